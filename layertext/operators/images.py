"""Operators on whole images, one image a call: arrays [height, width] or [height, width, 3] of uint8 in red, green, blue.

They run inside mapInPandas over the rows of an image table (see plans.extraction): an image is never larger than a row,
and rows are dealt out, so none of this gathers images.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np

from layertext.operators.raster import label, owner


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, between the middles of pixels; the type stays and integers are rounded."""
    h, w = image.shape[:2]

    def places(n: int, old: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n) + 0.5) * old / n - 0.5, 0, old - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, old - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = places(height, h), places(width, w)
    tail = (1,) * (image.ndim - 2)
    fx, fy = fx.reshape(1, -1, *tail), fy.reshape(-1, 1, *tail)
    rows = image.astype(np.float64)
    rows = rows[y0] * (1 - fy) + rows[y1] * fy
    out = rows[:, x0] * (1 - fx) + rows[:, x1] * fx
    return np.rint(out).astype(image.dtype) if np.issubdtype(image.dtype, np.integer) else out.astype(image.dtype)


def fitted(image: np.ndarray, side: int, multiple: int = 256) -> tuple[np.ndarray, float]:
    """The image with `side` as its longer side, black below and right up to multiples; and the scale."""
    h, w = image.shape[:2]
    scale = side / max(h, w)
    small = resized(image, max(round(h * scale), 1), max(round(w * scale), 1))
    pad = [(0, -n % multiple) for n in small.shape[:2]]
    return np.pad(small, pad + [(0, 0)] * (image.ndim - 2)), scale


def normalised(image: np.ndarray) -> np.ndarray:
    """What a network takes: levels of 0..255 as -1..1, and [channel, height, width]."""
    return np.moveaxis(image.astype(np.float32) / np.float32(127.5) - 1, 2, 0)


def mask_levels(scores: np.ndarray, pad: tuple[int, int]) -> np.ndarray:
    """A mask of scores at twice its size, without the padding (below, right), as levels of 0..255."""
    h, w = scores.shape
    large = resized(scores, 2 * h, 2 * w)[: 2 * h - pad[0], : 2 * w - pad[1]]
    return np.clip(large * 255, 0, 255).astype(np.uint8)


def bordered(image: np.ndarray, least: int = 400) -> np.ndarray:
    """The image in the top left of a black square of at least that side."""
    h, w = image.shape[:2]
    side = max(h, w, least)
    return np.pad(image, [(0, side - h), (0, side - w)] + [(0, 0)] * (image.ndim - 2))


def tiles(length: int, width: int, side: int) -> list[tuple[int, int]]:
    """(start, end) along the longer side: overlapping pieces of several widths each, evenly stepped to the end."""
    piece = max(2 * side // width, 2) * width
    n = -(-length // piece)
    step = (length - piece) // (n - 1) if n > 1 else 0
    return [(i * step, min(i * step + piece, length)) for i in range(n)]


def by_tiles(image: np.ndarray, side: int, map_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """map_of the image, [height, width]; of a long and narrow one by pieces.

    Where pieces overlap, each later one enters with half the weight, so the sum is the running mean of what overlaps.
    """
    h, w = image.shape[:2]
    if not (max(h, w) / side > 2.5 and max(h, w) > 3 * min(h, w)):
        return map_of(image)
    turned = w > h
    upright = image.swapaxes(0, 1) if turned else image
    out = np.zeros(upright.shape[:2])
    done = 0
    for start, end in tiles(*upright.shape[:2], side):
        piece = upright[start:end]
        found = map_of(piece.swapaxes(0, 1)).swapaxes(0, 1) if turned else map_of(piece)
        out[start:end] += found
        out[start : max(done, start)] /= 2
        done = end
    return out.swapaxes(0, 1) if turned else out


def bilateral(image: np.ndarray, size: int = 17, colour: float = 80, space: float = 80) -> np.ndarray:
    """Means over a disc weighted by nearness in place and in colour (sum of absolute differences); borders mirror."""
    radius = size // 2
    pixels = image.astype(np.float64).reshape(*image.shape[:2], -1)
    h, w = pixels.shape[:2]
    wide = np.pad(pixels, [(radius, radius), (radius, radius), (0, 0)], mode="reflect" if min(h, w) > radius else "edge")
    total, weight = np.zeros_like(pixels), np.zeros((h, w, 1))
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if dy * dy + dx * dx <= radius * radius:
                near = wide[radius + dy : radius + dy + h, radius + dx : radius + dx + w]
                off = np.abs(near - pixels).sum(-1, keepdims=True)
                by = np.exp(-off * off / (2 * colour * colour) - (dy * dy + dx * dx) / (2 * space * space))
                total += near * by
                weight += by
    return np.rint(total / weight).reshape(image.shape).astype(image.dtype)


def ellipse(size: int) -> np.ndarray:
    """The mask of an ellipse in a square: each row reaches as far as the rounded half chord."""
    r = size // 2
    if r == 0:
        return np.ones((size, size), bool)
    half = np.rint(r * np.sqrt(np.maximum(r * r - (np.arange(size) - r) ** 2.0, 0)) / r).astype(int)
    return np.abs(np.arange(size)[None] - r) <= half[:, None]


def dilated(mask: np.ndarray, size: int) -> np.ndarray:
    """A boolean mask grown by an ellipse."""
    r = size // 2
    wide = np.pad(mask, r)
    out = np.zeros_like(mask)
    for dy, dx in np.argwhere(ellipse(size)):
        out |= wide[dy : dy + mask.shape[0], dx : dx + mask.shape[1]]
    return out


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of [n, 2], in order."""
    rows = np.unique(points, axis=0)
    if len(rows) < 3:
        return rows

    def half(ps: np.ndarray) -> list[np.ndarray]:
        chain: list[np.ndarray] = []
        for p in ps:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        return chain[:-1]

    return np.array(half(rows) + half(rows[::-1]))


def least_rect(points: np.ndarray) -> np.ndarray:
    """[4, 2]: the rectangle of least area around points; one of its sides lies on a side of their hull."""
    corners = hull(np.asarray(points, float))
    run = np.roll(corners, -1, axis=0) - corners
    run = run[np.hypot(*run.T) > 0]
    run = run / np.hypot(*run.T)[:, None] if len(run) else np.array([[1.0, 0.0]])
    across = run[:, ::-1] * [-1, 1]
    u, v = corners @ run.T, corners @ across.T
    best = int(np.argmin((u.max(0) - u.min(0)) * (v.max(0) - v.min(0))))
    ends = [(u[:, best].min(), v[:, best].min()), (u[:, best].max(), v[:, best].min()), (u[:, best].max(), v[:, best].max()), (u[:, best].min(), v[:, best].max())]
    return np.array([a * run[best] + b * across[best] for a, b in ends])


def grown(quad: np.ndarray, ratio: float) -> np.ndarray:
    """A rectangle with its sides moved out by its area times ratio over its perimeter."""
    sides = np.roll(quad, -1, axis=0) - quad
    length = np.hypot(*sides.T)
    if not length.all():
        return quad
    by = length[0] * length[1] * ratio / length.sum()
    unit = sides / length[:, None]
    return quad + by * (np.roll(unit, 1, axis=0) - unit)


def boxes(scores: np.ndarray, threshold: float = 0.5, least: float = 0.7, grow: float = 2.3, most: int = 1000) -> list[tuple[np.ndarray, float]]:
    """(quad, mean score) of the 8-connected regions over the threshold, from the top left on, at most `most`.

    A region needs four hull corners, a mean score of `least`, and after growing a shorter side of 5.  The report's limit
    `most` is that of the detector that this stands for.
    """
    found = []
    for ys, xs in islice(parts(scores > threshold), most):
        mean = float(scores[ys, xs].mean())
        pixels = np.stack([xs, ys], 1)
        if len(hull(pixels)) < 4 or mean < least:
            continue
        quad = grown(least_rect(pixels), grow)
        if np.hypot(*(quad[[1, 2]] - quad[[0, 1]]).T).min() >= 5:
            found.append((quad, mean))
    return found


def strip(image: np.ndarray, quad: np.ndarray, vertical: bool, size: int = 48) -> np.ndarray:
    """What lies in the quad, warped to a strip of that height; a vertical line is turned a quarter against the clock."""
    q = np.asarray(quad, float)
    middle = (q + np.roll(q, -1, axis=0)) / 2
    down, over = np.hypot(*(middle[2] - middle[0])), np.hypot(*(middle[1] - middle[3]))
    ratio = max(down, 1e-9) / max(over, 1e-9)
    h, w = (max(round(size * ratio), 2), size) if vertical else (size, max(round(size / ratio), 2))
    lines, wants = [], []
    for (x, y), (u, v) in zip([(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)], q, strict=True):
        lines += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        wants += [u, v]
    m = np.append(np.linalg.lstsq(np.array(lines), np.array(wants), rcond=None)[0], 1).reshape(3, 3)
    ys, xs = np.mgrid[:h, :w]
    u, v, s = np.tensordot(m, np.stack([xs, ys, np.ones_like(xs)]), 1)
    out = sampled(image, u / s, v / s)
    return np.rot90(out).copy() if vertical else out


def sampled(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The image at places between its pixels, black outside."""
    h, w = image.shape[:2]
    wide = np.pad(image, [(1, 1), (1, 1)] + [(0, 0)] * (image.ndim - 2)).astype(float)
    x, y = np.clip(x, -1, w) + 1, np.clip(y, -1, h) + 1
    x0, y0 = np.minimum(np.floor(x).astype(int), w), np.minimum(np.floor(y).astype(int), h)
    tail = (...,) + (None,) * (image.ndim - 2)
    fx, fy = (x - x0)[tail], (y - y0)[tail]
    top = wide[y0, x0] * (1 - fx) + wide[y0, x0 + 1] * fx
    return np.rint(top * (1 - fy) + (wide[y0 + 1, x0] * (1 - fx) + wide[y0 + 1, x0 + 1] * fx) * fy).astype(image.dtype)


def parts(mask: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ys, xs) of the pixels of each 8-connected part, from the top left on."""
    flat = label(mask).ravel()
    cells = np.flatnonzero(flat >= 0)
    cells = cells[np.argsort(flat[cells], kind="stable")]
    for own in np.split(cells, np.flatnonzero(np.diff(flat[cells])) + 1):
        if len(own):
            yield np.divmod(own, mask.shape[1])


def line_mask(mask: np.ndarray, lines: list[tuple[int, int, int, int]], offset: int = 20, kernel: int = 3) -> np.ndarray:
    """The mask's parts that belong to lines (x, y, w, h), each line's share grown with its text size; boolean.

    The lines' frames cut the mask first.  A part over 9 pixels goes to the line that raster.owner() gives it.
    """
    cut = mask.astype(bool).copy()
    height, width = cut.shape
    for x, y, w, h in lines:
        for row in (y, y + h):
            if 0 <= row < height:
                cut[row, max(x, 0) : x + w + 1] = False
        for column in (x, x + w):
            if 0 <= column < width:
                cut[max(y, 0) : y + h + 1, column] = False
    shares: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    box = np.array(lines, float).reshape(-1, 4)
    for ys, xs in parts(cut):
        area, x, y, w, h = len(xs), int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1
        if area <= 9 or not len(box):
            continue
        line = owner(area, (x, y, w, h), box)
        if line < 0:
            continue
        shares.setdefault(line, []).append((ys, xs))
    out = np.zeros_like(cut)
    for line, own in shares.items():
        ys, xs = (np.concatenate(z) for z in zip(*own, strict=True))
        size = min(np.ptp(xs) + 1, np.ptp(ys) + 1, *box[line, 2:])
        reach = max(int((size + offset) * 0.3) // 2 * 2 + 1, 3)
        top, left = max(ys.min() - reach, 0), max(xs.min() - reach, 0)
        part = np.zeros((min(ys.max() + reach + 1, height) - top, min(xs.max() + reach + 1, width) - left), bool)
        part[ys - top, xs - left] = True
        out[top : top + part.shape[0], left : left + part.shape[1]] |= dilated(part, reach)
    return dilated(out, kernel)


def filled(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The image with the mask's pixels taken from their surroundings, ring by ring; stands for a trained network.

    A ring's pixels become the mean of their known neighbours.  A wholly masked image stays as it is.
    """
    out = image.astype(float).reshape(*image.shape[:2], -1)
    todo = mask.astype(bool).copy()
    if todo.all():
        return image.copy()
    h, w = todo.shape
    while todo.any():
        known = np.pad(~todo, 1)
        values = np.pad(out, [(1, 1), (1, 1), (0, 0)])
        moves = [(dy, dx) for dy in range(3) for dx in range(3) if (dy, dx) != (1, 1)]
        count = sum(known[dy : dy + h, dx : dx + w].astype(int) for dy, dx in moves)
        total = sum(values[dy : dy + h, dx : dx + w] * known[dy : dy + h, dx : dx + w, None] for dy, dx in moves)
        ring = todo & (count > 0)
        out[ring] = total[ring] / count[ring][:, None]
        todo &= ~ring
    return np.where(mask.astype(bool).reshape(h, w, *[1] * (image.ndim - 2)), np.rint(out).reshape(image.shape), image).astype(image.dtype)


def ignorable(region: np.ndarray, percent: int) -> bool:
    """Whether a region is no speech bubble: coloured, or its frame of two pixels neither nearly all dark nor nearly all light."""
    if not 1 <= percent <= 50:
        return False
    frame = np.ones(region.shape[:2], bool)
    frame[2:-2, 2:-2] = False
    dark = round(float((region[frame] <= 127).mean()), 6) * 100
    grey = region[..., :3] @ np.array([0.299, 0.587, 0.114])
    return percent <= dark <= 100 - percent or int((((region - grey[..., None]) ** 2).sum(-1) > 100).sum()) > 10


def darkness(image: np.ndarray) -> np.ndarray:
    """Scores of text for want of a trained network: 1 where a pixel is darker than the split of the image's levels, else 0.

    The split is the one between whose sides the levels vary most.  An image of one level has no text.
    """
    grey = np.rint(image.reshape(*image.shape[:2], -1)[..., :3].mean(-1)).astype(int)
    counts = np.bincount(grey.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(counts), counts.sum()
    mass = np.cumsum(counts * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = np.nan_to_num((mass[-1] * below / total - mass) ** 2 / (below * (total - below)), posinf=0)
    if spread.max() <= 0:
        return np.zeros(grey.shape)
    return (grey <= int(np.argmax(spread))).astype(float)
