"""Components, and what their distances tell, of the lines of many pages at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layertext.operators import paged, pairs


#: A gap of so many fonts above one parts two lines.
GAMMA = 0.5


def _roots(n: int, us: list[int], vs: list[int]) -> list[int]:
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for u, v in zip(us, vs, strict=True):
        a, b = sorted((top(u), top(v)))
        up[b] = a
    return [top(i) for i in range(n)]


def labelled(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """lines with comp: the least line_id of each line's component; lines without edges are their own.

    The lines of a page are one row, so what follows by page needs no shuffle of its own.
    """

    @F.pandas_udf("array<int>")
    def label(n: pd.Series, us: pd.Series, vs: pd.Series) -> pd.Series:
        return pd.Series([_roots(a, [] if u is None else list(u), [] if v is None else list(v)) for a, u, v in zip(n, us, vs, strict=True)])

    others = [c for c in lines.columns if c not in ("page_id", "line_id")]
    pages = lines.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("line_id", *others))).alias("m"))
    pairs = edges.groupBy("page_id").agg(F.collect_list(F.struct("u", "v")).alias("e"))
    linked = pages.join(pairs, "page_id", "left").select("page_id", "m", label(F.array_max("m.line_id") + 1, F.col("e.u"), F.col("e.v")).alias("roots"))
    rows = linked.select("page_id", "roots", F.explode("m").alias("l"))
    return rows.select("page_id", "l.*", F.get("roots", F.col("l.line_id")).alias("comp"))


def tree(dist: np.ndarray, nodes: list[int]) -> list[tuple[float, int, int]]:
    """The edges (distance, from, to) of the minimum spanning tree of the nodes; of a pair dist[first, second] counts."""
    both = np.minimum(np.triu(dist, 1) + np.triu(dist, 1).T, np.inf)[np.ix_(nodes, nodes)]
    best, near, out = both[0].copy(), np.zeros(len(nodes), int), []
    best[0] = np.inf
    inside = np.zeros(len(nodes), bool)
    inside[0] = True
    for _ in range(len(nodes) - 1):
        v = int(np.argmin(np.where(inside, np.inf, best)))
        out.append((float(best[v]), nodes[near[v]], nodes[v]))
        inside[v] = True
        closer = both[v] < best
        best, near = np.where(closer, both[v], best), np.where(closer, v, near)
    return out


def split(dist: np.ndarray, touch: np.ndarray, fs: np.ndarray, cx: np.ndarray, cy: np.ndarray, angle: np.ndarray | None = None, gamma: float = GAMMA, sigma: float = 2.0) -> list[list[int]]:
    """Groups of a component's lines: the longest edges of the minimum spanning tree are cut while they stand out.

    Two lines stay together if they are near and their angles, in degrees, differ by less than 36.
    """

    def part(nodes: list[int]) -> list[list[int]]:
        if len(nodes) == 1:
            return [nodes]
        if len(nodes) == 2:
            a, b = nodes
            alike = angle is None or abs(angle[a] - angle[b]) < 36
            return [nodes] if alike and dist[a, b] < (1 + gamma) * max(fs[a], fs[b]) else [[a], [b]]
        edges = tree(dist, nodes)
        ds = np.array([t[0] for t in edges])
        d, u, v = max(edges)
        font = fs[nodes].mean()
        spread = ds.std()
        near = abs(cx[u] - cx[v]) < 5 or abs(cy[u] - cy[v]) < 5
        if (d <= ds.mean() + sigma * spread or d <= font * (1 + gamma)) and (spread < max(0.3 * font + 5, 5) or (touch[u, v] and near)):
            return [nodes]
        side, grown = {u}, True
        while grown:
            grown = False
            for e, a, b in edges:
                if (e, a, b) != (d, u, v) and (a in side) != (b in side):
                    side |= {a, b}
                    grown = True
        return [*part([n for n in nodes if n in side]), *part([n for n in nodes if n not in side])]

    return part(list(range(len(fs))))


def split_components(rows: DataFrame) -> DataFrame:
    """rows of lines with comp, with region: their component after splitting, named by its least line_id.

    deg, the lines' angles, is optional.  The lines of a component are one row.
    """
    others = [c for c in rows.columns if c not in ("page_id", "comp", "line_id")]
    turned = "deg" in others

    @F.pandas_udf("array<int>")
    def label(ids: pd.Series, xs: pd.Series, ys: pd.Series, ws: pd.Series, hs: pd.Series, degs: pd.Series) -> pd.Series:
        out = []
        for i, x, y, w, h, deg in zip(ids, xs, ys, ws, hs, degs, strict=True):
            if len(i) == 1:
                out.append([int(i[0])])
                continue
            x, y, w, h = (np.asarray(c, float) for c in (x, y, w, h))
            name = np.zeros(len(x), int)
            for group in split(pattern_distances(x, y, w, h), touching(x, y, w, h), np.minimum(w, h), x + w / 2, y + h / 2, np.asarray(deg, float) if turned else None):
                name[group] = min(int(i[g]) for g in group)
            out.append([int(k) for k in name])
        return pd.Series(out)

    found = rows.groupBy("page_id", "comp").agg(F.sort_array(F.collect_list(F.struct("line_id", *others))).alias("m"))
    found = found.select("page_id", "comp", "m", label("m.line_id", "m.x", "m.y", "m.w", "m.h", "m.deg" if turned else "m.x").alias("r"))
    return found.select("page_id", "comp", F.explode(F.arrays_zip(F.col("m").alias("l"), F.col("r").alias("region"))).alias("z")).select("page_id", "comp", "z.l.*", "z.region")


def components_of(dealt: DataFrame, test: pairs.Test) -> DataFrame:
    """(page_id, line_id, comp) of lines by page and in order, as from paged.dealt(), that the test joins."""

    def run(pages: paged.Pages) -> Iterator[pa.Table]:
        ids = pages.ids().astype(np.int32)
        root = paged.roots(len(ids), *pairs.linked(pages, test))
        yield pa.table([pages.table.column("page_id"), ids, ids[root]], names=["page_id", "line_id", "comp"])

    return paged.mapped(pairs.only(dealt), ["page_id"], run, f"page_id {dealt.schema['page_id'].dataType.simpleString()}, line_id int, comp int")


class Several:
    """The lines of the components of one size: rows [components, size], each in order."""

    def __init__(self, pages: paged.Pages, rows: np.ndarray) -> None:
        self.pages, self.rows = pages, rows

    def __getitem__(self, name: str) -> np.ndarray:
        return paged.numbers(self.pages.table, name)[self.rows]

    def distances(self) -> np.ndarray:
        """[components, size, size]"""
        return pattern_distances(*(self[c] for c in "xywh"))


def by_size(pages: paged.Pages, test: pairs.Test, most: int = 1 << 20) -> Iterator[Several]:
    """The components of two lines or more, by their size and in blocks of about that many distances."""
    order, starts = paged.grouped(paged.roots(len(pages.table), *pairs.linked(pages, test)))
    sizes = np.diff(np.r_[starts, len(order)])
    for k in np.unique(sizes[sizes > 1]).tolist():
        at = starts[sizes == k]
        step = max(1, most // (k * k))
        for i in range(0, len(at), step):
            yield Several(pages, order[at[i : i + step, None] + np.arange(k)])


def lengths(dist: np.ndarray) -> np.ndarray:
    """[components, size - 1]: the lengths of the edges that tree() finds, in its order."""
    up = np.triu(dist, 1)
    both = up + np.swapaxes(up, 1, 2)
    m, k, _ = both.shape
    each = np.arange(m)
    best = both[:, 0].copy()
    inside = np.zeros((m, k), bool)
    inside[:, 0] = True
    out = np.empty((m, k - 1))
    for i in range(k - 1):
        v = np.where(inside, np.inf, best).argmin(axis=1)
        out[:, i] = best[each, v]
        inside[each, v] = True
        best = np.minimum(best, both[each, v])
    return out


def tree_stats(dealt: DataFrame, test: pairs.Test) -> DataFrame:
    """(page_id, comp, n, mean_far, std_far): the edges of the minimum spanning tree of each component of several lines."""

    def run(pages: paged.Pages) -> Iterator[pa.Table]:
        ids = pages.ids().astype(np.int32)
        for some in by_size(pages, test):
            far = lengths(some.distances())
            n = np.full(len(far), far.shape[1], np.int32)
            yield pa.table([pages.table.column("page_id").take(some.rows[:, 0]), ids[some.rows[:, 0]], n, far.mean(axis=1), far.std(axis=1)], names=["page_id", "comp", "n", "mean", "std"])

    kind = dealt.schema["page_id"].dataType.simpleString()
    found = paged.mapped(pairs.only(dealt), ["page_id"], run, f"page_id {kind}, comp int, n int, mean double, std double")
    return found.select("page_id", "comp", "n", F.round("mean", 6).alias("mean_far"), F.round("std", 6).alias("std_far"))


def inside(dealt: DataFrame, test: pairs.Test) -> DataFrame:
    """(page_id, comp, u, v, far, fs2, turn, n): the pairs of lines of a component, with their distance, larger font, difference
    of angles (deg), and how many lines the component has."""

    def run(pages: paged.Pages) -> Iterator[pa.Table]:
        ids = pages.ids().astype(np.int32)
        for some in by_size(pages, test):
            k = some.rows.shape[1]
            a, b = np.triu_indices(k, 1)
            fs, deg, page = some["fs"], some["deg"], pages.table.column("page_id")
            columns = [np.repeat(ids[some.rows[:, 0]], len(a)), ids[some.rows[:, a]].ravel(), ids[some.rows[:, b]].ravel(), some.distances()[:, a, b].ravel()]
            columns += [np.fmax(fs[:, a], fs[:, b]).ravel(), np.abs(deg[:, a] - deg[:, b]).ravel(), np.full(len(fs) * len(a), k, np.int32)]
            yield pa.table([page.take(np.repeat(some.rows[:, 0], len(a))), *columns], names=["page_id", "comp", "u", "v", "far", "fs2", "turn", "n"])

    kind = dealt.schema["page_id"].dataType.simpleString()
    return paged.mapped(pairs.only(dealt, "deg"), ["page_id"], run, f"page_id {kind}, comp int, u int, v int, far double, fs2 double, turn double, n int")


def split_linked(dealt: DataFrame, test: pairs.Test) -> DataFrame:
    """(page_id, line_id, region): the component of each line after splitting by split(), named by its least line_id."""

    def run(pages: paged.Pages) -> Iterator[pa.Table]:
        ids = pages.ids().astype(np.int32)
        region = ids.copy()
        for some in by_size(pages, test):
            x, y, w, h, deg = (some[c] for c in ("x", "y", "w", "h", "deg"))
            far, fs = some.distances(), np.minimum(w, h)
            cx, cy = x + w / 2, y + h / 2
            if some.rows.shape[1] == 2:
                kept = (np.abs(deg[:, 0] - deg[:, 1]) < 36) & (far[:, 0, 1] < (1 + GAMMA) * fs.max(axis=1))
                region[some.rows[kept, 1]] = ids[some.rows[kept, 0]]
                continue
            for i, rows in enumerate(some.rows):
                for group in split(far[i], touching(x[i], y[i], w[i], h[i]), fs[i], cx[i], cy[i], deg[i]):
                    region[rows[group]] = ids[rows[min(group)]]
        yield pa.table([pages.table.column("page_id"), ids, region], names=["page_id", "line_id", "region"])

    return paged.mapped(pairs.only(dealt, "deg"), ["page_id"], run, f"page_id {dealt.schema['page_id'].dataType.simpleString()}, line_id int, region int")


def touching(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """[n, n]: whether two boxes touch or overlap."""
    apart = lambda at, size: (at[None, :] - at[:, None] - size[:, None] > 0) | (at[:, None] - at[None, :] - size[None, :] > 0)
    return ~apart(x, w) & ~apart(y, h)


def pattern_distances(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, rho: float = 0.5) -> np.ndarray:
    """[.., n, n]: functions.geometry.pattern_distance of each box to each other one of its group."""
    off = lambda v: v[..., :, None] - v[..., None, :]
    mean = lambda v: (v[..., :, None] + v[..., None, :]) / 2
    thin = np.minimum(w, h)
    fs = np.minimum(thin[..., :, None], thin[..., None, :])
    starts, ends, middles = off(x), off(x + w), off(np.floor(x + w / 2))
    left, right, middle = (mean(h) * np.abs(g) / fs for g in (starts, ends, middles))
    across = np.where((right < fs * rho) & (right < left), ends, starts)
    across = np.where((middle < fs * rho) & (middle < left) & (middle < right), middles, across)
    top, bottom = mean(w) * np.abs(off(y)) / fs, mean(w) * np.abs(off(y + h)) / fs
    low = (bottom < fs * rho) & (bottom < top)
    far = lambda x, y: np.sqrt(x * x + y * y)
    down = np.where(low, far(ends, off(y + h)), far(starts, off(y)))
    return np.where((w > h)[..., :, None], far(across, off(y)), down)
