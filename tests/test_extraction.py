"""Generated images through detection, merging, painting and every output; raster operators on small arrays."""

import json
import struct

import numpy as np
import pytest

from layertext.functions import layout
from layertext.operators import images
from layertext.plans import extraction
from layertext.sources import files, layered


def unpack(data, width):
    out, i = [], 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += [data[i + 1]] * (257 - n)
            i += 2
    assert len(out) == width
    return out


@pytest.mark.parametrize("row", [[], [7], [7, 7], [7] * 300, list(range(256)) * 2, [1, 1, 2, 2, 2, 3] * 50, [5, *[6] * 129, 5]])
def test_packed_rows_round_trip(row):
    row = np.array([v % 256 for v in row], np.uint8)
    assert unpack(layered.packed(row), len(row)) == row.tolist()


def test_geometry_of_rasters():
    square = np.array([[0, 0], [4, 0], [4, 4], [0, 4], [2, 2]])
    assert len(images.hull(square)) == 4
    a = np.radians(30)
    turned = np.array([[0, 0], [20, 0], [20, 6], [0, 6]]) @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])
    sides = np.roll(images.least_rect(turned), -1, axis=0) - images.least_rect(turned)
    assert sorted(np.hypot(*sides.T).round(6).tolist()) == [6, 6, 20, 20]
    assert np.ptp(images.grown(np.array([[0.0, 0], [20, 0], [20, 10], [0, 10]]), 1.5), axis=0).tolist() == [30, 20]
    assert images.ellipse(3).tolist() == [[False, True, False], [True] * 3, [False, True, False]]
    one = np.zeros((7, 7), bool)
    one[3, 3] = True
    assert images.dilated(one, 3).sum() == 5


def test_resizing_tiles_and_filling():
    flat = np.full((30, 50, 3), 77, np.uint8)
    assert (images.resized(flat, 11, 90) == 77).all() and images.bordered(flat).shape == (400, 400, 3)
    fitted, scale = images.fitted(flat, 100)
    assert fitted.shape == (256, 256, 3) and scale == 2 and (fitted[:60, :100] == 77).all() and not fitted[60:].any()
    long = np.random.default_rng(1).random((1000, 40))
    for image in (long, long.T):
        assert np.allclose(images.by_tiles(image, 100, lambda p: p), image)
    assert images.tiles(1000, 40, 100)[-1][1] == 1000
    mask = np.zeros((30, 50), bool)
    mask[10:20, 10:40] = True
    holed = np.where(mask[..., None], 0, flat).astype(np.uint8)
    assert (images.filled(holed, mask) == 77).all() and (images.filled(flat, np.ones((30, 50), bool)) == 77).all()
    assert (images.bilateral(flat) == 77).all()
    assert not images.darkness(flat).any()


def test_strips_keep_their_content():
    image = np.zeros((60, 120, 3), np.uint8)
    image[20:40, 30:60], image[20:40, 60:90] = 50, 200
    wide = images.strip(image, np.array([[30, 20], [89, 20], [89, 39], [30, 39]]), False)
    assert wide.shape[0] == 48 and (wide[:, 5] == 50).all() and (wide[:, -5] == 200).all()
    tall = images.strip(image.swapaxes(0, 1).copy(), np.array([[20, 30], [39, 30], [39, 89], [20, 89]]), True)
    assert tall.shape[0] == 48 and (tall[:, 5] == 50).all() and (tall[:, -5] == 200).all()


def test_masks_go_to_lines():
    mask = np.zeros((80, 120), bool)
    mask[12:24, 14:20] = mask[60:70, 100:112] = mask[40, 40] = True
    out = images.line_mask(mask, [(10, 10, 60, 18)])
    assert out[12:24, 14:20].all() and not out[55:75, 95:].any() and not out[40, 40]
    assert not images.line_mask(mask, []).any()


def test_layout():
    assert layout.rows("abcd", 10, 10) == ["ab", "cd"] and layout.rows("漢漢", 10, 5) == ["漢", "漢"] and layout.rows("", 10, 5) == []
    assert layout.columns("ab\ncd", 10, 100) == ["ab", "cd"] and layout.columns("abcd", 10, 20) == ["a", "b", "c", "d"]
    wide, high, chars = layout.placed("ab\nc", 10, 40, 50, True)
    assert (wide, high) == (48, 58) and chars[0][1] > chars[2][1] and chars[2][2] == chars[0][2]


def test_scripts_escape_and_skip_blanks():
    region = dict(text='a"\\\n b', x=1, y=2, width=9, height=9, font_size=4, fg_color=[1, 2, 3], direction="v")
    made = layered.script([dict(region, text="  "), region])
    row = json.loads(made[made.index("[\n") : made.index("\n];") + 2])
    assert row == [dict(name='Text 2: a"\\  b', text='a"\\\r b', size=10, x=1, y=10, vertical=True, color=[1, 2, 3])]
    assert layered.script([dict(region, text=" ")]) == "" == layered.script([])


def page(bars, size=(500, 600)):
    out = np.full((*size, 3), 255, np.uint8)
    for x, y, w, h in bars:
        out[y : y + h, x : x + w] = (10, 20, 30)
    return out


def test_images_to_documents(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    (source / "sub").mkdir(parents=True)
    for name, bars in (("two.png", [(100, 100, 200, 20), (100, 140, 200, 20), (400, 400, 20, 90)]), ("blank.png", []), ("sub/two.png", [(50, 60, 90, 18)])):
        (source / name).write_bytes(layered.png(page(bars)))
    (source / "bad.png").write_bytes(b"none")
    ports = extraction.Ports(read=lambda strip: (f"w{strip.shape[1]}", 0.9, (10, 20, 30), (255, 255, 255)))
    decoded = files.decoded(spark, str(source))
    documents = extraction.merged(extraction.lines(decoded, ports))
    rows = {r.path.rpartition("/in/")[2]: r for r in extraction.write(decoded, documents, target, ports).collect()}
    assert {k for k, r in rows.items() if r.error} == {"bad.png"} and not rows["bad.png"].outputs
    kinds = {k: sorted(o.rpartition(".")[2] for o in r.outputs) for k, r in rows.items()}
    assert kinds["two.png"] == kinds["sub/two.png"] == sorted(["jsx", "json", "png", "psd"])
    assert kinds["blank.png"] == ["json", "psd"]
    outputs = {o.rpartition(".")[2]: o for o in rows["two.png"].outputs}
    found = json.loads(open(outputs["json"], encoding="utf-8").read())
    # lines are numbered as they are read, the narrowest strips first
    assert found["image_width"] == 600 and [r["direction"] for r in found["regions"]] == ["v", "h"]
    first = found["regions"][1]
    assert first["fg_color"] == [10, 20, 30] and first["text"].count("w") == 2 and first["direction"] == "h"
    # a region's confidence is weighted by its share of the areas of the whole page, so the regions' multiply to the lines'
    assert np.prod([r["confidence"] for r in found["regions"]]) == pytest.approx(0.9, abs=1e-5)
    assert first["x"] < 100 < 300 < first["x"] + first["width"] and len(first["polygon"]) == 4
    data = open(outputs["psd"], "rb").read()
    assert data[:4] == b"8BPS" and struct.unpack(">HII", data[12:22]) == (3, 500, 600)
    assert all(n in data for n in (b"Original Image", b"Inpainted (Text Removed)", b"Text Layers", b"Text 2: w"))
    clean = {r.path: r for r in files.decoded(spark, target).collect()}
    kept = next(r for p, r in clean.items() if outputs["png"].rpartition("/")[2] in p)
    assert extraction.pixels(kept.data, kept.height, kept.width, kept.n_channels).min() == 255


def test_strips_are_read_in_batches_by_width():
    strips = [np.full((48, 10 + 7 * (i % 20), 3), i, np.uint8) for i in range(40)]
    seen = []

    def many(held, widths):
        assert held.shape[2] == max(widths) + 7 and len(held) <= 16 and sorted(widths) == widths
        assert all(not held[k, :, w:].any() for k, w in enumerate(widths))
        seen.append(len(held))
        return [(str(int(x[0, 0, 0])), 0.9, (0, 0, 0), (0, 0, 0)) for x in held]

    ports = extraction.Ports(read=lambda strip: (str(int(strip[0, 0, 0])), 0.9, (0, 0, 0), (0, 0, 0)))
    one = extraction.read_strips(strips, ports)
    assert one == extraction.read_strips(strips, extraction.Ports(read=ports.read, read_many=many)) and seen == [16, 16, 8]
    assert [i for i, _ in one] == sorted(range(40), key=lambda i: i % 20) and all(t == str(i) for i, (t, *_) in one)
