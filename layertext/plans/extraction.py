"""From image files to layered documents: detect, read, merge, paint over and write.

Ports are plain functions given by the caller, as no trained network can be had here:

- scores(image) -> [height, width] of 0..1; for want of a network images.darkness;
- read(strip) -> (text, probability, foreground, background), colours as three numbers each; has no stand-in;
- read_many(strips, widths) -> a list of the same, for a network that takes a batch: BATCH strips of the narrowest, then the
  next, side by side in one array that is black right of each; without it they are read one by one;
- smooth(image) -> image, before detection of an image that is not tiled; images.bilateral;
- paint(image, mask) -> image; for want of a network images.filled;
- correct(text, lang) -> text, as Columns; leaves texts as they are unless given.

An image that cannot be decoded or on which a port fails gets an error and no outputs; the others go on.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layertext.functions import text
from layertext.operators import graph, images, pairs, quads, regions
from layertext.sources import layered, scratch

Reader = Callable[[np.ndarray], tuple[str, float, tuple[int, int, int], tuple[int, int, int]]]

#: Strips that are read at once.
BATCH = 16
QUADS = "page_id string, line_id int, quad array<struct<x:int,y:int>>, width int, height int, error string"
LINES = "page_id string, line_id int, quad array<struct<x:int,y:int>>, prob double, txt string, fg array<int>, bg array<int>, width int, height int, error string"
REGION = "text string, x int, y int, width int, height int, angle double, polygon array<array<int>>, font_size int, fg_color array<int>, bg_color array<int>, bold boolean, italic boolean, direction string, alignment string, source_lang string, confidence double, line_spacing double, letter_spacing double, text_corrected string"


@dataclass(frozen=True)
class Ports:
    read: Reader
    scores: Callable[[np.ndarray], np.ndarray] = images.darkness
    paint: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = images.filled
    smooth: Callable[[np.ndarray], np.ndarray] = images.bilateral
    correct: Callable[[Column, Column], Column] | None = None
    read_many: Callable[[np.ndarray, list[int]], list[tuple]] | None = None


@dataclass(frozen=True)
class Limits:
    side: int = 2048
    paint_side: int = 2048
    pixel: float = 0.5
    box: float = 0.7
    grow: float = 2.3
    read: float = 0.2


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Red, green, blue from Spark's blue, green, red; grey is repeated and transparency is left out."""
    image = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(image, 3, axis=2) if channels == 1 else image[..., 2::-1].copy()


def found_quads(image: np.ndarray, ports: Ports, limits: Limits) -> list[np.ndarray]:
    """The quads of an image's lines."""
    framed = images.bordered(image) if min(image.shape[:2]) < 400 else image
    scale = min(limits.side / max(framed.shape[:2]), 1)
    tiled = max(framed.shape[:2]) / limits.side > 2.5 and max(framed.shape[:2]) > 3 * min(framed.shape[:2])
    if tiled:
        scale, small = 1.0, framed
    else:
        small = ports.smooth(framed)
        small = small if scale == 1 else images.resized(small, *(max(round(n * scale), 1) for n in framed.shape[:2]))
    height, width = image.shape[:2]
    scores = images.by_tiles(small, limits.side, ports.scores)[: round(height * scale), : round(width * scale)]
    out = []
    for quad, _ in images.boxes(scores, limits.pixel, limits.box, limits.grow):
        quad = quad / scale
        if (quad.min(axis=0) >= [width, height]).all():  # beyond the image both ways
            continue
        quad = np.clip(quad, 0, [width, height]).astype(int)
        sides = np.hypot(*(np.roll(quad, -1, axis=0) - quad).T)
        if sides[0] * sides[1] > 16:
            out.append(quad)
    return out


def read_strips(strips: list[np.ndarray], ports: Ports) -> list[tuple[int, tuple]]:
    """(strip, what was read) in the order of the strips' widths, in which they are read."""
    order = sorted(range(len(strips)), key=lambda i: strips[i].shape[1])
    out: list[tuple[int, tuple]] = []
    for at in range(0, len(order), BATCH):
        part = order[at : at + BATCH]
        if ports.read_many is None:
            found = [ports.read(strips[i]) for i in part]
        else:
            widths = [strips[i].shape[1] for i in part]
            held = np.zeros((len(part), strips[part[0]].shape[0], max(widths) + 7, 3), np.uint8)
            for k, i in enumerate(part):
                held[k, :, : widths[k]] = strips[i]
            found = ports.read_many(held, widths)
        out += zip(part, found, strict=True)
    return out


def corner_order(quad: np.ndarray) -> tuple[np.ndarray, bool]:
    """quads.ordered() for one quad."""
    run = np.roll(quad, -1, axis=0) - quad
    longest = run[int(np.argmax(np.hypot(*run.T)))]
    vertical = bool(abs(longest[0]) <= abs(longest[1]))
    rows = quad[np.lexsort((quad[:, 0], quad[:, 1]) if vertical else (quad[:, 1], quad[:, 0]))]
    first, last = (sorted(half.tolist(), key=lambda p: (p[0], p[1]) if vertical else (p[1], p[0])) for half in (rows[:2], rows[2:]))
    return np.array([first[0], first[1], last[1], last[0]] if vertical else [first[0], last[0], last[1], first[1]]), vertical


def detected(decoded: DataFrame, ports: Ports, limits: Limits = Limits()) -> DataFrame:
    """The quads of each image of files.decoded(); an image without any, or with an error, has one row with a null line_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.itertuples():
                if isinstance(r.error, str):
                    out.append((r.path, None, None, None, None, r.error))
                    continue
                try:
                    size = (int(r.width), int(r.height))
                    got = found_quads(pixels(r.data, size[1], size[0], int(r.n_channels)), ports, limits)
                    out += [(r.path, i, [dict(x=int(x), y=int(y)) for x, y in q], *size, None) for i, q in enumerate(got)] or [(r.path, None, None, *size, None)]
                except Exception as e:  # one image must not stop the others
                    out.append((r.path, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield framed_rows(out, QUADS)

    return decoded.mapInPandas(run, QUADS)


def framed_rows(rows: list[tuple], schema: str) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype(object)
    return frame.where(frame.notna(), None)


def reading_groups(found: DataFrame) -> DataFrame:
    """(page_id, strips, failed) of the images of detected(): their quads in the order of the groups that read in one direction,
    each with the direction of its group; and the error."""
    rows = quads.measured(found.where("line_id is not null").select("page_id", "line_id", "quad"))
    rows = rows.withColumn("direction", F.when(F.col("vertical"), "v").otherwise("h"))
    placed = regions.reading_order(graph.labelled(rows, quads.edges(rows, pairs.READ)))
    strips = placed.groupBy("page_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("comp", "place", "quad", "dir")))).alias("strips"))
    return found.groupBy("page_id").agg(F.max("error").alias("failed")).join(strips, "page_id", "left")


def lines(decoded: DataFrame, ports: Ports, limits: Limits = Limits()) -> DataFrame:
    """The lines of each image of files.decoded(), as they are read; an image without lines, or with an error, has one row with
    a null line_id.  The quads are written once, so that no image is detected again for the groups."""
    rows = decoded.join(reading_groups(scratch.written(detected(decoded, ports, limits), "quads")), F.col("path") == F.col("page_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.itertuples():
                if isinstance(r.failed, str):
                    out.append((r.path, None, None, None, None, None, None, None, None, r.failed))
                    continue
                try:
                    size = (int(r.width), int(r.height))
                    image = pixels(r.data, size[1], size[0], int(r.n_channels))
                    found = json.loads(r.strips) if isinstance(r.strips, str) else []
                    corners = [np.array([[p["x"], p["y"]] for p in x["quad"]]) for x in found]
                    strips = [images.strip(image, corner_order(q)[0], x["dir"] == "v") for q, x in zip(corners, found, strict=True)]
                    got = [(i, [dict(x=int(x), y=int(y)) for x, y in corners[k]], float(p), t, [int(c) for c in fg], [int(c) for c in bg]) for i, (k, (t, p, fg, bg)) in enumerate(read_strips(strips, ports))]
                    out += [(r.path, *x[:2], *x[2:], *size, None) for x in got] or [(r.path, None, None, None, None, None, None, *size, None)]
                except Exception as e:  # one image must not stop the others
                    out.append((r.path, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield framed_rows(out, LINES)

    return rows.mapInPandas(run, LINES)


def merged(found: DataFrame, limits: Limits = Limits(), correct: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(page_id, width, height, error, regions) of every image of lines(), the regions in order; none is an empty list.

    The lines and their groups are written once each, so that no image is detected or read again for another column.
    """
    found = scratch.written(found, "lines")
    pages = found.groupBy("page_id").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.max("error").alias("error"))
    rows = found.where("line_id is not null").where((F.col("prob") >= limits.read) & F.col("txt").rlike("(?U)\\S")).drop("width", "height")
    rows = quads.measured(rows).withColumns(
        {
            "direction": F.when(F.col("vertical"), "v").otherwise("h"),
            "ar": F.col("w") / F.greatest("h", F.lit(1)),
            "cx": F.aggregate("quad", F.lit(0.0), lambda a, p: a + p.x / 4),
            "cy": F.aggregate("quad", F.lit(0.0), lambda a, p: a + p.y / 4),
            "deg": F.coalesce(F.degrees("angle"), F.lit(90.0)),
        }
    )
    groups = graph.split_components(graph.labelled(rows, quads.edges(rows, pairs.MERGE)))
    rows = scratch.written(groups.withColumn("comp", F.col("region")).drop("region"), "groups")
    region = regions.all_columns(rows).withColumnsRenamed({"fg": "fg_color", "bg": "bg_color"}).join(rectangles(rows), regions.KEYS)
    size = F.when(F.col("font_size") > 0, F.col("font_size")).otherwise(20)
    shown = F.regexp_replace("text", "(?U)^\\s+|\\s+$", "")
    lang = text.script_language(F.col("text"))
    gated = text.corrected(shown, lang, correct) if correct is not None else F.lit("")
    fixed = {"text": shown, "font_size": size, "bold": F.lit(False), "italic": F.lit(False), "alignment": F.lit("left"), "source_lang": lang, "line_spacing": F.lit(1.0), "letter_spacing": F.lit(1.0), "text_corrected": gated}
    names = [c.split()[0] for c in REGION.split(", ")]
    region = region.withColumns(fixed).select(*regions.KEYS, F.struct(*names).cast(f"struct<{REGION.replace(' ', ':').replace(',:', ',')}>").alias("r"))
    listed = region.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("comp", "r"))), lambda s: s.r).alias("regions"))
    return pages.join(listed, "page_id", "left").withColumn("regions", F.coalesce("regions", F.array().cast(f"array<struct<{REGION.replace(' ', ':').replace(',:', ',')}>>")))


def rectangles(rows: DataFrame) -> DataFrame:
    """The least box of each region's corners in the frame that its lines' mean angle gives, as polygon."""
    turn = rows.groupBy(*regions.KEYS).agg((F.avg("deg") - 90).alias("a"), ((F.min("x") + F.max(F.col("x") + F.col("w"))) / 2).alias("cx"), ((F.min("y") + F.max(F.col("y") + F.col("h"))) / 2).alias("cy"))
    turn = turn.withColumn("angle", F.when(F.abs("a") < 3, 0.0).otherwise(F.col("a"))).drop("a")
    points = rows.select(*regions.KEYS, F.explode("quad").alias("p")).select(*regions.KEYS, "p.x", "p.y").join(turn, regions.KEYS)
    return quads.min_rect(points, regions.KEYS).select(*regions.KEYS, F.transform("quad", lambda c: F.array(c.x, c.y)).alias("polygon"))


def save(path: str, content: bytes) -> str:
    """Written beside and then renamed, so that a task that runs again leaves a whole file."""
    beside = f"{path}.{uuid.uuid4().hex}"
    with open(beside, "wb") as f:
        f.write(content)
    os.replace(beside, path)
    return path


def painted(image: np.ndarray, found: list[dict], ports: Ports, limits: Limits) -> np.ndarray:
    """The image without its text: dark pixels of the lines' boxes, grown, are painted over."""
    boxes = [(r["x"], r["y"], r["width"], r["height"]) for r in found]
    near = np.zeros(image.shape[:2], bool)
    for x, y, w, h in boxes:
        near[max(y, 0) : y + h, max(x, 0) : x + w] = True
    mask = images.line_mask((ports.scores(image) > limits.pixel) & near, boxes)
    scale = min(limits.paint_side / max(image.shape[:2]), 1)
    if scale == 1:
        out = ports.paint(image, mask)
    else:
        size = [max(round(n * scale), 1) for n in image.shape[:2]]
        out = images.resized(ports.paint(images.resized(image, *size), images.resized(mask.astype(np.uint8) * 255, *size) >= 127), *image.shape[:2])
    return np.where(mask[..., None], out, image)


def write(decoded: DataFrame, documents: DataFrame, folder: str, ports: Ports, limits: Limits = Limits(), form: str = "both") -> DataFrame:
    """Write the outputs of each image to a folder that all executors share; (path, outputs, error) of every image.

    form: json, psd (with the script) or both.  Images of one name in several folders would overwrite each other: theirs
    get a digest of the path at the end.
    """
    names = decoded.select("path").withColumn("base", F.regexp_extract("path", "([^/]+?)(?:\\.[^.]+)?$", 1))
    same = names.groupBy("base").agg(F.count("*").alias("same"))
    names = names.join(same, "base").select("path", F.when(F.col("same") > 1, F.concat_ws("-", "base", F.substring(F.sha2("path", 256), 1, 8))).otherwise(F.col("base")).alias("base"))
    plan = documents.select(F.col("page_id").alias("path"), F.to_json("regions").alias("regions"), F.col("error").alias("failed"))
    rows = decoded.join(names, "path").join(plan, "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            out = []
            for r in batch.itertuples():
                done: list[str] = []
                error = r.failed if isinstance(r.failed, str) else None
                try:
                    if error is None:
                        found, at = json.loads(r.regions), os.path.join(folder, r.base)
                        image = pixels(r.data, int(r.height), int(r.width), int(r.n_channels))
                        clean = painted(image, found, ports, limits) if found and ports.paint is not None else None
                        if clean is not None:
                            done.append(save(f"{at}_inpainted.png", layered.png(clean)))
                        if form in ("json", "both"):
                            done.append(save(f"{at}.json", layered.document(r.path, int(r.width), int(r.height), found, os.path.abspath(done[0]) if done else None).encode()))
                        if form in ("psd", "both"):
                            done.append(save(f"{at}.psd", layered.psd(image, found, clean)))
                            script = layered.script(found)
                            if script:
                                done.append(save(f"{at}.jsx", script.encode()))
                except Exception as e:  # one image must not stop the others
                    error = f"{type(e).__name__}: {e}"
                out.append((r.path, done, error))
            yield pd.DataFrame(out, columns=["path", "outputs", "error"])

    return rows.mapInPandas(run, "path string, outputs array<string>, error string")
