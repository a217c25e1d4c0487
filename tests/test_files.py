"""Image files, output folders and the stream of arriving files, on generated images."""

import json
import struct
import zlib

from pyspark.sql import functions as F

from layertext.functions import geometry
from layertext.sources import files
from layertext.streaming import folder


def png(width, height):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\x00" + b"\xff\x00\x10" * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def folder_of(path):
    (path / "sub").mkdir()
    for name in ("p10.png", "p2.png", "p1.PNG", "sub/p1.png"):
        (path / name).write_bytes(png(5, 3))
    (path / "notes.txt").write_text("no image")
    (path / "bad.png").write_bytes(b"no image either")


def test_listing_order_and_collisions(spark, tmp_path):
    folder_of(tmp_path)
    rows = files.collisions(files.listed(spark, str(tmp_path))).orderBy("folder", "order").select("base", "same_output").collect()
    assert [tuple(r) for r in rows] == [("bad", 1), ("p1", 2), ("p2", 1), ("p10", 1), ("p1", 2)]


def test_bad_images_stand_aside(spark, tmp_path):
    folder_of(tmp_path)
    rows = files.decoded(spark, str(tmp_path)).collect()
    assert sorted((r.width, r.height, r.error) for r in rows if r.error is None) == [(5, 3, None)] * 4
    assert [r.path.rpartition("/")[2] for r in rows if r.error] == ["bad.png"]
    good = next(r for r in rows if r.error is None)
    assert bytes(good.data[:3]) == b"\x10\x00\xff"  # blue, green, red


def test_documents_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "é 한"), ("b/c", "x"), ("n", None)], "base string, document string")
    rows = rows.withColumn("document", F.when(F.col("document").isNotNull(), F.to_json(F.struct("document"))))
    files.write_documents(rows, str(tmp_path / "out"))
    read = spark.read.text(str(tmp_path / "out")).collect()
    assert sorted((r.base, json.loads(r.value)["document"]) for r in read) == [("a", "é 한"), ("b/c", "x")]


def test_arriving_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    folder_of(tmp_path / "in")
    stream = folder.arriving(spark, str(tmp_path / "in")).select("base", F.length("content").alias("n"))
    run = stream.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    assert run.awaitTermination(60)
    assert sorted(r.base for r in spark.table("arrived").collect()) == ["bad", "p1", "p1", "p10", "p2"]


def test_segment_without_length_and_tiles(spark):
    n = [F.lit(v) for v in (3, 4, 0, 0, 0, 0)]
    row = spark.range(1).select(geometry.segment_distance(*n).alias("far"), geometry.needs_tiles(F.lit(100), F.lit(700), 256).alias("tiles"), geometry.needs_tiles(F.lit(100), F.lit(300), 100).alias("equal")).first()
    assert (row.far, row.tiles, row.equal) == (5.0, True, False)


def test_a_single_file_of_any_name_is_taken(spark, tmp_path):
    folder_of(tmp_path)
    (tmp_path / "page").write_bytes(png(5, 3))
    assert [r.base for r in files.listed(spark, str(tmp_path / "page")).collect()] == ["page"]
    assert [(r.width, r.height) for r in files.decoded(spark, str(tmp_path / "page")).collect()] == [(5, 3)]
    assert "page" not in {r.base for r in files.listed(spark, str(tmp_path)).collect()}


def test_digests_are_compared(spark, tmp_path):
    import hashlib

    folder_of(tmp_path)
    rows = files.listed(spark, str(tmp_path)).where("base = 'p2'").select("path", "content")
    path = rows.first().path
    for expected, want in ((hashlib.sha256(png(5, 3)).hexdigest().upper(), True), ("00", False)):
        assert [r.intact for r in files.checked(rows, spark.createDataFrame([(path, expected)], "path string, expected string")).collect()] == [want]


def test_dictionary_and_texts(spark, tmp_path):
    from layertext.operators import beam
    from layertext.sources import dictionary

    (tmp_path / "d.txt").write_bytes("<S>\n</S>\r\n<SP>\n漢\n\nend".encode())
    entries = dictionary.load(spark, str(tmp_path / "d.txt"))
    assert [r.char for r in entries.orderBy("tok").collect()] == ["<S>", "</S>", "<SP>", "漢", "", "en"]
    tokens = spark.createDataFrame([(1, s, t) for s, t in enumerate([0, 3, 2, 5, 1, 3])] + [(2, 0, 4), (2, 1, 99)], "vec_id long, step int, tok int")
    assert {r.vec_id: r.text for r in beam.detokenised(tokens, entries).collect()} == {1: "漢 en", 2: ""}


def test_colours_of_tokens(spark):
    from layertext.operators import beam

    rows = [(1, [0.5, 0.0, 1.0], [0.1, 0.2, 0.3], True, False), (1, [0.25, 1.0, 1.0], [0.9, 0.9, 0.9], False, True), (2, [0.1] * 3, [0.2] * 3, False, True)]
    df = spark.createDataFrame(rows, "vec_id long, fg array<double>, bg array<double>, has_fg boolean, has_bg boolean")
    got = {r.vec_id: (r.fg, r.bg) for r in beam.folded_colours(df).collect()}
    assert got == {1: ([127, 0, 255], [(127 + 229) // 2, 229 // 2, (255 + 229) // 2]), 2: ([0, 0, 0], [51, 51, 51])}


def test_what_a_network_takes():
    import numpy as np

    from layertext.operators import images

    image = np.zeros((2, 3, 3), np.uint8)
    image[0, 0] = [255, 0, 51]
    got = images.normalised(image)
    assert got.shape == (3, 2, 3) and got[0, 0, 0] == 1 and got[1, 0, 0] == -1 and abs(got[2, 0, 0] + 0.6) < 1e-6
    mask = images.mask_levels(np.full((4, 6), 2.0), (2, 0))
    assert mask.shape == (6, 12) and (mask == 255).all()
