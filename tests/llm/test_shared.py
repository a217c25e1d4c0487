"""Tables in the shared folder."""

from __future__ import annotations

import glob

from layertext.llm import shared
from layertext.sources import scratch


def test_result_deletes_what_was_written_on_the_way(spark):
    folder = scratch.folder(spark).removeprefix("file://")

    def build():
        first = shared.written(spark.range(5), "way-first")
        inner = shared.result(spark, lambda: shared.written(first.where("id > 1"), "way-inner").where("id > 2"), "way-second")
        return first.unionByName(inner)

    found = shared.result(spark, build, "way-result")
    assert sorted(r.id for r in found.collect()) == [0, 1, 2, 3, 3, 4, 4]
    left = {p.rpartition("/")[2].rpartition("-")[0] for p in glob.glob(f"{folder}/layertext/way-*")}
    assert left == {"way-result"}


def test_result_deletes_after_a_failure(spark):
    folder = scratch.folder(spark).removeprefix("file://")

    def build():
        shared.written(spark.range(5), "lost-first")
        raise ValueError("no result")

    try:
        shared.result(spark, build, "lost-result")
    except ValueError:
        pass
    assert not glob.glob(f"{folder}/layertext/lost-*")
    assert shared.written(spark.range(3), "after").count() == 3
