"""python -m layertext -i images -o outputs --reader module:function

The reader's module must be importable on the executors.
"""

from __future__ import annotations

import argparse
import importlib
import logging

from pyspark.sql import SparkSession

from layertext.operators import images
from layertext.plans import extraction
from layertext.sources import files, scratch


def options(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="layertext", description="Images to layered documents")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", required=True, help="a folder that all executors share")
    p.add_argument("-f", "--format", choices=["psd", "json", "both"], default="both")
    p.add_argument("--reader", required=True, help="module:function that reads a strip, see layertext.plans.extraction")
    p.add_argument("--detection-size", type=int, default=2048)
    p.add_argument("--text-threshold", type=float, default=0.5)
    p.add_argument("--box-threshold", type=float, default=0.7)
    p.add_argument("--inpaint", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--inpainting-size", type=int, default=2048)
    p.add_argument("--speller", help="module:function of the Columns text and lang; Korean texts are corrected by it")
    p.add_argument("-v", "--verbose", action="store_true")
    return p.parse_args(args)


def named(spec: str):
    module, _, function = spec.partition(":")
    return getattr(importlib.import_module(module), function)


def main(args: list[str] | None = None) -> int:
    o = options(args)
    logging.basicConfig(level=logging.DEBUG if o.verbose else logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    ports = extraction.Ports(read=named(o.reader), paint=images.filled if o.inpaint else None, correct=named(o.speller) if o.speller else None)
    limits = extraction.Limits(side=o.detection_size, paint_side=o.inpainting_size, pixel=o.text_threshold, box=o.box_threshold)
    spark = SparkSession.builder.appName("layertext").getOrCreate()
    decoded = files.decoded(spark, o.input)
    documents = scratch.written(extraction.merged(extraction.lines(decoded, ports, limits), limits, ports.correct), "documents")
    failed = 0
    for row in extraction.write(decoded, documents, o.output, ports, limits, o.format).toLocalIterator():
        if row.error is None:
            logging.info("%s: %s", row.path, ", ".join(row.outputs))
        else:
            failed += 1
            logging.error("%s: %s", row.path, row.error)
    return int(failed > 0)


if __name__ == "__main__":
    raise SystemExit(main())
