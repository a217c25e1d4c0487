"""WARC archives: written with segmented records and chunked framing, read back by segment reassembly.

Spark's text writer ends each row with CR LF CR LF, which is how a WARC record ends; so rows of whole records make
archives, written by Spark's own committed writer into any store.  A file is one gzip member, not one for each record.  Records are cut into segments, so a
file of FILE_RECORDS records has a bounded size and can be read whole by one task.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layertext.llm import shared

#: Bytes of a record's block; of a chunk of the transfer framing; records of a file; payloads that may be revisited.
SEGMENT, CHUNK, FILE_RECORDS, REVISIT_FROM = 32_768, 8_192, 1_000, 1_000
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(p := payload[i : i + size]), p) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped.  A broken frame raises ValueError."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return f"WARC/1.0\r\n{lines}\r\n".encode() + block


def segments(ident: str, headers: list[tuple[str, object]], kind: str, block: bytes, size: int = SEGMENT) -> list[bytes]:
    """One record, or a first segment and its continuations."""
    if len(block) <= size:
        return [record([("WARC-Type", kind), ("WARC-Record-ID", f"<{ident}>"), *headers], block)]
    parts = [block[i : i + size] for i in range(0, len(block), size)]
    out = [record([("WARC-Type", kind), ("WARC-Record-ID", f"<{ident}>"), *headers, ("WARC-Segment-Number", 1)], parts[0])]
    for i, part in enumerate(parts[1:], 2):
        more = [("WARC-Segment-Total-Length", len(block))] if i == len(parts) else []
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{ident}:segment:{i}>"), ("WARC-Date", DATE)]
        out.append(record([*own, ("WARC-Segment-Origin-ID", f"<{ident}>"), ("WARC-Segment-Number", i), *more], part))
    return out


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers, by lower-case name, and the block of each record."""
    at = 0
    while at < len(archive):
        end = archive.index(END, at)
        lines = archive[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        start = end + len(END)
        stop = start + int(headers["content-length"])
        if archive[stop : stop + len(END)] != END:
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield headers, archive[start:stop]
        at = stop + len(END)


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(END)
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _uri(url: str | None) -> str:
    return "".join(c if c.isprintable() and c != " " else "%%%02X" % ord(c) for c in url or "")


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a record for every row of pages (page_id, url, html) under path.

    Of the rows whose payloads (html in UTF-8; null: empty) are equal and have at least REVISIT_FROM bytes, those with the
    largest page_id become responses and the others revisit records; all other rows become responses.  A null page_id is
    less than any other.  A revisit record names the response that it refers to by its record id.
    """
    shared.small_batches(pages.sparkSession)
    payload = F.encode(F.coalesce(pages["html"].cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= REVISIT_FROM
    keys = rows.where(large).select("digest", F.octet_length("payload").alias("bytes"), "page_id")
    # rows are counted by page first, so that a payload of very many pages is a small group
    pages_of = keys.groupBy("digest", "bytes", "page_id").agg(F.count("*").alias("c"))
    same = pages_of.groupBy("digest", "bytes").agg(F.sum("c").alias("c"), F.max(F.struct("page_id", F.col("c").alias("rows"))).alias("x"))
    same = same.where("c > 1").select("digest", "bytes", F.col("x.page_id").alias("newest"), F.col("x.rows").alias("rows"))
    same = shared.written(same, "copies")
    # small payloads have no part in the join; copies are looked up by a payload's digest, however many pages have it
    joined = shared.join_small(rows.where(large).withColumn("bytes", F.octet_length("payload")), same, ["digest", "bytes"], "left")
    rows = rows.where(~large).withColumns({"bytes": F.octet_length("payload"), "newest": F.lit(None).cast("long"), "rows": F.lit(None).cast("long")}).unionByName(joined)
    newest = F.coalesce(F.col("page_id") == F.col("newest"), F.lit(False))
    rows = rows.withColumn("refers", F.when(~newest, F.col("newest")))
    # the response that others refer to has an id that they know; any other record's is made unique by its number
    number = F.when(newest & (F.col("rows") == 1), F.lit(None)).otherwise(F.monotonically_increasing_id())
    rows = rows.select("page_id", "url", F.when(F.col("refers").isNull(), F.col("payload")).alias("payload"), "digest", "refers", number.alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                page, url, payload, digest, refers, number = row
                headers = [("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
                if refers is None:
                    kind, block = "response", f"{_HTTP}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload)
                else:
                    kind, block = "revisit", f"{_HTTP}\r\n".encode()
                    headers += [("WARC-Refers-To", f"<{_ident(refers, digest)}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")]
                for x in segments(_ident(page, digest, number), headers, kind, block):
                    out.append(x)
                    size += len(x)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _ident(page: int | None, digest: str, number: int | None = None) -> str:
    return f"urn:layertext:page:{'' if page is None else page}:{digest}{'' if number is None else f':{number}'}"


def _page(ident: str | None) -> int | None:
    """The page in <urn:layertext:page:7:digest:12>."""
    text = (ident or "").strip("<>").split(":")
    return int(text[3]) if len(text) > 3 and text[3] else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, page_id, refers_to, digest, payload and intact of each record under path, continuations joined.

    Continuations are grouped by their origin, ordered by segment number and joined; the joined block must have the total
    length that the last segment states.  Where it doesn't, where a segment is missing or where the chunked framing is
    broken, intact is false and the payload null.  A revisit record has no payload.
    """
    shared.small_batches(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["origin", "record_type", "refers_to", "digest", "segment", "total", "block"]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)

        for batch in batches:
            for content in batch.column("content"):
                raw = content.as_py()
                rows, size = [], 0
                for headers, block in parse(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    number = headers.get("warc-segment-number")
                    total = headers.get("warc-segment-total-length")
                    rows.append(
                        (
                            headers.get("warc-segment-origin-id") or headers["warc-record-id"],
                            headers["warc-type"],
                            _page(headers.get("warc-refers-to")),
                            headers.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                            int(number) if number else None,
                            int(total) if total else None,
                            block,
                        )
                    )
                    size += len(block)
                    if size > 1 << 22:
                        yield made(rows)
                        rows, size = [], 0
                yield made(rows)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, intact = [], []
            for kind, numbers, blocks, total in zip(*[batch.column(c).to_pylist() for c in ("record_type", "numbers", "blocks", "total")], strict=True):
                whole = b"".join(blocks)
                fine = numbers == list(range(1, len(numbers) + 1)) and (total == len(whole) if len(numbers) > 1 else total is None)
                payload = None
                if fine and kind != "revisit":
                    try:
                        payload = http_payload(whole)
                    except ValueError:
                        fine = False
                payloads.append(payload)
                intact.append(fine)
            kept = [batch.column(c) for c in ("origin", "record_type", "refers_to", "digest")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(payloads, pa.binary()), pa.array(intact)], names=["record_id", "record_type", "refers_to", "digest", "payload", "intact"])

    files = spark.read.format("binaryFile").load(path).select("content")
    records = files.mapInArrow(read, "origin string, record_type string, refers_to long, digest string, segment int, total long, block binary")
    single = records.where("segment is null").select("origin", "record_type", "refers_to", "digest", F.array(F.lit(1)).alias("numbers"), F.array("block").alias("blocks"), "total")
    cut = records.where("segment is not null").groupBy("origin").agg(
        F.max(F.when(F.col("segment") == 1, F.struct("record_type", "refers_to", "digest"))).alias("first"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("x"),
        F.max("total").alias("total"),
    )
    cut = cut.select("origin", "first.record_type", "first.refers_to", "first.digest", F.col("x.segment").alias("numbers"), F.col("x.block").alias("blocks"), "total")
    out = single.unionByName(cut).mapInArrow(join, "record_id string, record_type string, refers_to long, digest string, payload binary, intact boolean")
    page = F.regexp_extract("record_id", "^<urn:layertext:page:([^:>]*)", 1)
    return out.withColumn("page_id", F.when(page != "", page.cast("long")))


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each row of pages, from archives written and read.

    The digest is the lower-case SHA-1 of the payload, computed from the bytes that were read.  A revisit record takes
    both from the response that it refers to.  A broken record has a null digest and size.  Null html is an empty
    payload; null urls and page_ids are kept; repeated rows give a record each, and repeated rows of the largest page_id
    of a payload are all responses, to which a revisit record refers by page and digest; an empty table gives an empty
    result.  Other columns are ignored.
    """
    spark = pages.sparkSession
    path = shared.new_path(spark, "warc")
    write_archives(pages, path)
    found = read_archives(spark, path)
    found = found.select("page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"))
    found = shared.written(found, "records")
    responses = found.where("record_type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to")
    revisits = found.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "digest")
    asked = shared.written(revisits.select("refers_to", "digest").distinct(), "asked")
    origins = found.where("record_type = 'response' and sha1 = digest").select(F.col("page_id").alias("refers_to"), "digest", "bytes", "sha1")
    origins = shared.written(origins.join(asked, ["refers_to", "digest"], "left_semi").distinct(), "origins")
    revisits = shared.join_small(revisits, origins, ["refers_to", "digest"], "left")
    revisits = revisits.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to")
    return responses.unionByName(revisits)


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS newest FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
CASE WHEN strlen(h) >= {REVISIT_FROM} AND newest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN strlen(h) >= {REVISIT_FROM} AND newest <> page_id THEN newest END AS refers_to FROM m
"""
