"""Content-addressed WARC archive (operator 4).

An archive is two Parquet folders: ``payloads`` holds each distinct payload once, under its SHA-256;
``records`` holds the exact header bytes of every record.  Joins on the digest rebuild the records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import _arrow_schema, drop_path, fresh_path, lookup, partitions, slices, staged

#: Fixed value: the alphabet of RFC 4648 base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: A digest with over one in this many of all records is hot.
SLOTS = 512

_CRLF = "\r\n"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of 40 hex digits (a SHA-1): four groups of 40 bits, eight symbols each."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda g: F.conv(F.substring(digest, g * 10 + 1, F.lit(10)), 16, 10).cast("long"))
    symbol = lambda v, k: F.substring(F.lit(BASE32), F.shiftright(v, 35 - 5 * k).bitwiseAND(31).cast("int") + 1, F.lit(1))
    return F.array_join(F.flatten(F.transform(groups, lambda v: F.array(*[symbol(v, k) for k in range(8)]))), "")


def record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("none"))))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null; line breaks in the value are escaped."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(_CRLF)), F.lit(""))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write one record a row of ``pages`` to the archive at ``path``.

    Null payloads count as empty.  Of records with equal payloads of ``min_bytes`` or more, those
    with the smallest id are responses, others are revisits of it; smaller ones are all responses.
    Null ids come after all others (if a group has only such, they are responses); a repeated row
    gives a repeated record; an empty table gives an empty archive; other columns are not read.
    Only digests are shuffled to tell copies; a payload leaves each task once at most, so copies of
    one page don't meet, and the few digests with very many copies are looked up by broadcast.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    keys = staged(
        rows.select("page_id", "url", F.unhex(F.sha2("body", 256)).alias("strong"), F.sha1("body").alias("sha1"), F.octet_length("body").cast("long").alias("n_bytes")), "warc-keys"
    )
    total = keys.count()
    groups = keys.groupBy("strong").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
    told = lookup(keys, "strong", groups, "copies", total, SLOTS)
    revisit = (F.col("n_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    told = told.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first_id")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}"), _line("Content-Length", F.col("n_bytes")), F.lit(_CRLF))
    told = told.withColumn("http", http)
    held = F.octet_length("http") + F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes"))
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _line("WARC-Refers-To", record_id(F.col("refers_to"))), _line("Page-Refers-To", F.col("refers_to")))).otherwise(""),
        _line("Page-Id", F.col("page_id")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", held),
        F.lit(_CRLF),
    )
    spread = F.ceil(F.col("copies") * SLOTS / F.lit(max(total, SLOTS))).cast("int")
    told.select("page_id", "strong", "n_bytes", spread.alias("spread"), F.concat(head, "http").cast("binary").alias("head")).write.parquet(f"{path}/records")

    hot = groups.withColumn("spread", spread).where("spread > 1").select(F.col("strong").alias("__strong"), "spread")
    once = _first_copies(rows.select(F.unhex(F.sha2("body", 256)).alias("strong"), "body"), pack=True)
    once = _first_copies(once.repartition(partitions(spark), "strong"), pack=False)
    # Fewer than SLOTS digests are hot, whatever the input.
    once = once.join(F.broadcast(hot), once.strong == F.col("__strong"), "left").select("strong", "body", F.coalesce("spread", F.lit(1)).alias("spread"))
    once.write.option("compression", "none").parquet(f"{path}/payloads")


def _first_copies(rows: DataFrame, pack: bool) -> DataFrame:
    """Of each task's rows, the first of each digest; the payload is compressed on the way."""
    out = rows.select("strong", "body").schema
    arrow = _arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches, "body"):
            keep, bodies = [], []
            for i, key in enumerate(batch.column(0).to_pylist()):
                if key not in seen:
                    seen.add(key)
                    keep.append(i)
                    if pack:
                        bodies.append(zlib.compress(batch.column(1)[i].as_py(), 4))
            if keep:
                kept = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(bodies, pa.binary()) if pack else kept.column(1)], schema=arrow)

    return rows.mapInArrow(run, out)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, head, payload, ok)`` for each record: exact header bytes (WARC and HTTP headers),
    the full payload (of revisits: that which they refer to), and whether the payload's digests and
    lengths are those that the store and the headers say.  A payload with very many records is
    copied as often as its records are split."""
    records = spark.read.parquet(f"{path}/records").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.col("spread")).cast("int"))
    payloads = spark.read.parquet(f"{path}/payloads").select("strong", "body", F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("salt"))
    joined = records.join(payloads, ["strong", "salt"], "left").select("page_id", "strong", "head", F.col("body").alias("payload"))
    out = spark.createDataFrame([], "page_id long, head binary, payload binary, ok boolean").schema
    arrow = _arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload"):
            bodies = [zlib.decompress(x) if x is not None else None for x in batch.column(3).to_pylist()]
            ok = [b is not None and hashlib.sha256(b).digest() == s and _sound(h, b) for s, h, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), bodies, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bodies, pa.binary()), pa.array(ok)], schema=arrow)

    return joined.mapInArrow(run, out)


def fields(head: bytes) -> dict[str, str]:
    """The named fields of a record's WARC header."""
    lines = head.split(b"\r\n\r\n", 1)[0].decode().split(_CRLF)
    return dict(x.split(": ", 1) for x in lines[1:])


def _sound(head: bytes, payload: bytes) -> bool:
    named, http = fields(head), head.split(b"\r\n\r\n", 1)[1]
    held = len(http) + (len(payload) if named["WARC-Type"] == "response" else 0)
    return named["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() and int(named["Content-Length"]) == held


def export_warc(spark: SparkSession, path: str, to: str) -> None:
    """Write the archive's records as gzipped WARC files to the folder ``to``."""
    rows = read_archive(spark, path).where("ok")
    revisit = F.col("head").cast("string").contains(f"{_CRLF}WARC-Type: revisit{_CRLF}")
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    rows.select(F.concat(F.col("head").cast("string"), body).alias("value")).write.option("lineSep", _CRLF * 2).option("compression", "gzip").text(to)


def records(stream: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an uncompressed WARC file."""
    at = 0
    while at < len(stream):
        end = stream.index(b"\r\n\r\n", at) + 4
        named = fields(stream[at:end])
        n = int(named["Content-Length"])
        yield named, stream[end : end + n]
        if stream[end + n : end + n + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        at = end + n + 4


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to an archive in the shared folder, read it back, and return per page
    ``(page_id, payload_bytes, payload_digest, record_type, refers_to, verified)``, all as the
    rebuilt records have it.  A record whose payload is gone or isn't that of its digests has false
    in ``verified`` (and no ``payload_bytes`` if it is gone)."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archive(pages, path, min_bytes)
    return archived_pages(pages.sparkSession, path)


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """What ``page_records`` returns, of an archive that is there already."""
    out = spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean").schema
    arrow = _arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload"):
            named = [fields(h) for h in batch.column(1).to_pylist()]
            bodies = batch.column(2).to_pylist()
            columns = [
                [int(f["Page-Id"]) if "Page-Id" in f else None for f in named],
                [None if b is None else len(b) for b in bodies],
                [f["WARC-Payload-Digest"].removeprefix("sha1:") for f in named],
                [f["WARC-Type"] for f in named],
                [int(f["Page-Refers-To"]) if "Page-Refers-To" in f else None for f in named],
                batch.column(3).to_pylist(),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return read_archive(spark, path).mapInArrow(run, out)


def drop_archive(spark: SparkSession, path: str) -> None:
    drop_path(spark, path)
