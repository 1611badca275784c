import base64
import gzip
import hashlib
from pathlib import Path

from lodestone.llm import warc


def brute(rows, min_bytes=0):
    first = {}
    for i, _, h in rows:
        h = h or ""
        first[h] = min((x for x in (first.get(h), i) if x is not None), default=None)
    out = []
    for i, _, h in rows:
        h = h or ""
        data = h.encode()
        again = len(data) >= min_bytes and i != first[h]
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h] if again else None))
    return out


ROWS = [(5, "http://a/", "<p>same</p>"), (3, "http://b/\r\nX: y", "<p>same</p>"), (9, None, None), (7, "u", ""), (1, "u", "ñ\r\n\r\nWARC/1.1\r\n" * 9), (4, "v", "x" * 200_000), (None, "w", "<p>same</p>"), (None, "z", "alone"), (3, "http://b/", "<p>same</p>")] + [(100 + i, "hot", "hot page") for i in range(900)]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 copies", "'x' strong", "2 spread").repartition(5)
    for least in (0, 10):
        got = warc.page_records(pages, least).collect()
        assert all(r.verified for r in got)
        assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(brute(ROWS, least), key=str)


def test_files(spark, tmp_path):
    pages = spark.createDataFrame(ROWS[:8], "page_id long, url string, html string")
    path, out = f"file://{tmp_path}/a", tmp_path / "out"
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({r[2] or "" for r in ROWS[:8]})
    warc.export_warc(spark, path, f"file://{out}")
    found = [x for p in Path(out).glob("*.gz") for x in warc.records(gzip.decompress(p.read_bytes()))]
    assert len(found) == 8
    blocks = {f.get("Page-Id"): b.split(b"\r\n\r\n", 1)[1] for f, b in found if f["WARC-Type"] == "response"}
    assert blocks["1"] == ROWS[4][2].encode() and blocks["3"] == b"<p>same</p>"


def test_damaged_records_are_told(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "one"), (2, "v", "two"), (3, "w", "one")], "page_id long, url string, html string")
    path = f"file://{tmp_path}/a"
    warc.write_archive(pages, path)
    store = spark.read.parquet(f"{path}/payloads")
    strong = hashlib.sha256(b"one").digest()
    other = [r for r in store.collect() if bytes(r.strong) != strong]
    rest = [other[0].asDict() | {"strong": bytearray(strong)}]  # the bytes of "two" under the digest of "one"; "two" is gone
    spark.createDataFrame(rest, store.schema).write.parquet(f"{path}/new")
    spark.read.parquet(f"{path}/new").write.mode("overwrite").parquet(f"{path}/payloads")
    got = {r.page_id: r for r in warc.archived_pages(spark, path).collect()}
    assert not any(r.verified for r in got.values()) and got[2].payload_bytes is None and got[1].payload_bytes == 3


def test_empty(spark):
    assert warc.page_records(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
