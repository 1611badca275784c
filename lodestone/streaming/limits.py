"""Rate limits and other stateful streams."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import micros

# ---- Fixed values ---------------------------------------------------------------------------
WINDOW_SECONDS, LIMIT = 60, 60
BUCKETS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 20.0, 30.0)
# ---------------------------------------------------------------------------------------------


def judge(times: list[float], log: deque[float], limit: int, window: float) -> list[tuple[bool, int]]:
    """Whether each request (in order) is accepted, and after how many seconds to retry.  Only
    accepted requests are in the ``log``.  A limit of 0 is none."""
    out = []
    for t in times:
        while log and t - log[0] >= window:
            log.popleft()
        ok = not limit or len(log) < limit
        if ok:
            log.append(t)
        out.append((ok, 0 if ok else max(1, int(-(-(window - (t - log[0])) // 1)))))
    return out


def rate_limit(requests: DataFrame, key: str, limit: int = LIMIT, window: float = WINDOW_SECONDS, id_col: str = "event_id", ts: str = "ts") -> DataFrame:
    """``(id, key, accepted, retry_after)`` for a table of requests: one ordered pass over each key,
    which holds ``limit`` times at most."""
    kinds = ", ".join(f"{c} {requests.schema[c].dataType.simpleString()}" for c in (id_col, key))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, log = None, deque()
        for part in parts:
            told = []
            for k, t in zip(part[key], part["__t"], strict=True):
                if k != last:
                    last, log = k, deque()
                told += judge([t], log, limit, window)
            yield pd.DataFrame({id_col: part[id_col], key: part[key], "accepted": [x[0] for x in told], "retry_after": [x[1] for x in told]})

    rows = requests.select(id_col, key, micros(ts).alias("__us"), (micros(ts) / 1e6).alias("__t"))
    return rows.repartition(F.col(key)).sortWithinPartitions(key, "__us", id_col).mapInPandas(run, f"{kinds}, accepted boolean, retry_after int")


def rate_limit_stream(requests: DataFrame, key: str, limit: int = LIMIT, window: float = WINDOW_SECONDS, id_col: str = "event_id", ts: str = "ts") -> DataFrame:
    """The same on a stream; the state of a key is its accepted times, dropped when idle."""
    kinds = f"{id_col} {requests.schema[id_col].dataType.simpleString()}, {key} {requests.schema[key].dataType.simpleString()}, accepted boolean, retry_after int"

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(parts)).sort_values(["__t", id_col])
        told = judge(rows["__t"].tolist(), log, limit, window)
        state.update((list(log),))
        state.setTimeoutDuration(int(window * 1000) * 2)
        yield pd.DataFrame({id_col: rows[id_col], key: k[0], "accepted": [x[0] for x in told], "retry_after": [x[1] for x in told]})

    rows = requests.select(id_col, key, (micros(ts) / 1e6).alias("__t"))
    return rows.groupBy(key).applyInPandasWithState(step, kinds, "log array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def once(documents: DataFrame, ts: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each content once (by its hash); with an event time, within a watermark, so state is bounded."""
    rows = documents.withColumn("content_hash", F.sha2("text", 256))
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["content_hash"]) if ts else rows.dropDuplicates(["content_hash"])


def counters(events: DataFrame, by: str = "event_type", ts: str = "ts", size: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Requests a window and kind; works on tables and on streams."""
    rows = events.withWatermark(ts, delay) if events.isStreaming else events
    return rows.groupBy(F.window(ts, size).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def histogram(events: DataFrame, value: str, by: str) -> DataFrame:
    """Cumulative counts of values up to each bucket's bound."""
    edges = F.array(*map(F.lit, BUCKETS))
    rows = events.select(by, F.col(value).alias("v"), F.explode(edges).alias("le"))
    return rows.groupBy(by, "le").agg(F.count_if(F.col("v") <= F.col("le")).alias("n"))


def cache_stream(requests: DataFrame, ttl: float = 3600, size: int = 512) -> DataFrame:
    """``(id, hit, value)`` for a stream of lookups and puts (``id, shard, key, value, ts``; a value
    puts it, null asks).  The state of a shard is its live entries in order of insertion: those past
    ``ttl`` seconds go, and beyond ``size`` the one inserted first."""
    kinds = f"id {requests.schema['id'].dataType.simpleString()}, hit boolean, value string"

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, values, times = state.get if state.exists else ([], [], [])
        held = {a: (b, t) for a, b, t in zip(keys, values, times, strict=True)}
        out = []
        for r in pd.concat(list(parts)).sort_values(["__t", "id"]).itertuples():
            t = r[4]
            for key in [x for x, (_, at) in held.items() if t - at >= ttl]:
                del held[key]
            if r[3] is None or r[3] != r[3]:
                out.append((r[1], r[2] in held, held.get(r[2], (None,))[0]))
                continue
            held.pop(r[2], None)
            while len(held) >= size:
                del held[next(iter(held))]
            held[r[2]] = (r[3], t)
            out.append((r[1], False, r[3]))
        state.update((list(held), [v for v, _ in held.values()], [t for _, t in held.values()]))
        yield pd.DataFrame(out, columns=["id", "hit", "value"])

    rows = requests.select("id", "key", "value", (micros("ts") / 1e6).alias("__t"), "shard")
    return rows.groupBy("shard").applyInPandasWithState(step, kinds, "keys array<string>, vals array<string>, times array<double>", "append", GroupStateTimeout.NoTimeout)


def audit_stream(events: DataFrame) -> DataFrame:
    """``(seq, actor, prev_hash, hash)``: a stream of audit events chained by actor, in order of
    ``seq`` within a batch; the state of an actor is its last hash."""
    from ..operators.audit import GENESIS, payload

    kinds = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in ("seq", "actor")) + ", prev_hash string, hash string"

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (GENESIS,)
        rows = pd.concat(list(parts)).sort_values("seq")
        prev, own = [], []
        for value in rows["__payload"]:
            prev.append(last)
            last = hashlib.sha256(f"{last}|{value}".encode()).hexdigest()
            own.append(last)
        state.update((last,))
        yield pd.DataFrame({"seq": rows["seq"], "actor": k[0], "prev_hash": prev, "hash": own})

    rows = events.select("seq", "actor", payload().alias("__payload"))
    return rows.groupBy("actor").applyInPandasWithState(step, kinds, "last string", "append", GroupStateTimeout.NoTimeout)


def index_stream(chunks: DataFrame, path: str, checkpoint: str, heading_col: str | None = None):
    """Start a query that adds each batch of new chunks to the index at ``path``, once: a batch that
    is run again overwrites its own folders."""
    from ..operators import retrieval

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        retrieval.postings(rows, heading_col=heading_col).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        retrieval.corpus_lengths(rows, heading_col).write.mode("overwrite").parquet(f"{path}/lengths/batch={number}")
        rows.unpersist()

    return chunks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watched(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, Observation]:
    """``df`` and an observation that holds ``metrics`` (columns by name) once it has been written."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), seen
