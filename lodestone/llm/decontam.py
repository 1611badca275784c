"""Benchmark decontamination (operator 10), in DataFrame functions only.

Item-sized windows of a document get a SimHash; fingerprints are cut into one block more than the
radius, so that two within the radius agree in a block; the blocks of a window are looked up among
those of all items of its size, and candidates are verified by the exact weighted similarity of
their word shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lookup, staged

#: Words in a shingle, and the similarity that a window needs.
SHINGLE, SIMILAR = 5, 0.8
#: Bits in which two fingerprints may differ.  At a similarity of 0.8, 9.7 differ on average, with a
#: deviation of 2.9: five deviations more are allowed.
RADIUS = 24
#: Rows that are broadcast at most (of some 50 bytes each); larger sides are shuffled.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(hashes: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of ``size`` words; of all words, if there are fewer."""
    n = F.size(hashes)
    run = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(*[F.element_at(hashes, i + k) for k in range(size)]))
    if size == 1:
        return F.transform(hashes, lambda w: F.xxhash64(w))
    short = F.when(n > 0, F.array(F.coalesce(*[F.when(n == k, F.xxhash64(*[F.try_element_at(hashes, F.lit(i + 1)) for i in range(k)])) for k in range(1, size)]))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n >= size, run).otherwise(short)


def simhash(hashes: Column) -> Column:
    """Bit-wise majority, as a long."""

    def bit(b: int) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda s, h: s + F.shiftright(h, b).bitwiseAND(F.lit(1).cast("long")).cast("int"))
        return F.when(ones * 2 > F.size(hashes), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))

    bits = [bit(b) for b in range(64)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """Number and value of each of ``radius`` + 1 blocks of bits."""
    m = radius + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << b - a) - 1).cast("long")).alias("value")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])


def items_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, m, shingles)`` of the items that have words, equal rows once; m: number of shingles."""
    hashes = F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w))
    found = benchmark.select(F.col(item_col).alias("item"), shingles(hashes).alias("shingles"), F.size(hashes).alias("n_words"))
    return found.where("n_words > 0").select("item", "n_words", F.size("shingles").alias("m"), "shingles").distinct()


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", radius: int = RADIUS, similar: float = SIMILAR) -> DataFrame:
    """``(doc_id, item_id, similarity)``: each document and item of which the document has a window
    at least ``similar``; the best window's similarity.

    The similarity is the weighted Jaccard of the shingles of five words, their numbers as weights.
    An item of fewer words is one shingle of all its words.  A window has as many shingles as the
    item (or the document, if that is shorter).  Windows of every item size get a fingerprint, whose
    blocks are looked up among those of all items of that size; what is within the radius is
    verified.  Only windows are left out in which so few shingles are any item's that no item can
    reach the similarity, and of those that hold the same such shingles all but the one that starts
    with the first of them (or as near to it as the document allows); so all orders of an item's
    parts are found.  Null and empty texts match nothing; rows with equal ids count as one document;
    a null id is an id; other columns are not read; empty tables give an empty result.

    Documents are read twice; only (row, size, place) moves, unless so many rows share shingles with
    items that the list of them can't be broadcast.  A shingle's items don't multiply its places,
    and shingles with very many places are looked up by broadcast.
    """
    items = staged(items_of(benchmark, item_col, text_col), "items")
    n_items, n_shingles = items.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0))).head()
    short = sorted(r[0] for r in items.where(F.col("n_words") < SHINGLE).select("n_words").distinct().collect())
    text = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = text.withColumn("mark", F.xxhash64("text"))
    hashed = lambda t: t.withColumn("hashes", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))

    # Where shingles of items occur in documents, and for which item sizes.
    sizes = [(k, F.when(F.size("hashes") >= k, shingles(F.col("hashes"), k)).otherwise(F.array().cast("array<bigint>"))) for k in [*short, SHINGLE]]
    exploded = None
    for size, each in sizes:
        part = hashed(text).select("doc", "mark", F.size("hashes").alias("n_words"), F.posexplode(each if size < SHINGLE else shingles(F.col("hashes"))).alias("at", "shingle")).withColumn("size", F.lit(size))
        exploded = part if exploded is None else exploded.unionByName(part)
    places = items.select("m", F.least("n_words", F.lit(SHINGLE)).alias("size"), F.explode("shingles").alias("shingle"))
    places = places.groupBy("shingle", "size").agg(F.collect_set("m").alias("sizes"))
    if n_shingles <= BROADCAST_ROWS:
        hits = exploded.join(F.broadcast(places), ["shingle", "size"])
    else:
        key = lambda t: t.withColumn("key", F.xxhash64("shingle", "size")).drop("shingle", "size")
        exploded, places = exploded.withColumn("key", F.xxhash64("shingle", "size")).drop("shingle"), key(places)
        met = staged(exploded.groupBy("key").agg(F.count("*").alias("times")).join(places, "key"), "places")
        hits = lookup(exploded, "key", met, "times", int(met.agg(F.coalesce(F.sum("times"), F.lit(0))).head()[0])).where("sizes is not null")
    hits = hits.select("doc", "mark", "n_words", "size", "at", F.explode("sizes").alias("m"))
    n = F.greatest(F.col("n_words") - F.col("size") + 1, F.lit(1))
    held = hits.groupBy("doc", "mark", "m", "size", n.alias("n")).agg(F.sort_array(F.collect_set("at")).alias("places"))
    last = F.greatest(F.col("n") - F.col("m"), F.lit(0))
    need = F.ceil((F.col("m") + F.least("m", "n")) * (similar / (1 + similar)) - 1e-6).cast("int")
    held = held.select("doc", "mark", "m", "size", "places", last.alias("last"), F.greatest(need, F.lit(1)).alias("need"))
    full = lambda at, i: F.try_element_at(F.col("places"), i + F.col("need")) < F.least(at, F.col("last")) + F.col("m")
    fit = F.transform(F.filter("places", full), lambda at: F.least(at, F.col("last")))
    starts = held.select("doc", "mark", "m", "size", F.array_distinct(fit).alias("starts")).where(F.size("starts") > 0)
    wanted = staged(starts.groupBy("doc", "mark").agg(F.collect_list(F.struct("m", "size", "starts")).alias("windows")), "windows")
    n_windows = wanted.agg(F.coalesce(F.sum(F.aggregate("windows", F.lit(0), lambda s, w: s + F.size(w["starts"]))), F.lit(0))).head()[0]

    # Fingerprints of those windows.
    held = wanted.withColumnsRenamed({"doc": "doc_", "mark": "mark_"})
    found = text.join(_small(held, n_windows), F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("mark") == F.col("mark_")))
    found = hashed(found.select("doc", "text", "mark", "windows").dropDuplicates(["doc", "mark"]))
    found = found.select("doc", "mark", "windows", *[each.alias(f"s{k}") for k, each in sizes[:-1]], shingles(F.col("hashes")).alias(f"s{SHINGLE}"))
    found = found.select("doc", "mark", F.explode("windows").alias("w"), *[f"s{k}" for k, _ in sizes])
    of_size = F.coalesce(*[F.when(F.col("w.size") == k, F.col(f"s{k}")) for k, _ in sizes])
    found = found.select("doc", "mark", "w.m", "w.size", of_size.alias("whole"), F.explode("w.starts").alias("start"))
    found = found.select("doc", "mark", "m", "size", "start", F.slice("whole", F.col("start") + 1, F.col("m")).alias("window"))
    found = staged(found.withColumn("fp", simhash(F.col("window"))), "fingerprints")

    # Multi-index: a block in common with an item of the size, then all bits.
    keyed = lambda t: t.withColumn("b", F.explode(blocks(F.col("fp"), radius))).withColumns({"block": F.col("b.block"), "value": F.col("b.value")}).drop("b")
    prints = items.select("item", "m", F.least("n_words", F.lit(SHINGLE)).alias("size"), simhash(F.col("shingles")).alias("fp"), F.xxhash64("shingles").alias("of"))
    index = keyed(prints.groupBy("m", "size", "fp", "of").agg(F.count("*").alias("same"))).drop("same").withColumnRenamed("fp", "item_fp")
    probes = keyed(found.select(F.xxhash64("doc", "mark", "m", "size", "start").alias("window_id"), "m", "size", "fp"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius
    met = probes.join(_small(index, n_items * (radius + 1)), ["m", "size", "block", "value"]).where(near).select("window_id", "of").distinct()

    # Exact similarity of what is left.
    keys = ["doc", "mark", "m", "size", "start"]
    rows = found.select(*keys, "window").withColumn("window_id", F.xxhash64(*keys))
    both = rows.join(met, "window_id").select(*keys, "of", F.size("window").alias("w"), "window")
    counts = both.select(*keys, "of", "w", F.explode("window").alias("shingle")).groupBy(*keys, "of", "w", "shingle").agg(F.count("*").alias("n"))
    weights = items.select("m", F.xxhash64("shingles").alias("of"), "shingles").dropDuplicates(["m", "of"]).select("m", "of", F.explode("shingles").alias("shingle")).groupBy("m", "of", "shingle").agg(F.count("*").alias("n_item"))
    shared = counts.join(_small(weights, n_shingles), ["m", "of", "shingle"])
    best = shared.groupBy(*keys, "of", "w").agg(F.sum(F.least("n", "n_item")).alias("common")).withColumn("similarity", F.col("common") / (F.col("m") + F.col("w") - F.col("common")))
    best = best.where(F.col("similarity") >= similar).groupBy("doc", "m", "of").agg(F.max("similarity").alias("similarity"))
    named = items.select("item", "m", F.xxhash64("shingles").alias("of"))
    out = best.join(_small(named, n_items), ["m", "of"]).groupBy("doc", "item").agg(F.max("similarity").alias("similarity"))
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "similarity")
