"""Operator 9 [native]: benchmark decontamination by SimHash over item-sized windows.

Texts and items are lower-cased, cut into words and five-word shingles (an item of fewer words is one shingle). A window
is as long as an item. Windows of documents that hold enough of an item's shingles to reach the similarity at all get a
SimHash; the others can't, so leaving them out loses nothing. Fingerprints meet in a multi-index: the 64 bits are four
blocks, items are entered under every value within RADIUS // 4 bits of each block, and so every pair within RADIUS bits
meets. Exact weighted Jaccard similarity of the shingles then decides: SIMILARITY or more is a leak.

Nulls: null texts have no words and no windows; null ids are kept as null. Repeated rows give the pair once. Documents
shorter than an item are one window. Other columns are ignored; empty tables give an empty result. Ties go to the
first window.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import saved, sized_broadcast, table, words

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 15, 4
#: Benchmark shingles, or documents with windows, up to these counts are broadcast (a few longs each); more are joined by shuffle.
BROADCAST_SHINGLES, BROADCAST_DOCS = 500_000, 500_000


def _next(name: str, other: str, step: int) -> Column:
    n = F.greatest(F.size(other) - step, F.lit(0))
    return F.zip_with(F.slice(name, 1, n), F.slice(other, step + 1, n), lambda a, b: F.xxhash64(a, b))


def shingled(df: DataFrame, size: int, keep: list) -> DataFrame:
    """keep, n_words and s: the hashes of the text's shingles of so many words, each step in a projection of its own."""
    df = df.select(*keep, words(F.lower(F.col("text"))).alias("_w")).select(*keep, F.size("_w").alias("n_words"), F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"))
    keep = [*keep, "n_words"]
    if size == 1:
        return df.select(*keep, F.col("_h").alias("s"))
    df = df.withColumn("_two", _next("_h", "_h", 1))
    if size == 2:
        return df.select(*keep, F.col("_two").alias("s"))
    if size == 3:
        return df.select(*keep, _next("_two", "_h", 2).alias("s"))
    df = df.withColumn("_four", _next("_two", "_two", 2))
    return df.select(*keep, F.col("_four").alias("s")) if size == 4 else df.select(*keep, _next("_four", "_h", 4).alias("s"))


def simhash(hashes: Column) -> Column:
    """The 64 bits that are set in over half the hashes, as a signed long."""
    def bit(acc: Column, b: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.call_function("getbit", h, b).cast("int"))
        return acc.bitwiseOR(F.when(2 * ones > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)


def _flips(bits: int, radius: int) -> list[int]:
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def _blocks(fp: Column) -> Column:
    width = 64 // BLOCKS
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, i * width).bitwiseAND((1 << width) - 1).alias("value")) for i in range(BLOCKS)])


def item_table(items: DataFrame, size: int) -> DataFrame:
    """item_id, n (shingles), s, counts (h, c) and fp of the items whose shingles have so many words, each of them once."""
    long = F.col("n_words") >= SHINGLE if size == SHINGLE else F.col("n_words") == size
    rows = shingled(items.select("item_id", "text").distinct(), size, ["item_id"]).where(long).select("item_id", F.size("s").alias("n"), "s")
    counts = F.transform(F.array_distinct("s"), lambda h: F.struct(h.alias("h"), F.size(F.filter("s", lambda x: x == h)).alias("c")))
    return rows.select("item_id", "n", "s", counts.alias("counts"), simhash(F.col("s")).alias("fp"))


def leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, by_text: bool = False) -> DataFrame:
    """doc_id, item_id, start (word), n_words, hamming, similarity: the best window of each pair. With by_text, texts of one
    doc_id are told apart, and th (the text's XXH64) is given too."""
    lengths = shingled(items.select("item_id", "text"), 1, ["item_id"]).select(F.least("n_words", F.lit(SHINGLE)).alias("k")).where("k > 0").distinct()
    sizes = sorted(r["k"] for r in lengths.collect())  # at most five
    found = None
    for size in sizes:
        part = _leaks(docs, items, size, similarity, radius, by_text)
        found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, " + ("th long, " if by_text else "") + "item_id long, start int, n_words int, hamming int, similarity double")
    return found


def _leaks(docs: DataFrame, items: DataFrame, size: int, similarity: float, radius: int, by_text: bool) -> DataFrame:
    items = saved(item_table(items, size), "items")
    keys = ["doc_id", "th"]
    base = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    shingles = items.select("item_id", "n", F.explode_outer("s").alias("h")).distinct()
    known = shingles.select("h").distinct()
    rows = shingled(base, size, keys).select(*keys, F.size("s").alias("m"), F.posexplode_outer("s").alias("pos", "h"))
    hits = saved(rows.join(sized_broadcast(known, BROADCAST_SHINGLES), "h", "left_semi").distinct(), "hits")
    # an item's shingles in a document, in order; both ends of what a window must hold are known
    per = hits.join(sized_broadcast(shingles, BROADCAST_SHINGLES), "h").groupBy(*keys, "m", "item_id", "n").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    need = F.ceil(F.col("n") * F.lit(similarity) - 1e-9).cast("int")
    width = F.least("n", "m")
    far = lambda i: F.get("at", i + F.col("need") - 1)
    starts = F.transform("at", lambda p, i: F.when(F.coalesce(far(i) - p < F.col("width"), F.lit(False)), F.sequence(F.greatest(F.lit(0), F.least(far(i) - F.col("width") + 1, F.col("m") - F.col("width"))), F.greatest(F.lit(0), F.least(p, F.col("m") - F.col("width"))))).otherwise(F.array().cast("array<int>")))
    ready = per.withColumn("need", need).withColumn("width", width).where(F.size("at") >= F.col("need"))
    windows = saved(ready.select(*keys, "width", F.array_distinct(F.flatten(starts)).alias("starts")).where(F.size("starts") > 0).select(*keys, "width", F.explode_outer("starts").alias("start")).distinct(), "windows")
    which = sized_broadcast(windows.select(*keys).distinct(), BROADCAST_DOCS)
    again = shingled(base.join(which, base.doc_id.eqNullSafe(which.doc_id) & (base.th == which.th), "left_semi").distinct(), size, keys).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "s")
    cut = windows.join(again, windows.doc_id.eqNullSafe(again.d) & (windows.th == again.t)).select(*keys, "width", "start", F.slice("s", F.col("start") + 1, F.col("width")).alias("win"))
    prints = saved(cut.withColumn("fp", simhash(F.col("win"))), "window-prints")
    width_bits = 64 // BLOCKS
    flips = F.array(*[F.lit(x) for x in _flips(width_bits, radius // BLOCKS)])
    index = items.select("item_id", "n", F.col("fp").alias("item_fp"), "counts", F.explode(_blocks(F.col("fp"))).alias("b")).select("item_id", "n", "item_fp", "b.block", F.explode_outer(F.transform(flips, lambda x: F.col("b.value").bitwiseXOR(x))).alias("value"))
    queries = prints.select(*keys, "start", "width", "fp", F.explode(_blocks(F.col("fp"))).alias("b")).select(*keys, "start", "width", "fp", "b.block", "b.value")
    hamming = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    met = queries.join(index, ["block", "value"]).where((hamming <= radius) & (F.col("width") <= F.col("n"))).select(*keys, "start", "width", "fp", "item_id", hamming.cast("int").alias("hamming")).distinct()
    full = met.join(prints.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("start").alias("a"), F.col("width").alias("v"), "win").distinct(), F.col("doc_id").eqNullSafe(F.col("d")) & F.col("th").eqNullSafe(F.col("t")) & (F.col("start") == F.col("a")) & (F.col("width") == F.col("v"))).join(items.select(F.col("item_id").alias("i"), "n", "counts"), F.col("item_id").eqNullSafe(F.col("i")))
    common = F.aggregate("counts", F.lit(0), lambda acc, x: acc + F.least(x["c"], F.size(F.filter("win", lambda w: w == x["h"]))))
    exact = full.withColumn("common", common).withColumn("similarity", F.col("common") / (F.col("n") + F.col("width") - F.col("common"))).where(F.col("similarity") >= similarity)
    own = keys if by_text else ["doc_id"]
    best = exact.groupBy(*own, "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "width", "hamming")).alias("b"))
    return best.select(*own, "item_id", (-F.col("b.back")).alias("start"), (F.col("b.width") + size - 1).cast("int").alias("n_words"), F.col("b.hamming").alias("hamming"), F.col("b.similarity").alias("similarity"))


def op9_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
