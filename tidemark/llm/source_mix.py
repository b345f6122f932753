"""Operator 8: mixing sources to target weights by a low-discrepancy schedule.

Sources, by code point with null last, weigh 1, 2, 3, repeating, and share all words; a target stops at 3 times its
source's size and the excess is shared again by weight. The mix is a sequence of slots of one block of words each. Slot i
takes the base-2 van der Corput point of i through the cumulative targets to a source; slots are ranked within their
source, and slot k of a source takes block k of the endless repetition of its documents in hashed order, cut into blocks
of equal length. So every stretch of the mix is near the targets, and reruns agree. A source's last block ends at `cap`
times its words. A source of under 1 / EVEN of the mix, for which a few slots matter, gives its target exactly: its blocks
end there, and what its slots leave open closes the mix.

No source is gathered in one task: documents are ordered within (source, hash bucket), slots are ranked within (source,
stretch of slots), and only the sums of buckets and stretches are summed up in order.

Nulls: a null text has size 0 and is never taken; a null source is a source of its own; a null doc_id is ordered like any,
by the text's hash. Repeated rows each take part; ties of the hash are ordered by doc_id. Very long texts span blocks. Other
columns are ignored, or kept with `keep`. Sizes of sources are collected: at most MAX_SOURCES of them, beyond which an error
says so. Empty tables give empty results; with no words nothing is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, saved, sized_broadcast, table, words

WEIGHTS = (1, 2, 3)
CAP = 3
#: Words of a block: total / SLOTS, but at most BLOCK and at least 1.
SLOTS, BLOCK = 1 << 16, 2048
EVEN = 8
#: Documents of a hash bucket, on average, and slots of a stretch.
BUCKET_DOCS, STRETCH = 2000, 4096
MAX_SOURCES = 100_000
#: With keep, results of up to so many rows (five numbers each) are broadcast to the documents; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Cells of the unit interval in which sources are looked up.
CELLS = 4096


def targets(sizes: dict[str | None, int], weights: tuple = WEIGHTS, cap: int = CAP) -> dict[str | None, float]:
    """Words that each source is to give."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, done = float(sum(sizes.values())), {}
    open_ = list(order)
    while open_:
        share = (total - sum(done.values())) / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > cap * sizes[s]]
        if not full:
            return done | {s: share * weight[s] for s in open_}
        done |= {s: float(cap * sizes[s]) for s in full}
        open_ = [s for s in open_ if s not in done]
    return done


def schedule(spark: SparkSession, plan: list[tuple[int, float]], block: int, total: int) -> DataFrame:
    """(slot, sid, rank): plan has (sid, target) in order."""
    n = max(1, round(total / block)) if total else 0
    slots = spark.range(n).select(F.col("id").alias("slot"), (F.conv(F.reverse(F.lpad(F.bin("id"), 40, "0")), 2, 10).cast("double") / float(1 << 40)).alias("point"))
    spans, run = [], 0.0
    for i, (sid, target) in enumerate(plan):
        last, run = run, run + target
        if target or not i:
            spans.append((sid, last / max(total, 1), run / max(total, 1)))
    # sources by cells of the unit interval: a slot meets those of its cell, as many as cells and sources in all
    spans[-1:] = [(sid, lo, 2.0) for sid, lo, _ in spans[-1:]]
    cells = spark.createDataFrame(spans, "sid int, lo double, hi double").select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS)))).alias("cell"))
    slots = slots.withColumn("cell", F.floor(F.col("point") * CELLS)).join(F.broadcast(cells), "cell").where("lo <= point and point < hi")
    slots = slots.select("slot", "sid", F.floor(F.col("slot") / STRETCH).alias("stretch"))
    before = slots.groupBy("sid", "stretch").count().withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("sid").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return slots.join(before.select("sid", "stretch", "before"), ["sid", "stretch"]).select("slot", "sid", (F.col("before") + F.row_number().over(Window.partitionBy("sid", "stretch").orderBy("slot")) - 1).alias("rank"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, keep: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, size, source_size, target, taken. With keep, all columns of docs and then those
    four, with an underscore behind names that docs has."""
    spark = docs.sparkSession
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if keep else []
    whole = saved(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("doc_id", F.xxhash64("text"), F.lit("mix")).alias("h"), *own), "sizes")
    sized = whole.drop("doc")
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r["source"]: int(r["size"]) for r in found}
    aim = targets(sizes, weights, cap)
    total = sum(sizes.values())
    block = max(1, min(BLOCK, total // SLOTS))
    docs_of = {r["source"]: r["n"] for r in found}
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    exact = {s: EVEN * aim[s] < total for s in order}
    quota = {s: round(aim[s]) if exact[s] else cap * sizes[s] for s in order}
    facts = spark.createDataFrame([(i, s, sizes[s], aim[s], -(-docs_of[s] // BUCKET_DOCS), quota[s], exact[s]) for i, s in enumerate(order)], "sid int, source string, source_size long, target double, buckets long, quota long, exact boolean")
    rows = sized.join(F.broadcast(facts), sized["source"].eqNullSafe(facts["source"])).drop(facts["source"]).withColumn("bucket", F.pmod("h", "buckets"))
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(sums, ["sid", "bucket"]).select("row", "doc_id", "size", "source_size", "target", "sid", (F.col("before") + F.coalesce(F.sum("size").over(own), F.lit(0))).alias("start"))
    placed = saved(placed, "placed")
    slots = saved(schedule(spark, [(i, aim[s]) for i, s in enumerate(order)], block, total), "slots")
    limits = facts.where("source_size > 0").select("sid", F.col("source_size").alias("ring"), "quota", "exact")
    # block k holds the words [k * block, (k + 1) * block) of the endless repetition, up to the quota
    blocks = slots.join(F.broadcast(limits), "sid").select("sid", "ring", (F.col("rank") * block).alias("a"), F.least((F.col("rank") + 1) * block, "quota").alias("b"))
    counts = slots.groupBy("sid").agg(F.count("*").alias("n"))
    closing = limits.where("exact").join(counts, "sid", "left").select("sid", "ring", (F.coalesce("n", F.lit(0)) * block).alias("a"), F.col("quota").alias("b"))
    # cut at the ends of the ring of source_size words
    turns = F.explode_outer(F.sequence(F.floor(F.col("a") / F.col("ring")), F.floor((F.col("b") - 1) / F.col("ring"))))
    pieces = blocks.union(closing).where("a < b").withColumn("turn", turns)
    pieces = pieces.select("sid", (F.greatest("a", F.col("turn") * F.col("ring")) - F.col("turn") * F.col("ring")).alias("at"), (F.least("b", (F.col("turn") + 1) * F.col("ring")) - F.col("turn") * F.col("ring")).alias("to"))
    # documents and pieces meet in cells of one block's length
    cells = lambda a, b: F.explode_outer(F.sequence(F.floor(a / block), F.floor((b - 1) / block)))
    used = pieces.withColumn("cell", cells(F.col("at"), F.col("to"))).select("sid", "cell", F.greatest("at", F.col("cell") * block).alias("at"), F.least("to", (F.col("cell") + 1) * block).alias("to")).groupBy("sid", "cell", "at", "to").count()
    spread = placed.where("size > 0").select("row", "sid", "start", (F.col("start") + F.col("size")).alias("end"), cells(F.col("start"), F.col("start") + F.col("size")).alias("cell"))
    overlap = F.greatest(F.lit(0), F.least("end", "to") - F.greatest("start", "at")) * F.col("count")
    taken = spread.join(used, ["sid", "cell"]).groupBy("row").agg(F.sum(overlap).alias("taken"))
    told = placed.join(taken, "row", "left").select("row", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    if not keep:
        return told.drop("row")
    names = {c: free_name(docs, c) for c in ("size", "source_size", "target", "taken")}
    told = sized_broadcast(saved(told.select("row", *names), "taken"), BROADCAST_ROWS)
    return whole.select("row", "doc").join(told, "row").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns], *[F.col(c).alias(n) for c, n in names.items()])


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
