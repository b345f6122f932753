"""Operator 1 [native]: hashed n-gram log-likelihood ratio between trusted target and raw corpus.

The n-grams of a text are its word bigrams and the last three characters of each word (endings, and marks that stick to
words), hashed into 2^bits buckets. Two smoothed multinomials are counted over the buckets: one over the trusted rows (labels of good
quality), one over the whole corpus. A text's score is the mean over its n-grams of log(target / raw); every text with
a score under the threshold is rejected: no draw is made. Base rules on length and repetition come first.

Nulls: a null text has no words and fails the base rules; a null doc_id is scored and is in no trusted set. Repeated rows
are counted and returned as often as they occur; other columns are ignored. Without trusted rows all scores are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import saved, table, words

BITS = 17
ALPHA = 1.0
THRESHOLD = -0.25
#: The trusted rows that the target model is fitted on: at most so many, least hashes of doc_id first.
MAX_TRUSTED = 20_000
#: Characters of the n-gram that ends a word.
TAIL = 3
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30  # the window is hashed in three doublings


def trusted_ids(labels: DataFrame, limit: int = MAX_TRUSTED) -> DataFrame:
    """At most `limit` doc_ids of good quality, so small enough to broadcast."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def _hashed(docs: DataFrame) -> DataFrame:
    """docs with _w (words), _h (their hashes) and _h2 (hashes of neighbours), each in a projection of its own, so that it is made once."""
    return docs.withColumn("_w", words(F.col("text"))).withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x))).withColumn("_h2", _joined("_h", 1))


def _joined(name: str, step: int) -> Column:
    """From hashes of k-grams: those of each with the one `step` further on."""
    n = F.greatest(F.size(name) - step, F.lit(0))
    return F.zip_with(F.slice(name, 1, n), F.slice(name, step + 1, n), lambda a, b: F.xxhash64(a, b))


def _grams(hashed: DataFrame, keep: list, bits: int) -> DataFrame:
    """A row for each word, with the buckets of its two n-grams: with the word before it, and its last characters.

    explode_outer, as explode would make Spark infer a filter that hashes all words once more; a text without words gives a
    row without buckets.
    """
    mask = (1 << bits) - 1
    rows = hashed.select(*keep, F.explode_outer(F.arrays_zip(F.col("_w").alias("w"), F.col("_h2").alias("pair"))).alias("g"))
    return rows.select(*keep, F.col("g.pair").bitwiseAND(mask).alias("pair"), F.when(F.col("g.w").isNotNull(), F.xxhash64(F.substring("g.w", -TAIL, TAIL)).bitwiseAND(mask)).alias("tail"))


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, alpha: float = ALPHA) -> DataFrame:
    """(bucket, llr): at most 2^bits rows. Map-side sums keep the shuffle at that size for each task."""
    marked = docs.select("doc_id", "text").join(F.broadcast(trusted_ids(labels).withColumn("trusted", F.lit(1))), "doc_id", "left")
    rows = _grams(_hashed(marked.select("text", F.coalesce("trusted", F.lit(0)).alias("trusted"))), ["trusted"], bits)
    rows = rows.select("trusted", F.explode_outer(F.array("pair", "tail")).alias("bucket"))
    counts = saved(rows.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target")), "bucket-counts")
    n = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first()
    size = 1 << bits
    target = (F.col("target") + alpha) / F.lit(n[1] + alpha * size)
    raw = (F.col("raw") + alpha) / F.lit(n[0] + alpha * size)
    return counts.select("bucket", (F.log(target / raw) if n[1] else F.lit(0.0)).alias("llr"))


def base_columns(docs: DataFrame) -> DataFrame:
    """docs, after _hashed, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w = REPEAT_WINDOW
    df = docs.withColumn("_lines", lines).withColumn("n_words", F.size("_w").cast("long"))
    df = df.withColumn("word_chars", F.char_length(F.array_join("_w", "")).cast("long")).withColumn("n_symbols", F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).withColumn("_h4", _joined("_h2", 2))
    # a window found twice holds four words found twice; few texts have any
    df = df.withColumn("_win", F.when(F.size(F.array_distinct("_h4")) < F.size("_h4"), _joined("_h4", 4)))
    some = F.size(F.array_distinct("_win")) < F.size("_win")
    df = df.withColumn("_at", F.when(some, F.array_sort(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: (j >= 0) & F.coalesce(F.get("_at", j)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_rep", F.when(F.col("_at").isNotNull(), F.array_sort(F.transform(F.filter("_at", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))))
    covered = F.aggregate(F.transform("_rep", lambda x, j: F.least(F.lit(w), F.coalesce(F.get("_rep", j + 1) - x, F.lit(w))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_lines", "_h4", "_win", "_at", "_rep")
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def score(docs: DataFrame, model: DataFrame, bits: int = BITS, threshold: float = THRESHOLD, keep: tuple = ("doc_id",)) -> DataFrame:
    """A row for each row of docs: the columns in keep, the base columns, n_grams, llr_score and kept.

    The model has at most 2^bits rows and is broadcast; a text's n-grams stay in its partition, so each task sends one
    row a text.
    """
    keys = ["_row", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = _grams(base_columns(_hashed(docs.select(F.monotonically_increasing_id().alias("_row"), *keep, "text"))), keys, bits)
    of = lambda name: F.broadcast(model.select(F.col("bucket").alias(name), F.col("llr").alias(f"{name}_llr")))
    scored = rows.join(of("pair"), "pair", "left").join(of("tail"), "tail", "left").groupBy(*keys).agg((F.count("pair") + F.count("tail")).alias("n_grams"), F.sum(F.coalesce("pair_llr", F.lit(0.0)) + F.coalesce("tail_llr", F.lit(0.0))).alias("total"))
    mean = F.coalesce(F.col("total") / F.nullif(F.col("n_grams"), F.lit(0)), F.lit(0.0))
    return scored.select(*keys[1:], "n_grams", mean.alias("llr_score"), (~F.col("base_failed") & (mean >= threshold)).alias("kept"))


def quality(docs: DataFrame, labels: DataFrame, bits: int = BITS, threshold: float = THRESHOLD, keep: tuple = ("doc_id",)) -> DataFrame:
    return score(docs, fit(docs, labels, bits), bits, threshold, keep)


def op1_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
