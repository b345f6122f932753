"""Operator 6 [native]: secrets by patterns and by a battery of randomness tests.

Patterns give spans of three kinds (assign, access, hex). Beside them, every run of 24 or more base64, base32 or hex
characters with a digit, and with = only at its end, that touches no such span is a candidate. Its encoding is inferred, its
characters become numbers, and three tests ask whether they look uniformly random: chi-squared over the alphabet
(Wilson-Hilferty, with the variance that few characters have), runs above and below the middle, and serial correlation at
lag 1. The battery's p-value is 1 - (1 - least)^3: uniform for random strings, near 0 for others.

A find is a claim that a string is random, so the control is of false finds: in each class of encoding and length (by powers
of two), strings with p of 0.5 or more are taken to be random, and tell how many random ones lie anywhere (Storey's
estimate); what is above that at a cutoff isn't random. The least cutoff at which the others are at most FDR of all above it
decides; what passes is a span of kind `random`. p-values are counted in bins, so the counts are bounded by classes and bins.

A random string of 24 characters has no digit with probability 0.018 in base64, 0.007 in base32 and 1e-10 in hex; of those and of shorter ones
nothing is found.

Nulls: a null text is empty: counts 0, digest of the empty string, empty spans; null doc_ids stay. Repeated rows are
counted and returned as often as they occur. Spans that begin together are in order of kind. Very long texts are read whole;
a text's cost grows with the square of its matches (8000 matches: seconds). Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import saved, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # the runs of [0-9a-f]+ with 16 characters or more
RUN = r"[A-Za-z0-9+/_-]{24,}={0,2}"
MIN_ASSIGN, MIN_ACCESS = 12, 18
FDR, BINS = 0.05, 200
#: Encodings: name, what a candidate must look like, alphabet.
ENCODINGS = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base64", r"^[A-Za-z0-9+/_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
KINDS = ("assign", "access", "hex", "random")
SPAN = "array<struct<start:int,kind:int,stop:int>>"


def spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """The pattern's matches that `keep` accepts, with code point positions: what lies between matches tells where they are."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(a: Column, z: Column) -> Column:
        start = a["at"] + F.char_length(z["gap"])
        stop = start + F.char_length(z["hit"])
        one = F.array(F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), stop.alias("stop")))
        return F.struct(stop.alias("at"), (F.concat(a["out"], one) if keep is None else F.when(keep(z["hit"]), F.concat(a["out"], one)).otherwise(a["out"])).alias("out"))

    zipped = F.arrays_zip(F.slice(between, 1, F.size(hits)).alias("gap"), hits.alias("hit"))
    return F.when(text.rlike(pattern), F.aggregate(zipped, zero, step)["out"]).otherwise(F.array().cast(SPAN))


def _normal_tail(z: Column) -> Column:
    """P(|Z| > |z|) by Abramowitz and Stegun 26.2.17."""
    x = F.least(F.abs(z), F.lit(37.0))
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.greatest(F.exp(-x * x / 2) * 0.7978845608028654 * poly, F.lit(1e-300))


def _upper_tail(z: Column) -> Column:
    """P(Z > z)."""
    return F.when(z >= 0, _normal_tail(z) / 2).otherwise(1 - _normal_tail(z) / 2)


def _codes(chars: Column, alphabet: str) -> Column:
    return F.transform(chars, lambda c: F.call_function("instr", F.lit(alphabet), c) - 1)


def battery(value: Column) -> Column:
    """struct (code: encoding's number, n, p) of a candidate."""
    code = F.when(value.rlike(ENCODINGS[0][1]), 0).when(value.rlike(ENCODINGS[1][1]), 1).otherwise(2)
    result = None
    for i in reversed(range(len(ENCODINGS))):
        _, _, alphabet = ENCODINGS[i]
        k = len(alphabet)
        plain = F.rtrim(value, F.lit("=")) if i else F.lower(value)
        plain = F.translate(plain, "-_=", "+/+") if i == 2 else plain
        chars = F.filter(F.split(plain, ""), lambda c: c != "")
        codes = _codes(chars, alphabet)
        result = _tests(codes, k, i) if result is None else F.when(code == i, _tests(codes, k, i)).otherwise(result)
    return result


def _tests(codes: Column, k: int, i: int) -> Column:
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    n = F.size(codes).cast("double")
    counts = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: F.size(F.filter(codes, lambda c: c == s)).cast("double"))
    chi = total(F.transform(counts, lambda c: c * c)) * k / n - n
    df = k - 1
    # Wilson and Hilferty's cube root; few characters have less variance, which makes for more degrees of freedom
    spread = 2 / (9 * (df * n / (n - 1)))
    p_chi = _upper_tail((F.pow(chi / df, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))
    high = F.transform(codes, lambda c: F.when(c >= k // 2, 1.0).otherwise(0.0))
    n1 = total(high)
    n0 = n - n1
    runs = 1 + total(F.transform(high, lambda h, j: F.when((j > 0) & (F.get(high, j - 1) != h), 1.0).otherwise(0.0)))
    mean = 1 + 2 * n1 * n0 / n
    var = (mean - 1) * (mean - 2) / F.greatest(n - 1, F.lit(1.0))
    p_runs = F.when((n1 < 1) | (n0 < 1) | (var <= 0), F.lit(1e-9)).otherwise(_normal_tail((runs - mean) / F.sqrt(F.greatest(var, F.lit(1e-9)))))
    mid = (k - 1) / 2
    lagged = total(F.transform(codes, lambda c, j: F.when(j > 0, (c - mid) * (F.get(codes, j - 1) - mid)).otherwise(0.0)))
    p_serial = _normal_tail(lagged / (F.sqrt(n - 1) * ((k * k - 1) / 12)))
    return F.struct(F.lit(i).alias("code"), F.size(codes).alias("n"), (1 - F.pow(1 - F.least(F.lit(1.0), p_chi, p_runs, p_serial), F.lit(3))).alias("p"))


def cutoffs(counts: list, fdr: float = FDR) -> dict[tuple[int, int], int]:
    """For each class the least bin of p from which at most `fdr` of the candidates aren't random; no entry if there is none."""
    by = defaultdict(dict)
    for code, size, b, n in counts:
        by[code, size][b] = by[code, size].get(b, 0) + n
    out = {}
    for key, bins in by.items():
        random = 2 * sum(n for b, n in bins.items() if 2 * b >= BINS)  # expected in all, as half of them lie there
        above = 0
        for b in range(BINS - 1, -1, -1):
            above += bins.get(b, 0)
            false = above - random * (1 - b / BINS)
            if random and false <= fdr * above:
                out[key] = b
    return out


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """A row for each row of docs: doc_id, base (spans of the patterns) and random (spans of the battery)."""
    text = F.coalesce("text", F.lit(""))
    group2 = lambda h: F.char_length(F.regexp_extract(h, ASSIGN, 2)) >= MIN_ASSIGN
    df = docs.select("doc_id", text.alias("text"))
    df = df.select("doc_id", "text", spans(F.col("text"), ASSIGN, "assign", group2).alias("a"), spans(F.col("text"), ACCESS, "access", lambda h: F.char_length(h) >= MIN_ACCESS).alias("k"), spans(F.col("text"), HEX, "hex").alias("h"), spans(F.col("text"), RUN, "random", lambda h: h.rlike("[0-9]")).alias("c"))
    df = df.select("doc_id", "text", F.array_sort(F.concat("a", "k", "h")).alias("base"), "c")
    alone = F.filter("c", lambda s: ~F.exists("base", lambda x: (x["start"] < s["stop"]) & (x["stop"] > s["start"])))
    value = lambda s: F.substring(F.col("text"), s["start"] + 1, s["stop"] - s["start"])
    df = df.select("doc_id", "base", F.transform(alone, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), value(s).alias("value"))).alias("c"))
    tested = F.transform("c", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), battery(s["value"]).alias("t")))
    binned = F.transform("tested", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["t"]["code"].alias("code"), F.floor(F.log2(F.greatest(s["t"]["n"], F.lit(1)))).cast("int").alias("size"), F.least(F.lit(BINS - 1), F.floor(s["t"]["p"] * BINS)).cast("int").alias("bin")))
    df = df.select("doc_id", "base", tested.alias("tested")).select("doc_id", "base", binned.alias("c"))
    df = saved(df, "candidates")
    few = df.where(F.size("c") > 0).select(F.explode_outer("c").alias("c")).groupBy("c.code", "c.size", "c.bin").count().collect()  # at most encodings x log2(length) x bins
    cut = cutoffs([tuple(r) for r in few], fdr)
    limit = F.create_map(*[x for (c, z), b in sorted(cut.items()) for x in (F.lit(c * 100 + z), F.lit(b))]) if cut else F.create_map(F.lit(-1), F.lit(BINS))
    random = F.filter("c", lambda s: s["bin"] >= F.coalesce(limit[s["code"] * 100 + s["size"]], F.lit(BINS)))
    return df.select("doc_id", "base", F.transform(random, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), s["stop"].alias("stop"))).alias("random"))


def listed(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "random"))).alias("spans"))
