"""Near copies of texts for the pipeline: operator 10's fingerprints, and a verified second pass for what they don't reach.

Texts are lower-cased (ASCII) and cut into words; a text's set holds its distinct five-word shingles as 64-bit hashes
(fewer words are one shingle, no words the empty text's own). Texts of equal sets are one form. Forms are linked if the
Jaccard similarity of their sets is SIMILARITY or more; groups are the connected components.

Candidates come from two indexes. The first is operator 10: SimHash fingerprints of the shingles meet in pigeonhole blocks
and lie within RADIUS bits. At a similarity of 0.8 fingerprints differ in about 10 bits of 64, and no blocks for so large a
radius are selective, so the second index gives every form BANDS keys, each the minima of ROWS random orders of its
shingles: two forms at the similarity have a key in common with probability 1 - (1 - 0.8^ROWS)^BANDS = 0.99993, above 0.9
always. A sketch of 128 bits, each from one minimum, differs in 12.8 bits on average at the similarity; pairs beyond FAR
bits (more than five standard deviations) are passed over. All others are compared exactly.

A form is first compared with one partner alone, the nearest by sketch among the first forms of its keys; what that links is
contracted, PARTNERS times more with another partner, and then all pairs under a key that are not linked yet, whose sketches are near, and whose shingles can be
enough: the parities of how many shingles a set has in PARITY ranges bound from below in how many two sets differ. So a
large group of near copies gives few pairs, and none is left out.

Nulls: a null text is empty, a null doc_id is an id like any, last in order. Repeated rows are of one form. Very long texts
are read whole; their sets are compared as arrays. Ties go to the least id, then the least hash. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, saved, sized_broadcast, sliced
from tidemark.llm.simhash_dedup import RADIUS, links, majority

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, FAR, PARTNERS = 24, 5, 31, 2
SKETCH, PARITY = 128, 512
#: Keys, or forms, up to this count are broadcast (a few longs each); more are joined by shuffle.
BROADCAST_KEYS = 1_000_000
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
ORDERS = np.random.default_rng(20).integers(0, 1 << 63, (2, SKETCH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    n, digest = len(found), xxhash.xxh64_intdigest
    if n < SHINGLE:
        return np.array([digest(b" ".join(found), n + 1)], np.uint64)
    h = np.fromiter((digest(w) for w in found), np.uint64, n)
    out = h[: n - SHINGLE + 1].copy()
    for k in range(1, SHINGLE):
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out += h[k : n - SHINGLE + 1 + k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x94D049BB133111EB)
    return np.unique(out ^ (out >> np.uint64(29)))


def minima(s: np.ndarray) -> np.ndarray:
    """The least of the set's shingles in each of SKETCH random orders."""
    out = np.full(SKETCH, ~np.uint64(0))
    for i in range(0, len(s), 4096):
        out = np.minimum(out, (s[i : i + 4096, None] * ORDERS[0]).min(axis=0))
    return out


def keys_and_sketch(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of minima: the keys of the bands, and the sketch as two longs."""
    key = np.zeros((len(least), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key ^= key >> np.uint64(31)
        key = key * np.uint64(0x9E3779B97F4A7C15) + least[:, j : BANDS * ROWS : ROWS]
    key ^= key >> np.uint64(32)
    bits = ((least ^ (least >> np.uint64(29))) * ORDERS[1]) >> np.uint64(63)
    return (key * np.uint64(0x94D049BB133111EB)).view(np.int64), np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)


def parity(s: np.ndarray) -> np.ndarray:
    """Whether the set has an odd number of shingles in each of PARITY ranges, as longs: two sets differ in as many shingles at least."""
    return np.packbits((np.bincount((s >> np.uint64(64 - PARITY.bit_length() + 1)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)).view(np.int64)


ROWS_OUT = "doc_id long, th long, form long, m int, fp long, s1 long, s2 long, keys array<long>, parity array<long>"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        sets = [shingles(x) for x in batch.column("text").to_pylist()]
        form = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        fp = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
        key, sketch = keys_and_sketch(np.stack([minima(s) for s in sets]))
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(key.reshape(-1)))
        odd = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (PARITY // 64)), pa.array(np.concatenate([parity(s) for s in sets])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(form), pa.array([len(s) for s in sets], pa.int32()), pa.array(fp), pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy()), listed, odd], [x.split()[0] for x in ROWS_OUT.split(", ")])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        sets = [shingles(x).tobytes() for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("form"), pa.array(sets, pa.binary())], ["form", "s"])


def _alike(similarity: float):
    """The pairs (a, b, sa, sb) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return run


def _similar(pairs: DataFrame, forms: DataFrame, base: DataFrame, twice: bool, similarity: float) -> DataFrame:
    """(src, dst) of the pairs of forms (a, b) at the similarity; only texts of forms in pairs are read again."""
    ids = pairs.select(F.col("a").alias("form")).union(pairs.select("b")).distinct()
    used = saved(forms.join(ids, "form", "left_semi").select("form", F.col("least.doc_id").alias("d"), F.col("least.th").alias("t")), "used")
    texts = base.join(sized_broadcast(used, BROADCAST_KEYS), (F.col("th") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("form", "text")
    sets = saved((texts.dropDuplicates(["form"]) if twice else texts).mapInArrow(_sets, "form long, s binary"), "sets")
    side = lambda x: sets.select(F.col("form").alias(x), F.col("s").alias("s" + x))
    return saved(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(_alike(similarity), "src long, dst long"), "similar")


def _open(keyed: DataFrame, near: DataFrame) -> DataFrame:
    """Of keys whose forms aren't all linked: keyed with component and main, the largest under the key."""
    placed = saved(keyed.join(components(near), keyed.form == F.col("node"), "left").drop("node").withColumn("component", F.coalesce("component", "form")), "placed")
    main = placed.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("k")).where("k > 1").select("key", "main")
    return saved(placed.join(sized_broadcast(saved(main, "open-keys"), BROADCAST_KEYS), "key"), "open")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, th, first_id, first_th): a row for each row of docs; th is the text's XXH64. The first of its group has
    the least doc_id (null last), then the least th."""
    base = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("th"))
    rows = saved(base.mapInArrow(_describe, ROWS_OUT), "rows")
    twice = not rows.groupBy("doc_id", "th").count().where("count > 1").isEmpty()
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    forms = saved(rows.groupBy("form").agg(F.min(rank).alias("least"), *[F.first(c).alias(c) for c in ("m", "fp", "s1", "s2", "keys", "parity")]), "forms")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    apart = lambda x, y: F.bit_count(F.col(f"{x}s1").bitwiseXOR(F.col(f"{y}s1"))) + F.bit_count(F.col(f"{x}s2").bitwiseXOR(F.col(f"{y}s2")))
    close = lambda x, y: (F.least(x, y) >= similarity * F.greatest(x, y) - 1e-9)
    # operator 10: fingerprints within the radius, and forms of one fingerprint
    heads = saved(forms.groupBy("fp").agg(F.min("form").alias("head"), F.count("*").alias("n")), "heads")
    of = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head"))
    linked = links(heads.select("fp"), radius).join(of("src"), "src").join(of("dst"), "dst").select(*pair("src_head", "dst_head"))
    shared = forms.join(heads.where("n > 1").select("fp", "head"), "fp").where("form <> head").select(*pair("form", "head"))
    # min-wise keys; most are of one form alone
    entries = forms.select("form", F.explode_outer("keys").alias("key"))
    keys = saved(entries.groupBy("key").count().where(F.col("count") > 1).select("key"), "keys")
    keyed = saved(forms.select("form", "m", "s1", "s2", F.explode_outer("keys").alias("key")).join(sized_broadcast(keys, BROADCAST_KEYS), "key"), "keyed")
    first = keyed.groupBy("key").agg(F.min(F.struct(F.xxhash64("form").alias("r"), "form", "m", "s1", "s2")).alias("p")).select("key", *[F.col(f"p.{c}").alias(f"f_{c}") for c in ("form", "m", "s1", "s2")])
    star = keyed.join(sized_broadcast(saved(first, "firsts"), BROADCAST_KEYS // 2), "key").where((F.col("form") != F.col("f_form")) & close("m", "f_m")).withColumn("bits", apart("", "f_")).where(F.col("bits") <= FAR)
    star = star.groupBy("form").agg(F.min(F.struct("bits", "f_form")).alias("best")).select(*pair("form", F.col("best.f_form")))
    pairs = saved(linked.union(shared).union(star).distinct(), "pairs")
    near = _similar(pairs, forms, base, twice, similarity)
    named = [f"p{i}" for i in range(PARITY // 64)]
    left = _open(keyed, near).join(forms.select("form", *[F.get("parity", F.lit(i)).alias(c) for i, c in enumerate(named)]), "form")
    columns = ["form", "m", "component", "s1", "s2", *named]
    renamed = lambda df: df.select("key", *[F.col(c).alias(f"o_{c}") for c in columns])
    differ = F.lit(0)
    for c in named:
        differ = differ + F.bit_count(F.col(c).bitwiseXOR(F.col(f"o_{c}")))
    may = (F.col("o_component") != F.col("component")) & close("m", "o_m") & (apart("", "o_") <= FAR) & (differ <= (1 - similarity) / (1 + similarity) * (F.col("m") + F.col("o_m")) + 1e-9)
    for k in range(PARTNERS):  # again a partner each, the nearest of one from the largest component under each key
        left = saved(left, "possible")
        one = left.where("component = main").groupBy("key").agg(F.min(F.struct(F.xxhash64("form", "key", F.lit(k)).alias("r"), *columns)).alias("p")).select("key", "p.*")
        star = left.join(sized_broadcast(saved(renamed(one), "partners"), BROADCAST_KEYS // 4), "key").where(may).groupBy("form").agg(F.min(F.struct(differ.alias("d"), "o_form")).alias("best"))
        near = near.union(_similar(saved(star.select(*pair("form", F.col("best.o_form"))).distinct(), "pairs"), forms, base, twice, similarity))
        left = _open(left.drop("component", "main"), near)
    rest = renamed(left.where("component <> main")).join(left, "key").where(may & ((F.col("component") == F.col("main")) | (F.col("o_form") < F.col("form"))))
    more = _similar(saved(rest.select(*pair("o_form", "form")).distinct(), "rest"), forms, base, twice, similarity)
    member = saved(forms.select("form", "least").join(components(near.union(more)), F.col("form") == F.col("node"), "left").select("form", "least", F.coalesce("component", "form").alias("component")), "member")
    best = member.groupBy("component").agg(F.min("least").alias("first"))
    return rows.select("doc_id", "th", "form").join(member.select("form", "component"), "form").join(best, "component").select("doc_id", "th", F.col("first.doc_id").alias("first_id"), F.col("first.th").alias("first_th"))
