"""Operator 10: SimHash near-duplicates by pigeonhole blocks.

A text's fingerprint is the bitwise majority of the XXH64 of its 4-word shingles. The 64 bits are cut into m blocks;
fingerprints that differ in at most r bits agree in at least m - r whole blocks, so rows are keyed by every choice of
m - r blocks and only rows that share a key are compared. m follows the number of distinct fingerprints, so that keys
stay selective: no choice of m loses a pair. Each key's rows are linked by a spanning forest, never by all pairs.

Nulls: a null text has fingerprint 0, as one without words; a row with null doc_id gets a fingerprint and the component
of its equals. Repeated rows stay repeated. A bit set in exactly half the shingles is 0. Very long texts are read whole, a
slice of hashes at a time. Other columns are ignored, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import components, saved, scratch, sliced, table

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Keys with more fingerprints than this are dealt out as tiles (pairs of chunks), each in a task of its own.
TILE = 20_000
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def simhash(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    n = len(found)
    if not n:
        return 0
    joined = b" ".join(found)
    if n <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, seed = xxhash.xxh64_intdigest, SEED
    h = np.array([digest(joined[i:j], seed) for i, j in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids pass as they are: pandas would make floats of longs beside nulls."""
    for batch in sliced(batches):
        fp = np.fromiter((simhash(x) for x in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): a row for each row of docs; fp holds the 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def block_masks(m: int, agree: int) -> list[int]:
    """Signed masks of every choice of `agree` of m blocks."""
    cuts = [round(64 * i / m) for i in range(m + 1)]
    blocks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(m)]
    return [x - (1 << 64) if x >> 63 else x for x in (sum(c) for c in combinations(blocks, agree))]


def agreement(n: int, radius: int = RADIUS) -> int:
    """How many of `radius + agreement` blocks must agree, so that chance meetings of n fingerprints under a key stay rare."""
    return next((g for g in range(1, 7) if 2 ** (64 * g / (radius + g)) >= 8 * n), 7)


def _forest(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph that links fingerprints within the radius."""
    src, dst, rest = [], [], np.arange(len(x))
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            p = todo.pop()
            near = np.bitwise_count(x[rest] ^ x[p]) <= radius
            hit = rest[near]
            if len(hit):
                src.append(np.full(len(hit), x[p]))
                dst.append(x[hit])
                todo.extend(hit.tolist())
                rest = rest[~near]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(src), np.concatenate(dst)) if src else (none, none)


def _links(radius: int):
    """For partitions sorted by key: the links within each key, whose rows may span batches."""

    def of(key: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        cut = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
        start, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(x)]))
        size, src, dst = end - start, [], []
        two = start[size == 2]
        near = two[np.bitwise_count(x[two] ^ x[two + 1]) <= radius]
        src.append(x[near])
        dst.append(x[near + 1])
        for i in np.flatnonzero(size > 2):
            a, b = _forest(x[start[i] : end[i]], radius)
            src.append(a)
            dst.append(b)
        return pd.DataFrame({"src": np.concatenate(src).view(np.int64), "dst": np.concatenate(dst).view(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not len(batch):
                continue
            key, x = batch[["choice", "part", "tile"]].to_numpy(np.int64), batch["fp"].to_numpy(np.int64).view(np.uint64)
            last = np.flatnonzero(np.any(key != key[-1], axis=1))
            if not len(last):  # all of one key: wait for its end
                if held and np.any(held[0][0][-1] != key[0]):
                    yield of(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
                held.append((key, x))
                continue
            k = last[-1] + 1
            held.append((key[:k], x[:k]))
            yield of(*map(np.concatenate, zip(*held, strict=True)))
            held = [(key[k:], x[k:])]
        if held:
            yield of(*map(np.concatenate, zip(*held, strict=True)))

    return run


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(src, dst): links that connect all fingerprints within the radius. fps: distinct values in column fp, saved."""
    g = agreement(fps.count(), radius)
    masks = block_masks(radius + g, g)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks)])).alias("k")).select("fp", "k.choice", "k.part")
    hot = saved(keyed.groupBy("choice", "part").count().where(F.col("count") > tile).select("choice", "part", F.ceil(F.col("count") / tile).alias("chunks")), "hot-keys")
    if hot.isEmpty():
        tiled = keyed.withColumn("tile", F.lit(0).cast("long"))
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
        pair = lambda j: F.least(own, j) * F.col("chunks") + F.greatest(own, j)
        tiled = keyed.join(hot, ["choice", "part"], "left").withColumn("tile", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)) - 1), pair)))).drop("chunks")
    return tiled.repartition("choice", "part", "tile").sortWithinPartitions("choice", "part", "tile").mapInPandas(_links(radius), "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): a row for each row of docs; component_id is the least doc_id reachable over links."""
    scratch(docs.sparkSession)
    fps = saved(fingerprints(docs), "fingerprints")
    groups = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    linked = components(links(groups.select("fp"), radius))
    member = linked.join(groups, linked.node == groups.fp).select("fp", "component", "least")
    ids = saved(member.join(member.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id"), "members")
    whole = groups.join(ids, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return fps.join(whole, "fp").select("doc_id", "fp", "component_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
