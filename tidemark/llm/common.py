"""Shared pieces: table access, shared scratch folder, word splitting, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space and the controls 0x09-0x0D.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset and all runs in one
    process (tests), one of our own; on a cluster without the setting, an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def saved_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Like saved, with the folder, for `forget`."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again."""
    return saved_at(df, name)[0]


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete folders of saved tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def saved_buckets(df: DataFrame, name: str, key: str) -> tuple[DataFrame, str]:
    """Like saved_at, for a table that is grouped by a key again and again: it is bucketed by the key, so that no later
    grouping moves it."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    own = path.rpartition("/")[2].replace("-", "_")
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key).option("path", path).saveAsTable(own)
    return spark.table(own), path


def forget_buckets(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        spark.sql(f"drop table if exists `{path.rpartition('/')[2].replace('-', '_')}`")
        forget(spark, path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that a worker holds few texts as Python objects at a time; at the end, what Arrow holds
    in reserve goes back, as workers live on."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    pa.default_memory_pool().release_unused()


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether df has no more than so many rows; reads no further than that."""
    return df.limit(rows + 1).count() <= rows


def sized_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where a count proves df small; otherwise df as it is, so that Spark shuffles it."""
    return F.broadcast(df) if at_most(df, rows) else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (src, dst), as (node, component): the least node of each.

    Alternating large and small stars (Kiveris et al., 2014), until all edges go from leaves to the least node of a star: a
    number of rounds that grows with the logarithm of the nodes, squared at most. Each round is a few aggregations and joins on nodes, and its result is
    written to the shared folder in place of the one before. Nulls and loops are left out; an empty edge list gives an
    empty result.
    """
    spark = edges.sparkSession
    e = edges.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e, path = saved_at(e, "edges")
    while True:
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(e.select("v", F.lit(0), F.lit(1)))
        odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or (up = 1 and root = 1)")
        if odd.isEmpty():  # no node has two edges up, or one up and others down: stars, whose least nodes are their roots
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u <> v").distinct()
        old, (e, path) = path, saved_at(small, "edges")
        forget(spark, old)
