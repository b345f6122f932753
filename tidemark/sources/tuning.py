"""How large a partition to read: candidates between two sizes are tried on some files, the fastest wins."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions import paths

SETTING = "spark.sql.files.maxPartitionBytes"
# Least and most bytes of a partition, how many sizes are tried, files read in a trial, memory for all cores.
LEAST, MOST, CANDIDATES, TRIAL_FILES, MEMORY = 50 << 20, 1 << 30, 5, 3, 4 << 30


def candidates(least: int = LEAST, most: int = MOST, n: int = CANDIDATES) -> list[int]:
    """n sizes from least to most, evenly spaced."""
    if not 0 < least <= most or n < 1:
        raise ValueError(f"no sizes between {least} and {most}")
    return sorted({least + (most - least) * i // max(n - 1, 1) for i in range(n)})


def whole(spark: SparkSession, files: list[str]) -> DataFrame:
    return spark.read.parquet(*map(paths.hadoop_path, files))


def trial(spark: SparkSession, files: list[str], read: Callable[[SparkSession, list[str]], DataFrame], size: int) -> float:
    """Seconds to read the files in partitions of the size; nothing is written."""
    before = spark.conf.get(SETTING)
    spark.conf.set(SETTING, str(size))
    try:
        df = read(spark, files)
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began
    finally:
        spark.conf.set(SETTING, before)


def best_partition_bytes(spark: SparkSession, files: list[str], read: Callable[[SparkSession, list[str]], DataFrame] = whole, sizes: Iterable[int] | None = None, memory: int = MEMORY) -> tuple[int, list[tuple[int, float]]]:
    """The fastest size and all trials (bytes, seconds). Sizes that all cores together can't hold in memory aren't tried, but
    for the least. read: as the run reads, for files of differing columns. The first file is read once before, so that no size pays for a cold start."""
    if not files:
        raise ValueError("no files to try")
    wanted = sorted(sizes if sizes is not None else candidates())
    cores = spark.sparkContext.defaultParallelism
    fits = [s for s in wanted if s * cores <= memory] or wanted[:1]
    some = files[:TRIAL_FILES]
    trial(spark, some[:1], read, fits[0])
    tried = [(s, trial(spark, some, read, s)) for s in fits]
    return min(tried, key=lambda t: t[1])[0], tried
