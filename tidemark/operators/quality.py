"""Run accounting: what was read, kept and discarded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mismatched(year: int, month: int):
    """Row's month is not the file's."""
    return (F.year("ts") != year) | (F.month("ts") != month)


def counters(trips: DataFrame, year: int, month: int) -> DataFrame:
    return trips.agg(F.count("*").alias("input_rows"), F.count_if(F.col("ts").isNull()).alias("parse_failures"), F.count_if(mismatched(year, month)).alias("month_mismatch"), F.count_distinct(F.when(mismatched(year, month), F.col("path"))).alias("files_with_mismatch"))


def per_file(trips: DataFrame) -> DataFrame:
    return trips.groupBy("path").agg(F.count("*").alias("input_rows"), F.count_if(F.col("ts").isNull()).alias("parse_failures"))


def by_file_and_month(trips: DataFrame) -> DataFrame:
    """Rows by path and the month of their time (null where there is none): all that the run's counters need, from one narrow scan."""
    return trips.groupBy("path", F.year("ts").alias("year"), F.month("ts").alias("month")).agg(F.count("*").alias("n"))


def run_totals(months: DataFrame, files: DataFrame) -> DataFrame:
    """input_rows, parse_failures, month_mismatch and files_with_mismatch. months: by_file_and_month; files: path, year, month of each."""
    said = files.select(F.col("path").alias("_p"), F.col("year").alias("_y"), F.col("month").alias("_m"))
    off = (F.col("year") != F.col("_y")) | (F.col("month") != F.col("_m"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return months.join(said, F.col("path") == F.col("_p"), "left").agg(n(F.lit(True)).alias("input_rows"), n(F.col("year").isNull()).alias("parse_failures"), n(off).alias("month_mismatch"), F.count_distinct(F.when(off, F.col("path"))).alias("files_with_mismatch"))


def breakdown(table: DataFrame, kind: str = "taxi_type") -> DataFrame:
    """Rows by year and type, and their share; the window is over the few groups, not the rows."""
    rows = table.groupBy(F.year("date").alias("year"), F.col(kind).alias("taxi_type")).agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def discards(stats: DataFrame) -> DataFrame:
    """Discarded rows by reason, with percentages of all discarded. stats: one row, a column a reason."""
    names = stats.columns
    long = stats.unpivot([], names, "reason", "n")
    return long.withColumn("percent", F.round(F.coalesce(100.0 * F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy()), F.lit(0)), F.lit(0.0)), 6))


def by_month(files: DataFrame, first: int | None = None) -> DataFrame:
    """Files by month, months without a date last; first: only so many months."""
    ym = F.coalesce(F.col("year") * 100 + F.col("month"), F.lit(999999))
    rows = files.groupBy(ym.alias("ym")).agg(F.array_sort(F.collect_list("path")).alias("paths"), F.count("*").alias("n"))
    return rows if first is None else rows.orderBy("ym").limit(first)
