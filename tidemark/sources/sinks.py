"""Writers: wide tables, JSON reports, the run report, tables between steps."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of `kept` tables, by run: the innermost open `scratch_removed` owns what is kept meanwhile.
_owned: list[list[str]] = []


def write_wide(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. One of our own only where it is unset and all runs in
    one process (tests); on a cluster without the setting, an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: df written into the shared folder and read again."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    if _owned:
        _owned[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


@contextmanager
def scratch_removed(spark: SparkSession) -> Iterator[list[str]]:
    """Delete at the end, also after errors, what `kept` writes in this block. For runs that end with a written result;
    a DataFrame that still reads a kept table must not leave the block."""
    _owned.append([])
    try:
        yield _owned[-1]
    finally:
        for path in _owned.pop():
            fs, at = _at(spark, path)
            fs.delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file on any Hadoop file system."""
    fs, at = _at(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes under a path."""
    fs, at = _at(spark, path)
    return fs.getContentSummary(at).getLength()


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


#: Metrics by section of the report; the others come first, files that failed last.
SECTIONS = {
    "Time": ("seconds", "seconds_discovery", "seconds_footers", "seconds_write", "seconds_counters"),
    "Input": ("source", "input_files", "input_bytes", "input_size", "input_rows", "input_mb_per_second"),
    "Output": ("target", "output_rows", "output_columns", "output_bytes", "output_size", "output_mb_per_second", "compression_ratio"),
    "Quality": ("parse_failures", "month_mismatch", "files_with_mismatch", "rows_before", "rows_removed", "rides_dropped", "discarded", "discarded_percent", "retained", "retained_percent"),
    "Resources": ("cores", "shuffle_partitions", "partition_bytes"),
}


def _table(head: str, rows: list[tuple]) -> list[str]:
    return [f"| {head} |", "|" + "---|" * (head.count("|") + 1), *("| " + " | ".join(str(x) for x in r) + " |" for r in rows)]


def report_lines(metrics: dict, breakdown: list[tuple]) -> list[str]:
    """The run report as Markdown: general metrics, a section for each kind, rows by year and type, failed files."""
    named = {k for names in SECTIONS.values() for k in names}
    failed = {k: v for k, v in metrics.items() if k.startswith("failed: ")}
    lines = ["# Run report", "", *_table("metric | value", [(k, v) for k, v in metrics.items() if k not in named and k not in failed])]
    for title, names in SECTIONS.items():
        if own := [(k, metrics[k]) for k in names if k in metrics]:
            lines += ["", f"## {title}", "", *_table("metric | value", own)]
    total = sum(n for _, _, n in breakdown)
    shares = [(y, t, n, f"{100 * n / total:.1f}" if total else "0.0") for y, t, n in breakdown]
    lines += ["", "## Rows by year and type", "", *_table("year | type | rows | percent", shares)]
    if failed:
        lines += ["", "## Failed files", "", *_table("file | why", [(k.removeprefix("failed: "), v) for k, v in failed.items()])]
    return lines


def write_report(spark: SparkSession, metrics: dict, breakdown: list[tuple], path: str) -> None:
    """Markdown at the path and JSON beside it, on any Hadoop file system."""
    write_text(spark, path, "\n".join(report_lines(metrics, breakdown)) + "\n")
    write_text(spark, path.removesuffix(".md") + ".json", json.dumps(metrics, default=str, indent=1))
