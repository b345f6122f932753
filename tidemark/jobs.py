"""The runs from files to files: `python -m tidemark.jobs NAME ...`, or a function each.

wide: trips to the wide table and a report. components: a wide table to a model. stability: a wide table to bootstrap
figures. tails: a model to the tail report of its loadings. zones: a wide table and a zone lookup to map markers.
Inputs and outputs are paths of any Hadoop file system.
"""

from __future__ import annotations

import argparse
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import paths, roles
from tidemark.functions.scalars import human_size, parse_size
from tidemark.operators import linalg, quality, resample, tails, wide, zones
from tidemark.sources import files as sources
from tidemark.sources import sinks, tuning

KEYS = ["taxi_type", "date", "pickup_place"]
TYPES = ("yellow", "green", "fhvhv", "fhv")


def usable(spark: SparkSession, found: list[str]) -> tuple[list[str], dict[str, str]]:
    """Files with a pickup time and place, and of the others why not: one bad file doesn't end a run."""
    good, bad = [], {}
    for path, footer in sources.footers(spark, found).items():
        columns = [] if isinstance(footer, Exception) else [c for c, _ in footer]
        if isinstance(footer, Exception):
            bad[path] = str(footer).splitlines()[0][:200]
        elif not roles.pickup_datetime(columns):
            bad[path] = "no pickup time"
        elif not roles.pickup_location(columns) and not roles.pickup_lon_lat(columns):
            bad[path] = "no pickup place"
        else:
            good.append(path)
    return good, bad


def typed_trips(spark: SparkSession, catalog: list) -> DataFrame | None:
    """ts, taxi_type, date, pickup_place, path. The type is a literal of each file group, so no path is matched per row."""
    out = None
    for kind in sorted({r["taxi_type"] for r in catalog}):
        part = sources.read_trips(spark, [r["path"] for r in catalog if r["taxi_type"] == kind])
        part = part.select("ts", F.lit(kind).alias("taxi_type"), F.to_date("ts").alias("date"), F.col("place").alias("pickup_place"), "path")
        out = part if out is None else out.unionByName(part)
    return out


def run_wide(spark: SparkSession, source: str, target: str, min_rides: int = 50, grain: str = "file", months: int | None = None, types: tuple = TYPES, report: str | None = None, intermediate: str | None = None, partition_size: str | None = None, tune: bool = False, max_memory: str | None = None) -> dict:
    """Write the wide table; returns the run's metrics. grain: whether min_rides judges a key within each file or over all.

    Files of unknown type and files that can't be used are left out and counted as failed. months: only the first so many.
    intermediate: where to keep the table before cleaning, which else is deleted at the end. partition_size: bytes of a read
    partition ('200MB'); tune: chosen by trial, within max_memory.
    """
    if grain not in ("file", "global"):
        raise ValueError(f"grain is file or global, not {grain!r}")
    clock, took = [time.time()], {}

    def done(step: str) -> None:
        took[f"seconds_{step}"] = round(time.time() - clock[-1], 2)
        clock.append(time.time())

    found = sources.discover(spark, source)
    done("discovery")
    good, bad = usable(spark, found)
    catalog = sources.file_catalog(spark, good)
    if months is not None:
        early = quality.by_month(catalog, months).select(F.explode("paths").alias("path"))
        catalog = catalog.join(early, "path", "left_semi")
    listed = catalog.collect()
    bad |= {r["path"]: "unknown type" for r in listed if r["taxi_type"] == "unknown"}
    listed = [r for r in listed if r["taxi_type"] in types]
    if not listed:
        raise ValueError(f"no usable files under {source}")
    before = spark.conf.get(tuning.SETTING)
    if tune:
        memory = parse_size(max_memory) if max_memory else tuning.MEMORY
        size, _ = tuning.best_partition_bytes(spark, [r["path"] for r in listed], sources.read_trips, memory=memory)
        spark.conf.set(tuning.SETTING, str(size))
    elif partition_size:
        spark.conf.set(tuning.SETTING, str(parse_size(partition_size)))
    done("footers")
    try:
        with sinks.scratch_removed(spark):
            trips = typed_trips(spark, listed)
            keys = [*KEYS, "path"] if grain == "file" else KEYS
            if intermediate:
                sinks.write_wide(wide.wide(trips, keys), intermediate)
                counted = spark.read.parquet(intermediate)
            else:
                counted = sinks.kept(wide.wide(trips, keys), "wide")
            table = wide.cleaned(counted, min_rides)
            sinks.write_wide(wide.combine([table.drop("path")], KEYS) if grain == "file" else table, target)
            removed = wide.cleanup_stats(counted, min_rides).select("rows_before", "rows_removed", "rides_dropped").first().asDict()
            done("write")
            seen = quality.by_file_and_month(trips).withColumn("path", paths.plain(F.col("path")))
            totals = quality.run_totals(seen, catalog).first().asDict()
        written = spark.read.parquet(target)
        years = quality.breakdown(written).orderBy("year", "taxi_type").collect()
        done("counters")
        used = {"cores": spark.sparkContext.defaultParallelism, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"), "partition_bytes": spark.conf.get(tuning.SETTING)}
    finally:
        spark.conf.set(tuning.SETTING, before)
    seconds = time.time() - clock[0]
    read, put = sum(sinks.size_of(spark, paths.hadoop_path(r["path"])) for r in listed), sinks.size_of(spark, target)
    discarded = totals["parse_failures"] + removed["rides_dropped"]
    percent = 100 * discarded / totals["input_rows"] if totals["input_rows"] else 0.0
    metrics = {"files": len(listed), "failed_files": len(bad), "attempted_files": len(found), "min_rides": min_rides, "grain": grain, "seconds": round(seconds, 2)} | took
    metrics |= {"source": source, "input_bytes": read, "input_size": human_size(read), "input_mb_per_second": round(read / 1e6 / seconds, 3)} | totals | removed
    metrics |= {"discarded": discarded, "discarded_percent": round(percent, 2), "retained": totals["input_rows"] - discarded, "retained_percent": round(100 - percent, 2) if totals["input_rows"] else 0.0}
    metrics |= {"target": target, "output_rows": sum(r["n"] for r in years), "output_columns": len(written.columns), "output_bytes": put, "output_size": human_size(put), "output_mb_per_second": round(put / 1e6 / seconds, 3), "compression_ratio": round(read / put, 2) if put else None} | used
    metrics |= {f"failed: {k}": v for k, v in sorted(bad.items())}
    if report:
        sinks.write_report(spark, metrics, [(r["year"], r["taxi_type"], r["n"]) for r in years], report)
    return metrics


def wide_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored wide table, its keys repaired; KeyError if hours are missing."""
    df = roles.repaired_keys(spark.read.parquet(paths.hadoop_path(path)))
    if missing := [c for c in wide.HOURS if c not in df.columns]:
        raise KeyError(f"missing columns: {missing}")
    return df


def run_components(spark: SparkSession, table: str, model: str) -> list[float]:
    """Write the model; returns the shares of variance, largest first."""
    components, values, _ = linalg.fit(wide_table(spark, table), wide.HOURS)
    sources.write_model(spark, model, components, values)
    return (values / values.sum()).tolist()


def run_stability(spark: SparkSession, table: str, target: str, replicates: int = 100, k: int = 2, seed: int = 42) -> dict[str, str]:
    """Write a row a replicate; returns the ratings. Replicates are drawn by the row's keys."""
    df = wide_table(spark, table).withColumn("_key", F.concat_ws("|", *[F.col(c).cast("string") for c in KEYS]))
    found, _ = resample.pca_stability(df, wide.HOURS, "_key", replicates, k, seed)
    sinks.write_json(resample.stability_table(spark, found).coalesce(1), target)
    return resample.interpretation(found, k)


def run_tails(spark: SparkSession, model: str, target: str) -> dict:
    """Write and return the tail report of the loadings (24 x 24 numbers)."""
    loadings, _ = sources.read_model(spark, model)
    out = tails.tail_report(spark, np.array([r["loading"] for r in loadings.orderBy("pc", "hour").collect()])).first().asDict()
    sinks.write_json(spark.createDataFrame([tuple(out.values())], f"{tails.REPORT}, tail string"), target)
    return out


def run_zones(spark: SparkSession, table: str, lookup: str, target: str, model: str | None = None) -> int:
    """Write the map's markers, on a stored model's components or else on the table's own; returns how many."""
    rows = wide_table(spark, table)
    scored = zones.scores_of(rows, sources.read_model(spark, model)[0]) if model else zones.scores(rows)
    found = zones.markers(scored, sources.read_zones(spark, lookup))
    found.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target).count()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark.jobs", description=__doc__)
    top.add_argument("--signed", action="store_true", help="use object store credentials, if any are found; anonymous otherwise")
    top.add_argument("--verbose", action="store_true", help="Spark's own messages, too")
    top.add_argument("--master", help="Spark's master; unset: as spark-submit says")
    sub = top.add_subparsers(dest="name", required=True)
    w = sub.add_parser("wide")
    w.add_argument("source")
    w.add_argument("target")
    w.add_argument("--min-rides", type=int, default=50)
    w.add_argument("--grain", choices=("file", "global"), default="file")
    w.add_argument("--months", type=int, help="only the first so many months")
    w.add_argument("--types", nargs="+", default=list(TYPES), choices=TYPES)
    w.add_argument("--report", help="Markdown report; a JSON file goes beside it")
    w.add_argument("--intermediate", help="keep the table before cleaning here")
    w.add_argument("--partition-size", help="bytes of a read partition, as 200MB")
    w.add_argument("--tune", action="store_true", help="choose the read partition by trial")
    w.add_argument("--max-memory", help="memory that a trial's partitions may take together, as 4GB")
    c = sub.add_parser("components")
    c.add_argument("table")
    c.add_argument("model")
    s = sub.add_parser("stability")
    s.add_argument("table")
    s.add_argument("target")
    s.add_argument("--replicates", type=int, default=100)
    s.add_argument("--k", type=int, default=2)
    s.add_argument("--seed", type=int, default=42)
    t = sub.add_parser("tails")
    t.add_argument("model")
    t.add_argument("target")
    z = sub.add_parser("zones")
    z.add_argument("table")
    z.add_argument("lookup")
    z.add_argument("target")
    z.add_argument("--model", help="a stored model; else the table's own components")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> object:
    args = vars(parser().parse_args(argv))
    signed, verbose, master, name = (args.pop(x) for x in ("signed", "verbose", "master", "name"))
    if spark is None:
        builder = SparkSession.builder.appName(f"tidemark-{name}").config("spark.sql.session.timeZone", "UTC")
        spark = (builder.master(master) if master else builder).config(map=paths.storage_options(not signed)).getOrCreate()
    if verbose:
        spark.sparkContext.setLogLevel("INFO")
    out = {"wide": run_wide, "components": run_components, "stability": run_stability, "tails": run_tails, "zones": run_zones}[name](spark, **args)
    print(out)
    return out


if __name__ == "__main__":
    main()
