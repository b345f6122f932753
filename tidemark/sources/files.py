"""File discovery, schema checks and readers. Everything goes through Spark's readers, so any Hadoop file system works."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import paths, roles


def discover(spark: SparkSession, path: str) -> list[str]:
    """All Parquet files under a path, sorted. ValueError for a blank path, FileNotFoundError if there is none."""
    if not path or not path.strip():
        raise ValueError("blank path")
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(paths.hadoop_path(path)).select("path")
        found = sorted(r["path"] for r in files.collect())
    except PySparkException as e:
        raise FileNotFoundError(path) from e
    if not found:
        raise FileNotFoundError(path)
    return found


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length): from the listing; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(paths.hadoop_path(path)).select("path", "length")


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """Column names from the footer."""
    return spark.read.parquet(paths.hadoop_path(path)).columns


def footers(spark: SparkSession, files: list[str], at_once: int = 16) -> dict[str, list[tuple[str, str]] | Exception]:
    """Names and types of every file's columns, or why its footer can't be read. Only footers are read, some at a time."""

    def one(path: str) -> list[tuple[str, str]] | Exception:
        try:
            return spark.read.parquet(paths.hadoop_path(path)).dtypes if path else ValueError("blank path")
        except Exception as e:  # noqa: BLE001  a file's error is its own
            return e

    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip(files, pool.map(one, files), strict=True))


def is_valid(spark: SparkSession, path: str) -> bool:
    try:
        columns_of(spark, path)
    except Exception:  # noqa: BLE001  whatever the reader says, the file can't be read
        return False
    return True


def consistent(spark: SparkSession, files: list[str], sample: int = 2) -> tuple[bool, str | None]:
    """Whether the first files all have a pickup time and a pickup place."""
    for f in files[:sample]:
        columns = columns_of(spark, f)
        if not roles.pickup_datetime(columns):
            return False, f"{f}: no pickup time among {columns}"
        if not roles.pickup_location(columns) and not roles.pickup_lon_lat(columns):
            return False, f"{f}: no pickup place among {columns}"
    return True, None


def read_trips(spark: SparkSession, files: list[str]) -> DataFrame:
    """ts, place, path of every trip: a scan for each family of schemas, of two or three columns each, united.

    Files of a family agree in names and types, as the types of one column differ between years. Times that can't be
    read are null; null places are 'unknown'.
    """
    from tidemark.functions.scalars import lonlat_key

    families: dict[tuple[tuple[str, str], ...], list[str]] = {}
    for f, found in footers(spark, files).items():
        if isinstance(found, Exception):
            raise found
        families.setdefault(tuple(found), []).append(paths.hadoop_path(f))
    out = None
    for types, own in families.items():
        columns = [c for c, _ in types]
        time, place, lonlat = roles.pickup_datetime(columns), roles.pickup_location(columns), roles.pickup_lon_lat(columns)
        if not time or not (place or lonlat):
            raise KeyError(f"no pickup time or place among {columns}")
        df = spark.read.parquet(*own)
        if place:
            numeric = dict(df.dtypes)[place] in ("double", "float")
            key = F.col(f"`{place}`").cast("bigint").cast("string") if numeric else F.col(f"`{place}`").cast("string")
        else:
            lon, lat = (F.col(f"`{c}`").cast("double") for c in lonlat)
            key = F.when(lon.isNotNull() & lat.isNotNull(), lonlat_key(lon, lat))
        moment = F.col(f"`{time}`")
        ts = F.try_to_timestamp(moment).cast("timestamp_ntz") if dict(df.dtypes)[time] == "string" else moment.cast("timestamp_ntz")
        part = df.select(ts.alias("ts"), F.coalesce(key, F.lit("unknown")).alias("place"), F.col("_metadata.file_path").alias("path"))
        out = part if out is None else out.unionByName(part)
    return out


def file_catalog(spark: SparkSession, files: list[str]) -> DataFrame:
    """path, taxi_type, year, month, older."""
    df = spark.createDataFrame([(f,) for f in files], "path string")
    year, month = paths.year_month(F.col("path"))
    return df.select("path", paths.taxi_type(F.col("path")).alias("taxi_type"), year.alias("year"), month.alias("month"), paths.looks_older(F.col("path")).alias("older"))


def trip_files(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("yellow", "green")) -> dict[str, list[str]]:
    """Files by kind, sorted; others are left out. A single file of no known kind counts as the first kind."""
    if path.rstrip("/").endswith(".parquet"):
        own = file_catalog(spark, [path]).first()["taxi_type"]
        own = kinds[0] if own == "unknown" else own
        return {k: [path] if k == own else [] for k in kinds}
    out: dict[str, list[str]] = {k: [] for k in kinds}
    for r in file_catalog(spark, discover(spark, path)).collect():
        if r["taxi_type"] in out:
            out[r["taxi_type"]].append(r["path"])
    return {k: sorted(v) for k, v in out.items()}


def first_file(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """The first file in a folder by path (of those whose path names the kind, if given), or the file itself. Which credentials
    are tried is the session's setting (`paths.storage_options`)."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(paths.hadoop_path(path))
    found = [f for f in discover(spark, path) if kind is None or kind.lower() in f.lower()]
    if not found:
        raise FileNotFoundError(f"{path}: no file names {kind!r}")
    return spark.read.parquet(paths.hadoop_path(found[0]))


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """pickup_place, lat, lon from csv, tsv or Parquet; rows without coordinates are left out."""
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = spark.read.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").csv(path)
    zone, lat, lon = roles.zone_columns(df.columns)
    if not (zone and lat and lon):
        raise KeyError(f"no id, lat and lon among {df.columns}")
    return df.select(F.col(zone).cast("string").alias("pickup_place"), F.col(lat).try_cast("double").alias("lat"), F.col(lon).try_cast("double").alias("lon")).dropna(subset=["lat", "lon"])


def ring_centroid(ring: str) -> F.Column:
    """Shoelace centroid of a closed ring (array of struct x, y), as struct x, y."""
    pts = F.col(ring)
    nxt = lambda i: F.get(pts, i + 1)
    total = lambda f: F.aggregate(F.transform(F.slice(pts, 1, F.size(pts) - 1), f), F.lit(0.0), lambda a, v: a + v)
    cross = lambda p, i: p["x"] * nxt(i)["y"] - nxt(i)["x"] * p["y"]
    area = total(lambda p, i: cross(p, i)) / 2
    return F.struct((total(lambda p, i: (p["x"] + nxt(i)["x"]) * cross(p, i)) / (6 * area)).alias("x"), (total(lambda p, i: (p["y"] + nxt(i)["y"]) * cross(p, i)) / (6 * area)).alias("y"))


def write_model(spark: SparkSession, path: str, components, variances) -> None:
    """A fitted basis as two small Parquet tables."""
    rows = [(k + 1, h, float(components[h][k])) for k in range(len(variances)) for h in range(len(components))]
    spark.createDataFrame(rows, "pc int, hour int, loading double").coalesce(1).write.mode("overwrite").parquet(f"{path}/loadings")
    spark.createDataFrame([(k + 1, float(v)) for k, v in enumerate(variances)], "pc int, eigenvalue double").coalesce(1).write.mode("overwrite").parquet(f"{path}/eigenvalues")


def read_model(spark: SparkSession, path: str, features: int = 24):
    """(loadings, eigenvalues); ValueError unless it is features x features."""
    loadings, values = spark.read.parquet(f"{path}/loadings"), spark.read.parquet(f"{path}/eigenvalues")
    if loadings.count() != features * features or values.count() != features:
        raise ValueError(f"not a {features} x {features} model")
    return loadings, values
