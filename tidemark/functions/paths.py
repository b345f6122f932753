"""What a file's path says: scheme, taxi type, month, age."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of path names, first match wins.
TYPE_PATTERNS = (("yellow", r"(?i)yellow[\W_]trip"), ("green", r"(?i)green[\W_]trip"), ("fhvhv", r"(?i)fhvhv[\W_]trip|high_volume_for_hire"), ("fhv", r"(?i)fhv[\W_]trip|for_hire_vehicle"))
MONTH_PATTERN = r"year[=_]?(\d{4})[/_]?month[=_]?(\d{1,2})|(\d{4})[-_](\d{1,2})(?:[-_.]|\.parquet)"
FILE_MONTH_PATTERN = r"(\d{4})-(\d{2})"
OLDER = ("2009", "2010", "2011", "2012", "2013", "2014")
# Hadoop's and the SDK's providers of credentials.
ANONYMOUS = "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"
SIGNED = ("org.apache.hadoop.fs.s3a.TemporaryAWSCredentialsProvider", "org.apache.hadoop.fs.s3a.SimpleAWSCredentialsProvider", "software.amazon.awssdk.auth.credentials.EnvironmentVariableCredentialsProvider", "org.apache.hadoop.fs.s3a.auth.IAMInstanceCredentialsProvider")


def is_object_path(path: object) -> bool:
    return isinstance(path, str) and path.lower().startswith(("s3://", "s3a://"))


def bucket_and_key(path: str) -> tuple[str, str]:
    if not is_object_path(path):
        raise ValueError(f"not an object store path: {path!r}")
    bucket, _, key = path.partition("://")[2].partition("/")
    if not bucket:
        raise ValueError(f"no bucket in {path!r}")
    return bucket, key


def hadoop_path(path: str) -> str:
    return "s3a://" + path.partition("://")[2] if is_object_path(path) else path


def storage_options(anonymous: bool = True) -> dict[str, str]:
    """Spark configuration for object stores: no credentials, or the first that is found (a session's, a key, the
    environment's, the instance's), and none where none is found."""
    chain = [ANONYMOUS] if anonymous else [*SIGNED, ANONYMOUS]
    return {"spark.hadoop.fs.s3a.aws.credentials.provider": ",".join(chain)}


def taxi_type(path: Column) -> Column:
    """yellow, green, fhvhv or fhv; unknown otherwise."""
    out = F.lit("unknown")
    for name, pattern in reversed(TYPE_PATTERNS):
        out = F.when(path.rlike(pattern), name).otherwise(out)
    return out


def year_month(path: Column) -> tuple[Column, Column]:
    """Year and month of the first match; null where it isn't in 2000..2100, 1..12."""
    group = lambda i: F.regexp_extract(path, MONTH_PATTERN, i)
    number = lambda a, b: F.when(group(a) != "", group(a)).otherwise(group(b)).try_cast("int")
    year, month = number(1, 3), number(2, 4)
    good = year.between(2000, 2100) & month.between(1, 12)
    return F.when(good, year), F.when(good, month)


def file_month(path: Column) -> tuple[Column, Column]:
    """Year and month by the file's name alone, as 2009-01 in it says; 0 and 0 where it says none. No range is checked."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    number = lambda i: F.coalesce(F.regexp_extract(name, FILE_MONTH_PATTERN, i).try_cast("int"), F.lit(0))
    return number(1), number(2)


def plain(path: Column) -> Column:
    """The path that a file's URI (as in _metadata.file_path) stands for."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def looks_older(path: Column) -> Column:
    return F.coalesce(path, F.lit("")).rlike("|".join(OLDER))
