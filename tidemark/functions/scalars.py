"""Small scalar pieces: sizes, place keys, hash draws."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB")


def parse_size(text: str) -> int:
    """'200MB' to bytes, base 1024; ValueError for negatives and unknown units."""
    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]*)?)\s*([A-Za-z]*)\s*", text)
    unit = m and (m[2].upper() or "B")
    if not m or unit not in UNITS:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * 1024 ** UNITS.index(unit))


def human_size(n: int) -> str:
    x, unit = float(n), 0
    while x >= 1024 and unit + 1 < len(UNITS):
        x, unit = x / 1024, unit + 1
    return f"{x:.1f}{UNITS[unit]}"


def lonlat_key(lon: Column, lat: Column) -> Column:
    """'lon_lat' with three decimals, null if either is. Ties go to even after scaling in doubles, as in pandas and DuckDB;
    Spark's bround would round the shortest decimal instead."""
    parts = [F.format_string("%.3f", F.when(c.isNotNull(), F.rint(c.cast("double") * 1000) / 1000)) for c in (lon, lat)]
    return F.when(lon.isNotNull() & lat.isNotNull(), F.concat_ws("_", *parts))


def draw(*parts) -> Column:
    """Eight hex digits that depend on the parts alone: a uniform draw that any engine can repeat. Compare it with `share`."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.substring(F.md5(text), 1, 8)


def share(p: float) -> str:
    """The hex digits below which a draw falls with probability p."""
    return f"{min(round(p * 2**32), 2**32 - 1):08x}"


def draw_int(*parts) -> Column:
    return F.conv(draw(*parts), 16, 10).cast("bigint")


#: P(Poisson(1) <= k) for k = 0..8.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975, 0.99999887)


def poisson(*parts) -> Column:
    """A Poisson(1) weight: bootstrap replicates of tables too large to gather from. Totals vary from replicate to replicate."""
    u, out = draw(*parts), F.lit(len(POISSON))
    for k in reversed(range(len(POISSON))):
        out = F.when(u < share(POISSON[k]), k).otherwise(out)
    return out


def angle_degrees(cosine: Column) -> Column:
    return F.degrees(F.acos(F.least(F.lit(1.0), F.abs(cosine))))


def normal_pdf(x: Column, mean: Column, sd: Column) -> Column:
    z = (x - mean) / sd
    return F.exp(-z * z / 2) / (sd * 2.5066282746310002)
