"""Every query by name, and its SQL where SQL can say it. Roles: events are trips (event_type, ts, user_id); order lines are fares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import paths, roles, scalars
from tidemark.operators import additive, classify, features, linalg, quality, resample, tails, wide, zones
from tidemark.operators.quantiles import quantiles
from tidemark.operators.wide import HOURS
from tidemark.sources import files as sources
from tidemark.sources.sinks import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- inputs ---------------------------------------------------------------------------------------------------------

G3, G2, G1 = ["taxi_type", "date", "pickup_place"], ["taxi_type", "pickup_place"], ["taxi_type", "date"]
COST = ["l_extendedprice", "discount_cost", "tax_cost"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def trips(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("taxi_type"), F.to_date("ts").alias("date"), F.col("user_id").cast("string").alias("pickup_place"), "ts", "event_id", "value")


def fares(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as trips with a fare. Both sides are large: Spark sorts and merges them on the order key."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    days = F.timestamp_diff("MICROSECOND", F.col("o_orderdate"), F.col("l_shipdate")) / 8.64e10
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return l.join(o, l.l_orderkey == o.o_orderkey).select(key.alias("id"), "l_quantity", days.alias("duration"), F.month("l_shipdate").alias("month"), F.weekday("l_shipdate").alias("weekday"), F.col("l_linenumber").alias("passengers"), "l_extendedprice", (F.col("l_extendedprice") * F.col("l_discount")).alias("discount_cost"), (F.col("l_extendedprice") * F.col("l_tax")).alias("tax_cost"))


def r6(c) -> F.Column:
    return F.round(c, 6)


def values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("value > 0").select("event_id", "value")


TRIPS = "with t as (select event_type as taxi_type, cast(ts as date) as date, cast(user_id as varchar) as pickup_place, ts, event_id, value from events) "
HOUR_SQL = ", ".join(f"count(*) filter (where hour(ts) = {h}) as hour_{h}" for h in range(24))
TOTAL_SQL = " + ".join(HOURS)
FARES = "with f as (select l_orderkey * 10 + l_linenumber as id, l_quantity, cast(date_diff('day', o_orderdate, l_shipdate) as double) as duration, month(l_shipdate) as month, isodow(l_shipdate) - 1 as weekday, l_linenumber as passengers, l_extendedprice, l_extendedprice * l_discount as discount_cost, l_extendedprice * l_tax as tax_cost from lineitem join orders on l_orderkey = o_orderkey) "
G2_SQL = TRIPS + f", w as (select taxi_type, pickup_place, {HOUR_SQL} from t group by all) "
U = lambda key, seed=42: f"substr(md5(concat_ws(':', {key}, '{seed}')), 1, 8)"

# --- wide tables ----------------------------------------------------------------------------------------------------


@query(TRIPS + f", w as (select taxi_type, date, pickup_place, {HOUR_SQL} from t group by all) select * from w where {TOTAL_SQL} >= 2")
def wide_g3(spark, d):
    return wide.cleaned(wide.wide(trips(spark, d), G3), 2)


@query(TRIPS + f", w as (select taxi_type, date, {HOUR_SQL} from t group by all) select * from w where {TOTAL_SQL} >= 50")
def wide_g1_min50(spark, d):
    return wide.cleaned(wide.wide(trips(spark, d), G1), 50)


@query(TRIPS + "select taxi_type, date, pickup_place, hour(ts) as hour, count(*) as count from t group by all")
def long_counts(spark, d):
    return wide.counts(trips(spark, d), G3)


@query(TRIPS + f"select taxi_type, pickup_place, {HOUR_SQL} from t group by all")
def wide_preagg(spark, d):
    return wide.pivoted(wide.counts(trips(spark, d), G2), G2)


@query(TRIPS + f"select taxi_type, date, {HOUR_SQL} from t group by all")
def wide_combine(spark, d):
    t = trips(spark, d)
    parts = [wide.wide(t.where(F.pmod("event_id", F.lit(2)) == k), G1) for k in (0, 1)]  # two halves, as two files
    return wide.combine(parts, G1)


@query(TRIPS + f", p as (select *, event_id % 2 as path from t), w as (select taxi_type, date, path, {HOUR_SQL} from p group by all), c as (select * from w where {TOTAL_SQL} >= 30) select taxi_type, date, " + ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in HOURS) + " from c group by all")
def wide_by_file(spark, d):
    return wide.by_file(trips(spark, d).withColumn("path", F.pmod("event_id", F.lit(2))), G1, 30)


@query(TRIPS + f", w as (select taxi_type, date, pickup_place, {HOUR_SQL} from t group by all), x as (select {TOTAL_SQL} as n from w) select count(*) as rows_before, count(*) filter (where n >= 2) as rows_after, count(*) filter (where n < 2) as rows_removed, cast(coalesce(sum(n) filter (where n < 2), 0) as bigint) as rides_dropped from x")
def cleanup_stats(spark, d):
    return wide.cleanup_stats(wide.wide(trips(spark, d), G3), 2)


@query(G2_SQL + "select taxi_type, pickup_place, " + ", ".join(f"round({c} / ({TOTAL_SQL}), 6) as {c}" for c in HOURS) + f" from w where {TOTAL_SQL} > 0")
def row_proportions(spark, d):
    return wide.proportions(wide.wide(trips(spark, d), G2)).select(*G2, *[r6(c).alias(c) for c in HOURS])


@query(TRIPS + "select taxi_type, pickup_place, h as hour, count(*) filter (where hour(ts) = h) as value from t, (select unnest(range(24)) as h) group by all")
def wide_unpivot(spark, d):
    return wide.unpivoted(wide.wide(trips(spark, d), G2), G2)


# --- accounting -----------------------------------------------------------------------------------------------------


@query(TRIPS + "select count(*) as input_rows, count(*) filter (where ts is null) as parse_failures, count(*) filter (where year(ts) <> 2024 or month(ts) <> 1 or day(ts) > 31) as month_mismatch, count(distinct case when year(ts) <> 2024 or month(ts) <> 1 then taxi_type end) as files_with_mismatch from t")
def run_counters(spark, d):
    return quality.counters(trips(spark, d).withColumn("path", F.col("taxi_type")), 2024, 1)


@query("select cast(count(*) filter (where year(l_shipdate) <> 1995 or month(l_shipdate) <> 6) as bigint) as month_mismatch from lineitem")
def month_mismatch(spark, d):
    return quality.counters(table(spark, d, "lineitem").select(F.col("l_shipdate").alias("ts"), F.lit("f").alias("path")), 1995, 6).select("month_mismatch")


@query(TRIPS + "select taxi_type as path, count(*) as input_rows, count(*) filter (where ts is null) as parse_failures from t group by all")
def file_records(spark, d):
    return quality.per_file(trips(spark, d).withColumn("path", F.col("taxi_type")))


@query(TRIPS + f", w as (select taxi_type, date, {HOUR_SQL} from t group by all) select year(date) as year, taxi_type, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from w group by all")
def type_year_breakdown(spark, d):
    return quality.breakdown(wide.wide(trips(spark, d), G1))


@query(TRIPS + f", w as (select taxi_type, date, pickup_place, {HOUR_SQL} from t group by all), s as (select (select count(*) from t where ts is null) as parse_failures, (select count(*) from w where {TOTAL_SQL} < 2) as rows_removed) select reason, n, round(coalesce(100.0 * n / nullif(sum(n) over (), 0), 0), 6) as percent from (select 'parse_failures' as reason, parse_failures as n from s union all select 'rows_removed', rows_removed from s)")
def discard_breakdown(spark, d):
    t = trips(spark, d)
    failed = t.agg(F.count_if(F.col("ts").isNull()).alias("parse_failures")).first()[0]
    stats = wide.cleanup_stats(wide.wide(t, G3), 2).select(F.lit(failed).cast("bigint").alias("parse_failures"), "rows_removed")
    return quality.discards(stats)


PATHS = ["s3://b/yellow_tripdata_2023-01.parquet", "s3://b/GREEN_tripdata_2023_02.parquet", "a/fhvhv_tripdata_2024-03.parquet", "a/fhv_tripdata_2012-13.parquet", "a/high_volume_for_hire/year=2021/month=7/x.parquet", "a/for_hire_vehicle-2019-11.parquet", "a/other_1999-01.parquet", "a/none.parquet", "a/yellow_tripdata_2023-03.parquet", "a/green_tripdata_2023-03.parquet"]
PATH_SQL = "with p as (select unnest(['" + "', '".join(PATHS) + "']) as path) "


def _paths(spark):
    return spark.createDataFrame([(p,) for p in PATHS], "path string")


TYPE_CASE = "case when regexp_matches(path, '(?i)yellow[\\W_]trip') then 'yellow' when regexp_matches(path, '(?i)green[\\W_]trip') then 'green' when regexp_matches(path, '(?i)fhvhv[\\W_]trip|high_volume_for_hire') then 'fhvhv' when regexp_matches(path, '(?i)fhv[\\W_]trip|for_hire_vehicle') then 'fhv' else 'unknown' end"
YM = r"""select path, case when y between 2000 and 2100 and m between 1 and 12 then y end as year, case when y between 2000 and 2100 and m between 1 and 12 then m end as month from (select path, try_cast(coalesce(nullif(regexp_extract(path, r, 1), ''), regexp_extract(path, r, 3)) as int) as y, try_cast(coalesce(nullif(regexp_extract(path, r, 2), ''), regexp_extract(path, r, 4)) as int) as m from (select path, 'year[=_]?(\d{4})[/_]?month[=_]?(\d{1,2})|(\d{4})[-_](\d{1,2})(?:[-_.]|\.parquet)' as r from p))"""
YM = YM.replace("(path, r,", r"(path, 'year[=_]?(\d{4})[/_]?month[=_]?(\d{1,2})|(\d{4})[-_](\d{1,2})(?:[-_.]|\.parquet)',")


@query(PATH_SQL + f"select path, {TYPE_CASE} as taxi_type from p")
def path_taxi_type(spark, d):
    return _paths(spark).select("path", paths.taxi_type(F.col("path")).alias("taxi_type"))


@query(PATH_SQL + YM)
def path_year_month(spark, d):
    y, m = paths.year_month(F.col("path"))
    return _paths(spark).select("path", y.alias("year"), m.alias("month"))


@query(PATH_SQL + r"select path, coalesce(try_cast(regexp_extract(split_part(path, '/', -1), '(\d{4})-(\d{2})', 1) as int), 0) as year, coalesce(try_cast(regexp_extract(split_part(path, '/', -1), '(\d{4})-(\d{2})', 2) as int), 0) as month from p")
def path_file_month(spark, d):
    y, m = paths.file_month(F.col("path"))
    return _paths(spark).select("path", y.alias("year"), m.alias("month"))


@query(PATH_SQL + "select path, regexp_matches(path, '2009|2010|2011|2012|2013|2014') as older from p")
def older_path_flag(spark, d):
    return _paths(spark).select("path", paths.looks_older(F.col("path")).alias("older"))


def _catalog_files(spark):
    y, m = paths.year_month(F.col("path"))
    return _paths(spark).select("path", paths.taxi_type(F.col("path")).alias("taxi_type"), y.alias("year"), m.alias("month"))


@query(PATH_SQL + f", q as ({YM}) select coalesce(year * 100 + month, 999999) as ym, count(*) as n, array_to_string(list(path order by path), ',') as files from q group by all")
def files_by_month(spark, d):
    return quality.by_month(_catalog_files(spark)).select("ym", "n", F.array_join("paths", ",").alias("files"))


@query(PATH_SQL + f", q as ({YM}), k as (select q.path, year, month, {TYPE_CASE.replace('path', 'q.path')} as t from q) select a.path as path_a, b.path as path_b from k a join k b on a.year = b.year and a.month = b.month and a.t = 'yellow' and b.t = 'green' order by a.year, a.month, 1, 2 limit 1")
def matched_month_pair(spark, d):
    return zones.matched_pair(_catalog_files(spark))


@query(PATH_SQL + f", q as ({YM}), k as (select q.path, year, {TYPE_CASE.replace('path', 'q.path')} as t from q) select a.path as path_a, b.path as path_b from k a, k b where a.t = 'fhv' and b.t = 'fhvhv' and a.year is not null and b.year is not null order by abs(a.year - b.year), 1, 2 limit 1")
def closest_year_pair(spark, d):
    return zones.matched_pair(_catalog_files(spark), "fhv", "fhvhv")


# --- projections and features ---------------------------------------------------------------------------------------


@query("select c_custkey, printf('%.3f', round_even(c_acctbal / 100, 3)) || '_' || printf('%.3f', round_even(c_acctbal / 50, 3)) as place from customer")
def lonlat_key(spark, d):
    return table(spark, d, "customer").select("c_custkey", scalars.lonlat_key(F.col("c_acctbal") / 100, F.col("c_acctbal") / 50).alias("place"))


PLACES = "case when c_custkey % 3 = 0 then '-73.5_' || c_nationkey || '.25' when c_custkey % 3 = 1 then cast(c_custkey as varchar) else 'unknown' end"


@query(f"with p as (select c_custkey, {PLACES} as place from customer) select c_custkey, cast(contains(place, '_') as int) as pickup_is_lonlat, case when contains(place, '_') then coalesce(try_cast(split_part(place, '_', 1) as double), 0) else 0 end as pickup_lon, coalesce(try_cast(nullif(split_part(place, '_', 2), '') as double), 0) as pickup_lat, coalesce(try_cast(place as double), -1) as pickup_zone_id from p")
def place_parse(spark, d):
    k = F.col("c_custkey") % 3
    place = F.when(k == 0, F.concat(F.lit("-73.5_"), F.col("c_nationkey").cast("string"), F.lit(".25"))).when(k == 1, F.col("c_custkey").cast("string")).otherwise("unknown")
    return table(spark, d, "customer").select("c_custkey", place.alias("pickup_place")).withColumns(features.place_features()).drop("pickup_place")


@query("select event_id, try_cast(case when event_id % 10 = 0 then 'not a time' else strftime(ts, '%Y-%m-%d %H:%M:%S') end as timestamp) as ts from events where event_id % 10 <> 0")
def datetime_coerce(spark, d):
    text = F.when(F.col("event_id") % 10 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    parsed = table(spark, d, "events").select("event_id", text.try_cast("timestamp_ntz").alias("ts"))
    return parsed.dropna(subset=["ts"])


@query("select event_id, hour(ts) as hour, isodow(ts) - 1 as weekday, cast(isodow(ts) >= 6 as int) as is_weekend, month(ts) as month, year(ts) as year from events")
def trip_features(spark, d):
    return table(spark, d, "events").select("event_id", *[c.alias(n) for n, c in features.calendar("ts").items()])


@query(FARES + "select id, l_quantity, duration, month, weekday, passengers, l_extendedprice from f where l_quantity > 0 and duration > 0 and passengers > 0 and l_extendedprice > 0")
def trip_clean(spark, d):
    return fares(spark, d).select("id", "l_quantity", "duration", "month", "weekday", "passengers", "l_extendedprice").dropna().where("l_quantity > 0 and duration > 0 and passengers > 0 and l_extendedprice > 0")


@query(FARES + ", g as (select * from f where duration > 0), q as (select quantile_cont(l_quantity, 0.99) as a, quantile_cont(duration, 0.99) as b, quantile_cont(l_extendedprice, 0.99) as c from g) select id, least(l_quantity, a) as l_quantity, least(duration, b) as duration, round(least(l_extendedprice, c), 6) as l_extendedprice, duration > b as duration_capped from g, q")
def p99_caps(spark, d):
    joined = kept(fares(spark, d).where("duration > 0").select("id", "l_quantity", "duration", "l_extendedprice"), "fares")  # three passes, one join
    g = features.capped(joined, ["l_quantity", "duration", "l_extendedprice"])
    return g.select("id", "l_quantity", "duration", r6("l_extendedprice").alias("l_extendedprice"), "duration_capped")


@query(FARES + "select count(l_extendedprice) as n, round(avg(l_extendedprice), 6) as mean, round(stddev_samp(l_extendedprice), 6) as std, min(l_extendedprice) as min, round(quantile_cont(l_extendedprice, 0.25), 6) as q25, round(quantile_cont(l_extendedprice, 0.5), 6) as q50, round(quantile_cont(l_extendedprice, 0.75), 6) as q75, max(l_extendedprice) as max from f")
def describe_features(spark, d):
    c, rows = "l_extendedprice", table(spark, d, "lineitem")
    q = quantiles(rows, [c], [0.25, 0.5, 0.75])[c]
    return rows.agg(F.count(c).alias("n"), r6(F.avg(c)).alias("mean"), r6(F.stddev_samp(c)).alias("std"), F.min(c).alias("min"), *[r6(F.lit(v).cast("double")).alias(n) for v, n in zip(q, ("q25", "q50", "q75"), strict=True)], F.max(c).alias("max"))


@query(f"select event_id from events order by {U('event_id')}, event_id limit 500")
def hash_sample_n(spark, d):
    return features.sample_n(table(spark, d, "events").select("event_id"), "event_id", 500)


@query(f"select event_id, event_type from events qualify row_number() over (partition by event_type order by {U('event_id')}, event_id) <= 100")
def per_class_cap(spark, d):
    return features.cap_per_class(table(spark, d, "events").select("event_id", "event_type"), "event_id", "event_type", 100)


@query(f"select event_id, case when {U('event_id')} < '{scalars.share(0.8)}' then 'train' else 'test' end as part from events")
def hash_split(spark, d):
    return features.split(table(spark, d, "events").select("event_id"), "event_id")


@query(f"select event_id, event_type, case when row_number() over (partition by event_type order by {U('event_id')}, event_id) <= floor(count(*) over (partition by event_type) * 0.8) then 'train' else 'test' end as part from events")
def stratified_split(spark, d):
    return features.stratified_split(table(spark, d, "events").select("event_id", "event_type"), "event_id", "event_type")


@query("select event_type as value, cast(row_number() over (order by event_type) - 1 as int) as code from (select distinct event_type from events)")
def label_encode(spark, d):
    return features.label_codes(table(spark, d, "events"), "event_type")


@query("with m as (select *, case when event_id % 7 = 0 then null else value end as v from events) select event_id, round(coalesce(v, a) - a, 6) as v from m, (select avg(v) as a from m)")
def impute_center(spark, d):
    v = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return features.centred(table(spark, d, "events").select("event_id", v.alias("v")), ["v"]).select("event_id", r6("v").alias("v"))


@query("select event_id, event_type from events where event_type in (select event_type from events group by 1 order by 1 limit 2) and value > 0")
def isin_range_filter(spark, d):
    kinds = [r[0] for r in table(spark, d, "events").select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    return table(spark, d, "events").where(F.col("event_type").isin(kinds) & (F.col("value") > 0)).select("event_id", "event_type")


@query("select l_orderkey, l_linenumber, round(degrees(acos(least(1, abs(l_discount)))), 6) as angle, round(ln(l_extendedprice), 6) as log_price, greatest(l_discount - 0.05, 0) as clipped from lineitem")
def math_expressions(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(scalars.angle_degrees(F.col("l_discount"))).alias("angle"), r6(F.ln("l_extendedprice")).alias("log_price"), F.greatest(F.col("l_discount") - 0.05, F.lit(0)).alias("clipped"))


# --- components -----------------------------------------------------------------------------------------------------


@query(G2_SQL + "select " + ", ".join(f"round(avg({c}), 6) as {c}" for c in HOURS) + " from w")
def column_means(spark, d):
    return wide.wide(trips(spark, d), G2).agg(*[r6(F.avg(c)).alias(c) for c in HOURS])


@query(G2_SQL + " union all ".join(f"select {i} as i, {j} as j, round(covar_pop(hour_{i}, hour_{j}), 6) as value from w" for i in range(24) for j in range(i, 24)))
def covariance_long(spark, d):
    return linalg.covariance_long(wide.wide(trips(spark, d), G2), HOURS).select("i", "j", r6("value").alias("value"))


@query(G2_SQL + "select round(" + " + ".join(f"var_pop({c})" for c in HOURS) + ", 6) as trace, 24 as n from w")
def trace_check(spark, d):
    _, v, _ = linalg.fit(wide.wide(trips(spark, d), G2), HOURS)
    return spark.createDataFrame([(round(float(v.sum()), 6), len(v))], "trace double, n int")


@query()
def pca_model(spark, d):
    c, v, _ = linalg.fit(wide.wide(trips(spark, d), G2), HOURS)
    return linalg.spectrum(linalg.model_tables(spark, c, v)[1])


@query()
def pca_loading_stats(spark, d):
    c, v, _ = linalg.fit(wide.wide(trips(spark, d), G2), HOURS)
    return linalg.loading_stats(linalg.model_tables(spark, c, v)[0])


@query()
def pca_scores(spark, d):
    return zones.scores(wide.wide(trips(spark, d), G2))


#: Published eigenvalues stand in for a spectrum where SQL is to check what is read off it.
SPECTRUM = "with e as (select row_number() over (order by n_nationkey desc) as pc, cast(power(1.5, n_nationkey) as double) as eigenvalue from nation) "


def _spectrum(spark, d):
    w = Window.orderBy(F.desc("n_nationkey"))
    return table(spark, d, "nation").select(F.row_number().over(w).alias("pc"), F.pow(F.lit(1.5), "n_nationkey").alias("eigenvalue"))


@query(SPECTRUM + "select pc, round(eigenvalue / sum(eigenvalue) over (), 6) as ratio, round(sum(eigenvalue) over (order by pc) / sum(eigenvalue) over (), 6) as cumulative, round(eigenvalue - lead(eigenvalue) over (order by pc), 6) as gap, round((eigenvalue - lead(eigenvalue) over (order by pc)) / eigenvalue, 6) as relative_gap, case when pc <= 5 then round(1 / (eigenvalue - lead(eigenvalue) over (order by pc)), 9) end as sensitivity from e")
def eigenvalue_gaps(spark, d):
    return linalg.spectrum(_spectrum(spark, d)).select("pc", r6("ratio").alias("ratio"), r6("cumulative").alias("cumulative"), r6("gap").alias("gap"), r6("relative_gap").alias("relative_gap"), F.round("sensitivity", 9).alias("sensitivity"))


@query(SPECTRUM + ", s as (select pc, eigenvalue / sum(eigenvalue) over () as r, sum(1.0 / pc) over (order by pc desc) / count(*) over () as b from e) select pc, round(b, 6) as broken_stick, r > b as significant from s")
def broken_stick(spark, d):
    return linalg.spectrum(_spectrum(spark, d)).select("pc", r6("broken_stick").alias("broken_stick"), "significant")


# --- tails ----------------------------------------------------------------------------------------------------------

VALUES = "with v as (select event_id, value from events where value > 0) "


@query(VALUES + "select event_id as key, value as x, round((count(*) over () - row_number() over (order by value, event_id) + 1) / count(*) over (), 9) as p from v")
def survival_ge(spark, d):
    return tails.survival(values(spark, d), "value", "event_id").select("key", "x", F.round("p", 9).alias("p"))


@query(VALUES + ", q as (select quantile_cont(value, 0.9) as q from v), t as (select value, event_id from v, q where value >= q), s as (select ln(value) as lx, ln((count(*) over () - row_number() over (order by value, event_id) + 1) / count(*) over ()) as lp from t) select count(*) as n_tail, round(-regr_slope(lp, lx), 6) as alpha, round(regr_r2(lp, lx), 6) as r2 from s")
def tail_alpha(spark, d):
    return tails.tail_alpha(values(spark, d), "value", "event_id").select("n_tail", r6("alpha").alias("alpha"), r6("r2").alias("r2"))


HILL = VALUES + ", r as (select row_number() over (order by value desc, event_id) as k, ln(value) as l from v), h as (select k, avg(l) over (order by k) - lead(l) over (order by k) as m from r), c as (select k, 1 / nullif(m, 0) as alpha from h where k between 10 and 200) "


@query(HILL + "select k, round(alpha, 6) as alpha from c")
def hill_estimator(spark, d):
    return tails.hill(values(spark, d), "value", "event_id").select("k", r6("alpha").alias("alpha"))


@query(HILL + ", i as (select *, row_number() over (order by k) - 1 as i, count(*) over () as n from c), m as (select alpha from i where i >= n // 4 and i < 3 * n // 4) select round(quantile_cont(alpha, 0.5), 6) as median, round(quantile_cont(alpha, 0.25), 6) as q25, round(quantile_cont(alpha, 0.75), 6) as q75 from m")
def hill_plateau(spark, d):
    return tails.hill_plateau(tails.hill(values(spark, d), "value", "event_id")).select(*[r6(c).alias(c) for c in ("median", "q25", "q75")])


MOMENTS = "m as (select count(value) as n, avg(value) as mu, stddev_pop(value) as sd, min(value) as lo, max(value) as hi, quantile_cont(value, 0.5) as md from events)"


@query(f"with {MOMENTS} select n, round(mu, 6) as mean, round(sd, 6) as std, lo as min, hi as max, round(md, 6) as median, (select round(avg(power((value - mu) / sd, 3)), 6) from events) as skew, (select round(avg(power((value - mu) / sd, 4)) - 3, 6) from events) as excess_kurtosis from m")
def moment_stats(spark, d):
    s = tails.describe(table(spark, d, "events"), "value")
    return s.select("n", r6("mean").alias("mean"), r6("std").alias("std"), "min", "max", r6("median").alias("median"), r6("skew").alias("skew"), r6("excess_kurtosis").alias("excess_kurtosis"))


@query("select event_type, " + ", ".join(f"round({e}, 6) as {n}" for e, n in (("avg(value)", "mean"), ("stddev_pop(value)", "std"), ("min(value)", "min"), ("max(value)", "max"), *((f"quantile_cont(value, {p})", n) for p, n in ((0.05, "p5"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95"), (0.025, "ci_lower"), (0.975, "ci_upper"))))) + " from events group by 1")
def metric_summary(spark, d):
    s = tails.summary(table(spark, d, "events"), "value", ["event_type"])
    return s.select("event_type", *[r6(c).alias(c) for c in s.columns[1:]])


@query("with m as (select min(value) as lo, max(value) as hi, count(value) as c from events) select least(cast(floor((value - lo) / ((hi - lo) / 50)) as bigint), 49) as bin, count(*) as n, round(count(*) / (any_value(c) * (any_value(hi) - any_value(lo)) / 50), 9) as density from events, m where value is not null group by 1")
def histogram_density(spark, d):
    return tails.histogram(table(spark, d, "events"), "value").select("bin", "n", F.round("density", 9).alias("density"))


@query("select event_type, count(value) as n, round(quantile_cont(value, 0.25), 6) as q1, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.75), 6) as q3 from events group by 1")
def boxplot_stats(spark, d):
    return tails.boxplot(table(spark, d, "events"), "value", "event_type").select("event_type", "n", *[r6(c).alias(c) for c in ("q1", "median", "q3")])


@query("with m as (select avg(value) as mu, stddev_pop(value) as sd from events) select x, round(exp(-power((x - mu) / sd, 2) / 2) / (sd * 2.5066282746310002), 9) as pdf from m, (select unnest(range(0, 200, 2)) as x)")
def normal_pdf_overlay(spark, d):
    mu, sd = table(spark, d, "events").agg(F.avg("value"), F.stddev_pop("value")).first()
    return spark.range(0, 200, 2).select(F.col("id").alias("x"), F.round(scalars.normal_pdf(F.col("id"), F.lit(mu), F.lit(sd)), 9).alias("pdf"))


@query(VALUES + ", m as (select quantile_cont(value, 0.9) as lo, max(value) as hi from v), t as (select value, event_id from v, m where value >= lo), s as (select ln(value) as lx, ln((count(*) over () - row_number() over (order by value, event_id) + 1) / count(*) over ()) as lp from t), a as (select -regr_slope(lp, lx) as alpha from s) select i, round(lo * power(hi / lo, i / 99.0), 6) as x, round(0.1 * power(power(hi / lo, i / 99.0), -alpha), 9) as p from m, a, (select unnest(range(100)) as i)")
def power_law_curve(spark, d):
    fit = tails.tail_alpha(values(spark, d), "value", "event_id").first()
    lo, hi = quantiles(values(spark, d), ["value"], [0.9])["value"][0], values(spark, d).agg(F.max("value")).first()[0]
    steps = F.pow(F.lit(hi / lo), F.col("id") / 99)
    return spark.range(100).select(F.col("id").alias("i"), r6(lo * steps).alias("x"), F.round(0.1 * F.pow(steps, F.lit(-fit["alpha"])), 9).alias("p"))


@query()
def qq_points(spark, d):
    return tails.qq_points(table(spark, d, "events").select("event_id", "value"), "value", "event_id")


@query()
def qq_fit(spark, d):
    return tails.qq_fit(tails.qq_points(table(spark, d, "events").select("event_id", "value"), "value", "event_id"))


@query()
def shapiro_sampled(spark, d):
    """Of all events: a sample of 5000 where there are more, as the operator says."""
    return spark.createDataFrame([tails.shapiro_of(table(spark, d, "events"), "value", "event_id")], "w double, p double")


@query()
def shapiro_tail_report(spark, d):
    """Normality, exponent and class of the components' coefficients (24 x 24)."""
    c, _, _ = linalg.fit(wide.wide(trips(spark, d), G2), HOURS)
    return tails.tail_report(spark, c)


@query("select c_custkey, case when (c_custkey % 5) / 4.0 < 0.9 or c_acctbal <= 0 then 'light' when greatest(c_nationkey - 12, 0) > 0 or (c_custkey % 7) / 100.0 < 0.05 then 'heavy' else 'light' end as tail from customer")
def tail_classes(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("alpha"), ((F.col("c_custkey") % 5) / 4.0).alias("r2"), (F.col("c_nationkey") - 12).cast("double").alias("excess_kurtosis"), ((F.col("c_custkey") % 7) / 100.0).alias("shapiro_p"))
    return tails.tail_class(rows).select("c_custkey", "tail")


@query("select n_regionkey, round(avg(n_nationkey), 6) as mean, round(quantile_cont(n_nationkey, 0.5), 6) as p50, array_to_string(list(n_nationkey order by n_nationkey), ',') as listed from nation group by 1")
def metric_values(spark, d):
    s = tails.summary(table(spark, d, "nation"), "n_nationkey", ["n_regionkey"], listed=True)
    return s.select("n_regionkey", r6("mean").alias("mean"), r6("p50").alias("p50"), F.array_join(F.col("values").cast("array<string>"), ",").alias("listed"))


# --- places ---------------------------------------------------------------------------------------------------------


@query(G2_SQL + "select pickup_place, " + ", ".join(f"round(avg({c}), 6) as {c}" for c in HOURS) + " from w group by 1")
def zone_means(spark, d):
    m = zones.means(wide.wide(trips(spark, d), G2))
    return m.select("pickup_place", *[r6(c).alias(c) for c in HOURS])


ZONES = "z as (select cast(c_custkey as varchar) as pickup_place, 40 + c_nationkey / 100.0 as lat, -74 + c_nationkey / 50.0 as lon from customer)"


def _zones(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("pickup_place"), (40 + F.col("c_nationkey") / 100).alias("lat"), (-74 + F.col("c_nationkey") / 50).alias("lon"))


@query(TRIPS + f", {ZONES} select pickup_place, lat, lon, count(*) as rides from t join z using (pickup_place) group by all")
def zone_join(spark, d):
    rides = trips(spark, d).groupBy("pickup_place").agg(F.count("*").alias("rides"))
    return rides.join(_zones(spark, d), "pickup_place").select("pickup_place", "lat", "lon", "rides")


@query()
def zone_markers(spark, d):
    return zones.markers(zones.scores(wide.wide(trips(spark, d), G2)), _zones(spark, d))


# --- resampling -----------------------------------------------------------------------------------------------------

POISSON_SQL = "case " + " ".join(f"when u < '{scalars.share(p)}' then {k}" for k, p in enumerate(scalars.POISSON)) + f" else {len(scalars.POISSON)} end"


@query(f"with d as (select event_id, value, b, substr(md5(concat_ws(':', event_id, b, '42')), 1, 8) as u from events, (select unnest(range(100)) as b)), w as (select b, value, {POISSON_SQL} as w from d), m as (select b, sum(w * value) / sum(w) as m from w group by b) select count(*) as replicates, round(avg(m), 6) as mean, round(quantile_cont(m, 0.025), 6) as ci_lower, round(quantile_cont(m, 0.975), 6) as ci_upper from m")
def bootstrap_mean_ci(spark, d):
    ci = resample.mean_ci(table(spark, d, "events"), "event_id", "value")
    return ci.select("replicates", *[r6(c).alias(c) for c in ("mean", "ci_lower", "ci_upper")])


@query("with n as (select n_nationkey, row_number() over (order by n_nationkey) - 1 as i from nation), d as (select b, k, cast(('0x' || substr(md5(concat_ws(':', b, k, '42')), 1, 8)) as bigint) % 25 as i from (select unnest(range(20)) as b), (select unnest(range(25)) as k)) select b, n_nationkey as value, count(*) as n from d join n using (i) group by all")
def bootstrap_exact_draws(spark, d):
    rows = resample.drawn(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", "n_nationkey", 20)
    return rows.groupBy("b", "value").agg(F.count("*").alias("n"))


@query()
def bootstrap_pca_stability(spark, d):
    report, _ = resample.pca_stability(wide.wide(trips(spark, d), G2).withColumn("key", F.concat_ws("|", *G2)), HOURS, "key", 100)
    return spark.createDataFrame(report)


@query()
def bootstrap_bands(spark, d):
    _, comps = resample.pca_stability(wide.wide(trips(spark, d), G2).withColumn("key", F.concat_ws("|", *G2)), HOURS, "key", 100)
    long = spark.createDataFrame([(b, k + 1, h, float(c[h, k])) for b, c in enumerate(comps) for k in range(c.shape[1]) for h in range(24)], "b int, pc int, hour int, loading double")
    return long.groupBy("pc", "hour").agg(F.percentile("loading", 0.025).alias("lo"), F.percentile("loading", 0.5).alias("mid"), F.percentile("loading", 0.975).alias("hi"))


@query()
def stability_interpretation(spark, d):
    report, _ = resample.pca_stability(wide.wide(trips(spark, d), G2).withColumn("key", F.concat_ws("|", *G2)), HOURS, "key", 100)
    return spark.createDataFrame(resample.interpretation_texts(report), "metric string, rating string, mean double, std double, ci_lower double, ci_upper double, text string")


# --- additive models ------------------------------------------------------------------------------------------------

TERMS = [additive.Term("l_quantity", 20), additive.Term("duration", 20), additive.Term("month", 12), additive.Term("weekday", 7), additive.Term("passengers", linear=True)]


def _clean(spark, d):
    """The joined fares, saved: models read them several times."""
    return kept(features.split(fares(spark, d).where("duration > 0"), "id"), "clean-fares")


@query()
def gam_fit_metrics(spark, d):
    rows = _clean(spark, d)
    model = additive.fit(rows.where("part = 'train'"), TERMS, "l_extendedprice")
    return additive.regression_metrics(additive.predict(rows.where("part = 'test'"), model), "l_extendedprice", "prediction").withColumn("lam", F.lit(model.lam)).withColumn("edof", F.lit(model.edof))


def _two_models(spark, d) -> dict[str, DataFrame]:
    """Metrics of the plain model, and of one with two more smooths (25 knots)."""
    rows = _clean(spark, d).withColumn("from_place", F.pmod("id", F.lit(263)).cast("double")).withColumn("to_place", F.pmod(F.floor(F.col("id") / 10), F.lit(263)).cast("double"))
    more = [*TERMS, additive.Term("from_place", 25), additive.Term("to_place", 25)]
    out = {}
    for name, terms in (("plain", TERMS), ("enhanced", more)):
        model = additive.fit(rows.where("part = 'train'"), terms, "l_extendedprice")
        out[name] = additive.regression_metrics(additive.predict(rows.where("part = 'test'"), model), "l_extendedprice", "prediction")
    return out


@query()
def gam_enhanced(spark, d):
    plain, enhanced = (m.withColumn("model", F.lit(name)) for name, m in _two_models(spark, d).items())
    return plain.union(enhanced)


@query()
def gam_improvement(spark, d):
    plain, enhanced = (m.first().asDict() for m in _two_models(spark, d).values())
    return spark.createDataFrame(additive.improvement(plain, enhanced), "metric string, plain double, enhanced double, gain double, percent double")


@query()
def gam_partial_dependence(spark, d):
    return spark.createDataFrame(additive.partial_dependence(additive.fit(_clean(spark, d).where("part = 'train'"), TERMS, "l_extendedprice")))


@query()
def gam_bootstrap_ci(spark, d):
    return spark.createDataFrame(additive.bootstrap_bands(_clean(spark, d).where("part = 'train'"), TERMS, "l_extendedprice", "id", 50))


@query()
def cost_breakdown(spark, d):
    rows = _clean(spark, d)
    return spark.createDataFrame(additive.cost_breakdown(rows, additive.fit_many(rows, TERMS, COST), "l_quantity"))


PRED = "with p as (select l_orderkey, l_extendedprice as y, l_quantity * 1500.0 as p, cast(l_returnflag = 'R' as int) as label, cast(l_quantity > 25 as int) as prediction, l_orderkey * 10 + l_linenumber as id from lineitem) "


def _rule(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_quantity") > 25).cast("int").alias("prediction"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))


@query(PRED + "select round(sqrt(avg(power(y - p, 2))), 4) as rmse, round(avg(abs(y - p)), 4) as mae, round(1 - sum(power(y - p, 2)) / (count(y) * var_pop(y)), 6) as r2 from p")
def regression_metrics(spark, d):
    return additive.regression_metrics(_rule(spark, d), "y", "p").select(F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), r6("r2").alias("r2"))


# --- classification -------------------------------------------------------------------------------------------------


@query(PRED + "select label, prediction, count(*) as n from p group by all")
def confusion_matrix(spark, d):
    return classify.confusion(_rule(spark, d))


REPORT = ", s as (select k as label, count(*) filter (where label = k) as support, count(*) filter (where prediction = k) as said, count(*) filter (where label = k and prediction = k) as hit from p, (select unnest([0, 1]) as k) group by k), r as (select label, support, hit / said as precision, hit / support as recall, 2.0 * hit / (said + support) as f1 from s) "


@query(PRED + REPORT + "select label, support, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from r")
def classification_report(spark, d):
    return classify.class_report(_rule(spark, d)).select("label", "support", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query(PRED + REPORT + "select round(sum(recall * support) / sum(support), 6) as accuracy, round(sum(f1 * support) / sum(support), 6) as f1 from r")
def weighted_scores(spark, d):
    return classify.overall(_rule(spark, d), average="weighted").select(r6("accuracy").alias("accuracy"), r6("f1").alias("f1"))


@query(PRED + f", d as (select label, prediction, b, substr(md5(concat_ws(':', id, b, '42')), 1, 8) as u from p, (select unnest(range(20)) as b)), w as (select b, label, prediction, {POISSON_SQL} as w from d), s as (select b, k, sum(w) filter (where label = k) as support, sum(w) filter (where prediction = k) as said, sum(w) filter (where label = k and prediction = k) as hit from w, (select unnest([0, 1]) as k) group by b, k) select b, round(sum(hit) / sum(support), 6) as accuracy, round(avg(2.0 * hit / (said + support)), 6) as f1 from s group by b")
def bootstrap_metrics(spark, d):
    return classify.bootstrap_metrics(_rule(spark, d), "id", 20).select("b", r6("accuracy").alias("accuracy"), r6("f1").alias("f1"))


@query(PRED + ", q as (select *, least(1, l / 50) as pr from (select label, prediction, p / 75000 * 50 as l from p)) select label = prediction as correct, count(*) as n, round(avg(greatest(pr, 1 - pr)), 6) as mean, round(quantile_cont(greatest(pr, 1 - pr), 0.5), 6) as median, round(min(greatest(pr, 1 - pr)), 6) as min, round(max(greatest(pr, 1 - pr)), 6) as max from q group by 1")
def confidence_stats(spark, d):
    rows = _rule(spark, d).withColumn("p", F.least(F.lit(1.0), F.col("p") / 75000))
    return classify.confidence_stats(rows).select("correct", "n", *[r6(c).alias(c) for c in ("mean", "median", "min", "max")])


def _labelled(spark, d):
    kinds = [r[0] for r in table(spark, d, "events").select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    rows = table(spark, d, "events").where(F.col("event_type").isin(kinds)).select("event_id", (F.col("event_type") == kinds[-1]).cast("double").alias("label"), "value", *[c.alias(n) for n, c in features.calendar("ts").items()])
    return features.stratified_split(rows, "event_id", "label")


TRIP_FEATURES = ["value", "hour", "weekday", "is_weekend"]


@query()
def gbt_report(spark, d):
    rows = _labelled(spark, d).cache()
    return classify.class_report(classify.boosted(rows.where("part = 'train'"), rows.where("part = 'test'"), TRIP_FEATURES, depth=3, trees=3)[0])


@query()
def gbt_sweep(spark, d):
    rows = _labelled(spark, d).cache()
    return spark.createDataFrame(classify.sweep(rows.where("part = 'train'"), rows.where("part = 'test'"), TRIP_FEATURES), "depth int, rate double, accuracy double, f1 double")


@query()
def gbt_importance(spark, d):
    rows = _labelled(spark, d).cache()
    _, own = classify.boosted(rows.where("part = 'train'"), rows.where("part = 'test'"), TRIP_FEATURES, depth=3, trees=3)
    return spark.createDataFrame(classify.importances(own, TRIP_FEATURES), "feature string, importance double")


@query()
def bagged_confidence(spark, d):
    rows = _labelled(spark, d).cache()
    return classify.confidence_stats(classify.bagged(rows.where("part = 'train'"), rows.where("part = 'test'"), TRIP_FEATURES, "event_id"))


@query()
def latent_classifier(spark, d):
    """Hour profiles by PCA, with metadata features."""
    w = wide.proportions(wide.wide(trips(spark, d), G3))
    kinds = [r[0] for r in w.select("taxi_type").distinct().orderBy("taxi_type").limit(2).collect()]
    rows = w.where(F.col("taxi_type").isin(kinds)).withColumn("label", (F.col("taxi_type") == kinds[-1]).cast("double")).withColumn("key", F.concat_ws("|", *G3))
    rows = rows.withColumns({k: v for k, v in features.calendar("date").items() if k not in ("hour",)} | features.place_features())
    rows = features.stratified_split(rows, "key", "label").withColumns({c: F.col(c).cast("double") for c in HOURS}).cache()
    extra = ["year", "month", "weekday", "is_weekend", "pickup_is_lonlat", "pickup_lon", "pickup_lat", "pickup_zone_id"]
    model = classify.latent_booster(HOURS, extra, depth=3, trees=2).fit(rows.where("part = 'train'"))
    return classify.class_report(classify.scored(model, rows.where("part = 'test'")))


@query()
def embedding_spectrum(spark, d):
    rows = table(spark, d, "embeddings")
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    df = rows.select(*[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(width)])
    c, v, _ = linalg.fit(df, df.columns)
    return linalg.spectrum(linalg.model_tables(spark, c, v)[1])


@query("select event_type, time_bucket(interval '1 hour', ts) as hour_start, count(*) as count from events group by all")
def hourly_batch(spark, d):
    from tidemark.streaming.hourly import hourly_counts

    return hourly_counts(table(spark, d, "events"), ["event_type"]).withColumn("hour_start", F.col("hour_start").cast("timestamp_ntz"))


# --- resolvers, sizes, files: pieces of the runs, over fixed inputs ---------------------------------------------------

OBJECTS = [*PATHS, "S3A://Bucket/deep/key.parquet", "s3://only", "/local/s3://x", "http://s3/b"]


@query("with p as (select unnest(['" + "', '".join(OBJECTS) + "']) as path) select path, regexp_matches(path, '(?i)^s3a?://') as object, case when regexp_matches(path, '(?i)^s3a?://') then regexp_extract(path, '://([^/]*)', 1) end as bucket, case when regexp_matches(path, '(?i)^s3a?://') then regexp_extract(path, '://[^/]*/?(.*)$', 1) end as key from p")
def object_paths(spark, d):
    rows = [(p, paths.is_object_path(p), *(paths.bucket_and_key(p) if paths.is_object_path(p) else (None, None))) for p in OBJECTS]
    return spark.createDataFrame(rows, "path string, object boolean, bucket string, key string")


HEADERS = [["VendorID", "tpep_pickup_datetime", "PULocationID", "DOLocationID"], ["lpep_pickup_datetime", "PULocationID"], ["Pickup_DateTime ", "pickup_location_id"], ["Trip_Pickup_DateTime", "Start_Lon", "Start_Lat"], ["pickup_longitude", "pickup_latitude", "my_pickup_time"], ["DOLocationID", "some_other_col"]]


@query("select * from (values (0, 'tpep_pickup_datetime', 'PULocationID', null, null), (1, 'lpep_pickup_datetime', 'PULocationID', null, null), (2, 'Pickup_DateTime ', 'pickup_location_id', null, null), (3, 'Trip_Pickup_DateTime', null, 'Start_Lon', 'Start_Lat'), (4, 'my_pickup_time', null, 'pickup_longitude', 'pickup_latitude'), (5, null, null, null, null)) as v(i, time, place, lon, lat)")
def role_resolvers(spark, d):
    rows = [(i, roles.pickup_datetime(h), roles.pickup_location(h), *(roles.pickup_lon_lat(h) or (None, None))) for i, h in enumerate(HEADERS)]
    return spark.createDataFrame(rows, "i int, time string, place string, lon string, lat string")


@query("select * from (values ('canonical', 'pickup_datetime,dropoff_datetime,trip_distance,passenger_count,fare_amount,extra'), ('missing', 'dropoff_datetime,passenger_count'), ('repaired', 'taxi_type,date,pickup_place,hour_0'), ('typed', 'taxi_type,hour_0'), ('count', 'rides'), ('last number', 'b')) as v(what, names)")
def canonical_names(spark, d):
    empty = lambda *names: spark.createDataFrame([], ", ".join(f"`{n}` int" for n in names))
    full = roles.canonical_trips(empty("tpep_pickup_datetime", "TPEP_dropoff_datetime", "trip_miles", "passenger_count", "Fare_Amt", "Extra"))
    try:
        roles.canonical_trips(empty("pickup_datetime", "trip_distance", "fare_amount"))
        missing = ""
    except KeyError as e:
        missing = ",".join(x.strip(" '[]") for x in e.args[0].partition(": ")[2].split(","))
    rows = [("canonical", ",".join(full.columns)), ("missing", missing), ("repaired", ",".join(roles.repaired_keys(empty("__index_level_0__", "__index_level_1__", "__index_level_2__", "hour_0")).columns)), ("typed", ",".join(roles.repaired_keys(empty("cab_type", "hour_0")).columns)), ("count", roles.count_column(empty("a", "Rides", "b").withColumnRenamed("Rides", "rides"))), ("last number", roles.count_column(empty("a", "b").withColumn("c", F.lit("x"))))]
    return spark.createDataFrame(rows, "what string, names string")


@query("select n, cast(n as varchar) || u as text, cast(n * power(1024, k) as bigint) as bytes, case when n = 0 then '0.0B' when n < 1024 then printf('%.1f', n * 1.0) || u else printf('%.1f', n / 1024.0) || 'GB' end as human from (select unnest([0, 1, 200, 1536]) as n), (values ('B', 0), ('MB', 2)) as v(u, k) where not (n >= 1024 and k = 0)")
def size_texts(spark, d):
    rows = [(n, f"{n}{u}") for n in (0, 1, 200, 1536) for u in ("B", "MB") if not (n >= 1024 and u == "B")]
    out = [(n, t, scalars.parse_size(t), scalars.human_size(scalars.parse_size(t))) for n, t in rows]
    return spark.createDataFrame(out, "n int, text string, bytes long, human string")


@query("select l_orderkey, l_linenumber, round(date_diff('microsecond', o_orderdate, l_shipdate) / 6e7, 6) as minutes from lineitem join orders on l_orderkey = o_orderkey")
def duration_minutes(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", r6(features.minutes_between("o_orderdate", "l_shipdate")).alias("minutes"))


@query("select column_name as name from (describe events)")
def footer_columns(spark, d):
    return spark.createDataFrame([(c,) for c in sources.columns_of(spark, f"{d}/events.parquet")], "name string")


@query("select * from (values ('events', true, false, false), ('nation', true, false, false), ('no_such_table', false, null, null)) as v(name, valid, has_time, has_place)")
def file_checks(spark, d):
    rows = []
    for name in ("events", "nation", "no_such_table"):
        path = f"{d}/{name}.parquet"
        valid = sources.is_valid(spark, path)
        columns = sources.columns_of(spark, path) if valid else []
        rows.append((name, valid, bool(roles.pickup_datetime(columns)) if valid else None, sources.consistent(spark, [path])[0] if valid else None))
    return spark.createDataFrame(rows, "name string, valid boolean, has_time boolean, has_place boolean")


@query("select * from (values ('yellow', 1), ('green', 0)) as v(kind, files)")
def single_file_kind(spark, d):
    """A single file of no known kind counts as yellow."""
    return spark.createDataFrame([(k, len(v)) for k, v in sources.trip_files(spark, f"{d}/nation.parquet").items()], "kind string, files int")


@query("select n_nationkey, n_name from nation")
def first_file(spark, d):
    return sources.first_file(spark, f"{d}/nation.parquet").select("n_nationkey", "n_name")


@query(PATH_SQL + f", q as ({YM}) select coalesce(year * 100 + month, 999999) as ym, count(*) as n from q group by all order by ym limit 2")
def first_months(spark, d):
    return quality.by_month(_catalog_files(spark), 2).select("ym", "n")


@query("select event_id, event_type, value from events order by event_id limit 10")
def preview(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", "value").orderBy("event_id").limit(10)


BASIS = [[round(((7 * i + 3 * k) % 11 - 5) / 10, 3) for k in range(2)] for i in range(24)]


@query(G2_SQL + ", m as (select pickup_place, " + ", ".join(f"avg({c}) as {c}" for c in HOURS) + " from w group by 1), g as (select " + ", ".join(f"avg({c}) as g{i}" for i, c in enumerate(HOURS)) + " from w) select pickup_place, " + ", ".join("round(" + " + ".join(f"({c} - g{i}) * ({BASIS[i][k]})" for i, c in enumerate(HOURS)) + f", 6) as pc{k + 1}" for k in range(2)) + " from m, g")
def scores_of_basis(spark, d):
    """Projection on a given basis: a fitted one has no SQL."""
    import numpy as np

    w = wide.wide(trips(spark, d), G2)
    centre = w.agg(*[F.avg(c).alias(c) for c in HOURS]).first()
    return linalg.project(zones.means(w), HOURS, np.array(BASIS), np.array([centre[c] for c in HOURS]), 2).select("pickup_place", r6("pc1").alias("pc1"), r6("pc2").alias("pc2"))


@query("select n_nationkey as i, round((power(cos(n_nationkey / 10.0), 2) + 1) / 2, 6) as affinity, round(sqrt(greatest(0, 4 - 2 * (abs(cos(n_nationkey / 10.0)) + 1))), 6) as procrustes from nation")
def subspace_distances(spark, d):
    """Of the plane (x, y) and itself turned about y."""
    import numpy as np

    a, out = np.array([[1.0, 0], [0, 1], [0, 0]]), []
    for r in table(spark, d, "nation").select("n_nationkey").collect():  # 25 rows
        t = r[0] / 10
        b = np.array([[np.cos(t), 0], [0, 1], [np.sin(t), 0]])
        out.append((r[0], round(linalg.affinity(a, b), 6), round(linalg.procrustes(a, b), 6)))
    return spark.createDataFrame(out, "i int, affinity double, procrustes double")


LOADINGS = "with l as (select pc, hour, ((pc * 7 + hour * hour) % 13 - 6) / 10.0 as loading from (select unnest([1, 2, 3]) as pc), (select unnest(range(24)) as hour)), m as (select pc, avg(loading) as mu, stddev_pop(loading) as sd, max(abs(loading)) as top from l group by pc) "


@query(LOADINGS + "select l.pc, round(any_value(mu), 6) as mean, round(any_value(sd), 6) as std, round(avg(power((loading - mu) / sd, 3)), 6) as skew, round(avg(power((loading - mu) / sd, 4)) - 3, 6) as excess_kurtosis, min(hour) filter (where loading > 0.05 * top) as first_up, max(hour) filter (where loading > 0.05 * top) as last_up, min(hour) filter (where loading < -0.05 * top) as first_down, max(hour) filter (where loading < -0.05 * top) as last_down from l join m using (pc) group by l.pc")
def loading_stats_of_basis(spark, d):
    loadings = spark.range(24).select(F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("pc"), F.col("id").alias("hour")).withColumn("loading", (F.pmod(F.col("pc") * 7 + F.col("hour") * F.col("hour"), F.lit(13)) - 6) / 10)
    s = linalg.loading_stats(loadings)
    return s.select("pc", *[r6(c).alias(c) for c in ("mean", "std", "skew", "excess_kurtosis")], "first_up", "last_up", "first_down", "last_down")


@query("with s as (select cast(c_custkey as varchar) as pickup_place, 40 + c_nationkey / 100.0 as lat, -74 + c_nationkey / 50.0 as lon, c_acctbal / 1000 as pc1, c_custkey % 7 - 3.0 as pc2 from customer), t as (select max(abs(pc1)) as a, max(abs(pc2)) as b from s) select pickup_place, lat, lon, round(0.5 + pc1 / (2 * a), 6) as colour, round(3 + 9 * abs(pc2) / b, 6) as radius from s, t")
def marker_scale(spark, d):
    scored = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("pickup_place"), (F.col("c_acctbal") / 1000).alias("pc1"), (F.col("c_custkey") % 7 - 3.0).alias("pc2"))
    return zones.markers(scored, _zones(spark, d)).select("pickup_place", "lat", "lon", r6("colour").alias("colour"), r6("radius").alias("radius"))
