import datetime as dt
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import paths, roles, scalars
from tidemark.operators import additive, classify, features, linalg, quantiles, quality, tails, wide
from tidemark.sources import files, sinks


def trips(spark, rows):
    return spark.createDataFrame([(k, dt.date(2023, 1, day), p, dt.datetime(2023, 1, day, h) if h is not None else None, f) for k, day, p, h, f in rows], "taxi_type string, date date, pickup_place string, ts timestamp_ntz, path string")


KEYS = ["taxi_type", "date", "pickup_place"]


def test_roles():
    assert roles.pickup_datetime(["x", " Pickup_DateTime "]) == " Pickup_DateTime "
    assert roles.pickup_datetime(["pickup_datetime", "tpep_pickup_datetime"]) == "tpep_pickup_datetime"
    assert roles.pickup_datetime(["my_pickup_time"]) == "my_pickup_time"
    assert roles.pickup_location(["DOLocationID", "PULocationID"]) == "PULocationID"
    assert roles.pickup_location(["DOLocationID"]) is None
    assert roles.pickup_lon_lat(["start_lon", "start_lat"]) == ("start_lon", "start_lat")


def test_paths_and_sizes():
    assert paths.is_object_path("S3A://b/k") and not paths.is_object_path(3)
    assert paths.bucket_and_key("s3://b/k/x") == ("b", "k/x")
    with pytest.raises(ValueError):
        paths.bucket_and_key("/local")
    assert scalars.parse_size("200MB") == 200 << 20 and scalars.parse_size("1.5 kb") == 1536
    for bad in ("-1MB", "5XB", ""):
        with pytest.raises(ValueError):
            scalars.parse_size(bad)


def test_wide_and_thresholds(spark):
    rows = [("yellow", 1, "a", 10, "f1")] * 30 + [("yellow", 1, "a", 11, "f2")] * 30 + [("green", 1, "b", 5, "f1")] * 49 + [("green", 2, "c", 5, "f1")] * 50 + [("green", 2, "d", None, "f1")]
    t = trips(spark, rows)
    table = wide.wide(t, KEYS)
    assert len(table.columns) == 27
    kept = {r["pickup_place"]: r for r in wide.cleaned(table, 50).collect()}
    assert set(kept) == {"a", "c"} and kept["a"]["hour_10"] == 30 and kept["a"]["hour_0"] == 0
    assert {r["pickup_place"] for r in wide.by_file(t, KEYS, 50).collect()} == {"c"}
    stats = wide.cleanup_stats(table, 50).first()
    assert (stats["rows_before"], stats["rows_after"], stats["rows_removed"], stats["rides_dropped"]) == (3, 2, 1, 49)
    assert sorted(map(tuple, wide.pivoted(wide.counts(t, KEYS), KEYS).collect())) == sorted(map(tuple, table.collect()))
    c = quality.counters(t, 2023, 2).first()
    assert c["parse_failures"] == 1 and c["month_mismatch"] == len(rows) - 1 and c["files_with_mismatch"] == 2


def test_discovery_and_reading(spark, tmp_path):
    spark.createDataFrame([(dt.datetime(2023, 1, 1, 3), 132), (None, None)], "tpep_pickup_datetime timestamp, PULocationID int").coalesce(1).write.parquet(str(tmp_path / "yellow"))
    spark.createDataFrame([("2010-01-01 05:00:00", -73.98211, 40.75), ("garbage", None, None)], "pickup_datetime string, start_lon double, start_lat double").coalesce(1).write.parquet(str(tmp_path / "old"))
    found = files.discover(spark, str(tmp_path))
    assert len(found) == 2 and found == sorted(found) and files.is_valid(spark, found[0]) and files.consistent(spark, found) == (True, None)
    got = files.read_trips(spark, found)
    assert sorted((r["place"], r["ts"] is None) for r in got.collect()) == [("-73.982_40.750", False), ("132", False), ("unknown", True), ("unknown", True)]
    with pytest.raises(ValueError):
        files.discover(spark, " ")
    with pytest.raises(FileNotFoundError):
        files.discover(spark, str(tmp_path / "none"))
    assert not files.is_valid(spark, str(tmp_path / "none"))
    sinks.write_report(spark, {"rows": 3}, [(2023, "yellow", 3)], str(tmp_path / "r.md"))
    assert "| rows | 3 |" in (tmp_path / "r.md").read_text()


def test_components(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4)) * [5, 3, 2, 1] + 100
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")))
    c, v, m = linalg.fit(df, list("abcd"))
    assert np.allclose(v, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]) and np.allclose(m, x.mean(0)) and np.allclose(c.T @ c, np.eye(4))
    assert linalg.affinity(c[:, :2], c[:, :2]) == pytest.approx(1) and linalg.procrustes(c[:, :2], c[:, :2]) == pytest.approx(0, abs=1e-6)
    files_model = linalg.model_tables(spark, c, v)
    assert files_model[0].count() == 16 and linalg.significant_count(files_model[1]).first()[0] >= 1


def test_tails(spark):
    rng = np.random.default_rng(2)
    x = (1 - rng.random(4000)) ** (-1 / 2.5)
    df = spark.createDataFrame(pd.DataFrame({"k": range(4000), "x": x}))
    assert tails.tail_alpha(df, "x", "k").first()["alpha"] == pytest.approx(2.5, rel=0.2)
    assert tails.hill_plateau(tails.hill(df, "x", "k")).first()["median"] == pytest.approx(2.5, rel=0.3)
    assert sorted(r["rank"] for r in tails.ranked(df, "x", "k").collect()) == list(range(1, 4001))
    w, p = tails.shapiro(rng.normal(size=500))
    assert w > 0.98 and p > 0.001 and tails.shapiro(x[:500])[1] < 1e-6
    cases = [(2.0, 0.9, 1.0, 0.5), (2.0, 0.89, 1.0, 0.0), (2.0, 0.95, -1.0, 0.04), (2.0, 0.95, 0.0, 0.05), (-2.0, 0.95, 1.0, 0.0), (None, None, 1.0, 0.0), (2.0, 0.95, None, None)]
    told = tails.tail_class(spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, alpha double, r2 double, excess_kurtosis double, shapiro_p double"))
    assert [r["tail"] for r in told.orderBy("i").collect()] == ["heavy", "light", "heavy", "light", "light", "light", "light"]
    assert tails.tail_alpha(df.limit(0), "x", "k").first()["alpha"] is None


def test_ranks_and_quantiles_at_size(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=1500), np.full(900, 0.25), np.full(300, -3.0), [np.nan]])
    df = spark.createDataFrame([(i, None if np.isnan(v) else float(v), 5) for i, v in enumerate(x)], "key long, x double, part int")
    told = sorted((v, i) for i, v in enumerate(x[:-1]))
    got = {r["key"]: (r["rank"], r["n"]) for r in tails.ranked(df, "x", "key", rows_a_range=200).collect()}
    assert got == {i: (k + 1, 2700) for k, (_, i) in enumerate(told)}
    at = [0.0, 0.05, 0.31, 0.5, 0.75, 0.99, 1.0]
    for most in (2_000_000, 20):
        assert quantiles.quantiles(df, ["x", "part"], at, most) == {"x": pytest.approx(np.quantile(x[:-1], at).tolist()), "part": [5.0] * 7}
    assert quantiles.quantiles(df.limit(0), ["x"], [0.5]) == {"x": [None]} and tails.ranked(df.limit(0), "x", "key").count() == 0


def test_quantiles_by_group_at_size(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.full(900, 5.0), rng.normal(5, 2, 1500), [np.nan]])
    pdf = pd.DataFrame({"x": x, "g": ["a", "b", None] * 800 + ["b"]})
    df = spark.createDataFrame(pdf).select(F.when(~F.isnan("x"), F.col("x")).alias("x"), "g")
    at = [0.0, 0.05, 0.31, 0.5, 0.99, 1.0]
    want = {g: (k.x.notna().sum(), np.quantile(k.x.dropna(), at).tolist()) for g, k in pdf.groupby(pdf.g.fillna("-"))}
    for most in (2_000_000, 100):
        got = {r["g"] or "-": (r["n"], list(r["q"])) for r in quantiles.quantiles_by(df, "x", ["g"], at, most).collect()}
        assert {g: n for g, (n, _) in got.items()} == {g: n for g, (n, _) in want.items()}
        assert all(got[g][1] == pytest.approx(q) for g, (_, q) in want.items())
    assert quantiles.quantiles_by(df.limit(0), "x", ["g"], at).count() == 0
    whole, own = tails.summary(df, "x").first(), tails.summary(df, "x", ["g"], listed=True).where("g is null").first()
    assert whole["p75"] == pytest.approx(np.quantile(x[:-1], 0.75)) and len(own["values"]) == want["-"][0] and own["p50"] == pytest.approx(want["-"][1][3])


def test_caps_and_shares_by_class(spark):
    sizes = {"big": 5000, "small": 3, None: 40}
    df = spark.createDataFrame([(i, c) for k, (c, n) in enumerate(sizes.items()) for i in range(k * 10_000, k * 10_000 + n)], "id long, c string")
    capped = features.cap_per_class(df, "id", "c", 37)
    assert {r["c"]: r["count"] for r in capped.groupBy("c").count().collect()} == {"big": 37, "small": 3, None: 37}
    drawn = df.withColumn("u", F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit("42"))), 1, 8))
    least = {r["id"] for r in drawn.where("c = 'big'").orderBy("u", "id").limit(37).collect()}
    assert {r["id"] for r in capped.where("c = 'big'").collect()} == least and capped.columns == df.columns
    assert features.cap_per_class(df.limit(0), "id", "c", 5).count() == 0
    parts = features.stratified_split(df, "id", "c").groupBy("c").agg(F.count_if(F.col("part") == "train").alias("n"))
    assert {r["c"]: r["n"] for r in parts.collect()} == {"big": 4000, "small": 2, None: 32}


def test_one_pass_bootstrap(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"k": range(400), "a": rng.random(400), "b": rng.random(400), "y": rng.random(400)}))
    terms = [additive.Term("a", 6), additive.Term("b", linear=True)]
    ranges = additive.ranges_of(df, terms)
    from tidemark.functions.scalars import poisson

    for b, g in enumerate(additive.bootstrap_grams(df, terms, "y", "k", 3, ranges)):
        one = df.withColumn("w", poisson(F.col("k").cast("string"), b).cast("double"))
        assert np.allclose(g, additive.gram(one, terms, ["y"], ranges, "w")["y"])
    bands = additive.bootstrap_bands(df, terms, "y", "k", 10)
    assert (bands["boot_lo"] <= bands["boot_hi"]).all() and (bands["width_ratio"] > 0).all()
    assert additive.improvement({"rmse": 2.0, "mae": 1.0, "r2": 0.5}, {"rmse": 1.0, "mae": 1.5, "r2": 0.75}) == [("rmse", 2.0, 1.0, 1.0, 50.0), ("mae", 1.0, 1.5, -0.5, -50.0), ("r2", 0.5, 0.75, 0.25, 50.0)]


def test_normality_of_samples_and_fit_line(spark):
    x = np.random.default_rng(6).normal(3, 2, 6000)
    df = spark.createDataFrame(pd.DataFrame({"k": range(6000), "x": x}))
    w, p = tails.shapiro_of(df, "x", "k")
    assert w > 0.998 and (w, p) == tails.shapiro_of(df.repartition(3), "x", "k") and tails.shapiro_of(df.withColumn("x", F.exp("x")), "x", "k")[1] < 1e-6
    line = tails.qq_fit(tails.qq_points(df, "x", "k")).first()
    assert line["slope"] == pytest.approx(2, rel=0.05) and line["intercept"] == pytest.approx(3, abs=0.1) and line["r"] > 0.999


def test_scratch_partitions_and_first_files(spark, tmp_path):
    from tidemark.sources import tuning

    with pytest.raises(RuntimeError), sinks.scratch_removed(spark) as own:
        kept = sinks.kept(spark.range(5), "five")
        assert kept.count() == 5 and len(own) == 1
        raise RuntimeError
    assert not os.path.exists(own[0].removeprefix("file:"))
    spark.range(50).coalesce(1).write.parquet(str(tmp_path / "green_tripdata_2023-01.parquet"))
    spark.range(9).coalesce(1).write.parquet(str(tmp_path / "yellow_tripdata_2022-01.parquet"))
    found = files.trip_files(spark, str(tmp_path))
    assert {k: len(v) for k, v in found.items()} == {"yellow": 1, "green": 1}
    assert files.trip_files(spark, "a/b/any.parquet") == {"yellow": ["a/b/any.parquet"], "green": []} and files.trip_files(spark, "green_tripdata_2023-01.parquet")["yellow"] == []
    assert files.first_file(spark, str(tmp_path)).count() == 50 and files.first_file(spark, str(tmp_path), "Yellow").count() == 9
    with pytest.raises(FileNotFoundError):
        files.first_file(spark, str(tmp_path), "fhv")
    assert tuning.candidates(100, 500, 5) == [100, 200, 300, 400, 500] and tuning.candidates(7, 7) == [7]
    before = spark.conf.get(tuning.SETTING)
    every = [f for k in found.values() for f in k]
    best, tried = tuning.best_partition_bytes(spark, every, tuning.whole, [1 << 20, 1 << 22, 1 << 40])
    assert best in dict(tried) and [s for s, _ in tried] == [1 << 20, 1 << 22] and spark.conf.get(tuning.SETTING) == before
    assert [s for s, _ in tuning.best_partition_bytes(spark, every, sizes=[1 << 40])[1]] == [1 << 40]


def test_additive_model(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random(3000), rng.random(3000)
    pdf = pd.DataFrame({"a": a, "b": b, "y": np.sin(6 * a) + b**2 + rng.normal(scale=0.05, size=3000)})
    df = spark.createDataFrame(pdf)
    model = additive.fit(df, [additive.Term("a", 12), additive.Term("b", 12)], "y")
    assert additive.regression_metrics(additive.predict(df, model), "y", "prediction").first()["r2"] > 0.98
    pd_a = additive.partial_dependence(model, 20).query("term == 'a'")
    assert np.corrcoef(pd_a["effect"], np.sin(6 * pd_a["x"]))[0, 1] > 0.99


def test_classification(spark):
    pdf = pd.DataFrame({"k": range(400), "x": np.arange(400) % 20, "z": np.arange(400) % 7})
    pdf["label"] = (pdf["x"] > 9).astype(float)
    df = spark.createDataFrame(pdf)
    out = classify.scored(classify.booster(["x", "z"], depth=2, trees=2).fit(df), df)
    assert classify.overall(out).first()["accuracy"] == 1.0
    assert classify.bootstrap_metrics(out, "k", 5).count() == 5


def test_splits_and_places(spark):
    df = spark.range(1000).withColumn("c", F.col("id") % 3)
    assert {r["c"]: r["count"] for r in features.stratified_split(df, "id", "c").where("part = 'train'").groupBy("c").count().collect()} == {0: 267, 1: 266, 2: 266}
    assert {r["count"] for r in features.cap_per_class(df, "id", "c", 50).groupBy("c").count().collect()} == {50}
    got = spark.createDataFrame([("132",), ("-73.982_40.751",)], "pickup_place string").withColumns(features.place_features()).collect()
    assert (got[0]["pickup_lon"], got[0]["pickup_zone_id"]) == (0.0, 132.0) and (got[1]["pickup_lon"], got[1]["pickup_lat"], got[1]["pickup_zone_id"]) == (-73.982, 40.751, -1.0)


def test_place_keys_round_in_doubles(spark):
    got = spark.createDataFrame([(6492.75 / 100, -0.0001), (None, 1.0), (0.0125, 2.0)], "x double, y double").select(scalars.lonlat_key(F.col("x"), F.col("y")).alias("k")).collect()
    assert [r["k"] for r in got] == ["64.927_-0.000", None, "0.012_2.000"]
    x = np.round(np.random.default_rng(5).uniform(-1000, 10000, 5000), 2) / 100
    rows = spark.createDataFrame(pd.DataFrame({"x": x})).select("x", scalars.lonlat_key(F.col("x"), F.col("x")).alias("k")).collect()
    assert all(r["k"] == f"{np.round(r['x'], 3):.3f}_{np.round(r['x'], 3):.3f}" for r in rows)


def test_draws_in_numpy(spark):
    from tidemark.functions import draws

    keys = [None, "", "7", "1234567", "é", "x" * 51, "x" * 55, "x" * 62, "x" * 63, "y" * 130]
    df = spark.createDataFrame([(k,) for k in keys], "k string").coalesce(1)
    for suffix in ("0:42", "17:42", "3"):
        got = df.select(scalars.poisson(F.col("k"), *suffix.split(":")).alias("w"), draws.prefix("k").alias("p")).collect()
        own = draws.poisson_weights(pa.array([r["p"] for r in got]), [suffix])[0]
        assert own.tolist() == [r["w"] for r in got]


def test_bootstrap_deals_out_and_draws_once(spark):
    """Few files or row groups once made few tasks, each with all of their rows times replicates."""
    from tidemark.functions import draws
    from tidemark.operators import resample

    one = spark.range(3 * draws.TASK_ROWS).coalesce(1)
    assert draws.dealt(one).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    df = spark.createDataFrame([(1, 2.0, 0, 0), (2, None, 1, 0), (None, 5.0, 1, 1), (4, 7.5, None, 1), (1, 0.0, 0, 1)], "k int, v double, y int, q int")
    ci = resample.mean_ci(df, "k", "v", 20)
    assert "Generate" not in ci._jdf.queryExecution().optimizedPlan().toString()
    b = F.explode(F.sequence(F.lit(0), F.lit(19)))
    w = df.withColumn("b", b).withColumn("w", scalars.poisson(F.col("k").cast("string"), F.col("b").cast("string"), 42))
    means = w.groupBy("b").agg((F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    want = means.agg(F.count("*"), F.avg("m"), F.percentile("m", 0.025), F.percentile("m", 0.975)).first()
    assert np.allclose(np.array(ci.first(), float), np.array(want, float))
    assert resample.mean_ci(df.where("false"), "k", "v").first()["replicates"] == 0
    hits = {r["b"]: r["a"] for r in w.groupBy("b").agg((F.sum(F.when(F.col("y") == F.col("q"), F.col("w")).otherwise(0)) / F.nullif(F.sum("w"), F.lit(0))).alias("a")).collect()}
    got = {r["b"]: r["accuracy"] for r in classify.bootstrap_metrics(df, "k", 20, "y", "q").collect()}
    assert all(np.isclose(got[k], hits[k]) for k in got) and len(got) >= 15


def noisy(spark, n):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": np.arange(n), "v": np.round(rng.exponential(50, n), 2), "h": rng.integers(0, 24, n), "g": rng.integers(0, 7, n)})
    pdf["label"] = (np.sin(pdf["h"]) + pdf["v"] / 60 + rng.normal(size=n) > 1).astype(float)
    return spark.createDataFrame(pdf)


def test_boosting_on_counts_is_spark_ml(spark, monkeypatch):
    """All models come from one count of cells, and are Spark ML's where its thresholds come from all rows."""
    from tidemark.operators import boost

    df = noisy(spark, 3000).cache()
    names = ["v", "h", "g"]
    got, own = classify.boosted(df, df, names, depth=4, rate=0.3, trees=4)
    model = classify.booster(names, depth=4, rate=0.3, trees=4).fit(df)
    want = classify.scored(model, df).orderBy("k").toPandas()
    assert np.allclose(np.sort(got.toPandas()["p"]), np.sort(want["p"])) and np.allclose(own, model.stages[-1].featureImportances.toArray())
    missing = df.withColumn("v", F.when(F.col("k") % 3 > 0, F.when(F.col("k") % 3 > 1, float("nan")).otherwise(F.col("v"))))
    assert classify.boosted(df, missing, names, depth=2, trees=1)[0].count() == 1000
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        classify.boosted(df.withColumn("label", F.lit(2.0)), df, names)
    monkeypatch.setattr(boost, "VALUES", 50)
    cut = boost.thresholds(boost.whole(df, names), names)
    share = np.histogram(df.toPandas()["v"], [-np.inf, *cut[0], np.inf])[0] / 3000
    assert len(cut[0]) == 31 and share.max() < 0.05 and [len(c) for c in cut[1:]] == [23, 6]


def test_bags_and_sweeps_fit_no_model_on_rows(spark, monkeypatch):
    """Each replicate and each pair of the grid once was a model fitted by dozens of jobs over the rows."""
    from tidemark.operators import boost

    df = noisy(spark, 2000).cache()
    train, test, names = df.where("k % 5 > 0"), df.where("k % 5 = 0"), ["h", "g"]
    monkeypatch.setattr(boost, "CELLS", 0)
    slow = classify.bagged(train, test, names, "k", 2, 3, 2).orderBy("k").toPandas(), classify.sweep(train, test, names, ((2, 0.1), (3, 0.3)), 2)
    monkeypatch.undo()
    monkeypatch.setattr(classify, "booster", None)
    fast = classify.bagged(train, test, names, "k", 2, 3, 2).orderBy("k").toPandas(), classify.sweep(train, test, names, ((2, 0.1), (3, 0.3)), 2)
    assert np.allclose(slow[0].to_numpy(float), fast[0].to_numpy(float)) and np.allclose(slow[1], fast[1])
    assert list(slow[0].columns) == list(fast[0].columns) and (slow[0].dtypes == fast[0].dtypes).all()


def test_entry_imports_and_streaming(spark, tmp_path):
    import __spark_entry__ as e

    assert "wide_g3" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
    from tidemark.streaming.hourly import hourly_counts

    spark.createDataFrame([("a", dt.datetime(2024, 1, 1, h, 5)) for h in (1, 1, 2, 9)], "k string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    q = hourly_counts(stream, ["k"]).writeStream.outputMode("complete").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["count"] for r in spark.table("hours").collect()) == [1, 1, 2]


def test_embedding_spectrum_reads_all_dimensions(spark, tmp_path):
    from tidemark.plans import catalog

    x = np.random.default_rng(8).normal(size=(200, 20)) * np.arange(1, 21)
    spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = catalog.embedding_spectrum(spark, str(tmp_path)).toPandas()
    want = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert len(got) == 20 and any(np.allclose(np.sort(got[c].to_numpy(float))[::-1], want, rtol=1e-4) for c in got.columns if got[c].dtype == float)


def test_classifiers_see_all_rows(spark, tmp_path, monkeypatch):
    from tidemark.plans import catalog

    when = F.timestamp_seconds(F.col("id") * 3600)
    spark.range(6000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"), (F.col("id") % 97).cast("double").alias("value"), when.alias("ts")).write.parquet(str(tmp_path / "events.parquet"))
    rows = catalog._labelled(spark, str(tmp_path))
    assert rows.count() == 6000 and rows.where("part = 'test'").count() > 1100
    asked = {}
    monkeypatch.setattr(classify, "sweep", lambda train, test, names, grid=classify.SWEEP, trees=10: asked.update(grid=grid, trees=trees) or [(1, 0.1, 1.0, 1.0)])
    monkeypatch.setattr(classify, "bagged", lambda train, test, names, key, replicates=30, trees=10, depth=4: asked.update(replicates=replicates) or test.withColumn("p", F.lit(0.7)).withColumn("prediction", F.lit(1.0)))
    catalog.gbt_sweep(spark, str(tmp_path))
    catalog.bagged_confidence(spark, str(tmp_path))
    assert asked == {"grid": classify.SWEEP, "trees": 10, "replicates": 30}
