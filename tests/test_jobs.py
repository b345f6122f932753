import datetime as dt
import json

import pytest

from tidemark import jobs
from tidemark.sources import files, tuning


def trip_file(spark, folder, name, rows, place="int"):
    spark.createDataFrame(rows, f"tpep_pickup_datetime timestamp, PULocationID {place}, DOLocationID int").coalesce(1).write.parquet(str(folder / name))


def rows_of(place, hours, each, month=1):
    return [(dt.datetime(2023, month, 15, h, i), place, 1) for h in hours for i in range(each)]


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("my trips")
    trip_file(spark, folder, "yellow_tripdata_2023-01.parquet", rows_of(100, range(12), 10) + rows_of(200, range(12, 24), 10) + rows_of(7, [5], 30) + [(None, 100, 1)])
    trip_file(spark, folder, "yellow_tripdata_2023-02.parquet", rows_of(100, [3], 60, 2) + rows_of(7, [6], 30), "bigint")
    spark.createDataFrame([(1,)], "x int").coalesce(1).write.parquet(str(folder / "green_tripdata_2023-01.parquet"))
    (folder / "green_tripdata_2023-03.parquet").write_bytes(b"not a table")
    trip_file(spark, folder, "other_2023-01.parquet", rows_of(1, [1], 2))
    return str(folder)


def test_wide_run(spark, source, tmp_path):
    out = jobs.main(["wide", source, str(tmp_path / "w"), "--report", str(tmp_path / "r.md")], spark)
    got = {(r["taxi_type"], str(r["date"]), r["pickup_place"]): r for r in spark.read.parquet(str(tmp_path / "w")).collect()}
    assert set(got) == {("yellow", "2023-01-15", "100"), ("yellow", "2023-01-15", "200"), ("yellow", "2023-02-15", "100")}
    first = got["yellow", "2023-01-15", "100"]
    assert [first[f"hour_{h}"] for h in range(24)] == [10] * 12 + [0] * 12
    assert (out["input_rows"], out["parse_failures"], out["month_mismatch"], out["files_with_mismatch"]) == (361, 1, 30, 1)
    assert (out["files"], out["failed_files"], out["output_rows"]) == (2, 3, 3)
    assert (out["rows_before"], out["rows_removed"], out["rides_dropped"], out["discarded"], out["retained"]) == (5, 2, 60, 61, 300)
    assert out["attempted_files"] == 5 and out["input_bytes"] > 0 and out["output_bytes"] > 0 and out["output_columns"] == 27
    report = (tmp_path / "r.md").read_text()
    assert "| input_rows | 361 |" in report and "## Failed files" in report and "| 2023 | yellow | 3 | 100.0 |" in report
    assert json.loads((tmp_path / "r.json").read_text())["discarded"] == 61


def test_intermediate_and_partition_size(spark, source, tmp_path):
    setting = spark.conf.get(tuning.SETTING)
    out = jobs.main(["wide", source, str(tmp_path / "w"), "--intermediate", str(tmp_path / "i"), "--partition-size", "64MB"], spark)
    assert out["partition_bytes"] == str(64 << 20) and spark.conf.get(tuning.SETTING) == setting
    assert spark.read.parquet(str(tmp_path / "i")).count() == out["rows_before"] == 5
    tuned = jobs.main(["wide", source, str(tmp_path / "x"), "--tune", "--max-memory", "1GB"], spark)
    assert int(tuned["partition_bytes"].rstrip("b")) in tuning.candidates() and spark.conf.get(tuning.SETTING) == setting
    assert tuned["output_rows"] == out["output_rows"]


def test_grain_months_and_types(spark, source, tmp_path):
    jobs.run_wide(spark, source, str(tmp_path / "g"), grain="global")
    assert {r["pickup_place"] for r in spark.read.parquet(str(tmp_path / "g")).collect()} == {"7", "100", "200"}  # 30 rides in each of two files
    assert jobs.run_wide(spark, source, str(tmp_path / "m"), months=1)["input_rows"] == 271
    with pytest.raises(ValueError):
        jobs.run_wide(spark, source, str(tmp_path / "t"), types=("fhv",))
    with pytest.raises(ValueError):
        jobs.run_wide(spark, source, str(tmp_path / "t"), grain="month")


def test_footers(spark, source):
    found = files.discover(spark, source)
    kinds = [isinstance(x, Exception) for x in files.footers(spark, found).values()]
    assert sum(kinds) == 1 and len(kinds) == 5


def test_runs_on_a_wide_table(spark, tmp_path):
    rows = [("yellow", dt.date(2023, 1, d), str(p), *[(h * p + d * (h % 5) * p + (7 * h * d + p) % 11) % 97 for h in range(24)]) for d in range(1, 29) for p in (1, 2, 3, 4)]
    keys = "taxi_type string, date date, pickup_place string, " + ", ".join(f"hour_{h} bigint" for h in range(24))
    table, model = str(tmp_path / "t"), str(tmp_path / "m")
    spark.createDataFrame(rows, keys).write.parquet(table)
    shares = jobs.main(["components", table, model], spark)
    assert sum(shares) == pytest.approx(1) and shares == sorted(shares, reverse=True)
    assert set(jobs.main(["stability", table, str(tmp_path / "s"), "--replicates", "5"], spark)) == {"subspace_affinity", "procrustes_distance", "PC1", "PC2", "overall_summary"}
    assert spark.read.json(str(tmp_path / "s")).count() == 5
    assert jobs.main(["tails", model, str(tmp_path / "a")], spark)["tail"] in ("heavy", "light", "moderate")
    (tmp_path / "z.csv").write_text("LocationID,lat,lon\n1,40.1,-73.1\n2,40.2,-73.2\n9,40.9,-73.9\n3,x,-73\n")
    assert jobs.main(["zones", table, str(tmp_path / "z.csv"), str(tmp_path / "k")], spark) == 2
    assert jobs.main(["zones", table, str(tmp_path / "z.csv"), str(tmp_path / "k2"), "--model", model], spark) == 2
    a, b = ({r["pickup_place"]: (abs(r["pc1"]), abs(r["pc2"])) for r in spark.read.parquet(str(tmp_path / x)).collect()} for x in ("k", "k2"))
    assert all(a[p] == pytest.approx(b[p]) for p in a)
    spark.createDataFrame([(1,)], "hour_0 int").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(KeyError):
        jobs.wide_table(spark, str(tmp_path / "bad"))
