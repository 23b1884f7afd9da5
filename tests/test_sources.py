"""Readers, writers, parameter documents and the weather contract."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from agroseries.plans import weather
from agroseries.sources import contract, files, params, schemas, shared

D = dt.date


@pytest.fixture(scope="module")
def raw(spark):
    data = [
        ("PR", D(2020, 1, 1), 25.0, 20.0, 30.0, 1.5, 80.0, 95.0, 60.0, 3.25, 9.6),
        ("PR", D(2020, 1, 2), None, 20.0, 30.0, 1.5, 80.0, 95.0, 60.0, 0.0, 4.8),
        ("TO", D(2020, 1, 1), 24.0, 19.0, 29.0, 1.0, 70.0, 90.0, 50.0, 1.0, 4.8),
    ]
    return spark.createDataFrame(data, schemas.WEATHER_RAW)


@pytest.mark.parametrize("compression", [None, "bzip2"])
def test_csv_round_trip(spark, raw, tmp_path, compression):
    path = str(tmp_path / "weather")
    files.write_csv(raw, path, compression=compression)
    suffix = ".csv.bz2" if compression else ".csv"
    assert all(p.name.endswith(suffix) for p in (tmp_path / "weather").glob("part-*"))
    back = files.scan_csv(spark, path, schemas.WEATHER_RAW)
    assert back.exceptAll(raw).count() == 0 and raw.exceptAll(back).count() == 0


def test_other_separator(spark, tmp_path):
    (tmp_path / "w.txt").write_text("date;T\n2020-01-01;25.5\n")
    got = files.scan_csv(spark, str(tmp_path / "w.txt"), "date date, T double", sep=";")
    assert got.first() == (D(2020, 1, 1), 25.5)


def test_tables_by_key(spark, raw, tmp_path):
    path = str(tmp_path / "by_site")
    files.write_by(raw, path)
    assert {p.name for p in (tmp_path / "by_site").glob("Site=*")} == {"Site=PR", "Site=TO"}
    assert files.scan_parquet(spark, path).where("Site = 'TO'").count() == 1
    organs = str(tmp_path / "organs")
    files.write_by(spark.range(6).withColumn("organ", F.when(F.col("id") < 2, "Leaf").otherwise("Male")),
                   organs, ["organ"])
    scales = files.scan_scales(spark, organs, ["Leaf", "Male", "Soil"])
    assert {name: df.count() for name, df in scales.items()} == {
        "Leaf": 2,
        "Male": 4,
        "Soil": 0,
    }
    assert "PartitionFilters: [isnotnull(organ" in scales["Leaf"]._jdf.queryExecution().toString()


def test_parameters(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "PR.yml").write_text("plot:\n  latitude: 6.137\n  soil:\n    depth: 100\nname: x\n")
    (tmp_path / "TO.yml").write_text("plot:\n  latitude: 7.0\n")
    got = {tuple(r) for r in params.scan_parameters(spark, str(tmp_path)).collect()}
    assert got == {
        ("PR.yml", "plot.latitude", "6.137"),
        ("PR.yml", "plot.soil.depth", "100"),
        ("PR.yml", "name", "x"),
        ("TO.yml", "plot.latitude", "7.0"),
    }


PLAIN = {
    "Site": "Site", "date": "ObservationDate", "T": "TAverage_pred", "Tmin": "TMin_pred",
    "Tmax": "TMax_pred", "Wind": "WindSpeed_pred", "Precipitations": "Rainfall_pred",
}
PERCENT = {"Rh": "HRAverage_pred", "Rh_max": "HRMax_pred", "Rh_min": "HRMin_pred"}


def test_normalize_prepare_and_contract(raw):
    clean = weather.normalize_weather(raw, PLAIN, PERCENT, "PAR_pred")
    first = clean.first()
    assert (first["Rh"], first["duration"], first["Ri_PAR_f"], first["Rg"]) == (0.8, 1, 9.6, 20.0)
    assert weather.prepare_weather(clean).count() == 2
    found = {tuple(r) for r in contract.contract_violations(clean, schemas.WEATHER).collect()}
    assert found == {
        ("timestep", "missing column", 1),
        ("months_after_planting", "missing column", 1),
        ("T", "null", 1),
    }


def test_contract_sees_types_and_keys(spark):
    df = spark.createDataFrame([("PR", "2020-01-01"), ("PR", "2020-01-01")], "Site string, date string")
    schema = schemas.WEATHER.__class__([f for f in schemas.WEATHER if f.name in ("Site", "date")])
    found = {tuple(r) for r in contract.contract_violations(df, schema).collect()}
    assert found == {("date", "type", 1), ("Site,date", "repeated key", 1)}
    good = df.limit(1).withColumn("date", F.col("date").cast("date"))
    assert contract.contract_violations(good, schema).count() == 0


def test_shared_folder_comes_from_the_session(spark):
    assert shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    kept = shared.saved(spark.range(5), "five")
    assert kept.count() == 5
    assert all(shared.shared_dir(spark) in file for file in kept.inputFiles())


def test_scratch_tables_are_cleared(spark):
    from agroseries.sources import shared

    kept = shared.saved(spark.range(5), "numbers")
    assert kept.count() == 5
    shared.clear(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|FileNotFound|does not exist"):
        spark.read.parquet(kept.inputFiles()[0]).count()
