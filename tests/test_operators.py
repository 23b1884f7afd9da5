"""Operators on small tables with the awkward cases: gaps, ties, NULLs, empty groups."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.errors import PySparkException

from agroseries.functions import aggregates as a
from agroseries.functions import columns as c
from agroseries.functions import constants as k
from agroseries.operators import checks, joins, reshape, rollup, scales, scenario
from agroseries.plans import scenarios, sites, weather

D = dt.date


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


# columns ------------------------------------------------------------------------------------


def test_ramp_and_stress(spark):
    df = spark.createDataFrame([(0,), (1460,), (2920,), (9999,)], "age int")
    got = [r[0] for r in df.select(c.age_ramp("age", 0.0, 2920, 0.0111, 0.0074)).collect()]
    assert got == pytest.approx([0.0111, 0.00925, 0.0074, 0.0074])
    df = spark.createDataFrame([(0.3,), (0.31,), (0.15,), (None,)], "f double")
    assert [r[0] for r in df.select(c.water_stress("f")).collect()] == [1.0, 1.0, 0.5, None]


def test_units(spark):
    fresh = 1e5 * 1e-3 / 0.4857 / 0.75
    assert one(spark, c.carbon_to_fresh_kg(F.lit(1e5))) == pytest.approx(fresh)
    assert one(spark, c.carbon_to_fresh_t_ha(F.lit(1e5))) == pytest.approx(fresh * 1e-3 * 136)
    assert one(spark, c.carbon_to_dry_t_ha(F.lit(1e5))) == pytest.approx(1e-1 / 0.45 * 136)
    assert one(spark, c.irradiance_to_daily_mj(F.lit(100.0))) == pytest.approx(8.64)
    assert one(spark, c.irradiance_to_daily_par(F.lit(100.0))) == pytest.approx(8.64 * 0.48)
    assert one(spark, c.area_index(F.lit(73.52941176470588))) == 1.0


def test_scalars(spark):
    assert one(spark, c.duration_days(F.lit("1 day"))) == 1
    assert one(spark, c.duration_label(F.lit(6))) == "6 months"
    assert one(spark, c.duration_label(F.lit(1))) == "1 month"
    assert one(spark, c.shift_years(F.lit(D(2012, 2, 29)), 1)) == D(2013, 2, 28)
    assert one(spark, c.year_start(F.lit(2023))) == D(2023, 1, 1)
    assert one(spark, c.year_gap(F.lit(D(2012, 1, 1)), F.lit(D(2006, 7, 1)))) == 6
    assert one(spark, c.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, c.fill_nan(F.lit(float("nan")))) == 0.0
    assert one(spark, c.fill_missing(F.lit(None).cast("double"))) == 0.0
    assert one(spark, c.clamp_zero(F.lit(-3))) == 0
    assert one(spark, c.clamp_zero(F.lit(None).cast("int"))) is None


# roll-ups -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def plant(spark):
    data = [
        ("PR", D(2020, 1, 30), 1, 10.0, 1, 5),
        ("PR", D(2020, 1, 31), 2, 20.0, 0, 7),
        ("PR", D(2020, 2, 1), 3, 40.0, 2, 7),
        ("TO", D(2020, 1, 30), 1, 1.0, 0, 1),
    ]
    df = spark.createDataFrame(
        data, "Site string, date date, timestep int, biomass_bunch_harvested double,"
        " n_bunches_harvested int, phytomer_count int",
    )
    from agroseries.operators.series import month_index

    return month_index(df).withColumns(
        {
            "TEff": F.lit(2.0),
            "biomass_bunch_harvested_cum": F.col("biomass_bunch_harvested") * 100,
            "n_bunches_harvested_cum": F.col("n_bunches_harvested") * 100,
        }
    )


def test_plant_months(plant):
    got = sites.plant_months(plant).orderBy("Site", "months_after_planting").collect()
    first = got[0].asDict()
    assert first.pop("ffb_kg") == pytest.approx(30e-3 / 0.4857 / 0.75)
    assert first == {
        "Site": "PR",
        "months_after_planting": -17,
        "date": D(2020, 1, 1),
        "nb_timesteps": 2,
        "TEff": 4.0,
        "biomass_bunch_harvested_monthly": 30.0,
        "n_bunches_harvested_monthly": 1,
        "biomass_bunch_harvested_cum": 2000.0,
        "n_bunches_harvested_cum": 0,
        "phytomer_count": 7,
        "phytomer_emitted": 2,
    }
    assert len(got) == 3


def test_rate_summary(plant):
    got = rollup.rate_summary(sites.plant_months(plant)).orderBy("Site").first().asDict()
    assert (got["months_after_planting"], got["phytomer_count"]) == (-16, 7)
    assert (got["TEff"], got["nb_timesteps"]) == (6.0, 3)
    assert got["phytomer_per_TT"] == pytest.approx(7 / 6)
    assert got["days_per_phytomer"] == pytest.approx(3 / 7)


def test_conditional_means_of_empty_groups(spark):
    df = spark.createDataFrame(
        [("a", "Scenescent", 4.0), ("a", "Scenescent", 6.0), ("b", "Harvested", 9.0), ("b", "x", 0.0)],
        "g string, state string, x double",
    )
    assert rows(rollup.mean_of_state(df, ["g"], "x", k.SENESCENT, "m"), "g") == [("a", 5.0), ("b", 0.0)]
    unfilled = rollup.mean_of_state(df, ["g"], "x", k.SENESCENT, "m", fill=None)
    assert rows(unfilled, "g") == [("a", 5.0), ("b", None)]
    zero = df.where("x = 0")
    assert rows(rollup.mean_positive(zero, ["g"], "x", "m"), "g") == [("b", None)]


def test_mean_with_distinct_repeats_the_group_mean(spark):
    df = spark.createDataFrame(
        [("m", 1, 2.0), ("m", 1, 4.0), ("m", 2, 12.0), (None, 3, 5.0)], "k string, v int, x double"
    )
    got = rollup.mean_with_distinct(df, ["k"], "x", "v", "mean")
    assert rows(got, "k", "v") == [(None, 3, 5.0), ("m", 1, 6.0), ("m", 2, 6.0)]


def test_organ_mass_uses_the_yearly_minimum(spark):
    df = spark.createDataFrame(
        [
            ("PR", 1, D(2020, 1, 1), 1e5, 1.0, 0.2),
            ("PR", 1, D(2020, 1, 1), 1e5, 2.0, 0.3),
            ("PR", 2, D(2020, 1, 2), 1e5, 5.0, 0.4),
        ],
        "Site string, timestep int, date date, biomass double, height double, radius double",
    )
    plant = rollup.organs_to_plant(
        df, sums={"biomass": "biomass", "height": "height"}, maxima={"radius": "radius"}
    )
    got = rollup.organ_mass_year(plant, minima={"height": "height"}, radius="radius").first()
    assert got["biomass_ton_ms"] == pytest.approx(0.1 / 0.45 * 136)
    assert (got["nb_timesteps"], got["height"], got["diameter"]) == (2, 3.0, 0.6)


def test_mean_of_means_is_unweighted(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0)], "g string, x double")
    assert rollup.mean_of_means(df, ["g"], "x", "m").first()[0] == 6.0


def test_first_and_last_need_an_order(spark):
    df = spark.createDataFrame([(2, 1, "b"), (1, 9, "a"), (2, 2, "c")], "t int, u int, x string")
    got = df.agg(a.first_by("x", ["t", "u"]), a.last_by("x", ["t", "u"])).first()
    assert tuple(got) == ("a", "c")


# reshape ------------------------------------------------------------------------------------


def test_reshape(spark):
    df = spark.createDataFrame([(1, 2000.0, 3000.0)], "timestep int, a double, b double")
    assert rows(reshape.to_long(df, ["timestep"]), "variable") == [(1, "a", 2000.0), (1, "b", 3000.0)]
    assert reshape.scale_frame(df, 1000).first()[0] == pytest.approx(0.001)
    assert tuple(reshape.scale_frame(df, 1000, ["timestep"]).first()) == (1, 2.0, 3.0)
    both = reshape.unite_tagged({"x": df, "y": df.select("b", "a", "timestep")}, "run")
    assert [r["a"] for r in both.collect()] == [2000.0, 2000.0]
    with pytest.raises(AnalysisException):
        reshape.unite([df, df.drop("a")]).count()
    assert reshape.slice_scales(df.withColumn("organ", F.lit("Leaf")), {"Leaf": []}) == {}
    names = spark.createDataFrame([("b",), ("A",), ("C",)], "n string")
    assert [r[0] for r in reshape.sort_ignoring_case(names, "n").collect()] == ["A", "b", "C"]


def extend_by_hand(days, copies, start):
    def shifted(day, years):
        try:
            return day.replace(year=day.year + years)
        except ValueError:
            return D(day.year + years, 2, 28)

    days = list(days)
    for first, last, years in copies:
        days += [shifted(d, years) for d in days if D.fromisoformat(first) <= d <= D.fromisoformat(last)]
    return sorted(d for d in days if d >= D.fromisoformat(start))


def test_extend_years_with_leap_days(spark):
    days = [D(2012, 1, 5) + dt.timedelta(days=i) for i in range(4160)]
    copies = [
        ("2013-01-01", "2013-01-04", -1),
        ("2022-05-27", "2022-12-31", 1),
        ("2012-01-01", "2017-12-31", -6),
        ("2021-01-01", "2023-12-31", 3),
    ]
    df = spark.createDataFrame([(d,) for d in days], "date date")
    extended = reshape.extend_years(df, copies, start="2006-07-01")
    got = [r[0] for r in extended.orderBy("date").collect()]
    assert got == extend_by_hand(days, copies, "2006-07-01")
    # 29 February 2016 falls on the 28th of 2010, which the key check reports; that of 2012 falls
    # before the start
    check = checks.check_unique_key(extended, ["date"]).first()
    assert (check["ok"], check["n_bad"]) == (False, 1)


# joins --------------------------------------------------------------------------------------


def test_common_period_and_preparation(spark):
    raw = [("A", D(2020, 1, d), 1.0) for d in range(1, 11)]
    raw += [("B", D(2020, 1, d), 1.0) for d in range(4, 20)] + [("A", D(2020, 1, 20), None)]
    df = spark.createDataFrame(raw, "Site string, date date, T double")
    got = weather.prepare_weather(df)
    assert rows(got.groupBy("Site").agg(F.min("date"), F.max("date"), F.max("timestep")), "Site") == [
        ("A", D(2020, 1, 4), D(2020, 1, 10), 7),
        ("B", D(2020, 1, 4), D(2020, 1, 10), 7),
    ]
    assert got.select("months_after_planting").distinct().count() == 1
    empty = df.where("Site = 'C'")
    assert joins.common_period(empty).count() == 0


def test_two_points_keep_complete_pairs(spark):
    df = spark.createDataFrame(
        [("PR", "g1", 50, 10), ("PR", "g1", 100, 110), ("PR", "g2", 50, 5), ("TO", "g1", 100, 7)],
        "site string, genotype string, map int, n int",
    )
    got = joins.two_points(df, ["site", "genotype"], "map", 50, 100, ("_50", "_100"))
    assert rows(got.select("site", "genotype", "n_50", "n_100"), "site") == [("PR", "g1", 10, 110)]


def test_lookup_needs_exactly_one_row(spark):
    calendar = spark.createDataFrame([(1, 10), (2, 20), (2, 21)], "d int, m int")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "day int")
    got = joins.lookup_one(asked, calendar, {"day": "d"}, "m", "found")
    assert rows(got, "day") == [(1, 10), (2, None), (3, None)]
    strict = joins.lookup_one(asked, calendar, {"day": "d"}, "m", "found", strict=True)
    with pytest.raises(PySparkException, match="exactly one row"):
        strict.collect()


def test_parameters_stay_with_their_site(spark):
    parameters = spark.createDataFrame(
        [("A", "plot.latitude", "2.93"), ("B", "plot.latitude", "6.137"), ("A", "plot.x", "1")],
        "Site string, path string, value string",
    )
    plots = spark.createDataFrame([("A",), ("B",), ("C",)], "Site string")
    got = joins.attach_parameters(
        plots, parameters, "Site", {"latitude": "plot.latitude"}, defaults={"plot.latitude": 0.97}
    )
    assert rows(got, "Site") == [("A", 2.93), ("B", 6.137), ("C", 0.97)]


def test_baseline_is_matched_by_month(spark):
    months = spark.createDataFrame(
        [
            (1, 50, 6, D(2023, 7, 1), 10.0),
            (2, 50, 6, D(2023, 8, 1), 20.0),
            (1, 25, 6, D(2023, 7, 1), 5.0),
            (2, 25, 6, D(2023, 8, 1), 15.0),
            (3, 25, 6, D(2023, 9, 1), 15.0),
        ],
        "months_after_planting int, rank_leaves_left int, window_duration int, date date,"
        " biomass_bunch_harvested_cum double",
    )
    baseline = "rank_leaves_left = 50 AND window_duration = 6"
    relative = scenarios.scenario_relative(months, baseline, "2023-07-01")
    got = relative.select(
        "rank_leaves_left", "months_after_planting", "biomass_bunch_harvested_cum_rel"
    )
    assert rows(got, "rank_leaves_left", "months_after_planting") == [
        (25, 2, 0.75),
        (25, 3, None),
        (50, 2, 1.0),
    ]
    known = months.where("months_after_planting < 3")
    loss = scenarios.scenario_loss(known, baseline, "2023-07-01")
    assert rows(loss, "rank_leaves_left") == [(25, 6, 0.25), (50, 6, 0.0)]


def test_observations_beside_simulation(spark):
    observed = spark.createDataFrame(
        [("PR", "g", 1, D(2020, 1, 1), 2.0), ("PR", "g", 2, D(2020, 2, 1), 3.0),
         ("PR", "g", 3, D(2020, 3, 1), 4.0)],
        "site string, genotype string, months_after_planting int, date date, nb_leaves_emitted double",
    )
    months = spark.createDataFrame(
        [("PR", D(2020, 1, 1), 10.0, 1), ("PR", D(2020, 3, 1), 20.0, 5)],
        "Site string, date date, TEff double, phytomer_emitted int",
    )
    got = sites.compare_observations(observed, months).orderBy("date").collect()
    assert [r["nb_leaves_emitted_cum"] for r in got] == [2.0, 9.0]
    assert [r["nb_leaves_emitted_cum_sim"] for r in got] == [1, 6]
    assert [r["nb_leaves_emitted_per_TEff"] for r in got] == pytest.approx([0.2, 0.2])


# scenarios ----------------------------------------------------------------------------------


def test_grid_and_windows(spark):
    base = spark.createDataFrame([("PR", D(2023, 7, 1))], "Site string, day date")
    grid = scenario.scenario_grid(base, "day")
    assert grid.count() == 12
    ends = rows(grid.select("window_duration", "duration_label", "end_date").distinct(), "end_date")
    assert ends == [(6, "6 months", D(2024, 1, 1)), (12, "12 months", D(2024, 7, 1))]
    assert {r[0] for r in grid.select("rank_leaves_left").collect()} == {25, 30, 35, 40, 45, 50}


def test_window_end_prefers_the_given_one(spark):
    windows = spark.createDataFrame(
        [(1, D(2023, 7, 1), 6, None), (2, D(2023, 7, 1), 6, D(2023, 9, 1)), (3, D(2023, 7, 1), None, None)],
        "i int, start_date date, window_duration int, end_date date",
    )
    got = scenario.window_end(windows)
    assert [r["end_date"] for r in got.orderBy("i").collect()] == [D(2024, 1, 1), D(2023, 9, 1), None]
    assert [r["i"] for r in scenario.windows_without_end(windows).collect()] == [3]


def test_totals(spark):
    years = spark.createDataFrame(
        [(25, 6, 2022, 1e5, 1e5), (25, 6, 2023, 2e5, 3e5), (25, 6, 2024, 4e5, 7e5)],
        "rank_leaves_left int, window_duration int, year int, h double, cum double",
    )
    unit = 1e5 * 1e-6 / 0.4857 / 0.75 * 136
    assert scenario.total_at_end(years, "cum").first()["t_ha"] == pytest.approx(7 * unit)
    assert scenario.total_since(years, "h", 2023).first()["t_ha"] == pytest.approx(6 * unit)
    after = scenario.total_since(years, "h", 2023, strict=True).first()["t_ha"]
    assert after == pytest.approx(4 * unit)


def test_open_leaf_area_starts_the_day_after(spark):
    leaves = spark.createDataFrame(
        [(1, D(2023, 7, 1), "Opened", 25, 1.0), (2, D(2023, 7, 2), "Opened", 25, 2.0),
         (2, D(2023, 7, 2), "Opened", 25, 3.0), (2, D(2023, 7, 2), "Pruned", 25, 9.0),
         (2, D(2023, 7, 2), "Opened", 30, 9.0)],
        "timestep int, date date, state string, rank_leaves_left int, leaf_area double",
    )
    got = scenario.open_leaf_area(leaves, "2023-07-01", {"rank_leaves_left": 25})
    assert rows(got.select("timestep", "leaf_area"), "timestep") == [(2, 5.0)]


# scales -------------------------------------------------------------------------------------


def test_gather_and_broadcast(spark):
    leaf = spark.createDataFrame([("PR", 1, 2.0), ("PR", 1, 4.0)], "Site string, timestep int, Rm double")
    male = spark.createDataFrame([("PR", 1, 6.0), ("PR", 2, 1.0)], "Site string, timestep int, rm double")
    got = scales.scale_gather({"Leaf": leaf, "Male": male}, {"Leaf": "Rm", "Male": "rm"}, "Rm_organs")
    assert rows(got, "timestep") == [("PR", 1, 12.0, 4.0, 3), ("PR", 2, 1.0, 1.0, 1)]
    scene = spark.createDataFrame([("PR", 1, 9.0)], "Site string, timestep int, aPPFD double")
    spread = scales.scale_broadcast(leaf, scene, {"aPPFD_scene": "aPPFD"})
    assert [r["aPPFD_scene"] for r in spread.collect()] == [9.0, 9.0]


# checks -------------------------------------------------------------------------------------


def verdict(df):
    row = df.first()
    return row["ok"], row["n_bad"]


def test_checks_pass_and_fail(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 60.0), (2, -1.0)], "k int, x double")
    assert verdict(checks.check_non_negative(df, ["x", "k"])) == (False, 1)
    assert verdict(checks.check_non_negative(df, ["k"])) == (True, 0)
    assert verdict(checks.check_max_equals(df, "x", 60.0)) == (True, 0)
    assert verdict(checks.check_max_equals(df, "x", 61.0)) == (False, 1)
    assert verdict(checks.check_all(df, F.col("x") < 60)) == (False, 1)
    assert verdict(checks.check_unique_key(df, ["k"])) == (False, 1)
    assert verdict(checks.check_in_range(df.agg(F.avg("x").alias("m")), df.select("x"), "m")) == (True, 0)
    edge = spark.createDataFrame([(60.0,)], "m double")
    assert verdict(checks.check_in_range(edge, df.select("x"), "m")) == (False, 1)
    empty = df.where("k > 9")
    assert verdict(checks.check_non_negative(empty, ["x"])) == (True, 0)
    assert verdict(checks.check_max_equals(empty, "x", 60.0)) == (False, 1)


def test_tables_equal(spark):
    left = spark.createDataFrame([("a", 1), ("b", None), (None, 3)], "k string, n int")
    assert verdict(checks.check_tables_equal(left, left, ["k"])) == (True, 0)
    right = spark.createDataFrame([("a", 2), ("b", None), ("c", 3)], "k string, n int")
    # a differs, the NULL key and c have no partner
    assert verdict(checks.check_tables_equal(left, right, ["k"])) == (False, 3)


def test_tables_equal_compares_repeated_keys_as_multisets(spark):
    """A key with 10,000 rows costs no more than its rows, and one changed row is seen."""
    left = spark.range(10_000).select(F.lit("hot").alias("k"), (F.col("id") % 7).alias("n"), F.lit(None).cast("int").alias("m"))
    assert verdict(checks.check_tables_equal(left, left.orderBy(F.rand(3)), ["k"])) == (True, 0)
    changed = left.withColumn("n", F.when(F.col("n") == 3, 4).when(F.col("n") == 4, 3).otherwise(F.col("n")))
    assert verdict(checks.check_tables_equal(left, changed, ["k"])) == (False, 1)
    other = left.limit(9_999).unionByName(spark.createDataFrame([("hot", None, 2)], "k string, n long, m int"))
    assert verdict(checks.check_tables_equal(left, other, ["k"])) == (False, 1)
    swapped = left.select("k", F.col("m").cast("long").alias("n"), F.col("n").cast("int").alias("m"))
    assert verdict(checks.check_tables_equal(left, swapped, ["k"])) == (False, 1)


def test_tables_equal_has_no_join_of_rows(spark):
    left = spark.range(10).select("id", F.lit(0.0).alias("x"))
    right = left.withColumn("x", F.lit(-0.0))
    compared = checks.check_tables_equal(left, right, ["id"])
    assert verdict(compared) == (True, 0)
    plan = compared._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == plan.count("Join LeftSemi") > 0  # with the buckets that differ only


def test_window_end(spark):
    df = spark.createDataFrame([(6, None), (None, D(2020, 1, 1)), (None, None)], "window_duration int, end_date date")
    assert verdict(checks.check_window_end(df)) == (False, 1)
    assert verdict(checks.check_window_end(df.limit(0))) == (True, 0)


def test_common_period_skips_row_groups(spark, tmp_path):
    """The bounds reach the scan of the raw timestamps, which then reads a part of a sorted file."""
    day = lambda c: F.timestamp_seconds(F.col(c) * 86400 + 3600)
    wide = spark.range(4000).select(F.lit("a").alias("Site"), day("id").alias("at"))
    narrow = spark.range(1900, 2100).select(F.lit("b").alias("Site"), day("id").alias("at"))
    path = str(tmp_path / "sorted")
    rows_ = wide.unionByName(narrow).coalesce(1).sortWithinPartitions("at")
    rows_.write.option("parquet.block.size", 2048).option("parquet.page.row.count.limit", 100).parquet(path)
    df = spark.read.parquet(path).withColumn("date", F.col("at").cast("date"))
    found = joins.common_period(df, raw="at")
    want = joins.common_period(df).collect()
    assert sorted(found.collect()) == sorted(want) and len(want) == 400
    found.write.format("noop").mode("overwrite").save()
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "DataFilters" in line and "subquery" in line.lower())
    assert "at#" in scan[scan.index("DataFilters") :]


def test_state_counts_with_last_values(spark):
    rows = [("p", 1, "Opened", 5), ("p", 3, "Pruned", None), ("p", 2, None, 7), ("q", 1, "Opened", 8), (None, None, "Opened", 9)]
    df = spark.createDataFrame(rows, "plant string, timestep int, state string, month int")
    got = rollup.state_counts(df, ["plant"], {"opened": ["Opened"]}, decision="state", lasts={"last": "month"})
    # the last step counts even if its value is NULL; a group without any step has no last value
    assert {tuple(r) for r in got.collect()} == {("p", 1, 3, None), ("q", 1, 1, 8), (None, 1, 1, None)}
