"""Rules against loops that go through the steps one by one."""

import datetime as dt
import random

from pyspark.sql import functions as F

from agroseries.functions import constants as k
from agroseries.operators import rules

START, END = dt.date(2023, 7, 1), dt.date(2024, 1, 1)
FIRST = dt.date(2023, 5, 1)


def leaf_rows(n_leaves=60, n_steps=120, seed=3):
    rng = random.Random(seed)
    rows = []
    for node in range(n_leaves):
        rank = rng.randrange(-5, 45)
        for step in range(n_steps):
            rank += rng.random() < 0.3
            state = rng.choice(["Opened"] * 60 + ["Pruned"]) if rank > 0 else "undetermined"
            day = FIRST + dt.timedelta(days=3 * step)
            rows.append(("PR", node, step, day, rank, state, float(step), 2.0, 3.0 + step))
    return rows


SCHEMA = (
    "Site string, node long, timestep int, date date, rank int, state string,"
    " leaf_area double, reserve double, biomass double"
)


def loop(rows, rank_max, rank_window, start, end):
    """Decision, litter and values of every row, one leaf and one step at a time."""
    out, pruned = {}, {}
    for site, node, step, day, rank, state, area, reserve, biomass in sorted(rows, key=lambda r: r[:3]):
        key = (site, node)
        if key not in pruned:
            window = rank >= rank_window and start <= day <= end
            if window or rank > rank_max or state == "Pruned":
                label = (
                    k.PRUNED_IN_WINDOW
                    if window
                    else k.PRUNED_AT_RANK
                    if rank > rank_max
                    else k.PRUNED_AT_HARVEST
                )
                pruned[key] = (label, biomass, step)
        if key in pruned:
            label, litter, _ = pruned[key]
            out[(*key, step)] = (label, True, "Pruned", 0.0, 0.0, 0.0, litter)
        else:
            out[(*key, step)] = (k.UNDETERMINED, False, state, area, biomass, reserve, None)
    return out, pruned


def test_prune_effects_follow_the_loop(spark):
    rows = leaf_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {
        (r["Site"], r["node"], r["timestep"]): (
            r["pruning_decision"],
            r["is_pruned"],
            r["state"],
            r["leaf_area"],
            r["biomass"],
            r["reserve"],
            r["litter_leaf"],
        )
        for r in rules.prune_effects(df, 25, START, END, rank_max=40).collect()
    }
    want, pruned = loop(rows, 40, 25, START, END)
    assert got == want
    assert {p[0] for p in pruned.values()} == {
        k.PRUNED_IN_WINDOW,
        k.PRUNED_AT_RANK,
        k.PRUNED_AT_HARVEST,
    }


def test_prune_decision_replaces_an_old_one(spark):
    rows = leaf_rows(10, 20)
    df = spark.createDataFrame(rows, SCHEMA)
    old = df.withColumn("pruning_decision", F.lit("old"))
    got = rules.prune_decision(old, 25, START, END)
    assert got.columns.count("pruning_decision") == 1
    assert got.where(F.col("pruning_decision") == "old").count() == 0


def test_label_order_on_one_day(spark):
    """Window before rank before harvest when several conditions hold on the same day."""
    day = dt.date(2023, 8, 1)
    rows = [
        ("PR", 1, 1, day, 60, "Pruned", 1.0, 1.0, 1.0),
        ("PR", 2, 1, dt.date(2023, 1, 1), 60, "Pruned", 1.0, 1.0, 1.0),
        ("PR", 3, 1, dt.date(2023, 1, 1), 5, "Pruned", 1.0, 1.0, 1.0),
        ("PR", 4, 1, day, 5, "Opened", 1.0, 1.0, 1.0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = rules.prune_decision(df, 25, START, END).orderBy("node").collect()
    assert [r["pruning_decision"] for r in got] == [
        k.PRUNED_IN_WINDOW,
        k.PRUNED_AT_RANK,
        k.PRUNED_AT_HARVEST,
        k.UNDETERMINED,
    ]


def test_prune_sweep_is_the_rule_per_scenario(spark):
    rows = leaf_rows(40, 100, seed=5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    scenarios = [
        {
            "rank_leaves_left": rank,
            "window_duration": months,
            "start_date": START,
            "end_date": END if months == 6 else dt.date(2024, 7, 1),
        }
        for rank in (25, 35)
        for months in (6, 12)
    ]
    got = {
        (r["node"], r["rank_leaves_left"], r["window_duration"]): (
            r["fired_at"],
            r["pruning_decision"],
        )
        for r in rules.prune_sweep(df, scenarios, rank_max=45).collect()
    }
    assert len(got) == 40 * 4
    for s in scenarios:
        _, pruned = loop(rows, 45, s["rank_leaves_left"], START, s["end_date"])
        for node in range(40):
            label, _, step = pruned.get(("PR", node), (k.UNDETERMINED, None, None))
            assert got[(node, s["rank_leaves_left"], s["window_duration"])] == (step, label)


def test_pruning_reads_the_table_once_and_blocks_do_not_show(spark, tmp_path):
    rows = leaf_rows(20, 60)
    rows += [("PR", None, step, *rest) for _, node, step, *rest in rows if node == 3]
    rows += [("PR", 99, None, START, 60, "Opened", 1.0, 2.0, 3.0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "leaf"))
    df = spark.read.parquet(str(tmp_path / "leaf"))
    whole = rules.prune_effects(df, 25, START, END, rank_max=40)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    months = {"_month": F.trunc("date", "month")}
    cut = rules.prune_effects(df, 25, START, END, rank_max=40, blocks=months)
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))
    assert not whole.where("node = 99").first()["is_pruned"]
    assert whole.where("node IS NULL").count() == 60


def test_prune_sweep_of_a_large_scenario_table(spark):
    rows = leaf_rows(6, 60, seed=9)
    rng = random.Random(1)
    table = []
    for k_ in range(1000):
        start = FIRST + dt.timedelta(days=rng.randrange(-20, 200))
        table.append((rng.randrange(-5, 50), k_, start, start + dt.timedelta(days=rng.randrange(-5, 90))))
    table += [(None, 1000, START, END), (25, 1001, None, END)]
    names = "rank_leaves_left int, window_duration int, start_date date, end_date date"
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    swept = rules.prune_sweep(df, spark.createDataFrame(table, names), rank_max=45, parts=3)
    got = {(r["node"], r["window_duration"]): (r["fired_at"], r["pruning_decision"]) for r in swept.collect()}
    assert len(got) == swept.count() == 6 * 1002
    for least, number, start, end in table:
        known = least is not None and start is not None
        _, pruned = loop(rows, 45, least if known else 10**6, start or START, end)
        for node in range(6):
            label, _, step = pruned.get(("PR", node), (k.UNDETERMINED, None, None))
            assert got[(node, number)] == (step, label)


def test_prune_sweep_of_nothing(spark):
    df = spark.createDataFrame(leaf_rows(2, 5), SCHEMA)
    assert rules.prune_sweep(df, []).count() == 0
    one = [{"rank_leaves_left": 1, "window_duration": 6, "start_date": START, "end_date": END}]
    assert rules.prune_sweep(df.limit(0), [*one, *one]).count() == 0
    assert rules.prune_sweep(df, [*one, *one]).count() == 4


def test_inflorescence_thresholds(spark):
    rows = [
        ("Male", 6300.0, 1, 0, "undetermined", "undetermined"),
        ("Male", 6300.1, 1, 0, "undetermined", k.FLOWERING),
        ("Male", 8100.1, 1, 0, "undetermined", k.SENESCENT),
        ("Female", 6300.0, 1, 0, "undetermined", k.FLOWERING),
        ("Female", 7794.0, 1, 0, "undetermined", k.OLEOSYNTHESIS),
        ("Female", 12150.0, 1, 0, "undetermined", k.HARVESTED),
        ("Female", 100.0, 25, 2190, "undetermined", k.HARVESTED),
        ("Female", 100.0, 24, 2190, "undetermined", "undetermined"),
        ("Female", 100.0, 25, 2374, "undetermined", "undetermined"),
        ("Male", 100.0, 25, 2200, "undetermined", "undetermined"),
        ("Female", 20000.0, 25, 2200, k.ABORTED, k.ABORTED),
        ("undetermined", 20000.0, 1, 0, "undetermined", "undetermined"),
    ]
    df = spark.createDataFrame(
        rows, "sex string, TT_since_init double, rank int, plant_age int, state string, want string"
    )
    got = rules.inflorescence_state(df).collect()
    assert [r["state"] for r in got] == [r["want"] for r in got]
    assert [r["leaf_harvested"] for r in got] == [
        False, False, False, False, False, True, True, False, False, True, True, False,
    ]


def test_harvest_reaches_phytomer_and_single_inflorescence(spark):
    edges = spark.createDataFrame(
        [
            (10, 1, "Internode"), (11, 10, "Leaf"), (12, 10, "Female"),
            (20, 2, "Internode"), (21, 20, "Leaf"), (22, 20, "Female"), (23, 20, "Male"),
            (30, 3, "Internode"), (31, 30, "Leaf"),
            (40, 4, "Internode"), (41, 40, "Leaf"), (42, 40, "Male"),
        ],
        "node long, parent long, symbol string",
    )
    pruned = spark.createDataFrame([(11,), (21,), (31,)], "node long")
    got = {r["node"] for r in rules.propagate_harvest(pruned, edges).collect()}
    assert got == {1, 2, 3, 12}


def test_harvest_by_marks_on_the_edges_and_repeated_edges(spark):
    """One read of the edges; an edge given twice is one edge; no join is planned."""
    edges = spark.createDataFrame(
        [
            (10, 1, "Internode", None), (11, 10, "Leaf", True), (12, 10, "Female", False), (12, 10, "Female", False),
            (20, 2, "Internode", False), (21, 20, "Leaf", False), (22, 20, "Female", False),
            (31, 30, "Leaf", True), (33, 30, "Male", None),
            (None, 40, "Leaf", True), (40, 4, "Internode", False), (51, None, "Leaf", True), (1, None, "Phytomer", False),
        ],
        "node long, parent long, symbol string, cut boolean",
    )
    reached = rules.propagate_harvest("cut", edges)
    assert {(r["node"], r["state"]) for r in reached.collect()} == {(n, "Harvested") for n in (1, 12, 33, 4)}
    plan = rules.propagate_harvest("cut", edges)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 3
    assert rules.propagate_harvest("cut", edges.limit(0)).count() == 0
    marks = spark.createDataFrame([(None,), (31,)], "node long")
    assert {r["node"] for r in rules.propagate_harvest(marks, edges.drop("cut")).collect()} == {33}


def test_leaves_with_null_keys_are_pruned(spark):
    rows = [(None, 1, 1, 60, "Opened", "2020-01-01"), (None, 1, 2, 60, "Opened", "2020-01-02")]
    df = spark.createDataFrame(rows, "Site string, node int, timestep int, rank int, state string, date string")
    df = df.withColumn("date", F.col("date").cast("date"))
    decided = rules.prune_decision(df, 30, "2021-01-01", "2021-02-01", rank_max=45)
    assert {r["pruning_decision"] for r in decided.collect()} == {"Pruned at rank"}
    swept = rules.prune_sweep(
        df, [{"rank_leaves_left": 30, "window_duration": 6, "start_date": "2021-01-01", "end_date": "2021-02-01"}], rank_max=45
    )
    assert [r["pruning_decision"] for r in swept.collect()] == ["Pruned at rank"]


def test_rows_without_a_date_stay_when_years_are_copied(spark):
    from agroseries.operators.reshape import extend_years

    df = spark.createDataFrame([(None, 1), ("2020-02-29", 2)], "d string, x int").select(F.col("d").cast("date").alias("date"), "x")
    copies = [("2020-01-01", "2020-12-31", k) for k in range(1, 13)]
    got = sorted((str(r[0]), r[1]) for r in extend_years(df, copies).collect())
    assert got[-1] == ("None", 1) and len(got) == 14
    assert len(extend_years(df, copies, start="2021-01-01").collect()) == 13


def test_nan_in_expressions(spark):
    import math

    from agroseries.functions import columns as c

    row = spark.createDataFrame([(float("nan"),)], "x double").select(
        c.clamp_zero("x").alias("clamped"), c.water_stress("x").alias("stress")
    ).first()
    assert row["clamped"] == 0 and math.isnan(row["stress"])
