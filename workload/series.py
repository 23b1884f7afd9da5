"""Order-dependent operators and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from agroseries.functions import constants as k
from agroseries.operators import reshape, series
from agroseries.plans.weather import day_blocks, hour_blocks
from workload import roles
from workload.registry import doubles, num, query
from workload.roles import FINE, FINE_ORDER, ORGANS, PERCENT, SERIES, SERIES_ORDER


@query(
    f"""
WITH {SERIES}
SELECT "Site", id, CAST(sum(x) OVER (PARTITION BY "Site" ORDER BY date, id
  ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS x_cum
FROM series"""
)
def running_sum(spark, sf):
    rows = roles.series(spark, sf).select("Site", "date", "id", "x")
    summed = series.running_sum(rows, ["Site"], SERIES_ORDER, {"x_cum": "x"}, day_blocks())
    return doubles(summed.select("Site", "id", "x_cum"))


@query(
    f"""
WITH {FINE}
SELECT event_id, node,
       1000 * (CAST(sum(value) OVER (PARTITION BY node ORDER BY ts, event_id
         ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 12330e0) * 1.44e0 AS carbon_demand
FROM fine"""
)
def cumulative_demand(spark, sf):
    rows = roles.fine(spark, sf).select("node", "ts", "event_id", "value")
    demand = series.cumulative_demand(rows, ["node"], FINE_ORDER, "value", hour_blocks("ts"))
    return demand.select("event_id", "node", "carbon_demand")


@query(
    f"""
WITH {FINE}, placed AS (
  SELECT node, event_id, row_number() OVER (PARTITION BY node ORDER BY ts, event_id) AS position
  FROM fine)
SELECT * FROM placed WHERE position BETWEEN 10 AND 20"""
)
def row_slice(spark, sf):
    rows = roles.fine(spark, sf).select("node", "ts", "event_id")
    return series.row_slice(rows, ["node"], FINE_ORDER, 10, 20, hour_blocks("ts")).drop("ts")


@query(
    f"""
WITH {SERIES}, placed AS (
  SELECT "Site", id, date, row_number() OVER (PARTITION BY "Site" ORDER BY date, id) AS position
  FROM series)
SELECT * FROM placed WHERE position = 1460"""
)
def nth_row(spark, sf):
    rows = roles.series(spark, sf).select("Site", "date", "id")
    return series.nth_row(rows, ["Site"], SERIES_ORDER, 1460, day_blocks())


@query(
    f"""
WITH {FINE}
SELECT event_id, node, CAST(lag(value, 1, 0) OVER (PARTITION BY node ORDER BY ts, event_id)
  AS DOUBLE) AS value_before,
  lag(state) OVER (PARTITION BY node ORDER BY ts, event_id) AS state_before
FROM fine"""
)
def lag_step(spark, sf):
    rows = roles.fine(spark, sf).select("node", "ts", "event_id", "value", "state")
    lagged = series.lag_step(
        rows,
        ["node"],
        FINE_ORDER,
        {"value_before": "value", "state_before": "state"},
        {"value_before": 0},
        hour_blocks("ts"),
    )
    return doubles(lagged.select("event_id", "node", "value_before", "state_before"))


# step by step: the stock takes the amount in, and one unit out when it holds one
COUNTER = """
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS t FROM increments),
counted AS (
  SELECT {keys}, event_id, t, CAST(1 + (amount >= 1)::INT AS BIGINT) AS emitted,
         CAST(amount - (amount >= 1)::INT AS DECIMAL(38,9)) AS stock
  FROM numbered WHERE t = 1
  UNION ALL
  SELECT {named}, n.event_id, n.t, c.emitted + (c.stock + n.amount >= 1)::INT,
         CAST(c.stock + n.amount - (c.stock + n.amount >= 1)::INT AS DECIMAL(38,9))
  FROM counted c JOIN numbered n ON {same} AND n.t = c.t + 1)"""
ONE = {"keys": "node", "named": "n.node", "same": "n.node = c.node"}
SWEPT = {
    "keys": "param_id, node",
    "named": "n.param_id, n.node",
    "same": "n.node = c.node AND n.param_id = c.param_id",
}


@query(
    f"""
WITH RECURSIVE {FINE}, increments AS (
  SELECT node, ts, event_id, CAST(value * 0.01 AS DECIMAL(18,9)) AS amount FROM fine),
{COUNTER.format(**ONE)}
SELECT event_id, node, emitted FROM counted"""
)
def emission_counter(spark, sf):
    rows = roles.fine(spark, sf).select("node", "ts", "event_id", "value")
    counted = series.emission_counter(
        rows, ["node"], FINE_ORDER, F.col("value") * F.lit(PERCENT), hour_blocks("ts")
    )
    return counted.select("event_id", "node", "emitted")


SETS = [
    {"param_id": "default", "speed_initial": 0.0111, "speed_mature": 0.0074},
    {"param_id": "slow", "speed_initial": 0.0050, "speed_mature": 0.0040},
]
_RAMP = (
    "CASE WHEN age <= 0 THEN speed_initial WHEN age >= 2920 THEN speed_mature"
    " ELSE speed_initial + (age - 0e0) * (speed_mature - speed_initial) / 2920e0 END"
)
_SETS = ", ".join(
    f"('{s['param_id']}', {num(s['speed_initial'])}, {num(s['speed_mature'])})" for s in SETS
)


@query(
    f"""
WITH RECURSIVE sets(param_id, speed_initial, speed_mature) AS (VALUES {_SETS}),
observed AS (
  SELECT user_id AS node, ts, event_id, CAST(value AS DOUBLE) AS teff,
         (CAST(ts AS DATE) - DATE '2024-01-01') * 110 AS age, (event_id % 10) / 10e0 AS ftsw
  FROM events),
increments AS (
  SELECT param_id, node, ts, event_id,
         CAST(teff * ({_RAMP}) * CASE WHEN ftsw > 0.3e0 THEN 1e0 ELSE ftsw / 0.3e0 END
           AS DECIMAL(18,9)) AS amount
  FROM observed CROSS JOIN sets),
{COUNTER.format(**SWEPT)}
SELECT param_id, event_id, node, emitted FROM counted"""
)
def emission_sweep(spark, sf):
    observed = roles.read(spark, sf, "events").select(
        F.col("user_id").alias("node"),
        "ts",
        "event_id",
        F.col("value").alias("TEff"),
        (F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) * 110).alias(
            "plant_age"
        ),
        ((F.col("event_id") % 10) / 10.0).alias("ftsw"),
    )
    increment = series.emission_increment(
        speed_initial=F.col("speed_initial"), speed_mature=F.col("speed_mature")
    )
    swept = series.emission_sweep(
        observed, ["node"], FINE_ORDER, increment, SETS, hour_blocks("ts")
    )
    return swept.select("param_id", "event_id", "node", "emitted")


@query(
    f"""
WITH {SERIES}, stepped AS (
  SELECT id, row_number() OVER (PARTITION BY "Site" ORDER BY date, id) AS timestep FROM series)
SELECT id, CASE WHEN timestep <= 100 THEN 0.3e0 WHEN timestep >= 3000 THEN 1e0
  ELSE 0.3e0 + (timestep - 100e0) * (1e0 - 0.3e0) / 2900e0 END * {k.FRUIT_NUMBER_MATURE} AS nfruits
FROM stepped"""
)
def age_ramp(spark, sf):
    rows = roles.series(spark, sf).select("Site", "date", "id")
    ramp = series.age_ramp_series(
        rows, ["Site"], SERIES_ORDER, age_start=100.0, age_end=3000.0, blocks=day_blocks()
    )
    return ramp.select("id", "nfruits")


@query(f"WITH {SERIES} SELECT \"Site\", date, id FROM series ORDER BY ALL")
def sort_output(spark, sf):
    rows = roles.series(spark, sf).select("Site", "date", "id")
    return reshape.sort_output(rows, "Site", "date", "id")


@query("SELECT DISTINCT upper(substring(p_type, 1, 1)) || p_name AS name FROM part ORDER BY lower(name)")
def sort_ci(spark, sf):
    initial = F.upper(F.substring("p_type", 1, 1))
    names = roles.read(spark, sf, "part").select(F.concat(initial, "p_name").alias("name"))
    return reshape.sort_ignoring_case(names.distinct(), "name")


@query(
    f"""
WITH {ORGANS}
SELECT node, id, line, timestep, 6 AS window_duration FROM organs WHERE "Site" = 'O'
UNION ALL
SELECT node, id, line, timestep, 12 FROM organs WHERE "Site" = 'F'"""
)
def union_scenarios(spark, sf):
    rows = roles.organs(spark, sf).select("Site", "node", "id", "line", "timestep")
    frames = {
        6: rows.where(F.col("Site") == "O").drop("Site"),
        12: rows.where(F.col("Site") == "F").drop("Site"),
    }
    return reshape.unite_tagged(frames, "window_duration")
