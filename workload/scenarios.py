"""Scenario grids and comparisons."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from agroseries.functions import constants as k
from agroseries.operators import scenario
from agroseries.operators.series import running_sum
from agroseries.plans import scenarios
from workload import roles
from workload.registry import doubles, num, query
from workload.roles import MONTHS, SCENARIO_PLANTS, SERIES

AREA, FRESH = num(k.SCENE_AREA_M2), num(k.DRY_TO_FRESH)
T_HA = f"* 1e-6 / 0.4857e0 * {FRESH} / {AREA} * 10000"
BASELINE = "rank_leaves_left = 50 AND window_duration = 6"


@query(
    f"""
WITH {SERIES},
starts AS (SELECT node, min(date) AS start_date FROM series GROUP BY 1),
grid AS (
  SELECT node, CAST(rank AS INTEGER) AS rank_leaves_left, start_date,
         CAST(duration AS INTEGER) AS window_duration
  FROM starts, range(25, 51, 5) r(rank), (VALUES (6), (12)) d(duration))
SELECT *, window_duration || ' months' AS duration_label,
       CAST(start_date + INTERVAL (window_duration) MONTH AS DATE) AS end_date
FROM grid"""
)
def scenario_grid(spark, sf):
    starts = roles.series(spark, sf).groupBy("node").agg(F.min("date").alias("_start"))
    return scenario.scenario_grid(starts, "_start").drop("_start")


@query(
    f"""
WITH {MONTHS},
days AS (
  SELECT DISTINCT "Site", date, months_after_planting FROM months
  UNION ALL SELECT DISTINCT "Site", date, months_after_planting FROM months WHERE day(date) = 13),
calendar AS (
  SELECT "Site", date, min(months_after_planting) AS m, count(*) AS n FROM days GROUP BY 1, 2),
windows AS (
  SELECT node, "Site", min(date) AS start_date, d AS window_duration,
         CAST(min(date) + INTERVAL (d) MONTH AS DATE) AS end_date
  FROM series, (VALUES (6), (12)) v(d) GROUP BY node, "Site", d)
SELECT w.node, w."Site", w.window_duration, w.start_date, w.end_date,
       CASE WHEN a.n = 1 THEN a.m END AS start_map, CASE WHEN b.n = 1 THEN b.m END AS end_map
FROM windows w
LEFT JOIN calendar a ON w."Site" = a."Site" AND w.start_date = a.date
LEFT JOIN calendar b ON w."Site" = b."Site" AND w.end_date = b.date"""
)
def window_bounds(spark, sf):
    days = roles.months(spark, sf).select("Site", "date", "months_after_planting").distinct()
    calendar = days.unionByName(days.where(F.dayofmonth("date") == 13))  # the 13th is there twice
    starts = roles.series(spark, sf).groupBy("node", "Site").agg(F.min("date").alias("start_date"))
    windows = scenario.window_end(
        starts.withColumn(
            "window_duration", F.explode(F.array(*[F.lit(d) for d in k.SCENARIO_DURATIONS_MONTHS]))
        )
    )
    return scenario.window_bounds(windows, calendar, keys=["Site"])


REL = f"""{SCENARIO_PLANTS},
scenario_months AS (
  SELECT months_after_planting, rank_leaves_left, window_duration,
         CAST(date_trunc('month', min(date)) AS DATE) AS date,
         max(timestep) - min(timestep) + 1 AS nb_timesteps,
         CAST(sum(biomass_bunch_harvested) AS DOUBLE) AS biomass_bunch_harvested_monthly,
         CAST(arg_max(biomass_bunch_harvested_cum, timestep) AS DOUBLE)
           AS biomass_bunch_harvested_cum
  FROM scenario_plants GROUP BY 1, 2, 3),
relative AS (
  SELECT s.*, s.biomass_bunch_harvested_cum / b.biomass_bunch_harvested_cum
           AS biomass_bunch_harvested_cum_rel
  FROM scenario_months s
  LEFT JOIN (SELECT * FROM scenario_months WHERE rank_leaves_left = 50 AND window_duration = 6) b
    ON s.months_after_planting = b.months_after_planting
  WHERE s.date > DATE '1998-07-01')"""


@query(f"WITH {REL} SELECT * FROM relative")
def relative_to_baseline(spark, sf):
    months = scenarios.scenario_months(roles.scenario_plants(spark, sf))
    return doubles(scenarios.scenario_relative(months, BASELINE, "1998-07-01"))


@query(
    f"""
WITH {REL}
SELECT rank_leaves_left, window_duration,
       1.0e0 - last(biomass_bunch_harvested_cum_rel ORDER BY months_after_planting) AS loss
FROM relative GROUP BY 1, 2"""
)
def scenario_loss(spark, sf):
    months = scenarios.scenario_months(roles.scenario_plants(spark, sf))
    return scenarios.scenario_loss(months, BASELINE, "1998-07-01")


YEARS = f"""{SCENARIO_PLANTS},
scenario_years AS (
  SELECT rank_leaves_left, window_duration, year(date) AS year,
         sum(biomass_bunch_harvested) AS biomass_bunch_harvested,
         arg_max(biomass_bunch_harvested_cum, timestep) AS biomass_bunch_harvested_cum
  FROM scenario_plants GROUP BY 1, 2, 3)"""


@query(
    f"""
WITH {YEARS}
SELECT rank_leaves_left, window_duration,
       CAST(arg_max(biomass_bunch_harvested_cum, year) AS DOUBLE) {T_HA} AS t_ha
FROM scenario_years GROUP BY 1, 2"""
)
def scenario_total(spark, sf):
    years = scenarios.scenario_years(roles.scenario_plants(spark, sf))
    return scenario.total_at_end(years, "biomass_bunch_harvested_cum")


@query(
    f"""
WITH {YEARS}
SELECT rank_leaves_left, window_duration,
       CAST(sum(biomass_bunch_harvested) AS DOUBLE) {T_HA} AS t_ha
FROM scenario_years WHERE year > 1998 GROUP BY 1, 2"""
)
def scenario_after_window(spark, sf):
    years = scenarios.scenario_years(roles.scenario_plants(spark, sf))
    return scenario.total_since(years, "biomass_bunch_harvested", 1998, strict=True)


@query(
    f"""
WITH {YEARS}
SELECT rank_leaves_left, window_duration,
       CAST(sum(biomass_bunch_harvested) AS DOUBLE) {T_HA} AS t_ha
FROM scenario_years WHERE year >= 1998 GROUP BY 1, 2"""
)
def scenario_since_window(spark, sf):
    years = scenarios.scenario_years(roles.scenario_plants(spark, sf))
    return scenario.total_since(years, "biomass_bunch_harvested", 1998)


FULL = f"""{SCENARIO_PLANTS},
outputs AS (
  SELECT *, timestep % 5 AS n_bunches_harvested, biomass_bunch_harvested * 0.5 AS biomass_fruit_harvested,
         CAST(sum(timestep % 5) OVER w AS BIGINT) AS n_bunches_harvested_cum,
         CAST(sum(timestep % 3) OVER w AS BIGINT) AS phytomer_count
  FROM scenario_plants
  WINDOW w AS (PARTITION BY rank_leaves_left, window_duration ORDER BY date ROWS UNBOUNDED PRECEDING))"""


def outputs(spark, sf):
    """Scenario outputs with bunches, fruit and phytomers, one row per scenario and day."""
    plants = roles.scenario_plants(spark, sf).withColumns(
        {
            "n_bunches_harvested": F.col("timestep") % 5,
            "_emitted": F.col("timestep") % 3,
            "biomass_fruit_harvested": F.col("biomass_bunch_harvested") * F.lit(Decimal("0.5")),
        }
    )
    sums = {"n_bunches_harvested_cum": "n_bunches_harvested", "phytomer_count": "_emitted"}
    return running_sum(plants, ["rank_leaves_left", "window_duration"], ["timestep"], sums)


@query(
    f"""
WITH {FULL}
SELECT months_after_planting, rank_leaves_left, window_duration,
       CAST(date_trunc('month', min(date)) AS DATE) AS date,
       max(timestep) - min(timestep) + 1 AS nb_timesteps,
       CAST(sum(biomass_bunch_harvested) AS DOUBLE) AS biomass_bunch_harvested_monthly,
       CAST(arg_max(biomass_bunch_harvested_cum, timestep) AS DOUBLE) AS biomass_bunch_harvested_cum,
       CAST(sum(n_bunches_harvested) AS BIGINT) AS n_bunches_harvested_monthly,
       arg_max(n_bunches_harvested_cum, timestep) AS n_bunches_harvested_cum,
       arg_max(phytomer_count, timestep) AS phytomer_count,
       arg_max(phytomer_count, timestep) - arg_min(phytomer_count, timestep) AS phytomer_emitted
FROM outputs GROUP BY 1, 2, 3"""
)
def scenario_months(spark, sf):
    return doubles(scenarios.scenario_months(outputs(spark, sf)))


@query(
    f"""
WITH {FULL}
SELECT rank_leaves_left, window_duration, CAST(year(date) AS INTEGER) AS year,
       max(timestep) - min(timestep) + 1 AS nb_timesteps,
       CAST(sum(biomass_bunch_harvested) AS DOUBLE) AS biomass_bunch_harvested,
       CAST(sum(biomass_fruit_harvested) AS DOUBLE) AS biomass_fruit_harvested,
       CAST(arg_max(biomass_bunch_harvested_cum, timestep) AS DOUBLE) AS biomass_bunch_harvested_cum,
       CAST(sum(biomass_bunch_harvested) AS DOUBLE) {T_HA} AS ffb_t_ha,
       CAST(sum(biomass_fruit_harvested) AS DOUBLE) {T_HA} AS fruit_t_ha
FROM outputs GROUP BY 1, 2, year(date)"""
)
def scenario_years(spark, sf):
    return doubles(scenarios.scenario_years(outputs(spark, sf)))


@query(
    f"""
WITH scenario_leaves AS (
  SELECT CAST(25 + 5 * ((l_linenumber - 1) % 6) AS INTEGER) AS rank_leaves_left,
         CASE WHEN l_linestatus = 'O' THEN 6 ELSE 12 END AS window_duration,
         CAST(CAST(l_shipdate AS DATE) - DATE '1995-01-01' AS INTEGER) AS timestep,
         CAST(l_shipdate AS DATE) AS date, CAST(l_quantity AS DECIMAL(18,2)) AS leaf_area, l_returnflag
  FROM lineitem)
SELECT timestep, CAST(sum(leaf_area) AS DOUBLE) AS leaf_area,
       CAST(sum(leaf_area) AS DOUBLE) / {AREA} AS lai_opened
FROM scenario_leaves
WHERE l_returnflag = 'N' AND date >= DATE '1997-07-02' AND rank_leaves_left = 25 AND window_duration = 6
GROUP BY 1 ORDER BY 1"""
)
def scenario_open_leaf_area(spark, sf):
    date = F.col("l_shipdate").cast("date")
    leaves = roles.read(spark, sf, "lineitem").select(
        (25 + 5 * ((F.col("l_linenumber") - 1) % 6)).cast("int").alias("rank_leaves_left"),
        F.when(F.col("l_linestatus") == "O", 6).otherwise(12).alias("window_duration"),
        date.alias("date"),
        roles.step_of(date).alias("timestep"),
        F.when(F.col("l_returnflag") == "N", k.OPENED).otherwise(k.PRUNED).alias("state"),
        F.col("l_quantity").cast(roles.MONEY).alias("leaf_area"),
    )
    chosen = {"rank_leaves_left": 25, "window_duration": 6}
    return doubles(scenario.open_leaf_area(leaves, "1997-07-01", chosen))
