"""Filters and group aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from agroseries.functions import columns as c
from agroseries.functions import constants as k
from agroseries.operators import rollup, scenario
from agroseries.operators.series import month_index
from agroseries.plans import sites
from agroseries.sources.shared import saved
from workload import roles
from workload.registry import doubles, num, query
from workload.roles import FINE, LEAVES, MONTHS, ORGANS, PLANTS, SCENARIO_PLANTS, SERIES

AREA, FRESH = num(k.SCENE_AREA_M2), num(k.DRY_TO_FRESH)
LEAF_T_HA = f"* 1e-6 / 0.45e0 / {AREA} * 10000"

ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]


@query(f"SELECT {', '.join(ROW)} FROM lineitem WHERE l_partkey = 6 OR l_returnflag = 'A'")
def filter_eq(spark, sf):
    chosen = (F.col("l_partkey") == 6) | (F.col("l_returnflag") == "A")
    return roles.read(spark, sf, "lineitem").where(chosen).select(*ROW)


@query(f"SELECT {', '.join(ROW)} FROM lineitem WHERE l_quantity > 40")
def filter_range(spark, sf):
    return roles.read(spark, sf, "lineitem").where(F.col("l_quantity") > 40).select(*ROW)


@query(
    f"""
SELECT {', '.join(ROW)} FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate <= TIMESTAMP '1999-12-31'
  AND l_linestatus = 'O' AND l_returnflag IN ('A', 'R')"""
)
def filter_and(spark, sf):
    # compared as timestamps, the type of the column, so that the bounds reach the file statistics
    bounds = [F.lit(day).cast("timestamp_ntz") for day in ("1998-01-01", "1999-12-31")]
    chosen = (
        F.col("l_shipdate").between(*bounds)
        & (F.col("l_linestatus") == "O")
        & F.col("l_returnflag").isin("A", "R")
    )
    return roles.read(spark, sf, "lineitem").where(chosen).select(*ROW)


@query(
    f"""
WITH {MONTHS}
SELECT "Site", months_after_planting, CAST(sum(x) AS DOUBLE) / count(x) AS lai
FROM months GROUP BY 1, 2"""
)
def month_mean(spark, sf):
    keys = ["Site", "months_after_planting"]
    return rollup.rollup(roles.months(spark, sf), keys, means={"lai": "x"})


@query(
    f"""
WITH {MONTHS}
SELECT yearmonth, CAST(sum(x) AS DOUBLE) AS x_sum FROM months GROUP BY 1"""
)
def month_sum(spark, sf):
    return doubles(rollup.rollup(roles.months(spark, sf), ["yearmonth"], sums={"x_sum": "x"}))


@query(
    f"""
WITH {PLANTS}
SELECT "Site", months_after_planting,
       CAST(date_trunc('month', arg_min(date, timestep)) AS DATE) AS date,
       max(timestep) - min(timestep) + 1 AS nb_timesteps,
       CAST(sum("TEff") AS DOUBLE) AS "TEff",
       CAST(sum(biomass_bunch_harvested) AS DOUBLE) AS biomass_bunch_harvested_monthly,
       CAST(sum(n_bunches_harvested) AS BIGINT) AS n_bunches_harvested_monthly,
       CAST(arg_max(biomass_bunch_harvested_cum, timestep) AS DOUBLE) AS biomass_bunch_harvested_cum,
       CAST(arg_max(n_bunches_harvested_cum, timestep) AS BIGINT) AS n_bunches_harvested_cum,
       CAST(arg_max(phytomer_count, timestep) AS BIGINT) AS phytomer_count,
       CAST(arg_max(phytomer_count, timestep) - arg_min(phytomer_count, timestep) AS BIGINT)
         AS phytomer_emitted,
       CAST(sum(biomass_bunch_harvested) AS DOUBLE) * 1e-3 / 0.4857e0 * {FRESH} AS ffb_kg
FROM plants GROUP BY 1, 2"""
)
def month_rollup(spark, sf):
    return doubles(sites.plant_months(roles.plants(spark, sf)))


@query(
    f"""
WITH {PLANTS}
SELECT "Site", months_after_planting,
       CAST(date_trunc('month', arg_min(date, timestep)) AS DATE) AS date,
       max(timestep) - min(timestep) + 1 AS nb_timesteps,
       CAST(sum("TEff") AS DOUBLE) AS "TEff",
       CAST(sum(biomass_bunch_harvested) AS DOUBLE) AS biomass_bunch_harvested_monthly,
       CAST(sum(n_bunches_harvested) AS BIGINT) AS n_bunches_harvested_monthly,
       CAST(arg_max(biomass_bunch_harvested_cum, timestep) AS DOUBLE) AS biomass_bunch_harvested_cum,
       CAST(arg_max(n_bunches_harvested_cum, timestep) AS BIGINT) AS n_bunches_harvested_cum,
       CAST(arg_max(phytomer_count, timestep) AS BIGINT) AS phytomer_count,
       CAST(arg_max(phytomer_count, timestep) - arg_min(phytomer_count, timestep) AS BIGINT)
         AS phytomer_emitted,
       CAST(sum(biomass_bunch_harvested) AS DOUBLE) * 1e-3 / 0.4857e0 * {FRESH} AS ffb_kg
FROM plants GROUP BY 1, 2"""
)
def site_months(spark, sf):
    """Outputs of all sites, joined to the weather by step, rolled up. The plants are made once."""
    plants = saved(roles.plants(spark, sf), "plants")
    weather = plants.select("Site", "timestep", "date", "months_after_planting", "TEff")
    output = plants.drop("date", "months_after_planting", "TEff")
    return doubles(sites.plant_months(output, weather))


@query(
    f"""
WITH {PLANTS}
SELECT "Site", CAST(year(date) AS INTEGER) AS year,
       max(timestep) - min(timestep) + 1 AS nb_timesteps,
       CAST(sum("TEff") AS DOUBLE) AS "TEff",
       CAST(sum(biomass_bunch_harvested) AS DOUBLE) AS biomass_bunch_harvested,
       CAST(sum(biomass_bunch_harvested) AS DOUBLE) * 1e-3 / 0.4857e0 * {FRESH} AS ffb_kg,
       CAST(sum(biomass_bunch_harvested) AS DOUBLE) * 1e-6 / 0.4857e0 * {FRESH} / {AREA} * 10000
         AS ffb_t_ha,
       make_date(year(date), 1, 1) AS year_date
FROM plants GROUP BY "Site", year(date)"""
)
def year_rollup(spark, sf):
    return doubles(sites.plant_years(roles.plants(spark, sf)))


@query(
    f"""
WITH {SCENARIO_PLANTS}
SELECT months_after_planting, rank_leaves_left, window_duration,
       CAST(max(biomass_bunch_harvested) AS DOUBLE) AS lai
FROM scenario_plants GROUP BY 1, 2, 3"""
)
def scenario_month_max(spark, sf):
    keys = ["months_after_planting", *scenario.SCENARIO]
    months = rollup.rollup(
        roles.scenario_plants(spark, sf), keys, maxima={"lai": "biomass_bunch_harvested"}
    )
    return doubles(months)


STATES = {
    "leaves_opened": ["Opened"],
    "leaves_pruned": ["Pruned"],
    "leaves_undetermined": ["undetermined"],
    "leaves_emitted": ["Opened", "Pruned"],
}
DECISIONS = {"pruned_at_rank": k.PRUNED_AT_RANK, "pruned_at_harvest": k.PRUNED_AT_HARVEST}
STATE_COUNTS = """
state_counts AS (
  SELECT "Site", timestep, date,
         count(*) FILTER (WHERE state = 'Opened') AS leaves_opened,
         count(*) FILTER (WHERE state = 'Pruned') AS leaves_pruned,
         count(*) FILTER (WHERE state = 'undetermined') AS leaves_undetermined,
         count(*) FILTER (WHERE state IN ('Opened', 'Pruned')) AS leaves_emitted,
         count(*) FILTER (WHERE pruning_decision = 'Pruned at rank') AS pruned_at_rank,
         count(*) FILTER (WHERE pruning_decision = 'Pruned at bunch harvest') AS pruned_at_harvest,
         count(*) AS n_rows,
         CAST(sum(CASE WHEN state = 'Opened' THEN leaf_area ELSE 0 END) AS DOUBLE) AS leaf_area,
         CAST(sum(biomass) AS DOUBLE) AS biomass
  FROM organs GROUP BY 1, 2, 3)"""


def leaf_counts(spark, sf):
    return rollup.state_counts(
        roles.organs(spark, sf),
        ["Site", "timestep", "date"],
        STATES,
        decisions=DECISIONS,
        opened_sums={"leaf_area": "leaf_area"},
        sums={"biomass": "biomass"},
    )


@query(f"WITH {ORGANS}, {STATE_COUNTS} SELECT * FROM state_counts")
def state_counts(spark, sf):
    return doubles(leaf_counts(spark, sf))


@query(
    f"""
WITH {ORGANS}
SELECT "Site", CAST(date_trunc('month', date) AS DATE) AS yearmonth,
       count(*) FILTER (WHERE state = 'Opened') AS leaves_opened,
       count(*) FILTER (WHERE state = 'Pruned') AS leaves_pruned,
       count(*) AS n_rows,
       CAST(sum(CASE WHEN state = 'Opened' THEN leaf_area ELSE 0 END) AS DOUBLE) AS leaf_area,
       max(timestep) AS last_step, arg_max(date, timestep) AS last_date
FROM organs GROUP BY 1, 2"""
)
def state_months(spark, sf):
    """State counts beside the last values of the month, in one roll-up."""
    organs = roles.organs(spark, sf).withColumn("yearmonth", c.month_start("date"))
    counts = rollup.state_counts(
        organs,
        ["Site", "yearmonth"],
        {name: STATES[name] for name in ("leaves_opened", "leaves_pruned")},
        opened_sums={"leaf_area": "leaf_area"},
        lasts={"last_step": "timestep", "last_date": "date"},
    )
    return doubles(counts)


@query(f"WITH {ORGANS} SELECT state, count(*) AS n FROM organs GROUP BY 1")
def count_by_state(spark, sf):
    return rollup.count_by(roles.organs(spark, sf), ["state"])


@query(
    f"""
WITH {ORGANS}
SELECT "Site", timestep,
       CAST(sum(reserve) FILTER (WHERE reserve > 0) AS DOUBLE)
         / nullif(count(reserve) FILTER (WHERE reserve > 0), 0) AS average
FROM organs GROUP BY 1, 2"""
)
def mean_positive(spark, sf):
    return rollup.mean_positive(roles.organs(spark, sf), ["Site", "timestep"], "reserve", "average")


@query(
    f"""
WITH {FINE}
SELECT node, date, coalesce(CAST(sum(value) FILTER (WHERE state = 'Scenescent') AS DOUBLE)
  / nullif(count(value) FILTER (WHERE state = 'Scenescent'), 0), 0e0) AS biomass_avg
FROM fine GROUP BY 1, 2"""
)
def mean_of_state(spark, sf):
    return rollup.mean_of_state(
        roles.fine(spark, sf), ["node", "date"], "value", k.SENESCENT, "biomass_avg"
    )


@query(
    f"""
WITH {MONTHS},
means AS (SELECT yearmonth, CAST(sum(x) AS DOUBLE) / count(x) AS lai FROM months GROUP BY 1)
SELECT DISTINCT m.yearmonth, m.genotype, means.lai
FROM months m JOIN means ON m.yearmonth = means.yearmonth"""
)
def unique_in_group(spark, sf):
    return rollup.mean_with_distinct(
        roles.months(spark, sf), ["yearmonth"], "x", "genotype", "lai"
    )


@query(
    f"""
WITH {ORGANS}, {STATE_COUNTS}
SELECT "Site", arg_max(leaves_emitted, timestep) + arg_max(leaves_undetermined, timestep)
  AS phytomer_count
FROM state_counts GROUP BY 1"""
)
def last_sum(spark, sf):
    return rollup.last_sum(
        leaf_counts(spark, sf),
        ["Site"],
        "timestep",
        "leaves_emitted",
        "leaves_undetermined",
        "phytomer_count",
    )


@query(
    f"""
WITH {PLANTS},
plant_months AS (
  SELECT "Site", months_after_planting, max(timestep) - min(timestep) + 1 AS nb_timesteps,
         sum("TEff") AS heat, CAST(arg_max(phytomer_count, timestep) AS BIGINT) AS phytomer_count
  FROM plants GROUP BY 1, 2),
totals AS (
  SELECT "Site", max(months_after_planting) AS months_after_planting,
         max(phytomer_count) AS phytomer_count, CAST(sum(heat) AS DOUBLE) AS "TEff",
         CAST(sum(nb_timesteps) AS BIGINT) AS nb_timesteps
  FROM plant_months GROUP BY 1)
SELECT *, phytomer_count / "TEff" AS "phytomer_per_TT",
       CAST(phytomer_count AS DOUBLE) / nb_timesteps AS phytomer_per_day,
       CAST(nb_timesteps AS DOUBLE) / phytomer_count AS days_per_phytomer
FROM totals"""
)
def rate_summary(spark, sf):
    return doubles(rollup.rate_summary(sites.plant_months(roles.plants(spark, sf))))


@query(
    f"""
WITH {ORGANS},
plant_days AS (
  SELECT "Site", timestep, date, sum(biomass) AS biomass, sum(leaf_area) AS height,
         max(rank) AS radius
  FROM organs GROUP BY 1, 2, 3)
SELECT "Site", CAST(year(date) AS INTEGER) AS year,
       max(timestep) - min(timestep) + 1 AS nb_timesteps,
       CAST(min(biomass) AS DOUBLE) {LEAF_T_HA} AS biomass_ton_ms,
       CAST(min(height) AS DOUBLE) AS height, min(radius) * 2 AS diameter
FROM plant_days GROUP BY "Site", year(date)"""
)
def organ_mass_year(spark, sf):
    plant = rollup.organs_to_plant(
        roles.organs(spark, sf),
        sums={"biomass": "biomass", "height": "leaf_area"},
        maxima={"radius": "rank"},
    )
    return doubles(rollup.organ_mass_year(plant, minima={"height": "height"}, radius="radius"))


@query(
    f"""
WITH {LEAVES}
SELECT timestep, CAST(sum(leaf_area) AS DOUBLE) AS leaf_area,
       CAST(sum(leaf_area) AS DOUBLE) / {AREA} AS lai_opened
FROM leaves
WHERE date >= DATE '1998-07-02' AND "Site" = 'O' AND state = 'Opened' GROUP BY 1"""
)
def open_leaf_area(spark, sf):
    return doubles(
        scenario.open_leaf_area(roles.leaves(spark, sf), "1998-07-01", {"Site": "O"})
    )


@query(
    f"""
WITH {SERIES}
SELECT count(*) AS n_rows, CAST(sum(x) AS DOUBLE) AS sum_value,
       CAST(sum(x) AS DOUBLE) / count(x) AS mean_value, CAST(min(x) AS DOUBLE) AS min_value,
       CAST(max(x) AS DOUBLE) AS max_value, min(date) AS first_date, max(date) AS last_date
FROM series"""
)
def global_aggs(spark, sf):
    return doubles(rollup.table_summary(roles.series(spark, sf), "x", "date"))


@query("SELECT DISTINCT l_partkey AS node, l_linestatus AS \"Site\" FROM lineitem")
def distinct_nodes(spark, sf):
    return rollup.distinct_values(roles.organs(spark, sf), "node", "Site")


@query(f"WITH {ORGANS} SELECT state, count(DISTINCT node) AS n_nodes FROM organs GROUP BY 1")
def distinct_count(spark, sf):
    return rollup.distinct_count(roles.organs(spark, sf), ["state"], "node", "n_nodes")


@query(
    f"""
WITH {MONTHS},
means AS (
  SELECT "Site", CAST(sum(x) AS DOUBLE) / count(x) AS m FROM months
  WHERE months_after_planting < 50 GROUP BY 1)
SELECT round(avg(m), 4) AS mean_x FROM means"""
)
def mean_of_means(spark, sf):
    early = roles.months(spark, sf).where(F.col("months_after_planting") < 50)
    means = rollup.mean_of_means(early, ["Site"], "x", "mean_x")
    return means.withColumn("mean_x", F.round("mean_x", 4))


@query(
    f"""
WITH {MONTHS}
SELECT CAST(sum(x) FILTER (WHERE months_after_planting = 50) AS DOUBLE)
         / count(*) FILTER (WHERE months_after_planting = 50)
     - CAST(sum(x) FILTER (WHERE months_after_planting = 10) AS DOUBLE)
         / count(*) FILTER (WHERE months_after_planting = 10) AS difference
FROM months"""
)
def point_mean_diff(spark, sf):
    return rollup.point_mean_diff(
        roles.months(spark, sf), "months_after_planting", 50, 10, "x", "difference"
    )


@query(f'WITH {ORGANS} SELECT "Site", timestep, count(*) FILTER (WHERE rank > 20) AS rank FROM organs GROUP BY 1, 2')
def emitted_leaves(spark, sf):
    return sites.emitted_leaves(roles.organs(spark, sf), rank_above=20)


ORGAN_MONTHS = f"""{ORGANS},
inflorescences AS (
  SELECT *, CAST(dense_rank() OVER (ORDER BY date_trunc('month', date)) - 18 AS INTEGER)
           AS months_after_planting,
         CASE state WHEN 'Pruned' THEN 'Harvested' WHEN 'Opened' THEN 'Scenescent'
              ELSE state END AS phase
  FROM organs)"""


def inflorescences(spark, sf):
    phase = (
        F.when(F.col("state") == k.PRUNED, k.HARVESTED)
        .when(F.col("state") == k.OPENED, k.SENESCENT)
        .otherwise(F.col("state"))
    )
    return month_index(roles.organs(spark, sf)).withColumn("state", phase)


@query(
    f"""
WITH {ORGAN_MONTHS}
SELECT "Site", months_after_planting, CAST(date_trunc('month', min(date)) AS DATE) AS date,
       max(timestep) - min(timestep) + 1 AS nb_timesteps,
       count(*) FILTER (WHERE phase = 'Harvested') AS n_bunches_harvested,
       CAST(sum(reserve) AS DOUBLE) AS biomass_bunch_harvested,
       CAST(sum(reserve) FILTER (WHERE reserve > 0) AS DOUBLE)
         / nullif(count(*) FILTER (WHERE reserve > 0), 0) AS biomass_bunch_harvested_average
FROM inflorescences GROUP BY 1, 2"""
)
def female_months(spark, sf):
    female = inflorescences(spark, sf).withColumn("biomass_bunch_harvested", F.col("reserve"))
    return doubles(sites.female_months(female))


@query(
    f"""
WITH {ORGAN_MONTHS}
SELECT "Site", months_after_planting, CAST(date_trunc('month', min(date)) AS DATE) AS date,
       max(timestep) - min(timestep) + 1 AS nb_timesteps,
       count(*) FILTER (WHERE phase = 'Harvested') AS n_males_harvested,
       count(*) FILTER (WHERE phase = 'Scenescent') AS n_males_senescent,
       coalesce(CAST(sum(biomass) FILTER (WHERE phase = 'Scenescent') AS DOUBLE)
         / nullif(count(*) FILTER (WHERE phase = 'Scenescent'), 0), 0e0) AS biomass_avg
FROM inflorescences GROUP BY 1, 2"""
)
def male_months(spark, sf):
    return sites.male_months(inflorescences(spark, sf))
