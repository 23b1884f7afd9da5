"""Joins of tables at different scales, with weather, observations and chosen sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from agroseries.operators import joins, reshape, rollup, scales
from agroseries.operators.series import month_index
from agroseries.plans import outputs, sites
from workload import roles
from workload.registry import doubles, query
from workload.roles import MONTHS, ORGANS, SERIES


def daily_weather(spark, sf):
    return rollup.rollup(roles.series(spark, sf), ["Site", "date"], sums={"rain": "x"})


WEATHER = """
weather AS (SELECT "Site", date, sum(x) AS rain FROM series GROUP BY 1, 2)"""


@query(
    f"""
WITH {SERIES}, {WEATHER}, {ORGANS}
SELECT o."Site", o.node, o.id, o.line, o.date, CAST(w.rain AS DOUBLE) AS rain
FROM organs o LEFT JOIN weather w ON o."Site" = w."Site" AND o.date = w.date"""
)
def join_weather(spark, sf):
    organs = roles.organs(spark, sf).select("Site", "node", "id", "line", "date")
    return doubles(joins.join_weather(organs, daily_weather(spark, sf), ["Site", "date"]))


OBSERVED = f"""{MONTHS},
observed AS (
  SELECT "Site" AS site, genotype, months_after_planting, yearmonth AS date,
         count(*) AS nb_leaves_emitted
  FROM months GROUP BY 1, 2, 3, 4),
simulated AS (
  SELECT l_linestatus AS site, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
         sum(CAST(l_quantity AS DECIMAL(18,2))) AS "TEff", count(*) AS nb_leaves_emitted_sim
  FROM lineitem GROUP BY 1, 2),
accumulated AS (
  SELECT *, sum(nb_leaves_emitted) OVER (PARTITION BY site, genotype
    ORDER BY months_after_planting ROWS UNBOUNDED PRECEDING) AS nb_leaves_emitted_cum
  FROM observed),
compared AS (
  SELECT a.site, a.genotype, a.months_after_planting, a.date, a.nb_leaves_emitted,
         CAST(a.nb_leaves_emitted_cum AS BIGINT) AS nb_leaves_emitted_cum,
         CAST(s."TEff" AS DOUBLE) AS "TEff", s.nb_leaves_emitted_sim,
         CAST(sum(s.nb_leaves_emitted_sim) OVER (PARTITION BY a.site, a.genotype
           ORDER BY a.months_after_planting ROWS UNBOUNDED PRECEDING) AS BIGINT)
           AS nb_leaves_emitted_cum_sim,
         CAST(a.nb_leaves_emitted AS DOUBLE) / CAST(s."TEff" AS DOUBLE)
           AS "nb_leaves_emitted_per_TEff"
  FROM accumulated a JOIN simulated s ON a.site = s.site AND a.date = s.date)"""


def compared(spark, sf):
    keys = ["site", "genotype", "months_after_planting", "date"]
    observed = rollup.count_by(
        roles.months(spark, sf).select(
            F.col("Site").alias("site"),
            "genotype",
            "months_after_planting",
            F.col("yearmonth").alias("date"),
        ),
        keys,
        "nb_leaves_emitted",
    )
    organs = month_index(roles.organs(spark, sf).select("Site", "date", "leaf_area"))
    simulated = organs.groupBy("Site", F.col("yearmonth").alias("date")).agg(
        F.sum("leaf_area").alias("TEff"), F.count("*").alias("phytomer_emitted")
    )
    return sites.compare_observations(observed, simulated)


@query(f"WITH {OBSERVED} SELECT * FROM compared")
def obs_vs_sim(spark, sf):
    return doubles(compared(spark, sf))


@query(
    f"""
WITH {OBSERVED},
periods AS (
  SELECT 'early' AS period, site, "nb_leaves_emitted_per_TEff" AS rate FROM compared WHERE months_after_planting < 20
  UNION ALL
  SELECT 'late', site, "nb_leaves_emitted_per_TEff" FROM compared WHERE months_after_planting > 40),
means AS (SELECT period, site, avg(rate) AS rate FROM periods GROUP BY 1, 2)
SELECT period, round(avg(rate), 10) AS phyllochron FROM means GROUP BY 1"""
)
def phyllochron_means(spark, sf):
    rows = compared(spark, sf)
    month, rate = F.col("months_after_planting"), "nb_leaves_emitted_per_TEff"
    periods = {"early": rows.where(month < 20), "late": rows.where(month > 40)}
    means = {p: rollup.mean_of_means(df, ["site"], rate, "phyllochron") for p, df in periods.items()}
    return reshape.unite_tagged(means, "period").withColumn("phyllochron", F.round("phyllochron", 10))


@query(
    f"""
WITH {OBSERVED}
SELECT a.site, a.genotype, a.nb_leaves_emitted_cum AS "nb_leaves_emitted_cum_10MAP",
       b.nb_leaves_emitted_cum AS "nb_leaves_emitted_cum_50MAP",
       b.nb_leaves_emitted_cum - a.nb_leaves_emitted_cum AS emitted_between
FROM compared a JOIN compared b ON a.site = b.site AND a.genotype = b.genotype
WHERE a.months_after_planting = 10 AND b.months_after_planting = 50"""
)
def two_point_self_join(spark, sf):
    rows = compared(spark, sf).select(
        "site", "genotype", "months_after_planting", "nb_leaves_emitted_cum"
    )
    both = joins.two_points(
        rows, ["site", "genotype"], "months_after_planting", 10, 50, ("_10MAP", "_50MAP")
    )
    between = F.col("nb_leaves_emitted_cum_50MAP") - F.col("nb_leaves_emitted_cum_10MAP")
    return both.withColumn("emitted_between", between).drop(
        "months_after_planting_10MAP", "months_after_planting_50MAP"
    )


@query(
    """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"""
)
def semi_select(spark, sf):
    orders = roles.read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    chosen = (
        roles.read(spark, sf, "customer")
        .where(F.col("c_mktsegment") == "BUILDING")
        .select(F.col("c_custkey").alias("o_custkey"))
    )
    return reshape.select_members(orders, chosen, "o_custkey")


@query(
    f"""
WITH {SERIES}, {ORGANS},
gathered AS (
  SELECT date, x AS rm FROM series UNION ALL SELECT date, biomass FROM organs)
SELECT date, CAST(sum(rm) AS DOUBLE) AS "Rm", CAST(sum(rm) AS DOUBLE) / count(rm) AS "Rm_mean",
       count(*) AS "Rm_n"
FROM gathered GROUP BY 1"""
)
def scale_gather(spark, sf):
    organs = {"Internode": roles.series(spark, sf), "Leaf": roles.organs(spark, sf)}
    values = {"Internode": "x", "Leaf": "biomass"}
    return doubles(scales.scale_gather(organs, values, "Rm", ["date"]))


@query(
    f"""
WITH {SERIES}, {ORGANS}, scene AS (SELECT date, sum(x) AS total FROM series GROUP BY 1)
SELECT o.node, o.id, o.line, o.date, CAST(s.total AS DOUBLE) AS "aPPFD_scene"
FROM organs o LEFT JOIN scene s ON o.date = s.date"""
)
def scale_broadcast(spark, sf):
    organs = roles.organs(spark, sf).select("node", "id", "line", "date")
    scene = rollup.rollup(roles.series(spark, sf), ["date"], sums={"aPPFD": "x"})
    return doubles(scales.scale_broadcast(organs, scene, {"aPPFD_scene": "aPPFD"}, ["date"]))


@query(
    f"""
WITH {ORGANS}
SELECT date, node, rank, CAST(leaf_area AS DOUBLE) AS leaf_area FROM organs WHERE state = 'Opened'"""
)
def scale_slice(spark, sf):
    chosen = {"Opened": ["rank", "leaf_area"], "Pruned": []}
    slices = reshape.slice_scales(roles.organs(spark, sf), chosen, organ="state")
    return doubles(slices["Opened"])


CALENDAR = """
calendar AS (SELECT timestep, min(date) AS day FROM organs GROUP BY 1),
dated AS (SELECT o.*, c.day FROM organs o LEFT JOIN calendar c ON o.timestep = c.timestep)"""


def opened_long(spark, sf):
    rows = roles.organs(spark, sf)
    calendar = rows.groupBy("timestep").agg(F.min("date").alias("day"))
    outputs_table = rows.select("timestep", "node", "state", "leaf_area", "biomass").withColumns(
        {n: F.col(n).cast("double") for n in ("leaf_area", "biomass")}
    )
    tables = outputs.scale_tables(
        outputs_table,
        calendar,
        {"Opened": ["leaf_area", "biomass"], "Pruned": []},
        organ="state",
        keys=["day", "node"],
    )
    return tables["Opened"]


LONG = f"""{ORGANS}, {CALENDAR},
long AS (
  SELECT day, node, 'leaf_area' AS variable, CAST(leaf_area AS DOUBLE) AS value FROM dated
  WHERE state = 'Opened'
  UNION ALL
  SELECT day, node, 'biomass', CAST(biomass AS DOUBLE) FROM dated WHERE state = 'Opened')"""


@query(f"WITH {LONG} SELECT * FROM long")
def scale_tables(spark, sf):
    return opened_long(spark, sf)


@query(
    f"""
WITH {LONG}
SELECT day, node, value FROM long
WHERE variable = 'biomass' AND node IN (SELECT p_partkey FROM part WHERE p_size > 40)"""
)
def scale_nodes(spark, sf):
    chosen = (
        roles.read(spark, sf, "part")
        .where(F.col("p_size") > 40)
        .select(F.col("p_partkey").alias("node"))
    )
    return outputs.nodes_of(opened_long(spark, sf), "biomass", chosen, keys=["day", "node"])
