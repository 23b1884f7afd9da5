"""The given tables in the roles of the domain, once as DataFrames and once as SQL.

orders    site series: status = site, priority = genotype, customer = plant, price = measure
lineitem  organs: part = node, quantity = rank and area, price = biomass, flags = state and site
events    fine series: user = node, type = state, value = measure
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agroseries.functions import constants as k
from agroseries.operators.series import month_index, running_sum
from agroseries.plans.weather import day_blocks

MONEY = "decimal(18,2)"
EPOCH = "1995-01-01"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def step_of(date: Column | str) -> Column:
    """Days since a fixed day, as the step number of a daily table."""
    return F.date_diff(date, F.lit(EPOCH).cast("date"))


# orders: rows of a site series, ordered by (date, id) ---------------------------------------

SERIES_ORDER = ["date", "id"]


def series(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("Site"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("node"),
        F.col("o_orderpriority").alias("genotype"),
        F.col("o_totalprice").cast(MONEY).alias("x"),
    )


def months(spark: SparkSession, sf: str) -> DataFrame:
    return month_index(series(spark, sf))


SERIES = """
series AS (
  SELECT o_orderstatus AS "Site", CAST(o_orderdate AS DATE) AS date, o_orderkey AS id,
         o_custkey AS node, o_orderpriority AS genotype, CAST(o_totalprice AS DECIMAL(18,2)) AS x
  FROM orders)"""

MONTHS = f"""{SERIES},
months AS (
  SELECT *, CAST(date_trunc('month', date) AS DATE) AS yearmonth,
         CAST(dense_rank() OVER (ORDER BY date_trunc('month', date)) - 18 AS INTEGER)
           AS months_after_planting
  FROM series)"""


def plants(spark: SparkSession, sf: str) -> DataFrame:
    """A plant output per site and step, with running totals, step and month numbers."""
    measured = months(spark, sf).select(
        "Site",
        "date",
        "id",
        "months_after_planting",
        F.col("x").alias("TEff"),
        F.col("x").alias("biomass_bunch_harvested"),
        F.when(F.col("genotype") == "1-URGENT", 1).otherwise(0).cast("bigint").alias("n_bunches_harvested"),
        F.when(F.col("genotype") < "3", 1).otherwise(0).cast("bigint").alias("_emitted"),
    )
    return running_sum(
        measured,
        ["Site"],
        SERIES_ORDER,
        {
            "biomass_bunch_harvested_cum": "biomass_bunch_harvested",
            "n_bunches_harvested_cum": "n_bunches_harvested",
            "phytomer_count": "_emitted",
        },
        day_blocks(),
        index="timestep",
    ).drop("_emitted")


PLANTS = f"""{MONTHS},
plants AS (
  SELECT "Site", date, id, months_after_planting, x AS "TEff", x AS biomass_bunch_harvested,
         CASE WHEN genotype = '1-URGENT' THEN 1 ELSE 0 END AS n_bunches_harvested,
         sum(x) OVER w AS biomass_bunch_harvested_cum,
         sum(CASE WHEN genotype = '1-URGENT' THEN 1 ELSE 0 END) OVER w AS n_bunches_harvested_cum,
         sum(CASE WHEN genotype < '3' THEN 1 ELSE 0 END) OVER w AS phytomer_count,
         row_number() OVER w AS timestep
  FROM months
  WINDOW w AS (PARTITION BY "Site" ORDER BY date, id ROWS UNBOUNDED PRECEDING))"""


# lineitem: organ rows -----------------------------------------------------------------------


def organs(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    pruned = F.when(F.col("l_linenumber") <= 3, k.PRUNED_AT_RANK).otherwise(k.PRUNED_AT_HARVEST)
    date = F.col("l_shipdate").cast("date")
    return read(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("Site"),
        F.col("l_partkey").alias("node"),
        date.alias("date"),
        step_of(date).alias("timestep"),
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").cast("int").alias("rank"),
        F.when(flag == "R", k.PRUNED)
        .when(flag == "A", k.OPENED)
        .otherwise(k.UNDETERMINED)
        .alias("state"),
        F.when(flag == "R", pruned).otherwise(k.UNDETERMINED).alias("pruning_decision"),
        F.col("l_quantity").cast(MONEY).alias("leaf_area"),
        F.col("l_extendedprice").cast(MONEY).alias("biomass"),
        F.col("l_discount").cast(MONEY).alias("reserve"),
    )


ORGANS = f"""
organs AS (
  SELECT l_linestatus AS "Site", l_partkey AS node, CAST(l_shipdate AS DATE) AS date,
         CAST(CAST(l_shipdate AS DATE) - DATE '{EPOCH}' AS INTEGER) AS timestep,
         l_orderkey AS id, l_linenumber AS line, CAST(l_quantity AS INTEGER) AS rank,
         CASE l_returnflag WHEN 'R' THEN 'Pruned' WHEN 'A' THEN 'Opened'
              ELSE 'undetermined' END AS state,
         CASE WHEN l_returnflag = 'R' AND l_linenumber <= 3 THEN 'Pruned at rank'
              WHEN l_returnflag = 'R' THEN 'Pruned at bunch harvest'
              ELSE 'undetermined' END AS pruning_decision,
         CAST(l_quantity AS DECIMAL(18,2)) AS leaf_area,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS biomass,
         CAST(l_discount AS DECIMAL(18,2)) AS reserve
  FROM lineitem)"""


def leaves(spark: SparkSession, sf: str) -> DataFrame:
    """One row per leaf and day."""
    # the code of the letter, as a numeric maximum keeps the hash aggregation
    flag = F.max(F.ascii("l_returnflag"))
    date = F.col("l_shipdate").cast("date")
    return (
        read(spark, sf, "lineitem")
        .groupBy(F.col("l_linestatus").alias("Site"), F.col("l_partkey").alias("node"), date.alias("date"))
        .agg(
            F.max(F.col("l_quantity").cast("int")).alias("rank"),
            F.when(flag == ord("R"), k.PRUNED)
            .when(flag == ord("A"), k.OPENED)
            .otherwise(k.UNDETERMINED)
            .alias("state"),
            F.sum(F.col("l_quantity").cast(MONEY)).alias("leaf_area"),
            F.sum(F.col("l_extendedprice").cast(MONEY)).alias("biomass"),
            F.sum(F.col("l_discount").cast(MONEY)).alias("reserve"),
        )
        .withColumn("timestep", step_of("date"))
    )


LEAVES = f"""
leaves AS (
  SELECT *, CAST(date - DATE '{EPOCH}' AS INTEGER) AS timestep FROM (
    SELECT l_linestatus AS "Site", l_partkey AS node, CAST(l_shipdate AS DATE) AS date,
           max(CAST(l_quantity AS INTEGER)) AS rank,
           CASE max(l_returnflag) WHEN 'R' THEN 'Pruned' WHEN 'A' THEN 'Opened'
                ELSE 'undetermined' END AS state,
           sum(CAST(l_quantity AS DECIMAL(18,2))) AS leaf_area,
           sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS biomass,
           sum(CAST(l_discount AS DECIMAL(18,2))) AS reserve
    FROM lineitem GROUP BY 1, 2, 3))"""


def scenario_plants(spark: SparkSession, sf: str) -> DataFrame:
    """Daily harvest of each scenario with its running total; scenario tags come from the rows."""
    date = F.col("l_shipdate").cast("date")
    daily = (
        read(spark, sf, "lineitem")
        .groupBy(
            (25 + 5 * ((F.col("l_linenumber") - 1) % 6)).cast("int").alias("rank_leaves_left"),
            F.when(F.col("l_linestatus") == "O", 6).otherwise(12).alias("window_duration"),
            date.alias("date"),
        )
        .agg(F.sum(F.col("l_extendedprice").cast(MONEY)).alias("biomass_bunch_harvested"))
        .withColumn("timestep", step_of("date"))
    )
    # one row per scenario and day: the window is as long as the calendar, so it needs no blocks
    totals = running_sum(
        daily,
        ["rank_leaves_left", "window_duration"],
        ["timestep"],
        {"biomass_bunch_harvested_cum": "biomass_bunch_harvested"},
    )
    return month_index(totals)


SCENARIO_PLANTS = f"""
scenario_daily AS (
  SELECT CAST(25 + 5 * ((l_linenumber - 1) % 6) AS INTEGER) AS rank_leaves_left,
         CASE WHEN l_linestatus = 'O' THEN 6 ELSE 12 END AS window_duration,
         CAST(l_shipdate AS DATE) AS date,
         sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS biomass_bunch_harvested
  FROM lineitem GROUP BY 1, 2, 3),
scenario_plants AS (
  SELECT *, CAST(date - DATE '{EPOCH}' AS INTEGER) AS timestep,
         CAST(date_trunc('month', date) AS DATE) AS yearmonth,
         CAST(dense_rank() OVER (ORDER BY date_trunc('month', date)) - 18 AS INTEGER)
           AS months_after_planting,
         sum(biomass_bunch_harvested) OVER (PARTITION BY rank_leaves_left, window_duration
           ORDER BY date ROWS UNBOUNDED PRECEDING) AS biomass_bunch_harvested_cum
  FROM scenario_daily)"""


# events: fine series per node, ordered by (ts, event_id) ------------------------------------

FINE_ORDER = ["ts", "event_id"]


def fine(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return read(spark, sf, "events").select(
        F.col("user_id").alias("node"),
        "ts",
        "event_id",
        F.col("ts").cast("date").alias("date"),
        F.when(kind == "purchase", k.HARVESTED)
        .when(kind == "error", k.SENESCENT)
        .otherwise(k.FLOWERING)
        .alias("state"),
        F.col("value").cast(MONEY).alias("value"),
    )


FINE = """
fine AS (
  SELECT user_id AS node, ts, event_id, CAST(ts AS DATE) AS date,
         CASE event_type WHEN 'purchase' THEN 'Harvested' WHEN 'error' THEN 'Scenescent'
              ELSE 'Flowering' END AS state,
         CAST(value AS DECIMAL(18,2)) AS value
  FROM events)"""

PERCENT = Decimal("0.01")
