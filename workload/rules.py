"""Pruning and phenology rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from agroseries.operators import rules, scenario
from workload import roles
from workload.registry import doubles, query
from workload.roles import EPOCH, LEAVES

RANK_MAX, RANK_WINDOW, START, END = 45, 30, "1998-07-01", "1999-01-01"

FIRES = """rank > {top} OR state = 'Pruned'
  OR (rank >= {least} AND date BETWEEN DATE '{start}' AND DATE '{end}')"""
LABEL = """CASE
  WHEN rank >= {least} AND date BETWEEN DATE '{start}' AND DATE '{end}'
    THEN 'Pruned during time window'
  WHEN rank > {top} THEN 'Pruned at rank' ELSE 'Pruned at bunch harvest' END"""
_ARGS = {"top": RANK_MAX, "least": RANK_WINDOW, "start": START, "end": END}

FIRED = f"""{LEAVES},
fired AS (
  SELECT "Site", node, timestep AS fired_at, biomass AS litter, {LABEL.format(**_ARGS)} AS decision
  FROM leaves WHERE {FIRES.format(**_ARGS)}
  QUALIFY row_number() OVER (PARTITION BY "Site", node ORDER BY timestep) = 1)"""


@query(
    f"""
WITH {FIRED}
SELECT l."Site", l.node, l.timestep, coalesce(l.timestep >= f.fired_at, false) AS is_pruned,
       CASE WHEN l.timestep >= f.fired_at THEN f.decision ELSE 'undetermined' END
         AS pruning_decision
FROM leaves l LEFT JOIN fired f ON l."Site" = f."Site" AND l.node = f.node"""
)
def prune_decision(spark, sf):
    decided = rules.prune_decision(
        roles.leaves(spark, sf), RANK_WINDOW, START, END, rank_max=RANK_MAX
    )
    return decided.select("Site", "node", "timestep", "is_pruned", "pruning_decision")


@query(
    f"""
WITH {FIRED}, marked AS (
  SELECT l.*, coalesce(l.timestep >= f.fired_at, false) AS is_pruned, f.decision, f.litter
  FROM leaves l LEFT JOIN fired f ON l."Site" = f."Site" AND l.node = f.node)
SELECT "Site", node, timestep, is_pruned,
       CASE WHEN is_pruned THEN decision ELSE 'undetermined' END AS pruning_decision,
       CASE WHEN is_pruned THEN 'Pruned' ELSE state END AS state,
       CAST(CASE WHEN is_pruned THEN 0 ELSE leaf_area END AS DOUBLE) AS leaf_area,
       CAST(CASE WHEN is_pruned THEN 0 ELSE biomass END AS DOUBLE) AS biomass,
       CAST(CASE WHEN is_pruned THEN 0 ELSE reserve END AS DOUBLE) AS reserve,
       CAST(CASE WHEN is_pruned THEN litter END AS DOUBLE) AS litter_leaf
FROM marked"""
)
def prune_effects(spark, sf):
    pruned = rules.prune_effects(
        roles.leaves(spark, sf), RANK_WINDOW, START, END, rank_max=RANK_MAX
    )
    return doubles(pruned.drop("date", "rank"))


SCENARIOS = [
    {"rank_leaves_left": rank, "window_duration": months, "start_date": START, "end_date": end}
    for rank in range(25, 51, 5)
    for months, end in ((6, "1999-01-01"), (12, "1999-07-01"))
]
_SCENARIOS = ", ".join(
    f"({s['rank_leaves_left']}, {s['window_duration']}, DATE '{START}', DATE '{s['end_date']}')"
    for s in SCENARIOS
)
_OPEN = """rank >= rank_leaves_left AND date BETWEEN start_date AND end_date"""


@query(
    f"""
WITH {LEAVES},
scenarios(rank_leaves_left, window_duration, start_date, end_date) AS (VALUES {_SCENARIOS}),
fired AS (
  SELECT "Site", node, rank_leaves_left, window_duration, timestep AS fired_at,
         CASE WHEN {_OPEN} THEN 'Pruned during time window'
              WHEN rank > {RANK_MAX} THEN 'Pruned at rank'
              ELSE 'Pruned at bunch harvest' END AS pruning_decision
  FROM leaves CROSS JOIN scenarios
  WHERE rank > {RANK_MAX} OR state = 'Pruned' OR ({_OPEN})
  QUALIFY row_number() OVER (
    PARTITION BY "Site", node, rank_leaves_left, window_duration ORDER BY timestep) = 1)
SELECT n."Site", n.node, s.rank_leaves_left, s.window_duration, f.fired_at,
       coalesce(f.pruning_decision, 'undetermined') AS pruning_decision
FROM (SELECT DISTINCT "Site", node FROM leaves) n CROSS JOIN scenarios s
LEFT JOIN fired f ON n."Site" = f."Site" AND n.node = f.node
  AND s.rank_leaves_left = f.rank_leaves_left AND s.window_duration = f.window_duration"""
)
def prune_sweep(spark, sf):
    return rules.prune_sweep(roles.leaves(spark, sf), SCENARIOS, rank_max=RANK_MAX)


@query(
    f"""
WITH {LEAVES},
scenarios(rank_leaves_left, window_duration, start_date, end_date) AS (VALUES {_SCENARIOS}),
fired AS (
  SELECT "Site", node, rank_leaves_left, window_duration, coalesce({_OPEN}, false) AS in_window
  FROM leaves CROSS JOIN scenarios
  WHERE rank > {RANK_MAX} OR state = 'Pruned' OR ({_OPEN})
  QUALIFY row_number() OVER (
    PARTITION BY "Site", node, rank_leaves_left, window_duration ORDER BY timestep) = 1)
SELECT rank_leaves_left, window_duration, count(*) AS n_leaves
FROM fired WHERE in_window GROUP BY 1, 2"""
)
def scenario_decisions(spark, sf):
    swept = rules.prune_sweep(roles.leaves(spark, sf), SCENARIOS, rank_max=RANK_MAX)
    return scenario.count_decisions(swept)


OLEO = "(6300e0 + 405e0 + (1 - 0.8e0) * (12150e0 - (6300e0 + 405e0)))"


@query(
    f"""
WITH rows AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / 8 AS heat,
         CASE l_returnflag WHEN 'R' THEN 'Male' WHEN 'A' THEN 'Female'
              ELSE 'undetermined' END AS sex,
         CAST(l_quantity AS INTEGER) AS rank,
         CAST(l_shipdate AS DATE) - DATE '{EPOCH}' AS age,
         CASE WHEN l_linenumber = 7 THEN 'Aborted' ELSE 'undetermined' END AS before
  FROM lineitem),
events_seen AS (SELECT *, rank = 25 AND age BETWEEN 1000 AND 2000 AS event FROM rows)
SELECT l_orderkey, l_linenumber, l_partkey, heat AS "TT_since_init",
  CASE WHEN before = 'Aborted' THEN 'Aborted'
       WHEN sex = 'Male' AND heat > 8100 THEN 'Scenescent'
       WHEN sex = 'Male' AND heat > 6300 THEN 'Flowering'
       WHEN sex = 'Female' AND (event OR heat >= 12150) THEN 'Harvested'
       WHEN sex = 'Female' AND heat >= {OLEO} THEN 'Oleosynthesis'
       WHEN sex = 'Female' AND heat >= 6300 THEN 'Flowering'
       ELSE before END AS state,
  event OR (before <> 'Aborted' AND sex = 'Female' AND heat >= 12150) AS leaf_harvested
FROM events_seen"""
)
def inflorescence_state(spark, sf):
    flag = F.col("l_returnflag")
    rows = roles.read(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (F.col("l_extendedprice") / 8).alias("TT_since_init"),
        F.when(flag == "R", "Male").when(flag == "A", "Female").otherwise("undetermined").alias("sex"),
        F.col("l_quantity").cast("int").alias("rank"),
        roles.step_of(F.col("l_shipdate").cast("date")).alias("plant_age"),
        F.when(F.col("l_linenumber") == 7, "Aborted").otherwise("undetermined").alias("state"),
    )
    states = rules.inflorescence_state(rows, event_start=1000, event_end=2000)
    return states.drop("sex", "rank", "plant_age")


# node numbers: leaf 0, inflorescence 1, internode 2 and phytomer 3 modulo 4
TREE = """
organs AS (
  SELECT DISTINCT (l_orderkey * 16 + l_linenumber) * 4
           + CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS node,
         l_orderkey * 4 + 2 AS parent,
         CASE WHEN l_linestatus = 'O' THEN 'Leaf' WHEN l_linenumber % 2 = 1 THEN 'Female'
              ELSE 'Male' END AS symbol
  FROM lineitem),
edges AS (
  SELECT * FROM organs UNION ALL
  SELECT o_orderkey * 4 + 2, o_custkey * 4 + 3, 'Internode' FROM orders),
pruned AS (
  SELECT DISTINCT (l_orderkey * 16 + l_linenumber) * 4 AS node
  FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'R')"""


@query(
    f"""
WITH {TREE},
internodes AS (SELECT DISTINCT e.parent AS node FROM pruned p JOIN edges e ON p.node = e.node)
SELECT node, 'Harvested' AS state FROM (
  SELECT e.parent AS node FROM internodes i JOIN edges e ON i.node = e.node
  UNION
  SELECT min(e.node) FROM internodes i JOIN edges e ON i.node = e.parent
  WHERE e.symbol IN ('Female', 'Male') GROUP BY i.node HAVING count(*) = 1)"""
)
def propagate_harvest(spark, sf):
    lineitem = roles.read(spark, sf, "lineitem")
    orders = roles.read(spark, sf, "orders")
    is_leaf = F.col("l_linestatus") == "O"
    place = (F.col("l_orderkey") * 16 + F.col("l_linenumber")) * 4
    symbol = (
        F.when(is_leaf, "Leaf").when(F.col("l_linenumber") % 2 == 1, "Female").otherwise("Male")
    )
    organs = lineitem.select(
        (place + F.when(is_leaf, 0).otherwise(1)).alias("node"),
        (F.col("l_orderkey") * 4 + 2).alias("parent"),
        symbol.alias("symbol"),
        (is_leaf & (F.col("l_returnflag") == "R")).alias("pruned"),
    )
    internodes = orders.select(
        (F.col("o_orderkey") * 4 + 2).alias("node"),
        (F.col("o_custkey") * 4 + 3).alias("parent"),
        F.lit("Internode").alias("symbol"),
        F.lit(False).alias("pruned"),
    )
    return rules.propagate_harvest("pruned", organs.unionByName(internodes))
