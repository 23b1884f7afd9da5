"""Data checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from agroseries.functions import aggregates as a
from agroseries.operators import checks, rollup
from workload import roles
from workload.joins import OBSERVED, compared
from workload.registry import query
from workload.roles import MONTHS, ORGANS, PLANTS
from workload.rollups import STATE_COUNTS, leaf_counts


def verdict(name: str, bad: str, source: str) -> str:
    return f"""
SELECT '{name}' AS "check", n_bad = 0 AS ok, n_bad
FROM (SELECT CAST({bad} AS BIGINT) AS n_bad FROM {source})"""


@query(
    f"WITH {ORGANS}"
    + verdict(
        "non_negative",
        "count(*) FILTER (WHERE leaf_area < 0) + count(*) FILTER (WHERE reserve < 0)",
        "organs",
    )
)
def check_non_negative(spark, sf):
    return checks.check_non_negative(roles.organs(spark, sf), ["leaf_area", "reserve"])


@query(
    f"WITH {ORGANS}, {STATE_COUNTS}"
    + verdict(
        "max_equals", "CASE WHEN max(leaves_undetermined) = 60 THEN 0 ELSE 1 END", "state_counts"
    )
)
def check_max_equals(spark, sf):
    return checks.check_max_equals(leaf_counts(spark, sf), "leaves_undetermined", 60)


@query(
    f"""WITH {PLANTS}, {ORGANS}, {STATE_COUNTS},
expected AS (
  SELECT "Site", CAST(arg_max(phytomer_count, timestep) AS BIGINT) AS n FROM plants GROUP BY 1),
found AS (
  SELECT "Site", arg_max(leaves_emitted, timestep) + arg_max(leaves_undetermined, timestep) AS n
  FROM state_counts GROUP BY 1)"""
    + verdict(
        "tables_equal",
        "count(*) FILTER (WHERE e.n IS DISTINCT FROM f.n)",
        "expected e FULL JOIN found f ON e.\"Site\" = f.\"Site\"",
    )
)
def check_tables_equal(spark, sf):
    expected = roles.plants(spark, sf).groupBy("Site").agg(
        a.last_by("phytomer_count", "timestep").alias("phytomer_count")
    )
    found = rollup.last_sum(
        leaf_counts(spark, sf),
        ["Site"],
        "timestep",
        "leaves_emitted",
        "leaves_undetermined",
        "phytomer_count",
    )
    return checks.check_tables_equal(expected, found, ["Site"])


@query(
    f"""WITH {OBSERVED},
v AS (
  SELECT CAST(sum(x) FILTER (WHERE months_after_planting = 50) AS DOUBLE)
           / count(*) FILTER (WHERE months_after_planting = 50)
       - CAST(sum(x) FILTER (WHERE months_after_planting = 49) AS DOUBLE)
           / count(*) FILTER (WHERE months_after_planting = 49) AS d
  FROM months),
o AS (SELECT min(nb_leaves_emitted_cum) AS low, max(nb_leaves_emitted_cum) AS high FROM compared)"""
    + verdict("in_range", "CASE WHEN d > low AND d < high THEN 0 ELSE 1 END", "v, o")
)
def check_in_range(spark, sf):
    value = rollup.point_mean_diff(
        roles.months(spark, sf), "months_after_planting", 50, 49, "x", "difference"
    )
    observed = compared(spark, sf).select("nb_leaves_emitted_cum")
    return checks.check_in_range(value, observed, "difference")


@query(
    f"WITH {ORGANS}"
    + verdict(
        "undetermined_rank", "count(*) FILTER (WHERE state = 'undetermined' AND rank >= 1)", "organs"
    )
)
def check_all(spark, sf):
    undetermined = roles.organs(spark, sf).where(F.col("state") == "undetermined")
    return checks.check_all(undetermined, F.col("rank") < 1, "undetermined_rank")


@query(
    f"WITH {ORGANS}"
    + verdict(
        "pruned_late",
        "count(*) FILTER (WHERE state = 'Pruned' AND NOT (rank > 10 OR timestep > 1000))",
        "organs",
    )
)
def check_all_either(spark, sf):
    pruned = roles.organs(spark, sf).where(F.col("state") == "Pruned")
    late = (F.col("rank") > 10) | (F.col("timestep") > 1000)
    return checks.check_all(pruned, late, "pruned_late")


@query(
    f"WITH {MONTHS}"
    + verdict(
        "unique_key",
        "count(*) FILTER (WHERE n <> 1)",
        '(SELECT count(*) AS n FROM months GROUP BY "Site", date)',
    )
)
def check_unique_key(spark, sf):
    return checks.check_unique_key(roles.series(spark, sf), ["Site", "date"])


@query(
    f"WITH {ORGANS}"
    + verdict(
        "leaf_key",
        "count(*) FILTER (WHERE n <> 1)",
        '(SELECT count(*) AS n FROM organs GROUP BY id, line)',
    )
)
def check_leaf_key(spark, sf):
    return checks.check_unique_key(
        roles.organs(spark, sf), ["id", "line"], "leaf_key"
    )


# windows from the events: some users gave no duration, some no end, the rest of them neither
WINDOWS = """
windows AS (
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 6 END AS window_duration,
         CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) END AS end_date
  FROM events)"""


@query(
    f"WITH {WINDOWS}"
    + verdict("window_end", "count(*) FILTER (WHERE window_duration IS NULL AND end_date IS NULL)", "windows")
)
def check_window_end(spark, sf):
    windows = roles.read(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, 6).alias("window_duration"),
        F.when(F.col("event_type") == "purchase", F.col("ts").cast("date")).alias("end_date"),
    )
    return checks.check_window_end(windows)


ORDER_TOTALS = """
lines AS (
  SELECT l_orderkey, l_returnflag AS flag, l_quantity AS quantity FROM lineitem),
shipped AS (
  SELECT l_orderkey, l_returnflag AS flag,
         CASE WHEN l_linenumber = 3 AND l_quantity > 49 THEN 0 ELSE l_quantity END AS quantity FROM lineitem)"""


@query(
    f"""WITH {ORDER_TOTALS},
diff AS (
  SELECT l_orderkey FROM (
    SELECT *, 1 AS side FROM lines UNION ALL SELECT *, -1 FROM shipped)
  GROUP BY l_orderkey, flag, quantity HAVING sum(side) <> 0)"""
    + verdict("tables_equal", "count(DISTINCT l_orderkey)", "diff")
)
def check_tables_repeated_keys(spark, sf):
    """Tables whose key repeats, compared as multisets."""
    lines = roles.read(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"), "l_linenumber"
    )
    off = (F.col("l_linenumber") == 3) & (F.col("quantity") > 49)
    shipped = lines.withColumn("quantity", F.when(off, F.lit(0).cast(lines.schema["quantity"].dataType)).otherwise(F.col("quantity")))
    return checks.check_tables_equal(lines.drop("l_linenumber"), shipped.drop("l_linenumber"), ["l_orderkey"])
