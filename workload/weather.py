"""Weather preparation, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, IntegerType, StringType, StructField, StructType

from agroseries.functions import columns as c
from agroseries.functions import constants as k
from agroseries.operators import joins, reshape, series
from agroseries.plans import weather
from agroseries.sources import contract, files, shared
from workload.registry import doubles, num, query
from workload.roles import MONTHS, SERIES, SERIES_ORDER, read
from workload import roles


@query(
    f"""
SELECT l_linestatus AS "Site", CAST(l_shipdate AS DATE) AS date, l_quantity AS "T", 1 AS duration,
       l_discount / 100 AS "Rh", l_tax / 100 AS "Rh_max", l_extendedprice AS "Ri_PAR_f",
       l_extendedprice / {num(k.PAR_FRACTION)} AS "Rg"
FROM lineitem"""
)
def weather_normalize(spark, sf):
    return weather.normalize_weather(
        read(spark, sf, "lineitem"),
        plain={"Site": "l_linestatus", "date": F.col("l_shipdate").cast("date"), "T": "l_quantity"},
        percent={"Rh": "l_discount", "Rh_max": "l_tax"},
        par="l_extendedprice",
    )


@query(
    """
SELECT l_linestatus AS "Site", l_partkey AS node, nullif(l_discount, 0) AS discount
FROM lineitem WHERE l_discount <> 0"""
)
def drop_missing(spark, sf):
    rows = read(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("Site"),
        F.col("l_partkey").alias("node"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("discount"),
    )
    return reshape.drop_missing(rows)


COMMON = """
bounds AS (
  SELECT max(a) AS start_date, min(b) AS end_date
  FROM (SELECT min(date) AS a, max(date) AS b FROM {table} GROUP BY "Site"))"""


@query(
    f"""
WITH {SERIES}, {COMMON.format(table="series")}
SELECT "Site", date, id FROM series
WHERE date BETWEEN (SELECT start_date FROM bounds) AND (SELECT end_date FROM bounds)"""
)
def common_period(spark, sf):
    raw = roles.read(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("Site"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_orderkey").alias("id"),
        "o_orderdate",
    )
    return joins.common_period(raw, raw="o_orderdate").select("Site", "date", "id")


@query(
    f"""
WITH {SERIES}
SELECT "Site", id, row_number() OVER (PARTITION BY "Site" ORDER BY date, id) AS timestep
FROM series"""
)
def row_index(spark, sf):
    rows = roles.series(spark, sf).select("Site", "date", "id")
    return series.row_index(rows, ["Site"], SERIES_ORDER, weather.day_blocks()).drop("date")


@query(
    f"""
WITH {SERIES}
SELECT id, row_number() OVER (ORDER BY date, id) AS timestep FROM series"""
)
def row_index_global(spark, sf):
    rows = roles.series(spark, sf).select("date", "id")
    return series.row_index(rows, [], SERIES_ORDER, weather.day_blocks()).drop("date")


@query(f"WITH {MONTHS} SELECT id, yearmonth, months_after_planting FROM months")
def month_index(spark, sf):
    return roles.months(spark, sf).select("id", "yearmonth", "months_after_planting")


@query(
    f"""
WITH {SERIES},
complete AS (SELECT "Site", date, id, nullif(node % 7, 0) AS "T", x FROM series WHERE node % 7 <> 0),
{COMMON.format(table="complete")},
aligned AS (
  SELECT * FROM complete
  WHERE date BETWEEN (SELECT start_date FROM bounds) AND (SELECT end_date FROM bounds))
SELECT "Site", date, id, "T", CAST(x AS DOUBLE) AS x,
       row_number() OVER (PARTITION BY "Site" ORDER BY date, id) AS timestep,
       CAST(dense_rank() OVER (ORDER BY date_trunc('month', date)) - 18 AS INTEGER)
         AS months_after_planting
FROM aligned"""
)
def weather_preparation(spark, sf):
    raw = roles.series(spark, sf).select(
        "Site", "date", "id", F.nullif(F.col("node") % 7, F.lit(0)).alias("T"), "x"
    )
    prepared = weather.prepare_weather(raw, order=SERIES_ORDER, blocks=weather.day_blocks())
    return doubles(prepared.drop("yearmonth"))


@query(
    "\nUNION ALL ".join(
        f"""SELECT l_orderkey, l_linenumber, l_partkey, '{name}' AS variable, {name} AS value
FROM lineitem"""
        for name in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    )
)
def unpivot_measures(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    rows = read(spark, sf, "lineitem").select(
        *keys, "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    return reshape.to_long(rows, keys)


@query(
    """
SELECT c_custkey, 'PR' AS "Site", 1 AS duration, 25 AS rank_leaves_left FROM customer"""
)
def tag_constant(spark, sf):
    return reshape.tag(
        read(spark, sf, "customer").select("c_custkey"), Site="PR", duration=1, rank_leaves_left=25
    )


@query(
    """
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(nullif(l_tax, 0), 0) AS wind FROM lineitem"""
)
def fill_missing(spark, sf):
    wind = F.nullif(F.col("l_tax"), F.lit(0.0))
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", c.fill_missing(wind).alias("wind")
    )


@query(
    f"""
SELECT o_orderkey, o_totalprice * 60 * 60 * 24 * 1e-6 AS rg,
       o_totalprice * 60 * 60 * 24 * 1e-6 * {num(k.PAR_FRACTION)} AS par
FROM orders"""
)
def radiation_units(spark, sf):
    return read(spark, sf, "orders").select(
        "o_orderkey",
        c.irradiance_to_daily_mj("o_totalprice").alias("rg"),
        c.irradiance_to_daily_par("o_totalprice").alias("par"),
    )


@query(
    """
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN CAST(l_quantity AS INTEGER) - 25 < 0 THEN 0
            ELSE CAST(l_quantity AS INTEGER) - 25 END AS rank
FROM lineitem"""
)
def clamp_zero(spark, sf):
    rank = F.col("l_quantity").cast("int") - 25
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", c.clamp_zero(rank).alias("rank")
    )


@query(
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice - l_quantity AS surplus,
       CASE WHEN l_discount <> 0 THEN l_extendedprice / l_discount END AS ratio
FROM lineitem"""
)
def column_ratio(spark, sf):
    return read(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (F.col("l_extendedprice") - F.col("l_quantity")).alias("surplus"),
        c.ratio("l_extendedprice", "l_discount").alias("ratio"),
    )


AREA, FRESH = num(k.SCENE_AREA_M2), num(k.DRY_TO_FRESH)


@query(
    f"""
SELECT o_orderkey, o_totalprice * 1e-3 AS kg, o_totalprice * 1e-3 / 0.4857e0 AS dry_kg,
       o_totalprice * 1e-3 / 0.4857e0 * {FRESH} AS fresh_kg,
       o_totalprice * 1e-6 / 0.4857e0 * {FRESH} / {AREA} * 10000 AS fresh_t_ha,
       o_totalprice * 1e-6 / 0.45e0 / {AREA} * 10000 AS dry_t_ha,
       o_totalprice * 560e0 AS scaled
FROM orders"""
)
def yield_units(spark, sf):
    return read(spark, sf, "orders").select(
        "o_orderkey",
        c.grams_to_kg("o_totalprice").alias("kg"),
        c.carbon_to_dry_kg("o_totalprice").alias("dry_kg"),
        c.carbon_to_fresh_kg("o_totalprice").alias("fresh_kg"),
        c.carbon_to_fresh_t_ha("o_totalprice").alias("fresh_t_ha"),
        c.carbon_to_dry_t_ha("o_totalprice").alias("dry_t_ha"),
        (F.col("o_totalprice") * 560.0).alias("scaled"),
    )


@query(
    """
SELECT o_orderkey, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS days FROM orders"""
)
def parse_duration(spark, sf):
    return read(spark, sf, "orders").select(
        "o_orderkey", c.duration_days("o_orderpriority").alias("days")
    )


@query(
    f"""
WITH {roles.ORGANS}
SELECT timestep / 1000e0 AS timestep, CAST(sum(reserve) AS DOUBLE) / 1000 AS reserve_sum
FROM organs GROUP BY organs.timestep"""
)
def frame_scale(spark, sf):
    reserves = (
        roles.organs(spark, sf)
        .groupBy("timestep")
        .agg(F.sum("reserve").cast("double").alias("reserve_sum"))
    )
    return reshape.scale_frame(reserves, 1000)


COPIES = [
    ("1996-01-01", "1996-01-04", -2),
    ("2000-08-02", "2000-12-31", 1),
    ("1994-01-01", "1996-12-31", -3),
    ("1999-01-01", "2001-12-31", 3),
]


def _backfill_sql() -> str:
    steps = ["e0 AS (SELECT id, date FROM series)"]
    for i, (first, last, years) in enumerate(COPIES):
        steps.append(
            f"e{i + 1} AS (SELECT * FROM e{i} UNION ALL"
            f" SELECT id, CAST(date + INTERVAL ({years}) YEAR AS DATE) FROM e{i}"
            f" WHERE date BETWEEN DATE '{first}' AND DATE '{last}')"
        )
    return (
        f"WITH {SERIES}, {', '.join(steps)}"
        f" SELECT id, date FROM e{len(COPIES)} WHERE date >= DATE '1992-07-01'"
    )


@query(_backfill_sql())
def year_backfill(spark, sf):
    rows = roles.series(spark, sf).select("id", "date")
    return reshape.extend_years(rows, COPIES, start="1992-07-01")


@query(
    f"""
WITH extended AS ({_backfill_sql()})
SELECT id, date, row_number() OVER (ORDER BY date, id) AS timestep,
       CAST(dense_rank() OVER (ORDER BY date_trunc('month', date)) - 18 AS INTEGER)
         AS months_after_planting
FROM extended"""
)
def weather_extension(spark, sf):
    rows = roles.series(spark, sf).select("id", "date")
    generated = weather.generate_weather(
        rows, COPIES, "1992-07-01", order=SERIES_ORDER, blocks=weather.day_blocks()
    )
    return generated.drop("yearmonth")


@query(
    """
WITH rows AS (
  SELECT l_linestatus AS "Site", CAST(l_shipdate AS DATE) AS date, nullif(l_discount, 0) AS "T"
  FROM lineitem)
SELECT * FROM (
  SELECT 'T' AS "column", 'null' AS problem, count(*) FILTER (WHERE "T" IS NULL) AS n_bad FROM rows
  UNION ALL
  SELECT 'Site,date', 'repeated key', count(*) FILTER (WHERE n > 1)
  FROM (SELECT count(*) AS n FROM rows GROUP BY "Site", date)
  UNION ALL
  SELECT 'timestep', 'missing column', 1)
WHERE n_bad > 0"""
)
def check_weather_contract(spark, sf):
    rows = read(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("Site"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("T"),
    )
    expected = StructType(
        [
            StructField("Site", StringType()),
            StructField("date", DateType()),
            StructField("timestep", IntegerType()),
            StructField("T", DoubleType()),
        ]
    )
    return contract.contract_violations(rows, expected)


@query(
    f"""
WITH {SERIES} SELECT "Site", date, id, CAST(x AS DOUBLE) AS x FROM series"""
)
def scan_csv(spark, sf):
    rows = roles.series(spark, sf).select("Site", "date", "id", "x")
    path = shared.scratch_path(spark, "csv")
    files.write_csv(rows, path, compression="bzip2")
    return files.scan_csv(spark, path, "Site string, date date, id bigint, x double")


@query(
    """
SELECT c_custkey, c_nationkey AS "Site", n_nationkey * 0.25e0 AS latitude,
       CASE WHEN n_regionkey <> 0 THEN n_nationkey * 10e0 ELSE 15.5e0 END AS altitude
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""
)
def param_lookup(spark, sf):
    nation = read(spark, sf, "nation")
    site = F.col("n_nationkey").alias("Site")
    latitude = nation.select(
        site,
        F.lit("plot.latitude").alias("path"),
        (F.col("n_nationkey") * 0.25).cast("string").alias("value"),
    )
    altitude = nation.where("n_regionkey <> 0").select(
        site,
        F.lit("plot.altitude").alias("path"),
        (F.col("n_nationkey") * 10.0).cast("string").alias("value"),
    )
    plots = read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("Site"))
    return joins.attach_parameters(
        plots,
        reshape.unite([latitude, altitude]),
        "Site",
        {"latitude": "plot.latitude", "altitude": "plot.altitude"},
        defaults={"plot.altitude": 15.5},
    )


@query(
    """
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN l_discount = 0 THEN 0 ELSE l_discount END AS filled
FROM lineitem"""
)
def fill_nan(spark, sf):
    nan = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount"))
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", c.fill_nan(nan).alias("filled")
    )


@query(
    f"""
WITH {SERIES}
SELECT id, CAST(date + INTERVAL 3 YEAR AS DATE) AS later,
       CAST(date - INTERVAL 18 MONTH AS DATE) AS earlier, CAST(date + INTERVAL 1 DAY AS DATE) AS next_day,
       make_date(year(date), 1, 1) AS year_date, CAST(year(date) - 1992 AS INTEGER) AS gap
FROM series"""
)
def date_shifts(spark, sf):
    return roles.series(spark, sf).select(
        "id",
        c.shift_years("date", 3).alias("later"),
        c.shift_months("date", -18).alias("earlier"),
        F.date_add("date", 1).alias("next_day"),
        c.year_start(F.year("date")).alias("year_date"),
        c.year_gap("date", F.lit("1992-07-01").cast("date")).alias("gap"),
    )


@query(
    f"""
WITH {SERIES} SELECT date, id, CAST(x AS DOUBLE) AS x, "Site" FROM series"""
)
def write_by_site(spark, sf):
    path = shared.scratch_path(spark, "by-site")
    files.write_by(roles.series(spark, sf).select("Site", "date", "id", "x"), path)
    return doubles(files.scan_parquet(spark, path))
