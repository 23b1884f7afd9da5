"""Site comparison: outputs joined to weather, rolled up, converted and set against observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agroseries.functions import aggregates as a
from agroseries.functions import columns as c
from agroseries.functions import constants as k
from agroseries.operators.joins import join_complete, join_weather
from agroseries.operators.rollup import rollup, year_rollup
from agroseries.operators.series import running_sum

SITE_MONTH = ("Site", "months_after_planting")


def plant_months(
    plant: DataFrame, weather: DataFrame | None = None, keys: Sequence[str] = SITE_MONTH
) -> DataFrame:
    """Monthly harvest, emission and thermal time per site, with the harvest in fresh kg."""
    joined = plant if weather is None else join_weather(plant, weather)
    months = rollup(
        joined,
        keys,
        "timestep",
        month="date",
        span="timestep",
        sums={
            "TEff": "TEff",
            "biomass_bunch_harvested_monthly": "biomass_bunch_harvested",
            "n_bunches_harvested_monthly": "n_bunches_harvested",
        },
        lasts={
            "biomass_bunch_harvested_cum": "biomass_bunch_harvested_cum",
            "n_bunches_harvested_cum": "n_bunches_harvested_cum",
            "phytomer_count": "phytomer_count",
        },
        gains={"phytomer_emitted": "phytomer_count"},
    )
    harvest = F.col("biomass_bunch_harvested_monthly").cast("double")
    return months.withColumn("ffb_kg", c.carbon_to_fresh_kg(harvest))


def plant_years(plant: DataFrame, keys: Sequence[str] = ("Site",)) -> DataFrame:
    """Yearly harvest per site, in grams of carbon, fresh kg per plant and t/ha."""
    years = year_rollup(
        plant,
        keys,
        span="timestep",
        sums={"TEff": "TEff", "biomass_bunch_harvested": "biomass_bunch_harvested"},
    )
    harvest = F.col("biomass_bunch_harvested").cast("double")
    return years.withColumns(
        {
            "ffb_kg": c.carbon_to_fresh_kg(harvest),
            "ffb_t_ha": c.carbon_to_fresh_t_ha(harvest),
            "year_date": c.year_start("year"),
        }
    )


def female_months(
    female: DataFrame, keys: Sequence[str] = SITE_MONTH, order: a.Order = "timestep"
) -> DataFrame:
    """Bunches per month: number and mass harvested, and the mean mass of those with any."""
    mass = "biomass_bunch_harvested"
    return rollup(
        female,
        keys,
        order,
        month="date",
        span="timestep",
        counts={"n_bunches_harvested": F.col("state") == k.HARVESTED},
        sums={mass: mass},
        others={f"{mass}_average": a.mean_where(mass, F.col(mass) > 0)},
    )


def male_months(
    male: DataFrame, keys: Sequence[str] = SITE_MONTH, order: a.Order = "timestep"
) -> DataFrame:
    """Male inflorescences per month by state, with the mean mass of the senescent ones (0 if none)."""
    senescent = F.col("state") == k.SENESCENT
    return rollup(
        male,
        keys,
        order,
        month="date",
        span="timestep",
        counts={
            "n_males_harvested": F.col("state") == k.HARVESTED,
            "n_males_senescent": senescent,
        },
        others={
            "biomass_avg": F.coalesce(a.mean_where("biomass", senescent), F.lit(0.0)),
        },
    )


def emitted_leaves(
    leaf: DataFrame, keys: Sequence[str] = ("Site", "timestep"), rank_above: int = 0
) -> DataFrame:
    """Leaves per step with a rank above a limit."""
    return rollup(leaf, keys, counts={"rank": F.col("rank") > rank_above})


def compare_observations(
    observed: DataFrame,
    months: DataFrame,
    series: Sequence[str] = ("site", "genotype"),
    order: Sequence[str] = ("months_after_planting",),
    emitted: str = "nb_leaves_emitted",
) -> DataFrame:
    """Observed beside simulated emission, both accumulated, and emission per degree day.

    Months without a simulated or an observed value are dropped after the observed values are
    accumulated and before the simulated ones are. Both tables hold one row per month, so a series is no longer
    than the calendar and its window needs no blocks.
    """
    accumulated = running_sum(
        observed, series, order, {f"{emitted}_cum": emitted}
    )
    simulated = months.select(
        "Site", "date", "TEff", F.col("phytomer_emitted").alias(f"{emitted}_sim")
    )
    both = join_complete(accumulated, simulated, {"site": "Site", "date": "date"})
    compared = running_sum(
        both, series, order, {f"{emitted}_cum_sim": f"{emitted}_sim"}
    )
    per_heat = c.ratio(F.col(emitted).cast("double"), F.col("TEff").cast("double"))
    return compared.withColumn(f"{emitted}_per_TEff", per_heat)
