"""Scenario sweep: outputs of all scenarios rolled up and compared with a baseline scenario."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agroseries.functions import columns as c
from agroseries.operators.joins import relative_to_baseline
from agroseries.operators.rollup import rollup, year_rollup
from agroseries.operators.scenario import SCENARIO, loss_at_end

HARVEST = "biomass_bunch_harvested"
FRUIT = "biomass_fruit_harvested"
BUNCHES = "n_bunches_harvested"


def scenario_months(
    plant: DataFrame,
    keys: Sequence[str] = ("months_after_planting", *SCENARIO),
    step: str = "timestep",
) -> DataFrame:
    """Harvest, bunches and phytomers per month of each scenario, as far as ``plant`` has them."""
    there = set(plant.columns)
    sums = {f"{HARVEST}_monthly": HARVEST, f"{BUNCHES}_monthly": BUNCHES}
    lasts = {name: name for name in (f"{HARVEST}_cum", f"{BUNCHES}_cum", "phytomer_count")}
    gains = {"phytomer_emitted": "phytomer_count"}
    present = lambda pairs: {out: source for out, source in pairs.items() if source in there}
    return rollup(
        plant,
        keys,
        step,
        month="date",
        span=step,
        sums=present(sums),
        lasts=present(lasts),
        gains=present(gains),
    )


def scenario_years(
    plant: DataFrame, keys: Sequence[str] = SCENARIO, step: str = "timestep"
) -> DataFrame:
    """Harvest per year of each scenario; fruit mass and both yields in t/ha if ``plant`` has fruit."""
    fruit = FRUIT in plant.columns
    years = year_rollup(
        plant,
        keys,
        order=step,
        span=step,
        sums={name: name for name in ([HARVEST, FRUIT] if fruit else [HARVEST])},
        lasts={f"{HARVEST}_cum": f"{HARVEST}_cum"},
    )
    if not fruit:
        return years
    t_ha = lambda name: c.carbon_to_fresh_t_ha(F.col(name).cast("double"))
    return years.withColumns({"ffb_t_ha": t_ha(HARVEST), "fruit_t_ha": t_ha(FRUIT)})


def scenario_relative(
    months: DataFrame,
    baseline: Column | str,
    since: str | None = None,
    on: Sequence[str] = ("months_after_planting",),
    value: str = f"{HARVEST}_cum",
) -> DataFrame:
    """Cumulated harvest over the baseline's in the same month.

    ``since`` keeps the months that start after that day; the month that starts on it is left out.
    """
    relative = relative_to_baseline(months, on, baseline, value, f"{value}_rel")
    return relative if since is None else relative.where(F.col("date") > F.lit(since).cast("date"))


def scenario_loss(
    months: DataFrame, baseline: Column | str, since: str, keys: Sequence[str] = SCENARIO
) -> DataFrame:
    """Final loss of each scenario against the baseline."""
    relative = scenario_relative(months, baseline, since)
    return loss_at_end(relative, f"{HARVEST}_cum_rel", "months_after_planting", keys)
