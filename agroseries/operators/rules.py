"""Pruning and phenology rules applied to whole observation tables.

A rule that the simulation applies leaf by leaf and day by day becomes a conditional minimum: the
first step at which a condition holds. Asked per leaf it is a plain aggregation, which is reduced on the
map side; asked per row it is a running minimum along the leaf.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agroseries.functions import constants as k
from agroseries.operators.ordered import Blocks, Carry, scan

LEAF = ("Site", "node")


def _first_step(condition: Column, step: str) -> Column:
    return F.min(F.when(condition, F.col(step)))


def _in_window(rank: str, date: str, least: int, start: object, end: object) -> Column:
    inside = F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return (F.col(rank) >= least) & inside


def _decision(fired: Column, window: Column, rank: Column) -> Column:
    """Label of the step that fired; the window goes before the rank, the rank before the harvest."""
    return (
        F.when(window == fired, F.lit(k.PRUNED_IN_WINDOW))
        .when(rank == fired, F.lit(k.PRUNED_AT_RANK))
        .when(fired.isNotNull(), F.lit(k.PRUNED_AT_HARVEST))
        .otherwise(F.lit(k.UNDETERMINED))
    )


def prune_decision(
    df: DataFrame,
    rank_window: int,
    start: object,
    end: object,
    rank_max: int = k.RANK_PRUNING,
    keys: Sequence[str] = LEAF,
    step: str = "timestep",
    rank: str = "rank",
    state: str = "state",
    date: str = "date",
    litter: str | None = None,
    blocks: Blocks = None,
) -> DataFrame:
    """Every row with the decision in force: it holds from the step that fired to the end.

    A leaf is pruned at its first step with rank above ``rank_max``, state ``Pruned``, or rank of at
    least ``rank_window`` between the dates. ``litter`` adds ``litter_leaf``, its value at that step.
    Rows without a step are not pruned. Keys are compared as grouping does, so a leaf with a NULL key
    is a leaf like any other.

    The first firing row is carried along the leaf, so the table is read and shuffled once. ``step`` is
    unique per leaf, which bounds a leaf by the calendar; where it is not (many rows without a key),
    ``blocks`` cuts the leaf as in ``ordered.scan``.
    """
    window = _in_window(rank, date, rank_window, start, end)
    above = F.col(rank) > rank_max
    fires = (window | above | (F.col(state) == k.PRUNED)) & F.col(step).isNotNull()
    held = [
        F.col(step).alias("step"),
        F.when(window, F.col(step)).alias("window"),
        F.when(above, F.col(step)).alias("rank"),
        *([F.col(litter).alias("litter")] if litter else []),
    ]
    fired = Carry(F.when(fires, F.struct(*held)), F.min, F.min)
    result = scan(df, keys, [step], {"_fired": fired}, blocks)
    decision = _decision(F.col("_fired.step"), F.col("_fired.window"), F.col("_fired.rank"))
    made = {"is_pruned": F.col("_fired").isNotNull(), "pruning_decision": decision}
    if litter:
        made["litter_leaf"] = F.col("_fired.litter")
    return result.withColumns(made).drop("_fired")


def prune_effects(
    df: DataFrame,
    rank_window: int,
    start: object,
    end: object,
    emptied: Sequence[str] = ("leaf_area", "biomass", "reserve"),
    biomass: str = "biomass",
    state: str = "state",
    **options,
) -> DataFrame:
    """Decisions with their effects: from the firing step on the leaf is empty and ``Pruned``.

    ``litter_leaf`` is the biomass at the firing step; it is NULL before.
    """
    decided = prune_decision(df, rank_window, start, end, litter=biomass, state=state, **options)
    emptying = {
        name: F.when(F.col("is_pruned"), F.lit(0).cast(df.schema[name].dataType)).otherwise(F.col(name))
        for name in emptied
        if name in df.columns
    }
    new_state = F.when(F.col("is_pruned"), F.lit(k.PRUNED)).otherwise(F.col(state))
    return decided.withColumns({**emptying, state: new_state})


def _scenario_table(spark: SparkSession, scenarios: DataFrame | Sequence[Mapping[str, object]]) -> DataFrame:
    """(rank_leaves_left, window_duration, start_date, end_date) of a table or of mappings."""
    if not isinstance(scenarios, DataFrame):
        rows = [(s["rank_leaves_left"], s["window_duration"], str(s["start_date"]), str(s["end_date"])) for s in scenarios]
        names = "rank_leaves_left int, window_duration int, start_date string, end_date string"
        scenarios = spark.createDataFrame(rows, names)
    dates = [F.col(name).cast("date").alias(name) for name in ("start_date", "end_date")]
    return scenarios.select("rank_leaves_left", "window_duration", *dates)


def _calendar_cuts(scenarios: DataFrame) -> DataFrame:
    """(_day, _from): every day inside some window, and the last day up to it on which a window begins or has ended.

    Every window then consists of whole stretches of equal ``_from``. Bounded by the calendar, as is the window here.
    """
    ends = F.array("start_date", F.date_add("end_date", 1))
    ahead = scenarios.where(F.col("start_date") <= F.col("end_date"))
    cuts = ahead.select(F.explode(ends).alias("_from")).distinct()
    cuts = cuts.withColumn("_next", F.lead("_from").over(Window.orderBy("_from"))).where(F.col("_next").isNotNull())
    return cuts.select("_from", F.explode(F.sequence("_from", F.date_sub("_next", 1))).alias("_day"))


def prune_sweep(
    df: DataFrame,
    scenarios: DataFrame | Sequence[Mapping[str, object]],
    rank_max: int = k.RANK_PRUNING,
    keys: Sequence[str] = LEAF,
    step: str = "timestep",
    rank: str = "rank",
    state: str = "state",
    date: str = "date",
    parts: int = 1,
) -> DataFrame:
    """Pruning of every leaf under every scenario, a row each.

    ``scenarios`` is a table, or mappings, of ``rank_leaves_left``, ``window_duration``, ``start_date`` and
    ``end_date``; equal scenarios stay scenarios of their own. Only the window condition differs between them. Their dates cut the calendar into
    stretches, and a leaf is summed up, on the map side first, as the first step at which it showed a
    rank in a stretch. A scenario takes the least of those inside its window with rank enough. The plan
    is the same for any number of scenarios, the rows of the leaf table are never multiplied, and the
    scenarios are laid out after the aggregation, from ``parts`` lists of them.
    """
    table = _scenario_table(df.sparkSession, scenarios)
    used = [*keys, step, rank, state, F.col(date).cast("date").alias("_day")]
    dated = df.select(*used).join(_calendar_cuts(table), "_day", "left")
    shown = dated.withColumn("_shown", F.when(F.col("_from").isNotNull(), F.col(rank)))
    stairs = shown.groupBy(*keys, "_from", "_shown").agg(
        F.min(step).alias("_step"),
        _first_step(F.col(rank) > rank_max, step).alias("_rank"),
        _first_step(F.col(state) == k.PRUNED, step).alias("_harvest"),
    )
    stair = F.when(F.col("_shown").isNotNull(), F.struct("_from", "_shown", "_step"))
    leaves = stairs.groupBy(*keys).agg(
        F.min("_rank").alias("_rank"), F.min("_harvest").alias("_harvest"), F.collect_list(stair).alias("_stairs")
    )
    part = F.pmod(F.xxhash64(*table.columns), F.lit(parts)).cast("int").alias("_part")
    lists = table.groupBy(part).agg(F.collect_list(F.struct(*table.columns)).alias("_list"))
    each = leaves.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = each.join(lists, "_part").withColumn("_s", F.explode("_list")).select(
        *keys, "_rank", "_harvest", "_stairs", "_s.*"
    )
    inside = F.filter(
        "_stairs",
        lambda s: (s["_shown"] >= F.col("rank_leaves_left")) & s["_from"].between(F.col("start_date"), F.col("end_date")),
    )
    rows = rows.withColumn("_window", F.array_min(F.transform(inside, lambda s: s["_step"])))
    fired = F.least("_window", "_rank", "_harvest")
    decision = _decision(fired, F.col("_window"), F.col("_rank"))
    return rows.select(
        *keys, "rank_leaves_left", "window_duration", fired.alias("fired_at"), decision.alias("pruning_decision")
    )


def inflorescence_state(
    df: DataFrame,
    tt_flowering: float = k.TT_FLOWERING,
    tt_harvest: float = k.TT_HARVEST,
    duration_flowering_male: float = k.DURATION_FLOWERING_MALE,
    duration_fruit_setting: float = k.DURATION_FRUIT_SETTING,
    fraction_oleosynthesis: float = k.FRACTION_OLEOSYNTHESIS,
    event_rank: int = k.EVENT_RANK,
    event_start: int = k.EVENT_AGE_START,
    event_end: int = k.EVENT_AGE_END,
    sex: str = "sex",
    thermal_time: str = "TT_since_init",
    rank: str = "rank",
    age: str = "plant_age",
    state: str = "state",
) -> DataFrame:
    """Phenological state from thermal time, and whether the leaf counts as harvested.

    An aborted inflorescence keeps its state. Males pass their thresholds strictly, females from
    equality on. The event harvests the female at exactly ``event_rank`` while the plant is in the
    age window, and marks the leaf in any case.
    """
    fruiting = tt_flowering + duration_fruit_setting
    tt_oleosynthesis = fruiting + (1 - fraction_oleosynthesis) * (tt_harvest - fruiting)
    tt_senescence = tt_flowering + duration_flowering_male

    heat = F.col(thermal_time)
    event = (F.col(rank) == event_rank) & F.col(age).between(event_start, event_end)
    aborted = F.coalesce(F.col(state) == k.ABORTED, F.lit(False))
    ripe = (F.col(sex) == "Female") & (event | (heat >= tt_harvest))

    male = (
        F.when(heat > tt_senescence, F.lit(k.SENESCENT))
        .when(heat > tt_flowering, F.lit(k.FLOWERING))
        .otherwise(F.col(state))
    )
    female = (
        F.when(ripe, F.lit(k.HARVESTED))
        .when(heat >= tt_oleosynthesis, F.lit(k.OLEOSYNTHESIS))
        .when(heat >= tt_flowering, F.lit(k.FLOWERING))
        .otherwise(F.col(state))
    )
    new_state = (
        F.when(aborted, F.col(state))
        .when(F.col(sex) == "Male", male)
        .when(F.col(sex) == "Female", female)
        .otherwise(F.col(state))
    )
    leaf = F.coalesce(event | (~aborted & ripe), F.lit(False))
    return df.withColumns({state: new_state, "leaf_harvested": leaf})


def propagate_harvest(
    pruned: DataFrame | str,
    edges: DataFrame,
    node: str = "node",
    sexes: Sequence[str] = ("Female", "Male"),
) -> DataFrame:
    """Nodes that become ``Harvested`` because a leaf was pruned.

    ``edges`` holds (node, parent, symbol) of a tree; an edge given twice counts once. A pruned leaf
    harvests its phytomer, two edges up, and the inflorescence beside it on the internode when there is
    exactly one. ``pruned`` is a table of leaves, or the name of a boolean column of ``edges`` that marks them, which
    spares a second read. A leaf without a parent harvests nothing.

    There is no join: marks meet edges in one grouping by node, and each edge then reports twice in one
    grouping by internode, to its parent (marks and inflorescences) and to its own node (what lies above).
    """
    edge = F.struct("parent", "symbol")
    if isinstance(pruned, str):
        tagged = edges.select("node", edge.alias("edge"), F.col(pruned).alias("mark"))
    else:
        marks = pruned.select(F.col(node).alias("node"), F.lit(None).alias("edge"), F.lit(True).alias("mark"))
        tagged = edges.select("node", edge.alias("edge"), F.lit(False).alias("mark"))
        tagged = tagged.unionByName(marks.where(F.col("node").isNotNull()))
    nodes = tagged.groupBy("node").agg(F.max("mark").alias("mark"), F.collect_set("edge").alias("edges"))
    known = nodes.select("node", "mark", F.inline("edges"))
    flower = F.when(F.col("symbol").isin(*sexes), F.col("node"))
    kind = edges.schema["node"].dataType
    own, parent, none = F.col("node"), F.col("parent").cast(kind), F.lit(None).cast(kind)
    unmarked = F.lit(None).cast("boolean")
    to_parent = F.struct(parent.alias("internode"), "mark", flower.alias("flower"), none.alias("above"))
    to_itself = F.struct(own.alias("internode"), unmarked.alias("mark"), none.alias("flower"), parent.alias("above"))
    reports = known.select(F.inline(F.array(to_parent, to_itself))).where(F.col("internode").isNotNull())
    internodes = reports.groupBy("internode").agg(
        F.max("mark").alias("mark"),
        F.count("flower").alias("n"),
        F.min("flower").alias("flower"),
        F.collect_set("above").alias("above"),
    )
    beside = F.when(F.col("n") == 1, F.col("flower"))
    reached = internodes.where("mark").select(F.explode(F.array_append("above", beside)).alias("node"))
    return reached.where(F.col("node").isNotNull()).distinct().withColumn("state", F.lit(k.HARVESTED))
