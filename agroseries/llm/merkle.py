"""Merkle manifest of a dataset, by a cogrouped subtree exchange.

Every row is a leaf; the leaves of a group stand in the order of their ids and are hashed in runs of
eight until one node, the subroot, is left; the subroots are hashed the same way to the root.

A *superblock* is a run of ``8 ** height`` consecutive leaves of a group. First each superblock is
reduced to its top. The tops, one row per superblock, are reduced level by level in joins and
groupings of eight rows, and on the way down each node receives the siblings of its ancestors from
its parent alone. So a superblock ends up with the few outer nodes that its leaves need. Leaves and outer
nodes are then cogrouped by superblock, and one pass over the group finishes the local reduction,
joins local and outer siblings to proofs, and folds every (perhaps changed) leaf to a root.

Ranks come from range partitions of (group, id) and their row counts, so a group that holds most
rows is spread like any other. Only digests are shuffled, never texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agroseries.sources.shared import saved

FAN, HEIGHT = 8, 3
GROUP = ("__none", "__group")
IN_PART = (1 << 33) - 1  # the low bits of monotonically_increasing_id count the rows of a partition


def encoded(values: Sequence[Column]) -> Column:
    """``-`` for a null, else byte count, ``:`` and the value, one after the other."""

    def one(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.concat(*map(one, values))


def digest(values: Sequence[Column]) -> Column:
    return F.sha2(encoded(values), 256)


def fold(leaf: Column, before: Column, after: Column) -> Column:
    """Root from a leaf and its proof; what a reader of the manifest needs to verify a row."""
    levels = F.arrays_zip(before.alias("before"), after.alias("after"))
    return F.aggregate(levels, leaf, lambda h, x: F.sha2(F.concat(x["before"], h, x["after"]), 256))


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Columns ``pos`` (0-based rank in ``by``) and ``n`` (rows of ``by``), without a window over rows."""
    keys = [*by, *order]
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit(IN_PART))
    laid = saved(laid.withColumns({"__part": F.spark_partition_id(), "__at": at}), "ranked")
    spans = laid.groupBy("__part", *by).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    series = Window.partitionBy(*by)
    earlier = series.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("__rows").over(earlier), F.lit(0))
    spans = spans.withColumns({"__base": base, "n": F.sum("__rows").over(series)})
    spans = saved(spans, "spans")  # a row per partition and group, so the planner knows its size
    placed = laid.join(spans, ["__part", *by])
    pos = F.col("__base") + F.col("__at") - F.col("__first")
    return placed.withColumn("pos", pos).drop("__part", "__at", "__first", "__rows", "__base")


def _run(digests: Sequence[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def _levels(nodes: list[str], total: int, height: int) -> list[list[str]]:
    """Nodes of a superblock from the leaves up; a group of ``total`` leaves may end below ``height``."""
    levels = [nodes]
    while total > 1 and len(levels) <= height:
        below = levels[-1]
        levels.append([_run(below[i : i + FAN]) for i in range(0, len(below), FAN)])
        total = -(-total // FAN)
    return levels


def _climb(nodes: DataFrame, by: Sequence[str]) -> tuple[list[DataFrame], list[DataFrame]]:
    """Runs of each level, and the nodes of each level that are the last of their tree.

    ``nodes``: ``by``, pos, digest, n (nodes of the tree at this level). Level after level has an
    eighth of the rows.
    """
    runs, tops, level = [], [], saved(nodes, "nodes")
    while True:
        tops.append(level.where("n = 1"))
        several = level.where("n > 1")
        if several.isEmpty():
            return runs, tops
        run = F.floor(F.col("pos") / FAN).cast("bigint")
        members = F.sort_array(F.collect_list(F.struct("pos", "digest")))
        grouped = several.groupBy(*by, run.alias("run")).agg(members.alias("members"), F.max("n").alias("n"))
        digests = F.col("members.digest")
        made = F.sha2(F.array_join(digests, ""), 256)
        above = F.ceil(F.col("n") / FAN).cast("bigint")
        runs.append(saved(grouped.select(*by, "run", digests.alias("digests"), made.alias("digest"), above.alias("n")), "runs"))
        level = runs[-1].select(*by, F.col("run").alias("pos"), "digest", "n")


def _descend(runs: list[DataFrame], tops: list[DataFrame], by: Sequence[str], start: DataFrame) -> DataFrame:
    """Siblings of every lowest node and of its ancestors, lowest level first.

    ``start`` has what lies above each tree: before, after and further columns, all handed down. A
    parent meets at most eight children, so no key of these joins is hot.
    """
    handed = [c for c in start.columns if c not in by]
    top = lambda k: tops[k].select(*by, "pos").join(start, list(by))
    proof = top(len(runs))
    for k in reversed(range(len(runs))):
        parents = proof.withColumnRenamed("pos", "run")
        children = runs[k].drop("digest", "n").join(parents, [*by, "run"])
        children = children.select("*", F.posexplode("digests").alias("i", "own"))
        lower = lambda start_at, n: F.array(F.array_join(F.slice("digests", start_at, n), ""))
        children = children.withColumns(
            {
                "pos": F.col("run") * FAN + F.col("i"),
                "before": F.concat(lower(F.lit(1), F.col("i")), "before"),
                "after": F.concat(lower(F.col("i") + 2, F.lit(FAN)), "after"),
            }
        )
        proof = children.select(*by, "pos", *handed).unionByName(top(k))
    return proof


def manifest(
    df: DataFrame, id_col: str, group_col: str, leaf: Column, changed: Column | None = None, height: int = HEIGHT
) -> DataFrame:
    """One row per row of ``df``: id, group, pos, leaf, subroot, root, before, after, folded.

    ``leaf`` is the digest of a row, as lowercase hex, and ``changed`` the digest it is verified with
    (null: the leaf itself); ``folded`` is the root recomputed from that digest and the proof. The
    proof lists, level by level up to the root, the joined digests of the siblings before and
    after. Groups are ordered bytewise, the null group (one of its own) first. Leaves ascend by id, null ids
    first; rows with equal ids are ordered by digest, and rows equal in both are leaves of their
    own. A null leaf is an error of the caller and raises. Other columns are ignored; an empty table gives no row.
    """
    by = list(GROUP)
    group = F.col(group_col)
    sure = F.coalesce(leaf, F.raise_error(F.lit("a leaf without a digest")).cast("string"))
    rows = df.select(
        group.isNotNull().alias(by[0]),
        F.coalesce(group.cast("string"), F.lit("")).alias(by[1]),
        F.col(id_col).alias("id"),
        F.col(id_col).cast("string").alias("name"),  # pandas would make floats of integers beside a null
        sure.alias("leaf"),
        (F.lit(None).cast("string") if changed is None else changed).alias("changed"),
    )
    # the last key splits rows that are equal in all others
    leaves = ranked(rows, by, [F.col("id").asc_nulls_first(), "leaf", F.monotonically_increasing_id()]).drop("id")
    size = FAN**height
    block = F.floor(F.col("pos") / size).cast("bigint")
    leaves = leaves.withColumn("block", block)

    def top(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part, total = part.sort_values("pos"), int(part["n"].iloc[0])
        return pd.DataFrame([[*key, _levels(list(part["leaf"]), total, height)[-1][0], -(-total // size)]])

    blocks = leaves.select(*by, "block", "pos", "leaf", "n").groupBy(*by, "block")
    tops = blocks.applyInPandas(top, f"{by[0]} boolean, {by[1]} string, pos bigint, digest string, n bigint")
    runs, ends = _climb(tops, by)

    subroots = ends[0].select(*by, "digest")
    for more in ends[1:]:
        subroots = subroots.unionByName(more.select(*by, "digest"))
    groups = ranked(subroots.withColumn("all", F.lit(1)), ["all"], by)
    groups = saved(groups, "groups")
    group_runs, group_ends = _climb(groups.select("all", "pos", "digest", "n"), ["all"])
    root = group_ends[-1].select("all", F.col("digest").alias("root"))
    none = F.array().cast("array<string>")
    start = root.select("all", "root", none.alias("before"), none.alias("after"))
    over = _descend(group_runs, group_ends, ["all"], start).join(groups, ["all", "pos"])
    over = saved(over.select(*by, F.col("digest").alias("subroot"), "root", "before", "after"), "subroots")
    outer = _descend(runs, ends, by, over).withColumnRenamed("pos", "block")

    schema = T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("group", T.StringType()),
            T.StructField("pos", T.LongType()),
            *[T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root")],
            *[T.StructField(c, T.ArrayType(T.StringType())) for c in ("before", "after")],
            T.StructField("folded", T.StringType()),
        ]
    )

    def finish(key: tuple, own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos")
        levels = _levels(list(own["leaf"]), int(own["n"].iloc[0]), height)
        beside = []
        for nodes in levels[:-1]:
            run = lambda i, nodes=nodes: nodes[i - i % FAN : i - i % FAN + FAN]
            beside.append([("".join(run(i)[: i % FAN]), "".join(run(i)[i % FAN + 1 :])) for i in range(len(nodes))])
        above = list(zip(others["before"].iloc[0], others["after"].iloc[0], strict=True))
        proofs, folded = [], []
        for i, (leaf, changed) in enumerate(zip(own["leaf"], own["changed"], strict=True)):
            proof = [at[i // FAN**k] for k, at in enumerate(beside)] + above
            node = changed if isinstance(changed, str) else leaf
            for before, after in proof:
                node = _run([before, node, after])
            proofs.append(proof)
            folded.append(node)
        return own[["name", "pos", "leaf"]].rename(columns={"name": "id"}).assign(
            group=key[1] if key[0] else None,
            subroot=others["subroot"].iloc[0],
            root=others["root"].iloc[0],
            before=[[b for b, _ in p] for p in proofs],
            after=[[a for _, a in p] for p in proofs],
            folded=folded,
        )[schema.names]

    left, right = (x.groupBy(*by, "block") for x in (leaves, outer))
    made = left.cogroup(right).applyInPandas(finish, schema)
    types = {"id": df.schema[id_col].dataType, "group": df.schema[group_col].dataType}
    return made.withColumns({c: F.col(c).cast(kind) for c, kind in types.items()})
