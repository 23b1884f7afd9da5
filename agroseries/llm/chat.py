"""Reply trees: root-to-leaf paths by self-joins, the best branches, one conversation per path.

Paths are enumerated with doubling self-joins: round k joins every message with its ancestor 2^k
steps up, so a tree of depth d takes log2(d) rounds. Depth and score of a branch come out of the same
rounds; only the branches that win are then expanded to their messages.

Template of a turn: ``<|im_start|>role LF text<|im_end|> LF``. Control strings inside a text are made
harmless reversibly: "<", any backslashes and "|" get one backslash more before the "|".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agroseries.sources.shared import saved

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
ROUNDS = 48


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _same(left: DataFrame, right: DataFrame, step: str) -> Column:
    return left["tree"].eqNullSafe(right["__tree"]) & (left[step] == right["__node"])


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Jump tables, and (tree, node, depth, total) of every message up to its root.

    Table k (tree, node, up, depth) jumps up to 2^k messages towards the root. ``depth`` counts the
    messages and ``total`` sums the scores from the node to just below ``up``, at last to the root.
    Only messages that have not reached their root go through another round.
    """
    parents = nodes.select(F.col("tree").alias("__tree"), F.col("node").alias("__node"))
    first = nodes.join(parents, _same(nodes, parents, "parent"), "left").select(
        "tree", "node", F.col("__node").alias("up"), F.lit(1).cast("bigint").alias("depth"),
        F.col("score").alias("total"),
    )
    level, jumps, whole = saved(first, "climb"), [], None
    while True:
        done, open_ = level.where(F.col("up").isNull()), level.where(F.col("up").isNotNull())
        whole = done if whole is None else whole.unionByName(done)
        if open_.isEmpty():
            return jumps, whole.select("tree", "node", "depth", "total")
        if len(jumps) > ROUNDS:
            raise ValueError("a message is its own ancestor")
        jumps.append(open_)
        above = whole.unionByName(open_).toDF("__tree", "__node", "__up", "__depth", "__total")
        doubled = open_.join(above, _same(open_, above, "up")).select(
            "tree", "node", F.col("__up").alias("up"),
            (F.col("depth") + F.col("__depth")).alias("depth"),
            (F.col("total") + F.col("__total")).alias("total"),
        )
        level = saved(doubled, "climb")


def best_paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, node, place, rank): the messages of the ``best`` branches of every tree.

    ``nodes``: tree, node (unique in its tree), parent, score. Branches are ranked by mean score,
    then longer first, then smaller leaf. A missing parent makes a message a root; null scores
    count 0; a loop raises an error.
    """
    nodes = saved(
        nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")),
        "nodes",
    )
    jumps, whole = climb(nodes)
    replies = nodes.select(F.col("tree").alias("__tree"), F.col("parent").alias("__node"))
    leaves = whole.join(replies, _same(whole, replies, "node"), "left_anti")
    order = Window.partitionBy("tree").orderBy(
        F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node"
    )
    ranked = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    path = ranked.select(
        "tree", F.col("node").alias("leaf"), "rank", "node", (F.col("depth") - 1).alias("place")
    )
    for table in reversed(jumps):  # the longest jump first, so that few rows pass many rounds
        jump = table.select(
            F.col("tree").alias("__tree"), F.col("node").alias("__node"), "up", "depth"
        )
        stay = F.struct("node", "place")
        move = F.struct(F.col("up").alias("node"), (F.col("place") - F.col("depth")).alias("place"))
        both = F.when(F.col("up").isNull(), F.array(stay)).otherwise(F.array(stay, move))
        path = path.join(jump, _same(path, jump, "node"), "left").select(
            "tree", "leaf", "rank", F.inline(both)
        )
    return path


def format_paths(messages: DataFrame, path: DataFrame) -> DataFrame:
    """One row per path: ``formatted`` text and ``loss``, the spans of assistant texts in it.

    ``messages``: tree, node, role, text (null role or text: empty). Spans count code points of
    ``formatted``, end exclusive.
    """
    said = messages.select(
        F.col("tree").alias("__tree"), F.col("node").alias("__node"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = path.join(said, _same(path, said, "node"))
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    turns = turns.select("tree", "leaf", "rank", "place", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(f"{END}\n")))
    upto = Window.partitionBy("tree", "leaf", "rank").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("turn")).over(upto), F.lit(0)) + F.length("head")
    turns = turns.withColumn("begin", begin)
    span = F.when(
        F.col("role") == "assistant",
        F.struct(F.col("begin").alias("start"), (F.col("begin") + F.length("body")).alias("end")),
    )
    rows = F.sort_array(F.collect_list(F.struct("place", "turn", span.alias("span"))))
    grouped = turns.groupBy("tree", "leaf", "rank").agg(rows.alias("rows"))
    return grouped.select(
        "tree", "leaf", "rank",
        F.array_join(F.col("rows.turn"), "").alias("formatted"),
        F.filter("rows.span", lambda s: s.isNotNull()).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation, control strings restored."""
    turns = F.split(formatted, r"<\|im_end\|>\n")
    turns = F.slice(turns, 1, F.size(turns) - 1)
    role = lambda t: unescape(F.replace(F.regexp_extract(t, r"^<\|im_start\|>([^\n]*)\n", 1), F.lit(NEWLINE), F.lit("\n")))
    text = lambda t: unescape(F.regexp_extract(t, r"(?s)^[^\n]*\n(.*)$", 1))
    return F.transform(turns, lambda t: F.struct(role(t).alias("role"), text(t).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, control strings restored, nothing between the spans."""
    part = lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))
    return F.array_join(F.transform(loss, part), "")


def chain(rows: DataFrame, tree: str, order: str, role: str, text: str) -> DataFrame:
    """Conversations stored as ordered turns, as trees with one branch.

    Rows of equal order (repeated ones too) follow each other by role and text; null order is first.
    """
    turns = rows.select(
        F.col(tree).alias("tree"), F.col(order).alias("order"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    place = F.row_number().over(Window.partitionBy("tree").orderBy("order", "role", "text")).cast("bigint")
    turns = turns.withColumn("node", place)
    return turns.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def format_trees(messages: DataFrame, best: int = 1) -> DataFrame:
    """The ``best`` branches of every reply tree as formatted conversations with loss spans.

    ``messages``: tree, node, parent, score, role, text; other columns are ignored. An empty table
    gives an empty result. Of a conversation, a task holds one path, which its text needs anyway.
    """
    return format_paths(messages, best_paths(messages, best))
