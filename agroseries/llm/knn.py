"""Exact top-k inner products: a KD-tree per shard, best-first search with a propagated bound.

Splits fitted on a bounded sample cut the space into cells, and every vector goes to its cell; a cell
with many rows (equal vectors, say) is spread over several shards by a hash. A shard builds a tree by
median splits along the widest side and keeps the tight bounding box of every node. No point of a box
can score more than the sum, over the coordinates, of the larger of q*low and q*high; nodes are visited
by falling bound until the bound drops below the k-th score found.

Two rounds: first every query searches its own shard, which gives it a k-th score, and every shard tells
its root box; then queries meet the boxes, and go on only to the shards whose bound reaches their k-th
score. A task holds the vectors of one shard (or a block of boxes); queries pass it in batches, so no
task grows with the number of queries. Scores are integers, computed exactly: in doubles while they
stay below 2^53, else in Python integers.
"""

from __future__ import annotations

import decimal
import heapq
import itertools
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from agroseries.sources.shared import saved

LEAF = 64
QUERY_BLOCK = 256
SAMPLE_ROWS, SAMPLE_BYTES = 16384, 32 << 20  # of the vectors that the cells are fitted on
CELL_SAMPLE = 64  # sampled vectors in a cell, at least
SHARD_BYTES = 32 << 20
BOX_BLOCK = 1024
TASKS = 20_000  # partitions of a shuffle, at most
RESULT = "row bigint, query_id bigint, vec_id bigint, score decimal(38,0), size int, shard bigint, low array<double>, high array<double>"
SENT = "row bigint, vec_id bigint, values array<double>, floor decimal(38,0), size int, shard bigint"


class Tree(NamedTuple):
    """Points in tree order; ``spans`` are their ranges by node, ``children`` -1 for leaves."""

    points: np.ndarray
    ids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    spans: list[tuple[int, int]]
    children: list[tuple[int, int]]


def build_tree(points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Tree:
    """Median splits down to ``leaf`` points; equal points cannot be split and share a leaf."""
    order = np.argsort(ids, kind="stable")
    low, high, spans, children = [], [], [], []

    def node(begin: int, end: int) -> int:
        own = points[order[begin:end]]
        low.append(own.min(axis=0))
        high.append(own.max(axis=0))
        spans.append((begin, end))
        children.append((-1, -1))
        return len(spans) - 1

    waiting = [node(0, len(ids))] if len(ids) else []
    while waiting:
        n = waiting.pop()
        begin, end = spans[n]
        side = high[n] - low[n]
        axis = int(np.argmax(side))
        if end - begin <= leaf or side[axis] == 0:
            continue
        values = points[order[begin:end], axis]
        middle = (end - begin) // 2
        order[begin:end] = order[begin:end][np.argpartition(values, middle, kind="introselect")]
        children[n] = (node(begin, begin + middle), node(begin + middle, end))
        waiting += children[n]
    return Tree(points[order], ids[order], np.array(low), np.array(high), spans, children)


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, floors: list, k: int) -> list[tuple]:
    """(number of the query, its id, vec, score) of the best ``k`` per query in this tree, at least its floor."""
    found = []
    if not len(tree.ids):
        return found
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    for begin in range(0, len(ids), QUERY_BLOCK):
        block = slice(begin, begin + QUERY_BLOCK)
        bounds = up[block] @ tree.high.T + down[block] @ tree.low.T
        asked = range(begin, begin + len(bounds))
        for number, own, query, bound, floor in zip(asked, ids[block], queries[block], bounds, floors[block], strict=True):
            best: list[tuple] = []  # (score, -vec), the worst first
            waiting = [(-bound[0], 0)]
            while waiting:
                top, n = heapq.heappop(waiting)
                least = best[0][0] if len(best) == k else floor
                if floor is not None and least is not None:
                    least = max(least, floor)
                if least is not None and -top < least:
                    break
                if tree.children[n][0] >= 0:
                    for child in tree.children[n]:
                        heapq.heappush(waiting, (-bound[child], child))
                    continue
                a, b = tree.spans[n]
                scores, vecs = tree.points[a:b] @ query, tree.ids[a:b]
                if b - a > k:  # ties with the k-th stay in, as the smaller id wins
                    edge = np.partition(scores, b - a - k - 1)[b - a - k - 1]
                    hold = np.flatnonzero(scores >= edge)
                    hold = hold[np.lexsort((vecs[hold], -scores[hold].astype(np.float64)))] if scores.dtype != object else hold
                else:
                    hold = np.arange(b - a)
                for score, vec in zip(scores[hold], vecs[hold], strict=True):
                    if vec == own or (least is not None and score < least):
                        continue
                    item = (int(score), -int(vec))
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
            found += [(number, int(own), -v, s) for s, v in best]
    return found


def matrix(lists: pa.ListArray, size: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), size)


class Cut(NamedTuple):
    """A node of the cells: vectors with ``axis`` at ``value`` or more go ``right``; axis -1 is a cell."""

    axis: int
    value: float
    left: int
    right: int


def cut_cells(points: np.ndarray, cells: int) -> list[Cut]:
    """Up to ``cells`` cells, the largest split first: at the mean of the axis that varies most.

    A mean falls between far groups of unequal size, where a median would cut through the larger one.
    """
    cuts, waiting = [Cut(-1, 0.0, -1, -1)], [(-len(points), 0, points)]
    for _ in range(cells - 1):
        if not waiting:
            break
        _, n, own = heapq.heappop(waiting)
        axis = int(np.argmax(own.std(axis=0)))
        value = float(own[:, axis].mean())
        upper = own[:, axis] >= value
        if upper.all() or not upper.any():
            continue
        cuts[n] = Cut(axis, value, len(cuts), len(cuts) + 1)
        for part in (own[~upper], own[upper]):
            heapq.heappush(waiting, (-len(part), len(cuts), part))
            cuts.append(Cut(-1, 0.0, -1, -1))
    return cuts


def cell_of(cuts: list[Cut], points: np.ndarray) -> np.ndarray:
    cells = np.zeros(len(points), dtype=np.int64)
    waiting = [(0, np.arange(len(points)))]
    while waiting:
        n, rows = waiting.pop()
        cut = cuts[n]
        if cut.axis < 0:
            cells[rows] = n
        elif len(rows):
            upper = points[rows, cut.axis] >= cut.value
            waiting += [(cut.left, rows[~upper]), (cut.right, rows[upper])]
    return cells


def cells_by_size(vectors: DataFrame, rows: int, size: int, shard_rows: int) -> dict[int, list[Cut]]:
    """Cells per vector length, from a sample of about ``SAMPLE_ROWS`` vectors or ``SAMPLE_BYTES``."""
    share = min(1.0, SAMPLE_ROWS / max(1, rows), SAMPLE_BYTES / max(1, 8 * size))
    sample: dict[int, list] = {}
    for r in vectors.select("values").sample(share, seed=8).collect():
        sample.setdefault(len(r["values"]), []).append(r["values"])
    shards = math.ceil(rows / shard_rows)
    return {n: cut_cells(np.array(own), max(1, min(shards, len(own) // min(CELL_SAMPLE, shard_rows)))) for n, own in sample.items()}


def in_cell(values: Column, cuts: dict[int, list[Cut]]) -> Column:
    """Number of the cell that a vector lies in; 0 for a length that was not sampled."""

    @F.arrow_udf("bigint")
    def find(lists: pa.Array) -> pa.Array:
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        cells = np.zeros(len(lists), dtype=np.int64)
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            if size in cuts:
                cells[own] = cell_of(cuts[size], matrix(lists.take(pa.array(own)), size))
        return pa.array(cells)

    return find(values)


def streamed(build: Callable, answer: Callable, close: Callable | None = None):
    """Task function over rows sorted by (size, shard, kind).

    What a shard stores (kind 0) is gathered and built once; its queries (kind 1) then pass in batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in ("size", "shard", "kind")])
            ends = (np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist()
            for begin, end in itertools.pairwise([0, *ends, batch.num_rows] if batch.num_rows else []):
                size, shard, kind = marks[:, begin].tolist()
                if (size, shard) != key:
                    if close and held:
                        yield close(*key, index or build(key[0], pa.Table.from_batches(held)))
                    key, held, index = (size, shard), [], None
                part = batch.slice(begin, end - begin)
                if kind == 0:
                    held.append(part)
                elif held:
                    index = index or build(size, pa.Table.from_batches(held))
                    yield from answer(index, size, part)
        if close and held:
            yield close(*key, index or build(key[0], pa.Table.from_batches(held)))

    return run


def by_shard(stored: DataFrame, asked: DataFrame, tasks: int) -> DataFrame:
    both = stored.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition(max(1, min(tasks, TASKS)), "size", "shard").sortWithinPartitions("size", "shard", "kind")


def _search_shards(k: int, boxes: bool, result: pa.Schema):
    """Task function of a round: nearest vectors in each shard, and with ``boxes`` its root box."""

    def batch(n: int, columns: dict) -> pa.RecordBatch:
        arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in result]
        return pa.RecordBatch.from_arrays(arrays, schema=result)

    def build(size: int, stored: pa.Table) -> Tree:
        return build_tree(matrix(stored["values"].combine_chunks(), size), stored["vec_id"].to_numpy())

    def answer(tree: Tree, size: int, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        queries, floors = matrix(asked.column("values"), size), asked.column("floor").to_pylist()
        most = max(-tree.low[0].min(), tree.high[0].max()) * np.abs(queries).max()
        if most * size >= 2**52:
            whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object)
            tree, queries = tree._replace(points=whole(tree.points), low=whole(tree.low), high=whole(tree.high)), whole(queries)
        floors = [None if x is None else int(x) for x in floors]
        found = search(tree, asked.column("vec_id").to_numpy(), queries, floors, k)
        rows = asked.column("row").to_pylist()
        number, query, vec, score = zip(*found, strict=True) if found else ((), (), (), ())
        yield batch(len(found), {"row": [rows[n] for n in number], "query_id": query, "vec_id": vec, "score": [decimal.Decimal(s) for s in score]})

    def close(size: int, shard: int, tree: Tree) -> pa.RecordBatch:
        return batch(1, {"size": [size], "shard": [shard], "low": [tree.low[0]], "high": [tree.high[0]]})

    return streamed(build, answer, close if boxes else None)


def _meet_boxes(sent: pa.Schema):
    """Task function: every query of a block for each other shard whose box reaches its k-th score.

    Bounds are doubles with a margin for their rounding, so no shard is left out wrongly.
    """

    def build(size: int, stored: pa.Table) -> tuple:
        low, high = (matrix(stored[n].combine_chunks(), size) for n in ("low", "high"))
        return low, high, stored["box"].to_numpy()

    def answer(boxes: tuple, size: int, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        low, high, shards = boxes
        reach = np.maximum(np.abs(low), np.abs(high))
        for begin in range(0, asked.num_rows, QUERY_BLOCK):
            block = asked.slice(begin, QUERY_BLOCK)
            queries = matrix(block.column("values"), size)
            floors = np.array([-math.inf if x is None else float(x) for x in block.column("floor").to_pylist()])
            bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
            bounds += (size + 4) * 4e-16 * (np.abs(queries) @ reach.T)
            own = block.column("own").to_numpy()
            query, box = np.nonzero((bounds >= floors[:, None]) & (shards[None, :] != own[:, None]))
            for at in range(0, len(query), 4096):
                kept = block.take(pa.array(query[at : at + 4096]))
                columns = {n: kept.column(n) for n in ("row", "vec_id", "values", "floor", "size")}
                columns["shard"] = pa.array(shards[box[at : at + 4096]])
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in sent], schema=sent)

    return streamed(build, answer)


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) per component, as doubles; null unless all components are finite."""
    grown = lambda x: x.cast("double") * factor
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    values = F.transform(vector, lambda x: whole(grown(x)))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    return F.when(fine & (F.size(vector) > 0), values)


def sharded(vectors: DataFrame, shard_rows: int) -> tuple[DataFrame, int]:
    """``vectors`` with ``shard``, written once, and about how many shards there are."""
    total = vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    cuts = cells_by_size(vectors, total["n"], total["size"], shard_rows)
    placed = vectors.withColumns({"row": F.monotonically_increasing_id(), "cell": in_cell(F.col("values"), cuts)})
    placed = saved(placed, "vectors")
    held = F.least(F.lit(shard_rows), F.greatest(F.lit(1), F.floor(SHARD_BYTES / (8 * F.col("size")))))
    parts = placed.groupBy("size", "cell").agg(F.ceil(F.count("*") / held).alias("parts"))
    part = F.pmod(F.xxhash64("row"), F.col("parts"))
    spread = placed.join(parts, ["size", "cell"]).withColumn("shard", F.shiftleft("cell", 32) + part)
    tasks = 2 * max(math.ceil(total["n"] / shard_rows), math.ceil(8 * total["size"] / SHARD_BYTES))
    return spread.drop("cell", "parts"), tasks


def candidate_shards(queries: DataFrame, boxes: DataFrame, tasks: int) -> DataFrame:
    """Rows of ``queries`` (row, vec_id, values, floor, size, shard) for every other shard they must search."""
    blocks = max(1, math.ceil(boxes.count() / BOX_BLOCK))
    block = F.pmod(F.xxhash64("shard"), F.lit(blocks))
    stored = boxes.select("size", F.col("shard").alias("box"), block.alias("shard"), "low", "high")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
    asked = queries.withColumn("own", F.col("shard")).withColumn("shard", every)
    met = by_shard(stored, asked, tasks)
    return met.mapInArrow(_meet_boxes(arrow_schema(SENT)), SENT)


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def top_k(
    df: DataFrame,
    id_col: str,
    values: Column,
    is_query: Column,
    k: int = 5,
    shard_rows: int = 8192,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of every query row.

    Candidates are all rows but the query's own id; ties go to the smaller id; fewer candidates give
    fewer rows. Rows with a null id or null ``values`` take no part, and vectors meet only those of
    their own length. Every row is a candidate of its own, also one that repeats or that shares its id; several query rows with
    one id are ranked together. Other columns are ignored; an empty table gives none. Shards grow in
    number, not in size.
    """
    vectors = df.select(F.col(id_col).cast("bigint").alias("vec_id"), values.alias("values"), is_query.alias("asks"))
    vectors = vectors.where(F.col("vec_id").isNotNull() & F.col("values").isNotNull()).withColumn("size", F.size("values"))
    vectors, tasks = sharded(vectors, shard_rows)
    stored = vectors.select("size", "shard", "vec_id", "values")
    queries = vectors.where("asks").select("size", "shard", "row", "vec_id", "values")
    result = arrow_schema(RESULT)

    def round_of(asked: DataFrame, boxes: bool) -> DataFrame:
        return by_shard(stored, asked, tasks).mapInArrow(_search_shards(k, boxes, result), RESULT)

    none = F.lit(None).cast("decimal(38,0)")
    first = saved(round_of(queries.withColumn("floor", none), True), "nearest")
    nearest = first.where(F.col("row").isNotNull())
    kth = nearest.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    kth = kth.select("row", F.when(F.col("n") >= k, F.col("least")).alias("floor"))
    boxes = first.where(F.col("row").isNull()).select("size", "shard", "low", "high")
    second = round_of(candidate_shards(queries.join(kth, "row", "left"), boxes, tasks), False)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = nearest.unionByName(second).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
