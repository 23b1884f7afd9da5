"""Byte-level BPE over a global shuffle of distinct words.

Texts are cut into pre-tokens. Within a block of documents each distinct word is kept once, and a
document becomes the list of its words' numbers, in order of position. The distinct words of all
blocks are shuffled by a hash of the word, so equal words meet in one task and are merged once; a
frequent word arrives once per block and not once per occurrence. Their ids travel back to the block,
where the documents are put together by position. Decoding looks ids up in the token-byte table.

Words and their ids travel as packed, compressed lists (one row per block and word bucket): a row per
word costs several times the disk of the input.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agroseries.sources.shared import scratch_path

BLOCK_WORDS, BLOCK_DISTINCT = 3_000_000, 250_000
CACHED_WORDS = 200_000
LEAST_BUCKETS, MOST_BUCKETS = 64, 8192
MOST_TABLE_BUCKETS = 100_000  # of a bucketed table, as Spark allows by default


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (a fixed vocabulary; its size does not follow the data)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank merges first, the leftmost of equals.

    Candidate pairs wait in a heap, so a word of n bytes takes n log n steps, however long it is.
    """
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    ends, before, gone = list(range(1, n + 1)), list(range(-1, n)), bytearray(n)
    waiting = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(waiting)
    while waiting:
        _, i, end = heapq.heappop(waiting)
        if gone[i] or ends[i] >= end or ends[ends[i]] != end:
            continue
        gone[ends[i]], ends[i] = 1, end
        if end < n:
            before[end] = i
            after = word[i : ends[end]]
            if after in ranks:
                heapq.heappush(waiting, (ranks[after], i, ends[end]))
        if (p := before[i]) >= 0 and (joined := word[p:end]) in ranks:
            heapq.heappush(waiting, (ranks[joined], p, end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return ids


def _pack(lengths: list[int], data: bytes) -> bytes:
    head = np.array([len(lengths), *lengths], dtype="<u4").tobytes()
    return zstandard.compress(head + data, 3)


def _unpack(blob: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    return np.frombuffer(raw, "<u4", n, 4).astype(np.int64), raw[4 + 4 * n :]


def _pieces(lengths: np.ndarray, data: bytes) -> list[bytes]:
    ends = np.cumsum(lengths).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def block_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("bucket", T.IntegerType()),
            T.StructField("id", id_type),
            T.StructField("data", T.BinaryType()),
        ]
    )


def split_blocks(pattern: str, buckets: int, schema: T.StructType, most_words: int, most_distinct: int):
    """Task function: pre-tokens with positions, as numbered words per block.

    A block gives one row per document (bucket -1: word numbers by position) and one row per bucket
    of its distinct words, which are numbered bucket by bucket.
    """

    def flush(block: int, kind: pa.DataType, numbers: dict[str, int], docs: list[tuple]) -> pa.RecordBatch:
        words = [w.encode() for w in numbers]
        bucket = [zlib.crc32(w) % buckets for w in words]
        order = sorted(range(len(words)), key=lambda k: (bucket[k], words[k]))
        number = np.empty(len(order), dtype="<u4")
        number[order] = np.arange(len(order))
        rows = [(-1, i, zstandard.compress(number[s].tobytes(), 3)) for i, s in docs]
        for b, group in itertools.groupby(order, key=bucket.__getitem__):
            own = [words[k] for k in group]
            rows.append((b, None, _pack([len(w) for w in own], b"".join(own))))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block] * len(rows), pa.int64()),
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([r[1] for r in rows], kind),
                pa.array([r[2] for r in rows], pa.binary()),
            ],
            names=schema.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = regex.compile(pattern)
        block, numbers, docs, held = TaskContext.get().partitionId() << 32, {}, [], 0
        for batch in batches:
            kind = batch.column("id").type
            for i, text in zip(batch.column("id"), batch.column("text"), strict=True):
                words = cut.findall((text.as_py() or b"").decode("utf-8", "replace"))
                docs.append((i.as_py(), np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int32)))
                held += len(words) + 1
                if held >= most_words or len(numbers) >= most_distinct:
                    yield flush(block, kind, numbers, docs)
                    block, numbers, docs, held = block + 1, {}, [], 0
                    pa.default_memory_pool().release_unused()
        if docs:
            yield flush(block, kind, numbers, docs)

    return run


def encode_words(ranks: Broadcast, schema: T.StructType):
    """Task function: the ids of each distinct word, in the order of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = ranks.value, {}
        for batch in batches:
            made = []
            for blob in batch.column("data").to_pylist():
                if len(known) > CACHED_WORDS:
                    known.clear()
                ids = []
                for word in _pieces(*_unpack(blob)):
                    if word not in known:
                        known[word] = np.array(merge_word(word, table), dtype="<u4").tobytes()
                    ids.append(known[word])
                made.append(_pack([len(one) // 4 for one in ids], b"".join(ids)))
            columns = [batch.column(n) for n in ("block", "bucket", "id")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.binary())], names=schema.names)

    return run


def join_blocks(docs: pa.Table, words: pa.Table) -> pa.Table:
    """Documents of one block: word numbers replaced by the words' ids, position by position."""
    rows = sorted(zip(words["bucket"].to_pylist(), words["data"].to_pylist(), strict=True))
    unpacked = [_unpack(blob) for _, blob in rows]
    lengths = np.concatenate([np.zeros(0, np.int64), *[n for n, _ in unpacked]])
    ids = np.frombuffer(b"".join(data for _, data in unpacked), dtype="<u4").astype(np.int32)
    begins = np.cumsum(lengths) - lengths
    made, ends = [], [0]
    for blob in docs["data"].to_pylist():
        sequence = np.frombuffer(zstandard.decompress(blob), "<u4")
        n, total = lengths[sequence], int(lengths[sequence].sum())
        within = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        made.append(ids[np.repeat(begins[sequence], n) + within])
        ends.append(ends[-1] + total)
    flat = np.concatenate([np.zeros(0, np.int32), *made])
    tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
    return pa.table({"id": docs["id"], "tokens": tokens})


def bucketed(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """``df`` as a table in the shared folder, laid out by ``key`` as a shuffle by ``key`` would be.

    It has a bucket for each of ``tasks``, which follow the input, so that a bucket does not grow with it.
    """
    spark = df.sparkSession
    name = f"words_{uuid.uuid4().hex}"
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TABLE_BUCKETS, tasks))
    df.write.bucketBy(count, key).option("path", scratch_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def encode(
    df: DataFrame,
    id_col: str,
    text_col: str,
    rank_file: str,
    pattern: str,
    buckets: int | None = None,
    most_words: int = BLOCK_WORDS,
    most_distinct: int = BLOCK_DISTINCT,
) -> DataFrame:
    """(id, tokens array<int>): one row per row of ``df``, its whole text encoded.

    Null and empty texts have no tokens. Equal rows and equal or null ids stay rows of their own;
    other columns are ignored; an empty table gives none. The rank table is broadcast: a vocabulary
    of fixed size. A block has up to ``most_words`` words or ``most_distinct`` distinct ones, or is
    one document if that has more. The numbered documents are written bucketed by block, so that only
    words and their ids are ever shuffled. Words are merged in ``buckets`` tasks: one for each task
    that reads the input, within 64 and 8192, since a block sends every bucket a row.
    """
    schema = block_schema(df.schema[id_col].dataType)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    tasks = rows.rdd.getNumPartitions()
    buckets = buckets or min(MOST_BUCKETS, max(LEAST_BUCKETS, tasks))
    split = split_blocks(pattern, buckets, schema, most_words, most_distinct)
    staged = bucketed(rows.mapInArrow(split, schema), "block", tasks)
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(rank_file))
    words = staged.where("bucket >= 0").repartition(buckets, "bucket").mapInArrow(encode_words(ranks, schema), schema)
    out = T.StructType([T.StructField("id", schema["id"].dataType), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    docs = staged.where("bucket < 0")
    return docs.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(join_blocks, out)


def decode(spark: SparkSession, tokens: Column, rank_file: str) -> Column:
    """Bytes of a token array, from the token-byte table (broadcast, as its size is fixed).

    A null array stays null; an id outside the table raises an error.
    """
    table = spark.sparkContext.broadcast([t for t, _ in sorted(read_ranks(rank_file).items(), key=lambda x: x[1])])

    @F.arrow_udf("binary")
    def look_up(arrays: pa.Array) -> pa.Array:
        find = table.value.__getitem__
        rows = (a.values for a in arrays)
        return pa.array([None if a is None else b"".join(map(find, a.to_numpy().tolist())) for a in rows], pa.binary())

    return look_up(tokens)
