"""Concatenate and cut: all documents as one token stream, cut into windows of equal length.

Pass one tokenizes every document once and writes its ids with its offset inside its partition. Pass
two sums the partitions, turns the totals into the offset at which each partition starts, and cuts.
A document that crosses window ends becomes several pieces (the boundary records), found from its
global offset alone, so the cut needs no shuffle of ids.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agroseries.sources.shared import saved

KNOWN_WORDS, SLICE_BYTES, JOINT = 400_000, 2 << 20, 400
MARK = "\x01"
LAST_PLAIN = "\u024f"  # Latin letters, all of them composed
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of words between ASCII white space, which this vocabulary never joins or sees.

    Known words are kept in two generations: when the young one is full it becomes the old one, from
    which words that come back are taken over. So frequent words stay and rare ones go, and neither holds more
    than ``KNOWN_WORDS`` words and those of one slice. They belong to the Python worker and outlive a task.

    A new word of plain lower-case letters is one pre-token that the normalizer leaves alone, so it goes
    straight to the merges. Other words go through the whole tokenizer, many in one text, with a mark
    between them that is a token of its own; a word that may hold a special token or the mark goes alone.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(vocabulary)
        _must_be_known(json.loads(vocabulary))
        self.merged = self.tokenizer.model.tokenize
        self.bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        if len(self.mark) != 1:
            raise ValueError("this vocabulary has no token of its own for the mark between words")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.letters: dict[str, str] = {}

    def _spelled(self, word: str) -> str:
        """The word in the characters that stand for its bytes."""
        if word.isascii():
            return word
        for letter in word:
            if letter not in self.letters:
                self.letters[letter] = self.bytes_of(letter)[0][0]
        return "".join(map(self.letters.__getitem__, word))

    def _look_up(self, missing: list[bytes]) -> None:
        joint, alone, young = [], [], self.young
        for word in missing:
            text = word.decode("utf-8", "replace")
            if text.isalpha() and text == text.lower() and max(text) <= LAST_PLAIN:
                ids = [t.id for t in self.merged(self._spelled(text))]
                young[word] = pack_ids(f"<{len(ids)}I", *ids)
            elif "<|" in text or MARK in text or "\ufffd" in text:
                alone.append((word, text))
            else:
                joint.append((word, text))
        encode = self.tokenizer.encode_batch_fast
        for (word, _), made in zip(alone, encode([t for _, t in alone], add_special_tokens=False), strict=True):
            young[word] = pack_ids(f"<{len(made.ids)}I", *made.ids)
        runs = [joint[k : k + JOINT] for k in range(0, len(joint), JOINT)]
        texts = [f" {MARK} ".join([t for _, t in run]) for run in runs]
        for run, made in zip(runs, encode(texts, add_special_tokens=False), strict=True):
            ids = np.array(made.ids, dtype="<u4")
            ends = [*np.flatnonzero(ids == self.mark[0]).tolist(), len(ids)]
            begin = 0
            for (word, _), end in zip(run, ends, strict=True):
                young[word] = ids[begin:end].tobytes()
                begin = end + 1

    def encode(self, texts: list[bytes]) -> list[bytes]:
        # ASCII case is folded here, as the vocabulary does, unless a special token could be meant
        docs = [(t if b"<|" in t else t.lower()).split() for t in texts]
        young, old, missing = self.young, self.old, {}
        for doc in docs:
            for word in doc:
                if word not in young:
                    if word in old:
                        young[word] = old[word]
                    else:
                        missing[word] = None
        self._look_up(list(missing))
        out = [b"".join(map(young.__getitem__, doc)) for doc in docs]
        if len(young) > KNOWN_WORDS:
            self.young, self.old = {}, young
        return out


def _must_be_known(vocabulary: dict) -> None:
    """Raise unless lower-case composed letters are one pre-token that no normalizer changes."""
    steps = {n["type"] for n in (vocabulary.get("normalizer") or {}).get("normalizers", [])}
    split, *rest = (vocabulary.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    pieces = split.get("pattern", {}).get("Regex", "").split("|")
    if not (
        steps <= {"NFC", "Replace", "Lowercase"}
        and split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and split.get("invert")
        and "[\\p{L}]+" in pieces
        and all(p[0] in "'[" for p in pieces)  # nothing but contractions comes before a run of letters
        and [r["type"] for r in rest] == ["ByteLevel"]
        and not vocabulary["model"].get("dropout")
    ):
        raise ValueError("words of this vocabulary cannot be told apart by white space and letters")


def _slices(texts: pa.Array) -> Iterator[list[bytes]]:
    """Texts in runs of about ``SLICE_BYTES``; a null is empty."""
    some, size = [], 0
    for text in texts:
        some.append(text.as_py() or b"")
        size += len(some[-1])
        if size >= SLICE_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def _encoder(vocabulary: str) -> WordEncoder:
    name = hashlib.sha1(vocabulary.encode()).hexdigest()
    if name not in _encoders:
        _encoders[name] = WordEncoder(vocabulary)
    return _encoders[name]


def tokenize(df: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int) -> DataFrame:
    """(id, part, first, tokens, ids): ids as little-endian unsigned 32-bit, ``first`` the offset in
    the partition. The vocabulary file is read once by the driver and broadcast (its size is fixed).
    """
    source = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = T.StructType(
        [
            T.StructField("id", df.schema[id_col].dataType),
            T.StructField("part", T.IntegerType()),
            T.StructField("first", T.LongType()),
            T.StructField("tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, first = _encoder(source.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for some in _slices(batch.column("text")):
                ids = [b + end for b in encoder.encode(some)]
                tokens = np.array([len(b) // 4 for b in ids], dtype=np.int64)
                begins = first + np.cumsum(tokens) - tokens
                first += int(tokens.sum())
                parts = pa.array(np.full(len(ids), part, np.int32))
                columns = [batch.column("id").slice(at, len(ids)), parts, pa.array(begins), pa.array(tokens)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], names=schema.names)
                at += len(ids)

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, schema)


def pack(
    df: DataFrame,
    id_col: str,
    text_col: str,
    vocabulary: str,
    window: int = 4096,
    end_id: int = 2,
) -> DataFrame:
    """One row per piece: id, start, length, ids, doc_tokens, sequence_id, offset.

    Every document is its word ids and ``end_id``; a null or empty text is the end id alone. Pieces
    lie gapless in sequences of ``window`` tokens, of which only the last can be shorter. Equal rows
    and equal or null ids are documents of their own; other columns are ignored; an empty table
    gives no piece. A text is one value, split into pieces after tokenizing, whatever its length.
    """
    tokens = saved(tokenize(df, id_col, text_col, vocabulary, end_id), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = saved(
        totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "bases"
    )  # a row per partition; written, so that its size is known to the planner
    begin = F.col("base") + F.col("first")
    placed = tokens.join(begins, "part").select("id", "ids", "tokens", begin.alias("begin"))
    last = F.col("begin") + F.col("tokens") - 1
    windows = F.sequence(F.floor(F.col("begin") / window), F.floor(last / window))
    cut = placed.withColumn("sequence_id", F.explode(windows))
    left = F.greatest(F.col("begin"), F.col("sequence_id") * window)
    right = F.least(last + 1, (F.col("sequence_id") + 1) * window)
    cut = cut.withColumns({"left": left, "length": right - left})
    start = F.col("left") - F.col("begin")
    return cut.select(
        "id",
        start.alias("start"),
        "length",
        F.substring("ids", (start * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")).alias("ids"),
        F.col("tokens").alias("doc_tokens"),
        "sequence_id",
        (F.col("left") - F.col("sequence_id") * window).alias("offset"),
    )


def sequences(pieces: DataFrame, window: int = 4096, pad_id: int = 0) -> DataFrame:
    """(sequence_id, tokens, ids): the training rows, the last one padded up to ``window``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("tokens"))
    empty = F.lit(b"")
    joined = F.aggregate("parts", empty, lambda whole, part: F.concat(whole, part["ids"]))
    pad = F.lit(int(pad_id).to_bytes(4, "little"))
    return grouped.select("sequence_id", "tokens", F.rpad(joined, 4 * window, pad).alias("ids"))
