"""Phrase collocations, with mergeable Misra-Gries summaries as the filter of an exact count.

Every contiguous run of one to three words is an item, known by a 64-bit hash that includes its
language. The hash range is cut into parts. Texts are dealt into slices of a bounded size; pass one
summarises the items of each slice per part, and the summaries of a part are merged in one task. A
Misra-Gries summary of k counters undercounts an item by at most mass / (k + 1), also after merging,
so with k = mass / threshold every item that occurs ``threshold`` times or more still has a counter.

What a part kept goes back to the slices whose summaries had it. Pass two cogroups the texts with
these hashes and counts the surviving items exactly, as words; equal hashes
can therefore only let a rare item through, which its exact count then removes.

Memory: a slice holds at most ``SLICE`` bytes of text (or one longer text), a part about
``PART`` bytes of texts' items, for any size of the table. Nothing is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agroseries.sources.shared import saved

SLICE, PART = 16 << 20, 16 << 20
LEAST_PARTS, SALTS, ROWS = 64, 32, 16
WORDS = 3
BREAK = b"."  # a separator itself, so never part of a word
_BREAKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", BREAK * 9)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Words of a text with A-Z lowered, and ``BREAK`` where a piece ends."""
    return text.encode().lower().translate(_BREAKS).replace(BREAK, b" . ").split()


class Summary(NamedTuple):
    """Misra-Gries counters in the order of their hashes; ``lost`` bounds what a counter may lack."""

    hashes: np.ndarray
    counts: np.ndarray
    lost: int = 0


def merge(a: Summary, b: Summary, capacity: int) -> Summary:
    """Counters of both, cut to ``capacity`` by taking the next largest counter off each."""
    hashes, at = np.unique(np.concatenate([a.hashes, b.hashes]), return_inverse=True)
    counts = np.zeros(len(hashes), np.int64)
    np.add.at(counts, at, np.concatenate([a.counts, b.counts]))
    lost = a.lost + b.lost
    if len(counts) > capacity:
        off = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
        kept = counts > off
        hashes, counts, lost = hashes[kept], counts[kept] - off, lost + off
    return Summary(hashes, counts, lost)


def survivors(summaries: Iterable[Summary], mass: int, threshold: int) -> np.ndarray:
    """Hashes of a superset of the items with ``threshold`` occurrences or more."""
    capacity, whole = mass // threshold + 1, Summary(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for some in summaries:
        whole = merge(whole, some, capacity)
    return whole.hashes[whole.counts + whole.lost >= threshold]


def _mixed(x: np.ndarray) -> np.ndarray:
    out = x >> np.uint64(32)
    out ^= x
    out *= _MIX
    out ^= out >> np.uint64(29)
    out *= _MIX
    out ^= out >> np.uint64(32)
    return out


class Items:
    """The words of some texts; ``runs`` makes their items, one length at a time to hold few at once."""

    def __init__(self, texts: Iterator[tuple[str, str]]):
        known: dict[bytes, int] = {BREAK: 0}
        runs, langs, names = [], [], {}
        for lang, text in texts:
            words = words_of(text)
            words.append(BREAK)
            for w in words:
                if w not in known:
                    known[w] = len(known)
            runs.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            langs.append(np.full(len(words), names.setdefault(lang, len(names)), np.int32))
        self.words, self.names = list(known), list(names)
        empty = [np.zeros(0, np.int32)]
        self.ids, self.langs = np.concatenate(runs or empty), np.concatenate(langs or empty)

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1 to WORDS, where its items begin and their hashes."""
        word = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        seed = np.array([xxhash.xxh3_64_intdigest(n.encode(), 1) for n in self.names], np.uint64)
        whole = self.ids != 0
        rolled = seed[self.langs] if len(seed) else np.zeros(0, np.uint64)
        for n in range(WORDS):
            if n:
                rolled, whole = rolled[:-1], whole[:-1] & (self.ids[n:] != 0)
            rolled = _mixed(rolled + word[self.ids[n:]])
            yield np.flatnonzero(whole), rolled[whole]


def _planes(values: np.ndarray) -> bytes:
    """64-bit values byte by byte: the high bytes are mostly zero, which the shuffle's codec then finds."""
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(planes: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _steps(hashes: np.ndarray) -> bytes:
    return _planes(np.diff(hashes, prepend=np.uint64(0)))


def _hashes(steps: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(steps, np.uint64), dtype=np.uint64)


def _cuts(hashes: np.ndarray, parts: int) -> list[tuple[int, int]]:
    """Where each part of the hash range begins and ends among sorted hashes."""
    bounds = np.array([(k << 64) // parts for k in range(parts)], np.uint64)
    at = [*np.searchsorted(hashes, bounds).tolist(), len(hashes)]
    return list(zip(at[:-1], at[1:], strict=True))


def _summaries(items: Items, parts: int) -> Iterator[tuple[int, Summary]]:
    """The part's number and the distinct items in it with their counts, for each part that has any."""
    lengths = [np.unique(hashes, return_counts=True) for _, hashes in items.runs()]
    cuts = [_cuts(hashes, parts) for hashes, _ in lengths]
    for part in range(parts):
        own = [(hashes[slice(*cut[part])], counts[slice(*cut[part])]) for (hashes, counts), cut in zip(lengths, cuts, strict=True)]
        hashes, at = np.unique(np.concatenate([h for h, _ in own]), return_inverse=True)
        if len(hashes):
            counts = np.zeros(len(hashes), np.int64)
            np.add.at(counts, at, np.concatenate([c for _, c in own]))
            yield part, Summary(hashes, counts)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values the sorted array holds."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    return ordered[np.minimum(at, len(ordered) - 1, out=at)] == values


def _texts(batches: list[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    for batch in batches:
        for start in range(0, len(batch), ROWS):
            some = batch.slice(start, ROWS)
            yield from zip(some.column("lang").to_pylist(), some.column("text").to_pylist(), strict=True)


def sliced(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(slice, lang, text), written: consecutive rows of a partition, ``SLICE`` bytes of text or one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            numbers = []
            for size in batch.column("size").to_pylist():
                if filled and filled + size > SLICE:
                    number, filled = number + 1, 0
                filled += size
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *batch.columns[1:]], names=["slice", "lang", "text"])

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.octet_length(text).cast("bigint").alias("size"), lang.alias("lang"), text.alias("text"))
    return saved(rows.mapInArrow(run, "slice bigint, lang string, text string"), "slices")


def _by_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Items]]:
    """Items of each run of rows with one slice number."""
    held, last = [], None
    for batch in batches:
        numbers = batch.column("slice").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and numbers[a] != last:
                yield last, Items(_texts(held))
                held = []
            last = int(numbers[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield last, Items(_texts(held))


def frequent(df: DataFrame, lang_col: str, text_col: str, threshold: int) -> DataFrame:
    """(lang, words, f): every run of one to three words with ``threshold`` occurrences or more.

    The empty run stands for all words of a language, whatever its count.
    """
    rows = sliced(df, lang_col, text_col)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    parts = max(LEAST_PARTS, -(-size // PART))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, items in _by_slice(batches):
            out: list[dict] = []
            for part, (hashes, counts, _) in _summaries(items, parts):
                row = (number, part, int(counts.sum()), _steps(hashes), _planes(counts))
                out.append(dict(zip(summary.names, row, strict=True)))
                if len(out) == ROWS:  # sent while the other parts are still to be made
                    yield pa.RecordBatch.from_pylist(out, summary)
                    out = []
            yield pa.RecordBatch.from_pylist(out, summary)

    summary = pa.schema([(c, pa.int64()) for c in ("slice", "part", "mass")] + [(c, pa.binary()) for c in ("steps", "counts")])
    pass_one = rows.mapInArrow(summarise, "slice bigint, part bigint, mass bigint, steps binary, counts binary")

    def keep(table: pa.Table) -> pa.Table:
        blobs = [(a.as_py(), b.as_py()) for a, b in zip(table.column("steps"), table.column("counts"), strict=True)]
        mass = int(np.sum(table.column("mass").to_numpy()))
        alive = survivors((Summary(_hashes(a), _unplaned(b, np.int64)) for a, b in blobs), mass, threshold)
        steps = [_steps(h[np.isin(h, alive, assume_unique=True)]) for h in (_hashes(a) for a, _ in blobs)]
        return table.select(["slice"]).append_column("steps", pa.array(steps, pa.binary()))

    alive = pass_one.groupBy("part").applyInArrow(keep, "slice bigint, steps binary")

    def count(texts: pa.Table, kept: pa.Table) -> pa.Table:
        items = Items(_texts(texts.to_batches()))
        alive = np.unique(np.concatenate([np.zeros(0, np.uint64), *[_hashes(b.as_py()) for b in kept.column("steps")]]))
        langs, runs, counts = [*items.names], [""] * len(items.names), []
        counts += np.bincount(items.langs[items.ids != 0], minlength=len(items.names)).tolist()
        names = [w.decode() for w in items.words]
        for n, (starts, found) in enumerate(items.runs(), 1):
            starts = starts[_among(found, alive)]
            keys = np.stack([items.langs[starts], *[items.ids[starts + k] for k in range(n)]], axis=1)
            keys = keys[np.lexsort(keys.T[::-1])]
            first = np.flatnonzero(np.r_[True, np.any(keys[1:] != keys[:-1], axis=1)][: len(keys)])
            counts += np.diff(np.r_[first, len(keys)]).tolist()
            for lang, *run in keys[first].tolist():
                langs.append(items.names[lang])
                runs.append(" ".join([names[w] for w in run]))
        return pa.table({"lang": pa.array(langs, pa.string()), "words": pa.array(runs, pa.string()), "f": pa.array(counts, pa.int64())})

    counted = rows.groupBy("slice").cogroup(alive.groupBy("slice")).applyInArrow(count, "lang string, words string, f bigint")
    exact = counted.groupBy("lang", "words").agg(F.sum("f").alias("f"))
    return exact.where((F.col("f") >= threshold) | (F.col("words") == ""))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exactly: the products have up to 38 digits."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(
    df: DataFrame, lang_col: str, text_col: str, threshold: int = 10, share: int = 50, top: int = 2000
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of two or three words per language.

    A phrase needs ``threshold`` occurrences; its score is that of its worst cut, ties to the first.
    A phrase that lies in a longer candidate with ``share`` percent of its occurrences is left out.
    Pieces end at ``. , ; : ! ?`` and line ends, words are told by blanks and tabs, A-Z are lowered.
    A null text is empty, a null language counts as ``und`` together with texts labelled so. Repeated rows count
    each; other columns are ignored; an empty table gives no row. A text of any length is one text.
    """
    counted = saved(frequent(df, lang_col, text_col, threshold), "counted")
    split = F.split("words", " ")
    runs = counted.where("words <> ''").withColumn("parts", split)
    totals = counted.where("words = ''").select("lang", F.col("f").alias("n"))
    one = runs.where(F.size("parts") == 1).select("lang", "words", "f")

    def looked_up(of: DataFrame, table: DataFrame, key: Column, out: str) -> DataFrame:
        theirs = table.select("lang", F.col("words").alias("__key"), F.col("f").alias(out))
        return of.withColumn("__key", key).join(theirs, ["lang", "__key"]).drop("__key")

    word = lambda k: F.col("parts")[k]
    pair = lambda k: F.concat_ws(" ", word(k), word(k + 1))
    two = runs.where(F.size("parts") == 2)
    two = looked_up(looked_up(two, one, word(0), "l"), one, word(1), "r")
    two = two.withColumn("score", _score(F.col("f"), F.col("l"), F.col("r")))
    three = runs.where(F.size("parts") == 3)
    for table, key, out in ((one, word(0), "l1"), (two, pair(1), "r1"), (two, pair(0), "l2"), (one, word(2), "r2")):
        three = looked_up(three, table, key, out)
    scores = {k: _score(F.col("f"), F.col(f"l{k}"), F.col(f"r{k}")) for k in (1, 2)}
    three = three.withColumns({f"s{k}": s for k, s in scores.items()})
    first = F.col("s1") <= F.col("s2")
    three = three.select(
        "lang",
        "words",
        "parts",
        "f",
        F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    three = saved(three, "threes")
    within = three.select("lang", F.explode(F.array(pair(0), pair(1))).alias("words"), "f")
    longest = within.groupBy("lang", "words").agg(F.max("f").alias("longer"))
    free = F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("f"))
    two = two.join(longest, ["lang", "words"], "left").where(free)
    columns = ["lang", "words", "f", "l", "r", "score"]
    found = two.select(columns).unionByName(three.select(columns))

    best = [F.col("score").desc(), F.col("f").desc(), F.col("words")]
    salt = F.pmod(F.xxhash64("words"), F.lit(SALTS))  # a language is ranked in SALTS tasks, then the best of each
    for keys in (["lang", salt], ["lang"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= top)
    return found.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), F.col("words").alias("phrase"), F.col("f").alias("a"), "l", "r", "n", "score"
    )
