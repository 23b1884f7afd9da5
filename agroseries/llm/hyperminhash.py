"""HyperMinHash near-duplicates of documents, by the Jaccard similarity of their word shingles.

The 64-bit hashes of a document's shingles fall into 288 buckets, equal ranges of the hash. Of the least hash
in a bucket a register keeps the number of leading zeros and the ten bits after the first one
(Yu and Weber, "HyperMinHash: MinHash in LogLog space"), two bytes in all. Empty registers are filled,
for banding only, from a bucket that is not empty, in an order fixed per bucket (optimal
densification), so small sets band as large ones do. Six registers make a band: a pair at similarity
0.8 misses all 48 bands with a probability of 5e-7.

Documents with equal sets are folded into one class first. A band key that several classes share is
a group, and groups are searched in two rounds, neither of which pairs up the members of a near-copy group:

- every member is compared with LEADERS leaders of its group, the same ones in most bands;
- what that linked is a component; only members of *different* components of a group can tell more. They are
  found by what sets them apart from one leader C, the pivot: |A ^ B| = |A ^ C| + |B ^ C| - 2 |(A ^ C) & (B ^ C)|,
  so a link of A and B asks for a number of shared differences, at least one as not both link with C. Most
  differences occur once in a group. The others are ordered, rarest first; each member is
  indexed by so many of its first ones that no link can miss all (prefix filter), and members meet where
  these agree and enough differences follow on both sides (position filter). These bounds lose no link. The join
  condition also counts how many of the filled registers differ in four of their bits.

A pair must fit by its set sizes, then by the similarity that its registers estimate, corrected for
registers that agree by accident; the intersection of the full sets then decides. Both estimates
let a pair of exactly the similarity asked for pass at SIGMAS standard deviations. Full sets are
64-bit shingle hashes, made again from the texts of the classes in question only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agroseries.llm.components import components
from agroseries.sources.shared import saved

BUCKETS, PER_BAND, MANTISSA = 288, 6, 10
SIGNED = BUCKETS * 4 // 64  # longs that hold four bits of each register
LEADERS, SIGMAS = 4, 5
_BOUNDS = np.array([(k << 64) // BUCKETS for k in range(BUCKETS)], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: In which order a bucket looks for a register when its own is empty.
_BORROW = np.argsort(np.random.default_rng(7).random((BUCKETS, BUCKETS)), axis=1)
#: Agreement by accident of two minima over n and m hashes is about this times 2 ** -MANTISSA
#: times n m / (n + m)^2: the integral of both exponential densities over cells as wide as a register's.
_ACCIDENT = 4 * 0.169919487159739


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of word shingles, A-Z lowered; a shorter text is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, width = xxhash.xxh3_64_intdigest, min(width, len(words))
    word = np.fromiter(map(digest, words), np.uint64, len(words))
    count = len(words) - width + 1
    rolled = np.full(count, width, np.uint64)
    for k in range(width):
        rolled = _mixed(rolled + word[k : k + count])
    return np.unique(rolled)


def registers_of(hashes: np.ndarray) -> np.ndarray:
    """A register per bucket: leading zeros and mantissa of its least hash plus one, or 0 if empty."""
    first = np.searchsorted(hashes, _BOUNDS)
    full = np.diff(np.r_[first, len(hashes)]) > 0
    least = hashes[first[full]] - _BOUNDS[full]
    low = least < 1 << 53  # a double holds 53 bits exactly
    digits = np.frexp(np.where(low, least, least >> np.uint64(11)).astype(np.float64))[1] + np.where(low, 0, 11)
    zeros = np.minimum(64 - digits, 63).astype(np.uint64)
    after = (least << zeros) << np.uint64(1)
    out = np.zeros(BUCKETS, np.uint16)
    out[full] = ((zeros << np.uint64(MANTISSA)) | (after >> np.uint64(64 - MANTISSA))) + np.uint64(1)
    return out


def filled(registers: np.ndarray) -> np.ndarray:
    """Every empty register replaced by the first one in its order that is not empty, if any."""
    full = registers != 0
    out, empty = registers.copy(), np.flatnonzero(~full)
    order = _BORROW[empty]
    out[empty] = registers[order[np.arange(len(empty)), np.argmax(full[order], axis=1)]]
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key per band of PER_BAND filled registers."""
    bands = registers.astype(np.uint64).reshape(-1, PER_BAND)
    keys = _mixed(np.arange(1, len(bands) + 1, dtype=np.uint64))
    for k in range(PER_BAND):
        keys = _mixed(keys + bands[:, k])
    return keys.view(np.int64)


def signature(registers: np.ndarray) -> np.ndarray:
    """Four bits of every filled register, packed into longs."""
    bits = (_mixed(registers.astype(np.uint64)) >> np.uint64(60)).astype(np.uint8)
    return (bits[::2] << np.uint8(4) | bits[1::2]).view(np.int64)


def _sketched(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, key, n, digest, registers): all that is kept of a row; ``key`` tells its text."""
    text = F.col(text_col)
    rows = df.select(F.col(id_col).alias("id"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("key"), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], []]
            for text in batch.column("text"):
                hashes = shingles(text.as_py(), width)
                made = (len(hashes), xxhash.xxh3_128_digest(hashes.tobytes()), registers_of(hashes).tobytes())
                for column, value in zip(columns, made, strict=True):
                    column.append(value)
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), *arrays], names=["id", "key", "n", "digest", "registers"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, key string, n bigint, digest binary, registers binary")


def _banded() -> Column:
    """bands and signature of registers that are not all empty."""

    @F.pandas_udf("bands array<bigint>, signed array<bigint>")
    def banded(registers: pd.Series) -> pd.DataFrame:
        full = [filled(np.frombuffer(r, np.uint16)) for r in registers]
        return pd.DataFrame({"bands": [band_keys(f) for f in full], "signed": [signature(f) for f in full]})

    return banded("registers")


def _alike(a: str, b: str, percent: int) -> Column:
    """Whether so few registers differ in their four bits as a similar enough pair may have."""
    apart, ones = 1 - percent / 100, F.lit(0x1111111111111111)
    rate = apart * 15 / 16  # unlike registers still agree in four bits now and then
    most = int(BUCKETS * rate + SIGMAS * (BUCKETS * rate * (1 - rate)) ** 0.5) + 1
    differing = F.lit(0)
    for k in range(SIGNED):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        for step in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        differing += F.bit_count(x.bitwiseAND(ones))
    return differing <= most


def _fits(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough at all."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(agreeing registers less those expected by accident, registers in use), a row per pair."""
    used = ((a != 0) | (b != 0)).sum(axis=1)
    agreeing = ((a == b) & (a != 0)).sum(axis=1)
    accident = BUCKETS * _ACCIDENT * 2.0**-MANTISSA * n * m / (n + m) ** 2
    return agreeing - accident, used


def _likely(percent: int) -> Column:
    least = percent / 100

    @F.pandas_udf("boolean")
    def likely(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        one, two = (np.frombuffer(b"".join(x), np.uint16).reshape(-1, BUCKETS) for x in (a, b))
        n, m = n.to_numpy(np.float64), m.to_numpy(np.float64)
        agreeing, used = estimate(one, two, n, m)
        union = np.maximum((n + m) / (1 + least), used + 1)
        spread = np.sqrt(used * least * (1 - least) * (union - used) / (union - 1))  # draws without replacement
        return pd.Series(agreeing >= least * used - SIGMAS * spread - 2)

    return likely("registers_a", "registers_b", "n_a", "n_b")


def _common() -> Column:
    @F.pandas_udf("bigint")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = zip(a, b, strict=True)
        sets = ((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in pairs)
        return pd.Series([len(np.intersect1d(x, y, assume_unique=True)) for x, y in sets], dtype="int64")

    return common("set_a", "set_b")


def _beside(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with columns of the classes ``a`` and ``b``."""
    for side in ("a", "b"):
        theirs = table.select(F.col("cls").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        pairs = pairs.join(theirs, side)
    return pairs


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that are similar enough, written."""
    fitting = _beside(pairs, classes, ["n", "registers"]).where(_fits(F.col("n_a"), F.col("n_b"), percent))
    likely = saved(fitting.where(_likely(percent)).select("a", "b", "n_a", "n_b"), "likely")
    common = F.col("common")
    checked = _beside(likely, sets, ["set"]).withColumn("common", _common())
    linked = checked.where(common * 100 >= (F.col("n_a") + F.col("n_b") - common) * percent)
    return saved(linked.select("a", "b"), "links")


def _differences() -> Column:
    @F.pandas_udf("array<bigint>")
    def differences(a: pd.Series, b: pd.Series) -> pd.Series:
        sets = ((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True))
        return pd.Series([np.setxor1d(x, y, assume_unique=True).view(np.int64) for x, y in sets], dtype=object)

    return differences("set", "set_pivot")


def _prefixes(known: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(pivot, token, cls, label, n, rest, over): the first differences of each member from the pivot of its group.

    ``rest`` counts the member's ordered differences from this one on. Members a and b link only if they
    share (over_a + over_b) / (2 (100 + percent)) differences or more.
    """
    mixed = known.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    open_ = saved(known.join(mixed.select("band"), "band", "left_semi"), "open")
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("degree"))
    leading = open_.where("leads").join(degree, "cls", "left")
    best = F.max(F.struct(F.coalesce("degree", F.lit(0)), -F.col("cls"), "cls", "label")).alias("best")
    pivots = leading.groupBy("band").agg(best).select("band", F.col("best.cls").alias("pivot"), F.col("best.label").alias("of"))
    members = open_.join(saved(pivots, "pivots"), "band").where("cls <> pivot")
    members = members.select("pivot", "cls", "label", (F.col("label") == F.col("of")).alias("own")).distinct()

    theirs = sets.select(F.col("cls").alias("pivot"), F.col("set").alias("set_pivot"))
    n = (F.octet_length("set") / 8).cast("bigint").alias("n")
    apart = members.join(sets, "cls").join(theirs, "pivot").withColumn("tokens", _differences())
    apart = saved(apart.select("pivot", "cls", "label", "own", n, "tokens"), "apart")
    each = apart.select("pivot", "cls", F.explode("tokens").alias("token"))
    several = each.groupBy("pivot", "token").agg(F.count("*").alias("seen")).where("seen > 1")
    tokens = F.sort_array(F.collect_list(F.struct("seen", "token"))).alias("tokens")
    ordered = each.join(several, ["pivot", "token"]).groupBy("pivot", "cls").agg(tokens)

    over = (100 + percent) * F.size("tokens").cast("bigint") - (100 - percent) * F.col("n")
    ordered = ordered.join(apart.select("pivot", "cls", "label", "own", "n", over.alias("over")), ["pivot", "cls"])
    reach = 2 * (100 + percent) * F.size("tokens") - F.col("over")
    ordered = saved(ordered.withColumn("reach", reach), "ordered")
    other = lambda c: F.when(~F.col("own"), F.col(c))  # noqa: E731  what the pivot's own component can link with
    bounds = ordered.groupBy("pivot").agg(
        F.min("over").alias("low"), F.max("reach").alias("high"), F.min(other("over")).alias("low_other"), F.max(other("reach")).alias("high_other")
    )
    low, high = (F.when(F.col("own"), F.col(f"{c}_other")).otherwise(F.col(c)) for c in ("low", "high"))
    found = ordered.join(saved(bounds, "bounds"), "pivot").where((F.col("over") <= high) & (low <= F.col("reach")))
    least = F.greatest(F.lit(1), F.ceil((F.col("over") + low) / (2 * (100 + percent))))
    take = F.greatest(F.lit(0), F.size("tokens") - least + 1).cast("int")
    found = found.select("*", F.size("tokens").alias("size"), F.posexplode(F.slice("tokens", F.lit(1), take)).alias("at", "one"))
    return found.select("pivot", F.col("one.token").alias("token"), "cls", "label", "n", (F.col("size") - F.col("at")).alias("rest"), "over")


def _across(known: DataFrame, links: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components that share a group and may be similar enough."""
    first = saved(_prefixes(known, links, sets, percent).join(classes.select("cls", "signed"), "cls"), "prefixes")
    columns = ("n", "label", "rest", "over", "signed")
    side = lambda of: first.select("pivot", "token", F.col("cls").alias(of), *[F.col(c).alias(f"{c}_{of}") for c in columns])
    one, two = side("a"), side("b")
    met = (one["pivot"] == two["pivot"]) & (one["token"] == two["token"])
    apart = met & (F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b"))
    enough = 2 * (100 + percent) * F.least("rest_a", "rest_b") >= F.col("over_a") + F.col("over_b")
    fitting = enough & _fits(F.col("n_a"), F.col("n_b"), percent) & _alike("signed_a", "signed_b", percent)
    return one.join(two, apart & fitting).select("a", "b").distinct()


def near_duplicates(df: DataFrame, id_col: str, text_col: str, width: int = 4, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per row of ``df``.

    Documents are linked when 100 |A and B| >= ``percent`` |A or B| for their sets of distinct shingles
    of ``width`` words (words between ASCII white space; fewer words: the whole sequence). ``component_id``
    is the smallest id reachable and ``kept`` tells the row that has it. A null text, an empty one and
    one without words have an empty set and link with nothing, not even with each other. Repeated rows and equal ids
    are rows of their own: of equal ids all that name their component are kept. A null id takes part and names a component only if it has no
    other id (``kept`` is then true for null). Other columns are ignored; an empty table gives no row.
    Texts of any length count whole.
    """
    rows = saved(_sketched(df, id_col, text_col, width), "sketches")
    ids = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    folded = rows.where("n > 0").groupBy("digest").agg(
        F.min(ids).alias("least"), F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("n", "registers")]
    )
    classes = folded.withColumn("made", _banded()).select("*", "made.*").drop("made")
    classes = saved(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")

    keyed = classes.select("cls", F.explode("bands").alias("band"))
    lot = F.pmod(F.xxhash64("cls"), F.lit(LEADERS))
    leaders = F.array(*[F.min(F.when(lot == k, F.col("cls"))) for k in range(LEADERS)])
    groups = keyed.groupBy("band").agg(leaders.alias("leaders"), F.count("*").alias("size"))
    shared = saved(keyed.join(groups.where("size > 1").drop("size"), "band"), "shared")

    wanted = shared.select("cls").distinct().join(classes.select("cls", "key"), "cls")
    texts = df.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    texts = texts.groupBy(F.md5("text").alias("key")).agg(F.first("text").alias("text"))
    sets = saved(wanted.join(texts, "key").select("cls", _set_of(F.col("text"), width).alias("set")), "sets")

    stars = shared.select(F.explode("leaders").alias("leader"), "cls").where("cls <> leader")
    stars = stars.select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b")).distinct()
    links = _confirmed(stars, classes, sets, percent)
    label = components(links, "a", "b").withColumnRenamed("node", "cls")
    leads = F.array_contains("leaders", F.col("cls")).alias("leads")
    known = shared.join(label, "cls", "left").select("band", "cls", F.coalesce("label", "cls").alias("label"), leads)
    across = _across(saved(known, "labelled"), links, classes, sets, percent)
    more = _confirmed(across, classes, sets, percent)
    for side in ("a", "b"):  # the components known so far are the nodes now
        theirs = label.select(F.col("cls").alias(side), F.col("label").alias(f"label_{side}"))
        more = more.join(theirs, side, "left").withColumn(f"label_{side}", F.coalesce(f"label_{side}", side))
    merged = components(more, "label_a", "label_b").select(F.col("node").alias("label"), F.col("label").alias("joined"))
    named = classes.select("cls", "digest", "least").join(label, "cls", "left")
    named = named.withColumn("label", F.coalesce("label", "cls")).join(merged, "label", "left")
    named = named.withColumn("label", F.coalesce("joined", "label")).drop("joined")
    smallest = named.groupBy("label").agg(F.min("least").alias("smallest"))
    found = saved(named.join(smallest, "label").select("digest", F.col("smallest.id").alias("smallest")), "components")
    several = F.col("n") > 0
    out = rows.join(found.withColumn("found", F.lit(True)), "digest", "left")
    component = F.when(several, F.col("smallest")).otherwise(F.col("id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def _set_of(text: Column, width: int) -> Column:
    @F.pandas_udf("binary")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, width).tobytes() for t in texts], dtype=object)

    return sets(text)
