"""Personal data: fixed patterns as seeds, and bootstrapped contexts that lead to more.

Every seed (e-mail, IP, card, phone) stands in a context: the two words before it, and the words on
either side. Such contexts are lexical patterns. Other tokens, or runs of number
tokens, that look like identifiers stand in contexts too. Pattern and identifier form a graph with counts; Spark scores it in rounds: a pattern
is trusted for a kind by the share of its mentions that are trusted instances of the kind (tokens not
trusted for any kind so far count a quarter), an instance by the patterns that point at it. Unseen
identifiers that only trusted patterns explain are added. The fixed matches always stay.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agroseries.sources.shared import saved

KINDS = ("email", "ip", "card", "phone")
UNSEEN_WEIGHT = 0.25  # of a token of unknown kind against a trusted one, in the mentions of a pattern
EMAIL, IP, CARD, PHONE = range(4)
# fixed values: the base patterns
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
DIGITS = re.compile(r"[0-9]([\x20-]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
PIECE = re.compile(r"[+]?[().0-9-]+")  # of a number written with blanks
MOST_DIGITS = 19  # of a card, the longest number
EDGES = "\"'`()[]{}<>,;:!?.=*#$%&|"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part is the run of its characters before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        found = DOMAIN.match(text, at) if begin < at else None
        if found:
            yield begin, found.end()
            free = found.end()
        at = text.find("@", found.end() if found else at + 1)


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base matches in order; matches that fail their check are dropped."""
    found = [(a, EMAIL, b) for a, b in emails(text)]
    for m in ADDRESS.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((m.start(), IP, m.end()))
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), CARD, m.end()))
    for m in DIALLED.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), PHONE, m.end()))
    return sorted(found)


def shapes(token: str) -> list[int]:
    """Kinds that an unseen token could be: e-mail with @, IP with three dots, else by its digits."""
    digits = sum(c.isdigit() for c in token)
    if "@" in token:
        return [EMAIL]
    if digits < 6 or any(c.isalpha() for c in token):
        return []
    if token.count(".") == 3:
        return [IP]
    return [CARD] * (12 <= digits <= 19) + [PHONE] * (7 <= digits <= 15)


def blank_shapes(value: str) -> list[int]:
    """Kinds of a number written with blanks: the base patterns without the plus and the check digit."""
    digits = sum(c.isdigit() for c in value)
    card = 12 <= digits <= MOST_DIGITS and DIGITS.fullmatch(value)
    return [CARD] * bool(card) + [PHONE] * (7 <= digits <= 15)


def blank_runs(text: str, tokens: list[tuple[int, int]], taken: list[bool]) -> Iterator[tuple[int, int, int]]:
    """(first token, start, end) of every number over two or more neighbouring tokens, none of them ``taken``."""
    pieces = []
    for (a, b), base in zip(tokens, taken, strict=True):
        raw = text[a:b]
        head, tail = raw.lstrip(EDGES.replace("(", "")), raw.rstrip(EDGES)
        fits = lambda part, plus: not base and bool(PIECE.fullmatch(part)) and (plus or part[0] != "+")
        digits = sum(c.isdigit() for c in raw)
        pieces.append((digits, digits and fits(head, True), fits(raw, False), digits and fits(tail, False), b - len(head), a + len(tail)))
    for i, (digits, opens, _, _, start, _) in enumerate(pieces):
        for j in range(i + 1, min(len(pieces), i + 2 * MOST_DIGITS) if opens else 0):
            more, _, goes_on, closes, _, end = pieces[j]
            digits += more
            if digits > MOST_DIGITS or text[tokens[j - 1][1] : tokens[j][0]].strip(" "):
                break
            if closes:
                value = text[start:end]
                open_, shut = value.count("("), value.count(")")
                yield i, start + (value[0] == "(" and shut < open_), end + (text[end : end + 1] == ")" and 0 < open_ - shut)
            if not goes_on:
                break


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and other identifier-like tokens, or numbers over several tokens, with their two contexts.

    Numbers that begin at one token exclude each other, so for the words before it they are one place:
    the longest. With the words on both sides a place is the value itself.
    """
    if not base and not re.search("[0-9@]", text):
        return []
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    begins = [a for a, _ in tokens]
    word = lambda k: text[slice(*tokens[k])].lower() if 0 <= k < len(tokens) else ""

    def mention(start: int, end: int, kind: int, seed: bool, place: str = "") -> dict:
        k = bisect.bisect_right(begins, start) - 1
        after = bisect.bisect_left(begins, end)
        value = text[start:end]
        contexts = [
            {"pattern": f"{word(k - 2)} {word(k - 1)} _", "place": place or value},
            {"pattern": f"{word(k - 1)} _ {word(after)}", "place": value},
        ]
        return {"start": start, "end": end, "kind": kind, "seed": seed, "value": value, "contexts": contexts}

    out, ends, last = [], [], -1
    for start, kind, end in base:
        out.append(mention(start, end, kind, True))
        last = max(last, end)
        ends.append(last)
    starts = [s for s, _, _ in base]

    def covered(start: int, end: int) -> bool:
        k = bisect.bisect_left(starts, end) - 1
        return k >= 0 and ends[k] > start

    read: dict[int, list[tuple[int, int, list[int]]]] = {}
    for k, (a, b) in enumerate(tokens):
        raw = text[a:b]
        token = raw.strip(EDGES)
        if not token or not any(c.isdigit() or c == "@" for c in token):
            continue
        start = a + raw.index(token)
        if not covered(start, start + len(token)) and (kinds := shapes(token)):
            read.setdefault(k, []).append((start, start + len(token), kinds))
    for k, start, end in blank_runs(text, tokens, [covered(a, b) for a, b in tokens]):
        if kinds := blank_shapes(text[start:end]):
            read.setdefault(k, []).append((start, end, kinds))
    for _, readings in sorted(read.items()):
        begin, stop, _ = max(readings, key=lambda r: r[1])
        for start, end, kinds in readings:
            out += [mention(start, end, kind, False, text[begin:stop]) for kind in kinds]
    return out


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())])
MENTION = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("seed", T.BooleanType()),
        T.StructField("value", T.StringType()),
        T.StructField(
            "contexts", T.ArrayType(T.StructType([T.StructField("pattern", T.StringType()), T.StructField("place", T.StringType())]))
        ),
    ]
)


def scan(text: Column) -> Column:
    """Base spans and mentions of a text (null: empty), as a struct."""
    result = T.StructType([T.StructField("base", T.ArrayType(SPAN)), T.StructField("mentions", T.ArrayType(MENTION))])

    @F.arrow_udf(result)
    def read(texts: pa.Array) -> pa.Array:
        rows = []
        for value in texts:
            text = (value.as_py() or b"").decode("utf-8", "replace")
            base = base_spans(text)
            spans = [{"start": a, "kind": k, "end": b} for a, k, b in base]
            rows.append({"base": spans, "mentions": mentions(text, base)})
        return pa.array(rows, type=_ARROW)

    return read(text.cast("binary"))


_ARROW = pa.struct(
    [
        ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))),
        (
            "mentions",
            pa.list_(
                pa.struct(
                    [
                        ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("seed", pa.bool_()),
                        ("value", pa.string()), ("contexts", pa.list_(pa.struct([("pattern", pa.string()), ("place", pa.string())]))),
                    ]
                )
            ),
        ),
    ]
)


def bootstrap(found: DataFrame, rounds: int, least_support: int, trusted: float) -> DataFrame:
    """(value, kind, score): unseen identifiers that trusted patterns lead to.

    ``found``: start, kind, seed, value, contexts of every mention. Counts are summed per
    (pattern, place, value, kind) before anything is joined, so a frequent context or value is one row per
    neighbour. Each round's scores are written.
    """
    spread = found.select("value", "kind", F.inline("contexts"))
    counts = spread.groupBy("pattern", "place", "value", "kind").agg(F.count("*").alias("n"))
    edges = saved(counts, "edges")
    score = found.groupBy("value", "kind").agg(F.max("seed").alias("seed"))
    score = saved(score.withColumn("score", F.col("seed").cast("double")), "scores")
    for _ in range(rounds):
        weight = F.when(F.col("score") >= trusted, 1.0).otherwise(UNSEEN_WEIGHT)
        known = edges.join(score, ["value", "kind"]).withColumn("weight", F.col("n") * weight)
        # what one place may be, of two kinds or shorter and longer, is one mention; known if one of them is trusted
        places = known.groupBy("pattern", "place", "kind").agg(
            F.max(F.col("weight") * F.col("score")).alias("hits"), F.max("weight").alias("weight")
        )
        totals = places.groupBy("pattern", "place").agg(F.max("weight").alias("weight"))
        totals = totals.groupBy("pattern").agg(F.sum("weight").alias("total"))
        support = known.where(F.col("score") >= trusted).groupBy("pattern", "kind").agg(F.count_distinct("value").alias("support"))
        patterns = places.groupBy("pattern", "kind").agg(F.sum("hits").alias("hits"))
        patterns = support.where(F.col("support") >= least_support).join(patterns, ["pattern", "kind"]).join(totals, "pattern")
        trust = F.least(F.col("hits") / F.col("total"), F.lit(0.999))
        patterns = patterns.select("pattern", "kind", trust.alias("trust")).where(F.col("trust") >= trusted)
        led = edges.join(patterns, ["pattern", "kind"]).groupBy("value", "kind", "pattern").agg(F.max("trust").alias("trust"))
        offers = led.groupBy("value", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("offer")
        )
        updated = score.join(offers, ["value", "kind"], "left").select(
            "value", "kind", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("offer", F.lit(0.0))).alias("score")
        )
        score = saved(updated, "scores")
    return score.where(~F.col("seed") & (F.col("score") >= trusted)).select("value", "kind", "score")


def settle(added: Column) -> Column:
    """Of overlapping spans the one of the highest score, then the longest; one span may be of two kinds."""
    result = T.ArrayType(SPAN)

    @F.arrow_udf(result)
    def choose(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows:
            taken: list[tuple[int, int]] = []
            kept = []
            for s in sorted(row.as_py() or [], key=lambda s: (-round(s["score"], 12), s["start"] - s["end"], s["start"], s["kind"])):
                span = (s["start"], s["end"])
                at = bisect.bisect_left(taken, span)
                if at == len(taken) or taken[at] != span:
                    if (at and taken[at - 1][1] > span[0]) or (at < len(taken) and taken[at][0] < span[1]):
                        continue
                    taken.insert(at, span)
                kept.append({name: s[name] for name in ("start", "kind", "end")})
            out.append(kept)
        return pa.array(out, type=_ARROW.field("base").type)

    return choose(added)


def find(
    df: DataFrame,
    text_col: str,
    rounds: int = 3,
    least_support: int = 5,
    trusted: float = 0.9,
    keep: list[str] | None = None,
) -> DataFrame:
    """Columns ``keep`` (all by default) of every row with ``base`` and ``spans``, sorted arrays of (start, kind, end).

    Offsets count code points of the whole text, end exclusive; ``spans`` holds the base spans and
    the added ones, which never overlap a base span. Unseen numbers may be written with blanks, within
    one line. A pattern needs ``least_support`` trusted
    values and a trusted share of its mentions. Null texts are empty; equal rows and equal or null
    ids stay rows of their own; columns named like the added ones are replaced; an empty table gives
    none.
    """
    keep = [c for c in (keep or df.columns) if c not in ("base", "spans")]
    rows = df.select(*keep, F.monotonically_increasing_id().alias("__llm_row"), scan(F.col(text_col)).alias("__llm_scan"))
    base, mentioned = F.col("__llm_scan.base").alias("base"), F.col("__llm_scan.mentions").alias("__llm_mentions")
    rows = saved(rows.select(*keep, "__llm_row", base, mentioned), "mentions")
    found = rows.select("__llm_row", F.inline("__llm_mentions"))
    new = bootstrap(found, rounds, least_support, trusted)
    told = found.where(~F.col("seed")).join(new, ["value", "kind"]).select("__llm_row", "start", "kind", "end", "score").distinct()
    added = told.groupBy("__llm_row").agg(F.collect_list(F.struct("start", "kind", "end", "score")).alias("__llm_added"))
    added = added.select("__llm_row", settle(F.col("__llm_added")).alias("__llm_added"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    both = rows.join(saved(added, "added"), "__llm_row", "left")
    spans = F.sort_array(F.concat("base", F.coalesce("__llm_added", none)))
    return both.select(*keep, "base", spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, in order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by <KIND>; of overlapping spans the first counts."""
    result = T.StringType()

    @F.arrow_udf(result)
    def replace(texts: pa.Array, all_spans: pa.Array) -> pa.Array:
        out = []
        for value, spans in zip(texts, all_spans, strict=True):
            text, parts, done = value.as_py(), [], 0
            for s in spans.as_py() or []:
                if text is not None and s["start"] >= done:
                    parts += [text[done : s["start"]], f"<{KINDS[s['kind']].upper()}>"]
                    done = s["end"]
            out.append(None if text is None else "".join([*parts, text[done:]]))
        return pa.array(out, pa.string())

    return replace(text, spans)
