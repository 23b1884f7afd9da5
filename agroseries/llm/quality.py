"""Quality rules: base counts, and divergence of a document from its nearest language.

Every language has two references, taken from all documents labelled with it: the shares of seven
character classes, and the shares of its most common words (all other words are one bin). A document
is compared with each reference by Jensen-Shannon distance (square root of the divergence in bits, 0
to 1) and the nearest language counts. Histograms of short texts are noise, so each comparison has a
least length below which it is not made.

Everything is one row in, one row out: repeated windows and common words are found inside the row, so
no document is spread over a shuffle and none is gathered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agroseries.sources.shared import saved

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
CLASSES = ("lower", "space", "upper", "digit", "symbol", "letter", "other")
PATTERNS = {
    "lower": r"\p{Ll}+", "space": SPACE, "upper": r"\p{Lu}+", "digit": "[0-9]+", "symbol": "[#*$%&|<>]+", "letter": r"\p{L}+",
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def sorted_windows(windows: Column) -> Column:
    """(hash, position) of every window, sorted: equal windows stand side by side."""
    return F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def repeated_starts(pairs: Column) -> Column:
    """Positions of the windows that stand beside an equal one, in order."""
    twice = F.transform(
        pairs,
        lambda x, k: F.when((F.get(pairs, k - 1)["h"] == x["h"]) | (F.get(pairs, k + 1)["h"] == x["h"]), x["i"]),
    )
    return F.sort_array(F.filter(twice, lambda i: i.isNotNull()))


def covered_words(starts: Column) -> Column:
    """Words under windows that start there: ``WINDOW`` each, less where the next starts earlier."""
    cover = F.transform(starts, lambda i, k: F.least(F.coalesce(F.get(starts, k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(cover, F.lit(0).cast("bigint"), lambda total, n: total + n)


def base_counts(df: DataFrame, text_col: str, common: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` with base counts, class counts (``__c_*``) and hits (index, count) of ``common``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    work = df.select(*keep, text.alias("__text")).withColumn("__words", words_of(F.col("__text")))
    lines = F.filter(F.split("__text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    work = work.withColumns({"__n": F.size("__words").cast("bigint"), "__lines": lines, "__rest": F.col("__text")})
    for name, pattern in PATTERNS.items():
        work = work.withColumn("__less", F.regexp_replace("__rest", pattern, ""))
        size = (F.length("__rest") - F.length("__less")).cast("bigint")
        work = work.withColumns({f"__c_{name}": size, "__rest": F.col("__less")})
    words = F.col("__words")
    hashed = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
    )
    windows = F.when(F.size(words) > WINDOW, hashed).otherwise(F.array().cast("array<bigint>"))
    work = work.withColumn("__windows", windows)
    known = F.array(*[F.lit(w) for w in common]).cast("array<string>")
    some = F.size(F.array_distinct("__windows")) < F.size("__windows")
    work = work.withColumns(
        {"__pairs": F.when(some, sorted_windows(F.col("__windows"))), "__found": F.array_intersect(words, known)}
    )
    work = work.withColumn("__starts", repeated_starts(F.col("__pairs")))
    hit = lambda w: F.struct(
        F.array_position(known, w).cast("int").alias("k"),
        (F.col("__n") - F.size(F.array_remove(words, w))).alias("n"),
    )
    return work.select(
        *keep,
        F.col("__n").alias("n_words"),
        (F.length("__text") - F.col("__c_space")).cast("bigint").alias("word_chars"),
        F.col("__c_symbol").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered_words(F.col("__starts")), F.lit(0).cast("bigint")).alias("n_repeat_words"),
        *[f"__c_{c}" for c in CLASSES[:-1]],
        F.length("__rest").cast("bigint").alias("__c_other"),
        F.transform("__found", hit).alias("__hits"),
    )


def common_words(df: DataFrame, text_col: str, lang_col: str, top: int) -> dict[str, dict[str, int]]:
    """Counts over all documents of the ``top`` words of each non-null language.

    Only languages times ``top`` numbers reach the driver. Words are counted before the shuffle and
    ranked within each task first, so neither a common word nor a common language meets in one task.
    """
    words = df.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.explode(words_of(F.col(text_col))).alias("word")
    )
    counts = words.groupBy("lang", "word").count()
    order = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    found: dict[str, dict[str, int]] = {}
    for row in best.orderBy("lang", "rank").collect():
        found.setdefault(row["lang"], {})[row["word"]] = row["count"]
    return found


def _half(own: Column, other: Column) -> Column:
    """Half of own * log2(own / middle), 0 for none."""
    return F.when(own > 0, 0.5 * own * F.log2(2 * own / (own + other))).otherwise(0.0)


def _divergence(p: Column, q: Column) -> Column:
    return _half(p, q) + _half(q, p)


def _distance(divergence: Column) -> Column:
    return F.sqrt(F.least(F.greatest(divergence, F.lit(0.0)), F.lit(1.0)))


def class_distance(shares: dict[str, float]) -> Column:
    total = sum((F.col(f"__c_{c}") for c in CLASSES[1:]), F.col(f"__c_{CLASSES[0]}"))
    parts = [_divergence(F.col(f"__c_{c}") / total, F.lit(shares[c])) for c in CLASSES]
    return _distance(sum(parts[1:], parts[0]))


def word_distance(shares: Sequence[float]) -> Column:
    """``shares`` by index of the common words, 0 for words that the language does not list."""
    q_of = F.array(*[F.lit(float(s)) for s in shares])
    listed = F.lit(float(sum(shares)))
    hits = F.filter("__hits", lambda x: F.element_at(q_of, x["k"]) > 0)
    p = lambda x: x["n"] / F.col("n_words")
    q = lambda x: F.element_at(q_of, x["k"])
    none = F.lit(0.0)
    matched = F.aggregate(hits, none, lambda s, x: s + _divergence(p(x), q(x)) - 0.5 * q(x))
    rest = 1 - F.aggregate(hits, none, lambda s, x: s + p(x))
    return _distance(matched + 0.5 * listed + _divergence(rest, 1 - listed))


def without_listed(listed: float) -> float:
    """Distance of a text that has none of the words that make up ``listed`` of a language."""
    rest, middle = 1 - listed, 1 - listed / 2
    parts = 0.5 * listed + 0.5 * math.log2(1 / middle) + (0.5 * rest * math.log2(rest / middle) if rest > 0 else 0.0)
    return math.sqrt(min(max(parts, 0.0), 1.0))


def judge(
    df: DataFrame,
    text_col: str,
    lang_col: str,
    keep: Sequence[str] | None = None,
    top: int = 40,
    least_chars: int = 200,
    least_words: int = 100,
    most_class: float = 0.32,
    most_word: float = 0.95,
) -> DataFrame:
    """Columns ``keep`` (all by default) of every row, with the base counts and the verdict.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance,
    word_distance and kept; columns of ``df`` with such names are replaced. A distance is null below
    its least length (``least_chars`` characters, ``least_words`` words) or without any reference,
    and a null distance fails nobody. The limit of the word distance is ``most_word`` times what a text
    without any listed word has, per language, so it can be reached whatever share a language's
    list covers; ``word_reach`` is the least such share. Null texts count as empty and fail the base rules. Rows with a
    null language help no reference but are judged like all others. Equal rows are judged alike; an
    empty table gives none.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "word_reach", "kept"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in added]
    listed = common_words(df, text_col, lang_col, top)
    common = sorted({w for words in listed.values() for w in words})
    known = df.withColumn("__lang", F.col(lang_col))
    rows = saved(base_counts(known, text_col, common, [*keep, "__lang"]), "quality")
    sums = rows.where(F.col("__lang").isNotNull()).groupBy("__lang").agg(
        F.sum("n_words").alias("n_words"), *[F.sum(f"__c_{c}").alias(c) for c in CLASSES]
    )
    references = sums.orderBy("__lang").collect()  # a row per language
    class_all, word_all, reach_all = [], [], []
    for row in references:
        total = sum(row[c] for c in CLASSES)
        if total and row["n_words"]:
            class_all.append(class_distance({c: row[c] / total for c in CLASSES}))
            own = listed.get(row["__lang"], {})
            shares = [own.get(w, 0) / row["n_words"] for w in common]
            word_all.append(word_distance(shares))
            if sum(shares) > 0:
                reach_all.append(word_all[-1] / without_listed(sum(shares)))
    nearest = lambda found: F.array_min(F.array(*found)) if found else F.lit(None).cast("double")
    chars = sum((F.col(f"__c_{c}") for c in CLASSES[1:]), F.col(f"__c_{CLASSES[0]}"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = rows.withColumns(
        {
            "base_failed": failed,
            "class_distance": F.when(chars >= least_chars, nearest(class_all)),
            "word_distance": F.when(F.col("n_words") >= least_words, nearest(word_all)),
            "word_reach": F.when(F.col("n_words") >= least_words, nearest(reach_all)),
        }
    )
    odd = (F.col("class_distance") > most_class) | (F.col("word_reach") > most_word)
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))).select(*keep, *added)
