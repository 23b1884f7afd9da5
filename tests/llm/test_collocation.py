import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from agroseries.llm import collocation
from tests.llm.helpers import LONG, awkward, clashing, empty

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, threshold=10, share=50, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = [w for w in re.split("[ \t]", piece) if w]
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    found = {}
    for (lang, words), a in counts.items():
        if len(words) > 1 and a >= threshold:
            cuts = []
            for k in range(1, len(words)):
                left, right = counts[lang, words[:k]], counts[lang, words[k:]]
                cuts.append((1000000 * a * a // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            found[lang, words] = (a, left, right, score)
    out = []
    for lang in totals:
        kept = []
        for (of, words), (a, left, right, score) in found.items():
            longer = [x[0] for (o, w), x in found.items() if o == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w)))]
            if of == lang and not any(100 * x >= share * a for x in longer):
                kept.append((-score, -a, " ".join(words).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def made(df, **options):
    got = collocation.collocations(df, "lang", "text", **options)
    assert got.columns == COLUMNS
    return sorted(tuple(r) for r in got.collect())


def texts(rng, n):
    vocabulary = [f"w{i}" for i in range(12)] + ["été", "Zoë", "New", "York", "<|x|>", "\x1f"]
    rows = []
    for _ in range(n):
        words = rng.choices(vocabulary, [30 // (i + 1) + 1 for i in range(len(vocabulary))], k=rng.randrange(0, 60))
        gap = lambda: rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\r\n", " \x0b"])
        rows.append((rng.choice(["en", "en", "en", "fr", None, "und"]), "".join(w + gap() for w in words)))
    return rows


@pytest.mark.parametrize("limits", [{}, {"threshold": 3, "share": 80, "top": 5}])
def test_against_brute_force(spark, limits, monkeypatch):
    monkeypatch.setattr(collocation, "SLICE", 2000)  # several slices in a partition
    rows = texts(random.Random(3), 400)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = brute(rows, **limits)
    assert made(df, **limits) == want and len(want) > 10


@pytest.mark.parametrize("seed", range(5))
def test_merged_summaries_keep_every_frequent_item(seed):
    """Also where most counters are cut, and in whatever order summaries are merged."""
    rng = np.random.default_rng(seed)
    draws = np.minimum(rng.zipf(1.3, 20000), 3000).astype(np.uint64)
    slices = np.array_split(draws, 17)
    summaries = [collocation.Summary(*np.unique(s, return_counts=True)) for s in slices]
    counts = dict(zip(*np.unique(draws, return_counts=True)))
    threshold = 200
    capacity = len(draws) // threshold + 1
    kept = set(collocation.survivors(iter(summaries), len(draws), threshold).tolist())
    assert {x for x, n in counts.items() if n >= threshold} <= kept and len(kept) <= capacity < len(counts)
    whole = collocation.Summary(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for s in summaries:
        whole = collocation.merge(s, whole, capacity)
    assert len(whole.hashes) <= capacity and whole.lost * (capacity + 1) <= len(draws)
    for x, n in zip(whole.hashes.tolist(), whole.counts.tolist()):
        assert n <= counts[x] <= n + whole.lost


def test_packed_hashes_come_back():
    hashes = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (collocation._hashes(collocation._steps(hashes)) == hashes).all()
    cuts = collocation._cuts(hashes, 7)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(hashes) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))


def test_exact_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_000_001, 3_000_000_000_002, 3_000_000_000_003)], "a long, l long, r long")
    a, l, r = 3_000_000_000_001, 3_000_000_000_002, 3_000_000_000_003
    assert df.select(collocation._score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 1000000 * a * a // (l * r)


def test_awkward_rows_and_clashing_names(spark):
    docs = clashing(awkward(spark), ["slice", "words", "f", "rank", "phrase", "n", "score", "size"])
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert made(docs) == brute(rows)
    assert any(r[0] == "la" and r[3] == LONG.count("ipsum") for r in made(docs))


def test_no_rows(spark):
    assert made(empty(spark)) == []


def test_a_slice_is_summarised_in_little_memory():
    """One length of items at a time, and the parts one after the other."""
    rng = np.random.default_rng(6)
    slice_ = [("en", " ".join(f"w{k}" for k in rng.integers(0, 20000, 1000))) for _ in range(300)]
    total = 0
    tracemalloc.start()
    try:
        for part, summary in collocation._summaries(collocation.Items(iter(slice_)), 64):
            total += int(summary.counts.sum())
            assert (summary.hashes[1:] > summary.hashes[:-1]).all() and int(summary.hashes[0]) >> 58 == part
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert total == 300 * (1000 + 999 + 998) and peak < 100 * 300_000
