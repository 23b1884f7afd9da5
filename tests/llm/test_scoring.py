"""Quality rules, language labels, exact search."""

import math
import random
import zlib
from collections import Counter
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from agroseries.llm import knn, language, quality, queries
from tests.llm.helpers import awkward, clashing, empty

SF = "/root/testdata/sf0.001"


def words(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def plain_counts(text):
    """The base counts by loops."""
    own = words(text)
    five = Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))
    covered = {j for i in range(len(own) - 4) if five[tuple(own[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (
        len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)
    )


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_base_counts_against_loops(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(0, 40))) for _ in range(150)]
    texts += ["a b c d e", "a a a a a a", "x\ny\nx\n\n \nx", "a\x0bb c | <d>", "é" * 50, None, ""]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "i int, text string, lang string")
    for r in quality.judge(df, "text", "lang", least_words=5, least_chars=10).collect():
        assert tuple(r[c] for c in COUNTS) == plain_counts(r["text"]), r["text"]
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])


def divergence(p, q):
    def half(a, b):
        return sum(0.5 * x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x > 0)

    return math.sqrt(max(0.0, half(p, q) + half(q, p)))


def test_word_distance_against_full_histograms(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r["lang"], Counter()).update(words(r["text"]))
    top = {lang: sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:40] for lang, c in by_lang.items()}
    got = {r["doc_id"]: r["word_distance"] for r in quality.judge(docs, "text", "lang").collect()}
    for r in rows:
        own, n = Counter(words(r["text"])), len(words(r["text"]))
        if n < 100:
            assert got[r["doc_id"]] is None
            continue
        near = []
        for lang, listed in top.items():
            total = sum(by_lang[lang].values())
            q = [c / total for _, c in listed]
            p = [own[w] / n for w, _ in listed]
            near.append(divergence([*p, 1 - sum(p)], [*q, 1 - sum(q)]))
        assert abs(got[r["doc_id"]] - min(near)) < 1e-9


def test_words_that_no_language_lists_go(spark):
    """Random lower-case words have ordinary letters; only the common words tell them from prose."""
    rng = random.Random(6)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    salad = [
        (10_000 + i, " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(7, 11))) for _ in range(400)), None) for i in range(20)
    ]
    made = spark.createDataFrame(salad, "doc_id bigint, text string, lang string")
    judged = quality.judge(docs.unionByName(made), "text", "lang")
    odd = judged.where("doc_id >= 10000").collect()
    assert not any(r["base_failed"] or r["kept"] for r in odd) and all(abs(r["word_reach"] - 1) < 1e-9 for r in odd)
    clean = judged.where("doc_id < 10000 AND NOT base_failed AND n_symbols = 0 AND n_words >= 100")
    assert clean.where("kept").count() >= 0.98 * clean.count() > 50


def test_clean_prose_stays_and_symbols_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 1500")
    noisy = docs.withColumns({"doc_id": F.col("doc_id") + 10_000, "text": F.regexp_replace("text", " ", "### "), "lang": F.lit(None).cast("string")})
    judged = quality.judge(docs.unionByName(noisy), "text", "lang").where("NOT base_failed")
    assert judged.where("doc_id >= 10000 AND kept").count() == 0
    plain = judged.where("doc_id < 10000 AND n_symbols = 0")
    assert plain.where("NOT kept").count() == 0 and plain.count() > 50


def test_quality_awkward_rows(spark):
    df = clashing(awkward(spark), ["kept", "n_words", "word", "count", "rank"])
    rows = quality.judge(df, "text", "lang").collect()
    assert len(rows) == 8 and {r["doc_id"]: r["n_words"] for r in rows}[2] == 0
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (2, 3, 5, 6))
    assert quality.judge(empty(spark), "text", "lang").count() == 0
    alone = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["class_distance"] for r in quality.judge(alone, "text", "lang").collect()} == {None}


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(0)
    codes, mask = language.to_batch([b"abcde", b"xy", b"hello"])
    h = 3
    w, u = rng.normal(0, 0.5, (256, 3 * h)).astype(np.float32), rng.normal(0, 0.5, (h, 3 * h)).astype(np.float32)
    aim = rng.normal(0, 1, (5, 3, h)).astype(np.float32)

    def loss():
        return float((language.run_direction(codes, mask, w, u).astype(np.float64) * aim).sum())

    _, saved = language.run_direction(codes, mask, w, u, keep=True)
    dw, du = language.back_direction(codes, saved, u, aim)
    for array, grad, at in ((u, du, (1, 2)), (u, du, (0, 7)), (u, du, (2, 4)), (w, dw, (ord("c"), 1)), (w, dw, (ord("y"), 8))):
        old, eps = array[at], 1e-2
        array[at] = old + eps
        high = loss()
        array[at] = old - eps
        low = loss()
        array[at] = old
        assert abs((high - low) / (2 * eps) - grad[at]) < 2e-2


def test_held_out_accuracy(spark):
    found = queries.op4_language(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r["lang_pred"] == r["lang"] for r in rows if r["held_out"]]
    assert len(held) > 250 and sum(held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_awkward_rows(spark):
    df = clashing(awkward(spark), ["lang_pred", "score", "window", "key", "rank", "data"])
    rows = language.identify(df, "doc_id", "text", "lang", F.lit(True), rounds=5).collect()
    assert len(rows) == 8
    assert {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 5)} == {2: "und", 3: "und", 5: "und"}
    assert all(r["lang_pred"] in ("en", "fr", "la") for r in rows if r["doc_id"] in (1, 4, 6))
    nothing = language.identify(df, "doc_id", "text", "lang", F.lit(False))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert language.identify(empty(spark), "doc_id", "text", "lang", F.lit(True)).count() == 0


def test_windows_of_a_text_are_averaged():
    net = language.train([b"aaaa", b"zzzz"] * 20, ["a", "z"] * 20, hidden=4, rounds=30)
    texts = [b"a" * 1000, b"z" * 5, b"", b"a" * 300 + b"z" * 40]
    found = list(language.predict_texts(net, iter(texts * 600)))
    assert len(found) == 2400 and np.allclose(found[0], found[2396], atol=1e-6)
    assert found[0][0] > 0.9 and found[1][1] > 0.8 and found[2].sum() == 0 and found[3][0] > found[3][1]


def brute_top(vectors, k):
    out = {}
    for q in vectors:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def found_top(df, k=5, **options):
    top = knn.top_k(df, "vec_id", knn.scaled(F.col("embedding")), F.col("vec_id") % 50 == 0, k, **options)
    out = {}
    for r in sorted(top.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], int(r["score"])))
    return out


def test_search_against_brute_force_over_shards(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(700)]
    rows += [(i, [0.25] * 6) for i in range(700, 1000)]  # many equal vectors
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    vectors = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows}
    assert found_top(df, shard_rows=150) == brute_top(vectors, 5)


def test_search_with_huge_components_is_exact(spark):
    rows = [(i, [1e12 + 3e5 * i, -1e12 - i, float(i)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    vectors = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    assert found_top(df) == brute_top(vectors, 5)


def test_search_keeps_every_row_of_a_repeated_id(spark):
    """Different vectors under one id, and one row given twice, are candidates of their own."""
    rows = [(50, [1.0]), (7, [3.0]), (7, [9.0]), (7, [-2.0]), (8, [4.0]), (8, [4.0]), (9, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    w = 256 * 256
    for options in ({}, {"shard_rows": 2}):
        assert found_top(df, **options) == {50: [(7, 9 * w), (8, 4 * w), (8, 4 * w), (7, 3 * w), (9, w)]}


def test_search_awkward_rows(spark):
    nan = float("nan")
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [math.inf, 1.0]), (5, [1.0, 2.0]),
        (6, [1.0, 2.0]), (7, [1.0]), (None, [9.0, 9.0]), (50, []), (8, [0.0, 0.0]),
    ]
    df = clashing(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), ["values", "size", "shard", "asks", "rank", "score"])
    want = 256 * 256 * 5
    # both rows with id 0 ask, and are ranked together
    assert found_top(df) == {0: [(5, want), (5, want), (6, want), (6, want), (8, 0)]}
    assert found_top(df.limit(0)) == {}
    assert isinstance(knn.top_k(df, "vec_id", knn.scaled(F.col("embedding")), F.lit(True)).first()["score"], Decimal)


def test_queries_go_only_to_shards_whose_box_reaches_their_kth_score(spark):
    """Ten far groups: a query leaves its own corner only where the k-th score can still be beaten."""
    rng = np.random.default_rng(3)
    centre = 40.0 * np.eye(10)
    points = [(i, (centre[i % 10] + rng.uniform(-1, 1, 10)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(points, "vec_id bigint, values array<double>").withColumn("size", F.size("values"))
    vectors, tasks = knn.sharded(df, 100)
    vectors = vectors.cache()
    shards = vectors.select("shard").distinct().count()
    assert shards >= 20
    ends = {f"v{i}": F.col("values")[i] for i in range(10)}
    low = F.array(*[F.min(c) for c in ends.values()])
    boxes = vectors.groupBy("size", "shard").agg(low.alias("low"), F.array(*[F.max(c) for c in ends.values()]).alias("high"))
    queries = vectors.where("vec_id % 50 = 0").withColumn("floor", F.lit(1000).cast("decimal(38,0)"))
    sent = knn.candidate_shards(queries.select("row", "vec_id", "values", "floor", "size", "shard"), boxes, tasks)
    pairs = {(r["vec_id"], r["shard"]) for r in sent.collect()}
    own = {r["vec_id"]: r["shard"] for r in queries.collect()}
    where = {r["shard"]: r for r in boxes.collect()}
    asked = {r["vec_id"]: np.array(r["values"]) for r in queries.collect()}
    bound = lambda q, b: np.maximum(q * np.array(b["low"]), q * np.array(b["high"])).sum()
    assert pairs == {(q, s) for q in own for s, b in where.items() if s != own[q] and bound(asked[q], b) >= 1000}
    assert 0 < len(pairs) < 0.3 * len(own) * (shards - 1)
    vectors.unpersist()


def test_cells_of_equal_vectors_and_of_two_values():
    assert knn.cut_cells(np.ones((50, 3)), 8) == [knn.Cut(-1, 0.0, -1, -1)]
    points = np.array([[0.0]] * 90 + [[1.0]] * 10)
    cells = knn.cell_of(knn.cut_cells(points, 8), points)
    assert len(set(cells[:90])) == len(set(cells[90:])) == 1 and cells[0] != cells[90]
