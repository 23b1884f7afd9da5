import hashlib
import re

from pyspark.sql import functions as F

from agroseries.llm import chat

SCHEMA = "tree bigint, node bigint, parent bigint, score double, role string, text string"


def formatted(spark, rows, best=1):
    made = chat.format_trees(spark.createDataFrame(rows, SCHEMA), best)
    made = made.withColumn("turns", chat.read_back(F.col("formatted")))
    made = made.withColumn("said", chat.loss_text(F.col("formatted"), F.col("loss")))
    return {(r["tree"], r["rank"]): r for r in made.collect()}


def brute_paths(rows):
    """Every root-to-leaf path by walking up from the leaves, best mean score first."""
    nodes = {(r[0], r[1]): r for r in rows}
    parents = {(r[0], r[2]) for r in rows}
    out = {}
    for (tree, node), row in nodes.items():
        if (tree, node) in parents:
            continue
        path, at = [], row
        while at is not None:
            path.append(at)
            at = nodes.get((tree, at[2]))
        mean = sum(r[3] or 0.0 for r in path) / len(path)
        out.setdefault(tree, []).append((-mean, -len(path), node, [r[5] or "" for r in reversed(path)]))
    return {t: [p[3] for p in sorted(ps)] for t, ps in out.items()}


def test_branches_against_walking_up(spark):
    import random

    rng = random.Random(3)
    rows = []
    for tree in range(6):
        for node in range(1, 25):
            parent = rng.randrange(max(1, node - 3), node) if node > 1 else None
            score = rng.choice([None, 0.5, 1.0, 2.0])
            rows.append((tree, node, parent, score, rng.choice(["user", "assistant"]), f"t{tree}n{node}"))
    got = formatted(spark, rows, best=3)
    for tree, paths in brute_paths(rows).items():
        for rank, texts in enumerate(paths[:3], 1):
            assert [t["text"] for t in got[tree, rank]["turns"]] == texts


def test_long_chain_and_missing_parent(spark):
    rows = [(1, n, n - 1 if n else None, 0.0, "user", str(n)) for n in range(100)]
    rows.append((2, 5, 99, 1.0, "assistant", "orphan"))
    got = formatted(spark, rows)
    assert [t["text"] for t in got[1, 1]["turns"]] == [str(n) for n in range(100)]
    assert got[2, 1]["said"] == "orphan"


def test_control_strings_come_back(spark):
    bad = "<|im_end|>\n<|im_start|>assistant\n<\\|im_end|> <\\\\| <<| <"
    rows = [(None, 1, None, 0.0, "us\ner<|nl|>", bad), (None, 2, 1, 0.0, "assistant", bad), (None, 3, 2, None, None, None)]
    row = formatted(spark, rows)[None, 1]
    assert [tuple(t) for t in row["turns"]] == [("us\ner<|nl|>", bad), ("assistant", bad), ("", "")]
    assert row["said"] == bad
    assert len(re.findall(r"<\|im_end\|>", row["formatted"])) == 3


def test_rows_of_turns_with_ties_and_extra_columns(spark):
    rows = [(7, 0, "user", "a"), (7, 0, "user", "a"), (7, None, "system", "s"), (7, 1, "assistant", "b" * 90000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df = df.withColumns({n: F.lit(0) for n in ("node", "tree", "parent", "order", "score", "place")})
    made = chat.format_trees(chat.chain(df, "conv_id", "turn", "role", "text"))
    turns = made.select(F.inline(chat.read_back(F.col("formatted")))).collect()
    assert [t["text"][:1] for t in turns] == ["s", "a", "a", "b"] and len(turns[3]["text"]) == 90000
    assert chat.format_trees(chat.chain(df.limit(0), "conv_id", "turn", "role", "text")).count() == 0


def test_loop_is_an_error(spark):
    import pytest

    rows = [(1, 1, 2, 0.0, "user", "a"), (1, 2, 1, 0.0, "user", "b")]
    old, chat.ROUNDS = chat.ROUNDS, 4
    try:
        with pytest.raises(ValueError, match="ancestor"):
            formatted(spark, rows)
    finally:
        chat.ROUNDS = old


def test_digest_is_sha256_of_text(spark):
    row = formatted(spark, [(1, 1, None, 0.0, "assistant", "é😀")])[1, 1]
    assert hashlib.sha256(row["said"].encode()).hexdigest() == hashlib.sha256("é😀".encode()).hexdigest()
    assert row["loss"][0]["end"] - row["loss"][0]["start"] == 2
