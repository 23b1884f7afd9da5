import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from agroseries.llm import merkle
from tests.llm.helpers import awkward, clashing, empty


def H(parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """Top of a list of digests and, per node, its siblings level by level."""
    proofs, level = [[] for _ in nodes], nodes
    at = list(range(len(nodes)))
    while len(level) > 1:
        for p, i in zip(proofs, at):
            run = level[i - i % 8 : i - i % 8 + 8]
            p.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        level = [H(level[i : i + 8]) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], proofs


def brute(rows):
    """rows: (id, group, leaf, changed)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    low = {g: tree([r[2] for r in groups[g]]) for g in names}
    root, high = tree([low[g][0] for g in names])
    out = []
    for g, over in zip(names, high):
        for r, proof in zip(groups[g], low[g][1]):
            h = r[3] or r[2]
            for before, after in proof + over:
                h = H([before, h, after])
            out.append((r[0], g, r[2], low[g][0], root, tuple(proof + over), h))
    return sorted(out, key=repr)


def made(df, **options):
    got = merkle.manifest(df, "doc_id", "lang", F.col("leaf_in"), F.col("changed_in"), **options)
    return sorted(
        ((r["id"], r["group"], r["leaf"], r["subroot"], r["root"], tuple(zip(r["before"], r["after"])), r["folded"]) for r in got.collect()),
        key=repr,
    )


@pytest.mark.parametrize("groups,height", [([700, 64, 9, 8, 1], 3), ([130, 70], 1), ([1], 2), ([3] * 70, 1)])
def test_against_brute_force(spark, groups, height):
    rng = random.Random(len(groups))
    names = [None, "é", "z", "a", "b"] if len(groups) < 6 else [f"g{i}" for i in range(len(groups))]
    rows = []
    for name, n in zip(names, groups):
        for i in range(n):
            rows.append((rng.choice([i, i, 7, None, 2**60 + i]), name, H([name or "", str(i)]), H(["x", str(i)]) if i % 3 == 0 else None))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, leaf_in string, changed_in string")
    assert made(df, height=height) == brute(rows)


def test_leaf_is_the_fields_with_their_lengths(spark):
    df = spark.createDataFrame([(1, None, "né")], "a int, b string, c string")
    got = df.select(merkle.digest([F.col("a"), F.col("b"), F.col("c")])).first()[0]
    assert got == sha256("1:1-3:né".encode()).hexdigest()


def test_proof_is_enough_to_verify(spark):
    rows = [(i, "a" if i % 4 else "b", H([str(i)]), None) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, leaf_in string, changed_in string")
    got = merkle.manifest(df, "doc_id", "lang", F.col("leaf_in"), height=1)
    good = merkle.fold(F.col("leaf"), F.col("before"), F.col("after")) == F.col("root")
    bad = merkle.fold(F.sha2("leaf", 256), F.col("before"), F.col("after")) == F.col("root")
    assert got.where(good).count() == 100 and got.where(bad).count() == 0
    assert got.where("folded = root").count() == 100


def test_awkward_rows_and_clashing_names(spark):
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    leaf = merkle.digest([F.col(c) for c in fields])
    docs = clashing(awkward(spark), ["id", "pos", "n", "leaf", "root", "block", "__group", "before", "group", "changed"])
    got = merkle.manifest(docs, "doc_id", "lang", leaf).collect()
    assert len(got) == 8 and len({r["root"] for r in got}) == 1
    assert all(r["folded"] == r["root"] for r in got)
    repeated = [r for r in got if r["id"] == 1]
    assert len(repeated) == 2 and repeated[0]["leaf"] == repeated[1]["leaf"] and repeated[0]["pos"] != repeated[1]["pos"]
    assert sorted(r["pos"] for r in got if r["group"] == "en") == [0, 1, 2, 3, 4]


def test_no_rows(spark):
    got = merkle.manifest(empty(spark), "doc_id", "lang", merkle.digest([F.col("text")]))
    assert got.count() == 0 and got.schema["id"].dataType.typeName() == "long"


def test_a_missing_digest_is_an_error(spark):
    df = spark.createDataFrame([(1, "a", None, None)], "doc_id bigint, lang string, leaf_in string, changed_in string")
    with pytest.raises(Exception, match="leaf without a digest"):
        made(df)
