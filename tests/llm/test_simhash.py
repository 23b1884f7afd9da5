import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from agroseries.llm import simhash
from agroseries.llm.components import components
from tests.llm.helpers import awkward, clashing, empty


def plain_fingerprint(text):
    """Bit by bit, one shingle after the other."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lowered.replace("\n", " ").replace("\t", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, near):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in near:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows.items()}
    near = [(a, b) for a in rows for b in rows if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = classes(rows, near)
    got = simhash.near_duplicates(docs, "doc_id", "text").select("doc_id", simhash.hex_of(F.col(simhash.FP)), "component_id").collect()
    assert {(r[0], r[1], r[2]) for r in got} == {(i, f"{prints[i]:016x}", want[i]) for i in rows}


def test_links_find_every_pair_once(spark):
    rng = random.Random(5)
    values = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        values.add(base)
        for _ in range(6):
            values.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    ordered = sorted(values)
    for distance in (0, 1, 2, 3, 4, 5):
        got = simhash.links(df, distance).collect()
        want = {(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if (a ^ b).bit_count() <= distance}
        assert len(got) == len(want)
        assert {tuple(sorted((r[0] % 2**64, r[1] % 2**64))) for r in got} == want


def test_embedding_never_exceeds_the_bit_distance(spark):
    rng = np.random.default_rng(2)
    pairs = rng.integers(-(2**63), 2**63 - 1, (200, 2))
    df = spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "a bigint, b bigint")
    far = F.bit_count(simhash.embedding(F.col("a")).bitwiseXOR(simhash.embedding(F.col("b"))))
    assert df.where(far > F.bit_count(F.col("a").bitwiseXOR(F.col("b")))).count() == 0


def test_components_of_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 101 + i) for i in range(30)] + [(115, 99)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(chain + star, "a bigint, b bigint"), "a", "b").collect())
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 99 for i in range(99, 131))
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_awkward_rows(spark):
    df = clashing(awkward(spark), ["component_id", "keeper", "fp", "label", "first", "node"])
    rows = simhash.near_duplicates(df, "doc_id", "text").collect()
    assert len(rows) == 8
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert [r["keeper"] for r in by_id[1]].count(True) == 1
    assert by_id[2][0]["component_id"] == by_id[3][0]["component_id"] == by_id[5][0]["component_id"] == 2
    assert by_id[2][0][simhash.FP] == 0 and by_id[None][0]["component_id"] is None
    assert simhash.near_duplicates(empty(spark), "doc_id", "text").count() == 0
