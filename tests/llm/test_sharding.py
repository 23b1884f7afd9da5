import numpy as np
from tests.llm.helpers import awkward, clashing, empty

from agroseries.llm import sharding


def test_matrix_margins_and_law():
    counts, sizes = [5, 0, 40, 15], [20, 20, 20]
    made = [sharding.communication_matrix(counts, sizes, seed) for seed in range(400)]
    for m in made:
        assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == sizes and (m >= 0).all()
    mean = np.mean([m[2] for m in made], axis=0)
    assert np.allclose(mean, 40 / 3, atol=0.4)
    spread = np.var([m[2, 0] for m in made])
    assert abs(spread - 40 * (1 / 3) * (2 / 3) * (20 / 59)) < 0.6  # hypergeometric variance


def test_draws_follow_the_hypergeometric_law():
    rng = np.random.default_rng(1)
    draws = np.bincount([sharding.hypergeometric(rng, 5, 7, 4) for _ in range(6000)], minlength=5) / 6000
    from math import comb

    want = [comb(5, k) * comb(7, 4 - k) / comb(12, 4) for k in range(5)]
    assert np.abs(draws - want).max() < 0.03
    assert sharding.hypergeometric(rng, 3 * 10**10, 10**10, 1000) > 600


def placed(df, shards=5, **options):
    return [tuple(r) for r in sharding.shuffle_into_shards(df, shards, **options).select("doc_id", "text", "shard", "slot").collect()]


def test_every_row_once_in_gapless_even_shards(spark):
    df = spark.range(1003).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text").repartition(7)
    rows = placed(df, rows_per_cell=50)
    assert sorted(r[0] for r in rows) == list(range(1003))
    sizes = [sorted(r[3] for r in rows if r[2] == s) for s in range(5)]
    assert sorted(map(len, sizes)) == [200, 200, 201, 201, 201]
    assert all(s == list(range(len(s))) for s in sizes)


def test_shuffle_is_uniform(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "'' AS text").repartition(3)
    rows = placed(df, shards=4)
    for half in (0, 2000):
        seen = np.bincount([r[2] for r in rows if half <= r[0] < half + 2000], minlength=4)
        assert np.abs(seen - 500).max() < 100
    order = [r[0] for r in sorted(rows, key=lambda r: (r[2], r[3]))]
    assert abs(np.corrcoef(order[:-1], order[1:])[0, 1]) < 0.08


def test_awkward_and_empty_tables(spark):
    df = clashing(awkward(spark), ["shard", "slot", "part", "place"])
    out = sharding.shuffle_into_shards(df, 3)
    assert sorted(out.columns) == sorted(df.columns)
    assert sorted(r["slot"] for r in out.collect()) == [0, 0, 0, 1, 1, 1, 2, 2]
    assert placed(empty(spark)) == []


def test_beyond_the_broadcast_limit(spark):
    old, sharding.BROADCAST_BYTES = sharding.BROADCAST_BYTES, -1
    try:
        assert len(placed(spark.range(50).selectExpr("id AS doc_id", "'' AS text"))) == 50
    finally:
        sharding.BROADCAST_BYTES = old
