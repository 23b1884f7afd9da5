import random

import numpy as np
from pyspark.sql import functions as F

from agroseries.llm import hyperminhash
from tests.llm.helpers import awkward, clashing, empty
from tests.llm.test_simhash import classes


def plain_set(text, width=4):
    words = [w.lower() for w in (text or "").split(" ") if w]
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows):
    sets = [plain_set(t) for _, t in rows]
    near = []
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                near.append((j, i))
    root = classes(range(len(rows)), near)
    members = {}
    for i, (doc, _) in enumerate(rows):
        members.setdefault(root[i], []).append(doc)
    smallest = {k: min((d for d in v if d is not None), default=None) for k, v in members.items()}
    out = []
    for i, (doc, _) in enumerate(rows):
        component = smallest[root[i]] if sets[i] else doc
        out.append((doc, len(sets[i]), component, component == doc))
    return sorted(out, key=repr)


def made(df, **options):
    got = hyperminhash.near_duplicates(df, "doc_id", "text", **options)
    assert got.columns == ["id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def corpus(rng):
    """Chains of edits, a large group of near copies, a passage that many share, tiny texts."""
    word = lambda: f"w{rng.randrange(3000)}"
    rows, base = [], [word() for _ in range(60)]
    for _ in range(80):  # one word differs from the template: all are near each other, or nearly so
        copy = list(base)
        copy[rng.randrange(60)] = word()
        rows.append(" ".join(copy))
    walk = [word() for _ in range(50)]
    for _ in range(40):  # each near the one before, far from the first
        walk[rng.randrange(50)] = word()
        rows.append(" ".join(walk))
    passage = [word() for _ in range(45)]
    for _ in range(60):
        own = [word() for _ in range(rng.randrange(0, 40))]
        rows.append(" ".join(own + passage))
    for n in range(1, 12):
        words = [word() for _ in range(n)]
        rows += [" ".join(words), " ".join(words).upper(), " ".join(words[:-1]), " ".join([*words, word()])]
    rows += ["", "   ", rows[0], rows[0]]
    out = [(i, r) for i, r in enumerate(rows)] + [(900, None), (None, rows[3]), (None, "only here once in all of it")]
    rng.shuffle(out)
    return out


def test_against_brute_force(spark):
    rows = corpus(random.Random(11))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert made(df) == brute(rows)


def test_whole_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], " ".join((r["text"] or "").split())) for r in docs.collect()]
    ascii_rows = [(i, t) for i, t in rows if t.isascii()]
    df = spark.createDataFrame(ascii_rows, "doc_id bigint, text string")
    assert made(df) == brute(ascii_rows)


def test_every_band_length_finds_pairs_at_the_limit():
    """At a similarity of 0.8 some band agrees, for sets of any size."""
    rng = np.random.default_rng(4)
    for size in (4, 8, 20, 100, 1000):
        for _ in range(60):
            union = rng.integers(0, 1 << 64, size * 5 // 4, dtype=np.uint64)
            common, rest = union[:size], union[size:]
            half = len(rest) // 2
            a, b = (np.unique(np.r_[common, part]) for part in (rest[:half], rest[half:]))
            full = [hyperminhash.filled(hyperminhash.registers_of(x)) for x in (a, b)]
            keys = [hyperminhash.band_keys(f) for f in full]
            assert (keys[0] == keys[1]).any()


def test_registers_hold_zeros_and_mantissa():
    first = [int(x) for x in hyperminhash._BOUNDS[:5]]
    hashes = np.array([5, first[1] + (1 << 55), first[2] + (3 << 53), first[3], first[4] + (1 << 55) + 1], np.uint64)
    got = hyperminhash.registers_of(hashes).astype(int) - 1
    assert got[0] == 61 << 10 | 0b0100000000  # 101: the bits after the first one
    assert got[1] == got[4] == 8 << 10 and got[2] == (9 << 10 | 0b1000000000)
    assert got[3] == 63 << 10 and (got[5:] == -1).all()


def test_signatures_differ_where_registers_do(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(1, 1 << 16, hyperminhash.BUCKETS).astype(np.uint16)
    for n in (0, 40, 80, 120, 288):
        b = a.copy()
        b[:n] = rng.integers(1, 1 << 16, n)
        both = [hyperminhash.signature(x) for x in (a, b)]
        nibbles = [[v >> s & 15 for v in x.tolist() for s in range(0, 64, 4)] for x in both]
        differing = sum(x != y for x, y in zip(*nibbles))
        df = spark.createDataFrame([(both[0].tolist(), both[1].tolist())], "a array<bigint>, b array<bigint>")
        assert df.select(hyperminhash._alike("a", "b", 80)).first()[0] == (differing <= 88)
        assert n * 0.8 < differing <= n if n else differing == 0


def test_estimate_is_corrected_for_accidental_agreement():
    """With few mantissa bits unrelated sets agree in some registers; the correction takes them off."""
    rng = np.random.default_rng(9)
    disjoint, related = [], []
    for _ in range(1500):
        x = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
        a, b, c = np.unique(x[:1000]), np.unique(x[1000:2000]), np.unique(np.r_[x[:800], x[2000:2200]])
        ra, rb, rc = (hyperminhash.registers_of(s)[None] for s in (a, b, c))
        n = np.array([1000.0])
        disjoint.append(hyperminhash.estimate(ra, rb, n, n))
        related.append(hyperminhash.estimate(ra, rc, n, n))
    mean = lambda x: float(sum(a[0] for a, _ in x) / sum(u[0] for _, u in x))
    assert abs(mean(disjoint)) < 1e-4 and abs(mean(related) - 800 / 1200) < 5e-3


def test_awkward_rows_and_clashing_names(spark):
    docs = clashing(awkward(spark), ["id", "key", "n", "bands", "band", "cls", "label", "set", "digest", "least", "kept"])
    got = {r[0]: r for r in made(docs)}
    assert got[1] == (1, 8, 1, True) and got[2] == (2, 0, 2, True) and got[3] == (3, 0, 3, True)
    assert got[5][1] == 0 and got[None][2] is None and got[4][1] == 5
    assert hyperminhash.near_duplicates(docs, "doc_id", "text").count() == 8


def test_no_rows(spark):
    assert made(empty(spark)) == []


def test_a_hot_group_makes_no_pairs_inside(spark):
    """Near copies of one text meet their leader, not each other."""
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base[: i % 100], f"x{i}", *base[i % 100 + 1 :]])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen = []
    confirmed = hyperminhash._confirmed

    def counting(pairs, *rest):
        seen.append(pairs.count())
        return confirmed(pairs, *rest)

    hyperminhash._confirmed = counting
    try:
        got = hyperminhash.near_duplicates(df, "doc_id", "text")
        assert got.select(F.countDistinct("component_id")).first()[0] == 1
    finally:
        hyperminhash._confirmed = confirmed
    assert seen[0] < 40 * 300 and seen[1] == 0


def test_a_hot_group_of_many_components_makes_few_pairs(spark):
    """Half of the near copies link with none of the others; a few of them link with each other only."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]

    def edited(words, at):
        out = list(words)
        for i in at:
            out[i] = f"x{rng.randrange(10**9)}"
        return out

    texts = [edited(base, rng.sample(range(150), k)) for k in [1] * 150 + [5, 6, 7] * 50]
    texts += [edited(texts[-k], [rng.randrange(150)]) for k in range(1, 13)]  # linked with one far copy each
    rows = [(i, " ".join(t)) for i, t in enumerate(rng.sample(texts, len(texts)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen, edges = [], []
    confirmed, components = hyperminhash._confirmed, hyperminhash.components

    def counting(pairs, *rest):
        seen.append(pairs.count())
        return confirmed(pairs, *rest)

    def counting_edges(links, a, b):
        edges.append(links.count())
        return components(links, a, b)

    hyperminhash._confirmed, hyperminhash.components = counting, counting_edges
    try:
        assert made(df) == brute(rows)
    finally:
        hyperminhash._confirmed, hyperminhash.components = confirmed, components
    assert 0 < seen[1] < 2 * len(rows)
    assert len(edges) == 2 and edges[1] <= seen[1] < edges[0]  # links inside a component are not walked again
