import base64
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from agroseries.llm import bpe, packing
from tests.llm.helpers import awkward, clashing, empty, rows_of

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
STRANGE = [
    "ÅngstrÖm İ <|endoftext|> <|ENDOFTEXT|>",
    "ΣΣ x y \x1f a\x1fb   K  \n\n  \t x",
    "it's IT'S we'll don't 'S  12345 ٣٤",
    "a" * 5000 + " " * 300 + "é" * 700,
]


def documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(STRANGE)], "doc_id bigint, text string")
    return docs.unionByName(more).repartition(3)


def test_pieces_hold_the_tokenizer_ids_once(spark):
    docs = documents(spark)
    tokenizer = Tokenizer.from_file(WORDS)
    want = {
        r["doc_id"]: np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4") for r in docs.collect()
    }
    pieces = packing.pack(docs, "doc_id", "text", WORDS, window=512).collect()
    seen = {i: np.zeros(len(ids), int) for i, ids in want.items()}
    ends = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        part = want[p["id"]][p["start"] : p["start"] + p["length"]]
        assert part.tobytes() == bytes(p["ids"]) and p["doc_tokens"] == len(want[p["id"]])
        seen[p["id"]][p["start"] : p["start"] + p["length"]] += 1
        assert p["offset"] == ends.get(p["sequence_id"], 0)
        ends[p["sequence_id"]] = p["offset"] + p["length"]
    assert all((n == 1).all() for n in seen.values())
    *full, last = [ends[s] for s in range(len(ends))]
    assert set(full) == {512} and 0 < last <= 512
    rows = packing.sequences(packing.pack(docs, "doc_id", "text", WORDS, window=512), 512).collect()
    assert all(len(r["ids"]) == 4 * 512 for r in rows) and sum(r["tokens"] for r in rows) == sum(map(len, want.values()))


def test_word_stores_may_change_generation_at_any_time(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 2)
    encoder = packing.WordEncoder(open(WORDS).read())
    texts = [b"the cat the dog", b"The cat saw the dog", b"", b"dog cat bird the"]
    want = [np.array(encoder.tokenizer.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for _ in range(3):
        assert encoder.encode(texts) == want
        assert encoder.encode(texts[:1]) == want[:1]
        assert len(encoder.young) <= 2 + 6


def test_words_of_every_kind_have_the_ids_of_the_whole_tokenizer(monkeypatch):
    """Plain letters, joined words, words that go alone; also with few words to a joined text."""
    monkeypatch.setattr(packing, "JOINT", 3)
    texts = [
        "Naïve ÉCOLE œuvre ŉ ǅ ß İstanbul Σίσυφος ΟΔΟΣ 中文 かな 한글",
        "<|endoftext|> a<|b <|startoftext|>the x\x01y \x01 \x01\x01 \ufffd don't we'll I'M o'Sé",
        "\x1cq r\x1d \u0301abc e\u0301t ﬁ ½ 3a4 a_b -- a-b... 😀x 😀 a\u00a0b ª º ʼn \u212b",
    ] * 2
    encoder = packing.WordEncoder(open(WORDS).read())
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode([t.encode() for t in texts]) == want
    other = json.loads(open(WORDS).read())
    other["pre_tokenizer"]["pretokenizers"][0]["behavior"] = "Isolated"
    with pytest.raises(ValueError, match="cannot be told apart"):
        packing.WordEncoder(json.dumps(other))


def test_packing_awkward_rows(spark):
    df = clashing(awkward(spark), ["id", "part", "first", "tokens", "ids", "sequence_id", "offset"])
    pieces = packing.pack(df, "doc_id", "text", WORDS).collect()
    by_id = {}
    for p in pieces:
        by_id.setdefault(p["id"], []).append(p)
    assert by_id[2][0]["doc_tokens"] == by_id[3][0]["doc_tokens"] == by_id[5][0]["doc_tokens"] == 1
    assert len(by_id[1]) >= 2 and None in by_id and len(by_id[4]) >= 3
    assert zlib.crc32(bytes(by_id[2][0]["ids"])) == zlib.crc32(b"\2\0\0\0")
    assert packing.pack(empty(spark), "doc_id", "text", WORDS).count() == 0


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merges_like_the_library():
    ranks, own, rng = bpe.read_ranks(RANKS), encoding(), random.Random(4)
    words = ["".join(rng.choice("abcdeéß😀 1!") for _ in range(rng.randrange(1, 40))) for _ in range(400)] + ["ab" * 3000, "a" * 999]
    for word in words:
        pieces = bpe.regex.findall(public_tokenizers.PATTERN, word)
        ids = [i for p in pieces for i in bpe.merge_word(p.encode(), ranks)]
        assert ids == own.encode_ordinary(word)


def test_encode_and_decode_documents(spark):
    docs, own = documents(spark), encoding()
    coded = bpe.encode(docs, "doc_id", "text", RANKS, public_tokenizers.PATTERN, buckets=5)
    coded = coded.withColumn("back", bpe.decode(spark, F.col("tokens"), RANKS))
    got = {r["id"]: r for r in coded.collect()}
    for row in docs.collect():
        assert got[row["doc_id"]]["tokens"] == own.encode_ordinary(row["text"])
        assert bytes(got[row["doc_id"]]["back"]).decode() == row["text"]


def test_encode_with_many_blocks_in_a_partition(spark):
    """A block ends inside a partition, by words or by distinct words; the ids stay the same."""
    docs, own = documents(spark).coalesce(1), encoding()
    want = {r["doc_id"]: own.encode_ordinary(r["text"]) for r in docs.collect()}
    for limits in ({"most_words": 40}, {"most_distinct": 7}):
        coded = bpe.encode(docs, "doc_id", "text", RANKS, public_tokenizers.PATTERN, 3, **limits)
        assert {r["id"]: r["tokens"] for r in coded.collect()} == want


def test_bpe_awkward_rows(spark):
    df = clashing(awkward(spark), ["id", "block", "bucket", "data", "tokens"])
    coded = bpe.encode(df, "doc_id", "text", RANKS, public_tokenizers.PATTERN)
    back = coded.select("id", F.coalesce(bpe.decode(spark, F.col("tokens"), RANKS).cast("string"), F.lit("")).alias("text"))
    want = df.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    assert rows_of(back, "id", "text") == rows_of(want, "id", "text")
    assert bpe.encode(empty(spark), "doc_id", "text", RANKS, public_tokenizers.PATTERN).count() == 0
