import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from cohortlens.llm import bpe
from tests.llm.conftest import ODD_ROWS

WHITE = [
    "a  b", " a", "a ", "  ", "a\n b", "a \nb", "a\n\n  b", "\n a", "it's we'll I'M 'S", " 's", "x  y", "x  y", "　 a b",
    "a\x1c b", "a \x1cb", "a\x85 b", "a\t\tb c", "end.\nStart of  two", "12 345abc !?x <|endoftext|> y", "é ​ z", " \n ", "\r\n x", "tab\t x ",
]


@pytest.fixture(scope="module")
def ranks():
    return bpe.public_ranks()


def want(ranks, text):
    ids = ranks.encoder().encode_ordinary(text or "")
    sha = hashlib.sha256
    return len(ids), sha(np.array(ids, "<u4").tobytes()).hexdigest(), sha((text or "").encode()).hexdigest()


def check(ranks, df, rows):
    got = sorted((tuple(r) for r in bpe.round_trip(df, ranks).collect()), key=repr)
    assert got == sorted([(d, *want(ranks, t)) for d, t in rows], key=repr)


def test_odd_rows(ranks, odd):
    check(ranks, odd, ODD_ROWS)


def test_white_space_and_symbols(ranks, documents, monkeypatch):
    rng = random.Random(0)
    pieces = [*WHITE, "word", "der", "%%%", "é", "漢", "\n", " ", "  ", "'ll", "7"]
    rows = list(enumerate(WHITE)) + [(100 + i, "".join(rng.choice(pieces) + rng.choice(["", " ", "\n"]) for _ in range(30))) for i in range(150)]
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 2_000)  # several blocks
    check(ranks, documents(rows), rows)


def test_words_put_together_are_the_text():
    texts = [*WHITE, None, "", "plain words only", " lead"]
    flat, starts = bpe.words_of(pa.array(texts))
    flat = flat.to_pylist()
    assert ["".join(flat[a:b]) for a, b in zip(starts, starts[1:])] == [t or "" for t in texts]


def test_empty(ranks, empty):
    assert bpe.round_trip(empty, ranks).count() == 0


def test_columns_are_kept(ranks, odd):
    out = bpe.encode(odd, ranks)
    assert out.columns == [c for c in odd.columns if c != "text"] + ["n_tokens", "ids"]
    assert all(r.block == (None if r.doc_id is None else f"x{r.doc_id}") for r in out.collect())
    with pytest.raises(ValueError):
        bpe.encode(odd.withColumnRenamed("key", "ids"), ranks)


def test_decode_any_ids(ranks, spark):
    table = ranks.token_bytes()
    df = spark.createDataFrame([(1, [5, 100, 7]), (2, []), (3, None)], "doc_id bigint, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, ranks).collect()}
    assert {k: v if v is None else bytes(v) for k, v in got.items()} == {1: table[5] + table[100] + table[7], 2: b"", 3: None}


def test_equal_blocks_and_unstable_texts(ranks, spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 40)
    rows = [(i, "one two three four five six seven") for i in range(12)]  # every block alike
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    check(ranks, df, rows)
    from pyspark.sql import functions as F

    @F.udf("string")
    def other(text):
        return text + os.urandom(8).hex()

    shifting = df.withColumn("text", other.asNondeterministic()("text"))
    with pytest.raises(Exception, match="write them to a table first"):
        bpe.encode(shifting, ranks, keep=["doc_id"]).collect()


def test_equal_blocks_are_groups_of_their_own(ranks, spark):
    text = "one two three four " * 50_000
    df = spark.range(0, 80, 1, 2).selectExpr("CAST(null AS bigint) doc_id", "repeat('one two three four ', 50000) text")  # ids alike too
    positions, words = bpe.split_positions(df, "text", ["doc_id"]), bpe.split_words(df, "text", ["doc_id"])
    sizes = {r.block: r["count"] for r in positions.groupBy("block").count().collect()}
    assert sum(sizes.values()) == 80 and max(sizes.values()) * len(text) < 2 * bpe.BLOCK_BYTES + len(text)
    assert sizes.keys() == {r.block for r in words.select("block").distinct().collect()}
    assert [tuple(r) for r in bpe.round_trip(df, ranks).distinct().collect()] == [(None, *want(ranks, text))]


def test_a_block_is_cut_into_words_piece_by_piece(monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_BYTES", 20_000)
    texts = [f" word{i % 700} and\n  some more {i}" * 20 for i in range(3000)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    usual, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(pool)
    try:
        block = bpe._Block([batch], "text", (0, 0))
        most = pool.max_memory()
    finally:
        pa.set_memory_pool(usual)
    assert most < 2 * batch.nbytes  # several times its bytes before
    words = [w.decode() for w in block.words]
    said = ["".join(words[p] for p in block.places[a:b]) for a, b in zip(block.starts[:-1], block.starts[1:])]
    assert said == texts
