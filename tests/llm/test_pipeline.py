import random

import pytest

import corpus_pipeline
from cohortlens.llm import bpe, mixing, toxicity
from tests.llm.test_exact import brute as exact_brute
from tests.llm.test_simhash import brute_groups


@pytest.fixture(scope="module")
def folder(documents, spark, tmp_path_factory):
    rng = random.Random(8)

    def words(n):
        return [f"w{rng.randrange(500)}x" for _ in range(n)]

    texts = []
    for i in range(250):
        w = words(rng.randrange(20, 200))
        if i % 5 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["vileword", "nastyterm"]))
        texts.append(" ".join(w))
    texts += texts[20:60] + [texts[61]] * 30
    texts += [t + " end" for t in texts[70:90]] + [None, "", "  "]
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en" if i % 4 else "de", f"src{min(i % 5, 2)}") for i, t in enumerate(texts)]
    documents(rows, extra=False).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i < 250 and i % 5 == 0)) for i in range(200)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), {r[0]: r[1] for r in rows}


def test_stages_against_brute_force(spark, folder, tmp_path):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, path).write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen[name] = before, docs
        if k < 4:
            assert docs.columns == columns
            assert all(r.text == texts[r.doc_id] for r in docs.collect())

    def kept(name):
        before, after = seen[name]
        return before, sorted(r.doc_id for r in after.collect())

    before, ids = kept("toxicity")
    marked = {i for i, t in before if t and ("vileword" in t or "nastyterm" in t)}
    assert not marked & set(ids) and len(ids) >= 0.98 * (len(before) - len(marked))
    before, ids = kept("exact dedup")
    assert ids == sorted(r[0] for r in exact_brute(before) if r[3])
    before, ids = kept("simhash near-dedup")
    assert ids == sorted({r[2] for r in brute_groups(before)})
    before, ids = kept("mixing")
    words = {i: len((t or "").split()) for i, t in before}
    assert 0.7 < sum(words[i] for i in ids) / sum(words.values()) < 0.9
    before, after = seen["bpe"]
    encoder = bpe.public_ranks().encoder()
    assert {r.doc_id: r.ids for r in after.collect()} == {i: encoder.encode_ordinary(t or "") for i, t in before}


def test_run_is_the_stages_in_a_row(spark, folder):
    path, _ = folder
    got = corpus_pipeline.run(spark, path)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids"]
    assert 0 < got.count() < 250


def test_empty_table(spark, folder, tmp_path):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0
        if "text" not in docs.columns:
            break
