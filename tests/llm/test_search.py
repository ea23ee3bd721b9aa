import math
import random
import re
from collections import Counter

from cohortlens.llm import search
from tests.llm.conftest import ODD_ROWS


def brute_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, top=20):
    docs = [(d, Counter(brute_terms(t)), len(brute_terms(t))) for d, t in rows]
    docs = [x for x in docs if x[2] > 0]
    n_docs, n_terms = len(docs), sum(x[2] for x in docs)
    df = Counter(term for _, tf, _ in docs for term in tf)
    out = []
    for item, text in items:
        asked = Counter(brute_terms(text))
        scored = []
        for d, tf, n in docs:
            m = 75 + (25 * n * n_docs) // n_terms
            s = sum(mult * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m))
                    for t, mult in asked.items() if t in tf)
            if s > 0:
                scored.append((s, d))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r + 1, d, s) for r, (s, d) in enumerate(scored[:top])]
    return sorted(out, key=repr)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_random_against_brute_force(spark, documents):
    rng = random.Random(5)
    vocab = [f"t{i}" for i in range(40)] + ["The", "the", "x2", "é"]
    rows = [(i, " ".join(rng.choice(vocab[: rng.randint(3, 44)]) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    rows += [(None, "t1 t1 t2"), (7, "t3 the"), (7, "t3 the")]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 6)))) for k in range(25)] + [(99, "!!"), (98, None)]
    assert got(search.ranked(documents(rows), items_of(spark, items))) == brute(rows, items)


def test_small_fanout_and_ties(spark, documents):
    rows = [(i, "same words here") for i in range(60)] + [(100 + i, f"w{i} same") for i in range(40)]
    items = [(1, "same"), (2, "words w3 w7"), (3, "here here")]
    index = search.build(documents(rows), fanout=2)
    assert index.height >= 6
    assert got(search.search(index, items_of(spark, items))) == brute(rows, items)


def test_odd_rows_long_text_and_empty(spark, documents, empty, odd):
    items = [(1, "a b"), (2, "word"), (3, "ä 漢字")]
    assert got(search.ranked(odd, items_of(spark, items))) == brute(ODD_ROWS, items)
    assert search.ranked(empty, items_of(spark, items)).count() == 0
    assert search.ranked(odd, items_of(spark, items).where("item_id < 0")).count() == 0


def test_postings_are_counted_in_the_scan_and_terms_as_in_sql(spark, documents, monkeypatch):
    plans, stage = {}, search._stage
    monkeypatch.setattr(search, "_stage", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), stage(df, name))[1])
    text = "A_b C9, é漢字 x y [z] Ünder-Score 10\t\n~a"
    post, n_docs, n_terms, _ = search.postings(documents([(1, text), (2, None), (3, "a a b"), (4, " !")]))
    assert "Aggregate" not in plans["search-postings"] and "hashpartitioning" not in plans["search-postings"]
    assert (n_docs, n_terms) == (2, len(brute_terms(text)) + 3)
    assert {(r.doc_id, r.term): r.tf for r in post.collect() if r.doc_id == 1} == {(1, t): c for t, c in Counter(brute_terms(text)).items()}
    assert 1 not in search.build(documents([(i, "same") for i in range(40)]), fanout=2).cells
