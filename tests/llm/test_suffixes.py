import random
from collections import defaultdict

import numpy as np
import pytest

from cohortlens.llm import suffixes
from tests.llm.conftest import ODD_ROWS


def brute(rows, size=50):
    """All runs of ``size`` words found in two documents, merged; documents are (id, text)."""
    rows = sorted(set(rows), key=repr)
    who = defaultdict(set)
    for r in rows:
        words = (r[1] or "").split()
        for i in range(len(words) - size + 1):
            who[tuple(words[i:i + size])].add(r)
    out = []
    for r in rows:
        words = (r[1] or "").split()
        hits = [i for i in range(len(words) - size + 1) if len(who[tuple(words[i:i + size])]) > 1]
        while hits:
            start = last = hits.pop(0)
            ids = [d for d, _ in who[tuple(words[start:start + size])]]
            while hits and hits[0] <= last + size:
                last = hits.pop(0)
                ids += [d for d, _ in who[tuple(words[last:last + size])]]
            first = min((d for d in ids if d is not None), default=None)
            out.append((r[0], start, last + size, last + size - start, first, first == r[0]))
    return sorted(out, key=repr)


def got(df, **kw):
    return sorted((tuple(r) for r in suffixes.repeated_passages(df, **kw).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)

    def words(n):
        return [f"v{rng.randrange(300)}" for _ in range(n)]

    passages = [words(n) for n in (49, 50, 51, 57, 60, 80, 200)]
    out = []
    for i in range(60):
        text = words(rng.randrange(0, 90))
        for p in rng.sample(passages, rng.choice([0, 1, 2])):
            cut = rng.choice([0, 0, 3, 10])
            text += p[cut:] + words(rng.randrange(0, 60))
        out.append((i, " ".join(text)))
    base = words(150)
    for i in range(60, 75):  # near copies with changes close to each other
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(150)] = "changed"
        out.append((i, " ".join(copy)))
    return out


def test_against_brute_force(documents, rows):
    want = brute(rows)
    assert len(want) > 20
    assert got(documents(rows)) == want


def test_large_classes_give_the_same(documents, rows, monkeypatch):
    monkeypatch.setattr(suffixes, "CLASS_ROWS", 3)
    assert got(documents(rows)) == brute(rows)


def test_odd_rows(odd, documents):
    assert got(odd) == brute(ODD_ROWS) == []
    text = " ".join(f"u{i}" for i in range(70))
    rows = [(1, text), (1, text), (None, text + " end"), (3, " ".join(["same"] * 200)), (4, " ".join(["same"] * 90)), (5, None)]
    assert got(documents(rows)) == brute(rows)
    alone = [(1, text), (1, text), (2, "x " + " ".join(["same"] * 200))]  # one document only
    assert got(documents(alone)) == []


def test_empty(empty):
    assert got(empty) == []


def test_rolling_and_minimisers():
    words = np.array([3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 1, 4, 1, 5, 9], np.uint64)
    for size in range(1, 8):
        values = suffixes.rolling(words, size)
        runs = [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]
        assert len(values) == len(runs)
        assert all((runs[i] == runs[j]) == (values[i] == values[j]) for i in range(len(runs)) for j in range(i))
    x = np.array([5, 2, 7, 2, 9, 1, 1, 8, 3, 4], np.uint64)
    for w in range(1, 8):
        want = {min(range(i, i + w), key=lambda p: (x[p], p)) for i in range(len(x) - w + 1)}
        assert set(suffixes.minimisers(x, w).tolist()) == want


def test_copies_in_a_large_class_are_one_kind(spark, documents, monkeypatch):
    made, staged = {}, suffixes.staged

    def counted(df, name, *by):
        out = staged(df, name, *by)
        made[name] = out.count()
        return out

    monkeypatch.setattr(suffixes, "staged", counted)
    monkeypatch.setattr(suffixes, "CLASS_ROWS", 10)
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(words)) for i in range(40)] + [(100 + i, " ".join([f"x{i}", *words[:60], f"y{i}"])) for i in range(3)]
    out = {r.doc_id: (r.start_word, r.end_word, r.first_id) for r in suffixes.repeated_passages(documents(rows)).collect()}
    assert out == {**{i: (0, 80, 0) for i in range(40)}, **{100 + i: (1, 61, 0) for i in range(3)}}
    assert made["passages"] == 0  # a row for each of 25 passages of each copy before
    assert 0 < made["kinds"] < made["contexts"] / 5


def test_a_start_repeated_in_a_text_is_few_rows(spark, documents, monkeypatch):
    made, staged = {}, suffixes.staged

    def counted(df, name, *by):
        out = staged(df, name, *by)
        made[name] = out.count()
        return out

    monkeypatch.setattr(suffixes, "staged", counted)
    monkeypatch.setattr(suffixes, "CLASS_ROWS", 50)
    line = "one line that is said again and again".split()
    rows = [(i, " ".join(["same"] * 600 + [f"x{i}"] + line * 40 + [f"y{i}"] + ["same"] * 60)) for i in range(4)] + [(9, " ".join(["same"] * 300)), (None, " ".join(line * 10))]
    assert got(documents(rows)) == brute(rows)
    assert made["contexts"] < made["suffixes"] / 4  # a row for each place before
