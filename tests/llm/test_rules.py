import random
import re
from collections import Counter

import numpy as np
import pytest

from cohortlens.llm import rules
from tests.llm.conftest import ODD_ROWS


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def base(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def prose(rng, n, letters="etaoinshr"):
    common = ["the", "of", "and", "to", "in"]
    return " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) + rng.choice(["", "", ".", ","]) for _ in range(n))


def test_base_counts(spark, documents):
    rng = random.Random(2)
    texts = [t for _, t in ODD_ROWS] + ["x y a\x1cb", "a b a b a b a", "same line\nsame line\n\n \n same line\nother\x0bx"]
    texts += [" ".join(rng.choice("abcd") for _ in range(n)) for n in (3, 30, 60, 90)] + [rng.choice(["%%", "l\n", " "]).join(["ab", "c#"] * 40) for _ in range(4)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in rules.judged(documents(rows)).collect()}
    for i, t in rows:
        assert base(got[i]) == brute(t), t
        assert not (got[i].kept and got[i].base_failed)


def test_odd_ids(odd):
    got = rules.judged(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in ODD_ROWS)
    assert len(got[0]) == len(rules.RESULT.split(","))


def test_empty(empty):
    assert rules.judged(empty).count() == 0


def test_verdicts(documents):
    rng = random.Random(4)
    clean = [(i, prose(rng, rng.randrange(50, 400)), rng.choice(["en", "de"])) for i in range(300)]
    digits = [(1000 + i, " ".join(str(rng.randrange(10**6)) for _ in range(150)), "en") for i in range(5)]
    shouted = [(2000 + i, prose(rng, 150).upper(), "de") for i in range(5)]
    strange = [(3000 + i, " ".join("".join(rng.choice("aeiou") for _ in range(7)) for _ in range(150)), "en") for i in range(5)]
    rare = [(4000, prose(rng, 200), "xx"), (4001, prose(rng, 200), None)]
    got = {r.doc_id: r for r in rules.judged(documents(clean + digits + shouted + strange + rare)).collect()}
    for i, t, *_ in clean + rare:
        assert got[i].kept == (not got[i].base_failed)
    assert not any(got[i].kept for i, *_ in digits + shouted + strange)
    short = [r for r in got.values() if r.n_words < rules.MIN_WORDS]
    assert short and all(r.word_divergence is None for r in short)


CYRILLIC, GREEK = "оеаинтсрвл", "αοιετσνηυρ"


def script(rng, n, letters):
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(40)]
    return lambda: " ".join(rng.choice(words) for _ in range(n))


@pytest.mark.parametrize("share", [0.001, 0.3])  # 0.3: all but en are small
def test_every_language_has_its_own_reference(documents, monkeypatch, share):
    monkeypatch.setattr(rules, "LANGUAGE_SHARE", share)
    rng = random.Random(5)
    rows = [(i, prose(rng, 200), "en") for i in range(200)]
    latin, cyrillic, greek = script(rng, 150, "etaoinshr"), script(rng, 150, CYRILLIC), script(rng, 60, GREEK)
    rows += [(1000 + i, latin(), "la") for i in range(40)] + [(2000 + i, cyrillic(), "cy") for i in range(12)]
    rows += [(3000 + i, greek(), "gr") for i in range(30)]  # short texts only
    rows += [(4000, script(rng, 120, GREEK)(), "few")]  # too few words for a reference
    odd = [(5000, " ".join(str(rng.randrange(10**6)) for _ in range(150)), "cy"), (5001, latin(), "gr"), (5002, cyrillic(), "la")]
    got = {r.doc_id: r for r in rules.judged(documents(rows + odd)).collect()}
    assert len(got) == len(rows + odd)
    for i, *_ in rows:
        assert got[i].kept == (not got[i].base_failed), i
    assert all(got[i].char_divergence < 0.1 for i, *_ in rows if i < 4000 and got[i].word_chars >= rules.MIN_CHARS)
    assert got[4000].char_divergence is None and got[4000].word_divergence is None
    assert all(got[i].char_divergence > rules.CHAR_LIMIT and not got[i].kept for i, *_ in odd)


def test_repeat_words_with_many_distinct():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 40, 2000)
    assert rules.repeat_words(codes, 40) == rules.repeat_words(codes, (1 << 20) + 1)


@pytest.mark.parametrize("p,q,want", [([1, 0], [0, 1], 1.0), ([2, 2], [1, 1], 0.0), ([1, 0], [1, 1], 0.311278)])
def test_divergence(p, q, want):
    assert abs(rules.divergence(np.array(p, float), np.array(q, float)) - want) < 1e-6
