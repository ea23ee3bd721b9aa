import hashlib
import random
import re

from cohortlens.llm import decontam
from tests.llm.conftest import ODD_ROWS


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, window=10):
    wins = {}
    for item, text in items:
        w = brute_words(text)
        size = min(len(w), window)
        for i in range(len(w) - size + 1 if w else 0):
            wins.setdefault(tuple(w[i:i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in rows:
        w = brute_words(text)
        hit, found = set(), set()
        for win, owners in wins.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found |= owners
        joined = ",".join(sorted(found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def got(report):
    return sorted((tuple(r) for r in report.collect()), key=repr)


def test_odd_rows(spark, odd):
    items = [(1, "A B C"), (2, None), (3, ""), (None, "word word"), (4, "ä ö"), (5, "other text of eight")]
    assert got(decontam.report(odd, bench(spark, items))) == brute(ODD_ROWS, items)


def test_random_against_brute_force(spark, documents):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(12)] + ["Ab", "x-y", "é"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 10, 14, 25])))) for i in range(12)]
    rows = []
    for d in range(80):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if d % 4 == 0:
            item = rng.choice(items)[1].split()
            at = rng.randint(0, len(words))
            words[at:at] = item[rng.randint(0, 2):]
        rows.append((d, ", ".join(words).upper() if d % 7 == 0 else " ".join(words)))
    rows += rows[:5]
    assert got(decontam.report(documents(rows), bench(spark, items))) == brute(rows, items)


def test_long_text_and_window_edges(spark, documents):
    item = " ".join(f"t{i}" for i in range(30))
    long_text = "pad " * 40_000 + item + " pad" * 40_000
    rows = [(1, long_text), (2, " ".join(f"t{i}" for i in range(9, 19))), (3, " ".join(f"t{i}" for i in range(9)))]
    want = brute(rows, [(7, item)])
    assert got(decontam.report(documents(rows), bench(spark, [(7, item)]))) == want
    assert [r[2] for r in want] == [30, 10, 0]


def test_empty_tables(spark, empty, odd):
    assert decontam.report(empty, bench(spark, [(1, "a b c")])).count() == 0
    none = bench(spark, [(1, "x")]).where("item_id < 0")
    rows = decontam.report(odd, none).collect()
    assert len(rows) == len(ODD_ROWS) and not any(r.contaminated for r in rows)


def test_remove_documents_keeps_clean_rows(spark, documents):
    rows = [(1, "q r s t"), (2, "clean text"), (3, None), (4, "a Q R S T b")]
    docs = documents(rows)
    kept = decontam.remove_documents(docs, bench(spark, [(9, "q r s t")]))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]
