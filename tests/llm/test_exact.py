import hashlib
from collections import defaultdict

from cohortlens.llm import exact
from tests.llm.conftest import ODD_ROWS


def brute(rows):
    by = defaultdict(list)
    for doc, text in rows:
        by[text or ""].append(doc)
    out = []
    for text, docs in by.items():
        known = [d for d in docs if d is not None]
        keep, first = max(known) if known else None, True
        for d in docs:
            kept = first and d == keep
            first = first and not kept
            out.append((d, keep, len(docs), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_report_against_brute_force(odd):
    got = sorted((tuple(r) for r in exact.duplicate_report(odd).collect()), key=repr)
    assert got == brute(ODD_ROWS)


def test_kept_rows_have_all_columns(odd):
    rows = exact.deduplicate(odd)
    assert rows.columns == odd.columns
    got = sorted(((r.doc_id, r.text) for r in rows.collect()), key=repr)
    want = sorted(((4, "a b c"), (3, ""), *[r for r in ODD_ROWS if r[0] in (5, 6, 7, 8)]), key=repr)
    assert got == want
    assert all(r.digest == f"x{r.doc_id}" for r in rows.collect())


def test_empty_table(empty):
    assert exact.duplicate_report(empty).count() == 0
    assert exact.deduplicate(empty).columns == empty.columns


def test_index_goes_on(spark, documents, tmp_path):
    path = str(tmp_path / "index")
    index = exact.DigestIndex(spark, "first_index", path, buckets=4)
    exact.duplicate_report(documents([(1, "old"), (2, "old"), (3, "other")]), index).collect()
    spark.sql("DROP TABLE first_index")  # external: the files stay
    index = exact.DigestIndex(spark, "second_index", path, buckets=4)
    report = exact.duplicate_report(documents([(9, "old"), (8, "new")]), index)
    assert {r.doc_id: (r.keep_id, r.kept) for r in report.collect()} == {9: (2, False), 8: (8, True)}
    assert index.read().count() == 3
    spark.sql("DROP TABLE second_index")


def test_hot_group(spark, documents):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(3000)]
    got = sorted((tuple(r) for r in exact.duplicate_report(documents(rows)).collect()), key=repr)
    assert got == brute(rows)
