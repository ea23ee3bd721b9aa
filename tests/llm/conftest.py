import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """The folder that executors share; here one for this test run."""
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents table from (doc_id, text[, lang, source]) rows, with columns whose names
    clash with those the operators use inside."""

    def make(rows, extra=True, parts=3):
        full = [(*r, *("en", "src0")[len(r) - 2:], None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(parts)
        if extra:
            for name in ("digest", "n", "shard", "fp", "score", "block", "key", "kept", "weight"):
                df = df.selectExpr("*", f"concat('x', doc_id) AS {name}")
        return df

    return make


#: Nulls, empty and long texts, ties, repeated rows.
ODD_ROWS = [
    (1, "a b c"), (2, None), (3, ""), (4, "a b c"), (4, "a b c"), (None, "a b c"), (None, None),
    (5, " \t\n"), (6, "word " * 30_000), (7, "A b C"), (8, "ä ö ü 漢字 🙂"), (8, "other text of eight"),
]


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD_ROWS)


@pytest.fixture(scope="session")
def empty(documents, spark):
    return documents([(0, "x")]).where("doc_id < 0")
