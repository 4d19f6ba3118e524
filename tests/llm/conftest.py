from __future__ import annotations

import duckdb
import pytest

SF = "/root/testdata/sf0.001"

#: Names that operators use inside, as extra columns of their input.
CLASHES = "_id long, _text string, _key string, _norm string, fp long, score double, row long, token string, n long, _gone_id long, _gone_sha string, address string, payload string, keep_id long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Null ids and texts, empty and repeated rows, a long text, and extra columns."""
    texts = [
        (1, "alpha beta gamma delta"), (2, "alpha  beta\tgamma delta"), (3, None), (4, ""), (None, "alpha beta gamma delta"), (None, None),
        (5, " \n\t "), (6, "one"), (7, "one two"), (7, "one two"), (8, "x" * 200_000), (9, "wörd İ ſ K 𝔘 " * 3000), (10, "password=hunter22"), (11, "a\x00b c"), (12, "one"),
    ]
    names = [c.split() for c in CLASHES.split(", ")]
    rows = [(i, t, "en", "s", *[None] * len(names)) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + CLASHES)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def documents():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()
