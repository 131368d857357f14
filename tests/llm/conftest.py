import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from linklens.session import build_session

    return build_session("local[4]", 4, app="linklens-tests")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank and repeated rows, a long text, and columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(20000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two three"), (4, "one two three"), (None, "no id here at all"),
            (5, long), (6, long), (7, long + " end"), (8, "Ünï \U0001F600 token = 'abcdef123' x\nAKIA" + "A1" * 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    extra = {c: f"'{c}'" for c in ("kept", "k_id", "k_text", "spans", "ids", "at", "key", "node", "lines", "id", "h")}
    return docs.selectExpr("*", "'en' AS lang", *[f"{v} AS {k}" for k, v in extra.items()])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
