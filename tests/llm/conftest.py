import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
# Python workers import the package by name, wherever the tests were started
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH")) if p)

SMALL = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, fp long, h string"


@pytest.fixture(scope="session")
def spark():
    from peakloom.session import build_session

    session = build_session("local[8]", "peakloom-tests", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns with names used inside."""
    long = " ".join(f"word{i % 977} again" for i in range(60_000))
    rows = [
        (1, "alpha beta gamma delta"), (2, "Alpha  beta\tgamma delta"), (3, None), (4, ""), (4, ""), (None, "alpha beta gamma delta"), (None, None),
        (7, long), (8, long), (8, long), (9, " \n \n"), (10, "é" * 5000), (11, "line one is long\nline two is long\nline one is long"), (12, "Line One is Long \nx"),
        (13, "\x00\x01"), (14, "<|endoftext|> a"), (15, "x" * 199), (16, "x" * 200), (17, "y" * 201),
    ]
    data = [(i, t, None if k % 2 else "en", None if k % 3 else "s", None, None, None, None) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
