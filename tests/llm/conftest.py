import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(k, n, seed=0):
    import numpy as np
    g = np.random.default_rng(seed + 7919 * k)
    return " ".join("".join(g.choice(list("abcdefghilmnorstu"), g.integers(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, copies, repeated rows, clashing column names."""
    from pyspark.sql import functions as F
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t", "en", "s", 3), (4, "x", "en", None, 1),
            (None, words(1, 60), "en", "s", 1), (5, words(1, 60), "en", "s", 1), (6, words(1, 60), None, "s", 1),
            (7, words(2, 9000), "fr", "s", 1), (8, words(3, 80) + "\n" + words(4, 40), "en", "s", 1),
            (8, words(3, 80) + "\n" + words(4, 40), "en", "s", 1), (9, "é" * 50 + " 漢字" * 70, "xx", "s", 1)]
    rows += [(20 + k, words(k, 30 + k), "en", "s", 1) for k in range(10, 20)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(0) for c in ("score", "length", "start", "fp", "node", "key", "r1", "sig", "h1", "part", "line")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def some_labels(spark):
    rows = [(k, int(k % 3 > 0), int(k % 4 == 0)) for k in range(1, 30)] + [(None, 1, 1), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
