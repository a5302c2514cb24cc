import datetime

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """documents-like frames from (doc_id, text) rows, with columns whose names clash with outputs."""

    def make(rows, **extra):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], DOCS)
        for name, value in extra.items():
            df = df.withColumn(name, F.lit(value))
        return df

    return make


@pytest.fixture(scope="session")
def today():
    return datetime.date(2024, 1, 1)


#: NULL, empty, blank, repeated and very long texts.
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (5, "word " * 20_000), (6, "x" * 50_000), (None, "no id here at all")]


@pytest.fixture(scope="session")
def odd():
    return ODD
