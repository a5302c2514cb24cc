"""Analyzers: named functions that turn a table of documents into rows, for DataFrames and for SQL.

An analyzer is a Python table function. It sees the documents of one partition in order, streamed, and may keep a little state
between them; what it yields are rows. ``analyze`` runs one on a DataFrame, ``register`` makes all of them known to SQL:

    SELECT * FROM factor_mentions(TABLE(docs) PARTITION BY topic ORDER BY id)

A partition is one task, so partition by a column with many values, or by a salt where order between documents doesn't matter.
What built-in functions can express belongs there instead; these are for rules that walk documents in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf

from tickloom.operators.feeds import FACTOR_IDS


@udtf(returnType="topic string, id bigint, keyword string, factor string, nth int")
class FactorMentions:
    """Documents (topic, id, text): a row for each keyword that a text contains, with its factor and how many documents of the
    partition have mentioned the factor so far, this one included. A NULL text mentions nothing."""

    keywords = FACTOR_IDS

    def __init__(self):
        self.seen: dict[str, int] = {}

    def eval(self, row: Row):
        text, counted = row["text"] or "", set()
        for keyword, factor in self.keywords.items():
            if keyword in text:
                if factor not in counted:
                    counted.add(factor)
                    self.seen[factor] = self.seen.get(factor, 0) + 1
                yield row["topic"], row["id"], keyword, factor, self.seen[factor]


@udtf(returnType="topic string, sentiment string, first_id bigint, last_id bigint, length int")
class SentimentRuns:
    """Documents (topic, id, sentiment): each run of documents with one sentiment, by first and last id; NULL is a sentiment."""

    def __init__(self):
        self.run = None

    def eval(self, row: Row):
        if self.run and self.run[1] == row["sentiment"]:
            self.run[3], self.run[4] = row["id"], self.run[4] + 1
            return
        if self.run:
            yield tuple(self.run)
        self.run = [row["topic"], row["sentiment"], row["id"], row["id"], 1]

    def terminate(self):
        if self.run:
            yield tuple(self.run)


ANALYZERS = {"factor_mentions": FactorMentions, "sentiment_runs": SentimentRuns}


def register(spark: SparkSession) -> list[str]:
    """Make all analyzers known to SQL by name."""
    for name, function in ANALYZERS.items():
        spark.udtf.register(name, function)
    return sorted(ANALYZERS)


def analyze(docs: DataFrame, name: str, partition_by: str = "topic", order_by: str = "id") -> DataFrame:
    """What the named analyzer yields for the documents of each partition, in order."""
    if name not in ANALYZERS:
        raise ValueError(f"no analyzer {name}; there are {', '.join(sorted(ANALYZERS))}")
    return ANALYZERS[name](docs.asTable().partitionBy(partition_by).orderBy(order_by))
