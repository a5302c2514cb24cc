"""A training-corpus pipeline of five operators: STAGES in order, each over all that the one before kept.

A stage is (name, function); the function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of ``documents``. The order goes from cheap row filters to the jobs that compare documents with each other:

1. quality rules: documents that fail the base rule or that the learned list rejects go.
2. toxicity: documents that the model finds toxic, with a probability of 0.5 or more, go.
3. MinHash near-dedup: one document of each group stays.
4. suffix-array dedup: passages of 100 bytes and more that an earlier document has are cut out; every document stays, with
   n_chars of the new text.
5. packing: token counts, optimal length buckets and batches.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import minhash_dedup, packing, quality_rules, suffix_dedup, toxicity
from tickloom.llm.common import materialize, spread, table

#: The model that counts tokens for packing.
TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).where("kept").select(docs.columns)


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, toxicity.flagged(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).where("not toxic").select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.deduplicate(docs, words=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.counted(docs, TOKENIZER))


STAGES = [
    ("quality_rules", keep_quality),
    ("toxicity", keep_harmless),
    ("minhash_dedup", keep_one_of_each),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_tokens),
]

#: The learned stages and the tokenizer have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over ``documents``, each written to the shared folder and read again."""
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
