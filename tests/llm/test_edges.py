"""Every training-data query on empty tables, and on tables with NULLs in every column and repeated rows."""

import pytest

import corpus_pipeline
from tickloom.llm import queries

TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn int, role string, text string",
}
TEXT = "a text of some words that is longer than a hundred bytes, so that its copies share a passage, and it goes on for a while here. "
ROWS = {
    "documents": [(None, None, None, None, None), (1, None, None, None, None), (None, TEXT, None, None, None), (2, "", "en", "s", 0), (3, TEXT, "en", "s", None), (3, TEXT, "en", "s", None), (4, TEXT * 2, None, "s", 9), (5, " \n ", "en", None, 3)],
    "labels": [(None, None, None), (3, None, 1), (4, 1, None), (None, 0, 0), (3, 1, 0), (4, 0, 1)],
    "pages": [(None, None, None), (1, None, None), (2, "no host", None), (None, "http://a.example.com/en/7", None), (3, "HTTP://A.org", ""), (3, "HTTP://A.org", "")],
    "benchmark": [(None, None), (1, TEXT), (1, TEXT), (2, "")],
    "embeddings": [(None, None, None), (0, [1.0, None], 1), (50, [1.0, 2.0], 1), (50, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 1.0], 2), (None, [1.0, 1.0], 3), (3, None, 1), (4, [1.0], None)],
    "conversations": [(None, None, None, None), (1, None, None, None), (1, 1, "user", None), (1, 2, "assistant", "x"), (1, 2, "assistant", "x"), (None, 1, None, "y")],
}
QUERIES = queries.queries() | {"pipeline": corpus_pipeline.run}


def folder(spark, path, rows):
    for name, schema in TABLES.items():
        spark.createDataFrame(rows.get(name, []), schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("empty"), {})


@pytest.fixture(scope="module")
def nulls(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("nulls"), ROWS)


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, empty, name):
    # op6 has its own conversation
    assert QUERIES[name](spark, empty).count() == (name == "op6_chat_format")


@pytest.mark.parametrize("name", QUERIES)
def test_nulls_and_repeats(spark, nulls, name):
    got = QUERIES[name](spark, nulls).collect()
    if name == "op3_url_filters":
        assert len(got) == len(ROWS["pages"]) and all(r.verdict in ("allow", "block") for r in got)
    elif name == "op6_chat_format":
        assert {r.conv_id: r.n_turns for r in got} == {None: 2, 1: 4, -1: 2}
    elif name == "op11_hard_negatives":
        # each copy of anchor 50 has the other one and row 1 as positives
        assert sorted((r.anchor_id, r.positive_id, r.rank, str(r.negative_id)) for r in got) == sorted([(50, 1, 1, "2"), (50, 1, 2, "None"), (50, 50, 1, "2"), (50, 50, 2, "None")] * 2)
    elif name == "pipeline":
        assert not got
    else:
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS["documents"])


def test_few_partitions_are_dealt_to_all_cores(spark, tmp_path):
    """One file with one row group is read in one task; spread deals its rows anew, and leaves wide tables and all rows as they are."""
    from tickloom.llm.common import spread

    spark.range(5000).coalesce(1).write.parquet(f"{tmp_path}/one")
    one, cores = spark.read.parquet(f"{tmp_path}/one"), spark.sparkContext.defaultParallelism
    dealt = spread(one)
    sizes = [len(p) for p in dealt.rdd.glom().collect()]
    assert len(sizes) == cores and min(sizes) > 0 and sorted(r.id for r in dealt.collect()) == list(range(5000))
    wide = spark.range(0, 5000, 1, cores + 1)
    assert spread(wide) is wide and spread(one.limit(0)).count() == 0
