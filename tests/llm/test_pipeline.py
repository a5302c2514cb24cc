import math
import re
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest
import sentencepiece

from tests.llm.test_minhash_dedup import shingles
from tests.llm.test_native_operators import counts
from tickloom.llm import packing, quality_rules, queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    from tickloom.llm.common import materialize, table

    docs = table(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_stages_keep_the_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "minhash_dedup", "suffix_dedup", "packing"]


def stays(before, after):
    """The rows of a filtering stage: those that stay are as they were."""
    old, new = ({r.doc_id: r for r in s.collect()} for s in (before, after))
    assert all(old[k] == r for k, r in new.items()) and len(new) == after.count()
    return old, new.keys()


def test_documents_that_a_rule_rejects_go(spark, steps):
    rules = quality_rules.fit(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))

    def kept(text):
        n, chars, symbols, lines, repeats = counts(text)
        per = max(n, 1)
        f = {"symbols": symbols / per, "word_length": chars / per, "repeats": repeats / per, "dup_lines": lines / per, "words": float(n)}
        f |= {k: len(re.findall(p, text or "")) / per for k, p in (("stops", "[.?]"), ("bangs", "!"), ("bars", "[|]"), ("digits", "[0-9]"))}
        f["capitals"] = sum(c.isupper() for c in text or "") / per
        rejected = any(all((f[t.feature] >= t.value) == t.above for t in rule) for rule in rules)
        return n >= 50 and 100 * repeats <= 50 * n and not rejected

    old, new = stays(*steps[:2])
    assert new == {k for k, r in old.items() if kept(r.text)} and 0 < len(new) < len(old)


def test_documents_that_the_model_finds_toxic_go(spark, steps):
    """Every text scored on its own: its words and their beginnings looked up in the model, one document at a time."""
    model = toxicity.fit(steps[1], toxicity.flagged(spark.read.parquet(f"{SF}/labels.parquet")))
    weight = dict(zip(model.keys.tolist(), model.weights, strict=True))

    def toxic(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        found = Counter(toxicity.features(data, np.array([0, len(data)]))[0].tolist())
        score = sum(weight[k] * math.log1p(n) for k, n in found.items() if k in weight)
        return len(model.thresholds) > 0 and 1 / (1 + math.exp(min(max(model.thresholds[0] - score, -40), 40))) >= toxicity.TOXIC_FROM

    old, new = stays(*steps[1:3])
    assert new == {k for k, r in old.items() if not toxic(r.text)}


def test_one_of_each_group_stays(steps):
    before, after = ({r.doc_id: shingles(r.text, 5) for r in s.collect()} for s in steps[2:4])
    parent = {k: k for k in before}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in before:
        for b in before:
            if a < b and before[a] and 100 * len(before[a] & before[b]) >= 80 * len(before[a] | before[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert sorted(after) == sorted(k for k in before if find(k) == k)


def test_passages_are_cut_and_nothing_else(steps):
    before, after = ({r.doc_id: r for r in s.collect()} for s in steps[3:5])
    assert before.keys() == after.keys()
    seen = set()
    for k in sorted(before):
        data = before[k].text.encode()
        gone = [False] * len(data)
        for s in range(len(data) - 99):
            x = data[s : s + 100]
            if x in seen:
                gone[s : s + 100] = [True] * 100
            seen.add(x)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        assert after[k].text == kept.decode("utf-8", "ignore") and after[k].n_chars == len(after[k].text)


def test_packing_loses_no_token(steps):
    """Tokens counted by the library; every part in the smallest bucket that holds it, every batch but a bucket's last full."""
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.TOKENIZER)
    texts, parts = {r.doc_id: r.text for r in steps[4].collect()}, steps[5].collect()
    sums, batches = Counter(), {}
    bounds = sorted({r.bucket for r in parts if r.bucket})
    for r in parts:
        sums[r.doc_id] += r.part_tokens
        if r.part_tokens:
            assert r.bucket == min(b for b in bounds if b >= r.part_tokens)
            batches.setdefault((r.bucket, r.batch), []).append(r.slot)
    assert dict(sums) == {k: len(library.encode(t or "")) for k, t in texts.items()} and len(bounds) <= packing.BUCKETS
    for (bucket, batch), slots in batches.items():
        room = packing.BUDGET // bucket
        assert sorted(slots) == list(range(room if (bucket, batch + 1) in batches else len(slots))) and len(slots) <= room


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, result = queries.queries()[name](spark, SF), con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    value = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    expected = sorted(tuple(value(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(value(r[c]) for c in sorted(columns)) for r in df.collect()) == expected


def test_run_is_the_stages_in_turn(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == steps[-1].columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, steps[-1].collect()), key=str)
