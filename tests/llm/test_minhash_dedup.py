import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tickloom.llm import minhash_dedup as op
from tickloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text, words):
    w = WORD.findall((text or "").translate(FOLD))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1)))


def brute(rows, words, percent):
    sets = [shingles(t, words) if k is not None else frozenset() for k, t in rows]
    parent = {k: k for k, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                parent[y] = x
    return sorted((k or -1, len(shingles(t, words)), find(k) if k is not None else None) for k, t in rows)


def near_copies(seed, groups, size):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefg") for _ in range(4)) for _ in range(400)]
    rows = []
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([6, 30, 80]))]
        for _ in range(rnd.randint(1, size)):
            text = [rnd.choice(vocabulary) if rnd.random() < 0.03 else w for w in base]
            rows.append(" ".join(text).upper() if rnd.random() < 0.3 else "  ".join(text))
    rnd.shuffle(rows)
    return list(enumerate(rows))


def check(frame, rows, words=4, percent=80):
    got = op.near_duplicates(frame(rows), words, percent).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id or -1, r.n_shingles, r.component_id) for r in got) == brute(rows, words, percent)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_matches_all_pairs(frame):
    check(frame, near_copies(1, 40, 6))


def test_one_large_group_of_near_copies(frame):
    check(frame, near_copies(2, 3, 60))


def test_edge_cases(frame, odd):
    check(frame, odd)


def test_empty_table_and_clashing_columns(frame):
    assert op.near_duplicates(frame([])).count() == 0
    rows = frame([(1, "a b c d e"), (2, "A b c d e"), (3, "other")], component_id="x", kept="y", sig="z")
    kept = op.deduplicate(rows)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_signature_distance_is_guaranteed():
    import numpy as np

    rnd = np.random.default_rng(3)
    a = rnd.integers(0, 2**16, (300, op.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rnd.choice(op.SYMBOLS, op.DISTANCE, replace=False)] ^= 1
    shared = (op.chunk_keys(a) == op.chunk_keys(b)).any(1)
    assert shared.all()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {k: 100 for k in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_buckets_are_split(frame):
    """With buckets of two classes split already, nearly all cross pairs come by rare shingles."""
    for seed in (4, 5):
        rows = near_copies(seed, 30, 6)
        got = op.near_duplicates(frame(rows), 4, 80, hot=1).collect()
        assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got) == brute(rows, 4, 80)


def boilerplate(n, own):
    """Texts of one template with words of their own: alike at about 0.6, so their buckets are large and hold no links."""
    template = " ".join(f"t{i}" for i in range(120))
    return [(k, template + " " + " ".join(f"w{k}x{i}" for i in range(own))) for k in range(n)]


def test_texts_that_share_boilerplate_are_not_compared_in_pairs(spark, frame):
    rows = boilerplate(600, 60) + [(1000 + k, t + " more words at the end") for k, t in boilerplate(20, 60)]
    got = op.near_duplicates(frame(rows), 4, 80).collect()
    component = {r.doc_id: r.component_id for r in got}
    assert all(component[1000 + k] == k for k in range(20)) and all(component[k] == k for k in range(600))
    sets = op.full_sets(frame(rows), spark.range(2000), 4)
    classes = spark.createDataFrame([(k, k) for k, _ in rows], "id long, component long")
    pairs = op.rare_pairs(classes, sets, op.bit_maps(sets), 80)
    assert pairs.count() == 20  # of 192,510


def test_bit_maps_never_refuse_a_link(spark):
    import numpy as np

    rnd = np.random.default_rng(5)
    rows = []
    for k in range(200):
        n = int(rnd.choice([1, 5, 40, 300, 5000]))
        pool = rnd.integers(-(2**63), 2**63 - 1, n)
        for side in range(2):
            keep = rnd.random(n) < rnd.choice([0.85, 0.93, 1.0])
            rows.append((2 * k + side, sorted(set(pool[keep].tolist()) or {int(pool[0])})))
    sets = {k: set(v) for k, v in rows}
    maps = op.bit_maps(spark.createDataFrame(rows, "id long, shingles array<long>"))
    x, y = maps.alias("x"), maps.alias("y")
    passed = {r.id for r in x.join(y, F.expr("x.id % 2 = 0 and y.id = x.id + 1 and " + op._may_link(80))).select("x.id").collect()}
    links = {k for k in range(0, 400, 2) if 100 * len(sets[k] & sets[k + 1]) >= 80 * len(sets[k] | sets[k + 1])}
    assert len(links) > 50 and links <= passed


def test_one_row_of_a_repeated_id_stays(frame):
    rows = frame([(1, "a b c d e"), (1, "a b c d e"), (1, None), (2, "x y z"), (None, "q"), (None, "q")], gone="g", many="m", place="p")
    got = op.deduplicate(rows)
    assert got.columns == rows.columns and sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "None", "None"]


def test_lower_similarities_are_refused(frame):
    with pytest.raises(ValueError, match="80"):
        op.near_duplicates(frame([]), 4, 70)


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    rows = duckdb.sql(op.SQL.replace("FROM documents", f"FROM '{folder}/documents.parquet'")).fetchall()
    assert sorted(map(tuple, op.query(spark, folder).collect())) == sorted(rows)


@pytest.mark.parametrize("letters", [1_024, 2_048, 4_096])
def test_words_that_agree_modulo_two_to_64_are_not_linked(frame, letters):
    """The Thue-Morse word and its complement have the same polynomial hash modulo 2 ** 64 under any base."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(letters))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, f"{word} {other} x y z"), (4, f"{other} {word} x y z"), (5, word)]
    check(frame, rows)
    got = {r.doc_id: r.component_id for r in op.near_duplicates(frame(rows), 4, 80).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_a_bucket_of_any_size_has_the_same_rule(frame, monkeypatch):
    """With a distance that parts many pairs of the similarity, split and whole buckets part the same ones."""
    monkeypatch.setattr(op, "DISTANCE", 4)
    rows = near_copies(11, 12, 9)
    split, whole = (sorted(map(tuple, op.near_duplicates(frame(rows), 4, 80, hot).collect())) for hot in (1, 10**9))
    assert split == whole
    monkeypatch.undo()
    assert split != sorted(map(tuple, op.near_duplicates(frame(rows), 4, 80).collect()))
