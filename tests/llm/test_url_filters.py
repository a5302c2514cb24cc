"""Host reputations against a plain Python version, page outcomes, and the SQL of the query."""

import math
import random
import re
from fractions import Fraction

import duckdb
import pytest

from tickloom.llm import url_filters as op

SF = "/root/testdata/sf0.001"


def levels(site):
    if re.fullmatch(r"\d+\.\d+\.\d+\.\d+", site):
        return site, ""
    labels = site.split(".")
    n = 2 if ".".join(labels[-2:]) in op.SUFFIXES else 1
    return ".".join(labels[-n - 1 :]), ".".join(labels[-n:])


def blocked_sites(outcomes, sites):
    """Exact counts; per level, every group shrinks towards the posterior mean of the group above."""
    tally = {s: [0, 0] for s in sites}
    for site, bad in outcomes:
        tally[site][0] += 1
        tally[site][1] += bad
    up = {"site": lambda s: levels(s)[0], "domain": lambda s: levels(s)[1]}
    groups = {"site": tally, "domain": {}, "suffix": {}}
    for s, (n, b) in tally.items():
        for level, key in zip(("domain", "suffix"), levels(s), strict=True):
            have = groups[level].setdefault(key, [0, 0])
            have[0] += n
            have[1] += b
    means = {}
    for level in ("suffix", "domain", "site"):
        rows = [x for x in groups[level].values() if x[0]]
        total = sum(n for n, _ in rows)
        mu = Fraction(sum(b for _, b in rows), total)
        # variance of the rates, weighted by counts, beyond what counting alone gives
        spread = (sum(n * (Fraction(b, n) - mu) ** 2 for n, b in rows) - (len(rows) - 1) * mu * (1 - mu)) / total
        m = min(200.0, max(2.0, float(mu * (1 - mu) / spread) - 1 if spread > 0 else 200.0))
        above = {"site": lambda k: means["domain"][levels(k)[0]][0], "domain": lambda k: next(means["suffix"][levels(s)[1]][0] for s in tally if levels(s)[0] == k), "suffix": lambda k: float(mu)}[level]
        means[level] = {k: ((b + m * above(k)) / (n + m), n + m) for k, (n, b) in groups[level].items()}
    return {s for s, (mean, size) in means["site"].items() if mean - 1.645 * math.sqrt(mean * (1 - mean) / (size + 1)) > 0.5}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_plain_shrinkage(spark, seed):
    rnd = random.Random(seed)
    sites = [f"{h}.{d}.{s}" for s in ("net", "co.uk", "org") for d in ("one", "two", "three") for h in ("a", "b", "c")] + ["10.0.0.1", "10.0.0.2", "uk"]
    rate = {s: rnd.choice([0.02, 0.1, 0.95]) for s in sites}
    outcomes = [(s, rnd.random() < rate[s]) for s in sites[:-4] for _ in range(rnd.choice([1, 2, 8, 40]))]
    expected = blocked_sites(outcomes, sites)
    assert expected
    pages = spark.createDataFrame([(i, f"ftp://me@{s}:8080/x") for i, s in enumerate(sites)], "page_id long, url string")
    got = op.judge(pages, spark.createDataFrame(outcomes, "host string, bad boolean"))
    assert {sites[r.page_id] for r in got.collect() if r.verdict == "block"} == expected


def test_unrelated_sites_under_long_suffixes_and_addresses(spark):
    bad = [("bad.co.uk", True)] * 90 + [("fine.co.uk", False)] * 90 + [("1.2.3.4", True)] * 90 + [("5.6.7.8", False)] * 90
    urls = ["http://bad.co.uk:81/", "http://fine.co.uk/", "http://www.fine.co.uk/", "http://1.2.3.4/", "http://9.2.3.4/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.url: r.verdict for r in op.judge(pages, spark.createDataFrame(bad, "host string, bad boolean")).collect()}
    assert [got[u] for u in urls] == ["block", "allow", "allow", "block", "allow"]


def test_clashing_columns_stay(spark):
    names = ("site", "found", "blocked", "suffix", "domain", "rule_verdict", "_host", "mean", "n", "bad")
    pages = spark.createDataFrame([(1, "http://x.net/", "old", *names)], ["page_id", "url", "Host", *names])
    out = op.judge(pages, spark.createDataFrame([(None, None)], "host string, bad boolean"))
    assert out.columns == ["page_id", "url", *names, "host", "path", "rule", "verdict"]
    row = out.first()
    assert tuple(row[n] for n in names) == names and (row.host, row.verdict) == ("x.net", "allow")


def test_outcomes_of_pages(spark):
    text = "word " * 60
    rows = [
        ("http://good.net/", f"<html><script>var x = '<p>';</script><body><nav>#### $$$$</nav><p>{text}</p><!-- #$% --></body></html>"),
        ("http://good.net/", "<p>" + "word " * 49 + "</p><script>" + text + "</script>"),
        ("http://good.net/", "<p>" + "w## " * 60 + "</p>"),
        ("http://casino-win.net/", f"<p>{text}</p>"),
        ("http://casinos.net/", f"<p>{text}</p>"),
        (None, None),
    ]
    got = op.page_outcomes(spark.createDataFrame(rows, "url string, html string").coalesce(1)).collect()
    assert [r.bad for r in got] == [False, True, True, True, False, True]


def test_hosts_of_bad_pages_are_blocked_and_others_not(spark):
    page = lambda host, n, word: [(f"http://{host}/{i}", f"<p>{word * 60}</p>") for i in range(n)]
    rows = page("www.spam-farm.example.com", 30, "word ") + page("junk.example.com", 30, "#|$ ") + [x for k in range(20) for x in page(f"h{k}.example.com", 10, "word ")]
    pages = spark.createDataFrame(rows, "url string, html string")
    got = op.judge(pages, op.page_outcomes(pages)).where("verdict = 'block'").select("host").distinct()
    assert {r.host for r in got.collect()} == {"www.spam-farm.example.com", "junk.example.com"}


def test_query_equals_its_sql(spark):
    rows = duckdb.sql(op.SQL.replace("FROM pages", f"FROM '{SF}/pages.parquet'")).fetchall()
    assert sorted(map(tuple, op.query(spark, SF).collect()), key=str) == sorted(rows, key=str)
