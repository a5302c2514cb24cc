"""Quality rules: a learned decision list over text statistics, applied as an ordered Spark conditional expression.

Sequential covering grows a conjunction of thresholds on two thirds of the labelled rows, prunes it on the last third and
keeps it if it is precise there, on rows that did not shape it; rows that it covers leave, and the next rule is grown. The list ends up as nested
CASE WHEN branches, so scoring is one scan without a shuffle, and every verdict can be explained by one rule.

Edge cases: a NULL or empty text has no words and fails the base rule; without labels the list is empty and only the base
rule rejects; repeated rows are judged one by one; extra columns pass through unless they clash with an output name, in
which case the output replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import let, table, unused, words

#: Labelled rows that a fit uses at most; they are those with the smallest hashes of doc_id.
MAX_LABELLED = 20_000
#: Candidate thresholds of a feature: quantiles of the labelled rows.
QUANTILES = 24
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(w: Column) -> Column:
    """Words that lie in a 3-word window whose words occur as a window twice or more, the first time included.

    Windows are put in order of their hashes only where some hash occurs twice.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def starts(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["p"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(ordered, starts), covered))

    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(hashes, count)).cast("long")


def base_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the counts in BASE, all long."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    stats = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated(w).alias("n_repeat_words"),
        ),
    )
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    (name,) = unused(df, "stats")
    out = df.withColumns({name: stats, "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"), "n_dup_lines": dup_lines.cast("long")})
    return out.withColumns({c: F.col(name)[c] for c in ("n_words", "word_chars", "n_repeat_words")}).drop(name)


def ratios(text_col: str = "text") -> dict[str, Column]:
    """The features that the rules test; those from BASE are relative to the number of words."""
    text, n = F.coalesce(F.col(text_col), F.lit("")), F.greatest(F.col("n_words"), F.lit(1))
    per_word = {
        "symbols": F.col("n_symbols"),
        "word_length": F.col("word_chars"),
        "repeats": F.col("n_repeat_words"),
        "dup_lines": F.col("n_dup_lines"),
        "capitals": F.regexp_count(text, F.lit("\\p{Lu}")),
        "stops": F.regexp_count(text, F.lit("[.?]")),
        "bangs": F.regexp_count(text, F.lit("!")),
        "bars": F.regexp_count(text, F.lit("[|]")),
        "digits": F.regexp_count(text, F.lit("[0-9]")),
    }
    return {k: (v / n).cast("double") for k, v in per_word.items()} | {"words": F.col("n_words").cast("double")}


@dataclass(frozen=True)
class Test:
    """One threshold: feature >= value if ``above``, else feature < value."""

    feature: str
    above: bool
    value: float

    def column(self, features: dict[str, Column]) -> Column:
        return features[self.feature] >= self.value if self.above else features[self.feature] < self.value

    def rows(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.value if self.above else x[self.feature] < self.value


def _holds(rule: list[Test], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(np.logical_and, (t.rows(x) for t in rule), np.ones(n, bool))


def _best_test(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray]) -> tuple[float, Test | None]:
    """The test with the largest information gain over the covered rows, from each feature's counts by threshold."""
    p0, n0 = bad.sum(), (~bad).sum()
    before = np.log2(max(p0, 1e-9) / max(p0 + n0, 1e-9))
    best: tuple[float, Test | None] = (1e-9, None)
    for name, at in cuts.items():
        place = np.searchsorted(at, x[name], side="right")
        p = np.bincount(place[bad], minlength=len(at) + 1)[::-1].cumsum()[::-1][1:]
        n = np.bincount(place[~bad], minlength=len(at) + 1)[::-1].cumsum()[::-1][1:]
        for above, pp, nn in ((True, p, n), (False, p0 - p, n0 - n)):
            gain = pp * (np.log2(np.maximum(pp, 1e-9) / np.maximum(pp + nn, 1e-9)) - before)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), Test(name, above, float(at[k])))
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray, max_rules: int = 12, max_tests: int = 4, precision: float = 0.98, least: int = 4, least_pruning: int = 2) -> list[list[Test]]:
    """Sequential covering: rules for the bad rows. ``prune`` marks the rows kept back for pruning.

    A rule is kept if it covers ``least`` bad rows among those it was grown on, and ``least_pruning`` among those kept back,
    where ``precision`` of the rows that it covers must be bad.
    """
    rules: list[list[Test]] = []
    if not len(bad):
        return rules
    cuts = {k: np.unique(np.concatenate([np.quantile(v, np.linspace(0, 1, QUANTILES + 1)[1:]), *([np.quantile(v[bad], np.linspace(0, 1, QUANTILES + 1))] if bad.any() else [])])) for k, v in x.items()}
    left = np.ones(len(bad), bool)
    for _ in range(max_rules):
        rule: list[Test] = []
        grow = left & ~prune
        while len(rule) < max_tests and (bad[grow]).any() and (~bad[grow]).any():
            _, test = _best_test({k: v[grow] for k, v in x.items()}, bad[grow], cuts)
            if test is None:
                break
            rule.append(test)
            grow = grow & test.rows(x)

        def worth(r: list[Test]) -> float:
            hit = _holds(r, x, len(bad)) & left & prune
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            return (p - n) / max(p + n, 1)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = _holds(rule, x, len(bad)) & left
        held = (hit & bad & prune).sum()
        if not rule or (hit & bad & ~prune).sum() < least or held < least_pruning or held < precision * (hit & prune).sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> list[list[Test]]:
    """Learn the list from labels(doc_id, quality 0/1); a document with a NULL label is not used."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg((F.min("quality") == 0).alias("bad")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    rows = base_features(docs.select("doc_id", F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id"))
    features = ratios()
    # one row a document, the same whatever the order, so that repeated rows do not pass the bound
    own = F.min(F.struct("bad", *(v.alias(k) for k, v in features.items())))
    got = sorted(rows.groupBy("doc_id").agg(own.alias("x")).select("doc_id", "x.*").collect(), key=lambda r: r["doc_id"])
    x = {k: np.array([r[k] for r in got], float) for k in features}
    prune = np.array([r["doc_id"] * 2654435761 % 2**32 % 3 == 0 for r in got], bool)
    return learn(x, np.array([r["bad"] for r in got], bool), prune)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: list[list[Test]], text_col: str = "text") -> Column:
    """The number of the first rule that rejects the document, from 1; NULL where none does."""
    features, out = ratios(text_col), F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(reduce(lambda a, b: a & b, (t.column(features) for t in rule)), k).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[list[Test]], text_col: str = "text") -> DataFrame:
    """Adds the counts, base_failed, rule (the rejecting rule's number) and kept."""
    out = base_features(docs, text_col).withColumns({"base_failed": base_failed(), "rule": verdict(rules, text_col)})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", *BASE, "base_failed", "rule", "kept")
