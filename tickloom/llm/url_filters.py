"""URL filters: host rules first, else an empirical-Bayes reputation of the host.

Page outcomes, labelled good or bad, give each site (a host without user and port) a count of outcomes and of bad ones.
Beta-binomial priors shrink these from the suffix to the registered domain to the site: a level's prior has its parent's
posterior mean, and a strength estimated by moments from the spread of that level's rates. A url without a rule is blocked if
the lower bound of its site's posterior bad rate exceeds ``max_bad``. A site without outcomes has its domain's posterior mean.

Outcomes come from a labelled table of pages where there is one. ``page_outcomes`` labels pages weakly by themselves
otherwise: a page is bad if its site is named for what corpora leave out (SPAM_WORDS), or if its text, with markup,
scripts, comments and navigation taken out, has fewer than 50 words or more than 30 symbols in 100 words.

The suffix is the last label of a site, or the last two where they are in SUFFIXES; the registered domain has one label more;
an IPv4 address is a domain of its own under the empty suffix.

Everything is grouping and joining by site: outcomes are counted map-side first into one table of sites, and the pages join
that once, by a join that Spark may broadcast only below its size threshold and else splits where one site is hot.

Edge cases: a NULL url or one without "://" has an empty host and path and no rule; it is judged by the reputation of the
empty site. Repeated pages count as often as they occur; outcomes that are NULL count for nothing. Without outcomes nothing
but the rules blocks. Extra columns pass through, those named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import LOWER, SPACES, UPPER, let, materialize, release, table, unused, words

#: Rules as (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
MAX_BAD, Z = 0.5, 1.645
#: Bounds of a prior's strength, in labelled pages.
LEAST, MOST = 2.0, 200.0
#: Suffixes of two labels under which domains are registered.
SUFFIXES = ("ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.hk", "com.mx", "com.sg", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
#: Words in a site's name that mark its pages as bad.
SPAM_WORDS = ("ads", "adult", "bet", "bets", "casino", "pills", "poker", "porn", "spam", "viagra", "xxx")
LEAST_WORDS, MOST_SYMBOLS = 50, 30


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_of(host: Column) -> Column:
    """The host without user, port and closing dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "(?s)^.*@", ""), ":[0-9]*$", ""), "[.]+$", "")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits host and path; NULLs where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        rule, verdict = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return F.struct(rule.alias("rule"), verdict.alias("verdict"))


def page_text(html: Column) -> Column:
    """The text of a page without markup, scripts, styles, comments, navigation and footers."""
    text = F.coalesce(html, F.lit(""))
    for part in ("<script.*?</script>", "<style.*?</style>", "<!--.*?-->", "<nav.*?</nav>", "<footer.*?</footer>"):
        text = F.regexp_replace(text, f"(?is){part}", " ")
    return F.regexp_replace(text, "<[^>]*>", " ")


def page_outcomes(pages: DataFrame, url_col: str = "url", html_col: str = "html", spam_words=SPAM_WORDS) -> DataFrame:
    """Weakly labelled outcomes(host, bad), one for each page."""
    names = F.split(site_of(host_of(F.col(url_col))), "[.-]")
    symbols = F.regexp_count("text", F.lit("[#*$%&|<>]"))
    poor = let(F.size(words(F.col("text"))), lambda n: (n < LEAST_WORDS) | (100 * symbols > MOST_SYMBOLS * n))
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.arrays_overlap(names, F.array(*map(F.lit, spam_words))).alias("spam"), page_text(F.col(html_col)).alias("text"))
    return rows.select("host", (F.col("spam") | poor).alias("bad"))


def _levels(site: Column) -> dict[str, Column]:
    labels = F.split(site, "[.]")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)), n), ".")
    address, two = site.rlike("^[0-9]+([.][0-9]+){3}$"), last(2).isin(*SUFFIXES)
    return {
        "suffix": F.when(address, "").when(two, last(2)).otherwise(last(1)),
        "domain": F.when(address, site).when(two, last(3)).otherwise(last(2)),
    }


def _posterior(rows: DataFrame, prior: str | None) -> DataFrame:
    """rows(..., n, bad) with mean and size of each row's posterior; ``prior`` is the column of its prior's mean.

    The strength of the prior is mu (1 - mu) / spread - 1, with the spread of the rates around their mean beyond what
    counting alone gives. Without any outcome all means are NULL.
    """
    n, bad = F.sum("n"), F.sum("bad")
    total = rows.where("n > 0").agg((bad / n).alias("mu"), n.alias("tn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("tq"), F.count("*").alias("tk"))
    noise = F.col("mu") * (1 - F.col("mu"))
    spread = (F.col("tq") - F.col("tn") * F.col("mu") * F.col("mu") - (F.col("tk") - 1) * noise) / F.col("tn")
    strength = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.when(spread > 0, noise / spread - 1).otherwise(F.lit(MOST))))
    rows = rows.crossJoin(F.broadcast(total.select("mu", strength.alias("m"))))
    size = F.col("n") + F.col("m")
    mean = (F.col("bad") + F.col("m") * F.col(prior or "mu")) / size
    return rows.drop("mean", "size").withColumns({"mean": mean, "size": size}).drop("mu", "m")


def reputations(counts: DataFrame, max_bad: float = MAX_BAD, z: float = Z) -> DataFrame:
    """(site, mean, blocked) of every site in counts(site, n, bad); a site may have no outcomes."""
    add = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    sites = counts.withColumns(_levels(F.col("site")))
    domains = sites.groupBy("domain", "suffix").agg(*add)
    s = _posterior(domains.groupBy("suffix").agg(*add), None).select("suffix", F.col("mean").alias("above"))
    d = _posterior(domains.join(s, "suffix"), "above").select("domain", F.col("mean").alias("above"))
    h = _posterior(sites.join(d, "domain"), "above")
    low = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("size") + 1))
    return h.select("site", "mean", F.coalesce(low > max_bad, F.lit(False)).alias("blocked"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, url_col: str = "url", max_bad: float = MAX_BAD, z: float = Z) -> DataFrame:
    """Adds host, path, rule and verdict ("allow" or "block") to pages, by outcomes(host, bad boolean)."""
    site, found, blocked = unused(pages, "site", "found", "blocked")
    host = host_of(F.col(url_col))
    seen = pages.select(site_of(host).alias("site"), F.lit(None).cast("boolean").alias("bad"))
    every = seen.union(outcomes.select(site_of(F.coalesce("host", F.lit(""))), F.col("bad").cast("boolean")))
    counts = materialize(every.groupBy("site").agg(F.count("bad").alias("n"), F.count_if("bad").alias("bad")), "site_counts")
    known = materialize(reputations(counts, max_bad, z), "reputations")
    release(counts)
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*kept, host.alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumns({site: site_of(F.col("host")), found: rule_of(F.col("host"), F.col("path"), rules)})
    rows = rows.join(known.select(F.col("site").alias(site), F.col("blocked").alias(blocked)), site, "left")
    verdict = F.coalesce(F.col(found)["verdict"], F.when(F.col(blocked), "block").otherwise("allow"))
    return rows.select(*kept, "host", "path", F.col(found)["rule"].alias("rule"), verdict.alias("verdict"))


def query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return judge(pages.select("page_id", "url"), page_outcomes(pages)).select("page_id", "host", "path", "rule", "verdict")


def _posterior_sql(level: str, parent: str | None, key: str) -> str:
    prior, join = ("p.mean", f"JOIN {parent} p USING ({key})") if parent else ("t.mu", "")
    return f"""(SELECT c.*, (c.bad + t.m * {prior}) / (c.n + t.m) AS mean, c.n + t.m AS size FROM {level}_n c {join} CROSS JOIN (
  SELECT mu, greatest({LEAST}, least({MOST}, CASE WHEN spread > 0 THEN mu * (1 - mu) / spread - 1 ELSE {MOST} END)) AS m FROM (
    SELECT mu, (tq - tn * mu * mu - (tk - 1) * (mu * (1 - mu))) / tn AS spread FROM (
      SELECT sum(n) AS tn, sum(bad * bad / n) AS tq, count(*) AS tk, sum(bad) / sum(n) AS mu FROM {level}_n))) t)"""


_ORDERED = sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))
_FITS = [f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN" for _, h, p in _ORDERED]
_TEXT = "coalesce(html, '')"
for _part in ("<script.*?</script>", "<style.*?</style>", "<!--.*?-->", "<nav.*?</nav>", "<footer.*?</footer>"):
    _TEXT = f"regexp_replace({_TEXT}, '(?is){_part}', ' ', 'g')"
_LAST = "array_to_string(list_slice(string_split(site, '.'), -{0}, -1), '.')"
_TWO = f"{_LAST.format(2)} IN {SUFFIXES}"
SQL = f"""WITH u AS (SELECT page_id, regexp_replace({_TEXT}, '<[^>]*>', ' ', 'g') AS text,
  translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
v AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '[.]+$', '') AS site,
  len(list_filter(regexp_split_to_array(text, '{SPACES}'), lambda w: w <> '')) AS n_words,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM u),
k AS (SELECT page_id, host, path, site, n_words < {LEAST_WORDS} OR 100 * n_symbols > {MOST_SYMBOLS} * n_words
    OR list_has_any(regexp_split_to_array(site, '[.-]'), {list(SPAM_WORDS)}) AS bad,
  CASE WHEN regexp_matches(site, '^[0-9]+([.][0-9]+){{3}}$') THEN '' WHEN {_TWO} THEN {_LAST.format(2)} ELSE {_LAST.format(1)} END AS suffix,
  CASE WHEN regexp_matches(site, '^[0-9]+([.][0-9]+){{3}}$') THEN site WHEN {_TWO} THEN {_LAST.format(3)} ELSE {_LAST.format(2)} END AS domain FROM v),
site_n AS (SELECT site, domain, suffix, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE bad) AS DOUBLE) AS bad FROM k GROUP BY ALL),
domain_n AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM site_n GROUP BY ALL),
suffix_n AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domain_n GROUP BY ALL),
s AS {_posterior_sql("suffix", None, "")},
d AS {_posterior_sql("domain", "s", "suffix")},
h AS {_posterior_sql("site", "d", "domain")}
SELECT page_id, host, path,
  CASE {' '.join(f"{f} '{h}{p}'" for f, (_, h, p) in zip(_FITS, _ORDERED))} END AS rule,
  CASE {' '.join(f"{f} '{v}'" for f, (v, _, _) in zip(_FITS, _ORDERED))}
    WHEN mean - {Z} * sqrt(mean * (1 - mean) / (size + 1)) > {MAX_BAD} THEN 'block' ELSE 'allow' END AS verdict FROM k JOIN h USING (site)"""
