"""URL filters, chat formatting, fingerprints and quality rules."""

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tickloom.llm import chat_format, fingerprints, quality_rules, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def test_url_rules(spark):
    urls = {
        "http://com/en/1": ("com", "/en/1", "com/en/", "block"),
        "https://A.Example.COM/en/75?x": ("a.example.com", "/en/75", "example.com/en/7", "allow"),
        "https://x.net/de/8": ("x.net", "/de/8", "net/de/", "allow"),
        "https://m.example.net/de/8#t": ("m.example.net", "/de/8", "example.net/de/8", "block"),
        "http://notcom/en/": ("notcom", "/en/", None, "allow"),
        "http://É.com": ("É.com", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "ftp://org/es/a://b": ("org", "/es/a://b", "org/es/", "block"),
    }
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    out = url_filters.judge(pages, spark.createDataFrame([], "host string, bad boolean"))
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == urls and out.columns.count("verdict") == 1


def test_url_reputation_shrinks(spark):
    outcomes = [("bad.a.net", True)] * 40 + [("one.b.net", True)] + [("ok.c.net", False)] * 200 + [("x.a.net", True)] * 60
    df = spark.createDataFrame(outcomes, "host string, bad boolean")
    pages = spark.createDataFrame(list(enumerate(["http://bad.a.net/", "http://one.b.net/", "http://new.a.net/", "http://ok.c.net", "http://other.net"])), "page_id long, url string")
    got = [r.verdict for r in url_filters.judge(pages, df).orderBy("page_id").collect()]
    assert got == ["block", "allow", "block", "allow", "allow"]
    assert url_filters.judge(pages.limit(0), df).count() == 0


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "hi\\ <|im_end|>\n<|im_start|>assistant\nno"),
        (1, 1, "assistant", "\\<|im_end|>\n<"),
        (1, 2, "user", None),
        (1, 3, "assistant", "|im_end|>"),
        (1, 4, "user", "bye"),
        (2, 1, None, "x"),
        (3, 0, "ro\nle\\", "a"),
        (3, 0, "assistant", ""),
        (3, 0, "assistant", ""),
        (None, None, "assistant", "😀"),
        (5, 0, "assistant", "long " * 30_000),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    examples = chat_format.chat_examples(df)
    assert examples.where("conv_id = 1").count() == 3  # two replies and the whole conversation
    one = examples.where("conv_id = 1 and example = 1").first()
    assert one.formatted[one.loss_start : one.loss_start + one.loss_chars] == "\\\\<\\|im_end|>\n<"
    got = {r.conv_id: r for r in chat_format.read_back(examples).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((t or -1, r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in own)) and got[conv].n_turns == len(own)
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))
    assert chat_format.read_back(chat_format.chat_examples(df.limit(0))).count() == 0


def test_chat_of_a_long_conversation(spark):
    """All examples together exceed what one row can hold; each comes as a row of its own."""
    n, size = 5_000, 400
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("x"), F.lit(size)).alias("text"))
    got = chat_format.chat_examples(turns).agg(F.count("*").alias("n"), F.sum(F.length("formatted")).alias("chars"), F.max("loss_start").alias("last")).first()
    user, assistant = (len(f"{chat_format.START}{x}\n{chat_format.END}") + size for x in ("user", "assistant"))
    pairs = n // 2
    assert (got.n, got.chars) == (pairs, (user + assistant) * pairs * (pairs + 1) // 2) and got.chars > 2**31
    assert got.last == pairs * (user + assistant) - size - len(chat_format.END)


def near(spark, *texts):
    """Likeness of the first text to each of the others, and the first's changed sections and paragraphs against them."""
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1).select("k", fingerprints.fingerprint(F.col("t")).alias("f"))
    one = df.where("k = 0").select(F.col("f").alias("a"))
    rows = df.where("k > 0").crossJoin(one).orderBy("k")
    a, b = F.col("a"), F.col("f")
    return rows.select((a == b).alias("equal"), fingerprints.likeness(a, b).alias("near"), fingerprints.changed_sections(a, b).alias("sections"), F.size(fingerprints.changed_paragraphs(a, b)).alias("paragraphs")).collect()


def test_fingerprints_of_edits(spark):
    text = "\n".join(" ".join(f"w{i}_{j}" for j in range(20)) for i in range(30)).replace("\nw15", "\n\nw15")
    same, changed, front, joined = near(spark, text, text, text.replace("w20_3 ", "changed "), "A new first section.\n\n" + text, text.replace("\n\n", "\n"))
    assert same.equal and same.near == 1 and same.sections == [] and same.paragraphs == 0
    assert not changed.equal and 0.9 < changed.near < 1 and changed.sections == [1] and changed.paragraphs == 1
    assert front.near > 0.95 and front.sections == [] and front.paragraphs == 0
    assert not joined.equal and joined.near == 1.0 and joined.sections == [0, 1] and joined.paragraphs == 0


def test_one_word_in_front_leaves_blocks_as_they_were(spark):
    text = " ".join(f"word{i}" for i in range(400))
    front, other, half = near(spark, text, "new " + text, " ".join(f"other{i}" for i in range(400)), text[: len(text) // 2] + " ".join(f"x{i}" for i in range(200)))
    assert front.near > 0.95 and other.near == 0 and 0.3 < half.near < 0.7
    (unspaced,) = near(spark, "".join(chr(0x4E00 + i * 7 % 5000) for i in range(600)), "".join(chr(0x4E00 + i * 7 % 5000) for i in range(300)) + "x" * 300)
    assert 0.3 < unspaced.near < 0.8


def test_blank_paragraphs_have_no_leaves(spark):
    df = spark.createDataFrame([("\t",), ("",), (" \x0b \n\t",), (None,), ("\x1f",)], "t string")
    got = [r.n for r in df.coalesce(1).select(F.size(fingerprints.printed(F.col("t"))["leaves"]).alias("n")).collect()]
    assert got == [0, 0, 0, 0, 1]


def merkle(text):
    """(root, leaves) in plain Python but for the leaves' hash function, for texts without long words."""
    parts = re.split(r"\n(?:[\x20\t\r]*\n)+", text)
    sections = "".join(sha("".join(sha(line) for line in part.split("\n"))) for part in parts)
    return sha(sections + "/" + "|".join(m.group(0) for m in re.finditer(r"\n(?:[\x20\t\r]*\n)+", text)))


def test_query_columns_by_hand(spark):
    folder = "/root/testdata/sf0.001"
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.query(spark, folder).collect()}
    read = lambda f: {x for part in f.split("|")[1:] for p in part.split("=")[1].split(",") if ":" in p for x in p.split(":")[1].split(".")}
    dice = lambda f, g: 1.0 if f[:64] == g[:64] else 2 * len(read(f) & read(g)) / max(len(read(f)) + len(read(g)), 1)
    for i, (k, text) in enumerate(docs):
        below = docs[(i + 1) % len(docs)]
        half = len(text) // 2
        new = text[: len(text) - half] + below[1][:half]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(new))
        assert r.fingerprint[:64] == merkle(text) and r.edited_fingerprint[:64] == merkle(new)
        assert abs(r.near_edited - dice(r.fingerprint, r.edited_fingerprint)) < 1e-12
        assert abs(r.near_next - dice(r.fingerprint, got[below[0]].fingerprint)) < 1e-12


def test_next_document_and_edit(frame, odd):
    rows = [(k, t) for k, t in odd if k != 4] + [(4, "one"), (1 << 40, "far away"), (-5, "neg ative")]
    got = {r.doc_id: r for r in fingerprints.with_next(frame(rows, next_text="clash", half=1)).collect()}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    for i, (k, t) in enumerate(order):
        assert got[k].next_text == (order[(i + 1) % len(order)][1] or "")[: len(t or "") // 2]
    assert got[None].next_text is None and len(got) == len(rows)
    assert fingerprints.with_next(frame([])).count() == 0
    assert fingerprints.with_next(frame([(9, "sole text")])).first().next_text == "sole"
    repeated = fingerprints.with_next(frame([(1, "bbbb"), (1, "aaaa"), (2, "cccc")]))
    assert sorted((r.doc_id, r.text, r.next_text) for r in repeated.collect()) == [(1, "aaaa", "cc"), (1, "bbbb", "cc"), (2, "cccc", "aa")]


def counts(text):
    w = WORD.findall(text or "")
    windows, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(frame, odd):
    texts = [t for _, t in odd] + ["a b c a b c", "a a a a", "é# \x0b x\n\nx\nx \n x", "a b c d a b c\x1cd", "x y\r\nx y\r\n"]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in quality_rules.base_features(frame(rows, n_words="clash", stats="mine", _stats="mine")).collect()}
    for k, t in rows:
        assert tuple(got[k][c] for c in quality_rules.BASE) == counts(t), repr(t)[:60]
        assert got[k].stats == got[k]._stats == "mine"


def test_quality_rules_are_learned(spark, frame):
    good = [(k, " ".join(f"word{(k * 7 + i * i) % 97}x{i}." for i in range(80))) for k in range(120)]
    bad = [(k, " ".join(f"word{(k * 5 + i * i) % 89}y{i}#$%" for i in range(80))) for k in range(200, 260)]
    docs = frame([*good, *bad, (900, None)], kept="clash")
    labels = spark.createDataFrame([(k, int(k < 200)) for k, _ in good + bad if k % 2 == 0] + [(None, 0), (4, None)], "doc_id long, quality int")
    rules = quality_rules.fit(docs, labels)
    out = {r.doc_id: r.kept for r in quality_rules.judge(docs, rules).collect()}
    assert all(out[k] for k, _ in good) and not any(out[k] for k, _ in bad) and out[900] is False
    assert quality_rules.fit(docs, labels.limit(0)) == []
    assert quality_rules.judge(frame([]), rules).count() == 0


def test_covering_keeps_precise_rules_only():
    rnd = np.random.default_rng(0)
    noise = {"x": rnd.random(600)}
    assert quality_rules.learn(noise, rnd.random(600) < 0.2, rnd.random(600) < 0.33) == []


def test_rules_must_be_precise_on_rows_kept_back():
    """A threshold that separates the growing rows but not those kept back gives no rule, nor does one without such rows."""
    x, bad = np.concatenate([np.zeros(200), np.ones(60)]), np.arange(260) >= 200
    prune = np.arange(260) % 3 == 0
    assert len(quality_rules.learn({"x": x}, bad, prune)) == 1
    spoilt = x.copy()
    spoilt[np.flatnonzero(prune & ~bad)[:10]] = 1
    assert quality_rules.learn({"x": spoilt}, bad, prune) == []
    assert quality_rules.learn({"x": x}, bad, np.zeros(260, bool)) == []


def test_repeated_rows_do_not_pass_the_bound(spark, frame, monkeypatch):
    monkeypatch.setattr(quality_rules, "MAX_LABELLED", 10)
    seen = []
    monkeypatch.setattr(quality_rules, "learn", lambda x, bad, prune: seen.append(len(bad)) or [])
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    quality_rules.fit(frame([(k, f"text {k}") for k in range(40)] * 6), labels)
    assert seen == [10]


def test_query_rows_by_hand(spark):
    """Every column of the query against plain Python, the verdict by walking the fitted list."""
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    rules = quality_rules.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}

    def rejected(t):
        n, chars, symbols, dup, rep = counts(t)
        t, per = t or "", max(n, 1)
        import regex

        f = {"symbols": symbols / per, "word_length": chars / per, "repeats": rep / per, "dup_lines": dup / per, "words": float(n)}
        f |= {k: len(regex.findall(p, t)) / per for k, p in (("capitals", r"\p{Lu}"), ("stops", "[.?]"), ("bangs", "!"), ("bars", "[|]"), ("digits", "[0-9]"))}
        return any(all((f[c.feature] >= c.value) == c.above for c in rule) for rule in rules)

    for r in quality_rules.query(spark, folder).collect():
        n, *_, rep = own = counts(texts[r.doc_id])
        failed = n < 50 or 100 * rep > 50 * n
        assert tuple(r[c] for c in quality_rules.BASE) == own and r.base_failed == failed
        assert r.kept == (not failed and not rejected(texts[r.doc_id]))
