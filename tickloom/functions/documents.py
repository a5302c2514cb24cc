"""Parsing of free-text answers that hold a JSON document, and of raw quote payloads.

All parsers are column expressions and never raise: what cannot be parsed gives the fallback.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.exprs import pct_change, safe_double


def fenced(text: Column) -> Column:
    """The inside of the first json fence, else of the first fence, else the text itself."""
    json_fence = F.nullif(F.regexp_extract(text, r"(?s)```json\s*(.*?)\s*```", 1), F.lit(""))
    any_fence = F.nullif(F.regexp_extract(text, r"(?s)```\s*(.*?)\s*```", 1), F.lit(""))
    return F.coalesce(json_fence, any_fence, text)


def between(text: Column, opens: str, closes: str) -> Column:
    """From the first ``opens`` to the last ``closes``; NULL without them."""
    return F.nullif(F.regexp_extract(text, rf"(?s)(\{opens}.*\{closes})", 1), F.lit(""))


def parsed(text: Column, schema: str, required: str) -> Column:
    """The document, or NULL where the text is no JSON or lacks the required field."""
    doc = F.from_json(text, schema)
    return F.when(doc[required].isNotNull(), doc)


def first_parsed(texts: list[Column], schema: str, required: str) -> Column:
    return F.coalesce(*(parsed(t, schema, required) for t in texts))


def parse_answer(text: Column, schema: str, required: str, chain: str) -> Column:
    """One of the chains: "fence_braces" (fence or text, then braces), "braces" (text, then braces), "fence" (fence or text
    only), "braces_only". NULL where it fails; the caller supplies its default document."""
    steps = {
        "fence_braces": [fenced(text), between(text, "{", "}")],
        "braces": [text, between(text, "{", "}")],
        "fence": [fenced(text)],
        "braces_only": [between(text, "{", "}")],
    }
    return first_parsed(steps[chain], schema, required)


def parse_array(text: Column, element: str) -> Column:
    """The array from the first [ to the last ]; empty where there is none."""
    found = F.from_json(between(text, "[", "]"), f"array<{element}>")
    return F.coalesce(found, F.array().cast(f"array<{element}>"))


def quote_fields(payload: Column, variable: str) -> Column:
    """The comma-separated fields of ``variable="..."``; NULL without it."""
    body = F.regexp_extract(payload, rf'{variable}="([^"]*)"', 1)
    return F.when(body != "", F.split(body, ","))


def quote_a(payload: Column) -> Column:
    """struct(price, open, high, low, prev_close, change_pct, date); NULL if a field is missing or malformed."""
    f = quote_fields(payload, "v_hf_GC")
    num = lambda i: F.get(f, i).try_cast("double")
    price, prev = num(0), num(7)
    whole = price.isNotNull() & num(2).isNotNull() & num(3).isNotNull() & num(4).isNotNull() & prev.isNotNull() & F.get(f, 12).isNotNull()
    out = F.struct(price.alias("price"), num(2).alias("open"), num(3).alias("high"), num(4).alias("low"), prev.alias("prev_close"), pct_change(price, prev).alias("change_pct"), F.get(f, 12).alias("date"))
    return F.when(whole, out)


def quote_dollar(payload: Column) -> Column:
    """struct(price, prev_close, change_pct); NULL with fewer than ten fields or malformed ones."""
    f = quote_fields(payload, "hq_str_DINIW")
    price, prev = F.get(f, 1).try_cast("double"), F.get(f, 8).try_cast("double")
    return F.when((F.size(f) >= 10) & price.isNotNull() & prev.isNotNull(), F.struct(price.alias("price"), prev.alias("prev_close"), pct_change(price, prev).alias("change_pct")))


def quote_b(payload: Column) -> Column:
    """struct(price, high, low, prev_close, open, change_pct, time); NULL with fewer than 13 fields; bad numbers count as 0."""
    f = quote_fields(payload, "hq_str_hf_GC")
    num = lambda i: safe_double(F.get(f, i))
    out = F.struct(num(0).alias("price"), num(4).alias("high"), num(5).alias("low"), num(7).alias("prev_close"), num(8).alias("open"), pct_change(num(0), num(7)).alias("change_pct"), F.concat_ws(" ", F.get(f, 12), F.get(f, 6)).alias("time"))
    return F.when(F.size(f) >= 13, out)


def quote_c(payload: Column) -> Column:
    """The JSON quote with prices in hundredths."""
    d = F.from_json(payload, "data struct<f43:bigint,f44:bigint,f45:bigint,f46:bigint,f60:bigint>")["data"]
    cents = lambda k: d[k] / F.lit(100.0)
    return F.when(d["f43"].isNotNull(), F.struct(cents("f43").alias("price"), cents("f44").alias("high"), cents("f45").alias("low"), cents("f46").alias("open"), cents("f60").alias("prev_close"), pct_change(cents("f43"), cents("f60")).alias("change_pct")))


def is_filled(items: Column) -> Column:
    """Whether a document's required array is there and not empty."""
    return F.coalesce(F.size(items) > 0, F.lit(False))


def with_defaults(doc: Column, defaults: dict[str, Column]) -> Column:
    """The document with defaults for its NULL fields; a NULL document stays NULL."""
    out = doc
    for name, value in defaults.items():
        out = out.withField(name, F.coalesce(doc[name], value))
    return out


def override(doc: Column, field: str, value: Column) -> Column:
    """The document with a realtime value in place of the field's own, where there is one."""
    return doc.withField(field, F.coalesce(value, doc[field]))


def with_metadata(doc: Column, cached: Column, source: str, generated_at: Column) -> Column:
    """The document with a metadata struct: cached, source, generated_at."""
    return doc.withField("metadata", F.struct(cached.alias("cached"), F.lit(source).alias("source"), generated_at.alias("generated_at")))


def pretty(doc: Column) -> Column:
    """Indented JSON, non-ASCII kept."""
    return F.to_json(doc, {"pretty": "true", "ignoreNullFields": "false"})
