"""Text columns: folding, terms, aliases, tokens, page tests, secret redaction."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from assaykit.plans.runtime import ws_trim

#: Legal words that are no company terms.
LEGAL_WORDS = ("company", "corporation", "limited", "ltd", "gmbh", "group", "international", "srl", "spa")
#: Marks of walls against robots, in lower case.
BOT_WALL_MARKS = ("captcha", "cloudflare", "verify you are human", "access denied", "enable javascript", "checking your browser", "unusual traffic", "security check")
#: Openings of error pages, in lower case.
ERROR_OPENINGS = ("error", "api key", "not found", "unauthorized", "extract_invalid_content")


def fold_python(value: str) -> str:
    """Compatibility decomposition, case folding, no combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", value).casefold() if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def fold_text(values: pd.Series) -> pd.Series:
    """``fold_python`` over Arrow batches; null stays null. Spark has no Unicode normaliser."""
    return values.map(fold_python, na_action="ignore")


def company_terms(name: Column) -> Column:
    """Folded letter runs of more than two letters without legal words, in their order."""
    runs = F.regexp_extract_all(fold_text(F.coalesce(name, F.lit(""))), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))
    return F.filter(runs, lambda w: (F.length(w) > 2) & ~w.isin(*LEGAL_WORDS))


def identity_aliases(name: Column) -> Column:
    """Full name, parts at slashes, texts in brackets, the name without brackets; distinct in this order, two letters at least."""
    n = ws_trim(F.coalesce(name, F.lit("")))
    slash = F.split(n, r"\s*/\s*")
    inside = F.regexp_extract_all(n, F.lit(r"[(（]([^)）]+)[)）]"), F.lit(1))
    bare = F.regexp_replace(n, r"\s*[(（][^)）]*[)）]\s*", " ")
    every = F.concat(F.array(n), slash, inside, F.array(bare))
    return F.array_distinct(F.filter(F.transform(every, ws_trim), lambda a: F.length(a) >= 2))


def identity_seed_name(name: Column) -> Column:
    """One line without quotes and site: operators, at most 120 characters."""
    line = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[\"“”„]", ""), r"(?i)\bsite:\S+", "")
    return F.left(ws_trim(F.regexp_replace(line, r"\s+", " ")), F.lit(120))


def search_name(name: Column) -> Column:
    """The name to search by: the last Latin part behind a slash that is more than 'X Group', else the first part without brackets."""
    parts = F.transform(F.split(ws_trim(F.coalesce(name, F.lit(""))), r"\s*/\s*"), lambda p: ws_trim(F.regexp_replace(p, r"\s*[(（][^)）]*[)）]\s*", " ")))
    useful = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda p: p.rlike(r"[A-Za-z]{2}") & ~p.rlike(r"(?i)^\S+ group$"))
    return F.coalesce(F.try_element_at(useful, F.lit(-1)), F.try_element_at(parts, F.lit(1)))


def page_tokens(url: Column, text: Column) -> Column:
    """Distinct runs of at least four letters or digits (a-z, 0-9) of the address and the text, in lower case."""
    both = F.lower(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(text, F.lit(""))))
    return F.array_distinct(F.regexp_extract_all(both, F.lit(r"[a-z0-9]{4,}"), F.lit(0)))


def extract_title(text: Column, url: Column) -> Column:
    """First Markdown heading that is not empty, else the address."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^#+ *([^#\s].*)$", 1)), F.lit("")), url)


def substantive(text: Column) -> Column:
    """At least 80 characters, no mark of a wall against robots, no error opening. False for null."""
    t = F.lower(ws_trim(F.coalesce(text, F.lit(""))))
    ok = F.length(t) >= 80
    for mark in BOT_WALL_MARKS:
        ok = ok & ~t.contains(mark)
    for start in ERROR_OPENINGS:
        ok = ok & ~t.startswith(start)
    return ok


#: Names of secrets, and what stands between a name and its value.
SECRETS = r"(?i)(api[_-]?key|access[_-]?token|secret)\s*[:=]\s*[^\s,;]+"


def redact_secrets(text: Column) -> Column:
    """Values after api key, access token and secret become ``[redacted]``."""
    return F.regexp_replace(text, SECRETS, "$1=[redacted]")


def signal_count(text: Column, patterns: list[str]) -> Column:
    """How many of ``patterns`` occur in the text."""
    out = F.lit(0)
    for p in patterns:
        out = out + F.coalesce(text.rlike(p), F.lit(False)).cast("int")
    return out


def safe_slug(value: Column) -> Column:
    """Name for a file: letters, digits, dots and dashes, at most 48 characters, 'record' if nothing is left."""
    s = F.regexp_replace(F.coalesce(value, F.lit("")), r"[^\p{L}\p{N}._-]+", "-")
    s = F.left(F.btrim(s, F.lit("-._")), F.lit(48))
    return F.when(s == "", F.lit("record")).otherwise(s)


def html_escape(value: Column) -> Column:
    out = F.coalesce(value, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def markdown_link(title: Column, url: Column) -> Column:
    """``[title](url)`` for http(s) addresses, else the title."""
    label = F.coalesce(F.nullif(title, F.lit("")), url, F.lit(""))
    return F.when(url.rlike(r"^https?://"), F.concat(F.lit("["), label, F.lit("]("), url, F.lit(")"))).otherwise(label)


def normalised_quote(text: Column) -> Column:
    """Markdown links unwrapped, emphasis marks dropped, lower case, only letters, digits and underscores kept."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(F.lower(F.regexp_replace(plain, r"\*\*|__", "")), r"[^\p{L}\p{N}_]+", "")


def mapped_level(value: Column, aliases: dict[str, str], default: str) -> Column:
    """Canonical level of a typed one by its aliases (trimmed, lower case), else ``default``."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(ws_trim(F.coalesce(value, F.lit(""))))), F.lit(default))
