"""URL columns as native expressions: normal form, provenance key, host tests, path intent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.plans.runtime import ws_trim

#: Query fields that say where a visitor came from, not which page it is.
TRACKING_FIELDS = ("srsltid", "gclid", "fbclid")
TRACKING_PREFIX = "utm_"

#: Hosts of directories and networks whose pages say little about a company.
LOW_AUTHORITY_HOSTS = ("facebook.com", "instagram.com", "linkedin.com", "youtube.com", "x.com", "twitter.com", "wikipedia.org", "dnb.com", "kompass.com", "europages.com")


def normalise_url(c: Column) -> Column:
    """Normal form: trimmed, https added where no scheme stands, no fragment, no trailing slash.

    '' for null or blank input, for schemes other than http(s) and for input without an authority.
    """
    t = ws_trim(F.coalesce(c, F.lit("")))
    full = F.when(t.contains("://"), t).otherwise(F.concat(F.lit("https://"), t))
    bare = F.regexp_replace(F.regexp_replace(full, r"#.*$", ""), r"/+$", "")
    return F.when(bare.rlike(r"^(?i:https?)://[^/?#\s]+"), F.regexp_replace(bare, r"^(?i:(https?))://", "$1://")).otherwise(F.lit(""))


def url_host(c: Column) -> Column:
    """Lower-case host of an address with or without scheme; no userinfo, port or trailing dot. '' if there is none."""
    n = normalise_url(c)
    authority = F.regexp_extract(n, r"^(?i:https?)://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""), r"\.+$", ""))


def _upper_escapes(path: Column) -> Column:
    pieces = F.split(path, "%")
    return F.concat_ws("%", F.transform(pieces, lambda p, i: F.when((i > 0) & p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.upper(F.substring(p, 1, 2)), p.substr(F.lit(3), F.length(p)))).otherwise(p)))


def url_path(c: Column) -> Column:
    """Path of the normal form: slashes collapsed, none at the end, ``;params`` dropped, %xx in upper case, '/' if empty."""
    raw = F.regexp_extract(normalise_url(c), r"^(?i:https?)://[^/?#]*([^?#]*)", 1)
    raw = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r";[^/]*$", ""), r"/+", "/"), r"/$", "")
    upper = _upper_escapes(raw)
    return F.when(upper == "", F.lit("/")).otherwise(upper)


def url_query_fields(c: Column) -> Column:
    """Query fields in their order, without empty ones and without tracking fields."""
    q = F.regexp_extract(normalise_url(c), r"^[^?]*\?(.*)$", 1)

    def kept(f: Column) -> Column:
        name = F.lower(F.substring_index(f, "=", 1))
        return (f != "") & ~name.isin(*TRACKING_FIELDS) & ~name.startswith(TRACKING_PREFIX)

    return F.filter(F.split(q, "&"), kept)


def provenance_key(c: Column) -> Column:
    """``struct(host, path, query)`` under which two addresses name the same page, NULL where there is no address.

    The host loses one leading www.; scheme, port, userinfo and fragment take no part.
    """
    key = F.struct(
        F.regexp_replace(url_host(c), r"^www\.", "").alias("host"),
        url_path(c).alias("path"),
        F.concat_ws("&", url_query_fields(c)).alias("query"),
    )
    return F.when(normalise_url(c) != "", key)


def with_url_parts(df: DataFrame, address: str) -> DataFrame:
    """Add ``url_norm, url_host, url_path, url_fields`` of a column, step by step, so that no expression is computed twice."""
    out = df.withColumn("url_norm", normalise_url(F.col(address)))
    out = out.withColumn("_rest", F.regexp_replace("url_norm", r"^(?i:https?)://", ""))
    out = out.withColumn("_authority", F.regexp_extract("_rest", r"^[^/?#]*", 0)).withColumn("_query", F.when(F.col("_rest").contains("?"), F.regexp_extract("_rest", r"\?(.*)$", 1)).otherwise(""))
    out = out.withColumn("_path", F.regexp_replace(F.regexp_replace(F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1), r";[^/]*$", ""), r"/+", "/"))

    def kept(f: Column) -> Column:
        name = F.lower(F.substring_index(f, "=", 1))
        return (f != "") & ~name.isin(*TRACKING_FIELDS) & ~name.startswith(TRACKING_PREFIX)

    out = out.withColumn("url_host", F.lower(F.regexp_replace(F.regexp_replace(F.col("_authority"), r"^.*@", ""), r"\.*(:\d*)?$", "")))
    out = out.withColumn("_path", F.when(F.col("_path").isin("", "/"), F.lit("/")).otherwise(F.rtrim(F.col("_path"), F.lit("/"))))
    out = out.withColumn("url_path", F.when(F.col("_path").contains("%"), _upper_escapes(F.col("_path"))).otherwise(F.col("_path")))
    out = out.withColumn("url_fields", F.when(F.col("_query") == "", F.array().cast("array<string>")).otherwise(F.filter(F.split("_query", "&"), kept)))
    return out.drop("_rest", "_authority", "_query", "_path")


def host_in(host: Column, domains: tuple[str, ...]) -> Column:
    """Host equals one of ``domains`` or lies under it: an equality test on its suffixes, no theta join."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))
    return F.arrays_overlap(suffixes, F.array(*[F.lit(d) for d in domains]))


def host_suffixes(host: Column) -> Column:
    """All dotted suffixes of a host, the whole host first; explode them to turn the domain test into an equi-join."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))


def clean_search_url(c: Column) -> Column:
    """Normal form of an address out of a search result: punctuation at its end is no part of it."""
    return normalise_url(F.regexp_replace(ws_trim(F.coalesce(c, F.lit(""))), r"[.,;:!?'\"\])}>]+$", ""))


def intent_of_path(path: Column) -> Column:
    """3: ends in product(s); 2: ends in (market-)application(s); 1: a segment on products, applications, solutions or a catalogue; else 0."""
    p = F.lower(path)
    return (
        F.when(p.rlike(r"/products?$"), 3)
        .when(p.rlike(r"/(market-)?applications?$"), 2)
        .when(p.rlike(r"(^|/)[^/]*(product|application|solution|catalog|portfolio)[^/]*(/|$)"), 1)
        .otherwise(0)
    )


def path_intent(c: Column) -> Column:
    """``intent_of_path`` of an address."""
    return intent_of_path(url_path(c))
