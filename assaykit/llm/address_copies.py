"""Problem 3: addresses that differ in writing only.

Addresses become a canonical text (provenance key, case, enclosing punctuation, order of query fields), the text two
64-bit hashes, i.e. 128 bits, and counts are aggregated on the hashes with map-side combining. A third, independent
64-bit hash and the length ride along as minimum and maximum: where they differ within a group two texts have collided,
and only those groups are grouped again by the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.urls import TRACKING_FIELDS, TRACKING_PREFIX
from assaykit.plans.runtime import cut_lineage, heavy_safe_join

#: What people write where there is no address.
STAND_INS = ("", "-", "--", "n/a", "na", "n.a", "none", "null", "nil", "nan", "unknown", "http", "https", "www", "http://", "https://", "tbd", "x", "?")

#: Fixed value: white space and punctuation that may enclose or end an address.
_AROUND = " \t\r\n\f\v\u00a0\u3000\u200b\ufeff\"'`<>()[]{}«»‹›“”„‘’.,;:!?…"


def _let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``; the expression tree stays linear wherever the optimizer copies it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _text(b: Column) -> Column:
    """Canonical text of an address that is already trimmed and in lower case; NULL if it has no dotted host."""

    def field(f: Column) -> Column:
        name = F.substring_index(f, "=", 1)
        return (f != "") & ~name.isin(*TRACKING_FIELDS) & ~name.startswith(TRACKING_PREFIX)

    def parts(rest: Column) -> Column:
        host = F.regexp_replace(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), r"^(?:.*@)?(?:www\.)?|\.*(?::\d*)?$", "")
        path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r";[^/]*$", ""), r"/+$|(?<=/)/+", "")
        query = F.when(rest.contains("?"), F.concat_ws("&", F.array_sort(F.filter(F.split(F.translate(F.regexp_extract(rest, r"\?(.*)$", 1), "+", " "), "&"), field)))).otherwise("")
        return _let(host, lambda h: F.when(h.rlike(r"^[^.\s]+(?:\.[^.\s]+)+$"), F.concat_ws("\x1f", h, path, query)))

    known = ~b.isin(*STAND_INS) & (~b.contains("://") | b.rlike(r"^https?://"))
    return F.when(known, _let(F.substring_index(F.regexp_replace(b, r"^https?:/+", ""), "#", 1), parts))


def hashed_addresses(df: DataFrame, key: str, address: str, table: str) -> DataFrame:
    """``table_name, row_id, canon, h1, h2, h3`` of the rows that have an address.

    Null, blank and stand-in addresses are left out. The rows come out of a generator, so no later filter copies the
    expression down to the scan.
    """
    bare = F.lower(F.btrim(F.coalesce(F.col(address), F.lit("")), F.lit(_AROUND)))
    found = F.explode(F.filter(F.array(_let(bare, _text)), lambda x: x.isNotNull())).alias("canon")
    rows = df.select(F.lit(table).alias("table_name"), F.col(key).cast("bigint").alias("row_id"), found)
    return rows.select("*", F.xxhash64("canon").alias("h1"), F.xxhash64(F.lit(7919), "canon").alias("h2"), F.xxhash64(F.lit(104729), F.reverse("canon")).alias("h3"))


def address_groups(hashed: DataFrame) -> DataFrame:
    """``table_name, h1, h2, kept_id, n, collided``: one row a 128-bit hash, combined map-side before the shuffle."""
    return hashed.groupBy("table_name", "h1", "h2").agg(
        F.min("row_id").alias("kept_id"),
        F.count(F.lit(1)).alias("n"),
        ((F.min("h3") != F.max("h3")) | (F.min(F.length("canon")) != F.max(F.length("canon")))).alias("collided"),
    )


def address_copies(hashed: DataFrame, heavy: int = 100_000) -> DataFrame:
    """``table_name, kept_id, copy_id`` for each row that has a smaller row id of the same address in its table.

    Null and blank addresses are no cases, tables without rows give none, and ties cannot occur, as row ids are unique.
    Groups of any size are safe: the row with the smallest id comes from the aggregate, and hot groups reach their rows
    by broadcast of (hash, smallest id).
    """
    hashed = cut_lineage(hashed)
    groups = cut_lineage(address_groups(hashed).filter("n > 1"))  # a collision needs two rows, too
    many = groups.filter("not collided").select("table_name", "h1", "h2", "kept_id", "n")
    out = heavy_safe_join(hashed.select("table_name", "h1", "h2", "row_id"), many, ["table_name", "h1", "h2"], "n", heavy)
    clashes = groups.filter("collided").select("table_name", "h1", "h2")
    apart = hashed.join(clashes, ["table_name", "h1", "h2"], "left_semi")
    exact = apart.groupBy("table_name", "canon").agg(F.min("row_id").alias("kept_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = apart.select("table_name", "canon", "row_id").join(exact, ["table_name", "canon"])
    both = out.select("table_name", "kept_id", "row_id").unionByName(again.select("table_name", "kept_id", "row_id"))
    return both.filter("row_id <> kept_id").select("table_name", "kept_id", F.col("row_id").alias("copy_id"))


def address_counts(hashed: DataFrame) -> DataFrame:
    """``table_name, address, kept_id, copies``: each address once with the number of its rows; collided hashes stay apart."""
    return hashed.groupBy("table_name", "h1", "h2", "h3", F.length("canon").alias("len")).agg(F.min_by("canon", "row_id").alias("address"), F.min("row_id").alias("kept_id"), F.count(F.lit(1)).alias("copies")).select("table_name", F.translate("address", "\x1f", " ").alias("address"), "kept_id", "copies")
