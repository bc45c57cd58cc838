"""Fields for display and requests for entry: bounded texts, numbers, lists, addresses, closed field sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaykit.plans.runtime import ws_trim


def bounded_text(c: Column, limit: int) -> Column:
    """A scalar as trimmed text of at most ``limit`` characters; '' for null."""
    return F.left(ws_trim(F.coalesce(c.cast("string"), F.lit(""))), F.lit(limit))


def bounded_list(c: Column, limit: int, item_limit: int) -> Column:
    """The first ``limit`` items as bounded texts, empty ones left out; an empty list for null."""
    items = F.coalesce(c, F.array().cast("array<string>"))
    return F.slice(F.filter(F.transform(items, lambda x: bounded_text(x, item_limit)), lambda x: x != ""), 1, limit)


def finite_number(c: Column) -> Column:
    """A number of two decimals; null for what is no finite number."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.round(x, 2))


def bounded_score(c: Column) -> Column:
    return F.when(c.between(0, 100), c)


def http_url(c: Column, limit: int = 2000) -> Column:
    """An http(s) address on one line of at most ``limit`` characters, else ''."""
    t = ws_trim(F.coalesce(c, F.lit("")))
    return F.when(t.rlike(r"^https?://[^\s]+$") & (F.length(t) <= limit), t).otherwise("")


def unknown_fields(body: Column, known: list[str]) -> Column:
    """Names of the fields of a JSON object that are not among ``known``; an empty list where there is no object."""
    return F.array_except(F.coalesce(F.json_object_keys(body), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in known]))


def named(name: Column, limit: int) -> Column:
    """True for a name of 1 to ``limit`` characters."""
    return F.length(ws_trim(F.coalesce(name, F.lit("")))).between(1, limit)


def text_values(structs: Column) -> Column:
    """All texts of an array of structs of texts, field by field in their order; nulls and empty texts are left out."""
    flat = F.flatten(F.transform(F.coalesce(structs, F.array().cast("array<struct<id:string,url:string,title:string>>")), lambda x: F.array(x["id"], x["url"], x["title"])))
    return F.filter(flat, lambda x: x.isNotNull() & (x != ""))


def same_shape(body: Column, template: str) -> Column:
    """True if a JSON object has exactly the fields of ``template`` and each holds a value of the template's type."""
    fields = [tuple(x.strip().split(" ")) for x in template.split(",")]
    forms = {"string": r'^".*"$', "bigint": r"^-?\d+$", "double": r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"}
    values = F.from_json(body, "map<string,string>")
    typed = F.from_json(body, ", ".join(f"{n} {t}" for n, t in fields), {"mode": "PERMISSIVE"})
    ok = F.array_sort(F.map_keys(values)) == F.array(*[F.lit(n) for n in sorted(n for n, _ in fields)])
    for n, t in fields:
        one = typed[n].isNotNull() if t == "string" else values[n].rlike(forms[t])
        ok = ok & one
    return F.coalesce(ok, F.lit(False))
