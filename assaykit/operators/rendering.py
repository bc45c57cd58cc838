"""Rows to Markdown and HTML: bullets, links of cited sources, reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaykit.functions.text import html_escape, markdown_link
from assaykit.plans.runtime import ws_trim

#: Fixed value: what stands between links of sources.
BETWEEN = "；"


def bullets(columns: dict[str, str]) -> Column:
    """``- **Label**: value`` lines; blank values are left out."""
    lines = []
    for c, label in columns.items():
        value = ws_trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
        lines.append(F.when(value != "", F.concat(F.lit(f"- **{label}**: "), value)))
    return F.concat_ws("\n", *lines)


def evidence_links(sources: Column, ids: Column, html: bool = False) -> Column:
    """Links of the sources with these ids, in the order of the ids; ids without a source are left out, the first of equal ids counts."""

    def link(i: Column) -> Column:
        x = F.element_at(F.filter(sources, lambda s: s["id"] == i), 1)
        if not html:
            return markdown_link(x["title"], x["url"])
        label = html_escape(F.coalesce(F.nullif(x["title"], F.lit("")), x["url"], F.lit("")))
        return F.when(x["url"].rlike(r"^https?://"), F.concat(F.lit('<a href="'), html_escape(x["url"]), F.lit('">'), label, F.lit("</a>"))).otherwise(label)

    known = F.filter(ids, lambda i: F.exists(F.coalesce(sources, F.array().cast("array<struct<id:string,url:string,title:string>>")), lambda s: s["id"] == i))
    return F.array_join(F.transform(known, link), BETWEEN)


def report(company: Column, lines: Column) -> Column:
    """A report: heading, table head, the lines of directions."""
    return F.concat(F.lit("# "), F.coalesce(company, F.lit("")), F.lit("\n\n| Product | Priority |\n| --- | --- |\n"), F.array_join(lines, "\n"))
