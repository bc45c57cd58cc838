"""Text to rows: evidence packs, search output, Markdown tables, HTML, JSON objects with slips."""

from __future__ import annotations

import ast
import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from assaykit.functions.urls import normalise_url, url_host

_MARK = "\x02"


def pack_sections(packs: DataFrame, key: str = "bundle_id", text: str = "text") -> DataFrame:
    """``key, pos, section, url, title, body``: one row a section (``## S<n>``) of a pack; native, no shuffle.

    Null and empty texts and texts without sections give no rows. The first URL and Title lines of a section count.
    """
    marked = F.regexp_replace(F.col(text), r"(?m)^## (S\d+)[ \t]*$", _MARK + "$1")
    parts = F.split(marked, _MARK)
    parts = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    rows = packs.filter(F.col(text).contains("## S")).select(key, F.posexplode(parts).alias("pos", "raw"))
    return rows.select(
        key,
        "pos",
        F.regexp_extract("raw", r"^(S\d+)", 1).alias("section"),
        F.regexp_extract("raw", r"(?m)^URL:[ \t]*(.*)$", 1).alias("url"),
        F.regexp_extract("raw", r"(?m)^Title:[ \t]*(.*)$", 1).alias("title"),
        F.regexp_replace("raw", r"^S\d+\n(?:URL:[^\n]*\n)?(?:Title:[^\n]*\n?)?", "").alias("body"),
    )


def search_urls(text: Column) -> Column:
    """Addresses of a search result: ``- **URL**:`` lines, then bare http(s), then bare www; distinct in this order."""
    listed = F.regexp_extract_all(text, F.lit(r"(?m)^- \*\*URL\*\*:\s*(\S+)"), F.lit(1))
    http = F.regexp_extract_all(text, F.lit(r"https?://[^\s<>\"\]|]+"), F.lit(0))
    www = F.regexp_extract_all(text, F.lit(r"(?<![/\w.])www\.[^\s<>\"\]|]+"), F.lit(0))
    clean = F.transform(F.concat(listed, http, www), lambda u: normalise_url(F.regexp_replace(u, r"[.,;:!?'\"]+$", "")))
    return F.array_distinct(F.filter(clean, lambda u: u != ""))


def search_sections(results: DataFrame, key: str, text: str, limit: int = 10) -> DataFrame:
    """``key, pos, block, url``: blocks that start with ``### n.``, hold an address and 80 characters; the first ``limit``."""
    blocks = F.filter(F.split(F.col(text), r"(?m)(?=^### \d+\.)"), lambda b: b.startswith("### ") & (F.length(b) >= 80) & (F.size(search_urls(b)) > 0))
    return results.select(key, F.posexplode(F.slice(blocks, 1, limit)).alias("pos", "block")).withColumn("url", F.element_at(search_urls(F.col("block")), 1))


def query_sections(results: DataFrame, key: str, text: str, slots: list[str]) -> DataFrame:
    """``key, slot, body``: sections ``## Query n:`` paired with the slot names by their order."""
    parts = F.filter(F.split(F.col(text), r"(?m)(?=^## Query \d+:)"), lambda b: b.startswith("## Query "))
    pairs = F.arrays_zip(F.slice(F.array(*[F.lit(s) for s in slots]), F.lit(1), F.size(parts)).alias("slot"), F.slice(parts, 1, len(slots)).alias("body"))
    return results.select(key, F.explode(pairs).alias("x")).select(key, "x.slot", "x.body").filter("slot is not null and body is not null")


def markdown_table(lines: DataFrame, columns: list[str], text: str = "value") -> DataFrame:
    """Rows of a Markdown table with these columns; honours ``\\|``, drops bold marks, heading and rule lines.

    The first column must be a number, given as a bigint; other lines are left out.
    """
    cells = F.transform(F.split(F.regexp_replace(F.col(text), r"^\s*\||\|\s*$", ""), r"(?<!\\)\|"), lambda c: F.replace(F.regexp_replace(F.trim(c), r"\*\*", ""), F.lit("\\|"), F.lit("|")))
    rows = lines.filter(F.col(text).rlike(r"^\s*\|")).select(cells.alias("c")).filter((F.size("c") == len(columns)) & F.col("c")[0].rlike(r"^\d+$"))
    return rows.select(F.col("c")[0].cast("bigint").alias(columns[0]), *[F.col("c")[i].alias(n) for i, n in enumerate(columns[1:], 1)])


def pack_urls(text: Column) -> Column:
    """Addresses of the URL: lines of a pack, distinct in their order; empty for null."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?m)^URL:[ \t]*(\S.*)$"), F.lit(1)), lambda x: F.rtrim(x)), lambda x: x != ""))


def table_rows(sections: DataFrame, keys: list[str], body: str = "body", width: int = 3) -> DataFrame:
    """``keys, pos, cells``: rows of Markdown tables of ``width`` columns inside texts; heading and rule lines stay out.

    A heading is a row without any digit-only cell; cells keep their order.
    """
    lines = sections.select(*keys, F.posexplode(F.split(F.col(body), "\n")).alias("pos", "line")).filter(F.col("line").rlike(r"^\|.*\|\s*$"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|\s*$", ""), r"(?<!\\)\|"), lambda c: F.trim(c))
    rows = lines.select(*keys, "pos", cells.alias("cells")).filter(F.size("cells") == width)
    return rows.filter(F.exists("cells", lambda c: c.rlike(r"^\d+([.,]\d+)?$")))


#: Elements whose text nobody sees; most texts before a link, and characters of them, that make its context; characters of a heading.
UNSEEN = frozenset(("script", "style", "noscript", "svg"))
CONTEXT_TEXTS, CONTEXT_CHARS, HEADING_CHARS = 6, 300, 240


class _Events(HTMLParser):
    """What a page consists of, in order: ``(kind, name or words, address)``; kinds are open, close and words."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.seen: list[tuple[str, str, str | None]] = []

    def handle_starttag(self, tag, attrs):
        self.seen.append(("open", tag, dict(attrs).get("href")))

    def handle_endtag(self, tag):
        self.seen.append(("close", tag, None))

    def handle_data(self, data):
        if words := " ".join(data.split()):
            self.seen.append(("words", words, None))


def _heading(tag: str) -> bool:
    return len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"


def page_parts(html: str) -> tuple[str, list[str], list[dict[str, str]]]:
    """Title, visible texts and links ``url, title, heading, context`` of a page; a link counts once it is closed."""
    events = _Events()
    events.feed(html)
    events.close()
    hidden, place = 0, ""
    parts: dict[str, list[str]] = {"title": [], "heading": [], "link": []}
    texts: list[str] = []
    links: list[dict[str, str]] = []
    link: dict[str, str] | None = None
    for kind, name, address in events.seen:
        if kind == "words":
            if hidden:
                continue
            if place:
                parts[place].append(name)
            if place == "title":
                continue
            if link is not None:
                parts["link"].append(name)
            texts.append(name)
        elif name in UNSEEN:
            hidden = hidden + 1 if kind == "open" else max(0, hidden - 1)
        elif name == "title" or _heading(name):
            place = ("title" if name == "title" else "heading") if kind == "open" else ""
            if place == "heading":
                parts["heading"] = []
        elif name == "a" and kind == "open" and address:
            link = {"url": address, "heading": " ".join(parts["heading"])[:HEADING_CHARS], "context": " ".join(texts[-CONTEXT_TEXTS:])[-CONTEXT_CHARS:]}
            parts["link"] = []
        elif name == "a" and kind == "close" and link is not None:
            links.append(link | {"title": " ".join(parts["link"])})
            link = None
    return " ".join(parts["title"]), texts, links


_LINK = StructType([StructField(n, StringType()) for n in ("url", "title", "heading", "context")])
_PAGE = StructType([StructField("title", StringType()), StructField("text", StringType()), StructField("links", ArrayType(_LINK))])


@F.pandas_udf(_PAGE)
def html_extract(html: pd.Series, base: pd.Series) -> pd.DataFrame:
    """Title, visible text and absolute links of a page; empty for null. Scripts, styles and drawings are left out."""
    out = []
    for h, b in zip(html, base):
        title, texts, links = page_parts(h or "")
        out.append({"title": title, "text": "\n".join(texts), "links": [x | {"url": urljoin(b or "", x["url"])} for x in links]})
    return pd.DataFrame(out, columns=["title", "text", "links"])


def site_links(pages: DataFrame, key: str, html: str, base: str) -> DataFrame:
    """``key, pos, url, title``: links of a page that stay on its host or below it."""
    parsed = pages.select(key, F.regexp_replace(url_host(F.col(base)), r"^www\.", "").alias("_host"), html_extract(html, base).alias("p"))
    links = parsed.select(key, "_host", F.posexplode("p.links").alias("pos", "x")).select(key, "_host", "pos", "x.url", "x.title")
    h = url_host(F.col("url"))
    return links.filter((h == F.col("_host")) | F.endswith(h, F.concat(F.lit("."), F.col("_host")))).drop("_host")


def _inner_quotes(text: str) -> str:
    """Escape quotes inside strings: a quote closes a string only ahead of what may follow a string."""
    out, inside, i = [], False, 0
    while i < len(text):
        c = text[i]
        if c == "\\" and inside:
            out.append(text[i : i + 2])
            i += 2
            continue
        if c == '"':
            if not inside:
                inside = True
            elif re.match(r'\s*(?:$|[:}\]]|,\s*(?:$|["{\[}\]\-0-9]))', text[i + 1 :]):
                inside = False
            else:
                c = '\\"'
        out.append(c)
        i += 1
    return "".join(out)


def parse_object(raw: str | None) -> tuple[str | None, str, str | None]:
    """``(json, strategy, error)`` for the one object in ``raw``: fenced or bare, strict, then repaired step by step."""
    fences = re.findall(r"```json\s*(.*?)```", raw or "", flags=re.S)
    if len(fences) > 1:
        return None, "none", "more than one fenced object"
    body = (fences[0] if fences else raw or "").strip()
    commas = re.sub(r",(\s*[}\]])", r"\1", body)
    for strategy, read in (("strict", lambda: json.loads(body)), ("commas", lambda: json.loads(commas)), ("quotes", lambda: json.loads(_inner_quotes(commas))), ("literal", lambda: ast.literal_eval(body))):
        try:
            value = read()
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
        if isinstance(value, dict):
            return json.dumps(value, ensure_ascii=False), strategy, None
        return None, strategy, "not an object"
    return None, "none", "no object"


@F.pandas_udf(StructType([StructField(n, StringType()) for n in ("json", "strategy", "error")]))
def json_object(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_object(x) for x in raw], columns=["json", "strategy", "error"], dtype="object")


__all__ = ["html_extract", "json_object", "markdown_table", "pack_sections", "pack_urls", "page_parts", "parse_object", "query_sections", "search_sections", "search_urls", "site_links", "table_rows"]
