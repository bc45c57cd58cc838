"""Problems 2 and 5: the main body of each page section, and sections or titles that hold residue instead.

One Arrow pass over the packs parts each text into sections and lines, labels the lines by a minimum cut with costs of the
fitted line model, and emits one row a section: its furniture lines, and the lines that may stand in the place of a body.
The latter are mined into templates with a prefix tree of fixed depth (number of words, first words; lines of a leaf that
agree with its most frequent words are one template). A template is a message if its lines sound like one, by known wordings
and by a model of words fitted to them, and if it stands alone where a body should be. Each template gets its verdict once; verdicts travel back to sections and titles by
equi-joins on the tree's leaf.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.mincut import min_cut
from assaykit.llm.line_model import LineModel, MessageModel, Place, fit, fit_messages, shape, size
from assaykit.llm.page_lines import seed
from assaykit.llm.residue import LONGEST, has_open_slot, is_bad_part, is_message, lorem_like, title_parts
from assaykit.llm.textforms import words_of
from assaykit.plans.runtime import BROADCAST_ROWS, at_most, cut_lineage, heavy_safe_join

#: Weights of the smoothness edges: neighbours of one form, bare words and what follows them, other neighbours, next but one; share of it across a blank line.
SAME, LEADS, OTHER, BLOCK, ACROSS = 1.5, 1.5, 0.8, 0.4, 0.3
#: Packs at most to which the line model is fitted.
FIT_PACKS = 800
#: Prefix tree: words that lead to a leaf after the number of words, most words of a line that merges with others, share of words in which it must agree.
DEPTH, MOST_WORDS, AGREE = 2, 40, 0.5
#: A section is lone if its content, messages aside, has at most this size; a template is a message if so large a share of it stands in lone sections, and they sound so much like one there on average.
LONE, LONE_SHARE, SOUNDS = 160, 0.5, 0.2
#: Cost below which a line is furniture for sure.
SURE = -3.0

_HEAD = re.compile(r"^## (S\d+)\s*$")
_COMPANY = re.compile(r"^Company:\s*(.*\S)\s*$")

SECTION_DDL = "bundle_id bigint, section string, furniture array<int>, lone boolean, leaf array<string>, line array<string>, score array<double>, mark array<int>"
_ARROW = pa.schema([("bundle_id", pa.int64()), ("section", pa.string()), ("furniture", pa.list_(pa.int32())), ("lone", pa.bool_()), ("leaf", pa.list_(pa.string())), ("line", pa.list_(pa.string())), ("score", pa.list_(pa.float64())), ("mark", pa.list_(pa.int32()))])
#: Bits of ``mark``: content by the cut, an open slot, a message by its wording.
CONTENT, SLOTTED, WORDED = 1, 2, 4
_SCRIPTS = re.compile(r"(?i)\bscript(?:s|ing)?\b|javascript|\bjs\b")


@lru_cache(maxsize=20_000)
def leaf_of(line: str) -> tuple[str, str]:
    """Leaf of the prefix tree, and the line as words parted by blanks: lower case, without numbers.

    Lines of more than ``MOST_WORDS`` words have a leaf each, by a hash of all their words.
    """
    words = words_of(line)
    text = " ".join(words)
    if len(words) > MOST_WORDS:
        return "long", blake2b(text.encode(), digest_size=12).hexdigest()
    return f"{len(words)}|{' '.join(words[:DEPTH])}", text


def sections(text: str) -> Iterator[tuple[str, str, list[tuple[int, str]]]]:
    """``(section, brand, lines with numbers)`` of a pack; URL and Title lines right after the head are left out."""
    brand, section, lines, head = "", None, [], 0
    for no, line in enumerate(text.split("\n"), 1):
        m = _HEAD.match(line) if line.startswith("## S") else None
        if m:
            if section:
                yield section, brand, lines
            section, lines, head = m[1], [], no
        elif section is None:
            c = _COMPANY.match(line)
            if c:
                brand = c[1]
        elif not (no - head <= 2 and (line.startswith("URL:") or line.startswith("Title:"))):
            lines.append((no, line))
    if section:
        yield section, brand, lines


def _brand_words(company: str) -> tuple[str, ...]:
    return tuple(w for w in re.findall(r"[^\W\d_]{4,}", company)[:3])


def placed(lines: list[tuple[int, str]], company: str) -> tuple[list[tuple[int, str, bool]], list[Place]]:
    """``(number, line, blank line above)`` of the non-blank lines of a section, and their places."""
    nodes, gap = [], True
    for no, line in lines:
        if line.strip():
            nodes.append((no, line, gap))
            gap = False
        else:
            gap = True
    brand, n = _brand_words(company), len(nodes)
    blocks, start = [0] * n, 0
    for i in range(1, n + 1):
        if i == n or nodes[i][2]:
            blocks[start:i] = [i - start] * (i - start)
            start = i
    return nodes, [(min(i, 6), min(n - 1 - i, 6), min(blocks[i], 4), len(x[1]) < 90 and any(map(x[1].__contains__, brand))) for i, x in enumerate(nodes)]


def smoothness(nodes: list[tuple[int, str, bool]]) -> list[tuple[int, int, float]]:
    """Edges of a section: neighbours, tighter if they have the same form, looser across a blank line; next but one in a block of one form."""
    out, forms = [], [shape(line) for _, line, _ in nodes]
    for i in range(1, len(nodes)):
        weight = SAME if forms[i] == forms[i - 1] else LEADS if forms[i - 1] in ("words", "heading") else OTHER
        out.append((i - 1, i, weight * ACROSS if nodes[i][2] else weight))
        if i > 1 and not nodes[i][2] and not nodes[i - 1][2] and forms[i] == forms[i - 2]:
            out.append((i - 2, i, BLOCK))
    return out


def labelled(lines: list[tuple[int, str]], company: str, model: LineModel | None = None) -> list[tuple[int, str, float, bool]]:
    """``(number, line, cost, content)`` of the non-blank lines of a section by the minimum cut."""
    model = model or LineModel()
    nodes, places = placed(lines, company)
    costs = [model.cost(line, place) for (_, line, _), place in zip(nodes, places)]
    return [(n[0], n[1], c, x) for n, c, x in zip(nodes, costs, min_cut(costs, smoothness(nodes)))]


def fitted(texts: Iterable[str]) -> tuple[LineModel, MessageModel]:
    """The models of lines and messages of some packs."""
    found, edges = [], []
    for text in texts:
        for _, company, lines in sections(text):
            nodes, places = placed(lines, company)
            found.append([(line, place) for (_, line, _), place in zip(nodes, places)])
            edges.append(smoothness(nodes))
    at = {id(x): e for x, e in zip(found, edges)}

    def cut(model: LineModel, section: list[tuple[str, Place]]) -> list[float]:
        costs = [model.cost(line, place) for line, place in section]
        return [0.5 if is_message(line) else float(x) for (line, _), x in zip(section, min_cut(costs, at[id(section)]))]

    model = fit(found, cut)
    others = []
    for section in found:
        if sum(size(line.strip()) for (line, _), y in zip(section, cut(model, section)) if y == 1.0) > LONE:
            others.extend(line for line, _ in section)
    return model, fit_messages((line for section in found for line, _ in section if is_message(line)), (x for x in others if not is_message(x)))


def line_models(packs: DataFrame, most: int = FIT_PACKS) -> tuple[LineModel, MessageModel]:
    """Both models, fitted to at most ``most`` packs, chosen by hash, in one task; their weights are as bounded as the sample."""
    texts = packs.filter(F.length("text") > 0).select("bundle_id", "text")
    n = texts.count()
    if n > most:
        texts = texts.filter(F.pmod(F.xxhash64("bundle_id"), F.lit(1_000_000)) < F.lit(1_000_000 * most // n)).limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = fitted([t for batch in batches for t in batch.column(0).to_pylist()])
        rows = [(k, f, w) for k, m in enumerate(models) for f, w in m.weights.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], names=["model", "feature", "weight"])

    got = texts.select("text").coalesce(1).mapInArrow(run, "model int, feature string, weight double").collect()
    return LineModel({r["feature"]: r["weight"] for r in got if r["model"] == 0}), MessageModel({r["feature"]: r["weight"] for r in got if r["model"] == 1})


def body_units(rows: list[tuple[int, str, float, bool]], messages: MessageModel) -> tuple[bool, list[tuple[str, str, float, int]]]:
    """Whether the section is lone, and its units: leaf, line, how much it sounds like a message (asked in lone sections only), mark.

    A section with a line of content longer than any known wording, and no filler, has a body whatever stands beside it; its
    other lines are not asked for wording and slots, they count for their templates only.
    """
    if any(content and len(line) > LONGEST and not lorem_like(line) for _, line, _, content in rows):
        return False, [(*leaf_of(line), 0.0, CONTENT * content) for _, line, cost, content in rows if content or cost > SURE]
    units, left = [], 0
    for _, line, cost, content in rows:
        worded, slotted = is_message(line), has_open_slot(line)
        if content and not worded and not slotted:
            left += size(line.strip())
        if content or cost > SURE or worded or slotted or _SCRIPTS.search(line) and seed(line) == 0:
            units.append((line, worded, CONTENT * (content and not worded) + SLOTTED * slotted + WORDED * worded))
    lone = left <= LONE
    return lone, [(*leaf_of(line), (1.0 if worded else messages.score(line)) if lone else 0.0, mark) for line, worded, mark in units]


def parsed(packs: DataFrame, most: int = FIT_PACKS) -> DataFrame:
    """One row a section of ``packs(bundle_id, text)``; null and empty texts and texts without sections give none."""
    lines_, messages_ = (m.weights for m in line_models(packs, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, messages = LineModel(lines_), MessageModel(messages_)
        for batch in batches:
            out: list[list] = [[] for _ in _ARROW]
            for bundle, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                for section, company, lines in sections(text):
                    rows = labelled(lines, company, model)
                    lone, units = body_units(rows, messages)
                    for column, x in zip(out, (bundle, section, [no for no, _, _, content in rows if not content], lone, *([u[k] for u in units] for k in range(4)))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _ARROW)], schema=_ARROW)

    return packs.select(F.col("bundle_id").cast("bigint").alias("bundle_id"), "text").mapInArrow(run, SECTION_DDL)


def _met(rows: DataFrame, mapping: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """Join with a mapping of one row a key: by broadcast if it is proven small, else by a join that parts hot keys."""
    if at_most(mapping, BROADCAST_ROWS):
        return rows.join(F.broadcast(mapping), keys, how)
    return heavy_safe_join(rows, mapping, keys, count, how=how)


def _agree(line: Column, template: Column) -> Column:
    """Share of a line's words that its leaf's template has at the same place."""
    return F.size(F.filter(F.zip_with(F.split(line, " "), template, lambda a, b: F.equal_null(a, b)), lambda x: x)) / F.size(template)


def message_templates(units: DataFrame) -> DataFrame:
    """``leaf, line, template, n, lone``: lines of messages, with their leaf's template (null for lines that are one by themselves).

    ``units(leaf, line, score, mark, lone)``, one row an occurrence. The template of a leaf has at each place the word most frequent in
    lone sections; lines that agree with it are one template, any other line is one by itself. Ties go to the greater word.
    """
    lines = units.filter(F.col("mark").bitwiseAND(SLOTTED) == 0).groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("lone").cast("int")).alias("lone"), F.sum(F.when(F.col("lone"), F.col("score")).otherwise(0.0)).alias("said"))
    lines = cut_lineage(lines)
    # Leaves that never stood alone and hold no message by wording give none.
    words = lines.filter("lone > 0 and leaf <> 'long'").select("leaf", "lone", F.posexplode(F.split("line", " ")).alias("pos", "word"))
    words = words.groupBy("leaf", "pos", "word").agg(F.sum("lone").alias("k")).groupBy("leaf", "pos").agg(F.max_by("word", F.struct("k", "word")).alias("word"))
    templates = words.groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("template"))
    templates = templates.join(lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows")), "leaf")
    merged = _met(lines, cut_lineage(templates), ["leaf"], "rows", how="left").drop("rows")
    merged = merged.withColumn("template", F.when(_agree(F.col("line"), F.col("template")) >= AGREE, F.col("template"))).withColumn("key", F.when(F.col("template").isNull(), F.col("line")))
    total = merged.groupBy("leaf", "key").agg(F.sum("n").alias("seen"), F.sum("lone").alias("alone"), F.sum("said").alias("said"), F.count(F.lit(1)).alias("rows"))
    bad = total.filter((F.col("alone") > 0) & (F.col("said") >= SOUNDS * F.col("alone")) & (F.col("alone") >= LONE_SHARE * F.col("seen"))).withColumn("key", F.coalesce("key", F.lit("")))
    marked = merged.withColumn("key", F.coalesce("key", F.lit("")))
    return _met(marked, cut_lineage(bad.select("leaf", "key", "rows")), ["leaf", "key"], "rows").select("leaf", "line", "template", "n", "lone")


def section_units(parts: DataFrame) -> DataFrame:
    return parts.select("bundle_id", "section", "lone", F.explode(F.arrays_zip("leaf", "line", "score", "mark")).alias("b")).select("bundle_id", "section", "lone", "b.leaf", "b.line", "b.score", "b.mark")


def residue_sections(parts: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """``bundle_id, section`` of sections in whose place of a main body stand only messages, filler or open slots."""
    units = section_units(parts)
    messages = message_templates(units) if messages is None else messages
    bad = messages.select("leaf", "line", "n", F.lit(True).alias("message"))
    judged = _met(units, cut_lineage(bad), ["leaf", "line"], "n", how="left").withColumn("out", (F.col("mark").bitwiseAND(SLOTTED) > 0) | F.col("message").isNotNull())
    real = ~F.col("out") & (F.col("mark").bitwiseAND(CONTENT) > 0)
    per = judged.groupBy("bundle_id", "section").agg(F.sum(F.col("out").cast("int")).alias("n_out"), F.sum(real.cast("int")).alias("n_real"))
    return per.filter("n_out > 0 and n_real = 0").select("bundle_id", "section")


def furniture_lines(parts: DataFrame) -> DataFrame:
    """``bundle_id, line_no`` of furniture in sections that are no residue."""
    good = parts.join(residue_sections(parts), ["bundle_id", "section"], "left_anti")
    return good.select("bundle_id", F.explode("furniture").alias("line_no")).select("bundle_id", F.col("line_no").cast("bigint").alias("line_no"))


def residue_titles(rows: DataFrame, key: str, title: str, messages: DataFrame | None = None) -> DataFrame:
    """``row_id`` of rows whose title is a message, filler, a default or an open slot; null and blank titles are none.

    Distinct titles fall into parts, parts go down the same prefix tree as the lines of sections. The wording of a part is
    judged once for all titles that have it; a part that fits a template of ``messages`` is one as well.
    """

    @F.pandas_udf("array<struct<leaf:string,line:string,bad:boolean>>")
    def parts(t: pd.Series) -> pd.Series:
        def one(x: str) -> list[dict]:
            every = dict.fromkeys([x.strip(), *title_parts(x)])
            return [dict(zip(("leaf", "line"), leaf_of(p)), bad=is_bad_part(p)) for p in every]

        return t.map(one)

    asked = rows.select(F.col(key).cast("bigint").alias("row_id"), F.col(title).alias("title")).filter(F.col("title").rlike(r"\S"))
    titles = asked.groupBy("title").agg(F.count(F.lit(1)).alias("n"))
    found = cut_lineage(titles.select("title", "n", F.explode(parts("title")).alias("p")).select("title", "n", "p.*"))
    bad = found.filter("bad").select("title", "n")
    if messages is not None:
        # Each different part meets the templates once.
        once = found.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("rows"))
        templates = messages.filter("template is not null").groupBy("leaf").agg(F.first("template").alias("template"))  # one a leaf
        fits = once.join(templates, "leaf").filter(_agree(F.col("line"), F.col("template")) >= AGREE).select("leaf", "line", "rows")
        same = once.join(messages.filter("template is null and leaf <> 'long'").select("leaf", "line"), ["leaf", "line"], "left_semi")
        hit = cut_lineage(fits.unionByName(same).distinct())
        bad = bad.unionByName(_met(found, hit, ["leaf", "line"], "rows").select("title", "n"))
    return _met(asked, cut_lineage(bad.distinct()), ["title"], "n").select("row_id")


__all__ = ["furniture_lines", "labelled", "leaf_of", "message_templates", "parsed", "residue_sections", "residue_titles", "section_units", "sections"]
