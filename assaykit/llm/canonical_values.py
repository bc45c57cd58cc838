"""Problem 1: free-entered values to entries of a reference list.

Distinct values meet the list (its names and known other writings) in a prefix-filtered set-similarity join on
unordered letter pairs; Jaccard is verified exactly, then an edit-distance check accepts or refuses each candidate, and
the best entry is kept. Values that fit none, or two entries alike, are reported with entry 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from math import prod
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.setjoin import in_rarity_order, jaccard, may_reach, rarity, with_prefix
from assaykit.llm.textforms import fold, osa, pair_grams, words
from assaykit.plans.runtime import bounded_broadcast, cut_lineage, heavy_safe_join

DATA = Path(__file__).parent / "data"

#: Combinations of readings of shortened words up to which all are looked up; a value with more has its unambiguous words read only.
READINGS = 64

#: Remarks that stand beside a value and do not change what it names.
_REMARKS = re.compile(
    r"\(?\bimported\)?|\(进口\)|进口|[a-z]级|\bor equivalent\b|\bfor trial\b|\bexw\b|\bgrade [a-z]\b|\btype [ivx]+\b|\bapprox\.?|\bca\.|"
    r"\b\d+(?:[.,]\d+)?\s*(?:-\s*\d+(?:[.,]\d+)?\s*)?(?:t/month|mm|kg bags|kg|t)\b|\b\d+\s*[#%]|\b\d{2,3}#|\bbased in\b|\bplant:|,?\s*\bhq\b"
)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_LEET = re.compile(r"(?<=[a-z])1|1(?=[a-z])")
_LEET0 = re.compile(r"(?<=[a-z])0(?=[a-z])")
_FILLER = {"the", "of", "and", "for", "in", "la", "de", "en", "rep", "republic"}


_APART = {"north", "south", "east", "west", "new", "or", "and", "oder", "o", "und", "y"}


def _within(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


@lru_cache(maxsize=50_000)
def readings(word: str, known: frozenset[str]) -> tuple[str, ...]:
    """Words of the list that a word may be short for: the same beginning and its letters in their order. A word of the list stands for itself."""
    if word in known or len(word) < 3:
        return (word,)
    shorter = 1 if not re.search("[aeiou]", word) else 2
    found = tuple(sorted(v for v in known if v[0] == word[0] and len(v) >= len(word) + shorter and (v.startswith(word) or shorter == 1 and _within(word, v))))
    return found or (word,)


@lru_cache(maxsize=100_000)
def forms(value: str, places: bool = False, known: frozenset[str] = frozenset()) -> tuple[tuple[int, tuple[str, ...]], ...]:
    """``(level, words)`` under which a value is looked up.

    Level 0: as it stands; 1: without remarks; 2: its parts at / ( ) , dashes and between scripts; 3, only
    for ``places``: its first or last words, as a town may stand beside the country. Lower levels go first. Words that may be
    short for some of ``known``, the words of the list, are looked up in each reading as well.
    """
    value = value.strip()
    camel = _CAMEL.sub(" ", value) if re.fullmatch(r"(?:[A-Z][a-z]+){2,}", value) else value
    out: list[tuple[int, tuple[str, ...]]] = []

    def add(text: str, level: int) -> None:
        text = _LEET0.sub("o", _LEET.sub("i", re.sub(r"(?<=\b[a-z])\.(?=[a-z]\b|$|\s|\))", "", text)))
        w = tuple(x for x in words(text) if x)
        w = tuple(x for x in w if x not in _FILLER) or w
        each = [readings(x, known) for x in w]
        if prod(map(len, each)) > READINGS:
            each = [r if len(r) == 1 else (x,) for r, x in zip(each, w)]
        for read in dict.fromkeys([w, *product(*each)]):
            if read and all(read != x for _, x in out):
                out.append((level, read))

    text = fold(camel)
    add(text, 0)
    plain = _REMARKS.sub(" ", text)
    add(plain, 1)
    parts = [p for p in re.split(r"[/(),]|\s-\s|\s+(?=[一-鿿])|(?<=[一-鿿])\s+", plain) if p.strip()]
    if len(parts) > 1:
        for p in parts:
            add(p, 2)
    tail = plain.split()
    if places and 2 <= len(tail) <= 5:
        for k in range(1, min(4, len(tail))):
            for kept, gone in ((tail[-k:], tail[:-k]), (tail[:k], tail[k:])):
                if not _APART & set(gone):
                    add(" ".join(kept), 3)
    return tuple(out)


def close(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    """Edit distance of two word lists in any order, 9 if they are not the same thing written differently.

    One slip a value, two in long values, never two in one word; codes of up to three letters must be equal.
    """
    x, y = "".join(a), "".join(b)
    if x == y or sorted(a) == sorted(b):
        return 0
    short = min(len(x), len(y))
    if short <= 3 or any("一" <= c <= "鿿" for c in x + y):
        return 9
    whole = osa(x, y, 1)
    best = whole if whole <= 1 else 9
    if len(a) == len(b) and best:
        total, rest = 0, list(b)
        for w in a:
            d, k = min((osa(w, v, 1), i) for i, v in enumerate(rest))
            if d > 1 or d == 1 and min(len(w), len(rest[k])) < 3:
                total = 9
                break
            total += d
            rest.pop(k)
        best = min(best, total)
    return best if best <= (1 if short < 9 else 2) else 9


def reference(spark, entries: DataFrame, id_col: str, name_cols: list[str], kind: str) -> DataFrame:
    """``entry_id, form, other`` of a list: its names in all columns and the other writings known for an entry's name.

    The list is fixed and small; other writings come from ``data/<kind>_writings.tsv`` (name, tab, writings parted by |).
    """
    known: dict[str, list[str]] = {}
    for line in (DATA / f"{kind}_writings.tsv").read_text(encoding="utf-8").splitlines():
        if line.strip() and not line.startswith("#"):
            name, _, other = line.partition("\t")
            known[name] = [x.strip() for x in other.split("|") if x.strip()]
    table = spark.createDataFrame([(k, v) for k, v in known.items()], "name string, writings array<string>")
    names = entries.select(F.col(id_col).cast("bigint").alias("entry_id"), F.explode(F.array(*name_cols)).alias("form"), F.lit(0).alias("other"))
    other = entries.select(F.col(id_col).cast("bigint").alias("entry_id"), F.col(name_cols[0]).alias("name")).join(F.broadcast(table), "name").select("entry_id", F.explode("writings").alias("form"), F.lit(1).alias("other"))
    return names.unionByName(other).filter(F.length(F.trim("form")) > 0).distinct()


def canonical_values(values: DataFrame, entries: DataFrame, t: float = 0.4, places: bool = False) -> DataFrame:
    """``value, n, entry_id, jaccard, slips`` for each row of ``values(value, n)`` (distinct values and their counts).

    ``entries(entry_id, form, other)`` is the reference list, ``other`` 1 for writings beside the list's own names. Of all
    candidates that pass the edit check the highest Jaccard wins, then the fewest slips, then own names;
    entry_id is 0 where no entry passes, where the best entries tie, and where parts of the value name different
    entries. Null and blank values must be filtered before. Empty tables give empty results; very long values fit
    nothing, as their sets fail the length filter.
    """

    # The list is fixed and small; words of four letters and more of its own names may be shortened in values.
    own = entries.filter("other = 0").select("form").collect() if not places else []
    known = frozenset(w for r in own for w in words(fold(r["form"])) if len(w) >= 4 and w.isascii())

    def struct_of(x: str) -> list[dict]:
        return [{"level": k, "words": " ".join(w), "tokens": pair_grams(sorted(w))} for k, w in forms(x, places, known)]

    @F.pandas_udf("array<struct<level:int,words:string,tokens:array<string>>>")
    def looked_up(v: pd.Series) -> pd.Series:
        return v.map(struct_of)

    @F.pandas_udf("int")
    def slips(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in pairs:
            yield pd.Series([close(tuple(x.split(" ")), tuple(y.split(" "))) for x, y in zip(a, b)], dtype="int32")

    # Few bytes but much work a row: a fixed number of partitions, which is not coalesced again.
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = cut_lineage(values.select("value").repartition(tasks, "value").select("value", F.explode(looked_up("value")).alias("f")).select("value", "f.level", "f.words", "f.tokens"))
    r = cut_lineage(entries.select("entry_id", "other", F.element_at(looked_up("form"), 1).alias("f")).groupBy("entry_id", "f").agg(F.min("other").alias("other")).select("entry_id", "other", F.col("f.words").alias("rwords"), F.col("f.tokens").alias("rtokens")))
    v = asked.groupBy("words").agg(F.min(F.struct("words", "tokens"))["tokens"].alias("tokens"))
    df = cut_lineage(rarity(v.select("tokens").unionByName(r.select(F.col("rtokens").alias("tokens")))))
    vo = cut_lineage(in_rarity_order(v, df, "words"))
    ro = in_rarity_order(r.select("rwords", F.col("rtokens").alias("tokens")).distinct(), df, "rwords")
    vp = with_prefix(vo, "words", t)
    rp = with_prefix(ro, "rwords", t).select("rwords", F.col("n").alias("rn"), F.col("pos").alias("rpos"), "token")
    pairs = vp.join(bounded_broadcast(rp), "token").filter(may_reach(F.col("n"), F.col("pos"), F.col("rn"), F.col("rpos"), t)).select("words", "rwords").distinct()
    found = pairs.join(vo, "words").join(bounded_broadcast(r), "rwords")
    found = found.withColumn("jaccard", jaccard(F.col("tokens"), F.col("rtokens"))).filter(F.col("jaccard") >= t - 1e-9)
    # Written before the check, as the optimizer would carry its filter, and with it the check, below the repartition.
    found = cut_lineage(found.select("words", "rwords", "entry_id", "other", "jaccard").repartition(tasks, "words", "rwords"))
    found = found.withColumn("slips", slips("words", "rwords")).filter("slips < 9")
    per_entry = found.groupBy("words", "entry_id").agg(F.min(F.struct((-F.col("jaccard")).alias("far"), "slips", "other")).alias("b"))
    ranked = per_entry.groupBy("words").agg(F.min(F.struct("b", "entry_id")).alias("w"), F.collect_list("b").alias("all"))
    won = ranked.select("words", "w.b", F.when(F.size(F.filter("all", lambda x: x == F.col("w.b"))) == 1, F.col("w.entry_id")).otherwise(F.lit(0)).alias("entry_id"))
    hits = asked.select("value", "level", "words").join(won, "words")
    # Parts of one level that name different entries make the value ambiguous; lower levels go first.
    per_level = hits.groupBy("value", "level").agg(F.min("entry_id").alias("least"), F.max("entry_id").alias("most"), F.min("b").alias("b"))
    got = per_level.groupBy("value").agg(F.min(F.struct("level", "least", "most", "b")).alias("g"))
    got = got.select("value", F.when(F.col("g.least") == F.col("g.most"), F.col("g.least")).otherwise(F.lit(0)).cast("bigint").alias("entry_id"), (-F.col("g.b.far")).alias("jaccard"), F.col("g.b.slips").alias("slips"))
    return values.join(got, "value", "left").select("value", "n", F.coalesce("entry_id", F.lit(0).cast("bigint")).alias("entry_id"), "jaccard", "slips")


def mapped_rows(rows: DataFrame, entries: DataFrame, id_col: str, value_col: str, names: DataFrame, table: str, t: float = 0.4, places: bool = False, heavy: int = 100_000) -> DataFrame:
    """``table_name, row_id, entry_id`` for rows whose value is neither null, blank nor literally a name of the list."""
    asked = rows.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(value_col).alias("value")).filter(F.col("value").rlike(r"[^\s 　​﻿]"))
    asked = asked.join(bounded_broadcast(names.select(F.col("name").alias("value")).distinct()), "value", "left_anti")
    values = asked.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    mapping = cut_lineage(canonical_values(values, entries, t, places))
    out = heavy_safe_join(asked, mapping.select("value", "n", "entry_id"), ["value"], "n", heavy, "inner")
    return out.select(F.lit(table).alias("table_name"), "row_id", "entry_id")
