"""Checks of JSON documents that tell numbers from booleans and fractions, and references inside them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """What must hold at a path: ``kind`` is text, one_of, integer, number, boolean or list; null and missing are alike."""

    path: str
    kind: str
    values: tuple = ()
    low: float | None = None
    high: float | None = None
    required: bool = True


def violations(document: Column, rules: list[Rule]) -> Column:
    """Messages of the rules that fail, in order; 'no JSON' alone where the text does not parse.

    Types are strict: ``true`` is no integer, ``1`` no boolean, ``9.0`` no integer. Null documents do not parse.
    """
    v = F.try_parse_json(document)
    checks = []
    for r in rules:
        kind = F.schema_of_variant(F.try_variant_get(v, r.path, "variant"))
        there = kind.isNotNull() & (kind != "VOID")
        text = F.try_variant_get(v, r.path, "string")
        number = F.try_variant_get(v, r.path, "double")
        if r.kind == "text":
            ok = (kind == "STRING") & (F.trim(text) != "")
        elif r.kind == "one_of":
            ok = (kind == "STRING") & text.isin(*r.values)
        elif r.kind == "integer":
            ok = kind == "BIGINT"
        elif r.kind == "number":
            ok = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        elif r.kind == "boolean":
            ok = kind == "BOOLEAN"
        else:
            ok = kind.startswith("ARRAY")
        if r.low is not None:
            ok = ok & (number >= r.low)
        if r.high is not None:
            ok = ok & (number <= r.high)
        bad = ~F.coalesce(ok, F.lit(False)) & there | ~F.coalesce(there, F.lit(False)) if r.required else F.coalesce(there, F.lit(False)) & ~F.coalesce(ok, F.lit(False))
        checks.append(F.when(bad, F.lit(f"{r.path}: {r.kind}")))
    return F.when(v.isNull(), F.array(F.lit("no JSON"))).otherwise(F.filter(F.array(*checks), lambda x: x.isNotNull()))


def reanchored_sources(sources: DataFrame, pack: DataFrame, group: str = "bundle_id") -> DataFrame:
    """``group, pos, old_id, id, url``: cited sources tied to those of the pack by id, else by key; the rest is dropped.

    ``sources(group, pos, id, key)`` and ``pack(group, id, key, url)``; of several pack entries with one key the least id
    counts, of several citations of one entry the first.
    """
    by_id = pack.select(group, F.col("id").alias("pid"), "url").dropDuplicates([group, "pid"])
    by_key = pack.filter("key is not null").groupBy(group, "key").agg(F.min(F.struct("id", "url")).alias("k"))
    joined = sources.join(by_id, (sources[group] == by_id[group]) & (sources["id"] == by_id["pid"]), "left").drop(by_id[group]).join(by_key, [group, "key"], "left")
    tied = joined.select(group, "pos", F.col("id").alias("old_id"), F.coalesce("pid", "k.id").alias("id"), F.coalesce("url", "k.url").alias("url")).filter("id is not null")
    return tied.groupBy(group, "id").agg(F.min(F.struct("pos", "old_id", "url")).alias("f")).select(group, "f.pos", "f.old_id", "id", "f.url")
