"""Relevance, distinct by key, interleaving of slots, best per key, diversity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaykit.functions.urls import LOW_AUTHORITY_HOSTS, host_in, intent_of_path
from assaykit.plans.runtime import cut_lineage

#: What a page tells by its words, and points for it.
CATEGORIES = {"product": (r"\bproducts?\b", 22), "process": (r"production|manufactur|process|furnace|melting", 20), "channel": (r"distributor|trading|import|export", 12), "technical": (r"technical|specification|datasheet|grade", 14)}
#: Words of pages that tell nothing.
NOISE_WORDS = ("career", "job", "login", "privacy", "cookie", "event", "news", "blog", "press", "terms", "sitemap", "contact", "imprint")

#: Points for the company's own host, a directory, terms in the locator (each, at most), a term in the host, a noise word, path intents, histories, the root.
OWN_HOST, DIRECTORY, TERM, MOST_TERMS, TERM_IN_HOST, NOISE, INTENTS, HISTORY, ROOT = 35, -25, 5, 15, 25, -120, {1: 24, 2: 32, 3: 36}, -24, 4


def first_by_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in ``order``. A rank filter, so partitions keep one row a key before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def category_flags(locator: Column, body: Column) -> Column:
    """Names of the categories that occur in either text, in alphabetical order."""
    found = [F.when(locator.rlike(p) | body.rlike(p), F.lit(n)) for n, (p, _) in sorted(CATEGORIES.items())]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def with_relevance(pages: DataFrame) -> DataFrame:
    """``pages`` with ``categories`` and ``relevance``: categories, own host or a directory, company terms, noise words, path intent, root.

    Needs ``url_host`` and ``url_path`` (see ``with_url_parts``), the folded texts ``locator`` (address with title) and ``folded``
    (body), ``domain``, the company's host or null, and its folded ``terms``. Each pattern is searched once a page.
    """
    out = pages.withColumn("categories", category_flags(F.col("locator"), F.col("folded")))
    host, path, domain = F.col("url_host"), F.lower("url_path"), F.col("domain")
    score = reduce(lambda a, n: a + F.when(F.array_contains("categories", n), CATEGORIES[n][1]).otherwise(0), CATEGORIES, F.lit(0))
    own = F.coalesce((host == domain) | F.endswith(host, F.concat(F.lit("."), domain)), F.lit(False))
    score = score + F.when(own, OWN_HOST).when(host_in(host, LOW_AUTHORITY_HOSTS), DIRECTORY).otherwise(0)
    score = score + F.least(F.lit(MOST_TERMS), TERM * F.size(F.filter("terms", lambda t: F.col("locator").contains(t))))
    score = score + F.when(F.exists("terms", lambda t: host.contains(t)), TERM_IN_HOST).otherwise(0)
    score = score + NOISE * reduce(lambda a, w: a + F.col("locator").contains(w).cast("int"), NOISE_WORDS, F.lit(0))
    intent = intent_of_path(path)
    score = score + reduce(lambda a, i: a.when(intent == i, INTENTS[i]), sorted(INTENTS)[1:], F.when(intent == 1, INTENTS[1])).otherwise(0)
    score = score + F.when(path.rlike("history|timeline|milestone"), HISTORY).otherwise(0)
    return out.withColumn("relevance", score + F.when(path == "/", ROOT).otherwise(0))


def ranked_distinct(rows: DataFrame, group: str, keys: list[str], score: str, pos: str) -> DataFrame:
    """Distinct by key within a group (least ``pos`` wins), ranked by score downwards, ties by ``pos``: column ``rank`` from 1."""
    once = first_by_key(rows, [group, *keys], [F.asc(pos)])
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), F.asc(pos))))


def interleave(rows: DataFrame, group: str, slot_order: str, pos: str, keys: list[str], limit: int) -> DataFrame:
    """Round robin over slots: rank 1 of each slot, then rank 2 ...; distinct by key, the first ``limit`` as ``turn`` from 1."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group, slot_order).orderBy(F.asc(pos))))
    once = first_by_key(ranked, [group, *keys], [F.asc("_r"), F.asc(slot_order), F.asc(pos)])
    turned = once.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy("_r", slot_order, pos)))
    return turned.filter(F.col("turn") <= limit).drop("_r")


def best_per_key(rows: DataFrame, keys: list[str], value: Column, score: Column, name: str) -> DataFrame:
    """The value of the highest score by key, combined map-side."""
    return rows.groupBy(*keys).agg(F.max_by(value, score).alias(name))


def mmr_select(pages: DataFrame, group: str, limit: int = 3, least: int = 20, id_col: str = "pos") -> DataFrame:
    """Greedy diverse choice by group from ``relevance, categories, tokens``: ``group, id_col, turn, relevance, selection_score``.

    Each turn takes the page of greatest relevance + 8 per new category - 20 times its greatest Jaccard to a chosen page (least
    ``id_col`` on ties); it ends when that page's relevance is below ``least``. A turn is one aggregate and one join on the group,
    so a group may have any number of pages. Null tokens count as none; scores are rounded to one decimal.
    """
    empty = F.array().cast("array<string>")
    rows = cut_lineage(pages.select(group, id_col, "relevance", F.coalesce("categories", empty).alias("categories"), F.coalesce("tokens", empty).alias("tokens")))
    rows = rows.withColumn("covered", empty).withColumn("near", F.lit(0.0))
    turns = []
    for turn in range(1, limit + 1):
        fresh = F.size(F.array_except("categories", "covered"))
        scored = rows.withColumn("score", F.col("relevance") + 8 * fresh - 20 * F.col("near"))
        best = scored.groupBy(group).agg(F.max_by(F.struct(id_col, "relevance", "categories", "tokens", "score"), F.struct("score", F.negative(id_col))).alias("best")).filter(F.col("best.relevance") >= least)
        best = cut_lineage(best)
        turns.append(best.select(group, f"best.{id_col}", F.lit(turn).alias("turn"), "best.relevance", F.round("best.score", 1).alias("selection_score")))
        if turn < limit:
            left = rows.join(best, group).filter(F.col(id_col) != F.col(f"best.{id_col}"))
            alike = F.size(F.array_intersect("tokens", "best.tokens")) / F.greatest(F.lit(1), F.size(F.array_union("tokens", "best.tokens")))
            rows = left.select(group, id_col, "relevance", "categories", "tokens", F.array_union("covered", "best.categories").alias("covered"), F.greatest("near", alike).alias("near"))
    return reduce(DataFrame.unionByName, turns)
