"""Cache with time to live, resume, overlay of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.urls import normalise_url
from assaykit.operators.ranking import first_by_key
from assaykit.plans.runtime import ws_trim

CACHE_VERSION = 2
CACHE_SECONDS = 604_800


def cache_key(name: Column, website: Column, country: Column, profile: Column, max_sources: int) -> Column:
    """24 hex digits of a SHA-256 over the version, the identity in normal form and the number of sources."""
    low = lambda c: F.lower(ws_trim(F.coalesce(c, F.lit(""))))
    return F.left(F.sha2(F.concat_ws("\x1f", F.lit(str(CACHE_VERSION)), low(name), normalise_url(website), low(country), normalise_url(profile), F.lit(str(max_sources))), 256), F.lit(24))


def cache_lookup(asked: DataFrame, entries: DataFrame, key: str, now: Column, seconds: int = CACHE_SECONDS) -> DataFrame:
    """``asked`` with ``hit`` and the newest entry of its key that is at most ``seconds`` old (inclusive)."""
    fresh = entries.filter(F.col("created_at") >= now - F.make_interval(secs=F.lit(seconds)))
    newest = fresh.groupBy(key).agg(F.max_by("entry_id", F.struct("created_at", "entry_id")).alias("entry_id"), F.max("created_at").alias("created_at"))
    return asked.join(newest, key, "left").withColumn("hit", F.col("entry_id").isNotNull())


def pending(wanted: DataFrame, done: DataFrame, key: str, ok: Column) -> DataFrame:
    """Rows of ``wanted`` without a result that passes ``ok``; a row with a null key is pending."""
    return wanted.join(done.filter(ok).select(key).distinct(), key, "left_anti")


def overlay(runs: DataFrame, key: str, priority: list[Column]) -> DataFrame:
    """The result of highest priority by key over all runs; whole rows that were delivered twice count once."""
    return first_by_key(runs, [key], priority)


def upsert(base: DataFrame, update: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with rows replaced or added by ``update``; the updates must be distinct by ``keys``."""
    return base.join(update.select(*keys), keys, "left_anti").unionByName(update)
