"""Prefix-filtered set-similarity join.

Tokens are ordered by global rarity; a pair whose Jaccard similarity reaches ``t`` must share a token within the first
``n - ceil(t n) + 1`` of each set. Length and positional filters drop pairs before the exact verification.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.plans.runtime import heavy_safe_join

#: Rows of a key that one task may meet with one another.
TOGETHER = 1_000


def rarity(sets: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``token, df`` over all sets, combined map-side; rare tokens first in the global order (df, token)."""
    return sets.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def in_rarity_order(sets: DataFrame, df: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """``key, tokens``: each set as an array from its rarest token on. Sets are short, so the regrouping is by key only."""
    long = sets.select(key, F.explode(tokens).alias("token")).join(df, "token")
    return long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("tokens"))


def prefix_length(n: Column, t: float) -> Column:
    return n - F.ceil(F.lit(t) * n - F.lit(1e-9)) + 1


def with_prefix(sets: DataFrame, key: str, t: float) -> DataFrame:
    """``key, n, pos, token`` for the prefix of each set in rarity order (``pos`` from 0)."""
    n = F.size("tokens")
    return sets.select(key, n.alias("n"), F.posexplode(F.slice("tokens", F.lit(1), prefix_length(n, t).cast("int"))).alias("pos", "token"))


def may_reach(na: Column, pa: Column, nb: Column, pb: Column, t: float) -> Column:
    """Length and positional filter at a shared prefix token: could the overlap still reach t/(1+t) (na + nb)?

    ``pa`` and ``pb`` are positions of the token in both sets; what precedes it in either set may match as well,
    so at most min of both positions plus one plus the shorter rest can be shared.
    """
    need = F.ceil(F.lit(t / (1 + t)) * (na + nb) - F.lit(1e-9))
    upper = F.least(pa, pb) + 1 + F.least(na - pa - 1, nb - pb - 1)
    return (F.least(na, nb) >= F.lit(t) * F.greatest(na, nb) - F.lit(1e-9)) & (upper >= need)


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def met_pairs(rows: DataFrame, keys: list[str], left: dict[str, str], right: dict[str, str], total: int | None = None, together: int = TOGETHER) -> DataFrame:
    """All pairs of ``rows`` with equal ``keys``, columns renamed by ``left`` and ``right``; the caller filters pairs.

    The self-join of a key with n rows is parted into about n / ``together`` parts: its left rows go to all parts, its right
    rows to one each, so a hot key is met by many tasks and no pair is lost. Keys of one row meet nothing and leave first.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    parts = F.ceil(F.col("_n") / F.lit(together)).cast("int")
    sized = heavy_safe_join(rows, counts, keys, "_n", total=total)
    one = sized.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).select(*keys, "_part", *[F.col(c).alias(n) for c, n in left.items()])
    other = sized.withColumn("_part", F.pmod(F.xxhash64(*right), parts)).select(*keys, "_part", *[F.col(c).alias(n) for c, n in right.items()])
    return one.join(other, [*keys, "_part"]).drop("_part")
