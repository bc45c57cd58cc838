"""Problem 7: a mix of sources at target weights.

Tokens are summed by source and hash bucket (4,096 buckets, combined map-side). Each source's budget is whole passes
over its documents plus the documents below a hash threshold. The threshold lies in one bucket; only that bucket is
split again by the next 12 bits of the hash, and so on, until it is exact to a document. The mix is then a filter on
the hash: nothing is sorted, and no source or document is gathered in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 12
LEVELS = 5  # 60 of the 63 bits used


def doc_hash(key: Column, seed: int) -> Column:
    """60 bits of a hash of the document's key, as a non-negative BIGINT."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 4)


def plan_budgets(have: dict[str, int], target: dict[str, float], repeats: dict[str, int], total: int | None = None) -> dict[str, int]:
    """Token budget of each source that has tokens.

    Without ``total``, the largest mix in which every such source reaches its share (shares rescaled to the sources
    present) within its repeats. With ``total``, sources that cannot reach theirs give all they may, and the rest is
    shared among the others by weight.
    """
    live = {s: w for s, w in target.items() if have.get(s, 0) > 0 and w > 0}
    most = {s: have[s] * max(0, repeats[s]) for s in live}
    live = {s: w for s, w in live.items() if most[s] > 0}
    if not live:
        return {}
    weight = sum(live.values())
    if total is None:
        scale = min(most[s] * weight / w for s, w in live.items())
        return {s: min(most[s], round(scale * w / weight)) for s, w in live.items()}
    out: dict[str, int] = {}
    rest, open_ = total, dict(live)
    while open_:
        weight = sum(open_.values())
        full = [s for s, w in open_.items() if most[s] <= rest * w / weight]
        if not full:
            return out | {s: round(rest * w / weight) for s, w in open_.items()}
        for s in full:
            out[s] = most[s]
            rest -= most[s]
            del open_[s]
    return out


def source_mix(sized: DataFrame, targets: DataFrame, key: str = "doc_id", total: int | None = None, seed: int = 7) -> DataFrame:
    """``key, source, tokens, copies`` of the documents in the mix; ``copies`` is how often each is used.

    ``sized`` has ``key, source, tokens``; ``targets`` has ``source, target_share, max_repeats`` and is a short list.
    Rows without a source, with a source that is no target, or without tokens take no part. A source's size differs
    from its budget by less than one document; equal hashes (repeated keys) enter together.
    """
    goals = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.select("source", "target_share", "max_repeats").collect()}
    docs = sized.filter(F.col("source").isin(*goals) & (F.col("tokens") > 0)).select(key, "source", "tokens", doc_hash(F.col(key), seed).alias("_h"))
    bucket = F.shiftright("_h", BITS * (LEVELS - 1))
    sums: dict[str, dict[int, int]] = {}
    for r in docs.groupBy("source", bucket.alias("b")).agg(F.sum("tokens").alias("t")).collect():  # at most sources x 4,096 rows
        sums.setdefault(r["source"], {})[r["b"]] = r["t"]
    have = {s: sum(b.values()) for s, b in sums.items()}
    budgets = plan_budgets(have, {s: g[0] for s, g in goals.items()}, {s: g[1] for s, g in goals.items()}, total)
    passes = {s: budgets[s] // have[s] for s in budgets}
    left = {s: budgets[s] - passes[s] * have[s] for s in budgets}
    low = dict.fromkeys(budgets, 0)  # documents with a hash below this are in once more
    open_ = {s for s in budgets if left[s] > 0}
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        if level:
            inside = reduce(lambda a, b: a | b, [(F.col("source") == s) & (F.shiftright("_h", shift + BITS) == low[s] >> (shift + BITS)) for s in sorted(open_)])
            sums = {}
            for r in docs.filter(inside).groupBy("source", F.shiftright("_h", shift).alias("b")).agg(F.sum("tokens").alias("t")).collect():
                sums.setdefault(r["source"], {})[r["b"]] = r["t"]
        for s in sorted(open_):
            for b, t in sorted(sums.get(s, {}).items()):
                if t > left[s]:
                    nearer = level == LEVELS - 1 and t - left[s] < left[s]  # one document by now: in, if that comes nearer
                    low[s] = (b + 1 if nearer else b) << shift
                    break
                left[s] -= t
                low[s] = (b + 1) << shift
            else:
                open_.discard(s)
        open_ = {s for s in open_ if left[s] > 0}
        if not open_:
            break
    if not budgets:
        return docs.filter(F.lit(False)).select(key, "source", "tokens", F.lit(0).alias("copies"))
    copies = F.coalesce(*[F.when(F.col("source") == s, F.lit(passes[s]) + (F.col("_h") < F.lit(low[s])).cast("int")) for s in budgets]).cast("int")
    return docs.withColumn("copies", copies).filter("copies > 0").select(key, "source", "tokens", "copies")


def mix_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, tokens, documents, most_copies``: one row a target, zero where nothing came."""
    per = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    total = mix.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] or 0
    out = targets.select("source", "target_share").join(F.broadcast(per), "source", "left")  # one row a target at most
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return out.select("source", "target_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.lit(float(total))), F.lit(0.0)).alias("actual_share"), zero("tokens"), zero("documents"), zero("most_copies"))
