"""Problem 6: items of varying length into containers of fixed capacity.

The plan is made on the histogram of lengths (at most one count a length up to the capacity, whatever the number of
items). Minimum bin slack: the longest length left opens a container; a bitset subset-sum dynamic program over a window
of remaining lengths finds the multiset that comes closest to the capacity, which is traced back to counts and applied
as often as the histogram allows. Items then find their container by length and rank, through sums by hash bucket.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaykit.plans.runtime import cut_lineage

#: Distinct lengths that one dynamic program looks at: the longest that fit, and the shortest.
WINDOW = 64
#: Least number of hash buckets by which the items of a length are ranked, and items a bucket beyond it.
BUCKETS, BUCKET_ITEMS = 256, 50_000


def fill(capacity: int, counts: list[tuple[int, int]]) -> Counter:
    """Multiset of lengths, within ``counts`` (length, how many), whose sum comes closest to ``capacity`` from below."""
    full = 1 << capacity
    mask = (full << 1) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []  # length, pieces at once, sums reachable before
    for length, n in counts:
        n = min(n, capacity // length) if length else 0
        k = 1
        while n > 0 and not reach & full:
            k = min(k, n)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            n -= k
            k *= 2
        if reach & full:
            break
    at = reach.bit_length() - 1
    out: Counter = Counter()
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            out[length] += k
            at -= length * k
    return out


def plan(capacity: int, histogram: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """``(lengths with counts, containers filled so)``: every item of the histogram is used exactly once.

    A container whose window leaves slack is tried again over all remaining lengths before it is accepted.
    """
    left = {length: n for length, n in histogram.items() if 0 < length <= capacity and n > 0}
    order = sorted(left, reverse=True)
    out = []
    while left:
        while order[0] not in left:
            order.pop(0)
        first = order[0]
        room = capacity - first
        own = [(x, left[x] - (x == first)) for x in order if x <= room and x in left]
        own = [(x, n) for x, n in own if n > 0]
        best: Counter = Counter()
        if room and own:
            near = own if len(own) <= window else own[: window // 2] + own[-window // 2 :]
            best = fill(room, near)
            if len(near) < len(own) and sum(k * v for k, v in best.items()) < room:
                best = max(best, fill(room, own), key=lambda c: sum(k * v for k, v in c.items()))
        need = dict(best)
        need[first] = need.get(first, 0) + 1
        times = min(left[x] // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((need, times))
    return out


def containers(sized: DataFrame, capacity: int, key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """``key, piece, start, tokens, container``: where each item, or each piece of an item longer than ``capacity``, goes.

    ``sized`` has ``key, tokens``. Items longer than the capacity are cut into full pieces and a rest; ``start`` is
    the first token of the piece. Items without tokens need no place and are left out. Pieces of one length are alike,
    so ties are free; keys may repeat, then each row is an item.
    """
    rows = sized.filter(F.col("tokens") > 0).select(key, F.col("tokens").cast("bigint").alias("size"), F.xxhash64(F.lit(31), key).alias("_h"))
    cuts = F.expr(f"sequence(0L, (size - 1) div {capacity}L)")
    items = rows.select(key, "_h", "size", F.explode(cuts).alias("piece")).select(key, "_h", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("size") - F.col("piece") * capacity).alias("tokens"))
    pieces = rows.agg(F.sum(F.expr(f"(size - 1) div {capacity}L + 1"))).first()[0] or 0
    buckets = max(BUCKETS, -(-pieces // BUCKET_ITEMS))
    items = cut_lineage(items.withColumn("bucket", F.pmod(F.col("_h") + F.col("piece") * 40503, F.lit(buckets))))
    # Ranks within a length: sums by (length, bucket) give each bucket its first rank, so that no length is ever in one task.
    sums = items.groupBy("tokens", "bucket").agg(F.count(F.lit(1)).alias("n"))
    firsts = sums.select("tokens", "bucket", "n", (F.sum("n").over(Window.partitionBy("tokens").orderBy("bucket")) - F.col("n")).alias("first"))
    firsts = cut_lineage(firsts)
    histogram = {r["tokens"]: r["n"] for r in firsts.groupBy("tokens").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    ranges, next_id, used = [], 0, Counter()
    for need, times in plan(capacity, histogram, window):
        for length, n in sorted(need.items()):
            ranges.append((length, used[length], used[length] + n * times, n, next_id))
            used[length] += n * times
        next_id += times
    spark = sized.sparkSession
    table = spark.createDataFrame(pd.DataFrame(ranges, columns=["tokens", "from_rank", "to_rank", "each", "first_id"]).astype("int64") if ranges else [], "tokens long, from_rank long, to_rank long, each long, first_id long")
    per_length = table.groupBy("tokens").agg(F.array_sort(F.collect_list(F.struct("from_rank", "to_rank", "each", "first_id"))).alias("ranges"))
    rank = F.row_number().over(Window.partitionBy("tokens", "bucket").orderBy("_h", key, "piece")) - 1
    ranked = items.withColumn("_r", rank).join(firsts.select("tokens", "bucket", "first"), ["tokens", "bucket"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("_r")).join(F.broadcast(per_length), "tokens")  # one row a length, at most `capacity`
    hit = F.element_at(F.filter("ranges", lambda x: (x["from_rank"] <= F.col("rank")) & (F.col("rank") < x["to_rank"])), 1)
    ranked = ranked.withColumn("hit", hit)
    place = F.col("hit.first_id") + F.expr("(rank - hit.from_rank) div hit.each")
    return ranked.select(key, F.col("piece").cast("int").alias("piece"), "start", "tokens", place.alias("container"))


def container_report(placed: DataFrame, capacity_col: str = "capacity_tokens") -> DataFrame:
    """``container_kind, capacity_tokens, containers, items, tokens, fill``: how full the containers of each kind are."""
    per = placed.groupBy("container_kind", capacity_col).agg(F.count_distinct("container").alias("containers"), F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"))
    return per.withColumn("fill", F.col("tokens") / (F.col("containers") * F.col(capacity_col)))
