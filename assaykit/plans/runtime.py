"""Physical helpers: lineage cuts, size-checked broadcasts and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a relation of short rows may be broadcast (about 30 MB at 150 bytes a row).
BROADCAST_ROWS = 200_000
#: Rows of a key beyond which it is hot.
HEAVY = 100_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of ``spark.checkpoint.dir``; set a temporary one only on a local master where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="assaykit-checkpoint-"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, for tables that outlive a job; nothing is made before it is written."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def release(df: DataFrame) -> None:
    """Delete the files of a checkpointed DataFrame that no later plan reads; other DataFrames are left alone."""
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() != "LogicalRDD" or not plan.rdd().getCheckpointFile().isDefined():
        return
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(plan.rdd().getCheckpointFile().get())
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Give the package to the executors' Python workers, once a context, so that they need not have it installed.

    The archive is served by the driver like any file added to the context; it holds code only, no data.
    """
    sc = spark.sparkContext
    root = Path(__file__).resolve().parents[1]
    if getattr(sc, "_assaykit_shipped", False) or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="assaykit-code-")) / "assaykit.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(archive))
    sc._assaykit_shipped = True


def at_most(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows; never reads further than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint if the relation is proven small, else the relation as it is (a shuffle join follows)."""
    return F.broadcast(df) if at_most(df, rows) else df


def heavy_safe_join(rows: DataFrame, mapping: DataFrame, keys: list[str], count_col: str, heavy: int = HEAVY, how: str = "inner", total: int | None = None) -> DataFrame:
    """Join ``rows`` with ``mapping`` (one row a key, carrying the number ``count_col`` of matching rows).

    Keys of more than ``heavy`` rows are joined by broadcast, so no task gets a hot key whole. Their number is at
    most the number of rows over ``heavy``; where that exceeds the broadcast bound, ``heavy`` rises until it does not.
    ``how`` is inner or left. Null keys match nothing. Where the
    caller knows the number of ``rows`` and it is no more than ``heavy``, no key can be hot and nothing is counted.
    """
    if total is not None and total <= heavy:
        return rows.join(mapping, keys, how)
    hot = mapping.filter(F.col(count_col) > heavy)
    n_hot = hot.limit(BROADCAST_ROWS + 1).count()
    while n_hot > BROADCAST_ROWS:
        heavy *= 4
        hot = mapping.filter(F.col(count_col) > heavy)
        n_hot = hot.limit(BROADCAST_ROWS + 1).count()
    if n_hot == 0:
        return rows.join(mapping, keys, how)
    hot_keys = F.broadcast(hot.select(*keys).withColumn("_hot", F.lit(True)))
    marked = rows.join(hot_keys, keys, "left")
    first = marked.filter(F.col("_hot").isNotNull()).drop("_hot").join(F.broadcast(hot), keys, "inner")
    rest = marked.filter(F.col("_hot").isNull()).drop("_hot").join(mapping.filter(F.col(count_col) <= heavy), keys, how)
    return first.unionByName(rest)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of each vertex of ``edges(a, b)``: ``node, component`` (the smallest vertex).

    Alternating large-star and small-star rounds; every star is an aggregate plus a join on the vertex, never a
    collected group. Each round is cut by a checkpoint, which goes once the next stands. Self loops are allowed and keep
    lone vertices. Rounds grow with the logarithm of a component's diameter; RuntimeError after ``max_rounds``. Rounds over at most
    half of ``HEAVY`` links go in one task, joined by broadcast, without shuffles: each shuffle holds a thread of the driver for a minute.
    """
    loops = edges.filter("a = b").select(F.col("a").alias("node")).distinct()
    links = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    size, signature = links.count(), None
    for _ in range(max_rounds):
        few, sent = (lambda df: df.coalesce(1), F.broadcast) if 2 * size <= HEAVY else (lambda df: df, lambda df: df)
        ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = few(links).select(F.explode(ways).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "u"))
        large = heavy_safe_join(both.filter("v > u"), sent(least), ["u"], "n", total=2 * size).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least2 = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = heavy_safe_join(large, sent(least2), ["u"], "n", total=2 * size).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = few(small.union(least2.select("u", F.col("m").alias("v")))).filter("u <> v").distinct()
        before, links = links, cut_lineage(small)
        release(before)
        now = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == signature:
            break
        size, signature = now.n, (now.n, now.h)
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = links.select(F.col("v").alias("node")).distinct()
    found = links.select(F.col("u").alias("node"), F.col("v").alias("component")).groupBy("node").agg(F.min("component").alias("component"))
    alone = loops.union(roots).distinct().join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(alone)


def ws_trim(c: Column) -> Column:
    """Strip all white space, also no-break, zero-width and ideographic spaces (``trim`` strips blanks only)."""
    return F.regexp_replace(c, r"^[\s 　​﻿]+|[\s 　​﻿]+$", "")


__all__ = ["BROADCAST_ROWS", "HEAVY", "at_most", "bounded_broadcast", "connected_components", "cut_lineage", "ensure_checkpoint_dir", "heavy_safe_join", "release", "shared_folder", "ship_package", "ws_trim"]
