"""Choice between competing candidates of one record, as one decision chain over joined tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_role(lead: DataFrame, other: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """``key, selected_role, reason``: which of two candidates stands; the first rule that applies decides.

    ``lead`` and ``other`` have ``valid, score, signature``; ``verdicts`` has ``decision`` and ``ok``. The other
    candidate is chosen only if it is valid, not lower, different, and a valid verdict names it. Missing rows and
    null scores leave the lead.
    """
    a = lead.select(key, F.col("valid").alias("lv"), F.col("score").alias("ls"), F.col("signature").alias("lg"))
    b = other.select(key, F.col("valid").alias("ov"), F.col("score").alias("os"), F.col("signature").alias("og"))
    v = verdicts.select(key, "decision", "ok")
    t = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = (
        F.when(~t("lv") | F.col("ls").isNull(), "lead not reviewable")
        .when(F.col("ov").isNull(), "no other candidate")
        .when(~t("ov"), "other invalid")
        .when(F.col("os").isNull() | (F.col("os") < F.col("ls")), "other lower")
        .when((F.col("os") == F.col("ls")) & F.equal_null("lg", "og"), "same decision")
        .when(~t("ok"), "no valid verdict")
        .when(F.col("decision") == "other", "verdict for other")
        .otherwise("verdict for lead")
    )
    joined = a.join(b, key, "left").join(v, key, "left").withColumn("reason", reason)
    return joined.select(key, F.when(F.col("reason") == "verdict for other", "other").otherwise("lead").alias("selected_role"), "reason")
