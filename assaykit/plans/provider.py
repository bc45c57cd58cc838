"""The one seam for answers that no table holds: rows in, answer rows out, each round written before it is read."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.plans.runtime import cut_lineage


class Provider(Protocol):
    def answer(self, requests: DataFrame) -> DataFrame:
        """``requests(key, role, attempt, prompt)`` to ``key, role, attempt, answer`` with at most one row a request."""


class ReplayProvider:
    """Answers from a table of recorded ones, ``key, role, attempt, answer``; requests without a record get null."""

    def __init__(self, recorded: DataFrame) -> None:
        self.recorded = recorded

    def answer(self, requests: DataFrame) -> DataFrame:
        return requests.select("key", "role", "attempt").join(self.recorded.select("key", "role", "attempt", "answer"), ["key", "role", "attempt"], "left")


def rounds(requests: DataFrame, provider: Provider, accept, attempts: int = 3) -> DataFrame:
    """``key, role, attempt, answer, accepted``: ask again up to ``attempts`` times for what ``accept(column)`` refuses.

    Every round is materialised before it is read, so a provider with side effects is called once a request.
    """
    open_, out = requests.withColumn("attempt", F.lit(1)), None
    for n in range(1, attempts + 1):
        got = provider.answer(open_).withColumn("accepted", F.coalesce(accept(F.col("answer")), F.lit(False)))
        got = cut_lineage(got)
        done = got if n == attempts else got.filter("accepted")
        out = done if out is None else out.unionByName(done)
        open_ = open_.join(got.filter("accepted").select("key", "role"), ["key", "role"], "left_anti").withColumn("attempt", F.lit(n + 1))
    return out
