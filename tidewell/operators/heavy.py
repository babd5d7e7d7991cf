"""Exact top-k of values with a long tail: mergeable summaries pick candidates, and a recount with an error bound confirms them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialize
from .sequence import top_k_per

#: Values that a summary tracks: a task hands on no more of each group, however many it has seen.
TRACKED = 100_000


def error_share(tracked: int) -> float:
    """What share of all rows a value may have at most that a frequent-items summary of this size doesn't return: twice its error of 3.5 in its table's size."""
    return 2 * 3.5 / (1 << math.ceil(math.log2(tracked / 0.75)))


def top_values(rows: DataFrame, group: list[str], value: str, k: int, min_count: int = 1, tracked: int = TRACKED) -> DataFrame:
    """The ``k`` most frequent values of each group (ties: the smaller first) with n and rank, exact; values below ``min_count`` are left out.

    A first pass keeps a summary of frequent values for each group, which
    merges without shuffling the tail. A second one counts the candidates
    alone. Whatever isn't a candidate has no more rows than a known bound; a
    group whose k-th candidate isn't above it is counted in full. Null values
    are left out.
    """
    rows = rows.where(F.col(value).isNotNull())
    wide = min(tracked, 4 * k)
    summary = rows.groupBy(*group).agg(F.expr(f"approx_top_k(`{value}`, {wide}, {tracked})").alias("top"), F.count(F.lit(1)).alias("total"))
    summary = materialize(summary, "summaries")
    seen = F.transform("top", lambda x: x["count"])
    bound = F.greatest(F.col("total") * error_share(tracked), F.when(F.size("top") >= wide, F.array_min(seen)).otherwise(F.lit(0)).cast("double"))
    given = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    candidates = summary.select(*given, F.explode("top").alias("t")).select(*[f"_g{i}" for i in range(len(group))], F.col("t.item").alias("_v"))
    count = lambda df: df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    exact = materialize(count(rows.join(candidates, [*same, F.col(value) == F.col("_v")], "left_semi")), "candidates")
    last = top_k_per(exact, group, k, [F.desc("n"), F.asc(value)]).where(F.col("rank") == k).select(*given, F.col("n").alias("_n"))
    open_ = summary.select(*group, bound.alias("bound")).join(last, same, "left").where(F.col("_n").isNull() | (F.col("_n") <= F.col("bound")))
    open_ = materialize(open_.select(*given), "open-groups")
    if not open_.isEmpty():
        exact = exact.join(open_, same, "left_anti").unionByName(count(rows.join(open_, same, "left_semi")))
    return top_k_per(exact.where(F.col("n") >= min_count), group, k, [F.desc("n"), F.asc(value)])
