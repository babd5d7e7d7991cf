"""What follows what in a stream, without putting a stream into one task.

Windows run over one stream's day. What a day needs from earlier days is a row
or two, so it comes from a small table of days and is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _day(ts: str) -> Column:
    return F.to_date(F.col(ts))


def with_previous(ev: DataFrame, cols: list[str], key: str = "dataset_id", ts: str = "ts", id_: str = "id") -> DataFrame:
    """Adds prev_<col>: the values of the event before, by time and then identifier; null for a stream's first."""
    at, own = F.struct(ts, id_), F.struct(*cols)
    day = ev.withColumn("_day", _day(ts))
    w = Window.partitionBy(key, "_day").orderBy(ts, id_)
    last = day.groupBy(key, "_day").agg(F.max_by(own, at).alias("_last"))
    carry = last.select(key, "_day", F.lag("_last").over(Window.partitionBy(key).orderBy("_day")).alias("_carry"))
    met = day.withColumn("_prev", F.lag(own).over(w)).join(carry, [key, "_day"], "left")
    prev = F.coalesce("_prev", "_carry")
    return met.select(*ev.columns, *[prev[c].alias(f"prev_{c}") for c in cols])


def with_session(ev: DataFrame, gap_secs: float, key: str = "dataset_id", ts: str = "ts", id_: str = "id") -> DataFrame:
    """Adds session, struct(ts, id) of the first event of its run: a run goes on while gaps are ``gap_secs`` at most."""
    lagged = with_previous(ev, [ts], key, ts, id_).withColumn("_day", _day(ts))
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(f"prev_{ts}").cast("timestamp"))) / 1e6
    start = F.when(F.col(f"prev_{ts}").isNull() | (gap > gap_secs), F.struct(F.col(ts).alias("ts"), F.col(id_).alias("id")))
    marked = lagged.withColumn("_start", start)
    w = Window.partitionBy(key, "_day").orderBy(ts, id_).rowsBetween(Window.unboundedPreceding, 0)
    days = marked.groupBy(key, "_day").agg(F.max("_start").alias("_last"))
    before = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carry = days.select(key, "_day", F.max("_last").over(before).alias("_carry"))
    met = marked.withColumn("_own", F.max("_start").over(w)).join(carry, [key, "_day"], "left")
    return met.select(*ev.columns, F.coalesce("_own", "_carry").alias("session"))


def with_number(ev: DataFrame, key: str = "dataset_id", ts: str = "ts", id_: str = "id") -> DataFrame:
    """Adds n, the event's number in its stream from 1."""
    day = ev.withColumn("_day", _day(ts))
    sizes = day.groupBy(key, "_day").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, "_day", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    w = Window.partitionBy(key, "_day").orderBy(ts, id_)
    met = day.withColumn("_n", F.row_number().over(w)).join(starts, [key, "_day"])
    return met.select(*ev.columns, (F.col("_before") + F.col("_n")).alias("n"))


def trailing_count(ev: DataFrame, secs: int, key: str = "dataset_id", ts: str = "ts") -> DataFrame:
    """Adds recent, the events of the last ``secs`` seconds, its own time included; an event is also seen by each later day that it reaches."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    day_us = 86_400_000_000
    own = F.floor(us / day_us)
    reach = F.floor((us + secs * 1_000_000) / day_us)
    echo = F.transform(F.sequence(own, reach), lambda d: F.struct(d.alias("d"), (d == own).alias("own")))
    spread = ev.withColumn("_us", us).withColumn("_at", F.explode(echo))
    w = Window.partitionBy(key, "_at.d").orderBy("_us").rangeBetween(-secs * 1_000_000, 0)
    return spread.withColumn("recent", F.count(F.lit(1)).over(w)).where("_at.own").select(*ev.columns, "recent")


def top_k_per(df: DataFrame, group: list[str], k: int | None, by: list[Column]) -> DataFrame:
    """The first ``k`` rows of each group in a total order (all for None), with rank."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*by)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def top_k(df: DataFrame, k: int, by: list[Column]) -> DataFrame:
    """The first ``k`` rows of all in a total order."""
    return df.orderBy(*by).limit(k)


def argmax(df: DataFrame, group: list[str], key: str, n: str, out: str) -> DataFrame:
    """For each group the smallest key of the greatest ``n``: ``out`` and ``n``."""
    best = F.min(F.struct((-F.col(n)).alias("_n"), F.col(key).alias("_k"))).alias("_best")
    return df.groupBy(*group).agg(best).select(*group, F.col("_best._k").alias(out), (-F.col("_best._n")).alias(n))


def order_statistic(values: DataFrame, group: list[str], col: str, rank: Column, bits: int) -> DataFrame:
    """The value of a rank, from 1, in each group: group, n (its rows), ``col``; ``rank`` is an expression over n.

    ``col`` holds whole numbers from 0 below 2**``bits``. Its upper half of bits is
    counted first, which tells the range that has the rank, and then the lower
    half of the values in that range: two aggregates with a map side, and windows
    over 2**(bits / 2) counts at most, however many rows a group has.
    """
    low = bits // 2
    upper = F.shiftright(col, low)
    parts = values.groupBy(*group, upper.alias("_at")).agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(*group)
    upto = parts.withColumns({"_upto": F.sum("_k").over(w.orderBy("_at")), "n": F.sum("_k").over(w)}).withColumn("_rank", rank)
    there = upto.where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_k") < F.col("_rank")))
    there = there.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_at").alias("_range"), (F.col("_rank") - F.col("_upto") + F.col("_k")).alias("_left"), "n")
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    met = values.join(there, [*same, upper == F.col("_range")]).groupBy(*group, col).agg(F.count(F.lit(1)).alias("_k"), F.first("_left").alias("_left"), F.first("n").alias("n"))
    last = met.withColumn("_upto", F.sum("_k").over(w.orderBy(col)))
    return last.where((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_k") < F.col("_left"))).select(*group, "n", col)
