"""A reproducible shuffle: a Feistel permutation over global row numbers.

Rows get numbers 0..N-1 in an order that depends on their values alone. A
permutation of these numbers gives each row its place; place mod shards is its
shard and place div shards its slot, so counts differ by one at most and either
can be computed from the other. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import given_names

#: Groups of rows that are numbered apart; their counts, a table of this size at most, are broadcast.
BUCKETS = 4096
#: Equal rows beyond this count are numbered in several groups.
RUN = 10_000
ROUNDS, WALKS = 4, 64


def _digits(text: Column, n: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, n), 16, 10).cast("long")


def _round(seed: int, i: Column, half: Column) -> Column:
    return _digits(F.concat_ws("/", F.lit(str(seed)), i.cast("string"), half.cast("string")), 13)


def feistel(x: Column, n: Column, seed: int) -> Column:
    """The permutation of 0..n-1 that the seed names, at x.

    x is cut into a low part below a = ceil(sqrt(n)) and a high part below
    b = ceil(n / a); rounds add a keyed digest of one part to the other. That
    permutes 0..a*b-1. Values of n and more walk on along their cycle, until one
    is below n: at most a*b - n < a steps, and more than one with a chance below
    1 / sqrt(n). For n up to 4096, 64 steps are always enough; beyond, they fail
    with a chance below 64**-64, and then the query raises.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = ((n + a - 1 - (n + a - 1) % a) / a).cast("long")

    def step(v: Column) -> Column:
        def one(acc: Column, i: Column) -> Column:
            low, high = acc["low"], acc["high"]
            even = i % 2 == 0
            return F.struct(
                F.when(even, (low + _round(seed, i, high)) % a).otherwise(low).alias("low"),
                F.when(even, high).otherwise((high + _round(seed, i, low)) % b).alias("high"),
            )

        start = F.struct((v % a).alias("low"), ((v - v % a) / a).cast("long").alias("high"))
        return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, one, lambda s: s["high"] * a + s["low"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), step(x), lambda v, _: F.when(v < n, v).otherwise(step(v)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("the cycle walk did not end")).cast("long"))


def number_rows(rows: DataFrame) -> DataFrame:
    """Each row of a slim table with ``row_number`` (from 0, no gaps) and ``n_rows``.

    Rows are counted first, so equal rows travel as one; each distinct row falls
    into one of 4096 groups by a digest of its values, and a group starts where
    the counts of the groups before it end. The numbers depend on the values
    alone, not on files or partitions; equal rows are interchangeable. Columns
    must be of types that cast to string; a null is a value of its own. A
    caller's column of the same name as an added one gets ``_given`` at its end.
    """
    # The caller's columns go by their places, so that no name of theirs can meet one of these.
    cols = [f"c{i}" for i in range(len(rows.columns))]
    values = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in cols], F.col("run").cast("string"))
    counted = (
        rows.toDF(*cols)
        .groupBy(*cols)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("run", F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN})")))
        .withColumn("n", F.least(F.lit(RUN).cast("long"), F.col("n") - F.col("run") * RUN))
        .withColumn("bucket", _digits(values, 3))
    )
    sizes = counted.groupBy("bucket").agg(F.sum("n").alias("size"))
    starts = sizes.selectExpr("bucket", "sum(size) over (order by bucket) - size as start", "sum(size) over () as n_rows")
    order = ", ".join([*cols, "run"])
    return (
        counted.selectExpr("*", f"sum(n) over (partition by bucket order by {order} rows unbounded preceding) - n as before")
        .join(F.broadcast(starts), "bucket")
        .withColumn("at", F.explode(F.expr("sequence(0L, n - 1)")))
        .select(*[F.col(c).alias(name) for c, name in zip(cols, given_names(rows.columns, ["row_number", "n_rows"]))], (F.col("start") + F.col("before") + F.col("at")).alias("row_number"), "n_rows")
    )


def shard_rows(rows: DataFrame, n_shards: int, seed: int = 0) -> DataFrame:
    """Deals the rows of a slim table to shards: adds ``place``, ``shard`` and ``slot``.

    Counts of shards differ by one at most, and slots are gapless from 0. The
    result is the same however the table is split, and another seed gives
    another shuffle. Nulls and repeated rows are dealt like others; no rows give
    none. A caller's column of the same name as an added one gets ``_given`` at
    its end. The query raises if 64 steps don't end a row's cycle walk, as
    ``feistel`` says. Project wide tables to an identifier first and join the result.
    """
    numbered = number_rows(rows)
    cols = [f"c{i}" for i in range(len(rows.columns))]
    placed = numbered.toDF(*cols, "row_number", "n_rows").withColumn("place", feistel(F.col("row_number"), F.col("n_rows"), seed))
    return placed.select(
        *[F.col(c).alias(name) for c, name in zip(cols, given_names(rows.columns, ["place", "shard", "slot"]))],
        "place",
        (F.col("place") % n_shards).cast("int").alias("shard"),
        F.floor(F.col("place") / n_shards).cast("long").alias("slot"),
    )
