"""Ordered computations inside a key that stay parallel when one key is huge.

A plain window over ``key`` sends every row of that key to one task. Here the
rows of a key are cut into blocks by a monotone ``block`` column of the sort
key; each block is numbered, summed and shifted on its own, and only one summary
row per block takes part in the window over the whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    position: str | None = None,
    total: str | None = None,
    running: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
) -> DataFrame:
    """Add position, group size, running sums and previous-row values.

    ``block`` must never decrease along ``order`` within a key, and should hold a
    bounded number of rows. Keys must not be NULL.
    """
    running, previous = running or {}, previous or {}
    blocked = df.withColumn("__block", block)
    here = [*keys, "__block"]
    key_of_order = F.struct(*order)

    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [F.sum(e).alias(f"__s{i}") for i, e in enumerate(running.values())]
    aggs += [F.max_by(F.struct(e.alias("v")), key_of_order).alias(f"__l{i}") for i, e in enumerate(previous.values())]
    summary = blocked.groupBy(*here).agg(*aggs)
    across = Window.partitionBy(*keys).orderBy("__block")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(
        *here,
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy(*keys)).alias("__total"),
        *[F.coalesce(F.sum(f"__s{i}").over(earlier), F.lit(0)).alias(f"__s{i}") for i in range(len(running))],
        *[F.lag(f"__l{i}").over(across).alias(f"__l{i}") for i in range(len(previous))],
    )

    within = Window.partitionBy(*here).orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.select(
        "*",
        F.row_number().over(within).alias("__rn"),
        *[F.sum(e).over(upto).alias(f"__r{i}") for i, e in enumerate(running.values())],
        *[F.lag(F.struct(e.alias("v"))).over(within).alias(f"__p{i}") for i, e in enumerate(previous.values())],
    )
    out = local.join(summary, here)
    cols = [F.col(c) for c in df.columns]
    if position:
        cols.append((F.col("__before") + F.col("__rn") - 1).alias(position))
    if total:
        cols.append(F.col("__total").alias(total))
    cols += [(F.col(f"__s{i}") + F.col(f"__r{i}")).alias(n) for i, n in enumerate(running)]
    cols += [
        F.when(F.col("__rn") == 1, F.col(f"__l{i}.v")).otherwise(F.col(f"__p{i}.v")).alias(n)
        for i, n in enumerate(previous)
    ]
    return out.select(*cols)


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of every key. Spark limits each key inside the map
    tasks before the shuffle, so a hot key sends at most n rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
