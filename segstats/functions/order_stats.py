"""Exact ranks, medians and percentiles per key, safe against huge keys.

Equal values are counted before anything is ordered. If the largest key still has more
distinct values than one task should order, the counts are range-partitioned by
(key, value): Spark samples the bounds, so every piece holds a bounded share of the rows
however they are spread over the keys, and piece totals carry across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segstats.session import materialize

VALUES_PER_TASK = 5_000_000


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(keys, value, n)``, written once; missing values have a row of their own."""
    return materialize(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")), "counts")


def ordered_counts(df: DataFrame, keys: list[str], value: str, per_task: int = VALUES_PER_TASK) -> DataFrame:
    """``(keys, value, n, below, total)``: ties of each value, rows below it, rows of the key."""
    present = df.filter(F.col(value).isNotNull())
    return order_counts(value_counts(present, keys, value), keys, value, per_task)


def order_counts(counts: DataFrame, keys: list[str], value: str, per_task: int = VALUES_PER_TASK) -> DataFrame:
    """``below`` and ``total`` for ``counts (keys, value, n)`` without missing values."""
    largest = counts.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    of_key = Window.partitionBy(*keys)
    if largest <= per_task:
        ahead = of_key.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return counts.select(
            *keys, value, "n", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("below"),
            F.sum("n").over(of_key).alias("total"),
        )
    pieces = counts.count() * 2 // per_task + 1
    split = counts.repartitionByRange(pieces, *keys, value).withColumn("piece", F.spark_partition_id())
    split = materialize(split, "pieces")
    ahead = Window.partitionBy(*keys, "piece").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = of_key.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        split.groupBy(*keys, "piece").agg(F.sum("n").alias("size"))
        .withColumn("skip", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .withColumn("total", F.sum("size").over(of_key))
        .drop("size")
    )
    inside = split.withColumn("inside", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    return inside.join(offsets, [*keys, "piece"]).select(
        *keys, value, "n", (F.col("skip") + F.col("inside")).alias("below"), "total"
    )


def percentile_of_counts(p: float, value: str) -> Column:
    """Aggregate over ``ordered_counts`` rows: the linearly interpolated percentile."""
    place = f"((total - 1) * {float(p)!r}D)"

    def pick(k: str) -> str:
        return f"max(CASE WHEN below <= {k} AND {k} < below + n THEN `{value}` END)"

    low, high = pick(f"floor({place})"), pick(f"ceil({place})")
    return F.expr(f"{low} + ({high} - {low}) * max({place} - floor({place}))")


def percentiles(
    df: DataFrame, keys: list[str], value: str, points: dict[str, float], per_task: int = VALUES_PER_TASK
) -> DataFrame:
    """One row per key with the exact percentile for each ``name: fraction``."""
    counts = ordered_counts(df, keys, value, per_task)
    return counts.groupBy(*keys).agg(*[percentile_of_counts(p, value).alias(name) for name, p in points.items()])


def rank_table(df: DataFrame, keys: list[str], value: str, prefix: str, per_task: int = VALUES_PER_TASK) -> DataFrame:
    """Per key and value: ``{prefix}_rank`` (ties lowest), ``_pct`` (ties average), ``_total``."""
    return ordered_counts(df, keys, value, per_task).selectExpr(
        *keys, value, f"below + 1 AS {prefix}_rank", f"(below + (n + 1) / 2) / total AS {prefix}_pct", f"total AS {prefix}_total"
    )


def ranked(df: DataFrame, keys: list[str], values: dict[str, str], per_task: int = VALUES_PER_TASK) -> DataFrame:
    """Rows of ``df`` with the rank columns of every ``prefix: value column``."""
    out = df
    for prefix, value in values.items():
        out = out.join(rank_table(df, keys, value, prefix, per_task), [*keys, value], "left")
    return out
