"""Object tables per subject: outliers, diameter bins, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstats.constants import BINNED_METRICS, DIAMETER_BINS
from segstats.functions.order_stats import percentiles
from segstats.functions.scalars import round_scaled

# Names and order of the statistics.
STATISTICS = {"Mean": "mean", "Standard Deviation": "std", "Min": "min", "Max": "max", "Median": "median"}


def _rules(gratio_null: bool, gratio_sup: bool) -> Column:
    drop = F.lit(False)
    if gratio_null:
        drop = drop | F.col("gratio").isNull()
    if gratio_sup:
        drop = drop | F.coalesce(F.col("gratio") >= 1, F.lit(False))
    return drop


def drop_outliers(objects: DataFrame, gratio_null: bool = True, gratio_sup: bool = True) -> DataFrame:
    """Objects without a missing g-ratio and without one of 1 or more (each switchable)."""
    return objects.filter(~_rules(gratio_null, gratio_sup))


def count_outliers(
    objects: DataFrame, keys: list[str], gratio_null: bool = True, gratio_sup: bool = True
) -> DataFrame:
    """How many objects ``drop_outliers`` removes per key."""
    return objects.groupBy(*keys).agg(
        F.count_if(_rules(gratio_null, gratio_sup)).alias("n_dropped"), F.count(F.lit(1)).alias("n_objects")
    )


def diameter_bin(diameter: Column) -> Column:
    """Bin label of a diameter (lower bound inclusive), null below the first bin."""
    out = None
    for label, low, high in DIAMETER_BINS:
        hit = diameter >= low if high is None else (diameter >= low) & (diameter < high)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation, min, max and median per key, rounded half-even to 2 places."""
    basic = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    median = percentiles(df, keys, value, {"median": 0.5})
    out = basic.join(median, keys, "left")
    return out.select(*keys, *[round_scaled(F.col(c), 2).alias(c) for c in STATISTICS.values()])


def binned_statistics(objects: DataFrame) -> DataFrame:
    """Long table ``(subject_id, metric, bin, mean, std, min, max, median)``; empty bins are null.

    One job for all subjects and images: pooling is just grouping by subject.
    """
    long = (
        objects.withColumn("bin", diameter_bin(F.col("axon_diam")))
        .select("subject_id", "bin", *[F.col(c).alias(name) for name, c in BINNED_METRICS.items()])
        .filter("bin IS NOT NULL")
        .unpivot(["subject_id", "bin"], list(BINNED_METRICS), "metric", "value")
    )
    stats = statistics(long, ["subject_id", "metric", "bin"], "value")
    grid = (
        objects.select("subject_id").distinct()
        .withColumn("metric", F.explode(F.array(*[F.lit(m) for m in BINNED_METRICS])))
        .withColumn("bin", F.explode(F.array(*[F.lit(b[0]) for b in DIAMETER_BINS])))
    )
    return grid.join(stats, ["subject_id", "metric", "bin"], "left")


def wide_statistics(binned: DataFrame) -> DataFrame:
    """One row per subject, metric and statistic, one column per bin."""
    names = {v: k for k, v in STATISTICS.items()}
    long = binned.withColumnsRenamed(names).unpivot(
        ["subject_id", "metric", "bin"], list(STATISTICS), "statistic", "value"
    )
    return long.groupBy("subject_id", "metric", "statistic").pivot("bin", [b[0] for b in DIAMETER_BINS]).agg(
        F.first("value", ignorenulls=True)
    )


def bin_counts(objects: DataFrame) -> DataFrame:
    """Objects per subject and diameter bin, including empty bins."""
    counted = objects.groupBy("subject_id", diameter_bin(F.col("axon_diam")).alias("bin")).agg(
        F.count("axon_diam").alias("n")
    )
    grid = objects.select("subject_id").distinct().withColumn(
        "bin", F.explode(F.array(*[F.lit(b[0]) for b in DIAMETER_BINS]))
    )
    return grid.join(counted, ["subject_id", "bin"], "left").select(
        "subject_id", "bin", F.coalesce("n", F.lit(0)).alias("n")
    )
