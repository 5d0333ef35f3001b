"""Quality control: summaries, histograms, flags, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segstats.functions.order_stats import order_counts, ordered_counts, percentile_of_counts, value_counts
from segstats.functions.scalars import fixed
from segstats.session import materialize


def numeric_metrics(objects: DataFrame, skip: int = 3) -> list[str]:
    """Names of the floating-point columns after the first ``skip``."""
    return [name for name, kind in objects.dtypes[skip:] if kind == "double"]


def melt(objects: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return objects.select(*keys, *metrics).unpivot(keys, metrics, "metric", "value")


#: Rows of a key that one task may sort; a key with more goes by counts of its values.
ROWS_PER_TASK = 1_000_000


def keys_fit(objects: DataFrame, keys: list[str]) -> bool:
    """Whether the rows of every key fit one task."""
    return (objects.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= ROWS_PER_TASK


def sorted_values(objects: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """``(keys, metric, v, rows, mean, std)``: present values in ascending order; the objects are shuffled once."""
    dealt = objects.select(*keys, *metrics).repartition(*keys)
    found = dealt.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.struct(F.lit(m).alias("metric"), F.sort_array(F.collect_list(m)).alias("v"), F.avg(m).alias("mean"), F.stddev_pop(m).alias("std")).alias(f"_{k}")
          for k, m in enumerate(metrics)],
    )
    return found.select(*keys, "rows", F.inline(F.array(*[f"_{k}" for k in range(len(metrics))])))


def percentile_of_sorted(p: float, values: str = "v") -> str:
    """The linearly interpolated percentile of an ascending array, as ``percentile_of_counts`` does it."""
    place = f"((size({values}) - 1) * {float(p)!r}D)"
    low, high = (f"get({values}, cast({f}({place}) as int))" for f in ("floor", "ceil"))
    return f"({low} + ({high} - {low}) * ({place} - floor({place})))"


def summary(objects: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean, median, population deviation, IQR, extremes and missing count per metric.

    Keys whose rows fit a task are sorted there; otherwise everything comes from the counts of distinct values.
    """
    by = [*keys, "metric"]
    if keys_fit(objects, keys):
        points = {"median": 0.5, "q1": 0.25, "q3": 0.75}
        found = sorted_values(objects, keys, metrics).selectExpr(
            *by, "mean", "std", "get(v, 0) AS min", "get(v, size(v) - 1) AS max", "rows - size(v) AS n_missing", "cast(size(v) as bigint) AS n",
            *[f"{percentile_of_sorted(p)} AS {name}" for name, p in points.items()],
        )
        return found.withColumn("iqr", F.col("q3") - F.col("q1"))
    counts = value_counts(melt(objects, keys, metrics), by, "value")
    weighted = F.sum(F.col("value") * F.col("n")) / F.sum(F.when(F.col("value").isNotNull(), F.col("n")))
    basic = counts.groupBy(*by).agg(
        weighted.alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("n"),
    )
    present = counts.filter("value IS NOT NULL")
    apart = present.join(basic.select(*by, "mean"), by).groupBy(*by).agg(
        F.sqrt(F.sum(F.col("n") * (F.col("value") - F.col("mean")) ** 2) / F.sum("n")).alias("std")
    )
    points = {"median": 0.5, "q1": 0.25, "q3": 0.75}
    ordered = order_counts(present, by, "value").groupBy(*by).agg(
        *[percentile_of_counts(p, "value").alias(name) for name, p in points.items()]
    )
    return (
        basic.join(apart, by, "left").join(ordered, by, "left").withColumn("iqr", F.col("q3") - F.col("q1"))
        .select(*by, "mean", "std", "min", "max", "n_missing", "n", *points, "iqr")
    )


BINS = "cast(CASE WHEN iqr > 0 THEN greatest(ceil((high - low) / (2.0D * iqr * pow(rows, -1.0D / 3.0D))), 1) ELSE 1 END as int)"
BIN = "cast(CASE WHEN high > low THEN least(floor((value - low) * bins / (high - low)), bins - 1) ELSE 0 END as int)"


def histogram(objects: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Equal-width histogram per metric with the Freedman-Diaconis bin width, empty bins included.

    Keys whose rows fit a task are sorted there; otherwise everything comes from the counts of distinct values.
    """
    by = [*keys, "metric"]
    if keys_fit(objects, keys):
        iqr = f"{percentile_of_sorted(0.75)} - {percentile_of_sorted(0.25)}"
        frame = sorted_values(objects, keys, metrics).filter("size(v) > 0").selectExpr(
            *by, "v", "get(v, 0) AS low", "get(v, size(v) - 1) AS high", "cast(size(v) as bigint) AS rows", f"{iqr} AS iqr",
        ).selectExpr(*by, "v", "low", "high", f"{BINS} AS bins")
        # every value in its bin, and every bin once with none
        every = "concat(transform(v, x -> struct(x AS value, cast(NULL as int) AS empty)), transform(sequence(0, bins - 1), b -> struct(cast(NULL as double) AS value, b AS empty)))"
        cells = frame.selectExpr(*by, "low", "high", "bins", f"inline({every})").selectExpr(*by, "low", "high", "bins", f"coalesce(empty, {BIN}) AS bin", "value")
        counted = cells.groupBy(*by, "low", "high", "bins", "bin").agg(F.count("value").alias("n"))
        return counted.selectExpr(*by, "bin", "low + bin * ((high - low) / bins) AS low", "n")
    counts = ordered_counts(melt(objects, keys, metrics), by, "value")
    stats = counts.groupBy(*by).agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.max("total").alias("rows"),
        (percentile_of_counts(0.75, "value") - percentile_of_counts(0.25, "value")).alias("iqr"),
    )
    frame = stats.selectExpr(
        *by, "low", "high",
        f"{BINS} AS bins",
    )
    placed = counts.join(frame, by).selectExpr(
        *by, "n",
        f"{BIN} AS bin",
    )
    counted = placed.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    grid = frame.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    return grid.join(counted, [*by, "bin"], "left").selectExpr(
        *by, "bin", "low + bin * ((high - low) / bins) AS low", "coalesce(n, 0) AS n"
    )


def flag_objects(objects: DataFrame, keys: list[str]) -> DataFrame:
    """Objects with a g-ratio of 0.99 or more, or an area within 5 times the smallest one."""
    least = objects.groupBy(*keys).agg(F.min("axon_area").alias("_axon"), F.min("myelin_area").alias("_myelin"))

    def on(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    flagged = objects.join(least, keys).select(
        *objects.columns,
        on(F.col("gratio") >= 0.99).alias("flag_gratio"),
        on(F.col("axon_area") <= F.col("_axon") * 5).alias("flag_axon"),
        on(F.col("myelin_area") <= F.col("_myelin") * 5).alias("flag_myelin"),
    )
    return flagged.filter("flag_gratio OR flag_axon OR flag_myelin")


RANKED = {"diameter": "axon_diam", "thickness": "myelin_thickness", "gratio": "gratio"}


def ranks(objects: DataFrame, keys: list[str]) -> DataFrame:
    """Rank, percentile rank and "k of n" text of diameter, thickness and g-ratio.

    Missing values count as the lowest, except in the absolute g-ratio rank, which leaves them out and shows -1.
    Keys whose rows fit a task are shuffled once and ranked there. Otherwise one set of value counts serves all three. Rows with a
    missing value never meet on it: their rank is a constant of their key, and in the joins they are spread by a hash that
    matches nothing.
    """
    if keys_fit(objects, keys):
        of_key = Window.partitionBy(*keys)
        out = objects.withColumn("_rows", F.count(F.lit(1)).over(of_key))
        for name, metric in RANKED.items():
            rising = of_key.orderBy(F.col(metric).asc_nulls_first())  # its range ends with the ties of a row
            out = out.withColumns({f"_{name}": F.rank().over(rising).cast("bigint"), f"_{name}_last": F.count(F.lit(1)).over(rising)})
        out = out.withColumn("_absent", (F.col("_rows") - F.count("gratio").over(of_key)))
        columns = {}
        for name in RANKED:
            below = F.col(f"_{name}") - 1
            rank = F.col(f"_{name}")
            if name == "gratio":
                rank = F.when(F.col("gratio").isNull(), F.lit(-1).cast("bigint")).otherwise(rank - F.col("_absent"))
            columns[f"{name}_rank"] = rank
            columns[f"{name}_percentile"] = fixed((below + (F.col(f"_{name}_last") - below + 1) / 2) / F.col("_rows") * 100, 1)
            columns[f"{name}_of"] = F.concat(rank, F.lit(" of "), F.col("_rows"))
        return out.select(
            *objects.columns, *[columns[f"{n}_{k}"].alias(f"{n}_{k}") for k in ("rank", "percentile", "of") for n in RANKED]
        )
    by = [*keys, "metric"]
    counts = value_counts(melt(objects, keys, list(RANKED.values())), by, "value")
    absent = counts.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("absent"), F.sum("n").alias("rows")
    )
    placed = materialize(order_counts(counts.filter("value IS NOT NULL"), by, "value").drop("total").join(absent, by), "ranks")
    out = objects
    for name, metric in RANKED.items():
        own = placed.filter(F.col("metric") == metric).selectExpr(
            *[f"{k} AS _{k}" for k in keys], "value AS _value", "0L AS _spread", f"below + 1 AS {name}_present",
            f"(below + absent + (n + 1) / 2) / rows AS {name}_above",
        )
        spread = F.when(F.col(metric).isNotNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(*objects.columns).bitwiseOR(1))
        value = F.coalesce(F.col(metric), F.lit(0.0))
        same = (value == F.col("_value")) & (spread == F.col("_spread"))
        for k in keys:
            same = same & (out[k] == F.col(f"_{k}"))
        out = out.join(own, same, "left").drop(*[f"_{k}" for k in keys], "_value", "_spread")
    # one row per key
    totals = absent.groupBy(*keys).agg(
        F.first("rows").alias("_rows"),
        *[F.max(F.when(F.col("metric") == m, F.col("absent"))).alias(f"_{n}") for n, m in RANKED.items()],
    )
    out = out.join(totals, keys)
    columns = {}
    for name in RANKED:
        present, missing = F.col(f"{name}_present"), F.col(f"_{name}")
        rank = F.when(present.isNull(), F.lit(1)).otherwise(present + missing)
        if name == "gratio":
            rank = F.coalesce(present, F.lit(-1))
        columns[f"{name}_rank"] = rank.cast("bigint")
        columns[f"{name}_percentile"] = fixed(F.coalesce(f"{name}_above", (missing + 1) / 2 / F.col("_rows")) * 100, 1)
        columns[f"{name}_of"] = F.concat(rank.cast("bigint"), F.lit(" of "), F.col("_rows"))
    return out.select(
        *objects.columns, *[columns[f"{n}_{k}"].alias(f"{n}_{k}") for k in ("rank", "percentile", "of") for n in RANKED]
    )
