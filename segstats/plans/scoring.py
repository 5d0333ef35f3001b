"""Prediction against ground truth: pixels, objects, contours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.functions.order_stats import percentiles
from segstats.functions.scalars import round_exact
from segstats.operators.algebra import ROW, n_pixels, overlap_lengths, places, sweep
from segstats.operators.components import label_components
from segstats.operators.distance import distance_to_background
from segstats.operators.grouped import changes, stream_groups
from segstats.operators.masks import contour
from segstats.operators.regions import centroid_pixels, region_sums
from segstats.operators.runs import PIXEL, complement, lookup
from segstats.session import materialize


def confusion(
    prediction: DataFrame, truth: DataFrame, images: DataFrame, by: str | None = None, values: tuple = ()
) -> DataFrame:
    """Pixel counts tp, fp, fn, tn per image, or per image and value of the column ``by``, such as a class.

    Both masks are sparse; true negatives are what is left of the image. Every image has a
    row for each of ``values``, also where it has no such pixel.
    """
    keys = [by] if by else []
    cells = sweep({"p": prediction.select(*ROW, *places(prediction), *keys), "t": truth.select(*ROW, *places(truth), *keys)}, keys)
    p, t = F.col("p"), F.col("t")
    counted = cells.groupBy("image_id", *keys).agg(
        n_pixels(p & t).alias("tp"), n_pixels(p & ~t).alias("fp"), n_pixels(t & ~p).alias("fn")
    )
    size = F.col("height").cast("bigint") * F.col("width")
    grid = images.withColumn(by, F.explode(F.array(*[F.lit(v) for v in values]))) if by else images
    return grid.join(counted, ["image_id", *keys], "left").select(
        "image_id", *keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")],
        (size - F.coalesce(F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))).alias("tn"),
    )


def pixel_scores(counts: DataFrame) -> DataFrame:
    """Nine ratios of the confusion counts; undefined ones are null."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    ratio = F.try_divide
    sensitivity, precision = ratio(tp, tp + fn), ratio(tp, tp + fp)
    specificity = ratio(tn, tn + fp)
    return counts.select(
        "*",
        sensitivity.alias("sensitivity"),
        precision.alias("precision"),
        specificity.alias("specificity"),
        (1 - sensitivity).alias("fn_rate"),
        (1 - specificity).alias("fp_rate"),
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(2 * sensitivity * precision, sensitivity + precision).alias("f1"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("dice"),
        ratio(tp, tp + fp + fn).alias("jaccard"),
    )


def global_dice(counts: DataFrame) -> DataFrame:
    """Dice of whole masks, 1 when both are empty."""
    total = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return counts.select("image_id", F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.col("tp") / total).alias("dice"))


def object_dice(
    predicted: DataFrame, true: DataFrame, min_area: int = 3
) -> DataFrame:
    """Dice of each predicted object with the true object under its truncated centroid.

    Inputs are label runs. Objects of at most ``min_area`` pixels and those whose centroid
    meets no true object are left out.
    """
    sums = region_sums(predicted)
    hit = lookup(centroid_pixels(sums), true.withColumnRenamed("label", "true_label"), ["true_label"])
    pairs = (
        hit.filter("true_label IS NOT NULL").select("image_id", "label", "true_label")
        .join(sums.select("image_id", "label", "area"), ["image_id", "label"])
        .filter(F.col("area") > min_area)
    )
    common = overlap_lengths(predicted, true)
    true_area = region_sums(true).select("image_id", F.col("label").alias("true_label"), F.col("area").alias("true_area"))
    return (
        pairs.join(common, ["image_id", "label", "true_label"], "left")
        .join(true_area, ["image_id", "true_label"])
        .select(
            "image_id", "label", "true_label", "area",
            (2.0 * F.coalesce("common", F.lit(0)) / (F.col("area") + F.col("true_area"))).alias("dice"),
        )
    )


# The reported percentiles.
DICE_PERCENTILES = {f"percent_{p}": p / 100 for p in (5, 10, 25, 50, 75, 90, 95)}


def dice_distribution(dice: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, population deviation, extremes and percentiles of object Dice."""
    basic = dice.groupBy(*keys).agg(
        F.avg("dice").alias("mean"), F.stddev_pop("dice").alias("std"),
        F.min("dice").alias("min"), F.max("dice").alias("max"),
    )
    return basic.join(percentiles(dice, keys, "dice", DICE_PERCENTILES), keys)


def match_centroids(predicted: DataFrame, true: DataFrame, min_area: int = 2) -> DataFrame:
    """Each distinct predicted centroid with the true object it falls in, nearest first.

    ``place`` 1 is the match of a true object, higher places are extra detections and a
    null ``true_label`` is a false positive.
    """
    spots = (
        centroid_pixels(region_sums(predicted).filter(F.col("area") > min_area)).select(*PIXEL).distinct()
    )
    sums = region_sums(true)
    centres = centroid_pixels(sums).select(
        "image_id", F.col("label").alias("true_label"), F.col("y").alias("cy"), F.col("x").alias("cx")
    )
    hit = lookup(spots, true.withColumnRenamed("label", "true_label"), ["true_label"]).join(
        centres, ["image_id", "true_label"], "left"
    )
    d2 = (F.col("y") - F.col("cy")) ** 2 + (F.col("x") - F.col("cx")) ** 2
    scored = hit.withColumn("d2", d2.cast("bigint")).drop("cy", "cx")
    # the nearest candidate by aggregation, so a region full of candidates is no window
    nearest = scored.filter("true_label IS NOT NULL").groupBy("image_id", "true_label").agg(
        F.min(F.struct("d2", "y", "x")).alias("best")
    )
    is_best = (F.col("best.y") == F.col("y")) & (F.col("best.x") == F.col("x"))
    return scored.join(nearest, ["image_id", "true_label"], "left").select(
        *PIXEL, "true_label", "d2", F.coalesce(is_best, F.lit(False)).alias("matched")
    )


def detection_scores(predicted: DataFrame, true: DataFrame, images: DataFrame, min_area: int = 2) -> DataFrame:
    """Sensitivity, precision and diffusion of object detection per image."""
    found = match_centroids(predicted, true, min_area).groupBy("image_id").agg(
        F.count_if("matched").alias("tp"),
        F.count_if(F.col("true_label").isNull()).alias("fp"),
        F.count_if(F.col("true_label").isNotNull() & ~F.col("matched")).alias("extra"),
    )
    actual = region_sums(true).groupBy("image_id").agg(F.count(F.lit(1)).alias("p"))
    out = images.select("image_id").join(found, "image_id", "left").join(actual, "image_id", "left").na.fill(
        0, ["tp", "fp", "extra", "p"]
    )
    shown = F.col("tp") + F.col("fp")
    return out.select(
        "image_id", "p", "tp", "fp", "extra",
        round_exact(F.try_divide(F.col("tp").cast("double"), F.col("p")), 3).alias("sensitivity"),
        round_exact(F.try_divide(F.col("tp").cast("double"), shown), 3).alias("precision"),
        round_exact(F.try_divide(F.col("extra").cast("double"), shown), 4).alias("diffusion"),
    )


def directed_hausdorff(from_mask: DataFrame, to_mask: DataFrame, images: DataFrame, radius: int = 3) -> DataFrame:
    """Largest distance from a contour pixel of one mask to the nearest of the other.

    The nearest distances come from a distance transform around the target contour, so no
    pair of contour pixels is formed. Null where a contour is missing.
    """
    source, target = contour(from_mask, images, radius), contour(to_mask, images, radius)
    around = distance_to_background(complement(target, images), images)
    joined = source.join(around, PIXEL, "left").join(
        target.select(*PIXEL, F.lit(0).cast("bigint").alias("on")), PIXEL, "left"
    )
    nearest = joined.groupBy("image_id").agg(F.max(F.coalesce("on", "d2")).alias("d2"))
    return images.select("image_id").join(nearest, "image_id", "left").select(
        "image_id", F.sqrt("d2").alias("hausdorff")
    )


ROW_BLOCK = 256


def _nearest_rows(table: pa.Table) -> pa.Table:
    """Smallest number of differing columns for each source row of a block pair."""
    starts = np.append(np.flatnonzero(changes(table, BLOCK_PAIR)), table.num_rows)
    columns = table["xs"].to_pylist()
    source = table["source"].to_numpy(zero_copy_only=False)
    best = np.full(table.num_rows, -1, np.int64)
    for lo, hi in zip(starts[:-1], starts[1:]):
        bits = np.zeros((hi - lo, max((max(c, default=0) for c in columns[lo:hi]), default=0) + 1), np.float32)
        for i, xs in enumerate(columns[lo:hi]):
            bits[i, xs] = 1
        here = source[lo:hi]
        a, b = bits[here], bits[~here]
        if len(a) and len(b):
            differ = a.sum(1)[:, None] + b.sum(1)[None, :] - 2 * (a @ b.T)
            best[lo:hi][here] = differ.min(1).astype(np.int64)
    kept = np.flatnonzero(best >= 0)
    return table.select(["image_id", "xs"]).take(pa.array(kept)).append_column("d2", pa.array(best[kept]))


BLOCK_PAIR = ["image_id", "block_a", "block_b"]


def row_hausdorff(from_mask: DataFrame, to_mask: DataFrame, images: DataFrame, radius: int = 3) -> DataFrame:
    """Directed Hausdorff distance between contour *rows*, each taken as a 0/1 vector.

    Rows are reduced to distinct patterns and hashed into blocks of about ``ROW_BLOCK``.
    Blocks meet block by block and only each row's minimum leaves a task.
    """
    lines = images.select("image_id", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))

    def patterns(mask: DataFrame, block: str) -> DataFrame:
        # an array is bounded by the image width
        xs = contour(mask, images, radius).groupBy("image_id", "y").agg(F.array_sort(F.collect_list("x")).alias("xs"))
        empty = F.array().cast("array<int>")
        rows = lines.join(xs, ["image_id", "y"], "left").select("image_id", F.coalesce("xs", empty).alias("xs")).distinct()
        blocks = rows.groupBy("image_id").agg(F.ceil(F.count(F.lit(1)) / ROW_BLOCK).cast("int").alias("n"))
        return rows.join(blocks, "image_id").withColumn(block, F.pmod(F.xxhash64("xs"), F.col("n")).cast("int"))

    a, b = patterns(from_mask, "block_a"), patterns(to_mask, "block_b")
    count_a, count_b = (
        m.groupBy("image_id").agg(F.max("n").alias("other")) for m in (a, b)
    )

    def facing(side: DataFrame, others: DataFrame, block: str, source: bool) -> DataFrame:
        spread = F.explode(F.sequence(F.lit(0), F.col("other") - 1)).alias(block)
        return side.join(others, "image_id").select("*", spread).select(*BLOCK_PAIR, "xs", F.lit(source).alias("source"))

    pairs = facing(a, count_b, "block_b", True).unionByName(facing(b, count_a, "block_a", False))
    kind = images.schema["image_id"].dataType.simpleString()
    nearest = stream_groups(
        pairs, BLOCK_PAIR, [], _nearest_rows, f"image_id {kind}, xs array<int>, d2 bigint", chunk_rows=2048
    )
    best = nearest.groupBy("image_id", "xs").agg(F.min("d2").alias("d2"))
    return best.groupBy("image_id").agg(F.sqrt(F.max("d2")).alias("hausdorff"))


def class_report(prediction: DataFrame, truth: DataFrame, images: DataFrame, extent=None) -> DataFrame:
    """Two-class report: pixel scores of axon and myelin, object Dice of axons.

    Inputs are pixels with ``cls``.
    """
    scores = pixel_scores(confusion(prediction, truth, images, "cls", ("axon", "myelin")))
    axon = [
        materialize(label_components(m.filter("cls = 'axon'"), 2, extent=extent), "objects") for m in (prediction, truth)
    ]
    dice = dice_distribution(object_dice(*axon, min_area=5), ["image_id"])
    objects = dice.select("image_id", F.lit("axon").alias("cls"), *[F.col(c).alias(f"object_dice_{c}") for c in dice.columns[1:]])
    return scores.join(objects, ["image_id", "cls"], "left")
