"""From a folder of images and masks to object tables, totals and nerve results."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segstats.plans.nerve import nerve_report
from segstats.plans.objects import image_totals, measure_objects
from segstats.session import materialize
from segstats.sources import files


class FolderResults(NamedTuple):
    """``totals`` exist for myelinated images, ``nerve`` (fascicle densities) for nerves, else None."""

    images: DataFrame
    objects: DataFrame
    totals: DataFrame | None = None
    nerve: DataFrame | None = None


def _plain(path) -> F.Column:
    return F.regexp_replace(path, "^file:/+", "/")


def read_masks(
    spark: SparkSession, root: str, mode: str = "myelinated", listing: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(image_id, height, width, dir)`` of ready images, and the set pixels ``(image_id, role, y, x)`` of their masks.

    An image is named by its path without the extension. A mask that a ready image lacks is an error, as is one of
    another size than its fellows.
    """
    listing = files.list_files(spark, root) if listing is None else listing
    needed = files.require_masks(listing, mode).select(
        F.concat("dir", F.lit("/"), "stem").alias("image_id"), "dir", "role", _plain("path").alias("_path")
    )
    named = materialize(needed, "masks")
    headers = files.read_headers(spark, root, listing).select(_plain("path").alias("_path"), "height", "width")
    sized = named.join(headers, "_path").groupBy("image_id", "dir").agg(
        F.max("height").alias("height"), F.max("width").alias("width"), F.min("height").alias("_h"), F.min("width").alias("_w")
    )
    odd = F.raise_error(F.concat(F.lit("masks of different sizes: "), "image_id")).cast("int")
    same = (F.col("height") == F.col("_h")) & (F.col("width") == F.col("_w"))
    images = sized.select("image_id", F.when(same, F.col("height")).otherwise(odd).alias("height"), "width", "dir")
    pixels = files.read_pixels(spark, root, "*_seg-*.png", listing).filter("v > 0").withColumn("_path", _plain("path"))
    return materialize(images, "images"), materialize(pixels.join(named, "_path").select("image_id", "role", "y", "x"), "pixels")


def measure_folder(
    spark: SparkSession, root: str, mode: str = "myelinated", axon_shape: str = "circle", pixel_size: float | None = None,
) -> FolderResults:
    """List, check and decode the masks under ``root`` and measure them; pixel sizes come from each folder's text file.

    A given ``pixel_size`` wins over the files; a folder without either is an error.
    """
    listing = files.list_files(spark, root)
    images, pixels = read_masks(spark, root, mode, listing)
    images = files.with_pixel_size(images, files.read_pixel_sizes(spark, root, listing), pixel_size)
    mask = {role: pixels.filter(F.col("role") == role).drop("role") for role in files.REQUIRED_MASKS[mode]}
    if mode == "unmyelinated":
        return FolderResults(images, measure_objects(mask["uaxon"], images, axon_shape=axon_shape))
    if mode == "nerve":
        objects, densities = nerve_report(mask["axon"], mask["myelin"], mask["nerve"], images)
        return FolderResults(images, objects, nerve=densities)
    objects = materialize(measure_objects(mask["axon"], images, mask["myelin"], axon_shape=axon_shape), "table")
    classes = pixels.withColumnRenamed("role", "cls")
    return FolderResults(images, objects, totals=image_totals(classes, objects, images))
