"""Nerve sections: fascicle areas, axons per fascicle, densities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.functions.scalars import round_exact
from segstats.operators.components import label_components
from segstats.operators.masks import clip
from segstats.operators.regions import region_sums
from segstats.operators.runs import lookup
from segstats.plans.objects import measure_objects
from segstats.session import materialize

AREA_UNIT = "um^2"
DENSITY_UNIT = "axon/um^2"


def fascicle_areas(fascicles: DataFrame, pixel_size: float | None = None, images: DataFrame | None = None) -> DataFrame:
    """``(image_id, fascicle, area)``: areas of labelled nerve regions, counted from 0.

    A given ``pixel_size`` wins over ``um_per_px`` of ``images``.
    """
    sums = region_sums(fascicles)
    if pixel_size is None:
        sums = sums.join(images.select("image_id", "um_per_px"), "image_id")
    size = F.col("um_per_px") if pixel_size is None else F.lit(float(pixel_size))
    return sums.select("image_id", (F.col("label") - 1).alias("fascicle"), (F.col("area") * size**2).alias("area"))


def assign_fascicle(objects: DataFrame, fascicles: DataFrame, images: DataFrame) -> DataFrame:
    """Fascicle under each truncated centroid, -1 where there is none or outside the image."""
    points = objects.withColumn("y", F.col("y0").cast("int")).withColumn("x", F.col("x0").cast("int"))
    hit = lookup(points, fascicles.withColumnRenamed("label", "_region"), ["_region"])
    sized = hit.join(images.select("image_id", "height", "width"), "image_id", "left")
    inside = F.expr("y >= 0 AND y < height AND x >= 0 AND x < width")
    region = F.when(inside, F.col("_region") - 1)
    return sized.withColumn("fascicle_id", F.coalesce(region, F.lit(-1)).cast("bigint")).drop(
        "y", "x", "_region", "height", "width"
    )


def fascicle_density(areas: DataFrame, assigned: DataFrame) -> DataFrame:
    """Axons and density per fascicle, 0 where a fascicle holds none or has no area."""
    counts = assigned.filter("fascicle_id >= 0").groupBy("image_id", F.col("fascicle_id").alias("fascicle")).agg(
        F.count(F.lit(1)).alias("n")
    )
    n = F.coalesce("n", F.lit(0))
    return areas.join(counts, ["image_id", "fascicle"], "left").select(
        "image_id", "fascicle", "area", n.alias("n_axons"),
        F.when(F.col("area") > 0, round_exact(n / F.col("area"), 5)).otherwise(F.lit(0.0)).alias("density"),
    )


def total_density(areas: DataFrame, assigned: DataFrame) -> DataFrame:
    """Total area, assigned axons and overall density of each image."""
    area = areas.groupBy("image_id").agg(F.sum("area").alias("total_area"))
    axons = assigned.groupBy("image_id").agg(F.count_if(F.col("fascicle_id") >= 0).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return area.join(axons, "image_id", "left").select(
        "image_id", "total_area", n.alias("n_axons"),
        F.when(F.col("total_area") > 0, round_exact(n / F.col("total_area"), 5)).otherwise(F.lit(0.0)).alias("total_density"),
    )


def _measure(value, unit: str):
    return F.struct(value.cast("double").alias("value"), F.lit(unit).alias("unit"))


def nerve_document(areas: DataFrame, images: DataFrame) -> DataFrame:
    """One row per image with the fascicle map and the total; an empty mask totals 0."""
    entry = F.struct(F.col("fascicle").cast("string").alias("key"), _measure(F.col("area"), AREA_UNIT).alias("value"))
    # the document of an image lists its fascicles: a few dozen entries
    found = areas.groupBy("image_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("fascicle_areas"), F.sum("area").alias("total")
    )
    empty = F.create_map().cast("map<string,struct<value:double,unit:string>>")
    return images.select("image_id").join(found, "image_id", "left").select(
        "image_id",
        F.coalesce("fascicle_areas", empty).alias("fascicle_areas"),
        _measure(F.coalesce("total", F.lit(0.0)), AREA_UNIT).alias("total_area"),
    )


def add_densities(documents: DataFrame, assigned: DataFrame) -> DataFrame:
    """Add fascicle and total densities to nerve documents; ``total_area`` must be there."""
    counts = assigned.filter("fascicle_id >= 0").groupBy("image_id", "fascicle_id").agg(F.count(F.lit(1)).alias("n"))
    per_image = counts.groupBy("image_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("fascicle_id").cast("string"), F.col("n")))).alias("counts"),
        F.sum("n").alias("assigned"),
    )
    missing = F.raise_error(F.lit("total_area not found in the nerve document")).cast("double")
    total = F.coalesce(F.col("total_area.value"), missing)

    def density(n, area):
        return _measure(F.when(area > 0, round_exact(n / area, 5)).otherwise(F.lit(0.0)), DENSITY_UNIT)

    zipped = F.map_zip_with(
        "fascicle_areas", F.coalesce("counts", F.create_map().cast("map<string,bigint>")),
        lambda k, area, n: F.struct(
            area["value"].alias("value"), area["unit"].alias("unit"),
            density(F.coalesce(n, F.lit(0)), area["value"]).alias("axon_density"),
        ),
    )
    listed = F.map_filter(zipped, lambda k, v: v["value"].isNotNull())
    return documents.join(per_image, "image_id", "left").select(
        "image_id",
        listed.alias("fascicle_areas"),
        F.col("total_area"),
        density(F.coalesce("assigned", F.lit(0)), total).alias("total_axon_density"),
    )


def nerve_report(
    axon: DataFrame, myelin: DataFrame, nerve: DataFrame, images: DataFrame, pixel_size: float | None = None,
    extent: tuple[int, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Objects inside the nerve with their fascicle, and ``(image_id, fascicle, area, n_axons, density)``.

    Both are flat and have no limit. ``nerve_documents`` makes one row per image of them.
    """
    fascicles = materialize(label_components(nerve, 1, extent=extent), "fascicles")
    areas = fascicle_areas(fascicles, pixel_size, images)
    objects = measure_objects(
        clip(axon, nerve), images, clip(myelin, nerve), pixel_size, extent=extent
    )
    # written once: the densities count what the table lists
    assigned = materialize(assign_fascicle(objects, fascicles, images), "assigned")
    return assigned, fascicle_density(areas, assigned)


def nerve_documents(assigned: DataFrame, densities: DataFrame, images: DataFrame) -> DataFrame:
    """The documents of ``nerve_report``: a row per image that lists its fascicles, so for images with few of them."""
    return add_densities(nerve_document(densities.select("image_id", "fascicle", "area"), images), assigned)
