"""From masks to the object table, and per-image totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.operators.components import label_components
from segstats.operators.masks import enclosed_holes
from segstats.operators.regions import OBJECT, centroid_pixels, ellipse, measure_regions, perimeters, region_sums
from segstats.operators.runs import PIXEL, TILE, as_pixels, lookup
from segstats.operators.watershed import flood, grow, seed_points
from segstats.schema import OBJECT_MEASURES
from segstats.session import materialize

BOX = ["bbox_min_y", "bbox_min_x", "bbox_max_y", "bbox_max_x"]


def _diameter(shape: str) -> str:
    if shape not in ("circle", "ellipse"):
        raise ValueError("axon_shape must be 'circle' or 'ellipse'")
    return "equivalent_diameter" if shape == "circle" else "minor_axis"


def fibre_labels(
    axon: DataFrame, myelin: DataFrame, axon_labels: DataFrame, images: DataFrame,
    extent=None, mode: str = "flood", fill_holes: bool = False, tile: int = TILE,
) -> DataFrame:
    """Instance map of whole fibres, as runs ``(image_id, y, x0, x1, label)``."""
    if fill_holes:
        both = as_pixels(axon).select(*PIXEL).union(as_pixels(myelin).select(*PIXEL)).distinct()
        myelin = as_pixels(myelin).select(*PIXEL).union(enclosed_holes(both, images, extent))
    seeds = seed_points(axon_labels)
    if mode == "grow":
        return grow(axon, myelin, seeds, tile, extent)
    if mode in ("flood", "arrival"):
        return flood(axon, myelin, seeds, images, extent, tile, mode == "arrival")
    raise ValueError("mode must be 'grow', 'flood' or 'arrival'")


def fibre_metrics(matched: DataFrame, axon_shape: str = "circle") -> DataFrame:
    """Thickness, myelin area and g-ratio of axons matched with a fibre (in pixels).

    ``plausible`` is the check that both sizes are positive and the fibre is the larger.
    """
    name = _diameter(axon_shape)
    sized = matched.selectExpr("*", f"{name} AS _d", f"fibre_{name} AS _f", f"(fibre_{name} - {name}) / 2 AS _t")
    # a zero denominator voids all measures that depend on it
    valid = "_d / 2 + _t <> 0"
    return sized.selectExpr(
        *matched.columns,
        "try_divide(_d / 2, _d / 2 + _t) AS gratio",
        f"CASE WHEN {valid} THEN _t END AS thickness_px",
        f"CASE WHEN {valid} THEN fibre_area - area END AS myelin_area_px",
        "_d > 0 AND _f > 0 AND _f > _d AS plausible",
    )


def measure_objects(
    axon: DataFrame,
    images: DataFrame,
    myelin: DataFrame | None = None,
    pixel_size: float | None = None,
    axon_shape: str = "circle",
    extent: tuple[int, int] | None = None,
    mode: str = "flood",
    fill_holes: bool = False,
    tile: int = TILE,
) -> DataFrame:
    """Object table of axon masks, with fibre measures when a myelin mask is given.

    ``images (image_id, height, width[, um_per_px])``; a given ``pixel_size`` wins over
    the column. Objects join diagonally with a myelin mask and by sides without one.
    """
    # labels feed sums, borders, hulls and seeds: written once instead of labelled four times
    labels = materialize(label_components(axon, 1 if myelin is None else 2, extent=extent, tile=tile), "objects")
    size = f"{float(pixel_size)!r}D" if pixel_size is not None else "um_per_px"
    base = measure_regions(labels, tile=tile)
    kind = axon.schema["image_id"].dataType
    axon_measures = [
        *OBJECT, "x0", "y0", "solidity", "eccentricity", "orientation", f"{_diameter(axon_shape)} * {size} AS axon_diam",
        f"area * {size} * {size} AS axon_area", f"perimeter * {size} AS axon_perimeter",
    ]
    if myelin is None:
        return conform(base.join(images, "image_id").selectExpr(*axon_measures), kind)

    # written once: sums, borders, hulls and the look-up below all read it
    fibres = materialize(fibre_labels(axon, myelin, labels, images, extent, mode, fill_holes, tile), "fibres")
    measured = ellipse(region_sums(fibres)).join(perimeters(fibres, tile), OBJECT).selectExpr(
        "image_id", "label AS fibre", "area AS fibre_area", "equivalent_diameter AS fibre_equivalent_diameter",
        "minor_axis AS fibre_minor_axis", "perimeter AS fibre_perimeter", "orientation AS fiber_orientation",
        "eccentricity AS fiber_eccentricity", *BOX,
    )
    found = lookup(centroid_pixels(base), fibres.withColumnRenamed("label", "fibre"), ["fibre"], tile)
    matched = (
        base.drop(*BOX).join(found.select(*OBJECT, "fibre"), OBJECT)
        .join(measured, ["image_id", "fibre"], "left")
        .join(images, "image_id")
    )
    out = fibre_metrics(matched, axon_shape).selectExpr(
        *axon_measures, "fiber_orientation", "fiber_eccentricity", "gratio",
        f"thickness_px * {size} AS myelin_thickness", f"myelin_area_px * {size} * {size} AS myelin_area",
        f"CASE WHEN gratio IS NOT NULL THEN fibre_area * {size} * {size} END AS axonmyelin_area",
        f"CASE WHEN gratio IS NOT NULL THEN fibre_perimeter * {size} END AS axonmyelin_perimeter",
        "least(bbox_min_y, bbox_min_x) = 0 OR bbox_max_y = height OR bbox_max_x = width AS image_border_touching", *BOX,
    )
    return conform(out, kind)


def conform(objects: DataFrame, image_type) -> DataFrame:
    """The fixed object schema; measures a mode does not produce are null."""
    have = set(objects.columns)
    measures = [
        f"cast({f.name if f.name in have else 'null'} as {f.dataType.simpleString()}) AS {f.name}"
        for f in OBJECT_MEASURES.fields
    ]
    return objects.selectExpr(
        f"cast(image_id as {image_type.simpleString()}) AS image_id", "cast(label as bigint) AS label", *measures
    )


def mask_fractions(classes: DataFrame, images: DataFrame) -> DataFrame:
    """Axon and myelin volume fraction of every image; ``classes (image_id, ..., cls)``."""
    counted = classes.groupBy("image_id").agg(
        F.count_if(F.col("cls") == "axon").alias("axon_px"), F.count_if(F.col("cls") == "myelin").alias("myelin_px")
    )
    area = F.col("height").cast("double") * F.col("width")
    return images.join(counted, "image_id", "left").select(
        "image_id", "height", "width",
        (F.coalesce("axon_px", F.lit(0)) / area).alias("avf"),
        (F.coalesce("myelin_px", F.lit(0)) / area).alias("mvf"),
    )


def image_totals(classes: DataFrame, objects: DataFrame, images: DataFrame, pixel_size: float | None = None) -> DataFrame:
    """The seven per-image aggregates from class pixels and the axon table.

    A given ``pixel_size`` wins over the images' ``um_per_px``.
    """
    size = F.col("um_per_px") if pixel_size is None else F.lit(float(pixel_size))
    sizes = images.select("image_id", size.alias("um_per_px"))
    per_image = objects.groupBy("image_id").agg(
        F.avg("axon_diam").alias("mean_axon_diam"), F.count(F.lit(1)).alias("n_axons")
    )
    gratio = F.sqrt(F.try_divide(F.lit(1.0), 1 + F.try_divide(F.col("mvf"), F.col("avf"))))
    out = mask_fractions(classes, images).join(sizes, "image_id").join(per_image, "image_id", "left").withColumn("gratio_aggr", gratio)
    out = out.withColumn("mean_myelin_diam", F.try_divide(F.col("mean_axon_diam"), F.col("gratio_aggr")))
    mm2 = F.col("height").cast("double") * F.col("width") * (F.col("um_per_px") * F.col("um_per_px")) / 1_000_000
    return out.select(
        "image_id", "avf", "mvf", "gratio_aggr", "mean_axon_diam", "mean_myelin_diam",
        (F.col("mean_myelin_diam") / 2 - F.col("mean_axon_diam") / 2).alias("mean_myelin_thickness"),
        (F.coalesce("n_axons", F.lit(0)) / mm2).alias("axon_density_mm2"),
    )
