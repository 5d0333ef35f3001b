"""Painting, outlines, crops and rasterised shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstats.constants import PALETTE
from segstats.operators.runs import PIXEL, TILE, as_pixels, as_runs, cut_to_tiles, div, lookup
from segstats.session import materialize

CROP_TILE = 64
PIXELS_PER_TASK, SHAPES_PER_TASK = 500_000, 20_000


def paint(labels: DataFrame, table: DataFrame, how: str = "inner", tile: int = TILE) -> DataFrame:
    """Label runs joined with a per-object ``table (image_id, label, ...)``.

    The table first meets the tiles an object lies in, then the runs of each tile, so an
    object that fills the image is spread over its tiles instead of being one join key.
    """
    runs = cut_to_tiles(as_runs(labels).select("image_id", "y", "x0", "x1", "label"), tile)
    key = ["image_id", "label", "ty", "tx"]
    parts = runs.select(*key).distinct().join(table, ["image_id", "label"], "inner")
    return runs.join(parts, key, how).drop("ty", "tx")


def numbered_points(objects: DataFrame, pixel_size: Column | float = 1.0) -> DataFrame:
    """Index 0..n-1 at each centroid, with the image's mean diameter in pixels and text size."""
    size = F.lit(pixel_size) if isinstance(pixel_size, (int, float)) else pixel_size
    scale = objects.groupBy("image_id").agg((F.avg("axon_diam") / F.first(size)).alias("mean_diam_px"))
    points = objects.select("image_id", (F.col("label") - 1).alias("idx"), "x0", "y0")
    return points.join(scale, "image_id").withColumn(
        "text_px", F.greatest(F.floor(F.col("mean_diam_px") / 3), F.lit(10)).cast("int")
    )


def rasterize(shapes: DataFrame, images: DataFrame) -> DataFrame:
    """Ellipses with a sheath as mask pixels: 255 inside, 127 in the ring, first shape wins.

    ``shapes (image_id, shape_id, radius, cx, cy, gratio, plane_angle)``; the angle in
    degrees stretches x. Each shape only visits the pixels of its own outer ellipse; of equal ones only the first can win a pixel.
    """
    form = ["image_id", "radius", "cx", "cy", "gratio", "plane_angle"]
    shapes = materialize(shapes.groupBy(*form).agg(F.min("shape_id").alias("shape_id")), "shapes")
    tasks = shapes.count() // SHAPES_PER_TASK + shapes.sparkSession.sparkContext.defaultParallelism
    shapes = shapes.repartition(tasks, "image_id", "shape_id")
    outer = F.col("radius") + F.col("radius") * (1 / F.col("gratio") - 1)
    stretch = F.cos(F.radians("plane_angle"))
    sized = shapes.join(images, "image_id").select(
        "image_id", "shape_id", "cx", "cy", "height", "width", "radius",
        (F.col("radius") / stretch).alias("ax"), outer.alias("oy"), (outer / stretch).alias("ox"),
    )
    low = F.greatest(F.ceil(F.col("cy") - F.col("oy")), F.lit(0))
    high = F.least(F.floor(F.col("cy") + F.col("oy")), F.col("height") - 1)
    rows = sized.filter(low <= high).withColumn("y", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    dy = F.col("y") - F.col("cy")
    half = F.col("ox") * F.sqrt(F.greatest(F.lit(0.0), 1 - dy * dy / (F.col("oy") * F.col("oy")))) + 1
    left = F.greatest(F.floor(F.col("cx") - half), F.lit(0))
    right = F.least(F.ceil(F.col("cx") + half), F.col("width") - 1)
    cells = rows.filter(left <= right).withColumn("x", F.explode(F.sequence(left.cast("int"), right.cast("int"))))
    dx = F.col("x") - F.col("cx")

    def inside(a: str, b: str) -> Column:
        return dx * dx / (F.col(a) * F.col(a)) + dy * dy / (F.col(b) * F.col(b)) < 1

    v = F.when(inside("ax", "radius"), 255).when(inside("ox", "oy"), 127)
    return cells.withColumn("v", v).filter("v IS NOT NULL").groupBy(*PIXEL).agg(F.min_by("v", "shape_id").alias("v"))


def ellipse_points(df: DataFrame, n: int, cx: str, cy: str, major: str, minor: str, angle: str) -> DataFrame:
    """``n`` outline points ``(k, px, py)`` per row; the angle runs from axis 0 to the major axis."""
    t = F.col("k") * F.lit(2.0) * F.pi() / n
    turn = -F.col(angle)
    ex, ey = F.col(minor) * F.cos(t), F.col(major) * F.sin(t)
    return df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(
        *df.columns,
        "k",
        (F.col(cx) + ex * F.cos(turn) - ey * F.sin(turn)).alias("px"),
        (F.col(cy) + ex * F.sin(turn) + ey * F.cos(turn)).alias("py"),
    )


def diameter_outlines(objects: DataFrame, pixel_size: float, axon_shape: str = "circle", n: int = 64) -> DataFrame:
    """Inner (axon) and outer (fibre) outline points of every measurable object."""
    radius = F.col("axon_diam") / pixel_size / 2
    outer = radius + F.col("myelin_thickness") / pixel_size
    null = F.lit(None).cast("double")
    if axon_shape == "circle":
        first = F.struct(F.lit("axon").alias("ring"), radius.alias("minor"), radius.alias("major"), F.lit(0.0).alias("angle"))
        second = F.struct(F.lit("fibre").alias("ring"), outer.alias("minor"), outer.alias("major"), F.lit(0.0).alias("angle"))
        kept = objects
    elif axon_shape == "ellipse":
        def major(minor: Column, e: str) -> Column:
            valid = (F.col(e) >= 0) & (F.col(e) < 1)
            return F.when(valid, minor / F.sqrt(F.when(valid, 1 - F.col(e) * F.col(e))))

        kept = objects.filter("eccentricity >= 0 AND eccentricity < 1")
        first = F.struct(
            F.lit("axon").alias("ring"), radius.alias("minor"), major(radius, "eccentricity").alias("major"),
            F.coalesce("orientation", F.lit(0.0)).alias("angle"),
        )
        second = F.struct(
            F.lit("fibre").alias("ring"), outer.alias("minor"),
            F.when(F.col("fiber_orientation").isNotNull(), major(outer, "fiber_eccentricity")).otherwise(null).alias("major"),
            F.col("fiber_orientation").alias("angle"),
        )
    else:
        raise ValueError("axon_shape must be 'circle' or 'ellipse'")
    rings = (
        kept.filter("x0 IS NOT NULL AND y0 IS NOT NULL AND axon_diam IS NOT NULL")
        .select("image_id", "label", "x0", "y0", F.explode(F.array(first, second)).alias("r"))
        .select("image_id", "label", "x0", "y0", "r.*")
        .filter("minor IS NOT NULL AND major IS NOT NULL")
    )
    return ellipse_points(rings, n, "x0", "y0", "major", "minor", "angle").select(
        "image_id", "label", "ring", "k", "px", "py"
    )


# Fixed values of this engine: odd multipliers that scatter an index over 16 bits per channel.
_SCATTER = (40503, 30011, 51749)


def instance_colour(label: Column, palette: list[tuple[int, int, int]] = PALETTE, seed: int = 42) -> Column:
    """Colour of an instance: between two neighbouring palette colours, scattered by index."""
    if len(palette) < 4:
        raise ValueError("a palette needs 4 colours or more")
    index = label.cast("bigint") - 1
    segment = F.pmod(index, F.lit(len(palette) - 1))
    channels = []
    for c, name in enumerate("rgb"):
        low = F.array(*[F.lit(min(a[c], b[c])) for a, b in zip(palette, palette[1:])])
        span = F.array(*[F.lit(abs(a[c] - b[c]) + 1) for a, b in zip(palette, palette[1:])])
        scatter = F.pmod((index + seed) * _SCATTER[c], F.lit(65536))
        at = segment.cast("int")
        channels.append((low[at] + F.shiftright(span[at] * scatter, 16)).cast("int").alias(name))
    return F.struct(*channels)


def colour_instances(labels: DataFrame, palette=PALETTE, seed: int = 42) -> DataFrame:
    return labels.withColumn("rgb", instance_colour(F.col("label"), palette, seed))


def _rgb(r: int, g: int, b: int) -> Column:
    return F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"))


def class_colours(pixels: DataFrame, style: str = "index") -> DataFrame:
    """Class colours: ``index`` axon blue on red myelin, ``overlay`` axon red on green myelin."""
    axon, myelin = {"index": ((0, 0, 255), (255, 0, 0)), "overlay": ((255, 0, 0), (0, 255, 0))}[style]
    colour = F.when(F.col("cls") == "axon", _rgb(*axon)).when(F.col("cls") == "myelin", _rgb(*myelin))
    return pixels.withColumn("rgb", F.coalesce(colour, _rgb(0, 0, 0)))


def closeups(
    regions: DataFrame, pixels: DataFrame, labels: DataFrame, images: DataFrame, buffer: int = 20
) -> DataFrame:
    """Crop pixels around every object, one row per crop pixel.

    ``pixels (image_id, y, x, v, axon, myelin)``. A crop pixel keeps its gray value; the
    class flags are set only on the object's own pixels. Boxes meet pixels tile by tile.
    """
    boxes = regions.join(images, "image_id").select(
        "image_id", F.col("label").alias("object"),
        F.greatest(F.lit(0), F.col("bbox_min_y") - buffer).alias("top"),
        F.greatest(F.lit(0), F.col("bbox_min_x") - buffer).alias("left"),
        F.least("height", F.col("bbox_max_y") + buffer).alias("bottom"),
        F.least("width", F.col("bbox_max_x") + buffer).alias("right"),
    )
    spread = (
        boxes.withColumn("ty", F.explode(F.sequence(div("top", CROP_TILE), div(F.col("bottom") - 1, CROP_TILE))))
        .withColumn("tx", F.explode(F.sequence(div("left", CROP_TILE), div(F.col("right") - 1, CROP_TILE))))
    )
    # as many tasks as the images' pixels need, so that the rows a join sorts in one task do not grow with the table
    n_pixels = images.agg(F.sum(F.col("height").cast("bigint") * F.col("width"))).first()[0] or 0
    tasks = n_pixels // PIXELS_PER_TASK + images.sparkSession.sparkContext.defaultParallelism
    own = as_pixels(labels).select(*PIXEL, "label").repartition(tasks, *PIXEL)
    owned = pixels.repartition(tasks, *PIXEL).join(own, PIXEL, "left").select(
        "*", div("y", CROP_TILE).alias("ty"), div("x", CROP_TILE).alias("tx")
    )
    tile = ["image_id", "ty", "tx"]
    mine = F.coalesce(F.col("label") == F.col("object"), F.lit(False))
    return (
        owned.repartition(tasks, *tile).join(spread.repartition(tasks, *tile), tile)
        .filter("y >= top AND y < bottom AND x >= left AND x < right")
        .select(
            "image_id", "object", (F.col("y") - F.col("top")).alias("cy"), (F.col("x") - F.col("left")).alias("cx"),
            "v", (mine & F.col("axon")).alias("own_axon"), (mine & F.col("myelin")).alias("own_myelin"),
        )
    )


def flagged_mask(labels: DataFrame, flagged: DataFrame) -> DataFrame:
    """Pixels of flagged objects; ``flagged (image_id, idx)`` counts from 0."""
    ids = flagged.select("image_id", (F.col("idx") + 1).cast("bigint").alias("label")).distinct()
    return as_pixels(paint(labels, ids)).select(*PIXEL)


def metric_map(labels: DataFrame, objects: DataFrame, metric: str = "axon_diam") -> DataFrame:
    """Every object pixel painted with one of its metrics."""
    painted = paint(labels, objects.select("image_id", "label", metric))
    return as_pixels(painted).select(*PIXEL, metric)


def metrics_at(points: DataFrame, labels: DataFrame, objects: DataFrame, metrics: list[str]) -> DataFrame:
    """Object and metrics under each point; background and points outside give nulls."""
    hit = lookup(points, as_runs(labels), ["label"])
    return hit.join(objects.select("image_id", "label", *metrics), ["image_id", "label"], "left")
