"""Components, regions, masks, growth and geometry on the raster views."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog.views import (
    AXON, EXTENT, NERVE, PIXEL, POINTS, PX, SLIDE, arrival_sql, axon, cols, components_sql, flood_sql, grow_sql, hull_sql, images, myelin, nerve,
    perimeter_sql, points, predicted_classes, query, raster_runs, rasters, regions_sql, seeds_sql, slide, slide_size, table,
)
from segstats.functions.scalars import float_to_bits
from segstats.operators import geometry, masks, patches
from segstats.operators.algebra import n_pixels, sweep
from segstats.operators.blocks import image_blocks
from segstats.operators.components import label_components
from segstats.operators.distance import distance_to_background
from segstats.operators.regions import centroid_pixels, hull_areas, measure_regions, perimeters, region_sums
from segstats.operators.runs import as_pixels, complement, compress
from segstats.operators.watershed import flood, remove_fibres, seed_points
from segstats.plans.objects import fibre_labels, measure_objects
from segstats.session import materialize

P = "image_id; y; x"


def axon_labels(spark, sf, connectivity=2):
    return materialize(label_components(axon(spark, sf), connectivity, extent=EXTENT), "labels")


# ---- components -----------------------------------------------------------------------


def _components(connectivity):
    name = "components_sides" if connectivity == 1 else "components_diagonal"
    sql = f"WITH RECURSIVE {PX}, {components_sql('l', 'axon', connectivity)} SELECT {cols(P + '; label')} FROM l"

    @query(name, sql)
    def run(spark, sf):
        return as_pixels(label_components(axon(spark, sf), connectivity, extent=EXTENT)).select(*PIXEL, "label")


_components(1)
_components(2)


@query(
    "components_by_value",
    f"""WITH RECURSIVE {PX},
n AS (SELECT a.image_id, a.pos AS p, b.pos AS q FROM pcls a JOIN pcls b ON a.image_id = b.image_id AND a.cls = b.cls
  AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
r AS (SELECT image_id, pos AS s, pos AS p FROM pcls UNION
  SELECT r.image_id, r.s, n.q FROM r JOIN n ON r.image_id = n.image_id AND r.p = n.p),
l AS (SELECT image_id, p AS pos, min(s) AS root FROM r GROUP BY ALL)
SELECT image_id, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS BIGINT) AS label, {cols('y; x')}, cls
FROM l JOIN pcls USING (image_id, pos)""",
)
def components_by_value(spark, sf):
    labels = label_components(predicted_classes(spark, sf), 1, value="cls", extent=EXTENT)
    return as_pixels(labels).select(*PIXEL, "label", "cls")


SLIDE_LABELS = f"""{SLIDE}, fg AS (SELECT y, x FROM cells WHERE v > 25),
n AS (SELECT f.y, f.x, f.y + dy AS ny, f.x + dx AS nx FROM fg f, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx)
  WHERE dy <> 0 OR dx <> 0),
e AS (SELECT n.* FROM n JOIN fg ON fg.y = n.ny AND fg.x = n.nx),
r AS (SELECT y * 100000 + x AS root, y, x FROM fg UNION SELECT r.root, e.ny, e.nx FROM r JOIN e ON r.y = e.y AND r.x = e.x),
l AS (SELECT 0 AS image_id, y, x, y * 1000 + x AS pos, dense_rank() OVER (ORDER BY root) AS label
  FROM (SELECT y, x, min(root) AS root FROM r GROUP BY ALL))"""


@query(
    "slide_components",
    f"""WITH RECURSIVE {SLIDE_LABELS}
SELECT CAST(0 AS BIGINT) AS image_id, {cols('label; count(*):area; min(y):min_y; min(x):min_x; max(y) + 1:max_y; max(x) + 1:max_x')}
FROM l GROUP BY label""",
)
def slide_components(spark, sf):
    labels = label_components(slide(spark, sf).filter("v > 25").select(*PIXEL), 2)
    return region_sums(labels).select(
        "image_id", "label", "area", F.col("bbox_min_y").alias("min_y"), F.col("bbox_min_x").alias("min_x"),
        F.col("bbox_max_y").alias("max_y"), F.col("bbox_max_x").alias("max_x"),
    )


def slide_mask(spark, sf):
    return slide(spark, sf).filter("v > 25").select(*PIXEL)


@query(
    "slide_perimeter",
    f"WITH RECURSIVE {SLIDE_LABELS}, {perimeter_sql('q', 'l')} SELECT {cols('image_id; label', 'perimeter')} FROM q",
)
def slide_perimeter(spark, sf):
    return perimeters(label_components(slide_mask(spark, sf), 2))


#: Background places of the slide within 16 pixels of a set one; its cells are too mixed for a farther nearest one.
NEAR = f"""{SLIDE}, fg AS (SELECT y, x FROM cells WHERE v > 25), h AS (SELECT max(y) + 1 AS height FROM cells),
o AS (SELECT dy, dx, dy * dy + dx * dx AS d2 FROM range(-16, 17) a(dy), range(-16, 17) b(dx)),
c AS (SELECT fg.y, fg.x, fg.y + dy AS ny, fg.x + dx AS nx, d2 FROM fg, o, h
  WHERE fg.y + dy >= 0 AND fg.y + dy < height AND fg.x + dx >= 0 AND fg.x + dx < 1000),
near AS (SELECT c.y, c.x, min(c.d2) AS d2 FROM c ANTI JOIN fg ON fg.y = c.ny AND fg.x = c.nx GROUP BY ALL)"""


@query(
    "slide_distance",
    f"WITH {NEAR} SELECT CAST(0 AS BIGINT) AS image_id, {cols('y; x; d2', 'sqrt(d2):dist')} FROM near",
)
def slide_distance(spark, sf):
    return distance_to_background(slide_mask(spark, sf), slide_size(spark, sf))


@query("slide_contour", f"WITH {NEAR} SELECT CAST(0 AS BIGINT) AS image_id, {cols('y; x')} FROM near WHERE d2 <= 9")
def slide_contour(spark, sf):
    return masks.contour(slide_mask(spark, sf), slide_size(spark, sf), 3)


# ---- regions --------------------------------------------------------------------------

REGION_SQL = f"WITH RECURSIVE {PX}, {components_sql('l', 'axon', 2)}, {regions_sql('r', 'l')}"


@query(
    "region_table",
    f"""{REGION_SQL} SELECT {cols("image_id; label; area; cy; cx; y_lo:bbox_min_y; x_lo:bbox_min_x; y_hi:bbox_max_y; x_hi:bbox_max_x",
        "y0; x0; equivalent_diameter; major_axis; minor_axis; eccentricity; orientation")} FROM r""",
)
def region_table(spark, sf):
    regions = measure_regions(label_components(axon(spark, sf), 2, extent=EXTENT), shape=False)
    return regions.select(
        "image_id", "label", "area", F.floor("y0").cast("int").alias("cy"), F.floor("x0").cast("int").alias("cx"),
        "bbox_min_y", "bbox_min_x", "bbox_max_y", "bbox_max_x", "y0", "x0", "equivalent_diameter", "major_axis",
        "minor_axis", "eccentricity", "orientation",
    )


@query("region_centroids", f"{REGION_SQL} SELECT {cols('image_id; label; cy:y; cx:x')} FROM r")
def region_centroids(spark, sf):
    return centroid_pixels(region_sums(label_components(axon(spark, sf), 2, extent=EXTENT)))


@query(
    "region_perimeter",
    f"WITH RECURSIVE {PX}, {components_sql('l', 'axon', 2)}, {perimeter_sql('q', 'l')} "
    f"SELECT {cols('image_id; label', 'perimeter')} FROM q",
)
def region_perimeter(spark, sf):
    return perimeters(label_components(axon(spark, sf), 2, extent=EXTENT))


@query(
    "region_solidity",
    f"WITH RECURSIVE {PX}, {components_sql('l', 'axon', 2)}, {regions_sql('r', 'l')}, {hull_sql('h', 'l')} "
    f"SELECT {cols('image_id; label; hull_area', 'area / hull_area:solidity')} FROM r JOIN h USING (image_id, label)",
)
def region_solidity(spark, sf):
    labels = label_components(axon(spark, sf), 2, extent=EXTENT)
    both = region_sums(labels).join(hull_areas(labels), ["image_id", "label"])
    return both.select("image_id", "label", "hull_area", (F.col("area") / F.col("hull_area")).alias("solidity"))


# ---- masks ----------------------------------------------------------------------------

LEVEL = "CAST(floor((v + 1) * 127) AS BIGINT)"
SLIDE_MASKS = """two AS (SELECT l_suppkey AS y, l_partkey % 1000 AS x, sum(l_quantity) AS v, sum(l_linenumber) AS n FROM lineitem GROUP BY ALL)"""


def slide_masks(spark, sf):
    """Two masks of the slide as runs."""
    cells = table(spark, sf, "lineitem").groupBy(
        F.lit(0).cast("bigint").alias("image_id"), F.col("l_suppkey").cast("int").alias("y"), (F.col("l_partkey") % 1000).cast("int").alias("x")
    ).agg(F.sum("l_quantity").alias("v"), F.sum("l_linenumber").alias("n"))
    return compress(cells.filter("v > 25").select(*PIXEL)), compress(cells.filter("n > 2").select(*PIXEL))


def gray(spark, sf):
    """Rasters as 8-bit images."""
    return rasters(spark, sf).select(*PIXEL, F.expr("cast(floor((v + 1) * 127) as int)").alias("v"))


def _split(rule, condition):
    sql = f"""WITH {PX}, g AS (SELECT image_id, y, x, least(greatest({LEVEL} * 3 - 200, 0), 255) AS v FROM px)
SELECT {cols(P)}, CASE WHEN v > 200 THEN 'axon' ELSE 'myelin' END AS cls FROM g WHERE v > 200 OR ({condition})"""

    @query(f"class_split_{rule}", sql)
    def run(spark, sf):
        g = gray(spark, sf).withColumn("v", F.expr("least(greatest(v * 3 - 200, 0), 255)"))
        return masks.split_classes(g, rule).select(*PIXEL, "cls")


_split("scoring", "v BETWEEN 50 AND 200")
_split("editor", "v > 100 AND v < 200")

CLS_ID = "CASE WHEN v > CAST(0.05 AS DOUBLE) THEN 2 WHEN v > CAST(-0.10 AS DOUBLE) THEN 1 ELSE 0 END"


def class_map(spark, sf):
    return rasters(spark, sf).select(*PIXEL, F.expr("CASE WHEN v > 0.05D THEN 2 WHEN v > -0.10D THEN 1 ELSE 0 END").alias("cls_id"))


@query("class_extraction", f"WITH {PX} SELECT {cols(P + f'; CASE WHEN {CLS_ID} = 2 THEN 255 ELSE 0 END:v')} FROM px")
def class_extraction(spark, sf):
    return masks.extract_class(class_map(spark, sf), 2)


@query(
    "class_census",
    f"""WITH {PX}, c AS (SELECT image_id, {CLS_ID} AS k, count(*) AS n FROM px GROUP BY ALL),
names AS (SELECT * FROM (VALUES ('background', 0), ('myelin', 1), ('axon', 2), ('unmyelinated', 3)) t(cls, k))
SELECT i.image_id, names.cls, CAST(coalesce(n, 0) AS BIGINT) AS n, n IS NULL AS absent
FROM images i CROSS JOIN names LEFT JOIN c ON c.image_id = i.image_id AND c.k = names.k""",
)
def class_census(spark, sf):
    return masks.class_census(class_map(spark, sf), {"background": 0, "myelin": 1, "axon": 2, "unmyelinated": 3})


@query(
    "merge_masks",
    f"""WITH {PX} SELECT {cols(P + "; min(v):v")} FROM (SELECT image_id, y, x, 255 AS v FROM axon
UNION ALL SELECT image_id, y, x, 127 FROM nerve) GROUP BY image_id, y, x""",
)
def merge_masks(spark, sf):
    return as_pixels(masks.merge_masks(raster_runs(spark, sf, AXON), raster_runs(spark, sf, NERVE)))


def _overlap(priority):
    loser, winner = ("nerve", "axon") if priority == 1 else ("axon", "nerve")
    keep = f"SELECT image_id, y, x FROM {loser} ANTI JOIN {winner} USING (image_id, y, x)"
    sql = f"""WITH {PX}, r AS (SELECT image_id, y, x, 'mask' || CASE WHEN '{winner}' = 'axon' THEN '1' ELSE '2' END AS part FROM {winner}
UNION ALL SELECT *, 'mask' || CASE WHEN '{winner}' = 'axon' THEN '2' ELSE '1' END FROM ({keep})
UNION ALL SELECT a.image_id, a.y, a.x, 'overlap' FROM axon a SEMI JOIN nerve USING (image_id, y, x))
SELECT {cols(P)}, part FROM r"""

    @query(f"remove_overlap_keep_{priority}", sql)
    def run(spark, sf):
        parts = masks.remove_overlap(raster_runs(spark, sf, AXON), raster_runs(spark, sf, NERVE), priority)
        named = [as_pixels(m).withColumn("part", F.lit(n)) for m, n in zip(parts, ("mask1", "mask2", "overlap"))]
        return named[0].unionByName(named[1]).unionByName(named[2])


_overlap(1)
_overlap(2)


@query("clip_to_nerve", f"WITH {PX} SELECT {cols(P)} FROM axon WHERE bv > 0")
def clip_to_nerve(spark, sf):
    return as_pixels(masks.clip(raster_runs(spark, sf, AXON), raster_runs(spark, sf, NERVE)))


@query(
    "mask_symmetric_difference",
    f"WITH {PX} SELECT {cols(P)} FROM (SELECT * FROM axon ANTI JOIN nerve USING (image_id, y, x) "
    "UNION ALL SELECT * FROM nerve ANTI JOIN axon USING (image_id, y, x))",
)
def mask_symmetric_difference(spark, sf):
    return as_pixels(masks.symmetric_difference(raster_runs(spark, sf, AXON), raster_runs(spark, sf, NERVE)))


@query(
    "slide_merged_masks",
    f"""WITH {SLIDE_MASKS}, s AS (SELECT y, x, CASE WHEN n > 2 THEN 127 ELSE 255 END AS v FROM two WHERE v > 25 OR n > 2),
k AS (SELECT y, x, v, x - row_number() OVER (PARTITION BY y, v ORDER BY x) AS g FROM s)
SELECT CAST(0 AS BIGINT) AS image_id, {cols('y; min(x):x0; max(x):x1; v')} FROM k GROUP BY y, v, g""",
)
def slide_merged_masks(spark, sf):
    big, many = slide_masks(spark, sf)
    return compress(masks.merge_masks(big, many), ["v"])


@query(
    "slide_mask_algebra",
    f"""WITH {SLIDE_MASKS} SELECT CAST(0 AS BIGINT) AS image_id, {cols('y; count(*) FILTER (v > 25 AND n > 2):both; count(*) FILTER (v > 25 AND n <= 2):only_a; '
        'count(*) FILTER (v <= 25 AND n > 2):only_b; count(*):either')} FROM two WHERE v > 25 OR n > 2 GROUP BY y""",
)
def slide_mask_algebra(spark, sf):
    big, many = slide_masks(spark, sf)
    a, b = F.col("a"), F.col("b")
    return sweep({"a": big, "b": many}).groupBy("image_id", "y").agg(
        n_pixels(a & b).alias("both"), n_pixels(a & ~b).alias("only_a"), n_pixels(b & ~a).alias("only_b"), n_pixels().alias("either")
    )


HOLES = f"""WITH RECURSIVE {PX}, bg AS (SELECT px.* FROM px ANTI JOIN myelin USING (image_id, pos)),
{components_sql('h', 'bg', 1)}, s AS (SELECT image_id, label, count(*) AS area, min(y) AS a, min(x) AS b, max(y) AS c, max(x) AS d
  FROM h GROUP BY ALL)"""


@query("fill_small_holes", f"{HOLES} SELECT {cols(P)} FROM h JOIN s USING (image_id, label) WHERE area < 0.1 * 64")
def fill_small_holes(spark, sf):
    return masks.small_holes(myelin(spark, sf), images(spark, sf), 0.1, extent=EXTENT)


@query(
    "fill_enclosed_holes",
    f"{HOLES} SELECT {cols(P)} FROM h JOIN s USING (image_id, label) WHERE a > 0 AND b > 0 AND c < 7 AND d < 7",
)
def fill_enclosed_holes(spark, sf):
    return masks.enclosed_holes(myelin(spark, sf), images(spark, sf), extent=EXTENT)


@query("mask_complement", f"WITH {PX} SELECT {cols(P)} FROM px WHERE (v > CAST(0.05 AS DOUBLE)) IS NOT TRUE")
def mask_complement(spark, sf):
    return as_pixels(complement(axon(spark, sf), images(spark, sf)))


@query(
    "mask_runs",
    f"""WITH {PX}, k AS (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM axon)
SELECT {cols('image_id; y; min(x):x0; max(x):x1')} FROM k GROUP BY image_id, y, g""",
)
def mask_runs(spark, sf):
    return compress(axon(spark, sf))


def erode_sql(square: int) -> str:
    """Set pixels of whole images kept as lists, and whether a clear one is as near as the radius."""
    return f"""im AS (SELECT vec_id AS image_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE) > CAST(-0.15 AS DOUBLE)) AS m FROM embeddings),
g AS (SELECT image_id, p // 8 AS y, p % 8 AS x, len(list_filter(range(64),
  lambda q: NOT m[q + 1] AND (q // 8 - p // 8) * (q // 8 - p // 8) + (q % 8 - p % 8) * (q % 8 - p % 8) <= {square})) = 0 AS kept
  FROM im, range(64) t(p) WHERE m[p + 1])"""


@query("erosion", f"WITH {erode_sql(4)} SELECT {cols(P)}, kept FROM g")
def erosion(spark, sf):
    mask = rasters(spark, sf).filter("v > -0.15D").select(*PIXEL)
    return masks.eroded(mask, images(spark, sf), 2)


@query("contour", f"WITH {erode_sql(9)} SELECT {cols(P)} FROM g WHERE NOT kept")
def contour(spark, sf):
    return masks.contour(rasters(spark, sf).filter("v > -0.15D").select(*PIXEL), images(spark, sf), 3)


@query(
    "distance_transform",
    f"""WITH {PX}, bg AS (SELECT px.* FROM px ANTI JOIN axon USING (image_id, pos))
SELECT {cols('a.image_id:image_id; a.y:y; a.x:x; min((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)):d2',
             'sqrt(min((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x))):dist')}
FROM axon a LEFT JOIN bg b ON a.image_id = b.image_id GROUP BY a.image_id, a.y, a.x""",
)
def distance_transform(spark, sf):
    return distance_to_background(axon(spark, sf), images(spark, sf))


# ---- growth ---------------------------------------------------------------------------

SEED_SQL = f"WITH RECURSIVE {PX}, {components_sql('l', 'axon', 2)}, {regions_sql('r', 'l')}, {seeds_sql('s', 'r')}"
FIBRE_SQL = f"{SEED_SQL}, {grow_sql('f', 's')}"
FLOOD_SQL = f"{SEED_SQL}, {flood_sql('f', 's')}"


def fibres(spark, sf, mode="grow"):
    return fibre_labels(axon(spark, sf), myelin(spark, sf), axon_labels(spark, sf), images(spark, sf), EXTENT, mode)


@query("fibre_instances", f"{FIBRE_SQL} SELECT {cols(P + '; label')} FROM f")
def fibre_instances(spark, sf):
    return as_pixels(fibres(spark, sf)).select(*PIXEL, "label")


@query(
    "fibre_flood",
    f"{FLOOD_SQL} SELECT {cols(P + '; label')} FROM f",
)
def fibre_flood(spark, sf):
    seeds = seed_points(axon_labels(spark, sf))
    return as_pixels(flood(axon(spark, sf), myelin(spark, sf), seeds, images(spark, sf), EXTENT))


@query("fibre_arrival", f"{SEED_SQL}, {arrival_sql('f', 's')} SELECT {cols(P + '; label')} FROM f")
def fibre_arrival(spark, sf):
    return as_pixels(fibres(spark, sf, "arrival")).select(*PIXEL, "label")


@query(
    "fibre_flood_cover",
    f"""{FIBRE_SQL} SELECT image_id, CAST(count(*) AS BIGINT) AS n_pixels FROM f GROUP BY image_id""",
)
def fibre_flood_cover(spark, sf):
    seeds = seed_points(axon_labels(spark, sf))
    return flood(axon(spark, sf), myelin(spark, sf), seeds, images(spark, sf), EXTENT).groupBy("image_id").agg(
        F.sum(F.expr("x1 - x0 + 1")).alias("n_pixels")
    )


@query(
    "remove_fibres_at_points",
    f"""{FIBRE_SQL}, {POINTS}, gone AS (SELECT DISTINCT image_id, label FROM f JOIN points USING (image_id, y, x)),
dead AS (SELECT image_id, pos FROM f JOIN gone USING (image_id, label))
SELECT {cols(P)}, 'axon' AS cls FROM axon ANTI JOIN dead USING (image_id, pos)
UNION ALL SELECT {cols(P)}, 'myelin' FROM myelin ANTI JOIN dead USING (image_id, pos)""",
)
def remove_fibres_at_points(spark, sf):
    a, m = axon(spark, sf), myelin(spark, sf)
    a2, m2 = remove_fibres(a, m, fibres(spark, sf), points(spark, sf))
    return a2.withColumn("cls", F.lit("axon")).unionByName(m2.withColumn("cls", F.lit("myelin")))


# ---- objects --------------------------------------------------------------------------


def measure_sql(shape: str, scale: str = "0.5") -> str:
    """CTE ``o``: the whole object table of the rasters."""
    d = "equivalent_diameter" if shape == "circle" else "minor_axis"
    return f"""{FLOOD_SQL}, {perimeter_sql('q', 'l')}, {hull_sql('h', 'l')}, {regions_sql('fr', 'f')}, {perimeter_sql('fq', 'f')},
j AS (SELECT r.*, q.perimeter, r.area / CAST(h.hull_area AS DOUBLE) AS solidity, r.{d} AS d, fr.{d} AS fd, fr.area AS farea,
  fr.orientation AS fori, fr.eccentricity AS fecc, fq.perimeter AS fper, fr.y_lo AS b0, fr.x_lo AS b1, fr.y_hi AS b2, fr.x_hi AS b3,
  (fr.{d} - r.{d}) / 2 AS t
  FROM r JOIN q USING (image_id, label) JOIN h USING (image_id, label)
  LEFT JOIN f ON f.image_id = r.image_id AND f.y = r.cy AND f.x = r.cx
  LEFT JOIN fr ON fr.image_id = f.image_id AND fr.label = f.label
  LEFT JOIN fq ON fq.image_id = f.image_id AND fq.label = f.label),
o AS (SELECT image_id, label, x0, y0, d * {scale} AS axon_diam, area * {scale} * {scale} AS axon_area, perimeter * {scale} AS axon_perimeter,
  solidity, eccentricity, orientation, fori AS fiber_orientation, fecc AS fiber_eccentricity, ok, 
  CASE WHEN ok THEN (d / 2) / (d / 2 + t) END AS gratio, CASE WHEN ok THEN t * {scale} END AS myelin_thickness,
  CASE WHEN ok THEN (farea - area) * {scale} * {scale} END AS myelin_area,
  CASE WHEN ok THEN farea * {scale} * {scale} END AS axonmyelin_area, CASE WHEN ok THEN fper * {scale} END AS axonmyelin_perimeter,
  least(b0, b1) = 0 OR b2 = 8 OR b3 = 8 AS image_border_touching, b0 AS bbox_min_y, b1 AS bbox_min_x, b2 AS bbox_max_y, b3 AS bbox_max_x
  FROM (SELECT *, d / 2 + t <> 0 AS ok FROM j))"""


MEASURES = ("x0; y0; axon_diam; axon_area; axon_perimeter; solidity; eccentricity; orientation; fiber_orientation; "
            "fiber_eccentricity; gratio; myelin_thickness; myelin_area; axonmyelin_area; axonmyelin_perimeter")
BOX = "bbox_min_y; bbox_min_x; bbox_max_y; bbox_max_x"


def measured(spark, sf, shape="circle"):
    return measure_objects(axon(spark, sf), images(spark, sf), myelin(spark, sf), 0.5, shape, EXTENT)


def _objects(shape):
    sql = f"{measure_sql(shape)} SELECT {cols('image_id; label; ' + BOX, MEASURES, 'image_border_touching')} FROM o"

    @query(f"object_table_{shape}", sql)
    def run(spark, sf):
        return measured(spark, sf, shape)


_objects("circle")
_objects("ellipse")


@query(
    "object_table_unmyelinated",
    f"""WITH RECURSIVE {PX}, {components_sql('l', 'axon', 1)}, {regions_sql('r', 'l')}, {perimeter_sql('q', 'l')}, {hull_sql('h', 'l')}
SELECT {cols('image_id; label', 'x0; y0; equivalent_diameter * 0.5:axon_diam; area * 0.25:axon_area; perimeter * 0.5:axon_perimeter; '
             'area / CAST(hull_area AS DOUBLE):solidity; eccentricity; orientation')}
FROM r JOIN q USING (image_id, label) JOIN h USING (image_id, label)""",
)
def object_table_unmyelinated(spark, sf):
    out = measure_objects(axon(spark, sf), images(spark, sf), None, 0.5, extent=EXTENT)
    return out.select("image_id", "label", "x0", "y0", "axon_diam", "axon_area", "axon_perimeter", "solidity",
                      "eccentricity", "orientation")


# ---- geometry -------------------------------------------------------------------------


@query(
    "numbered_points",
    f"""{measure_sql('circle')}, m AS (SELECT image_id, avg(axon_diam) / 0.5 AS mean_diam_px FROM o GROUP BY 1)
SELECT {cols('image_id; label - 1:idx; greatest(floor(mean_diam_px / 3), 10):text_px', 'x0; y0; mean_diam_px')} FROM o JOIN m USING (image_id)""",
)
def numbered_points(spark, sf):
    return geometry.numbered_points(measured(spark, sf), 0.5)


SHAPES = """SELECT p_size AS image_id, p_partkey AS shape_id, 3.0 + p_partkey % 7 AS radius, p_partkey * 37 % 200 AS cx,
p_partkey * 91 % 150 AS cy, 0.5 + (p_partkey % 5) / 10 AS gratio, p_partkey % 8 * 10.0 AS plane_angle FROM part"""


@query(
    "rasterized_ellipses",
    f"""WITH s0 AS (SELECT image_id, shape_id, CAST(radius AS DOUBLE) AS b, cx, cy, CAST(0.5 AS DOUBLE) + (shape_id % 5) / CAST(10 AS DOUBLE) AS g,
  CAST(plane_angle AS DOUBLE) AS ang FROM ({SHAPES})),
s AS (SELECT *, b + b * (1 / g - 1) AS ob, b / cos(radians(ang)) AS a, (b + b * (1 / g - 1)) / cos(radians(ang)) AS oa FROM s0),
c AS (SELECT image_id, shape_id, y, x, CASE WHEN (x-cx)*(x-cx)/(a*a) + (y-cy)*(y-cy)/(b*b) < 1 THEN 255
  WHEN (x-cx)*(x-cx)/(oa*oa) + (y-cy)*(y-cy)/(ob*ob) < 1 THEN 127 END AS v
  FROM s JOIN range(150) r(y) ON abs(y - cy) <= ob JOIN range(200) q(x) ON abs(x - cx) <= oa)
SELECT {cols(P + '; min_by(v, shape_id):v')} FROM c WHERE v IS NOT NULL GROUP BY image_id, y, x""",
)
def rasterized_ellipses(spark, sf):
    shapes = table(spark, sf, "part").selectExpr(
        "p_size AS image_id", "p_partkey AS shape_id", "cast(3 + p_partkey % 7 as double) AS radius",
        "p_partkey * 37 % 200 AS cx", "p_partkey * 91 % 150 AS cy",
        "0.5D + (p_partkey % 5) / 10D AS gratio", "(p_partkey % 8) * 10D AS plane_angle",
    )
    canvas = shapes.select("image_id").distinct().select("image_id", F.lit(150).alias("height"), F.lit(200).alias("width"))
    return geometry.rasterize(shapes, canvas)


def _outlines(shape):
    major = {"circle": ("m0", "m1"), "ellipse": ("m0 / sqrt(1 - e0 * e0)", "m1 / sqrt(1 - e1 * e1)")}[shape]
    angles = {"circle": ("0.0", "0.0"), "ellipse": ("orientation", "fiber_orientation")}[shape]
    ok = {"circle": ("true", "true"), "ellipse": ("e0 >= 0 AND e0 < 1", "e0 >= 0 AND e0 < 1 AND e1 >= 0 AND e1 < 1")}[shape]
    sql = f"""{measure_sql(shape)}, b AS (SELECT *, axon_diam / 0.5 / 2 AS m0, axon_diam / 0.5 / 2 + myelin_thickness / 0.5 AS m1,
  eccentricity AS e0, fiber_eccentricity AS e1 FROM o),
g AS (SELECT image_id, label, x0, y0, 'axon' AS ring, m0 AS mi, {major[0]} AS ma, {angles[0]} AS an FROM b WHERE {ok[0]}
  UNION ALL SELECT image_id, label, x0, y0, 'fibre', m1, {major[1]}, {angles[1]} FROM b WHERE m1 IS NOT NULL AND {ok[1]}),
t AS (SELECT *, 2 * pi() * k / 16 AS t FROM g, range(16) n(k))
SELECT {cols('image_id; label; k', 'x0 + mi * cos(t) * cos(-an) - ma * sin(t) * sin(-an):px; y0 + mi * cos(t) * sin(-an) + ma * sin(t) * cos(-an):py', 'ring')} FROM t"""

    @query(f"diameter_outlines_{shape}", sql)
    def run(spark, sf):
        return geometry.diameter_outlines(measured(spark, sf, shape), 0.5, shape, n=16)


_outlines("circle")
_outlines("ellipse")


def _channel(name, low, span, factor):
    return f"CAST(({low})[CAST((label - 1) % 3 AS INTEGER) + 1] + (({span})[CAST((label - 1) % 3 AS INTEGER) + 1] * ((label - 1 + 42) * {factor} % 65536)) // 65536 AS BIGINT) AS {name}"


@query(
    "instance_colours",
    f"""WITH RECURSIVE {PX}, {components_sql('l', 'axon', 2)}
SELECT {cols(P + '; label')}, {_channel('r', '[118, 22, 22]', '[100, 97, 3]', 40503)},
{_channel('g', '[200, 138, 78]', '[38, 63, 61]', 30011)}, {_channel('b', '[146, 147, 119]', '[2, 27, 55]', 51749)} FROM l""",
)
def instance_colours(spark, sf):
    labels = as_pixels(label_components(axon(spark, sf), 2, extent=EXTENT))
    return geometry.colour_instances(labels).select(*PIXEL, "label", "rgb.r", "rgb.g", "rgb.b")


def _colours(style, a, m):
    sql = f"""WITH {PX} SELECT {cols(P)}, {', '.join(f"CAST(CASE WHEN cls = 'axon' THEN {a[i]} ELSE {m[i]} END AS BIGINT) AS {c}" for i, c in enumerate('rgb'))} FROM pcls"""

    @query(f"class_colours_{style}", sql)
    def run(spark, sf):
        return geometry.class_colours(predicted_classes(spark, sf), style).select(*PIXEL, "rgb.r", "rgb.g", "rgb.b")


_colours("index", (0, 0, 255), (255, 0, 0))
_colours("overlay", (255, 0, 0), (0, 255, 0))


@query(
    "object_closeups",
    f"""{FIBRE_SQL}, b AS (SELECT image_id, label, greatest(min(y) - 2, 0) AS t, greatest(min(x) - 2, 0) AS l, least(max(y) + 3, 8) AS d,
  least(max(x) + 3, 8) AS r FROM f GROUP BY ALL)
SELECT {cols('b.image_id:image_id; b.label:object; p.y - b.t:cy; p.x - b.l:cx', 'p.v:v')},
coalesce(f.label = b.label, false) AND p.v > CAST(0.05 AS DOUBLE) AS own_axon,
coalesce(f.label = b.label, false) AND p.v > CAST(-0.10 AS DOUBLE) AND p.v <= CAST(0.05 AS DOUBLE) AS own_myelin
FROM b JOIN px p ON p.image_id = b.image_id AND p.y >= b.t AND p.y < b.d AND p.x >= b.l AND p.x < b.r
LEFT JOIN f ON f.image_id = p.image_id AND f.pos = p.pos""",
)
def object_closeups(spark, sf):
    labels = materialize(fibres(spark, sf), "fibres")
    pixels = rasters(spark, sf).selectExpr(*PIXEL, "v", "v > 0.05D AS axon", "v > -0.10D AND v <= 0.05D AS myelin")
    return geometry.closeups(region_sums(labels), pixels, labels, images(spark, sf), buffer=2)


@query(
    "flagged_object_mask",
    f"""{FIBRE_SQL}, k AS (SELECT image_id, label FROM r WHERE area <= 2) SELECT {cols(P)} FROM f SEMI JOIN k USING (image_id, label)""",
)
def flagged_object_mask(spark, sf):
    axons = axon_labels(spark, sf)
    small = region_sums(axons).filter("area <= 2").select("image_id", (F.col("label") - 1).alias("idx"))
    labels = fibre_labels(axon(spark, sf), myelin(spark, sf), axons, images(spark, sf), EXTENT, "grow")
    return geometry.flagged_mask(labels, small)


@query(
    "diameter_map",
    f"{REGION_SQL} SELECT {cols('image_id; l.y:y; l.x:x', 'equivalent_diameter:axon_diam')} FROM l JOIN r USING (image_id, label)",
)
def diameter_map(spark, sf):
    labels = axon_labels(spark, sf)
    table_ = measure_regions(labels, shape=False).withColumn("axon_diam", F.col("equivalent_diameter"))
    return geometry.metric_map(labels, table_)


@query(
    "metrics_at_points",
    f"""{measure_sql('circle')}, {POINTS}
SELECT {cols('p.event_id:event_id; p.image_id:image_id; f.label:label', 'o.axon_diam:axon_diam; o.myelin_thickness:myelin_thickness; o.gratio:gratio', 'o.image_border_touching')}
FROM points p LEFT JOIN f ON f.image_id = p.image_id AND f.y = p.y AND f.x = p.x
LEFT JOIN o ON o.image_id = f.image_id AND o.label = f.label""",
)
def metrics_at_points(spark, sf):
    metrics = ["axon_diam", "myelin_thickness", "gratio", "image_border_touching"]
    out = geometry.metrics_at(points(spark, sf), fibres(spark, sf, "flood"), measured(spark, sf), metrics)
    return out.select("event_id", "image_id", "label", *metrics)


# ---- patches --------------------------------------------------------------------------


@query("tile_windows", f"WITH {PX} SELECT image_id, {cols('oy; ox')} FROM images, (VALUES (0), (2), (4)) a(oy), (VALUES (0), (2), (4)) b(ox)")
def tile_windows(spark, sf):
    return patches.windows(images(spark, sf), (4, 4), 0.5)


WINDOWS = """win AS (SELECT p.image_id, p.pos, p.y, p.x, oy, ox, p.y - oy AS py, p.x - ox AS px, CAST(floor((p.v + 1) * 127) AS BIGINT) AS v
  FROM px p, (VALUES (0), (2), (4)) a(oy), (VALUES (0), (2), (4)) b(ox)
  WHERE p.y >= oy AND p.y < oy + 4 AND p.x >= ox AND p.x < ox + 4)"""


@query("tile_pixels", f"WITH {PX}, {WINDOWS} SELECT {cols('image_id; oy; ox; y; x; py; px; v')} FROM win")
def tile_pixels(spark, sf):
    return patches.cut(gray(spark, sf), images(spark, sf), (4, 4), 0.5)


def toy_fold(number):
    """A deterministic stand-in for a model fold: gray level and place decide the scores."""

    def make():
        def predict(batch):
            flat = batch.reshape(len(batch), 16).astype("float64")
            py, px = np.divmod(np.arange(16), 4)
            return {
                "c0": np.full_like(flat, 128.0),
                "c1": flat + py + number,
                "c2": 255.0 - flat + 2 * px - number,
            }

        return predict

    return make


@query(
    "tile_segmentation",
    f"""WITH {PX}, {WINDOWS}, s AS (SELECT w.*, CASE WHEN fy = 1 THEN 3 - py ELSE py END AS qy, CASE WHEN fx = 1 THEN 3 - px ELSE px END AS qx, fold
  FROM win w, (VALUES (0), (1)) a(fy), (VALUES (0), (1)) b(fx), (VALUES (0), (1)) c(fold)),
m AS (SELECT image_id, y, x, avg(128.0) AS c0, avg(CAST(v + qy + fold AS DOUBLE)) AS c1, avg(CAST(255 - v + 2 * qx - fold AS DOUBLE)) AS c2
  FROM s GROUP BY ALL)
SELECT {cols(P + '; CASE WHEN c0 >= c1 AND c0 >= c2 THEN 0 WHEN c1 >= c2 THEN 1 ELSE 2 END:cls_id', 'c0; c1; c2')} FROM m""",
)
def tile_segmentation(spark, sf):
    arrays = table(spark, sf, "embeddings").selectExpr(
        "vec_id AS image_id", "8 AS height", "8 AS width", "transform(embedding, v -> cast(floor((cast(v as double) + 1) * 127) as float)) AS values"
    )
    return patches.segment(image_blocks(arrays, 8), images(spark, sf), [toy_fold(0), toy_fold(1)], 3, (4, 4), 0.5, block=8)


@query(
    "bit_depth",
    f"""WITH {PX}, r AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1)
SELECT {cols("image_id; y; x; floor((v - lo) / (hi - lo) * 255 + 0.499999999):v8; (floor((v - lo) / (hi - lo) * 65535 + 0.499999999)):v16; "
             "CAST(floor((v - lo) / (hi - lo) * 65535 + 0.499999999) AS BIGINT) // 256:low8")} FROM px JOIN r USING (image_id)""",
)
def bit_depth(spark, sf):
    px = rasters(spark, sf)
    span = px.groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    out = px.join(span, "image_id")
    wide = float_to_bits(F.col("v"), F.col("lo"), F.col("hi"), 16)
    return out.select(*PIXEL, float_to_bits(F.col("v"), F.col("lo"), F.col("hi")).alias("v8"), wide.alias("v16"),
                      F.shiftright(wide, 8).alias("low8"))
