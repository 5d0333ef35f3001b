"""Totals, nerve reports, scoring, subject statistics and quality control."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.raster_queries import FIBRE_SQL, axon_labels, fibres
from catalog.views import (
    AXON, exact, EXTENT, OBJ, POINTS, PX, TRUTH, axon, cols, components_sql, images, myelin, nerve, objects, points,
    predicted_classes, query, raster_runs, regions_sql, seeds_sql, slide, slide_size, table, true_axon, true_classes, SLIDE, flood_sql,
)
from segstats.constants import BINNED_METRICS, DIAMETER_BINS
from segstats.operators.algebra import overlap_lengths
from segstats.operators.components import label_components
from segstats.operators.regions import measure_regions, region_sums
from segstats.operators.runs import lookup
from segstats.plans import aggregate, nerve as nerve_plan, quality, scoring
from segstats.plans.objects import fibre_metrics, image_totals, mask_fractions
from segstats.session import materialize
from segstats.sources.tables import parse_nerve

# ---- image totals -----------------------------------------------------------------------

TOTALS = f"""WITH RECURSIVE {PX}, {components_sql('l', 'axon', 1)}, {regions_sql('r', 'l')},
d AS (SELECT image_id, avg(equivalent_diameter * 0.5) AS mean_axon_diam, count(*) AS n FROM r GROUP BY 1),
fr AS (SELECT image_id, count(*) FILTER (cls = 'axon') / 64.0 AS avf, count(*) FILTER (cls = 'myelin') / 64.0 AS mvf FROM pcls GROUP BY 1),
t AS (SELECT i.image_id, coalesce(avf, 0) AS avf, coalesce(mvf, 0) AS mvf, mean_axon_diam, coalesce(n, 0) AS n,
  CASE WHEN coalesce(avf, 0) > 0 THEN sqrt(1 / (1 + mvf / avf)) END AS g
  FROM images i LEFT JOIN fr USING (image_id) LEFT JOIN d USING (image_id))"""


@query(
    "image_totals",
    f"""{TOTALS} SELECT image_id, {cols('', 'avf; mvf; g:gratio_aggr; mean_axon_diam; mean_axon_diam / g:mean_myelin_diam; '
    'mean_axon_diam / g / 2 - mean_axon_diam / 2:mean_myelin_thickness; n / (64 * 0.25 / 1000000):axon_density_mm2')} FROM t""",
)
def image_totals_query(spark, sf):
    # the flagship: label, measure and summarise every image
    labels = label_components(axon(spark, sf), 1, extent=EXTENT)
    found = measure_regions(labels, shape=False).select("image_id", (F.col("equivalent_diameter") * 0.5).alias("axon_diam"))
    return image_totals(predicted_classes(spark, sf), found, images(spark, sf), 0.5)


@query("volume_fractions", f"{TOTALS} SELECT image_id, {cols('', 'avf; mvf')} FROM t")
def volume_fractions(spark, sf):
    return mask_fractions(predicted_classes(spark, sf), images(spark, sf)).select("image_id", "avf", "mvf")


@query(
    "slide_fractions",
    f"""WITH {SLIDE} SELECT CAST(0 AS BIGINT) AS image_id, {cols('', "count(*) FILTER (v > 40) / ((max(y) + 1) * 1000.0):avf; count(*) FILTER (v > 25 AND v <= 40) / ((max(y) + 1) * 1000.0):mvf")} FROM cells""",
)
def slide_fractions(spark, sf):
    classes = slide(spark, sf).selectExpr("image_id", "CASE WHEN v > 40 THEN 'axon' WHEN v > 25 THEN 'myelin' END AS cls")
    return mask_fractions(classes, slide_size(spark, sf)).select("image_id", "avf", "mvf")


@query(
    "fibre_derived_metrics",
    f"""WITH {OBJ}, m AS (SELECT image_id, line, subject_id, axon_diam AS d, axon_diam / gratio AS fd FROM obj)
SELECT image_id, line, subject_id, n, gratio, thickness_px, myelin_area_px, plausible FROM (
SELECT image_id, CAST(line AS BIGINT) AS line, subject_id, CAST(count(*) AS BIGINT) AS n,
{cols('', 'avg((d / 2) / (d / 2 + (fd - d) / 2)):gratio; avg((fd - d) / 2):thickness_px; avg(pi() * fd * fd / 4 - pi() * d * d / 4):myelin_area_px')},
bool_and(d > 0 AND fd > 0 AND fd > d) AS plausible FROM m WHERE fd IS NOT NULL GROUP BY ALL)""",
)
def fibre_derived_metrics(spark, sf):
    base = objects(spark, sf).filter("gratio IS NOT NULL").selectExpr(
        "image_id", "line", "subject_id", "axon_diam AS equivalent_diameter", "axon_diam / gratio AS fibre_equivalent_diameter",
        "pi() * axon_diam * axon_diam / 4 AS area", "pi() * (axon_diam / gratio) * (axon_diam / gratio) / 4 AS fibre_area",
    )
    out = fibre_metrics(base, "circle")
    return out.groupBy("image_id", "line", "subject_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("gratio").alias("gratio"), F.avg("thickness_px").alias("thickness_px"),
        F.avg("myelin_area_px").alias("myelin_area_px"), F.bool_and("plausible").alias("plausible"),
    )


# ---- nerve ------------------------------------------------------------------------------

NERVE_SQL = f"""WITH RECURSIVE {PX}, {components_sql('n', 'nerve', 1)},
fa AS (SELECT image_id, label - 1 AS fascicle, count(*) * 0.25 AS area FROM n GROUP BY ALL)"""


@query("fascicle_areas", f"{NERVE_SQL} SELECT image_id, {cols('fascicle', 'area')} FROM fa")
def fascicle_areas(spark, sf):
    return nerve_plan.fascicle_areas(label_components(nerve(spark, sf), 1, extent=EXTENT), 0.5)


ASSIGNED = f"""{NERVE_SQL}, {POINTS}, a AS (SELECT p.*, coalesce(n.label - 1, -1) AS fascicle_id
  FROM points p LEFT JOIN n USING (image_id, y, x))"""


def assigned_points(spark, sf, fascicles):
    spots = points(spark, sf).withColumn("x0", F.col("x") + 0.75).withColumn("y0", F.col("y") + 0.25)
    return nerve_plan.assign_fascicle(spots.drop("x", "y"), fascicles, images(spark, sf))


def labelled_nerve(spark, sf):
    return materialize(label_components(nerve(spark, sf), 1, extent=EXTENT), "nerve")


@query("fascicle_assignment", f"{ASSIGNED} SELECT event_id, image_id, {cols('fascicle_id')} FROM a")
def fascicle_assignment(spark, sf):
    return assigned_points(spark, sf, labelled_nerve(spark, sf)).select("event_id", "image_id", "fascicle_id")


@query(
    "fascicle_density",
    f"""{ASSIGNED}, c AS (SELECT image_id, fascicle_id AS fascicle, count(*) AS n FROM a WHERE fascicle_id >= 0 GROUP BY ALL)
SELECT fa.image_id, {cols('fascicle; coalesce(n, 0):n_axons', 'area; ' + exact('coalesce(n, 0) / area', 5) + ':density')}
FROM fa LEFT JOIN c USING (image_id, fascicle)""",
)
def fascicle_density(spark, sf):
    fascicles = labelled_nerve(spark, sf)
    return nerve_plan.fascicle_density(nerve_plan.fascicle_areas(fascicles, 0.5), assigned_points(spark, sf, fascicles))


@query(
    "nerve_total_density",
    f"""{ASSIGNED}, t AS (SELECT image_id, sum(area) AS total_area FROM fa GROUP BY 1),
c AS (SELECT image_id, count(*) FILTER (fascicle_id >= 0) AS n FROM a GROUP BY 1)
SELECT t.image_id, {cols('coalesce(n, 0):n_axons', 'total_area; ' + exact('coalesce(n, 0) / total_area', 5) + ':total_density')}
FROM t LEFT JOIN c USING (image_id)""",
)
def nerve_total_density(spark, sf):
    fascicles = labelled_nerve(spark, sf)
    return nerve_plan.total_density(nerve_plan.fascicle_areas(fascicles, 0.5), assigned_points(spark, sf, fascicles))


@query(
    "nerve_document",
    f"""{ASSIGNED}, c AS (SELECT image_id, fascicle_id AS fascicle, count(*) AS n FROM a WHERE fascicle_id >= 0 GROUP BY ALL),
t AS (SELECT image_id, sum(area) AS total, count(*) AS k FROM fa GROUP BY 1), s AS (SELECT image_id, sum(n) AS n FROM c GROUP BY 1)
SELECT i.image_id, {cols('coalesce(k, 0):n_fascicles; coalesce(fascicle, -1):fascicle',
    'area; ' + exact('coalesce(c.n, 0) / area', 5) + ':density; coalesce(total, 0):total_area; CASE WHEN total > 0 THEN ' + exact('coalesce(s.n, 0) / total', 5) + ' ELSE 0 END:total_density')}
FROM images i LEFT JOIN t USING (image_id) LEFT JOIN s USING (image_id) LEFT JOIN fa USING (image_id) LEFT JOIN c USING (image_id, fascicle)"""
,
)
def nerve_document(spark, sf):
    fascicles = labelled_nerve(spark, sf)
    plain = nerve_plan.nerve_document(nerve_plan.fascicle_areas(fascicles, 0.5), images(spark, sf))
    # through JSON text and back, as a stored document would go
    stored = parse_nerve(plain.select("image_id", F.to_json(F.struct("fascicle_areas", "total_area")).alias("document")))
    full = nerve_plan.add_densities(stored, assigned_points(spark, sf, fascicles))
    flat = full.select("image_id", F.size("fascicle_areas").alias("n_fascicles"), F.explode_outer("fascicle_areas"),
                       "total_area", "total_axon_density")
    return flat.select(
        "image_id", "n_fascicles", F.coalesce(F.col("key").cast("bigint"), F.lit(-1)).alias("fascicle"),
        F.col("value.value").alias("area"), F.col("value.axon_density.value").alias("density"),
        F.col("total_area.value").alias("total_area"), F.col("total_axon_density.value").alias("total_density"),
    )


CLIPPED = f"""WITH RECURSIVE {PX}, {components_sql('n', 'nerve', 1)},
ca AS (SELECT * FROM axon SEMI JOIN nerve USING (image_id, pos)), cm AS (SELECT * FROM myelin SEMI JOIN nerve USING (image_id, pos)),
{components_sql('l', 'ca', 2)}, {regions_sql('r', 'l')}, {seeds_sql('s', 'r')}, {flood_sql('f', 's', 'ca', 'cm')}, {regions_sql('fr', 'f')}"""


@query(
    "nerve_report",
    f"""{CLIPPED} SELECT r.image_id, {cols('r.label:label; coalesce(n.label - 1, -1):fascicle_id',
    'r.equivalent_diameter * 0.5:axon_diam; fr.area * 0.25:axonmyelin_area')}
FROM r LEFT JOIN n ON n.image_id = r.image_id AND n.y = r.cy AND n.x = r.cx
LEFT JOIN f ON f.image_id = r.image_id AND f.y = r.cy AND f.x = r.cx LEFT JOIN fr ON fr.image_id = f.image_id AND fr.label = f.label""",
)
def nerve_report(spark, sf):
    found, _ = nerve_plan.nerve_report(
        axon(spark, sf), myelin(spark, sf), nerve(spark, sf), images(spark, sf), 0.5, EXTENT
    )
    return found.select("image_id", "label", "fascicle_id", "axon_diam", "axonmyelin_area")


@query(
    "nerve_report_densities",
    f"""{CLIPPED}, fa AS (SELECT image_id, label - 1 AS fascicle, count(*) * 0.25 AS area FROM n GROUP BY ALL),
c AS (SELECT r.image_id, n.label - 1 AS fascicle, count(*) AS n FROM r JOIN n ON n.image_id = r.image_id AND n.y = r.cy AND n.x = r.cx GROUP BY ALL)
SELECT fa.image_id, {cols('fascicle', 'area; ' + exact('coalesce(n, 0) / area', 5) + ':density')} FROM fa LEFT JOIN c USING (image_id, fascicle)""",
)
def nerve_report_densities(spark, sf):
    _, densities = nerve_plan.nerve_report(
        axon(spark, sf), myelin(spark, sf), nerve(spark, sf), images(spark, sf), 0.5, EXTENT
    )
    return densities.select("image_id", "fascicle", "area", "density")


# ---- scoring ----------------------------------------------------------------------------

CONFUSION = f"""WITH RECURSIVE {PX}, cf AS (SELECT image_id, count(*) FILTER (a AND t) AS tp, count(*) FILTER (a AND NOT t) AS fp,
  count(*) FILTER (t AND NOT a) AS fn, count(*) FILTER (NOT a AND NOT t) AS tn FROM (SELECT image_id, v > CAST(0.05 AS DOUBLE) AS a,
  (v + nv) / 2 > CAST(0.03 AS DOUBLE) AS t FROM px) GROUP BY 1)"""


def _ratio(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / nullif({b}, 0)"


SE, PR, SP = _ratio("tp", "tp + fn"), _ratio("tp", "tp + fp"), _ratio("tn", "tn + fp")
SCORES = (f"{SE}:sensitivity; {PR}:precision; {SP}:specificity; 1 - {SE}:fn_rate; 1 - {SP}:fp_rate; "
          f"{_ratio('tp + tn', 'tp + fp + fn + tn')}:accuracy; 2 * ({SE}) * ({PR}) / nullif(({SE}) + ({PR}), 0):f1; "
          f"{_ratio('2 * tp', '2 * tp + fp + fn')}:dice; {_ratio('tp', 'tp + fp + fn')}:jaccard")


@query("pixel_scores", f"{CONFUSION} SELECT image_id, {cols('tp; fp; fn; tn', SCORES)} FROM cf")
def pixel_scores(spark, sf):
    return scoring.pixel_scores(scoring.confusion(raster_runs(spark, sf, AXON), raster_runs(spark, sf, TRUTH), images(spark, sf)))


@query("global_dice", f"{CONFUSION} SELECT image_id, {cols('', 'coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 1):dice')} FROM cf")
def global_dice(spark, sf):
    return scoring.global_dice(scoring.confusion(raster_runs(spark, sf, AXON), raster_runs(spark, sf, TRUTH), images(spark, sf)))


TWO = f"""WITH RECURSIVE {PX}, {components_sql('pl', 'axon', 2)}, {regions_sql('pr', 'pl')},
{components_sql('tl', 'truth', 2)}, {regions_sql('tr', 'tl')}"""


def two_labellings(spark, sf):
    return [
        materialize(label_components(m(spark, sf), 2, extent=EXTENT), "labels") for m in (axon, true_axon)
    ]


def dice_sql(min_area: int) -> str:
    return f"""{TWO}, od AS (SELECT pr.image_id, pr.label, tl.label AS true_label, pr.area, 2.0 * (SELECT count(*) FROM pl p JOIN tl t
  ON p.image_id = t.image_id AND p.pos = t.pos WHERE p.image_id = pr.image_id AND p.label = pr.label AND t.label = tl.label)
  / (pr.area + tr.area) AS dice FROM pr JOIN tl ON tl.image_id = pr.image_id AND tl.y = pr.cy AND tl.x = pr.cx
  JOIN tr ON tr.image_id = tl.image_id AND tr.label = tl.label WHERE pr.area > {min_area})"""


@query("object_dice", f"{dice_sql(3)} SELECT image_id, {cols('label; true_label; area', 'dice')} FROM od")
def object_dice(spark, sf):
    return scoring.object_dice(*two_labellings(spark, sf))


PERCENT = "; ".join(f"quantile_cont(dice, {p / 100}):percent_{p}" for p in (5, 10, 25, 50, 75, 90, 95))


@query(
    "object_dice_distribution",
    f"{dice_sql(5)} SELECT image_id, {cols('', 'avg(dice):mean; stddev_pop(dice):std; min(dice):min; max(dice):max; ' + PERCENT)} FROM od GROUP BY image_id",
)
def object_dice_distribution(spark, sf):
    return scoring.dice_distribution(scoring.object_dice(*two_labellings(spark, sf), min_area=5), ["image_id"])


MATCH = f"""{TWO}, sp AS (SELECT DISTINCT image_id, cy AS y, cx AS x FROM pr WHERE area > 2),
m AS (SELECT sp.*, tl.label AS true_label, (sp.y - tr.cy) * (sp.y - tr.cy) + (sp.x - tr.cx) * (sp.x - tr.cx) AS d2
  FROM sp LEFT JOIN tl USING (image_id, y, x) LEFT JOIN tr ON tr.image_id = sp.image_id AND tr.label = tl.label),
k AS (SELECT *, true_label IS NOT NULL AND row_number() OVER (PARTITION BY image_id, true_label ORDER BY d2, y, x) = 1 AS matched FROM m)"""


@query("centroid_matches", f"{MATCH} SELECT image_id, {cols('y; x; true_label; d2')}, matched FROM k")
def centroid_matches(spark, sf):
    return scoring.match_centroids(*two_labellings(spark, sf))


@query(
    "detection_scores",
    f"""{MATCH}, c AS (SELECT image_id, count(*) FILTER (matched) AS tp, count(*) FILTER (true_label IS NULL) AS fp,
  count(*) FILTER (true_label IS NOT NULL AND NOT matched) AS extra FROM k GROUP BY 1),
p AS (SELECT image_id, count(*) AS p FROM tr GROUP BY 1),
j AS (SELECT image_id, coalesce(p, 0) AS p, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(extra, 0) AS extra
  FROM images LEFT JOIN c USING (image_id) LEFT JOIN p USING (image_id))
SELECT image_id, {cols('p; tp; fp; extra', f'{exact(_ratio("tp", "p"), 3)}:sensitivity; {exact(_ratio("tp", "tp + fp"), 3)}:precision; {exact(_ratio("extra", "tp + fp"), 4)}:diffusion')} FROM j""",
)
def detection_scores(spark, sf):
    return scoring.detection_scores(*two_labellings(spark, sf), images(spark, sf))


def _contour_sql(name, source):
    return f"""{name} AS (SELECT DISTINCT g.image_id, g.y, g.x FROM {source} g JOIN (SELECT px.* FROM px ANTI JOIN {source} USING (image_id, pos)) b
  ON b.image_id = g.image_id AND (b.y - g.y) * (b.y - g.y) + (b.x - g.x) * (b.x - g.x) <= 9)"""


@query(
    "contour_hausdorff",
    f"""WITH {PX}, {_contour_sql('ca', 'axon')}, {_contour_sql('ct', 'truth')},
d AS (SELECT a.image_id, a.y, a.x, min((a.y - t.y) * (a.y - t.y) + (a.x - t.x) * (a.x - t.x)) AS d2 FROM ca a JOIN ct t ON a.image_id = t.image_id GROUP BY ALL)
SELECT i.image_id, {cols('', 'sqrt(max(d2)):hausdorff')} FROM images i LEFT JOIN d ON d.image_id = i.image_id GROUP BY i.image_id""",
)
def contour_hausdorff(spark, sf):
    return scoring.directed_hausdorff(axon(spark, sf), true_axon(spark, sf), images(spark, sf))


@query(
    "row_hausdorff",
    f"""WITH {PX}, {_contour_sql('ca', 'axon')}, {_contour_sql('ct', 'truth')}, g AS (SELECT image_id, y FROM images, range(8) t(y)),
a AS (SELECT g.image_id, g.y, coalesce(sum(1 << x), 0) AS b FROM g LEFT JOIN ca ON ca.image_id = g.image_id AND ca.y = g.y GROUP BY ALL),
t AS (SELECT g.image_id, g.y, coalesce(sum(1 << x), 0) AS b FROM g LEFT JOIN ct ON ct.image_id = g.image_id AND ct.y = g.y GROUP BY ALL),
d AS (SELECT a.image_id, a.y, min(bit_count(xor(CAST(a.b AS BIGINT), CAST(t.b AS BIGINT)))) AS d2 FROM a JOIN t ON a.image_id = t.image_id GROUP BY ALL)
SELECT image_id, {cols('', 'sqrt(max(d2)):hausdorff')} FROM d GROUP BY image_id""",
)
def row_hausdorff(spark, sf):
    return scoring.row_hausdorff(axon(spark, sf), true_axon(spark, sf), images(spark, sf))


REPORT_COUNTS = f"""{dice_sql(5)}, cc AS (SELECT image_id, cls, count(*) FILTER (a = cls AND t = cls) AS tp,
  count(*) FILTER (a = cls AND t IS DISTINCT FROM cls) AS fp, count(*) FILTER (t = cls AND a IS DISTINCT FROM cls) AS fn,
  count(*) FILTER (a IS DISTINCT FROM cls AND t IS DISTINCT FROM cls) AS tn
  FROM (SELECT px.image_id, p.cls AS a, t.cls AS t FROM px LEFT JOIN pcls p USING (image_id, pos) LEFT JOIN tcls t USING (image_id, pos)),
  (VALUES ('axon'), ('myelin')) k(cls) GROUP BY ALL),
dd AS (SELECT image_id, 'axon' AS cls, avg(dice) AS mean, stddev_pop(dice) AS std, min(dice) AS min, max(dice) AS max,
  quantile_cont(dice, 0.5) AS p50 FROM od GROUP BY 1)"""


@query(
    "class_report",
    f"""{REPORT_COUNTS} SELECT image_id, cls, {cols('tp; fp; fn; tn', SCORES + '; mean:object_dice_mean; std:object_dice_std; min:object_dice_min; max:object_dice_max; p50:object_dice_percent_50')}
FROM cc LEFT JOIN dd USING (image_id, cls)""",
)
def class_report(spark, sf):
    out = scoring.class_report(predicted_classes(spark, sf), true_classes(spark, sf), images(spark, sf), EXTENT)
    return out.drop(*[f"object_dice_percent_{p}" for p in (5, 10, 25, 75, 90, 95)])


@query(
    "pixel_scores_slide",
    f"""WITH {SLIDE}, cf AS (SELECT count(*) FILTER (v > 25 AND n > 2) AS tp, count(*) FILTER (v > 25 AND n <= 2) AS fp,
  count(*) FILTER (v <= 25 AND n > 2) AS fn, (max(y) + 1) * 1000 AS size FROM (SELECT l_suppkey AS y, l_partkey % 1000 AS x, sum(l_quantity) AS v, sum(l_linenumber) AS n FROM lineitem GROUP BY ALL))
SELECT CAST(0 AS BIGINT) AS image_id, {cols('tp; fp; fn; size - tp - fp - fn:tn')} FROM cf""",
)
def pixel_scores_slide(spark, sf):
    cells = table(spark, sf, "lineitem").groupBy(
        F.lit(0).cast("bigint").alias("image_id"), F.col("l_suppkey").cast("int").alias("y"), (F.col("l_partkey") % 1000).cast("int").alias("x")
    ).agg(F.sum("l_quantity").alias("v"), F.sum("l_linenumber").alias("n"))
    return scoring.confusion(cells.filter("v > 25"), cells.filter("n > 2"), slide_size(spark, sf))


# ---- subjects ---------------------------------------------------------------------------


@query(
    "outlier_counts",
    f"""WITH {OBJ} SELECT subject_id, image_id, {cols('count(*) FILTER (gratio IS NULL OR gratio >= 1):n_dropped; count(*):n_objects')} FROM obj GROUP BY ALL""",
)
def outlier_counts(spark, sf):
    return aggregate.count_outliers(objects(spark, sf), ["subject_id", "image_id"])


@query("outlier_filter", f"WITH {OBJ} SELECT subject_id, image_id, {cols('line', 'axon_diam; gratio')} FROM obj WHERE gratio < 1")
def outlier_filter(spark, sf):
    return aggregate.drop_outliers(objects(spark, sf)).select("subject_id", "image_id", "line", "axon_diam", "gratio")


STATS = "round_even(avg({0}), 2):mean; round_even(stddev_samp({0}), 2):std; round_even(min({0}), 2):min; round_even(max({0}), 2):max; round_even(median({0}), 2):median"


@query(
    "subject_statistics",
    f"WITH {OBJ} SELECT subject_id, {cols('', STATS.format('axon_diam'))} FROM obj WHERE gratio < 1 GROUP BY subject_id",
)
def subject_statistics(spark, sf):
    return aggregate.statistics(aggregate.drop_outliers(objects(spark, sf)), ["subject_id"], "axon_diam")


BIN = "CASE " + " ".join(
    f"WHEN axon_diam >= {low}" + (f" AND axon_diam < {high}" if high else "") + f" THEN '{name}'" for name, low, high in DIAMETER_BINS
) + " END"
BINNED = f"""WITH {OBJ}, b AS (SELECT *, {BIN} AS bin FROM obj WHERE gratio < 1),
u AS ({' UNION ALL '.join(f"SELECT subject_id, bin, '{m}' AS metric, {c} AS value FROM b WHERE bin IS NOT NULL" for m, c in BINNED_METRICS.items())}),
s AS (SELECT subject_id, metric, bin, {cols('', STATS.format('value'))} FROM u GROUP BY ALL),
grid AS (SELECT DISTINCT subject_id, metric, k.bin FROM b, (VALUES {', '.join(f"('{m}')" for m in BINNED_METRICS)}) m(metric),
  (VALUES {', '.join(f"('{n}')" for n, _, _ in DIAMETER_BINS)}) k(bin))"""


@query("binned_statistics", f"{BINNED} SELECT * FROM grid LEFT JOIN s USING (subject_id, metric, bin)")
def binned_statistics(spark, sf):
    return aggregate.binned_statistics(aggregate.drop_outliers(objects(spark, sf)))


@query(
    "binned_statistics_wide",
    f"""{BINNED}, w AS (SELECT subject_id, metric, bin, unnest(['Mean', 'Standard Deviation', 'Min', 'Max', 'Median']) AS statistic,
  unnest([mean, std, min, max, median]) AS value FROM grid LEFT JOIN s USING (subject_id, metric, bin))
SELECT subject_id, metric, statistic, {', '.join(f"max(value) FILTER (bin = '{n}') AS " + chr(34) + n + chr(34) for n, _, _ in DIAMETER_BINS)}
FROM w GROUP BY ALL""",
)
def binned_statistics_wide(spark, sf):
    return aggregate.wide_statistics(binned_statistics(spark, sf))


@query(
    "bin_counts",
    f"""{BINNED}, c AS (SELECT subject_id, bin, count(axon_diam) AS n FROM b GROUP BY ALL)
SELECT subject_id, bin, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT subject_id, bin FROM grid) LEFT JOIN c USING (subject_id, bin)""",
)
def bin_counts(spark, sf):
    return aggregate.bin_counts(aggregate.drop_outliers(objects(spark, sf)))


@query(
    "pooled_by_nation",
    f"""WITH {OBJ} SELECT n_name, r_name, {cols('count(*):n_objects; count(DISTINCT subject_id):n_subjects', STATS.format('gratio'))}
FROM obj JOIN supplier ON s_suppkey = subject_id JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE gratio < 1 GROUP BY ALL""",
)
def pooled_by_nation(spark, sf):
    groups = (
        table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("subject_id"), "n_name", "r_name")
    )
    pooled = aggregate.drop_outliers(objects(spark, sf)).join(groups, "subject_id")
    counts = pooled.groupBy("n_name", "r_name").agg(
        F.count(F.lit(1)).alias("n_objects"), F.count_distinct("subject_id").alias("n_subjects")
    )
    return counts.join(aggregate.statistics(pooled, ["n_name", "r_name"], "gratio"), ["n_name", "r_name"])


@query(
    "pooled_union",
    f"""WITH {OBJ} SELECT subject_id, image_id, {cols('line', 'axon_diam; CASE WHEN line > 3 THEN gratio END:gratio')} FROM obj""",
)
def pooled_union(spark, sf):
    # tables without fibre measures are pooled with tables that have them
    base = objects(spark, sf).select("subject_id", "image_id", "line", "axon_diam", "gratio")
    plain = base.filter("line <= 3").drop("gratio")
    return base.filter("line > 3").unionByName(plain, allowMissingColumns=True)


# ---- quality ----------------------------------------------------------------------------

METRICS = ["axon_diam", "gratio", "myelin_thickness"]
MELT = " UNION ALL ".join(f"SELECT subject_id, '{m}' AS metric, {m} AS value FROM obj" for m in METRICS)


@query(
    "metric_summary",
    f"""WITH {OBJ}, u AS ({MELT}) SELECT subject_id, metric, {cols('count(*) FILTER (value IS NULL):n_missing; count(value):n',
    'avg(value):mean; stddev_pop(value):std; min(value):min; max(value):max; median(value):median; quantile_cont(value, 0.25):q1; quantile_cont(value, 0.75):q3; '
    'quantile_cont(value, 0.75) - quantile_cont(value, 0.25):iqr')} FROM u GROUP BY ALL""",
)
def metric_summary(spark, sf):
    return quality.summary(objects(spark, sf), ["subject_id"], METRICS)


@query(
    "metric_histogram",
    f"""WITH {OBJ}, u AS (SELECT * FROM ({MELT}) WHERE value IS NOT NULL),
s AS (SELECT subject_id, metric, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, count(*) AS n FROM u GROUP BY ALL),
b AS (SELECT *, CAST(CASE WHEN iqr > 0 THEN greatest(ceil((hi - lo) / (2.0 * iqr * pow(n, CAST(-1 AS DOUBLE) / 3))), 1) ELSE 1 END AS BIGINT) AS bins FROM s),
c AS (SELECT subject_id, metric, CASE WHEN hi > lo THEN least(CAST(floor((value - lo) * bins / (hi - lo)) AS BIGINT), bins - 1) ELSE 0 END AS bin, count(*) AS k
  FROM u JOIN b USING (subject_id, metric) GROUP BY ALL),
g AS (SELECT *, unnest(range(bins)) AS bin FROM b)
SELECT subject_id, metric, {cols('bin; coalesce(k, 0):n', 'lo + bin * ((hi - lo) / bins):low')} FROM g LEFT JOIN c USING (subject_id, metric, bin)""",
)
def metric_histogram(spark, sf):
    return quality.histogram(objects(spark, sf), ["subject_id"], METRICS)


@query(
    "numeric_metrics",
    f"""WITH {OBJ} SELECT * FROM (VALUES ('axon_diam'), ('gratio'), ('myelin_thickness'), ('axon_area'), ('myelin_area')) t(metric),
(SELECT count(*) AS n_objects FROM obj)""",
)
def numeric_metrics(spark, sf):
    df = objects(spark, sf)
    names = F.array(*[F.lit(m) for m in quality.numeric_metrics(df)])
    return df.agg(F.count(F.lit(1)).alias("n_objects")).select(F.explode(names).alias("metric"), "n_objects")


@query(
    "quality_flags",
    f"""WITH {OBJ}, m AS (SELECT subject_id, min(axon_area) AS a, min(myelin_area) AS b FROM obj GROUP BY 1),
f AS (SELECT obj.*, coalesce(gratio >= CAST(0.99 AS DOUBLE), false) AS flag_gratio, coalesce(axon_area <= a * 5, false) AS flag_axon,
  coalesce(myelin_area <= b * 5, false) AS flag_myelin FROM obj JOIN m USING (subject_id))
SELECT subject_id, image_id, {cols('line', 'axon_diam')}, flag_gratio, flag_axon, flag_myelin FROM f WHERE flag_gratio OR flag_axon OR flag_myelin""",
)
def quality_flags(spark, sf):
    flagged = quality.flag_objects(objects(spark, sf), ["subject_id"])
    return flagged.select("subject_id", "image_id", "line", "axon_diam", "flag_gratio", "flag_axon", "flag_myelin")


@query(
    "distinct_counts",
    f"""{FIBRE_SQL}, i AS (SELECT image_id, count(DISTINCT label) AS n_instances FROM f GROUP BY 1),
g AS (SELECT image_id, max(label) AS n_regions, count(*) FILTER (area <= 2) AS n_small FROM r GROUP BY 1)
SELECT image_id, {cols('coalesce(n_instances, 0):n_instances; coalesce(n_regions, 0):n_regions; coalesce(n_small, 0):n_small')}
FROM images LEFT JOIN i USING (image_id) LEFT JOIN g USING (image_id)""",
)
def distinct_counts(spark, sf):
    instances = fibres(spark, sf).groupBy("image_id").agg(F.count_distinct("label").alias("n_instances"))
    regions = region_sums(axon_labels(spark, sf)).groupBy("image_id").agg(
        F.max("label").alias("n_regions"), F.count_if(F.col("area") <= 2).alias("n_small")
    )
    out = images(spark, sf).select("image_id").join(instances, "image_id", "left").join(regions, "image_id", "left")
    return out.na.fill(0)


@query(
    "object_ranks",
    f"""WITH {OBJ}, z AS (SELECT *, coalesce(axon_diam, -1) AS d, coalesce(myelin_thickness, -1) AS t, coalesce(gratio, -1) AS g FROM obj),
k AS (SELECT *, count(*) OVER w AS total, rank() OVER (PARTITION BY subject_id ORDER BY d) AS rd, rank() OVER (PARTITION BY subject_id ORDER BY t) AS rt,
  CASE WHEN gratio IS NULL THEN -1 ELSE rank() OVER (PARTITION BY subject_id ORDER BY gratio NULLS LAST) END AS rg,
  rank() OVER (PARTITION BY subject_id ORDER BY g) AS rg2, count(*) OVER (PARTITION BY subject_id, d) AS nd, count(*) OVER (PARTITION BY subject_id, t) AS nt,
  count(*) OVER (PARTITION BY subject_id, g) AS ng FROM z WINDOW w AS (PARTITION BY subject_id))
SELECT subject_id, image_id, {cols('line; rd:diameter_rank; rt:thickness_rank; rg:gratio_rank', 'axon_diam')},
printf('%.1f', (rd + (nd - 1) / 2) / total * 100) AS diameter_percentile, printf('%.1f', (rt + (nt - 1) / 2) / total * 100) AS thickness_percentile,
printf('%.1f', (rg2 + (ng - 1) / 2) / total * 100) AS gratio_percentile,
rd || ' of ' || total AS diameter_of, rt || ' of ' || total AS thickness_of, rg || ' of ' || total AS gratio_of FROM k""",
)
def object_ranks(spark, sf):
    out = quality.ranks(objects(spark, sf), ["subject_id"])
    return out.drop("gratio", "myelin_thickness", "axon_area", "myelin_area")


@query(
    "object_index",
    f"""WITH RECURSIVE {PX}, {components_sql('l', 'axon', 2)} SELECT DISTINCT image_id, {cols('label - 1:idx')} FROM l""",
)
def object_index(spark, sf):
    regions = region_sums(label_components(axon(spark, sf), 2, extent=EXTENT))
    return regions.select("image_id", (F.col("label") - 1).alias("idx"))


# ---- sets and joins -----------------------------------------------------------------------


@query(
    "flag_union",
    f"""WITH {OBJ} SELECT subject_id, image_id, CAST(line AS BIGINT) AS line FROM obj WHERE gratio >= CAST(0.99 AS DOUBLE)
UNION SELECT subject_id, image_id, CAST(line AS BIGINT) FROM obj WHERE axon_diam < 0.25""",
)
def flag_union(spark, sf):
    df = objects(spark, sf).select("subject_id", "image_id", "line", "gratio", "axon_diam")
    keep = ["subject_id", "image_id", "line"]
    return df.filter("gratio >= 0.99D").select(keep).union(df.filter("axon_diam < 0.25D").select(keep)).distinct()


@query(
    "candidate_intersection",
    f"""{TWO} SELECT image_id, {cols('y; x')} FROM (SELECT DISTINCT image_id, cy AS y, cx AS x FROM pr INTERSECT SELECT image_id, y, x FROM truth)""",
)
def candidate_intersection(spark, sf):
    spots = region_sums(axon_labels(spark, sf)).selectExpr("image_id", "cast(sum_y div area as int) y", "cast(sum_x div area as int) x")
    return spots.intersect(true_axon(spark, sf))


@query(
    "candidate_difference",
    f"""{TWO} SELECT image_id, {cols('y; x')} FROM (SELECT image_id, cy AS y, cx AS x FROM pr EXCEPT ALL SELECT image_id, y, x FROM truth)""",
)
def candidate_difference(spark, sf):
    spots = region_sums(axon_labels(spark, sf)).selectExpr("image_id", "cast(sum_y div area as int) y", "cast(sum_x div area as int) x")
    return spots.exceptAll(true_axon(spark, sf))


@query(
    "object_overlaps",
    f"""{TWO} SELECT p.image_id, {cols('p.label:label; t.label:true_label; count(*):common')}
FROM pl p JOIN tl t ON p.image_id = t.image_id AND p.pos = t.pos GROUP BY p.image_id, p.label, t.label""",
)
def object_overlaps(spark, sf):
    return overlap_lengths(*two_labellings(spark, sf))


@query(
    "points_in_regions",
    f"""WITH RECURSIVE {PX}, {components_sql('l', 'axon', 2)}, {POINTS}
SELECT event_id, image_id, {cols('label')} FROM points LEFT JOIN l USING (image_id, y, x)""",
)
def points_in_regions(spark, sf):
    labels = label_components(axon(spark, sf), 2, extent=EXTENT)
    return lookup(points(spark, sf), labels, ["label"]).select("event_id", "image_id", "label")
