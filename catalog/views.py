"""Views of the given tables that the queries (and their SQL) start from.

* rasters: every vector of ``embeddings`` is an 8 x 8 image, row-major;
* slide: one large sparse image of ``lineitem`` cell sums;
* objects: every row of ``lineitem`` is a measured object of an image and a subject;
* points: every event is a point on one of the images.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EXTENT = (8, 8)


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, the equivalent SQL."""

    def add(fn):
        QUERIES[name] = lambda spark, sf: tidy(fn(spark, sf))
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: BIGINT integers, doubles rounded to 6 places without -0."""
    columns = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("tinyint", "smallint", "int"):
            c = c.cast("bigint")
        elif kind in ("float", "double"):
            c = F.when(F.abs(c) < 5e-7, F.lit(0.0)).otherwise(F.round(c.cast("double"), 6))
        columns.append(c.alias(name))
    return df.select(*columns)


def I(expr: str, name: str | None = None) -> str:  # noqa: E743
    return f"CAST({expr} AS BIGINT) AS {name or expr}"


def D(expr: str, name: str | None = None) -> str:
    d = f"CAST({expr} AS DOUBLE)"
    return f"CASE WHEN abs({d}) < 5e-7 THEN 0.0 ELSE round({d}, 6) END AS {name or expr}"


def exact(expr: str, places: int) -> str:
    """Exact decimal rounding of a double."""
    return f"CASE WHEN ({expr}) IS NOT NULL THEN CAST(printf('%.{places}f', CAST({expr} AS DOUBLE)) AS DOUBLE) END"


def cols(ints: str = "", doubles: str = "", plain: str = "") -> str:
    """SELECT list of columns by kind; an item is ``name`` or ``expr:name``."""
    out = []
    for text, form in ((ints, I), (doubles, D)):
        for item in filter(None, (t.strip() for t in text.split(";"))):
            expr, _, name = item.rpartition(":")
            out.append(form(expr or name, name))
    out += [t.strip() for t in plain.split(";") if t.strip()]
    return ", ".join(out)


# ---- rasters ------------------------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rasters(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels with their value, the next one's and the one a row below (both wrap)."""
    cells = (
        "inline(transform(embedding, (v, i) -> struct(i AS pos, cast(i div 8 as int) AS y, i % 8 AS x, cast(v as double) AS v, "
        "cast(embedding[(i + 1) % 64] as double) AS nv, cast(embedding[(i + 8) % 64] as double) AS bv)))"
    )
    return table(spark, sf, "embeddings").selectExpr("vec_id AS image_id", cells)


def raster_runs(spark: SparkSession, sf: str, condition: str) -> DataFrame:
    """Runs of the pixels where a condition on ``c.v``, ``c.nv`` and ``c.bv`` holds, found inside each vector."""
    cells = (
        "transform(embedding, (v, i) -> struct(cast(v as double) AS v, cast(embedding[(i + 1) % 64] as double) AS nv, "
        "cast(embedding[(i + 8) % 64] as double) AS bv))"
    )
    on = table(spark, sf, "embeddings").selectExpr("vec_id AS image_id", f"transform({cells}, c -> coalesce({condition}, false)) AS on")
    ends = on.selectExpr(
        "image_id", "filter(sequence(0, 63), i -> on[i] AND (i % 8 = 0 OR NOT on[i - 1])) AS a", "filter(sequence(0, 63), i -> on[i] AND (i % 8 = 7 OR NOT on[i + 1])) AS b"
    )
    return ends.selectExpr("image_id", "inline(transform(arrays_zip(a, b), r -> struct(cast(r.a div 8 as int) AS y, r.a % 8 AS x0, r.b % 8 AS x1)))")


#: The masks of the views as conditions for ``raster_runs``.
AXON, NERVE, TRUTH = "c.v > 0.05D", "c.bv > 0", "(c.v + c.nv) / 2 > 0.03D"


def images(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width")
    )


PIXEL = ["image_id", "y", "x"]


def axon(spark, sf):
    return rasters(spark, sf).filter("v > 0.05D").select(*PIXEL)


def myelin(spark, sf):
    return rasters(spark, sf).filter("v > -0.10D AND v <= 0.05D").select(*PIXEL)


def nerve(spark, sf):
    return rasters(spark, sf).filter("bv > 0").select(*PIXEL)


def true_axon(spark, sf):
    return rasters(spark, sf).filter("(v + nv) / 2 > 0.03D").select(*PIXEL)


def predicted_classes(spark, sf):
    return rasters(spark, sf).selectExpr(
        *PIXEL, "CASE WHEN v > 0.05D THEN 'axon' WHEN v > -0.10D THEN 'myelin' END AS cls"
    ).filter("cls IS NOT NULL")


def true_classes(spark, sf):
    return rasters(spark, sf).selectExpr(
        *PIXEL, "CASE WHEN (v + nv) / 2 > 0.03D THEN 'axon' WHEN (v + nv) / 2 > -0.08D THEN 'myelin' END AS cls"
    ).filter("cls IS NOT NULL")


PX = """px AS (SELECT vec_id AS image_id, p AS pos, p // 8 AS y, p % 8 AS x,
  CAST(embedding[p + 1] AS DOUBLE) AS v, CAST(embedding[(p + 1) % 64 + 1] AS DOUBLE) AS nv,
  CAST(embedding[(p + 8) % 64 + 1] AS DOUBLE) AS bv FROM embeddings, range(64) t(p)),
axon AS (SELECT * FROM px WHERE v > CAST(0.05 AS DOUBLE)),
myelin AS (SELECT * FROM px WHERE v > CAST(-0.10 AS DOUBLE) AND v <= CAST(0.05 AS DOUBLE)),
nerve AS (SELECT * FROM px WHERE bv > 0),
truth AS (SELECT * FROM px WHERE (v + nv) / 2 > CAST(0.03 AS DOUBLE)),
pcls AS (SELECT image_id, pos, y, x, CASE WHEN v > CAST(0.05 AS DOUBLE) THEN 'axon' ELSE 'myelin' END AS cls
  FROM px WHERE v > CAST(-0.10 AS DOUBLE)),
tcls AS (SELECT image_id, pos, y, x, CASE WHEN (v + nv) / 2 > CAST(0.03 AS DOUBLE) THEN 'axon' ELSE 'myelin' END AS cls
  FROM px WHERE (v + nv) / 2 > CAST(-0.08 AS DOUBLE)),
images AS (SELECT vec_id AS image_id, 8 AS height, 8 AS width FROM embeddings)"""


def components_sql(name: str, source: str, connectivity: int) -> str:
    """CTEs that label the pixels of ``source`` by reachability."""
    near = "abs(a.y - b.y) + abs(a.x - b.x) = 1" if connectivity == 1 else "greatest(abs(a.y - b.y), abs(a.x - b.x)) = 1"
    return f"""{name}_n AS (SELECT a.image_id, a.pos AS p, b.pos AS q FROM {source} a JOIN {source} b
  ON a.image_id = b.image_id AND {near}),
{name}_r AS (SELECT image_id, pos AS s, pos AS p FROM {source} UNION
  SELECT r.image_id, r.s, n.q FROM {name}_r r JOIN {name}_n n ON r.image_id = n.image_id AND r.p = n.p),
{name} AS (SELECT image_id, p AS pos, p // 8 AS y, p % 8 AS x,
  dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS label
  FROM (SELECT image_id, p, min(s) AS root FROM {name}_r GROUP BY 1, 2))"""


def regions_sql(name: str, labels: str) -> str:
    """CTEs with sums, box and ellipse of labelled pixels."""
    return f"""{name}_s AS (SELECT image_id, label, count(*) AS area, sum(y) AS sy, sum(x) AS sx, sum(y * y) AS syy,
  sum(x * x) AS sxx, sum(x * y) AS sxy, min(y) AS y_lo, min(x) AS x_lo, max(y) + 1 AS y_hi, max(x) + 1 AS x_hi
  FROM {labels} GROUP BY 1, 2),
{name}_m AS (SELECT *, CAST(area * sxx - sx * sx AS DOUBLE) / area / area AS a,
  CAST(area * syy - sy * sy AS DOUBLE) / area / area AS c,
  CAST(area * sxy - sx * sy AS DOUBLE) / area / area AS b,
  CAST(area * sxx - sx * sx AS BIGINT) AS ia, CAST(area * syy - sy * sy AS BIGINT) AS ic FROM {name}_s),
{name}_e AS (SELECT *, greatest((a + c) / 2 + sqrt(4 * b * b + (a - c) * (a - c)) / 2, 0.0) AS l1,
  greatest((a + c) / 2 - sqrt(4 * b * b + (a - c) * (a - c)) / 2, 0.0) AS l2 FROM {name}_m),
{name} AS (SELECT image_id, label, area, sy, sx, y_lo, x_lo, y_hi, x_hi,
  CAST(sy AS DOUBLE) / area AS y0, CAST(sx AS DOUBLE) / area AS x0, CAST(sy // area AS INTEGER) AS cy,
  CAST(sx // area AS INTEGER) AS cx, sqrt(4.0 * area / pi()) AS equivalent_diameter,
  4 * sqrt(l1) AS major_axis, 4 * sqrt(l2) AS minor_axis,
  CASE WHEN l1 = 0 THEN 0.0 ELSE sqrt(1 - l2 / l1) END AS eccentricity,
  CASE WHEN ia = ic THEN CASE WHEN b > 0 THEN pi() / 4 ELSE -pi() / 4 END
  ELSE 0.5 * atan2(2 * b, c - a) END AS orientation FROM {name}_e)"""


def perimeter_sql(name: str, labels: str) -> str:
    """CTE with the pattern-weighted border length of labelled pixels."""
    return f"""{name}_b AS (SELECT l.* FROM {labels} l LEFT JOIN {labels} n ON l.image_id = n.image_id AND l.label = n.label
  AND abs(l.y - n.y) + abs(l.x - n.x) = 1 GROUP BY ALL HAVING count(n.pos) < 4),
{name}_c AS (SELECT l.image_id, l.label, l.pos, 1 + coalesce(sum(CASE WHEN n.pos IS NULL THEN 0
  WHEN l.y = n.y OR l.x = n.x THEN 2 ELSE 10 END), 0) AS code
  FROM {name}_b l LEFT JOIN {name}_b n ON l.image_id = n.image_id AND l.label = n.label
  AND greatest(abs(l.y - n.y), abs(l.x - n.x)) = 1 GROUP BY ALL),
{name} AS (SELECT image_id, label, count(*) FILTER (code IN (5, 7, 15, 17, 25, 27))
  + sqrt(2.0) * count(*) FILTER (code IN (21, 33)) + (1 + sqrt(2.0)) / 2 * count(*) FILTER (code IN (13, 23)) AS perimeter
  FROM {name}_c GROUP BY 1, 2)"""


def hull_sql(name: str, labels: str) -> str:
    """CTE with the pixels inside each object's hull, from all pairs of its row ends."""
    return f"""{name}_r AS (SELECT image_id, label, y, min(x) AS x0, max(x) AS x1 FROM {labels} GROUP BY ALL),
{name}_p AS (SELECT image_id, label, 2 * y + k AS py, 2 * x0 - 1 + abs(k) AS lx, 2 * x1 + 1 - abs(k) AS rx
  FROM {name}_r, (VALUES (-1), (0), (1)) o(k)),
{name}_b AS (SELECT r.image_id, r.label, r.y,
  min(CASE WHEN a.py = b.py THEN a.lx ELSE a.lx + CAST(b.lx - a.lx AS DOUBLE) * (2 * r.y - a.py) / (b.py - a.py) END) AS l,
  max(CASE WHEN a.py = b.py THEN a.rx ELSE a.rx + CAST(b.rx - a.rx AS DOUBLE) * (2 * r.y - a.py) / (b.py - a.py) END) AS h
  FROM {name}_r r JOIN {name}_p a ON a.image_id = r.image_id AND a.label = r.label AND a.py <= 2 * r.y
  JOIN {name}_p b ON b.image_id = r.image_id AND b.label = r.label AND b.py >= 2 * r.y GROUP BY ALL),
{name} AS (SELECT image_id, label, CAST(sum(floor(h / 2 + 1e-9) - ceil(l / 2 - 1e-9) + 1) AS BIGINT) AS hull_area
  FROM {name}_b GROUP BY ALL)"""


def _level(name: str, start: str) -> str:
    """CTE: 64 growth steps on whole images kept as lists of labels."""
    return f"""{name}(image_id, k, mask, lab) AS (SELECT image_id, 0, mask, lab FROM {start} UNION ALL
  SELECT image_id, k + 1, mask, list_transform(range(64), lambda p: CASE WHEN NOT mask[p + 1] THEN NULL
    WHEN lab[p + 1] IS NOT NULL THEN lab[p + 1] ELSE list_min([
      CASE WHEN p >= 8 THEN lab[p - 7] END, CASE WHEN p % 8 > 0 THEN lab[p] END,
      CASE WHEN p % 8 < 7 THEN lab[p + 2] END, CASE WHEN p < 56 THEN lab[p + 9] END]) END)
  FROM {name} WHERE k < 64)"""


def grow_sql(name: str, seeds: str, axon: str = "axon", myelin: str = "myelin") -> str:
    """CTEs that grow seeds in the axon pixels, then in the whole fibre mask."""
    return f"""{name}_f AS (SELECT p.image_id, p.pos, a.pos IS NOT NULL AS ax, a.pos IS NOT NULL OR m.pos IS NOT NULL AS fib,
  s.label FROM px p LEFT JOIN {axon} a USING (image_id, pos) LEFT JOIN {myelin} m USING (image_id, pos)
  LEFT JOIN {seeds} s ON s.image_id = p.image_id AND s.y = p.y AND s.x = p.x),
{name}_g AS (SELECT image_id, list(ax ORDER BY pos) AS mask, list(fib ORDER BY pos) AS fib,
  list(CASE WHEN ax THEN label END ORDER BY pos) AS lab,
  list(CASE WHEN fib AND NOT ax THEN label END ORDER BY pos) AS outside FROM {name}_f GROUP BY 1),
{_level(name + "_1", name + "_g")},
{name}_h AS (SELECT g.image_id, g.fib AS mask, list_transform(range(64), lambda p: coalesce(i.lab[p + 1], g.outside[p + 1])) AS lab
  FROM {name}_1 i JOIN {name}_g g USING (image_id) WHERE i.k = 64),
{_level(name + "_2", name + "_h")},
{name} AS (SELECT image_id, p AS pos, p // 8 AS y, p % 8 AS x, lab[p + 1] AS label FROM {name}_2, range(64) t(p)
  WHERE k = 64 AND lab[p + 1] IS NOT NULL)"""


def flood_sql(name: str, seeds: str, axon: str = "axon", myelin: str = "myelin") -> str:
    """CTEs that flood the fibre mask: least costs by 64 rounds over whole images, then labels by 64 more."""

    def near(form: str) -> str:
        sides = (("p >= 8", "p - 7"), ("p % 8 > 0", "p"), ("p % 8 < 7", "p + 2"), ("p < 56", "p + 9"))
        return ", ".join(f"CASE WHEN {inside} THEN {form.format(n=n)} END" for inside, n in sides)

    top = "cost[{n}] // 2147483648"
    onward = (
        f"CASE WHEN lev[p + 1] > {top} THEN lev[p + 1] * 2147483648 + 1 WHEN lev[p + 1] = {top} THEN cost[{{n}}] + 1 ELSE cost[{{n}}] END"
    )
    return f"""{name}_d AS (SELECT a.image_id, a.pos, min((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)) AS d2
  FROM {axon} a JOIN (SELECT px.* FROM px ANTI JOIN {axon} USING (image_id, pos)) b USING (image_id) GROUP BY 1, 2),
{name}_f AS (SELECT p.image_id, p.pos, s.label, CASE WHEN a.pos IS NOT NULL OR m.pos IS NOT NULL
  THEN CAST(1073741824 - coalesce(d.d2, 0) AS BIGINT) END AS lev FROM px p
  LEFT JOIN {axon} a USING (image_id, pos) LEFT JOIN {myelin} m USING (image_id, pos) LEFT JOIN {name}_d d USING (image_id, pos)
  LEFT JOIN {seeds} s ON s.image_id = p.image_id AND s.y = p.y AND s.x = p.x),
{name}_g AS (SELECT image_id, list(lev ORDER BY pos) AS lev, list(CASE WHEN lev IS NOT NULL THEN label END ORDER BY pos) AS lab,
  list(CASE WHEN label IS NOT NULL THEN lev * 2147483648 END ORDER BY pos) AS cost FROM {name}_f GROUP BY 1),
{name}_1(image_id, k, lev, lab, cost) AS (SELECT image_id, 0, lev, lab, cost FROM {name}_g UNION ALL
  SELECT image_id, k + 1, lev, lab, list_transform(range(64), lambda p: CASE WHEN lev[p + 1] IS NOT NULL
    THEN list_min([cost[p + 1], {near(onward)}]) END) FROM {name}_1 WHERE k < 64),
{name}_2(image_id, k, lev, cost, seed, lab) AS (SELECT image_id, 0, lev, cost, lab, lab FROM {name}_1 WHERE k = 64 UNION ALL
  SELECT image_id, k + 1, lev, cost, seed, list_transform(range(64), lambda p: CASE WHEN seed[p + 1] IS NOT NULL THEN seed[p + 1]
    WHEN cost[p + 1] IS NOT NULL THEN list_min([lab[p + 1], {near(f"CASE WHEN ({onward}) = cost[p + 1] THEN lab[{{n}}] END")}]) END)
  FROM {name}_2 WHERE k < 64),
{name} AS (SELECT image_id, p AS pos, p // 8 AS y, p % 8 AS x, lab[p + 1] AS label FROM {name}_2, range(64) t(p)
  WHERE k = 64 AND lab[p + 1] IS NOT NULL)"""


def arrival_sql(name: str, seeds: str, axon: str = "axon", myelin: str = "myelin") -> str:
    """CTEs that run a priority queue of (level, arrival, place) on every image: each round takes one place and puts in its neighbours."""
    return f"""{name}_d AS (SELECT a.image_id, a.pos, min((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)) AS d2
  FROM {axon} a JOIN (SELECT px.* FROM px ANTI JOIN {axon} USING (image_id, pos)) b USING (image_id) GROUP BY 1, 2),
{name}_f AS (SELECT p.image_id, p.pos, CASE WHEN a.pos IS NOT NULL OR m.pos IS NOT NULL THEN s.label END AS label,
  CASE WHEN a.pos IS NOT NULL OR m.pos IS NOT NULL THEN CAST(-coalesce(d.d2, 0) AS BIGINT) END AS lev FROM px p
  LEFT JOIN {axon} a USING (image_id, pos) LEFT JOIN {myelin} m USING (image_id, pos) LEFT JOIN {name}_d d USING (image_id, pos)
  LEFT JOIN {seeds} s ON s.image_id = p.image_id AND s.y = p.y AND s.x = p.x),
{name}_q(image_id, lev, lab, queue, age) AS (SELECT image_id, list(lev ORDER BY pos), list(label ORDER BY pos),
    list([lev, 0, pos] ORDER BY pos) FILTER (label IS NOT NULL), 0 FROM {name}_f GROUP BY 1
  UNION ALL SELECT image_id, lev, list_transform(range(64), lambda i: CASE WHEN list_contains(fresh, i) THEN lab[here + 1] ELSE lab[i + 1] END),
    list_concat(list_filter(queue, lambda e: e <> head), list_transform(fresh, lambda i, k: [lev[i + 1], age + k, i])), age + len(fresh)
  FROM (SELECT *, list_filter([CASE WHEN here >= 8 THEN here - 8 END, CASE WHEN here % 8 > 0 THEN here - 1 END, CASE WHEN here % 8 < 7 THEN here + 1 END,
      CASE WHEN here < 56 THEN here + 8 END], lambda i: i IS NOT NULL AND lev[i + 1] IS NOT NULL AND lab[i + 1] IS NULL) AS fresh
    FROM (SELECT *, list_min(queue) AS head, list_min(queue)[3] AS here FROM {name}_q WHERE len(queue) > 0))),
{name} AS (SELECT image_id, p AS pos, p // 8 AS y, p % 8 AS x, lab[p + 1] AS label
  FROM (SELECT image_id, lab FROM {name}_q WHERE queue IS NULL OR len(queue) = 0), range(64) t(p) WHERE lab[p + 1] IS NOT NULL)"""


def seeds_sql(name: str, regions: str) -> str:
    return f"{name} AS (SELECT image_id, cy AS y, cx AS x, max(label) AS label FROM {regions} GROUP BY ALL)"


# ---- slide --------------------------------------------------------------------------


def slide(spark: SparkSession, sf: str) -> DataFrame:
    """Non-empty cells of the large sparse image."""
    return table(spark, sf, "lineitem").groupBy(
        F.lit(0).cast("bigint").alias("image_id"), F.col("l_suppkey").cast("int").alias("y"),
        (F.col("l_partkey") % 1000).cast("int").alias("x"),
    ).agg(F.sum("l_quantity").alias("v"))


def slide_size(spark: SparkSession, sf: str) -> DataFrame:
    """The large image is as high as its last row; columns are taken modulo 1000."""
    return table(spark, sf, "lineitem").agg(F.max("l_suppkey").alias("last")).select(
        F.lit(0).cast("bigint").alias("image_id"), (F.col("last") + 1).cast("int").alias("height"), F.lit(1000).alias("width")
    )


SLIDE = """cells AS (SELECT 0 AS image_id, l_suppkey AS y, l_partkey % 1000 AS x, sum(l_quantity) AS v
  FROM lineitem GROUP BY ALL)"""


# ---- objects ------------------------------------------------------------------------


def objects(spark: SparkSession, sf: str) -> DataFrame:
    """Object table: subject, image and measures of every ``lineitem`` row."""
    base = table(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS subject_id", "l_orderkey AS image_id", "l_linenumber AS line",
        "(l_quantity + l_extendedprice / 1317171D) / 20 AS axon_diam",
        "CASE WHEN l_tax = 0.08D THEN NULL ELSE 0.6D + 4.5D * l_discount + l_extendedprice / 13171717D END AS gratio",
    ).withColumn("myelin_thickness", F.expr("axon_diam / 2 * (1 / gratio - 1)"))
    return base.withColumn("axon_area", F.expr("pi() * axon_diam * axon_diam / 4")).withColumn(
        "myelin_area", F.expr("pi() * (axon_diam / 2 + myelin_thickness) * (axon_diam / 2 + myelin_thickness) - axon_area")
    )


OBJ = """obj0 AS (SELECT l_suppkey AS subject_id, l_orderkey AS image_id, l_linenumber AS line, (l_quantity + l_extendedprice / CAST(1317171 AS DOUBLE)) / 20 AS axon_diam,
  CASE WHEN l_tax = CAST(0.08 AS DOUBLE) THEN NULL ELSE CAST(0.6 AS DOUBLE) + CAST(4.5 AS DOUBLE) * l_discount + l_extendedprice / CAST(13171717 AS DOUBLE) END AS gratio
  FROM lineitem),
obj1 AS (SELECT *, axon_diam / 2 * (1 / gratio - 1) AS myelin_thickness, pi() * axon_diam * axon_diam / 4 AS axon_area FROM obj0),
obj AS (SELECT *, pi() * (axon_diam / 2 + myelin_thickness) * (axon_diam / 2 + myelin_thickness) - axon_area AS myelin_area
  FROM obj1)"""


# ---- points -------------------------------------------------------------------------


def points(spark: SparkSession, sf: str) -> DataFrame:
    """A point per event, spread over all images."""
    n = table(spark, sf, "embeddings").agg(F.count(F.lit(1))).scalar()
    return table(spark, sf, "events").select(
        "event_id", (F.col("event_id") % n).alias("image_id"),
        (F.hour("ts") % 8).cast("int").alias("y"), (F.col("user_id") % 8).cast("int").alias("x"),
    )


POINTS = """points AS (SELECT event_id, event_id % (SELECT count(*) FROM embeddings) AS image_id,
  CAST(hour(ts) % 8 AS INTEGER) AS y, CAST(user_id % 8 AS INTEGER) AS x FROM events)"""
