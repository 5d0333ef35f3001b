"""Files and stored tables: names, headers, sidecars and round trips.

Folder listings are derived from the given tables: every ``part`` is an image of the
subject given by its size, and some of its files are missing.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from catalog.raster_queries import BOX, MEASURES, measure_sql
from catalog.views import EXTENT, OBJ, PX, axon, cols, components_sql, images, objects, predicted_classes, query, rasters, table
from segstats.functions.scalars import file_extension, gray_level
from segstats.operators.components import label_components
from segstats.operators.masks import mask_name
from segstats.operators.runs import as_pixels
from segstats.plans.folder import measure_folder
from segstats.plans.nerve import fascicle_areas, nerve_document
from segstats.plans.objects import mask_fractions
from segstats.session import scratch_path
from segstats.sources import files, tables

# one row per file: images, masks of several roles, object tables, sidecars, other files
_FILES = {
    ".png": "p_partkey % 7 <> 0",
    ".TIF": "p_partkey % 7 = 0",
    "_seg-axonmyelin.png": "p_partkey % 3 <> 0",
    "_seg-axon.png": "p_partkey % 5 <> 0",
    "_seg-myelin.png": "p_partkey % 11 <> 0",
    "_seg-uaxon.png": "p_partkey % 4 = 0",
    "_seg-nerve.png": "p_partkey % 6 = 0",
    "_axon_morphometrics.csv": "p_partkey % 3 = 1 OR p_size > 40",
    "_index.png": "p_partkey % 9 = 0",
    "_notes.ome.tiff": "p_partkey % 13 = 0",
    ".txt": "p_partkey % 8 = 0",
}
STEM = "'/data/subject' || CAST(p_size AS STRING) || '/img' || CAST(p_partkey AS STRING)"
LISTING = "listing AS (" + " UNION ALL ".join(
    f"SELECT {STEM.replace('STRING', 'VARCHAR')} || '{end}' AS path FROM part WHERE {rule}" for end, rule in _FILES.items()
) + ")"


def listing(spark, sf):
    cases = F.array(*[F.when(F.expr(rule), F.lit(end)) for end, rule in _FILES.items()])
    # a table in one piece would be one task's work; the narrow rows are dealt first
    part = table(spark, sf, "part").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    return part.select(F.expr(STEM).alias("base"), F.explode(cases).alias("end")).filter("end IS NOT NULL").select(
        F.concat("base", "end").alias("path")
    )


GENERATED = ("_seg-axonmyelin.png", "_seg-axon.png", "_seg-myelin.png", "_index.png", "_seg-uaxon.png", "_seg-nerve.png")
NOT_GENERATED = " AND ".join(f"NOT path LIKE '%{s.replace('_', '!_')}' ESCAPE '!'" for s in GENERATED)


@query(
    "image_scan",
    f"""WITH {LISTING} SELECT path FROM listing WHERE regexp_matches(lower(path), '\\.(tif|tiff|png|jpg|jpeg)$') AND {NOT_GENERATED}""",
)
def image_scan(spark, sf):
    return files.list_images(listing(spark, sf))


ROLES = f"""WITH {LISTING}, m AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir,
  regexp_extract(path, '([^/]*)_seg-[a-z]+\\.png$', 1) AS stem, regexp_extract(path, '_seg-([a-z]+)\\.png$', 1) AS role
  FROM listing WHERE path LIKE '%!_seg-%' ESCAPE '!'),
i AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)\\.[^.]*$', 1) AS stem FROM listing
  WHERE regexp_matches(lower(path), '\\.(tif|tiff|png|jpg|jpeg)$') AND path NOT LIKE '%!_seg-%' ESCAPE '!')"""


@query("mask_roles", f"{ROLES} SELECT path, dir, stem, role FROM m")
def mask_roles(spark, sf):
    return files.mask_files(listing(spark, sf))


@query(
    "mask_pivot",
    f"""{ROLES} SELECT dir, stem, bool_or(role = 'axon') AS axon, bool_or(role = 'myelin') AS myelin, bool_or(role = 'axonmyelin') AS axonmyelin,
bool_or(role = 'uaxon') AS uaxon, bool_or(role = 'nerve') AS nerve FROM m GROUP BY ALL""",
)
def mask_pivot(spark, sf):
    found = files.mask_files(listing(spark, sf))
    return found.groupBy("dir", "stem").agg(*[F.bool_or(F.col("role") == r).alias(r) for r in files.MASK_ROLES])


def _ready(mode, role):
    @query(f"ready_images_{mode}", f"{ROLES} SELECT i.dir, i.stem, i.path FROM i SEMI JOIN (SELECT * FROM m WHERE role = '{role}') k USING (dir, stem)")
    def run(spark, sf):
        return files.ready_images(listing(spark, sf), mode)


for _mode, _role in files.TARGET_MASK.items():
    _ready(_mode, _role)


@query(
    "missing_masks",
    f"""{ROLES}, ready AS (SELECT * FROM i SEMI JOIN (SELECT * FROM m WHERE role = 'nerve') k USING (dir, stem)),
need AS (SELECT dir, stem, r.role FROM ready, (VALUES ('nerve'), ('axon'), ('myelin')) r(role))
SELECT * FROM need ANTI JOIN m USING (dir, stem, role)""",
)
def missing_masks(spark, sf):
    return files.missing_masks(listing(spark, sf), "nerve")


@query(
    "file_extensions",
    f"""WITH {LISTING} SELECT path, CASE {' '.join(f"WHEN lower(path) LIKE '%{e}' THEN '{e}'" for e in
    ('.ome.tif', '.ome.tiff', '.ome.tf2', '.ome.tf8', '.ome.btf', '.tif', '.tiff', '.png', '.jpg', '.jpeg'))} END AS extension FROM listing""",
)
def file_extensions(spark, sf):
    return listing(spark, sf).select("path", file_extension(F.col("path")).alias("extension"))


@query(
    "class_file_names",
    f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN {STEM.replace('STRING', 'VARCHAR')} || '_seg-axon.png' ELSE {STEM.replace('STRING', 'VARCHAR')} || '_seg-myelin.png' END AS path FROM part",
)
def class_file_names(spark, sf):
    raw = table(spark, sf, "part").select("p_partkey", F.expr(f"{STEM} || '_seg-nnunet.png'").alias("raw"))
    return raw.select(
        "p_partkey",
        F.when(F.col("p_partkey") % 2 == 0, mask_name(F.col("raw"), "axon")).otherwise(mask_name(F.col("raw"), "myelin")).alias("path"),
    )


def headers(spark, sf):
    """PNG header bytes built from part sizes: up to 50,000 x 50,000 pixels."""
    fixed = "'89504E470D0A1A0A0000000D49484452'"
    kind = "CASE p_partkey % 4 WHEN 0 THEN '00' WHEN 1 THEN '02' WHEN 2 THEN '04' ELSE '06' END"
    content = F.expr(
        f"unhex(concat({fixed}, lpad(hex(p_size * 1000), 8, '0'), lpad(hex(p_partkey % 500 * 100 + 1), 8, '0'), '08', {kind}))"
    )
    return table(spark, sf, "part").select(F.expr(f"{STEM} || CASE WHEN p_partkey % 3 = 0 THEN '.tif' ELSE '.png' END").alias("path"), content.alias("content"))


HEADERS = f"""WITH h AS (SELECT {STEM.replace('STRING', 'VARCHAR')} || CASE WHEN p_partkey % 3 = 0 THEN '.tif' ELSE '.png' END AS path, CAST(p_size * 1000 AS BIGINT) AS width,
  p_partkey % 500 * 100 + 1 AS height, CAST(8 AS BIGINT) AS bit_depth, CAST(CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 4 END AS BIGINT) AS channels FROM part)"""


@query("header_shapes", f"{HEADERS} SELECT path, {cols('width; height; bit_depth; channels')} FROM h")
def header_shapes(spark, sf):
    return files.png_header(headers(spark, sf)).drop("content")


def image_files(spark, sf):
    """Header bytes of TIFF files in both byte orders, with 32- and 64-bit offsets, and of JPEG files, built from part sizes."""
    big = lambda e, n: f"lpad(hex({e}), {2 * n}, '0')"
    little = lambda e, n: "concat(" + ", ".join(f"substr({big(e, n)}, {2 * k + 1}, 2)" for k in reversed(range(n))) + ")"

    def tiff(put, mark: str, large: bool) -> str:
        n = 8 if large else 4
        entry = lambda tag, form, value: [put(tag, 2), put(form, 2), put(1, n), f"rpad({put(value, 2 if form == 3 else 4)}, {2 * n}, '0')"]
        start = [f"'{mark}'", put(43, 2), put(8, 2), put(0, 2), put(24, 8), "repeat('0', 16)"] if large else [f"'{mark}'", put(42, 2), put(8, 4)]
        tags = [*entry(254, 4, 0), *entry(256, 4, "w"), *entry(257, 4, "h"), *entry(258, 3, "b"), *entry(277, 3, "c")]
        return ", ".join([*start, put(5, 8 if large else 2), *tags])

    comment = f"'FFD8', 'FFFE', {big('2 + p_partkey % 50', 2)}, repeat('AB', p_partkey % 50)"
    jpeg = f"{comment}, 'FFC2', '0011', '08', {big('h % 65536', 2)}, {big('w % 65536', 2)}, {big('c', 1)}, '0000'"
    forms = (tiff(little, "4949", False), tiff(big, "4D4D", False), tiff(little, "4949", True), jpeg, "'0000'")
    content = " ".join(f"WHEN {k} THEN concat({form})" for k, form in enumerate(forms))
    sizes = table(spark, sf, "part").selectExpr(
        "p_partkey", "p_size * 1000 AS w", "p_partkey % 500 * 100 + 1 AS h", "8 + 8 * (p_partkey % 2) AS b", "1 + p_partkey % 3 AS c"
    )
    return sizes.selectExpr("p_partkey", f"unhex(CASE p_partkey % 5 {content} END) AS content")


@query(
    "header_shapes_all",
    f"""WITH p AS (SELECT p_partkey, p_partkey % 5 AS f, p_size * 1000 AS w, p_partkey % 500 * 100 + 1 AS h, 8 + 8 * (p_partkey % 2) AS b, 1 + p_partkey % 3 AS c FROM part)
SELECT p_partkey, CASE WHEN f < 3 THEN 'tiff' WHEN f = 3 THEN 'jpeg' END AS kind,
{cols('CASE WHEN f < 3 THEN w WHEN f = 3 THEN w % 65536 END:width; CASE WHEN f < 3 THEN h WHEN f = 3 THEN h % 65536 END:height; '
      'CASE WHEN f < 3 THEN b WHEN f = 3 THEN 8 END:bit_depth; CASE WHEN f < 4 THEN c END:channels')} FROM p""",
)
def header_shapes_all(spark, sf):
    return files.image_headers(image_files(spark, sf))


@query("size_guard", f"{HEADERS} SELECT path, {cols('width * height:n_pixels')}, width * height <= 89478485 AS accepted FROM h")
def size_guard(spark, sf):
    ok, rejected = files.size_guard(files.png_header(headers(spark, sf)).drop("content"))
    both = ok.withColumn("accepted", F.lit(True)).unionByName(rejected.withColumn("accepted", F.lit(False)))
    return both.select("path", "n_pixels", "accepted")


@query(
    "input_check",
    f"""{HEADERS} SELECT path, channels <> 1 AS to_gray, path LIKE '%.tif' AS to_format,
CASE WHEN channels <> 1 THEN regexp_replace(path, '\\.[a-z]+$', '_grayscale.png') ELSE regexp_replace(path, '\\.[a-z]+$', '.png') END AS target FROM h""",
)
def input_check(spark, sf):
    return files.check_inputs(files.png_header(headers(spark, sf)), ".png", 1).select("path", "to_gray", "to_format", "target")


@query(
    "pixel_sizes",
    """SELECT p_partkey, '/data/subject' || CAST(p_size AS VARCHAR) AS dir, round(CASE WHEN p_size % 2 = 0 THEN p_size / 1000 ELSE p_size / 500 END, 6) AS um_per_px FROM part""",
)
def pixel_sizes(spark, sf):
    part = table(spark, sf, "part")
    texts = part.select("p_size").distinct().selectExpr(
        "'/data/subject' || CAST(p_size AS STRING) || '/pixel_size_in_micrometer.txt' AS path",
        "CAST(CASE WHEN p_size % 2 = 0 THEN p_size / 1000D ELSE p_size / 500D END AS STRING) || '\\n' AS value",
    )
    pictures = part.selectExpr("p_partkey", "'/data/subject' || CAST(p_size AS STRING) AS dir")
    return files.with_pixel_size(pictures, files.parse_pixel_sizes(texts)).select("p_partkey", "dir", "um_per_px")


@query(
    "subject_completeness",
    f"""WITH {LISTING}, f AS (SELECT regexp_extract(path, '/([^/]*)/[^/]*$', 1) AS subject_id, regexp_extract(path, '/([^/_]*)_[^/]*$', 1) AS stem,
  path LIKE '%.csv' AS o FROM listing WHERE path LIKE '%axon!_morphometrics.csv' ESCAPE '!' OR path LIKE '%!_seg-axonmyelin.png' ESCAPE '!'),
p AS (SELECT subject_id, stem, count(*) FILTER (o) AS a, count(*) FILTER (NOT o) AS b FROM f GROUP BY ALL),
s AS (SELECT subject_id, sum(a) AS a, sum(b) AS b, count(*) FILTER (b > 0 AND a = 0) AS c FROM p GROUP BY ALL)
SELECT subject_id, {cols('a:n_objects; b:n_masks; c:n_missing')}, a = b AND a > 0 AND c = 0 AS complete FROM s""",
)
def subject_completeness(spark, sf):
    return files.completeness(listing(spark, sf))


@query(
    "gray_conversion",
    f"""WITH {PX}, g AS (SELECT image_id, y, x, CAST(floor((v + 1) * 127) AS BIGINT) AS a, CAST(floor((nv + 1) * 127) AS BIGINT) AS b,
  CAST(floor((bv + 1) * 127) AS BIGINT) AS c FROM px)
SELECT {cols('image_id; y; x', 'CASE WHEN image_id % 4 < 2 THEN a ELSE 0.299 * c + 0.587 * b + 0.114 * a END:gray')} FROM g""",
)
def gray_conversion(spark, sf):
    g = rasters(spark, sf).selectExpr(
        "image_id", "y", "x",
        "transform(slice(array(v, nv, bv, 1D), 1, cast(image_id % 4 as int) + 1), e -> floor((e + 1) * 127)) AS channels",
    )
    return g.select("image_id", "y", "x", gray_level(F.col("channels")).alias("gray"))


@query(
    "stored_object_table",
    f"WITH {OBJ} SELECT subject_id, image_id, {cols('line', 'axon_diam; gratio; myelin_thickness; axon_area; myelin_area')} FROM obj",
)
def stored_object_table(spark, sf):
    path = scratch_path(spark, "objects")
    tables.write_objects(objects(spark, sf), path, "csv")
    back = tables.read_objects(spark, path, "csv")
    return back.withColumns({c: F.col(c).cast("bigint") for c in ("subject_id", "image_id", "line")})


@query(
    "subject_tree",
    f"""WITH {OBJ} SELECT CAST(subject_id AS VARCHAR) AS subject_id, {cols('count(*):n; count(gratio) FILTER (subject_id % 3 <> 1):n_gratio', 'sum(axon_diam):sum_diam; sum(axon_area) FILTER (subject_id % 3 <> 2):sum_area')}
FROM obj GROUP BY subject_id""",
)
def subject_tree(spark, sf):
    """A tree of CSV tables whose columns differ in number and order from subject to subject."""
    root = scratch_path(spark, "subjects")
    every = objects(spark, sf).select("subject_id", "line", "axon_diam", "gratio", "axon_area")
    forms = [every, every.select("axon_area", "subject_id", "axon_diam"), every.select("gratio", "axon_diam", "line", "subject_id")]
    for k, form in enumerate(forms):
        tables.write_objects(form.filter(F.col("subject_id") % 3 == k), f"{root}/form{k}", "csv", ["subject_id"])
    back = tables.read_subject_tree(spark, root, "*.csv")
    return back.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("gratio").alias("n_gratio"), F.sum("axon_diam").alias("sum_diam"),
        F.sum("axon_area").alias("sum_area"),
    )


def png_bytes(grid: np.ndarray) -> bytes:
    """A gray 8-bit PNG file."""
    h, w = grid.shape
    raw = b"".join(b"\0" + row.tobytes() for row in grid.astype(np.uint8))

    def chunk(tag: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def write_mask_folder(spark, sf, root: str) -> None:
    """Every raster as an image with its masks, a thousand to a folder, which says that a pixel is half a micrometer wide."""
    from segstats.constants import PIXEL_SIZE_FILE, SUFFIXES

    cls = predicted_classes(spark, sf).select("image_id", "y", "x", F.when(F.col("cls") == "axon", 2).otherwise(1).alias("c"))
    cell = F.when(F.col("c").isNotNull(), F.struct("y", "x", "c"))
    rows = images(spark, sf).select("image_id").join(cls, "image_id", "left").groupBy("image_id").agg(
        F.transform(F.collect_list(cell), lambda p: p["y"] * 100 + p["x"] * 10 + p["c"]).alias("cells")
    )

    def write(batches):
        store, base = fs.FileSystem.from_uri(root)
        made = set()
        for batch in batches:
            for image_id, cells in zip(*[c.to_pylist() for c in batch.columns]):
                folder = f"{base}/s{image_id // 1000}"
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    with store.open_output_stream(f"{folder}/{PIXEL_SIZE_FILE}") as out:
                        out.write(b"0.5")
                    made.add(folder)
                grid = np.zeros((8, 8), int)
                for code in cells:
                    grid[code // 100, code // 10 % 10] = code % 10
                masks = {SUFFIXES["axon"]: grid == 2, SUFFIXES["myelin"]: grid == 1, SUFFIXES["axonmyelin"]: grid > 0, ".png": grid > 0}
                for end, mask in masks.items():
                    with store.open_output_stream(f"{folder}/i{image_id}{end}") as out:
                        out.write(png_bytes(mask * 255))
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    rows.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


@query(
    "folder_objects",
    f"{measure_sql('circle')} SELECT {cols('image_id; label; ' + BOX, MEASURES, 'image_border_touching')} FROM o",
)
def folder_objects(spark, sf):
    """PNG masks of the rasters, measured by the plan that starts from a folder."""
    root = scratch_path(spark, "folder")
    root = root if root.startswith("file:") or "://" in root else f"file://{root}"
    write_mask_folder(spark, sf, root)
    number = F.regexp_extract("image_id", "/i([0-9]+)$", 1).cast("bigint")
    return measure_folder(spark, root).objects.withColumn("image_id", number)


@query(
    "stored_nerve_documents",
    f"""WITH RECURSIVE {PX}, {components_sql('n', 'nerve', 1)}, fa AS (SELECT image_id, label - 1 AS fascicle, count(*) * 0.25 AS area FROM n GROUP BY ALL)
SELECT CAST(image_id AS VARCHAR) AS image_id, {cols('count(*):n_fascicles', 'sum(area):total_area; max(area):largest')} FROM fa GROUP BY image_id""",
)
def stored_nerve_documents(spark, sf):
    path = scratch_path(spark, "nerve")
    nerve = rasters(spark, sf).filter("bv > 0").select("image_id", "y", "x")
    areas = fascicle_areas(label_components(nerve, 1, extent=EXTENT), 0.5)
    tables.write_nerve(nerve_document(areas, images(spark, sf)).withColumn("image_id", F.col("image_id").cast("string")), path)
    back = tables.read_nerve(spark, path).filter(F.size("fascicle_areas") > 0)
    values = F.transform(F.map_values("fascicle_areas"), lambda f: f["value"])
    return back.select("image_id", F.size("fascicle_areas").alias("n_fascicles"), F.col("total_area.value").alias("total_area"),
                       F.array_max(values).alias("largest"))


@query(
    "stored_totals",
    f"""WITH {PX} SELECT CAST(i.image_id AS VARCHAR) AS image_id, {cols('', "count(cls) FILTER (cls = 'axon') / 64.0:avf; count(cls) FILTER (cls = 'myelin') / 64.0:mvf")}
FROM images i LEFT JOIN pcls USING (image_id) GROUP BY ALL""",
)
def stored_totals(spark, sf):
    path = scratch_path(spark, "totals")
    fractions = mask_fractions(predicted_classes(spark, sf), images(spark, sf)).select("image_id", "avf", "mvf")
    tables.write_totals(fractions, path)
    return spark.read.schema("image_id string, avf double, mvf double").json(path)


MODELS = {"f0": "p_partkey % 3 > 0", "f1": "p_partkey % 3 > 0", "f2": "p_partkey % 5 > 0", "all": "p_partkey % 3 <> 1"}


@query(
    "model_folds",
    "WITH f AS ("
    + " UNION ALL ".join(f"SELECT '/models/' || p_name || CAST(p_partkey AS VARCHAR) AS dir, '{k}' AS fold FROM part WHERE {rule}" for k, rule in MODELS.items())
    + ") SELECT dir, fold FROM f WHERE fold = 'all' OR dir NOT IN (SELECT dir FROM f WHERE fold = 'all')",
)
def model_folds(spark, sf):
    cases = F.array(*[F.when(F.expr(rule), F.lit(f"/fold_{k}/checkpoint.pth")) for k, rule in MODELS.items()])
    base = table(spark, sf, "part").select(F.expr("'/models/' || p_name || CAST(p_partkey AS STRING)").alias("base"), F.explode(cases).alias("end"))
    return files.model_folds(base.filter("end IS NOT NULL").select(F.concat("base", "end").alias("path")))


@query(
    "stored_raster",
    f"WITH RECURSIVE {PX}, {components_sql('l', 'axon', 2)} SELECT {cols('image_id; y; x; label')} FROM l",
)
def stored_raster(spark, sf):
    path = scratch_path(spark, "labels")
    tables.write_raster(label_components(axon(spark, sf), 2, extent=EXTENT), path, bits=16)
    return as_pixels(spark.read.parquet(path)).select("image_id", "y", "x", "label")
