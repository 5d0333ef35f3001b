"""File discovery: images, masks, their roles, headers and pixel sizes.

Every function below ``list_files`` takes a table with a ``path`` column, so it works on
a folder listing of any size without opening a file.
"""

from __future__ import annotations

import fnmatch
import re

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segstats.constants import AGGREGATE_DIR, LARGE_PIXEL_LIMIT, PIXEL_LIMIT, PIXEL_SIZE_FILE, SLOW_PIXELS, SUFFIXES, VALID_EXTENSIONS
from segstats.functions.scalars import file_name, is_generated, parent_dir, stem
from segstats.session import materialize
from segstats.sources.headers import SCHEMA, plain_png, png_pixels, shape_of, shapes

MASK_ROLES = ["axonmyelin", "axon", "myelin", "uaxon", "nerve"]
# Masks each mode needs, and the one that marks an image as ready.
REQUIRED_MASKS = {
    "myelinated": ["axon", "myelin"],
    "unmyelinated": ["uaxon"],
    "nerve": ["nerve", "axon", "myelin"],
}
TARGET_MASK = {"myelinated": "axonmyelin", "unmyelinated": "uaxon", "nerve": "nerve"}


#: Folders one task lists, files one task opens, files of unusual forms that one job decodes.
FOLDERS_PER_TASK, FILES_PER_TASK, FILES_PER_JOB = 16, 4096, 10_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and its name there; listings write file:/a/b, URIs have file:///a/b."""
    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def _entries(batches):
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, name = opened(path)
            name = name.rstrip("/") or "/"
            local = isinstance(store, fs.LocalFileSystem)
            front = "file:" if local else path.rstrip("/").removesuffix(name)
            alone = store.get_file_info(name)
            if alone.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            found = [alone] if alone.is_file else store.get_file_info(fs.FileSelector(name))
            for at in range(0, len(found), 4096):
                part = [e for e in found[at:at + 4096] if not e.base_name.startswith(("_", "."))]
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([front + e.path for e in part], pa.string()),
                    "length": pa.array([e.size if e.is_file else None for e in part], pa.int64()),
                })


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length)`` of all files under a folder; contents are not read.

    Tasks list the folders, one level after another, so that no listing passes through the driver; the folder must be one that
    ``pyarrow.fs`` knows (file, hdfs, s3, gs). Empty files and names that begin with ``_`` or ``.`` are left out.
    """
    if any(c in root for c in "*?[{"):
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    folders, levels = spark.createDataFrame([(root,)], "path string"), []
    count = 1
    while count:
        dealt = folders.repartition(-(-count // FOLDERS_PER_TASK), "path")
        found = materialize(dealt.mapInArrow(_entries, "path string, length bigint"), "listing")
        levels.append(found.filter("length > 0"))
        folders = found.filter("length IS NULL").select("path")
        count = folders.count()
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def in_tasks(paths: DataFrame, more: int = 0) -> DataFrame:
    """Files or pieces of them dealt to tasks by number, and to ``more`` tasks if they are large."""
    return paths.repartition(paths.count() // FILES_PER_TASK + paths.sparkSession.sparkContext.defaultParallelism + more, *paths.columns)


def list_images(files: DataFrame) -> DataFrame:
    """Readable images that are not outputs of an earlier run."""
    name = file_name(F.col("path"))
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return files.filter(extension.isin(VALID_EXTENSIONS) & ~is_generated(name))


def mask_files(files: DataFrame) -> DataFrame:
    """``(path, dir, stem, role)`` of mask files, told apart by their suffix."""
    name = file_name(F.col("path"))
    role = F.coalesce(*[F.when(name.endswith(SUFFIXES[r]), F.lit(r)) for r in MASK_ROLES])
    base = F.regexp_replace(name, r"_seg-[a-z]+\.png$", "")
    return files.select("path", parent_dir(F.col("path")).alias("dir"), base.alias("stem"), role.alias("role")).filter(
        "role IS NOT NULL"
    )


def source_images(files: DataFrame) -> DataFrame:
    """``(path, dir, stem)`` of image files that are not masks."""
    name = file_name(F.col("path"))
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    role = F.lit(False)
    for r in MASK_ROLES:
        role = role | name.endswith(SUFFIXES[r])
    readable = extension.isin(".jpeg", ".jpg", ".tif", ".tiff", ".png")
    return files.filter(readable & ~role).select("path", parent_dir(F.col("path")).alias("dir"), stem(name).alias("stem"))


def ready_images(files: DataFrame, mode: str = "myelinated") -> DataFrame:
    """Images that have the mask their mode starts from."""
    ready = mask_files(files).filter(F.col("role") == TARGET_MASK[mode]).select("dir", "stem")
    return source_images(files).join(ready, ["dir", "stem"], "left_semi")


def missing_masks(files: DataFrame, mode: str = "myelinated") -> DataFrame:
    """``(dir, stem, role)`` of masks a ready image lacks; empty when a batch can run.

    One pass over the files and one grouping: a path is a mask or a source image, never both.
    """
    name = file_name(F.col("path"))
    role = F.coalesce(*[F.when(name.endswith(SUFFIXES[r]), F.lit(r)) for r in MASK_ROLES])
    readable = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).isin(".jpeg", ".jpg", ".tif", ".tiff", ".png")
    each = files.select(parent_dir(F.col("path")).alias("dir"), name.alias("_name"), role.alias("role"), readable.alias("_readable"))
    base = F.when(F.col("role").isNotNull(), F.regexp_replace("_name", r"_seg-[a-z]+\.png$", "")).otherwise(stem(F.col("_name")))
    found = each.filter("role IS NOT NULL OR _readable").select("dir", base.alias("stem"), "role").groupBy("dir", "stem").agg(
        F.count_if(F.col("role").isNull()).alias("_images"), F.collect_set("role").alias("_roles")
    )
    ready = found.filter(F.array_contains("_roles", TARGET_MASK[mode]) & (F.col("_images") > 0))
    needed = F.array(*[F.lit(r) for r in REQUIRED_MASKS[mode]])
    lacking = ready.select("dir", "stem", "_images", F.explode(F.array_except(needed, "_roles")).alias("role"))
    # a row for each source image of that name
    return lacking.select("dir", "stem", "role", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_images"))).alias("_k")).drop("_k")


def require_masks(files: DataFrame, mode: str = "myelinated") -> DataFrame:
    """``(dir, stem, role, path)`` of the masks a mode needs; an absent one is an error."""
    needed = ready_images(files, mode).select(
        "dir", "stem", F.explode(F.array(*[F.lit(r) for r in REQUIRED_MASKS[mode]])).alias("role")
    )
    error = F.raise_error(F.concat(F.lit("missing mask "), "role", F.lit(" for "), "dir", F.lit("/"), "stem"))
    return needed.join(mask_files(files), ["dir", "stem", "role"], "left").withColumn(
        "path", F.coalesce("path", error.cast("string"))
    )


def _number(content: Column, first: int, length: int) -> Column:
    return F.conv(F.hex(F.substring(content, first, length)), 16, 10).cast("int")


def png_header(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``width, height, bit_depth, channels`` from the header bytes of PNG files."""
    c = F.col(content)
    kind = _number(c, 26, 1)
    channels = F.when(kind == 0, 1).when(kind == 4, 2).when(kind.isin(2, 3), 3).when(kind == 6, 4)
    png = F.hex(F.substring(c, 1, 8)) == "89504E470D0A1A0A"
    return df.withColumns(
        {
            "width": F.when(png, _number(c, 17, 4)),
            "height": F.when(png, _number(c, 21, 4)),
            "bit_depth": F.when(png, _number(c, 25, 1)),
            "channels": F.when(png, channels),
        }
    )


def image_headers(files: DataFrame) -> DataFrame:
    """``files`` with ``kind, width, height, bit_depth, channels`` in place of ``content``, of any known format.

    For files whose bytes are in the table; ``read_headers`` reads those in a folder.
    """
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != "content")

    def heads(batches):
        for batch in batches:
            yield shapes(batch, [shape_of(lambda at, n, c=c: (c or b"")[at:at + n]) for c in batch.column("content").to_pylist()])

    return files.mapInArrow(heads, f"{kept}, {SCHEMA}")


def read_headers(spark: SparkSession, root: str, listing: DataFrame | None = None) -> DataFrame:
    """Shapes of the image files under a folder; only header bytes of each file are read, in a few ranges.

    Tasks open the files themselves, so the folder must be one that ``pyarrow.fs`` knows (file, hdfs, s3, gs). Files that are no images
    whatever their name have nulls. ``listing`` is that of ``list_files`` if it is there already.
    """
    ends = "|".join(sorted({e.rsplit(".", 1)[1] for e in VALID_EXTENSIONS}))
    listing = list_files(spark, root) if listing is None else listing
    paths = in_tasks(listing.select("path").filter(F.regexp_like("path", F.lit(rf"\.({ends})$"))))

    def heads(batches):
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                store, name = opened(path)
                with store.open_input_file(name) as source:
                    found.append(shape_of(lambda at, n, source=source: source.read_at(n, at)))
            yield shapes(batch, found)

    return paths.mapInArrow(heads, f"path string, {SCHEMA}")


def size_guard(headers: DataFrame, allow_large: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` images by pixel count; ``slow`` marks large accepted ones."""
    limit = LARGE_PIXEL_LIMIT if allow_large else PIXEL_LIMIT
    sized = headers.withColumn("n_pixels", F.col("height").cast("bigint") * F.col("width")).withColumn(
        "slow", F.col("n_pixels") > SLOW_PIXELS
    )
    return sized.filter(F.col("n_pixels") <= limit), sized.filter(F.col("n_pixels") > limit)


def check_inputs(headers: DataFrame, file_format: str, n_channels: int) -> DataFrame:
    """Add the conversions an input needs, and the path it will then have.

    Only a one-channel model allows conversion; other mismatches are errors.
    """
    shape_ok = F.col("channels") == n_channels
    format_ok = F.regexp_extract("path", r"(\.[^./]*)$", 1) == file_format
    out = headers.withColumns({"to_gray": ~shape_ok, "to_format": ~format_ok})
    if n_channels != 1:
        bad = F.raise_error(F.concat(F.col("path"), F.lit(f": expected {n_channels} channels in {file_format}")))
        return out.withColumn("target", F.when(shape_ok & format_ok, F.col("path")).otherwise(bad.cast("string")))
    base = F.regexp_replace("path", r"\.[^./]*$", "")
    return out.withColumn(
        "target",
        F.when(F.col("to_gray"), F.concat(base, F.lit("_grayscale" + file_format)))
        .when(F.col("to_format"), F.concat(base, F.lit(file_format)))
        .otherwise(F.col("path")),
    )


def model_formats(spark: SparkSession, root: str) -> DataFrame:
    """``(dir, file_format, n_channels, classes)`` from the ``dataset.json`` of model folders."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "dataset.json")
    texts = reader.text(root, wholetext=True).select(parent_dir(F.col("_metadata.file_path")).alias("dir"), "value")
    card = F.from_json("value", "file_ending string, channel_names map<string,string>, labels map<string,int>")
    return texts.select("dir", card.alias("c")).select(
        "dir", F.col("c.file_ending").alias("file_format"), F.size("c.channel_names").alias("n_channels"),
        F.map_filter("c.labels", lambda name, _: name != "background").alias("classes"),
    )


def model_folds(files: DataFrame) -> DataFrame:
    """``(dir, fold)`` of model folders: the single fold ``all`` where there is one, else every fold."""
    folds = files.select(
        F.regexp_extract("path", r"^(.*)/fold_[^/]*/[^/]*$", 1).alias("dir"),
        F.regexp_extract("path", r"/fold_([^/]*)/[^/]*$", 1).alias("fold"),
    ).filter("fold <> ''").distinct()
    light = folds.filter("fold = 'all'").select("dir")
    return folds.filter("fold = 'all'").unionByName(folds.join(light, "dir", "left_anti"))


def parse_pixel_sizes(texts: DataFrame) -> DataFrame:
    """``(dir, um_per_px)`` from ``(path, value)`` sidecar texts; other text is an error."""
    number = F.trim(F.regexp_replace("value", r"\s+", " "))
    error = F.raise_error(F.concat(F.lit("invalid pixel size in "), "path")).cast("double")
    return texts.filter(file_name(F.col("path")) == PIXEL_SIZE_FILE).select(
        parent_dir(F.col("path")).alias("dir"), F.coalesce(number.try_cast("double"), error).alias("um_per_px")
    )


def read_pixel_sizes(spark: SparkSession, root: str, listing: DataFrame | None = None) -> DataFrame:
    listing = list_files(spark, root) if listing is None else listing
    paths = in_tasks(listing.select("path").filter(file_name(F.col("path")) == PIXEL_SIZE_FILE))

    def texts(batches):
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                store, name = opened(path)
                with store.open_input_file(name) as source:
                    found.append(source.read().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_pydict({"path": batch.column(0), "value": pa.array(found, pa.string())})

    return parse_pixel_sizes(paths.mapInArrow(texts, "path string, value string"))


def with_pixel_size(images: DataFrame, sizes: DataFrame | None = None, given: float | None = None) -> DataFrame:
    """Add ``um_per_px``: the argument wins, then the folder's sidecar, else an error."""
    if given is not None:
        return images.withColumn("um_per_px", F.lit(float(given)))
    if sizes is None:
        raise ValueError("pass pixel sizes or a value")
    error = F.raise_error(F.concat(F.lit("no pixel size for "), "dir")).cast("double")
    return images.join(sizes, "dir", "left").withColumn("um_per_px", F.coalesce("um_per_px", error))


def to_eight_bits(gray: np.ndarray) -> np.ndarray:
    """Float gray levels of a whole image in 8 bits, as ``float_to_bits`` does it."""
    low, high = gray.min(), gray.max()
    if low >= 0 and high <= 1:
        scaled = gray
    elif low == high:
        return np.clip(np.floor(gray), 0, 255)
    else:
        scaled = (gray - low) / (high - low)
    return np.floor(scaled * 255 + 0.499999999)


PIXELS = "path string, height int, width int, y int, x int, v int"


def _bands(path: str, data: np.ndarray):
    """Pixel rows of an image whose channels are ``(blue, green, red)`` or whose first one is gray, a band at a time."""
    h, w, c = data.shape
    if c < 3:
        image = data[..., 0].astype(np.float64)
    else:
        image = to_eight_bits(data[..., :3] @ np.array([0.114, 0.587, 0.299]))
    band = max(1, 262_144 // w)
    for top in range(0, h, band):
        gray = image[top : top + band]
        y, x = np.indices(gray.shape)
        n = gray.size
        yield pa.RecordBatch.from_pydict(
            {
                "path": pa.array([path] * n),
                "height": pa.array(np.full(n, h, np.int32)),
                "width": pa.array(np.full(n, w, np.int32)),
                "y": pa.array((y.ravel() + top).astype(np.int32)),
                "x": pa.array(x.ravel().astype(np.int32)),
                "v": pa.array(gray.astype(np.int32).ravel()),
            }
        )


def read_pixels(spark: SparkSession, root: str, glob: str = "*.png", listing: DataFrame | None = None) -> DataFrame:
    """Gray pixels ``(path, height, width, y, x, v)`` of the images under a folder, ``v`` in 8 bits.

    Gray images keep their levels; the weighted sum of a colour image is stretched to 8 bits like any float image. Tasks open the
    files themselves and decode PNG of 8 bits a channel without a palette. All other files go through the built-in image source,
    ``FILES_PER_JOB`` at a time, since that lists them in the driver; it keeps the low byte only of deeper channels, so a PNG of
    more than 8 bits is an error.
    """
    listing = list_files(spark, root) if listing is None else listing
    paths = in_tasks(listing.select("path").filter(F.regexp_like(file_name(F.col("path")), F.lit(fnmatch.translate(glob)))))

    def forms(batches):
        for batch in batches:
            plain, depth = [], []
            for path in batch.column(0).to_pylist():
                store, name = opened(path)
                with store.open_input_file(name) as source:
                    at = lambda start, n, source=source: source.read_at(n, start)
                    plain.append(plain_png(at))
                    depth.append(None if plain[-1] else shape_of(at).bit_depth)
            yield pa.RecordBatch.from_pydict({"path": batch.column(0), "plain": pa.array(plain), "bit_depth": pa.array(depth, pa.int32())})

    def decode_files(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = opened(path)
                with store.open_input_file(name) as source:
                    yield from _bands(path, png_pixels(source.read()))

    def decode_rows(batches):
        for batch in batches:
            # one image at a time; a batch only refers to the bytes of its images
            for k in range(batch.num_rows):
                path, h, w, c = (batch.column(i)[k].as_py() for i in range(4))
                yield from _bands(path, np.frombuffer(batch.column(4)[k].as_buffer(), np.uint8).reshape(h, w, c))

    found = materialize(paths.mapInArrow(forms, "path string, plain boolean, bit_depth int"), "forms")
    out = in_tasks(found.filter("plain").select("path")).mapInArrow(decode_files, PIXELS)
    some = []

    def decoded() -> DataFrame:
        bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
        origin = F.url_decode(F.replace("image.origin", F.lit("+"), F.lit("%2B"))).alias("origin")  # the source writes URIs
        rows = spark.read.format("image").load(some).select(origin, "image.height", "image.width", "image.nChannels", "image.data")
        deep = found.filter("bit_depth > 8").select(bare("path").alias("_path"), "bit_depth")
        error = F.raise_error(F.concat(F.lit("more than 8 bits per channel: "), "origin"))
        checked = rows.join(deep, bare("origin") == F.col("_path"), "left").select(
            F.when(F.col("bit_depth") > 8, error.cast("string")).otherwise(F.col("origin")).alias("origin"),
            "height", "width", "nChannels", "data",
        )
        return materialize(checked.mapInArrow(decode_rows, PIXELS), "decoded")

    for row in found.filter("NOT plain").select("path").toLocalIterator():
        some.append(row["path"])
        if len(some) == FILES_PER_JOB:
            out, some = out.unionByName(decoded()), []
    return out.unionByName(decoded()) if some else out


def subject_files(files: DataFrame) -> DataFrame:
    """``(subject_id, stem, kind)`` of object tables and semantic masks in a subject tree."""
    name, folder = file_name(F.col("path")), parent_dir(F.col("path"))
    kind = F.when(F.regexp_like(name, F.lit(r"_axon_morphometrics\.(csv|xlsx|parquet)$")), "objects").when(
        name.endswith(SUFFIXES["axonmyelin"]), "mask"
    )
    base = F.regexp_replace(name, r"(_axon_morphometrics\.[a-z]+|_seg-axonmyelin\.png)$", "")
    return files.select(file_name(folder).alias("subject_id"), base.alias("stem"), kind.alias("kind")).filter(
        (F.col("kind").isNotNull()) & (F.col("subject_id") != AGGREGATE_DIR)
    )


def completeness(files: DataFrame) -> DataFrame:
    """Per subject: counts of object tables and masks, masks without a table, and the verdict."""
    pairs = subject_files(files).groupBy("subject_id", "stem").agg(
        F.count_if(F.col("kind") == "objects").alias("objects"), F.count_if(F.col("kind") == "mask").alias("masks")
    )
    out = pairs.groupBy("subject_id").agg(
        F.sum("objects").alias("n_objects"), F.sum("masks").alias("n_masks"),
        F.count_if((F.col("masks") > 0) & (F.col("objects") == 0)).alias("n_missing"),
    )
    ok = (F.col("n_objects") == F.col("n_masks")) & (F.col("n_objects") > 0) & (F.col("n_missing") == 0)
    return out.withColumn("complete", ok)
