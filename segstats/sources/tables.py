"""Object tables, image totals, nerve documents and rasters on disk."""

from __future__ import annotations

import csv
import fnmatch
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segstats.constants import AGGREGATE_DIR, DISPLAY_NAMES
from segstats.functions.scalars import file_name, parent_dir
from segstats.schema import NERVE, OBJECT_MEASURES
from segstats.sources.files import in_tasks, list_files, opened

#: Endings of packed files, which are read whole.
PACKED = (".gz", ".bz2", ".lz4", ".zst")


def for_saving(objects: DataFrame) -> DataFrame:
    """Output order and display names with units; unknown columns go last."""
    known = [c for c in DISPLAY_NAMES if c in objects.columns]
    rest = [c for c in objects.columns if c not in DISPLAY_NAMES]
    return objects.select(*[F.col(c).alias(DISPLAY_NAMES[c]) for c in known], *[F.col(c) for c in rest])


def after_loading(table: DataFrame) -> DataFrame:
    """Internal names without units; index columns left over from other tools are dropped."""
    plain = table.withColumnsRenamed({shown: key for key, shown in DISPLAY_NAMES.items()})
    index = [c for c in plain.columns if c == "_c0" or "unnamed" in c.lower()]
    return plain.drop(*index)


def write_objects(objects: DataFrame, path: str, form: str = "csv", partition_by: list[str] | None = None) -> None:
    """Write an object table with display names; missing values are ``NaN`` in CSV."""
    if form not in ("csv", "parquet"):
        raise ValueError("form must be 'csv' or 'parquet'")
    table = for_saving(objects)
    if partition_by:
        # few files per folder, and a large folder is still written by several tasks
        table = table.hint("rebalance", *partition_by)
    writer = table.write.mode("errorifexists")
    if partition_by:
        # tasks move their files themselves; by default the driver moves all of them, one after another
        writer = writer.partitionBy(*partition_by).option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    if form == "csv":
        writer.option("header", "true").option("nullValue", "NaN").csv(path)
    else:
        writer.parquet(path)


def _typed(table: DataFrame) -> DataFrame:
    """Known measures get their fixed type; the text NaN and empty cells become null."""
    types = {f.name: f.dataType for f in OBJECT_MEASURES.fields} | {"label": "bigint"}
    columns = []
    for name in table.columns:
        if name in types and dict(table.dtypes)[name] == "string":
            text = F.when(~F.lower(F.trim(name)).isin("nan", ""), F.trim(name))
            if name == "label" or name.startswith("bbox"):
                columns.append(text.cast("double").cast(types[name]).alias(name))
            else:
                columns.append(text.cast(types[name]).alias(name))
        else:
            columns.append(F.col(f"`{name}`"))
    return table.select(*columns)


#: Bytes of a file that one task reads, and that it holds at a time.
PIECE, BLOCK = 64 << 20, 1 << 20


def _text_lines(path: str, start: int = 0, end: int | None = None) -> Iterator[list[bytes]]:
    """Lists of the lines that begin in ``[start, end)`` of a file; lines end with a line feed, a carriage return or both."""
    store, name = opened(path)
    packed = name.endswith(PACKED)
    with store.open_input_stream(name) if packed else store.open_input_file(name) as source:
        place, held = start, b""
        if start:  # the line that the piece before ends with belongs to that one
            place = start - 1
            source.seek(place)
            while True:
                block = source.read(BLOCK)
                cut = block.find(b"\n")
                if cut >= 0 or not block:
                    break
                place += len(block)
            place, held = place + cut + 1, block[cut + 1:]
            if not block or end is not None and place >= end:
                return
        while True:
            # ``held`` begins at ``place``
            if end is not None and place + len(held) >= end:
                cut = held.find(b"\n", max(end - 1 - place, 0))
                if cut >= 0:
                    yield held[:cut].removesuffix(b"\r").splitlines() if cut else [b""]
                    return
            else:
                cut = held.rfind(b"\n")
                if cut >= 0:
                    yield held[:cut + 1].splitlines()
                    place, held = place + cut + 1, held[cut + 1:]
            block = source.read(BLOCK)
            if not block:
                yield held.splitlines()
                return
            held += block


def _header(path: str) -> str | None:
    """The first line of a file without the white space at its end; an empty file has none."""
    for lines in _text_lines(path):
        if lines:
            return lines[0].removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace").removesuffix("\r").rstrip(" ")
    return None


def _forms(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"_header": pa.array([_header(path) for path in batch.column(0).to_pylist()], pa.string())})


def _rows(batches):
    for batch in batches:
        for path, start, end in zip(*[c.to_pylist() for c in batch.columns]):
            header, first = _header(path), start == 0
            for lines in _text_lines(path, start, end):
                if first and lines:
                    lines[0], first = lines[0].removeprefix(b"\xef\xbb\xbf"), False
                lines = [v for v in lines if v]
                for at in range(0, len(lines), 8192):
                    part = pa.array(lines[at:at + 8192], pa.binary())
                    try:
                        value = part.cast(pa.string())
                    except pa.ArrowInvalid:  # not UTF-8
                        value = pa.array([v.decode("utf-8", "replace") for v in part.to_pylist()], pa.string())
                    yield pa.RecordBatch.from_pydict({
                        "value": value, "_file": pa.repeat(pa.scalar(path, pa.string()), len(part)), "_header": pa.repeat(pa.scalar(header, pa.string()), len(part)),
                    })


def read_csv_by_name(listing: DataFrame) -> tuple[DataFrame, str]:
    """Rows of CSV files ``(path, length)`` whose headers may differ, aligned by column name; what a file lacks is null.

    Also gives the name of the column with the file path. Tasks open the files themselves, large ones in pieces, and give every line
    the header of its file, so that neither files nor lines meet in a join. Only the distinct header lines (the forms of
    tables, not the files) come to the driver, since they decide the columns. A value may be quoted but has no line break.
    """
    heads = in_tasks(listing.select("path")).mapInArrow(_forms, "_header string")
    forms = sorted(r["_header"] for r in heads.distinct().collect() if r["_header"])
    split = {form: [name or f"_c{k}" for k, name in enumerate(next(csv.reader([form])))] for form in forms}
    names = list(dict.fromkeys(name for form in forms for name in split[form]))
    width = max((len(v) for v in split.values()), default=0)
    whole = F.lit(False)
    for end in PACKED:
        whole = whole | F.col("path").endswith(end)
    starts = F.when(whole, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(PIECE).cast("bigint")))
    pieces = listing.select("path", F.explode(starts).alias("start"), whole.alias("_whole")).select(
        "path", "start", F.when(~F.col("_whole"), F.col("start") + PIECE).alias("end")
    )
    cells = F.from_csv("value", F.lit(", ".join(f"_{k} string" for k in range(max(width, 1)))))
    n_bytes = listing.agg(F.sum("length")).first()[0] or 0
    parsed = in_tasks(pieces, n_bytes // PIECE).mapInArrow(_rows, "value string, _file string, _header string").filter("rtrim(value) <> _header").select(
        "_file", "_header", cells.alias("_cells")
    )
    columns = []
    for name in names:
        value = F.lit(None).cast("string")
        for form in forms:
            if name in split[form]:
                value = F.when(F.col("_header") == form, F.col(f"_cells._{split[form].index(name)}")).otherwise(value)
        columns.append(value.alias(name))
    return parsed.select("_file", *columns), "_file"


def read_objects(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    """Read an object table; types come from the fixed schema, never from inference."""
    if form == "csv":
        table, file = read_csv_by_name(list_files(spark, path))
        table = table.drop(file)
    elif form == "parquet":
        table = spark.read.option("mergeSchema", "true").parquet(path)
    else:
        raise ValueError("form must be 'csv' or 'parquet'")
    return _typed(after_loading(table))


def read_subject_tree(spark: SparkSession, root: str, pattern: str = "*_axon_morphometrics.csv") -> DataFrame:
    """Pool the object tables of all subjects by column name; ids are taken from the path.

    Folders are named by the subject, plainly or as Spark writes them (``subject_id=...``).
    """
    listing = list_files(spark, root)
    table, file = read_csv_by_name(listing.filter(F.regexp_like(file_name(F.col("path")), F.lit(fnmatch.translate(pattern)))))
    path = F.col(file)
    table = table.select(
        "*", F.regexp_replace(file_name(parent_dir(path)), "^subject_id=", "").alias("subject_id"),
        F.regexp_replace(file_name(path), r"_axon_morphometrics\.csv$", "").alias("image_id"),
    ).drop(file)
    return _typed(after_loading(table)).filter(F.col("subject_id") != AGGREGATE_DIR)


def write_totals(totals: DataFrame, path: str) -> None:
    """One JSON line of aggregates per image."""
    totals.write.mode("errorifexists").json(path)


def write_nerve(documents: DataFrame, path: str) -> None:
    """One JSON line per image: the image id and its nerve document as JSON text."""
    body = [F.col(c) for c in documents.columns if c != "image_id"]
    documents.select("image_id", F.to_json(F.struct(*body)).alias("document")).write.mode("errorifexists").json(path)


def parse_nerve(texts: DataFrame) -> DataFrame:
    """Nerve documents from ``(image_id, document)`` JSON text."""
    return texts.select("image_id", F.from_json("document", NERVE).alias("d")).select("image_id", "d.*")


def read_nerve(spark: SparkSession, path: str) -> DataFrame:
    return parse_nerve(spark.read.schema("image_id string, document string").json(path))


def write_raster(raster: DataFrame, path: str, bits: int | None = None) -> None:
    """Write pixels, runs or labels clustered by image, so readers prune by ``image_id``.

    With ``bits`` 8 or 16 pixel values keep only their low bits. Labels are never cut: one
    that does not fit is an error.
    """
    out = raster
    if bits is not None and "v" in raster.columns:
        out = raster.withColumn("v", F.col("v").bitwiseAND(2**bits - 1).cast("smallint" if bits == 8 else "int"))
    elif bits is not None:
        error = F.raise_error(F.lit(f"a label does not fit {bits} bits")).cast("bigint")
        out = raster.withColumn("label", F.when(F.col("label") >= 2**bits, error).otherwise(F.col("label")))
    order = [c for c in ("image_id", "y", "x", "x0") if c in out.columns]
    out.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").parquet(path)
