"""Small helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For bytes.translate: A-Z to a-z, every other byte (also those inside UTF-8 sequences) as it is.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Lower-cases and turns every ASCII character that is no word character into a space.
WORD_BYTES = bytes(
    (b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns that an operator needs, so that no other name can clash; a null text is empty."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more
    )


def as_bytes(docs: DataFrame, *more: str) -> DataFrame:
    """Texts as UTF-8, which tasks search without decoding them."""
    return docs.select("doc_id", F.encode("text", "UTF-8").alias("text"), *more)


#: Texts and bytes of a batch that goes to Python, where the session has Spark's own defaults.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b")}


def bounded_batches(df: DataFrame) -> DataFrame:
    """Texts are long rows: smaller Arrow batches than the default keep tasks small. A session's own choice stays."""
    conf = df.sparkSession.conf
    for key, (default, smaller) in BATCH.items():
        if conf.get(key, default) == default:
            conf.set(key, smaller)
    return df


def map_rows(
    df: DataFrame, schema: str, rows: Callable[[Iterable[tuple]], Iterator[tuple]], per_batch: int = 4096
) -> DataFrame:
    """``rows`` maps an iterator of row tuples to one of result tuples, once per task."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
        buffer: list[tuple] = []
        for row in rows(source):
            buffer.append(row)
            if len(buffer) >= per_batch:
                yield _batch(buffer, out)
                buffer = []
        if buffer:
            yield _batch(buffer, out)

    return bounded_batches(df).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


#: Rows of keys (some 40 bytes each) that may be broadcast.
BROADCAST_ROWS = 1_000_000


def small(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``keys`` for a join with texts: broadcast if counted to be few, else left to Spark's own choice."""
    return F.broadcast(keys) if keys.count() <= rows else keys


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def merge_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open intervals, sorted; touching ones join."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(s, e) for s, e in out]
