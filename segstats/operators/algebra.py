"""Set algebra of masks on runs: one sweep over sorted run ends.

All masks of an image row meet by ``(image_id, y, tx)``; their run ends, sorted by x, cut the row into segments that lie wholly
inside or outside each mask. Running counts say which. And, or, minus, xor, priorities and overlap lengths of any number of
masks are filters or sums over these segments: one shuffle of runs, no row per pixel. A mask given as pixels takes part as runs of
length one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segstats.operators.runs import TILE, as_pixels, as_runs, cut_to_tiles

ROW = ["image_id", "y"]


def others(mask: DataFrame, by: list[str] | None = None) -> list[str]:
    """Columns of a mask beside its place."""
    return [c for c in mask.columns if c not in ("image_id", "y", "x", "x0", "x1", *(by or []))]


def sweep(masks: dict[str, DataFrame], by: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """Segments ``(image_id, y, *by, x0, x1)`` with a flag per mask, for all places that are in any.

    ``by`` are key columns that all masks have. Further columns of a mask ``m`` come along as the struct ``m_row``, null outside of it;
    runs of such a mask must not overlap (of those that do, one is taken). Segments end at tile borders, so that no row of an
    image is one group.
    """
    by = by or []
    key = [*ROW, "tx", *by]

    def ends(name: str, mask: DataFrame) -> DataFrame:
        more = others(mask, by)
        runs = cut_to_tiles(as_runs(mask).select(*ROW, "x0", "x1", *by, *more), tile)
        own = F.struct(*more) if more else None

        def side(start: int) -> Column:
            fields = [(F.col("x0") if start else F.col("x1") + 1).alias("x"), F.lit(start).alias("start")]
            for n, m in masks.items():
                fields.append(F.lit((2 * start - 1) if n == name else 0).alias(f"{n}_d"))
                if others(m, by):
                    fields.append((own if n == name and start else F.lit(None).cast(kinds[n])).alias(f"{n}_row"))
            return F.struct(*fields)

        return runs.select(*key, F.explode(F.array(side(1), side(0))).alias("e")).select(*key, "e.*")

    kinds = {n: m.select(F.struct(*others(m, by)).alias("s")).schema["s"].dataType for n, m in masks.items() if others(m, by)}
    events = reduce(DataFrame.unionByName, (ends(n, m) for n, m in masks.items()))
    order = Window.partitionBy(*key).orderBy("x", "start")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = [(F.sum(f"{n}_d").over(so_far) > 0).alias(n) for n in masks]
    rows = [F.last(f"{n}_row", ignorenulls=True).over(so_far).alias(f"{n}_row") for n in kinds]
    cut = events.select(*key, F.col("x").alias("x0"), (F.lead("x").over(order) - 1).alias("x1"), *counts, *rows)
    inside = cut.filter("x0 <= x1").filter(" OR ".join(masks))
    return inside.select(*ROW, *by, "x0", "x1", *masks, *[F.when(F.col(n), F.col(f"{n}_row")).alias(f"{n}_row") for n in kinds])


def n_pixels(condition: Column | None = None) -> Column:
    """Pixels in segments, all or those where a condition holds, as an aggregate."""
    length = (F.col("x1") - F.col("x0") + 1).cast("bigint")
    return F.coalesce(F.sum(length if condition is None else F.when(condition, length)), F.lit(0))


def part(segments: DataFrame, condition: str, like: DataFrame, row_of: str | None = None) -> DataFrame:
    """The segments where a condition holds, as pixels or runs as ``like`` is, with the other columns of one mask."""
    chosen = segments.filter(condition)
    out = chosen.select(*ROW, "x0", "x1", *([f"{row_of}_row.*"] if row_of and f"{row_of}_row" in segments.columns else []))
    return out if "x0" in like.columns else as_pixels(out).select(*like.columns if row_of else (*ROW, "x"))


def overlap_lengths(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(image_id, label, true_label, common)``: pixels that labelled runs of ``a`` and ``b`` share."""
    met = sweep({"a": a.select(*ROW, *places(a), "label"), "b": b.select(*ROW, *places(b), "label")}).filter("a AND b")
    return met.groupBy("image_id", F.col("a_row.label").alias("label"), F.col("b_row.label").alias("true_label")).agg(n_pixels().alias("common"))


def places(mask: DataFrame) -> list[str]:
    return ["x0", "x1"] if "x0" in mask.columns else ["x"]
