"""One row per labelled object: area, moments, ellipse, box, perimeter, solidity.

Sums over runs have closed forms, so a region table is a single aggregation of runs
with partial sums on the map side: an object that holds a third of all pixels costs
no more than any other.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.operators.grouped import changes, ints, stream_groups
from segstats.operators.runs import TILE, TILE_KEY, as_runs, cut_to_tiles

OBJECT = ["image_id", "label"]


# 0^2 + 1^2 + ... + k^2, and the sum of x^2 over a run (term by term where it could overflow)
_SQUARES = "(cast({0} as bigint) * ({0} + 1L) * (2L * {0} + 1L)) div 6"
_SUM_XX = f"""CASE WHEN x1 < 1000000 THEN {_SQUARES.format("x1")} - {_SQUARES.format("(x0 - 1)")}
ELSE aggregate(sequence(x0, x1), 0L, (a, x) -> a + cast(x as bigint) * x) END"""


def region_sums(labels: DataFrame) -> DataFrame:
    """Integer sums and bounding box of every object (box maxima exclusive)."""
    runs = as_runs(labels).selectExpr(
        *OBJECT, "y", "x0", "x1", "x1 - x0 + 1L AS n", "cast(y as bigint) AS ly",
        "((cast(x0 as bigint) + x1) * (x1 - x0 + 1)) div 2 AS sx", f"{_SUM_XX} AS sxx",
    )
    return runs.groupBy(*OBJECT).agg(
        *map(
            F.expr,
            [
                "sum(n) AS area", "sum(n * ly) AS sum_y", "sum(sx) AS sum_x", "sum(n * ly * ly) AS sum_yy",
                "sum(sxx) AS sum_xx", "sum(ly * sx) AS sum_xy", "min(y) AS bbox_min_y", "min(x0) AS bbox_min_x",
                "max(y) + 1 AS bbox_max_y", "max(x1) + 1 AS bbox_max_x",
            ],
        )
    )


def _central(a: str, b: str, product: str) -> str:
    """Central second moment times area squared, exact in integers."""
    def big(c: str) -> str:
        return f"cast({c} as decimal(19,0))"

    return f"{big('area')} * {big(product)} - {big(a)} * {big(b)}"


def ellipse(sums: DataFrame) -> DataFrame:
    """Centroid, equivalent diameter and the second-moment ellipse."""
    exact = sums.selectExpr(
        "*", _central("sum_x", "sum_x", "sum_xx") + " AS _xx", _central("sum_y", "sum_y", "sum_yy") + " AS _yy",
        _central("sum_x", "sum_y", "sum_xy") + " AS _xy",
    )
    moments = exact.selectExpr(
        "*", *[f"cast({c} as double) / (cast(area as double) * area) AS {m}" for c, m in (("_xx", "_a"), ("_yy", "_c"), ("_xy", "_b"))]
    )
    axes = moments.selectExpr(
        "*",
        "greatest((_a + _c) / 2 + sqrt(4.0D * _b * _b + (_a - _c) * (_a - _c)) / 2, 0.0D) AS _l1",
        "greatest((_a + _c) / 2 - sqrt(4.0D * _b * _b + (_a - _c) * (_a - _c)) / 2, 0.0D) AS _l2",
    )
    return axes.selectExpr(
        *sums.columns,
        "sum_y / area AS y0",
        "sum_x / area AS x0",
        "sqrt(4.0D * area / pi()) AS equivalent_diameter",
        "4.0D * sqrt(_l1) AS major_axis",
        "4.0D * sqrt(_l2) AS minor_axis",
        "CASE WHEN _l1 = 0 THEN 0.0D ELSE sqrt(1.0D - try_divide(_l2, _l1)) END AS eccentricity",
        # equal spread along both axes: +-45 degrees by the sign of the covariance
        "CASE WHEN _xx = _yy THEN CASE WHEN _xy > 0 THEN pi() / 4 ELSE -pi() / 4 END "
        "ELSE 0.5D * atan2(2.0D * _b, _c - _a) END AS orientation",
    )


def centroid_pixels(regions: DataFrame) -> DataFrame:
    """Centroids truncated to the pixel that holds them: ``(image_id, label, y, x)``."""
    return regions.select(
        *OBJECT,
        F.expr("cast(sum_y div area as int)").alias("y"),
        F.expr("cast(sum_x div area as int)").alias("x"),
    )


# Perimeter weight by the border pattern code of a pixel, where a border
# pixel counts 1, each bordering side neighbour 2 and each bordering diagonal one 10.
STRAIGHT_CODES = [5, 7, 15, 17, 25, 27]
DIAGONAL_CODES = [21, 33]
MIXED_CODES = [13, 23]


def expand(table: pa.Table, tile: int, pad: int):
    """Pixels of tile runs: ``(run, y, x, code)`` with growing, padded pixel codes."""
    x0, x1 = ints(table, "x0"), ints(table, "x1")
    length = x1 - x0 + 1
    run = np.repeat(np.arange(table.num_rows), length)
    x = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + x0[run]
    y = ints(table, "y")[run]
    group = (np.cumsum(changes(table, TILE_KEY)) - 1)[run]
    side = tile + 2 * pad
    row = y - ints(table, "ty")[run] * tile + pad
    column = x - ints(table, "tx")[run] * tile + pad
    return run, y, x, (group * side + row) * side + column, side


def find(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each wanted code in the sorted ``codes``, or -1."""
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return np.where(codes[at] == wanted, at, -1)


def _border_codes(table: pa.Table, tile: int) -> pa.Table:
    run, y, x, code, side = expand(table, tile, pad=4)
    label = ints(table, "label")[run]

    def same(step: int, flag: np.ndarray | None = None) -> np.ndarray:
        at = find(code, code + step)
        hit = (at >= 0) & (label[at] == label)
        return hit if flag is None else hit & flag[at]

    sides, diagonals = (-side, -1, 1, side), (-side - 1, -side + 1, side - 1, side + 1)
    border = ~np.logical_and.reduce([same(s) for s in sides])
    pattern = border + 2 * sum(same(s, border) for s in sides) + 10 * sum(same(s, border) for s in diagonals)
    home = (y // tile == ints(table, "ty")[run]) & (x // tile == ints(table, "tx")[run]) & border
    classes = [np.isin(pattern, codes) for codes in (STRAIGHT_CODES, DIAGONAL_CODES, MIXED_CODES)]
    kept = np.flatnonzero(home)
    pixel = pa.table(
        {
            "image_id": table["image_id"].take(pa.array(run[kept])),
            "label": pa.array(label[kept]),
            **{name: pa.array(flag[kept].astype(np.int64)) for name, flag in zip(("n1", "n2", "n3"), classes)},
        }
    )
    total = pixel.group_by(OBJECT).aggregate([("n1", "sum"), ("n2", "sum"), ("n3", "sum")])
    return total.select(["image_id", "label", "n1_sum", "n2_sum", "n3_sum"]).rename_columns(
        ["image_id", "label", "n1", "n2", "n3"]
    )


def perimeters(labels: DataFrame, tile: int = TILE) -> DataFrame:
    """Object perimeters from border pixel patterns: ``(image_id, label, perimeter)``.

    Tiles overlap by two pixels, so each border pixel sees its neighbours' borders, and
    only counts leave the task.
    """
    runs = cut_to_tiles(as_runs(labels).select("image_id", "y", "x0", "x1", "label"), tile, halo=2)
    kind = labels.schema["image_id"].dataType.simpleString()
    counts = stream_groups(
        runs, TILE_KEY, ["y", "x0"], partial(_border_codes, tile=tile),
        f"image_id {kind}, label bigint, n1 bigint, n2 bigint, n3 bigint",
    )
    root2 = float(np.sqrt(2))
    return counts.groupBy(*OBJECT).agg(
        (F.sum("n1") + F.sum("n2") * F.lit(root2) + F.sum("n3") * F.lit((1 + root2) / 2)).alias("perimeter")
    )


def _chain(group: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows on the convex lower envelope of x over y, for all groups at once."""
    kept = np.arange(len(y))
    while True:
        a, b, c = kept[:-2], kept[1:-1], kept[2:]
        inner = (group[a] == group[c]) & (
            (x[b] - x[a]) * (y[c] - y[a]) >= (x[c] - x[a]) * (y[b] - y[a])
        )
        if not inner.any():
            return kept
        kept = np.delete(kept, np.flatnonzero(inner) + 1)


def _hull_side(group, y, x, sign):
    """Hull bound of each row (doubled coordinates) as a fraction ``num / den``."""
    # a row's outer end contributes its side midpoint and its two corner-edge midpoints
    gy = np.repeat(group, 3)
    py = (2 * y[:, None] + np.array([-1, 0, 1])).ravel()
    px = (sign * 2 * x[:, None] - np.array([0, 1, 0])).ravel()
    order = np.lexsort((px, py, gy))
    gy, py, px = gy[order], py[order], px[order]
    low = np.flatnonzero(np.append(True, (gy[1:] != gy[:-1]) | (py[1:] != py[:-1])))
    gy, py, px = gy[low], py[low], px[low]
    kept = _chain(gy, py, px)
    gy, py, px = gy[kept], py[kept], px[kept]
    span = int(py.max() - py.min()) + 2
    base = int(py.min())
    at = np.searchsorted(gy * span + py - base, group * span + 2 * y - base, "right") - 1
    den = py[at + 1] - py[at]
    return px[at] * den + (px[at + 1] - px[at]) * (2 * y - py[at]), den


def _hull_rows(table: pa.Table) -> pa.Table:
    start = np.flatnonzero(changes(table, OBJECT))
    group = np.cumsum(changes(table, OBJECT)) - 1
    y = ints(table, "y")
    left, left_den = _hull_side(group, y, ints(table, "x0"), 1)
    right, right_den = _hull_side(group, y, ints(table, "x1"), -1)
    # whole pixels between the two bounds: ceil(left / 2) .. floor(right / 2)
    count = (-right) // (2 * right_den) + (-left) // (2 * left_den) + 1
    return pa.table(
        {
            "image_id": table["image_id"].take(pa.array(start)),
            "label": table["label"].take(pa.array(start)),
            "hull_area": pa.array(np.add.reduceat(count, start)),
        }
    )


def hull_areas(labels: DataFrame) -> DataFrame:
    """Pixels inside each object's convex hull: ``(image_id, label, hull_area)``.

    Only the two ends of each object row are shuffled; a group is one object's rows, so
    it is bounded by the image height.
    """
    ends = as_runs(labels).groupBy(*OBJECT, "y").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    kind = labels.schema["image_id"].dataType.simpleString()
    return stream_groups(ends, OBJECT, ["y"], _hull_rows, f"image_id {kind}, label bigint, hull_area bigint")


def measure_regions(labels: DataFrame, shape: bool = True, tile: int = TILE) -> DataFrame:
    """Full region table; ``shape`` adds perimeter and solidity."""
    regions = ellipse(region_sums(labels))
    if not shape:
        return regions
    return (
        regions.join(perimeters(labels, tile), OBJECT)
        .join(hull_areas(labels), OBJECT)
        .withColumn("solidity", F.col("area") / F.col("hull_area"))
    )
