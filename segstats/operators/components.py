"""Connected components of masks of any size.

1. Masks are cut into tiles; each tile is labelled on its own (a tile has a fixed
   maximum size, so no group can grow with the data).
2. Only pixels on tile borders form edges between tile components. That graph is
   contracted with joins until it fits one task, however large it starts.
3. Labels 1..n follow the raster order of each component's first pixel. They are
   numbered per image row first and offset by row totals, so one crowded image is not
   one window partition.

Images known to fit one tile skip steps 2 and 3: one shuffle, no extra job.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segstats.operators.grouped import changes, ints, stream_groups
from segstats.operators.runs import TILE, TILE_KEY, as_runs, cut_to_tiles, div
from segstats.session import materialize

ROW = 2**31  # a pixel's position is y * ROW + x: ordering by it is raster order
EDGES_PER_TASK = 1_000_000


def union_edges(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable node for each of ``n`` nodes."""
    parent = np.arange(n)
    while True:
        a, b = parent[i], parent[j]
        if np.array_equal(a, b):
            return parent
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def one_tile_only(table: pa.Table) -> pa.Table:
    """Images that were promised to fit one tile and do not are an error, never a wrong result."""
    if (ints(table, "ty") != 0).any() or (ints(table, "tx") != 0).any():
        raise ValueError("an image is larger than the given extent")
    return table


def _label_single(table: pa.Table, reach: int, tile: int, value: str | None) -> pa.Table:
    return _label_tiles(one_tile_only(table), reach, tile, value)


def _label_tiles(table: pa.Table, reach: int, tile: int, value: str | None) -> pa.Table:
    """Label the runs of every tile in ``table``; touching pieces of a row are merged."""
    new_tile = changes(table, TILE_KEY)
    group = np.cumsum(new_tile) - 1
    y, x0, x1 = (ints(table, c) for c in ("y", "x0", "x1"))
    fresh = changes(table, [*TILE_KEY, "y"] + ([value] if value else []))
    # repeated or overlapping input runs merge: compare with the furthest end so far
    row = np.cumsum(fresh) * ROW
    furthest = np.maximum.accumulate(row + x1)
    fresh[1:] |= (row + x0)[1:] > furthest[:-1] + 1
    first = np.flatnonzero(fresh)
    runs = table.take(first)
    group, y, x0, x1 = group[first], y[first], x0[first], np.maximum.reduceat(x1, first)

    # one growing code per (tile, row, column), padded so neighbours stay in their row
    def code(row, column):
        return (group * (tile + 1) + row - ints(runs, "ty") * tile) * (tile + 2) + column - ints(runs, "tx") * tile + 1

    lo = np.searchsorted(code(y, x1), code(y + 1, x0 - reach), "left")
    hi = np.searchsorted(code(y, x0), code(y + 1, x1 + reach), "right")
    count = np.maximum(hi - lo, 0)
    i = np.repeat(np.arange(len(y)), count)
    j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    if value:
        same = runs[value].to_numpy()
        keep = same[i] == same[j]
        i, j = i[keep], j[keep]
    root = union_edges(len(y), i, j)
    number = np.cumsum(root == np.arange(len(y)))
    base = number[np.searchsorted(group, np.arange(group[-1] + 1))] - 1
    columns = {
        "image_id": runs["image_id"], "ty": runs["ty"], "tx": runs["tx"],
        "y": pa.array(y.astype(np.int32)), "x0": pa.array(x0.astype(np.int32)), "x1": pa.array(x1.astype(np.int32)),
        "root": pa.array(y[root] * ROW + x0[root]),
        "label": pa.array(number[root] - base[group]),
    }
    if value:
        columns[value] = runs[value]
    return pa.table(columns)


def _crossing_edges(local: DataFrame, connectivity: int, tile: int, value: str | None) -> DataFrame:
    """Pairs of tile components whose pixels touch across a tile border."""
    extra = [value] if value else []
    edge_row = (F.col("y") % tile).isin(0, tile - 1)
    ends = F.array_distinct(
        F.filter(F.array("x0", "x1"), lambda x: (x % tile == 0) | (x % tile == tile - 1))
    )
    border = local.select(
        "image_id", "y", "root", *extra,
        F.explode(F.when(edge_row, F.sequence("x0", "x1")).otherwise(ends)).alias("x"),
    )
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 2 else [])
    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps])
    source = border.withColumn("step", F.explode(moves)).select(
        "image_id",
        (F.col("y") + F.col("step.dy")).alias("y"),
        (F.col("x") + F.col("step.dx")).alias("x"),
        F.col("root").alias("a"),
        div("y", tile).alias("sy"),
        div("x", tile).alias("sx"),
        *extra,
    ).filter((F.col("sy") != div("y", tile)) | (F.col("sx") != div("x", tile)))
    target = border.select("image_id", "y", "x", F.col("root").alias("b"), *extra)
    return source.join(target, ["image_id", "y", "x", *extra]).select("image_id", "a", "b").distinct()


def _finish_task(batches):
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    frame = pa.Table.from_batches(batches).to_pandas()
    nodes = pd.concat([frame[["image_id", end]].rename(columns={end: "node"}) for end in ("a", "b")])
    codes = nodes.groupby(["image_id", "node"], sort=True).ngroup().to_numpy()
    half = len(frame)
    root = union_edges(codes.max() + 1, codes[:half], codes[half:])
    names = nodes.assign(code=codes).drop_duplicates("code").sort_values("code")
    out = names[["image_id", "node"]].assign(rep=names["node"].to_numpy()[root])
    yield from pa.Table.from_pandas(out, preserve_index=False).to_batches()


def contract(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """``(image_id, root, top)``: the smallest node of each node's component.

    Each round every node joins the neighbour with the smallest hash (randomised
    contraction, a constant expected share of nodes disappears per round). Once the
    counted edges fit one task, that task finishes the job.
    """
    kind = edges.schema["image_id"].dataType.simpleString()
    rounds: list[DataFrame] = []
    while edges.count() > edges_per_task:
        seed = F.lit(len(rounds))
        both = edges.unionByName(edges.select("image_id", F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("image_id", "a").agg(
            F.min(F.struct(F.xxhash64("image_id", "b", seed).alias("h"), "b")).alias("best")
        )
        own = F.struct(F.xxhash64("image_id", "a", seed).alias("h"), F.col("a").alias("b"))
        step = materialize(
            best.select("image_id", F.col("a").alias("node"), F.least("best", own)["b"].alias("rep")), "contract"
        )
        rounds.append(step)
        moved = edges
        for end in ("a", "b"):
            name = step.select("image_id", F.col("node").alias(end), F.col("rep").alias("to"))
            moved = moved.join(name, ["image_id", end]).drop(end).withColumnRenamed("to", end)
        edges = materialize(
            moved.filter("a <> b")
            .select("image_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct(),
            "edges",
        )
    reps = edges.select("image_id", "a", "b").repartition(1).mapInArrow(
        _finish_task, f"image_id {kind}, node bigint, rep bigint"
    )
    for step in reversed(rounds):
        later = reps.select("image_id", F.col("node").alias("rep"), F.col("rep").alias("later"))
        reps = step.join(later, ["image_id", "rep"], "left").select(
            "image_id", "node", F.coalesce("later", "rep").alias("rep")
        )
    tops = reps.groupBy("image_id", "rep").agg(F.min("node").alias("low"))
    return reps.join(tops, ["image_id", "rep"]).select(
        "image_id", F.col("node").alias("root"), F.least("low", "rep").alias("top")
    )


def number_in_raster_order(tops: DataFrame) -> DataFrame:
    """Label 1..n per image for components given by their first pixel ``(image_id, y, x)``."""
    in_row = F.row_number().over(Window.partitionBy("image_id", "y").orderBy("x"))
    before = Window.partitionBy("image_id").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    rows = tops.groupBy("image_id", "y").count().select(
        "image_id", "y", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("skip")
    )
    return tops.withColumn("k", in_row).join(rows, ["image_id", "y"]).withColumn(
        "label", (F.col("skip") + F.col("k")).cast("bigint")
    ).drop("skip", "k")


def label_components(
    mask: DataFrame,
    connectivity: int = 2,
    value: str | None = None,
    extent: tuple[int, int] | None = None,
    tile: int = TILE,
    edges_per_task: int = EDGES_PER_TASK,
) -> DataFrame:
    """Runs ``(image_id, y, x0, x1, label[, value])`` of the components of ``mask``.

    ``connectivity`` 1 joins side neighbours, 2 also diagonal ones. With ``value`` only
    equal-valued neighbours join. ``extent`` is an upper bound (height, width) of the
    images if the caller knows one; it saves the cross-tile step for small images, and an
    image beyond that one tile raises an error.
    """
    if connectivity not in (1, 2):
        raise ValueError("connectivity must be 1 or 2")
    keep = ["image_id", "y", "x0", "x1"] + ([value] if value else [])
    tiled = cut_to_tiles(as_runs(mask).select(*keep), tile)
    kind = mask.schema["image_id"].dataType.simpleString()
    schema = f"image_id {kind}, ty int, tx int, y int, x0 int, x1 int, root bigint, label bigint"
    if value:
        schema += f", {value} {mask.schema[value].dataType.simpleString()}"
    options = {"reach": connectivity - 1, "tile": tile, "value": value}
    if extent and max(extent) <= tile:
        local = stream_groups(tiled, TILE_KEY, ["y", "x0"], partial(_label_single, **options), schema)
        return local.select(*keep[:4], "label", *keep[4:])
    local = stream_groups(tiled, TILE_KEY, ["y", "x0"], partial(_label_tiles, **options), schema)

    local = materialize(local.drop("label"), "tiles")
    tops = contract(materialize(_crossing_edges(local, connectivity, tile, value), "edges"), edges_per_task)
    heads = local.filter(F.col("root") == F.col("y").cast("bigint") * ROW + F.col("x0"))
    parts = (
        heads.select("image_id", "root")
        .join(tops, ["image_id", "root"], "left")
        .withColumn("top", F.coalesce("top", "root"))
    )
    first = parts.filter("root = top").select(
        "image_id", "top", div("root", ROW).alias("y"), (F.col("root") % ROW).alias("x")
    )
    names = parts.join(number_in_raster_order(first).select("image_id", "top", "label"), ["image_id", "top"])
    return local.join(names.select("image_id", "root", "label"), ["image_id", "root"]).select(
        *keep[:4], "label", *keep[4:]
    )
