"""Seeded growth: every pixel of a fibre mask goes to one axon.

Every pixel has a level. A path from a seed costs the highest level on it, then the steps at that level (lower places behind
it fill at once); a pixel takes the label of its cheapest paths, the smallest label on a tie.

* ``grow``: all levels are equal, so the fewest steps decide: first inside the axon pixels, then from everything labelled
  through the whole mask.
* ``flood``: the level is the negated squared distance to the background of the axons. Low places fill first, as in a
  watershed transform, and where two labels meet at one level the nearer one wins. A priority queue gives the same
  labels except where levels tie; there it decides by order of arrival.
* ``arrival``: the same levels, and exactly the labels of a priority queue of (level, order of arrival), see ``_arrive``.

All rules are least fixpoints, costs first and labels along cheapest steps afterwards, so tiles settle on their own and trade
the border pixels that improved. A round settles only tiles that got a better offer, from the untouched start and all offers
so far, and writes their border pixels only; the pixels themselves are written once, at the end. Rounds grow with the
tile borders that a path crosses, not with its length.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.operators.components import one_tile_only
from segstats.operators.distance import distance_to_background
from segstats.operators.geometry import paint
from segstats.operators.grouped import changes, ints, stream_groups
from segstats.operators.regions import centroid_pixels, find, region_sums
from segstats.operators.runs import PIXEL, TILE, TILE_KEY, as_pixels, compress, div, lookup
from segstats.session import materialize

# level * STEP + steps: one integer that orders by level, then by steps. A path has no more steps than its image has
# pixels, and squared distances up to TOP fit; larger ones are an error.
STEP = 2**31
TOP = 2**30
ROW = 2**31  # a pixel's place is y * ROW + x
NEVER = 2**62


def seed_points(axon_labels: DataFrame) -> DataFrame:
    """One seed per object at its truncated centroid; the last label wins a shared pixel."""
    points = centroid_pixels(region_sums(axon_labels))
    return points.groupBy(*PIXEL).agg(F.max("label").alias("label"))


def _codes(table: pa.Table, tile: int) -> tuple[np.ndarray, int]:
    """Growing pixel codes of sorted tile rows, and the code distance of one image row."""
    group = np.cumsum(changes(table, TILE_KEY)) - 1
    side = tile + 2
    row = ints(table, "y") - ints(table, "ty") * tile + 1
    return (group * side + row) * side + ints(table, "x") - ints(table, "tx") * tile + 1, side


def _neighbours(code: np.ndarray, side: int) -> list[np.ndarray]:
    """Place of each pixel's side neighbour in each direction, or -1."""
    return [find(code, code + step) for step in (-side, -1, 1, side)] if len(code) else []


def _onward(cost: np.ndarray, level: np.ndarray, unit: int = 1) -> np.ndarray:
    """Cost of one more step, onto pixels of the given levels."""
    top = cost // STEP
    return np.where(level > top, level * STEP + unit, cost + unit * (level == top))


def _relax(cost: np.ndarray, level: np.ndarray, near: list[np.ndarray], unit: int = 1) -> np.ndarray:
    """Least cost of every pixel; only pixels that improved pass it on."""
    front = np.flatnonzero(cost < NEVER)
    while len(front):
        improved = []
        for there in near:
            target = there[front]
            source, target = front[target >= 0], target[target >= 0]
            offer = _onward(cost[source], level[target], unit)
            better = offer < cost[target]
            target = target[better]
            cost[target] = offer[better]
            improved.append(target)
        front = np.unique(np.concatenate(improved))
    return cost


def _spread_labels(label: np.ndarray, cost: np.ndarray, level: np.ndarray, near: list[np.ndarray]) -> np.ndarray:
    """Smallest label that reaches each pixel by its cheapest steps."""
    front = np.flatnonzero(label < NEVER)
    while len(front):
        improved = []
        for there in near:
            target = there[front]
            source, target = front[target >= 0], target[target >= 0]
            better = (_onward(cost[source], level[target]) == cost[target]) & (label[source] < label[target])
            source, target = source[better], target[better]
            label[target] = label[source]
            improved.append(target)
        front = np.unique(np.concatenate(improved))
    return label


def _runs(table: pa.Table, label: np.ndarray) -> pa.Table:
    """Runs of sorted, labelled pixels."""
    x = ints(table, "x")
    fresh = changes(table, ["image_id", "y"])
    fresh[1:] |= (x[1:] != x[:-1] + 1) | (label[1:] != label[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(x))[: len(first)] - 1
    return pa.table(
        {
            "image_id": table["image_id"].take(pa.array(first)), "y": table["y"].take(pa.array(first)),
            "x0": pa.array(x[first].astype(np.int32)), "x1": pa.array(x[last].astype(np.int32)),
            "label": pa.array(label[first]),
        }
    )


def _settle(table: pa.Table, tile: int, by_label: bool, border: bool, unit: int = 1) -> pa.Table:
    """Costs (or labels) of whole tiles with the offers from outside; with ``border`` only their edge pixels go on."""
    near = _neighbours(*_codes(table, tile))
    level, cost, label = ints(table, "level"), ints(table, "cost").copy(), ints(table, "label").copy()
    if by_label:
        label = _spread_labels(label, cost, level, near)
    else:
        cost = _relax(cost, level, near, unit)
    out = table.set_column(table.column_names.index("cost"), "cost", pa.array(cost))
    out = out.set_column(out.column_names.index("label"), "label", pa.array(label))
    if border:
        y, x = ints(table, "y") % tile, ints(table, "x") % tile
        out = out.filter(pa.array((y == 0) | (y == tile - 1) | (x == 0) | (x == tile - 1)))
    return out


def _one_tile(table: pa.Table, tile: int, inner: bool, arrival: bool = False) -> pa.Table:
    """All stages for images that fit one tile; equal pixels are merged first."""
    table = one_tile_only(table)
    first = np.flatnonzero(changes(table, [*TILE_KEY, "y", "x"]))
    axon = np.maximum.reduceat(table["axon"].cast("int8").fill_null(-1).to_numpy(), first)
    seed = np.maximum.reduceat(table["label"].fill_null(0).to_numpy(), first)
    level = np.maximum.reduceat(table["level"].fill_null(-1).to_numpy(), first)
    on_mask = axon >= 0
    table, axon, seed, level = table.take(pa.array(first[on_mask])), axon[on_mask] == 1, seed[on_mask], level[on_mask]
    level = np.where(level < 0, TOP, level)
    code, side = _codes(table, tile)
    label = np.where(seed > 0, seed, NEVER)

    def stage(label: np.ndarray, level: np.ndarray, code: np.ndarray) -> np.ndarray:
        near = _neighbours(code, side)
        cost = _relax(np.where(label < NEVER, level * STEP, NEVER), level, near)
        return _spread_labels(label, cost, level, near)

    if arrival:
        near = _neighbours(code, side)
        cost = _relax(np.where(label < NEVER, level * STEP + 1, NEVER), level, near, 2)
        place = ints(table, "y") * ROW + ints(table, "x")
        label = _order(cost, level, near, label, np.where(label < NEVER, place, -1), np.ones(len(label), bool), [])[0]
    else:
        if inner:
            label[axon] = stage(label[axon], level[axon], code[axon])
        label = stage(label, level, code)
    reached = np.flatnonzero(label < NEVER)
    return _runs(table.take(pa.array(reached)), label[reached])


def _order(
    cost: np.ndarray, level: np.ndarray, near: list[np.ndarray], label: np.ndarray, seed: np.ndarray, own: np.ndarray,
    outside: list[tuple[int, list[int], int]],
) -> tuple[np.ndarray, Callable[[int], list[int] | None]]:
    """Labels of pixels by the order in which a priority queue of (level, arrival) reaches them, and the trail of each.

    ``cost`` is the water level at which a pixel is reached, times ``STEP``, plus twice the steps at that level, plus one if they lead
    from a seed of that level (seeds are in the queue before all else, other pixels of the level that are known before). What is left
    open is which of several neighbours of least cost came first. That is the order of the places from which their paths
    rose to this level, then of those from which these rose to theirs, and so on down to the seeds, which come in raster order. So a
    pixel has a *trail*: the costs of these places and, last, the seed's place; trails are compared from the first on. All pixels that one
    place makes flow at once have one trail and one label.

    Costs are taken in order; within one, trails get ranks, so that comparing them is comparing two numbers. Rows that are not ``own`` are
    pixels of other tiles; ``outside`` has ``(row, trail, label)`` of those that are known.
    """
    n = len(cost)
    nodes_cost, follow, last = [], [], []
    for row, trail, _ in outside:  # a chain of places for each trail, behind the pixels
        at = n + len(nodes_cost)
        for k, c in enumerate(trail[:-1]):
            nodes_cost.append(c)
            follow.append(at + k + 1 if k < len(trail) - 2 else -1)
            last.append(trail[-1] if k == len(trail) - 2 else -1)
    every = np.concatenate([cost, np.array(nodes_cost, dtype=np.int64)])
    total = len(every)
    rank = np.full(total, NEVER)
    tail = np.full(total, NEVER)
    origin = np.full(total, -1)
    chain = np.full(total, -1)
    root_place = np.full(total, -1)
    root_place[:n] = seed
    chain[n:] = follow
    root_place[n:] = last
    label = label.copy()
    foreign = np.ones(total, dtype=bool)
    foreign[:n] = ~own
    at = n
    for row, trail, there in outside:
        label[row] = there
        if len(trail) == 1:
            root_place[row] = trail[0]
        else:
            chain[row] = at
        at += len(trail) - 1
    # least cost among the neighbours, and whether it is the pixel's own: then it fills with a place of the same cost
    padded = np.append(cost, NEVER)
    around = np.stack([padded[t] for t in near]) if near else np.empty((4, n), np.int64)
    least = around.min(axis=0) if n else np.empty(0, np.int64)
    behind = np.zeros(total, dtype=bool)
    behind[:n] = (seed < 0) & (least == cost) & ~foreign[:n]
    known = np.flatnonzero(every < NEVER)
    known = known[np.argsort(every[known], kind="stable")]
    starts = np.flatnonzero(np.diff(every[known], prepend=-1))
    base = 0
    for lo, hi in zip(starts, np.append(starts[1:], len(known))):
        here = known[lo:hi]
        seeds = here[root_place[here] >= 0]
        tail[seeds] = root_place[seeds]
        linked = here[chain[here] >= 0]
        tail[linked], origin[linked] = rank[chain[linked]], chain[linked]
        fresh = here[(root_place[here] < 0) & ~foreign[here] & ~behind[here]]
        if len(fresh):
            best, parent = np.full(len(fresh), NEVER), np.full(len(fresh), -1)
            for there in near:
                q = there[fresh]
                offer = np.where((q >= 0) & (padded[q] == least[fresh]), rank[q], NEVER)
                better = offer < best
                best[better], parent[better] = offer[better], q[better]
            got = parent >= 0
            fresh, parent = fresh[got], parent[got]
            rise = level[fresh] > cost[parent] // STEP
            tail[fresh] = np.where(rise, rank[parent], tail[parent])
            origin[fresh] = np.where(rise, parent, origin[parent])
            root_place[fresh] = np.where(rise, -1, np.where(origin[parent] < 0, root_place[parent], -1))
            label[fresh] = label[parent]
        front = here[(tail[here] < NEVER) & (here < n)]
        if behind[here].any():
            while len(front):
                moved = []
                for there in near:
                    t = there[front]
                    q, t = front[t >= 0], t[t >= 0]
                    better = behind[t] & (padded[t] == every[here[0]]) & (tail[q] < tail[t])
                    for q, t in zip(q[better], t[better]):
                        if tail[q] < tail[t]:
                            tail[t], origin[t], label[t], root_place[t] = tail[q], origin[q], label[q], root_place[q] if origin[q] < 0 else -1
                            moved.append(t)
                front = np.unique(np.array(moved, dtype=np.int64))
        done = here[tail[here] < NEVER]
        values, position = np.unique(tail[done], return_inverse=True)
        rank[done] = base + position
        base += len(values)

    def trail_of(row: int) -> list[int] | None:
        if rank[row] == NEVER:
            return None
        out, at = [], row
        while origin[at] >= 0:
            at = origin[at]
            out.append(int(every[at]))
        return [*out, int(root_place[at])]

    label[rank[:n] == NEVER] = NEVER
    return label, trail_of


def _arrive(table: pa.Table, tile: int, border: bool) -> pa.Table:
    """Labels of whole tiles in order of arrival, with what is known of the pixels around them; with ``border`` trails of edge pixels."""
    near = _neighbours(*_codes(table, tile))
    own = ~table["outside"].to_numpy(zero_copy_only=False)
    cost, level = ints(table, "cost"), ints(table, "level")
    given, trails = ints(table, "label"), table["trail"]
    seed = np.where(own & (given < NEVER), ints(table, "y") * ROW + ints(table, "x"), -1)
    known = np.flatnonzero(~own & trails.is_valid().to_numpy())
    outside = [(int(r), t, int(given[r])) for r, t in zip(known, trails.take(pa.array(known)).to_pylist())]
    label, trail_of = _order(cost, level, near, np.where(own, given, NEVER), seed, own, outside)
    rows = np.flatnonzero(own)
    if border:
        y, x = ints(table, "y")[rows] % tile, ints(table, "x")[rows] % tile
        rows = rows[(y == 0) | (y == tile - 1) | (x == 0) | (x == tile - 1)]
    out = table.select([*TILE_KEY, "y", "x", "cost"]).take(pa.array(rows))
    return out.append_column("label", pa.array(label[rows])).append_column(
        "trail", pa.array([trail_of(r) if border else None for r in rows.tolist()], pa.list_(pa.int64()))
    )


def arrive(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """Label of every pixel that is reached, in order of arrival; ``pixels`` as for ``spread``.

    Costs settle first. Then tiles settle labels alone and send the trails of their edge pixels to the tiles beside them; those that
    got another trail settle again, until none changes. Trails only fall, and a trail has one entry for each rise of the level.
    """
    kind = pixels.schema["image_id"].dataType.simpleString()
    start = _start(pixels, tile, 1)
    costs = materialize(_exchange(materialize(start, "start"), tile, False, 2).filter(F.col("cost") < NEVER), "costs")
    schema = f"image_id {kind}, ty int, tx int, y int, x int, cost bigint, label bigint, trail array<bigint>"
    columns = [*TILE_KEY, "y", "x", "level", "cost", "label", "trail", "outside"]
    home = costs.select(*columns[:8], F.lit(None).cast("array<bigint>").alias("trail"), F.lit(False).alias("outside"))

    def settled(tiles: DataFrame, around: DataFrame, border: bool) -> DataFrame:
        both = tiles.unionByName(around.select(*columns[:5], F.lit(0).cast("bigint").alias("level"), "cost", "label", "trail", F.lit(True).alias("outside")))
        return stream_groups(both, TILE_KEY, ["y", "x"], partial(_arrive, tile=tile, border=border), schema)

    step = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]))

    def sent(edge: DataFrame) -> DataFrame:
        """Edge pixels to the tiles that they touch."""
        beside = edge.withColumn("step", step).select(
            "image_id", div(F.col("y") + F.col("step.dy"), tile).alias("ty"), div(F.col("x") + F.col("step.dx"), tile).alias("tx"), "y", "x",
            F.col("ty").alias("sy"), F.col("tx").alias("sx"), "cost", "label", "trail",
        )
        return beside.filter((F.col("ty") != F.col("sy")) | (F.col("tx") != F.col("sx"))).drop("sy", "sx")

    y, x = F.col("y") % tile, F.col("x") % tile
    on_edge = (y == 0) | (y == tile - 1) | (x == 0) | (x == tile - 1)
    nothing = home.filter(on_edge).select(*TILE_KEY, "y", "x", "cost", F.lit(NEVER).alias("label"), "trail")
    around = materialize(sent(nothing).join(home.select(*TILE_KEY).distinct(), TILE_KEY, "left_semi"), "around")
    if around.isEmpty():
        return settled(home, around, False).filter(F.col("label") < NEVER).select(*PIXEL, "label")
    edge = materialize(settled(home, around, True), "edge")
    while True:
        news = sent(edge).join(home.select(*TILE_KEY).distinct(), TILE_KEY, "left_semi")
        old = around.select(*TILE_KEY, "y", "x", F.col("trail").alias("before"))
        compared = materialize(news.join(old, [*TILE_KEY, "y", "x"]).withColumn("moved", ~F.col("trail").eqNullSafe(F.col("before"))), "compared")
        around = compared.drop("before", "moved")
        busy = materialize(compared.filter("moved").select(*TILE_KEY).distinct(), "busy")
        if busy.isEmpty():
            return settled(home, around, False).filter(F.col("label") < NEVER).select(*PIXEL, "label")
        fresh = settled(home.join(busy, TILE_KEY, "left_semi"), around.join(busy, TILE_KEY, "left_semi"), True)
        edge = materialize(edge.join(busy, TILE_KEY, "left_anti").unionByName(fresh), "edge")


def _exchange(start: DataFrame, tile: int, by_label: bool, unit: int = 1) -> DataFrame:
    """Settle ``start (image_id, ty, tx, y, x, level, cost, label)`` across tiles for costs or for labels."""
    value = "label" if by_label else "cost"
    kind = start.schema["image_id"].dataType.simpleString()
    schema = f"image_id {kind}, ty int, tx int, y int, x int, level bigint, cost bigint, label bigint"
    columns = [*TILE_KEY, "y", "x", "level", "cost", "label"]

    def settled(tiles: DataFrame, offers: DataFrame | None, border: bool) -> DataFrame:
        if offers is not None:
            better = F.least(value, "offer").alias(value)
            tiles = tiles.join(offers, PIXEL, "left").select(*[better if c == value else c for c in columns])
        return stream_groups(tiles, TILE_KEY, ["y", "x"], partial(_settle, tile=tile, by_label=by_label, border=border, unit=unit), schema)

    top = F.expr(f"s_cost div {STEP}L")
    onward = F.when(F.col("level") > top, F.col("level") * STEP + unit).when(F.col("level") == top, F.col("s_cost") + unit).otherwise(F.col("s_cost"))
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]))
    fresh = known = materialize(settled(start, None, True), "border")
    inbox = None
    while True:
        sent = (
            fresh.filter(F.col(value) < NEVER).withColumn("step", step)
            .select(
                "image_id", F.col("ty").alias("sy"), F.col("tx").alias("sx"), (F.col("y") + F.col("step.dy")).alias("y"),
                (F.col("x") + F.col("step.dx")).alias("x"), F.col("cost").alias("s_cost"), F.col("label").alias("s_label"),
            )
            .filter((div("y", tile) != F.col("sy")) | (div("x", tile) != F.col("sx")))
        )
        met = sent.join(known, PIXEL).withColumn("onward", onward)
        if by_label:
            met = met.filter((F.col("onward") == F.col("cost")) & (F.col("s_label") < F.col("label")))
        else:
            met = met.filter(F.col("onward") < F.col("cost"))
        offer = F.min("s_label" if by_label else "onward").alias("offer")
        better = materialize(met.groupBy(*PIXEL, "ty", "tx").agg(offer), "offers")
        if better.isEmpty():
            return settled(start, inbox, False)
        fewer = better.select(*PIXEL, "offer")
        if inbox is not None:
            fewer = inbox.unionByName(fewer).groupBy(*PIXEL).agg(F.min("offer").alias("offer"))
        inbox = materialize(fewer, "inbox")
        busy = start.join(better.select(*TILE_KEY).distinct(), TILE_KEY, "left_semi")
        fresh = materialize(settled(busy, inbox, True), "border")
        # values only fall, so the least of all rounds is the present one
        rest = known.join(fresh.select(*TILE_KEY).distinct(), TILE_KEY, "left_anti")
        known = materialize(rest.unionByName(fresh), "border")


def _start(pixels: DataFrame, tile: int, extra: int) -> DataFrame:
    """Pixels in their tiles, seeds at the cost of their level plus ``extra``."""
    level = F.col("level").cast("bigint")
    return pixels.select(
        "image_id", div("y", tile).alias("ty"), div("x", tile).alias("tx"), "y", "x", level.alias("level"),
        F.when(F.col("label").isNotNull(), level * STEP + extra).otherwise(F.lit(NEVER)).alias("cost"),
        F.coalesce(F.col("label").cast("bigint"), F.lit(NEVER)).alias("label"),
    )


def spread(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """Label of every pixel that is reached; ``pixels (image_id, y, x, level, label)``, label null but at the seeds."""
    costs = materialize(_exchange(materialize(_start(pixels, tile, 0), "start"), tile, False), "costs")
    labels = _exchange(costs, tile, True)
    return labels.filter(F.col("label") < NEVER).select(*PIXEL, "label")


def _tagged(axon: DataFrame, myelin: DataFrame, seeds: DataFrame) -> DataFrame:
    none = F.lit(None)
    return (
        as_pixels(axon).select(*PIXEL, F.lit(True).alias("axon"), none.cast("bigint").alias("label"))
        .union(as_pixels(myelin).select(*PIXEL, F.lit(False), none.cast("bigint")))
        .union(seeds.select(*PIXEL, none.cast("boolean"), F.col("label").cast("bigint")))
        .withColumn("level", F.lit(None).cast("bigint"))
    )


def _single(union: DataFrame, tile: int, inner: bool, arrival: bool = False) -> DataFrame:
    kind = union.schema["image_id"].dataType.simpleString()
    tiled = union.select("image_id", div("y", tile).alias("ty"), div("x", tile).alias("tx"), "y", "x", "axon", "label", "level")
    return stream_groups(
        tiled, TILE_KEY, ["y", "x"], partial(_one_tile, tile=tile, inner=inner, arrival=arrival),
        f"image_id {kind}, y int, x0 int, x1 int, label bigint",
    )


def _merged(union: DataFrame) -> DataFrame:
    """One aggregation merges both masks, levels and seeds; seeds off the mask drop out."""
    merged = union.groupBy(*PIXEL).agg(F.max("axon").alias("axon"), F.max("label").alias("label"), F.max("level").alias("level"))
    return materialize(merged.filter("axon IS NOT NULL"), "fibre")


def grow(
    axon: DataFrame,
    myelin: DataFrame,
    seeds: DataFrame,
    tile: int = TILE,
    extent: tuple[int, int] | None = None,
) -> DataFrame:
    """Fibre runs ``(image_id, y, x0, x1, label)`` grown from ``seeds (image_id, y, x, label)``, nearest seed first."""
    union = _tagged(axon, myelin, seeds)
    if extent and max(extent) <= tile:
        return _single(union, tile, True)
    mask = _merged(union)
    flat = F.lit(0).alias("level")
    inner = spread(mask.filter("axon").select(*PIXEL, flat, "label"), tile)
    # axon pixels that were reached, and seeds on myelin, are the sources of the second stage
    sources = mask.filter("axon").select(*PIXEL).join(inner, PIXEL, "left").select(*PIXEL, flat, "label")
    outer = spread(sources.unionByName(mask.filter("NOT axon").select(*PIXEL, flat, "label")), tile)
    return compress(outer, ["label"])


def flood(
    axon: DataFrame,
    myelin: DataFrame,
    seeds: DataFrame,
    images: DataFrame,
    extent: tuple[int, int] | None = None,
    tile: int = TILE,
    arrival: bool = False,
) -> DataFrame:
    """Watershed of the negated axon distance as fibre runs; with ``arrival`` ties are broken as by a priority queue."""
    depth = F.coalesce("d2", F.lit(0))
    error = F.raise_error(F.lit(f"squared distances above {TOP} are not supported")).cast("bigint")
    levels = distance_to_background(axon, images).select(
        *PIXEL, F.lit(None).cast("boolean").alias("axon"), F.lit(None).cast("bigint").alias("label"),
        F.when(depth > TOP, error).otherwise(TOP - depth).alias("level"),
    )
    union = _tagged(axon, myelin, seeds).unionByName(levels)
    if extent and max(extent) <= tile:
        return _single(union, tile, False, arrival)
    mask = _merged(union).select(*PIXEL, F.coalesce("level", F.lit(TOP)).alias("level"), "label")
    return compress(arrive(mask, tile) if arrival else spread(mask, tile), ["label"])


def remove_fibres(axon: DataFrame, myelin: DataFrame, fibres: DataFrame, points: DataFrame):
    """Both masks without the fibres (runs) under ``points (image_id, x, y)`` (truncated to pixels)."""
    spots = points.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).distinct()
    runs = fibres.select("image_id", "y", "x0", "x1", "label")
    doomed = lookup(spots, runs, ["label"]).filter("label IS NOT NULL").select("image_id", "label").distinct()
    gone = as_pixels(paint(runs, doomed)).select(*PIXEL)
    return as_pixels(axon).join(gone, PIXEL, "left_anti"), as_pixels(myelin).join(gone, PIXEL, "left_anti")
