import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from reference_helpers import ALL, SIDES, flood as slow_flood, grow as slow_grow, label, queue_flood, squared_distance, to_array
from segstats.operators import geometry, masks
from segstats.operators.components import label_components
from segstats.operators.distance import distance_to_background
from segstats.operators.regions import measure_regions, region_sums
from segstats.operators.runs import as_pixels, complement, compress
from segstats.operators.watershed import flood, grow, remove_fibres, seed_points
from conftest import pixel_set

RNG = np.random.default_rng(7)


@pytest.mark.parametrize("connectivity", [1, 2])
@pytest.mark.parametrize("options", [{"extent": (40, 50)}, {"tile": 8}, {"tile": 5, "edges_per_task": 0}])
def test_components_match_flood_fill(draw, connectivity, options):
    grid = (RNG.random((40, 50)) < 0.55).astype(int)
    found = label_components(draw(grid), connectivity, **options)
    expected = label(grid, SIDES if connectivity == 1 else ALL)
    assert (to_array(as_pixels(found), grid.shape) == expected).all()


def test_three_pieces_by_sides_two_with_diagonals(draw):
    mask = draw("11000 11000 00100 00100 00001")
    counts = [label_components(mask, c, extent=(5, 5)).select("label").distinct().count() for c in (1, 2)]
    assert counts == [3, 2]


@pytest.mark.parametrize("tile", [4, 64])
def test_repeated_and_overlapping_runs_merge(spark, tile):
    rows = [(0, 0, 0, 10), (0, 0, 2, 3), (0, 0, 5, 6), (0, 0, 11, 11), (0, 0, 11, 11), (0, 2, 4, 4), (0, 2, 4, 4)]
    mask = spark.createDataFrame(rows, "image_id long, y int, x0 int, x1 int")
    found = as_pixels(label_components(mask, 2, tile=tile))
    assert found.count() == found.select("y", "x").distinct().count() == 13
    assert found.select("label").distinct().count() == 2


@pytest.mark.parametrize("tile", [4, 64])
def test_equal_values_join(draw, tile):
    grid = RNG.integers(0, 3, (20, 20))
    found = label_components(draw(grid, value=True), 2, value="v", tile=tile)
    assert (to_array(as_pixels(found), grid.shape) == label(grid, ALL)).all()


def test_one_component_across_many_tiles(draw):
    """A spiral: one object in one image that crosses every tile again and again."""
    grid = np.zeros((33, 33), int)
    y, x, dy, dx = 0, 0, 0, 1
    for _ in range(2000):
        grid[y, x] = 1
        a, b = y + 2 * dy, x + 2 * dx
        ahead = not (0 <= y + dy < 33 and 0 <= x + dx < 33) or (0 <= a < 33 and 0 <= b < 33 and grid[a, b])
        if ahead:
            dy, dx = dx, -dy
            if not (0 <= y + dy < 33 and 0 <= x + dx < 33) or grid[y + dy, x + dx]:
                break
        y, x = y + dy, x + dx
    found = label_components(draw(grid), 1, tile=4, edges_per_task=3)
    assert region_sums(found).count() == label(grid, SIDES).max()


def test_region_measures(draw):
    grid = (RNG.random((30, 30)) < 0.4).astype(int)
    expected = label(grid, ALL)
    rows = {r["label"]: r for r in measure_regions(label_components(draw(grid), 2, tile=8), tile=8).collect()}
    assert set(rows) == set(range(1, expected.max() + 1))
    for k, r in rows.items():
        y, x = np.nonzero(expected == k)
        cov = np.cov(np.vstack([y, x]), bias=True) if len(y) > 1 else np.zeros((2, 2))
        low, high = np.maximum(np.linalg.eigvalsh(cov), 0)
        assert (r["area"], r["y0"], r["x0"]) == (len(y), pytest.approx(y.mean()), pytest.approx(x.mean()))
        assert r["minor_axis"] == pytest.approx(4 * np.sqrt(low), abs=1e-5)
        assert r["major_axis"] == pytest.approx(4 * np.sqrt(high), abs=1e-5)
        assert (r["bbox_min_y"], r["bbox_max_x"]) == (y.min(), x.max() + 1)
        assert 0 < r["solidity"] <= 1


def test_square_perimeter_and_solidity(draw):
    square = np.zeros((12, 12), int)
    square[3:9, 3:9] = 1
    row = measure_regions(label_components(draw(square), 2, extent=(12, 12))).first()
    assert row["perimeter"] == 20  # 20 border pixels, all of weight 1
    assert row["solidity"] == 1 and row["orientation"] == pytest.approx(-np.pi / 4)


def test_tilted_line_orientation(draw):
    row = measure_regions(label_components(draw(np.eye(9, dtype=int)), 2, extent=(9, 9))).first()
    assert row["orientation"] == pytest.approx(np.pi / 4)
    assert row["eccentricity"] == pytest.approx(1, abs=1e-6)


@pytest.mark.parametrize("radius", [6, 15, 40])
def test_disc_perimeter_within_ten_percent(draw, radius):
    y, x = np.indices((2 * radius + 5,) * 2) - radius - 2
    disc = (x**2 + y**2 < radius**2).astype(int)
    row = measure_regions(label_components(draw(disc), 2)).first()
    assert row["perimeter"] == pytest.approx(2 * np.pi * radius, rel=0.1)
    assert row["equivalent_diameter"] == pytest.approx(2 * radius, rel=0.1)


def test_measures_follow_rotation(draw):
    grid = np.zeros((20, 20), int)
    grid[2:9, 3:15] = 1
    grid[9:12, 3:6] = 1
    keep = ["area", "perimeter", "solidity", "eccentricity", "minor_axis"]
    a, b = (
        measure_regions(label_components(draw(g), 2, extent=(20, 20))).select(keep).first() for g in (grid, np.rot90(grid))
    )
    assert list(a) == pytest.approx(list(b))


def test_distance(draw, sizes):
    grid = (RNG.random((25, 31)) < 0.8).astype(int)
    grid[5:20, 5:20] = 1
    grid[12, 12] = 0
    rows = distance_to_background(draw(grid), sizes((25, 31))).collect()
    assert {(r["y"], r["x"]): r["d2"] for r in rows} == squared_distance(grid)


def test_distance_without_background(draw, sizes):
    rows = distance_to_background(draw(np.ones((4, 5), int)), sizes((4, 5))).collect()
    assert len(rows) == 20 and all(r["dist"] is None for r in rows)


@pytest.mark.parametrize("options", [{"tile": 6}, {"tile": 64}, {"extent": (30, 30)}])
def test_growth_is_the_same_on_any_tiling(draw, options):
    axon = (RNG.random((30, 30)) < 0.3).astype(int)
    ring = ((RNG.random((30, 30)) < 0.5) & (axon == 0)).astype(int)
    labels = label_components(draw(axon), 2, extent=(30, 30))
    seeds = seed_points(labels)
    found = to_array(as_pixels(grow(draw(axon), draw(ring), seeds, **options)), axon.shape)
    start = {(r["y"], r["x"]): r["label"] for r in seeds.collect()}
    assert (found == slow_grow(axon, axon + ring, start)).all()


def discs(shape, items):
    y, x = np.indices(shape)
    axon, ring = np.zeros(shape, int), np.zeros(shape, int)
    for cy, cx, r, t in items:
        d = (y - cy) ** 2 + (x - cx) ** 2
        axon[d < r * r] = 1
        ring[(d < (r + t) ** 2) & (d >= r * r)] = 1
    return axon, ring & (axon == 0)


def test_flood_and_growth_agree_on_separate_discs(draw, sizes):
    axon, ring = discs((60, 60), [(15, 15, 6, 4), (40, 42, 8, 5), (44, 12, 4, 4)])
    a, m = draw(axon), draw(ring)
    seeds = seed_points(label_components(a, 2, extent=axon.shape))
    one = to_array(as_pixels(grow(a, m, seeds, extent=axon.shape)), axon.shape)
    two = to_array(as_pixels(flood(a, m, seeds, sizes(axon.shape))), axon.shape)
    assert (one == two).all() and ((one > 0) == (axon + ring > 0)).all()


def noisy(n, count, share=0.35):
    out = []
    for _ in range(count):
        axon = (RNG.random((n, n)) < share).astype(int)
        out.append((axon, ((RNG.random((n, n)) < 0.6) & (axon == 0)).astype(int)))
    return out


@pytest.mark.parametrize("options", [{"extent": (14, 14)}, {"tile": 5}, {"tile": 64}])
def test_flood_rule(draw, sizes, options):
    """Noisy masks, where ties decide most pixels, against plain rescans."""
    images = noisy(14, 3)
    a, m = draw(*[i[0] for i in images]), draw(*[i[1] for i in images])
    seeds = seed_points(label_components(a, 2, extent=(14, 14)))
    found = as_pixels(flood(a, m, seeds, sizes(*[(14, 14)] * 3), **options)).cache()
    rows = seeds.collect()
    for k, (axon, ring) in enumerate(images):
        start = {(r["y"], r["x"]): r["label"] for r in rows if r["image_id"] == k}
        assert (to_array(found, (14, 14), image=k) == slow_flood(axon, axon + ring, start)).all()


@pytest.mark.parametrize("options", [{"extent": (14, 14)}, {"tile": 8}])
def test_arrival_is_the_queue_on_noise(draw, sizes, options):
    """One-pixel objects, where nearly every level ties, against a priority queue."""
    images = noisy(14, 4) + noisy(14, 2, 0.6)
    a, m = draw(*[i[0] for i in images]), draw(*[i[1] for i in images])
    seeds = seed_points(label_components(a, 2, extent=(14, 14)))
    found = as_pixels(flood(a, m, seeds, sizes(*[(14, 14)] * 6), arrival=True, **options)).cache()
    rows = seeds.collect()
    for k, (axon, ring) in enumerate(images):
        start = {(r["y"], r["x"]): r["label"] for r in rows if r["image_id"] == k}
        assert (to_array(found, (14, 14), image=k) == queue_flood(axon, axon + ring, start)).all()


def test_arrival_is_the_queue_on_touching_discs(draw, sizes):
    axon, ring = discs((40, 60), [(20, 18, 11, 4), (20, 40, 9, 4), (8, 50, 6, 6)])
    a, m = draw(axon), draw(ring)
    seeds = seed_points(label_components(a, 2, extent=axon.shape))
    start = {(r["y"], r["x"]): r["label"] for r in seeds.collect()}
    found = to_array(as_pixels(flood(a, m, seeds, sizes(axon.shape), arrival=True, tile=32)), axon.shape)
    assert (found == queue_flood(axon, axon + ring, start)).all()


def test_flood_differs_from_the_queue_on_ties_only():
    """The same pixels are reached; labels differ where levels tie, often in noise and rarely between discs."""
    differ = total = 0
    for axon, ring in noisy(20, 6, 0.45):
        labels = label(axon, ALL)
        start = {}
        for k in range(1, labels.max() + 1):
            y, x = np.nonzero(labels == k)
            start[int(y.mean()), int(x.mean())] = k
        start = {c: k for c, k in start.items() if (axon + ring)[c]}
        ours, queue = slow_flood(axon, axon + ring, start), queue_flood(axon, axon + ring, start)
        assert ((ours > 0) == (queue > 0)).all()
        differ += (ours != queue).sum()
        total += (queue > 0).sum()
    assert differ < 0.3 * total  # noise of one-pixel objects: nearly every level ties
    # two discs that touch: the pass between them is one place, and both rules cut there
    axon, ring = discs((40, 60), [(20, 18, 11, 4), (20, 40, 9, 4)])
    both = axon + ring
    start = {(20, 18): 1, (20, 40): 2}
    ours, queue = slow_flood(axon, both, start), queue_flood(axon, both, start)
    assert (ours != queue).mean() < 0.02


def test_serpentine_tile_settles_fast(draw, sizes):
    grid = np.zeros((256, 256), int)
    grid[::2] = 1
    grid[1::4, -1] = grid[3::4, 0] = 1
    started = time.perf_counter()
    seed = draw(np.eye(1, dtype=int)).selectExpr("*", "7L AS label")
    out = grow(draw(np.zeros_like(grid)), draw(grid), seed, extent=grid.shape)
    assert out.agg(F.sum(F.expr("x1 - x0 + 1"))).first()[0] == grid.sum()
    assert time.perf_counter() - started < 20


def test_fibres_at_points_are_removed(draw, spark):
    axon, ring = discs((60, 60), [(15, 15, 6, 4), (40, 42, 8, 5)])
    a, m = draw(axon), draw(ring)
    fibres = grow(a, m, seed_points(label_components(a, 2, extent=axon.shape)), extent=axon.shape)
    points = spark.createDataFrame([(0, 15.7, 9.2), (0, 0.0, 0.0)], "image_id long, x double, y double")
    left_a, left_m = remove_fibres(a, m, fibres, points)
    kept = pixel_set(left_a) | pixel_set(left_m)
    assert kept == {(0, y, x) for y, x in zip(*np.nonzero(discs((60, 60), [(40, 42, 8, 5)])[0] + discs((60, 60), [(40, 42, 8, 5)])[1]))}


def test_clip_and_overlap_on_hand_arrays(draw):
    axon, myelin, nerve = draw("001000100"), draw("010101010"), draw("000011111")
    assert pixel_set(masks.clip(axon, nerve)) == pixel_set(draw("000000100"))
    assert pixel_set(masks.clip(myelin, nerve)) == pixel_set(draw("000001010"))
    first, second, overlap = masks.remove_overlap(draw("110 110 110"), draw("011 011 011"), priority=2)
    assert pixel_set(overlap) == pixel_set(draw("010 010 010"))
    assert pixel_set(first) == pixel_set(draw("100 100 100"))
    assert pixel_set(second) == pixel_set(draw("011 011 011"))
    with pytest.raises(ValueError):
        masks.remove_overlap(axon, myelin, priority=3)


def test_class_split_rules(spark):
    df = spark.createDataFrame([(0, v, 0, v) for v in (0, 49, 50, 100, 127, 200, 201, 255)], "image_id long, y int, x int, v int")
    scoring = {r["v"]: r["cls"] for r in masks.split_classes(df).collect()}
    editor = {r["v"]: r["cls"] for r in masks.split_classes(df, "editor").collect()}
    assert scoring == {50: "myelin", 100: "myelin", 127: "myelin", 200: "myelin", 201: "axon", 255: "axon"}
    assert editor == {127: "myelin", 201: "axon", 255: "axon"}


def test_merge_prefers_myelin(draw):
    rows = {(r["y"], r["x"]): r["v"] for r in masks.merge_masks(draw("110"), draw("011")).collect()}
    assert rows == {(0, 0): 255, (0, 1): 127, (0, 2): 127}


def test_hole_filling(draw, sizes):
    ring = "0000000 0111110 0100010 0101010 0100010 0111110 0000000"
    inside = masks.enclosed_holes(draw(ring), sizes((7, 7)))
    assert inside.count() == 8
    assert masks.small_holes(draw(ring), sizes((7, 7)), 0.1).count() == 0  # 8 pixels, limit 4.9
    assert masks.small_holes(draw(ring), sizes((7, 7)), 0.2).count() == 8


def test_complement_and_runs(draw, sizes):
    grid = (RNG.random((9, 11)) < 0.5).astype(int)
    grid[3] = 0
    rest = as_pixels(complement(draw(grid), sizes((9, 11))))
    assert (to_array(rest.withColumn("label", F.lit(1)), grid.shape) == 1 - grid).all()
    assert pixel_set(as_pixels(compress(draw(grid)))) == pixel_set(draw(grid))


@pytest.mark.parametrize("tile", [7, 64])
def test_erosion(draw, sizes, tile):
    grid = (RNG.random((30, 26)) < 0.97).astype(int)
    kept = pixel_set(masks.eroded(draw(grid), sizes(grid.shape), 3, tile).filter("kept"))
    expected = set()
    for y, x in zip(*np.nonzero(grid)):
        disk = [(y + a, x + b) for a in range(-3, 4) for b in range(-3, 4) if a * a + b * b <= 9]
        if all(grid[c, d] for c, d in disk if 0 <= c < 30 and 0 <= d < 26):
            expected.add((0, y, x))
    assert kept == expected


def test_outline_points(spark):
    df = spark.createDataFrame([(50.0, 80.0, 15.0, 15.0, 0.3)], "cx double, cy double, a double, b double, o double")
    rows = geometry.ellipse_points(df, 128, "cx", "cy", "a", "b", "o").collect()
    assert len(rows) == 128
    assert all(np.hypot(r["px"] - 50, r["py"] - 80) == pytest.approx(15, abs=1e-10) for r in rows)
    df = spark.createDataFrame([(0.0, 0.0, 30.0, 10.0, 1.1)], "cx double, cy double, a double, b double, o double")
    far = [np.hypot(r["px"], r["py"]) for r in geometry.ellipse_points(df, 1000, "cx", "cy", "a", "b", "o").collect()]
    assert (max(far), min(far)) == (pytest.approx(30, abs=1e-2), pytest.approx(10, abs=1e-2))


def test_rings_of_diameter_outlines(spark):
    df = spark.createDataFrame([(0, 1, 100.0, 90.0, 10.0, 3.0)], "image_id long, label long, x0 double, y0 double, axon_diam double, myelin_thickness double")
    rows = geometry.diameter_outlines(df, 0.1).collect()
    radius = {r["ring"]: np.hypot(r["px"] - 100, r["py"] - 90) for r in rows}
    assert radius == {"axon": pytest.approx(50), "fibre": pytest.approx(80)}


def test_instance_colours_differ_between_neighbours(spark):
    rows = spark.range(1, 60).select(geometry.instance_colour(F.col("id")).alias("c")).collect()
    colours = [tuple(r["c"]) for r in rows]
    assert all(a != b for a, b in zip(colours, colours[1:]))
    with pytest.raises(ValueError):
        geometry.instance_colour(F.lit(1), [(0, 0, 0)] * 3)


def test_paint_covers_every_object_pixel(draw, spark):
    grid = (RNG.random((40, 40)) < 0.6).astype(int)
    labels = label_components(draw(grid), 2, extent=grid.shape)
    table = region_sums(labels).select("image_id", "label", F.col("area").cast("double").alias("axon_diam"))
    painted = geometry.paint(labels, table, tile=8)
    expected = label(grid, ALL)
    sizes_ = np.bincount(expected.ravel())
    for r in as_pixels(painted).collect():
        assert r["axon_diam"] == sizes_[expected[r["y"], r["x"]]]
    assert as_pixels(painted).count() == grid.sum()


def test_text_image_ids(draw, sizes):
    grid = (RNG.random((20, 20)) < 0.5).astype(int)
    mask = draw(grid, grid.T).withColumn("image_id", F.concat(F.lit("img-"), "image_id"))
    images = sizes((20, 20), (20, 20)).withColumn("image_id", F.concat(F.lit("img-"), "image_id"))
    labels = label_components(mask, 2, tile=8, edges_per_task=0)
    assert labels.select("image_id", "label").distinct().count() == label(grid, ALL).max() + label(grid.T, ALL).max()
    assert measure_regions(labels).filter("perimeter IS NULL OR solidity IS NULL").count() == 0
    assert distance_to_background(mask, images).count() == 2 * grid.sum()


def test_a_broken_size_promise_is_an_error(spark, draw):
    pixels = spark.createDataFrame([(0, 0, 0), (0, 0, 300)], "image_id long, y int, x int")
    assert label_components(pixels, 2).select("label").distinct().count() == 2
    with pytest.raises(Exception, match="larger than the given extent"):
        label_components(pixels, 2, extent=(8, 8)).collect()
    none = pixels.limit(0)
    seeds = pixels.selectExpr("*", "1L AS label")
    with pytest.raises(Exception, match="larger than the given extent"):
        grow(pixels, none, seeds, extent=(8, 8)).collect()
    # labels are a column of their own and may have any size
    assert {r.label for r in grow(pixels, none, pixels.selectExpr("*", "3000000000L + x AS label")).collect()} == {3 * 10**9, 3 * 10**9 + 300}


def test_erosion_of_label_runs_that_end_at_tiles(spark, sizes):
    block = spark.createDataFrame([(0, y, 240, 279) for y in range(5, 36)], "image_id long, y int, x0 int, x1 int")
    images = sizes((50, 400))
    labels = label_components(block, 2)
    assert labels.count() > block.count()
    kept = [masks.eroded(m, images, 3).filter("kept").count() for m in (block, labels)]
    assert kept[0] == kept[1] > 0


def test_closeups_deal_pixels_to_as_many_tasks_as_they_need(draw, sizes, monkeypatch):
    monkeypatch.setattr(geometry, "PIXELS_PER_TASK", 10, raising=False)
    monkeypatch.setattr(geometry, "CROP_TILE", 4)
    mask = draw("00000000 01100000 01100000 00000000 00000110 00000110")
    labels = label_components(mask, 2)
    pixels = mask.selectExpr("image_id", "y", "x", "1D AS v", "true AS axon", "false AS myelin")
    crops = geometry.closeups(region_sums(labels), pixels, labels, sizes((6, 8)), buffer=1)
    assert crops.rdd.getNumPartitions() >= 4
    assert sorted((r.object, r.cy, r.cx) for r in crops.filter("own_axon").collect()) == [(k, y, x) for k in (1, 2) for y in (1, 2) for x in (1, 2)]


def test_equal_ellipses_are_painted_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(geometry, "materialize", lambda df, name: seen.append(df.count()) or df, raising=False)
    one = spark.createDataFrame([(0, 5, 4.0, 10, 10, 0.5, 0.0)], "image_id long, shape_id long, radius double, cx int, cy int, gratio double, plane_angle double")
    many = one.crossJoin(spark.range(40)).withColumn("shape_id", F.col("id") + 5).drop("id")
    canvas = spark.createDataFrame([(0, 30, 30)], "image_id long, height int, width int")
    assert sorted(geometry.rasterize(many, canvas).collect()) == sorted(geometry.rasterize(one, canvas).collect())
    assert seen == [1, 1]
