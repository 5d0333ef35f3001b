import numpy as np
import pytest

from segstats.operators import geometry, masks
from segstats.plans.nerve import nerve_documents, nerve_report
from segstats.plans.objects import measure_objects

SETS = {
    "circles": (
        [50, 45, 40, 35, 30, 23, 18, 12], [(100, 100), (200, 200), (300, 300), (400, 400), (520, 520), (630, 630), (725, 725), (830, 830)],
        [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2], [0] * 8,
    ),
    "angles": ([25] * 8, [(100 * k, 100 * k) for k in range(1, 9)], [0.5] * 8, list(range(0, 80, 10))),
}


def shapes(spark, sets):
    rows = []
    for image, name in enumerate(sets):
        for k, (r, (cx, cy), g, angle) in enumerate(zip(*SETS[name])):
            rows.append((image, k, float(r), cx, cy, float(g), float(angle)))
    return spark.createDataFrame(
        rows, "image_id long, shape_id int, radius double, cx int, cy int, gratio double, plane_angle double"
    )


@pytest.fixture(scope="module")
def slides(spark):
    """Both sets as images of 1000 x 1000 pixels: axon, myelin and image tables."""
    images = spark.createDataFrame([(0, 1000, 1000), (1, 1000, 1000)], "image_id long, height int, width int")
    pixels = masks.split_classes(geometry.rasterize(shapes(spark, list(SETS)), images)).cache()
    return pixels.filter("cls = 'axon'"), pixels.filter("cls = 'myelin'"), images


def test_known_shapes_are_recovered(slides):
    """Diameter, g-ratio and thickness of discs and tilted discs within 10 percent."""
    axon, myelin, images = slides
    rows = measure_objects(axon, images, myelin, 1.0, "ellipse").orderBy("image_id", "label").collect()
    for image, name in enumerate(SETS):
        radius, centres, gratio, _ = SETS[name]
        found = [r for r in rows if r["image_id"] == image]
        assert len(found) == len(radius)
        for r, true_r, (cx, cy), g in zip(found, radius, centres, gratio):
            assert (r["x0"], r["y0"]) == (pytest.approx(cx, abs=1), pytest.approx(cy, abs=1))
            assert r["axon_diam"] == pytest.approx(2 * true_r, rel=0.1)
            assert r["gratio"] == pytest.approx(g, rel=0.1)
            assert r["myelin_thickness"] == pytest.approx(true_r * (1 / g - 1), rel=0.1)


def test_circle_and_ellipse_modes_agree_on_a_circle(slides):
    axon, myelin, images = (d.filter("image_id = 0") for d in slides)
    one = {r["label"]: r for r in measure_objects(axon, images, myelin, 0.5, "circle").collect()}
    two = {r["label"]: r for r in measure_objects(axon, images, myelin, 0.5, "ellipse").collect()}
    for k in (1, 2, 3):
        assert one[k]["axon_diam"] == pytest.approx(two[k]["axon_diam"], rel=0.02)
        assert one[k]["myelin_thickness"] == pytest.approx(two[k]["myelin_thickness"], rel=0.02, abs=0.1)
        assert one[k]["axon_perimeter"] == pytest.approx(np.pi * one[k]["axon_diam"], rel=0.1)


def test_border_flag_and_boxes(spark):
    rows = [(0, 0, 100.0, 100, 100, 0.6, 0.0), (0, 1, 40.0, 500, 500, 0.6, 0.0)]
    table = spark.createDataFrame(rows, "image_id long, shape_id int, radius double, cx int, cy int, gratio double, plane_angle double")
    images = spark.createDataFrame([(0, 1000, 1000)], "image_id long, height int, width int")
    pixels = masks.split_classes(geometry.rasterize(table, images))
    out = measure_objects(
        pixels.filter("cls = 'axon'"), images, pixels.filter("cls = 'myelin'"), 0.1
    ).orderBy("label").collect()
    assert [r["image_border_touching"] for r in out] == [True, False]
    box = ["bbox_min_y", "bbox_min_x", "bbox_max_y", "bbox_max_x"]
    assert [[r[c] for c in box] for r in out] == [[0, 0, 267, 267], [434, 434, 567, 567]]


def test_no_sheath_gives_ratio_one(draw, sizes, spark):
    disc = np.zeros((30, 30), int)
    disc[8:20, 8:20] = 1
    none = spark.createDataFrame([], "image_id long, y int, x int")
    row = measure_objects(draw(disc), sizes((30, 30)), none, 1.0, extent=(30, 30)).first()
    assert (row["gratio"], row["myelin_thickness"], row["myelin_area"]) == (1.0, 0.0, 0.0)


def test_empty_mask_gives_a_typed_empty_table(sizes, spark):
    none = spark.createDataFrame([], "image_id long, y int, x int")
    out = measure_objects(none, sizes((30, 30)), none, 1.0)
    assert out.count() == 0 and len(out.columns) == 22


def test_centroid_outside_every_fibre_has_null_measures(draw, sizes):
    ring = np.zeros((21, 21), int)
    y, x = np.indices(ring.shape) - 10
    ring[(y**2 + x**2 < 81) & (y**2 + x**2 > 25)] = 1
    row = measure_objects(draw(ring), sizes(ring.shape), draw(np.zeros_like(ring)), 1.0, extent=ring.shape).first()
    assert row["gratio"] is None and row["image_border_touching"] is None and row["axon_area"] == ring.sum()


def test_growth_and_flood_modes_agree(slides):
    axon, myelin, images = (d.filter("image_id = 1") for d in slides)
    keep = ["label", "axonmyelin_area", "gratio"]
    a = measure_objects(axon, images, myelin, 1.0).select(keep).orderBy("label").collect()
    b = measure_objects(axon, images, myelin, 1.0, mode="flood").select(keep).orderBy("label").collect()
    assert a == b


def test_filling_holes_gives_unreached_pixels_to_the_fibre(draw, sizes):
    y, x = np.indices((31, 31)) - 15
    d = y**2 + x**2
    axon, ring = (d < 36).astype(int), ((d < 144) & (d > 64)).astype(int)
    args = (draw(axon), sizes((31, 31)), draw(ring), 1.0)
    plain = measure_objects(*args, extent=(31, 31)).first()
    filled = measure_objects(*args, extent=(31, 31), fill_holes=True).first()
    assert plain["axonmyelin_area"] == axon.sum() and filled["axonmyelin_area"] == (d < 144).sum()


def test_nerve_report(draw, sizes, spark):
    nerve = np.zeros((30, 40), int)
    nerve[2:20, 2:15] = 255
    nerve[5:25, 20:38] = 255
    axon, myelin = np.zeros_like(nerve), np.zeros_like(nerve)
    for y, x in ((6, 6), (12, 9), (10, 28), (27, 5)):
        myelin[y - 2 : y + 3, x - 2 : x + 3] = 1
        axon[y - 1 : y + 2, x - 1 : x + 2] = 1
    myelin[axon > 0] = 0
    objects, densities = nerve_report(draw(axon), draw(myelin), draw(nerve), sizes((30, 40)), 0.5, (30, 40))
    documents = nerve_documents(objects, densities, sizes((30, 40)))
    assert sorted(r["fascicle_id"] for r in objects.collect()) == [0, 0, 1]
    doc = documents.first()
    assert doc["total_area"]["value"] == (18 * 13 + 20 * 18) * 0.25
    assert doc["fascicle_areas"]["0"]["axon_density"]["value"] == round(2 / (18 * 13 * 0.25), 5)
    assert doc["fascicle_areas"]["1"]["unit"] == "um^2"
    assert doc["total_axon_density"]["value"] == round(3 / ((18 * 13 + 20 * 18) * 0.25), 5)


def test_one_image_with_most_pixels(spark):
    """A crowded image next to tiny ones gives the same table as on its own."""
    rng = np.random.default_rng(3)
    grid = (rng.random((70, 70)) < 0.45).astype(int)
    rows = [(0, int(y), int(x)) for y, x in zip(*np.nonzero(grid))] + [(i, 1, 1) for i in range(1, 30)]
    mask = spark.createDataFrame(rows, "image_id long, y int, x int")
    images = spark.createDataFrame([(i, 70, 70) for i in range(30)], "image_id long, height int, width int")
    none = spark.createDataFrame([], "image_id long, y int, x int")
    a = measure_objects(mask, images, none, 1.0, tile=16).filter("image_id = 0").orderBy("label").collect()
    b = measure_objects(mask.filter("image_id = 0"), images, none, 1.0, extent=(70, 70)).orderBy("label").collect()
    assert a == b


def test_folder_needs_masks_sizes_and_a_pixel_size(spark, tmp_path):
    from catalog.file_queries import png_bytes
    from segstats.plans.folder import measure_folder

    y, x = np.indices((40, 50))
    axon = ((y - 20) ** 2 + (x - 25) ** 2 < 49) * 255
    ring = (((y - 20) ** 2 + (x - 25) ** 2 < 121) & (axon == 0)) * 255

    def save(folder, masks):
        folder.mkdir(parents=True)
        for end, mask in masks.items():
            (folder / f"a{end}").write_bytes(png_bytes(mask))

    full = {".png": axon, "_seg-axon.png": axon, "_seg-myelin.png": ring, "_seg-axonmyelin.png": axon + ring}
    root = tmp_path / "r"
    save(root / "one", full)
    with pytest.raises(Exception, match="no pixel size"):
        measure_folder(spark, str(root)).objects.collect()
    (root / "one" / "pixel_size_in_micrometer.txt").write_text("0.5")
    save(root / "two", full)
    (root / "two" / "pixel_size_in_micrometer.txt").write_text("2.0")
    found = measure_folder(spark, str(root))
    rows = {r.image_id.split("/")[-2]: r for r in found.objects.collect()}
    totals = {r.image_id.split("/")[-2]: r for r in found.totals.collect()}
    assert rows["two"].axon_diam == pytest.approx(4 * rows["one"].axon_diam) and rows["one"].gratio == rows["two"].gratio
    assert totals["one"].axon_density_mm2 == pytest.approx(16 * totals["two"].axon_density_mm2)
    given = measure_folder(spark, str(root), pixel_size=1.0).objects.collect()
    assert {r.axon_diam for r in given} == {2 * rows["one"].axon_diam}
    save(root / "three", {**full, "_seg-myelin.png": ring[:, :40]})
    with pytest.raises(Exception, match="different sizes"):
        measure_folder(spark, str(root), pixel_size=1.0)
    save(tmp_path / "s", {k: v for k, v in full.items() if k != "_seg-myelin.png"})
    with pytest.raises(Exception, match="missing mask"):
        measure_folder(spark, str(tmp_path / "s"), pixel_size=1.0)
