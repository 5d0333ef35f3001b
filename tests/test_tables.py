import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from segstats.constants import SUFFIXES
from segstats.functions import order_stats
from segstats.functions.order_stats import percentiles, ranked
from segstats.functions.scalars import file_extension, fixed, float_to_bits, gray_level, round_exact, round_scaled, to_bits
from segstats.operators import patches
from segstats.operators.components import label_components
from segstats.plans import aggregate, nerve, quality, scoring
from segstats.sources import files, tables


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; few keys hold the rest; values tie and may be missing."""
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"k": np.where(rng.random(4000) < 0.8, 0, rng.integers(1, 6, 4000))})
    frame["v"] = np.round(rng.normal(size=4000), 2)
    frame.loc[rng.random(4000) < 0.05, "v"] = np.nan
    df = spark.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).withColumn("id", F.monotonically_increasing_id())
    return frame, df


@pytest.mark.parametrize("per_task", [10**6, 50])
def test_percentiles_and_ranks_with_a_hot_key(skewed, per_task):
    frame, df = skewed
    points = {"p5": 0.05, "p50": 0.5, "p90": 0.9}
    for r in percentiles(df, ["k"], "v", points, per_task).collect():
        data = frame.v[frame.k == r["k"]].dropna()
        assert [r[n] for n in points] == pytest.approx([np.percentile(data, 100 * p) for p in points.values()])
    got = ranked(df.filter("v IS NOT NULL"), ["k"], {"v": "v"}, per_task).toPandas().sort_values(["k", "v"])
    assert (got.v_rank == got.groupby("k").v.rank(method="min")).all()
    assert np.allclose(got.v_pct, got.groupby("k").v.rank(pct=True))


def test_rounding(spark):
    values = [0.125, 0.375, 2.675, 1.005, 0.0125, 0.0375, 64.25, 1 / 3, 2.5, 0.15, 7.0, 0.0625]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (0, 1, 2, 3, 5):
        rows = df.select("v", round_exact(F.col("v"), places).alias("a"), round_scaled(F.col("v"), places).alias("b")).collect()
        assert [r["a"] for r in rows] == [round(v, places) for v in values]
        assert [r["b"] for r in rows] == [float(np.round(v, places)) for v in values]
    assert [r[0] for r in df.select(fixed(F.col("v"), 1)).collect()] == [f"{v:.1f}" for v in values]


def test_statistics_per_bin_match_pandas(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"subject_id": rng.choice(["a", "b"], 500), "axon_diam": rng.uniform(0.2, 1.6, 500)})
    frame["gratio"] = rng.uniform(0.5, 0.9, 500)
    frame["myelin_thickness"] = frame.axon_diam / 2 * (1 / frame.gratio - 1)
    rows = aggregate.binned_statistics(spark.createDataFrame(frame)).collect()
    assert len(rows) == 2 * 3 * 5
    edges = [0.5, 1, 1.25, 1.5, 1.75, np.inf]
    frame["bin"] = pd.cut(frame.axon_diam, edges, right=False, labels=["0.5-1", "1-1.25", "1.25-1.5", "1.5-1.75", "1.75-"])
    columns = {"Axon Diameter": "axon_diam", "G-Ratio": "gratio", "Myelin Thickness": "myelin_thickness"}
    for r in rows:
        data = frame[(frame.subject_id == r["subject_id"]) & (frame.bin == r["bin"])][columns[r["metric"]]]
        if data.empty:
            assert r["mean"] is None and r["median"] is None
        else:
            expected = [round(x, 2) for x in (data.mean(), data.std(), data.min(), data.max(), data.median())]
            assert [r[c] for c in ("mean", "std", "min", "max", "median")] == pytest.approx(expected)
    wide = aggregate.wide_statistics(aggregate.binned_statistics(spark.createDataFrame(frame.drop(columns="bin"))))
    assert wide.count() == 2 * 3 * 5 and "1.75-" in wide.columns


def test_outliers(spark):
    df = spark.createDataFrame([("s", g) for g in (None, 0.7, 1.0, 1.2)], "subject_id string, gratio double")
    assert aggregate.drop_outliers(df).count() == 1
    assert aggregate.drop_outliers(df, gratio_null=False).count() == 2
    assert aggregate.drop_outliers(df, gratio_sup=False).count() == 3
    assert aggregate.count_outliers(df, ["subject_id"]).first()["n_dropped"] == 3


def test_quality(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"image_id": 0, "label": np.arange(1, 201), "note": 1, "axon_diam": rng.gamma(2, size=200).round(2),
                          "gratio": rng.uniform(0.4, 1.05, 200), "myelin_thickness": rng.uniform(0, 1, 200)})
    frame["axon_area"], frame["myelin_area"] = frame.axon_diam**2, frame.myelin_thickness + 0.1
    frame.loc[::17, "gratio"] = np.nan
    df = spark.createDataFrame(frame).withColumn("gratio", F.when(~F.isnan("gratio"), F.col("gratio")))
    assert quality.numeric_metrics(df) == ["axon_diam", "gratio", "myelin_thickness", "axon_area", "myelin_area"]
    row = quality.summary(df, ["image_id"], ["gratio"]).first()
    g = frame.gratio.dropna()
    assert [row["mean"], row["std"], row["iqr"]] == pytest.approx([g.mean(), g.std(ddof=0), np.subtract(*np.percentile(g, [75, 25]))])
    assert row["n_missing"] == frame.gratio.isna().sum()
    hist = quality.histogram(df, ["image_id"], ["axon_diam"]).orderBy("bin").collect()
    count, edges = np.histogram(frame.axon_diam, bins="fd")
    assert [r["n"] for r in hist] == list(count) and [r["low"] for r in hist] == pytest.approx(list(edges[:-1]))
    flagged = {r["label"] for r in quality.flag_objects(df, ["image_id"]).collect()}
    rule = (frame.gratio >= 0.99) | (frame.axon_area <= frame.axon_area.min() * 5) | (frame.myelin_area <= frame.myelin_area.min() * 5)
    assert flagged == set(frame.label[rule])
    ranks = quality.ranks(df, ["image_id"]).toPandas().set_index("label").sort_index()
    frame = frame.set_index("label")
    assert (ranks.diameter_rank == frame.axon_diam.rank(method="min")).all()
    assert (ranks.gratio_rank == frame.gratio.rank(method="min").fillna(-1)).all()
    pct = frame.gratio.fillna(-1).rank(pct=True) * 100
    assert list(ranks.gratio_percentile) == [f"{v:.1f}" for v in pct]
    assert ranks.diameter_of.iloc[0] == f"{int(ranks.diameter_rank.iloc[0])} of 200"


def test_perfect_prediction(draw, sizes):
    grid = np.zeros((40, 40), int)
    grid[3:12, 3:14] = 1
    grid[20:36, 18:33] = 1
    mask, images = draw(grid), sizes((40, 40))
    s = scoring.pixel_scores(scoring.confusion(mask, mask, images)).first()
    assert [s[c] for c in ("sensitivity", "precision", "specificity", "accuracy", "f1", "dice", "jaccard")] == [1.0] * 7
    assert (s["fn_rate"], s["fp_rate"]) == (0.0, 0.0)
    labels = label_components(mask, 2, extent=(40, 40))
    d = scoring.detection_scores(labels, labels, images).first()
    assert (d["sensitivity"], d["precision"], d["diffusion"]) == (1.0, 1.0, 0.0)
    dist = scoring.dice_distribution(scoring.object_dice(labels, labels, 5), ["image_id"]).first()
    assert (dist["mean"], dist["std"], dist["percent_5"]) == (1.0, 0.0, 1.0)
    assert scoring.directed_hausdorff(mask, mask, images).first()["hausdorff"] == 0
    assert scoring.row_hausdorff(mask, mask, images).first()["hausdorff"] == 0


def test_imperfect_prediction(draw, sizes):
    rng = np.random.default_rng(8)
    a, b = (rng.random((2, 24, 30)) < 0.5).astype(int)
    row = scoring.confusion(draw(a), draw(b), sizes((24, 30))).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == ((a & b).sum(), (a > b).sum(), (b > a).sum(), ((a | b) == 0).sum())
    found = scoring.row_hausdorff(draw(a), draw(b), sizes((24, 30)), radius=1).first()["hausdorff"]

    def inner(m):
        pad = np.pad(m, 1, constant_values=1)
        full = pad[1:-1, 1:-1] & pad[:-2, 1:-1] & pad[2:, 1:-1] & pad[1:-1, :-2] & pad[1:-1, 2:]
        return m & (full == 0)

    ca, cb = inner(a), inner(b)
    assert found == pytest.approx(np.sqrt((ca[:, None, :] != cb[None]).sum(2).min(1).max()))
    pa, pb = np.argwhere(ca), np.argwhere(cb)
    near = np.sqrt(((pa[:, None] - pb[None]) ** 2).sum(2).min(1).max())
    assert scoring.directed_hausdorff(draw(a), draw(b), sizes((24, 30)), 1).first()["hausdorff"] == pytest.approx(near)


def test_both_masks_empty(spark, sizes):
    none = spark.createDataFrame([], "image_id long, y int, x int")
    counts = scoring.confusion(none, none, sizes((5, 5)))
    assert scoring.global_dice(counts).first()["dice"] == 1.0
    assert scoring.pixel_scores(counts).first()["dice"] is None


def test_extra_detections(draw, sizes):
    """Two predicted pieces in one true object: one match, one extra, plus a false alarm."""
    true = np.zeros((20, 30), int)
    true[2:10, 2:20] = 1
    true[14:18, 2:6] = 1
    pred = np.zeros_like(true)
    pred[3:8, 3:7] = 1
    pred[3:8, 12:16] = 1
    pred[13:18, 20:25] = 1
    pred[0, 29] = 1  # below the area limit
    labels = [label_components(draw(m), 2, extent=true.shape) for m in (pred, true)]
    d = scoring.detection_scores(*labels, sizes(true.shape)).first()
    assert (d["p"], d["tp"], d["fp"], d["extra"]) == (2, 1, 1, 1)
    assert (d["sensitivity"], d["precision"], d["diffusion"]) == (0.5, 0.5, 0.5)


def png(path, array, depth=8):
    """Minimal PNG writer for fixtures."""
    array = np.asarray(array, np.uint8 if depth == 8 else ">u2")
    h, w = array.shape[:2]
    kind = {2: 0, 3: {2: 4, 3: 2, 4: 6}.get(array.shape[-1])}[array.ndim]
    raw = b"".join(b"\0" + row.tobytes() for row in array)

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    head = struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_folder(spark, tmp_path):
    rng = np.random.default_rng(0)
    gray = rng.integers(0, 256, (6, 9))
    colour = rng.integers(0, 256, (5, 4, 3))
    folder = tmp_path / "s1"
    folder.mkdir()
    png(folder / "a.png", gray)
    png(folder / "b.png", colour)
    for role in ("axon", "myelin", "axonmyelin"):
        png(folder / f"a{SUFFIXES[role]}", gray)
    (folder / "notes.txt").write_text("x")
    (folder / "pixel_size_in_micrometer.txt").write_text("0.07\n")
    listing = files.list_files(spark, str(tmp_path)).cache()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in files.list_images(listing).collect()) == ["a.png", "b.png"]
    assert files.ready_images(listing).select("stem").collect()[0][0] == "a"
    assert files.missing_masks(listing).count() == 0
    assert files.require_masks(listing).count() == 2
    heads = {r["path"].rsplit("/", 1)[1]: r for r in files.read_headers(spark, str(tmp_path)).collect()}
    assert (heads["a.png"]["height"], heads["a.png"]["width"], heads["a.png"]["channels"]) == (6, 9, 1)
    assert heads["b.png"]["channels"] == 3
    size = files.with_pixel_size(files.ready_images(listing), files.read_pixel_sizes(spark, str(tmp_path))).first()
    assert size["um_per_px"] == 0.07
    pixels = files.read_pixels(spark, str(tmp_path)).withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))
    got = np.zeros((6, 9), int)
    for r in pixels.filter("name = 'a.png'").collect():
        got[r["y"], r["x"]] = r["v"]
    assert (got == gray).all()
    luma = colour @ np.array([0.299, 0.587, 0.114])
    luma = np.floor((luma - luma.min()) / (luma.max() - luma.min()) * 255 + 0.499999999)
    assert all(abs(r["v"] - luma[r["y"], r["x"]]) <= 1 for r in pixels.filter("name = 'b.png'").collect())
    deep = tmp_path / "deep"
    deep.mkdir()
    png(deep / "c.png", gray.astype(np.uint16) * 257, depth=16)
    assert files.read_headers(spark, str(deep)).first()["bit_depth"] == 16
    with pytest.raises(Exception, match="more than 8 bits"):
        files.read_pixels(spark, str(deep)).collect()


def test_bits_of_constant_images(spark):
    rows = [(255.0, 255.0, 255.0), (300.0, 300.0, 300.0), (-4.0, -4.0, -4.0), (0.5, 0.5, 0.5), (1.0, 0.0, 1.0), (7.0, 5.0, 9.0)]
    df = spark.createDataFrame(rows, "v double, lo double, hi double")
    eight = [r[0] for r in df.select(float_to_bits(F.col("v"), F.col("lo"), F.col("hi"))).collect()]
    assert eight == [255, 255, 0, 127, 255, 127]
    for v, low, high in rows[:4]:
        assert files.to_eight_bits(np.array([[v]]))[0, 0] == eight[rows.index((v, low, high))]
    deep = spark.createDataFrame([(0,), (255,), (128,)], "v int").select(to_bits(F.col("v"), 8, 16), to_bits(F.col("v") * 257, 16, 8)).collect()
    assert [tuple(r) for r in deep] == [(0, 0), (65_535, 255), (32_896, 128)]


def test_bad_pixel_size_and_missing_mask_fail(spark):
    texts = spark.createDataFrame([("/d/pixel_size_in_micrometer.txt", "&&&")], "path string, value string")
    with pytest.raises(Exception, match="invalid pixel size"):
        files.parse_pixel_sizes(texts).collect()
    listing = spark.createDataFrame([("/d/a.png",), ("/d/a_seg-axonmyelin.png",)], "path string")
    with pytest.raises(Exception, match="missing mask"):
        files.require_masks(listing).collect()
    images = spark.createDataFrame([("/d", "a")], "dir string, stem string")
    assert files.with_pixel_size(images, given=0.2).first()["um_per_px"] == 0.2


def test_every_output_suffix_is_skipped(spark):
    df = spark.createDataFrame([(f"/d/a{s}",) for s in SUFFIXES.values()] + [("/d/a.png",)], "path string")
    assert [r["path"] for r in files.list_images(df).collect()] == ["/d/a.png"]


def test_extensions(spark):
    names = ["a_zf-1.25.ome.tiff", "A.PNG", "b.Tif", "c.txt", "d.jpeg"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r[0] for r in df.select(file_extension(F.col("p"))).collect()] == [".ome.tiff", ".png", ".tif", None, ".jpeg"]


def test_gray_levels(spark):
    df = spark.createDataFrame([([7.0],), ([7.0, 9.0],), ([10.0, 20.0, 30.0],), ([10.0, 20.0, 30.0, 99.0],)], "c array<double>")
    got = [r[0] for r in df.select(gray_level(F.col("c"), blue_first=False)).collect()]
    assert got == pytest.approx([7, 7, 18.15, 18.15])


def test_input_check(spark):
    df = spark.createDataFrame([("/d/a.png", 1), ("/d/b.tif", 1), ("/d/c.tif", 3)], "path string, channels int")
    assert [r["target"] for r in files.check_inputs(df, ".png", 1).collect()] == ["/d/a.png", "/d/b.png", "/d/c_grayscale.png"]
    with pytest.raises(Exception, match="expected 3 channels"):
        files.check_inputs(df, ".png", 3).collect()


def test_object_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.5, 2.5, None, 3.0, "kept")], "y0 double, x0 double, gratio double, axon_diam double, note string")
    tables.write_objects(df, str(tmp_path / "t"), "csv")
    # a task without rows may still write a file with the header alone
    text = [line for part in (tmp_path / "t").glob("*.csv") for line in part.read_text().splitlines()]
    assert set(text) == {"x0 (px),y0 (px),gratio,axon_diam (um),note", "2.5,1.5,NaN,3.0,kept"}
    back = tables.read_objects(spark, str(tmp_path / "t"))
    assert back.columns == ["x0", "y0", "gratio", "axon_diam", "note"]
    assert tuple(back.first()) == (2.5, 1.5, None, 3.0, "kept")


def test_subject_tree(spark, tmp_path):
    for subject, image, g in (("s1", "a", 0.6), ("s1", "b", 0.8), ("s2", "c", "NaN"), ("morphometrics_agg", "x", 0.1)):
        folder = tmp_path / subject
        folder.mkdir(exist_ok=True)
        (folder / f"{image}_axon_morphometrics.csv").write_text(f",x0 (px),gratio,axon_diam (um)\n0,1.0,{g},2.0\n")
        (folder / f"{image}_seg-axonmyelin.png").write_bytes(b"x")
    (tmp_path / "s2" / "c_axon_morphometrics.csv").unlink()
    (tmp_path / "s2" / "d_axon_morphometrics.csv").write_text(",x0 (px),gratio,axon_diam (um)\n0,1.0,NaN,2.0\n")
    pooled = tables.read_subject_tree(spark, str(tmp_path))
    assert pooled.groupBy("subject_id").count().orderBy("subject_id").collect() == [("s1", 2), ("s2", 1)]
    assert pooled.filter("subject_id = 's2'").first()["gratio"] is None
    assert "_c0" not in pooled.columns
    verdict = {r["subject_id"]: r["complete"] for r in files.completeness(files.list_files(spark, str(tmp_path))).collect()}
    assert verdict == {"s1": True, "s2": False}


def test_tables_with_other_columns_are_aligned_by_name(spark, tmp_path):
    for subject, body in (
        ("s1", "x0 (px),y0 (px),gratio,axon_diam (um)\n1,2,0.7,3.5\n"),
        ("s2", "x0 (px),y0 (px),axon_diam (um),solidity,note\n5,6,9.5,0.9,\"a, b\"\n7,8,,NaN,\n"),
        ("s3", ""), ("s4", "axon_diam (um)\r\n4.5\r\n"),
    ):
        (tmp_path / subject).mkdir()
        (tmp_path / subject / "i_axon_morphometrics.csv").write_text(body)
    pooled = tables.read_subject_tree(spark, str(tmp_path))
    rows = sorted((r.subject_id, r.x0, r.gratio, r.axon_diam, r.solidity, r.note) for r in pooled.filter("axon_diam IS NOT NULL").collect())
    assert rows == [
        ("s1", 1.0, 0.7, 3.5, None, None), ("s2", 5.0, None, 9.5, 0.9, "a, b"), ("s4", None, None, 4.5, None, None)
    ]
    assert pooled.count() == 4
    (tmp_path / "none").mkdir()
    assert tables.read_objects(spark, str(tmp_path / "none")).count() == 0


def test_labels_are_never_cut(spark, tmp_path):
    labels = spark.createDataFrame([(0, 0, 0, 1, 65_537)], "image_id long, y int, x0 int, x1 int, label long")
    with pytest.raises(Exception, match="does not fit"):
        tables.write_raster(labels, str(tmp_path / "a"), bits=16)
    tables.write_raster(labels, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).first().label == 65_537


def test_nerve_documents(spark, sizes, tmp_path):
    areas = spark.createDataFrame([(0, 0, 4.0), (0, 1, 9.0)], "image_id long, fascicle long, area double")
    docs = nerve.nerve_document(areas, sizes((5, 5), (5, 5)))
    stored = docs.withColumn("image_id", F.col("image_id").cast("string"))
    tables.write_nerve(stored, str(tmp_path / "n"))
    back = {r["image_id"]: r for r in tables.read_nerve(spark, str(tmp_path / "n")).collect()}
    assert back["1"]["total_area"]["value"] == 0 and back["0"]["total_area"]["value"] == 13.0
    broken = tables.parse_nerve(spark.createDataFrame([("0", '{"fascicle_areas": {}}')], "image_id string, document string"))
    axons = spark.createDataFrame([("0", -1)], "image_id string, fascicle_id long")
    with pytest.raises(Exception, match="total_area not found"):
        nerve.add_densities(broken, axons).collect()


@pytest.mark.parametrize("shape,patch,step", [((10, 13), (4, 4), 0.5), ((9, 9), (4, 5), 1.0), ((3, 6), (4, 4), 0.5)])
def test_tiles_cover_every_pixel_and_stitch_back(spark, draw, sizes, shape, patch, step):
    def sum_fold():
        def predict(batch):
            flat = batch.reshape(len(batch), -1)
            return {"c0": np.full_like(flat, 50.0), "c1": flat}

        return predict

    grid = np.arange(1, shape[0] * shape[1] + 1).reshape(shape)
    pixels, images = draw(grid, value=True), sizes(shape)
    cells = patches.cut(pixels, images, patch, step)
    inside = cells.filter(f"y < {shape[0]} AND x < {shape[1]}")
    assert inside.select("y", "x").distinct().count() == grid.size
    spots = {(r["oy"], r["ox"]) for r in patches.windows(images, patch, step).collect()}
    assert {(r["oy"], r["ox"]) for r in cells.select("oy", "ox").distinct().collect()} == spots
    out = patches.segment(pixels, images, [sum_fold, sum_fold], 2, patch, step).collect()
    assert len(out) == grid.size
    for r in out:
        v = grid[r["y"], r["x"]]
        assert r["c1"] == pytest.approx(v) and r["cls_id"] == (1 if v > 50 else 0)


def test_tile_step_bounds(spark, sizes):
    with pytest.raises(ValueError):
        patches.windows(sizes((8, 8)), (4, 4), 0.0)


def test_ranks_where_most_values_are_missing(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"s": np.where(rng.random(800) < 0.8, 0, 1), "line": np.arange(800)})
    for name in ("axon_diam", "myelin_thickness", "gratio"):
        frame[name] = np.round(rng.random(800), 2)
        frame.loc[(frame["s"] == 0) & (rng.random(800) < 0.9), name] = np.nan
    frame.loc[frame["s"] == 1, "gratio"] = np.nan
    df = spark.createDataFrame(frame)
    for name in ("axon_diam", "myelin_thickness", "gratio"):
        df = df.withColumn(name, F.when(~F.isnan(name), F.col(name)))
    got = quality.ranks(df, ["s"]).toPandas().sort_values("line").reset_index(drop=True)
    total = frame.groupby("s")["line"].transform("size")
    for short, name in (("diameter", "axon_diam"), ("thickness", "myelin_thickness"), ("gratio", "gratio")):
        filled = frame[name].fillna(-1.0).groupby(frame["s"])
        rank = filled.rank(method="min").astype(int)
        if short == "gratio":
            present = frame["gratio"].groupby(frame["s"]).rank(method="min")
            rank = present.fillna(-1).astype(int)
        assert (got[f"{short}_rank"] == rank).all()
        assert (got[f"{short}_of"] == rank.astype(str) + " of " + total.astype(str)).all()
        assert np.allclose(got[f"{short}_percentile"].astype(float), filled.rank(pct=True) * 100, atol=0.051)
    stats = quality.summary(df, ["s"], ["axon_diam", "gratio"]).toPandas().set_index(["s", "metric"])
    for (s, name), row in stats.iterrows():
        v = frame.loc[frame["s"] == s, name].dropna()
        assert row["n"] == len(v) and row["n_missing"] == (frame["s"] == s).sum() - len(v)
        if len(v):
            assert np.allclose([row["mean"], row["std"], row["median"]], [v.mean(), v.std(ddof=0), v.median()])


def test_ranks_of_bounded_keys_write_nothing(spark, monkeypatch):
    """Keys that fit a task are ranked there, with the ranks that counts give."""
    df = spark.range(600).selectExpr("id % 3 AS s", "id AS line", *[
        f"CASE WHEN id % {k} > 0 THEN id * 37 % {k + 40} / 8D END AS {name}" for k, name in ((5, "axon_diam"), (7, "myelin_thickness"), (4, "gratio"))
    ])
    monkeypatch.setattr(quality, "materialize", None)
    bounded = sorted(quality.ranks(df, ["s"]).collect())
    monkeypatch.undo()
    monkeypatch.setattr(quality, "ROWS_PER_TASK", 0, raising=False)
    assert bounded == sorted(quality.ranks(df, ["s"]).collect())


def test_missing_masks_in_one_grouping(spark):
    """A row for each source image of a name, and no join of the listing with itself."""
    names = ["a.png", "a.TIF", "a_seg-nerve.png", "a_seg-axon.png", "b.png", "b_seg-axon.png", "c_seg-nerve.png", "d.jpg", "d_seg-nerve.png", "d_seg-axon.png", "d_seg-myelin.png"]
    listing = spark.createDataFrame([(f"/d/{n}",) for n in names] + [(None,)], "path string")
    found = files.missing_masks(listing, "nerve")
    assert sorted(tuple(r) for r in found.collect()) == [("/d", "a", "myelin")] * 2
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_histogram_of_bounded_keys_writes_nothing(spark, monkeypatch):
    df = spark.range(600).selectExpr("id % 3 AS s", "CASE WHEN id % 5 > 0 THEN id * 37 % 101 / 8D END AS a", "CASE WHEN id % 3 > 0 THEN id * id % 89 / 4D END AS b")
    monkeypatch.setattr(order_stats, "materialize", None)
    bounded = sorted(map(repr, (tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in quality.histogram(df, ["s"], ["a", "b"]).collect())))
    monkeypatch.undo()
    monkeypatch.setattr(quality, "ROWS_PER_TASK", 0, raising=False)
    counted = quality.histogram(df, ["s"], ["a", "b"])
    assert bounded == sorted(map(repr, (tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in counted.collect())))


def test_summary_of_bounded_keys_writes_nothing(spark, monkeypatch):
    df = spark.range(600).selectExpr("id % 3 AS s", "CASE WHEN id % 5 > 0 THEN id * 37 % 101 / 8D END AS a", "CASE WHEN id % 3 > 0 THEN id * id % 89 / 4D END AS b")
    monkeypatch.setattr(order_stats, "materialize", None)
    bounded = sorted(map(repr, (tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in quality.summary(df, ["s"], ["a", "b"]).collect())))
    monkeypatch.undo()
    monkeypatch.setattr(quality, "ROWS_PER_TASK", 0, raising=False)
    counted = quality.summary(df, ["s"], ["a", "b"])
    assert bounded == sorted(map(repr, (tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in counted.collect())))


@pytest.mark.parametrize("piece,block", [(1, 3), (5, 2), (13, 7), (1000, 4)])
def test_pieces_of_a_file_have_each_line_once(tmp_path, monkeypatch, piece, block):
    text = b"a,b\r\n1,2\n\n33333333333333,4\r\n5,6\n7,\xc3\xa9\n8,9"
    (tmp_path / "t.csv").write_bytes(text)
    monkeypatch.setattr(tables, "BLOCK", block)
    got = [v for start in range(0, len(text), piece) for lines in tables._text_lines(str(tmp_path / "t.csv"), start, start + piece) for v in lines if v]
    assert got == [v for v in text.splitlines() if v]


def test_lines_meet_their_header_without_a_join(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfgratio,note\r\n0.5,x\r\n")
    (tmp_path / "b.csv").write_bytes(b"note,gratio\ny,0.25\n\xff,NaN\n")
    back = tables.read_objects(spark, str(tmp_path))
    assert sorted(tuple(r) for r in back.filter("gratio > 0").collect()) == [(0.25, "y"), (0.5, "x")] and back.count() == 3
    assert "Join" not in back._jdf.queryExecution().optimizedPlan().toString()
