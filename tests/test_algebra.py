"""Mask algebra on runs against pixel sets."""

import numpy as np
import pytest
from conftest import pixel_set
from pyspark.sql import functions as F

from segstats.operators import masks
from segstats.operators.algebra import n_pixels, overlap_lengths, sweep
from segstats.operators.runs import as_pixels, complement, compress
from segstats.plans.scoring import confusion


def random_runs(spark, seed, width=700, images=2, extra=False):
    """Runs that cross tile borders; touching, repeated and overlapping ones unless they carry a value."""
    rng = np.random.default_rng(seed)
    rows = []
    for image in range(images):
        for y in range(6):
            at = 0
            while at < width:
                x0 = at + int(rng.integers(0, 60))
                x1 = x0 + int(rng.integers(0, 300 if rng.random() < 0.2 else 12))
                if x0 < width:
                    rows.append((image, y, x0, min(x1, width - 1), int(rng.integers(1, 9))))
                at = x1 + 1 if extra else max(x0, x1 - 5)
    frame = spark.createDataFrame(rows, "image_id long, y int, x0 int, x1 int, label long")
    return frame if extra else frame.drop("label")


def pixels(runs):
    return pixel_set(as_pixels(runs))


def test_operations_match_sets(spark):
    a, b, c = (random_runs(spark, k) for k in (1, 2, 3))
    pa, pb, pc = pixels(a), pixels(b), pixels(c)
    assert pixels(masks.clip(a, b)) == pa & pb
    assert pixels(masks.symmetric_difference(a, b)) == pa ^ pb
    first, second, overlap = masks.remove_overlap(a, b, 1)
    assert (pixels(first), pixels(second), pixels(overlap)) == (pa, pb - pa, pa & pb)
    merged = masks.merge_masks(a, b)
    assert pixels(merged.filter("v = 127")) == pb and pixels(merged.filter("v = 255")) == pa - pb
    three = sweep({"a": a, "b": b, "c": c})
    assert as_pixels(three).count() == len(pa | pb | pc)
    assert pixels(three.filter("a AND b AND NOT c")) == (pa & pb) - pc
    count = three.agg(n_pixels(F.col("a") & F.col("c")).alias("n"), n_pixels().alias("all")).first()
    assert (count["n"], count["all"]) == (len(pa & pc), len(pa | pb | pc))


def test_columns_and_labels_come_along(spark):
    a, b = random_runs(spark, 4, extra=True), random_runs(spark, 5, extra=True)
    la = {(r.image_id, r.y, r.x): r.label for r in as_pixels(a).collect()}
    lb = {(r.image_id, r.y, r.x): r.label for r in as_pixels(b).collect()}
    got = {(r.image_id, r.y, r.x): r.label for r in as_pixels(masks.clip(a, b.drop("label"))).collect()}
    assert got == {k: v for k, v in la.items() if k in lb}
    expected = {}
    for k in la.keys() & lb.keys():
        expected[k[0], la[k], lb[k]] = expected.get((k[0], la[k], lb[k]), 0) + 1
    assert {(r.image_id, r.label, r.true_label): r.common for r in overlap_lengths(a, b).collect()} == expected


def test_pixels_and_runs_may_meet(spark, draw):
    a, b = draw("110011 111111"), compress(draw("011000 000111"))
    assert pixel_set(masks.clip(a, b)) == {(0, 0, 1), (0, 1, 3), (0, 1, 4), (0, 1, 5)}
    assert masks.clip(a, b).columns == a.columns and "x0" in masks.clip(b, a).columns
    empty = a.limit(0)
    assert masks.clip(a, empty).count() == 0 and pixel_set(masks.symmetric_difference(a, empty)) == pixel_set(a)
    assert sweep({"a": empty, "b": empty}).count() == 0


def test_complement_and_compress_of_overlapping_runs(spark, sizes):
    a = random_runs(spark, 6)
    pa = pixels(a)
    every = {(i, y, x) for i in range(2) for y in range(6) for x in range(700)}
    assert pixels(complement(a, sizes((6, 700), (6, 700)))) == every - pa
    runs = compress(a)
    assert pixels(runs) == pa and as_pixels(runs).count() == len(pa)
    ends = {(r.image_id, r.y, r.x1 + 1) for r in runs.collect()}
    assert not ends & {(r.image_id, r.y, r.x0) for r in runs.collect()}


@pytest.mark.parametrize("by", [None, "cls"])
def test_confusion_by_runs(spark, sizes, by):
    frames = [random_runs(spark, k).distinct() for k in (7, 8)]
    if by:
        frames = [f.withColumn("cls", F.when(F.col("y") % 2 == 0, "axon").otherwise("myelin")) for f in frames]
    p, t = (pixels(f) for f in frames)
    for r in confusion(*frames, sizes((6, 700), (6, 700)), by, ("axon", "myelin") if by else ()).collect():
        own = [{k for k in s if k[0] == r.image_id and (not by or (k[1] % 2 == 0) == (r.cls == "axon"))} for s in (p, t)]
        assert (r.tp, r.fp, r.fn) == (len(own[0] & own[1]), len(own[0] - own[1]), len(own[1] - own[0]))
        assert r.tn == 4200 - len(own[0] | own[1])


def test_only_runs_are_shuffled(spark):
    a, b = random_runs(spark, 9), random_runs(spark, 10)
    plan = masks.clip(a, b)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "sequence(x0" not in plan
