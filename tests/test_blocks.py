"""Windows over pixel blocks against plain slices."""

import numpy as np
import pytest

from segstats.operators import blocks, patches

SHAPES = [(10, 13), (3, 6), (21, 17)]


def grids():
    rng = np.random.default_rng(3)
    return [rng.integers(0, 100, s).astype(np.float32) for s in SHAPES]


def plain(grid, patch, step, fold):
    """Mean scores over all windows, class by class."""
    h, w = grid.shape
    padded = np.zeros((max(h, patch[0]), max(w, patch[1])), np.float32)
    padded[:h, :w] = grid
    total, count = np.zeros((2, *padded.shape)), np.zeros(padded.shape)
    for oy in blocks.origins(h, patch[0], step):
        for ox in blocks.origins(w, patch[1], step):
            place = np.s_[oy:oy + patch[0], ox:ox + patch[1]]
            scores = fold()(padded[place][None])
            for k in range(2):
                total[(k, *place)] += np.asarray(scores[f"c{k}"]).reshape(patch)
            count[place] += 1
    return (total / count)[:, :h, :w]


def toy_fold():
    """A fold that goes to the workers by value."""

    def fold():
        def predict(batch):
            flat = batch.reshape(len(batch), -1).astype(float)
            where = np.arange(flat.shape[1])
            return {"c0": flat * 2 + where, "c1": flat.sum(axis=1, keepdims=True) - where}

        return predict

    return fold


@pytest.mark.parametrize("patch,step,block", [((4, 4), 0.5, 5), ((4, 5), 1.0, 4), ((7, 3), 0.3, 64), ((6, 6), 0.5, 2)])
def test_scores_match_plain_windows(spark, patch, step, block):
    rows = [(i, *g.shape, g.ravel().tolist()) for i, g in enumerate(grids())]
    images = spark.createDataFrame(rows, "image_id long, height int, width int, values array<float>")
    made = blocks.image_blocks(images, block)
    assert max(max(r.h, r.w) for r in made.collect()) <= block
    slices = blocks.window_slices(made, patch, step)
    if block >= max(patch):
        assert slices.groupBy("image_id", "oy", "ox").count().agg({"count": "max"}).first()[0] <= 4
    got = blocks.class_pixels(blocks.segment_blocks(made, toy_fold(), 2, patch, step, 3, block), 2).toPandas()
    for i, grid in enumerate(grids()):
        expected, own = plain(grid, patch, step, toy_fold()), got[got.image_id == i]
        assert len(own) == grid.size
        for k in range(2):
            assert np.allclose(own[f"c{k}"], expected[k][own.y, own.x])
        assert (own.cls_id == expected.argmax(axis=0)[own.y, own.x]).all()


def test_blocks_of_pixels_and_of_arrays_are_the_same(spark, draw, sizes):
    grid = grids()[2].astype(int) + 1
    images = spark.createDataFrame([(0, *grid.shape, grid.ravel().astype(float).tolist())], "image_id long, height int, width int, values array<float>")
    a = {(r.top, r.left): (r.h, r.w, bytes(r.data)) for r in blocks.image_blocks(images, 6).collect()}
    b = {(r.top, r.left): (r.h, r.w, bytes(r.data)) for r in blocks.to_blocks(draw(grid, value=True), sizes(grid.shape), 6).collect()}
    assert a == b and len(a) == 12
    assert blocks.to_blocks(draw(grid, value=True).limit(0), sizes(grid.shape), 6).count() == 0


def test_no_row_per_pixel_is_shuffled(spark):
    images = spark.createDataFrame([(0, 8, 8, [1.0] * 64)], "image_id long, height int, width int, values array<float>")
    plan = patches.segment(blocks.image_blocks(images, 8), images, [toy_fold()], 2, (4, 4), block=8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Generate" not in plan
    with pytest.raises(ValueError):
        blocks.window_slices(blocks.image_blocks(images), (4, 4), 0.0)
