import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__  # noqa: E402, F401
from segstats.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def draw(spark):
    """Mask pixels from an array or from text rows of 0 and 1, for one image or several."""

    import numpy as np

    def make(*images, value=None):
        rows = []
        for image_id, image in enumerate(images):
            grid = np.array([[int(c) for c in row] for row in image.split()]) if isinstance(image, str) else np.asarray(image)
            for y, x in zip(*np.nonzero(grid)):
                rows.append((image_id, int(y), int(x), int(grid[y, x])))
        df = spark.createDataFrame(rows, "image_id long, y int, x int, v int")
        return df if value else df.drop("v")

    return make


@pytest.fixture(scope="session")
def sizes(spark):
    def make(*shapes):
        rows = [(i, h, w) for i, (h, w) in enumerate(shapes)]
        return spark.createDataFrame(rows, "image_id long, height int, width int")

    return make


def pixel_set(df):
    return {(r["image_id"], r["y"], r["x"]) for r in df.collect()}
