"""Every registered query against its SQL (a quick part by default, all with SEGSTATS_ALL=1)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUICK = [
    "components_diagonal", "components_by_value", "region_table", "region_solidity", "fibre_instances", "object_table_ellipse",
    "metrics_at_points", "tile_segmentation", "image_totals", "nerve_document", "detection_scores",
    "binned_statistics", "metric_histogram", "object_ranks", "missing_masks", "stored_object_table", "slide_components",
    "subject_tree", "slide_fractions", "pixel_scores_slide", "slide_perimeter", "slide_distance", "slide_contour", "fibre_flood", "fibre_flood_cover", "folder_objects", "nerve_report_densities", "stored_raster", "erosion", "contour", "clip_to_nerve", "mask_complement", "fibre_arrival", "slide_merged_masks", "slide_mask_algebra", "header_shapes_all", "class_report",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("SEGSTATS_ALL") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    return tuple(plain(v) for v in value) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    assert got == expected


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 500


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
