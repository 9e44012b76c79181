import duckdb
import pandas as pd
import pytest

from platen.operators import objects
from platen.plans import queries

SF = "/root/testdata/sf0.001"
RECTANGLES = ["min_area_rect", "body_rect", "rectangularity", "polygon_measures", "unclip_rect", "box_score", "hole_count", "iou_merge", "angle_decision"]
TABLES = ["lineitem", "events", "embeddings", "pages"]


def same(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> bool:
    names = sorted(spark_rows.columns)
    assert names == sorted(sql_rows.columns)
    key = lambda df: sorted(map(repr, ([None if pd.isna(v) else (round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v) for v in row] for row in df[names].astype(object).values.tolist())))
    return key(spark_rows) == key(sql_rows)


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES) - set(RECTANGLES)))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert same(queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df())


def test_labels_touching_diagonally_and_areas(spark):
    rows = [(1, y, x) for y, x in [(0, 0), (1, 1), (0, 2), (3, 3), (5, 0), (5, 1)]]
    labelled = objects.label_components(spark.createDataFrame(rows, "img long, y int, x int"), 8)
    found = [(r.label, r.area) for r in objects.objects(labelled).orderBy("obj_idx").collect()]
    assert found == [(0, 3), (40, 2), (27, 1)]


def test_background_is_what_no_mask_covers_labelled(spark):
    dark = {(r.img, r.y, r.x) for r in queries.alpha_raster(spark, SF).where(f"alpha < {queries.CUTOFF}").collect()}
    expected, left = {}, set(dark)
    for img, y, x in sorted(dark):  # the first pixel of each component in row order
        todo = [(img, y, x)]
        while todo:
            i, b, a = todo.pop()
            if (i, b, a) in left:
                left.remove((i, b, a))
                expected[i, b, a] = y * queries.SIDE + x
                todo += [(i, b + d, a + e) for d in (-1, 0, 1) for e in (-1, 0, 1)]
    found = queries.background_inversion(spark, SF).collect()
    assert len(found) == len(expected) > 0 and {(r.img, r.y, r.x): r.label for r in found} == expected
