import duckdb
import pytest
from pyspark.sql import functions as F

from platen.operators import objects, rectangles, votes
from platen.plans import queries
from test_scans import RECTANGLES, SF, TABLES, same


@pytest.mark.parametrize("name", RECTANGLES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert same(queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df())


def test_rectangles_of_a_bar_a_triangle_and_a_line(spark):
    bar = [(1, x, y) for x in range(20) for y in range(10)]
    triangle = [(2, x, y) for y in range(20) for x in range(y + 1)]
    points = spark.createDataFrame([*bar, *triangle, (3, 0, 0), (3, 1, 1), (3, 2, 2), (4, 5, 5), (5, None, 1)], "obj long, x long, y long")
    found = rectangles.least_rectangles(points)
    assert {r.obj: sorted([r.w, r.h]) for r in found.where("obj = 1").collect()} == {1: [9.0, 19.0]}
    assert {r.obj for r in found.collect()} == {1, 2}
    outline = points.where("obj = 1 and (x in (0, 19) or y in (0, 9)) or obj = 2 and (x = 0 or y = 19 or x = y)").withColumn("area", F.when(F.col("obj") == 1, 200).otherwise(210))
    shape = {r.obj: r.rectangularity for r in rectangles.rectangularity(outline, found).collect()}
    assert shape[1] > 0.98 and shape[2] < 0.7
    assert found.limit(0).count() == rectangles.least_rectangles(points.limit(0)).count() == 0


def test_body_leaves_out_a_spike(spark):
    body = [(1, x, y) for x in range(60) for y in range(40) if x in (0, 59) or y in (0, 39)]
    points = spark.createDataFrame([*body, *((1, 30, y) for y in range(40, 80))], "obj long, x long, y long")
    whole = rectangles.least_rectangles(points)
    (w,), (b,) = whole.collect(), rectangles.body_rectangles(points, whole).collect()
    assert max(w.w, w.h) > 75
    assert max(b.w, b.h) < 66 and min(b.w, b.h) > 30


def test_unclip_moves_the_sides_and_keeps_the_angle(spark):
    r = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 0.0, 40.0, 10.0)], "obj long, ux double, uy double, u0 double, v0 double, w double, h double")
    (row,) = rectangles.unclipped(r).collect()
    assert (row.w, row.h, row.ux, row.uy) == (pytest.approx(51.2), pytest.approx(21.2), 1.0, 0.0)


def test_holes_of_enough_pixels_count(spark):
    holes = {(y, x) for a, b in [(3, 3), (12, 12)] for y in range(a, a + 3) for x in range(b, b + 3)}
    solid = spark.createDataFrame([(1, y, x, 0) for y in range(20) for x in range(20)], "img long, y int, x int, label long")
    holed = spark.createDataFrame([(1, y, x, 0) for y in range(20) for x in range(20) if (y, x) not in holes], "img long, y int, x int, label long")
    counts = [objects.hole_counts(df, n).first().holes for df, n in [(holed, 4), (holed, 16), (solid, 1)]]
    assert counts == [2, 0, 0]


def test_instances_merge_over_the_threshold_only(spark):
    rows = [(0, m, 0, x) for m, bits in enumerate(["1100", "0110", "0001"]) for x, b in enumerate(bits) if b == "1"]
    masks = spark.createDataFrame(rows, "img long, inst long, y int, x int")
    merged = {(r.inst, r.x) for r in objects.merged_masks(masks, 0.0).collect()}
    assert merged == {(0, 0), (0, 1), (0, 2), (2, 3)}
    assert {r.root for r in objects.merged_instances(masks, 0.5).collect()} == {0, 1, 2}


def test_decisions(spark):
    rows = [(1, 0.9, 0, 0, 7.0, 3.0, True, 3), (2, 0.1, 0, 0, 7.0, 3.0, True, 3), (3, None, 2, 1, None, 3.0, None, 1), (4, 0.9, 0, 0, None, None, None, None)]
    found = spark.createDataFrame(rows, "obj int, rectangularity double, clipped int, holes int, text_angle double, mask_angle double, flip boolean, doc_turns int")
    got = {r.obj: (r.use_text, r.fit, r.padded, r.source, r.angle_deg, r.turns) for r in votes.decide(found).collect()}
    assert got == {1: (False, "min", False, "mask", 3.0, 3), 2: (True, "max", True, "text", 7.0, 2), 3: (True, "min", True, "mask", 3.0, 0), 4: (False, "min", False, "none", None, 0)}
    assert {r.turns for r in votes.decide(found, no_deskew=True).collect()} == {0}
