"""Rows that share their geometry meet as one where pairs do not have to be told apart."""

from pyspark.sql import functions as F

from geoloom.functions.planar import wkb_point
from geoloom.operators import joins as J


def _copies(spark, n: int, places: int, by: float) -> J.DataFrame:
    return spark.range(n).select("id", (F.col("id") % places * 3.0 + by).alias("x"), (F.col("id") % places % 7 * 2.0).alias("y")).withColumn("geometry", wkb_point("x", "y"))


def test_nearest_of_copies(spark, monkeypatch):
    met = []
    former = J._nearest
    monkeypatch.setattr(J, "_nearest", lambda left, right, *more: met.append((left.df.count(), right.df.count())) or former(left, right, *more))
    a, b = _copies(spark, 600, 20, 1.0), _copies(spark, 90, 30, 0.0)
    xy = lambda i, places, by: (i % places * 3.0 + by, i % places % 7 * 2.0)
    want = []
    for i in range(600):
        (x, y), gaps = xy(i, 20, 1.0), []
        for j in range(90):
            u, v = xy(j, 30, 0.0)
            gaps.append((((x - u) ** 2 + (y - v) ** 2) ** 0.5, j))
        want += [(i, j, round(d, 9)) for d, j in gaps if d == min(gaps)[0]]
    for side in (lambda df: J.point_side(df, "id", "x", "y"), lambda df: J.geometry_side(df, "id")):
        got = J.nearest(side(a), side(b)).select("left_id", "right_id", F.round("distance", 9))
        assert sorted(map(tuple, got.collect())) == want
    assert met == [(20, 30)] * 2


def test_nearest_rows_with_attributes(spark):
    a, b = _copies(spark, 40, 20, 1.0).withColumn("v", F.col("id") * 2), _copies(spark, 90, 30, 0.0)
    a = a.unionByName(spark.createDataFrame([(99, None, None, None, 7)], a.schema))
    sides = J.geometry_side(a, "id"), J.geometry_side(b, "id")
    pairs = {tuple(r) for r in J.nearest(*sides).select("left_id", "right_id").collect()}
    for how in ("inner", "left", "right"):
        got = J.sjoin_nearest(*sides, how, attributes=True, distance_col="gap").select("id_left", "id_right", "v", "gap").collect()
        assert {tuple(r)[:2] for r in got if r.gap is not None} == pairs and all(r.v == 2 * r.id_left for r in got if r.gap is not None)
        alone = {tuple(r)[:2] for r in got if r.gap is None}
        assert alone == {"inner": set(), "left": {(99, None)}, "right": {(None, i) for i in range(90) if i not in {j for _, j in pairs}}}[how]


def test_semi_and_anti_of_copies(spark):
    a, b = _copies(spark, 300, 60, 0.0), _copies(spark, 4000, 20, 0.0)
    assert J.alike(J.geometry_side(b, "id")).df.count() == J.alike(J.point_side(b, "id", "x", "y")).df.count() == 20
    sides = J.geometry_side(a, "id"), J.geometry_side(b, "id")
    assert J.left_semi(*sides).count() == 100 and J.left_anti(*sides).count() == 200
    assert J.left_semi(*(J.point_side(df, "id", "x", "y") for df in (a, b))).count() == 100
