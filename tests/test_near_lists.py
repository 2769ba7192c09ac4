"""Where boxes lie on one another, or on lines, a search for near ones meets few of them."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from geoloom.operators import joins as J
from geoloom.operators import steps
from geoloom.plans import trip_queries as T


def _boxes(spark, rows):
    return J.box_side(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, xmin double, ymin double, xmax double, ymax double"), "id")


def _points(spark, rows):
    return J.point_side(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, x double, y double"), "id", "x", "y")


def _gap(p, b):
    return (max(b[0] - p[0], 0, p[0] - b[2]) ** 2 + max(b[1] - p[1], 0, p[1] - b[3]) ** 2) ** 0.5


def _plain(points, boxes, k):
    out = set()
    for i, p in enumerate(points):
        gaps = sorted((_gap(p, b), j) for j, b in enumerate(boxes))
        out |= {(i, j, round(d, 9)) for d, j in (gaps[:k] if k else [g for g in gaps if g[0] == gaps[0][0]])}
    return out


def _rows(found):
    return {(r.left_id, r.right_id, round(r.distance, 9)) for r in found.collect()}


def test_boxes_on_one_another(spark, monkeypatch):
    draw = random.Random(3)
    corners = [(draw.randrange(400) / 4, draw.randrange(400) / 4) for _ in range(3000)]
    boxes = [(x, y, x + 30 + draw.randrange(40), y + 20 + draw.randrange(40)) for x, y in corners]
    points = [(draw.randrange(600) / 4 - 10, draw.randrange(600) / 4 - 10) for _ in range(150)]
    made, write = [], J.written
    monkeypatch.setattr(J, "written", lambda df: made.append(write(df)) or made[-1])
    for k in (3, None):
        assert _rows(J.nearest(_points(spark, points), _boxes(spark, boxes), k)) == _plain(points, boxes, k)
        if k:
            lists = next(df for df in made if "boxes" in df.columns)
            # a cell lies in hundreds of boxes
            assert lists.agg(F.avg(F.size("near"))).first()[0] < 60


def test_exclusive_among_boxes_on_one_another(spark):
    draw = random.Random(4)
    points = [(draw.randrange(40) / 4, draw.randrange(40) / 4) for _ in range(120)]
    boxes = [(*p, *p) for p in points for _ in range(3)] + [(x, y, x + 6, y + 6) for x, y in ((draw.randrange(400) / 4, draw.randrange(400) / 4) for _ in range(2500))]
    want = set()
    for i, p in enumerate(points):
        want |= {(i, j, round(d, 9)) for d, j in sorted((_gap(p, b), j) for j, b in enumerate(boxes) if b != (*p, *p))[:2]}
    assert _rows(J.nearest(_points(spark, points), _boxes(spark, boxes), 2, exclusive=True)) == want


def test_places_on_lines(spark, monkeypatch):
    draw = random.Random(5)
    boxes = [(x, y, x + 0.25, y + 0.25) for x, y in ((draw.randrange(25) * 40, draw.randrange(4000) / 4) for _ in range(2500))]
    points = [(draw.randrange(4000) / 4, draw.randrange(4000) / 4) for _ in range(200)]
    monkeypatch.setattr(J, "LEFT", 0, raising=False)
    left, enough = [], J._enough
    monkeypatch.setattr(J, "_enough", lambda *args: left.append(1) or enough(*args))
    monkeypatch.setattr(J, "_cell_sizes", lambda *args: [5.0])
    assert _rows(J.nearest(_points(spark, points), _boxes(spark, boxes), 4)) == _plain(points, boxes, 4)
    # wider cells serve the rows between the lines
    assert not left


def test_a_written_step_leaves_no_shuffle_files(spark):
    local = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    files = lambda: {p.name for p in local.rglob("shuffle_*")}
    before = files()
    rows = steps.written(spark.range(1000).repartition(7))
    assert not files() - before
    assert rows.count() == 1000


def test_q12_with_equal_distances(spark, monkeypatch):
    view, d = T.view, "/root/testdata/sf0.001"

    def covered(spark, d, name):
        rows = view(spark, d, name)
        if name == "trip":
            return rows.unionByName(rows.limit(40).withColumn("py", F.lit(None).cast("double")))
        return rows.limit(8).withColumns({"xmin": F.lit(-1.0), "ymin": F.lit(-1.0), "xmax": F.lit(2000.0), "ymax": F.lit(2000.0)})

    met = []
    monkeypatch.setattr(T, "view", covered)
    monkeypatch.setattr(T, "written", lambda df: met.append(steps.written(df)) or met[-1])
    got = [tuple(r) for r in T.q12(spark, d).collect()]
    assert got == [(r.tripkey, 0.0) for r in view(spark, d, "trip").orderBy("tripkey").limit(100).select("tripkey").collect()]
    # of places that tie, trips of a hundred are read again
    assert met[-1].count() == 100
