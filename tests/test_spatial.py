import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from geoloom.frame import SpatialFrame
from geoloom.functions import geometry as G
from geoloom.functions import planar as P
from geoloom.functions.jts import build_jar
from geoloom.operators import joins as J
from geoloom.operators import layers as L
from geoloom.operators import tabular as T
from geoloom.sources import vector


def shapes(spark, *wkts):
    return spark.createDataFrame(list(enumerate(wkts, 1)), "id int, w string").select("id", G.from_wkt("w").alias("geometry"))


@pytest.fixture(scope="module")
def squares(spark):
    a = shapes(spark, "POLYGON((0 0,2 0,2 2,0 2,0 0))", "POLYGON((2 2,4 2,4 4,2 4,2 2))")
    b = shapes(spark, "POLYGON((1 1,3 1,3 3,1 3,1 1))", "POLYGON((3 3,5 3,5 5,3 5,3 3))")
    return a, b


@pytest.mark.parametrize("how,n,area", [("intersection", 3, 3), ("union", 7, 13), ("identity", 5, 8), ("symmetric_difference", 4, 10), ("difference", 2, 5)])
def test_overlay(squares, how, n, area):
    got = L.overlay(*squares, how)
    assert (got.count(), got.select(F.sum(G.area("geometry"))).first()[0]) == (n, area)


def test_overlay_refuses(spark, squares):
    bowtie = shapes(spark, "POLYGON((0 0,2 2,2 0,0 2,0 0))")
    with pytest.raises(ValueError):
        L.overlay(bowtie, squares[1], make_valid=False)
    assert L.overlay(bowtie, squares[1]).count() == 1
    with pytest.raises(ValueError):
        L.overlay(*squares, "nothing")


def test_sources_build(tmp_path):
    assert build_jar(tmp_path / "x.jar").stat().st_size > 1000


def test_null_and_empty(spark):
    rows = spark.createDataFrame([(1, None), (2, "POINT EMPTY"), (3, "POINT (1 2)")], "id int, w string").select("id", G.from_wkt("w").alias("g"))
    got = rows.select("id", G.area("g").alias("a"), G.is_empty("g").alias("e"), G.is_valid("g").alias("v"), G.intersects("g", "g").alias("i"), G.bounds("g")["minx"].alias("x")).orderBy("id").collect()
    assert [(r.a, r.e, r.v, r.i) for r in got] == [(None, False, False, False), (0.0, True, True, False), (0.0, False, True, True)]
    assert got[1].x != got[1].x and got[2].x == 1.0
    assert L.total_bounds(rows, "g").first()[:] == (1.0, 2.0, 1.0, 2.0)


@pytest.mark.parametrize("seed", range(3))
def test_cell_join_is_brute_force(spark, seed):
    """Boxes of very different sizes, so several levels of cells are used."""
    rng = random.Random(seed)

    def boxes(n, sizes):
        out = []
        for i in range(n):
            w, h = (rng.choice(sizes) * rng.random() for _ in range(2))
            x, y = rng.random() * 100, rng.random() * 100
            out.append((i, x, y, x + w, y + h))
        return out

    a, b = boxes(60, (0, 1, 200)), boxes(80, (0.1, 5, 60))
    frame = lambda rows: spark.createDataFrame(rows, "id int, xmin double, ymin double, xmax double, ymax double")
    left, right = J.box_side(frame(a), "id"), J.box_side(frame(b), "id")
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    assert sorted(map(tuple, J.pairs(left, right, size=1.0).collect())) == want
    assert sorted(map(tuple, J.pairs(left, right).collect())) == want

    def gap(p, q):
        return (max(q[1] - p[3], 0, p[1] - q[3]) ** 2 + max(q[2] - p[4], 0, p[2] - q[4]) ** 2) ** 0.5

    near = sorted((p[0], q[0]) for p in a for q in b if gap(p, q) <= 7)
    assert sorted((r[0], r[1]) for r in J.pairs(left, right, "dwithin", 7.0, size=2.0).collect()) == near
    k3 = {r[:2] for r in J.nearest(left, right, k=3).collect()}
    assert k3 == {(p[0], q[0]) for p in a for q in sorted(b, key=lambda q: (gap(p, q), q[0]))[:3]}


def test_frame(spark, squares):
    a, b = (SpatialFrame(x, crs=3857) for x in squares)
    assert a.sjoin(b, how="outer").count() == 3
    assert a.semijoin(b).df.count() == 2 and a.antijoin(b).df.count() == 0
    assert a.clip((0.0, 0.0, 1.0, 1.0)).df.select(G.area("geometry")).first()[0] == 1.0
    assert a.cx(3.5, None, None, None).df.count() == 1
    with pytest.raises(ValueError):
        a.set_crs(4326)
    assert a.to_crs(4326).crs == 4326
    assert SpatialFrame(shapes(spark, "POINT (10 -50)"), crs=4326).estimate_utm_crs() == 32732
    with pytest.warns(UserWarning):
        a.sjoin(b.set_crs(4326, allow_override=True))


def test_hilbert_is_a_curve(spark):
    cells = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    rows = cells.withColumn("d", P.hilbert(F.col("x"), F.col("y"), 3)).orderBy("d").collect()
    assert [r.d for r in rows] == list(range(64))
    assert all(abs(p.x - q.x) + abs(p.y - q.y) == 1 for p, q in zip(rows, rows[1:]))


def test_lines(spark):
    one = spark.range(1)
    line, other = G.from_wkt(F.lit("LINESTRING (0 0, 4 0)")), G.from_wkt(F.lit("LINESTRING (3 0, 1 0)"))
    got = one.select(
        G.to_wkt(G.interpolate(line, -1.0)), G.project(line, P.literal_point(3.0, 5.0), normalized=True), G.to_wkt(G.shared_paths(line, other)),
        G.to_wkt(G.line_merge(G.from_wkt(F.lit("MULTILINESTRING ((0 0, 1 0), (1 0, 2 0))")))), G.to_wkt(G.remove_repeated_points(G.from_wkt(F.lit("LINESTRING (0 0, 0 0, 1 1)")))),
        G.hausdorff_distance(line, other), G.frechet_distance(line, other), G.length(G.offset_curve(line, 1.0)),
    ).first()
    assert got[:5] == ("POINT (3 0)", 0.75, "GEOMETRYCOLLECTION (MULTILINESTRING EMPTY, MULTILINESTRING ((1 0, 3 0)))", "LINESTRING (0 0, 1 0, 2 0)", "LINESTRING (0 0, 1 1)") and got[5:] == (1.0, 3.0, 4.0)


def test_whole_column(spark):
    lines = shapes(spark, "LINESTRING (0 0, 2 0, 2 2, 0 2, 0 0)", "LINESTRING (1 -1, 1 3)")
    assert L.polygonize(lines).count() == 2
    assert L.polygonize(lines, part="dangles").count() == 2
    assert L.build_area(lines).select(G.area("geometry")).first()[0] == 4.0
    points = shapes(spark, "POINT (0 0)", "POINT (2 0)", "POINT (0 2)", "POINT (2 2)")
    assert L.delaunay_triangles(points).count() == 2 and L.voronoi_polygons(points).count() == 4
    two = shapes(spark, "POLYGON((0 0,2 0,2 2,0 2,0 0))", "POLYGON((2 0,3 0,3 2,2 2,2 0))")
    assert L.is_valid_coverage(two).first()[0] and not L.is_valid_coverage(shapes(spark, "POLYGON((0 0,2 0,2 2,0 2,0 0))", "POLYGON((1 0,3 0,3 2,1 2,1 0))")).first()[0]
    assert L.simplify_coverage(two, 0.1).count() == 2
    assert L.intersection_all(shapes(spark, "POLYGON((0 0,2 0,2 2,0 2,0 0))", "POLYGON((1 0,3 0,3 2,1 2,1 0))")).select(G.area("geometry")).first()[0] == 2.0


def test_formats(spark, squares, tmp_path):
    rows = squares[0].withColumn("name", F.concat(F.lit("n"), F.col("id")))
    vector.to_geoparquet(rows, f"{tmp_path}/a.parquet", covering_bbox=True, crs=4326)
    assert vector.read_file(spark, f"{tmp_path}/a.parquet", bbox=(3.0, 3.0, 9.0, 9.0)).select("id").collect() == [(2,)]
    vector.to_file(rows, f"{tmp_path}/a.geojsonl")
    back = vector.read_geojsonseq(spark, f"{tmp_path}/a.geojsonl", "id int, name string")
    assert sorted(r[0] for r in back.select(G.area("geometry")).collect()) == [4.0, 4.0]
    (tmp_path / "b.geojson").write_text(vector.to_json(rows))
    assert vector.read_file(spark, f"{tmp_path}/b.geojson").count() == 2
    vector.to_file(rows, f"{tmp_path}/a.csv")
    assert vector.read_csv(spark, f"{tmp_path}/a.csv").select(F.sum(G.area("geometry"))).first()[0] == 8.0
    (tmp_path / "p.csv").write_text("Lat,Lon\n1,2\n3,4\n")
    assert vector.read_csv(spark, f"{tmp_path}/p.csv").select(F.sum(G.x("geometry"))).first()[0] == 6.0
    vector.to_file(rows, f"{tmp_path}/a.wkt")
    assert vector.read_wkt(spark, f"{tmp_path}/a.wkt").count() == 2
    vector.to_feather(rows, f"{tmp_path}/a.feather")
    assert vector.read_feather(spark, f"{tmp_path}/a.feather").count() == 2
    (tmp_path / "k.kml").write_text("<kml><Placemark><name>x</name><Point><coordinates>1,2,0</coordinates></Point></Placemark></kml>")
    assert vector.read_kml(spark, f"{tmp_path}/k.kml").select(G.to_wkt("geometry")).collect() == [("POINT (1 2)",)]
    with pytest.raises(ValueError):
        vector.read_file(spark, "a.parquet", bbox=(0.0, 0.0, 1.0, 1.0), mask=F.lit(None))


def test_tabular(spark):
    rows = spark.createDataFrame([(1, "a", 3.0), (2, "b", None), (3, "a", 3.0)], "id int, k string, v double")
    assert [r._row for r in T.positions(rows, ["id"]).orderBy("id").collect()] == [0, 1, 2]
    assert [r.id for r in T.take(rows, [2, 0, 2], ["id"]).orderBy("_at").collect()] == [3, 1, 3]
    assert [r.id for r in T.drop_duplicates(rows, ["k"], ["id"], keep=False).collect()] == [2]
    assert T.nlargest(rows.na.drop(), 1, ["v"], keep="all").count() == 2
    assert [r.v for r in T.reindex(rows, "id", [3, 9]).orderBy("id").collect()] == [3.0, None]
    other = spark.createDataFrame([(2, 7.0), (3, None)], "id int, v double")
    assert [r.v for r in T.update(rows, other, "id").orderBy("id").collect()] == [3.0, 7.0, 3.0]
    assert T.filter_columns(rows, regex="^[kv]$").columns == ["k", "v"] and T.select_dtypes(rows, "number").columns == ["id", "v"]
    with pytest.raises(Exception, match="domain"):
        T.dense_count(rows, "id", 2).collect()


def test_geoparquet_footers(spark, squares, tmp_path):
    from geoloom.sources import geoparquet

    rows = squares[0]
    vector.to_geoparquet(rows, f"{tmp_path}/a.parquet", covering_bbox=True, crs=32631)
    meta = geoparquet.geo_metadata(f"{tmp_path}/a.parquet")
    own = meta["columns"]["geometry"]
    assert meta["primary_column"] == "geometry" and own["geometry_types"] == ["Polygon"] and geoparquet.crs_code(own) == 32631
    assert own["covering"]["bbox"]["xmin"] == ["bbox", "xmin"] and len(own["bbox"]) == 4
    bbox = vector.read_geoparquet(spark, f"{tmp_path}/a.parquet", bbox=(3.0, 3.0, 9.0, 9.0))
    assert bbox.count() == 1 and "PushedFilters: [IsNotNull(bbox.xmin)" in bbox._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        vector.to_geoparquet(rows, f"{tmp_path}/a.parquet")
    none = rows.limit(0).withColumnRenamed("geometry", "shape")
    vector.to_geoparquet(none, f"{tmp_path}/none.parquet", geometry="shape")
    assert vector.read_geoparquet(spark, f"{tmp_path}/none.parquet").count() == 0 and geoparquet.geo_metadata(f"{tmp_path}/none.parquet")["primary_column"] == "shape"
    rows.write.parquet(f"{tmp_path}/plain.parquet")
    assert geoparquet.geo_metadata(f"{tmp_path}/plain.parquet") is None and vector.read_geoparquet(spark, f"{tmp_path}/plain.parquet").count() == rows.count()


def test_unions_of_overlapping_shapes(spark):
    two = shapes(spark, "POLYGON((0 0,2 0,2 2,0 2,0 0))", "POLYGON((1 0,3 0,3 2,1 2,1 0))", "POLYGON((9 9,10 9,10 10,9 10,9 9))", None)
    for method in ("unary", "disjoint_subset"):
        got = L.union_all(two, method=method).select(G.area("geometry"), G.is_valid("geometry"), G.count_geometries("geometry")).first()
        assert tuple(got) == (7.0, True, 2)
    with pytest.raises(Exception, match="no coverage"):
        L.union_all(two, method="coverage").collect()
    with pytest.raises(ValueError):
        L.dissolve(two.withColumn("v", F.lit(1)), None, "first")


def test_nearest_of_rows_far_away(spark):
    left = spark.createDataFrame([(i, float(i), 0.0) for i in range(50)] + [(99, 1e7, 1e7), (98, -1e6, 5.0)], "id int, x double, y double")
    right = spark.createDataFrame([(i, float(i), 1.0) for i in range(0, 50, 7)], "id int, x double, y double")
    got = J.nearest(J.point_side(left, "id", "x", "y"), J.point_side(right, "id", "x", "y"), k=3)
    by = {}
    for r in got.collect():
        by.setdefault(r.left_id, set()).add(r.right_id)
    assert by[99] == {49, 42, 35} and by[98] == {0, 7, 14} and len(by) == 52 and all(len(v) == 3 for v in by.values())
    every = J.nearest(J.point_side(left, "id", "x", "y"), J.point_side(right, "id", "x", "y"), k=100)
    assert every.count() == 52 * 8


def test_frames_keep_what_they_are(spark):
    from geoloom.frame import SpatialFrame

    frame = SpatialFrame(shapes(spark, "POINT (1 2)", "POINT (3 4)").withColumn("v", F.col("id") * 1.0), crs=4326)
    assert frame.rename({"geometry": "shape", "id": "key"}).sort_index().crs == 4326
    assert frame.set_axis(["key", *frame.df.columns[1:]]).id == "key" and not frame.has_sindex()
    with pytest.raises(TypeError):
        frame.max()
    with pytest.raises(ValueError):
        frame.concat(SpatialFrame(frame.df, crs=3857))
    assert frame.concat(SpatialFrame(frame.df)).df.count() == 4 and frame.tail(1).df.count() == 1 and frame.sample(frac=0.5).df.count() == 1
    assert SpatialFrame(frame.df.withColumn("geometry", P.literal_point(5.0, 60.0)), crs=4326).estimate_utm_crs() == 32632
    assert SpatialFrame(frame.df.withColumn("geometry", P.literal_point(20.0, 78.0)), crs=4326).estimate_utm_crs() == 32633
    with pytest.warns(UserWarning, match="degrees"):
        assert frame.sjoin_nearest(frame).columns == ["id_left", "geometry", "v_left", "id_right", "v_right"]
    assert frame.apply(lambda f: f[["id"]], "id int").geometry is None
    assert [r.x for r in frame.df.select(G.x(G.transform("geometry", lambda x, y: (y, x))).alias("x")).collect()] == [2.0, 4.0]


def _plain_nearest(left, right, k, exclusive, limit):
    gap = lambda p, q: (max(q[1] - p[3], 0, p[1] - q[3]) ** 2 + max(q[2] - p[4], 0, p[2] - q[4]) ** 2) ** 0.5
    out = set()
    for p in left:
        ranked = sorted((gap(p, q), q[0]) for q in right if not (exclusive and p[1:] == q[1:]))
        ranked = ranked[:k] if k else [r for r in ranked if r[0] == ranked[0][0]]
        out |= {(p[0], i, round(d, 9)) for d, i in ranked if limit is None or d <= limit}
    return out


@pytest.mark.parametrize("few", [0, 10**6])
@pytest.mark.parametrize("k, exclusive, limit", [(3, False, None), (None, False, None), (2, True, None), (None, True, None), (4, False, 2.0), (500, True, None)])
def test_nearest_against_all_pairs(spark, monkeypatch, k, exclusive, limit, few):
    """A dense place, a sparse rest, rows far away, repeated places and boxes."""
    monkeypatch.setattr(J, "FEW", few)
    rng = random.Random(11)
    spot = lambda: (rng.gauss(50, 0.5), rng.gauss(50, 0.5)) if rng.random() < 0.8 else (rng.random() * 1000, rng.random() * 1000)
    at = [spot() for _ in range(60)]
    right = [(i, *p, *p) for i, p in enumerate([*at, *(spot() for _ in range(300)), *at[:20], *at[:5]])] + [(900 + i, x, y, x + 3, y + 1) for i, (x, y) in enumerate(at[:10])]
    left = [(i, *p, *p) for i, p in enumerate([*at[:30], *(spot() for _ in range(60)), (-1e5, 7.0)])]
    frame = lambda rows: spark.createDataFrame(rows, "id int, xmin double, ymin double, xmax double, ymax double")
    points = J.point_side(frame(left), "id", "xmin", "ymin")
    want = _plain_nearest(left, right, k, exclusive, limit)
    got = {(r.left_id, r.right_id, round(r.distance, 9)) for r in J.nearest(points, J.box_side(frame(right), "id"), k, limit, exclusive).collect()}
    assert got == want
    if k != 500:
        boxes = [(i, x, y, x + 2, y) for i, x, y, *_ in left]
        found = J.nearest(J.box_side(frame(boxes), "id"), J.box_side(frame(right), "id"), k, limit, exclusive)
        assert {(r.left_id, r.right_id, round(r.distance, 9)) for r in found.collect()} == _plain_nearest(boxes, right, k, exclusive, limit)


def test_repeated_ids_are_rows_of_their_own(spark):
    left = spark.createDataFrame([(1, 0.5, 0.5), (1, 9.0, 9.0), (2, 0.6, 0.6)], "id int, x double, y double")
    right = spark.createDataFrame([(7, 0.0, 0.0, 1.0, 1.0), (7, 0.0, 0.0, 2.0, 2.0)], "id int, xmin double, ymin double, xmax double, ymax double")
    a, b = J.point_side(left, "id", "x", "y"), J.box_side(right, "id")
    assert sorted((r.id_left, r.x) for r in J.sjoin(a, b).collect()) == [(1, 0.5), (1, 0.5), (2, 0.6), (2, 0.6)]
    assert J.sjoin(a, b, "outer").count() == 5
    assert [r.x for r in J.left_anti(a, b).collect()] == [9.0] and J.right_semi(a, b).count() == 2 and J.left_semi(a, b).count() == 2
    assert sorted(map(tuple, J.match_counts(a, b).collect())) == [(1, 0), (1, 2), (2, 2)]
    assert sorted(map(tuple, J.query_aggregate(a, b, {"n": ("*", "size"), "w": ("xmax", "sum")}).collect())) == [(1, 0, 0.0), (1, 2, 3.0), (2, 2, 3.0)]
    near = J.sjoin_nearest(a, b, attributes=True, distance_col="d").collect()
    assert sorted((r.x, r.xmax, round(r.d, 6)) for r in near) == [(0.5, 1.0, 0.0), (0.5, 2.0, 0.0), (0.6, 1.0, 0.0), (0.6, 2.0, 0.0), (9.0, 2.0, 9.899495)]


def test_box_unions_that_do_not_fill(spark):
    box = lambda x0, y0, x1, y1: f"POLYGON(({x0} {y0},{x1} {y0},{x1} {y1},{x0} {y1},{x0} {y0}))"
    groups = {
        "apart": [box(0, 0, 2, 2), box(10, 0, 12, 2)], "fill": [box(0, 0, 1, 2), box(1, 0, 3, 1), box(1, 1, 3, 2)],
        "sum only": [box(0, 0, 2, 1), box(1, 0, 3, 1), box(4, 0, 5, 1)], "overlap": [box(0, 0, 2, 2), box(1, 0, 3, 2)], "twice": [box(0, 0, 1, 1), box(0, 0, 1, 1)],
        "triangle": ["POLYGON((0 0,2 0,0 2,0 0))"],
    }
    rows = reduce(lambda a, b: a.unionAll(b), (shapes(spark, *g).withColumn("k", F.lit(k)) for k, g in groups.items()))
    got = {r.k: round(r.a, 9) for r in L.box_union_by(rows, ["k"]).select("k", G.area("geometry").alias("a")).collect()}
    assert got == {"apart": 8.0, "fill": 6.0, "sum only": 4.0, "overlap": 6.0, "twice": 1.0, "triangle": 2.0}


def test_relations_of_a_union(spark):
    two = shapes(spark, "POLYGON((0 0,2 0,2 2,0 2,0 0))", "POLYGON((2 0,4 0,4 2,2 2,2 0))", None).withColumn("k", F.lit(1))
    across, out = F.lit("POLYGON((1 0.5,3 0.5,3 1.5,1 1.5,1 0.5))"), F.lit("POLYGON((1 0.5,5 0.5,5 1.5,1 1.5,1 0.5))")
    hit = lambda name, shape: L.dissolved_intersects(two, "k", G.from_wkt(shape), predicate=name).first().hit
    assert hit("contains", across) and hit("covers", across) and not hit("contains", out) and hit("intersects", out)
    around = F.lit("POLYGON((0 0,9 0,9 2,0 2,0 0))")
    assert hit("within", around) and hit("covered_by", around) and not hit("within", out) and not hit("disjoint", out)
    assert hit("disjoint", F.lit("POINT (9 9)")) and not hit("contains", F.lit("POINT (9 9)"))
    with pytest.raises(ValueError):
        hit("touches", across)


def test_coverage_union_by_edges(spark):
    """A checkered ring with a hole, an island inside it and groups that touch at a corner; overlaps are refused."""
    tile = lambda x, y: f"POLYGON(({x} {y},{x + 1} {y},{x + 1} {y + 1},{x} {y + 1},{x} {y}))"
    ring = [tile(x, y) for x in range(5) for y in range(5) if (x, y) not in {(1, 1), (1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2), (3, 3)}]
    rows = shapes(spark, *ring).withColumn("k", F.lit("ring")).unionAll(shapes(spark, tile(0, 0), tile(1, 1), None).withColumn("k", F.lit("corner")))
    got = {r.k: tuple(r)[1:] for r in L.union_by(rows, ["k"], method="coverage").select("k", G.area("geometry"), G.count_geometries("geometry"), G.is_valid("geometry"), G.length("geometry")).collect()}
    assert got == {"ring": (17.0, 2, True, 36.0), "corner": (2.0, 2, True, 8.0)}
    for bad in ([tile(0, 0), tile(0, 0)], [tile(0, 0), tile(0.5, 0)], ["LINESTRING (0 0, 1 1)"]):
        with pytest.raises(Exception, match="no coverage"):
            L.union_by(shapes(spark, *bad).withColumn("k", F.lit(1)), ["k"], method="coverage").collect()
    many = spark.range(90_000).select(F.lit(1).alias("k"), P.wkb_box(P.Box((F.col("id") % 300).cast("double"), F.floor(F.col("id") / 300).cast("double"), F.col("id") % 300 + 1.0, F.floor(F.col("id") / 300) + 1.0)).alias("geometry"))
    plan = L.union_by(many, ["k"], method="coverage")
    assert plan.select(G.area("geometry"), G.count_coordinates("geometry")).first()[0] == 90_000.0
    assert "collect_list(__g" not in plan._jdf.queryExecution().toString()


def test_adaptive_cells(spark):
    """Nine tenths of the points in a hundredth of the extent: the same pairs as by brute force, and even tasks."""
    rng = random.Random(21)
    spot = lambda: (rng.random() * 10 + 200, rng.random() * 10 + 700) if rng.random() < 0.9 else (rng.random() * 1000, rng.random() * 1000)
    points = [(i, *spot()) for i in range(3000)]
    boxes = [(i, x, y, x + w, y + w) for i, ((x, y), w) in enumerate((spot(), rng.choice((0.05, 0.3, 30.0))) for _ in range(400))]
    left = J.point_side(spark.createDataFrame(points, "id int, x double, y double"), "id", "x", "y")
    right = J.box_side(spark.createDataFrame(boxes, "id int, xmin double, ymin double, xmax double, ymax double"), "id")
    want = sorted((p[0], q[0]) for p in points for q in boxes if q[1] <= p[1] <= q[3] and q[2] <= p[2] <= q[4])
    assert sorted(map(tuple, J.pairs(left, right, adaptive=True).collect())) == want
    assert sorted(map(tuple, J.pairs(right, left, adaptive=True).select("right_id", "left_id").collect())) == want
    near = sorted((p[0], q[0]) for p in points for q in boxes if max(q[1] - p[1], 0, p[1] - q[3]) ** 2 + max(q[2] - p[2], 0, p[2] - q[4]) ** 2 <= 0.25)
    assert sorted(tuple(r)[:2] for r in J.pairs(left, right, "dwithin", 0.5, adaptive=True).collect()) == near
    both = J.pairs(right, right, adaptive=True).collect()
    assert len(both) == sum(p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4] for p in boxes for q in boxes)
    packed, leaves = J.quadtree(left, right, *J.measure(left, right))
    assert len(leaves) > 8 and min(leaf.size for leaf in leaves) * 20 < max(leaf.size for leaf in leaves)
    from geoloom.functions.jts import call

    dealt = left.df.select(F.explode(call("Leaves", F.array("x", "y", "x", "y"), F.lit(packed))).alias("leaf"), "x", "y")
    sizes = {i: leaf.size for i, leaf in enumerate(leaves)}
    cells = [(r.leaf, r.x // sizes[r.leaf], r.y // sizes[r.leaf]) for r in dealt.collect()]
    assert len(cells) == len(points)  # a point is in one leaf
    tasks = [0] * 64
    for cell in cells:
        tasks[hash(cell) % 64] += 1
    assert max(tasks) <= 4 * sorted(tasks)[32]


def test_systems_by_parameters(spark):
    """Worked examples of the projections on their own datums, and published points through the datum shifts."""
    from geoloom.functions import crs as C

    def at(code, target, x, y):
        r = spark.range(1).select(G.to_crs(P.literal_point(x, y), code, target).alias("g")).select(G.x("g").alias("x"), G.y("g").alias("y")).first()
        return r.x, r.y

    near = lambda a, b, within: abs(a[0] - b[0]) <= within and abs(a[1] - b[1]) <= within
    assert near(at(4277, 27700, 0.5, 50.5), (577274.99, 69740.50), 0.01)
    assert near(at(4289, 28992, 6.0, 53.0), (196105.283, 557057.739), 0.01)
    assert near(at(27700, 4277, 577274.99, 69740.50), (0.5, 50.5), 1e-7) and near(at(28992, 4289, 196105.283, 557057.739), (6.0, 53.0), 1e-8)
    assert near(at(4326, 28992, 5.38720621, 52.15517440), (155000.0, 463000.0), 1.0)
    assert near(at(4258, 25832, 9.0, 50.0), (500000.0, 5538630.703), 0.01) and near(at(4326, 25833, 12.0, 52.0), at(4326, 32633, 12.0, 52.0), 0.01)
    # heights are left out between datums, which costs a millimetre
    for code, x, y in ((27700, 530000.0, 180000.0), (28992, 121000.0, 487000.0), (31467, 3500000.0, 5500000.0), (23030, 440000.0, 4470000.0), (25829, 500000.0, 4500000.0), (32723, 333000.0, 7390000.0)):
        assert near(at(4326, code, *at(code, 4326, x, y)), (x, y), 2e-3)
        told = C.to_projjson(C.by_code(code))
        assert C.from_projjson(told).numbers == pytest.approx(C.by_code(code).numbers)
        assert {"base_crs", "conversion", "coordinate_system"} <= set(told) and told["id"] == {"authority": "EPSG", "code": code}
    shifted = {"type": "BoundCRS", "source_crs": C.to_projjson(C.by_code(28992)), "target_crs": C.to_projjson(C.by_code(4326)), "transformation": {
        "method": {"name": "Coordinate Frame rotation (geog2D domain)"}, "parameters": [{"name": n, "value": v} for n, v in zip(C.SHIFTS, (565.4171, 50.3319, 465.5524, 0.398957, -0.343988, 1.87740, 4.0725))]}}
    assert near(at(4326, shifted, 5.38720621, 52.15517440), (155000.0, 463000.0), 1.0)
    assert near(at(3857, 27700, *at(27700, 3857, 530000.0, 180000.0)), (530000.0, 180000.0), 2e-3)
    with pytest.raises(NotImplementedError):
        at(4326, 2056, 7.0, 46.0)
    with pytest.warns(UserWarning, match="datum"):
        at(4326, 5070, -96.0, 40.0)
