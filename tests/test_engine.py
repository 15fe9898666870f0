"""Commands end to end on small fixtures, and every query against DuckDB."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import GreaterThan, GreaterThanOrEqual, In, LessThan
from tidemark import queries
from tidemark.functions import spatial as S
from tidemark.operators import geometry as G
from tidemark.operators import lookups as L
from tidemark.operators.locations import unique_locations, with_keys
from tidemark.plans import region as R
from tidemark.plans.engine import Engine, coast_lookup, custom_lookup, place_lookup, row_lookup, sea_lookup
from tidemark.plans.settings import Box, Overrides, Settings
from tidemark.sources.features import read_features, read_geojson, read_shoreline
from tidemark.sources.netcdf import _Reader, read_grid, write_grid, write_tiles
from tidemark.sources.shapefile import write_shapefile
from tidemark.streaming.enrich import enrich_stream

SF = "/root/testdata/sf0.001"


def points(spark, *rows):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], "longitude double, latitude double")


def segs(spark, *lines):
    rows = [(i, *map(float, (*a, *b))) for i, line in enumerate(lines) for a, b in zip(line, line[1:], strict=False)]
    return spark.createDataFrame(rows, "fid long, alon double, alat double, blon double, blat double")


def boxes(spark, *rows):
    """(name, code, w, s, e, n) as features."""
    made = []
    for i, (name, code, w, s, e, n) in enumerate(rows):
        made.append((i, name, code, [[(w, s), (e, s), (e, n), (w, n), (w, s)]]))
    schema = T.StructType().add("fid", "long").add("name", "string").add("code", "string").add("rings", T.ArrayType(T.ArrayType(T.StructType().add("lon", "double").add("lat", "double"))))
    return G.with_bounds(spark.createDataFrame([(i, n, c, [[(float(a), float(b)) for a, b in r] for r in rs]) for i, n, c, rs in made], schema))


def settings(*box, **more):
    b = Box(*map(float, box))
    return Settings(box=b, proj_lon0=b.center[0], proj_lat0=b.center[1], **more)


def test_dedup_and_report(spark):
    e = Engine(spark, count=True)
    x = custom_lookup([T.StructField("val", T.DoubleType())], lambda locs: locs.select("_klon", "_klat", (F.col("lon") + F.col("lat")).alias("val")))
    out = e.run(points(spark, (18, 59), (18, 59), (24, 60)), x)
    assert sorted(r.val for r in out.collect()) == [77.0, 77.0, 84.0]
    assert (e.report.rows, e.report.unique, e.report.unresolved) == (3, 2, 0)


def test_coast(spark):
    e = Engine(spark, settings(8, 31, 53, 66))
    line = segs(spark, [(20, 58), (20, 60)])
    rows = {r.longitude: r.dist_to_coast for r in e.coast(points(spark, (20, 59), (21, 59)), line).collect()}
    great = spark.range(1).select(S.haversine(21.0, 59.0, 20.0, 59.0)).first()[0] / 1000
    assert rows[20.0] < 0.01 and rows[21.0] == pytest.approx(great, rel=0.02)
    m = e.coast(points(spark, (21, 59)), line, unit="m", column="d").first()
    assert m.d == pytest.approx(1000 * rows[21.0])
    assert math.isnan(e.coast(points(spark, (21, 59)), segs(spark, [(100, 0), (100, 5)])).first().dist_to_coast)


def brute_segments(locs, s):
    """Nearest segment by all pairs: {(keys): (metres, fid)}."""
    from tidemark.functions import spatial as S
    from tidemark.operators.locations import KEYS

    p = lambda x, y: S.laea_forward(F.col(x), F.col(y), 5.0, 5.0)
    d2 = S.segment_distance2(*p("lon", "lat"), *p("alon", "alat"), *p("blon", "blat"))
    best = locs.crossJoin(s).groupBy(*KEYS).agg(F.min(F.struct(d2.alias("d2"), "fid")).alias("b"))
    return {(r._klon, r._klat): (round(math.sqrt(r.b.d2), 5), r.b.fid) for r in best.collect()}


def test_nearest_segment_is_exact(spark):
    """Even, crowded and repeated segments, a very long one, some of no length, locations inside and far outside."""
    rng = random.Random(10)
    even = [((i * 37 % 360) - 180 + 0.5, (i * 53 % 160) - 80 + 0.25, (i * 37 % 360) - 180 + 1.5, (i * 53 % 160) - 79.0) for i in range(200)]
    town = [(x := rng.uniform(20, 20.1), y := rng.uniform(40, 40.1), x + rng.uniform(0, 0.01), y + 0.002) for _ in range(1500)]
    rows = [(i, *r) for i, r in enumerate([*even, *town, *town[:200], (-40.0, -30.0, 60.0, 50.0), (1.0, 1.0, 1.0, 1.0)])]
    s = spark.createDataFrame([*rows, (9000, float("nan"), 0.0, 0.0, 0.0)], "fid long, alon double, alat double, blon double, blat double")
    at = [(i * 7 % 100 - 50, i * 11 % 90 - 45) for i in range(60)] + [(rng.uniform(19.95, 20.15), rng.uniform(39.95, 40.15)) for _ in range(80)]
    locs = unique_locations(with_keys(points(spark, *at), "longitude", "latitude", 3), 3)
    found = L.nearest_segments(locs, s, 5.0, 5.0)
    assert {(r._klon, r._klat): (round(r.metres, 5), r.fid) for r in found.collect()} == brute_segments(locs, s.where("fid < 9000"))
    assert L.nearest_segments(locs, s.limit(0), 5.0, 5.0).count() == 0


def test_a_crowd_of_references_is_no_slower(spark, monkeypatch):
    """Pairs of location and reference that are looked at: as few in a town as over the globe."""
    rng, seen = random.Random(11), {}
    monkeypatch.setattr(L, "SORTED", 1000)
    for name, (x, y, size) in {"town": (5.0, 50.0, 0.1), "globe": (-180.0, -80.0, 160.0)}.items():
        spots = lambda n: [(rng.uniform(x, x + 2 * size), rng.uniform(y, y + size)) for _ in range(n)]  # noqa: B023, E731
        refs = spark.createDataFrame([(i, *p) for i, p in enumerate(spots(4000))], "rid long, lon double, lat double")
        locs = unique_locations(with_keys(points(spark, *spots(300)), "longitude", "latitude", 4), 4)
        counts, own = [], L._descend

        def counted(at, packed, *rest):
            counts.append(packed.count())  # noqa: B023
            return own(at, packed, *rest)  # noqa: B023

        monkeypatch.setattr(L, "_descend", counted)
        found = L.nearest_points(locs, refs)
        monkeypatch.setattr(L, "_descend", own)
        rows = found.collect()
        assert len(rows) == locs.count() and counts == [4000]
        join = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "leaf" in x and "Join" in x]
        assert join
        seen[name] = rows
    assert all(r.metres < 4000 for r in seen["town"])


def test_depth(spark, tmp_path):
    path = f"{tmp_path}/g.nc"
    write_grid(path, [0.0, 1.0, 2.0], [10.0, 11.0, 12.0, 13.0], [[-(i * 100 + j * 10 + 5) for j in range(4)] for i in range(3)])
    grid = read_grid(spark, path)
    rows = {r.longitude: r.bathymetry for r in Engine(spark).depth(points(spark, (11.1, 0.9), (13.2, 2.2), (11.0, 0.0), (50, 1)), *grid).collect()}
    assert (rows[11.1], rows[13.2], rows[11.0]) == (-115.0, -235.0, -15.0) and math.isnan(rows[50.0])
    write_grid(path, [0.0, 1.0], [0.0, 1.0], [[-100.0, 250.0], [-300.0, -400.0]])
    got = Engine(spark).depth(points(spark, (0, 0), (1, 0), (9, 9), (360, 1)), *read_grid(spark, path), positive=True, on_land=True)
    rows = {(r.longitude, r.latitude): (r.bathymetry, r.on_land) for r in got.collect()}
    assert rows[0.0, 0.0] == (100.0, False) and rows[1.0, 0.0] == (-250.0, True) and rows[360.0, 1.0] == (300.0, False)
    assert rows[9.0, 9.0][1] is None
    (tmp_path / "bad.nc").write_bytes(b"\x89HDF")
    with pytest.raises(ValueError, match="classic"):
        read_grid(spark, f"{tmp_path}/bad.nc")


def test_grid_reads_only_the_rows_asked_for(spark, tmp_path):
    path = str(tmp_path / "wide.nc")
    write_grid(path, [float(i) for i in range(200)], [0.0, 1.0], [[i * 10.0, i * 10.0 + 1] for i in range(200)])
    grid, lat, lon = read_grid(spark, path)
    reader = _Reader(path, 64)
    assert list(reader.pushFilters([GreaterThanOrEqual(("i",), 70), LessThan(("i",), 75), GreaterThan(("j",), 0)])) and [(p.first, p.stop) for p in reader.partitions()] == [(70, 75)]
    assert grid.where("i between 70 and 74").rdd.getNumPartitions() == 1
    assert sorted(r.elevation for r in grid.where("i between 70 and 71").collect()) == [700.0, 701.0, 710.0, 711.0]
    got = Engine(spark).depth(points(spark, (1, 70), (0, 74), (0, 5000)), grid, lat, lon).collect()
    assert {r.latitude: r.bathymetry for r in got if r.latitude < 100} == {70.0: 701.0, 74.0: 740.0}


@pytest.mark.parametrize("kind", ["netcdf", "tiles"])
def test_far_locations_read_their_tiles_only(spark, tmp_path, kind, monkeypatch):
    """Three locations at opposite ends of a grid of twelve tiles: three tiles are read."""
    n, m = 1100, 2000
    path = f"{tmp_path}/g"
    if kind == "netcdf":
        write_grid(path, [float(i) / 10 - 55 for i in range(n)], [float(j) / 10 - 100 for j in range(m)], [[i * 10_000.0 + j for j in range(m)] for i in range(n)])
        grid = read_grid(spark, path)
        reader = _Reader(path, 64)
        list(reader.pushFilters([In(("tile",), (0, 3, 2 << 16 | 1))]))
        cells = [b.num_rows for p in reader.partitions() for b in reader.read(p)]
        assert sum(cells) == 512 * 512 + 512 * (m - 3 * 512) + (n - 2 * 512) * 512
    else:
        cells = spark.range(n * m).selectExpr(f"cast(id div {m} as int) as i", f"cast(id % {m} as int) as j").withColumn("elevation", F.expr("i * 10000.0D + j"))
        write_tiles(cells, path)
        grid = spark.read.parquet(path), (-55.0, 0.1, n), (-100.0, 0.1, m)
    locs = unique_locations(with_keys(points(spark, (-99.8, -54.9), (99.0, -54.0), (0.0, 54.0)), "longitude", "latitude", 3), 3)
    found = L.grid_lookup(locs, *grid)
    assert sorted(r.elevation for r in found.collect()) == [1 * 10_000 + 2, 10 * 10_000 + 1990, 1090 * 10_000 + 1000]
    if kind == "tiles":
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [tile" in plan
        tiles = [r[0] for r in grid[0].where(F.col("tile").isin(0, 3, 2 << 16 | 1)).select(F.input_file_name()).distinct().collect()]
        assert len(tiles) == 3 and set(tiles) <= set(grid[0].inputFiles()) and len(grid[0].inputFiles()) == 12
    monkeypatch.setattr(L, "MOST_TILES", 1)
    assert sorted(r.elevation for r in L.grid_lookup(locs, *grid).collect()) == sorted(r.elevation for r in found.collect())


def test_notes_and_a_plain_function(spark):
    e = Engine(spark, Settings(box=Box(), proj_lon0=0.0, proj_lat0=0.0), count=True)
    e.coast(points(spark, (0, 0)), segs(spark, [(1, 1), (2, 2)]).limit(0))
    assert any("shoreline" in n for n in e.report.notes)
    # without count, the writing job tells; nothing is known before
    e = Engine(spark, Settings(box=Box(), proj_lon0=0.0, proj_lat0=0.0))
    out = e.coast(points(spark, (0, 0), (0, 0), (90, 0), (float("nan"), 1)), segs(spark, [(1, 1), (2, 2)]))
    assert e.report.rows == 0 and not e.report.notes
    out.write.format("noop").mode("overwrite").save()
    r = e.told()
    assert (r.rows, r.unique, r.unresolved) == (4, 2, 0) and r.worst_distortion == pytest.approx(1 - math.sqrt(0.5)) and any("farthest" in n for n in r.notes)
    e.coast(points(spark, (0, 0)), segs(spark, [(150, 1), (151, 2)]))
    assert e.report.notes == []  # the crop is the globe
    small = Engine(spark, settings(8, 31, 53, 66))
    rows = small.run(points(spark, (20, 59)), sea_lookup(boxes(spark, ("X", None, 100, 0, 110, 9)))).collect()
    assert rows[0].sea_name is None and any("sea areas within" in n for n in small.report.notes) and small.told().unresolved == 1
    fields = [T.StructField("half", T.DoubleType()), T.StructField("side", T.StringType())]
    got = Engine(spark).run(points(spark, (2, 4), (6, 8), (9, 9)), row_lookup(fields, lambda lon, lat: None if lon == lat else (lon / 2, "north" if lat > 5 else "south"))).collect()
    assert {r.longitude: r.side for r in got} == {2.0: "south", 6.0: "north", 9.0: None}
    assert {r.half for r in got if r.side} == {1.0, 3.0}


def test_sea(spark):
    seas = boxes(spark, ("West", None, 16, 57, 20, 61), ("East", None, 20, 57, 24, 61))
    e = Engine(spark, settings(8, 31, 53, 66))
    rows = {r.longitude: r.sea_name for r in e.sea(points(spark, (18, 59), (22, 59), (26, 59)), seas).collect()}
    assert rows == {18.0: "West", 22.0: "East", 26.0: "East"}
    far = Engine(spark, settings(100, 110, 0, 10)).sea(points(spark, (105, 5)), seas).first()
    assert far.sea_name is None


def test_holes_are_outside(spark):
    f = boxes(spark, ("A", None, 0, 0, 10, 10)).withColumn("rings", F.expr("array_append(rings, transform(array(array(4D, 4D), array(6D, 4D), array(6D, 6D), array(4D, 6D)), v -> struct(v[0] as lon, v[1] as lat)))"))
    locs = unique_locations(with_keys(points(spark, (5, 5), (2, 2), (11, 5)), "longitude", "latitude", 3), 3)
    assert [r._klon for r in L.containing(locs, f).collect()] == [2000]


def test_place(spark):
    countries = boxes(spark, ("Sweden", "SWE", 10, 55, 18.5, 66), ("Finland", "FIN", 21.5, 55, 30, 66), ("Atlantis", None, -40, 20, -30, 30))
    towns = boxes(spark, ("Stockholm", None, 17.5, 59, 18.5, 59.8), ("Helsinki", None, 24.5, 60, 25.5, 60.5))
    e = Engine(spark, settings(-50, 40, 10, 70))
    p = points(spark, (18.07, 59.33), (20.5, 60), (-35, 25))
    rows = {r.longitude: r for r in e.place(p, countries, towns).collect()}
    assert (rows[18.07].country, rows[18.07].country_code, rows[18.07].municipality, rows[18.07].municipality_dist) == ("Sweden", "SWE", "Stockholm", 0.0)
    assert rows[20.5].country == "Finland" and rows[20.5].municipality_dist > 10
    assert rows[-35.0].country == "Atlantis" and rows[-35.0].country_code is None
    bare = e.place(p, countries)
    assert "municipality_dist" not in bare.columns and all(r.municipality is None for r in bare.collect())
    cut = {r.longitude: r for r in e.place(p, countries, towns, max_municipality_dist=50.0).collect()}
    assert cut[20.5].municipality is None and math.isnan(cut[20.5].municipality_dist) and cut[18.07].municipality == "Stockholm"


def test_nearest(spark):
    refs = spark.createDataFrame([(18.07, 59.33, "Stockholm"), (151.21, -33.87, "Sydney"), (-74.0, 40.7, "New York"), (None, 1.0, "Nowhere"), (0.0, 0.0, None)], "longitude double, latitude double, name string")
    e = Engine(spark)
    rows = {r.longitude: r for r in e.nearest(points(spark, (24.94, 60.17), (144.96, -37.81), (0.1, 0.1)), refs).collect()}
    assert rows[24.94].nearest_name == "Stockholm" and rows[144.96].nearest_name == "Sydney"
    assert rows[0.1].nearest_name is None and rows[0.1].nearest_dist < 20
    great = spark.range(1).select(S.haversine(24.94, 60.17, 18.07, 59.33)).first()[0]
    assert rows[24.94].nearest_dist == pytest.approx(great / 1000, rel=1e-6)
    none = e.nearest(points(spark, (1, 1)), refs.limit(0)).first()
    assert none.nearest_name is None and math.isnan(none.nearest_dist)
    with pytest.raises(ValueError, match="unit"):
        e.nearest(points(spark, (1, 1)), refs, unit="miles")


def test_partitioned_coast_is_near_each_point_alone(spark):
    corners = [(22, 60), (-58, -28), (152, -28), (-148, 22)]
    line = segs(spark, *[[(x + 2, y - 2), (x + 2, y + 2)] for x, y in corners])
    e = Engine(spark, Settings(partition=True))
    rows = {r.longitude: r.dist_to_coast for r in e.coast(points(spark, *corners), line).collect()}
    for x, y in corners:
        alone = Engine(spark, Settings(box=Box(), proj_lon0=float(x), proj_lat0=float(y))).coast(points(spark, (x, y)), line).first().dist_to_coast
        assert rows[float(x)] == pytest.approx(alone, rel=0.02)
    assert e.report.parts == 4 and e.report.rebuilds == 0


def test_widening_finds_a_far_coast(spark):
    e = Engine(spark, Settings(partition=True))
    rows = e.coast(points(spark, (0, 0), (1, 1), (-1, -1)), segs(spark, [(40, -5), (40, 5)])).collect()
    # the crop is as wide as its locations need at once: nothing is asked twice
    assert all(4200 < r.dist_to_coast < 4700 for r in rows) and e.report.rebuilds == 0


def test_partitioned_seas_and_places(spark):
    seas = boxes(spark, *[(f"S{i}", None, x - 3, y - 3, x + 3, y + 3) for i, (x, y) in enumerate([(22, 60), (-58, -28), (152, -28), (-148, 22)])])
    e = Engine(spark, Settings(partition=True))
    p = points(spark, (22, 60), (-58, -28), (152, -28), (-148, 22), (27, 60))
    rows = {r.longitude: (r.sea_name, r.country) for r in e.run(p, sea_lookup(seas), place_lookup(seas, seas, 10.0)).collect()}
    assert rows == {22.0: ("S0", "S0"), -58.0: ("S1", "S1"), 152.0: ("S2", "S2"), -148.0: ("S3", "S3"), 27.0: ("S0", "S0")}


def test_auto_region(spark):
    auto = lambda *p, **o: R.settle(points(spark, *p), Settings(auto=Overrides(**o)))
    s = auto((178.5, -17.5), (-179.2, -16.8), (179.9, -18.1))
    assert abs(s.proj_lon0) > 179 and (s.box.min_lon, s.box.max_lon) == (-180.0, 180.0)
    ring = auto(*[(x, 75) for x in range(-180, 180, 20)])
    assert ring.proj_lat0 > 89.9 and ring.box.max_lat == 80.0
    assert auto((10, 50), (12, 52), min_lat=0.0, proj_lon0=3.0).box == Box(5.0, 17.0, 0.0, 57.0)
    assert auto((float("nan"), 1)).box == Box() and auto((0, 0), (180, 0)).box == Box()


def test_regions_from_geojson(spark, tmp_path):
    square = lambda w, s, e, n: [[w, s], [e, s], [e, n], [w, n], [w, s]]
    import json

    def feature(name, kind, coordinates):
        return {"type": "Feature", "properties": {"NAME": name}, "geometry": {"type": kind, "coordinates": coordinates}}

    bands = [[square(w, 70, w + 90, 80)] for w in (-180, -90, 0, 90)]
    parts = [feature("Plain", "Polygon", [square(10, 20, 30, 40)]), feature("Seam", "MultiPolygon", [[square(120, 0, 180, 10)], [square(-180, -5, -100, 10)]]), feature("Round", "MultiPolygon", bands), feature(7, "Polygon", [square(0, 0, 1, 1)]), feature("  ", "Polygon", [square(0, 0, 1, 1)]), feature("Line", "LineString", [[0, 0], [1, 1]])]
    path = f"{tmp_path}/a.geojson"
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": parts}))
    f = read_features(spark, path)
    assert f.count() == 1 + 2 + 4
    rows = {r.name: tuple(r)[1:6] for r in Engine(spark).regions(f).collect()}
    assert rows == {"Plain": (10.0, 30.0, 20.0, 40.0, False), "Seam": (120.0, -100.0, -5.0, 10.0, True), "Round": (-180.0, 180.0, 70.0, 80.0, False)}
    with pytest.raises(ValueError, match="TITLE"):
        read_features(spark, path, "TITLE")
    (tmp_path / "b.geojson").write_text('{"type": "Feature"}')
    with pytest.raises(ValueError, match="FeatureCollection"):
        read_features(spark, f"{tmp_path}/b.geojson")
    with pytest.raises(ValueError, match="expected"):
        read_features(spark, f"{tmp_path}/c.gpkg")


def test_geojson_is_read_in_ranges(spark, tmp_path):
    """Many tasks for one file, the features of a whole read; where the word is inside a property or the type comes last, a whole read."""
    import json

    rng = random.Random(13)

    def feature(k, **more):
        x, y = rng.uniform(-170, 160), rng.uniform(-80, 70)
        ring = [[x, y], [x + 5, y], [x + 5, y + 5], [x, y]]
        return {"type": "Feature", "properties": {"NAME": f"n {k}", **more}, "geometry": {"type": "Polygon", "coordinates": [ring]} if k % 3 else {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}

    parts = [feature(k) for k in range(3000)]
    turned = [{k: f[k] for k in ("properties", "geometry", "type")} for f in parts[:50]]
    files = {"plain": (parts, None), "lined": (parts, 1), "word": ([feature(1, kind="Feature"), *parts[:9]], None), "nested": ([feature(1, kind={"type": "Feature"}), *parts[:9]], None), "turned": (turned, 2), "none": ([], None)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        for name, (some, indent) in files.items():
            (tmp_path / f"{name}.json").write_text(json.dumps({"type": "FeatureCollection", "name": "x", "features": some, "bbox": [1, 2, 3, 4]}, indent=indent))
            f = read_geojson(spark, f"{tmp_path}/{name}.json")
            got = f.collect()
            rows = sum(2 if x["geometry"]["type"] == "MultiPolygon" else 1 for x in some)
            assert len(got) == rows == len({r.fid for r in got})
            assert sorted({r.name for r in got}) == sorted({x["properties"]["NAME"] for x in some})
            if name in ("plain", "lined"):
                assert f.rdd.getNumPartitions() >= 8 and got == f.collect()
                assert [r.name for r in sorted(got, key=lambda r: r.fid)] == [x["properties"]["NAME"] for x in some for _ in range(2 if x["geometry"]["type"] == "MultiPolygon" else 1)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_shapefile(spark, tmp_path):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
    write_shapefile(f"{tmp_path}/GSHHS_f_L1.shp", [([ring, hole], {"NAME": "A", "CODE": "-99"}), ([ring], {"NAME": " ", "CODE": "X"})])
    f = read_features(spark, f"{tmp_path}/GSHHS_f_L1.shp")
    assert [(r.name, len(r.rings), r.xmax) for r in f.collect()] == [("A", 2, 4.0)]
    assert read_shoreline(spark, str(tmp_path)).count() == 12
    # a store that only Spark's file systems open
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shapes.link./in", f"file://{tmp_path}")
    far = read_features(spark, "viewfs://shapes/in/GSHHS_f_L1.shp")
    assert far.collect() == f.collect() and read_shoreline(spark, "viewfs://shapes/in").count() == 12
    (tmp_path / "GSHHS_f_L1.dbf").unlink()
    assert read_shoreline(spark, "viewfs://shapes/in/GSHHS_f_L1.shp").count() == 12
    with pytest.raises(ValueError, match="GSHHS"):
        read_shoreline(spark, str(tmp_path / ".."))


def test_stream(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    points(spark, (20, 59), (21, 59)).write.parquet(src)
    e = Engine(spark, settings(8, 31, 53, 66))
    stream = spark.readStream.schema("longitude double, latitude double").parquet(src)
    q = enrich_stream(stream, e, [coast_lookup(segs(spark, [(20, 58), (20, 60)]))], lambda df, _: df.write.mode("append").parquet(out), trigger={"availableNow": True}, checkpointLocation=f"{tmp_path}/c")
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 2
    with pytest.raises(ValueError, match="region"):
        enrich_stream(stream, Engine(spark, Settings(auto=Overrides())), [coast_lookup(segs(spark, [(20, 58), (20, 60)]))], print)


def _plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_against_duckdb(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rows = sorted((tuple(_plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    if name not in queries.ORACLE_SQL:
        assert rows
        return
    got = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows == sorted((tuple(_plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in got.fetchall()), key=str)


def test_entry():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_no_reference_is_lost_to_equal_order_values(spark):
    refs = spark.createDataFrame([(1, 100.0, 50.0, "far"), (1, 10.0, 50.0, "near"), (2, 10.0, 50.0, "later"), (0, 10.0, 50.0, None)], "o int, longitude double, latitude double, name string")
    at = spark.createDataFrame([(10.001, 50.0)], "longitude double, latitude double")
    assert Engine(spark).nearest(at, refs.where("o > 0"), order_by="o").first().nearest_name == "near"
    assert Engine(spark).nearest(at, refs, order_by="o").first().nearest_name is None
    assert Engine(spark).nearest(at, refs.where("o > 0")).first().nearest_name == "later"


@pytest.mark.parametrize("west", [-8.0, 150.0])
def test_descent_matches_brute_force(spark, west):
    """References around the locations, and all far from them; two of each, so that equals go to the lowest id."""
    rng = random.Random(8)
    at = [(i, 0, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(40)]
    refs = [(rng.uniform(west, west + 16), rng.uniform(-8, 8)) for _ in range(700)]
    locs = spark.createDataFrame(at, "_klon long, _klat long, lon double, lat double")
    points = spark.createDataFrame([(i + 700 * k, *r) for k in (0, 1) for i, r in enumerate(refs)], "rid long, lon double, lat double")

    def chord2(a, b):
        def unit(lon, lat):
            lon, lat = math.radians(lon), math.radians(lat)
            return math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)

        return sum((p - q) ** 2 for p, q in zip(unit(*a), unit(*b), strict=True))

    got = {r._klon: r.rid for r in L.nearest_points(locs, points).collect()}
    assert got == {i: min(range(700), key=lambda k: chord2((lon, lat), refs[k])) for i, _, lon, lat in at}
    assert L.nearest_points(locs, points.limit(0)).count() == 0


def _even_odd(lon, lat, rings):
    odd = False
    for r in rings:
        if len(r) >= 3:
            for (xj, yj), (xi, yi) in zip([r[-1], *r[:-1]], r, strict=True):
                if (yi > lat) != (yj > lat) and lon < (xj - xi) * (lat - yi) / (yj - yi) + xi:
                    odd = not odd
    return odd


def test_inside_is_even_odd_over_all_edges(spark):
    """Stars, combs, holes, shared borders, flat and thin rings; locations anywhere, on vertices and on edges."""
    rng = random.Random(9)
    ring = lambda n, r, x, y: [(x + r * (1 + 0.5 * math.cos(k * 7)) * math.cos(2 * math.pi * k / n), y + r * (1 + 0.5 * math.cos(k * 7)) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    comb = [(k / 40, 0.0 if k % 2 else 8.0) for k in range(400)] + [(10.0, 9.0), (0.0, 9.0)]
    square = lambda w, s, e, n: [(w, s), (e, s), (e, n), (w, n), (w, s)]
    shapes = [[ring(4000, 3, 5, 5)], [ring(9, 4, 3, 4), ring(5, 2, 3, 4)], [comb], [square(0, 0, 5, 5)], [square(5, 0, 10, 5), square(6, 1, 9, 4)], [[(1.0, 2.0), (9.0, 2.0), (1.0, 2.0)]], [[(2.0, 1.0), (2.0, 9.0), (2.0000001, 5.0)]], [[(0.0, 0.0), (1.0, 1.0)]], [square(2.5, 2.5, 7.5, 7.5), square(2.5, 2.5, 7.5, 7.5)]]
    at = [(rng.uniform(-1, 11), rng.uniform(-1, 11)) for _ in range(500)] + [(float(rng.randrange(11)), float(rng.randrange(11))) for _ in range(60)] + [(rng.uniform(0, 10), float(rng.randrange(10))) for _ in range(60)] + [s[0][k] for s in shapes[:3] for k in (0, 5)]
    shape = G.with_bounds(spark.createDataFrame([(i, [[(float(a), float(b)) for a, b in r] for r in rs]) for i, rs in enumerate(shapes)], "fid long, rings array<array<struct<lon: double, lat: double>>>"))
    locs = spark.createDataFrame([(i, 0, *p) for i, p in enumerate(at)], "_klon long, _klat long, lon double, lat double")
    bounds = [(min(x for r in rs for x, _ in r), max(x for r in rs for x, _ in r), min(y for r in rs for _, y in r), max(y for r in rs for _, y in r)) for rs in shapes]
    held = lambda lon, lat, b: b[0] <= lon <= b[1] and b[2] <= lat <= b[3]
    want = {(i, f) for i, p in enumerate(at) for f, rs in enumerate(shapes) if held(*p, bounds[f]) and _even_odd(*p, rs)}
    got = [(r._klon, r.fid) for r in L.inside(locs, shape).collect()]
    assert set(got) == want and len(got) == len(want)
    assert {r._klon: r.fid for r in L.containing(locs, shape).collect()} == {i: min(f for j, f in want if j == i) for i, _ in want}


def test_inner_locations_ask_no_edges(spark):
    """Of a land-locked set of locations, under 5 in 100 meet an edge of a polygon of 20,000; what edges touch grows with their number."""
    n = 20_000
    coast = [(5 + 4 * (1 + 0.02 * math.sin(k * 1.7)) * math.cos(2 * math.pi * k / n), 5 + 4 * (1 + 0.02 * math.sin(k * 1.7)) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    shape = G.with_bounds(spark.createDataFrame([(1, [coast])], "fid long, rings array<array<struct<lon: double, lat: double>>>"))
    grids, stretches, edges = L.cover(shape)
    g = grids.first()
    rows = stretches.collect()
    assert edges.count() < 8 * n and len(rows) < n
    rng, asked = random.Random(12), 0
    for _ in range(2000):
        a, r = rng.uniform(0, 2 * math.pi), 3.9 * math.sqrt(rng.random())
        j, i = int((5 + r * math.sin(a) - g.y0) / g.ch), int((5 + r * math.cos(a) - g.x0) / g.cw)
        mine = [s for s in rows if s.j == j and s.first <= i <= s.last and s.bucket == i >> L.BUCKET_BITS]
        assert len(mine) == 1
        asked += mine[0].run is not None
    assert asked < 0.05 * 2000
