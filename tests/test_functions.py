"""Formulas, options, formats: facts that need no join."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark import cli
from tidemark.functions import spatial as S
from tidemark.operators import geometry as G
from tidemark.operators.locations import check_clashes, coordinate, join_back, unique_locations, with_keys
from tidemark.plans import partition as P
from tidemark.plans.settings import Box, Overrides, read_config, region_box, region_names, resolve, suggestions
from tidemark.sources.areas import SEA_AREAS
from tidemark.sources.netcdf import write_grid
from tidemark.sources.tables import default_output, format_of, read_table, write_table


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_projection_round_trip_and_limits(spark):
    for lon, lat in ((24.94, 60.17), (10.0, 10.0), (-75.0, 40.0), (179.0, -45.0)):
        x, y = S.laea_forward(lon, lat, 18.0, 59.0)
        back = one(spark, *S.laea_inverse(x, y, 18.0, 59.0))
        assert abs((back.c0 - lon + 180) % 360 - 180) < 1e-7 and abs(back.c1 - lat) < 1e-7
    r = one(spark, *S.laea_forward(18.0, 59.0, 18.0, 59.0), S.haversine(24.94, 60.17, 18.07, 59.33))
    assert abs(r.c0) < 1e-6 and abs(r.c1) < 1e-6 and 390_000 < r.c2 < 402_000
    e = one(spark, S.laea_error(F.lit(math.radians(22))), S.laea_error(F.lit(math.radians(24))), S.laea_radius(0.02))
    assert abs(e.c0) < 0.02 < abs(e.c1)
    assert abs(one(spark, S.laea_error_at(F.lit(e.c2))).c0) == pytest.approx(0.02, abs=1e-9)


def test_chord_equals_haversine(spark):
    a, b = S.unit_sphere(24.94, 60.17), S.unit_sphere(18.07, 59.33)
    c2 = sum(((p - q) ** 2 for p, q in zip(a, b, strict=True)), F.lit(0.0))
    r = one(spark, S.chord_metres(c2), S.haversine(24.94, 60.17, 18.07, 59.33))
    assert r.c0 == pytest.approx(r.c1, rel=1e-9)


def test_segment_distance_clamps_and_degenerates(spark):
    d = lambda *v: S.segment_distance2(*[F.lit(float(x)) for x in v])
    assert tuple(one(spark, d(0, 1, -1, 0, 1, 0), d(3, 0, -1, 0, 1, 0), d(3, 4, 0, 0, 0, 0))) == (1.0, 4.0, 25.0)


def test_longitudes(spark):
    r = one(spark, S.norm360(-10.0), S.to180(F.lit(180.0)), S.to180(F.lit(190.0)), S.normalize_lon(-190.0), S.normalize_lon(180.0))
    assert tuple(r) == (350.0, 180.0, -170.0, 170.0, -180.0)
    assert tuple(one(spark, *S.edge_interval(170.0, -170.0))) == (170.0, 20.0)


def test_axis_index(spark):
    i = lambda q: S.axis_index(F.lit(q), 0.0, 1.0, 3)
    assert tuple(one(spark, i(-0.5), i(-0.51), i(1.5), i(2.5), i(2.51), S.axis_index(F.lit(0.0), 0.0, 0.0, 3))) == (0, None, 2, 2, None, None)


def test_coordinates_cast_and_keys(spark):
    df = spark.createDataFrame([("1.5", 2.0), ("abc", 1.0), (None, 1.0), ("inf", 1.0), ("NaN", 1.0), ("1.4996", 2.0004)], "longitude string, latitude double")
    keyed = with_keys(df, "longitude", "latitude", 3)
    assert [(r._klon, r._klat) for r in keyed.collect()] == [(1500, 2000), (None, None), (None, None), (None, None), (None, None), (1500, 2000)]
    assert unique_locations(keyed, 3).count() == 1
    with pytest.raises(ValueError, match="no column 'x'"):
        coordinate(df, "x")
    # half away from zero on the scaled value
    r = with_keys(spark.createDataFrame([(-129.9475, 0.0)], "longitude double, latitude double"), "longitude", "latitude", 3).first()
    assert r._klon == -129948 or r._klon == round(-129.9475 * 1000)


def test_clashes(spark):
    df = spark.createDataFrame([(1.0, "a", 2.0)], "longitude double, val string, latitude double")
    with pytest.raises(ValueError, match="val"):
        check_clashes(df, ["val"], False)
    check_clashes(df, ["val"], True)
    with pytest.raises(ValueError, match="case"):
        check_clashes(df, ["VAL"], True)


def test_join_back_keeps_position_and_nan(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([(18.0, "a", 59.0), (float("nan"), "b", 59.0)], "longitude double, val string, latitude double")
    keyed = with_keys(df, "longitude", "latitude", 3)
    found = unique_locations(keyed, 3).select("_klon", "_klat", (F.col("lon") + 1).alias("val"), F.lit("x").alias("tag"))
    out = join_back(keyed, found, [T.StructField("val", T.DoubleType()), T.StructField("tag", T.StringType())])
    assert out.columns == ["longitude", "val", "latitude", "tag"]
    rows = {r.tag: r.val for r in out.collect()}
    assert rows["x"] == 19.0 and math.isnan(rows[None])
    assert join_back(keyed, found, [T.StructField("val", T.DoubleType()), T.StructField("tag", T.StringType())], null_floats=True).where("val is null").count() == 1


def test_formats_and_default_output():
    assert [format_of(p) for p in ("a.parquet", "a.PQ", "a.TSV.gz", "a.csv.gz", "a.tsv", "a.CSV", "a.bin")] == ["parquet", "parquet", "tsv.gz", "csv.gz", "tsv", "csv", "parquet"]
    made = {"dir/cores.parquet": "dir/cores.sea.parquet", "cores.csv": "cores.sea.csv", "cores.tsv": "cores.sea.tsv", "cores.csv.gz": "cores.sea.csv.gz", "cores.pq": "cores.sea.parquet", "cores.dat": "cores.sea.parquet"}
    assert {p: default_output(p, "sea") for p in made} == made
    assert default_output("cores.dat", "sea", "tsv") == "cores.sea.tsv"
    with pytest.raises(ValueError, match="unknown format"):
        format_of("a", "xls")


@pytest.mark.parametrize("end", ["parquet", "csv", "tsv", "csv.gz", "tsv.gz"])
def test_table_round_trip(spark, tmp_path, end):
    df = spark.createDataFrame([(1.5, "a\tb", float("nan")), (2.0, None, 3.0)], "longitude double, name string, v double")
    write_table(df, f"{tmp_path}/t.{end}", single_file=True)
    got = read_table(spark, f"{tmp_path}/t.{end}")
    rows = {r.longitude: (r.name, r.v) for r in got.collect()}
    assert rows[2.0] == (None, 3.0) and rows[1.5][0] == "a\tb" and math.isnan(rows[1.5][1])


def test_region_names_and_suggestions():
    assert len(SEA_AREAS) == 101 and len(region_names()) == 109
    assert region_box("BALTIC") == Box(8.0, 31.0, 53.0, 66.0)
    assert region_box("adriatic sea").min_lon == 12.0652
    assert sum(a[5] for a in SEA_AREAS) == 4
    for name in (a[0] for a in SEA_AREAS if a[5]):
        with pytest.raises(ValueError, match="antimeridian"):
            region_box(name)
    assert "Barentsz Sea" in suggestions("Barent Sea") and suggestions("zzzz") == []
    with pytest.raises(ValueError, match="did you mean"):
        region_box("Barent Sea")


def test_settings_precedence(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('region = "norway"\nmin_lon = -5\nother = 1\n')
    assert read_config(f) == {"region": "norway", "min_lon": -5}
    s = resolve(config=f)
    assert s.box == Box(-5.0, 45.0, 55.0, 85.0) and s.proj_lon0 == 20.0 and s.auto is None
    assert resolve("baltic", config=f).box == Box(-5.0, 31.0, 53.0, 66.0)
    assert resolve("baltic", Overrides(min_lon=9.0), f).box.min_lon == 9.0
    assert resolve().auto == Overrides() and resolve("AUTO", Overrides(max_lat=3.0)).auto == Overrides(max_lat=3.0)
    for bad in (dict(explicit=Overrides(min_lon=5.0, max_lon=4.0)), dict(region="nowhere"), dict(region="baltic", partition=True)):
        with pytest.raises(ValueError):
            resolve(**bad)


def _arc(spark, lons):
    df = spark.createDataFrame([(float(x),) for x in lons], "lon double")
    return tuple(G.covering_arc(df, F.col("lon"), F.col("lon"), []).first())


def test_covering_arc(spark):
    assert _arc(spark, [10, 20, 15]) == (10.0, 20.0, False)
    assert _arc(spark, [178.5, -179.2, 179.9]) == (178.5, pytest.approx(-179.2), True)
    assert _arc(spark, np.arange(0, 360, 0.5)) == (-180.0, 180.0, False)


def test_partitions():
    lon, lat = (a.ravel() for a in np.meshgrid(np.arange(-180, 180, 15.0), np.arange(-60, 61, 15.0)))
    v = P._vectors(lon, lat)
    parts = P.split(v, np.ones(len(v)), 0.02)
    assert sorted(np.concatenate([p.members for p in parts])) == list(range(216))
    assert max(p.distortion for p in parts) <= 0.02 and 20 < len(parts) < 64
    assert len(P.split(v, np.ones(len(v)), 0.005)) > len(parts)
    again = P.split(v, np.ones(len(v)), 0.02)
    assert [p.members.tolist() for p in again] == [p.members.tolist() for p in parts]
    assert len(P.split(P._vectors(np.array([0.0, 180.0]), np.zeros(2)), np.ones(2), 0.02)) == 2
    assert len(P.split(P._vectors(np.array([22, 21.5, 23.0]), np.array([60, 59, 61.5])), np.ones(3), 0.02)) == 1


def test_partition_by_cells_keeps_the_bound(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.uniform(-180, 180, 3000), rng.uniform(-80, 80, 3000), strict=True)], "longitude double, latitude double")
    locs = unique_locations(with_keys(df, "longitude", "latitude", 3), 3)
    owned, parts = P.partition(locs)
    assert owned.count() == locs.count() and parts.agg(F.sum("members")).first()[0] == locs.count()
    worst = owned.select(F.max(F.abs(S.laea_error_at(S.haversine(F.col("clon"), F.col("clat"), F.col("lon"), F.col("lat")))))).first()[0]
    assert worst <= 0.02 and parts.where("distortion > 0.02").count() == 0
    outside = owned.join(parts.drop("clon", "clat"), "pid").where("lat < min_lat or lat > max_lat or lon < min_lon or lon > max_lon")
    assert outside.count() == 0
    # one more row in a cell that has one already leaves the parts as they are
    more = unique_locations(with_keys(df.union(df.limit(1).selectExpr("longitude + 0.001", "latitude")), "longitude", "latitude", 3), 3)
    assert abs(P.partition(more)[1].count() - parts.count()) <= 1
    with pytest.raises(ValueError, match="no usable"):
        P.partition(locs.limit(0))


@pytest.mark.parametrize("rows", [0, 1, 5000])
def test_gzip_by_the_stated_format(spark, tmp_path, rows):
    import gzip

    (tmp_path / "in").mkdir()
    head = "longitude,latitude,name\n"
    for k in range(2):
        text = head + "".join(f'{i}.5,{k},"a, {i}"\n' for i in range(rows))
        (tmp_path / "in" / f"p{k}.bin").write_bytes(gzip.compress(text[:30].encode()) + gzip.compress(text[30:].encode()))
    got = read_table(spark, str(tmp_path / "in"), "csv.gz")
    assert got.columns == ["longitude", "latitude", "name"]
    assert sorted((float(r.longitude), int(r.latitude), r.name) for r in got.collect()) == sorted((i + 0.5, k, f"a, {i}") for k in range(2) for i in range(rows))


def test_gzip_streams_and_headers(spark, tmp_path):
    """Pieces of any size give the same lines, few at a time; files of different headers are refused."""
    import gzip
    import io

    from tidemark.sources.tables import _batches, _pieces

    lines = [f"line {i} é{'x' * (i % 90)}" for i in range(60_000)]
    text = "\n".join(lines).encode()
    packed = gzip.compress(text[:1_000_000]) + gzip.compress(b"") + gzip.compress(text[1_000_000:])
    for size in (1 << 20, 1000, 7):
        pieces = (packed[i : i + size] for i in range(0, len(packed), size)) if size < 1 << 20 else _pieces(io.BytesIO(packed))
        got = list(_batches(pieces))
        assert [v for b in got for v in b.column(0).to_pylist()] == lines
        assert [v for b in got for v in b.column(1).to_pylist()] == [True] + [False] * (len(lines) - 1)
        assert max(b.nbytes for b in got) < 4 << 20
    (tmp_path / "in").mkdir()
    for k, head in enumerate(("a,b", "b,a")):
        (tmp_path / "in" / f"p{k}.bin").write_bytes(gzip.compress(f"{head}\n1,2\n".encode()))
    with pytest.raises(ValueError, match="header"):
        read_table(spark, str(tmp_path / "in"), "csv.gz")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.packed.link./in", f"file://{tmp_path}/in")
    assert [tuple(r) for r in read_table(spark, "viewfs://packed/in/p0.bin", "csv.gz").collect()] == [(1, 2)]


def test_one_file_replaces_what_was_there(spark, tmp_path):
    for n in (3, 5):
        write_table(spark.range(n), f"{tmp_path}/one.parquet", single_file=True)
        assert (tmp_path / "one.parquet").is_file() and read_table(spark, f"{tmp_path}/one.parquet").count() == n
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["one.parquet"]


def test_command_line(spark, tmp_path, capsys):
    for shell in cli.SHELLS:
        assert cli.main(["completions", shell]) == 0
        assert "coast" in capsys.readouterr().out
    assert cli.main(["regions", "--name", "baltic"], spark) == 0
    out = capsys.readouterr().out
    assert "Baltic Sea" in out and "53.00" in out
    assert cli.main(["regions", "--name", "nothing like it"], spark) == 2
    df = spark.createDataFrame([(24.94, 60.17), (144.96, -37.81)], "longitude double, latitude double")
    refs = spark.createDataFrame([(18.07, 59.33, "Stockholm"), (151.21, -33.87, "Sydney")], "longitude double, latitude double, name string")
    write_table(df, f"{tmp_path}/in.csv")
    write_table(refs, f"{tmp_path}/to.parquet")
    assert cli.main(["nearest", f"{tmp_path}/in.csv", "--to", f"{tmp_path}/to.parquet"], spark) == 0
    assert {r.nearest_name for r in read_table(spark, f"{tmp_path}/in.nearest.csv").collect()} == {"Stockholm", "Sydney"}
    assert cli.main(["coast", "x.csv", "--data", "y", "--partition", "--region", "baltic"], spark) == 2
    write_grid(f"{tmp_path}/g.nc", [-90.0, 0.0, 90.0], [-180.0, 0.0, 180.0], [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [7.0, 8.0, 9.0]])
    assert cli.main(["enrich", f"{tmp_path}/in.csv", "--depth", f"{tmp_path}/g.nc", "--to", f"{tmp_path}/to.parquet", "--keep", f"{tmp_path}/kept", "-o", f"{tmp_path}/all.parquet"], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/all.parquet").columns == ["longitude", "latitude", "bathymetry", "nearest_name", "nearest_dist"]
    step = spark.read.parquet(f"{tmp_path}/kept/step0.depth.parquet")
    assert step.columns == ["longitude", "latitude", "bathymetry"] and sorted(r.bathymetry for r in step.collect()) == [6.0, 8.0]
    assert "2 rows, 2 locations, 0 unresolved" in capsys.readouterr().err
