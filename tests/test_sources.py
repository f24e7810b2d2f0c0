"""Formats round-trip; odd rows are left out."""

import pytest
from pyspark.sql import functions as F

from wayloom.functions import text as tx
from wayloom.operators import decompose as dc
from wayloom.sources import catalog, networks


def lines(spark):
    rows = [("a", [(1.0, 2.0, 10.0), (3.5, -4.25, 20.0)]), ("b", [(0.0, 0.0, 0.0)])]
    return spark.createDataFrame(rows, "traj_id string, pts array<struct<x:double,y:double,t:double>>")


@pytest.mark.parametrize("ext", ["wktcsv", "wkbcsv"])
@pytest.mark.parametrize("timed", [False, True])
def test_lines_round_trip(spark, tmp_path, ext, timed):
    d = lines(spark)
    if not timed:
        d = d.select("traj_id", F.transform("pts", lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))).alias("pts"))
    uri = f"{tmp_path}/l.{ext}?idCol=0&trajectoryCol=1"
    catalog.write(uri, d, timed=timed)
    got = catalog.read(spark, uri, timed)
    assert sorted(map(str, got.collect())) == sorted(map(str, d.collect()))


def test_other_geometries_are_left_out(spark, tmp_path):
    (tmp_path / "x.wktcsv").write_text("ID;TRAJECTORY\na;POINT (1 2)\nb;LINESTRING (1 2,3 4)\nc;\n")
    assert [r.traj_id for r in catalog.read(spark, f"{tmp_path}/x.wktcsv").collect()] == ["b"]


def grid(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0), (1, 3.0, 4.0), (2, 3.0, 0.0)], "v long, x double, y double")
    e = spark.createDataFrame([(0, 0, 1), (1, 1, 2)], "e long, src long, dst long")
    return v, networks.with_length(v, e)


@pytest.mark.parametrize("ext", ["maptxt", "mapjson", "net"])
def test_networks_round_trip(spark, tmp_path, ext):
    v, e = grid(spark)
    catalog.write(f"{tmp_path}/m.{ext}", v, e)
    v2, e2 = catalog.read(spark, f"{tmp_path}/m.{ext}")
    assert sorted(map(tuple, v2.select("v", "x", "y").collect())) == sorted(map(tuple, v.collect()))
    assert sorted(map(tuple, e2.select("e", "src", "dst", "length").collect())) == [(0, 0, 1, 5.0), (1, 1, 2, 4.0)]


OSM = """<?xml version="1.0"?><osm>
<node id="10" lat="52.0" lon="4.0"/><node id="11" lat="52.0" lon="4.001"/><node id="12" lat="52.001" lon="4.001"/>
<way id="1"><nd ref="10"/><nd ref="11"/><nd ref="12"/><tag k="highway" v="primary"/></way>
<way id="2"><nd ref="12"/><nd ref="10"/><tag k="highway" v="residential"/><tag k="oneway" v="yes"/></way>
<way id="3"><nd ref="10"/><nd ref="12"/><tag k="highway" v="footway"/></way>
<way id="4"><nd ref="10"/><nd ref="12"/><tag k="highway" v="primary"/><tag k="area" v="yes"/></way></osm>"""


def test_osm(spark, tmp_path):
    (tmp_path / "m.osm").write_text(OSM)
    v, e = catalog.read(spark, f"{tmp_path}/m.osm")
    assert v.count() == 3
    got = sorted((r.osm_way, r.src, r.dst) for r in e.collect())
    assert got == [(1, 0, 1), (1, 1, 0), (1, 1, 2), (1, 2, 1), (2, 2, 0)]
    lengths = {(r.src, r.dst): r.length for r in e.collect()}
    assert lengths[0, 1] == pytest.approx(68.7, abs=0.2) and lengths[1, 2] == pytest.approx(111.2, abs=0.3)


DRAWING = """<?xml version="1.0"?><ipe><page><use name="mark/disk" pos="0 0"/><use name="mark/disk" pos="10 0"/><use name="mark/disk" pos="10 10"/>
<path layer="a" stroke="black" arrow="normal">0 0 m
9 1 l</path><path layer="a" stroke="black">10 0 m
10 10 l</path></page></ipe>"""


def test_drawing(spark, tmp_path):
    (tmp_path / "m.ipe").write_text(DRAWING)
    v, e = catalog.read(spark, f"{tmp_path}/m.ipe")
    assert v.count() == 3
    assert sorted((r.src, r.dst) for r in e.collect()) == [(0, 1), (1, 2), (2, 1)]


@pytest.mark.parametrize("ext", ["fieldtxt", "fieldjson"])
def test_fields_round_trip(spark, tmp_path, ext):
    p = spark.createDataFrame([(0, 0, 5, 1.5), (0, 1, 6, 1.5), (1, 0, 7, 2.0)], "path_id long, pos long, e long, value double")
    catalog.write(f"{tmp_path}/f.{ext}", p, "net.maptxt")
    graph, got = catalog.read(spark, f"{tmp_path}/f.{ext}")
    assert graph == "net.maptxt"
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, p.collect()))


def test_flat_field_json(spark, tmp_path):
    (tmp_path / "f.fieldjson").write_text('{"graphfile": "g", "knownpaths": [[1, 2]], "pathvalues": [3.0]}')
    graph, got = catalog.read(spark, f"{tmp_path}/f.fieldjson")
    assert graph == "g" and sorted(map(tuple, got.collect())) == [(0, 0, 1, 3.0), (0, 1, 2, 3.0)]


def test_result_and_problem_round_trip(spark, tmp_path):
    b = spark.createDataFrame([(0, "r", 0, 4)], "b long, src_repr string, pos int, e long")
    c = spark.createDataFrame([(0, 1.25)], "b long, coef double")
    catalog.write(f"{tmp_path}/x.result", dc.Result(b, c, 3.5, [{"it": 0}]))
    got = catalog.read(spark, f"{tmp_path}/x.result")
    assert got.objective == 3.5 and got.log == [{"it": 0}] and got.coefs.first().coef == 1.25
    v, e = grid(spark)
    p = dc.Problem(e, v, e.selectExpr("e", "1.0D as value"), v.selectExpr("'a' as traj_id", "v as pos", "x", "y"), 2.0)
    catalog.write(f"{tmp_path}/x.problem", p)
    assert catalog.read(spark, f"{tmp_path}/x.problem").epsilon == 2.0


def test_catalog(spark):
    assert "osm" in catalog.extensions("network")
    assert catalog.default_args("a.wktcsv") == {"idCol": "0", "trajectoryCol": "1"}
    with pytest.raises(ValueError):
        catalog.format_of("a.unknown")
    assert tx.split_uri("p/a b.x?k=v&k2=a%20b") == ("p/a b.x", {"k": "v", "k2": "a b"})
    assert tx.same_uri("a?x=1&y=2", "a?y=2&x=1") and not tx.same_uri("a?x=1", "a?x=2")
    assert tx.join_uri("a", {"k": "a b"}) == "a?k=a%20b"
