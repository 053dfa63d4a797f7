"""Vector layers: files of each format made by hand."""

import io
import json
import sqlite3
import struct
import zipfile

import numpy as np
import pytest

from verdure.operators import planar
from verdure.sources import layers

WGS = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
UTM = 'PROJCS["WGS_1984_UTM_Zone_36S",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]]'


def square(x, y, s):
    return [(x, y), (x, y + s), (x + s, y + s), (x + s, y), (x, y)]  # clockwise


def shapefile(shapes, prj, names=("one", "two", "three", "")):
    shp, out = b"", []
    for i, rings in enumerate(shapes):
        if rings is None:
            body = struct.pack("<i", 0)
        else:
            points = [p for r in rings for p in r]
            starts = np.cumsum([0, *map(len, rings)])[:-1].tolist()
            body = struct.pack("<i4dii", 5, 0, 0, 0, 0, len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        out.append(struct.pack(">ii", i + 1, len(body) // 2) + body)
    shp = bytes(100) + b"".join(out)
    field = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([10]) + bytes(15)
    dbf = bytes([3, 0, 0, 0]) + struct.pack("<IHH", len(shapes), 65, 11) + bytes(20) + field + b"\r" + b"".join(b" " + n.encode().ljust(10) for n in names[: len(shapes)])
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a/x.shp", shp)
        z.writestr("a/x.dbf", dbf)
        if prj:
            z.writestr("a/x.prj", prj)
    return buffer.getvalue()


def wkb(polygons, order="<", z=False):
    def one(rings):
        points = b"".join(struct.pack(order + "I", len(r)) + b"".join(struct.pack(order + ("3d" if z else "2d"), *p, *([7.0] if z else [])) for p in r) for r in rings)
        return (b"\1" if order == "<" else b"\0") + struct.pack(order + "II", 1003 if z else 3, len(rings)) + points

    return (b"\1" if order == "<" else b"\0") + struct.pack(order + "II", 6, len(polygons)) + b"".join(map(one, polygons))


def geopackage(rows):
    db = sqlite3.connect(":memory:")
    db.executescript("CREATE TABLE gpkg_spatial_ref_sys (srs_id INT, organization_coordsys_id INT); INSERT INTO gpkg_spatial_ref_sys VALUES (4326, 4326); CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INT); INSERT INTO gpkg_geometry_columns VALUES ('fields', 'geom', 4326); CREATE TABLE fields (id INTEGER PRIMARY KEY, geom BLOB, NAME TEXT)")
    for name, body in rows:
        db.execute("INSERT INTO fields (geom, NAME) VALUES (?, ?)", (b"GP\0\3" + struct.pack("<i4d", 4326, 0, 0, 0, 0) + body if body else None, name))
    return db.serialize()


def collection(*features, **more):
    return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": g} for p, g in features], **more}).encode()


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    def go(name, raw):
        path = tmp_path_factory.mktemp("layer") / name
        path.write_bytes(raw)
        return sorted(((r.position, r.name, r.reason, r.repaired, r.geometry and [[np.array(q)[:-1] for q in p] for p in r.geometry]) for r in layers.read_layers(spark, str(path), "NAME").collect()), key=lambda r: (r[0] is not None, r[0]))

    return go


def poly(*rings):
    return {"type": "Polygon", "coordinates": [list(map(list, r)) for r in rings]}


def test_geojson(read):
    bow = [(31, -18), (31.01, -17.99), (31.01, -18), (31, -17.99), (31, -18)]
    rows = read("x.geojson", collection(({"NAME": " a "}, poly(square(31, -18, 0.01), square(31.002, -17.998, 0.002))), ({"NAME": None}, poly(square(31, -18, 0.01))), ({"NAME": "p"}, {"type": "Point", "coordinates": [1, 2]}), ({"NAME": "n"}, None), ({"NAME": 7}, poly(bow)), ({"NAME": "t"}, poly(square(31, -18, 1e-8))), ({"NAME": "s"}, poly([(31, -18), (31.01, -18), (31, -18)]))))
    assert [r[:4] for r in rows] == [(0, "a", None, False), (1, None, "missing name in column 'NAME'", False), (2, "p", "geometry must be polygonal, got 'Point'", False), (3, "n", "empty or missing geometry", False), (4, "7", None, True), (5, "t", "geometry area below 1.0 m² (degenerate)", False), (6, "s", "unparseable geometry", False)]
    assert planar.area(rows[0][4]) == pytest.approx(0.01**2 - 0.002**2)
    assert [r[2] for r in read("x.json", json.dumps(poly(square(31, -18, 0.01))).encode())] == ["name column 'NAME' not in layer"]
    assert [r[2] for r in read("y.json", b"{")] == ["could not read layer: JSONDecodeError"] and [r[2] for r in read("z.json", collection())] == ["layer has no features"]
    utm = read("u.geojson", collection(({"NAME": "u"}, poly(square(300_000, 8_030_000, 500))), crs={"properties": {"name": "urn:ogc:def:crs:EPSG::32736"}}))
    assert 31 < utm[0][4][0][0][0][0] < 32


def test_shapefile(read):
    hole = square(31.002, -17.998, 0.002)[::-1]
    rows = read("a.zip", shapefile([[square(31, -18, 0.01), hole, square(32, -18, 0.01)], [square(30, -18, 0.01)], None, [square(29, -18, 0.01)]], WGS))
    assert [r[:3] for r in rows] == [(0, "one", None), (1, "two", None), (2, "three", "empty or missing geometry"), (3, None, "missing name in column 'NAME'")]
    assert [len(p) for p in rows[0][4]] == [2, 1] and planar.area(rows[0][4]) == pytest.approx(2 * 0.01**2 - 0.002**2)
    assert read("b.zip", shapefile([[square(300_000, 8_030_000, 500)]], UTM))[0][2] is None
    assert [r[2] for r in read("c.zip", shapefile([[square(31, -18, 0.01)]], None))] == ["layer has no CRS; provide a .prj or a CRS rather than guessing"]
    assert read("d.zip", b"PK no zip")[0][2] == "could not read layer: BadZipFile"


def test_geopackage(read):
    rows = read("a.gpkg", geopackage([("one", wkb([[square(31, -18, 0.01), square(31.002, -17.998, 0.002)[::-1]], [square(32, -18, 0.01)]])), ("big", wkb([[square(31, -18, 0.01)]], ">", True)), ("none", None)]))
    assert [r[:3] for r in rows] == [(0, "one", None), (1, "big", None), (2, "none", "empty or missing geometry")]
    assert planar.area(rows[0][4]) == pytest.approx(2 * 0.01**2 - 0.002**2) and planar.area(rows[1][4]) == pytest.approx(0.01**2)


def test_first_usable_feature(spark, tmp_path):
    (tmp_path / "x.geojson").write_bytes(collection(({"NAME": ""}, poly(square(31, -18, 0.01))), ({"NAME": "b"}, poly(square(31, -18, 0.01))), ({"NAME": "c"}, poly(square(31, -18, 0.01)))))
    got = layers.area_of_interest(layers.read_layers(spark, str(tmp_path), "NAME")).collect()
    assert [r.name for r in got] == ["b"]
