"""Vector layers from files: GeoJSON, zipped shapefiles and GeoPackages (S26, S30, K26, K27, H7, H12, H15, Q-19).

Files come through Spark's binary reader, so any store that it reads will do, and
each is parsed in a task of its own (an upload fits one); the features are rows
from there on and are validated, repaired and reprojected as such.
"""

from __future__ import annotations

import io
import json
import re
import sqlite3
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdure.operators import planar
from verdure.operators.overlay import MULTI, packed, validated
from verdure.operators.planar import Geometry

Feature = tuple[str | None, Geometry | None, dict]
_RAW = f"file string, position int, name string, named boolean, kind string, geometry {MULTI}, epsg int, problem string"
#: Shape types of polygons, plain, with heights and with measures.
_POLYGONS = (5, 15, 25)
#: Features that are passed on at once.
_MANY = 500


def _rings(rings: list) -> list[np.ndarray]:
    return [np.array([p[:2] for p in r], float).reshape(-1, 2) for r in rings]


def _geojson(raw: bytes) -> tuple[int | None, list[Feature]]:
    doc = json.loads(raw.decode("utf-8-sig"))
    kind = doc.get("type")
    features = doc["features"] if kind == "FeatureCollection" else [doc] if kind == "Feature" else [{"geometry": doc, "properties": {}}]
    named = re.search(r"(\d+)$", str(((doc.get("crs") or {}).get("properties") or {}).get("name", "4326")).replace("CRS84", "4326"))
    out = []
    for f in features:
        g = f.get("geometry") or {}
        c = g.get("coordinates") or []
        shape = [_rings(c)] if g.get("type") == "Polygon" else [_rings(p) for p in c] if g.get("type") == "MultiPolygon" else None
        out.append((g.get("type"), shape if shape != [[]] else [], f.get("properties") or {}))
    return int(named.group(1)) if named else None, out


def _epsg_of(wkt: str) -> int | None:
    """The code of a projection file: its last authority, else the plain names of WGS 84 and its southern UTM zones."""
    if codes := re.findall(r'(?:AUTHORITY|ID)\["EPSG",\s*"?(\d+)"?\]\]?\s*\]?\s*$', wkt.strip()):
        return int(codes[-1])
    if zone := re.search(r"WGS_?\s?(?:19)?84[_ /]+UTM[_ ]zone[_ ](\d+)S", wkt, re.I):
        return 32700 + int(zone.group(1))
    return 4326 if re.match(r'\s*GEOGCS\["(GCS_)?WGS[_ ](19)?84"', wkt) else None


def _grouped(rings: list[np.ndarray]) -> Geometry:
    """Rings of a shapefile as polygons: clockwise ones are shells, the others holes of the smallest shell around them."""
    rings = [r for r in map(planar.opened, rings) if len(r)]
    shells = [[r] for r in rings if len(r) < 3 or planar.signed_area(r) <= 0]
    by_size = sorted(shells, key=lambda p: abs(planar.signed_area(p[0])))
    for r in rings:
        if len(r) > 2 and planar.signed_area(r) > 0:
            at = planar.inner_point(r)
            home = next((p for p in by_size if planar.covers_point(p[:1], *at)), None)
            if home is None:
                shells.append([r])
            else:
                home.append(r)
    return shells


def _shapefile(raw: bytes) -> tuple[int | None, list[Feature]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = {n.rsplit(".", 1)[-1].lower(): n for n in reversed(z.namelist()) if not n.startswith("__MACOSX")}
        shp, dbf = z.read(names["shp"]), z.read(names["dbf"])
        epsg = _epsg_of(z.read(names["prj"]).decode("utf-8", "replace")) if "prj" in names else None
        code = z.read(names["cpg"]).decode("ascii", "replace").strip() if "cpg" in names else "utf-8"
    rows, head, width = struct.unpack("<IHH", dbf[4:12])
    fields, at = [], 1
    for i in range(32, head - 1, 32):
        name, size = dbf[i : i + 11].split(b"\0")[0].decode("ascii", "replace"), dbf[i + 16]
        fields.append((name, at, at + size))
        at += size
    records = [dbf[head + i * width : head + (i + 1) * width] for i in range(rows)]
    tables = [{n: r[a:b].decode(code, "replace").strip(" \0") or None for n, a, b in fields} for r in records]
    out, at = [], 100
    while at + 12 <= len(shp):
        size = 2 * struct.unpack(">i", shp[at + 4 : at + 8])[0]
        body = shp[at + 8 : at + 8 + size]
        at += 8 + size
        (kind,) = struct.unpack("<i", body[:4])
        shape = None
        if kind in _POLYGONS:
            parts, points = struct.unpack("<ii", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
            shape = _grouped([xy[a:b] for a, b in zip(starts, starts[1:], strict=False)])
        out.append(("MultiPolygon" if kind in _POLYGONS else None if kind == 0 else f"shape {kind}", shape, tables[len(out)] if len(out) < len(tables) else {}))
    return epsg, out


def _wkb(raw: bytes, at: int = 0) -> tuple[str, Geometry | None, int]:
    """A geometry of well-known binary: its kind, its polygons, and where it ends."""
    order = "<" if raw[at] else ">"
    (code,) = struct.unpack_from(order + "I", raw, at + 1)
    at += 5
    if code & 0x20000000:
        at += 4
    wide = 2 + bool(code & 0x80000000) + bool(code & 0x40000000) if code > 0xFFFF else (2, 3, 3, 4)[code // 1000 % 4]
    kind = code & 0xFFFF if code > 0xFFFF else code % 1000
    if kind == 3:
        (n,) = struct.unpack_from(order + "I", raw, at)
        rings, at = [], at + 4
        for _ in range(n):
            (m,) = struct.unpack_from(order + "I", raw, at)
            rings.append(np.frombuffer(raw, order + "f8", m * wide, at + 4).reshape(m, wide)[:, :2])
            at += 4 + 8 * m * wide
        return "Polygon", [rings] if rings else [], at
    if kind == 6:
        (n,) = struct.unpack_from(order + "I", raw, at)
        out, at = [], at + 4
        for _ in range(n):
            _, g, at = _wkb(raw, at)
            out += g or []
        return "MultiPolygon", out, at
    return f"geometry {kind}", None, at


def _geopackage(raw: bytes) -> tuple[int | None, list[Feature]]:
    db = sqlite3.connect(":memory:")
    db.deserialize(raw)
    db.row_factory = sqlite3.Row
    layer = db.execute("SELECT g.table_name, g.column_name, s.organization_coordsys_id AS epsg FROM gpkg_geometry_columns g LEFT JOIN gpkg_spatial_ref_sys s ON g.srs_id = s.srs_id ORDER BY g.rowid LIMIT 1").fetchone()
    out = []
    table = layer["table_name"].replace('"', '""')
    for row in db.execute(f'SELECT * FROM "{table}" ORDER BY rowid'):
        have = dict(row)
        blob = have.pop(layer["column_name"])
        kind, shape = None, None
        if blob and not blob[3] & 0x10:
            kind, shape, _ = _wkb(blob, 8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7])
        out.append((kind, shape, have))
    return layer["epsg"] if layer["epsg"] and layer["epsg"] > 0 else None, out


_READERS = {"geojson": _geojson, "json": _geojson, "zip": _shapefile, "gpkg": _geopackage}


def _parsed(name_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("file", pa.string()), ("position", pa.int32()), ("name", pa.string()), ("named", pa.bool_()), ("kind", pa.string()), ("geometry", None), ("epsg", pa.int32()), ("problem", pa.string())]

        def out(rows: list[dict]) -> pa.RecordBatch:
            shapes = packed([None if r["geometry"] is None else [[planar.opened(q) for q in p] for p in r["geometry"]] for r in rows])
            return pa.RecordBatch.from_arrays([shapes if t is None else pa.array([r[n] for r in rows], t) for n, t in kinds], names=[n for n, _ in kinds])

        for batch in batches:
            for file, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                none = {"file": file, "position": None, "name": None, "named": False, "kind": None, "geometry": None, "epsg": None}
                try:
                    epsg, found = _READERS[file.rsplit(".", 1)[-1].lower()](raw)
                except Exception as e:  # a file that can't be read is one row
                    yield out([none | {"problem": f"could not read layer: {type(e).__name__}"}])
                    continue
                problem = "layer has no CRS; provide a .prj or a CRS rather than guessing" if epsg is None else None
                if not problem and not any(name_column in p for *_, p in found):
                    problem = f"name column '{name_column}' not in layer" if found else "layer has no features"
                if problem:
                    yield out([none | {"problem": problem}])
                    continue
                rows = []
                for i, (kind, shape, properties) in enumerate(found):
                    name = properties.get(name_column)
                    short = shape is not None and any(0 < len(r) < 3 for p in shape for r in p)
                    rows.append(none | {"position": i, "name": None if name is None else str(name).strip(), "named": True, "kind": kind, "geometry": shape, "epsg": epsg, "problem": "unparseable geometry" if short else None})
                    if len(rows) == _MANY:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    return run


def read_layers(spark: SparkSession, path: str, name_column: str) -> DataFrame:
    """One row a feature of the files at path (a file, folder or pattern): file, position, name, geometry in degrees, epsg, repaired, reason.

    A feature with a reason is skipped: it has no polygon, no name, or one that
    can't be used. A file that has no coordinate system, lacks the name column,
    has no features or can't be read is one row without a position. Nothing is guessed.
    """
    return parse_layers(spark.read.format("binaryFile").load(path).select("path", "content"), name_column)


def parse_layers(raw: DataFrame, name_column: str) -> DataFrame:
    """The same of files that are rows already: path and content."""
    rows = raw.select("path", "content").mapInArrow(_parsed(name_column), _RAW)
    checked = rows.withColumn("c", validated(F.col("kind"), F.col("geometry"), F.col("epsg")))
    empty = F.col("geometry").isNull() & F.col("kind").isNull() | (F.size("geometry") == 0)
    reason = F.when(F.col("problem").isNotNull(), F.col("problem")).when(empty, "empty or missing geometry").when(F.coalesce(F.col("name"), F.lit("")) == "", f"missing name in column '{name_column}'").when(~F.col("c.ok"), F.col("c.reason"))
    return checked.select("file", "position", F.nullif("name", F.lit("")).alias("name"), F.when(reason.isNull(), F.col("c.geometry")).alias("geometry"), "epsg", (reason.isNull() & F.col("c.repaired")).alias("repaired"), reason.alias("reason"))


def usable(layers: DataFrame) -> DataFrame:
    """K27, Q-19: layer (file), region (position), name and geometry of the features that can be used; of a layer without any nothing."""
    return layers.where("reason IS NULL").select(F.col("file").alias("layer"), F.col("position").alias("region"), "name", "geometry")


def area_of_interest(layers: DataFrame) -> DataFrame:
    """The first feature of each file that can be used."""
    return usable(layers).groupBy("layer").agg(F.min_by(F.struct("name", "geometry"), "region").alias("a")).select("layer", "a.name", "a.geometry")


def kind(read_only: Column, source: Column) -> Column:
    """How a layer came about."""
    return F.when(read_only, "seeded").when(source == "analyst-draw", "drawn").otherwise("uploaded")
