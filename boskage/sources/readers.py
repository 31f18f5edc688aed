"""Tables from files: Parquet, delimited text, GeoPackage, shapefile, spreadsheet, GML and GeoTIFF.

Formats that Spark has no reader for are read file by file from ``binaryFile``, each file in
one task, with the standard library and numpy alone.  Parquet is the form for large tables.
"""

from __future__ import annotations

import io
import re
import sqlite3
import struct
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boskage.functions.geometry import strip_gpkg


class Catalog:
    """Named tables under one folder; ``views`` makes them known to SQL."""

    def __init__(self, spark: SparkSession, paths: dict[str, str]) -> None:
        self.spark, self.paths = spark, dict(paths)

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.paths[name])

    def views(self) -> None:
        for name in self.paths:
            self[name].createOrReplaceTempView(name)

    def union(self, names: list[str]) -> DataFrame:
        from boskage.operators.relational import union_all

        return union_all([self[n].withColumn("dataset", F.lit(n)) for n in names])


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ";", columns: list[str] | None = None) -> DataFrame:
    df = spark.read.csv(path, schema=schema, sep=sep, header=True, enforceSchema=False)
    return df.select(*columns) if columns else df


def read_wkt_csv(spark: SparkSession, path: str, schema: str, geometry: str, key: str, sep: str = ",") -> DataFrame:
    """A delimited table with the locations of its WKT column as x and y."""
    from boskage.operators.proximity import located

    df = read_csv(spark, path, schema, sep).withColumn("_side", F.lit(""))
    places = located(df, key, geometry, "_side").withColumnRenamed("row", key).drop("side")
    return df.drop("_side").join(places, key, "left")


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def _per_file(files: DataFrame, schema: str, read) -> DataFrame:
    """Each file's rows, by ``read(path, bytes)`` which gives data frames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content):
                yield from read(path, bytes(content))

    return files.mapInPandas(run, schema)


def read_gpkg(spark: SparkSession, path: str, schema: str, geometry: str = "geom") -> DataFrame:
    """The features of all GeoPackages in a folder; geometries come out as WKB in column ``geometry``.

    ``schema`` lists the attribute columns; those a file lacks are null.
    """
    wanted = [f.name for f in spark.createDataFrame([], schema).schema]

    def read(path: str, content: bytes) -> Iterator[pd.DataFrame]:
        db = sqlite3.connect(":memory:")
        try:
            db.deserialize(content)
            for name, column in db.execute("select table_name, column_name from gpkg_geometry_columns").fetchall():
                df = pd.read_sql_query(f'select * from "{name}"', db)
                out = pd.DataFrame({c: df[c] if c in df else None for c in wanted}, index=df.index)
                out["geometry"] = [strip_gpkg(b) for b in df[column]]
                yield out
        finally:
            db.close()

    return _per_file(_files(spark, path, "*.gpkg"), f"{schema}, geometry binary", read)


def read_shapefile(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Polygons of zipped shapefiles with the named attributes as text."""
    from boskage.functions.geometry import MULTIPOLYGON, POLYGON, signed_area, write_wkb

    def shapes(shp: bytes) -> Iterator[bytes | None]:
        at = 100
        while at + 8 <= len(shp):
            size = struct.unpack(">i", shp[at + 4 : at + 8])[0] * 2
            body = shp[at + 8 : at + 8 + size]
            at += 8 + size
            kind = struct.unpack("<i", body[:4])[0]
            if kind not in (5, 15, 25):
                yield None
                continue
            n, m = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{n}i", body[44 : 44 + 4 * n]), m]
            xy = np.frombuffer(body[44 + 4 * n : 44 + 4 * n + 16 * m], "<f8").reshape(-1, 2)
            rings = [xy[a : b - 1] for a, b in zip(starts, starts[1:])]
            parts: list = []
            for r in rings:  # outer rings run clockwise
                if signed_area(r) < 0 or not parts:
                    parts.append([r])
                else:
                    parts[-1].append(r)
            yield write_wkb(parts, POLYGON if len(parts) == 1 else MULTIPOLYGON)

    def attributes(dbf: bytes) -> pd.DataFrame:
        n, head, width = struct.unpack("<IHH", dbf[4:12])
        fields, at = [], 32
        while dbf[at] != 0x0D:
            fields.append((dbf[at : at + 11].split(b"\0")[0].decode("latin-1"), dbf[at + 16]))
            at += 32
        rows = []
        for k in range(n):
            p, row = head + k * width + 1, {}
            for name, size in fields:
                row[name] = dbf[p : p + size].decode("utf-8", "replace").strip() or None
                p += size
            rows.append(row)
        return pd.DataFrame(rows, columns=[f[0] for f in fields])

    def read(path: str, content: bytes) -> Iterator[pd.DataFrame]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in (n for n in z.namelist() if n.lower().endswith(".shp")):
                df = attributes(z.read(name[:-4] + ".dbf"))
                out = pd.DataFrame({c: df[c] if c in df else None for c in columns}, index=df.index)
                out["geometry"] = list(shapes(z.read(name)))
                yield out

    return _per_file(_files(spark, path, "*.zip"), ", ".join([*(f"`{c}` string" for c in columns), "geometry binary"]), read)


def read_xlsx(spark: SparkSession, path: str, sheet: str, header: int, columns: list[str]) -> DataFrame:
    """A sheet of spreadsheets as text; ``header`` is the number of the row (from 0) that names the columns."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

    def read(path: str, content: bytes) -> Iterator[pd.DataFrame]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            strings = []
            if "xl/sharedStrings.xml" in z.namelist():
                strings = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
            book = ElementTree.fromstring(z.read("xl/workbook.xml"))
            ids = {s.get("name"): s.get(rel) for s in book.iter(f"{{{ns['m']}}}sheet")}
            targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            rows: list[dict[int, str | None]] = []
            for row in ElementTree.fromstring(z.read(str(PurePosixPath("xl") / targets[ids[sheet]].lstrip("/").removeprefix("xl/")))).iter(f"{{{ns['m']}}}row"):
                cells = {}
                for c in row.findall("m:c", ns):
                    letters = re.match("[A-Z]+", c.get("r"))[0]
                    place = 0
                    for letter in letters:
                        place = place * 26 + ord(letter) - 64
                    value = c.find("m:v", ns)
                    inline = c.find("m:is", ns)
                    text = "".join(t.text or "" for t in inline.iter(f"{{{ns['m']}}}t")) if inline is not None else None if value is None else value.text
                    cells[place] = strings[int(text)] if c.get("t") == "s" and text is not None else text
                while len(rows) < int(row.get("r")) - 1:
                    rows.append({})
                rows.append(cells)
        names = {name: place for place, name in rows[header].items()} if len(rows) > header else {}
        yield pd.DataFrame([{c: r.get(names.get(c, -1)) for c in columns} for r in rows[header + 1 :] if r], columns=columns, dtype=object)

    return _per_file(_files(spark, path, "*.xlsx"), ", ".join(f"`{c}` string" for c in columns), read)


def read_gml(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight) of graphs in Graph Modelling Language."""

    def read(path: str, content: bytes) -> Iterator[pd.DataFrame]:
        text = content.decode("utf-8", "replace")
        label = {int(i): int(t) for i, t in re.findall(r'node\s*\[\s*id\s+(\d+)\s+label\s+"(-?\d+)"', text)}
        rows = []
        for body in re.findall(r"edge\s*\[([^\]]*)\]", text):
            own = dict(re.findall(r"(\w+)\s+(\S+)", body))
            a, b = int(own["source"]), int(own["target"])
            rows.append((label.get(a, a), label.get(b, b), float(own.get("weight", 1))))
        yield pd.DataFrame(rows, columns=["src", "dst", "weight"])

    return _per_file(_files(spark, path, "*.gml"), "src bigint, dst bigint, weight double", read)


def geotiff(content: bytes) -> tuple[np.ndarray, dict]:
    """The first band of a GeoTIFF, and its affine, nodata and code of reference system.

    Strips and tiles, uncompressed or deflate, LZW, with or without horizontal prediction.
    """
    order = "<" if content[:2] == b"II" else ">"
    at = struct.unpack(order + "I", content[4:8])[0]
    size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 11: 4, 12: 8, 16: 8}
    code = {1: "B", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
    tags: dict = {}
    for k in range(struct.unpack(order + "H", content[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", content[at + 2 + 12 * k : at + 10 + 12 * k])
        p = at + 10 + 12 * k
        if size.get(kind, 1) * n > 4:
            p = struct.unpack(order + "I", content[p : p + 4])[0]
        raw = content[p : p + size.get(kind, 1) * n]
        tags[tag] = raw if kind == 2 else struct.unpack(f"{order}{n}{code[kind]}", raw) if kind in code else raw
    one = lambda t, d=None: tags.get(t, (d,))[0]
    w, h, bits, form, method, predictor = one(256), one(257), one(258, 1), one(339, 1), one(259, 1), one(317, 1)
    kind = np.dtype(f"{order}{'uif'[form - 1]}{bits // 8}")
    tiled = 324 in tags
    tw, th = (one(322), one(323)) if tiled else (w, one(278, h))
    out = np.zeros((h, w), kind.newbyteorder("="))
    across = -(-w // tw)
    for k, (p, n) in enumerate(zip(tags[324 if tiled else 273], tags[325 if tiled else 279])):
        raw = content[p : p + n]
        if method in (8, 32946):
            raw = zlib.decompress(raw)
        elif method == 5:
            raw = lzw(raw)
        elif method != 1:
            raise ValueError(f"compression {method} isn't supported")
        r0, c0 = k // across * th, k % across * tw
        rows = th if tiled else min(th, h - r0)
        block = np.frombuffer(raw, kind, rows * tw).reshape(rows, tw).astype(out.dtype)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        out[r0 : r0 + rows, c0 : c0 + tw] = block[: h - r0, : w - c0]
    info: dict = {"nodata": float(tags[42113].split(b"\0")[0]) if 42113 in tags else None, "srid": None}
    if 33550 in tags:
        (sx, sy, _), (i, j, _, x, y, _) = tags[33550][:3], tags[33922][:6]
        info["affine"] = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    if 34735 in tags:
        keys = tags[34735]
        info["srid"] = next((keys[k + 3] for k in range(4, len(keys), 4) if keys[k] in (3072, 2048)), None)
    return out, info


def lzw(data: bytes) -> bytes:
    """TIFF's variant: most significant bit first, codes grow one early."""
    out, table, width, acc, bits, old = bytearray(), [], 9, 0, 0, None
    fresh = [bytes([i]) for i in range(256)] + [b"", b""]
    for byte in data:
        acc, bits = (acc << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        c = acc >> bits
        acc &= (1 << bits) - 1
        if c == 256:
            table, width, old = list(fresh), 9, None
            continue
        if c == 257:
            break
        entry = table[c] if c < len(table) else old + old[:1]
        out += entry
        if old is not None:
            table.append(old + entry[:1])
        old = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def read_geotiff(spark: SparkSession, path: str) -> DataFrame:
    """(raster_id, row, col, value): the pixels of all GeoTIFFs in a folder but those without data, a strip of rows at a time."""

    def read(path: str, content: bytes) -> Iterator[pd.DataFrame]:
        band, info = geotiff(content)
        name = PurePosixPath(path).name
        for r0 in range(0, len(band), 256):
            part = band[r0 : r0 + 256]
            rows, cols = np.nonzero(part != info["nodata"]) if info["nodata"] is not None else np.nonzero(np.ones(part.shape, bool))
            yield pd.DataFrame({"raster_id": name, "row": (rows + r0).astype("int32"), "col": cols.astype("int32"), "value": part[rows, cols].astype(float)})

    return _per_file(_files(spark, path, "*.tif*"), "raster_id string, row int, col int, value double", read)


def geotiff_headers(spark: SparkSession, path: str) -> DataFrame:
    """(raster_id, height, width, a..f, nodata, srid) of the GeoTIFFs in a folder."""

    def read(path: str, content: bytes) -> Iterator[pd.DataFrame]:
        band, info = geotiff(content)
        a, b, c, d, e, f = info.get("affine", (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))
        yield pd.DataFrame({"raster_id": [PurePosixPath(path).name], "height": [band.shape[0]], "width": [band.shape[1]], "a": [a], "b": [b], "c": [c], "d": [d], "e": [e], "f": [f], "nodata": [info["nodata"]], "srid": [info["srid"]]})

    return _per_file(_files(spark, path, "*.tif*"), "raster_id string, height int, width int, a double, b double, c double, d double, e double, f double, nodata double, srid int", read)


def year_of(name) -> F.Column:
    """The first run of four digits between underscores of a file name."""
    return F.regexp_extract(name, r"(?:^|[_/])(\d{4})(?=[_.]|$)", 1).cast("int")


def date_of(name) -> F.Column:
    """The date in the second to last part of a file name."""
    return F.to_date(F.regexp_extract(name, r"_(\d{8})_[^_]*$", 1), "yyyyMMdd")
