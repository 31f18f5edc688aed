import io
import sqlite3
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from boskage.functions.geometry import read_wkb, write_wkb
from boskage.sources import readers, writers

SQUARE = [[np.array([[0, 0], [2, 0], [2, 2], [0, 2]], float)]]


def test_gpkg(spark, tmp_path):
    for k in range(2):
        db = sqlite3.connect(tmp_path / f"fire{k}.gpkg")
        db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
        db.execute("insert into gpkg_geometry_columns values ('fires', 'geom')")
        db.execute("create table fires (UID text, geom blob)")
        db.execute("insert into fires values (?, ?)", (f"u{k}", b"GP\0\1" + struct.pack("<i", 2154) + write_wkb(SQUARE)))
        db.execute("insert into fires values (?, ?)", (None, b"GP\0\3" + struct.pack("<i4d", 2154, 0, 2, 0, 2) + write_wkb(SQUARE)))
        db.execute("insert into fires values ('empty', null)")
        db.commit()
        db.close()
    rows = readers.read_gpkg(spark, str(tmp_path), "UID string, annee bigint").collect()
    assert len(rows) == 6 and {r.UID for r in rows} == {"u0", "u1", "empty", None} and all(r.annee is None for r in rows)
    assert sum(len(read_wkb(r.geometry)[1]) for r in rows) == 4


def tiff(band, compress=8, predictor=1, tile=None):
    h, w = band.shape
    blocks = []
    step = tile or 2
    places = [(r, c) for r in range(0, h, step) for c in (range(0, w, step) if tile else (0,))]
    for r, c in places:
        part = band[r : r + step, c : c + step] if tile else band[r : r + step]
        if tile:
            full = np.zeros((tile, tile), band.dtype)
            full[: part.shape[0], : part.shape[1]] = part
            part = full
        if predictor == 2:
            part = np.diff(part, axis=1, prepend=part[:, :1] * 0).astype(band.dtype)
        raw = part.astype("<" + band.dtype.str[1:]).tobytes()
        blocks.append(zlib.compress(raw) if compress == 8 else raw)
    out, at, offsets = b"", 8, []
    for b in blocks:
        offsets.append(at + len(out))
        out += b
    tags = {256: (4, [w]), 257: (4, [h]), 258: (3, [band.itemsize * 8]), 259: (3, [compress]), 317: (3, [predictor]), 339: (3, [{"u": 1, "i": 2, "f": 3}[band.dtype.kind]])}
    tags |= {322: (4, [tile]), 323: (4, [tile]), 324: (4, offsets), 325: (4, [len(b) for b in blocks])} if tile else {278: (4, [step]), 273: (4, offsets), 279: (4, [len(b) for b in blocks])}
    tags |= {33550: (12, [30.0, 30.0, 0.0]), 33922: (12, [0, 0, 0, 600000.0, 6700000.0, 0]), 34735: (3, [1, 1, 0, 1, 3072, 0, 1, 2154]), 42113: (2, b"0\0")}
    start = 8 + len(out)
    extra_at, ifd, extra = start + 2 + 12 * len(tags) + 4, b"", b""
    for t, (kind, vals) in sorted(tags.items()):
        raw = vals if kind == 2 else struct.pack("<" + {3: "H", 4: "I", 12: "d"}[kind] * len(vals), *vals)
        n = len(vals)
        if len(raw) > 4:
            ifd += struct.pack("<HHII", t, kind, n, extra_at + len(extra))
            extra += raw
        else:
            ifd += struct.pack("<HHI", t, kind, n) + raw.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", start) + out + struct.pack("<H", len(tags)) + ifd + b"\0\0\0\0" + extra


@pytest.mark.parametrize(("compress", "predictor", "tile"), [(1, 1, None), (8, 1, None), (8, 2, None), (8, 2, 16), (1, 1, 16)])
@pytest.mark.parametrize("kind", ["uint8", "int16", "uint16"])
def test_geotiff_kernel(compress, predictor, tile, kind):
    band = np.random.default_rng(1).integers(0, 200, (21, 37)).astype(kind)
    got, info = readers.geotiff(tiff(band, compress, predictor, tile))
    assert (got == band).all() and info == {"nodata": 0.0, "srid": 2154, "affine": (30.0, 0.0, 600000.0, 0.0, -30.0, 6700000.0)}


def test_geotiff_tables(spark, tmp_path):
    band = np.array([[0, 3, 3], [7, 0, 3]], "uint8")
    (tmp_path / "cdi_20120110_fr.tif").write_bytes(tiff(band))
    rows = readers.read_geotiff(spark, str(tmp_path))
    assert {(r.row, r["col"], r.value) for r in rows.collect()} == {(0, 1, 3), (0, 2, 3), (1, 0, 7), (1, 2, 3)}
    head = readers.geotiff_headers(spark, str(tmp_path)).first()
    assert (head.height, head.width, head.srid, head.c) == (2, 3, 2154, 600000.0)
    day = rows.select(readers.date_of(F.col("raster_id"))).first()[0]
    assert str(day) == "2012-01-10"
    assert spark.range(1).select(readers.year_of(F.lit("Height_mavg_2023.tif"))).first()[0] == 2023


def test_lzw():
    # "ABABABA" with clear and end codes, nine bits each
    codes, bits = [256, 65, 66, 258, 260, 257], ""
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert readers.lzw(data) == b"ABABABA"


def test_xlsx(spark, tmp_path):
    cell = lambda ref, text: f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {main}><sheetData><row r="1">{cell("A1", "title")}</row><row r="3">{cell("A3", "year")}<c r="B3" t="s"><v>0</v></c></row><row r="4"><c r="A4"><v>2012</v></c><c r="B4" t="s"><v>1</v></c></row><row r="5"><c r="A5"><v>2013</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>cause</t></si><si><r><t>gel </t></r><r><t>tardif</t></r></si></sst>")
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s0" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    assert [tuple(r) for r in readers.read_xlsx(spark, str(tmp_path), "s0", 2, ["cause", "year", "absent"]).collect()] == [("gel tardif", "2012", None), (None, "2013", None)]


def test_shapefile(spark, tmp_path):
    ring = np.array([[0, 0], [0, 2], [2, 2], [2, 0], [0, 0]], float)
    body = struct.pack("<i4d2i", 5, 0, 0, 2, 2, 1, 5) + struct.pack("<i", 0) + ring.tobytes()
    shp = b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body
    dbf = struct.pack("<B3BIHH20x", 3, 1, 1, 1, 1, 65, 11) + b"region".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10, 0]) + b"\0" * 14 + b"\r" + b" " + b"alps".ljust(10)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("r.shp", shp)
        z.writestr("r.dbf", dbf)
    (tmp_path / "r.zip").write_bytes(buf.getvalue())
    row = readers.read_shapefile(spark, str(tmp_path), ["region"]).first()
    assert row.region == "alps" and abs(abs(readers.np.float64(read_wkb(row.geometry)[1][0][0][2][0])) - 2) < 1e-9


def test_text_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "POINT (3 4)", None), (2, None, "x|y"), (3, "rubbish", "z")], "id long, g string, n string")
    writers.write_csv(df, str(tmp_path / "csv"))
    got = readers.read_wkt_csv(spark, str(tmp_path / "csv"), "id long, g string, n string", "g", "id", sep=";")
    assert {r.id: r.x for r in got.collect()} == {1: 3.0, 2: None, 3: None}
    writers.write_parquet(df, str(tmp_path / "p"), ["id"])
    assert readers.Catalog(spark, {"a": str(tmp_path / "p")}).union(["a", "a"]).count() == 6
    for _ in range(2):
        writers.append_ledger(df, str(tmp_path / "ledger"))
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 6
    assert writers.memoised(df, str(tmp_path / "m")).count() == writers.memoised(df.limit(0), str(tmp_path / "m")).count() == 3
    assert writers.markdown(df.orderBy("id")).splitlines()[-2] == "| 2 |  | x\\|y |"
    with pytest.raises(ValueError):
        writers.markdown(df, 2)


def test_gml(spark, tmp_path):
    (tmp_path / "g.gml").write_text('graph [\n node [\n id 0\n label "7"\n ]\n node [\n id 1\n label "9"\n ]\n edge [\n source 0\n target 1\n weight 0.5\n ]\n edge [\n source 1\n target 1\n ]\n]')
    assert sorted(map(tuple, readers.read_gml(spark, str(tmp_path)).collect())) == [(7, 9, 0.5), (9, 9, 1.0)]
    df = spark.createDataFrame([(7, 9, 0.5)], "src long, dst long, weight double")
    writers.write_gml(df, str(tmp_path / "out"))
    for f in (tmp_path / "out").glob("*.txt"):
        f.rename(f.with_suffix(".gml"))
    assert sorted(map(tuple, readers.read_gml(spark, str(tmp_path / "out")).collect())) == [(7, 9, 0.5)]
    odd = spark.createDataFrame([(1, [1, 2], bytearray(b"ab"), {"k": 1}, (3,))], "id long, a array<int>, b binary, m map<string,int>, s struct<x:int>")
    assert tuple(writers.repaired(odd).first()) == (1, "[1,2]", "6162", '{"k":1}', '{"x":3}')
