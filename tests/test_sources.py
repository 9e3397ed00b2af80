import gzip
import struct

import pytest
from pyspark.sql import functions as F

from parcelloom.functions import ids, measure
from parcelloom.operators import rollup, trace
from parcelloom.sources import shapefile, tables, tiles, wkb
from parcelloom.streaming.moves import move_totals


def shp(records):
    out = b""
    for n, rings in enumerate(records, 1):
        points = [p for r in rings for p in r]
        starts, at = [], 0
        for r in rings:
            starts.append(at)
            at += len(r)
        body = struct.pack("<i4d2i", 5, 0, 0, 1, 1, len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        out += struct.pack(">ii", n, len(body) // 2) + body
    return struct.pack(">i", 9994) + b"\0" * 96 + out


def dbf(rows):
    fields = [("GEOID20", b"C", 8, 0), ("ALAND20", b"N", 10, 0)]
    head = b"".join(n.encode().ljust(11, b"\0") + t + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, t, w, d in fields) + b"\r"
    body = b"".join(b" " + a.encode().ljust(8) + str(b).encode().rjust(10) for a, b in rows)
    return struct.pack("<B3BIHH", 3, 24, 1, 1, len(rows), 32 + len(head), 19) + b"\0" * 20 + head + body


CW = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)]
HOLE = [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]


def test_shapefile(spark, tmp_path):
    (tmp_path / "a.shp").write_bytes(shp([[CW, HOLE, [(p[0] + 9, p[1]) for p in CW]], [CW]]))
    (tmp_path / "a.dbf").write_bytes(dbf([("01", 5), ("02", 7)]))
    rows = shapefile.read_shapefile(spark, str(tmp_path), {"GEOID20": "string", "ALAND20": "long"}).orderBy("idx").collect()
    assert [(r["GEOID20"], r["ALAND20"], [len(p) for p in r["geom"]]) for r in rows] == [("01", 5, [2, 1]), ("02", 7, [1])]
    with pytest.raises(ValueError):
        shapefile.shapes(b"x" * 200)


def test_wkb_of_either_order():
    geom = [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]]
    assert wkb.decode(wkb.encode(geom)) == geom
    big = struct.pack(">BII", 0, 3, 1) + struct.pack(">I8d", 4, 0, 0, 1, 0, 1, 1, 0, 0)
    assert wkb.decode(big) == geom
    with pytest.raises(ValueError):
        wkb.decode(struct.pack("<BI", 1, 1) + b"\0" * 20)


def test_csv_and_pipe(spark, tmp_path):
    (tmp_path / "a.csv").write_text("geo_id,parent_state,pop\n1001,1,5\n01002, ,6\n")
    rows = {r["geo_id"]: r["parent_state"] for r in tables.read_attributes(spark, str(tmp_path / "a.csv")).collect()}
    assert rows == {"01001": "01", "01002": None}
    (tmp_path / "b.txt").write_text("BLOCKID|DISTRICT\n170010001001000|0A\n170010001001001|\n")
    walk = ids.crosswalk(tables.read_pipe(spark, str(tmp_path / "b.txt"))).collect()
    assert [(r["geo_id"], r["parent_vtd"]) for r in walk] == [("170010001001000", "170010A")]
    assert tables.read_csv_text(spark, "a,b\n1,x\n2,y").count() == 2


def test_ids(spark):
    df = spark.createDataFrame([("170010001001000",)], "g string")
    assert df.select(ids.parent(F.col("g"), "tract")).first()[0] == "17001000100"
    assert ids.level(" VTD ") == "vtd" and len(ids.STATES) == 52
    with pytest.raises(ValueError):
        ids.level("planet")
    with pytest.raises(Exception, match="not a county id"):
        df.select(ids.checked(F.col("g"), "county")).collect()


def test_merge_wants_both_sides(spark):
    a, b = spark.createDataFrame([("x", 1)], "geo_id string, v int"), spark.createDataFrame([("y", 1)], "geo_id string, w int")
    with pytest.raises(ValueError):
        rollup.merge_attributes(a, b)
    assert rollup.merge_attributes(a, b, strict=False).count() == 0
    n = spark.createDataFrame([(0, None, 1.5)], "idx int, a int, b double")
    assert rollup.weights(n).first().asDict() == {"idx": 0, "a": 0, "b": 1.5}


def test_colours(spark):
    lean = spark.createDataFrame([(1.0,), (-2.0,), (0.0,), (float("nan"),), (None,), (float("inf"),)], "x double")
    assert [r[0] for r in lean.select(measure.partisan_colour(F.col("x"))).collect()] == ["#0571b0", "#ca0020", "#dfe4e7", "#969696", "#969696", "#969696"]


def test_tiles():
    assert tiles.clip([(-10, 0), (10, 0), (10, 10), (-10, 10)], 0, 20) == [(0, 10), (0, 0), (10, 0), (10, 10)] or len(tiles.clip([(-10, 0), (10, 0), (10, 10), (-10, 10)], 0, 20)) == 4
    assert tiles.clean([(0, 0), (0, 0), (1, 0), (1, 1), (1, 0), (0, 0)]) == []
    raw = gzip.decompress(tiles.encode_tile("block", [("01", [[[(-90, 40), (-89, 40), (-89, 41), (-90, 41), (-90, 40)]]])], 3, 2, 3))
    assert b"block" in raw and b"geo_id" in raw and b"01" in raw
    assert measure.zoom_tolerance(5, 5) == 0 and measure.zoom_tolerance(0, 5) == 0.36


def test_log_lines_of_another_form_go(spark):
    lines = spark.createDataFrame([(0, "noise"), (0, "Iter 5 | Phase 1 | Obj: 0.5 | Best: 0.6 | Temp: 1.0e-01 | Prob: 0.2500 | a=1.0, b=2.0")], "chain int, line string")
    row = trace.parsed(lines).collect()
    assert len(row) == 1 and row[0]["iter"] == 5 and row[0]["metrics"] == {"a": "1.0", "b": "2.0"}


def test_move_stream(spark, tmp_path):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    moves = spark.createDataFrame([(at, 0, 1, 2), (at + datetime.timedelta(minutes=1), 1, 2, 1)], "ts timestamp, idx int, src int, dst int")
    moves.write.parquet(str(tmp_path / "in"))
    units = spark.createDataFrame([(0, 10), (1, 3)], "idx int, pop long")
    stream = move_totals(spark.readStream.schema(moves.schema).parquet(str(tmp_path / "in")), units, "pop")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("moves").start()
    q.processAllAvailable()
    q.stop()
    assert {r["district"]: r["gain"] for r in spark.sql("select * from moves").collect()} == {1: -7, 2: 7}
