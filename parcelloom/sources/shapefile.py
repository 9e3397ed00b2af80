"""ESRI shapefiles: polygons and attribute records, parsed where the files are read."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelloom.operators.outline import twice_area
from parcelloom.sources.wkb import GEOM


def shapes(raw: bytes) -> list:
    """Polygons of a ``.shp`` file, one item a record; a clockwise ring is an outer one, those after it are its holes.

    Anything but polygons is an error; a null shape is an empty geometry.
    """
    if len(raw) < 100 or struct.unpack_from(">i", raw, 0)[0] != 9994:
        raise ValueError("not a shapefile")
    at, out = 100, []
    while at < len(raw):
        words = struct.unpack_from(">ii", raw, at)[1]
        body = raw[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        kind = struct.unpack_from("<i", body, 0)[0]
        if kind == 0:
            out.append([])
            continue
        if kind not in (5, 15, 25):
            raise ValueError(f"shape of type {kind}")
        parts, points = struct.unpack_from("<2i", body, 36)
        starts = [*struct.unpack_from(f"<{parts}i", body, 44), points]
        flat = struct.unpack_from(f"<{2 * points}d", body, 44 + 4 * parts)
        xy = list(zip(flat[::2], flat[1::2]))
        polygons: list = []
        for a, b in zip(starts, starts[1:]):
            ring = xy[a:b]
            if ring and ring[0] != ring[-1]:
                ring.append(ring[0])
            if twice_area(ring) < 0 or not polygons:
                polygons.append([ring[::-1] if twice_area(ring) < 0 else ring])
            else:
                polygons[-1].append(ring[::-1] if twice_area(ring) > 0 else ring)
        out.append(polygons)
    return out


def records(raw: bytes) -> list[dict]:
    """The records of a ``.dbf`` file; numbers are floats where they have decimals, blanks are None."""
    count, head, size = struct.unpack_from("<IHH", raw, 4)
    fields, at = [], 32
    while raw[at] != 0x0D:
        name = raw[at : at + 11].split(b"\0")[0].decode()
        fields.append((name, chr(raw[at + 11]), raw[at + 16], raw[at + 17]))
        at += 32
    out = []
    for n in range(count):
        row, p = {}, head + n * size + 1
        if raw[p - 1 : p] == b"*":
            continue
        for name, kind, width, decimals in fields:
            text = raw[p : p + width].decode("utf-8", "replace").strip()
            p += width
            row[name] = None if not text else text if kind not in "NF" else float(text) if decimals else int(float(text))
        out.append(row)
    return out


def read_shapefile(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """``idx, geom`` and some fields (names with types) of the ``.shp`` and ``.dbf`` pairs of a folder.

    A file is one task's work; a source of many files is read by many.  ``idx`` counts within a file.
    """
    files = spark.read.format("binaryFile").load(path).where("path like '%.shp' or path like '%.dbf'")
    files = files.withColumn("kind", F.right(F.col("path"), F.lit(3)))
    pairs = files.groupBy(F.regexp_replace("path", r"\.(shp|dbf)$", "").alias("stem")).pivot("kind", ["shp", "dbf"]).agg(F.first("content"))
    schema = T.StructType([T.StructField("stem", T.StringType()), T.StructField("idx", T.IntegerType()), T.StructField("geom", GEOM), *(T.StructField(n, T._parse_datatype_string(t)) for n, t in fields.items())])

    def run(frames):
        import pandas as pd

        for frame in frames:
            for stem, shp, dbf in zip(frame["stem"], frame["shp"], frame["dbf"]):
                rows = []
                for i, (geom, row) in enumerate(zip(shapes(bytes(shp)), records(bytes(dbf)), strict=True)):
                    rows.append((stem, i, [[[{"x": x, "y": y} for x, y in ring] for ring in p] for p in geom], *(row.get(n) for n in fields)))
                yield pd.DataFrame(rows, columns=schema.fieldNames())

    return pairs.mapInPandas(run, schema)
