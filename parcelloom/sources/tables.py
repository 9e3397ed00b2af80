"""Tables of maps and plans in Parquet, CSV and pack folders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelloom.functions.ids import LEVELS, level, normalised

_PARENTS = [f"parent_{x}" for x in LEVELS[:5]]
FORMATS = ("parquet", "csv")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A comma-separated file with a header; types are inferred only without a schema."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_csv_text(spark: SparkSession, text: str, schema: str | None = None) -> DataFrame:
    """The same from a string."""
    lines = spark.createDataFrame([(x,) for x in text.splitlines()], "line string").rdd.map(lambda r: r[0])
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(lines)


def read_pipe(spark: SparkSession, path: str) -> DataFrame:
    """A file separated by ``|`` with a header; every column is a string."""
    return spark.read.option("header", True).option("sep", "|").csv(path)


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of a pack: identifiers stay strings and get their leading zeros back."""
    head = spark.read.option("header", True).csv(path)
    plain = read_csv(spark, path)
    ids = {"geo_id", "name", *_PARENTS}
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in ids else plain.schema[f.name].dataType) for f in head.schema])
    return normalised(read_csv(spark, path, schema))


def read_layer_shapes(df: DataFrame) -> DataFrame:
    """The seven columns of a layer from its source's fields; areas add up and an empty name falls back to the long one."""
    name = F.coalesce(F.nullif(F.trim("NAME20"), F.lit("")), F.trim("NAMELSAD20")) if "NAMELSAD20" in df.columns else F.trim("NAME20")
    land, water = F.col("ALAND20").cast("double"), F.col("AWATER20").cast("double")
    return df.select(F.trim("GEOID20").alias("geo_id"), name.alias("name"), F.trim("INTPTLON20").cast("double").alias("centroid_lon"), F.trim("INTPTLAT20").cast("double").alias("centroid_lat"), (land + water).alias("area_m2"), land.alias("land_m2"), water.alias("water_m2"))


def plan_rows(units: DataFrame, plan: DataFrame) -> DataFrame:
    """``geo_id, district`` of the assigned units."""
    return units.select("idx", "geo_id").join(plan, "idx").where("district <> 0").select("geo_id", "district")


def write_plan(units: DataFrame, plan: DataFrame, path: str) -> None:
    plan_rows(units, plan).write.mode("overwrite").option("header", True).csv(path)


def plan_text(units: DataFrame, plan: DataFrame) -> str:
    """The plan of one map as CSV text, by geo_id; a plan has a row a unit of one state's map."""
    rows = plan_rows(units, plan).orderBy("geo_id").toLocalIterator()
    return "geo_id,district\n" + "".join(f"{r['geo_id']},{r['district']}\n" for r in rows)


def read_plan(spark: SparkSession, path: str, units: DataFrame, chain: int = 0, strict: bool = False) -> DataFrame:
    """``chain, idx, district`` from the first two columns of a CSV: an id that stays a string, and a district.

    Units without a row are unassigned, or an error with ``strict``.  An id that no unit has, or twice, is an error.
    """
    rows = spark.read.option("header", True).schema("geo_id string, district int").option("enforceSchema", True).csv(path)
    return plan_of_rows(rows, units, chain, strict)


def plan_of_rows(rows: DataFrame, units: DataFrame, chain: int = 0, strict: bool = False) -> DataFrame:
    if bad := rows.join(units.select("geo_id"), "geo_id", "left_anti").first():
        raise ValueError(f"no unit {bad['geo_id']!r}")
    if twice := rows.groupBy("geo_id").count().where("count > 1").first():
        raise ValueError(f"two rows for {twice['geo_id']!r}")
    out = units.select("idx", "geo_id").join(rows, "geo_id", "left")
    if strict and (gone := out.where("district is null").first()):
        raise ValueError(f"no row for {gone['geo_id']!r}")
    return out.select(F.lit(chain).alias("chain"), "idx", F.coalesce("district", F.lit(0)).alias("district"))


def pack_projection(units: DataFrame, parents: DataFrame) -> DataFrame:
    """Units with their parents as the last columns."""
    first = [c for c in units.columns if c not in _PARENTS]
    have = [c for c in _PARENTS if c in parents.columns]
    return units.select(*first).join(parents.select("geo_id", *have), "geo_id").select(*first, *have)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(data))
    out.close()


def _get(spark: SparkSession, path: str) -> bytes | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``file, sha256`` of the files below a folder, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"))


def write_pack(spark: SparkSession, layers: dict[str, dict[str, DataFrame]], path: str, fmt: str = "parquet") -> dict:
    """Layers as ``data/<level>.<fmt>``, ``geom/<level>`` and ``edges/<level>``, and a manifest with counts and hashes.

    A layer has ``units`` and may have ``geoms`` and ``edges``.  Geometry keeps its ``idx``, so nothing depends on order.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    counts = {}
    for name, tables in layers.items():
        data = tables["units"].write.mode("overwrite")
        where = f"{path}/data/{level(name)}.{fmt}"
        data.option("header", True).csv(where) if fmt == "csv" else data.parquet(where)
        counts[name] = tables["units"].count()
        for kind in ("geoms", "edges"):
            if kind in tables:
                tables[kind].write.mode("overwrite").parquet(f"{path}/{'geom' if kind == 'geoms' else 'edges'}/{name}")
    hashes = {r["file"].split(path.rstrip("/").split("/")[-1] + "/", 1)[-1]: {"sha256": r["sha256"]} for r in file_hashes(spark, path).where("file not like '%manifest.json' and file not like '%_SUCCESS'").toLocalIterator()}
    manifest = {"pack_id": path.rstrip("/").split("/")[-1], "version": "2", "crs": "EPSG:4269", "formats": {"data": fmt}, "levels": list(LEVELS), "counts": counts, "files": hashes}
    _put(spark, f"{path}/manifest.json", json.dumps(manifest, indent=1, sort_keys=True).encode())
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    raw = _get(spark, f"{path}/manifest.json")
    return json.loads(raw) if raw else None


def data_format(spark: SparkSession, path: str) -> str:
    """The manifest's format, or the first that the block layer has."""
    if manifest := read_manifest(spark, path):
        return manifest["formats"]["data"]
    for fmt in FORMATS:
        if exists(spark, f"{path}/data/block.{fmt}"):
            return fmt
    raise ValueError(f"no data in {path}")


def read_pack(spark: SparkSession, path: str, need: tuple[str, ...] = ("state", "block")) -> dict[str, dict[str, DataFrame]]:
    """The layers that a pack has; those of ``need`` must be there."""
    fmt, out = data_format(spark, path), {}
    for name in LEVELS:
        where = f"{path}/data/{name}.{fmt}"
        if not exists(spark, where):
            continue
        out[name] = {"units": read_attributes(spark, where) if fmt == "csv" else spark.read.parquet(where)}
        for kind, folder in (("geoms", "geom"), ("edges", "edges")):
            if exists(spark, f"{path}/{folder}/{name}"):
                out[name][kind] = spark.read.parquet(f"{path}/{folder}/{name}")
    if gone := [x for x in need if x not in out]:
        raise ValueError(f"pack without layers {gone}")
    return out


def validate_pack(spark: SparkSession, path: str) -> list[str]:
    """What is wrong with a pack: files that are missing or changed, and layers with other counts."""
    manifest = read_manifest(spark, path)
    if not manifest:
        return ["no manifest"]
    name = path.rstrip("/").split("/")[-1]
    now = {r["file"].split(name + "/", 1)[-1]: r["sha256"] for r in file_hashes(spark, path).toLocalIterator()}
    found = [f"missing {f}" if f not in now else f"changed {f}" for f, x in manifest["files"].items() if now.get(f) != x["sha256"]]
    if found:
        return found
    layers = read_pack(spark, path, ())
    return [f"{k}: {layers[k]['units'].count()} rows, not {n}" for k, n in manifest["counts"].items() if layers[k]["units"].count() != n]
