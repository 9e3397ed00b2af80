"""GeoJSON and SVG of layers and plans, as columns of rows; a document is put together from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelloom.functions.measure import choropleth_colour, district_colour


@dataclass(frozen=True)
class Viewport:
    """Longitude and latitude to picture units, x to the right and y downwards from the top left corner."""

    left: float
    top: float
    scale: float
    margin: float = 0.0

    @staticmethod
    def fit(minx: float, miny: float, maxx: float, maxy: float, width: float, margin: float) -> "Viewport":
        return Viewport(minx, maxy, (width - 2 * margin) / max(maxx - minx, 1e-12), margin)

    def x(self, lon: Column) -> Column:
        return (lon - self.left) * self.scale + self.margin

    def y(self, lat: Column) -> Column:
        return (F.lit(self.top) - lat) * self.scale + self.margin


def svg_path(geom: Column, view: Viewport) -> Column:
    """All rings of a geometry as a path of three decimals; the closing point of a ring is left out."""
    point = lambda p: F.format_string("%.3f,%.3f", view.x(p["x"]), view.y(p["y"]))
    ring = lambda r: F.concat(F.lit("M "), F.array_join(F.transform(F.slice(r, 1, F.size(r) - 1), point), " L "), F.lit(" Z"))
    return F.regexp_replace(F.array_join(F.transform(F.flatten(geom), ring), " "), r"-0\.000", "0.000")


def svg_points(geom: Column, view: Viewport) -> Column:
    """The outer ring of the first polygon as a list of points."""
    point = lambda p: F.format_string("%.3f,%.3f", view.x(p["x"]), view.y(p["y"]))
    return F.array_join(F.transform(F.slice(geom[0][0], 1, F.size(geom[0][0]) - 1), point), " ")


def _header(width: float, height: float) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height:g}" viewBox="0 0 {width:g} {height:g}">\n<style>path{{stroke:#333;stroke-width:0.2;fill-rule:evenodd}}</style>\n'


def layer_svg_rows(units: DataFrame, geoms: DataFrame, view: Viewport, series: str | None = None) -> DataFrame:
    """``idx, element``: a path for each unit, filled by a series if one is given."""
    rows = geoms.join(units, "idx")
    fill = F.lit("#dddddd")
    if series:
        bounds = units.agg(F.min(series).alias("_lo"), F.max(series).alias("_hi"))
        rows = rows.crossJoin(F.broadcast(bounds))
        fill = choropleth_colour(F.col(series).cast("double"), F.col("_lo"), F.col("_hi"))
    return rows.select("idx", F.format_string('<path d="%s" fill="%s"/>', svg_path(F.col("geom"), view), fill).alias("element"))


def edge_svg_rows(units: DataFrame, edges: DataFrame, view: Viewport) -> DataFrame:
    """``idx, element``: a line between the centroids of each pair of neighbours."""
    a = units.select(F.col("idx").alias("src"), F.col("centroid_lon").alias("x1"), F.col("centroid_lat").alias("y1"))
    b = units.select(F.col("idx").alias("dst"), F.col("centroid_lon").alias("x2"), F.col("centroid_lat").alias("y2"))
    rows = edges.where("src < dst").join(a, "src").join(b, "dst")
    return rows.select(F.col("src").alias("idx"), F.format_string('<line x1="%.3f" y1="%.3f" x2="%.3f" y2="%.3f"/>', view.x(F.col("x1")), view.y(F.col("y1")), view.x(F.col("x2")), view.y(F.col("y2"))).alias("element"))


def svg_document(rows: DataFrame, width: float, height: float) -> str:
    """A picture of rows ``idx, element``; they are streamed to the driver in order, as a picture is one file."""
    return _header(width, height) + "\n".join(r["element"] for r in rows.orderBy("idx", "element").toLocalIterator()) + "\n</svg>\n"


def features(units: DataFrame, geoms: DataFrame, plan: DataFrame | None = None, series: tuple[str, ...] = ()) -> DataFrame:
    """``idx, feature``: a GeoJSON feature for each unit with a geometry, with its district and colour if a plan is given."""
    rows = units.join(geoms.where(F.size("geom") > 0), "idx")
    properties = [F.col("geo_id"), F.col("name"), *(F.col(s) for s in series)]
    if plan is None:
        properties.append(F.col("geo_id").alias("_hash"))
    else:
        rows = rows.join(plan.select("idx", "district"), "idx")
        properties += [F.col("district"), district_colour(F.col("district")).alias("district_color"), F.concat_ws(":", "geo_id", F.col("district").cast("string")).alias("_hash")]
    point = lambda p: F.array(p["x"], p["y"])
    coordinates = F.transform("geom", lambda poly: F.transform(poly, lambda ring: F.transform(ring, point)))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))
    return rows.select("idx", F.to_json(feature).alias("feature"))


def feature_collection(rows: DataFrame) -> str:
    """The features as one document, streamed to the driver in the order of their units."""
    return '{"type":"FeatureCollection","features":[' + ",".join(r["feature"] for r in rows.orderBy("idx").toLocalIterator()) + "]}"


def write_features(rows: DataFrame, path: str) -> None:
    """The features as lines of text files, one a line."""
    rows.select(F.col("feature").alias("value")).write.mode("overwrite").text(path)
