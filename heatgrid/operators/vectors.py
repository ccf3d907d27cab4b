"""Vector layers as edge tables (feature_id, part, ring, seq, x1, y1, x2, y2): geometry, audit, ring repair, projections.

Outer rings run anticlockwise and holes clockwise, so signed sums over edges give areas; all measures are aggregates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

RING = ["feature_id", "part", "ring"]


def edges_from_vertices(vertices: DataFrame) -> DataFrame:
    """Edges from (feature_id, part, ring, seq, x, y), the ring's last vertex joined to its first unless they're equal."""
    w = W.partitionBy(*RING).orderBy("seq")
    ends = W.partitionBy(*RING).orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(ends))
    out = vertices.select(*RING, "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), nxt("x").alias("x2"), nxt("y").alias("y2"))
    return out.where("x1 <> x2 OR y1 <> y2")


def features_from_geojson(lines: DataFrame, text: str = "value") -> DataFrame:
    """Vertices (feature_id, part, ring, seq, x, y) of the Polygon and MultiPolygon features of FeatureCollection texts; the id is ``properties.id``."""
    shape = "struct<features: array<struct<properties: struct<id: string>, geometry: struct<type: string, coordinates: string>>>>"
    feature = lines.select(F.explode(F.from_json(text, shape)["features"]).alias("f")).select(F.col("f.properties.id").alias("feature_id"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))
    parts = F.when(F.col("type") == "Polygon", F.array(F.from_json("c", "array<array<array<double>>>"))).when(F.col("type") == "MultiPolygon", F.from_json("c", "array<array<array<array<double>>>>"))
    part = feature.select("feature_id", F.posexplode(parts).alias("part", "rings"))
    ring = part.select("feature_id", "part", F.posexplode("rings").alias("ring", "points"))
    return ring.select(*RING, F.posexplode("points").alias("seq", "p")).select(*RING, "seq", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def geometry(edges: DataFrame, unit_m: float = 1.0) -> DataFrame:
    """Area, hectares, perimeter, centroid of the largest part and extent of each feature; ``unit_m``: metres of a unit."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    part = edges.groupBy("feature_id", "part").agg(
        (F.sum(cross) / 2).alias("area"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("length"),
        F.sum((F.col("x1") + F.col("x2")) * cross).alias("mx"), F.sum((F.col("y1") + F.col("y2")) * cross).alias("my"),
        F.min("x1").alias("x_min"), F.max("x1").alias("x_max"), F.min("y1").alias("y_min"), F.max("y1").alias("y_max"))
    big = F.struct(F.abs("area").alias("a"), (-F.col("part")).alias("p"))
    out = part.groupBy("feature_id").agg(
        F.sum(F.abs("area")).alias("area"), F.sum("length").alias("length"), F.max_by(F.col("mx") / (6 * F.col("area")), big).alias("cx"), F.max_by(F.col("my") / (6 * F.col("area")), big).alias("cy"),
        (F.max("x_max") - F.min("x_min")).alias("w"), (F.max("y_max") - F.min("y_min")).alias("h"))
    m2 = F.col("area") * unit_m * unit_m
    return out.select("feature_id", F.round(m2, 2).alias("area_m2"), F.round(m2 / 1e4, 4).alias("area_ha"), F.round(F.col("length") * unit_m, 2).alias("perimeter_m"), F.round("cx", 2).alias("centroid_x"), F.round("cy", 2).alias("centroid_y"), F.round(F.col("w") * unit_m, 2).alias("bbox_width"), F.round(F.col("h") * unit_m, 2).alias("bbox_height"))


def filter_by_area(edges: DataFrame, min_ha: float = 0.0, max_ha: float = math.inf, unit_m: float = 1.0) -> DataFrame:
    return geometry(edges, unit_m).where(F.col("area_ha").between(min_ha, max_ha))


def area_excluded(edges: DataFrame, min_ha: float, max_ha: float, unit_m: float = 1.0) -> DataFrame:
    out = geometry(edges, unit_m).where(~F.col("area_ha").between(min_ha, max_ha))
    return out.agg(F.count("*").alias("n"), F.min("area_ha").alias("least"), F.max("area_ha").alias("most"))


def bbox(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    xs, ys = F.array("x1", "x2"), F.array("y1", "y2")
    return edges.groupBy(*(by or [])).agg(F.min(F.array_min(xs)).alias("x_min"), F.min(F.array_min(ys)).alias("y_min"), F.max(F.array_max(xs)).alias("x_max"), F.max(F.array_max(ys)).alias("y_max"))


def audit(edges: DataFrame, bucket: float = 16.0) -> DataFrame:
    """Faults of each feature: open rings, under three different vertices, no area, repeated vertices, crossing edges."""
    w = W.partitionBy(*RING).orderBy("seq")
    step = edges.withColumn("_gap", (F.lag("x2").over(w) != F.col("x1")) | (F.lag("y2").over(w) != F.col("y1")))
    ring = step.groupBy(*RING).agg(
        (F.count_if("_gap") > 0).alias("gap"), F.min_by(F.struct("x1", "y1"), "seq").alias("a"), F.max_by(F.struct(F.col("x2").alias("x1"), F.col("y2").alias("y1")), "seq").alias("z"),
        F.count_distinct("x1", "y1").alias("different"), F.count("*").alias("n"), F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).alias("area2"))
    flat = ring.groupBy("feature_id").agg(F.count_if(F.col("gap") | (F.col("a") != F.col("z"))).alias("open_rings"), F.count_if(F.col("different") < 3).alias("thin_rings"), F.count_if(F.col("area2") == 0).alias("empty_rings"), F.count_if(F.col("different") < F.col("n")).alias("repeated"))
    spread = lambda a, b: F.sequence(F.floor(F.least(a, b) / bucket), F.floor(F.greatest(a, b) / bucket))
    near = edges.withColumn("_bx", F.explode(spread("x1", "x2"))).withColumn("_by", F.explode(spread("y1", "y2")))
    a, b = near.alias("a"), near.alias("b")
    side = lambda p, q, x, y: F.signum((F.col(f"{q}.x2") - F.col(f"{q}.x1")) * (F.col(f"{p}.{y}") - F.col(f"{q}.y1")) - (F.col(f"{q}.y2") - F.col(f"{q}.y1")) * (F.col(f"{p}.{x}") - F.col(f"{q}.x1")))
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("feature_id", "_bx", "_by")]
    order = F.struct(*[F.col(f"a.{k}") for k in ("part", "ring", "seq")]) < F.struct(*[F.col(f"b.{k}") for k in ("part", "ring", "seq")])
    cross = (side("a", "b", "x1", "y1") * side("a", "b", "x2", "y2") < 0) & (side("b", "a", "x1", "y1") * side("b", "a", "x2", "y2") < 0)
    hits = a.join(b, [*same, order, cross]).select(F.col("a.feature_id").alias("feature_id"), *[F.col(f"{s}.{k}").alias(f"{s}_{k}") for s in "ab" for k in ("part", "ring", "seq")]).distinct().groupBy("feature_id").agg(F.count("*").alias("crossings"))
    out = flat.join(hits, "feature_id", "left").withColumn("crossings", F.coalesce("crossings", F.lit(0)))
    return out.withColumn("valid", (F.col("open_rings") + F.col("thin_rings") + F.col("empty_rings") + F.col("crossings")) == 0)


def normalise_rings(edges: DataFrame) -> DataFrame:
    """Rings closed, without zero-length edges, outer rings (ring 1) anticlockwise and holes clockwise."""
    vertices = edges.where("x1 <> x2 OR y1 <> y2").select(*RING, "seq", F.col("x1").alias("x"), F.col("y1").alias("y"))
    closed = edges_from_vertices(vertices)
    area2 = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).over(W.partitionBy(*RING))
    out = closed.withColumn("_turn", (area2 < 0) == (F.col("ring") == 1))
    flip = lambda a, b: F.when(F.col("_turn"), F.col(b)).otherwise(F.col(a))
    seq = F.row_number().over(W.partitionBy(*RING).orderBy(F.when(F.col("_turn"), -F.col("seq")).otherwise(F.col("seq"))))
    return out.select(*RING, seq.alias("seq"), flip("x1", "x2").alias("x1"), flip("y1", "y2").alias("y1"), flip("x2", "x1").alias("x2"), flip("y2", "y1").alias("y2"))


# Ellipsoid and projection parameters of the supported codes
_A, _F = 6378137.0, 1 / 298.257222101
_UTM = {"scale": 0.9996, "lon0": -87.0, "east": 500000.0}  # 32616
_LCC = {"lat1": 41.03333333333333, "lat2": 40.66666666666666, "lat0": 40.16666666666666, "lon0": -74.0, "east": 300000.0}  # 2263, in metres
_FOOT = 0.3048006096012192


def _lcc() -> tuple[float, float, float, float]:
    e = math.sqrt(2 * _F - _F * _F)
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p1, p2, p0 = (math.radians(_LCC[k]) for k in ("lat1", "lat2", "lat0"))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    f = m(p1) / (n * t(p1) ** n)
    return e, n, f, _A * f * t(p0) ** n


def _forward(lon: Column, lat: Column, dst: int) -> tuple[Column, Column]:
    lam, phi = F.radians(lon), F.radians(lat)
    if dst == 3857:
        return lam * _A, F.ln(F.tan(math.pi / 4 + phi / 2)) * _A
    if dst == 2263:
        e, n, f, rho0 = _lcc()
        t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - e * F.sin(phi)) / (1 + e * F.sin(phi)), F.lit(e / 2))
        rho, theta = _A * f * F.pow(t, F.lit(n)), n * (lam - math.radians(_LCC["lon0"]))
        return (rho * F.sin(theta) + _LCC["east"]) / _FOOT, (rho0 - rho * F.cos(theta)) / _FOOT
    if dst == 32616:
        n = _F / (2 - _F)
        radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        alpha = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3)
        e = 2 * math.sqrt(n) / (1 + n)
        t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
        d = lam - math.radians(_UTM["lon0"])
        xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
        x, y = eta, xi
        for j, a in enumerate(alpha, 1):
            x, y = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta), y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return _UTM["east"] + _UTM["scale"] * radius * x, _UTM["scale"] * radius * y
    raise ValueError(f"no projection {dst}")


def _inverse(x: Column, y: Column, src: int) -> tuple[Column, Column]:
    if src == 3857:
        return F.degrees(x / _A), F.degrees(2 * F.atan(F.exp(y / _A)) - math.pi / 2)
    if src == 2263:
        e, n, f, rho0 = _lcc()
        dx, dy = x * _FOOT - _LCC["east"], rho0 - y * _FOOT
        t = F.pow(F.hypot(dx, dy) / (_A * f), F.lit(1 / n))
        phi = math.pi / 2 - 2 * F.atan(t)
        for _ in range(5):
            phi = math.pi / 2 - 2 * F.atan(t * F.pow((1 - e * F.sin(phi)) / (1 + e * F.sin(phi)), F.lit(e / 2)))
        return F.degrees(F.atan2(dx, dy) / n) + _LCC["lon0"], F.degrees(phi)
    if src == 32616:
        n = _F / (2 - _F)
        radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        beta = (n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3, n**2 / 48 + n**3 / 15, 17 / 480 * n**3)
        delta = (2 * n - 2 / 3 * n**2 - 2 * n**3, 7 / 3 * n**2 - 8 / 5 * n**3, 56 / 15 * n**3)
        xi, eta = y / (_UTM["scale"] * radius), (x - _UTM["east"]) / (_UTM["scale"] * radius)
        u, v = xi, eta
        for j, b in enumerate(beta, 1):
            u, v = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta), v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        chi = F.asin(F.sin(u) / F.cosh(v))
        phi = chi
        for j, d in enumerate(delta, 1):
            phi = phi + d * F.sin(2 * j * chi)
        return F.degrees(F.atan2(F.sinh(v), F.cos(u))) + _UTM["lon0"], F.degrees(phi)
    raise ValueError(f"no projection {src}")


def reproject(df: DataFrame, src: int | None, dst: int, x: str = "x", y: str = "y") -> DataFrame:
    """``x`` and ``y`` (longitude and latitude for 4326) from one code to another; an undefined source is an error."""
    if src is None:
        raise ValueError("the source has no coordinate system")
    if src == dst:
        return df
    a, b = F.col(x), F.col(y)
    if src != 4326:
        a, b = _inverse(a, b, src)
    if dst != 4326:
        a, b = _forward(a, b, dst)
    return df.withColumns({x: a, y: b})


def match_crs(a: DataFrame, b: DataFrame, a_crs: int, b_crs: int, to: str = "a") -> tuple[DataFrame, DataFrame, int]:
    """Both point tables in the system of ``to``."""
    return (a, reproject(b, b_crs, a_crs), a_crs) if to == "a" else (reproject(a, a_crs, b_crs), b, b_crs)


def bbox_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlap of two layers' extents as a share of the first's (one row each)."""
    p = bbox(a).withColumnsRenamed({c: f"a_{c}" for c in ("x_min", "y_min", "x_max", "y_max")})
    both = p.crossJoin(bbox(b))
    w = F.greatest(F.lit(0.0), F.least("a_x_max", "x_max") - F.greatest("a_x_min", "x_min"))
    h = F.greatest(F.lit(0.0), F.least("a_y_max", "y_max") - F.greatest("a_y_min", "y_min"))
    area = (F.col("a_x_max") - F.col("a_x_min")) * (F.col("a_y_max") - F.col("a_y_min"))
    return both.select((w * h > 0).alias("overlaps"), F.round(100 * w * h / area, 2).alias("overlap_pct"))


def tile_cover(boxes: DataFrame, step: int = 3) -> DataFrame:
    """Names of the grid tiles that (x_min, y_min, x_max, y_max) touch."""
    at = lambda c: (F.floor(F.col(c) / step) * step).cast("int")
    out = boxes.withColumn("lat", F.explode(F.sequence(at("y_min"), at("y_max"), F.lit(step)))).withColumn("lon", F.explode(F.sequence(at("x_min"), at("x_max"), F.lit(step))))
    name = F.format_string("%s%02d%s%03d", F.when(F.col("lat") >= 0, "N").otherwise("S"), F.abs("lat"), F.when(F.col("lon") >= 0, "E").otherwise("W"), F.abs("lon"))
    return out.withColumn("tile", name)
