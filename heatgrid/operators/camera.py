"""Ground rectification and scoring of posed frames as column arithmetic over small pose tables.

A pose is (frame_id, rx, ry, rz, tx, ty, tz); intrinsics are fx, fy, cx, cy and distortion k1, k2, p1, p2, k3.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rotation(rx: Column, ry: Column, rz: Column) -> list[list[Column]]:
    """Rotation matrix of a rotation vector; the identity for a tiny one."""
    angle = F.sqrt(rx * rx + ry * ry + rz * rz)
    x, y, z = (F.when(angle > 1e-12, v / angle).otherwise(0.0) for v in (rx, ry, rz))
    c, s = F.cos(angle), F.sin(angle)
    u = 1 - c
    return [[c + x * x * u, x * y * u - z * s, x * z * u + y * s], [y * x * u + z * s, c + y * y * u, y * z * u - x * s], [z * x * u - y * s, z * y * u + x * s, c + z * z * u]]


def to_camera(gx: Column, gy: Column) -> tuple[Column, Column]:
    """Normalised image coordinates of a ground point, from the pose columns."""
    r = rotation(F.col("rx"), F.col("ry"), F.col("rz"))
    p = [row[0] * gx + row[1] * gy + F.col(t) for row, t in zip(r, ("tx", "ty", "tz"), strict=True)]
    return p[0] / p[2], p[1] / p[2]


def rectify_to_ground(cells: DataFrame, poses: DataFrame, camera: tuple[float, float, float, float], extent: tuple[float, float, float, float], scale: float, nodata: int = 0) -> DataFrame:
    """Bird's-eye view of undistorted frames (frame_id, row, col, code): each output cell reads the source cell under it."""
    x0, x1, y0, y1 = extent
    w, h = round((x1 - x0) * scale), round((y1 - y0) * scale)
    if w <= 0 or h <= 0:
        raise ValueError(f"the output has {w} x {h} cells")
    fx, fy, cx, cy = camera
    out = poses.withColumn("out_row", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))).withColumn("out_col", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
    u, v = to_camera(x0 + F.col("out_col") / scale, y1 - F.col("out_row") / scale)
    at = out.select("frame_id", "out_row", "out_col", F.round(fy * v + cy).cast("int").alias("row"), F.round(fx * u + cx).cast("int").alias("col"))
    at = at.hint("merge")  # estimates leave out the cells that explode adds, which a filter behind would let be broadcast
    return at.join(cells, ["frame_id", "row", "col"], "left").select("frame_id", F.col("out_row").alias("row"), F.col("out_col").alias("col"), F.coalesce("code", F.lit(nodata)).alias("code"))


def valid_fraction(rectified: DataFrame, nodata: int = 0) -> DataFrame:
    out = rectified.groupBy("frame_id").agg(F.round(F.count_if(F.col("code") != nodata) / F.count("*"), 4).alias("valid_fraction"))
    return out.withColumn("warn", F.col("valid_fraction") < 0.5)


def quad_area(poses: DataFrame, name: str, extent: tuple[Column, Column, Column, Column], camera: tuple[float, float, float, float], distortion: tuple[float, ...] = ()) -> DataFrame:
    """``name``: image area of each frame's ground rectangle (x0, x1, y0, y1), by the shoelace sum over its projected corners."""
    x0, x1, y0, y1 = extent
    k1, k2, p1, p2, k3 = (*distortion, 0, 0, 0, 0, 0)[:5]
    fx, fy, cx, cy = camera
    corner = lambda gx, gy: F.struct(gx.alias("gx"), gy.alias("gy"))

    def flat(c: Column) -> Column:
        x, y = to_camera(c["gx"], c["gy"])
        return F.struct(x.alias("x"), y.alias("y"))

    def image(c: Column) -> Column:
        x, y = c["x"], c["y"]
        r2 = x * x + y * y
        radial = 1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2
        return F.struct((fx * (x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)) + cx).alias("u"), (fy * (y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y) + cy).alias("v"))

    corners = F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))
    pts = F.transform(F.transform(corners, flat), image)
    area = F.transform(F.array(pts), lambda q: F.abs(sum((F.get(q, i)["u"] * F.get(q, (i + 1) % 4)["v"] - F.get(q, (i + 1) % 4)["u"] * F.get(q, i)["v"] for i in range(4)), F.lit(0.0))) / 2)
    return poses.withColumn(name, area[0])


def score_composition(poses: DataFrame, camera: tuple[float, float, float, float], distortion: tuple[float, ...] = (), coverage_min: float = 0.5) -> DataFrame:
    """Target share of the region in the image against that on the ground; poses also hold roi_*, target_* (x0, x1, y0, y1) and coverage."""
    names = ("x0", "x1", "y0", "y1")
    ext = lambda k: tuple(F.col(f"{k}_{n}") for n in names)
    out = quad_area(quad_area(poses, "_target", ext("target"), camera, distortion), "_roi", ext("roi"), camera, distortion)
    ground = lambda k: (F.col(f"{k}_x1") - F.col(f"{k}_x0")) * (F.col(f"{k}_y1") - F.col(f"{k}_y0"))
    raw, truth = F.col("_target") / F.col("_roi"), ground("target") / ground("roi")
    error = F.abs(raw - truth)
    verdict = F.when(F.col("coverage") < coverage_min, "inconclusive").when(error > 0, "supported").otherwise("not_supported")
    return out.select("frame_id", F.round(truth, 6).alias("truth_fraction"), F.round(raw, 6).alias("raw_fraction"), F.round(error, 6).alias("raw_error"), "coverage", verdict.alias("verdict"))
