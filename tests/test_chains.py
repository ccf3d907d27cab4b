"""The long analyses and tiled rasters against hand cases, separate steps and numpy."""

import math

import numpy as np
import pytest
from compare import duck, same

from heatgrid import registry
from heatgrid.operators import sampling, statistics
from heatgrid.operators.cells import align, mask_by_class
from heatgrid.plans import chains
from heatgrid.sources.bucketed import forget, write_bucketed

RASTER = "row int, col int, value double"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_rasters_meet_without_exchange(spark):
    values = spark.createDataFrame([(r, c, float(r * c % 17)) for r in range(-70, 70, 3) for c in range(0, 200, 7)] + [(5, 5, None)], RASTER)
    codes = values.selectExpr("row", "col", "abs(row + col) % 3 code").where("row <> 5")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # rasters that are too large to broadcast
    try:
        a, b = write_bucketed(values, 8, "cells_a"), write_bucketed(codes, 8)
        for df in (align(a, b), align(a, b, "left"), mask_by_class(a, b, [1]), align(a, b).groupBy("row", "col").count()):
            assert "Exchange" not in _plan(df)
        assert "Exchange" in _plan(align(values, codes))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    order = lambda df: sorted(map(str, df.select("row", "col", "value").collect()))
    assert order(align(a, b)) == order(align(values, codes)) and order(mask_by_class(a, b, [1])) == order(mask_by_class(values, codes, [1]))
    assert align(a, b, "left").count() == values.count()
    assert write_bucketed(values.limit(0)).count() == 0
    forget(spark, "cells_a")
    with pytest.raises(ValueError):
        write_bucketed(values.drop("row"))


def test_raster_between_systems(spark):
    dn = spark.createDataFrame([(r, c, 40000.0 + 1000 * r + 100 * c) for r in range(6) for c in range(5) if (r, c) != (2, 2)] + [(2, 2, None)], RASTER)
    got = {(x["row"], x["col"]): x["value"] for x in chains.metric_raster(dn).collect()}
    plane = lambda r, c: (40000 + 1000 * (r + 0.25) + 100 * (c + 0.25)) * chains.SCALE + chains.OFFSET
    assert math.isclose(got[0, 0], plane(0, 0), abs_tol=1e-6) and math.isclose(got[4, 3], plane(4, 3), abs_tol=1e-6)
    # beside the gap the other three cells are weighed
    w = {(2, 1): 0.5625 + 0, (3, 1): 0.1875, (3, 2): 0.0625}
    value = lambda r, c: (40000 + 1000 * r + 100 * c) * chains.SCALE + chains.OFFSET
    assert math.isclose(got[2, 1], sum(v * value(*k) for k, v in w.items()) / sum(w.values()), abs_tol=1e-6)


def _ring(fid, points):
    scale = chains.DEG
    at = [(x * scale, y * scale) for x, y in points]
    return [(fid, 1, 1, i + 1, *a, *at[(i + 1) % len(at)]) for i, a in enumerate(at)]


def test_parks_from_raster_to_cooling(spark):
    square = lambda x, y, n: [(x, y), (x + n, y), (x + n, y + n), (x, y + n)]
    edges = _ring(1, square(10.3, 10.3, 6)) + _ring(2, square(30.3, 10.3, 2)) + _ring(3, [(30.3, 30.3), (36.3, 36.3), (36.3, 30.3), (30.3, 34.3)])
    parks = spark.createDataFrame(edges, "fid bigint, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double")
    names = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "fid bigint, park_code string")
    distance = lambda r, c: max(10.3 - min(r, c), max(r, c) - 15.3, 0)
    dn = spark.createDataFrame([(r, c, 44000.0 + 500 * min(distance(r, c), 2)) for r in range(40) for c in range(40)], RASTER)
    got = chains.park_cooling_whole(parks, names, dn).collect()
    assert [r["feature_id"] for r in got] == ["one"]
    assert got[0]["PCI"] > 0 and got[0]["n_rings"] == 4
    assert [r["step"] for r in chains.chain_warnings(parks, dn).collect()] == ["validate_vector"]
    with pytest.raises(ValueError):
        chains.park_cooling_whole(parks, names.unionAll(names), dn)
    assert chains.park_cooling_whole(parks.limit(0), names, dn).count() == 0


def _regressed(spark, n=120):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 3))
    y = 2 + 3 * x[:, 0] - x[:, 1] + rng.normal(size=n)
    rows = [(i, float(y[i]), *map(float, x[i]), float(x[i, 0] + 1e-3 * x[i, 2]), 7.0) for i in range(n)] + [(n, None, 0.0, 0.0, 0.0, 0.0, 7.0)]
    return spark.createDataFrame(rows, "id bigint, y double, a double, b double, c double, near double, flat double"), x, y


def test_explained_to_the_hold_out(spark):
    df, x, y = _regressed(spark)
    out = {(r["part"], r["variable"], r["metric"]): r["value"] for r in chains.explained(df, "y", ["a", "b", "c", "near", "flat"], ["b"]).collect()}
    used = sorted({k[1] for k in out if k[0] == "regression"} - {"(Intercept)"})
    assert len(used) == 2 and "b" in used and used[0] in ("a", "b") and not any(k[1] == "flat" for k in out)
    names = {"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "near": x[:, 0] + 1e-3 * x[:, 2]}
    design = np.column_stack([np.ones(len(y)), *[names[v] for v in used]])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    for v, b in zip(["(Intercept)", *used], beta, strict=True):
        assert math.isclose(out["regression", v, "estimate"], b, rel_tol=1e-8)
    assert math.isclose(out["correlation", "a", "r"], np.corrcoef(x[:, 0], y)[0, 1], abs_tol=1e-4)
    test = np.array([r["partition"] == "test" for r in sampling.holdout(df.where("y IS NOT NULL"), 0.25, 7).orderBy("id").collect()])
    beta = np.linalg.lstsq(design[~test], y[~test], rcond=None)[0]
    assert math.isclose(out["holdout", None, "rmse"], math.sqrt(np.mean((y[test] - design[test] @ beta) ** 2)), abs_tol=1e-4)
    assert {"r_squared", "bp_p_value", "jb_statistic", "condition_number"} <= {k[2] for k in out if k[0] == "diagnostics"}
    assert chains.explained(df.limit(0), "y", ["a"], []).count() == 0
    assert chains.explained(df.where("id < 4"), "y", ["a", "b"], []).count() == 0
    low = {r["metric"]: r["value"] for r in chains.explained(df, "y", ["a"], [], n_boot=100).where("part = 'correlation'").collect()}
    assert low["ci_low"] <= low["r"] <= low["ci_high"]


def test_stepwise_sql_on_columns_that_matter(spark):
    """The registered table has hardly any relation; here two of three columns are chosen by all directions."""
    df, x, y = _regressed(spark)
    pdf = df.where("y IS NOT NULL").selectExpr("id", "y", "a x1", "b x2", "c x3")
    con = duck()
    rows = pdf.toPandas()  # noqa: F841
    con.register("small", rows)
    for d in ("backward", "forward", "both"):
        sql = registry.ORACLES[f"x6_stepwise_{d}"]
        start = sql.index("(SELECT p_partkey AS id")
        depth = next(i for i in range(start, len(sql)) if sql[start : i + 1].count("(") == sql[start : i + 1].count(")"))
        sql = sql.replace(sql[start : depth + 1], "(SELECT * FROM small)")
        got = statistics.regression(pdf, "y", ["x1", "x2", "x3"], d)
        assert got.count() >= 3
        same(got.selectExpr("variable", "round(estimate, 4) estimate", "round(std_error, 4) std_error", "round(t_value, 3) t_value", "round(p_value, 4) p_value", "round(std_beta, 4) std_beta", "significance"), con, sql)


def test_segmenters_learn_and_survey(spark):
    px = [(f"photos/{f}_{f % 2}.jpg", r, c, 200 if c < 4 else 20, 30 if c < 4 else 180, 10) for f in range(10) for r in range(8) for c in range(8)]
    pixel = "path string, row int, col int, r int, g int, b int"
    photo_px = spark.createDataFrame(px, pixel)
    scribble_px = spark.createDataFrame([(p.replace("photos", "labels").replace("jpg", "png"), r, c, *((200, 60, 60) if c < 4 else (1, 99, 2))) for p, r, c, *_ in px if (r + c) % 2 == 0], pixel)
    palette = spark.createDataFrame([(0, 100, 0, 1), (200, 60, 60, 3)], "pr int, pg int, pb int, code int")
    photos, scribbles = photo_px.select("path").distinct(), scribble_px.select("path").distinct()
    got = {r["model"]: r for r in chains.compared_segmenters(photos, scribbles, photo_px, scribble_px, palette, ("rf", "logistic")).collect()}
    assert got["rf"]["accuracy"] == got["logistic"]["accuracy"] == 1.0
    assert (got["rf"]["wins"], got["logistic"]["wins"]) == ("accuracy kappa mean_iou", "")
    frames, labels = chains.prepared_frames(photos, scribbles, scribble_px, palette, 0.2, 0.2)
    assert {(r["scene"], r["partition"]): r["count"] for r in frames.groupBy("scene", "partition").count().collect()} == {(s, p): n for s in "01" for p, n in (("test", 1), ("val", 1), ("train", 3))}
    assert labels.count() == 320
