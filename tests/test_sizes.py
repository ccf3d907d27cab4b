"""Plans and results of steps whose tables outgrow what their size estimates say."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest
from compare import SF, same
from pyspark.sql import functions as F

from heatgrid import registry
from heatgrid.operators import camera, spatial, statistics
from heatgrid.operators.cells import FEATURES, featurize_frames
from heatgrid.sources import standins


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_shifted_cells_are_not_broadcast(spark):
    cells = spark.range(81).selectExpr("cast(id div 9 as int) row", "cast(id % 9 as int) col", "cast(id % 5 as double) value")  # whose size is known
    codes = cells.selectExpr("row", "col", "cast(value as int) code")
    for df in (spatial.neighbours(cells, 1.5), spatial.knn_within(cells), spatial.edge_metrics(codes)):
        plan = _plan(df)
        assert "SortMergeJoin" in plan
    assert "BroadcastHashJoin" not in _plan(spatial.neighbours(cells, 1.0)) + _plan(spatial.knn_within(cells))
    assert spatial.neighbours(cells, 1.0).count() == 4 * 9 * 8


def test_ground_cells_are_not_broadcast(spark):
    poses = spark.createDataFrame([(i, 0.1, 0.02, 0.01, -2.0, -2.0, 8.0) for i in range(3)], "frame_id int, rx double, ry double, rz double, tx double, ty double, tz double")
    pixels = spark.range(3 * 64 * 64).selectExpr("cast(id % 3 as int) frame_id", "cast(id div 3 % 64 as int) row", "cast(id div 192 as int) col", "cast(id % 5 as int) code")
    ground = camera.rectify_to_ground(pixels, poses, (60.0, 60.0, 32.0, 32.0), (0, 4, 0, 4), 4.0)
    assert "SortMergeJoin" in _plan(ground.where("code <> 0"))
    assert ground.count() == 3 * 256


def test_disc_sums_shuffle_cells_once(spark):
    """Tiles with their margins; a cell is no longer sent once for each chord. Cells on both sides of tile borders."""
    rnd = random.Random(3)
    grid = {(r, c): rnd.uniform(20, 40) for r in range(-9, 9) for c in [*range(245, 268), *range(-267, -246)] if rnd.random() < 0.7}
    cells = spark.createDataFrame([(r, c, v) for (r, c), v in grid.items()], "row int, col bigint, value double")
    sums = spatial.disc_sums(cells, 5.0)
    plan = _plan(sums)
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
    got = {(q["row"], q["col"]): (q["w"], q["l"]) for q in sums.collect()}
    want = {(r, c): [v for (a, b), v in grid.items() if 0 < (a - r) ** 2 + (b - c) ** 2 <= 25] for r, c in grid}
    assert set(got) == {k for k, v in want.items() if v} and sums.schema["col"].dataType.simpleString() == "bigint"
    assert all(n == len(want[k]) and t == pytest.approx(sum(want[k]), abs=1e-9) for k, (n, t) in got.items())


def test_stand_ins_round_as_duckdb(spark, tmp_path):
    """Spark's cast to a whole number cuts and DuckDB's rounds, so 9999.8 lost to an earlier 9999.4."""
    balances = [9999.4, 9999.8, 9999.6, 0.5, 1.5, -0.5, -1.5, 9999.5]
    spark.createDataFrame([(i, i, b) for i, b in enumerate(balances)], "c_custkey bigint, c_nationkey int, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    same(standins.standin(spark, str(tmp_path), "ranked"), con, standins.duck(standins.SQL["ranked"]))
    same(registry.QUERIES["a14_winners"](spark, str(tmp_path)), con, registry.ORACLES["a14_winners"])


def test_factors_of_columns_that_depend_on_one_another(spark):
    """x4 follows from x1 and x2: its factor is infinite, also where the inverse is singular or its rounding errors are negative."""
    for n in (300, 3000, 20_000):
        rows = spark.range(n).selectExpr("double(id % 50) x1", "double(id % 7) x2", "double(id * 31 % 11) x3").withColumn("x4", F.col("x1") + F.col("x2") * 0.001)
        g = statistics.Gram(rows, ["x1", "x2", "x3", "x4"])
        v = statistics.vif(g, ["x1", "x2", "x3", "x4"])
        assert v["x1"] == v["x4"] == math.inf and 1 <= v["x3"] < 1.01
        rest = {x: np.linalg.det(g.correlation(*[o for o in g.cols if o != x])) for x in ("x1", "x4")}
        worst = max(rest, key=rest.get)
        assert statistics.vif_prune(g, ["x1", "x2", "x3", "x4"]) == [x for x in g.cols if x != worst]
    g.cols, g.s = ["a", "b", "c"], np.array([[1.0, 0.0, 1.0], [0.0, 1.0, 1.0], [1.0, 1.0, 2.0]])
    assert statistics.vif_prune(g, ["a", "b", "c"]) == ["a", "b"]  # a and b are unrelated, c half of each


def test_labelled_pixels_are_featurized_once(spark, monkeypatch):
    """Training reads its rows many times; each time every texture was computed again."""
    from heatgrid.operators import models

    written = []
    monkeypatch.setattr(models, "checkpointed", lambda df: written.append(spatial.checkpointed(df)) or written[-1])
    pixels = spark.range(400).selectExpr("cast(id % 2 as int) frame_id", "cast(id div 40 as int) row", "cast(id div 2 % 20 as int) col", "cast(id * 7 % 256 as int) r", "cast(id % 256 as int) g", "5 b", "cast(case when id % 3 = 0 then 0 when id * 7 % 256 > 128 then 1 else 2 end as int) label")
    out = models.segment_pixels(featurize_frames(pixels.drop("label"), pixels.select("frame_id", "row", "col", "label")), FEATURES)
    assert len(written) == 1 and "Window" not in _plan(out)
    assert out.count() == 400 and {r["pred"] for r in out.select("pred").distinct().collect()} == {1, 2}


def test_scores_read_their_pairs_once(spark):
    """Sums, rows and columns of the confusions were three reads, each with all predictions of its own."""
    from heatgrid.operators import scores

    pairs = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, 2), ("a", 0, 2), ("b", 3, None), ("b", 3, 3), (None, 1, 1)], "g string, truth int, pred int")
    out = scores.score_segmenters(pairs, ["g"])
    assert _plan(out).count("Scan") == 1 and "Join" not in _plan(out)
    assert sorted(map(tuple, out.collect())) == [("a", 3, 0.6667, 0.5, 0.4), ("b", 2, 0.5, 0.5, 0.0)]


def test_boosted_trees_of_the_classes_there_are(spark):
    """One against the rest was fitted for every number up to the largest label, also those that no row has."""
    from heatgrid.operators import models

    rows = spark.range(200).selectExpr("id % 20 a", "id % 7 b", "cast(case when id % 20 < 10 then 7 else 3 end as int) label")
    model = models.train_classifier(rows, "label", ["a", "b"], "gbt", 2)
    assert len(model.stages[1].models) == 2
    assert models.apply_classifier(model, rows).where("pred = label").count() == 200
    assert models.apply_classifier(model, rows.drop("label")).select("pred").distinct().count() == 2


@pytest.mark.parametrize("name", ["q1_park_cooling_reprojected", "q2_heat_islands_reprojected"])
def test_rasters_are_written_before_they_are_read_again(spark, monkeypatch, name):
    """A crop reads its raster three times; each time it was reprojected from the table again."""
    seen = []
    for step in ("crop", "edge_distances"):
        monkeypatch.setattr(spatial, step, lambda c, *a, real=getattr(spatial, step): seen.append(_plan(c)) or real(c, *a))
    registry.QUERIES[name](spark, SF)
    assert seen and not any("Join" in p or "Aggregate" in p for p in seen)


def test_points_are_dealt_before_they_meet_edges(spark):
    """One task summed a row for each crossing of all its points. Features of many edges, holes, and an id that is there twice."""
    circle = lambda f, n, r: [(f, r * math.cos(2 * math.pi * i / n), r * math.sin(2 * math.pi * i / n), r * math.cos(2 * math.pi * (i + 1) / n), r * math.sin(2 * math.pi * (i + 1) / n)) for i in range(n)]
    rings = circle("a", 90, 9.0) + circle("a", 40, 4.0) + circle("b", 7, 6.0)
    rnd = random.Random(5)
    points = [(i // 2 if i < 4 else i, rnd.uniform(-10, 10), rnd.uniform(-10, 10)) for i in range(400)]
    out = spatial.points_in_polygons(spark.createDataFrame(points, "id bigint, x double, y double"), spatial.checkpointed(spark.createDataFrame(rings, "feature_id string, x1 double, y1 double, x2 double, y2 double")), block=8)
    assert "hashpartitioning(id#" in _plan(out) and not re.search(r"hashpartitioning\(id#\d+L?, feature_id", _plan(out))
    want = collections.Counter((i, f) for i, x, y in points for f, x1, y1, x2, y2 in rings if (y1 <= y) != (y2 <= y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1))
    assert sorted(map(tuple, out.collect())) == sorted(k for k, n in want.items() if n % 2)


def test_bags_vote_in_many_tasks(spark, tmp_path):
    """Rows of one file were fitted and voted on by one task."""
    from heatgrid.operators import bagging

    spark.range(300).selectExpr("id", "double(id % 10) a", "double(id % 10 + id % 3) y").coalesce(1).write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    out = bagging.oob_predictions(bagging.train_bag(df, "y", ["a"], trees=2, regression=True), df)
    assert "hashpartitioning(id#" in _plan(out)
    assert 0 < out.count() < 300 and out.select("id").distinct().count() == out.count()


def test_many_pixels_are_many_tasks(spark, monkeypatch):
    """Tasks of the session's number sorted ever more pixels as these grew."""
    from heatgrid.operators import cells

    pixels = spark.range(800).selectExpr("id % 2 frame_id", "cast(id div 40 as int) row", "cast(id div 2 % 20 as int) col", "cast(id * 7 % 256 as int) r", "cast(id * 31 % 256 as int) g", "5 b")
    labels = pixels.selectExpr("frame_id", "row", "col", "row % 3 label")
    few = featurize_frames(pixels, labels)
    want = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(cells, "TASK_ROWS", 40, raising=False)
    many = featurize_frames(pixels, labels)
    deals = set(re.findall(r"hashpartitioning\([^)]*, (\d+)\)", _plan(many)))
    assert deals == {"20"} and sorted(map(tuple, many.collect())) == want
