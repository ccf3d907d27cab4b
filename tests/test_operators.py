"""Hand-computed cases of the branchy operators."""

import datetime
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from compare import SF
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from heatgrid import registry
from heatgrid.functions.order import medians, rank_descending
from heatgrid.operators import bagging, camera, catalog, cells, cooling, coverage, identity, models, outcome, sampling, spatial, statistics, vectors
from heatgrid.sources import standins
from heatgrid.streaming import gatekeeper


def test_pci_statuses(spark):
    rings = spark.createDataFrame([("ok", 30.0, 20.0), ("ok", 60.0, 22.0), ("ok", 90.0, 21.0), ("up", 30.0, 20.0), ("up", 60.0, 21.0), ("up", 90.0, None), ("few", 30.0, 20.0), ("none", 30.0, 20.0), ("none", 60.0, 19.0), ("gap", 30.0, 25.0), ("gap", 60.0, None), ("gap", 90.0, 24.0)], "feature_id string, distance_m double, lst_median double")
    own = spark.createDataFrame([("ok", 19.0), ("up", 18.0), ("few", 19.0), ("gap", 20.0)], "feature_id string, lst_median double")
    got = {r["feature_id"]: r for r in cooling.park_cooling_intensity(rings, own).collect()}
    assert (got["ok"]["PCI"], got["ok"]["turning_point_m"], got["ok"]["status"]) == (3.0, 60.0, "success")
    assert (got["up"]["PCI"], got["up"]["turning_point_m"], got["up"]["status"]) == (3.0, 60.0, "no_turning_point_found")
    assert got["few"]["status"] == "insufficient_rings"
    assert got["none"]["status"] == "no_interior_lst"
    assert (got["gap"]["status"], got["gap"]["PCI"]) == ("no_turning_point_found", 4.0)
    mean = {r["feature_id"]: r["PCI"] for r in cooling.park_cooling_intensity(rings, own, "TPM-A").collect()}
    assert mean["ok"] == 2.0


def test_split_sizes_and_disjointness(spark):
    df = spark.range(1000)
    got = {r["partition"]: r["count"] for r in sampling.split_random(df, 0.25, 0.1, 3).groupBy("partition").count().collect()}
    assert got == {"test": 250, "val": 100, "train": 650}
    a = sampling.split_random(df.repartition(7), 0.25, 0.1, 3).where("partition = 'test'")
    assert a.join(sampling.split_random(df, 0.25, 0.1, 3).where("partition = 'test'"), "id").count() == 250
    with pytest.raises(ValueError):
        sampling.split_random(df, 0.9, 0.2, 3)


def test_identity(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "k int, s string")
    assert identity.assign_feature_id(df, "k").count() == 3
    for bad in ("s", "absent"):
        with pytest.raises(ValueError):
            identity.assign_feature_id(df, bad)
    with pytest.raises(ValueError):
        identity.assign_feature_id(df.where("s IS NOT NULL"), "s")


def test_nearest_cells_however_far(spark):
    places = [(0, 0), (0, 1), (1, 0), (1, 1), (3, 9), (20, 20), (20, 27), (64, 3), (65, 3), (-40, 7), (-40, 8)] + [(30 + a, 30 + b) for a in range(4) for b in range(4)]
    cells = spark.createDataFrame([(r, c, float(r * c % 13)) for r, c in places], "row int, col int, value double")
    for k in (1, 8, 40):
        want = {(r, c, *o[1:], o[0]) for r, c in places for o in sorted(((r - a) ** 2 + (c - b) ** 2, a, b) for a, b in places if (a, b) != (r, c))[:k]}
        assert {(x["row"], x["col"], x["n_row"], x["n_col"], x["d2"]) for x in spatial.knn(cells, k).collect()} == want
    assert spatial.local_gi(cells, queen=True).count() == len(places)
    assert spatial.knn(cells.limit(1)).count() == spatial.knn(cells.limit(0)).count() == 0


def test_distance_bands_of_all_zones(spark):
    lst, zones = (standins.standin(spark, SF, x).collect() for x in ("lst", "zones"))
    edges = defaultdict(list)
    for e in zones:
        edges[e["feature_id"]].append((e["x1"], e["y1"], e["x2"], e["y2"]))
    x, y = np.array([r["col"] + 0.5 for r in lst]), np.array([r["row"] + 0.5 for r in lst])
    want = set()
    for f, part in edges.items():
        inside, d = np.zeros(len(x), bool), np.full(len(x), np.inf)
        for x1, y1, x2, y2 in part:
            if y1 != y2:
                inside ^= ((y1 <= y) != (y2 <= y)) & (x < x1 + (y - y1) * (x2 - x1) / (y2 - y1))
            t = np.clip(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2), 0, 1)
            d = np.minimum(d, np.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1)))
        want |= {(f, lst[i]["row"], lst[i]["col"], max(1.0, np.ceil(round(d[i] / 2, 9))) * 2) for i in np.flatnonzero(~inside & (d <= 6))}
    got = [tuple(r) for r in registry.QUERIES["j3_distance_bands_whole"](spark, SF).select("feature_id", "row", "col", "distance_m").collect()]
    assert len(edges) == 75 and len(got) == len(want) and set(got) == want


def test_heat_islands_of_the_whole_grid(spark):
    lst = standins.standin(spark, SF, "lst")
    near = spatial.neighbours(lst, 1.5).select("row", "col").distinct()
    assert near.where("row >= 40").count() > 0
    assert sum(r["n"] for r in registry.QUERIES["q2_heat_islands_whole"](spark, SF).collect()) == near.count()


def test_tails():
    assert statistics.t_p(2.228138851986273, 10) == pytest.approx(0.05, abs=1e-9)
    assert statistics.chi2_p(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert statistics.chi2_p(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert statistics.f_p(4.102821015000064, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert statistics.chi2_1_quantile(0.05) == pytest.approx(3.841458820694124, abs=1e-9)


def test_stepwise_and_vif(spark):
    df = spark.range(400).selectExpr("id", "cast(id % 17 as double) a", "cast(id * 7 % 23 as double) b", "cast(id * 13 % 29 as double) c").selectExpr("*", "2 * a - 3 * b + sin(id) y", "a + 0.001 * c d")
    g = statistics.Gram(df, ["y", "a", "b", "c", "d"])
    for direction in ("backward", "forward", "both"):
        assert set(statistics.stepwise(g, "y", ["a", "b", "c"], direction).xs) >= {"a", "b"}
    assert len(statistics.vif_prune(g, ["a", "b", "d"])) == 2
    table = {r[0]: r for r in statistics.Fit(g, "y", ["a", "b"]).table()}
    assert table["a"][1] == pytest.approx(2, abs=0.05) and table["b"][1] == pytest.approx(-3, abs=0.05)


EDGES = "feature_id string, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double"


def ring_edges(feature, ring, points, part=1):
    return [(feature, part, ring, k + 1, *map(float, p), *map(float, q)) for k, (p, q) in enumerate(zip(points, points[1:] + points[:1], strict=True))]


def clipped_area(points, row, col):
    """Area of a ring inside a cell, by cutting it at the cell's four sides."""
    for axis, bound, keep in ((0, col, 1), (0, col + 1, -1), (1, row, 1), (1, row + 1, -1)):
        out = []
        for p, q in zip(points, points[1:] + points[:1], strict=True):
            inside = [(x[axis] - bound) * keep >= 0 for x in (p, q)]
            if inside[0]:
                out.append(p)
            if inside[0] != inside[1]:
                t = (bound - p[axis]) / (q[axis] - p[axis])
                out.append(tuple(bound if i == axis else p[i] + t * (q[i] - p[i]) for i in (0, 1)))
        points = out
        if not points:
            return 0.0
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, points[1:] + points[:1], strict=True))) / 2


def test_coverage_equals_clipped_areas(spark):
    """Triangles, a hole, slivers, rings of either turn, two parts and sides on cell borders, to a billionth."""
    rnd = random.Random(8)
    shapes = {f"t{i}": [(1, [(rnd.uniform(0, 20), rnd.uniform(0, 20)) for _ in range(3)])] for i in range(12)}
    shapes["square"] = [(1, [(2, 2), (2, 5), (6, 5), (6, 2)])]
    shapes["hole"] = [(1, [(0.25, 0.5), (12.75, 0.5), (12.75, 9.5), (0.25, 9.5)]), (2, [(3.3, 3.1), (8.2, 4.4), (5.5, 8.7)])]
    shapes["sliver"] = [(1, [(0.1, 0.2), (19.9, 17.3), (19.9, 17.300001)])]
    shapes["flat"] = [(1, [(0.5, 3.0000001), (19.5, 3.0000002), (19.5, 3.4), (0.5, 3.3)])]
    edges = [e for f, rings in shapes.items() for r, points in rings for e in ring_edges(f, r, points)]
    edges += ring_edges("two", 1, [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5)]) + ring_edges("two", 1, [(10.25, 10.5), (11, 12.5), (10.25, 12.5)], 2)
    shapes["two"] = [(1, [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5)]), (1, [(10.25, 10.5), (11, 12.5), (10.25, 12.5)])]
    cells = spark.range(400).selectExpr("cast(id div 20 as int) row", "cast(id % 20 as int) col", "cast(id as double) value")
    table = spark.createDataFrame(edges, EDGES)
    got = {(r["feature_id"], r["row"], r["col"]): r["units"] / coverage.UNIT for r in coverage.covered_cells(cells, table).collect()}
    for f, rings in shapes.items():
        for row in range(20):
            for col in range(20):
                want = sum((1 if r == 1 else -1) * clipped_area([tuple(map(float, p)) for p in points], row, col) for r, points in rings)
                assert got.get((f, row, col), 0.0) == pytest.approx(want, abs=2e-9), (f, row, col)
    stats = {r["feature_id"]: r for r in spatial.zonal_statistics(cells, table, exact=True).collect()}
    own = [(row * 20 + col, w) for (f, row, col), w in got.items() if f == "hole"]
    whole = sum(w for _, w in own)
    assert stats["hole"]["count"] == pytest.approx(whole) and stats["hole"]["mean"] == pytest.approx(sum(v * w for v, w in own) / whole)
    assert coverage.covered_cells(cells, table.limit(0)).count() == 0


def test_coverage_costs_by_the_cells_that_edges_cross(spark):
    """A zone of a million cells adds a few numbers for each row, not for each cell."""
    table = spark.createDataFrame(ring_edges("z", 1, [(0.5, 0.5), (1000.5, 0.5), (1000.5, 1000.5), (0.5, 1000.5)]), EDGES)
    assert coverage.edge_areas(table).count() <= 4 * 1001
    assert coverage.coverage_spans(table).selectExpr("sum((to - from + 1) * units)").first()[0] == 1_000_000 * coverage.UNIT


def test_projection_known_points(spark):
    df = spark.createDataFrame([(-87.0, 41.0), (-73.0, 40.5)], "x double, y double")
    utm = vectors.reproject(df, 4326, 32616).first()
    assert utm["x"] == pytest.approx(500000, abs=1e-3) and utm["y"] == pytest.approx(4538757.06, abs=0.05)
    web = vectors.reproject(df, 4326, 3857).first()
    assert web["x"] == pytest.approx(math.radians(-87) * 6378137)
    with pytest.raises(ValueError):
        vectors.reproject(df, None, 4326)


def test_rectify_straight_down(spark):
    pose = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "frame_id int, rx double, ry double, rz double, tx double, ty double, tz double")
    px = spark.createDataFrame([(1, r, c, 10 * r + c) for r in range(5) for c in range(5)], "frame_id int, row int, col int, code int")
    got = {(r["row"], r["col"]): r["code"] for r in camera.rectify_to_ground(px, pose, (1.0, 1.0, 0.0, 0.0), (0, 4, 0, 4), 1.0).collect()}
    assert got[(0, 0)] == 40 and got[(3, 2)] == 12


def test_impact_equals_recomputation(spark):
    pairs = [(2, 1), (3, 2), (4, 2), (5, 9), (6, 3), (6, 5)]
    edges = spark.createDataFrame(pairs, "step int, depends_on int")
    missing = spark.createDataFrame([(2,), (5,)], "step int")

    def down(s):
        found = set()
        todo = [s]
        while todo:
            x = todo.pop()
            for a, b in pairs:
                if b == x and a not in found:
                    found.add(a)
                    todo.append(a)
        return found

    got = {(r[0], r[1]) for r in catalog.trace_impact(edges, missing).select("missing", "step").collect()}
    assert got == {(m, s) for m in (2, 5) for s in down(m)}


def test_stream_routes_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    (src / "b.geojson").write_text('{"type":"FeatureCollection"}')
    (src / "c.geojson").write_text("not json")
    (src / "d.tif").write_bytes(b"II*\x00rest")
    (src / "e.tif").write_bytes(b"II")
    (src / "a.geojson.meta.json").write_text("{}")
    gatekeeper.route(gatekeeper.file_arrivals(spark, f"file://{src}"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination(120)
    names = {t: {r[0].rsplit("/", 1)[1] for r in spark.read.parquet(f"file://{tmp_path}/out/{t}").select("source_file").collect()} for t in ("ready", "invalid", "quarantine")}
    assert names == {"ready": {"a.geojson", "d.tif"}, "invalid": {"b.geojson"}, "quarantine": {"c.geojson", "e.tif"}}


def test_tables_and_hashes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string")
    for name in ("t.csv", "t.parquet"):
        catalog.write_table(df, f"file://{tmp_path}/{name}")
        assert catalog.read_table(spark, f"file://{tmp_path}/{name}").count() == 2
    catalog.write_result_json(df, f"file://{tmp_path}/r.json")
    assert spark.read.json(f"file://{tmp_path}/r.json").count() == 2
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert catalog.hash_inputs(spark, [f"file://{tmp_path}/x.bin"]).first()["hash"] == "900150983cd24fb0d6963f7d28e17f72"


def test_medians_and_ranks_by_buckets(spark):
    import statistics

    rnd = random.Random(3)
    rows = [(k, rnd.choice([None, float("-inf"), -1e300, -2.5, 0.0, 1e-12, rnd.uniform(-5, 5), rnd.uniform(20, 21)])) for k in ("a", "b", None) for _ in range(301 if k else 150)] + [("none", None)] * 3
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r["median"] for r in medians(df, "v", ["k"]).collect()}
    for k in ("a", "b", None):
        assert got[k] == pytest.approx(statistics.median([v for g, v in rows if g == k and v is not None]))
    assert "none" not in got and medians(df.where("k = 'none'"), "v", []).collect()[0][0] is None
    assert medians(df, "v", []).collect()[0][0] == pytest.approx(statistics.median([v for _, v in rows if v is not None]))
    values = [v for _, v in rows]
    for r in rank_descending(df, "v").collect():
        more = sum(v is not None and (r["v"] is None or v > r["v"]) for v in values)
        assert r["rank"] == more + 1


def test_stratified_samples_of_a_hot_stratum(spark):
    df = spark.range(5000).selectExpr("id", "case when id % 100 = 0 then 'rare' when id % 7 = 0 then null else 'hot' end s").repartition(6)
    drawn = {r["s"]: r["count"] for r in sampling.sample_stratified(df, 40, 1, "s").groupBy("s").count().collect()}
    assert drawn == {"hot": 40, "rare": 40, None: 40}
    parts = sampling.split_stratified(df, 0.2, 0.1, 1, "s")
    n = {r["s"]: r["n"] for r in df.groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert parts.count() == 5000
    for r in parts.groupBy("s", "partition").count().collect():
        share = {"test": 0.2, "val": 0.1, "train": 0.7}[r["partition"]]
        assert abs(r["count"] - share * n[r["s"]]) <= 1.01


def test_texture_of_each_frame(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    frames = {f: rng.integers(0, 256, (9, 11, 3)) for f in (1, 2)}
    rows = [(f, r, c, *map(int, x[r, c])) for f, x in frames.items() for r in range(9) for c in range(11)]
    got = {(r["frame_id"], r["row"], r["col"]): r["texture"] for r in cells.featurize_frames(spark.createDataFrame(rows, "frame_id int, row int, col int, r int, g int, b int")).collect()}
    for f, x in frames.items():
        grey = np.pad(x.mean(2), 3, mode="symmetric")
        for r in range(9):
            for c in range(11):
                assert got[f, r, c] == pytest.approx(grey[r : r + 7, c : c + 7].std(), abs=1e-6)


def test_patches_by_hand(spark):
    grid = ["aab", "bbb", "acb"]
    codes = {"a": 1, "b": 2, "c": 3}
    df = spark.createDataFrame([(r, c, codes[x]) for r, line in enumerate(grid) for c, x in enumerate(line)], "row int, col int, code int")
    got = {r["code"]: r for r in spatial.patch_metrics(df).collect()}
    assert {k: r["n_patches"] for k, r in got.items()} == {1: 2, 2: 1, 3: 1}
    # outlines: a 6 of 6 and 4 of 4, b 12 of 10, c 4 of 4
    assert (got[1]["SHAPE_MN"], got[2]["SHAPE_MN"], got[3]["SHAPE_MN"]) == (1.0, 1.2, 1.0)
    assert got[1]["PD"] == pytest.approx(2 / 9, abs=1e-6)


def test_palette_ties_nulls_and_tolerance(spark):
    px = spark.createDataFrame([(0, 100, 0), (30, 100, 0), (31, 100, 0), (10, 10, 10), (None, 1, 1)], "r int, g int, b int")
    palette = spark.createDataFrame([(0, 100, 0, 5), (60, 100, 0, 4), (20, 10, 10, 9), (0, 10, 10, 8)], "pr int, pg int, pb int, code int")
    got = {(r["r"], r["g"]): r["code"] for r in cells.snap_palette(px, palette).collect()}
    assert got == {(0, 100): 5, (30, 100): 4, (31, 100): 4, (10, 10): 8, (None, 1): None}


def test_out_of_bag_scores_equal_recomputed_votes(spark):
    """Each row's vote by the trees that never drew it, from single predictions and draws."""
    rnd = random.Random(3)
    rows = [(i, float(i % 2), i % 2 + rnd.gauss(0, 0.6), rnd.random(), None if i % 50 == 0 else 1.0, 3.0 * (i % 7) + rnd.random()) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, label double, a double, b double, c double, y double")
    for label, xs, regression in (("label", ["a", "b", "c"], False), ("y", ["a", "b"], True)):
        bag = bagging.train_bag(df, label, xs, trees=5, regression=regression)
        drawn = {r["id"]: r["w"] for r in df.select("id", F.array(*[bagging.times_drawn(bag.seed, t, "id") for t in range(5)]).alias("w")).collect()}
        used = [v for w in drawn.values() for v in w]
        assert 0.85 < sum(used) / len(used) < 1.15 and 0.3 < sum(v == 0 for v in used) / len(used) < 0.44
        whole = VectorAssembler(inputCols=xs, outputCol="_features").transform(df.dropna(subset=xs))
        votes = defaultdict(list)
        for t, m in enumerate(bag.models):
            for r in m.transform(whole).collect():
                if drawn[r["id"]][t] == 0:
                    votes[r["id"]].append(r["prediction"])
        want = {i: sum(v) / len(v) if regression else min(set(v), key=lambda c: (-v.count(c), c)) for i, v in votes.items()}
        got = {r["id"]: r for r in bagging.oob_predictions(bag, df).collect()}
        assert {i: r["pred"] for i, r in got.items()} == pytest.approx(want) and all(r["trees"] == len(votes[i]) for i, r in got.items())
        score = bagging.oob_score(bag, df).first()
        truth = {r["id"]: r[label] for r in df.collect()}
        if regression:
            mean = sum(truth[i] for i in want) / len(want)
            assert score["oob_r2"] == pytest.approx(1 - sum((truth[i] - p) ** 2 for i, p in want.items()) / sum((truth[i] - mean) ** 2 for i in want))
        else:
            assert score["oob_accuracy"] == pytest.approx(sum(truth[i] == p for i, p in want.items()) / len(want)) and score["oob_accuracy"] > 0.6
        assert bagging.apply_bag(bag, df).count() == whole.count()


def test_bootstrap_intervals_without_multiplied_rows(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=600)
    y, z = 0.5 * x + rnd.normal(size=600), rnd.normal(size=600)
    rows = [(i, float(1e6 + y[i]), float(x[i]) if i % 40 else None, float(z[i])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, y double, x double, z double")
    got = sampling.bootstrap_correlations(df, "y", ["x", "z"], 300, 7)
    assert "Generate" not in got._jdf.queryExecution().toString()
    r = {v: np.array([q["r"] for q in got.where(F.col("variable") == v).collect()]) for v in ("x", "z")}
    for v, own in (("x", x), ("z", z)):
        keep = [i for i in range(600) if v == "z" or i % 40]
        plain = np.array([np.corrcoef(own[at], y[at])[0, 1] for at in (rnd.choice(keep, len(keep)) for _ in range(600))])
        assert np.abs(np.percentile(r[v], [2.5, 97.5]) - np.percentile(plain, [2.5, 97.5])).max() < 0.035
    table = {q["variable"]: q for q in statistics.correlation(df, "y", ["x", "z"], n_boot=300, seed=7).collect()}
    assert table["x"]["ci_low"] == pytest.approx(np.percentile(r["x"], 2.5), abs=1e-4) and table["z"]["ci_high"] == pytest.approx(np.percentile(r["z"], 97.5), abs=1e-4)
    hashes = rnd.integers(0, 1 << 63, 4000, dtype=np.uint64)
    drawn = sampling.draws(hashes, 50)
    assert drawn.mean() == pytest.approx(1, abs=0.02) and drawn.var() == pytest.approx(1, abs=0.03)


def test_retries_survive_a_restart(spark, tmp_path):
    """A file that heals on its second try, one that never does, one that arrives twice, one that heals after its end."""
    good, bad = b'{"type":"FeatureCollection","features":[]}', b"[1]"
    t = lambda s: datetime.datetime.fromtimestamp(1_700_000_000 + s, datetime.UTC)

    def run(rows):
        spark.createDataFrame([(p, c, t(s)) for p, c, s in rows], "path string, content binary, received_at timestamp").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema("path string, content binary, received_at timestamp").parquet(f"file://{tmp_path}/in")
        gatekeeper.route_decided(gatekeeper.with_retries(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
        out = set()
        for table in ("ready", "invalid", "quarantine"):
            got = spark.read.schema("path string, attempts int, decided_at timestamp, errors array<string>").parquet(f"file://{tmp_path}/out/{table}")
            out |= {(r["path"], table, r["attempts"], r["decided_at"].timestamp() - 1_700_000_000) for r in got.withColumn("decided_at", F.col("decided_at")).collect()}
        return out

    first = run([("heals.geojson", bad, 0), ("never.geojson", bad, 1), ("twice.geojson", good, 2), ("twice.geojson", good, 3), ("invalid.geojson", b'{"type":"Feature"}', 3), ("skip.txt", b"x", 4), ("late.geojson", bad, 5)])
    assert first == {("twice.geojson", "ready", 1, 2.0), ("invalid.geojson", "invalid", 1, 3.0)}
    second = run([("heals.geojson", good, 40), ("never.geojson", bad, 50), ("twice.geojson", good, 55)])
    assert second - first == {("heals.geojson", "ready", 2, 40.0)}
    third = run([("clock.geojson", good, 1000), ("late.geojson", good, 999)])
    assert third - second == {("never.geojson", "quarantine", 3, 121.0), ("late.geojson", "quarantine", 3, 125.0), ("late.geojson", "ready", 1, 999.0), ("clock.geojson", "ready", 1, 1000.0)}


def test_outcomes_measure_in_one_pass(spark, tmp_path):
    """Metadata and warnings equal separate aggregates; the plan that wrote the result read its cells once."""
    rows = [(r, c, None if (r * 7 + c) % 9 == 0 else float((r * 31 + c * 17) % 23), 10 if c < 2 else 30) for r in range(12) for c in range(12)]
    spark.createDataFrame(rows, "row int, col int, value double, code int").write.parquet(f"file://{tmp_path}/cells")
    cells = spark.read.parquet(f"file://{tmp_path}/cells")
    edges = spark.createDataFrame(ring_edges("in", 1, [(1, 1), (7.5, 1), (7.5, 6), (1, 6)]) + ring_edges("out", 1, [(50, 50), (60, 50), (60, 60)]), EDGES)
    nulls = sum(v is None for _, _, v, _ in rows)

    def scans(run):
        spark.sparkContext.setJobGroup("outcome", "outcome")
        out = run()
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("outcome") for s in tracker.getJobInfo(j).stageIds}
        read = sum(d.inputRecords() for s in stages for d in [spark.sparkContext._jsc.sc().statusStore().lastStageAttempt(s)])
        spark.sparkContext.setJobGroup("rest", "rest")
        return out, read

    zonal, read = scans(lambda: outcome.zonal_outcome(cells, edges, f"file://{tmp_path}/a1"))
    assert read == len(rows)
    assert {k: zonal.metadata[k] for k in ("n_cells", "n_null", "lowest", "highest", "n_zones", "n_empty")} == {"n_cells": 144, "n_null": nulls, "lowest": 0.0, "highest": 22.0, "n_zones": 2, "n_empty": 1}
    assert {tuple(r) for r in zonal.warnings.collect()} == {("warning", "zonal_statistics", "1 of 2 zones have no cells"), ("info", "zonal_statistics", "2 zones")}
    assert {r["feature_id"]: r["count"] for r in zonal.data.collect()} == {r["feature_id"]: r["count"] for r in spatial.zonal_statistics(cells, edges).collect()}
    cool = outcome.cooling_outcome(cells, [10], [30], f"file://{tmp_path}/a5", 30)
    forest = sum(v is not None and k == 10 for _, _, v, k in rows)
    assert cool.metadata["forest_n"] == forest < 30 and cool.metadata["n_valid"] == 144 - nulls
    assert [r["level"] for r in cool.warnings.collect()] == ["warning"]
    parts = spark.createDataFrame([(i, "test" if i % 4 == 0 else None) for i in range(20)], "id int, partition string")
    split = outcome.split_outcome(parts, 0.25, 0.0, f"file://{tmp_path}/m11")
    assert {r["level"] for r in split.warnings.collect()} == {"critical", "warning"} and split.metadata["n_without"] == 15
    merged = {r["level"]: r["n"] for r in catalog.warnings_by_level(zonal.warnings, cool.warnings, split.warnings).collect()}
    assert merged == {"warning": 3, "info": 1, "critical": 1}


def test_disc_sums_by_chords(spark):
    rnd = random.Random(2)
    grid = {(r, c): rnd.uniform(20, 40) for r in range(30) for c in range(-5, 35) if rnd.random() < 0.6} | {(100, 100): 1.0}
    cells = spark.createDataFrame([(r, c, v) for (r, c), v in grid.items()], "row int, col int, value double")
    for d in (1.0, 1.5, 8.0, 5.5):
        want = {}
        for r, c in grid:
            near = [v for (a, b), v in grid.items() if 0 < (a - r) ** 2 + (b - c) ** 2 <= d * d]
            if near:
                want[r, c] = (len(near), sum(near))
        got = {(q["row"], q["col"]): (q["w"], q["l"]) for q in spatial.disc_sums(cells, d).collect()}
        assert set(got) == set(want) and all(got[k][0] == n and got[k][1] == pytest.approx(t, abs=1e-9) for k, (n, t) in want.items())
    assert spatial.disc_sums(cells.limit(0), 8.0).count() == 0


def test_buckets_along_an_edge(spark):
    """A slanted edge of 100,000 units takes buckets in proportion to its length; distances equal those to each edge."""
    long = spark.createDataFrame(ring_edges("z", 1, [(0, 0), (80_000, 60_000)])[:1], EDGES)
    assert spatial.edge_buckets(long, 10.0).count() < 12 * 100_000 / 10
    shapes = {"a": [(3.2, 4.1), (17.5, 9.3), (8.8, 22.6)], "flat": [(2, 12), (25, 12), (25, 12.5)]}
    edges = spark.createDataFrame([e for f, points in shapes.items() for e in ring_edges(f, 1, points)], EDGES)
    cells = spark.range(900).selectExpr("cast(id div 30 as int) row", "cast(id % 30 as int) col", "cast(id as double) value")
    got = {(q["feature_id"], q["row"], q["col"]): q["d"] for q in spatial.edge_distances(cells, edges, 3.0).collect()}

    def distance(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)

    want = {(f, r, c): d for f, points in shapes.items() for r in range(30) for c in range(30) if (d := min(distance((c + 0.5, r + 0.5), a, b) for a, b in zip(points, points[1:] + points[:1], strict=True))) <= 3}
    assert got == pytest.approx(want)


def test_patches_from_runs(spark):
    """Equal to a flood fill, with links between runs; a patch of a million cells is a thousand runs."""
    rnd = random.Random(4)
    grid = {(r, c): rnd.choice([1, 1, 2]) for r in range(40) for c in range(-3, 150) if rnd.random() < 0.8}
    cells = spark.createDataFrame([(r, c, v) for (r, c), v in grid.items()], "row int, col int, code int")
    want = {}
    for start in sorted(grid):
        todo = [start] if start not in want else []
        while todo:
            at = todo.pop()
            if at in want:
                continue
            want[at] = start[0] * (1 << 31) + start[1]
            todo += [(at[0] + i, at[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if grid.get((at[0] + i, at[1] + j)) == grid[at]]
    assert {(r["row"], r["col"]): r["patch"] for r in spatial.patches(cells).collect()} == want
    million = spark.range(1_000_000).selectExpr("cast(id div 1000 as int) row", "cast(id % 1000 as int) col", "1 code")
    spans = spatial.runs(million).groupBy("row", "start", "code").agg(F.max("col").alias("end")).withColumn("v", F.col("row"))
    assert spans.count() == 1000 and spatial.run_links(spans).count() == 999
    assert spatial.patches(million).select("patch").distinct().count() == 1


def test_any_operator_as_a_step(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "scene string, v double")
    got = outcome.run_step(cooling.scene_rollup, {"rows": rows}, {"by": ["scene"], "value": "v"}, f"file://{tmp_path}/one")
    assert {tuple(r) for r in got.data.collect()} == {("a", 2.0, 2), ("b", None, 0)}
    assert {(r["name"], r["value"]) for r in got.report().collect()} == {("n_rows", "3"), ("n_out", "2")}
    empty = outcome.run_step(cooling.scene_rollup, {"rows": rows.limit(0)}, {"by": ["scene"], "value": "v"}, f"file://{tmp_path}/none")
    assert [(r["level"], r["message"]) for r in empty.warnings.collect()] == [("warning", "the result has no rows")] and empty.metadata["n_rows"] == 0
    with pytest.raises(ValueError, match="needs \\['value'\\]"):
        outcome.run_step(cooling.scene_rollup, {"rows": rows}, {"by": ["scene"], "value": None}, f"file://{tmp_path}/x")
    with pytest.raises(ValueError, match="takes no \\['colour'\\]"):
        outcome.run_step(cooling.scene_rollup, {"rows": rows}, {"by": ["scene"], "value": "v", "colour": 1}, f"file://{tmp_path}/x")


def test_user_filters(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    kept = outcome.filtered_outcome(rows, "s IS NULL OR id > 5", f"file://{tmp_path}/some")
    assert [r["id"] for r in kept.data.collect()] == [2] and kept.warnings.count() == 0 and kept.metadata["n_before"] == 2
    for i, bad in enumerate(("id >", "no_such > 1", "id + 1")):
        with pytest.raises(ValueError, match="filter expression"):
            outcome.filtered_outcome(rows, bad, f"file://{tmp_path}/bad{i}")
    with pytest.raises(ValueError, match="there are \\['gbt'"):
        models.train_regressor(rows, "id", ["id"], "no_such")


def test_moves_from_tables_equal_moves_as_parameters(spark):
    rnd = random.Random(4)
    weights = {"canopy": 1.0, "grass": 0.5, "impervious": -0.5, "soil": 0.1}
    rows = [(s, c, rnd.random()) for s in range(40) for c in (*weights, "other") if rnd.random() < 0.7]
    comp = spark.createDataFrame(rows, "space int, cls string, fraction double")
    moves = [("impervious", "grass", 0.25), ("grass", "canopy", 1.5), ("absent", "canopy", 1.0), ("soil", "no_such", 1.0), ("canopy", "soil", -0.5), ("other", "grass", 0.125)]
    table = spark.createDataFrame([(i, *m) for i, m in enumerate(moves)], "ord int, source string, target string, share double")
    known = spark.createDataFrame([*weights.items(), ("grass", 0.2), (None, 9.0)], "cls string, weight double")
    want = {tuple(r) for r in cooling.counterfactual_cooling(comp, weights, moves).collect()}
    assert {tuple(r) for r in cooling.counterfactual_from_tables(comp, known, table).collect()} == want
    own = table.where("ord = 0").withColumn("space", F.lit(3)).unionByName(spark.createDataFrame([(0, "soil", "soil", 0.5, 4), (1, "soil", "grass", None, 4)], "ord int, source string, target string, share double, space int"))
    got = {r["space"]: tuple(r) for r in cooling.counterfactual_from_tables(comp, known, own).collect()}
    one = {r["space"]: tuple(r) for r in cooling.counterfactual_cooling(comp, weights, moves[:1]).collect()}
    assert got[3] == one[3] and all(r[3] == 0 for s, r in got.items() if s != 3)
    assert cooling.counterfactual_from_tables(comp.limit(0), known, table).count() == 0
    assert {r[3] for r in cooling.counterfactual_from_tables(comp, known, table.limit(0)).collect()} == {0.0}


def test_columns_that_depend_on_others(spark):
    """Partial correlations and stepwise choice where a column repeats another, is their sum, or is constant."""
    rng = np.random.default_rng(3)
    a, b, e = rng.normal(size=(3, 300))
    table = {"y": 2 * a - b + e, "a": a, "b": b, "twice": 2 * a, "both": a + b, "one": np.ones(300)}
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(*table.values(), strict=True))], "id int, " + ", ".join(f"{k} double" for k in table))
    got = {r["variable"]: r for r in statistics.correlation(df, "y", ["a", "both"], ["twice"]).collect()}
    assert (got["a"]["partial_r"], got["a"]["partial_p"]) == (None, None)
    rest = lambda v: v - np.polyval(np.polyfit(a, v, 1), a)
    assert got["both"]["partial_r"] == pytest.approx(np.corrcoef(rest(table["y"]), rest(table["both"]))[0, 1], abs=1e-4)
    repeated = {r["variable"]: r["partial_r"] for r in statistics.correlation(df, "y", ["b"], ["a", "twice"]).collect()}
    assert repeated == {r["variable"]: r["partial_r"] for r in statistics.correlation(df, "y", ["b"], ["a"]).collect()}
    g = statistics.Gram(df, list(table))
    assert statistics.unaliased(g, ["one", "a", "twice", "b", "both"]) == ["a", "b"]
    assert statistics.unaliased(g, ["both", "twice", "b"]) == ["both", "twice"]
    for direction in ("backward", "forward", "both"):
        fit = statistics.stepwise(g, "y", ["a", "twice", "b", "both", "one"], direction)
        assert sorted(fit.xs) == ["a", "b"] and fit.b[fit.xs.index("a")] == pytest.approx(2, abs=0.2)


def test_forests_in_a_session_that_has_observed(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i), float(i % 7), int(i > 30)) for i in range(60)], "id int, a double, b double, label int")
    outcome.filtered_outcome(rows, "id > 0", f"file://{tmp_path}/seen")
    for kind in ("rf", "logistic", "gbt"):
        assert models.apply_classifier(models.train_classifier(rows, "label", ["a", "b"], kind, 3), rows).where("pred = label").count() > 50
    assert models.cv_score(rows, "label", ["a", "b"], trees=3) > 0.8
