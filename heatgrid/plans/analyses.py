"""End-to-end analyses: chains of the operators, each one lazy plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgrid.operators import camera, cells, cooling, sampling, scores, spatial, statistics, vectors
from heatgrid.operators.models import apply_regressor, segment_pixels, train_regressor
from heatgrid.operators.regrid import Grid, reproject_cells
from heatgrid.plans.cooling import DIFFERENTIAL, PCI
from heatgrid.plans.spatial import DIST, GEOM, GI, TIER, inside
from heatgrid.registry import query
from heatgrid.sources import standins
from heatgrid.sources.shared import new_folder
from heatgrid.streaming import gatekeeper

standins.SQL |= {
    "arrivals": """SELECT page_id AS id, CAST(page_id AS STRING) || CASE page_id % 4 WHEN 0 THEN '.geojson' WHEN 1 THEN '.tif' WHEN 2 THEN '.yml' ELSE '.txt' END AS path,
      CASE page_id % 20 WHEN 0 THEN '{"type":"FeatureCollection","features":[]}' WHEN 4 THEN '{"type":"FeatureCollection"}' WHEN 8 THEN '{"type":"Feature"}' WHEN 12 THEN '[1]' WHEN 16 THEN html WHEN 1 THEN 'MM' WHEN 2 THEN '{"city":{"name":"a","id":"b"},"crs":{"working":1}}' WHEN 6 THEN '{"city":{"id":"b"},"crs":{"working":1}}' ELSE html END AS body FROM {pages}""",
    # every file once, broken ones a second time, half of those mended; the last row only moves the clock
    "receives": """SELECT path, CASE id % 20 WHEN 12 THEN '[1]' WHEN 16 THEN '[2' ELSE body END AS body, id % 100 AS at FROM {arrivals} a WHERE id % 4 <> 3 UNION ALL
      SELECT path, CASE id % 40 WHEN 12 THEN '{"type":"FeatureCollection","features":[]}' ELSE '[1]' END, id % 100 + CASE id % 80 WHEN 12 THEN 30 ELSE 90 END FROM {arrivals} b WHERE id % 20 = 12 UNION ALL SELECT 'clock.tif', 'MM', 100000""",
    "poses": "SELECT s_suppkey AS frame_id, 0.1E0 + CAST(s_suppkey % 5 AS DOUBLE) / 50 AS rx, 0.02E0 AS ry, 0.01E0 AS rz, -2.0E0 AS tx, -2.0E0 AS ty, 8.0E0 + CAST(s_suppkey % 7 AS DOUBLE) AS tz, 0.0E0 AS roi_x0, 4.0E0 AS roi_x1, 0.0E0 AS roi_y0, 4.0E0 AS roi_y1, 1.0E0 AS target_x0, 2.0E0 AS target_x1, 1.0E0 AS target_y0, 3.0E0 AS target_y1, CASE WHEN s_suppkey % 4 = 0 THEN 0.3E0 ELSE 0.9E0 END AS coverage FROM {supplier}",
    "frames_px": "SELECT l_suppkey AS frame_id, CAST(l_partkey % 64 AS INT) AS row, CAST(l_orderkey % 64 AS INT) AS col, CAST(max(l_partkey % 8) AS INT) AS code FROM {lineitem} GROUP BY 1, 2, 3",
}
CAMERA = (60.0, 60.0, 32.0, 32.0)
_UNREADABLE = "['unreadable']"
query("k2_validate", "arrivals", """SELECT path, file_type, status, array_to_string(errors, ';') AS errors FROM (SELECT path, t AS file_type, CASE WHEN t = 'unknown' THEN 'skipped' WHEN e IS NULL THEN 'poisoned' WHEN len(e) > 0 THEN 'invalid' ELSE 'ready' END AS status, coalesce(e, ['unreadable']) AS errors FROM (
SELECT path, CASE id % 4 WHEN 0 THEN 'geojson' WHEN 1 THEN 'geotiff' WHEN 2 THEN 'manifest' ELSE 'unknown' END AS t, CASE id % 20 WHEN 0 THEN [] WHEN 4 THEN ['FeatureCollection without features'] WHEN 8 THEN ['Feature without geometry'] WHEN 1 THEN NULL WHEN 2 THEN [] WHEN 6 THEN ['missing city.name']
 ELSE CASE id % 4 WHEN 1 THEN ['no TIFF signature'] WHEN 3 THEN [] END END AS e FROM {arrivals} a))""")(lambda a: gatekeeper.validate(a.select("path", F.encode("body", "UTF-8").alias("content"))).withColumn("errors", F.array_join("errors", ";")))  # fmt: skip


def routed(arrivals):
    """K1, K6: a stream over the written arrivals, routed to three tables, which are read back."""
    spark, base = arrivals.sparkSession, new_folder(arrivals.sparkSession, "arrivals")
    arrivals.select("path", F.encode("body", "UTF-8").alias("content")).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("path string, content binary").parquet(f"{base}/in")
    gatekeeper.route(stream, f"{base}/out", f"{base}/state").awaitTermination()
    read = [spark.read.parquet(f"{base}/out/{t}").select(F.col("source_file").alias("path"), F.lit(t).alias("routed"), F.array_join("errors", ";").alias("errors")) for t in ("ready", "invalid", "quarantine")]
    return read[0].unionByName(read[1]).unionByName(read[2])


query("k6_route", "arrivals", """SELECT path, CASE WHEN e IS NULL THEN 'quarantine' WHEN len(e) > 0 THEN 'invalid' ELSE 'ready' END AS routed, array_to_string(coalesce(e, ['unreadable']), ';') AS errors FROM (
SELECT path, CASE id % 20 WHEN 0 THEN [] WHEN 4 THEN ['FeatureCollection without features'] WHEN 8 THEN ['Feature without geometry'] WHEN 1 THEN NULL WHEN 2 THEN [] WHEN 6 THEN ['missing city.name'] ELSE CASE WHEN id % 4 = 1 THEN ['no TIFF signature'] END END AS e FROM {arrivals} a WHERE id % 4 <> 3)""")(routed)
def retried(receives):
    """K6: arrivals with times, as a stream; poisoned files are received again before they are given up."""
    spark, base = receives.sparkSession, new_folder(receives.sparkSession, "receives")
    receives.select("path", F.encode("body", "UTF-8").alias("content"), F.timestamp_seconds(F.col("at") + 1_700_000_000).alias("received_at")).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("path string, content binary, received_at timestamp").parquet(f"{base}/in")
    gatekeeper.route_decided(gatekeeper.with_retries(stream), f"{base}/out", f"{base}/state").awaitTermination()
    read = [spark.read.schema("path string, attempts int, decided_at timestamp").parquet(f"{base}/out/{t}").select("path", F.lit(t).alias("routed"), "attempts", (F.unix_seconds("decided_at") - 1_700_000_000).alias("at")) for t in ("ready", "invalid", "quarantine")]
    return read[0].unionByName(read[1]).unionByName(read[2]).where("path <> 'clock.tif'")


query("k6_retries", "arrivals receives", """SELECT path, routed, CASE WHEN routed = 'quarantine' THEN 3 WHEN id % 80 = 12 THEN 2 WHEN id % 40 = 12 THEN 3 ELSE 1 END AS attempts, id % 100 + CASE WHEN routed = 'quarantine' THEN 120 WHEN id % 80 = 12 THEN 30 WHEN id % 40 = 12 THEN 90 ELSE 0 END AS at
FROM (SELECT id, path, CASE WHEN id % 20 IN (0, 2) OR id % 40 = 12 THEN 'ready' WHEN id % 20 IN (4, 5, 6, 8, 9, 13, 17) THEN 'invalid' ELSE 'quarantine' END AS routed FROM {arrivals} a WHERE id % 4 <> 3)""")(lambda a, r: retried(r))
query("k5_validation_sidecars", "arrivals", "SELECT CASE id % 4 WHEN 0 THEN 'geojson' WHEN 1 THEN 'geotiff' WHEN 2 THEN 'manifest' ELSE 'unknown' END AS file_type, count(*) AS n, '1' AS version FROM {arrivals} a GROUP BY 1")(
    lambda a: gatekeeper.sidecars(gatekeeper.validate(a.select("path", F.encode("body", "UTF-8").alias("content")))).groupBy("file_type").agg(F.count("*").alias("n"), F.max("validator_version").alias("version")))
_SRC, _DST = Grid(3857, 0.0, 0.0, 1.0, 1.0, 64, 64), Grid(3857, 0.25, 0.25, 2.0, 2.0, 30, 30)
query("r1_reproject_cells_nearest", "lst", "SELECT CAST(y AS INT) AS row, CAST(x AS INT) AS col, value FROM range(30) a(y), range(30) b(x) JOIN {lst} t ON t.row = floor(0.25 + (y + 0.5) * 2) AND t.col = floor(0.25 + (x + 0.5) * 2)")(lambda lst: reproject_cells(lst, _SRC, _DST, "nearest"))
query("r1_reproject_cells_bilinear", "lst", """SELECT CAST(y AS INT) AS row, CAST(x AS INT) AS col, round(sum(CASE WHEN dy = 0 THEN 1 - wy ELSE wy END * CASE WHEN dx = 0 THEN 1 - wx ELSE wx END * value) / sum(CASE WHEN dy = 0 THEN 1 - wy ELSE wy END * CASE WHEN dx = 0 THEN 1 - wx ELSE wx END), 4) AS value
FROM (SELECT y, x, 0.75::DOUBLE AS wy, 0.75::DOUBLE AS wx FROM range(30) a(y), range(30) b(x)), range(2) c(dy), range(2) d(dx) JOIN {lst} t ON t.row = 2 * y + dy AND t.col = 2 * x + dx GROUP BY y, x""")(lambda lst: reproject_cells(lst, _SRC, _DST).withColumn("value", F.round("value", 4)))  # fmt: skip
query("r1_reproject_cells_utm", "lst")(lambda lst: reproject_cells(lst, Grid(32616, 500000.0, 4500000.0, 30.0, 30.0, 64, 64), Grid(4326, -87.0, 40.65, 0.0003, 0.0003, 60, 60), "nearest"))
_AXIS = "SELECT *, cos(th) AS c, sin(th) AS s, rx / th AS ax, ry / th AS ay, rz / th AS az FROM (SELECT *, sqrt(rx * rx + ry * ry + rz * rz) AS th FROM {poses} p)"


def _point(x: str, y: str) -> tuple[str, str]:
    """SQL: normalised image coordinates of a ground point by the rotation formula v cos + (a x v) sin + a (a . v)(1 - cos)."""
    dot = f"((ax * ({x}) + ay * ({y})) * (1 - c))"
    px, py, pz = f"(({x}) * c - az * ({y}) * s + ax * {dot} + tx)", f"(({y}) * c + az * ({x}) * s + ay * {dot} + ty)", f"((ax * ({y}) - ay * ({x})) * s + az * {dot} + tz)"
    return f"({px} / {pz})", f"({py} / {pz})"


_GX, _GY = _point("j / 4.0::DOUBLE", "4 - i / 4.0::DOUBLE")
GROUND = f"""SELECT o.frame_id, CAST(i AS INT) AS row, CAST(j AS INT) AS col, coalesce(code, 0) AS code FROM (SELECT frame_id, i, j, round(60 * {_GY} + 32)::INT AS sr, round(60 * {_GX} + 32)::INT AS sc FROM ({_AXIS}), range(16) a(i), range(16) b(j)) o
LEFT JOIN {{frames_px}} f ON f.frame_id = o.frame_id AND f.row = sr AND f.col = sc"""


def _quad(k: str) -> str:
    """SQL: image area of a ground rectangle under radial distortion."""
    uv = []
    for x, y in ((0, 0), (1, 0), (1, 1), (0, 1)):
        nx, ny = _point(f"{k}_x{x}", f"{k}_y{y}")
        far = f"(1 + 0.1 * ({nx} * {nx} + {ny} * {ny}) - 0.05 * ({nx} * {nx} + {ny} * {ny}) ** 2)"
        uv.append((f"(60 * {nx} * {far} + 32)", f"(60 * {ny} * {far} + 32)"))
    return "abs(" + " + ".join(f"{uv[i][0]} * {uv[(i + 1) % 4][1]} - {uv[(i + 1) % 4][0]} * {uv[i][1]}" for i in range(4)) + ") / 2"


query("r5_rectify_to_ground", "frames_px poses", GROUND)(lambda px, p: camera.rectify_to_ground(px, p, CAMERA, (0, 4, 0, 4), 4.0))
query("r5_valid_fraction", "frames_px poses", f"SELECT *, valid_fraction < 0.5 AS warn FROM (SELECT frame_id, round(count(*) FILTER (code <> 0) / count(*), 4) AS valid_fraction FROM ({GROUND}) GROUP BY 1)")(lambda px, p: camera.valid_fraction(camera.rectify_to_ground(px, p, CAMERA, (0, 4, 0, 4), 4.0)))
query("a18_score_composition", "poses", f"""SELECT frame_id, round(truth, 6) AS truth_fraction, round(raw, 6) AS raw_fraction, round(abs(raw - truth), 6) AS raw_error, coverage, CASE WHEN coverage < 0.5 THEN 'inconclusive' WHEN abs(raw - truth) > 0 THEN 'supported' ELSE 'not_supported' END AS verdict
FROM (SELECT frame_id, coverage, (target_x1 - target_x0) * (target_y1 - target_y0) / ((roi_x1 - roi_x0) * (roi_y1 - roi_y0)) AS truth, {_quad('target')} / ({_quad('roi')}) AS raw FROM ({_AXIS}))""")(lambda p: camera.score_composition(p, CAMERA, (0.1, -0.05)))
_MIRROR = """SELECT *, {at} AS _at FROM {t} UNION ALL SELECT *, 2 * lo - 1 - {at} FROM {t} WHERE 2 * lo - 1 - {at} >= lo - 3 UNION ALL SELECT *, 2 * hi + 1 - {at} FROM {t} WHERE 2 * hi + 1 - {at} <= hi + 3"""


def _means(t: str, at: str, other: str) -> str:
    """SQL: means of s and q over 7 cells along ``at``, ends reflected, at the cells of ``t``."""
    ends = f"(SELECT *, min({at}) OVER (PARTITION BY frame_id, {other}) AS lo, max({at}) OVER (PARTITION BY frame_id, {other}) AS hi FROM {t})"
    frame = f"(PARTITION BY frame_id, {other} ORDER BY _at RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
    return f"SELECT frame_id, {other}, _at AS {at}, s, q FROM (SELECT frame_id, {other}, _at, avg(s) OVER {frame} AS s, avg(q) OVER {frame} AS q, _at BETWEEN lo AND hi AS inside FROM ({_MIRROR.format(t=ends, at=at)})) WHERE inside"


query("p18_featurize_frames", "labelled_pixels", f"""WITH p AS (SELECT frame_id, row, col, label, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b FROM {{labelled_pixels}}), grey AS (SELECT frame_id, row, col, (r + g + b) / 3 AS s, (r + g + b) / 3 * ((r + g + b) / 3) AS q FROM p),
 h AS ({_means('grey', 'col', 'row')}), v AS ({_means('h', 'row', 'col')})
 SELECT frame_id, row, col, r, g, b, 2 * g - r - b AS exg, round(greatest(-1, least(1, (g - r) / (g + r - b + 1e-6))), 4) AS vari, round((2 * g - r - b) / (2 * g + r + b + 1e-6), 4) AS gli, round(sqrt(greatest(q - s * s, 0)), 3) AS texture, label
 FROM p JOIN v USING (frame_id, row, col) WHERE label <> 0""")(
    lambda px: cells.featurize_frames(px.drop("label"), px.select("frame_id", "row", "col", "label"), "labeled").select("frame_id", "row", "col", *[F.col(c).cast("double").alias(c) for c in "rgb"], "exg", F.round("vari", 4).alias("vari"), F.round("gli", 4).alias("gli"), F.round("texture", 3).alias("texture"), "label"))

_PARK = f"SELECT feature_id, round(median(value), 6) AS lst_median FROM ({inside('lst', 'zones', 'value')}) GROUP BY 1"


def park_cooling(zones, lst):
    """Q1: audit, normalise, area filter, rings, medians, PCI. The parks and their cells are found once."""
    good = vectors.audit(zones).where("valid").select("feature_id")
    rings = vectors.normalise_rings(zones.join(good, "feature_id", "left_semi"))
    large = vectors.filter_by_area(rings, 0.005).select("feature_id")
    parks = spatial.checkpointed(rings.join(large, "feature_id", "left_semi"))
    inside_ = spatial.checkpointed(spatial.cells_in_zones(lst, parks))
    band = spatial.distance_bands(lst, parks, 1, 5, inside_).groupBy("feature_id", "distance_m").agg(F.median("value").alias("lst_median"))
    own = inside_.groupBy("feature_id").agg(F.median("value").alias("lst_median"))
    return cooling.park_cooling_intensity(band, own, min_rings=2)


_BANDS = f"""SELECT feature_id, distance_m, median(value) AS lst_median FROM (SELECT d.feature_id, d.value, greatest(1, ceil(round(d, 9))) * 1.0::DOUBLE AS distance_m FROM ({DIST.replace('{some_zones}', '{zones}')}) d
ANTI JOIN ({inside('lst', 'zones', 'value')}) i ON i.feature_id = d.feature_id AND i.row = d.row AND i.col = d.col WHERE d <= 5) WHERE feature_id IN (SELECT feature_id FROM ({GEOM}) WHERE area_ha >= 0.005) GROUP BY 1, 2"""
#: every zone is valid
Q1 = PCI.replace("LEVEL", "tv").replace("j >= 3", "j >= 2").replace("n_rings < 3", "n_rings < 2").replace("{rings}", f"({_BANDS})").replace("{interior}", f"({_PARK.replace('round(median(value), 6)', 'median(value)')})")
query("q1_park_cooling", "zones lst", Q1 + "SELECT * FROM pci")(park_cooling)
query("q2_heat_islands", "lst", f"SELECT tier, count(*) AS n FROM (SELECT {TIER} AS tier FROM ({GI})) GROUP BY tier")(lambda lst: spatial.classify_clusters(spatial.local_gi(lst)).groupBy("tier").agg(F.count("*").alias("n")))
query("q2_heat_islands_whole", "lst", f"SELECT tier, count(*) AS n FROM (SELECT {TIER} AS tier FROM ({GI})) GROUP BY tier")(lambda lst: spatial.classify_clusters(spatial.local_gi(lst)).groupBy("tier").agg(F.count("*").alias("n")))
_COARSE = """SELECT value, code FROM (SELECT row // 4 AS row, col // 4 AS col, median(value) AS value FROM {lst} t GROUP BY ALL) JOIN (SELECT row, col, arg_min(code, code - 1000 * n) AS code FROM (SELECT row // 4 AS row, col // 4 AS col, code, count(*) AS n FROM {lc} t GROUP BY ALL) GROUP BY row, col) USING (row, col)"""
query("q3_cooling_differential", "lst lc", DIFFERENTIAL.replace("{lst_lc}", f"({_COARSE})"))(lambda lst, lc: cooling.cooling_differential(cells.composite(lst.selectExpr("cast(row div 4 as int) row", "cast(col div 4 as int) col", "value", "row * 64 + col time"), "median").join(cells.resample_majority(lc, 4), ["row", "col"]), [10], [30, 50]))


def predict_temperature(lst, lc):
    """Q4: sample valid cells, window shares, blocks to train and test, fit, apply, score."""
    at = cells.valid_mask(lst, lc).withColumn("id", F.col("row") * 1000 + F.col("col"))
    drawn = sampling.sample_random(at, 800, 7)
    shares = spatial.buffer_fractions(lc, drawn, 3, {"green": [10, 30], "grey": [50], "blue": [80]})
    rows = shares.join(drawn.select("id", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), F.col("value").alias("lst")), "id")
    parts = sampling.split_spatial(rows, 0.3, 0.0, 7, 8)
    model = train_regressor(parts.where("partition = 'train'"), "lst", ["green", "grey", "blue"], "linear")
    return scores.score_regression(apply_regressor(model, parts.where("partition = 'test'")), "lst", "pred")


query("q4_predict_temperature", "lst lc")(predict_temperature)


def evaluate_segmenters(px):
    """Q5: split labelled frames, fit on training pixels, apply, score by frame, average."""
    feats = cells.FEATURES
    rows = spatial.checkpointed(cells.featurize_frames(px.drop("label"), px.select("frame_id", "row", "col", "label")))  # training reads them many times
    parts = sampling.split_random(rows.select("frame_id").distinct(), 0.3, 0.0, 7, "frame_id")
    train = rows.join(parts.where("partition = 'train'"), "frame_id", "left_semi")
    test = rows.join(parts.where("partition = 'test'"), "frame_id", "left_semi")
    from heatgrid.operators.models import train_classifier

    done = segment_pixels(test, feats, model=train_classifier(train.where("label <> 0"), "label", feats, "rf", 10))
    by_frame = scores.score_segmenters(done.withColumn("model", F.lit("rf")), ["frame_id", "model"], "label", "pred")
    return scores.macro_average(by_frame, ["model"], ["accuracy", "mean_iou", "kappa"])


query("q5_evaluate_segmenters", "labelled_pixels")(evaluate_segmenters)


def landscape_survey(px, poses, weights):
    """Q6: index of whole frames and of their ground view, with coverage; coldest first."""
    potential = lambda m, s: cooling.space_cooling_potential(m.select(F.col("frame_id").alias("space"), "code"), weights, {"green": [1, 2, 3]}).select("space", F.col("index").alias(s))
    ground = spatial.checkpointed(camera.rectify_to_ground(px, poses, CAMERA, (0, 4, 0, 4), 4.0))  # read twice
    cover = camera.valid_fraction(ground).select(F.col("frame_id").alias("space"), "valid_fraction")
    return potential(px, "whole").join(potential(ground, "ground"), "space", "left").join(cover, "space", "left").where("whole IS NOT NULL").orderBy("whole", "space")


query("q6_landscape_survey", "frames_px poses weights")(landscape_survey)
query("q7_composition_lst", "composition class_lst", "SELECT round(avg(lst), 3) AS mean, count(lst) AS n FROM (SELECT space, round(sum(fraction * lst::DOUBLE) / sum(fraction), 3) AS lst FROM {composition} c JOIN {class_lst} t USING (cls) WHERE cls NOT IN ('water', 'soil') GROUP BY space)")(
    lambda c, t: cooling.scene_rollup(cooling.predicted_lst(c.where("cls <> 'water'"), t.withColumn("lst", F.col("lst").cast("double")), "excluded").withColumn("g", F.lit(1)), ["g"], "lst").drop("g"))
query("q8_falsification", "three poses")(lambda t, p: scores.composition_error(t, 0.9, [1, 2, 3, 4]).select("verdict").unionByName(camera.score_composition(p, CAMERA).select("verdict")).groupBy("verdict").agg(F.count("*").alias("n")))


def explain_pci(zones, lst, lc, crosswalk):
    """Q9: landscape metrics and class shares against PCI: correlations."""
    pci = park_cooling(zones, lst).where("PCI IS NOT NULL").select("feature_id", "PCI")
    metrics = spatial.landscape_metrics(vectors.geometry(zones), zones, lc, lst.withColumn("value", F.col("value") / 50 - 0.3))
    shares = spatial.land_cover_proportions(lc, zones, crosswalk, ["forest", "open", "built"])
    rows = pci.join(metrics, "feature_id").join(shares, "feature_id").withColumnRenamed("feature_id", "id")
    return statistics.correlation(rows, "PCI", ["PA", "LPI", "prop_forest", "prop_open"], ["PP"])


query("q9_explain_pci", "zones lst lc crosswalk")(explain_pci)
