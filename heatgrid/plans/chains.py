"""The analyses in their full length: Q1 and Q2 from scaled, reprojected and cropped rasters, Q5 and Q6 from image files, Q9 to hold-out scores."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgrid.functions.order import medians
from heatgrid.operators import camera, catalog, cells, cooling, sampling, scores, spatial, statistics, vectors
from heatgrid.operators.identity import assign_feature_id
from heatgrid.operators.models import apply_classifier, segment_pixels, train_classifier
from heatgrid.operators.regrid import Grid, reproject_cells
from heatgrid.plans.analyses import CAMERA
from heatgrid.plans.cooling import PCI
from heatgrid.plans.sampling import rank
from heatgrid.plans.spatial import DIST, GI, TIER, inside
from heatgrid.registry import query
from heatgrid.sources import standins

#: degrees of one metre at the equator
DEG = 180 / math.pi / 6378137.0
#: Scale and offset of thermal numbers, and the range of plausible degrees
SCALE, OFFSET, LOW, HIGH = 0.00341802, -124.15, -60.0, 80.0

standins.SQL |= {
    # a raster of 64 columns in degrees, with gaps; its rows grow with the parts
    "strip_dn": "SELECT CAST(floor(l_partkey / 8) AS INT) AS row, CAST(l_orderkey % 64 AS INT) AS col, CASE WHEN min(l_partkey) % 17 = 0 THEN NULL ELSE sum(l_quantity) / count(*) * 100 + 44000 END AS value FROM {lineitem} GROUP BY 1, 2",
    # one park for each row of the raster, in degrees: squares, triangles, small squares and crossed ones
    "strip_parks": """SELECT fid, 1 AS part, 1 AS ring, seq, degrees((x0 + a) / 6378137.0E0) AS x1, degrees(2 * atan(exp((y0 + b) / 6378137.0E0)) - pi() / 2) AS y1, degrees((x0 + c) / 6378137.0E0) AS x2, degrees(2 * atan(exp((y0 + d) / 6378137.0E0)) - pi() / 2) AS y2
      FROM (SELECT fid, CAST(fid % 4 AS INT) AS k, CAST(fid % 8 * 8 AS DOUBLE) + 1.25E0 AS x0, CAST(floor(fid / 8) * 8 AS DOUBLE) + 1.25E0 AS y0 FROM {strip_names} n) q JOIN
      (VALUES (0, 1, 0, 0, 6, 0), (0, 2, 6, 0, 6, 6), (0, 3, 6, 6, 0, 6), (0, 4, 0, 6, 0, 0), (1, 1, 0, 0, 6, 0), (1, 2, 6, 0, 0, 6), (1, 3, 0, 6, 0, 0),
        (2, 1, 0, 0, 3, 0), (2, 2, 3, 0, 3, 3), (2, 3, 3, 3, 0, 3), (2, 4, 0, 3, 0, 0), (3, 1, 0, 0, 6, 6), (3, 2, 6, 6, 6, 0), (3, 3, 6, 0, 0, 4), (3, 4, 0, 4, 0, 0)) AS e(kind, seq, a, b, c, d) ON kind = k""",
    "strip_names": "SELECT CAST(floor(p_partkey / 8) AS BIGINT) AS fid, 'park_' || CAST(CAST(floor(p_partkey / 8) AS BIGINT) AS STRING) AS park_code FROM {part} WHERE p_partkey % 8 = 0",
    "strip_boundary": """SELECT 'city' AS feature_id, 1 AS part, 1 AS ring, seq, degrees((CASE a WHEN 0 THEN 4.25E0 ELSE 58.25E0 END) / 6378137.0E0) AS x1, degrees(2 * atan(exp((CASE b WHEN 0 THEN 4.25E0 ELSE h END) / 6378137.0E0)) - pi() / 2) AS y1, degrees((CASE c WHEN 0 THEN 4.25E0 ELSE 58.25E0 END) / 6378137.0E0) AS x2, degrees(2 * atan(exp((CASE d WHEN 0 THEN 4.25E0 ELSE h END) / 6378137.0E0)) - pi() / 2) AS y2
      FROM (SELECT CAST(floor(max(l_partkey) / 8) AS DOUBLE) - 4.75E0 AS h FROM {lineitem}) q, (VALUES (1, 0, 0, 1, 0), (2, 1, 0, 1, 1), (3, 1, 1, 0, 1), (4, 0, 1, 0, 0)) AS e(seq, a, b, c, d)""",
    "photo_files": "SELECT 'photos/' || CAST(s_suppkey AS STRING) || '_' || CAST(s_suppkey % 3 AS STRING) || '.jpg' AS path FROM {supplier}",
    "scribble_files": "SELECT 'labels/' || CAST(s_suppkey AS STRING) || '_' || CAST(s_suppkey % 3 AS STRING) || '.png' AS path FROM {supplier} WHERE s_suppkey % 7 <> 0 UNION ALL SELECT 'labels/' || CAST(s_suppkey AS STRING) || '_' || CAST(s_suppkey % 3 AS STRING) || '.jpg' FROM {supplier} WHERE s_suppkey % 2 = 0",
    "photo_px": "SELECT 'photos/' || CAST(l_suppkey AS STRING) || '_' || CAST(l_suppkey % 3 AS STRING) || '.jpg' AS path, CAST(l_partkey % 64 AS INT) AS row, CAST(l_orderkey % 64 AS INT) AS col, CAST(max(l_partkey) % 256 AS INT) AS r, CAST(max(l_orderkey) % 256 AS INT) AS g, CAST(max(l_linenumber) * 30 AS INT) AS b FROM {lineitem} GROUP BY 1, 2, 3",
    # scribbles are near palette colours where the red or the green of the photograph is high, black elsewhere
    "scribble_px": "SELECT replace(replace(path, 'photos', 'labels'), 'jpg', 'png') AS path, row, col, CASE WHEN r > 170 THEN 201 WHEN g > 128 THEN 3 ELSE 0 END AS r, CASE WHEN r > 170 THEN 62 WHEN g > 128 THEN 99 ELSE 0 END AS g, CASE WHEN r > 170 THEN 58 ELSE 0 END AS b FROM {photo_px} p WHERE (row + col) % 2 = 0",
}


def metric_raster(dn: DataFrame, step: float = DEG) -> DataFrame:
    """Thermal numbers of a raster in degrees from (0, 0), scaled, on a grid of one metre a quarter step in; read twice."""
    far = dn.agg(F.max("row"), F.max("col")).first()
    rows, cols = (far[0] or 0) + 1, (far[1] or 0) + 1
    scaled = cells.scale_cells(dn, SCALE, OFFSET)
    return reproject_cells(scaled, Grid(4326, 0.0, 0.0, step, step, rows, cols), Grid(3857, 0.25, 0.25, 1.0, 1.0, rows, cols))


def metric_edges(edges: DataFrame) -> DataFrame:
    return vectors.reproject(vectors.reproject(edges, 4326, 3857, "x1", "y1"), 4326, 3857, "x2", "y2")


def prepared_parks(parks: DataFrame, names: DataFrame, min_ha: float) -> DataFrame:
    """Audit, rings, reprojection, area filter and the declared id."""
    edges = parks.withColumnRenamed("fid", "feature_id")
    good = vectors.audit(edges).where("valid").select("feature_id")
    rings = metric_edges(vectors.normalise_rings(edges.join(good, "feature_id", "left_semi")))
    large = vectors.filter_by_area(rings, min_ha).select("feature_id")
    ids = assign_feature_id(names, "park_code").select("fid", F.col("feature_id").alias("_id"))
    return rings.join(large, "feature_id", "left_semi").withColumnRenamed("feature_id", "fid").join(ids, "fid").drop("fid").withColumnRenamed("_id", "feature_id")


def park_cooling_whole(parks: DataFrame, names: DataFrame, dn: DataFrame, min_ha: float = 0.0015, interval: float = 1.0, most: float = 4.0, min_rings: int = 3) -> DataFrame:
    """Q1 in full. Parks, the rasters and the parks' cells are written once; medians hold no park or ring in one task."""
    return cooling_of(spatial.checkpointed(prepared_parks(parks, names, min_ha)), spatial.checkpointed(dn), interval, most, min_rings)


def cooling_of(zones: DataFrame, dn: DataFrame, interval: float = 1.0, most: float = 4.0, min_rings: int = 3) -> DataFrame:
    """The raster needs no crop to the parks: what follows looks at cells inside and within ``most`` alone, the cells that it would keep."""
    lst = spatial.checkpointed(metric_raster(dn))
    own = spatial.checkpointed(spatial.cells_in_zones(lst, zones))
    named = lambda df, keys: medians(df, "value", keys).withColumnRenamed("median", "lst_median")
    return cooling.park_cooling_intensity(named(spatial.distance_bands(lst, zones, interval, most, own), ["feature_id", "distance_m"]), named(own, ["feature_id"]), min_rings=min_rings)


def chain_warnings(parks: DataFrame, dn: DataFrame) -> DataFrame:
    """(step, message) of the validations that Q1 begins with."""
    audit = vectors.audit(parks.withColumnRenamed("fid", "feature_id"))
    return scores.validate_vector(audit).select(F.lit("validate_vector").alias("step"), "message").unionByName(scores.validate_raster(cells.scale_cells(dn, SCALE, OFFSET), LOW, HIGH, 5.0).select("step", "message"))


def heat_islands_whole(boundary: DataFrame, dn: DataFrame, buffer: float = 2.0, d: float = 1.5) -> DataFrame:
    """Q2 in full: reprojected, cropped to the boundary, Gi, tiers, summary."""
    city = metric_edges(vectors.normalise_rings(boundary))
    raster = spatial.checkpointed(metric_raster(spatial.checkpointed(dn)))  # crop reads it three times
    lst = spatial.checkpointed(spatial.crop(raster, city, buffer))
    return spatial.cluster_summary(spatial.classify_clusters(spatial.local_gi(lst, d)))


def _metres(t: str, id_: str) -> str:
    y = lambda v: f"6378137.0 * ln(tan(pi() / 4 + radians({v}) / 2)) AS {v}"
    return f"SELECT {id_} AS feature_id, part, ring, seq, radians(x1) * 6378137.0 AS x1, {y('y1')}, radians(x2) * 6378137.0 AS x2, {y('y2')} FROM {t}"


_RASTER = f"""dn AS (SELECT row, col, value * {SCALE} + {OFFSET} AS value FROM {{strip_dn}} t WHERE value IS NOT NULL),
pt AS (SELECT CAST(y AS INT) AS row, CAST(x AS INT) AS col, degrees(2 * atan(exp((0.75 + y)::DOUBLE / 6378137.0)) - pi() / 2) / {DEG!r} - 0.5 AS r, degrees((0.75 + x)::DOUBLE / 6378137.0) / {DEG!r} - 0.5 AS c FROM (SELECT unnest(range(max(row) + 1)) AS y FROM {{strip_dn}} u), (SELECT unnest(range(max(col) + 1)) AS x FROM {{strip_dn}} v)),
lst_m AS (SELECT row, col, sum(w * value) / sum(w) AS value FROM (SELECT pt.row, pt.col, value, (CASE dy WHEN 0 THEN 1 - (r - floor(r)) ELSE r - floor(r) END) * (CASE dx WHEN 0 THEN 1 - (c - floor(c)) ELSE c - floor(c) END) AS w
  FROM pt, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dy, dx) JOIN dn ON dn.row = floor(r) + dy AND dn.col = floor(c) + dx) GROUP BY 1, 2)"""
_PARKS = f"""park_e AS ({_metres('{strip_parks} e JOIN {strip_names} n USING (fid)', 'park_code')}),
park_m AS (SELECT * FROM park_e WHERE feature_id IN (SELECT feature_id FROM park_e GROUP BY 1 HAVING abs(sum(x1 * y2 - x2 * y1)) / 2 / 10000 >= 0.0015))"""
_OWN = inside("lst", "zones", "value").replace("{lst}", "lst_m").replace("{zones}", "park_m")
_RINGS = f"""SELECT feature_id, distance_m, median(value) AS lst_median FROM (SELECT d.feature_id, d.value, greatest(1, ceil(round(d, 9))) * 1.0::DOUBLE AS distance_m FROM ({DIST.replace('{lst}', 'lst_m').replace('{some_zones}', 'park_m')}) d
ANTI JOIN ({_OWN}) i ON i.feature_id = d.feature_id AND i.row = d.row AND i.col = d.col WHERE d <= 4) GROUP BY 1, 2"""
query("q1_park_cooling_reprojected", "strip_parks strip_names strip_dn", f"WITH {_RASTER}, {_PARKS}, " + PCI.removeprefix("WITH ").replace("LEVEL", "tv").replace("{rings}", f"({_RINGS})").replace("{interior}", f"(SELECT feature_id, median(value) AS lst_median FROM ({_OWN}) GROUP BY 1)") + "SELECT * FROM pci")(park_cooling_whole)
query("q1_warnings", "strip_parks strip_dn", f"""SELECT 'validate_vector' AS step, 'invalid features' AS message FROM {{strip_names}} s HAVING count(*) FILTER (fid % 4 = 3) > 0 UNION ALL
SELECT 'validate_raster', unnest(list_filter([CASE WHEN 100 * (count(*) - count(value)) / count(*) > 5 THEN 'too many cells without data' END, CASE WHEN min(value * {SCALE} + {OFFSET}) < {LOW} THEN 'values below the expected range' END, CASE WHEN max(value * {SCALE} + {OFFSET}) > {HIGH} THEN 'values above the expected range' END], lambda x: x IS NOT NULL)) FROM {{strip_dn}} t""")(chain_warnings)
_OFFSETS = ", ".join(f"({i}, {j})" for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0))
_GI = GI.replace("{lst} a JOIN {lst} b ON (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 2.25 AND NOT (a.row = b.row AND a.col = b.col)", f"lst_c a, (VALUES {_OFFSETS}) o(dr, dc) JOIN lst_c b ON b.row = a.row + dr AND b.col = a.col + dc")
query("q2_heat_islands_reprojected", "strip_boundary strip_dn", f"""WITH {_RASTER}, city AS ({_metres('{strip_boundary} e', 'feature_id')}),
lst_c AS (SELECT DISTINCT row, col, value FROM (SELECT row, col, value FROM ({inside('lst', 'zones', 'value').replace('{lst}', 'lst_m').replace('{zones}', 'city')}) UNION ALL SELECT row, col, value FROM ({DIST.replace('{lst}', 'lst_m').replace('{some_zones}', 'city')}) WHERE d <= 2)),
tiers AS (SELECT tier, count(*) AS n FROM (SELECT {TIER} AS tier FROM ({_GI}) WHERE z IS NOT NULL) GROUP BY tier)
SELECT category, confidence, coalesce(n, 0) AS n_cells, round(100 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 2) AS pct_valid FROM (VALUES ('hot', 99, 99), ('hot', 95, 95), ('hot', 90, 90), ('cold', 99, -99), ('cold', 95, -95), ('cold', 90, -90), ('not_significant', NULL, 0)) k(category, confidence, tier) LEFT JOIN tiers USING (tier)""")(heat_islands_whole)  # fmt: skip


def prepared_frames(photos: DataFrame, scribbles: DataFrame, scribble_px: DataFrame, palette: DataFrame, test: float = 0.2, val: float = 0.1, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(frames, labels): photographs with a scribble and their partition by scene; labelled pixels, by palette colour. Frames
    and the pixels of their scribbles, which are read more than once, are written."""
    pairs = catalog.pair_by_stem(photos, scribbles)
    frames = spatial.checkpointed(sampling.split_stratified(pairs, test, val, seed, "scene", "stem").withColumnRenamed("stem", "frame_id"))
    own = spatial.checkpointed(scribble_px.join(frames.select("frame_id", F.col("label").alias("path")), "path"))
    return frames, cells.snap_palette(own, palette).where("code <> 0").select("frame_id", "row", "col", F.col("code").alias("label"))


def prepared_labels(photos: DataFrame, scribbles: DataFrame, scribble_px: DataFrame, palette: DataFrame) -> DataFrame:
    frames, labels = prepared_frames(photos, scribbles, scribble_px, palette)
    return labels.join(frames.select("frame_id", "scene", "partition"), "frame_id").groupBy("partition", "scene", F.col("label").alias("code")).agg(F.count("*").alias("n"), F.count_distinct("frame_id").alias("frames"))


def compared_segmenters(photos: DataFrame, scribbles: DataFrame, photo_px: DataFrame, scribble_px: DataFrame, palette: DataFrame, models: tuple[str, ...] = ("rf", "logistic", "gbt"), trees: int = 5) -> DataFrame:
    """Q5 in full: each model learns from the labelled pixels of the training frames and segments the test frames whole;
    (model, accuracy, mean_iou, kappa, wins), wins the measures in which it is the first, ties to the model named first."""
    frames, labels = prepared_frames(photos, scribbles, scribble_px, palette)
    pixels = photo_px.join(frames.select(F.col("image").alias("path"), "frame_id", "partition"), "path").drop("path")
    rows = spatial.checkpointed(cells.featurize_frames(pixels, labels))
    train, test = rows.where("partition = 'train' AND label IS NOT NULL"), rows.where("partition = 'test'")
    done = [segment_pixels(test, cells.FEATURES, model=train_classifier(train, "label", cells.FEATURES, m, trees)).select("frame_id", "label", "pred", F.lit(m).alias("model")) for m in models]
    measures = ["accuracy", "mean_iou", "kappa"]
    by_model = spatial.checkpointed(scores.macro_average(scores.score_segmenters(reduce(DataFrame.unionByName, done), ["frame_id", "model"], "label", "pred"), ["model"], measures))  # read twice
    order = F.create_map(*[F.lit(x) for i, m in enumerate(models) for x in (m, i)])
    best = scores.winners(by_model.withColumn("rank", order[F.col("model")]), "model", measures).groupBy(F.col("winner").alias("model")).agg(F.array_join(F.array_sort(F.collect_list("dimension")), " ").alias("wins"))  # a row for each measure
    return by_model.join(best, "model", "left").fillna("", ["wins"])


_STEM = "replace(replace(path, '{d}/', ''), '.{e}', '')"
query("q5_prepared_labels", "photo_files scribble_files scribble_px palette", f"""WITH p AS (SELECT {_STEM.format(d='photos', e='jpg')} AS stem FROM {{photo_files}} f), l AS (SELECT DISTINCT regexp_replace(replace(path, 'labels/', ''), '\\..*', '') AS stem FROM {{scribble_files}} f),
 s AS (SELECT stem, split_part(stem, '_', 2) AS scene FROM p JOIN l USING (stem)), q AS (SELECT *, {rank('stem', 'scene')} AS k, count(*) OVER (PARTITION BY scene) AS m FROM s),
 f AS (SELECT stem, scene, CASE WHEN k < round(m * 0.2) THEN 'test' WHEN k < round(m * 0.2) + round(m * 0.1) THEN 'val' ELSE 'train' END AS partition FROM q JOIN (SELECT path, {_STEM.format(d='labels', e='png')} AS stem FROM {{scribble_files}} g WHERE path LIKE '%.png') USING (stem))
 SELECT partition, scene, CASE WHEN r = 201 THEN 3 ELSE 1 END AS code, count(*) AS n, count(DISTINCT stem) AS frames FROM f JOIN (SELECT *, {_STEM.format(d='labels', e='png')} AS stem FROM {{scribble_px}} x) USING (stem) WHERE r <> 0 GROUP BY ALL""")(prepared_labels)  # fmt: skip
query("q5_compare_segmenters", "photo_files scribble_files photo_px scribble_px palette")(compared_segmenters)


def segmented_survey(photo_px: DataFrame, labels: DataFrame, poses: DataFrame, weights: DataFrame, least: float = 0.8, trees: int = 5) -> DataFrame:
    """Q6 in full: two segmenters, the cooling index of whole frames and of their ground view by the first, the agreement
    of both and its status; coldest first."""
    feats = cells.FEATURES
    rows = spatial.checkpointed(cells.featurize_frames(photo_px, labels))
    known = rows.where("label IS NOT NULL AND label <> 0")
    first = segment_pixels(rows, feats, model=train_classifier(known, "label", feats, "rf", trees))
    both = spatial.checkpointed(apply_classifier(train_classifier(known, "label", feats, "logistic"), first.select("frame_id", "row", "col", *feats, F.col("pred").alias("a"))).select("frame_id", "row", "col", "a", F.col("pred").alias("b")))
    mask = both.select("frame_id", "row", "col", F.col("a").alias("code"))
    potential = lambda m, s: cooling.space_cooling_potential(m.select(F.col("frame_id").alias("space"), "code"), weights, {"green": [1, 2, 3]}).select("space", F.col("index").alias(s))
    ground = spatial.checkpointed(camera.rectify_to_ground(mask, poses, CAMERA, (0, 4, 0, 4), 4.0))  # read twice
    agreed = scores.disagreement_rate(both, ["frame_id"]).select(F.col("frame_id").alias("space"), "agreement")
    status = F.when(F.col("ground").isNull(), "no_ground").when(F.col("agreement") >= least, "agreed").otherwise("contested")
    cover = camera.valid_fraction(ground).select(F.col("frame_id").alias("space"), "valid_fraction")
    out = potential(mask, "whole").join(potential(ground, "ground"), "space", "left").join(cover, "space", "left").join(agreed, "space", "left")
    return out.where("whole IS NOT NULL").withColumn("status", status).orderBy("whole", "space")


def _frames_of(photo_px: DataFrame, scribble_px: DataFrame, palette: DataFrame) -> tuple[DataFrame, DataFrame]:
    number = F.regexp_extract("path", r"/(\d+)_", 1).cast("bigint")
    labels = cells.snap_palette(scribble_px, palette).where("code <> 0")
    return photo_px.withColumn("frame_id", number).drop("path"), labels.select(number.alias("frame_id"), "row", "col", F.col("code").alias("label"))


query("q6_segmented_survey", "photo_px scribble_px palette poses weights")(lambda px, s, pal, poses, w: segmented_survey(*_frames_of(px, s, pal), poses, w))
query("q6_survey_status", "photo_px scribble_px palette poses weights")(lambda px, s, pal, poses, w: scores.survey_status(segmented_survey(*_frames_of(px, s, pal), poses, w)))


def explained(rows: DataFrame, y: str, xs: list[str], controls: list[str], share: float = 0.25, seed: int = 7, n_boot: int = 0, direction: str = "both", threshold: float = 7.5) -> DataFrame:
    """Q9 from correlations on: (part, variable, metric, value) of correlations (with intervals if ``n_boot``), the chosen
    coefficients, diagnostics and the hold-out score. ``rows`` has an ``id``. Rows with a null and columns of one value are
    left out; without rows enough for all columns and three more the result is empty."""
    spark = rows.sparkSession
    columns = list(dict.fromkeys([y, *xs, *controls]))
    full = spatial.checkpointed(cells.complete_cases(rows.select("id", *columns), columns))
    g = statistics.Gram(full, columns)
    varied = [c for i, c in enumerate(columns) if g.s[i, i] > 1e-9 * max(1.0, g.n * g.mean[i] ** 2)]
    xs, controls = [x for x in xs if x in varied], [c for c in controls if c in varied]
    if y not in varied or not xs or g.n < len(columns) + 3:
        return spark.createDataFrame([], "part string, variable string, metric string, value double")
    used = statistics.vif_prune(g, statistics.stepwise(g, y, xs, direction).xs, threshold)
    free = [x for x in xs if x not in controls]
    long = lambda df, part, names: df.select(F.lit(part).alias("part"), "variable", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])).alias("m")).select("part", "variable", "m.*")
    out = [long(statistics.correlation(full, y, xs, None, n_boot, seed=seed), "correlation", ["r", "p_value"] + (["ci_low", "ci_high"] if n_boot else []))]
    if controls and free:
        out.append(long(statistics.correlation(full, y, free, controls), "partial correlation", ["partial_r", "partial_p"]))
    out.append(long(spark.createDataFrame(statistics.Fit(g, y, used).table(), statistics.SUMMARY), "regression", ["estimate", "std_error", "t_value", "p_value", "std_beta"]))
    if used:
        out.append(statistics.diagnostics(full, y, used).select(F.lit("diagnostics").alias("part"), F.lit(None).cast("string").alias("variable"), "metric", "value"))
        parts = sampling.holdout(full, share, seed)
        score = scores.score_regression(statistics.fitted(parts.where("partition = 'test'"), parts.where("partition = 'train'"), y, used), y, "pred").withColumn("variable", F.lit(None).cast("string"))
        out.append(long(score, "holdout", ["n", "r2", "rmse", "mae"]))
    return reduce(DataFrame.unionByName, out).where("value IS NOT NULL")


def explain_pci_whole(parks: DataFrame, names: DataFrame, dn: DataFrame, lc: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Q9 in full, from the whole of Q1: landscape metrics and class shares of each park against its PCI. Each of the three,
    a row for each park, is written before they are joined, so that the joins know their sizes; the rasters are written as
    all three read them."""
    dn, lc = spatial.checkpointed(dn), spatial.checkpointed(lc)
    zones = spatial.checkpointed(prepared_parks(parks, names, 0.0015))
    pci = spatial.checkpointed(cooling_of(zones, dn).where("PCI IS NOT NULL").select("feature_id", "PCI"))
    green = cells.scale_cells(dn, 1 / 5000, -9.0)
    metrics = spatial.checkpointed(spatial.landscape_metrics(vectors.geometry(zones), zones, lc, green))
    shares = spatial.checkpointed(spatial.land_cover_proportions(lc, zones, crosswalk, ["forest", "open", "built"]))
    rows = pci.join(metrics, "feature_id").join(shares, "feature_id").withColumnRenamed("feature_id", "id")
    return explained(rows, "PCI", ["PA", "LPI", "prop_forest", "prop_open"], ["PP"])


standins.SQL["strip_lc"] = "SELECT CAST(floor(l_partkey / 8) AS INT) AS row, CAST(l_orderkey % 64 AS INT) AS col, CASE min(l_suppkey) % 5 WHEN 0 THEN 10 WHEN 1 THEN 30 WHEN 2 THEN 50 WHEN 3 THEN 80 ELSE 0 END AS code FROM {lineitem} GROUP BY 1, 2"
query("q9_explain_pci_whole", "strip_parks strip_names strip_dn strip_lc crosswalk")(explain_pci_whole)
query("q9_explain_prices", "regress")(lambda df: explained(df, "y", ["x1", "x2", "x3"], ["x2"]))
