"""Queries of catalogs and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgrid.operators import catalog as op
from heatgrid.operators.cells import range_warnings, scale_cells
from heatgrid.registry import query
from heatgrid.sources import standins
from heatgrid.sources.shared import new_folder

standins.SQL |= {
    "assets": "SELECT event_id AS scene, event_type || '_' || CAST(event_id % 3 AS STRING) AS asset FROM {events} UNION ALL SELECT event_id, 'red_' || CAST(event_id % 2 AS STRING) FROM {events} WHERE event_id % 4 > 0",
    "aliases": "SELECT band, asset, CAST(min(rank) AS INT) AS rank FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'thermal' WHEN 1 THEN 'nir' ELSE 'qa' END AS band, event_type || '_' || CAST(event_id % 3 AS STRING) AS asset, length(event_type) * 10 + ascii(event_type) AS rank FROM {events} UNION ALL SELECT 'red', 'red_0', 0 FROM {region} UNION ALL SELECT 'red', 'red_1', 1 FROM {region}) x GROUP BY 1, 2",
    "files": "SELECT o_orderkey AS id FROM {orders} WHERE o_orderkey % 2 = 0 UNION ALL SELECT -o_orderkey FROM {orders} WHERE o_orderkey % 5 = 0",
    "images": "SELECT '/a/img_s' || CAST(page_id % 5 AS STRING) || '_' || CAST(page_id AS STRING) || '.png' AS path FROM {pages}",
    "label_files": "SELECT '/b/img_s' || CAST(page_id % 5 AS STRING) || '_' || CAST(page_id AS STRING) || CASE WHEN page_id % 4 = 0 THEN '.jpg' WHEN page_id % 4 = 1 THEN '.tif' WHEN page_id % 4 = 2 THEN '.PNG' ELSE '.txt' END AS path FROM {pages} UNION ALL SELECT '/c/img_s' || CAST(page_id % 5 AS STRING) || '_' || CAST(page_id AS STRING) || '.tif' FROM {pages} WHERE page_id % 8 = 0",
    "stills": "SELECT event_id AS name, user_id AS scene, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS taken, CASE WHEN user_id % 3 = 0 AND event_id % 2 = 0 THEN 100 ELSE 200 END AS width, 100 AS height FROM {events}",
    "missing": "SELECT p_partkey AS step FROM {part} WHERE p_partkey IN (3, 10)",
    "bodies": "SELECT page_id AS id, url AS path, html AS content FROM {pages}",
    "typed": "SELECT DISTINCT p_brand || '!' AS name FROM {part} UNION SELECT DISTINCT lower(substring(p_name, 1, 8)) FROM {part}",
    "known": "SELECT DISTINCT p_brand AS name FROM {part} UNION SELECT DISTINCT substring(p_name, 1, 8) FROM {part}",
    "exif": "SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE '2024:03:' || CAST(10 + event_id % 18 AS STRING) || ' 12:30:' || CAST(10 + event_id % 50 AS STRING) END AS text FROM {events}",
    "own_steps": "SELECT p_partkey AS step, CASE WHEN p_partkey % 2 = 0 THEN 'b' END AS branch FROM {part}",
}
query("s5_select_scenes", "scenes", "SELECT id, cloud, platform FROM {scenes} s WHERE coalesce(cloud, 100) < 60 AND month(datetime) IN (1, 2, 6, 7) ORDER BY (platform = 'error')::INT, coalesce(cloud, 100), id LIMIT 25")(lambda s: op.select_scenes(s, 60, [1, 2, 6, 7], 25, "error").select("id", "cloud", "platform"))
query("s10_resolve_bands", "assets aliases", """SELECT s.scene, b.band, x.asset FROM (SELECT DISTINCT scene FROM {assets} a) s CROSS JOIN (SELECT DISTINCT band FROM {aliases} l) b LEFT JOIN (SELECT scene, band, arg_min(asset, rank) AS asset FROM {assets} a JOIN {aliases} l USING (asset) GROUP BY scene, band) x ON x.scene = s.scene AND x.band = b.band""")(op.resolve_bands)
query("s11_reconcile", "catalog files", "SELECT id, coalesce(available, false) AND NOT coalesce(e, false) AS available_but_missing, NOT coalesce(available, false) AND coalesce(e, false) AS file_exists_but_unavailable FROM (SELECT id, available FROM {catalog} c) FULL JOIN (SELECT id, true AS e FROM {files} f) USING (id)")(op.reconcile)
_NOW = "2025-01-15 12:00:00"
query("s12_stale", "catalog", f"SELECT id, reason IS NOT NULL AS needed, reason FROM (SELECT id, CASE WHEN fetched_at IS NULL THEN 'not_cached' WHEN policy = 'always' THEN 'always' WHEN policy = 'daily' AND age >= 1 THEN 'daily' WHEN policy = 'weekly' AND age >= 7 THEN 'weekly' WHEN age >= max_age_days THEN 'max_age' END AS reason FROM (SELECT *, floor((epoch(TIMESTAMP '{_NOW}') - epoch(fetched_at)) / 86400) AS age FROM {{catalog}} c))")(lambda c: op.stale(c, _NOW))
query("s12_stale_old_clock", "catalog", "SELECT id, reason IS NOT NULL AS needed, reason FROM (SELECT id, CASE WHEN fetched_at IS NULL THEN 'not_cached' WHEN policy = 'always' THEN 'always' WHEN policy = 'daily' AND age >= 1 THEN 'daily' WHEN policy = 'weekly' AND age >= 7 THEN 'weekly' WHEN age >= max_age_days THEN 'max_age' END AS reason FROM (SELECT *, floor((epoch(TIMESTAMP '1995-06-15 12:00:00') - epoch(fetched_at)) / 86400) AS age FROM {catalog} c))")(lambda c: op.stale(c, "1995-06-15 12:00:00"))
query("s13_select_datasets", "catalog", "SELECT id FROM {catalog} c WHERE semantic_type = 'raster' AND NOT available AND source_type <> 'manual' AND NOT needs_auth")(lambda c: op.select_datasets(c, "raster", acquirable=True, auth=False).select("id"))
query("s14_hash_inputs", "bodies", "SELECT id, md5(content) AS hash FROM {bodies} b")(lambda b: b.select("id", op.content_hash(F.col("content").cast("binary"), F.col("path"), F.length("content"), F.lit(0), "full").alias("hash")))
query("s15_pair_by_stem", "images label_files", """SELECT stem, image, label, split_part(stem, '_', 2) AS scene FROM (SELECT regexp_extract(path, '([^/]+)\\.', 1) AS stem, path AS image FROM {images} i) JOIN (
  SELECT stem, arg_min(path, rank::STRING || path) AS label FROM (SELECT regexp_extract(path, '([^/]+)\\.', 1) AS stem, path, CASE lower(regexp_extract(path, '\\.(.+)$', 1)) WHEN 'png' THEN 0 WHEN 'tif' THEN 1 WHEN 'jpg' THEN 2 END AS rank FROM {label_files} l) WHERE rank IS NOT NULL GROUP BY stem) USING (stem)""")(op.pair_by_stem)  # fmt: skip
query("s16_ingest_index", "stills", "SELECT s.*, format('{{:03d}}', row_number() OVER (PARTITION BY scene ORDER BY taken IS NULL, taken, name)) AS number, max(width) OVER (PARTITION BY scene) > min(width) OVER (PARTITION BY scene) AS mixed FROM {stills} s".replace("{{:03d}}", "{:03d}"))(op.ingest_index)
query("f_exif_time", "exif", "SELECT id, try_strptime(text, '%Y:%m:%d %H:%M:%S') AS taken FROM {exif} e")(lambda e: e.select("id", op.exif_time(F.col("text")).alias("taken")))
query("f_suggestions", "typed known", "SELECT DISTINCT a.name, b.name AS suggestion FROM {typed} a JOIN {known} b ON a.name <> b.name AND levenshtein(a.name, b.name) <= 2")(op.suggestions)
_REACH = "WITH RECURSIVE r AS (SELECT step AS missing, step FROM {missing} m UNION SELECT r.missing, e.step FROM r JOIN {lineage} e ON e.depends_on = r.step) "
query("l1_trace_impact", "lineage missing", _REACH + "SELECT * FROM r WHERE step <> missing")(op.trace_impact)
query("l2_runnable", "lineage missing", _REACH + "SELECT DISTINCT step, step IN (SELECT step FROM r) AS blocked FROM {lineage} l")(lambda e, m: op.runnable(e, op.trace_impact(e, m), m))
query("l3_warnings", "lst", "SELECT 'warning' AS level, 2 AS n")(lambda lst: op.warnings_by_level(range_warnings(scale_cells(lst, 10.0)), range_warnings(scale_cells(lst, -10.0))))
query("u3_merge_provenance", "own_steps lineage", "SELECT step, branch FROM {own_steps} o UNION ALL SELECT step, 'left' FROM {lineage} l UNION ALL SELECT step, coalesce(branch, 'right') FROM {own_steps} p")(lambda o, e: op.merge_provenance(o, left=e.select("step", F.lit(None).cast("string").alias("branch")), right=o))
query("p19_assign_feature_id", "own_steps", "SELECT CAST(step AS STRING) AS feature_id FROM {own_steps} o")(lambda o: op_assign(o, "step").select("feature_id"))


def op_assign(df, source):
    from heatgrid.operators.identity import assign_feature_id

    return assign_feature_id(df, source)


def _written(samples, kind: str):
    path = f"{new_folder(samples.sparkSession, 'samples')}.{kind}"
    op.write_table(samples, path)
    return op.read_table(samples.sparkSession, path)


_SAMPLES = "SELECT id, grp, stratum, value FROM {samples} s"
query("s3_read_csv", "samples", _SAMPLES)(lambda s: _written(s.select("id", "grp", "stratum", "value"), "csv"))
query("s3_read_parquet", "samples", _SAMPLES)(lambda s: _written(s.select("id", "grp", "stratum", "value"), "parquet"))


def _json(catalog):
    path = new_folder(catalog.sparkSession, "result")
    op.write_result_json(catalog.select("id", "policy", "available"), path)
    return catalog.sparkSession.read.schema("id bigint, policy string, available boolean").json(path)


query("s4_write_result_json", "catalog", "SELECT id, policy, available FROM {catalog} c")(_json)
