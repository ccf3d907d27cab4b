"""Queries of samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgrid.operators import sampling as op
from heatgrid.registry import query
from heatgrid.sources import standins

standins.SQL |= {
    "listed": "SELECT event_id * 3 AS id FROM {events} WHERE event_id % 5 = 0",
    "frames": "SELECT event_id AS id, user_id AS scene, event_id % 3 = 0 AS ok FROM {events}",
}
H = "md5(concat(CAST({id} AS STRING), '_7'))".replace("{id}", "ID")
R = "(row_number() OVER ({p}ORDER BY " + H + ", ID) - 1)"


def rank(id_: str = "id", part: str = "") -> str:
    return R.replace("{p}", f"PARTITION BY {part} " if part else "").replace("ID", id_)


def part(r: str, n: str) -> str:
    return f"CASE WHEN {r} < round({n} * 0.2) THEN 'test' WHEN {r} < round({n} * 0.2) + round({n} * 0.1) THEN 'val' ELSE 'train' END"


query("m1_sample_random", "samples", f"SELECT id FROM (SELECT *, {rank()} AS r FROM {{samples}} s) WHERE r < 100")(lambda s: op.sample_random(s, 100, 7).select("id"))
query("m2_sample_stratified", "samples", f"SELECT id, stratum FROM (SELECT *, {rank(part='stratum')} AS r FROM {{samples}} s) WHERE r < 40")(lambda s: op.sample_stratified(s, 40, 7, "stratum").select("id", "stratum"))
query("m3_first_n", "samples", "SELECT id, value FROM {samples} s ORDER BY id LIMIT 50")(lambda s: op.first_n(s, 50, "id").select("id", "value"))
query("m4_sample_filtered", "samples", "SELECT id FROM {samples} s WHERE value > 50 AND stratum LIKE '%e%'")(lambda s: op.sample_filtered(s, "value > 50 AND stratum LIKE '%e%'").select("id"))
query("m5_keep_ids", "samples listed", "SELECT id, value FROM {samples} s WHERE id IN (SELECT id FROM {listed} l)")(lambda s, x: op.keep_ids(s, x).select("id", "value"))
query("m5_unmatched_ids", "samples listed", "SELECT DISTINCT id FROM {listed} l WHERE id NOT IN (SELECT id FROM {samples} s)")(op.unmatched_ids)
query("m6_split_random", "samples", f"SELECT id, {part('r', 'n')} AS partition FROM (SELECT id, {rank()} AS r, count(*) OVER () AS n FROM {{samples}} s)")(lambda s: op.split_random(s, 0.2, 0.1, 7).select("id", "partition"))
query("m7_split_stratified", "samples", f"SELECT id, stratum, {part('r', 'n')} AS partition FROM (SELECT id, stratum, {rank(part='stratum')} AS r, count(*) OVER (PARTITION BY stratum) AS n FROM {{samples}} s)")(lambda s: op.split_stratified(s, 0.2, 0.1, 7, "stratum").select("id", "stratum", "partition"))
query("m8_split_grouped", "samples", f"SELECT id, grp, {part('r', 'n')} AS partition FROM {{samples}} s JOIN (SELECT grp, {rank('grp')} AS r, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM {{samples}} t)) USING (grp)")(lambda s: op.split_grouped(s, 0.2, 0.1, 7, "grp").select("id", "grp", "partition"))
query("m9_split_spatial", "points", f"""WITH b AS (SELECT id, concat(CAST(floor(x / 900) AS BIGINT)::STRING, '_', CAST(floor(y / 900) AS BIGINT)::STRING) AS block FROM {{points}} p)
SELECT id, block, {part('r', 'n')} AS partition FROM b JOIN (SELECT block, {rank('block')} AS r, count(*) OVER () AS n FROM (SELECT DISTINCT block FROM b)) USING (block)""")(lambda p: op.split_spatial(p, 0.2, 0.1, 7, 900).select("id", "block", "partition"))  # fmt: skip
_T = "SELECT id, stratum, CASE WHEN r >= n - round(n * 0.2) THEN 'test' WHEN r >= n - round(n * 0.2) - round(n * 0.1) THEN 'val' ELSE 'train' END AS partition FROM (SELECT *, row_number() OVER (ORDER BY time, id) - 1 AS r, count(*) OVER () AS n FROM {samples} s)"
query("m10_split_temporal", "samples", f"SELECT id, partition FROM ({_T})")(lambda s: op.split_temporal(s, 0.2, 0.1, "time").select("id", "partition"))
query("m10_missing_classes", "samples", f"SELECT p.partition, c.stratum FROM (SELECT DISTINCT partition FROM ({_T})) p, (SELECT DISTINCT stratum FROM {{samples}} s) c WHERE NOT EXISTS (SELECT 1 FROM ({_T}) t WHERE t.partition = p.partition AND t.stratum = c.stratum AND NOT (t.partition = 'val' AND t.stratum LIKE 'p%')) AND NOT (p.partition = 'val' AND c.stratum LIKE 'q%')")(
    lambda s: op.missing_classes(op.split_temporal(s, 0.2, 0.1, "time").where("NOT (partition = 'val' AND stratum LIKE 'p%')"), "stratum"))
query("m11_split_audit", "samples", f"SELECT partition, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS actual, 'info' AS level FROM ({_T}) GROUP BY partition")(lambda s: op.split_audit(op.split_temporal(s, 0.2, 0.1, "time"), 0.2, 0.1))
query("m12_sample_valid_cells", "lst", "SELECT row, col, value FROM (SELECT *, row_number() OVER (ORDER BY md5(concat(CAST(row * 100000 + col AS STRING), '_7')), row * 100000 + col) AS r FROM {lst} t WHERE value IS NOT NULL) WHERE r <= 200")(
    lambda lst: op.sample_random(lst.where("value IS NOT NULL").withColumn("id", F.col("row") * 100000 + F.col("col")), 200, 7).select("row", "col", "value"))
query("m13_bootstrap", "regress")(lambda df: op.bootstrap_sums(df, "y", "x1", 200, 3))
query("m14_holdout", "regress", f"SELECT id, CASE WHEN r < floor(n * 0.25) THEN 'test' ELSE 'train' END AS partition FROM (SELECT id, {rank()} AS r, count(*) OVER () AS n FROM {{regress}} t)")(lambda df: op.holdout(df, 0.25, 7).select("id", "partition"))
query("w4_quota_per_scene", "frames", "SELECT id, scene, ok FROM (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY scene ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {frames} f) WHERE b < 5")(lambda f: op.quota_per_scene(f, 5, "scene", "ok", "id"))
