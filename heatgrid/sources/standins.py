"""Inputs of the registered queries, derived from the given tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels", "conversations")

SQL = {
    "lst": "SELECT CAST(l_partkey % 64 AS INT) AS row, CAST(l_orderkey % 64 AS INT) AS col, sum(l_quantity) / count(*) AS value FROM {lineitem} GROUP BY 1, 2",
    "lc": "SELECT CAST(l_partkey % 64 AS INT) AS row, CAST(l_orderkey % 64 AS INT) AS col, CASE min(l_suppkey) % 5 WHEN 0 THEN 10 WHEN 1 THEN 30 WHEN 2 THEN 50 WHEN 3 THEN 80 ELSE 0 END AS code FROM {lineitem} GROUP BY 1, 2",
    "crosswalk": "SELECT * FROM (VALUES (10, 'forest'), (30, 'open'), (50, 'built')) AS t(code, target)",
    "squares": "SELECT CAST(n_nationkey AS INT) AS k, CAST((n_nationkey % 5) * 12 AS DOUBLE) AS x0, CAST(floor(n_nationkey / 5) * 12 AS DOUBLE) AS y0 FROM {nation}",
    "rings": "SELECT CAST(c_nationkey AS STRING) AS feature_id, CAST(30 * (1 + c_custkey % 10) AS DOUBLE) AS distance_m, median(c_acctbal) AS lst_median FROM {customer} WHERE c_custkey % 10 < 1 + c_nationkey % 5 GROUP BY 1, 2",
    "interior": "SELECT CAST(s_nationkey AS STRING) AS feature_id, median(s_acctbal) AS lst_median FROM {supplier} WHERE s_suppkey % 25 <> 7 AND s_nationkey % 6 <> 0 GROUP BY 1",
    "regress": "SELECT p_partkey AS id, p_retailprice AS y, CAST(p_size AS DOUBLE) AS x1, CAST(coalesce(l.n, 0) AS DOUBLE) AS x2, l.q AS x3 FROM {part} LEFT JOIN (SELECT l_partkey, count(*) AS n, sum(l_quantity) / count(*) AS q FROM {lineitem} GROUP BY 1) l ON l.l_partkey = p_partkey",
    "pred_truth": "SELECT o_orderkey AS id, o_totalprice AS truth, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS pred FROM {orders}",
    "mask_pair": "SELECT l_suppkey AS frame, l_orderkey AS ord, l_linenumber AS line, CAST(l_partkey % 8 AS INT) AS truth, CAST((l_partkey + l_linenumber % 2) % 8 AS INT) AS a, CAST(l_orderkey % 8 AS INT) AS b FROM {lineitem}",
    "composition": "SELECT space, cls, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY space) AS DOUBLE) AS fraction FROM (SELECT c_nationkey AS space, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'canopy' WHEN 'BUILDING' THEN 'grass' WHEN 'FURNITURE' THEN 'impervious' WHEN 'HOUSEHOLD' THEN 'water' ELSE 'soil' END AS cls, count(*) AS n FROM {customer} GROUP BY 1, 2) t",
    "class_lst": "SELECT * FROM (VALUES ('canopy', 27.5), ('grass', 30.13), ('impervious', 38.2), ('soil', 36.29)) AS t(cls, lst)",
    "scenes": "SELECT event_id AS id, CASE WHEN value / 5 > 90 THEN NULL ELSE value / 5 END AS cloud, ts AS datetime, event_type AS platform, user_id FROM {events}",
    "samples": "SELECT event_id AS id, ts AS time, user_id AS grp, event_type AS stratum, value FROM {events}",
    "points": "SELECT c_custkey AS id, c_acctbal AS x, CAST(c_custkey AS DOUBLE) AS y, c_nationkey AS stratum FROM {customer}",
    "pixels": "SELECT l_suppkey AS frame_id, l_orderkey AS ord, l_linenumber AS line, CAST(l_partkey % 256 AS INT) AS r, CAST(l_suppkey % 256 AS INT) AS g, CAST(l_orderkey % 256 AS INT) AS b FROM {lineitem}",
    "palette": "SELECT * FROM (VALUES (0, 100, 0, 1), (120, 200, 80, 2), (200, 60, 60, 3), (60, 60, 220, 4)) AS t(pr, pg, pb, code)",
    "lineage": "SELECT p_partkey AS step, CAST(floor(p_partkey / 2) AS BIGINT) AS depends_on FROM {part} WHERE p_partkey > 1",
    "catalog": "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'daily' WHEN 'F' THEN 'weekly' ELSE 'always' END AS policy, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS fetched_at, CAST(o_orderkey % 40 AS INT) AS max_age_days, o_orderkey % 3 = 0 AS available, CASE o_orderkey % 4 WHEN 0 THEN 'vector' WHEN 1 THEN 'raster' WHEN 2 THEN 'tabular' ELSE 'image' END AS semantic_type, CASE o_orderkey % 5 WHEN 0 THEN 'manual' WHEN 1 THEN 'url' ELSE 'stac' END AS source_type, o_orderkey % 11 = 0 AS needs_auth FROM {orders}",
}

#: stand-ins that Spark says otherwise: its casts to whole numbers cut, DuckDB's round to the nearest, halves to the even one
SPARK: dict[str, str] = {}


def fill(sql: str, name, own: dict[str, str] | None = None) -> str:
    """``sql`` with each {table} and each {stand-in} as a parenthesised query; ``own``: stand-ins to use in place of those in SQL."""
    return re.sub(r"\{(\w+)\}", lambda m: name(m[1]) if m[1] in TABLES else f"({fill((own or {}).get(m[1], SQL[m[1]]), name, own)})", sql)


def duck(sql: str) -> str:
    """For DuckDB, where the tables are views."""
    return fill(sql, lambda t: t)


def spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(fill(sql, lambda t: f"parquet.`{sf_dir}/{t}.parquet`", SPARK))


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark_sql(spark, sf_dir, SPARK.get(name, SQL[name]))
