"""Queries over co-partitioned rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgrid.operators.cells import align, mask_by_class
from heatgrid.registry import query
from heatgrid.sources.bucketed import write_bucketed


def bucketed_classes(lst, lc):
    """J6, A5: both rasters bucketed, aligned in place; only counts and sums of the classes are exchanged."""
    return align(write_bucketed(lst), write_bucketed(lc)).groupBy("code").agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


query("j6_bucketed_classes", "lst_wide lc_wide", "SELECT code, count(value) AS n, round(avg(value), 4) AS mean FROM {lst_wide} t JOIN (SELECT row AS r, col AS c, code FROM {lc_wide} u) ON r = row AND c = col GROUP BY 1")(bucketed_classes)
query("j6_bucketed_mask", "lst_wide lc_wide", "SELECT row, col, value FROM {lst_wide} t JOIN (SELECT row AS r, col AS c, code FROM {lc_wide} u) ON r = row AND c = col WHERE code NOT IN (10, 30)")(
    lambda lst, lc: mask_by_class(write_bucketed(lst), write_bucketed(lc), [10, 30]).where("value IS NOT NULL").select("row", "col", "value"))
