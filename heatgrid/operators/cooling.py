"""Cooling of features and classes: park cooling intensity, differentials, indices and predicted temperatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from heatgrid.operators.checks import require_columns
from heatgrid.functions.order import medians


def park_cooling_intensity(rings: DataFrame, interior: DataFrame, method: str = "TPM-M", min_rings: int = 2, lst_col: str = "lst_median") -> DataFrame:
    """PCI of each feature from its ring temperatures and its own.

    Rings count outwards from 1, also those without data. The turning point is the first ring j >= ``min_rings`` that is
    warmer than the next, both with data: TPM-M takes its temperature less the feature's, TPM-A the mean up to it less
    that. Without one the outermost ring with data stands in (always as TPM-M). One window pass and one aggregate.
    """
    require_columns(rings, "feature_id", "distance_m", lst_col)
    require_columns(interior, "feature_id", lst_col)
    w = W.partitionBy("feature_id").orderBy("distance_m")
    v = F.col(lst_col)
    numbered = rings.select("feature_id", "distance_m", v.alias("v"), F.row_number().over(w).alias("j"), F.lead(lst_col).over(w).alias("next"))
    own = interior.groupBy("feature_id").agg(F.first(lst_col).alias("park"))
    turn = F.when((F.col("v") > F.col("next")) & (F.col("j") >= min_rings), F.col("j"))
    ring = numbered.withColumn("turn", F.min(turn).over(W.partitionBy("feature_id")))
    per = ring.groupBy("feature_id").agg(
        F.count("v").cast("int").alias("n_rings"), F.first("turn").alias("turn"),
        F.max(F.when(F.col("j") == F.col("turn"), F.struct("v", "distance_m"))).alias("at"), F.avg(F.when(F.col("j") <= F.col("turn"), F.col("v"))).alias("mean"),
        F.max_by(F.struct("v", "distance_m"), F.when(F.col("v").isNotNull(), F.col("j"))).alias("outer"))
    out = per.join(own, "feature_id", "left")
    status = F.when(F.col("n_rings") < min_rings, "insufficient_rings").when(F.col("park").isNull(), "no_interior_lst").when(F.col("turn").isNull(), "no_turning_point_found").otherwise("success")
    out = out.withColumn("status", status)
    some, none = F.col("status") == "success", F.col("status") == "no_turning_point_found"
    level = F.col("at.v") if method == "TPM-M" else F.col("mean")
    pick = lambda good, other: F.when(some, good).when(none, other)
    return out.select("feature_id", F.round(pick(level, F.col("outer.v")) - F.col("park"), 4).alias("PCI"), pick(F.col("at.distance_m"), F.col("outer.distance_m")).alias("turning_point_m"),
                      F.round(F.col("park"), 4).alias("lst_park"), F.round(pick(F.col("at.v"), F.col("outer.v")), 4).alias("lst_turning_point"), "n_rings", "status")


def pci_quality(pci: DataFrame) -> DataFrame:
    negative = F.count_if(F.col("PCI") < 0)
    kinds = [F.count_if(F.col("status") == s).alias(s) for s in ("success", "no_turning_point_found", "insufficient_rings", "no_interior_lst")]
    return pci.agg(*kinds, negative.alias("n_negative"), F.round(100 * negative / F.count("PCI"), 2).alias("pct_negative"), F.min("PCI").alias("least"), F.max("PCI").alias("most"), F.round(F.avg("PCI"), 4).alias("mean")).join(medians(pci, "PCI", []).select(F.round("median", 4).alias("median")), how="left")  # one row each


def class_statistics(cells: DataFrame) -> DataFrame:
    """n, mean, median and population deviation of ``value`` by ``code``."""
    out = cells.groupBy("code").agg(F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("mean"), F.round(F.stddev_pop("value"), 3).alias("std"))
    middle = medians(cells, "value", ["code"]).select(F.col("code").alias("_code"), F.round("median", 3).alias("median"))  # a row for each class
    return out.join(middle, F.col("code").eqNullSafe(F.col("_code")), "left").select("code", "n", "mean", "median", "std")


def cooling_differential(cells: DataFrame, forest: list[int], open_: list[int], tendency: str = "median", min_pixels: int = 20) -> DataFrame:
    """One row: forest and open groups of (value, code) cells and open less forest."""
    pick = lambda codes: F.when(F.col("code").isin(*codes), F.col("value"))
    aggs: list[Column] = []
    for name, codes in (("forest", forest), ("open", open_)):
        aggs += [F.count(pick(codes)).alias(f"{name}_n"), F.avg(pick(codes)).alias(f"{name}_mean"), F.stddev_pop(pick(codes)).alias(f"{name}_std")]
    group = F.filter(F.array(*[F.when(F.col("code").isin(*codes), F.lit(name)) for name, codes in (("forest", forest), ("open", open_))]), lambda g: g.isNotNull())
    middle = medians(cells.select("value", F.explode(group).alias("_group")), "value", ["_group"])
    both = middle.agg(*[F.max(F.when(F.col("_group") == g, F.col("median"))).alias(f"{g}_median") for g in ("forest", "open")])
    one = cells.agg(*aggs).crossJoin(both)  # one row each
    rounded = [F.col(f"{n}_n") for n in ("forest", "open")] + [F.round(f"{n}_{s}", 3).alias(f"{n}_{s}") for n in ("forest", "open") for s in ("mean", "median", "std")]
    diff = {s: F.round(F.col(f"open_{s}") - F.col(f"forest_{s}"), 3) for s in ("mean", "median")}
    return one.select(*rounded, diff["mean"].alias("diff_mean"), diff["median"].alias("diff_median"), diff[tendency].alias("differential"), (F.least("forest_n", "open_n") < min_pixels).alias("few_pixels"))


def class_distribution(cells: DataFrame) -> DataFrame:
    n = cells.where("code > 0").groupBy("code").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy()), 2))  # a row for each class


def space_cooling_potential(masks: DataFrame, weights: DataFrame, groups: dict[str, list[int]], nodata: int = 0) -> DataFrame:
    """Index, shares by group and dominant class of each space (space, code); ``weights``: (code, weight)."""
    n = masks.where(F.col("code") != nodata).groupBy("space", "code").agg(F.count("*").alias("n"))
    share = n.withColumn("f", F.round(F.col("n") / F.sum("n").over(W.partitionBy("space")), 5)).join(weights, "code")
    return share.groupBy("space").agg(F.round(F.sum(F.col("weight") * F.col("f")), 4).alias("index"), *[F.round(F.coalesce(F.sum(F.when(F.col("code").isin(*codes), F.col("f"))), F.lit(0.0)), 5).alias(g) for g, codes in groups.items()], F.max_by("code", F.struct("f", -F.col("code"))).alias("dominant"))


def counterfactual_cooling(composition: DataFrame, weights: dict[str, float], transforms: list[tuple[str, str, float]]) -> DataFrame:
    """Index before and after moving shares between classes in turn; composition: (space, cls, fraction).

    A move takes clip(share, 0, 1) of its source's fraction; one from an absent class or to one without a weight is skipped.
    """
    made = composition.groupBy("space").agg(F.map_from_entries(F.collect_list(F.struct("cls", F.round("fraction", 5)))).alias("m"))
    w = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    score = lambda m: F.aggregate(F.map_entries(m), F.lit(0.0), lambda a, e: a + e["value"] * F.coalesce(F.element_at(w, e["key"]), F.lit(0.0)))
    out = made.withColumn("after", F.col("m"))
    for source, target, share in transforms:
        if target not in weights:
            continue
        have = F.coalesce(F.element_at("after", source), F.lit(0.0))
        part = F.round(have * min(1.0, max(0.0, share)), 5)
        rest = F.map_filter("after", lambda k, _: ~k.isin(source, target))  # noqa: B023  read at once
        moved = F.map_concat(rest, F.create_map(F.lit(source), F.round(have - part, 5), F.lit(target), F.round(F.coalesce(F.element_at("after", target), F.lit(0.0)) + part, 5)))
        out = out.withColumn("after", F.when(F.map_contains_key("after", source), moved).otherwise(F.col("after")))
    return out.select("space", F.round(score(F.col("m")), 4).alias("index_before"), F.round(score(F.col("after")), 4).alias("index_after")).withColumn("delta", F.round(F.col("index_after") - F.col("index_before"), 4))


def counterfactual_from_tables(composition: DataFrame, weights: DataFrame, moves: DataFrame) -> DataFrame:
    """``counterfactual_cooling`` with weights (cls, weight) and moves (ord, source, target, share) as data; moves with a
    ``space`` are each space's own, others are those of all. Fractions of repeated classes add up; the largest of repeated
    weights counts; a null share moves nothing; a space without moves keeps its index. ``weights`` has a row for each class."""
    require_columns(composition, "space", "cls", "fraction")
    require_columns(weights, "cls", "weight")
    require_columns(moves, "ord", "source", "target", "share")
    entries = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    known = weights.where("cls IS NOT NULL").groupBy("cls").agg(F.max("weight").cast("double").alias("weight")).agg(entries("cls", "weight").alias("w"))
    shares = composition.where("cls IS NOT NULL").groupBy("space", "cls").agg(F.round(F.sum("fraction"), 5).alias("f")).groupBy("space").agg(entries("cls", "f").alias("m"))
    steps = moves.select(*[c for c in ("space",) if c in moves.columns], F.struct("ord", "source", "target", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("share").cast("double"), F.lit(0.0)))).alias("share")).alias("t"))
    listed = F.array_sort(F.collect_list("t")).alias("moves")
    spaces = shares.crossJoin(known)  # one row
    spaces = spaces.join(steps.groupBy("space").agg(listed), "space", "left") if "space" in moves.columns else spaces.crossJoin(steps.agg(listed))  # one row

    def move(m: Column, t: Column) -> Column:
        part = F.round(F.coalesce(F.element_at(m, t["source"]), F.lit(0.0)) * t["share"], 5)
        moved = F.transform_values(m, lambda k, v: F.when(k == t["source"], F.round(v - part, 5)).when(k == t["target"], F.round(v + part, 5)).otherwise(v))
        return F.when(F.map_contains_key("w", t["target"]) & (t["source"] != t["target"]), moved).otherwise(m)

    score = lambda m: F.aggregate(F.map_entries(m), F.lit(0.0), lambda a, e: a + e["value"] * F.coalesce(F.element_at("w", e["key"]), F.lit(0.0)))
    absent = F.map_filter(F.transform_values("w", lambda k, v: F.lit(0.0)), lambda k, v: ~F.map_contains_key("m", k))
    all_ = spaces.withColumn("before", F.map_concat("m", absent))
    none = F.array().cast(all_.schema["moves"].dataType)
    after = F.aggregate(F.coalesce("moves", none), F.col("before"), move)
    out = all_.select("space", F.round(score(F.col("before")), 4).alias("index_before"), F.round(score(after), 4).alias("index_after"))
    return out.withColumn("delta", F.round(F.col("index_after") - F.col("index_before"), 4))


def predicted_lst(composition: DataFrame, class_lst: DataFrame, mode: str = "measured", grass: str = "grass", soil: str = "soil") -> DataFrame:
    """Mean class temperature by fraction; soil as ``measured``, ``excluded`` or ``organic`` (as grass); null if a class has none."""
    c = composition.where("fraction > 0")
    if mode == "excluded":
        c = c.where(F.col("cls") != soil)
    if mode == "organic":
        c = c.withColumn("cls", F.when(F.col("cls") == soil, grass).otherwise(F.col("cls")))
    joined = c.join(class_lst, "cls", "left")
    value = F.sum(F.col("fraction") * F.col("lst")) / F.sum("fraction")
    return joined.groupBy("space").agg(F.round(F.when(~F.bool_or(F.col("lst").isNull()), value), 3).alias("lst"))


def scene_rollup(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.round(F.avg(value), 3).alias("mean"), F.count(value).alias("n"))


def green_pivot(rows: DataFrame, by: str, column: str, values: list, value: str) -> DataFrame:
    return rows.groupBy(by).pivot(column, values).agg(F.round(F.avg(value), 3))


def satellite_fraction(cells: DataFrame, codes: list[int]) -> DataFrame:
    return cells.agg(F.round(F.count_if(F.col("code").isin(*codes)) / F.count("*"), 5).alias("fraction"))
