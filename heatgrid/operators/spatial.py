"""Joins of cells with zones and with each other, as equi-joins on rows, buckets or offsets; no nested loops over data.

A cell (row, col) of size 1 has its centre at (col + 0.5, row + 0.5).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from heatgrid.functions.order import medians
from heatgrid.operators.coverage import UNIT, covered_cells
from heatgrid.sources.shared import new_folder

#: cells along a side of the tiles of disc sums
TILE = 256


def zone_spans(edges: DataFrame) -> DataFrame:
    """(feature_id, row, from, to): columns whose centres lie inside on each row.

    Each edge gives its crossing with the centre line of every row that it spans; sorted crossings pair up.
    """
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.ceil(lo - 0.5), F.ceil(hi - 0.5) - 1
    rows = edges.where("y1 <> y2").where(first <= last).withColumn("row", F.explode(F.sequence(first, last)))
    y = F.col("row") + 0.5
    x = F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    xs = rows.groupBy("feature_id", "row").agg(F.array_sort(F.collect_list(x)).alias("xs"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)), lambda i: F.struct(F.ceil(F.get("xs", i) - 0.5).alias("from"), (F.ceil(F.get("xs", i + 1) - 0.5) - 1).alias("to")))
    return xs.where(F.size("xs") >= 2).select("feature_id", "row", F.explode(pairs).alias("p")).select("feature_id", "row", "p.from", "p.to").where("from <= to")


def cells_in_zones(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Cells with the ``feature_id`` of each zone that their centre lies in, and ``weight`` 1."""
    at = zone_spans(edges).select("feature_id", F.col("row").cast("int").alias("row"), F.explode(F.sequence(F.col("from").cast("int"), F.col("to").cast("int"))).alias("col"), F.lit(1).cast("bigint").alias("weight"))
    return at.join(cells, ["row", "col"])


def points_in_polygons(points: DataFrame, edges: DataFrame, bucket: float = 4.0, block: int = 256) -> DataFrame:
    """(id, feature_id) of points (id, x, y) inside polygons, by the parity of crossings to the right, found in buckets of y.

    In each bucket a feature's edges are blocks of at most ``block``; a point counts its crossings of a block at once, and only
    odd counts are summed, so no task holds a row for each crossing. Points are dealt by id, by which they are also summed."""
    p = points.repartition("id").withColumn("_b", F.floor(F.col("y") / bucket))
    e = edges.where("y1 <> y2").withColumn("_b", F.explode(F.sequence(F.floor(F.least("y1", "y2") / bucket), F.floor(F.greatest("y1", "y2") / bucket))))
    part = F.floor((F.row_number().over(W.partitionBy("_b", "feature_id").orderBy("y1", "x1")) - 1) / block)
    blocks = e.withColumn("_k", part).groupBy("_b", "feature_id", "_k").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_e"))
    crosses = lambda e: ((e["y1"] <= F.col("y")) != (e["y2"] <= F.col("y"))) & (F.col("x") < e["x1"] + (F.col("y") - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"]))
    hits = p.join(blocks, "_b").where(F.size(F.filter("_e", crosses)) % 2 == 1)
    return hits.groupBy("id", "feature_id").agg(F.count("*").alias("n")).where("n % 2 = 1").select("id", "feature_id")


def edge_buckets(edges: DataFrame, most: float) -> DataFrame:
    """Edges with each square bucket (_bx, _by) of side ``most`` that may hold points within ``most`` of them. In each band of
    buckets only the part of the edge that comes near it counts, so a slanted edge costs its length and not its bounding box."""
    e = edges.withColumn("_by", F.explode(F.sequence(F.floor(F.least("y1", "y2") / most) - 1, F.floor(F.greatest("y1", "y2") / most) + 1)))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    at = lambda y: F.col("x1") + dx * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(y - F.col("y1"), dy)))
    a, b = at((F.col("_by") - 1) * most), at((F.col("_by") + 2) * most)
    left, right = F.when(dy == 0, F.least("x1", "x2")).otherwise(F.least(a, b)), F.when(dy == 0, F.greatest("x1", "x2")).otherwise(F.greatest(a, b))
    return e.withColumn("_bx", F.explode(F.sequence(F.floor(left / most) - 1, F.floor(right / most) + 1)))


def _near_edges(cells: DataFrame, edges: DataFrame, most: float) -> DataFrame:
    """Cells with each edge whose distance ``d`` from their centre is at most ``most``."""
    x, y = F.col("col") + 0.5, F.col("row") + 0.5
    c = cells.withColumn("_bx", F.floor(x / most)).withColumn("_by", F.floor(y / most))
    e = edge_buckets(edges, most)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - F.col("x1")) * dx + (y - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))))
    d = F.hypot(x - (F.col("x1") + t * dx), y - (F.col("y1") + t * dy))
    return c.join(e, ["_bx", "_by"]).withColumn("d", d).where(F.col("d") <= most)


def edge_distances(cells: DataFrame, edges: DataFrame, most: float) -> DataFrame:
    """(feature_id, row, col, value, d): least distance, at most ``most``, of cell centres to a feature's outline."""
    return _near_edges(cells, edges, most).groupBy("feature_id", "row", "col").agg(F.min("d").alias("d"), F.first("value").alias("value"))


def distance_bands(cells: DataFrame, edges: DataFrame, interval: float, most: float, inside: DataFrame | None = None) -> DataFrame:
    """Cells outside each feature with ``distance_m``, the outer edge of the ring (distance - interval, distance] they lie in.
    ``inside``: ``cells_in_zones`` of the same, where it is known."""
    inside = cells_in_zones(cells, edges) if inside is None else inside
    outside = edge_distances(cells, edges, most).join(inside.select("feature_id", "row", "col"), ["feature_id", "row", "col"], "left_anti")
    ring = F.greatest(F.lit(1), F.ceil(F.round(F.col("d") / interval, 9))) * F.lit(float(interval))
    return outside.withColumn("distance_m", ring)


def crop(cells: DataFrame, boundary: DataFrame, buffer: float) -> DataFrame:
    """Cells inside the boundary or within ``buffer`` of it."""
    inside = cells_in_zones(cells, boundary).select("row", "col")
    near = _near_edges(cells, boundary, buffer).select("row", "col")
    return cells.join(inside.unionByName(near).distinct(), ["row", "col"], "left_semi")


def neighbours(cells: DataFrame, d: float) -> DataFrame:
    """(row, col, value, other): all pairs of cells with 0 < distance <= d, by an equi-join on shifted cells. Size estimates
    don't count the copies that explode makes, so joins with shifted cells name the sort-merge join, lest they are broadcast."""
    r = int(d)
    shifts = [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if 0 < a * a + b * b <= d * d]
    moved = cells.select("row", "col", "value", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in shifts])).alias("s"))
    moved = moved.select((F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"), F.col("value").alias("other"))
    return cells.select("row", "col", "value").join(moved.hint("merge"), ["row", "col"])


def disc_sums(cells: DataFrame, d: float) -> DataFrame:
    """(row, col, value, w, l): number and sum of the other cells within ``d`` of each one, where there are any.

    Square tiles and the cells within ``d`` of them are groups, so a cell is shuffled little more than once, however many
    cells the disc holds, and no group is larger than a tile. In a tile, a disc is 2 d + 1 chords, one for each row, and a
    chord is the difference of two running sums over its cells in order. Values are taken less their mean, so that
    differences keep their digits.
    """
    r = int(d)
    side = max(TILE, 4 * r)
    width = side + 4 * r + 2
    chords = [(k, int(math.sqrt(d * d - k * k) + 1e-9)) for k in range(-r, r + 1)]
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - r) / side), F.floor((F.col(c) + r) / side)))
    base = cells.select("row", "col", "value", F.col("value").cast("double").alias("_v"))
    near = base.withColumn("_tr", tiles("row")).withColumn("_tc", tiles("col"))

    def sums(table: pa.Table) -> pa.Table:
        row, col, v, tr, tc = (table[c].to_numpy() for c in ("row", "col", "_v", "_tr", "_tc"))
        own = np.flatnonzero((row // side == tr) & (col // side == tc))
        at = (row.astype(np.int64) - row.min()) * width + (col - col.min() + r + 1)
        order = np.argsort(at, kind="stable")
        mean = v.mean()
        places, upto = at[order], np.r_[0.0, np.cumsum((v - mean)[order])]
        own = own[np.argsort(at[own], kind="stable")]
        n, total = np.full(len(own), -1), mean - v[own]
        for k, h in chords:
            a = np.searchsorted(places, at[own] + (k * width - h), "left")
            b = np.searchsorted(places, at[own] + (k * width + h), "right")
            n += b - a
            total += upto[b] - upto[a]
        some = n > 0
        out = table.select(["row", "col", "value"]).take(pa.array(own[some]))
        return out.append_column("w", pa.array(n[some].astype(float))).append_column("l", pa.array(total[some] + n[some] * mean))

    types = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    return near.groupBy("_tr", "_tc").applyInArrow(sums, f"row {types['row']}, col {types['col']}, value {types['value']}, w double, l double")


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("row", "col").orderBy("d2", "n_row", "n_col"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def knn_within(cells: DataFrame, k: int = 8, reach: int = 2) -> DataFrame:
    """The k nearest cells of each one within ``reach`` (ties by row and column): (row, col, n_row, n_col, d2)."""
    shifts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if a or b])
    moved = cells.select(F.col("row").alias("n_row"), F.col("col").alias("n_col"), F.explode(shifts).alias("s"))
    pairs = cells.select("row", "col").join(moved.select("n_row", "n_col", (F.col("n_row") - F.col("s.a")).alias("row"), (F.col("n_col") - F.col("s.b")).alias("col"), (F.col("s.a") * F.col("s.a") + F.col("s.b") * F.col("s.b")).alias("d2")).hint("merge"), ["row", "col"])
    return _nearest(pairs, k)


def knn(cells: DataFrame, k: int = 8, reach: int = 2) -> DataFrame:
    """The k nearest cells of each one however far they lie, or all others if fewer: columns and ties as in ``knn_within``.

    Cells whose k neighbours aren't sure within ``reach`` look again within twice that, by buckets of that size, until none is left.
    """
    at = cells.select("row", "col")
    ends = at.agg(*[f(c).alias(n) for f, c, n in ((F.min, "row", "r0"), (F.max, "row", "r1"), (F.min, "col", "c0"), (F.max, "col", "c1"))]).first()
    span = 0 if ends["r0"] is None else max(ends["r1"] - ends["r0"], ends["c1"] - ends["c0"])
    near, left, parts = knn_within(cells, k, reach), at, []
    while reach < span:
        near = checkpointed(near)
        sure = near.groupBy("row", "col").agg(F.count("*").alias("n"), F.max("d2").alias("far")).where((F.col("n") >= k) & (F.col("far") < (reach + 1) ** 2)).select("row", "col")
        parts.append(near.join(sure, ["row", "col"], "left_semi"))
        left = checkpointed(left.join(sure, ["row", "col"], "left_anti"))
        if left.isEmpty():
            near = near.limit(0)
            break
        reach *= 2
        by = lambda c: F.floor(F.col(c) / reach).cast("bigint")  # noqa: B023, E731
        around = lambda c: F.explode(F.sequence(by(c) - 1, by(c) + 1))  # noqa: B023, E731
        asks = left.withColumn("_br", around("row")).withColumn("_bc", around("col"))
        others = at.select(F.col("row").alias("n_row"), F.col("col").alias("n_col"), by("row").alias("_br"), by("col").alias("_bc"))
        dr, dc = F.col("row") - F.col("n_row"), F.col("col") - F.col("n_col")
        near = _nearest(asks.join(others, ["_br", "_bc"]).where((dr != 0) | (dc != 0)).select("row", "col", "n_row", "n_col", (dr * dr + dc * dc).alias("d2")), k)
    for part in parts:
        near = near.unionByName(part)
    return near


def local_gi(cells: DataFrame, d: float = 1.5, include_self: bool = False, queen: bool = False) -> DataFrame:
    """(row, col, value, z): the Getis-Ord statistic with binary weights; cells without neighbours go before the totals."""
    valid = cells.where("value IS NOT NULL")
    if queen:
        pairs = knn(valid).join(valid.select(F.col("row").alias("n_row"), F.col("col").alias("n_col"), F.col("value").alias("other")), ["n_row", "n_col"]).join(valid, ["row", "col"])
        local = pairs.groupBy("row", "col").agg(F.first("value").alias("value"), F.count("*").cast("double").alias("w"), F.sum("other").alias("l"))
    else:
        local = disc_sums(valid, d)
    local = checkpointed(local)  # read twice
    total = local.agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    n, s, q, w, x = (F.col(c) for c in ("n", "s", "q", "w", "value"))
    if include_self:
        mean = s / n
        var, weight, each = q / n - mean * mean, w + 1, F.col("l") + x
        spread = var * (n * weight - weight * weight) / (n - 1)
    else:
        mean = (s - x) / (n - 1)
        var, weight, each = (q - x * x) / (n - 1) - mean * mean, w, F.col("l")
        spread = var * ((n - 1) * weight - weight * weight) / (n - 2)
    return local.crossJoin(F.broadcast(total)).select("row", "col", "value", F.when(spread > 0, (each - weight * mean) / F.sqrt(spread)).alias("z"))


TIERS = ((99, 2.5758293), (95, 1.9599640), (90, 1.6448536))


def classify_clusters(z: DataFrame, levels: tuple[int, ...] = (99, 95, 90), mode: str = "tiers") -> DataFrame:
    """``tier``: signed confidence of the highest level reached, 0 if none; ``binary`` uses 95 alone."""
    used = [(c, v) for c, v in TIERS if c in ((95,) if mode == "binary" else levels)]
    tier = F.lit(0)
    for c, v in reversed(used):
        tier = F.when(F.col("z") >= v, c).when(F.col("z") <= -v, -c).otherwise(tier)
    return z.withColumn("tier", tier)


def cluster_summary(tiers: DataFrame, levels: tuple[int, ...] = (99, 95, 90)) -> DataFrame:
    """Cells and per cent of each tier, also those without cells."""
    spark = tiers.sparkSession
    names = [("hot", c, c) for c in levels] + [("cold", c, -c) for c in levels] + [("not_significant", None, 0)]
    kinds = spark.createDataFrame(names, "category string, confidence int, tier int")
    counts = tiers.where("z IS NOT NULL").groupBy("tier").agg(F.count("*").alias("n"))
    out = kinds.join(counts, "tier", "left").withColumn("n_cells", F.coalesce("n", F.lit(0)))
    return out.select("category", "confidence", "n_cells", F.round(100 * F.col("n_cells") / F.sum("n_cells").over(W.partitionBy()), 2).alias("pct_valid"))  # a row for each tier


def zonal_statistics(cells: DataFrame, edges: DataFrame, zones: DataFrame | None = None, value: str = "value", prefix: str = "", exact: bool = False) -> DataFrame:
    """Mean, median, least, most, sum, count, deviation, variance and majority of each zone; zones without cells get nulls.

    Cells count by their centre, with sample deviations, or ``exact``: by the share that the zone covers, with deviations of
    the weighted whole; ``count`` is then the sum of shares."""
    v, w, unit = F.col(value), F.col("units") if exact else F.lit(1), UNIT if exact else 1
    inside = (covered_cells(cells, edges) if exact else cells_in_zones(cells, edges)).where(v.isNotNull() & F.col("feature_id").isNotNull())
    times = inside.groupBy("feature_id", value).agg(F.sum(w).alias("_w"))  # the only pass over the cells; all below shares its shuffle
    n, total, square = F.sum("_w"), F.sum(v * F.col("_w")), F.sum(v * v * F.col("_w"))
    var = F.greatest(F.lit(0.0), (square - total * total / n) / (n if exact else F.when(n > 1, n - 1)))
    var = F.when(n > (0 if exact else 1), var)
    out = times.groupBy("feature_id").agg((total / n).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), (total / unit).alias("sum"), (n / unit if exact else n).alias("count"), F.sqrt(var).alias("stdev"), var.alias("variance"), F.max_by(value, F.struct("_w", -v)).alias("majority"))
    out = out.join(medians(times, value, ["feature_id"], "_w"), "feature_id")
    ids = (zones if zones is not None else edges).select("feature_id").distinct()
    out = ids.join(out, "feature_id", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return out.select("feature_id", *[F.col(c).alias(prefix + c) for c in out.columns if c != "feature_id"])


def land_cover_proportions(cells: DataFrame, edges: DataFrame, crosswalk: DataFrame, targets: list[str]) -> DataFrame:
    """prop_<class> of each zone by covered area; unmapped codes count in the whole only; ``row_ok`` says whether the shares sum to about 1."""
    inside = covered_cells(cells, edges).where("code IS NOT NULL").join(crosswalk, "code", "left")
    whole = F.sum("units")
    out = inside.groupBy("feature_id").agg(*[F.round(F.coalesce(F.sum(F.when(F.col("target") == t, F.col("units"))), F.lit(0)) / whole, 4).alias(f"prop_{t}") for t in targets])
    return out.withColumn("row_ok", sum(F.col(f"prop_{t}") for t in targets).between(0.95, 1.05))


def landscape_metrics(geometry: DataFrame, edges: DataFrame, classes: DataFrame, ndvi: DataFrame, unit_m: float = 1.0) -> DataFrame:
    """PA, PP, LSI, LPI and mean vegetation index of each feature."""
    n = cells_in_zones(classes, edges).where("code IS NOT NULL").groupBy("feature_id", "code").count().groupBy("feature_id").agg(F.round(100 * F.max("count") / F.sum("count"), 2).alias("LPI"))
    veg = cells_in_zones(ndvi, edges).groupBy("feature_id").agg(F.round(F.avg(F.when(F.col("value") > 0.2, F.col("value"))), 4).alias("NDVI_veg"))
    out = geometry.select("feature_id", F.round(F.col("area_m2") / 1e4, 4).alias("PA"), F.col("perimeter_m").alias("PP"), F.round(F.col("perimeter_m") / (2 * F.sqrt(F.pi() * F.col("area_m2"))), 4).alias("LSI"))
    return out.join(n, "feature_id", "left").join(veg, "feature_id", "left")


def edge_metrics(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Edge density (per unit of area) and aggregation index of each class of (row, col, code), from its 4-neighbours; ``by``:
    columns whose every value is a landscape of its own, such as feature_id."""
    shifts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    moved = cells.withColumn("s", F.explode(shifts)).select(*by, (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"), F.col("code").alias("other"))
    pairs = cells.join(moved.hint("merge"), [*by, "row", "col"]).groupBy(*by, "code").agg(F.count_if(F.col("code") == F.col("other")).alias("like2"), F.count_if(F.col("code") != F.col("other")).alias("unlike"))
    area = cells.groupBy(*by, "code").agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(W.partitionBy(*by)))  # a row for each class
    side = F.floor(F.sqrt("n"))
    left = F.col("n") - side * side
    most = 2 * side * (side - 1) + F.when(left == 0, 0).when(left <= side, 2 * left - 1).otherwise(2 * left - 2)
    return pairs.join(area, [*by, "code"]).select(*by, "code", F.round(F.col("unlike") / F.col("all"), 4).alias("ED"), F.round(100 * F.col("like2") / 2 / F.when(most > 0, most), 4).alias("AI"))


def runs(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Cells with ``start``, the column in which their run begins: a run is a stretch of one code in a row."""
    w = W.partitionBy(*by, "row").orderBy("col")
    new = (F.lag("col").over(w).isNull()) | (F.lag("col").over(w) != F.col("col") - 1) | ~F.lag("code").over(w).eqNullSafe(F.col("code"))
    return cells.select(*by, "row", "col", "code", F.when(new, F.col("col")).alias("_new")).withColumn("start", F.last("_new", ignorenulls=True).over(w)).drop("_new")


def run_links(spans: DataFrame, by: tuple[str, ...] = (), block: int = 64) -> DataFrame:
    """(a, b): runs (v, row, start, end, code) that touch a run of their code in the row above, also by a corner. Runs meet in
    blocks of columns, so no task compares all runs of a row."""
    blocks = lambda extra: F.explode(F.sequence(F.floor((F.col("start") - extra) / block), F.floor((F.col("end") + extra) / block)))
    here = spans.withColumn("_b", blocks(1))
    above = spans.select(*by, (F.col("row") + 1).alias("row"), "code", F.col("v").alias("u"), F.col("start").alias("_s"), F.col("end").alias("_e")).withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / block), F.floor(F.col("_e") / block))))
    low = F.greatest("_s", F.col("start") - 1)
    both = here.join(above, [*by, "row", "code", "_b"]).where((F.col("_s") <= F.col("end") + 1) & (F.col("_e") >= F.col("start") - 1) & (F.col("_b") == F.floor(low / block)))
    return both.select(F.col("v").alias("a"), F.col("u").alias("b"))


def patches(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, row, col, code, patch): patches of equal 8-neighbours; ``patch`` is the smallest cell number, by rounds of joins.

    Rows are cut into runs, runs are linked where they touch, and only runs take part in the rounds: each takes the least
    label around a run, then that label's label. Rounds are checkpointed in turn and end, as labels only fall.
    """
    number = lambda col: F.col("row").cast("bigint") * (1 << 31) + F.col(col)
    key = lambda col: F.struct(*by, number(col).alias("cell")) if by else number(col)
    base = runs(cells, by).withColumn("v", key("start"))
    spans = checkpointed(base.groupBy(*by, "v", "row", "start", "code").agg(F.max("col").alias("end")))
    one_way = run_links(spans, by)
    links = checkpointed(one_way.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(one_way.select(F.col("b").alias("v"), F.col("a").alias("u"))))
    label = checkpointed(spans.select("v", F.col("v").alias("c")))
    while True:
        near = links.join(label.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("c").alias("m"))
        low = label.join(near, "v", "left").select("v", "c", F.least("c", "m").alias("m"))
        new = checkpointed(low.join(label.select(F.col("v").alias("m"), F.col("c").alias("cm")), "m", "left").select("v", F.least("m", "cm").alias("c"), F.col("c").alias("old")))
        label = new.select("v", "c")
        if not new.where("c <> old").limit(1).count():
            return base.join(label, "v").select(*by, "row", "col", "code", F.col("c").alias("patch"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and, unlike a checkpoint, forgets the sizes that
    joins were estimated to have, which square with every round."""
    path = new_folder(df.sparkSession, "checkpoints")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def patch_metrics(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Patches, patch density and mean shape index (outline over that of the most compact patch of its size) of each class,
    in each landscape of ``by``."""
    p = checkpointed(patches(cells, by))
    shifts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    moved = p.withColumn("s", F.explode(shifts)).select(*by, (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"), "patch")
    like = p.join(moved.hint("merge"), [*by, "row", "col", "patch"]).groupBy(*by, "patch").agg(F.count("*").alias("like"))
    size = p.groupBy(*by, "patch").agg(F.first("code").alias("code"), F.count("*").alias("n")).join(like, [*by, "patch"], "left")
    shape = size.withColumn("outline", 4 * F.col("n") - F.coalesce("like", F.lit(0))).withColumn("least", 2 * F.ceil(2 * F.sqrt("n")))
    out = shape.groupBy(*by, "code").agg(F.count("*").alias("n_patches"), F.sum("n").alias("n"), F.avg(F.col("outline") / F.col("least")).alias("shape"))
    return out.select(*by, "code", "n_patches", F.round(F.col("n_patches") / F.sum("n").over(W.partitionBy(*by)), 6).alias("PD"), F.round("shape", 4).alias("SHAPE_MN"))


def buffer_fractions(cells: DataFrame, points: DataFrame, r: int, groups: dict[str, list[int]], min_valid: int = 10) -> DataFrame:
    """Share of each group of codes among the valid cells of the square of r cells around each point (id, row, col).

    Two running sums make each window four lookups, whatever r is; rows of the sums lie in the grid's row and column.
    """
    names = list(groups)
    at = points.select("id", F.col("row").alias("_pr"), F.col("col").alias("_pc"))
    near = at.withColumn("row", F.explode(F.sequence(F.col("_pr") - r, F.col("_pr") + r)))
    w = W.partitionBy("row").orderBy("col")
    sums = cells.select("row", "col", *[F.sum(F.col("code").isin(*groups[g]).cast("int")).over(w).alias(g) for g in names], F.sum((F.col("code") != 0).cast("int")).over(w).alias("_valid"))
    ends = near.select("id", "row", F.explode(F.array(F.struct((F.col("_pc") + r).alias("c"), F.lit(1).alias("s")), F.struct((F.col("_pc") - r - 1).alias("c"), F.lit(-1).alias("s")))).alias("e")).select("id", "row", "e.c", "e.s")
    marks = sums.select("row", F.col("col").alias("c"), F.lit(None).cast("bigint").alias("id"), F.lit(0).alias("s"), *names, "_valid")
    asked = ends.select("row", "c", F.col("id").cast("bigint").alias("id"), "s", *[F.lit(None).cast("bigint").alias(x) for x in [*names, "_valid"]])
    upto = W.partitionBy("row").orderBy("c", F.col("id").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    got = marks.unionByName(asked).select("id", "s", *[F.coalesce(F.last(x, ignorenulls=True).over(upto), F.lit(0)).alias(x) for x in [*names, "_valid"]]).where("id IS NOT NULL")
    total = got.groupBy("id").agg(*[F.sum(F.col("s") * F.col(x)).alias(x) for x in [*names, "_valid"]])
    return total.where(F.col("_valid") >= min_valid).select("id", *[F.round(F.col(g) / F.col("_valid"), 5).alias(g) for g in names])
