"""Cell tables (row, col, value): scaling, masks, crosswalks, composites and regridding.

All operators are narrow projections or equi-joins on the cell; null is the only missing value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from heatgrid.operators.checks import require_columns
from heatgrid.operators.spatial import checkpointed

CELL = ["row", "col"]


def cells_from_arrays(df: DataFrame, id_col: str, array_col: str) -> DataFrame:
    """One row for each non-null element: (row, col, value)."""
    return df.select(F.col(id_col).alias("row"), F.posexplode(array_col).alias("col", "value")).where("value IS NOT NULL")


def nodata_to_null(value: Column, nodata: tuple = (0, 255)) -> Column:
    return F.when(value.isin(*nodata) | F.isnan(value.cast("double")), None).otherwise(value)


def scale_cells(cells: DataFrame, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    return cells.withColumn("value", F.col("value") * scale + offset)


def range_warnings(cells: DataFrame, low: float = -60.0, high: float = 80.0) -> DataFrame:
    """(level, step, message, n), a row if any value lies outside."""
    n = cells.agg(F.count_if((F.col("value") < low) | (F.col("value") > high)).alias("n")).where("n > 0")
    return n.select(F.lit("warning").alias("level"), F.lit("scale_cells").alias("step"), F.lit("values outside the plausible range").alias("message"), "n")


def qa_bad(qa: Column) -> Column:
    """Fill, dilated cloud, cirrus, cloud or shadow: any of bits 0 to 4."""
    return qa.bitwiseAND(31) > 0


def dn_to_celsius(cells: DataFrame, qa: DataFrame) -> DataFrame:
    """Surface temperature from digital numbers; zero and flagged cells become null. ``qa``: (row, col, qa)."""
    dn = F.col("value")
    good = (dn != 0) & ~F.coalesce(qa_bad(F.col("qa")), F.lit(False))
    return cells.join(qa, CELL, "left").withColumn("value", F.when(good, dn * 0.00341802 + 149.0 - 273.15)).drop("qa")


def ndvi(bands: DataFrame) -> DataFrame:
    """(row, col, value) from (row, col, nir, red, qa)."""
    nir, red = F.col("nir") * 0.0000275 - 0.2, F.col("red") * 0.0000275 - 0.2
    value = F.try_divide(nir - red, nir + red)
    good = (F.col("nir") != 0) & (F.col("red") != 0) & ~F.coalesce(qa_bad(F.col("qa")), F.lit(False)) & (F.abs(value) <= 1)
    return bands.select(*CELL, F.when(good, value).alias("value"))


def align(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Two rasters of one grid, by cell."""
    return a.join(b, CELL, how)


def valid_mask(lst: DataFrame, lc: DataFrame, lst_nodata: float = 0.0, lc_nodata: int = 0) -> DataFrame:
    """Cells with a finite, present value in both."""
    v = F.col("value")
    return align(lst, lc).where(v.isNotNull() & ~F.isnan(v) & (v != lst_nodata) & (F.col("code") != lc_nodata))


def valid_fraction(lst: DataFrame, lc: DataFrame) -> DataFrame:
    v = F.col("value")
    ok = F.coalesce(v.isNotNull() & ~F.isnan(v) & (v != 0) & (F.col("code") != 0), F.lit(False))
    return align(lst, lc, "left").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_valid")).withColumn("fraction", F.col("n_valid") / F.col("n"))


def mask_by_class(target: DataFrame, classes: DataFrame, codes: list[int]) -> DataFrame:
    """``value`` is null where the class is one of ``codes``."""
    hit = F.coalesce(F.col("code").isin(*codes), F.lit(False))
    return target.join(classes, CELL, "left").withColumn("value", F.when(~hit, F.col("value"))).drop("code")


def mask_report(before: DataFrame, after: DataFrame) -> DataFrame:
    both = before.select(*CELL, F.col("value").alias("was")).join(after.select(*CELL, F.col("value").alias("now")), CELL)
    lost = F.count_if(F.col("was").isNotNull() & F.col("now").isNull())
    return both.agg(lost.alias("n_masked"), F.round(100 * lost / F.count("was"), 4).alias("pct_masked")).withColumn("warn", F.col("pct_masked") > 30)


def clip_to_bbox(cells: DataFrame, x_min: float, y_min: float, x_max: float, y_max: float, x: str = "col", y: str = "row") -> DataFrame:
    """Cells whose centre coordinates lie inside; the ranges reach the Parquet scan."""
    return cells.where(F.col(x).between(x_min, x_max) & F.col(y).between(y_min, y_max))


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    return require_columns(df, *cols).dropna(subset=cols)


def dropped_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    missing = F.lit(False)
    for c in cols:
        missing |= F.col(c).isNull()
    return df.agg(F.count("*").alias("n"), F.count_if(missing).alias("dropped")).withColumn("error", F.col("n") - F.col("dropped") < 10)


def log_shift(df: DataFrame, cols: list[str]) -> DataFrame:
    """ln(v), or ln(v + |min| + 1) where the column's least value isn't positive."""
    low = df.agg(*[F.min(c).alias(f"_{c}") for c in cols])  # one row
    out = df.crossJoin(F.broadcast(low))
    for c in cols:
        out = out.withColumn(c, F.when(F.col(f"_{c}") > 0, F.ln(c)).otherwise(F.ln(F.col(c) + F.abs(F.col(f"_{c}")) + 1)))
    return out.select(*df.columns)


def apply_crosswalk(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """``target`` of each code; null where a code has none."""
    return cells.join(mapping, "code", "left")


def unmapped(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    return cells.where("code IS NOT NULL").groupBy("code").agg(F.count("*").alias("n")).join(mapping, "code", "left_anti")


def mosaic(tiles: DataFrame, priority: str) -> DataFrame:
    """Overlapping tiles: in each cell the first with data by ``priority``."""
    return tiles.where("value IS NOT NULL").groupBy(*CELL).agg(F.min_by("value", priority).alias("value"))


def composite(stack: DataFrame, how: str, time: str = "time") -> DataFrame:
    """Stack of scenes to one value a cell: median, first or mosaic (the last)."""
    kinds = {"median": F.median("value"), "first": F.min_by("value", time), "mosaic": F.max_by("value", time)}
    return stack.where("value IS NOT NULL").groupBy(*CELL).agg(kinds[how].alias("value"))


def resample_majority(fine: DataFrame, factor: int) -> DataFrame:
    """Class grid to cells ``factor`` times as large by mode, ties to the smallest code."""
    at = fine.where("code IS NOT NULL").select(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col"), "code")
    return at.groupBy(*CELL, "code").count().groupBy(*CELL).agg(F.min_by("code", F.struct(-F.col("count"), F.col("code"))).alias("code"))


def match_grid(cells: DataFrame, h: int, w: int, to_h: int, to_w: int) -> DataFrame:
    """Nearest resize: each target cell reads the source cell under its centre; the target grid comes from the source's cells."""
    spans = lambda at, n, to: F.sequence(F.ceil(F.col(at) * to / n - 0.5), F.ceil((F.col(at) + 1) * to / n - 0.5) - 1)
    rows, cols = spans("row", h, to_h), spans("col", w, to_w)
    some = F.when(F.element_at(rows, 1) <= F.ceil((F.col("row") + 1) * to_h / h - 0.5) - 1, rows)
    other = F.when(F.element_at(cols, 1) <= F.ceil((F.col("col") + 1) * to_w / w - 0.5) - 1, cols)
    out = cells.withColumn("_r", some).withColumn("_c", other).withColumn("_row", F.explode("_r")).withColumn("_col", F.explode("_c"))
    return out.drop("row", "col", "_r", "_c").withColumnsRenamed({"_row": "row", "_col": "col"}).withColumns({"row": F.col("row").cast("int"), "col": F.col("col").cast("int")})


def snap_palette(pixels: DataFrame, palette: DataFrame, tolerance: float = 30.0) -> DataFrame:
    """``code`` of the nearest palette colour within ``tolerance``, else 0, ties to the smallest code. Distinct colours meet
    the palette in cubes of that side: each palette colour is in 27 cubes, a pixel's colour in its own."""
    side = max(1.0, float(tolerance))
    cube = lambda c: F.floor(F.col(c) / side).cast("int")
    around = lambda c: F.explode(F.sequence(cube(c) - 1, cube(c) + 1))
    colours = pixels.select("r", "g", "b").distinct().withColumns({"_x": cube("r"), "_y": cube("g"), "_z": cube("b")})
    known = palette.withColumn("_x", around("pr")).withColumn("_y", around("pg")).withColumn("_z", around("pb"))
    d2 = sum((F.col(x) - F.col(p)) * (F.col(x) - F.col(p)) for x, p in (("r", "pr"), ("g", "pg"), ("b", "pb")))
    near = colours.join(known, ["_x", "_y", "_z"]).where(d2 <= tolerance * tolerance).groupBy("r", "g", "b").agg(F.min(F.struct(d2.alias("d2"), F.col("code"))).alias("m"))
    return pixels.join(near.select("r", "g", "b", F.col("m.code").alias("code")), ["r", "g", "b"], "left").withColumn("code", F.when(F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull(), F.coalesce("code", F.lit(0))))


def drop_small_classes(cells: DataFrame, min_px: int = 20) -> DataFrame:
    n = cells.groupBy("code").agg(F.count("*").alias("_n"))
    return cells.join(n, "code").withColumn("code", F.when(F.col("_n") >= min_px, F.col("code")).otherwise(0)).drop("_n")


def label_lut(names: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """(index, code): names split at ; or , and the first token that the crosswalk (token, code) has, else 0."""
    tokens = names.select("index", F.posexplode(F.split("name", "[;,]")).alias("pos", "token")).withColumn("token", F.lower(F.trim("token")))
    hit = tokens.join(crosswalk, "token").groupBy("index").agg(F.min_by("code", "pos").alias("code"))
    return names.select("index").join(hit, "index", "left").withColumn("code", F.coalesce("code", F.lit(0)))


def visible_indices(pixels: DataFrame) -> DataFrame:
    """exg, vari, gli and grey of (r, g, b)."""
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    vari = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (g - r) / (g + r - b + 1e-6)))
    return pixels.withColumns({"exg": 2 * g - r - b, "vari": vari, "gli": (2 * g - r - b) / (2 * g + r + b + 1e-6), "grey": (r + g + b) / 3})


#: pixels that one task sorts at once
TASK_ROWS = 500_000


def focal_std(cells: DataFrame, k: int = 7, keys: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Standard deviation of ``value`` over k x k cells of a full grid, edges reflected: sums along rows, then columns. Each
    value of ``keys`` is a grid of its own. ``parts``: tasks of each step, if not those of the session."""
    h = k // 2
    deal = lambda df, *by: df.repartition(parts, *by) if parts else df

    def mirrored(df: DataFrame, axis: str) -> DataFrame:
        other = "row" if axis == "col" else "col"
        ends = df.select("*", F.min(axis).over(W.partitionBy(*keys, other)).alias("_lo"), F.max(axis).over(W.partitionBy(*keys, other)).alias("_hi"))
        at = F.col(axis)
        low, high = 2 * F.col("_lo") - 1 - at, 2 * F.col("_hi") + 1 - at
        copies = F.array(at, F.when(low >= F.col("_lo") - h, low), F.when(high <= F.col("_hi") + h, high))
        return ends.withColumn("_at", F.explode(F.filter(copies, lambda x: x.isNotNull()))).drop(axis).withColumnRenamed("_at", axis)

    out = cells.select(*keys, *CELL, F.col("value").alias("s"), (F.col("value") * F.col("value")).alias("q"))
    for axis in ("col", "row"):
        other = "row" if axis == "col" else "col"
        w = W.partitionBy(*keys, other).orderBy(axis).rangeBetween(-h, h)
        inside = F.col(axis).between(F.col("_lo"), F.col("_hi"))
        out = mirrored(deal(out, *keys, other), axis).select(*keys, *CELL, F.avg("s").over(w).alias("s"), F.avg("q").over(w).alias("q"), inside.alias("_in")).where("_in").drop("_in")
    return deal(out, *keys, *CELL).select(*keys, *CELL, F.sqrt(F.greatest(F.col("q") - F.col("s") * F.col("s"), F.lit(0.0))).alias("texture"))


FEATURES = ["r", "g", "b", "exg", "vari", "gli", "texture"]


def featurize_frames(pixels: DataFrame, labels: DataFrame | None = None, mode: str = "all", k: int = 7) -> DataFrame:
    """Colour, indices and texture (deviation of grey over k x k pixels) of each pixel (frame_id, row, col, r, g, b), with
    labels if given; ``labeled`` keeps labelled ones. A pixel that is there more than once counts as its mean grey. Pixels are
    written, as they are read twice, and where they are many dealt over as many tasks, so that none sorts more as they grow."""
    at = ["frame_id", "row", "col"]
    pixels = checkpointed(pixels)
    parts = math.ceil(pixels.count() / TASK_ROWS)
    if parts <= int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        parts = None
    deal = lambda df: df.repartition(parts, *at) if parts else df
    base = visible_indices(deal(pixels))
    grey = base.groupBy(*at).agg(F.avg("grey").alias("value"))
    out = base.join(focal_std(grey, k, ("frame_id",), parts), at)
    if labels is not None:
        out = out.join(deal(labels), ["frame_id", "row", "col"], "left")
        if mode == "labeled":
            out = out.where("label IS NOT NULL AND label <> 0")
    return out


def file_type(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.endswith(".yml") | p.endswith(".yaml"), "manifest").when(p.endswith(".geojson"), "geojson").when(p.endswith(".tif") | p.endswith(".tiff"), "geotiff").otherwise("unknown")


def scene_of(name: Column) -> Column:
    return F.coalesce(F.get(F.split(name, "_"), F.lit(1)), F.lit("unknown"))
