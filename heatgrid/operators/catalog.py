"""Catalogs of scenes, datasets and files, and their lineage, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from heatgrid.operators.spatial import checkpointed


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV by its extension, else Parquet."""
    return spark.read.csv(path, header=True, inferSchema=True) if path.lower().endswith(".csv") else spark.read.parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    (df.write.csv(path, header=True) if path.lower().endswith(".csv") else df.write.parquet(path))


def write_result_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def select_scenes(scenes: DataFrame, max_cloud: float, months: list[int], n: int, older: str) -> DataFrame:
    """The n clearest scenes of these months, those of the older sensor last; unknown cloud counts as 100."""
    cloud = F.coalesce("cloud", F.lit(100.0))
    kept = scenes.where((cloud < max_cloud) & F.month("datetime").isin(*months))
    return kept.orderBy((F.col("platform") == older).cast("int"), cloud, "id").limit(n)


def resolve_bands(assets: DataFrame, aliases: DataFrame) -> DataFrame:
    """(scene, band, asset): for each scene and band the present alias of lowest rank; null if there is none."""
    best = assets.join(aliases, "asset").groupBy("scene", "band").agg(F.min_by("asset", "rank").alias("asset"))
    wanted = assets.select("scene").distinct().crossJoin(F.broadcast(aliases.agg(F.collect_set("band").alias("band")))).withColumn("band", F.explode("band"))  # one row
    return wanted.join(best, ["scene", "band"], "left")


def reconcile(declared: DataFrame, files: DataFrame) -> DataFrame:
    """Flags of (id, available) against the files (id) that exist."""
    both = declared.select("id", "available").join(files.select("id", F.lit(True).alias("exists")), "id", "full")
    have, there = F.coalesce("available", F.lit(False)), F.coalesce("exists", F.lit(False))
    return both.select("id", (have & ~there).alias("available_but_missing"), (~have & there).alias("file_exists_but_unavailable"))


def stale(catalog: DataFrame, now: str, force: bool = False) -> DataFrame:
    """(id, needed, reason) by cache policy and age in whole days."""
    age = F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("fetched_at").cast("timestamp"))) / 86400)
    reason = F.when(F.lit(force), "forced").when(F.col("fetched_at").isNull(), "not_cached").when(F.col("policy") == "always", "always").when((F.col("policy") == "daily") & (age >= 1), "daily").when((F.col("policy") == "weekly") & (age >= 7), "weekly").when(age >= F.col("max_age_days"), "max_age")
    return catalog.select("id", reason.isNotNull().alias("needed"), reason.alias("reason"))


def select_datasets(catalog: DataFrame, semantic_type: str | None = None, acquirable: bool | None = None, auth: bool | None = None, manual: bool | None = None) -> DataFrame:
    for cond, value in (((F.col("semantic_type") == semantic_type), semantic_type), ((~F.col("available") & (F.col("source_type") != "manual")) == F.lit(acquirable), acquirable), (F.col("needs_auth") == F.lit(auth), auth), ((F.col("source_type") == "manual") == F.lit(manual), manual)):
        if value is not None:
            catalog = catalog.where(cond)
    return catalog


def content_hash(content: Column, path: Column, size: Column, mtime: Column, mode: str) -> Column:
    if mode == "full":
        return F.md5(content)
    if mode == "dev":
        return F.md5(F.concat(size.cast("string").cast("binary"), mtime.cast("string").cast("binary"), F.substring(content, 1, 1000)))
    return F.lit(None).cast("string")


def hash_inputs(spark: SparkSession, paths: list[str], mode: str = "full") -> DataFrame:
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", content_hash(F.col("content"), F.col("path"), F.col("length"), F.col("modificationTime"), mode).alias("hash"))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def pair_by_stem(images: DataFrame, labels: DataFrame) -> DataFrame:
    """(stem, image, label, scene): labels by extension, png before tif before jpg."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rank = F.when(ext == "png", 0).when(ext.isin("tif", "tiff"), 1).when(ext.isin("jpg", "jpeg"), 2)
    best = labels.withColumn("_rank", rank).where("_rank IS NOT NULL").groupBy(stem(F.col("path")).alias("stem")).agg(F.min_by("path", F.struct("_rank", "path")).alias("label"))
    out = images.select(stem(F.col("path")).alias("stem"), F.col("path").alias("image")).join(best, "stem")
    return out.withColumn("scene", F.coalesce(F.get(F.split("stem", "_"), F.lit(1)), F.lit("unknown")))


def ingest_index(files: DataFrame) -> DataFrame:
    """Number frames of each scene by capture time (unknown last) and name; flag scenes of mixed dimensions."""
    w = W.partitionBy("scene").orderBy(F.col("taken").isNull(), "taken", "name")
    mixed = F.size(F.collect_set(F.struct("width", "height")).over(W.partitionBy("scene"))) > 1
    return files.withColumn("number", F.format_string("%03d", F.row_number().over(w))).withColumn("mixed", mixed)


def exif_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss"))


def suggestions(names: DataFrame, known: DataFrame, most: int = 2) -> DataFrame:
    """Known names within ``most`` edits of each unknown one; candidates meet by deletion neighbourhoods, not in pairs."""

    def keys(c: str) -> Column:
        cut = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))
        one = F.array_union(F.array(F.col(c)), cut(F.col(c)))
        return one if most < 2 else F.array_distinct(F.flatten(F.transform(one, lambda s: F.array_union(F.array(s), F.when(F.length(s) > 0, cut(s)).otherwise(F.array().cast("array<string>"))))))

    a = names.select("name", F.explode(keys("name")).alias("_k"))
    b = known.select(F.col("name").alias("suggestion"), F.explode(keys("name")).alias("_k"))
    near = a.join(b, "_k").select("name", "suggestion").distinct()
    return near.where((F.col("name") != F.col("suggestion")) & (F.levenshtein("name", "suggestion") <= most))


def trace_impact(edges: DataFrame, missing: DataFrame) -> DataFrame:
    """(missing, step): every step (step, depends_on) that depends on a missing one, through rounds of joins over the newly
    reached; each round adds a table and none is written again. Ends when a round reaches nothing new."""
    front = checkpointed(missing.select(F.col("step").alias("missing"), F.col("step")))
    total = front
    while True:
        near = front.join(edges.withColumnRenamed("step", "_s"), F.col("step") == F.col("depends_on")).select("missing", F.col("_s").alias("step")).distinct()
        front = checkpointed(near.join(total, ["missing", "step"], "left_anti"))
        if front.isEmpty():
            return total.where("step <> missing")
        total = total.unionByName(front)


def runnable(steps: DataFrame, impact: DataFrame, missing: DataFrame) -> DataFrame:
    blocked = impact.select("step").unionByName(missing.select("step")).distinct().withColumn("blocked", F.lit(True))
    return steps.select("step").distinct().join(blocked, "step", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def warnings_by_level(*tables: DataFrame) -> DataFrame:
    """Counts of (level, step, message) rows by level."""
    out = tables[0].select("level", "step", "message")
    for t in tables[1:]:
        out = out.unionByName(t.select("level", "step", "message"))
    return out.groupBy("level").agg(F.count("*").alias("n"))


def merge_provenance(own: DataFrame, **inputs: DataFrame) -> DataFrame:
    """Provenance rows (step, branch) of all inputs, tagged by input where they have no branch, and one's own."""
    out = own.select("step", "branch")
    for name, t in inputs.items():
        out = out.unionByName(t.select("step", F.coalesce("branch", F.lit(name)).alias("branch")))
    return out
