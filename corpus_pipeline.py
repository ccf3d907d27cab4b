"""A training-data pipeline over documents: STAGES in order, each written as Parquet and reread as the next one's docs.

Toxic documents go; lines that an earlier document holds go; one document of each group of near copies stays; sources are
mixed to their target weights (a document that the mix takes twice is there twice, one it doesn't take goes); what is
left is encoded. All stages but the last return the columns of their input, with ``n_chars`` brought up to date.
Nulls, empty texts and empty tables pass as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from heatgrid.llm.bpe import bpe_encode
from heatgrid.llm.lines import line_dedup
from heatgrid.llm.mixing import mix, n_words
from heatgrid.llm.ngramjoin import drop_near_copies
from heatgrid.llm.queries import held_out, ranks_path
from heatgrid.llm.store import remove, repeated, written
from heatgrid.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return toxicity(docs, labels).where("score < 0.5").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    th = F.xxhash64("text")
    copy = F.row_number().over(W.partitionBy("doc_id", th).orderBy("doc_id")) if repeated(docs.select("doc_id")) else F.lit(1)  # of rows with equal ids and texts
    numbered = docs.withColumn("_hg_n", copy)
    taken = mix(numbered.select(F.struct("doc_id", th.alias("th"), F.col("_hg_n").alias("n")).alias("row"), "source", "text"), F.array("source"), n_words(F.col("text")), id_col="row")
    times = taken.where("taken > 0").select(F.col("row.doc_id").alias("_hg_id"), F.col("row.th").alias("_hg_th"), F.col("row.n").alias("_hg_m"), F.expr("taken div size").alias("_hg_times"))
    both = numbered.join(times.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_hg_id")) & (th == F.col("_hg_th")) & (F.col("_hg_n") == F.col("_hg_m")))
    return both.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_hg_times").cast("int"))).alias("_hg_copy")).drop("_hg_copy")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_encode(docs, ranks_path(), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("n-gram Jaccard join", drop_copies), ("source mix", mix_sources), ("byte-level BPE", encode)]
#: The toxicity scores and the byte-pair merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if k:
            remove(before)
    return STAGES[-1][1](spark, docs, sf_dir)
