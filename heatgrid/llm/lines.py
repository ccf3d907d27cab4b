"""Line dedup with DataFrame functions only.

``line_bitmaps`` hashes every line's key, range-partitions the hashes with documents and positions as secondary order and
streams each key's first document through a window on that order. A line is dropped where an earlier document holds its
key. What comes back is a keep bitmap of each document that loses lines, as its 64-line words that aren't all ones, and
not text; ``apply_bitmaps`` joins them to the documents.

A key held by a large share of all lines is dealt out over slices by document (see ``first_seen``).

Cases: null and empty texts are one empty line; keys under ``min_chars`` code points are kept; rows with a null id keep
all lines and count for no other; rows with equal ids are one document; all columns of the documents stay (names in _hg_
are the operator's own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatgrid.llm.firsts import first_seen
from heatgrid.llm.store import written

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(_id, _text_hash, _keep array<struct<word, bits>>, _dropped) of each document that loses lines."""
    cut = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), _text_hash(F.col(text_col)).alias("_text_hash"), split_lines(F.col(text_col)).alias("_lines"))
    lines = cut.select("_id", "_text_hash", F.posexplode("_lines").alias("pos", "line"))
    lines = lines.select("_id", "_text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    lines = written(lines.select("_id", "_text_hash", "pos", F.xxhash64("key").alias("h1"), F.hash(F.lit("line"), "key").alias("h2")), "line-keys")

    seen = first_seen(lines, ["h1", "h2"], ["_id", "_text_hash", "pos"], ranged=True)
    dropped = seen.where(F.col("_id") > F.col("_first._id")).select("_id", "_text_hash", "pos")
    words = dropped.groupBy("_id", "_text_hash", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    word = F.struct("word", F.bitwise_not("bits").alias("bits"))
    return words.groupBy("_id", "_text_hash").agg(F.array_sort(F.collect_list(word)).alias("_keep"), F.sum(F.bit_count("bits")).alias("_dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with ``text_col`` less the dropped lines, and the bitmap columns ``_hg_keep`` and ``_hg_dropped`` (null: nothing dropped)."""
    text = F.col(text_col)
    found = bitmaps.select(F.col("_id").alias("_hg_id"), F.col("_text_hash").alias("_hg_hash"), F.col("_keep").alias("_hg_keep"), F.col("_dropped").alias("_hg_dropped"))
    joined = docs.withColumn("_hg_text", _text_hash(text)).join(found.hint("merge"), (F.col(id_col) == F.col("_hg_id")) & (F.col("_hg_text") == F.col("_hg_hash")), "left")
    gap = lambda e, k: e["word"] - F.when(k > 0, F.get("_hg_keep", k - 1)["word"]).otherwise(-1) - 1
    dense = F.array(F.flatten(F.transform("_hg_keep", lambda e, k: F.concat(F.array_repeat(F.lit(-1).cast("bigint"), gap(e, k).cast("int")), F.array(e["bits"])))))
    # the outer transform binds the dense words once
    kept = F.transform(dense, lambda bits: F.filter(split_lines(text), lambda _, i: F.coalesce(F.get(bits, F.shiftright(i, 6)), F.lit(-1).cast("bigint")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i.bitwiseAND(63))) != 0))
    return joined.withColumn(text_col, F.when(F.col("_hg_keep").isNull(), text).otherwise(F.array_join(kept[0], "\n"))).drop("_hg_id", "_hg_text", "_hg_hash")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """The documents without repeated lines; a document whose lines all go has an empty text."""
    return apply_bitmaps(docs, line_bitmaps(docs, id_col, text_col, min_chars), id_col, text_col).select(*docs.columns)
