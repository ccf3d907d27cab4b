"""Quality rules whose thresholds come from quantile sketches, with DataFrame functions only.

``text_counts`` takes the base counts of each whole text in one row (arrays, no shuffle). ``limits`` merges, for each
language and source, histogram sketches of four ratios and of their denominators: a value's bucket keeps its leading bits,
so counts add up in any order and quantiles are exact to one part in 64. A group's quantiles are drawn to those of its
language, and these to the corpus's, by ``weight`` rows. Its fence stands ``spread`` times its own spread beyond its median;
a spread is at least one event (see RATIOS) in the group's median text, as ratios that are mostly 0 have no other scale, and
a tenth of a character for word length, in case of a source of near copies. No cutoff is fixed. ``quality_rules`` joins the fences back and filters.

Cases: null and empty texts have zero words and fail the base rule; null language or source is a group of its own; equal texts
of a group are one in the sketches and each a row of the result; extra columns are ignored; an
empty table gives no row; texts of any length are whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from heatgrid.llm.store import written

SYMBOLS = "#*$%&|<>"
#: name: numerator, denominator and the numerator of one event (a repeated window covers 6 words at least; 0: no events) of each ratio
RATIOS = {"symbols": ("n_symbols", "word_chars", 1), "dup_lines": ("n_dup_lines", "n_lines", 1), "repeats": ("n_repeat_words", "n_words", 6), "word_length": ("word_chars", "n_words", 0)}
SIZES = ("word_chars", "n_lines", "n_words")
LEVELS = (10, 50, 90)
SPREAD, WEIGHT = 5, 1000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _bind(value: Column, use) -> Column:
    """use(value) with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more among ``words``: sort the windows' hashes, keep the places of
    equal neighbours and add up what each place newly covers."""

    def of(w: Column) -> Column:
        places = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return _bind(F.array_sort(places), twice)

    def twice(s: Column) -> Column:
        n = F.size(s)
        at = F.filter(F.transform(s, lambda x, k: F.when(((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k + 1 < n) & (F.get(s, k + 1)["h"] == x["h"])), x["i"])), lambda i: i.isNotNull())
        return _bind(F.array_sort(at), covered)

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda i, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), i - F.get(p, k - 1)))), F.lit(0), lambda a, x: a + x)

    return _bind(words, lambda w: F.when(F.size(w) >= 4, of(w)).otherwise(0))


def text_counts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, the base counts and ``n_lines`` (lines with a word)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.transform(F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""), lambda x: F.xxhash64(x))
    joined = F.translate(text, " \t\n\x0b\x0c\r", "")
    packed = docs.select(*keep, F.length(joined).alias("word_chars"), (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
                         _bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("_l"),
                         _bind(words, lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("repeats"))).alias("_w"))
    big = [F.col(a).cast("bigint").alias(b) for a, b in (("_w.n", "n_words"), ("word_chars", "word_chars"), ("n_symbols", "n_symbols"), ("_l.dup", "n_dup_lines"), ("_w.repeats", "n_repeat_words"), ("_l.n", "n_lines"))]
    return packed.select(*keep, *big)


def bucket(value: str) -> str:
    """SQL for the sketch bucket of a non-negative integer: itself below 128, else its 7 leading bits."""
    return f"CASE WHEN {value} < 128 THEN {value} ELSE shiftleft(shiftright({value}, length(bin({value})) - 7), length(bin({value})) - 7) END"


def ratio(name: str) -> Column:
    top, bottom, _ = RATIOS[name]
    return F.expr(f"CASE WHEN {bottom} > 0 THEN ({top} * 1000000) div {bottom} ELSE 0 END")


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group of ``keys``: n, q10_, q50_ and q90_ of each ratio and size, by running counts over the buckets of
    a group, whose number is bounded."""
    merged = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*keys, "rule")
    run = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
    at = {(k, p): F.min(F.when((F.col("rule") == k) & (F.col("upto") * 100 >= F.col("all") * p), F.col("bucket"))).alias(f"q{p}_{k}") for k in (*RATIOS, *SIZES) for p in LEVELS}
    return run.groupBy(*keys).agg(F.max("all").alias("n"), *at.values())


def settled(spread: int, weight: int, parent: bool, div: str = "div") -> dict[str, str]:
    """SQL for a group's settled columns, from its own (n, q..) and, if it has a parent, the parent's settled ones (with p_ before)."""
    out = {}
    for k in (*RATIOS, *SIZES):
        for p in LEVELS:
            own = f"q{p}_{k}"
            out[own] = f"(n * {own} + {weight} * p_{own}) {div} (n + {weight})" if parent else own
    for k, (_, size, event) in RATIOS.items():
        least = f"{event * 1_000_000} {div} greatest(1, {out[f'q50_{size}']})" if event else "100000"
        for side, a, b in (("up", 90, 50), ("down", 50, 10)):
            out[f"{side}_{k}"] = f"greatest({out[f'q{a}_{k}']} - {out[f'q{b}_{k}']}, {least})"
        out[f"high_{k}"] = f"{out[f'q50_{k}']} + {spread} * {out[f'up_{k}']}"
        out[f"low_{k}"] = f"{out[f'q50_{k}']} - {spread} * {out[f'down_{k}']}"
    return out


def limits(counts: DataFrame, spread: int, weight: int) -> DataFrame:
    """(_lang, _source, high_ and low_ of each ratio) of each group of languages and sources, from ``text_counts`` with text_hash."""
    values = [F.struct(F.lit(k).alias("rule"), ratio(k).alias("value")) for k in RATIOS] + [F.struct(F.lit(k).alias("rule"), F.col(k).alias("value")) for k in SIZES]
    long = counts.where(~F.col("base_failed")).select("lang", "source", "text_hash", *COUNTS, "n_lines").distinct().select("lang", "source", F.explode(F.array(*values)).alias("r"))
    sketch = long.select("lang", "source", "r.rule", F.expr(bucket("r.value")).alias("bucket")).groupBy("lang", "source", "rule", "bucket").agg(F.count("*").alias("n"))
    sketch = written(sketch, "sketch")

    def settle(own: DataFrame, parent: DataFrame | None, keys: list[str]) -> DataFrame:
        exprs = settled(spread, weight, parent is not None)
        if parent is not None:
            shared = [k for k in keys if k in parent.columns]
            above = parent.select(*[F.col(c).alias(f"p_{c}") for c in parent.columns])
            same = [F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in shared]
            own = own.join(above, same) if same else own.crossJoin(F.broadcast(above))  # the corpus is one row
        return own.select(*keys, *[F.expr(x).alias(k) for k, x in exprs.items()])

    corpus = settle(quantiles(sketch, []), None, [])
    langs = settle(quantiles(sketch, ["lang"]), corpus, ["lang"])
    both = settle(quantiles(sketch, ["lang", "source"]), langs, ["lang", "source"])
    return both.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[f"{side}_{k}" for k in RATIOS for side in ("high", "low")])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, spread: int = SPREAD, weight: int = WEIGHT) -> DataFrame:
    """(id_col, the base counts, base_failed, kept) of each row; a text stays within the upper fences and the lower one of word length."""
    counts = text_counts(docs.select(F.col(id_col), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash")), [id_col, "lang", "source", "text_hash"])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = written(counts.withColumn("base_failed", failed), "counts")
    joined = counts.join(limits(counts, spread, weight), F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    within = F.lit(True)
    for k in RATIOS:
        within &= ratio(k) <= F.coalesce(F.col(f"high_{k}"), ratio(k))
    within &= ratio("word_length") >= F.coalesce(F.col("low_word_length"), ratio("word_length"))
    return joined.select(id_col, *COUNTS, "base_failed", (~F.col("base_failed") & within).alias("kept"))
