"""Registered queries of this subpackage, and the SQL that some of them have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from heatgrid.llm.bpe import bpe_encode

    return bpe_encode(table(spark, sf_dir, "documents"), ranks_path(), public_tokenizers.PATTERN, keep_ids=False)


def op2_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keeps the share of documents that labels call good, drawn by importance."""
    from heatgrid.llm.resampling import importance_sample

    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL AND doc_id IS NOT NULL")
    share = labels.agg(F.avg("quality")).first()[0]
    return importance_sample(table(spark, sf_dir, "documents"), labels.where("quality = 1").select("doc_id"), 1.0 if share is None else share)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heatgrid.llm.lines import apply_bitmaps, line_bitmaps, split_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(split_lines(F.col("text"))).cast("bigint").alias("n_lines"))
    kept = apply_bitmaps(docs, line_bitmaps(docs))
    return kept.select("doc_id", "n_lines", F.coalesce("_hg_dropped", F.lit(0)).cast("bigint").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL3 = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS dropped FROM k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heatgrid.llm.spans import remove_spans, repeated_spans

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = remove_spans(docs, repeated_spans(docs), digest=True)
    return kept.select("doc_id", F.col("_hg_sentences").alias("n_sentences"), F.col("_hg_removed").alias("n_removed"), F.col("text").alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heatgrid.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def _sql5() -> str:
    from heatgrid.llm.quality import COUNTS, LEVELS, RATIOS, SIZES, SPREAD, WEIGHT, settled

    value = {k: f"CASE WHEN {b} > 0 THEN {a} * 1000000 // {b} ELSE 0 END" for k, (a, b, _) in RATIOS.items()}
    values = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS rule, {v} AS v FROM d" for k, v in (value | {k: k for k in SIZES}).items())
    at = ", ".join(f"min(bucket) FILTER (rule = '{k}' AND upto * 100 >= rows * {p}) AS q{p}_{k}" for k in (*RATIOS, *SIZES) for p in LEVELS)

    def quantiles(keys: list[str]) -> str:
        by = ", ".join([*keys, "rule"])
        inner = f"SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}) AS rows FROM (SELECT {by}, bucket, count(*) AS n FROM h GROUP BY {by}, bucket)"
        return f"SELECT {''.join(k + ', ' for k in keys)}max(rows) AS n, {at} FROM ({inner}) {'GROUP BY ' + ', '.join(keys) if keys else ''}"

    def settle(keys: list[str], parent: str, on: str) -> str:
        exprs = settled(SPREAD, WEIGHT, bool(parent), "//")
        above = f", (SELECT {', '.join(f'{c} AS p_{c}' for c in (*exprs, *(['lang'] if on else [])))} FROM {parent}) p" if parent else ""
        return f"SELECT {''.join(k + ', ' for k in keys)}{', '.join(f'{x} AS {k}' for k, x in exprs.items())} FROM ({quantiles(keys)}) o{above} {on}"

    beyond = " OR ".join([f"{value[k]} > f.high_{k}" for k in RATIOS] + [f"{value['word_length']} < f.low_word_length"])
    return f"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), rw AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE times > 1) GROUP BY 1
), dl AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY 1
), b AS (
  SELECT w.doc_id, lang, source, text, len(w.w) AS n_words, coalesce(length(array_to_string(w.w, '')), 0) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         coalesce(dl.dup, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words, coalesce(dl.n, 0) AS n_lines
  FROM w LEFT JOIN rw ON rw.doc_id = w.doc_id LEFT JOIN dl ON dl.doc_id = w.doc_id
), c AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
d AS (SELECT DISTINCT lang, source, text, {', '.join(COUNTS)}, n_lines FROM c WHERE NOT base_failed),
h AS (SELECT *, CASE WHEN v < 128 THEN v ELSE (v >> (length(bin(v)) - 7)) << (length(bin(v)) - 7) END AS bucket FROM ({values})),
fc AS ({settle([], '', '')}),
fl AS ({settle(['lang'], 'fc', '')}),
f AS ({settle(['lang', 'source'], 'fl', 'WHERE o.lang IS NOT DISTINCT FROM p.p_lang')})
SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({beyond}, false) AS kept
FROM c LEFT JOIN f ON f.lang IS NOT DISTINCT FROM c.lang AND f.source IS NOT DISTINCT FROM c.source
"""


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heatgrid.llm.mixing import mix, n_words

    docs = table(spark, sf_dir, "documents")
    return mix(docs, F.array("source"), n_words(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heatgrid.llm.vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL7 = """
WITH RECURSIVE v AS (
  SELECT DISTINCT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), r AS (
  SELECT a AS v, a AS c FROM l
  UNION
  SELECT l.b, r.c FROM r JOIN l ON l.a = r.v
), o AS (
  SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, coalesce((SELECT min(c) FROM r WHERE v = vec_id), vec_id) AS component_id
  FROM embeddings WHERE vec_id IS NOT NULL
)
SELECT *, component_id = vec_id AS kept FROM o
"""


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heatgrid.llm.ngramjoin import ngram_groups

    return ngram_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL8 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-6
), r AS (
  SELECT a AS v, a AS c FROM l
  UNION
  SELECT l.b, r.c FROM r JOIN l ON l.a = r.v
)
SELECT d.doc_id, coalesce((SELECT min(c) FROM r WHERE v = d.doc_id), d.doc_id) AS class_id, (SELECT count(*) FROM l WHERE a = d.doc_id) AS n_links
FROM documents d WHERE d.doc_id IS NOT NULL
"""


def held_out(id_: str = "doc_id"):
    return F.crc32(F.col(id_).cast("string").cast("binary")) % 5 == 0


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heatgrid.llm.toxicity import toxicity

    labels = table(spark, sf_dir, "labels").where(~held_out())
    scored = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from heatgrid.llm.store import new_path
    from heatgrid.llm.tokenfiles import read_tokens, write_tokens

    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(spark, path)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heatgrid.llm.whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from heatgrid.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, keep_ids=False)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heatgrid.llm.merkle import build_manifest, fold, leaf_hash, proof_digest, proofs

    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    tampered = leaf_hash(*[F.col(f).cast("decimal(38,0)") + 1 if f == "n_chars" else F.col(f) for f in fields])
    found = proofs(build_manifest(docs, fields, claim=F.when(changed, tampered)))
    out = found.withColumn("folded_root", fold(F.coalesce("claim", "leaf"), F.col("steps")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


SQL13 = """
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS ft, concat_ws('', CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
    CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END) AS head, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
    list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda k: (ord(c)::BIGINT >> k) & 1))), lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295) AS rest
  FROM documents
), e AS (
  SELECT *, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || ft) AS leaf,
    CASE WHEN xor(rest, 4294967295) % 7 = 0 AND n_chars IS NOT NULL THEN sha256(head || strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1) || ft) END AS claim
  FROM d
), l AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS m, row_number() OVER () AS id FROM e
), n AS (
  SELECT tree, 0 AS level, i, m, leaf AS h FROM l
  UNION ALL
  SELECT tree, level + 1, i // 2, (m + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM n WHERE m > 1 GROUP BY tree, level, m, i // 2
), t AS (
  SELECT 0 AS level, tree AS i, count(*) OVER () AS m, h FROM n WHERE m = 1
  UNION ALL
  SELECT level + 1, i // 2, (m + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE m > 1 GROUP BY level, m, i // 2
), a AS (
  SELECT tree, level, level AS step, i, m, h FROM n UNION ALL SELECT -1, level, 1000 + level, i, m, h FROM t
), v AS (SELECT DISTINCT tree, level, step FROM a WHERE m > 1),
s AS (
  SELECT l.id, row_number() OVER (PARTITION BY l.id ORDER BY v.step) AS k, (CASE WHEN v.tree < 0 THEN l.tree ELSE l.i END >> v.level) & 1 AS odd, coalesce(a.h, '') AS h
  FROM l JOIN v ON v.tree IN (l.tree, -1) LEFT JOIN a ON a.tree = v.tree AND a.level = v.level AND a.i = xor(CASE WHEN v.tree < 0 THEN l.tree ELSE l.i END >> v.level, 1)
), f AS (
  SELECT id, 0 AS k, coalesce(claim, leaf) AS x FROM l
  UNION ALL
  SELECT f.id, s.k, sha256(CASE WHEN s.odd = 1 THEN s.h || f.x ELSE f.x || s.h END) FROM f JOIN s ON s.id = f.id AND s.k = f.k + 1
), p AS (SELECT id, string_agg(h, '' ORDER BY k) AS h FROM s GROUP BY id),
g AS (SELECT id, arg_max(x, k) AS x FROM f GROUP BY id), r AS (SELECT h FROM t WHERE m = 1)
SELECT doc_id, leaf, n.h AS subroot, r.h AS root, sha256(coalesce(p.h, '')) AS proof_sha256, g.x AS folded_root, g.x = r.h AS verified
FROM l JOIN n ON n.tree = l.tree AND n.m = 1 JOIN g ON g.id = l.id LEFT JOIN p ON p.id = l.id, r
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_importance": op2_importance,
    "op3_line_dedup": op3_line_dedup,
    "op4_sentence_spans": op4_sentence_spans,
    "op5_quality_rules": op5_quality_rules,
    "op6_source_mix": op6_source_mix,
    "op7_near_vectors": op7_near_vectors,
    "op8_ngram_join": op8_ngram_join,
    "op9_toxicity": op9_toxicity,
    "op10_token_files": op10_token_files,
    "op11_whitening": op11_whitening,
    "op12_packing": op12_packing,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": SQL3,
    "op5_quality_rules": _sql5(),
    "op7_near_vectors": SQL7,
    "op8_ngram_join": SQL8,
    "op13_merkle": SQL13,
}
