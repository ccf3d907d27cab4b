"""The training-data operators against SQL, brute force, public tokenizers and held-out labels, also on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from compare import SF, duck, same
from pyspark.sql import functions as F

import corpus_pipeline
from heatgrid.llm import bpe, lines, mixing, ngramjoin, quality, resampling, spans, textops, tokenfiles, toxicity, vectors
from heatgrid.llm.queries import ORACLES, QUERIES, ranks_path

PASSAGE = " ".join(f"w{i}" + (". " if i % 9 == 8 else "") for i in range(60)).replace("  ", " ") + "."
DOC = "doc_id long, text string, lang string, source string, n_chars long, _id long, word string, h1 long"


def awkward(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    prose = lambda n: " ".join(word() + ("." if rnd.random() < 0.1 else "") for _ in range(n))
    base = prose(120)
    near = base.split(" ")
    texts = [None, "", " ", "\n", "\n\n", "one", "two words", "a b c d", base, base, base, " ".join([*near[:60], "changed", *near[61:]]), " ".join([*near[:-1], "end"]), base + "\nCommon Footer Line", prose(50) + "\n  common footer line\t", "Common footer line\n" + prose(30) + "\nCommon footer line",
             prose(3000), "x" * 5000, "éè 你好 \U0001f600 ١٢ <|endoftext|> don't", "a  b\t c \n d   e\x1c f", PASSAGE, prose(20) + ". " + PASSAGE + " " + prose(20) + ".", "da da da da da da " * 20, "#### $$$$ " * 60]
    rows = [(i, t, rnd.choice(["en", "fr", None]), rnd.choice(["s1", "s2", "s10", None]), len(t) if t else None, i, "w", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder with awkward documents and labels, and one where the tables are empty."""
    path = str(tmp_path_factory.mktemp("awkward"))
    awkward(spark).repartition(3).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i in (3, 9))) for i in range(1, 20)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    e = [(0, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0, 0.0], 1), (2, [0.99, 0.05, 0.0], 1), (3, [-0.0, 0.0, 0.0], 1), (4, None, 1), (5, [1.0, None, 0.0], 1), (6, [float("nan"), 1.0, 0.0], 1), (7, [float("inf"), 1.0, 0.0], 1), (8, [1.0, 0.0, 0.0], None), (9, [], 1), (10, [2.0, 0.0, 0.0], 2), (11, [1.0, 0.0], 1), (12, [3.0, 0.1, 0.0], 1)]
    spark.createDataFrame(e, "vec_id long, embedding array<float>, label int").write.parquet(f"file://{path}/embeddings.parquet")
    for t in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"file://{path}/{t}.parquet").limit(0).write.parquet(f"file://{path}/empty/{t}.parquet")
    return path


def texts_of(spark, path):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    same(QUERIES[name](spark, SF), duck(), ORACLES[name])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql_on_awkward_rows(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    same(QUERIES[name](spark, f"file://{sf}"), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, sf, name):
    assert QUERIES[name](spark, f"file://{sf}/empty").count() == 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op11_whitening", "op12_packing"}))
def test_awkward_rows_give_a_row_each(spark, sf, name):
    assert QUERIES[name](spark, f"file://{sf}").count() == awkward(spark).count()


@pytest.mark.parametrize("where", ["given", "awkward"])
def test_bpe_equals_tiktoken(spark, sf, where):
    import public_tokenizers as P
    import tiktoken

    from heatgrid.llm.bpe import bpe_decode, bpe_encode, load_ranks

    path = SF if where == "given" else f"file://{sf}"
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(ranks_path()), special_tokens={})
    texts = texts_of(spark, path)
    for r in QUERIES["op1_bpe"](spark, path).collect():
        ids = own.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    docs = spark.read.parquet(f"{path}/documents.parquet")
    back = bpe_decode(bpe_encode(docs, ranks_path(), P.PATTERN), ranks_path(), P.PATTERN)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {k: v or "" for k, v in texts.items()}


@pytest.mark.parametrize("where", ["given", "awkward"])
def test_token_files_equal_tokenizers(spark, sf, where):
    import public_tokenizers as P
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = SF if where == "given" else f"file://{sf}"
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    at = 0
    got = {r["doc_id"]: r for r in QUERIES["op10_token_files"](spark, path).collect()}
    for doc, text in sorted(texts_of(spark, path).items()):
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[doc]["start"], got[doc]["n_tokens"], got[doc]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1023, 1024, 1025, 5000):
        for top in (1, 2, 300, 60_000, 2**32):
            x = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            x[::37] = top - 1
            payload, starts = tokenfiles.pack_blocks(x)
            assert (tokenfiles.unpack_blocks(payload, starts) == x).all()
            if n > 1024:
                assert (tokenfiles.read_block(payload, int(starts[1])) == x[1024:2048]).all()


def test_line_dedup_with_a_hot_line(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "concat('The Same Footer', '\n', 'line number ', id, '\n', ' the same footer ') text")
    got = {r["doc_id"]: r["text"] for r in lines.line_dedup(docs).collect()}
    assert got[0].count("ooter") == 2 and all("ooter" not in got[i] for i in range(1, 3000))


def brute_sentences(text):
    words = [(m.group(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
    out, begin, at = [], 0, 0
    for i, (w, end) in enumerate(words):
        last = i + 1 == len(words)
        gap = text[end : words[i + 1][1] - len(words[i + 1][0])] if not last else ""
        if last or "\n" in gap or w.rstrip("\"')]}")[-1:] in (".", "!", "?"):
            stop = len(text) if last else end
            out.append(([x for x, _ in words[begin : i + 1]], text[at:stop]))
            begin, at = i + 1, stop
    return out


@pytest.mark.parametrize("where", ["given", "awkward"])
def test_sentence_spans_equal_brute_force(spark, sf, where):
    path = SF if where == "given" else f"file://{sf}"
    texts = texts_of(spark, path)
    first, covered = {}, defaultdict(set)
    cut = {d: brute_sentences(t) for d, t in texts.items()}
    for d in sorted(cut):
        s = cut[d]
        for i in range(len(s)):
            words, j = [], i
            while j < len(s) and not (len(words) >= 25 or (j - i >= 3 and len(words) >= 8)):
                words += s[j][0]
                j += 1
            if len(words) >= 25 or (j - i >= 3 and len(words) >= 8):
                if first.setdefault(tuple(words), (d, i)) != (d, i):
                    covered[d] |= set(range(i, j))
    for r in QUERIES["op4_sentence_spans"](spark, path).collect():
        d = r["doc_id"]
        text = "".join(x for k, (_, x) in enumerate(cut[d]) if k not in covered[d]) if cut[d] else texts[d] or ""
        assert (r["n_sentences"], r["n_removed"], r["kept_sha256"]) == (len(cut[d]), len(covered[d]), hashlib.sha256(text.encode()).hexdigest()), d
    if where == "awkward":
        assert covered[21] and not covered[20]


def test_large_group_of_near_copies(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*words[:100], f"x{i}", *words[101:]])) for i in range(700)] + [(10_000 + i, " ".join(f"u{i}_{k}" for k in range(50))) for i in range(50)]
    got = {r["doc_id"]: r for r in ngramjoin.ngram_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert all(got[i]["n_links"] == 699 and got[i]["class_id"] == 0 for i in range(700))
    assert all(got[10_000 + i]["n_links"] == 0 for i in range(50))


def test_banding_reaches_the_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = ngramjoin.banding(threshold, 0.9999)
        assert 1 - (1 - threshold**rows) ** bands >= 0.9999


def test_vector_recall_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.981 * a + np.sqrt(1 - 0.981**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    rows = [(i, x.tolist(), 1) for i, x in enumerate(np.concatenate([a, b]))]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sum(r["n_links"] for r in got) >= 0.99 * 800


def test_targets_and_flow():
    got = mixing.source_targets({"a": 100, "b": 1000, None: 1000})
    assert got["a"] == 200 and sum(got.values()) == pytest.approx(3150) and got[None] == pytest.approx(2 * got["b"])
    flow = mixing.min_cost_flow([10, 10, 5], [[0], [0, 1], [1]], [12, 20], 2)
    used = [[sum(x.values()) for x in p] for p in flow]
    assert sum(map(sum, used)) == 32 and all(u[0] == s for u, s in zip(used, [10, 10, 5], strict=True))
    assert sum(x.get(0, 0) for p in flow for x in p) == 12


def test_mix_is_near_its_targets_and_repeats(spark):
    a = {r["doc_id"]: r for r in QUERIES["op6_source_mix"](spark, SF).collect()}
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    taken, target, most = defaultdict(int), {}, defaultdict(int)
    for d, r in a.items():
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[source[d]] += r["taken"]
        target[source[d]] = r["target"]
        most[source[d]] = max(most[source[d]], r["size"])
    assert all(abs(taken[s] - target[s]) <= most[s] + 1 for s in target)
    again = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet").repartition(7), F.array("source"), mixing.n_words(F.col("text")))
    assert {r["doc_id"]: r["taken"] for r in again.collect()} == {d: r["taken"] for d, r in a.items()}


def test_overlapping_sources(spark):
    docs = spark.range(200).selectExpr("id doc_id", "array_compact(array(if(id % 2 = 0, 'a', null), if(id % 3 = 0, 'b', null), if(id % 2 > 0 and id % 3 > 0, 'c', null))) s")
    got = mixing.mix(docs, F.col("s"), F.lit(10).cast("bigint")).collect()
    assert all(set(r["picked"]) and r["taken"] == 10 * len(r["picked"]) for r in got if r["taken"])


def test_importance_sample(spark):
    good = [(i, f"alpha beta gamma number{i} delta") for i in range(200)]
    bad = [(1000 + i, f"zig zag{i} zug zig zag") for i in range(100)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    got = resampling.importance_sample(docs, spark.range(0, 100).toDF("doc_id"), 0.5).collect()
    assert sum(r["kept"] for r in got) == 150
    assert sum(r["kept"] for r in got if r["doc_id"] >= 1000) == 0
    keys = sorted((r["key"] for r in got), reverse=True)
    assert min(r["key"] for r in got if r["kept"]) == keys[149]


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(0)
    made = []
    for _ in range(500):
        t = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        made.append((t, toxicity.weigh(t, rng.integers(1, 5, len(t)), np.linspace(1, 3, 40))))
    index = toxicity.Index(np.repeat(np.arange(500), [len(t) for t, _ in made]), np.concatenate([t for t, _ in made]), np.concatenate([x for _, x in made]), np.zeros(500), list(range(500)), 40, 10)
    dense = np.zeros((500, 40))
    for i, (t, x) in enumerate(made):
        dense[i, t] = x
    for i in range(0, 500, 7):
        got, cosine = index.nearest(*made[i])
        want = np.sort(dense @ dense[i])[::-1][:10]
        assert np.allclose(cosine, want[want > 0][: len(cosine)])


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op9_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) >= 0.9
    docs = spark.createDataFrame([(i, ("good words here " if i % 4 else "vile slur text ") + f"n{i}") for i in range(400)], "doc_id long, text string")
    labels = spark.range(0, 300).selectExpr("id doc_id", "cast(id % 4 = 0 as int) toxic")
    scored = toxicity.toxicity(docs, labels).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in scored)


def test_toxicity_of_long_labelled_texts(spark):
    """A bound on the examples' bytes is kept, and one weak hit stays near the base rate."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 8)))
    texts = [" ".join([word() for _ in range(2000)] + ["vileslur"] * 3 * (i % 4 == 0)) for i in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (100, " ".join(word() for _ in range(40)))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int")
    whole = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    assert whole[100] < 0.5 and all((whole[i] > 0.5) == (i % 4 == 0) for i in range(60))
    fitted = toxicity.fit(docs, labels, "doc_id", "text", "toxic", 2048, 300_000, 8, True, 25, 11)
    assert 5 <= len(fitted[2].ids) <= 40


def test_toxicity_learns_from_few_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    hits = wrong = 0
    for k in range(5):
        got = toxicity.toxicity(docs, labels.where(fold != k)).select("doc_id", "score").join(labels.where(fold == k), "doc_id").collect()
        hits += sum(r["toxic"] and r["score"] >= 0.5 for r in got)
        wrong += sum(r["toxic"] == 0 and r["score"] >= 0.5 for r in got)
    assert hits >= 5 and wrong <= 1


def test_pipeline(spark, sf):
    for path in (SF, f"file://{sf}", f"file://{sf}/empty"):
        docs = spark.read.parquet(f"{path}/documents.parquet")
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs
            docs = corpus_pipeline.written(stage(spark, docs, path), f"test-{k}")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == columns
            if k == 1:
                assert docs.count() == before.count()
            if k == 2:
                assert docs.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_null_ids_do_not_crash(spark):
    docs = awkward(spark).unionByName(spark.createDataFrame([(None, "no id here at all and some more words", None, None, None, None, None, None)] * 2, DOC))
    assert lines.line_dedup(docs).count() == docs.count()
    assert spans.substring_dedup(docs).count() == docs.count()
    assert ngramjoin.drop_near_copies(docs).where("doc_id IS NULL").count() == 2
    assert toxicity.toxicity(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == docs.count()
    assert corpus_pipeline.mix_sources(spark, docs, "").columns == docs.columns


ODD = list(" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u2002\u2028\u3000'.,;:!?*&%$#|-_()aAbsStTdmrelivéñ你١́①\U0001f600\u200b\ufeff9") + ["'re", "'ll", " the", "<|endoftext|>"]


def test_encoders_on_odd_texts():
    import public_tokenizers as P
    import pyarrow as pa
    import tiktoken
    from tokenizers import Tokenizer

    rnd = random.Random(4)
    texts = [None if k % 50 == 0 else "".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 30))) for k in range(4000)]
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids, counts = tokenfiles.Encoder(P.path("byte_bpe_50k.json")).encode(pa.array(texts))
    for t, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert got.tolist() == whole.encode(t or "", add_special_tokens=False).ids, repr(t)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(ranks_path()), special_tokens={})
    with bpe.coder(ranks_path(), P.PATTERN) as coder:
        ids, counts = coder.pieces.encode(pa.array(texts))
        for t, got, back in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), coder.decode(ids, counts), strict=True):
            assert got.tolist() == own.encode_ordinary(t or "") and back == (t or "").encode(), repr(t)


def test_bpe_on_code_points_of_newer_unicode():
    """Letters and numbers that one of the two libraries doesn't know yet, alone and beside what tells kinds apart."""
    import unicodedata

    import pyarrow as pa
    import public_tokenizers as P
    import regex
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(ranks_path()), special_tokens={})
    points = [c for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if unicodedata.category(c) == "Cn" and regex.match(r"[\p{L}\p{N}]", c)]
    points += [chr(c) for c in range(0x110000) if c % 211 == 0 and not 0xD800 <= c < 0xE000]
    texts = [form.replace("{}", c) for c in points for form in ("{}'s", "{}a", "1{}!? {}")]
    with bpe.coder(ranks_path(), P.PATTERN, bpe.newer_letters()) as coder:
        ids, counts = coder.pieces.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == own.encode_ordinary_batch(texts)


def test_known_pieces_are_bounded(monkeypatch):
    import public_tokenizers as P
    import pyarrow as pa

    monkeypatch.setattr(tokenfiles, "KNOWN_BYTES", 20_000)
    own = tokenfiles.Encoder(P.path("byte_bpe_50k.json"))
    for k in range(20):
        texts = [f"word{k}x{i} plain, words." for i in range(200)]
        ids, counts = own.encode(pa.array(texts))
        assert own.pieces.known.nbytes + own.pieces.ids.nbytes + own.pieces.counts.nbytes <= 40_000
        assert ids.tolist() == [x for e in own.whole.encode_batch(texts, add_special_tokens=False) for x in e.ids]


def test_encoder_reads_its_file_once_for_each_worker():
    """Two tokenizers were read for each task; now a worker keeps them."""
    import public_tokenizers as P
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    a, b = tokenfiles.Encoder(path), tokenfiles.Encoder(path)
    assert a.plain is b.plain and a.pieces is not b.pieces
    whole = Tokenizer.from_file(path)
    odd = [None, "", "some words", *[f"some {t} words{t}" for t in a.added], "some words again"]
    for own in (a, b):
        ids, counts = own.encode(pa.array(odd, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [whole.encode(t or "", add_special_tokens=False).ids for t in odd]


def exchanges(df, *keys):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange" in x and all(k in x for k in keys) for x in plan.split("\n"))


def test_spans_are_dealt_once(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}." for k in range(40))) for i in range(2000)], "doc_id long, text string")
    assert exchanges(spans.repeated_spans(docs), "h1") == 1


def test_lines_keep_their_ranges(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"line {i} number {k}" for k in range(20))) for i in range(500)], "doc_id long, text string")
    bitmaps = lines.line_bitmaps(docs)
    assert exchanges(bitmaps, "rangepartitioning(h1") == 1 and exchanges(bitmaps, "hashpartitioning(h1") == 0


def test_line_dedup_of_long_documents(spark):
    rnd = random.Random(9)
    texts = {i: "\n".join(rnd.choice(["short", f"a longer line {rnd.randrange(60_000)}"]) for _ in range(60_000)) for i in range(3)}
    first = {}
    for i, t in texts.items():
        for x in t.split("\n"):
            first.setdefault(x, i)
    got = {r["doc_id"]: r["text"] for r in lines.line_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, t in texts.items():
        assert got[i] == "\n".join(x for x in t.split("\n") if len(x) < 10 or first[x] == i)


def test_columns_with_the_names_of_spans(spark):
    docs = spark.createDataFrame([(1, PASSAGE, 5, 6), (2, PASSAGE, 7, 8)], "doc_id long, text string, _sentences long, _removed long")
    got = {r["doc_id"]: r for r in spans.substring_dedup(docs).collect()}
    assert got[1]["text"] == PASSAGE and got[2]["text"] == "" and (got[2]["_sentences"], got[2]["_removed"]) == (7, 8)


def test_quality_fences_follow_the_sources(spark):
    """Two sources of unlike spread get unlike fences, and the same text passes in one only."""
    rnd = random.Random(2)
    rows = []
    for i in range(6000):
        source = "tidy" if i % 2 else "noisy"
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(120)]
        if source == "noisy":
            words[: rnd.randrange(40)] = ["#"] * 20
        rows.append((i, " ".join(words), "en", source))
    rows += [(9001, " ".join(["#"] * 14 + rows[1][1].split()[:100]), "en", "tidy"), (9002, " ".join(["#"] * 14 + rows[1][1].split()[:100]), "en", "noisy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs, weight=100).where("doc_id > 9000").collect()}
    assert got == {9001: False, 9002: True}
    counts = quality.text_counts(docs.withColumn("text_hash", F.xxhash64("text")), ["doc_id", "lang", "source", "text_hash"]).withColumn("base_failed", F.lit(False))
    fence = {r["_source"]: r for r in quality.limits(counts, quality.SPREAD, 100).collect()}
    assert fence["noisy"]["high_symbols"] > 2 * fence["tidy"]["high_symbols"]


def test_vectors_of_clashing_labels_and_repeated_ids(spark):
    assert zlib.crc32(b"599430bd25") == zlib.crc32(b"f7633dd321")
    rows = [(1, [1.0, 0.0, 0.0, 0.0], "599430bd25"), (2, [1.0, 0.01, 0.0, 0.0], "f7633dd321"), (3, [1.0, 0.0, 0.01, 0.0], "599430bd25"), (4, [1.0, 0.0], "f7633dd321"), (3, [1.0, 0.0, 0.01, 0.0], "599430bd25"), (3, [1.0, 0.0, 0.01, 0.0], "599430bd25")]
    got = [tuple(r) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()]
    assert sorted(got) == [(1, 1, 1, True), (2, 0, 2, True), *[(3, 1, 1, False)] * 3, (4, 0, 4, True)]


def test_documents_of_repeated_ids(spark):
    words = [f"w{i}" for i in range(100)]
    a, b = " ".join(words), " ".join([*words[:50], "x", *words[51:]])
    rows = [(1, a), (2, b), (2, b), (2, b), (3, "one other text"), (4, a), (4, "quite another text here"), (5, "")]
    got = sorted(tuple(r) for r in ngramjoin.ngram_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert len(got) == 8 and got[:4] == [(1, 1, got[0][2]), *[(2, 1, got[1][2])] * 3] and got[-1] == (5, 5, 0)
    same_text = [tuple(r) for r in ngramjoin.ngram_groups(spark.createDataFrame([(1, a), (2, b), (2, b), (2, b)], "doc_id long, text string")).collect()]
    assert sorted(same_text) == [(1, 1, 1), (2, 1, 1), (2, 1, 1), (2, 1, 1)]


def test_importance_weights_equal_brute_force(spark):
    rnd = random.Random(8)
    texts = {i: " ".join(rnd.choice("ab cd ef gh ij kl mn".split()) for _ in range(rnd.randint(0, 30))) for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in resampling.importance_sample(docs, spark.range(0, 40).toDF("doc_id"), 0.3, buckets=256).collect()}
    import pyarrow as pa

    grams = {i: [int(b) for w in textops.word_chunks(pa.array([t])) for b in resampling.features(w, 256)[1]] for i, t in texts.items()}
    assert all(len(g) == max(0, 2 * len(texts[i].split()) - 1) for i, g in grams.items())
    raw, target = np.bincount(sum(grams.values(), []), minlength=256), np.bincount(sum((grams[i] for i in range(40)), []), minlength=256)
    for i, g in grams.items():
        want = sum(np.log((target[b] + 1) / (target.sum() + 256)) - np.log((raw[b] + 1) / (raw.sum() + 256)) for b in g)
        assert got[i]["log_weight"] == pytest.approx(want)
    largest = sorted(texts, key=lambda i: -got[i]["key"])[:90]
    assert {i for i, r in got.items() if r["kept"]} == set(largest)
    noise = np.array([r["key"] - r["log_weight"] for r in got.values()])
    assert abs(noise.mean() - 0.5772) < 0.3 and abs(noise.std() - np.pi / 6**0.5) < 0.3


def test_flow_is_the_cheapest_of_the_largest():
    from itertools import product

    rnd = random.Random(1)
    for _ in range(40):
        supply = [rnd.randint(0, 2) for _ in range(3)]
        members = [sorted(rnd.sample([0, 1], rnd.randint(1, 2))) for _ in range(3)]
        quota = [rnd.randint(0, 4), rnd.randint(0, 4)]
        best = (0, 0)
        arcs = [(p, s) for p in range(3) for s in members[p]]
        for x in product(*(range(2 * supply[p] + 1) for p, _ in arcs)):
            used = [sum(v for v, (p, _) in zip(x, arcs, strict=True) if p == q) for q in range(3)]
            filled = [sum(v for v, (_, s) in zip(x, arcs, strict=True) if s == t) for t in range(2)]
            if all(u <= 2 * c for u, c in zip(used, supply, strict=True)) and all(f <= q for f, q in zip(filled, quota, strict=True)):
                best = max(best, (sum(x), -sum(max(0, u - c) for u, c in zip(used, supply, strict=True))))
        flow = mixing.min_cost_flow(supply, members, quota, 2)
        steps = [[sum(step.values()) for step in p] for p in flow]
        assert (sum(map(sum, steps)), -sum(s[1] for s in steps)) == best
        assert all(s[0] <= c and s[1] <= c for s, c in zip(steps, supply, strict=True))


@pytest.mark.parametrize("weighted", [True, False])
def test_toxicity_equals_brute_force(spark, weighted):
    """Scores and neighbours by dense cosines over all terms of the whole texts."""
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 9))) for _ in range(80)]
    rows = []
    for i in range(160):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 40))]
        rows.append((i, " ".join(w.capitalize() if rnd.random() < 0.1 else w for w in words + ["nastyword"] * (i % 5 == 0 and i % 10 > 0) + ["nastier"] * (i % 15 == 0))))
    rows += [(200, None), (201, "")]
    truth = {i: int(i % 5 == 0) for i in range(120)}

    def terms(text):
        out = defaultdict(int)
        for w in re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower()):
            for n in (None, 4, 5, 6):
                if n is None or len(w) > n:
                    out[n, w[:n]] += 1
        return out

    bags = {i: terms(t) for i, t in rows}
    text_of = dict(rows)
    examples = sorted({text_of[i]: i for i in sorted(truth, reverse=True)}.values(), key=lambda i: (-truth[i], str(i)))
    rate = sum(truth[i] for i in examples) / len(examples)
    d, a, df = defaultdict(int), defaultdict(int), defaultdict(int)
    for i in examples:
        for t in bags[i]:
            d[t] += 1
            a[t] += truth[i]
    for bag in bags.values():
        for t in bag:
            df[t] += 1
    gain = {t: ((a[t] + 8 * rate) / (d[t] + 8) - rate) / (1 - rate) if weighted else 1.0 for t in d}
    weight = {t: (np.log((len(rows) + 1) / (df[t] + 1)) + 1) * g for t, g in gain.items() if g > 1e-9}

    def vector(bag):
        x = {t: (1 + np.log(n)) * weight[t] for t, n in bag.items() if t in weight}
        norm = sum(v * v for v in x.values()) ** 0.5
        return {t: v / norm for t, v in x.items()}

    known = {i: v for i in examples if (v := vector(bags[i]))}

    def vote(x, without=None):
        near = sorted(((-round(c, 9), k) for k, i in enumerate(known) if i != without and (c := sum(v * known[i].get(t, 0) for t, v in x.items())) > 0))[:25]
        w = [c * c / (0.05 + max(0, 1 - c)) for c in (-c for c, _ in near)]
        return (sum(u * truth[list(known)[k]] for u, (_, k) in zip(w, near, strict=True)) + rate) / (sum(w) + 1), [list(known)[k] for _, k in near[:3]]

    cuts, steps = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.8, 0.9, 0.95]), np.array([0, 1, 0, 1, 1, 0.5]), 0.5)
    assert cuts == pytest.approx([0.15, 0.55, 0.95]) and steps == pytest.approx([0.25, 0.5, 0.75])  # halfway between steps
    ends, means = toxicity.isotonic(np.array([vote(v, i)[0] for i, v in known.items()]), np.array([truth[i] for i in known], float), rate)
    bare = [truth[i] for i in examples if i not in known]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, spark.createDataFrame(list(truth.items()), "doc_id long, toxic int"), weighted=weighted).collect()}
    for i, bag in bags.items():
        if x := vector(bag):
            raw, near = vote(x)
            at = int(np.argmin(np.abs(ends - raw))) if np.abs(ends - raw).min() < 1e-7 else min(int(np.searchsorted(ends, raw)), len(means) - 1)
            assert got[i]["score"] == pytest.approx(means[at]), i
            assert [e["cosine"] for e in got[i]["evidence"]] == pytest.approx([sum(v * known[n].get(t, 0) for t, v in x.items()) for n in near])
        else:
            assert got[i]["score"] == pytest.approx((sum(bare) + rate) / (len(bare) + 1)) and not got[i]["evidence"]


def test_pipeline_on_planted_cases(spark, tmp_path):
    import public_tokenizers as P
    import tiktoken

    rnd = random.Random(12)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 7))) for _ in range(n))
    texts = {i: prose(60) for i in range(40)}
    for i in range(0, 40, 4):
        texts[i] += " vileslur"
    words = texts[5].split()
    texts |= {50: " ".join([*words[:30], "changed", *words[31:]]), 51: "A footer line that repeats\n" + prose(40), 52: prose(40) + "\na footer line that repeats ", 53: texts[7], 54: ""}
    spark.createDataFrame([(i, t, "en", "one", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    left = {i: t for i, t in texts.items() if i >= 40 or i % 4}
    left[52] = left[52].split("\n")[0]
    left[53] = ""  # its one line is that of 7
    del left[50]
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(ranks_path()), special_tokens={})
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    times = defaultdict(int)
    for r in got:
        assert r["ids"] == own.encode_ordinary(left[r["doc_id"]])
        times[r["doc_id"]] += 1
    sizes = {i: len(t.split()) for i, t in left.items()}
    assert all(n <= 2 for n in times.values()) and abs(sum(sizes[i] * n for i, n in times.items()) - 1.5 * sum(sizes.values())) <= 60
    assert {i for i, s in sizes.items() if s} == set(times)
