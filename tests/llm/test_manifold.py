"""Whitening, packing and Merkle manifests against brute force, on given and awkward rows."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from compare import SF
from pyspark.sql import functions as F

from heatgrid.llm import merkle, packing, whitening
from heatgrid.llm.queries import op11_whitening, op12_packing
from test_llm import awkward, sf, texts_of  # noqa: F401


def whitened_rows(rows, components=4, counted=False):
    """(id, component) -> (n, deviation, whitened, explained), by plain sums over the fit list."""
    good = [(i, tuple(math.floor(256 * float(c)) for c in e)) for i, e in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    out = {}
    for d in {len(x) for _, x in good} - {0}:
        own = [(i, x) for i, x in good if len(x) == d]
        vectors = sorted(x for _, x in own) if counted else sorted({x for _, x in own})
        n, sums = len(vectors), [sum(c) for c in zip(*vectors, strict=True)]
        mean = np.array([s / n for s in sums])
        away = np.array(vectors, float) - mean
        e, u = np.linalg.eigh(away.T @ away / n)
        e, u = e[::-1], u[:, ::-1]
        for i, x in own:
            dev = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            for k in range(min(components, d)):
                z = float((np.array(x) - mean) @ u[:, k] / np.sqrt(e[k])) if e[k] > 1e-12 * max(e[0], 0) else None
                out[i, k + 1] = (n, dev if dev < 1 << 63 else None, z, e[k] / e.sum() if e.sum() > 0 else None)
    return out


def same_whitening(got, want):
    assert {(r[0], r["component"]) for r in got} == set(want) and len(got) == len(want)
    sign = {}
    for r in got:
        n, dev, z, part = want[r[0], r["component"]]
        assert (r["n"], r["deviation"]) == (n, dev)
        assert (z is None) == (r["whitened"] is None) and (r["explained"] is None) == (part is None)
        if z is not None:
            if abs(z) > 1e-6:
                sign.setdefault((n, r["component"]), np.sign(z * r["whitened"]))
            assert abs(sign.get((n, r["component"]), 1) * r["whitened"] - z) < 1e-7 * max(1, abs(z))
            assert abs(r["explained"] - part) < 1e-9
            assert r["identity_error"] < 1e-9


@pytest.mark.parametrize("where", ["given", "awkward"])
def test_whitening_equals_brute_force(spark, sf, where):  # noqa: F811
    path = SF if where == "given" else f"file://{sf}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    same_whitening(op11_whitening(spark, path).collect(), whitened_rows(rows))


def test_whitening_of_hot_huge_and_single_vectors(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, [0.5, -0.25, 1.0]) for i in range(3000)] + [(i, rnd.normal(size=3).tolist()) for i in range(3000, 4000)] + [(None, [1.0, 2.0, 3.0])] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "h": F.lit("a"), "d": F.lit(None)})
    counted = whitening.whitened(df.where("vec_id IS NOT NULL"), multiplicity=True, components=2)
    same_whitening(counted.collect(), whitened_rows([r for r in rows if r[0] is not None], 2, True))
    assert whitening.whitened(df).where("vec_id IS NULL").count() == 6
    big = [(0, [1e15, 2.0]), (1, [-1e15, 3.0]), (2, [5.0]), (3, [5.0])]
    got = whitening.whitened(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(0, None), (1, None), (2, 0), (3, 0)}
    assert all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in got if r["vec_id"] > 1)


def pieces_hold(got, ids, capacity=2048):
    """Every id in one piece, sequences gapless and padded by nothing; how many documents are cut where they need not be."""
    texts, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        texts[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(texts) == set(ids)
    for parts, most in [(p, None) for p in texts.values()] + [(p, capacity) for p in sequences.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert most is None or at == most or at < most and not at & (at - 1)
    assert all(sum(n for _, n in texts[d]) == len(x) for d, x in ids.items())
    return sum(len(texts[d]) > -(-len(x) // capacity) for d, x in ids.items())


@pytest.mark.parametrize("where", ["given", "awkward"])
def test_packing_holds_every_id_once(spark, sf, where):  # noqa: F811
    import public_tokenizers
    from tokenizers import Tokenizer

    path = SF if where == "given" else f"file://{sf}"
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts_of(spark, path).items()}
    got = op12_packing(spark, path).collect()
    assert pieces_hold(got, ids) <= 0.2 * len(ids)
    with_ids = packing.pack(spark.read.parquet(f"{path}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), 1).collect()
    for r in with_ids:
        assert r["ids"] == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tolist()


@pytest.mark.parametrize("lengths", [[1] * 3000, [1100] * 300, [2047, 1] * 200, [2048] * 50, [5], [700, 700, 650] * 100 + [1] * 40, list(range(1, 4000, 7))])
def test_pieces_of_given_lengths(spark, lengths):
    items = spark.createDataFrame(list(enumerate(lengths)), "key long, n long").withColumn("h", F.lit(7).cast("long"))
    got = packing.place_pieces(items, 2048).withColumns({"doc_id": F.col("key"), "doc_tokens": F.lit(0)}).collect()
    ids = {i: np.arange(n, dtype="<u4") for i, n in enumerate(lengths)}
    got = [r.asDict() | {"doc_tokens": lengths[r["key"]], "ids_crc32": zlib.crc32(ids[r["key"]][r["start"] : r["start"] + r["length"]].tobytes())} for r in got]
    pieces_hold(got, ids)
    assert len({r["sequence_id"] for r in got}) <= -(-sum(lengths) // 2048) + 11


def test_columns_are_generated_to_the_fewest_sequences():
    for classes, demand, fewest in (([3, 5], [40, 40], 100 / 3), ([4, 5, 7], [30, 20, 10], 35.0), ([6], [7], 7.0), ([1, 9], [10, 10], 10.0)):
        columns, x = packing.column_generation(np.array(classes), np.array(demand, float), 10)
        assert ((columns * np.array(classes)[:, None]).sum(0) <= 10).all()
        assert np.allclose((columns * x).sum(1), demand, atol=1e-3)
        assert abs(x.sum() - fewest) < 1e-2
    worth, pattern = packing.price(np.array([3, 5]), np.array([0.31, 0.5]), 10)
    assert worth == pytest.approx(1.0) and pattern.tolist() == [0, 2]
    a = np.random.default_rng(1).random((9, 9))
    assert np.allclose(packing.inverted(a) @ a, np.eye(9))


def test_plan_fills_its_gaps():
    rnd = np.random.default_rng(3)
    for n in (10, 1000, 100_000):
        histogram = {int(c): int(k) for c, k in zip(*np.unique(rnd.integers(1, 129, n), return_counts=True), strict=True)}
        plan = packing.plan_patterns(histogram, 128, 2048, 16)
        used = defaultdict(int, plan.left)
        for items, times in plan.patterns:
            assert sum(c * a for c, a in items.items()) <= 128
            for c, a in items.items():
                used[c] += a * times
        assert used == histogram
        gaps = sum(times * (2048 - sum(a * ((c - 1) * 16 + 1) for c, a in items.items())) for items, times in plan.patterns)
        assert gaps <= sum(k * ((c - 1) * 16 + 1) for c, k in plan.left.items())
        assert n < 1000 or sum(plan.left.values()) < 0.2 * n


def plain_log(n):
    """(level, index) of the nodes over n leaves in postorder, by recursion."""
    top = merkle.levels(n)

    def walk(level, index):
        if index << level >= n:
            return []
        return (walk(level - 1, 2 * index) + walk(level - 1, 2 * index + 1) if level else []) + [(level, index)]

    return walk(top, 0)


def test_places_in_a_log():
    for n in [*range(1, 70), 255, 256, 257, 511, 512]:
        order = plain_log(n)
        assert [int(merkle.place(level, index, n)) for level, index in order] == list(range(len(order)))
        nodes = merkle.log_nodes([hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)], merkle.levels(n))
        assert len(nodes) == len(order)
        at = dict(zip(order, nodes, strict=True))
        for (level, index), node in at.items():
            if level:
                below = at[level - 1, 2 * index] + at.get((level - 1, 2 * index + 1), "")
                assert node == hashlib.sha256(below.encode()).hexdigest()


def test_manifest_of_several_rounds(spark, monkeypatch):
    """Blocks of four leaves, repeated and null ids, a hot tree, many small trees: every proof leads to the root, changed rows don't."""
    monkeypatch.setattr(merkle, "BITS", 2)
    monkeypatch.setattr(merkle, "SPAN", 4)
    docs = [(i % 90 if i % 11 else None, "t" * (i % 5), "hot" if i % 3 else f"tree{i}") for i in range(180)] + [(1, "same", "hot")] * 30 + [(5, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"tree": F.lit("x"), "m": F.lit(1), "digest": F.lit(None)})
    fields = ["doc_id", "text", "lang"]
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    trees = defaultdict(list)
    for d, t, lang in docs:
        trees[lang].append((d is not None, d or 0, h("".join("-" if v is None else f"{len(str(v))}:{v}" for v in (d, t, lang)))))

    def root(nodes):
        while len(nodes) > 1:
            nodes = [h("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        return nodes[0]

    subs = {k: root([x[2] for x in sorted(v)]) for k, v in trees.items()}
    whole = root([subs[k] for k in sorted(subs, key=lambda k: (k is not None, k or ""))])
    bad = F.when(F.col("doc_id") == 7, F.lit("0" * 64))
    got = merkle.proofs(merkle.build_manifest(df, fields, claim=bad)).select("*", merkle.fold(F.coalesce("claim", "leaf"), F.col("steps")).alias("folded")).collect()
    assert sorted(r["leaf"] for r in got) == sorted(x[2] for v in trees.values() for x in v)
    assert {r["root"] for r in got} == {whole} and {r["subroot"] for r in got} == set(subs.values())
    assert all((r["folded"] == whole) == (r["claim"] is None) for r in got)
    assert sum(r["claim"] is not None for r in got) == sum(d == 7 for d, *_ in docs)


def test_awkward_documents_in_the_manifest(spark):
    docs = awkward(spark).unionByName(awkward(spark).limit(5))
    got = merkle.proofs(merkle.build_manifest(docs, ["doc_id", "text"], tree_col="source"))
    assert got.count() == docs.count() and got.select(merkle.fold(F.col("leaf"), F.col("steps"))).distinct().count() == 1
