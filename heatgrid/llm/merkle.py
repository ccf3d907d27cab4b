"""A Merkle manifest of a table, kept as postorder append logs.

Rows are leaves of one tree for each value of a column, and the trees' roots, in that column's order, are the leaves of the
tree above them. Builders take aligned blocks of SPAN consecutive leaves and append every node at the moment it is
complete: a leaf, then each run of two that it ends; the last block of a tree also ends the runs of one. The roots of the
blocks are the leaves of the next round, until a tree is one block. A node's place in its log follows from subtree sizes
alone (``place``), so proofs read siblings at computed places of fixed-size records, without keys or searches.

``build_manifest`` writes the logs, ``proofs`` reads them: each leaf's steps (sibling and its side) to the root;
``proof_digest`` and ``fold`` are columns over steps. Ranks come from a range sort with counts by partition. Lost tasks
write their part of a log again; nothing is sorted or held whole.

Cases: nulls count as ``-`` and empty texts as ``0:``; a null in the tree column is a tree of its own, first; null ids are
first in their tree; equal ids go by their hash, and equal rows are equal leaves side by side, dealt over tasks like
others; a tree of one leaf is that leaf; an empty table gives no row; columns that aren't named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from heatgrid.llm.blocks import groups
from heatgrid.llm.store import remove, written

BITS = 9
SPAN = 1 << BITS  # 2 * SPAN nodes of a block are in a task's memory at once
STEPS = "array<struct<left:boolean,digest:string>>"


def leaf_hash(*fields: Column) -> Column:
    """Hash of fields, each ``-`` or its length in bytes, a colon and the value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]).cast("binary"), 256)


def levels(n: int) -> int:
    """Levels above n leaves."""
    return max(0, n - 1).bit_length()


def log_nodes(leaves: list[str], top: int) -> list[str]:
    """All nodes over some leaves up to level ``top``, in the order in which they are complete."""
    out, last = [], [""] * (top + 1)
    for i, node in enumerate(leaves):
        out.append(node)
        ends, h = i == len(leaves) - 1, 0  # the last leaf also ends the runs of one
        while h < top and (i & 1 or ends):
            node = hashlib.sha256(((last[h] if i & 1 else "") + node).encode()).hexdigest()
            out.append(node)
            i, h = i >> 1, h + 1
        last[h] = node
    return out


def place(level: np.ndarray | int, index: np.ndarray | int, n: int) -> np.ndarray:
    """Places in a log of n leaves of nodes, from subtree sizes: before a subtree that begins at leaf s there are 2 s less
    the ones of s in binary, and its root comes last in it."""
    level, index = np.broadcast_arrays(np.asarray(level, np.int64), np.asarray(index, np.int64))
    s = index << level
    under = np.minimum(n - s, 1 << level)
    size = np.zeros(s.shape, np.int64)
    for h in range(int(level.max(initial=0)) + 1):
        size += np.where(h <= level, -(-under >> h), 0)
    return 2 * s - np.bitwise_count(s).astype(np.int64) + size - 1


class Manifest(NamedTuple):
    """logs: tables (tree, block, m, n, top, nodes) of the rounds over the rows; above: those over the trees' roots."""

    logs: list[DataFrame]
    above: list[DataFrame]
    payload: list[tuple[str, str]]


def _ordered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` written in order, with _part and _k, the number of rows before each one in its part."""
    dealt = rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)  # equal rows are dealt out, too
    return written(dealt.withColumns({"_part": F.spark_partition_id(), "_k": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), name)


def _build(rows: DataFrame, payload: list[tuple[str, str]], name: str) -> DataFrame:
    """The log of each aligned block of (tree, m, i, digest): leaf i of m, with the payload of its leaves as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 2):
            m, n = t.column("m")[0].as_py(), t.num_rows
            top = levels(m) if m <= SPAN else BITS
            nodes = bytes.fromhex("".join(log_nodes(t.column("digest").to_pylist(), top)))
            cols = {"tree": t.column("tree")[:1], "block": t.column("block")[:1], "m": t.column("m")[:1], "n": pa.array([n], pa.int32()), "top": pa.array([top], pa.int32()), "nodes": pa.array([nodes], pa.binary())}
            for c, _ in payload:
                v = t.column(c).combine_chunks()
                cols[c] = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), v.chunk(0) if isinstance(v, pa.ChunkedArray) else v)
            yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in cols.values()], names=list(cols))

    kept = [c for c, _ in payload]
    dealt = rows.select("tree", F.expr(f"i div {SPAN}").alias("block"), "i", "m", "digest", *kept).repartition("tree", "block").sortWithinPartitions("tree", "block", "i")
    return written(dealt.mapInArrow(run, "tree bigint, block bigint, m bigint, n int, top int, nodes binary" + "".join(f", `{c}` array<{k}>" for c, k in payload)), name)


def _rounds(rows: DataFrame, most: int, payload: list[tuple[str, str]], name: str) -> list[DataFrame]:
    """Logs over (tree, m, i, digest) round by round; ``most`` is the largest m."""
    logs = [_build(rows, payload, name)]
    while most > SPAN:
        most = -(-most // SPAN)
        logs.append(_build(logs[-1].select("tree", F.col("block").alias("i"), F.expr(f"(m + {SPAN - 1}) div {SPAN}").alias("m"), _root()), [], name))
    return logs


def _root() -> Column:
    return F.lower(F.hex(F.substring("nodes", -32, 32))).alias("digest")


def build_manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", tree_col: str = "lang", claim: Column | None = None) -> Manifest:
    """Logs over all rows. ``claim``: a leaf hash that ``proofs`` hands on for verification, null for the row's own."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(tree_col).alias("_tree"), F.col(id_col).alias("_id"), leaf_hash(*[F.col(f) for f in fields]).alias("digest"), (F.lit(None).cast("string") if claim is None else claim).alias("_claim"))
    rows = _ordered(rows, ["_tree", "_id", "digest"], "leaves")
    spans = written(rows.groupBy("_part", "_tree").agg(F.count("*").alias("n"), F.min("_k").alias("_k0")), "leaf-spans")  # one for each part, and for each tree's end
    trees = _ordered(spans.groupBy("_tree").agg(F.sum("n").alias("m")), ["_tree"], "trees")
    parts = trees.groupBy("_part").agg(F.count("*").alias("n"))
    before = parts.select("_part", (F.sum("n").over(W.orderBy("_part")) - F.col("n")).alias("_before"))  # a row for each part
    trees = written(trees.join(before, "_part").select("_tree", "m", (F.col("_before") + F.col("_k")).alias("tree")), "trees")
    at = spans.join(trees.withColumnRenamed("_tree", "_t"), F.col("_tree").eqNullSafe(F.col("_t"))).drop("_t")
    at = at.withColumn("_start", F.sum("n").over(W.partitionBy("tree").orderBy("_part")) - F.col("n") - F.col("_k0"))
    at = at.select(F.col("_part").alias("_p"), F.col("_tree").alias("_t"), "tree", "m", "_start")
    placed = rows.join(at, (F.col("_part") == F.col("_p")) & F.col("_tree").eqNullSafe(F.col("_t"))).withColumn("i", F.col("_start") + F.col("_k"))
    payload = [("_id", kind), ("_claim", "string")]
    sizes = trees.agg(F.coalesce(F.max("m"), F.lit(0)).alias("m"), F.count("*").alias("n")).first()
    logs = _rounds(placed, sizes["m"], payload, "tree-log")
    remove(rows, spans)
    roots = logs[-1].select(F.col("tree").alias("i"), _root()).withColumns({"tree": F.lit(0).cast("bigint"), "m": F.lit(sizes["n"]).cast("bigint")})
    above = _rounds(roots, sizes["n"], [], "root-log")
    remove(trees)
    return Manifest(logs, above, [(id_col, kind), ("claim", "string")])


def _expand(log: DataFrame, up: DataFrame, payload: list[tuple[str, str]]) -> DataFrame:
    """Each leaf of a log (tree, i, digest) with its steps, followed by those of its block in ``up``."""
    kept = [c for c in log.columns if c not in ("tree", "block", "m", "n", "top", "nodes")]
    both = log.join(up, ["tree", "block"]).select("tree", "block", "n", "top", "nodes", "subroot", "root", "steps", *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                tree, block, n, top, nodes, subroot, root, steps = (b.column(k)[r].as_py() for k in range(8))
                hexes = np.frombuffer(nodes.hex().encode(), "S64")
                leaf, level = np.arange(n)[:, None], np.arange(top)[None, :]
                index = leaf >> level
                other = index ^ 1
                there = other << level < n
                own = hexes[place(level, np.where(there, other, 0), n)]
                size = top + len(steps)
                left, full, digest = np.zeros((n, size), bool), np.zeros((n, size), bool), np.zeros((n, size), "S64")
                left[:, :top], full[:, :top], digest[:, :top] = (index & 1) == 1, there, own
                for k, s in enumerate(steps):
                    left[:, top + k], full[:, top + k], digest[:, top + k] = s["left"], bool(s["digest"]), s["digest"].encode()
                off = np.r_[0, np.cumsum(np.where(full.ravel(), 64, 0))].astype(np.int32)
                text = pa.StringArray.from_buffers(n * size, pa.py_buffer(off), pa.py_buffer(digest.ravel()[full.ravel()].tobytes()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), pa.StructArray.from_arrays([pa.array(left.ravel()), text], ["left", "digest"]))
                leaves = hexes[place(0, np.arange(n), n)]
                own_leaf = pa.array(leaves.astype("U64"))
                cols = [pa.array(np.full(n, tree)), pa.array(block * SPAN + np.arange(n)), own_leaf, pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string()), lists]
                cols += [b.column(8 + k).slice(r, 1).flatten() for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays(cols, names=["tree", "i", "leaf", "subroot", "root", "steps", *kept])

    return both.mapInArrow(run, f"tree bigint, i bigint, leaf string, subroot string, root string, steps {STEPS}" + "".join(f", `{c}` {k}" for c, k in zip(kept, [k for _, k in payload], strict=False)))


def proofs(manifest: Manifest) -> DataFrame:
    """(id, claim, leaf, subroot, root, steps) of every leaf: steps lead from the leaf by its tree's root to the root."""
    up = manifest.above[-1].select("tree", "block", F.lit(None).cast("string").alias("subroot"), _root().alias("root"), F.array().cast(STEPS).alias("steps"))
    for log in reversed(manifest.above):
        up = _expand(log, up, []).select("tree", F.col("i").alias("block"), F.col("leaf").alias("subroot"), "root", "steps")
    up = up.select(F.col("block").alias("tree"), F.lit(0).cast("bigint").alias("block"), "subroot", "root", "steps")
    for log in reversed(manifest.logs[1:]):
        up = _expand(log, up, []).select("tree", F.col("i").alias("block"), "subroot", "root", "steps")
    out = _expand(manifest.logs[0], up, manifest.payload)
    (id_col, _), _ = manifest.payload
    return out.select(F.col("_id").alias(id_col), F.col("_claim").alias("claim"), "leaf", "subroot", "root", "steps")


def proof_digest(steps: Column) -> Column:
    """Hash of a proof's siblings, from the leaf up."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: s["digest"]), "").cast("binary"), 256)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its steps give."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.when(s["left"], F.concat(s["digest"], h)).otherwise(F.concat(h, s["digest"])).cast("binary"), 256))
