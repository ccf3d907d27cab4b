"""Packing documents into sequences of a fixed number of tokens by column generation.

A document's whole sequences are cut off first; what is left of it, shorter than a sequence, is an item. A histogram of item
lengths in BINS classes goes to the driver, whatever the number of documents. There a linear program says how often to
use which pattern (how many items of each class share a sequence); a knapsack over the classes prices new patterns by
dynamic programming until none is worth its sequence. Values are rounded down, then up where items suffice, and what is
left is solved again. Items are ranked within their class, and a rank says which sequence and slot an item takes.

Items without a slot are laid end to end and cut to the gaps that patterns leave, then to whole sequences; the last tokens
make sequences of powers of two, which need no padding. So many patterns are taken apart as it takes for the gaps to be
filled, by bounds that the classes give; nothing is padded at all, and only those items are cut.

Ranks and places on the line are running sums in two levels (buckets of about BUCKET_ROWS rows by hash), so no task holds
a class. Token ids are written once and meet their pieces by one join.

Cases: null and empty texts are the end id alone; equal and null ids are documents of their own; a document of any length
is whole over its pieces; extra columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from heatgrid.llm.pieces import freeing, text_slices
from heatgrid.llm.store import remove, written
from heatgrid.llm.tokenfiles import SLICE_BYTES, Encoder

BINS = 128
BUCKET_ROWS = 10_000
BLOCK = 256


def price(classes: np.ndarray, values: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """The dearest pattern of classes (their sizes, rising) that fits into ``units``, and its value."""
    best, choice = np.zeros(units + 1), np.full(units + 1, -1)
    for c in range(1, units + 1):
        best[c] = best[c - 1]
        fit = int(np.searchsorted(classes, c, "right"))
        if fit:
            with_one = best[c - classes[:fit]] + values[:fit]
            k = int(with_one.argmax())
            if with_one[k] > best[c]:
                best[c], choice[c] = with_one[k], k
    pattern, c = np.zeros(len(classes)), units
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= int(classes[choice[c]])
    return float(best[units]), pattern


def inverted(a: np.ndarray) -> np.ndarray:
    """Inverse by elimination with row pivots, in plain array arithmetic: a threaded matrix library can stand still in a driver that started its JVM first."""
    n = len(a)
    both = np.hstack([a.astype(float), np.eye(n)])
    for k in range(n):
        p = k + int(np.abs(both[k:, k]).argmax())
        both[[k, p]] = both[[p, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= factor[:, None] * both[k]
    return both[:, n:]


def column_generation(classes: np.ndarray, demand: np.ndarray, units: int, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Patterns as columns and how often each is used: the fewest sequences, in fractions, that hold ``demand`` (all above 0).

    Ends when no pattern is worth more than its sequence, or when the bound that prices give is within ``tolerance``."""
    m = len(classes)
    demand = demand + 1e-5 * np.arange(1, m + 1) / m  # unlike sizes, so that steps aren't 0
    basis = np.diag(np.floor(units / classes))
    inverse, x = np.diag(1 / np.diag(basis)), demand / np.diag(basis)
    least, idle, pivots = x.sum(), 0, 0
    while idle < 4 * m:  # ties can stand still for a while
        values = inverse.sum(0)
        worth, pattern = price(classes, values, units)
        if worth <= 1 + 1e-9 or x.sum() * (1 - tolerance) <= (values * demand).sum() / worth:
            break
        along = (inverse * pattern).sum(1)
        ratio = np.where(along > 1e-9, x / np.where(along > 1e-9, along, 1), np.inf)
        out = int(np.lexsort((-along, ratio))[0])
        step = max(0.0, float(ratio[out]))
        basis[:, out] = pattern
        pivots += 1
        if pivots % 64:
            inverse[out] /= along[out]
            others = np.arange(m) != out
            inverse[others] -= np.outer(along[others], inverse[out])
            x = x - step * along
            x[out] = step
        else:  # rounding doesn't add up
            inverse = inverted(basis)
            x = (inverse * demand).sum(1)
        x = np.maximum(x, 0)
        idle = 0 if x.sum() < least * (1 - tolerance / 100) else idle + 1
        least = min(least, x.sum())
    return basis, x


class Plan(NamedTuple):
    """patterns: ({class: items}, sequences) of each; left: items of each class that have no slot."""

    patterns: list[tuple[dict[int, int], int]]
    left: dict[int, int]


def plan_patterns(histogram: dict[int, int], units: int, capacity: int, granule: int) -> Plan:
    """Rounded patterns for items by class; class c has lengths above (c - 1) * granule. Those without a slot are sure to fill all gaps."""
    left, patterns = {c: n for c, n in histogram.items() if n}, []
    while left:
        classes = np.array(sorted(left))
        columns, x = column_generation(classes, np.array([left[c] for c in classes.tolist()], float), units)
        taken = 0
        for extra in (False, True):
            for k in np.argsort(-x, kind="stable").tolist():
                items = {int(c): int(a) for c, a in zip(classes, columns[:, k], strict=True) if a}
                most = min(left.get(c, 0) // a for c, a in items.items())
                times = min(most, int(x[k] + 1e-4)) if not extra else min(most, int(x[k] % 1 > 1e-4))
                if times > 0:
                    patterns.append((items, times))
                    taken += times
                    for c, a in items.items():
                        left[c] -= a * times
        left = {c: n for c, n in left.items() if n}
        if not taken:
            break
    least = lambda items: sum(a * ((c - 1) * granule + 1) for c, a in items.items())
    missing = sum(n * (capacity - least(items)) for items, n in patterns) - least(left)
    apart = max(0, -(-missing // capacity))  # one sequence taken apart is worth a capacity: a gap less and items more
    kept = []
    for items, n in sorted(patterns, key=lambda p: least(p[0])):
        k = min(n, apart)
        apart -= k
        for c, a in items.items():
            left[c] = left.get(c, 0) + a * k
        if n > k:
            kept.append((items, n - k))
    return Plan(kept, {c: n for c, n in left.items() if n})


def running(rows: DataFrame, value: Column, out: str, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``out``, the sum of ``value`` over the rows before, in the order of a hash of (h, key), within ``by``; ``n``: about how many rows there are."""
    dealt = rows.withColumn("_v", value).withColumn("_b", F.pmod(F.xxhash64("h", "key"), F.lit(max(1, -(-n // BUCKET_ROWS)))))
    sums = dealt.groupBy(*by, "_b").agg(F.sum("_v").alias("_s"))
    before = sums.select(*by, "_b", (F.sum("_s").over(W.partitionBy(*by).orderBy("_b")) - F.col("_s")).alias("_before"))  # a row for each bucket
    upto = F.sum("_v").over(W.partitionBy(*by, "_b").orderBy("h", "key").rowsBetween(W.unboundedPreceding, 0)) - F.col("_v")
    return dealt.join(before, [*by, "_b"]).withColumn(out, F.col("_before") + upto).drop("_v", "_b", "_before")


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(key, id, n, ids) of each document, written: its ids and ``end_id`` as little-endian integers of 2 bytes, or 4 where ids need it."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(tokenizer_path)
        kind = np.dtype(id_type(own, end_id))
        for b in text_slices(batches, SLICE_BYTES):
            ids, counts = own.encode(b.column(2))
            ids = np.insert(ids, np.cumsum(counts), end_id).astype(kind)
            off = np.r_[0, np.cumsum(counts + 1)] * kind.itemsize
            blobs = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts + 1), pa.array(np.full(len(counts), kind.itemsize, np.int32)), blobs], names=["key", "id", "n", "width", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(run, f"key bigint, id {docs.schema[id_col].dataType.simpleString()}, n bigint, width int, ids binary"), "tokens")


def id_type(own: Encoder, end_id: int) -> str:
    return "<u2" if max(len(own.sizes), end_id + 1) <= 1 << 16 else "<u4"


def place_pieces(items: DataFrame, capacity: int, bins: int = BINS) -> DataFrame:
    """(key, start, length, sequence_id, offset) of every piece of (key, h, n): documents of n tokens, ordered by h and key."""
    spark = items.sparkSession
    granule = -(-capacity // bins)
    units = capacity // granule
    rows = items.withColumns({"full": F.expr(f"n div {capacity}"), "rem": F.col("n") % capacity}).withColumn("bin", F.least(F.lit(units), F.expr(f"(rem + {granule - 1}) div {granule}").cast("int")))
    found = rows.groupBy("bin").agg(F.count("*").alias("n"), F.sum("full").alias("full")).collect()  # bins + 1 rows
    histogram = {r["bin"]: r["n"] for r in found if r["bin"]}
    total, cut = sum(histogram.values()), sum(r["full"] for r in found)
    plan = plan_patterns(histogram, units, capacity, granule)
    slots: dict[int, list[tuple[int, int, int, int, int]]] = {}
    sequences = 0
    for items_, n in plan.patterns:
        slot = 0
        for c, a in sorted(items_.items(), reverse=True):
            first = slots[c][-1][1] if c in slots else 0
            slots.setdefault(c, []).append((first, first + a * n, a, sequences, slot))
            slot += a
        sequences += n
    table = F.broadcast(spark.createDataFrame(list(slots.items()), "bin int, slots array<struct<first:bigint,last:bigint,each:bigint,sequence:bigint,slot:bigint>>"))  # a row for each class
    ranked = running(rows.where("rem > 0"), F.lit(1), "rank", total, ("bin",))
    mine = F.get(F.filter("slots", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["last"])), F.lit(0))
    ranked = ranked.join(table, "bin", "left").withColumn("s", mine)
    ranked = written(ranked.select("key", "h", (F.col("full") * capacity).alias("start"), "rem", F.expr("s.sequence + (rank - s.first) div s.each").alias("sequence_id"), F.expr("s.slot + (rank - s.first) % s.each").alias("slot")), "ranked")
    together = W.partitionBy("sequence_id")
    placed = ranked.where("sequence_id IS NOT NULL").select("key", "start", F.col("rem").alias("length"), "sequence_id", (F.sum("rem").over(together.orderBy("slot")) - F.col("rem")).alias("offset"), "slot", F.sum("rem").over(together).alias("used"))
    placed = written(placed, "placed")
    gaps = placed.where("slot = 0").select(F.col("sequence_id").alias("key"), F.xxhash64("sequence_id").alias("h"), (F.lit(capacity) - F.col("used")).alias("size"), F.col("used").alias("at")).where("size > 0")
    fillers = ranked.where("sequence_id IS NULL").select("key", "h", "start", "rem")
    room = gaps.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    line = fillers.agg(F.count("*").alias("n"), F.coalesce(F.sum("rem"), F.lit(0)).alias("size")).first()
    over = line["size"] - room["size"]
    whole, rest = divmod(over, capacity)
    frames = running(gaps, F.col("size"), "from", room["n"]).select("from", (F.col("from") + F.col("size")).alias("to"), F.col("key").alias("sequence_id"), "at")
    frames = frames.unionByName(spark.range(whole).select((F.col("id") * capacity + room["size"]).alias("from"), ((F.col("id") + 1) * capacity + room["size"]).alias("to"), (F.col("id") + sequences).alias("sequence_id"), F.lit(0).cast("bigint").alias("at")))
    ends, at, sequences = [], room["size"] + whole * capacity, sequences + whole
    for bit in reversed(range(capacity.bit_length())):
        if rest >> bit & 1:
            ends.append((at, at + (1 << bit), sequences, 0))
            at, sequences = at + (1 << bit), sequences + 1
    frames = frames.unionByName(spark.createDataFrame(ends, "from bigint, to bigint, sequence_id bigint, at bigint"))
    blocks = lambda a, b: F.explode(F.sequence(F.expr(f"`{a}` div {BLOCK}"), F.expr(f"(`{b}` - 1) div {BLOCK}")))
    laid = running(fillers, F.col("rem"), "a", line["n"]).withColumn("b", F.col("a") + F.col("rem")).withColumn("block", blocks("a", "b"))
    low, high = F.greatest("a", "from"), F.least("b", "to")
    filled = laid.join(frames.withColumn("block", blocks("from", "to")), "block").where((low < high) & (F.col("block") == F.floor(low / BLOCK)))
    filled = filled.select("key", (F.col("start") + low - F.col("a")).alias("start"), (high - low).alias("length"), "sequence_id", (F.col("at") + low - F.col("from")).alias("offset"))
    alone = running(rows.where("full > 0"), F.col("full"), "first", sum(r["n"] for r in found)).select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("k"), "first")
    alone = alone.select("key", (F.col("k") * capacity).alias("start"), F.lit(capacity).cast("bigint").alias("length"), (F.col("first") + F.col("k") + sequences).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return placed.select(*alone.columns).unionByName(filled).unionByName(alone)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, keep_ids: bool = True) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of each piece: ``length`` ids of the document from
    ``start`` on stand in the sequence at ``offset``. Sequences are full, or their length is a power of two."""
    tokens = token_table(docs, tokenizer_path, end_id, id_col, text_col)
    pieces = place_pieces(tokens.select("key", F.xxhash64("id").alias("h"), "n"), capacity, bins)
    own = pieces.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))  # no more than its tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, SLICE_BYTES):
            if not b.num_rows:
                continue
            blobs, lists = b.column(3), b.column(4)
            off = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
            raw = np.frombuffer(blobs.buffers()[2], np.uint8)[off[0] : off[-1]]
            width = b.column(2)[0].as_py()
            ids = raw.view(f"<u{width}").astype("<u4")
            parts = lists.flatten()
            of = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            start, length = (parts.field(k).to_numpy() for k in (0, 1))
            a = (off[:-1] - off[0])[of] // width + start
            data = memoryview(ids.tobytes())
            crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(a.tolist(), (a + length).tolist(), strict=True)]
            at = pa.array(of)
            cols = [b.column(0).take(at), parts.field(0), parts.field(1), pa.array(crc, pa.int64()), b.column(1).take(at), parts.field(2), parts.field(3)]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if keep_ids:
                cols.append(pa.array([ids[i:j].astype(np.int32) for i, j in zip(a.tolist(), (a + length).tolist(), strict=True)], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    both = tokens.join(own, "key").select("id", "n", "width", "ids", "pieces")
    kind = tokens.schema["id"].dataType.simpleString()
    return both.mapInArrow(run, f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * keep_ids)
