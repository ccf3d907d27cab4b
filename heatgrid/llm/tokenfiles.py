"""Token-id files in patched frame-of-reference blocks.

``write_tokens`` ranges the documents by id, encodes them and writes segments of consecutive documents through Spark's
Parquet committer (so a lost task leaves nothing behind): a binary payload of blocks of BLOCK ids and ``block_starts``,
the byte offset of each block. A block is its minimum (4 bytes), width, ids and exceptions (1, 2 and 2 bytes), the ids
less the minimum packed in ``width`` bits, then positions (2 bytes each) and values (4 bytes each) of the ids that need
more bits. The width is the one that a given share of the block's ids fits. ``read_tokens`` decodes the ids again and
``read_block`` any one block by its start.

The ids are those of the tokenizers library as its file says: a special token's string in a text is that token.
Cases: a null or empty text is the end id alone; equal ids (or null ones, first) keep the order of their texts; an empty table
writes no segment and reads as no rows; texts of any length are whole, and one that spans many blocks is one segment.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatgrid.llm.pieces import PieceEncoder, freeing, ranges, text_slices

if TYPE_CHECKING:
    from tokenizers import Tokenizer

BLOCK = 1024
SEGMENT_IDS = 1 << 20
SHARE = 0.9
KNOWN_BYTES = 40 << 20
SLICE_BYTES = 6 << 20
WHITE = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
HEADER = np.dtype([("min", "<u4"), ("width", "u1"), ("n", "<u2"), ("exceptions", "<u2")])


@functools.lru_cache(maxsize=2)
def loaded(path: str, special: bool) -> Tokenizer:
    """The tokenizer of a file; ``special``: added tokens in a text count as such. Reading the file costs as much as encoding
    3 MB, so a Python worker keeps it for its next tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = not special
    own.no_truncation()
    own.no_padding()
    return own


@functools.lru_cache(maxsize=1)
def token_sizes(path: str) -> np.ndarray:
    """Bytes of each token."""
    own = loaded(path, False)
    sizes = np.zeros(own.get_vocab_size(), np.int64)
    for token, i in own.get_vocab().items():
        sizes[i] = len(token)  # a character of a token stands for a byte
    return sizes


class Encoder:
    """The tokenizers library, given each different piece of a slice once; texts that hold an added token go to it whole."""

    def __init__(self, path: str):
        self.path, self.plain, self.sizes = path, loaded(path, False), token_sizes(path)
        self.added = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        self.pieces = PieceEncoder(self._learn, KNOWN_BYTES)

    @property
    def whole(self) -> Tokenizer:
        return loaded(self.path, True)

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and how many each has. Pieces go through the tokenizer by the thousand, each that
        doesn't begin with white space after a line break, and are told apart by their bytes; those that end in white space
        and might join the next one go alone."""
        alone = {k: np.array(self.plain.encode(p, add_special_tokens=False).ids, np.uint32) for k, p in enumerate(pieces) if p[-1].isspace()}
        joined = [k for k in range(len(pieces)) if k not in alone]
        counts = np.zeros(len(pieces), np.int64)
        counts[list(alone)] = [len(x) for x in alone.values()]
        out = [np.zeros(0, np.uint32)] * len(pieces) if alone else []
        ids = np.zeros(0, np.uint32)
        if joined:
            after = np.array([pieces[k][0] not in WHITE for k in joined])
            whole = ["\n" + pieces[k] if a else pieces[k] for k, a in zip(joined, after, strict=True)]
            texts = ["".join(whole[i : i + 1000]) for i in range(0, len(whole), 1000)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)])
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(p.encode()) for p in whole])) + 1
            starts = np.r_[0, ends[:-1]] + after
            counts[joined] = ends - starts
            ids = ids[ranges(starts, ends - starts)]
        if not alone:
            return ids, counts
        for k, part in zip(joined, np.split(ids, np.cumsum(counts[joined])[:-1]), strict=True):
            out[k] = part
        for k, part in alone.items():
            out[k] = part
        return np.concatenate(out), counts

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column in order (unsigned 32-bit), and the number of ids of each row; null counts as empty."""
        odd = np.zeros(len(column), bool)
        for content in self.added:
            odd |= pc.match_substring(column, content).fill_null(False).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self.pieces.encode(column)
        ids, counts = self.pieces.encode(pc.if_else(pa.array(odd), pa.scalar(None, column.type), column))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in np.flatnonzero(odd):
            parts[i] = np.array(self.whole.encode(column[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def _bits(v: np.ndarray) -> np.ndarray:
    """Bit lengths."""
    return np.frexp(v.astype(np.float64))[1].astype(np.int64)


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width as rows of 64-bit words: each 64 values fill ``width`` words."""
    v = v.reshape(-1, 64).astype(np.uint64)
    out = np.zeros((len(v), width), "<u8")
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[:, word] |= v[:, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= v[:, i] >> np.uint64(64 - shift)
    return out.reshape(-1, BLOCK // 64 * width)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    words = words.reshape(-1, width)
    out = np.empty((len(words), 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, i] = x & mask
    return out.reshape(-1, BLOCK).astype(np.uint32)


def pack_blocks(ids: np.ndarray, share: float = SHARE) -> tuple[bytes, np.ndarray]:
    """Payload and block starts of ids (unsigned 32-bit)."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return b"", np.zeros(0, np.int64)
    x = np.full(blocks * BLOCK, ids[-1], np.uint32)
    x[:n] = ids
    x = x.reshape(blocks, BLOCK)
    low = x.min(1)
    x = x - low[:, None]
    counts = np.full(blocks, BLOCK)
    counts[-1] = n - (blocks - 1) * BLOCK
    bits = _bits(x.ravel()).reshape(blocks, BLOCK)
    seen = np.cumsum(np.bincount((np.arange(blocks)[:, None] * 33 + bits).ravel(), minlength=33 * blocks).reshape(blocks, 33), 1)
    width = np.maximum(1, (seen >= np.ceil(share * BLOCK)).argmax(1))
    over = bits > width[:, None]
    extra = over.sum(1)
    sizes = HEADER.itemsize + BLOCK // 8 * width + 6 * extra
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    out = np.zeros(int(sizes.sum()), np.uint8)
    head = np.zeros(blocks, HEADER)
    head["min"], head["width"], head["n"], head["exceptions"] = low, width, counts, extra
    out[starts[:, None] + np.arange(HEADER.itemsize)] = head.view(np.uint8).reshape(blocks, -1)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        packed = _pack(np.where(over[at], 0, x[at]), int(w)).view(np.uint8).reshape(len(at), -1)
        out[(starts[at] + HEADER.itemsize)[:, None] + np.arange(packed.shape[1])] = packed
    for b in np.flatnonzero(extra):
        pos = np.flatnonzero(over[b])
        raw = pos.astype("<u2").tobytes() + x[b][pos].astype("<u4").tobytes()
        end = starts[b] + sizes[b]
        out[end - len(raw) : end] = np.frombuffer(raw, np.uint8)
    return out.tobytes(), starts


def unpack_blocks(payload: bytes, starts: np.ndarray) -> np.ndarray:
    """All ids of a payload."""
    raw = np.frombuffer(payload, np.uint8)
    blocks = len(starts)
    if not blocks:
        return np.zeros(0, np.uint32)
    head = np.ascontiguousarray(raw[starts[:, None] + np.arange(HEADER.itemsize)]).view(HEADER).ravel()
    x = np.empty((blocks, BLOCK), np.uint32)
    for w in np.unique(head["width"]):
        at = np.flatnonzero(head["width"] == w)
        body = raw[(starts[at] + HEADER.itemsize)[:, None] + np.arange(BLOCK // 8 * int(w))]
        x[at] = _unpack(np.ascontiguousarray(body).view("<u8"), int(w))
    for b in np.flatnonzero(head["exceptions"]):
        k = int(head["exceptions"][b])
        at = int(starts[b]) + HEADER.itemsize + BLOCK // 8 * int(head["width"][b])
        x[b, np.frombuffer(payload, "<u2", k, at)] = np.frombuffer(payload, "<u4", k, at + 2 * k)
    x += head["min"][:, None]
    keep = np.arange(BLOCK)[None, :] < head["n"][:, None]
    return x[keep] if head["n"][-1] < BLOCK else x.ravel()


def read_block(payload: bytes, start: int) -> np.ndarray:
    """The ids of the block at byte ``start``."""
    return unpack_blocks(payload, np.array([start]))


SEGMENTS = "shard int, segment int, first bigint, n_tokens bigint, doc_ids array<{}>, doc_tokens array<bigint>, block_starts array<bigint>, payload binary"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> None:
    """Write the ids of all documents, each followed by ``end_id``, in ascending id order. ``first``: ids of the shard before the segment."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(tokenizer_path)
        shard, segment, first, size = TaskContext.get().partitionId(), 0, 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            ids, counts = np.concatenate([x for _, x, _ in held]), np.concatenate([n for *_, n in held])
            payload, starts = pack_blocks(ids, share)
            docs = pa.concat_arrays([a for a, *_ in held])
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "segment": pa.array([segment], pa.int32()), "first": pa.array([first], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64()),
                "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), "doc_tokens": pa.array([counts], pa.list_(pa.int64())),
                "block_starts": pa.array([starts], pa.list_(pa.int64())), "payload": pa.array([payload], pa.binary()),
            })

        for b in text_slices(batches, SLICE_BYTES):
            ids, counts = own.encode(b.column(1))
            held.append((b.column(0), np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32), counts + 1))
            size += len(ids) + len(counts)
            if size >= SEGMENT_IDS:
                yield flush()
                segment, first, size, held = segment + 1, first + size, 0, []
        if held:
            yield flush()

    ordered = docs.select(id_col, text_col).repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col, text_col)
    ordered.mapInArrow(run, SEGMENTS.format(docs.schema[id_col].dataType.simpleString())).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32[, ids]) of each document, from the files. Only one number for each shard meets on the driver."""
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    totals = sorted((r[0], r[1]) for r in files.groupBy("shard").agg(F.sum("n_tokens")).collect())
    before = dict(zip((s for s, _ in totals), np.r_[0, np.cumsum([n for _, n in totals])].tolist(), strict=False))

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = unpack_blocks(r["payload"], np.asarray(r["block_starts"], np.int64)).astype("<u4")
                off = np.r_[0, np.cumsum(r["doc_tokens"])]
                raw = memoryview(ids.tobytes())
                cols = {
                    id_col: pa.array(r["doc_ids"], b.schema.field("doc_ids").type.value_type), "start": pa.array(before[r["shard"]] + r["first"] + off[:-1], pa.int64()), "n_tokens": pa.array(r["doc_tokens"], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(off[:-1], off[1:], strict=True)], pa.int64()),
                }
                if keep_ids:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(cols)

    return files.mapInArrow(run, f"{id_col} {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids)
