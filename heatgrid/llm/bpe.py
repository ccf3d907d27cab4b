"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside Spark tasks.

A text is cut where white space follows something else (never inside a match of the split pattern), each different
piece is split by the pattern, and the words that the task doesn't know yet go through one recursive query: rows
(word, position, id) join the merge table and every round contracts each word's leftmost pair of minimum rank, until
no pair is left (between rounds a word's ids are one list). Decoding is an ordered aggregation of the token bytes.
Results depend on the text alone, so a lost executor's partitions are simply encoded again. A task opens its own DuckDB
and closes it, so a reused Python worker keeps no memory for the stages after it.

Cases: null and empty texts encode to no ids; words of any length are encoded in rounds of bounded size; extra
columns are ignored; equal rows give equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from heatgrid.llm.pieces import PieceEncoder, release, text_slices

STATE_ROWS = 800_000
KNOWN_BYTES = 16 << 20

_ROUNDS = """
WITH RECURSIVE s AS (
  SELECT word, ids, 0 AS step FROM start
  UNION ALL
  SELECT s.word, list_concat(list_append(s.ids[:b.at], b.rank), s.ids[b.at + 3:]), s.step + 1
  FROM s JOIN (
    SELECT word, min((m.rank << 40) | pos) AS best, best & 1099511627775 AS at, best >> 40 AS rank
    FROM (SELECT word, unnest(ids) AS id, unnest(ids[2:]) AS next, generate_subscripts(ids, 1) - 1 AS pos FROM s WHERE step < {limit}) p
    JOIN merges m ON m.pair = ((p.id << 20) | p.next)
    GROUP BY word
  ) b ON b.word = s.word
)
SELECT word, arg_max(ids, step) AS ids, max(step) AS step FROM s GROUP BY word
"""
#: Token bytes are kept as one character each, for the string aggregate.
_DECODE = "SELECT doc, string_agg(v.chars, '' ORDER BY pos) AS text FROM ids_in i JOIN vocab v ON v.id = i.id GROUP BY doc"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.cache
def newer_letters() -> str:
    """A character class of the code points that ``regex`` takes for letters or numbers and the tiktoken library, whose
    Unicode tables are older, doesn't; empty if there are none."""
    import regex
    import tiktoken

    known = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000)))))
    ranks = {bytes([i]): i for i in range(256)} | {b"\x01\x02": 256}
    probe = tiktoken.Encoding("probe", pat_str=r"[\p{L}\p{N}]+|\x01\x02", mergeable_ranks=ranks, special_tokens={})
    found, codes = [], probe.encode_ordinary("".join(c + "\x01\x02" for c in known))
    at = 0
    for c in known:  # what matches nothing gives no id
        n = len(c.encode())
        if codes[at] == 256:
            found.append(ord(c))
            n = 0
        at += n + 1
    edges = [k for k in range(len(found)) if not k or found[k] != found[k - 1] + 1] + [len(found)]
    return "".join(f"\\U{found[a]:08X}-\\U{found[b - 1]:08X}" for a, b in zip(edges, edges[1:], strict=False))


class Coder:
    """A task's merge table in DuckDB, and the pieces it has encoded lately. ``newer``: what ``newer_letters`` says."""

    def __init__(self, ranks_path: str, pattern: str, newer: str = ""):
        import duckdb
        import regex

        self.newer = regex.compile(f"[{newer}]") if newer else None
        self.ranks = load_ranks(ranks_path)
        self.single = np.array([self.ranks.get(bytes([i]), 0) for i in range(256)], np.int64)
        self.split = regex.compile(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "100MB", "temp_directory": ""})
        parts = (array("q"), array("q"), array("q"))
        for t, rank in self.ranks.items():
            for i in range(1, len(t)):
                left, right = self.ranks.get(t[:i]), self.ranks.get(t[i:])
                if left is not None and right is not None:
                    for column, value in zip(parts, (left, right, rank), strict=True):
                        column.append(value)
        merges = pa.table({k: np.frombuffer(v, np.int64) if len(v) else np.zeros(0, np.int64) for k, v in zip(("l", "r", "rank"), parts, strict=True)})
        self.db.register("merges_in", merges)
        self.db.execute("CREATE TABLE merges AS SELECT (l << 20) | r AS pair, rank FROM merges_in")
        vocab = pa.table({"id": pa.array(list(self.ranks.values()), pa.int64()), "chars": pa.array([t.decode("latin-1") for t in self.ranks])})
        self.db.register("vocab_in", vocab)
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM vocab_in")
        for name in ("merges_in", "vocab_in"):
            self.db.unregister(name)
        self.pieces = PieceEncoder(self._learn, KNOWN_BYTES)

    def _split(self, piece: str) -> list[str]:
        """Matches of the pattern; newer letters count as code points of no kind."""
        if self.newer is None or piece.isascii() or not self.newer.search(piece):
            return self.split.findall(piece)
        return [piece[m.start() : m.end()] for m in self.split.finditer(self.newer.sub("\ue000", piece))]

    def _contract(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of words that aren't tokens themselves."""
        out: dict[bytes, bytes] = {}
        words = sorted(words, key=len)
        counts = np.array([len(w) for w in words], np.int64)
        rows = np.cumsum(counts * counts // 2)
        i = 0
        while i < len(words):
            j = max(i + 1, int(np.searchsorted(rows, (rows[i - 1] if i else 0) + STATE_ROWS, "right")))
            names = words[i:j]
            ids = self.single[np.frombuffer(b"".join(names), np.uint8)]
            state = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts[i:j])].astype(np.int32)), pa.array(ids))
            while len(names):
                longest = int(pc.max(pc.list_value_length(state)).as_py())
                limit = max(1, min(longest, STATE_ROWS // longest))
                start = pa.table({"word": pa.array(np.arange(len(names))), "ids": state})
                self.db.register("start", start)
                got = self.db.sql(_ROUNDS.format(limit=limit)).to_arrow_table().combine_chunks()
                self.db.unregister("start")
                word, lists = got.column("word").to_numpy(), got.column("ids").combine_chunks()
                raw, off = lists.flatten().to_numpy().astype("<u4").tobytes(), (np.asarray(lists.offsets) - np.asarray(lists.offsets)[0]) * 4
                open_ = got.column("step").to_numpy() >= limit
                for k, w in enumerate(word.tolist()):
                    if not open_[k]:
                        out[names[w]] = raw[off[k] : off[k + 1]]
                names, state = [names[w] for w in word[open_].tolist()], lists.filter(pa.array(open_))
            i = j
        return out

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and how many each has."""
        split = [self._split(p) for p in pieces]
        words = {w: w.encode() for ms in split for w in ms}
        ids = {w: int.to_bytes(self.ranks[b], 4, "little") for w, b in words.items() if b in self.ranks}
        raw = self._contract([b for w, b in words.items() if w not in ids])
        ids.update({w: raw[b] for w, b in words.items() if w not in ids})
        parts = [ids[ms[0]] if len(ms) == 1 else b"".join([ids[w] for w in ms]) for ms in split]
        return np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Ordered aggregation of the token bytes of rows with ``counts`` ids each, in batches of a bounded number of ids."""
        out: list[bytes] = []
        ends = np.r_[0, np.cumsum(counts)]
        i = 0
        while i < len(counts):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + STATE_ROWS // 4, "right")) - 1)
            rows = pa.table({"doc": np.repeat(np.arange(j - i), counts[i:j]), "pos": np.arange(ends[j] - ends[i]), "id": ids[ends[i] : ends[j]].astype(np.int64)})
            self.db.register("ids_in", rows)
            got = dict(self.db.execute(_DECODE).fetchall())
            self.db.unregister("ids_in")
            out += [got.get(k, "").encode("latin-1") for k in range(j - i)]
            i = j
        return out

    def close(self) -> None:
        self.db.close()
        self.pieces.forget()


@contextmanager
def coder(ranks_path: str, pattern: str, newer: str = "") -> Iterator[Coder]:
    """A coder for one task."""
    own = Coder(ranks_path, pattern, newer)
    try:
        yield own
    finally:
        own.close()
        del own
        release()


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(id_col, ids, n_tokens, ids_sha256, decoded_sha256) of each row: its ids, their digest, and that of the bytes they decode to."""
    newer = newer_letters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with coder(ranks_path, pattern, newer) as own:
            for b in text_slices(batches):
                ids, counts = own.pieces.encode(b.column(1))
                decoded = own.decode(ids, counts)
                ends = np.r_[0, np.cumsum(counts)]
                raw = memoryview(ids.astype("<u4")).cast("B")
                cols = {id_col: b.column(0), "n_tokens": pa.array(counts)}
                if keep_ids:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                cols["ids_sha256"] = pa.array([hashlib.sha256(raw[4 * i : 4 * j]).hexdigest() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())
                cols["decoded_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())
                yield pa.RecordBatch.from_pydict(cols)

    kind = docs.schema[id_col].dataType.simpleString()
    ids = "ids array<int>, " if keep_ids else ""
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens bigint, {ids}ids_sha256 string, decoded_sha256 string")


def bpe_decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, text) from (id_col, ids array<int>); bytes that are no UTF-8 become replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with coder(ranks_path, pattern) as own:
            for b in batches:
                ids = b.column(1).fill_null([])
                got = own.decode(ids.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64))
                yield pa.RecordBatch.from_pydict({id_col: b.column(0), "text": pa.array([x.decode("utf-8", "replace") for x in got], pa.string())})

    return encoded.select(id_col, "ids").mapInArrow(run, f"{id_col} {encoded.schema[id_col].dataType.simpleString()}, text string")
