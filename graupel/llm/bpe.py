"""Byte-level BPE encoding and decoding in length-bucketed padded numpy matrices.

Every batch of texts is split by the pattern, its distinct pieces are put into matrices by
length, and each round merges the leftmost minimum-rank pair of every row at once: the
merged pairs' ranks come from an open-addressing hash table, the right halves are cut out
by compaction, and rows without a pair left leave the matrix.

Null and empty texts give no ids; decoding null gives empty bytes.  Pieces longer than
``LONG`` bytes merge by a heap (same result, since a matrix would need a round per byte).
Extra columns pass through; an output name that the input already has is replaced.
"""

from __future__ import annotations

import base64
import functools
import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from graupel.llm.text import binary_column, chunks

NONE = np.int32(2**31 - 1)
LONG = 1024
WIDTHS = (*range(2, 17), 20, 24, 32, 48, 64, 128, 256, 512, LONG)
CELLS = 1 << 20
#: Text bytes that one pass of encoding and decoding holds.
CHUNK = 1 << 19


class Ranks:
    """A rank file, its pairs in a hash table, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for t, r in self.rank.items():
            self.token[r] = t
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.rank[t[:i]], self.rank[t[i:]], r) for t, r in self.rank.items() for i in range(1, len(t)) if t[:i] in self.rank and t[i:] in self.rank]
        left, right, rank = np.array(pairs, np.int64).T
        self.bits = int(np.ceil(np.log2(len(pairs) * 4)))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.vals = np.full(1 << self.bits, NONE, np.int32)
        key = left << 32 | right
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = key[free]  # of several for one slot, the last stays
            won = self.keys[slot[todo]] == key[todo]
            self.vals[slot[todo[won]]] = rank[todo[won]]
            todo = todo[~won]
            slot[todo] = slot[todo] + 1 & (1 << self.bits) - 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, NONE where there is none (or an end is padding, -1)."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        slot = self._slot(key)
        out = np.full(len(key), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        while len(todo):
            seen = self.keys[slot[todo]]
            hit = seen == key[todo]
            out[todo[hit]] = self.vals[slot[todo[hit]]]
            todo = todo[~hit & (seen != -1)]
            slot[todo] = slot[todo] + 1 & (1 << self.bits) - 1
        return out

    def merge_matrix(self, ids: np.ndarray) -> np.ndarray:
        """Merges every row of a padded matrix to its end; padding is -1."""
        out = np.full_like(ids, -1)
        live = np.arange(len(ids))
        rank = self.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while True:
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(ids), np.int64)
            best = rank[np.arange(len(ids)), at] if rank.shape[1] else np.full(len(ids), NONE)
            done = best == NONE
            if done.any():
                out[live[done], : ids.shape[1]] = ids[done]
                live, ids, rank, at, best = live[~done], ids[~done], rank[~done], at[~done], best[~done]
            n, w = ids.shape
            if not n:
                return out
            i = np.arange(n)
            ids[i, at] = best
            keep = np.ones((n, w), bool)
            keep[i, at + 1] = False
            ids = ids[keep].reshape(n, w - 1)
            rank = rank[np.delete(keep, 0, 1)].reshape(n, w - 2)  # drops the rank of the merged pair
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self.lookup(ids[before, at[before] - 1], ids[before, at[before]])
            after = np.flatnonzero(at < w - 2)
            rank[after, at[after]] = self.lookup(ids[after, at[after]], ids[after, at[after] + 1])

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merges for one very long piece, by a heap over linked neighbours."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        nxt, prev, alive = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [True] * len(ids)
        get = lambda a, b: self.rank.get(self.token[ids[a]] + self.token[ids[b]])
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := get(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= len(ids) or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], nxt[i] = r, False, nxt[j]
            if nxt[i] < len(ids):
                prev[nxt[i]] = i
            for x, y in ((prev[i], i), (i, nxt[i])):
                if x >= 0 and y < len(ids) and (s := get(x, y)) is not None:
                    heapq.heappush(heap, (s, x, ids[x], ids[y]))
        return [t for t, on in zip(ids, alive, strict=True) if on]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and the number of ids of each."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        start = np.concatenate([[0], np.cumsum(size)])
        count = np.zeros(len(pieces), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        one = np.flatnonzero(size == 1)
        count[one] = 1
        parts.append((one, self.byte[raw[start[one]]]))
        low = 1
        for width in WIDTHS:
            rows = np.flatnonzero((size > low) & (size <= width))
            low = width
            step = max(1, CELLS // width)
            for k in range(0, len(rows), step):
                own = rows[k : k + step]
                cols = np.arange(width)
                inside = cols < size[own, None]
                at = np.minimum(start[own, None] + cols, len(raw) - 1)
                done = self.merge_matrix(np.where(inside, self.byte[raw[at]], np.int32(-1)).astype(np.int32))
                real = done >= 0
                count[own] = real.sum(1)
                parts.append((own, done[real]))
        for i in np.flatnonzero(size > LONG):
            ids = np.array(self.merge_long(pieces[i]), np.int32)
            count[i] = len(ids)
            parts.append((np.array([i]), ids))
        first = np.concatenate([[0], np.cumsum(count)])
        flat = np.empty(first[-1], np.int32)
        for rows, ids in parts:
            flat[spread(first[rows], count[rows])] = ids
        return flat, count


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... (count of them) for each pair, one after another."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


@functools.cache
def ranks(path: str) -> Ranks:
    return Ranks(path)


def _encoded(table: Ranks, split, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a column one after another, and the bounds of each."""
    found = [split.findall(t) if t else [] for t in column.to_pylist()]
    per = np.fromiter(map(len, found), np.int64, len(found))
    code, pieces = pd.factorize(np.array([p for f in found for p in f], dtype=object))
    flat, size = table.encode_pieces([p.encode() for p in pieces])
    begin = np.cumsum(size) - size
    got = flat[spread(begin[code], size[code])].astype("<u4")
    return got, np.concatenate([[0], np.cumsum(size[code])])[np.concatenate([[0], np.cumsum(per)])]


def _decoded(table: Ranks, ids: np.ndarray) -> bytes:
    return b"".join(map(table.token.__getitem__, ids.tolist()))


def bpe_encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", count: str = "n_tokens") -> DataFrame:
    """Adds ``ids`` (binary: little-endian unsigned 32-bit integers) and ``count`` (long)."""
    base = df.drop(ids, count)

    def run(batches):
        table, split = ranks(ranks_path), regex.compile(pattern)
        for batch, _, _ in chunks(batches, text):
            got, bounds = _encoded(table, split, batch.column(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, binary_column(got, bounds), pa.array(np.diff(bounds), pa.int64())], names=[*batch.schema.names, ids, count])

    schema = T.StructType([*base.schema.fields, T.StructField(ids, T.BinaryType()), T.StructField(count, T.LongType())])
    return base.mapInArrow(run, schema)


def bpe_round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", count: str = "n_tokens", same: str = "round_trip") -> DataFrame:
    """Encodes and decodes in one pass: all columns but ``text``, then ``ids``, ``count`` and ``same`` (whether the decoded bytes are the text's)."""
    base = df.drop(ids, count, same)
    kept = [f for f in base.schema.fields if f.name != text]

    def run(batches):
        table, split = ranks(ranks_path), regex.compile(pattern)
        for batch, raw, offs in chunks(batches, text, CHUNK):
            got, bounds = _encoded(table, split, batch.column(text))
            good = [_decoded(table, got[i:j]) == raw[a:b].tobytes() for i, j, a, b in zip(bounds[:-1], bounds[1:], offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], binary_column(got, bounds), pa.array(np.diff(bounds), pa.int64()), pa.array(good, pa.bool_())], names=[*[f.name for f in kept], ids, count, same])

    return base.mapInArrow(run, T.StructType([*kept, T.StructField(ids, T.BinaryType()), T.StructField(count, T.LongType()), T.StructField(same, T.BooleanType())]))


def bpe_decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the bytes that packed ``ids`` stand for."""
    base = df.drop(out)

    def run(batches):
        table = ranks(ranks_path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                made = [_decoded(table, np.frombuffer(x or b"", "<u4")) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], names=[*part.schema.names, out])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(out, T.BinaryType())]))


def bpe_roundtrip_query(spark, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers as pt

    path = ranks_path or pt.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = bpe_decode(bpe_encode(docs, path, pt.PATTERN).drop("text"), path)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
