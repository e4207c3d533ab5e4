"""Vectorised text helpers for Arrow batches: chunks, word hashes, shingles, packed columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective, so it adds no collisions)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches, column: str, limit: int = CHUNK_BYTES):
    """Slices of Arrow batches of at most ``limit`` text bytes (or one row): batch, bytes, offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, offs = string_buffer(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a chunk: 64-bit hashes, byte spans, word offsets of the rows."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, lower: bool = True):
        n = len(raw)
        solid = ~SPACE[raw]
        head = np.zeros(n + 1, bool)
        head[offs] = True
        before = np.zeros(n, bool)
        before[1:] = solid[:-1]
        before &= ~head[:-1]
        self.start = np.flatnonzero(solid & ~before)
        after = np.zeros(n, bool)
        after[:-1] = solid[1:]
        after &= ~head[1:]
        self.end = np.flatnonzero(solid & ~after) + 1
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[LOWER[raw] if lower else raw] * up[:n], out=total[1:])
        length = (self.end - self.start).astype(np.uint64)
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] ^ (length << np.uint64(48)))
        self.offs = np.searchsorted(self.start, offs)
        self.row = np.repeat(np.arange(len(offs) - 1), np.diff(self.offs))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all word windows of ``size``; a row with fewer words gives one window of all."""
    h, n = words.hash, len(words.hash)
    count = np.diff(words.offs)
    acc = np.zeros(max(n - size + 1, 0), np.uint64)
    up, _ = powers(size + 1)
    for j in range(size):
        acc += h[j : j + len(acc)] * up[j]
    ok = words.row[: len(acc)] == words.row[size - 1 : size - 1 + len(acc)]
    out, rows = mix(acc[ok]), words.row[: len(acc)][ok]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = []
        for r in short:
            own = h[words.offs[r] : words.offs[r + 1]]
            extra.append((own * up[: len(own)]).sum(dtype=np.uint64) ^ np.uint64(len(own)))
        out, rows = np.concatenate([out, mix(np.array(extra, np.uint64))]), np.concatenate([rows, short])
    return out, rows


def distinct_per_row(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, sorted by row, then hash."""
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return h[keep], rows[keep]


def binary_column(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value for each pair of neighbours in ``bounds`` (item positions in ``data``)."""
    data = np.ascontiguousarray(data)
    offs = np.asarray(bounds, np.int64) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())
