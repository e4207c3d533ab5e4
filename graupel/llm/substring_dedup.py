"""Removal of repeated byte strings by the common-prefix interval tree of an enhanced suffix array.

Suffixes are taken at anchors only: in every window of ``length`` bytes the leftmost smallest hash of
``GRAM`` bytes is one, so two equal windows hold the same anchor in the same place.  Anchors that
occur once in the corpus drop out, and so do all but the earliest of those with equal bytes around
them (all their windows are repeats); the rest meet in hashed buckets with these bytes.
There the occurrences of an anchor are sorted by what follows, neighbours' common prefixes are
stack-scanned into the interval tree, and in each interval (a repeat with all its occurrences) the
order of what precedes them tells how far each occurrence extends to the left together with an
earlier one.  Extensions of ``length`` bytes or more are removed from all but the earliest.

An anchor with more than ``HOT`` occurrences that differ is not gathered in one place: each of its windows is
compared by hash on its own.

Blocks of texts are cut in id order, so places compare as (block, byte).  Rows with equal ids
come in the order of their texts, null ids first; matches never cross documents.  Null texts are empty; texts shorter than ``length`` keep everything; repeated rows are
copies, of which the first stays.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from graupel.llm.jaccard_join import bucket_count
from graupel.llm.katz import pack, unpack
from graupel.llm.text import _BYTE, binary_column, chunks, mix, powers
from graupel.session import Scratch

GRAM = 32
HOT = 1000


class Bytes:
    """Prefix hashes of a block's bytes."""

    def __init__(self, raw: np.ndarray, lens: np.ndarray):
        self.raw, self.offs = raw, np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
        up, self.down = powers(len(raw) + 1)
        self.total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=self.total[1:])

    def hash(self, at: np.ndarray, size: int) -> np.ndarray:
        return mix((self.total[at + size] - self.total[at]) * self.down[at])

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the anchors of all windows, and their hashes."""
        n, wide = len(self.raw), length - GRAM + 1
        none = np.zeros(0, np.int64)
        if n < length:
            return none, none.astype(np.uint64)
        low = np.uint64(int(n).bit_length())
        gram = mix((self.total[GRAM:] - self.total[:-GRAM]) * self.down[: n - GRAM + 1])
        least = (gram >> low << low) | np.arange(len(gram), dtype=np.uint64)
        reach = 1
        while reach * 2 <= wide:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if wide > reach:
            least = np.minimum(least[: reach - wide], least[wide - reach :])
        inside = np.ones(n + length, bool)
        ends = np.repeat(self.offs[1:], np.minimum(np.diff(self.offs), length - 1))
        short = np.minimum(np.diff(self.offs), length - 1)
        inside[ends - 1 - (np.arange(len(ends)) - np.repeat(np.cumsum(short) - short, short))] = False
        at = np.unique((least[inside[: len(least)]] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64))
        return at, gram[at]

    def around(self, at, before, after, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes before (nearest first) and from each anchor, padded with zeros."""
        left, right = np.arange(1, length - GRAM + 1), np.arange(length)
        l = np.where(left <= before[:, None], self.raw[np.maximum(at[:, None] - left, 0)], 0).astype(np.uint8)
        r = np.where(right < after[:, None], self.raw[np.minimum(at[:, None] + right, len(self.raw) - 1)], 0).astype(np.uint8)
        return l, r


def _key_parts(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & np.uint64(0xFFFFFF)) % np.uint64(buckets), hashes >> np.uint64(16)


def _cuts(bucket: np.ndarray):
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    return zip(cut, np.r_[cut[1:], len(bucket)] if len(bucket) else [], strict=True)


def text_blocks(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Packed blocks of texts; ids ascend within and across block numbers."""
    count = max(32, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def build(batches):
        part = TaskContext.get().partitionId()
        for number, (batch, raw, offs) in enumerate(chunks(batches, text)):
            ids = batch.column(id)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 20 | number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([np.diff(offs).astype(np.uint32).tobytes()], pa.binary()), pa.array([raw.tobytes()], pa.binary())],
                names=["block", "ids", "lens", "raw"],
            )

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).repartitionByRange(count, id).sortWithinPartitions(id, text).mapInArrow(build, f"block long, ids array<{kind}>, lens binary, raw binary")


def _anchors_of(row: dict, length: int):
    """A block's bytes, and its anchors with distinct surroundings: place, bytes before and after, bucket, code, sign, and copies."""
    b = Bytes(np.frombuffer(row["raw"], np.uint8), np.frombuffer(row["lens"], np.uint32))
    at, h = b.anchors(length)
    doc = np.searchsorted(b.offs, at, "right") - 1
    before = np.minimum(at - b.offs[doc], length - GRAM)
    after = np.minimum(b.offs[doc + 1] - at, length)
    sign = mix((b.total[at + after] - b.total[at - before]) * b.down[at - before] ^ mix((before * 1024 + after).astype(np.uint64)))
    _, first = np.unique(sign, return_index=True)
    copy = np.ones(len(at), bool)
    copy[first] = False
    bucket, code = _key_parts(h[first], row["buckets"])
    order = np.lexsort((sign[first], code, bucket))
    return b, at, before, after, copy, first[order], bucket[order], code[order], sign[first][order] >> np.uint64(16)


def _levels(blocks: DataFrame, length: int, buckets: int) -> DataFrame:
    """For each distinct anchor of a block: 0 nothing to do, 1 compare, 2 compare by windows, 3 equals an earlier one."""

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                *_, bucket, code, sign = _anchors_of(row | {"buckets": buckets}, length)
                rows = [(int(bucket[i]), row["block"], pack(code[i:j], True), pack(sign[i:j])) for i, j in _cuts(bucket)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "block", "codes", "signs"])

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        codes = [unpack(x.as_py(), True) for x in table.column("codes")]
        code, sign = np.concatenate(codes), np.concatenate([unpack(x.as_py()) for x in table.column("signs")])
        order = np.lexsort((sign, code))  # stable, so the earliest block comes first
        code, sign = code[order], sign[order]
        new = np.r_[True, code[1:] != code[:-1]]
        own = new | np.r_[True, sign[1:] != sign[:-1]]
        kinds = np.add.reduceat(own.astype(np.int64), np.flatnonzero(new))[np.cumsum(new) - 1]
        level = np.where(~own, 3, np.where(kinds == 1, 0, np.where(kinds > HOT, 2, 1)))
        out = np.empty(len(level), np.uint64)
        out[order] = level
        ends = np.cumsum([len(k) for k in codes])
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "level": pa.array([pack(out[e - len(k) : e]) for e, k in zip(ends, codes, strict=True)], pa.binary())})

    return blocks.select("block", "lens", "raw").mapInArrow(ask, "bucket int, block long, codes binary, signs binary").groupBy("bucket").applyInArrow(answer, "block long, bucket int, level binary")


_PART = "kind int, bucket int, block long, keys binary, places binary, before binary, after binary, bytes binary"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for c, (name, kind) in zip(columns, fields, strict=True)})


def _surroundings(blocks: DataFrame, levels: DataFrame, length: int, buckets: int) -> DataFrame:
    """kind 0: spans settled by equal surroundings; kind 1: anchors to compare, with their bytes; kind 2: windows of hot anchors."""

    def cut(key, rows: pa.Table, found: pa.Table) -> pa.Table:
        row = rows.to_pylist()[0] | {"buckets": buckets}
        b, at, before, after, copy, own, bucket, code, _ = _anchors_of(row, length)
        if not len(at):
            return _table([], _PART)
        replies = sorted(zip(found.column("bucket").to_pylist(), found.column("level").to_pylist(), strict=True), key=lambda x: x[0])
        level = np.concatenate([unpack(v) for _, v in replies]).astype(np.int64)
        copy[own[level == 3]] = True
        settled = copy & (before + after >= length)
        starts, ends, out = [(at - before)[settled]], [(at + after)[settled]], []
        hot = own[level == 2]
        pick = level == 1
        own, bucket, code = own[pick], bucket[pick], code[pick]
        for i, j in _cuts(bucket):
            x = own[i:j]
            l, r = b.around(at[x], before[x], after[x], length)
            out.append((1, int(bucket[i]), row["block"], pack(code[i:j], True), pack(at[x]), before[x].astype(np.uint8).tobytes(), after[x].astype(np.uint8).tobytes(), pa.compress(np.concatenate([l, r], 1).tobytes(), "zstd", asbytes=True)))
        if len(hot):
            pos = np.unique(np.concatenate([np.arange(at[i] - before[i], at[i] + after[i] - length + 1) for i in hot]))
            wh = b.hash(pos, length)
            _, first = np.unique(wh, return_index=True)
            again = np.ones(len(pos), bool)
            again[first] = False
            starts.append(pos[again])
            ends.append(pos[again] + length)
            pos, wh = pos[first], wh[first]
            bucket = (wh % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((wh, bucket))
            pos, wh, bucket = pos[order], wh[order], bucket[order]
            for i, j in _cuts(bucket):
                out.append((2, int(bucket[i]), row["block"], pack(wh[i:j], True), pack(pos[i:j]), None, None, None))
        out.append((0, 0, row["block"], None, pack(np.concatenate(starts)), pack(np.concatenate(ends)), None, None))
        return _table(out, _PART)

    return blocks.groupBy("block").cogroup(levels.groupBy("block")).applyInArrow(cut, _PART)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def prefix_intervals(common: list[int], least: int):
    """Stack scan of an enhanced suffix array: (depth, first, last) of every interval of ``least`` or more.

    ``common[i]`` is the common prefix of suffixes i-1 and i (common[0] is ignored).
    """
    stack: list[tuple[int, int]] = []
    for i in range(1, len(common) + 1):
        depth = common[i] if i < len(common) else 0
        first = i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i - 1
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def earlier_extension(times: list[int], common: list[int]) -> list[int]:
    """For strings in sorted order: the longest prefix that each shares with one of an earlier time."""
    n, best = len(times), [0] * len(times)
    for step in (1, -1):
        stack: list[tuple[int, int]] = []
        for i in range(n) if step == 1 else range(n - 1, -1, -1):
            cur = 0 if not stack else common[i] if step == 1 else common[i + 1]
            while stack and stack[-1][0] > times[i]:
                cur = min(cur, stack.pop()[1])
            if stack:
                best[i] = max(best[i], cur)
            stack.append((times[i], cur))
    return best


def repeat_spans(left: list[bytes], right: list[bytes], length: int):
    """(occurrence, bytes before, bytes from the anchor) to remove; occurrences come in corpus order."""
    by_right = sorted(range(len(right)), key=right.__getitem__)
    follow = [0] + [_common(right[by_right[i - 1]], right[by_right[i]]) for i in range(1, len(right))]
    rank = {x: i for i, x in enumerate(sorted(range(len(left)), key=left.__getitem__))}
    for depth, first, last in prefix_intervals(follow, GRAM):
        own = sorted(by_right[first : last + 1], key=rank.__getitem__)
        before = [0] + [_common(left[own[i - 1]], left[own[i]]) for i in range(1, len(own))]
        if max(before) < length - depth:
            continue
        for x, extent in zip(own, earlier_extension(own, before), strict=True):
            if extent + depth >= length and (extent or min(own) != x):
                yield x, extent, depth


_SPANS = "block long, starts binary, ends binary"


def _spans(block: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
    order = np.argsort(block, kind="stable")
    block, start, end = block[order], start[order], end[order]
    return _table([(int(block[i]), pack(start[i:j]), pack(end[i:j])) for i, j in _cuts(block)], _SPANS)


def _match(parts: DataFrame, length: int) -> DataFrame:
    """Spans of a bucket's repeated anchors."""
    wide = length - GRAM

    def match(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        key = np.concatenate([unpack(r["keys"], True) for r in rows])
        at = np.concatenate([unpack(r["places"]) for r in rows]).astype(np.int64)
        block = np.repeat([r["block"] for r in rows], [len(r["before"]) for r in rows])
        before = np.frombuffer(b"".join(r["before"] for r in rows), np.uint8).astype(np.int64)
        after = np.frombuffer(b"".join(r["after"] for r in rows), np.uint8).astype(np.int64)
        data = np.concatenate([np.frombuffer(pa.decompress(r["bytes"], len(r["before"]) * (wide + length), "zstd", asbytes=True), np.uint8).reshape(-1, wide + length) for r in rows])
        order = np.lexsort((at, block, key))
        key, at, block, before, after = (x[order] for x in (key, at, block, before, after))
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        who, lo, hi = [], [], []
        two = first[size == 2]
        for k in range(0, len(two), 1 << 14):
            i = two[k : k + (1 << 14)]
            x, y = data[order[i]], data[order[i + 1]]
            upto = lambda ne, most: np.minimum(np.where(ne.any(1), ne.argmax(1), ne.shape[1]), most)
            l = upto(x[:, :wide] != y[:, :wide], np.minimum(before[i], before[i + 1]))
            r = upto(x[:, wide:] != y[:, wide:], np.minimum(after[i], after[i + 1]))
            ok = l + r >= length
            who.append(i[ok] + 1)
            lo.append(l[ok])
            hi.append(r[ok])
        for f, m in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            near = data[order[f : f + m]]
            left = [x[:n].tobytes() for x, n in zip(near[:, :wide], before[f : f + m], strict=True)]
            right = [x[:n].tobytes() for x, n in zip(near[:, wide:], after[f : f + m], strict=True)]
            for x, l, r in repeat_spans(left, right, length):
                who.append([f + x])
                lo.append([l])
                hi.append([r])
        if not who:
            return _table([], _SPANS)
        who, lo, hi = (np.concatenate(x).astype(np.int64) for x in (who, lo, hi))
        return _spans(block[who], at[who] - lo, at[who] + hi)

    return parts.groupBy("bucket").applyInArrow(match, _SPANS)


def _match_windows(parts: DataFrame, length: int) -> DataFrame:
    """Spans of hot anchors' windows: each window hash but its earliest place."""

    def match(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [unpack(r["keys"], True) for r in rows]
        key = np.concatenate(keys)
        at = np.concatenate([unpack(r["places"]) for r in rows]).astype(np.int64)
        block = np.repeat([r["block"] for r in rows], [len(k) for k in keys])
        order = np.lexsort((at, block, key))
        later = order[np.r_[False, key[order][1:] == key[order][:-1]]]
        return _spans(block[later], at[later], at[later] + length)

    return parts.groupBy("bucket").applyInArrow(match, _SPANS)


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans (long), kept (binary: the remaining bytes)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "substrings")
    buckets = bucket_count(spark, docs.select(id, text))
    blocks = scratch.save(text_blocks(docs, id, text), "blocks")
    levels = scratch.save(_levels(blocks, length, buckets), "levels")
    parts = scratch.save(_surroundings(blocks, levels, length, buckets), "parts", partition_by=["kind"])
    spans = parts.where("kind = 0").select("block", F.col("places").alias("starts"), F.col("before").alias("ends"))
    spans = spans.union(_match(parts.where("kind = 1"), length)).union(_match_windows(parts.where("kind = 2"), length))
    spans = scratch.save(spans, "spans")
    scratch.free(levels, parts)

    def strip(key, rows: pa.Table, found: pa.Table) -> pa.Table:
        row = rows.to_pylist()[0]
        raw, lens = np.frombuffer(row["raw"], np.uint8), np.frombuffer(row["lens"], np.uint32).astype(np.int64)
        offs = np.concatenate([[0], np.cumsum(lens)])
        starts, ends = (np.concatenate([unpack(x.as_py()) for x in found.column(c)] or [np.zeros(0, np.uint64)]).astype(np.int64) for c in ("starts", "ends"))
        edge = np.bincount(starts, minlength=len(raw) + 1) - np.bincount(ends, minlength=len(raw) + 1)
        gone = np.cumsum(edge)[:-1] > 0
        head = np.zeros(len(raw) + 1, bool)
        head[offs] = True
        opens = gone & (head[:-1] | ~np.r_[False, gone[:-1]]) if len(raw) else gone
        upto = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[offs])
        removed = upto(gone)
        return pa.table({id: rows.column("ids").combine_chunks().flatten(), "n_bytes": lens, "n_removed": removed, "n_spans": upto(opens), "kept": binary_column(raw[~gone], np.concatenate([[0], np.cumsum(lens - removed)]))})

    kind = docs.schema[id].dataType.simpleString()
    return blocks.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(strip, f"{id} {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def substring_query(spark, sf_dir: str) -> DataFrame:
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SUBSTRING_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents
), p AS (
  SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100
), win AS (
  SELECT doc_id, p, substring(h, 2 * p + 1, 200) AS s FROM p
), ranked AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM win
), again AS (
  SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS opens FROM ranked WHERE k > 1
), numbered AS (
  SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM again
), spans AS (
  SELECT doc_id, min(p) AS b, max(p) + 100 AS e FROM numbered GROUP BY doc_id, span
), pieces AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS b, b AS e FROM spans
  UNION ALL SELECT doc_id, max(e), NULL FROM spans GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(substring(h, 2 * pieces.b + 1, 2 * (coalesce(pieces.e, n) - pieces.b)), '' ORDER BY pieces.b, coalesce(pieces.e, n)) AS h FROM pieces JOIN d USING (doc_id) GROUP BY doc_id
), sums AS (
  SELECT doc_id, sum(e - b) AS removed, count(*) AS spans FROM spans GROUP BY doc_id
)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
