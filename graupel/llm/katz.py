"""Katz back-off language model: Good-Turing discounts, exactly normalised back-off weights.

P(w)    = d1(c) c(w)/N                     for known words; the rest of the mass goes to one unknown word
P(w|h)  = d2(c) c(h,w)/c(h)                for word pairs seen in training
        = a(h) P(w)                        otherwise, a(h) = (1 - seen mass of h) / (1 - sum of P over words seen after h)

Words are compared by 64-bit hashes, pairs by 48 bits and their bucket.  Texts become blocks of local word numbers once.  A
block asks for the counts of its distinct words and pairs: requests, one sorted packed column per
bucket, meet in hashed buckets, which write the model's count tables and answer every block in its
own order.  One block answers for each pair in the sums of a(h), so a history with very many
followers is summed in parts, and only pairs unseen in training look up a(h).

Counts of up to K = 5 have Good-Turing discounts; higher counts keep all but ``TAIL`` of one count,
so that every history has mass to give.  Null and empty texts are one end token; a null id is
hashed as empty text.  Repeated rows count as often as they occur; a very long text is a block of its own.  Ids may be of any type, extra
columns of any name are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from graupel.llm.jaccard_join import bucket_count
from graupel.llm.text import Words, chunks, mix
from graupel.session import Scratch

K = 5
TAIL = 0.05
BLOCK_BYTES = 2 << 20
ROW_KEYS = 1 << 15
END, START = np.uint64(0x51AB4E17C0FFEE01), np.uint64(0x2B992DDFA23249D7)


def pack(values: np.ndarray, sorted_keys: bool = False) -> bytes:
    """Byte planes of (the differences of) unsigned integers, compressed."""
    values = np.asarray(values, np.uint64)
    if sorted_keys and len(values):
        values = np.diff(values, prepend=np.uint64(0))
    planes = values.view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, sorted_keys: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    values = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(values, dtype=np.uint64) if sorted_keys else values


def discounts(counts_of_counts: list[int]) -> list[float]:
    """Good-Turing discount factors of counts 1 to K from n_1 .. n_(K+1); a plain half count where they fail."""
    n = [0, *counts_of_counts]
    out = [1.0]
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out.append(d if 0.0 < d < 1 - TAIL / r else 1 - 0.5 / r)
    return out


def discounted(counts: np.ndarray, d: list[float]) -> np.ndarray:
    """d(c) * c for arrays of counts."""
    counts = counts.astype(np.float64)
    return np.where(counts > K, counts - TAIL, np.asarray(d)[np.minimum(counts, K).astype(np.int64)] * counts)


class Block:
    """Local word numbers of a block's tokens, each text ending in END, with the word before."""

    def __init__(self, row: dict):
        self.vocab = np.concatenate([np.array([END, START]), unpack(row["vocab"], True)])
        self.len = np.frombuffer(row["lens"], np.uint32).astype(np.int64)
        self.train = np.frombuffer(row["train"], np.uint8).astype(bool)
        self.word = unpack(row["words"]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.len)), self.len)
        self.before = np.empty_like(self.word)
        self.before[1:] = self.word[:-1]
        self.before[np.cumsum(self.len) - self.len] = 1
        self.learn = self.train[self.doc]

    def words(self, buckets: int):
        """Vocabulary entries ordered by bucket and hash, and their training counts."""
        bucket = (self.vocab % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((self.vocab, bucket))
        return order, bucket[order], self.vocab[order], np.bincount(self.word[self.learn], minlength=len(self.vocab))[order]

    def pairs(self, buckets: int):
        """Distinct pairs ordered by bucket and key: each token's place, bucket, key, training counts."""
        up = self.vocab
        full = mix(up[self.before] * np.uint64(0x9E3779B97F4A7C15) ^ up[self.word])
        code, full = pd.factorize(full)
        bucket, key = (full & np.uint64(0xFFFFFF)) % np.uint64(buckets), full >> np.uint64(16)
        order = np.lexsort((key, bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = place[code]
        return at, bucket[order].astype(np.int64), key[order], np.bincount(at[self.learn], minlength=len(order))


def text_blocks(docs: DataFrame, id: str, text: str, folds: int, fold: int) -> DataFrame:
    """Rows of tokenised texts; rows whose crc32(id as text) mod ``folds`` is ``fold`` are held out."""

    def build(batches):
        part = TaskContext.get().partitionId()
        for number, (batch, raw, offs) in enumerate(chunks(batches, text, BLOCK_BYTES)):
            w = Words(raw, offs)
            code, vocab = pd.factorize(w.hash)
            order = np.argsort(vocab)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(2, len(order) + 2)
            lens = np.diff(w.offs) + 1
            flat = np.insert(rank[code], w.offs[1:], 0)
            ids = batch.column(id)
            held = [zlib.crc32(b"" if x is None else str(x).encode()) % folds == fold for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
                + [pa.array([x], pa.binary()) for x in (lens.astype(np.uint32).tobytes(), (~np.array(held, bool)).tobytes(), pack(vocab[order], True), pack(flat))],
                names=["block", "ids", "lens", "train", "vocab", "words"],
            )

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(build, f"block long, ids array<{kind}>, lens binary, train binary, vocab binary, words binary")


def _requests(blocks: DataFrame, buckets: int) -> DataFrame:
    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                rows = []
                for order, (bucket, key, count) in ((1, b.words(buckets)[1:]), (2, b.pairs(buckets)[1:])):
                    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                    for i, j in zip(cut, np.r_[cut[1:], len(bucket)], strict=True):
                        rows.append((order, int(bucket[i]), row["block"], pack(key[i:j], True), pack(count[i:j])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["ngram", "bucket", "block", "keys", "counts"])

    return blocks.select("block", "lens", "train", "vocab", "words").mapInArrow(ask, "ngram int, bucket int, block long, keys binary, counts binary")


def _answers(requests: DataFrame) -> DataFrame:
    """kind 'count': the model's counts of a bucket; kind 'answer': 2 * count + owner for a request."""

    def answer(table: pa.Table) -> pa.Table:
        ngram, bucket = table.column("ngram")[0].as_py(), table.column("bucket")[0].as_py()
        keys = [unpack(x.as_py(), True) for x in table.column("keys")]
        counts = np.concatenate([unpack(x.as_py()) for x in table.column("counts")])
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        new = np.r_[True, flat[order][1:] != flat[order][:-1]]
        total = np.add.reduceat(counts[order], np.flatnonzero(new))
        out = np.empty(len(flat), np.uint64)
        out[order] = total[np.cumsum(new) - 1] * np.uint64(2) + new
        ends = np.cumsum([len(k) for k in keys])
        known = total > 0
        freq = np.bincount(np.minimum(total[known], K + 2).astype(np.int64), minlength=K + 3)[1:].tolist()
        listed, sums = flat[order][new][known], total[known]
        rows = [("count", None, pack(listed[i : i + ROW_KEYS], True), pack(sums[i : i + ROW_KEYS]), None if i else freq, None if i else int(sums.sum())) for i in range(0, max(len(listed), 1), ROW_KEYS)]
        rows += [("answer", b, None, pack(out[e - len(k) : e]), None, None) for b, k, e in zip(table.column("block").to_pylist(), keys, ends, strict=True)]
        kind, block, key, value, freqs, sums = zip(*rows, strict=True)  # small rows: a bucket's table is cut
        n = len(rows)
        return pa.table({"kind": kind, "ngram": pa.array([ngram] * n, pa.int32()), "bucket": pa.array([bucket] * n, pa.int32()), "block": pa.array(block, pa.int64()), "keys": pa.array(key, pa.binary()), "values": pa.array(value, pa.binary()), "freq": pa.array(freqs, pa.list_(pa.int64())), "total": pa.array(sums, pa.int64())})

    return requests.groupBy("ngram", "bucket").applyInArrow(answer, "kind string, ngram int, bucket int, block long, keys binary, values binary, freq array<long>, total long")


def katz_score(docs: DataFrame, id: str = "doc_id", text: str = "text", folds: int = 5, fold: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """Scores every text by a model of the texts that are not held out.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "katz")
    buckets = bucket_count(spark, docs.select(id, text))
    blocks = scratch.save(text_blocks(docs, id, text, folds, fold), "blocks")
    model = scratch.save(_answers(_requests(blocks, buckets)), "counts", partition_by=["kind", "ngram"])
    stats = {r["ngram"]: r for r in model.where("kind = 'count'").groupBy("ngram").agg(*[F.sum(F.element_at("freq", r)).alias(f"n{r}") for r in range(1, K + 3)], F.sum("total").alias("total")).collect()}
    freq = {n: [stats[n][f"n{r}"] if n in stats else 0 for r in range(1, K + 3)] for n in (1, 2)}
    total = stats[1]["total"] if 1 in stats else 0
    d1, d2 = discounts(freq[1]), discounts(freq[2])
    distinct = sum(freq[1])
    left = sum(freq[1][r - 1] * r * (1 - d1[r]) for r in range(1, K + 1)) + TAIL * sum(freq[1][K:])
    unknown = left / total if total else 1.0

    def score(key, rows: pa.Table, replies: pa.Table) -> pa.Table:
        row = rows.to_pylist()[0]
        b = Block(row)
        reply = {1: [], 2: []}
        for n, bucket, v in sorted(zip(replies.column("ngram").to_pylist(), replies.column("bucket").to_pylist(), replies.column("values").to_pylist(), strict=True), key=lambda x: x[:2]):
            reply[n].append(unpack(v))
        order = b.words(buckets)[0]
        count = np.empty(len(b.vocab), np.int64)
        count[order] = (np.concatenate(reply[1]) >> np.uint64(1)).astype(np.int64)
        as_history = count.copy()
        as_history[1] = count[0]  # START comes once for each END
        prob = np.where(count > 0, discounted(count, d1) / max(total, 1), unknown)
        at = b.pairs(buckets)[0]
        got = np.concatenate(reply[2])
        pair, owner = (got >> np.uint64(1)).astype(np.int64)[at], (got & np.uint64(1)).astype(bool)
        seen = pair > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            given = discounted(pair, d2) / as_history[b.before]
            logs = np.log10(np.where(seen, given, prob[b.word]))
        base = np.log10((count + 0.5) / (total + 0.5 * (distinct + 1)))
        starts = np.cumsum(b.len) - b.len
        sums = lambda x: np.add.reduceat(x, starts) if len(starts) else x[:0]
        # one token of each pair that this block owns stands for the pair in the sums of a(h)
        one = np.full(len(owner), -1)
        one[at[::-1]] = np.arange(len(at))[::-1]
        mine = one[owner]
        mine = mine[seen[mine]]
        hist, place = np.unique(b.before[mine], return_inverse=True)
        mass, lower = np.bincount(place, given[mine], len(hist)), np.bincount(place, prob[b.word[mine]], len(hist))
        # pairs that training never saw, after a known history: (text, history, times)
        back = np.flatnonzero(~seen & (as_history[b.before] > 0))
        combo, times = np.unique(b.doc[back] * len(b.vocab) + b.before[back], return_counts=True)
        n, m, u = len(b.len), len(hist), len(combo)
        ids = rows.column("ids").combine_chunks().flatten()
        fill = lambda k, v, dtype: [pa.nulls(x, dtype) if i != k else pa.array(v, dtype) for i, x in enumerate((n, m, u))]
        own = np.arange(n, dtype=np.int32)
        rank = lambda *parts: pa.concat_arrays(list(parts))
        return pa.table({
            "kind": np.repeat(np.array([0, 1, 2], np.int32), [n, m, u]),
            "id": rank(ids, pa.nulls(m, ids.type), pa.nulls(u, ids.type)),
            "held_out": rank(*fill(0, ~b.train, pa.bool_())),
            "n_tokens": rank(*fill(0, b.len, pa.int64())),
            "n_known": rank(*fill(0, sums((count > 0)[b.word].astype(np.int64)), pa.int64())),
            "base": rank(*fill(0, sums(base[b.word]), pa.float64())),
            "score": rank(*fill(0, sums(logs), pa.float64())),
            "block": pa.array(np.full(n + m + u, row["block"], np.int64)),
            "row": rank(pa.array(own), pa.nulls(m, pa.int32()), pa.array(own[combo // len(b.vocab)])),
            "history": rank(pa.nulls(n, pa.int64()), pa.array(b.vocab[hist].view(np.int64)), pa.array(b.vocab[combo % len(b.vocab)].view(np.int64))),
            "x": rank(pa.nulls(n, pa.float64()), pa.array(mass, pa.float64()), pa.array(times.astype(np.float64))),
            "y": rank(pa.nulls(n, pa.float64()), pa.array(lower, pa.float64()), pa.nulls(u, pa.float64())),
        })

    kind = docs.schema[id].dataType.simpleString()
    schema = f"kind int, id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, block long, row int, history long, x double, y double"
    replies = model.where("kind = 'answer'").select("block", "ngram", "bucket", "values")
    scored = scratch.save(blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, schema), "scored", partition_by=["kind"])
    scratch.free(blocks, model)
    weights = scratch.save(scored.where("kind = 1").groupBy("history").agg(F.log10((1 - F.sum("x")) / (1 - F.sum("y"))).alias("weight")), "weights")
    backs = scored.where("kind = 2").select("block", "row", "history", "x").join(weights, "history")
    extra = scratch.save(backs.groupBy("block", "row").agg(F.sum(F.col("x") * F.col("weight")).alias("extra")), "extra")
    rows = scored.where("kind = 0").join(extra, ["block", "row"], "left")
    return rows.select(F.col("id").alias(id), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("score") + F.coalesce("extra", F.lit(0.0))).alias("score"))


def katz_query(spark, sf_dir: str) -> DataFrame:
    return katz_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
