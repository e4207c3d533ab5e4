"""Quality classifier: random-indexing word vectors, pooled, and a small calibrated network.

Words are runs of letters (or bytes beyond ASCII), of digits, or of other marks.  Every word has a random index vector; a word's vector
is the sum of the index vectors of its neighbours in the training sample, kept in a hashed table of
fixed size.  A text's inputs are the mean and the spread of its words' vectors and a few shape
ratios (share of upper case, marks, digits, line ends, distinct words, length).  Two dense layers,
trained by numpy, give a logit; one temperature, fitted on a part of the sample kept out of
training, calibrates it.

The model learns from at most ``SAMPLE`` labelled rows (a documented bound), the ones with the
smallest hash among those outside the held-out fold; scoring streams all texts once.  Null and
empty texts have all-zero inputs and get the score that these have; with no usable label every
score is 0.5.  Ids may be of any type.  Rows with a null label are not learned from; repeated label rows count once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from graupel.llm.text import SPACE, _BYTE, chunks, distinct_per_row, mix, powers
from graupel.session import Scratch

SAMPLE = 20_000
DIMENSIONS = 32
BUCKETS = 1 << 15
WINDOW = 2
HIDDEN = 24
FOLDS = 5
CUT = 0.3
SLICES = 16
#: Text bytes whose word vectors are held at once.
CHUNK = 1 << 19
_CLASS = np.full(256, 3, np.int8)  # 0 space, 1 letter, 2 digit, 3 mark
_CLASS[SPACE] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[0x30:0x3A] = 2
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True


def fold_of(id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(id.cast("string"), F.lit("")), "UTF-8")) % FOLDS


def units(raw: np.ndarray, offs: np.ndarray):
    """Hash and row of each run of one byte class that isn't space; row borders."""
    kind = _CLASS[raw]
    n = len(raw)
    head = np.zeros(n + 1, bool)
    head[offs] = True
    change = head[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(change)
    end = np.r_[start[1:], n] if len(start) else start
    solid = kind[start] > 0
    start, end = start[solid], end[solid]
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start])
    border = np.searchsorted(start, offs)
    return h, np.repeat(np.arange(len(offs) - 1), np.diff(border)), border


def index_table() -> np.ndarray:
    """Sparse random index vectors of the hashed words: four entries of +-1 each."""
    rng = np.random.Generator(np.random.PCG64(7))
    out = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    for _ in range(4):
        out[np.arange(BUCKETS), rng.integers(0, DIMENSIONS, BUCKETS)] += rng.choice([-1.0, 1.0], BUCKETS).astype(np.float32)
    return out


def word_vectors(sample: DataFrame, text: str) -> np.ndarray:
    """The hashed table of context vectors over the sample, unit length."""

    def add(batches):
        index, total = index_table(), np.zeros((BUCKETS, DIMENSIONS), np.float64)
        for _, raw, offs in chunks(batches, text, CHUNK):
            h, row, _ = units(raw, offs)
            bucket = (h >> np.uint64(40)).astype(np.int64) % BUCKETS
            near = np.zeros((len(h), DIMENSIONS), np.float32)
            for d in range(1, WINDOW + 1):
                same = (row[d:] == row[:-d])[:, None]
                near[d:] += index[bucket[:-d]] * same
                near[:-d] += index[bucket[d:]] * same
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]]) if len(order) else []
            if len(order):
                total[bucket[order][cut]] += np.add.reduceat(near[order], cut)
        parts = total.astype(np.float32).reshape(SLICES, -1)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "part": pa.array([p.tobytes() for p in parts], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in table.column("part"))
        return pa.table({"slice": table.column("slice")[:1], "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    out = np.zeros((SLICES, BUCKETS * DIMENSIONS // SLICES), np.float32)
    for r in sample.select(text).mapInArrow(add, "slice int, part binary").groupBy("slice").applyInArrow(merge, "slice int, part binary").collect():
        out[r["slice"]] = np.frombuffer(r["part"], np.float32)
    out = out.reshape(BUCKETS, DIMENSIONS)
    return out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-6)


def inputs(raw: np.ndarray, offs: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Pooled word vectors and shape ratios of each text."""
    n = len(offs) - 1
    h, row, border = units(raw, offs)
    count = np.diff(border)
    size = np.maximum(np.diff(offs), 1)
    full = np.flatnonzero(count)
    mean, spread = np.zeros((n, DIMENSIONS), np.float32), np.zeros((n, DIMENSIONS), np.float32)
    if len(full):
        v = vectors[(h >> np.uint64(40)).astype(np.int64) % BUCKETS]
        mean[full] = np.add.reduceat(v, border[full]) / count[full, None]
        spread[full] = np.add.reduceat(v * v, border[full]) / count[full, None] - mean[full] ** 2
    part = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][offs]) / size
    kind = _CLASS[raw]
    distinct = np.bincount(distinct_per_row(h, row)[1], minlength=n) / np.maximum(count, 1)
    repeat = np.zeros(n)
    if len(h) > 1:
        repeat = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=n) / np.maximum(count, 1)
    shape = [part(_UPPER[raw]), part(kind == 3), part(kind == 2), part(raw == 10), part(kind == 0), distinct, repeat, np.log1p(count), size / np.maximum(count, 1) / 10.0, distinct * np.log1p(count), np.sqrt((mean**2).sum(1))]
    return np.concatenate([mean, spread, np.stack(shape, 1)], 1).astype(np.float64) * (count > 0)[:, None]


@dataclass
class Network:
    """Two dense layers over scaled inputs and one temperature."""

    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.center) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 5) -> Network:
    """Adam on the logistic loss; a fifth of the rows fits the temperature only."""
    rng = np.random.Generator(np.random.PCG64(seed))
    order = rng.permutation(len(x))
    cut = max(1, len(x) // 5)
    tune, learn = (order[:cut], order[cut:]) if len(x) > 5 else (order, order)
    center, scale = x[learn].mean(0), x[learn].std(0) + 1e-6
    net = Network(center, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), float(np.log((y[learn].mean() + 1e-3) / (1 - y[learn].mean() + 1e-3))))
    z = (x - center) / scale
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs)
        shuffled = rng.permutation(learn)
        for k in range(0, len(shuffled), 256):
            i = shuffled[k : k + 256]
            a = np.tanh(z[i] @ params[0] + params[1])
            d = (1 / (1 + np.exp(-np.clip(a @ params[2] + params[3], -40, 40))) - y[i]) / len(i)
            back = d[:, None] * params[2] * (1 - a * a)
            step += 1
            for q, g in enumerate((z[i].T @ back + 1e-4 * params[0], back.sum(0), a.T @ d + 1e-4 * params[2], np.array([d.sum()]))):
                m[q] = 0.9 * m[q] + 0.1 * g
                s[q] = 0.999 * s[q] + 0.001 * g * g
                params[q] = params[q] - rate * m[q] / (1 - 0.9**step) / (np.sqrt(s[q] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logit = net.logit(x[tune])
    loss = lambda t: np.mean(np.logaddexp(0, -np.where(y[tune] > 0, 1, -1) * logit / t))
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", bound: int = SAMPLE, scratch: Scratch | None = None) -> tuple[np.ndarray, Network | None]:
    """Word vectors and network from at most ``bound`` labelled rows outside the held-out fold."""
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    chosen = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull() & (fold_of(F.col(id)) != 0)).groupBy(id).agg(F.min(label).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64(id), id).limit(bound)  # bounded by ``bound`` short rows, so it may be broadcast
    # an id that many rows carry counts once, by the text with the least hash, so the bound holds for rows
    met = docs.select(id, text).join(F.broadcast(chosen), id).groupBy(id, "_label").agg(F.min_by(text, F.xxhash64(text)).alias(text))
    sample = scratch.save(met.repartition(32), "sample")
    vectors = word_vectors(sample, text)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def measure(batches):
        for batch, raw, offs in chunks(batches, "_text", CHUNK):
            x = inputs(raw, offs, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column("_label").cast(pa.float64()), batch.column("_key")], names=["x", "label", "key"])

    rows = sample.select(F.col(text).alias("_text"), "_label", F.xxhash64(id).alias("_key"))
    got = rows.mapInArrow(measure, "x binary, label double, key long").toArrow()
    if not len(got):
        return vectors, None
    x = np.stack([np.frombuffer(v, np.float64) for v in got.column("x").to_pylist()])
    order = np.lexsort((x[:, -1], got.column("key").to_numpy()))
    return vectors, fit(x[order], got.column("label").to_numpy()[order])


def score(docs: DataFrame, model: tuple[np.ndarray, Network | None], id: str = "doc_id", text: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of its text."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        vectors, net = shared.value
        for batch, raw, offs in chunks(batches, text, CHUNK):
            s = net.score(inputs(raw, offs, vectors)) if net else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, out])

    schema = docs.schema
    return docs.mapInArrow(run, type(schema)([*schema.fields]).add(out, "double"))


def quality_query(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from a score of 0.3)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    done = score(docs, model)
    return done.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
