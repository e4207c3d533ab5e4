"""Language ID: a bidirectional gated recurrent network over UTF-8 bytes, trained by backpropagation through time.

A text is cut into windows of ``WINDOW`` bytes, each byte in exactly one of them; two gated recurrent layers
(one reads forwards, one backwards, both from a zero state at the window's border) give every position a
probability for each language, and a text's probabilities are the mean over all its positions.  Gates are
clipped straight lines, so a step needs one tanh.  Arrays lie features x windows; the windows of a chunk are
put in order of length, so that step t touches only those that have a byte there.

The network learns from at most ``LANGUAGES`` languages (the most frequent), ``PER_LANGUAGE`` documents of
each (least hash of the id) and ``PIECES`` windows of a document, spread evenly over it: documented bounds,
kept by a cut of the hash before any row moves, then by rank.  Rows with a null language or without a letter aren't learned
from.  Everything else streams the whole table once.

Null texts and texts without a letter are ``und`` with a score of 0; so is every text if nothing could be
learned.  Equal scores go to the language that sorts first.  Ids may be of any type, repeated rows are
separate rows, columns named like an output are replaced, an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from graupel.llm.text import chunks

WINDOW = 128
HIDDEN = 8
LANGUAGES = 200
PER_LANGUAGE = 500
PIECES = 6
STEPS = 140
BATCH = 192
#: Windows that one pass of the network holds.
WIDE = 2048
CHUNK = 1 << 20
FOLDS, HELD = 4, 2
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def fold_of(id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(id.cast("string"), F.lit("")), "UTF-8")) % FOLDS


@dataclass
class Layer:
    """One direction: byte inputs (3H x 256) with biases, and recurrent weights (3H x H); gates are z, r, n."""

    bytes: np.ndarray
    past: np.ndarray

    def run(self, codes: np.ndarray, live: np.ndarray, steps, keep: list | None = None) -> np.ndarray:
        """States (time, H, windows) of bytes (time, windows), of which the first ``live[t]`` count at t."""
        size = self.past.shape[1]
        state = np.zeros((size, codes.shape[1]), np.float32)
        out = np.zeros((len(live), size, codes.shape[1]), np.float32)
        for t in steps:
            n = live[t]
            h = state[:, :n]
            x = np.take(self.bytes, codes[t, :n], 1, mode="clip")
            u = self.past @ h
            gate = x[: 2 * size]
            gate += u[: 2 * size]
            gate *= 0.25
            gate += 0.5
            np.clip(gate, 0, 1, out=gate)
            new = x[2 * size :] + gate[size:] * u[2 * size :]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((t, n, h.copy(), gate, u[2 * size :], new))
            np.subtract(h, new, out=h)
            h *= gate[:size]
            h += new
            out[t, :, :n] = h
        return out

    def back(self, kept: list, grad: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of ``bytes`` and ``past`` from those of the states, through time."""
        size = self.past.shape[1]
        carry = np.zeros(grad.shape[1:], np.float32)
        d_past, d_x, where = np.zeros_like(self.past), [], []
        for t, n, h, gate, u, new in reversed(kept):
            d = carry[:, :n] + grad[t, :, :n]
            z, r = gate[:size], gate[size:]
            d_new = d * (1 - z) * (1 - new * new)
            d_gate = np.concatenate([d * (h - new), d_new * u]) * (0.25 * ((gate > 0) & (gate < 1)))
            d_u = np.concatenate([d_gate, d_new * r])
            d_past += d_u @ h.T
            carry[:, :n] = d * z + self.past.T @ d_u
            d_x.append(np.concatenate([d_gate, d_new]))
            where.append(codes[t, :n])
        flat, at = np.concatenate(d_x, 1), np.concatenate(where)
        return np.stack([np.bincount(at, row, 256) for row in flat]).astype(np.float32), d_past


@dataclass
class Network:
    """Both directions and the linear layer over their states; ``names`` are the languages in order."""

    names: list[str]
    forward: Layer
    backward: Layer
    out: np.ndarray
    bias: np.ndarray

    def positions(self, codes: np.ndarray, live: np.ndarray, keep: tuple | None = None):
        """Probabilities (time, languages, windows); with ``keep`` the states as well."""
        last = len(live)
        ahead, behind = keep or (None, None)
        a = self.forward.run(codes, live, range(last), ahead)
        b = self.backward.run(codes, live, range(last - 1, -1, -1), behind)
        size = a.shape[1]
        p = self.out[:, :size] @ a
        p += self.out[:, size:] @ b
        p += self.bias[:, None]
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        return p if keep is None else (p, a, b)

    def weights(self) -> list[np.ndarray]:
        return [self.forward.bytes, self.forward.past, self.backward.bytes, self.backward.past, self.out, self.bias]

    def gradients(self, codes: np.ndarray, live: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy of all positions with their window's label."""
        kept: tuple[list, list] = ([], [])
        p, a, b = self.positions(codes, live, kept)
        p[:, label, np.arange(len(label))] -= 1
        p *= (np.arange(len(label)) < live[:, None])[:, None, :] / np.float32(live.sum())
        size = a.shape[1]
        d_out = np.concatenate([np.einsum("tlb,thb->lh", p, s, optimize=True) for s in (a, b)], 1)
        up = self.forward.back(kept[0], self.out[:, :size].T @ p, codes)
        down = self.backward.back(kept[1], self.out[:, size:].T @ p, codes)
        return [*up, *down, d_out, p.sum((0, 2))]


def arranged(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (time, windows) of the windows, longest first; the windows with a byte at each time; their order."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    time = np.arange(size[0] if len(size) else 0)
    codes = raw[np.minimum(start + time[:, None], len(raw) - 1)]
    return codes.astype(np.intp), np.searchsorted(-size, -time, "left"), order


def fit(raw: np.ndarray, start: np.ndarray, size: np.ndarray, label: np.ndarray, names: list[str], steps: int = STEPS, hidden: int = HIDDEN, seed: int = 3) -> Network:
    """Adam over batches that hold every language equally often."""
    rng = np.random.Generator(np.random.PCG64(seed))
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    layer = lambda: Layer(normal(0.5, 3 * hidden, 256), normal(hidden**-0.5, 3 * hidden, hidden))
    net = Network(names, layer(), layer(), normal(0.3, len(names), 2 * hidden), np.zeros(len(names), np.float32))
    weights = net.weights()
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    own = [np.flatnonzero(label == k) for k in range(len(names))]
    for step in range(1, steps + 1):
        drawn = np.array([rng.choice(own[k]) for k in rng.integers(0, len(names), BATCH)])
        codes, live, order = arranged(raw, start[drawn], size[drawn])
        grads = net.gradients(codes, live, label[drawn][order])
        long = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1.0, step / 20) * (1 - step / (steps + 1)) + 1e-4
        for w, g, m, s in zip(weights, grads, mean, square, strict=True):
            g = g / max(1.0, long)
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
    return net


def has_letter(column: pa.Array, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter; only texts without an ASCII letter are looked at as characters."""
    seen = np.concatenate([[0], np.cumsum(_LETTER[raw])])[offs]
    found = seen[1:] > seen[:-1]
    for i in np.flatnonzero(~found & (np.diff(offs) > 0)):
        found[i] = any(map(str.isalpha, column[i].as_py()))
    return found


def _windows(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and row of the windows of all rows."""
    count = -(-np.diff(offs) // WINDOW)
    row = np.repeat(np.arange(len(count)), count)
    start = offs[row] + WINDOW * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    return start, np.minimum(start + WINDOW, offs[row + 1]) - start, row


def probabilities(net: Network, raw: np.ndarray, offs: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Pooled probabilities (rows, languages); ``labels`` (one per byte), if given, takes the likeliest language of each byte."""
    start, size, row = _windows(offs)
    total = np.zeros((len(offs) - 1, len(net.names)))
    for k in range(0, len(start), WIDE):
        codes, live, order = arranged(raw, start[k : k + WIDE], size[k : k + WIDE])
        p = net.positions(codes, live)
        p *= (np.arange(p.shape[2]) < live[:, None])[:, None, :]
        np.add.at(total, row[k : k + WIDE][order], p.sum(0).T.astype(np.float64))
        if labels is not None:
            t, w = np.nonzero(np.arange(p.shape[2]) < live[:, None])
            labels[start[k : k + WIDE][order][w] + t] = p.argmax(1)[t, w]
    return total / np.maximum(np.diff(offs), 1)[:, None]


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> Network | None:
    """The network learned from ``docs`` (all of them; leave out held-out rows before)."""
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    raw = F.encode(text, "UTF-8")
    room = F.greatest(F.octet_length(text) - WINDOW, F.lit(0))
    piece = lambda k: F.substring(F.col("_raw"), (F.col("_room") * k / max(PIECES - 1, 1)).cast("int") + 1, F.lit(WINDOW))
    rows = usable.select(F.col(lang).cast("string").alias("_lang"), F.xxhash64(F.col(id).cast("string")).alias("_key"), raw.alias("_raw"), room.alias("_room"))
    rows = rows.select("_lang", "_key", F.array_distinct(F.array(*[piece(F.lit(k)) for k in range(PIECES)])).alias("_piece"))
    at = F.col("_key") / float(2**64) + 0.5
    found = rows.groupBy("_lang").agg(F.count("*").alias("n"), F.min(at).alias("least")).orderBy(F.desc("n"), "_lang").limit(languages)
    common = {r["_lang"]: max(min(1.0, 4 * per_language / r["n"]), r["least"]) for r in found.collect()}
    if not common:
        return None
    # the keys are even, so the least ones lie below a share of their range; only rows below four times that share (or of the least key) move
    share = F.create_map(*[F.lit(x) for pair in common.items() for x in pair])[F.col("_lang")]
    low = rows.where(F.col("_lang").isin(list(common)) & (at <= share))
    ranked = low.withColumn("_rank", F.row_number().over(Window.partitionBy("_lang").orderBy("_key", "_piece")))
    got = ranked.where(F.col("_rank") <= per_language).select("_lang", "_key", F.explode("_piece").alias("_piece")).toArrow()
    if not got.num_rows:
        return None
    names = sorted(set(got.column("_lang").to_pylist()))
    parts = sorted(zip(got.column("_lang").to_pylist(), got.column("_key").to_pylist(), got.column("_piece").to_pylist()))
    size = np.array([len(p) for _, _, p in parts])
    raw_bytes = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
    return fit(raw_bytes, np.cumsum(size) - size, size, np.array([names.index(x) for x, _, _ in parts]), names)


def identify(docs: DataFrame, net: Network | None, text: str = "text", pred: str = "lang_pred", score: str = "score", spans: str | None = None) -> DataFrame:
    """All columns of ``docs``, the likeliest language of its text and its pooled probability.

    ``spans``, if named, is a column of the runs of equal labels: (start, end, lang) in bytes.
    """
    docs = docs.drop(pred, score, *([spans] if spans else []))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    added = [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]
    run_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))
    if spans:
        added.append(T.StructField(spans, run_type))
    runs_arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        net = shared.value
        for batch, raw, offs in chunks(batches, text, CHUNK):
            known = has_letter(batch.column(text), raw, offs) if net else np.zeros(batch.num_rows, bool)
            labels = np.zeros(len(raw), np.int64) if spans else None
            p = probabilities(net, raw, offs, labels) if net else np.zeros((batch.num_rows, 1))
            best = p.argmax(1)
            names = np.array([*net.names, UNKNOWN] if net else [UNKNOWN, UNKNOWN], object)
            out = [pa.array(names[np.where(known, best, -1)], pa.string()), pa.array(np.where(known, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0), pa.float64())]
            if spans:
                made = []
                for i, (a, b) in enumerate(zip(offs[:-1], offs[1:])):
                    cut = np.flatnonzero(np.diff(labels[a:b])) + 1
                    ends = [0, *cut.tolist(), int(b - a)]
                    made.append([(s, e, names[labels[a + s]]) for s, e in zip(ends[:-1], ends[1:])] if known[i] else [])
                out.append(pa.array([[dict(zip(("start", "end", "lang"), r)) for r in m] for m in made], runs_arrow))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *[f.name for f in added]])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def language_query(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    net = train(docs.where(fold_of(F.col("doc_id")) != HELD))
    done = identify(docs.drop("lang"), net)
    return done.select("doc_id", (fold_of(F.col("doc_id")) == HELD).alias("held_out"), "lang_pred", "score")
