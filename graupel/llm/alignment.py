"""Cross-tokenizer alignment: the tokens of two vocabularies over the same bytes.

Side A is a byte-level BPE of the tokenizers library, side B a SentencePiece model; both encode space + text
(B adds its space itself).  ``align`` works on chunks of documents as frames of tokens: ``pandas.merge_asof``,
keyed by document, finds for each token's start the other side's covering token, once in each direction; the
union is every pair of tokens whose byte ranges overlap.  Places where tokens of both sides end cut the text
into groups.

``link_counts`` counts for each pair of ids how many documents hold it linked, combined in each task before
the shuffle.  ``weigh_links`` gives a document the figures of its links: the ``COMMON`` most frequent pairs
(a fixed bound of rows, chosen by a histogram of counts) go to the tasks, all others are joined by a shuffle,
in which no pair is frequent; both give the same figures.

Texts that are null, empty or whose joined A or B bytes differ from space + text have no tokens: zeros and
empty lists.  Repeated rows are separate documents; ids may be of any type or null; columns named like an
output are replaced, all others but the text pass through; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from graupel.llm.bpe import spread
from graupel.llm.text import binary_column, chunks, string_buffer
from graupel.session import Scratch

CHUNK = 1 << 20
COMMON = 2_000_000
#: Pairs that a counting task holds before it combines them.
HELD = 2_000_000
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
#: UTF-8 lead bytes from here on begin code points from U+0240 on.
_BEYOND = 0xC9


class Vocabulary:
    """Bytes of the tokens of one side, and their decimal ids followed by each of three separators."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.named = [b"%d%c" % (i, s) for i in range(len(tokens)) for s in b",|;"]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.start[ids], self.length[ids])]


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteSide(Vocabulary):
    """Byte-level BPE from a tokenizers file.

    Texts of code points below U+0240, whose classes all versions of Unicode share, are encoded by tiktoken with the
    same merges (the ids are the ranks, which is checked); all other texts by the tokenizers library.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        vocab, alphabet = said["model"]["vocab"], byte_alphabet()
        special = {t["content"] for t in said["added_tokens"]}
        tokens = [b""] * (max([*vocab.values(), *[t["id"] for t in said["added_tokens"]]]) + 1)
        for word, i in vocab.items():
            tokens[i] = word.encode() if word in special else bytes(alphabet[c] for c in word)
        super().__init__(tokens)
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in said["model"]["merges"]]
        order = [vocab[m] for m in merges]
        ranked = order == sorted(order) and all(i < order[0] for w, i in vocab.items() if len(w) == 1) and said["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and said["normalizer"] is None
        ranks = {tokens[i]: i for w, i in vocab.items() if w not in special}
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranked else None

    def encode(self, texts: list[str], latin: np.ndarray) -> list[list[int]]:
        out: list = [None] * len(texts)
        for i in np.flatnonzero(latin) if self.fast else ():
            out[i] = self.fast.encode_ordinary(texts[i])
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.slow.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False) if rest else ()):
            out[i] = e.ids
        return out


class PieceSide(Vocabulary):
    """A SentencePiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@functools.cache
def sides(a_path: str, b_path: str) -> tuple[ByteSide, PieceSide]:
    return ByteSide(a_path), PieceSide(b_path)


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    count = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(count.sum())), count


def _matches(side: Vocabulary, ids: np.ndarray, count: np.ndarray, raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each document's tokens join to its bytes."""
    border = np.concatenate([[0], np.cumsum(count)])
    total = np.concatenate([[0], np.cumsum(side.length[ids])])[border]
    good = np.diff(total) == size
    if good.all():
        wrong = np.concatenate([[0], np.cumsum(side.joined(ids) != raw)])[np.concatenate([[0], np.cumsum(size)])]
        return np.diff(wrong) == 0
    start = np.cumsum(size) - size
    for i in np.flatnonzero(good):
        good[i] = np.array_equal(side.joined(ids[border[i] : border[i + 1]]), raw[start[i] : start[i] + size[i]])
    return good


def _groups(a: Vocabulary, b: Vocabulary, a_ids, b_ids, a_cut, b_cut, a_doc, b_doc, rows: int) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each document; the cuts mark tokens that end where the other side has an end as well."""
    a_group, b_group = (np.cumsum(c) - c for c in (a_cut, b_cut))
    groups = int(a_cut.sum())
    a_before = np.concatenate([[0], np.cumsum(np.bincount(a_group, minlength=groups))])
    b_before = np.concatenate([[0], np.cumsum(np.bincount(b_group, minlength=groups))])
    code = np.empty(len(a_ids) + len(b_ids), np.int64)
    code[np.arange(len(a_ids)) + b_before[a_group]] = 3 * a_ids + a_cut
    code[np.arange(len(b_ids)) + a_before[b_group + 1]] = 3 * b_ids + 2 * b_cut + 3 * len(a.length)
    named = a.named + b.named
    words = list(map(named.__getitem__, code.tolist()))
    ends = np.cumsum(np.bincount(a_doc, minlength=rows) + np.bincount(b_doc, minlength=rows)).tolist()
    return [b"".join(words[s:e])[:-1] for s, e in zip([0, *ends[:-1]], ends)]


def aligned(texts: list[str], a: ByteSide, b: PieceSide):
    """Counts (rows x 4), groups, and distinct links (row, pair, times) of some documents; pair = A id * size of B + B id."""
    n = len(texts)
    given = np.array([bool(t) for t in texts], bool)
    spaced = [" " + t for t in texts]
    raw, offs = string_buffer(pa.array(spaced, pa.large_string()))
    size = np.diff(offs)
    highest = np.maximum.reduceat(raw, offs[:-1]) if n else np.zeros(0, np.uint8)
    a_ids, a_count = _flat(a.encode(spaced, highest < _BEYOND))
    b_ids, b_count = _flat(b.encode(texts))
    good = given & _matches(a, a_ids, a_count, raw, size) & _matches(b, b_ids, b_count, raw, size)
    a_ids, b_ids = a_ids[np.repeat(good, a_count)], b_ids[np.repeat(good, b_count)]
    a_count, b_count = a_count * good, b_count * good
    a_doc, b_doc = np.repeat(np.arange(n), a_count), np.repeat(np.arange(n), b_count)
    a_end, b_end = np.cumsum(a.length[a_ids]), np.cumsum(b.length[b_ids])
    one = pd.DataFrame({"doc": a_doc, "start": a_end - a.length[a_ids], "a": a_ids})
    two = pd.DataFrame({"doc": b_doc, "start": b_end - b.length[b_ids], "b": b_ids})
    ahead = pd.merge_asof(one, two, on="start", by="doc")
    behind = pd.merge_asof(two, one.assign(own=one["start"]), on="start", by="doc")
    behind = behind[behind["own"].to_numpy() != behind["start"].to_numpy()]  # equal starts are in the other direction already
    doc = np.concatenate([ahead["doc"], behind["doc"]])
    pair = np.concatenate([ahead["a"].to_numpy(np.int64), behind["a"].to_numpy(np.int64)]) * len(b.length) + np.concatenate([ahead["b"].to_numpy(np.int64), behind["b"].to_numpy(np.int64)])
    shared = np.zeros(int(a_end[-1]) + 1 if len(a_end) else 1, bool)
    shared[b_end] = True
    a_cut = shared[a_end]
    shared[:] = False
    shared[a_end] = True
    b_cut = shared[b_end]
    counts = np.stack([a_count, b_count, np.bincount(a_doc[a_cut], minlength=n), np.bincount(doc, minlength=n)], 1)
    key, times = np.unique(doc * (len(a.length) * len(b.length)) + pair, return_counts=True)
    row, pair = np.divmod(key, len(a.length) * len(b.length))
    return counts, _groups(a, b, a_ids, b_ids, a_cut, b_cut, a_doc, b_doc, n), (row, pair, times)


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """All columns but the text, then n_a, n_b, n_groups, n_links, groups (binary), pairs and times.

    ``pairs`` are a document's distinct links (A id * size of B + B id, ascending) as differences in little-endian
    64-bit integers, each byte plane together; ``times`` (unsigned 32-bit) says how often each occurs.
    """
    added = [*[T.StructField(c, T.LongType()) for c in COUNTS], *[T.StructField(c, T.BinaryType()) for c in ("groups", "pairs", "times")]]
    base = docs.drop(*[f.name for f in added if f.name != text])
    kept = [f for f in base.schema.fields if f.name != text]

    def run(batches):
        a, b = sides(a_path, b_path)
        for batch, _, _ in chunks(batches, text, CHUNK):
            counts, groups, (row, pair, times) = aligned([t or "" for t in batch.column(text).to_pylist()], a, b)
            border = np.searchsorted(row, np.arange(batch.num_rows + 1))
            packed = pa.array([_packed(pair[i:j]) for i, j in zip(border[:-1], border[1:])], pa.binary())
            made = [*[pa.array(c, pa.int64()) for c in counts.T], pa.array(groups, pa.binary()), packed, binary_column(times.astype("<u4"), border)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *made], names=[*[f.name for f in kept], *[f.name for f in added]])

    return base.mapInArrow(run, T.StructType([*kept, *added]))


def _packed(pair: np.ndarray) -> bytes:
    """Differences of ascending numbers, byte plane after byte plane (which compresses well)."""
    return np.diff(pair, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, pair and times of all links of a batch with columns ``pairs`` and ``times``."""
    pairs = [np.cumsum(np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(8, -1).T).view("<i8").ravel()) for p in batch.column("pairs").to_pylist()]
    times = [np.frombuffer(t, "<u4") for t in batch.column("times").to_pylist()]
    row = np.repeat(np.arange(batch.num_rows), [len(p) for p in pairs])
    empty = [np.zeros(0, np.int64)]
    return row, np.concatenate(pairs + empty), np.concatenate(times + empty).astype(np.int64)


def link_counts(done: DataFrame, b_size: int) -> DataFrame:
    """pair, a, n (documents that hold it) and best (whether n is the highest of the pairs with this A id)."""

    def tally(batches):
        held, many = [], 0

        def flush():
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                _, pair, _ = unpacked(batch.slice(k, 1024))
                held.append(pair)
                many += len(pair)
                if many >= HELD:
                    yield flush()
                    held, many = [], 0
        if many:
            yield flush()

    counted = done.select("pairs", "times").mapInArrow(tally, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = counted.withColumn("a", F.expr(f"pair div {b_size}"))
    most = counted.groupBy("a").agg(F.max("n").alias("most"))
    return counted.join(most, "a").select("pair", "a", "n", (F.col("n") == F.col("most")).alias("best"))


def weigh_links(done: DataFrame, counts: DataFrame, key: str, common: int = COMMON) -> DataFrame:
    """``done`` without pairs and times, with n_best and count_sum; ``key`` names its rows, both are written tables."""
    spark = done.sparkSession
    level = F.floor(F.log2("n")).cast("int")
    room, lowest = common, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # at most 64 rows
        room -= r["count"]
        if room < 0:
            lowest = r["level"] + 1
            break
    near = counts.where(level >= lowest).select("pair", "n", "best").toArrow()  # at most ``common`` rows
    order = np.argsort(near.column("pair").to_numpy())
    table = spark.sparkContext.broadcast(tuple(near.column(c).to_numpy()[order] for c in ("pair", "n", "best")))
    base = done.drop("n_best", "count_sum")
    kept = [f for f in base.schema.fields if f.name not in ("pairs", "times")]

    def look_up(batches):
        pairs, n, best = table.value
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                row, pair, times = unpacked(part)
                at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
                found = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
                at, where, weight = at[found], row[found], times[found]
                add = lambda v: pa.array(np.bincount(where, v, part.num_rows).astype(np.int64), pa.int64())
                border = np.searchsorted(row[~found], np.arange(part.num_rows + 1))
                left = pa.ListArray.from_arrays(pa.array(border, pa.int32()), pa.StructArray.from_arrays([pa.array(pair[~found]), pa.array(times[~found])], names=["pair", "times"]))
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], add(weight * best[at]), add(weight * n[at]), left], names=[*[f.name for f in kept], "n_best", "count_sum", "_left"])

    link = T.ArrayType(T.StructType([T.StructField("pair", T.LongType()), T.StructField("times", T.LongType())]))
    out = base.mapInArrow(look_up, T.StructType([*kept, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("_left", link)]))
    if not lowest:
        return out.drop("_left")
    rare = out.select(F.col(key).alias("_key"), F.explode("_left").alias("l")).select("_key", "l.*").join(counts.where(level < lowest).select("pair", "n", "best"), "pair")
    rare = rare.groupBy("_key").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    joined = out.drop("_left").join(rare, F.col(key) == F.col("_key"), "left")
    return joined.withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))}).drop("_key", "_best", "_sum")


def alignment_query(spark, sf_dir: str, common: int = COMMON) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import public_tokenizers as pt

    paths = pt.path("byte_bpe_50k.json"), pt.path("piece_bpe_32k.model")
    scratch = Scratch(spark, "alignment")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = align(docs, *paths).select("doc_id", *COUNTS, F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"), "pairs", "times", F.monotonically_increasing_id().alias("_row"))
    done = scratch.save(found, "documents")
    counts = scratch.save(link_counts(done, len(sides(*paths)[1].length)), "pairs")
    return weigh_links(done, counts, "_row", common).select("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256")
