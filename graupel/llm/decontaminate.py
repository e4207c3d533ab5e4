"""Benchmark decontamination by greedy string tiling (Wise 1993, Running Karp-Rabin).

Word runs of ``minimum`` words (all words of a shorter item) that a document shares with a
benchmark item are seeds.  For document-item pairs whose shared seeds could reach the threshold, the
common runs are found by the hashes of their windows, and the longest one is marked again and again without overlap, down to
the minimum; what a longer tile leaves of a run comes back as shorter ones.  The tiles may lie in any order, so reordered
passages count.  A document is contaminated by an item when tiles cover ``threshold`` of the item's words.

A benchmark of up to ``BLOCK_BYTES`` of text (checked) is sent to the tasks, and documents stream by it without a shuffle.
A larger one isn't gathered anywhere: its seeds fill a bitmap of fixed size, the documents' runs that it knows meet the
seeds in a shuffled join, and the pairs that could reach the threshold are tiled with their texts.

Words are split at ASCII white space and A-Z is lower-cased.  Item ids are integers (others raise TypeError) or null, which is an id like others.  Null or empty
texts and items match nothing; a document row or an item row that is repeated is reported each time, both ways; extra columns of any name pass through.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from graupel.llm.text import Words, chunks, mix, powers
from graupel.session import Scratch

MINIMUM = 5
THRESHOLD = 0.5
BLOCK_BYTES = 8 << 20
#: Bits of the bitmap of seeds (8 MB), and rows in which its parts are merged.
BITS = 26
SLICES = 64
#: Digests of 32 bytes that may be broadcast.
FEW = 200_000


def _runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words (row borders not regarded)."""
    up, _ = powers(size + 1)
    out = np.zeros(max(len(hashes) - size + 1, 0), np.uint64)
    for j in range(size):
        out += hashes[j : j + len(out)] * up[j]
    return mix(out ^ np.uint64(size))


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count of them) for each pair, one after another."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def common_runs(pattern: np.ndarray, text: np.ndarray, minimum: int, piece: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pattern start, text start and length of every maximal common run of at least ``minimum`` words.

    A run starts where the windows of ``minimum`` words are equal and the words before them aren't; only such pairs are listed, so
    repeated words cost one entry for each diagonal and not one for each pair of places.  Lengths come from binary search over prefix hashes.
    ``piece``: pieces of the text that no run crosses.
    """
    m, n = len(pattern), len(text)
    piece = np.zeros(n, np.int64) if piece is None else piece
    h = _runs(text, minimum)
    inside = np.flatnonzero(piece[: len(h)] == piece[minimum - 1 : minimum - 1 + len(h)])
    head = np.r_[True, piece[1:] != piece[:-1]] if n else np.zeros(0, bool)
    _, code = np.unique(np.concatenate([pattern, text]), return_inverse=True)
    before_p = np.r_[-1, code[:m][:-1]] if m else code[:0]
    before_t = np.where(head, -2, np.r_[-2, code[m:][:-1]]) if n else code[:0]
    known, seed = np.unique(_runs(pattern, minimum), return_inverse=True)
    at = np.searchsorted(known, h[inside])
    fits = known[np.minimum(at, len(known) - 1)] == h[inside] if len(known) else np.zeros(len(inside), bool)
    t, t_seed = inside[fits], at[fits]
    width = int(code.max(initial=0)) + 3
    key = t_seed * width + before_t[t] + 2
    order = np.argsort(key, kind="stable")
    t, key = t[order], key[order]
    low, high = np.searchsorted(key, seed * width), np.searchsorted(key, (seed + 1) * width)
    own = seed * width + before_p[: len(seed)] + 2
    same_low, same_high = np.searchsorted(key, own), np.searchsorted(key, own, "right")
    place = np.arange(len(seed))
    p = np.concatenate([np.repeat(place, same_low - low), np.repeat(place, high - same_high)])
    q = np.concatenate([t[_ranges(low, same_low - low)], t[_ranges(same_high, high - same_high)]])
    up, _ = powers(max(m, n) + 1)
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[: len(x)], dtype=np.uint64)]) for x in (mix(pattern), mix(text))]
    left = np.searchsorted(piece, piece[q], "right") - q if n else q
    good, bad = np.full(len(p), minimum), np.minimum(m - p, left) + 1
    while (open_ := bad - good > 1).any():
        mid = np.where(open_, (good + bad) // 2, good)
        one, two = sums[0][p + mid] - sums[0][p], sums[1][q + mid] - sums[1][q]
        shift = q - p  # both sums are brought to the higher power
        equal = np.where(shift >= 0, one * up[np.maximum(shift, 0)], one) == np.where(shift < 0, two * up[np.maximum(-shift, 0)], two)
        good, bad = np.where(open_ & equal, mid, good), np.where(open_ & ~equal, mid, bad)
    return p, q, good


def greedy_tiles(pattern: np.ndarray, text: np.ndarray, minimum: int, piece: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Non-overlapping common runs of at least ``minimum``, longest first (of equals the one first in pattern, then text).

    (pattern start, text start, length); ``piece``: ascending numbers of the pieces of the text that no run crosses.
    """
    p, t, length = common_runs(pattern, text, minimum, piece)
    heap = list(zip((-length).tolist(), p.tolist(), t.tolist(), strict=True))
    heapq.heapify(heap)
    used_p, used_t = np.zeros(len(pattern), bool), np.zeros(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    left = len(pattern)
    while heap and left >= minimum:
        n, p0, t0 = heapq.heappop(heap)
        taken = used_p[p0 : p0 - n] | used_t[t0 : t0 - n]
        if not taken.any():
            used_p[p0 : p0 - n] = used_t[t0 : t0 - n] = True
            tiles.append((p0, t0, -n))
            left += n
            continue
        edge = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # what is free of the run
            if b - a >= minimum:
                heapq.heappush(heap, (a - b, p0 + a, t0 + a))
    return tiles


@dataclass
class Items:
    """A block of benchmark items and its seed table."""

    ids: list
    words: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # run length: distinct hashes, where the entries of each begin, item and place of each entry
    minimum: int

    @classmethod
    def of(cls, table: pa.Table, minimum: int) -> Items:
        ids, words = [], []
        for batch in table.to_batches():
            for part, raw, offs in chunks([batch], "text"):
                w = Words(raw, offs)
                ids += part.column("item_id").to_pylist()
                words += [w.hash[a:b] for a, b in zip(w.offs[:-1], w.offs[1:], strict=True)]
        seeds = {}
        for size in sorted({min(minimum, len(w)) for w in words} - {0}):
            own = [i for i, w in enumerate(words) if min(minimum, len(w)) == size]
            h = [_runs(words[i], size) for i in own]
            flat, item = np.concatenate(h), np.repeat(own, [len(x) for x in h])
            place = np.concatenate([np.arange(len(x)) for x in h])
            order = np.argsort(flat, kind="stable")
            known, first = np.unique(flat[order], return_index=True)
            seeds[size] = known, np.append(first, len(flat)), item[order], place[order]
        return cls(ids, words, seeds, minimum)


def _matches(words: Words, items: Items, threshold: float):
    """(row, item, tiles) for every pair that reaches the threshold."""
    for size, (table, first, item_of, place_of) in items.seeds.items():
        h = _runs(words.hash, size)
        whole = words.row[: len(h)] == words.row[size - 1 : size - 1 + len(h)]
        seed = np.searchsorted(table, h)
        hit = np.flatnonzero(whole & (table[np.minimum(seed, len(table) - 1)] == h))
        if not len(hit):
            continue
        seed, border = seed[hit], np.searchsorted(words.row[hit], np.arange(len(words.offs)))
        row, once = np.divmod(np.unique(words.row[hit].astype(np.int64) * len(table) + seed), len(table))  # a row's seeds, each once
        count = first[once + 1] - first[once]
        at = _ranges(first[once], count)
        row, item, place, of = np.repeat(row, count), item_of[at], place_of[at], np.repeat(once, count)
        order = np.lexsort((item, row))
        row, item, place, of = row[order], item[order], place[order], of[order]
        cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])])
        for i, j in zip(cut, np.r_[cut[1:], len(row)], strict=True):
            pattern = items.words[item[i]]
            if (j - i) * size < threshold * len(pattern):
                continue
            reach = np.zeros(len(pattern) + 1, np.int64)
            np.add.at(reach, place[i:j], 1)
            np.add.at(reach, place[i:j] + size, -1)
            if (np.cumsum(reach)[:-1] > 0).sum() < threshold * len(pattern):
                continue
            own = slice(border[row[i]], border[row[i] + 1])
            spots = hit[own][np.isin(seed[own], of[i:j])]
            cover = np.unique((spots[:, None] + np.arange(size)).ravel())
            tiles = greedy_tiles(pattern, words.hash[cover], size, np.cumsum(np.r_[0, np.diff(cover) > 1]))
            if sum(n for _, _, n in tiles) >= threshold * len(pattern):
                start = int(words.offs[row[i]])
                yield int(row[i]), int(item[i]), sorted((p, int(cover[t]) - start, n) for p, t, n in tiles)


_TILES = "array<struct<item_start: long, doc_start: long, words: long>>"


def _found(batch, row: int, items: Items, item: int, tiles: list, id: str) -> tuple:
    n, covered = len(items.words[item]), sum(t[2] for t in tiles)
    return batch.column(id)[row].as_py(), items.ids[item], n, covered, covered / n, [{"item_start": p, "doc_start": t, "words": k} for p, t, k in tiles]


def _table(rows: list[tuple], id: str, kind: pa.DataType, item: str = "item_id", item_kind: pa.DataType = pa.int64()) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
    tile = pa.list_(pa.struct([("item_start", pa.int64()), ("doc_start", pa.int64()), ("words", pa.int64())]))
    types = (kind, item_kind, pa.int64(), pa.int64(), pa.float64(), tile)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[id, item, "item_words", "covered", "coverage", "tiles"])


def _small(docs: DataFrame, items: DataFrame, id: str, text: str, threshold: float, minimum: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Items.of(items.toArrow(), minimum))

    def find(batches):
        for batch, raw, offs in chunks(batches, text):
            if rows := [_found(batch, row, shared.value, item, tiles, id) for row, item, tiles in _matches(Words(raw, offs), shared.value, threshold)]:
                yield _table(rows, id, batch.column(id).type)

    return docs.select(id, text).mapInArrow(find, f"{id} {docs.schema[id].dataType.simpleString()}, item_id long, item_words long, covered long, coverage double, tiles {_TILES}")


def _seeds(items: DataFrame, minimum: int) -> DataFrame:
    """seed, size, item, place, item_words for every seed of every item (columns item and text)."""

    def seeds(batches):
        for batch, raw, offs in chunks(batches, "text"):
            w = Words(raw, offs)
            name = batch.column("item")
            count = np.diff(w.offs)
            for size in np.unique(np.minimum(count, minimum)):
                if size:
                    h = _runs(w.hash, int(size))
                    row = w.row[: len(h)]
                    ok = (row == w.row[size - 1 : size - 1 + len(h)]) & (np.minimum(count, minimum)[row] == size)
                    row = row[ok]
                    yield pa.RecordBatch.from_pydict({"seed": h[ok].view(np.int64), "size": np.full(len(row), size, np.int32), "item": name.take(pa.array(row)), "place": np.flatnonzero(ok) - w.offs[row], "item_words": count[row]})

    return items.mapInArrow(seeds, "seed long, size int, item string, place long, item_words long")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """Which hashes occur among the seeds, by ``BITS`` bits: a table of fixed size whatever the benchmark."""

    def mark(batches):
        bits = np.zeros(1 << BITS - 3, np.uint8)
        for batch in batches:
            at = batch.column("seed").to_numpy().view(np.uint64) >> np.uint64(64 - BITS)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "part": pa.array([p.tobytes() for p in bits.reshape(SLICES, -1)], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        total = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in table.column("part")])
        return pa.table({"slice": table.column("slice")[:1], "part": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((SLICES, (1 << BITS - 3) // SLICES), np.uint8)
    for r in seeds.mapInArrow(mark, "slice int, part binary").groupBy("slice").applyInArrow(merge, "slice int, part binary").collect():
        out[r["slice"]] = np.frombuffer(r["part"], np.uint8)
    return out.ravel()


def _few(names: DataFrame) -> DataFrame:
    """Names to look up: broadcast up to ``FEW`` of them (counted), so that what is looked through needn't be shuffled."""
    return F.broadcast(names) if names.limit(FEW + 1).count() <= FEW else names


def _large(texts: DataFrame, items: DataFrame, threshold: float, minimum: int, scratch: Scratch) -> DataFrame:
    """name and item (digests of the texts), item_words, covered, coverage, tiles, for every two texts that reach the threshold.

    ``texts`` (name, text) and ``items`` (item, text) may repeat; a repeated text is looked at once.  A pair that reaches it shares so
    many places of the item that one of them is left when the most frequent ``share - 1`` of the places are left out: these seeds alone make
    candidates, so one that many items begin with makes none, and all seeds of the candidates are counted.
    """
    seeds = scratch.save(_seeds(items.groupBy("item").agg(F.any_value("text").alias("text")), minimum), "seeds")
    often = seeds.groupBy("seed", "size").agg(F.count("*").alias("often"))
    needed = F.ceil(F.col("item_words") * threshold / F.col("size"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("often", "seed", "place"))
    rare = seeds.join(often, ["seed", "size"]).withColumn("_rank", rank).where(F.col("_rank") <= F.col("item_words") - F.col("size") + 2 - needed)
    rare = scratch.save(rare.select("seed", "size", "item").distinct(), "rare")
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())  # at most ``minimum`` numbers
    shared = texts.sparkSession.sparkContext.broadcast(_bitmap(seeds))

    def known(batches):
        for batch, raw, offs in chunks(batches, "text"):
            w = Words(raw, offs)
            for size in sizes:
                h = _runs(w.hash, size)
                at = h >> np.uint64(64 - BITS)
                ok = (w.row[: len(h)] == w.row[size - 1 : size - 1 + len(h)]) & (shared.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0)
                pairs = np.unique(np.stack([w.row[: len(h)][ok], h[ok].view(np.int64)], 1), axis=0)
                yield pa.RecordBatch.from_pydict({"name": batch.column("name").take(pa.array(pairs[:, 0])), "seed": pairs[:, 1], "size": np.full(len(pairs), size, np.int32)})

    hits = scratch.save(texts.select("name", "text").mapInArrow(known, "name string, seed long, size int").distinct(), "hits")
    maybe = hits.join(rare, ["seed", "size"]).select("name", "item", "size").distinct()
    counted = maybe.join(hits, ["name", "size"]).join(seeds, ["item", "seed", "size"]).groupBy("name", "item")
    counted = counted.agg(F.countDistinct("place").alias("n"), F.first("size").alias("size"), F.first("item_words").alias("words"))
    pairs = scratch.save(counted.where(F.col("n") * F.col("size") >= F.col("words") * threshold).select("name", "item"), "pairs")
    # only texts of these pairs move
    some = texts.join(_few(pairs.select("name").distinct()), "name", "left_semi").groupBy("name").agg(F.any_value("text").alias("text"))
    own = items.join(pairs.select("item").distinct(), "item", "left_semi").groupBy("item").agg(F.any_value("text").alias("item_text"))
    both = pairs.join(some, "name").join(own, "item").select("name", "item", "text", "item_text")

    def find(batches):
        for batch, raw, offs in chunks(batches, "text"):
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                item = Items.of(pa.table({"item_id": one.column("item"), "text": one.column("item_text")}), minimum)
                words = Words(raw[offs[k] : offs[k + 1]], offs[k : k + 2] - offs[k])
                if found := [_found(one, 0, item, 0, tiles, "name") for _, _, tiles in _matches(words, item, threshold)]:
                    yield _table(found, "name", one.column("name").type, "item", pa.string())

    return scratch.save(both.mapInArrow(find, f"name string, item string, item_words long, covered long, coverage double, tiles {_TILES}"), "found")


def _items(benchmark: DataFrame) -> DataFrame:
    if not isinstance(benchmark.schema["item_id"].dataType, T.IntegralType):
        raise TypeError("item_id must be an integer column")
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")


def contamination(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, minimum: int = MINIMUM, scratch: Scratch | None = None) -> DataFrame:
    """Contaminated document-item pairs: id, item_id, item_words, covered, coverage, tiles (item start, document start, words)."""
    items = _items(benchmark)
    if _bytes(items) <= BLOCK_BYTES:
        return _small(docs, items, id, text, threshold, minimum)
    named, of = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.md5(F.encode(text, "UTF-8")).alias("name")), items.withColumn("item", F.md5(F.encode("text", "UTF-8")))
    found = _large(named, of, threshold, minimum, scratch or Scratch(docs.sparkSession, "tiling"))
    # every row of the texts and of the items, as often as it is there
    out = found.join(named.select("id", "name"), "name").join(of.select("item", "item_id"), "item")
    return out.select(F.col("id").alias(id), "item_id", "item_words", "covered", "coverage", "tiles")


def _bytes(items: DataFrame) -> int:
    return items.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD, minimum: int = MINIMUM, scratch: Scratch | None = None) -> DataFrame:
    """The documents that no item contaminates, all columns kept."""
    items = _items(benchmark)
    if _bytes(items) > BLOCK_BYTES:
        scratch = scratch or Scratch(docs.sparkSession, "tiling")
        digest = F.md5(F.encode(text, "UTF-8"))
        named = docs.select(F.col(text).alias("text"), digest.alias("name"))
        bad = _large(named, items.withColumn("item", F.md5(F.encode("text", "UTF-8"))), threshold, minimum, scratch).select("name").distinct()
        bad = _few(scratch.save(bad, "bad"))
        # the documents' columns travel as one, so none of their names can clash
        whole = docs.select(digest.alias("name"), F.struct(*[F.col(c) for c in docs.columns]).alias("doc"))
        return whole.join(bad, "name", "left_anti").select(*[F.col("doc")[c].alias(c) for c in docs.columns])
    shared = docs.sparkSession.sparkContext.broadcast(Items.of(items.toArrow(), minimum))

    def clean(batches):
        for batch, raw, offs in chunks(batches, text):
            keep = np.ones(batch.num_rows, bool)
            keep[[row for row, _, _ in _matches(Words(raw, offs), shared.value, threshold)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(clean, T.StructType(docs.schema.fields))


def contamination_query(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
