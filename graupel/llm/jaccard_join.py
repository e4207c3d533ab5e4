"""N-gram Jaccard self-join by parity sketches.

A document is the set of its distinct word n-grams (all words as one, if there are fewer).  Every
n-gram is hashed to one word of a sketch and flips its own bits there (XOR), so an n-gram that two
sets share cancels out and the number of sketch words that differ is at most the symmetric
difference.  With similarity of at least s, two sets differ in at most (|A|+|B|)(1-s)/(1+s) = D
n-grams, hence share a sketch word unless they have only D non-empty ones (pigeonhole).  Sets meet
in size bands of one sketch width each.  In a band, a set posts its D+1 words that come first in one
order for all (rarest first, by a hashed count table of fixed size): two similar sets always post a
common word.  Posted words are joined by their hash; the pairs then pass a narrow bit sketch's
Hamming distance and exact verification; links become components.

A word posted by many sets gives no pairs of all with all: its sets are linked to one of them, and
only sets which these links leave apart are compared, in blocks, by their sketches.
Copies (equal sets) are one node throughout.

Null or empty texts have the empty set and no links; repeated rows are copies; rows with a null id
join like others but never name a component.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graupel.llm.text import Words, chunks, distinct_per_row, mix, shingles
from graupel.operators.graph import connected_components
from graupel.session import Scratch

COUNTERS = 1 << 20
SLICES = 64
LANES = 16
WIDE = 128
WIDE_FROM = 700
SMALL_GROUP = 16
BLOCK = 512
FLUSH = 2_000_000
#: Bytes of an input table, as stored, for each bucket of a packed exchange.
BUCKET_BYTES = 32 << 20
_SALT = np.uint64(0xD6E8FEB86659FD93)


class Sets:
    """The distinct n-gram sets of a chunk of texts, copies within the chunk once."""

    def __init__(self, raw, offs, size: int):
        n = len(offs) - 1
        h, rows = distinct_per_row(*shingles(Words(raw, offs), size))
        self.count = np.bincount(rows, minlength=n)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.h, self.rows = h, rows
        full = np.flatnonzero(self.count)
        self.sig = np.zeros(n, np.int64)
        if len(full):
            self.sig[full] = mix(np.add.reduceat(mix(h ^ _SALT), self.first[full]) ^ self.count[full].astype(np.uint64)).view(np.int64)
        _, one = np.unique(self.sig, return_index=True)
        self.kept = one[self.count[one] > 0]

    def lanes(self) -> list[bytes]:
        """Narrow parity sketch of each row: 64 * LANES bits, or 64 * WIDE for large sets."""
        out = [b""] * len(self.count)
        for lanes, own in ((LANES, np.flatnonzero(self.count < WIDE_FROM)), (WIDE, np.flatnonzero(self.count >= WIDE_FROM))):
            for k in range(0, len(own), 1024):
                part = own[k : k + 1024]
                size = self.count[part]
                at = np.repeat(self.first[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                bit = ((self.h[at] >> np.uint64(40)) % np.uint64(64 * lanes)).astype(np.int64)
                flips = np.bincount(np.repeat(np.arange(len(part)), size) * (64 * lanes) + bit, minlength=len(part) * 64 * lanes).astype(np.uint8) & 1
                for r, sketch in zip(part, np.packbits(flips, bitorder="little").reshape(len(part), -1), strict=True):
                    out[r] = sketch.tobytes()
        return out


def sketch_distance(a: bytes, b: bytes) -> int:
    """Hamming distance; the wider sketch is folded to the other's width first."""
    a, b = (np.frombuffer(x, np.uint64) for x in (a, b))
    if len(a) > len(b):
        a, b = b, a
    if len(b) > len(a):
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def _bands(count: np.ndarray, num: int, den: int):
    """Band number and width in which each set of ``count`` n-grams meets others: (sets, band, width)."""
    level = np.maximum(3, np.ceil(np.log2(np.maximum(count, 1)) / 2 - 1e-9).astype(np.int64))
    level += 4**level < count
    largest = count * den // num
    for step in (0, 1):
        own = np.flatnonzero((count > 0) & ((step == 0) | (largest > 4**level)))
        for band in np.unique(level[own] + step):
            yield own[level[own] + step == band], int(band), (1 << 20 if band == 3 else int(4**band))


def sketch_words(sets: Sets, num: int, den: int):
    """For each band: owner set, 64-bit key of each non-empty sketch word, and the bound D of the owner."""
    for own, band, width in _bands(sets.count[sets.kept], num, den):
        own = sets.kept[own]
        size = sets.count[own]
        at = np.repeat(sets.first[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        h = sets.h[at]
        word = (mix(h ^ np.uint64(band)) >> np.uint64(20)) % np.uint64(width)
        owner = np.repeat(np.arange(len(own)), size)
        order = np.argsort(owner * width + word.astype(np.int64), kind="stable")
        cell = (owner * width + word.astype(np.int64))[order]
        start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        value = np.bitwise_xor.reduceat(mix(h[order] + _SALT), start)
        key = mix(value ^ (word[order][start] * np.uint64(64) + np.uint64(band)) * _SALT)
        bound = (size + size * den // num) * (den - num) // (den + num)
        yield own, owner[order][start], key, bound


def _counts(docs: DataFrame, text: str, size: int, num: int, den: int) -> np.ndarray:
    """How often sketch words fall into each of COUNTERS hashed counters, over all sets.

    The table has a fixed size whatever the input, and only orders the words.
    """

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for _, raw, offs in chunks(batches, text):
            for _, _, key, _ in sketch_words(Sets(raw, offs, size), num, den):
                total += np.bincount((key >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
        parts = np.minimum(total, 65535).astype(np.uint16).reshape(SLICES, -1)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "part": pa.array([p.tobytes() for p in parts], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.uint16).astype(np.int64) for x in table.column("part"))
        return pa.table({"slice": table.column("slice")[:1], "part": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    schema = "slice int, part binary"
    rows = docs.select(text).mapInArrow(count, schema).groupBy("slice").applyInArrow(add, schema).collect()
    out = np.zeros((SLICES, COUNTERS // SLICES), np.uint32)
    for r in rows:
        out[r["slice"]] = np.frombuffer(r["part"], np.uint32)
    return out.ravel()


def bucket_count(spark, docs: DataFrame | None = None) -> int:
    """Buckets of packed exchanges: in proportion to the session's shuffle partitions, and at least one for ``BUCKET_BYTES`` of the table ``docs``."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if docs is not None else 0
    known = size if size < 2**60 else 0  # Spark's estimate is far above that where it knows nothing
    return max(128, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), known // BUCKET_BYTES)


def _posted(docs: DataFrame, text: str, size: int, num: int, den: int) -> DataFrame:
    """Packed posts ``bucket, keys, sigs``: the first D+1 sketch words of every set."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_counts(docs, text, size, num, den))
    buckets = bucket_count(spark, docs)

    def post(batches):
        held, many = [], 0
        table = shared.value

        def flush():
            key, sig = (np.concatenate(x) for x in zip(*held, strict=True))
            low = (key & np.uint64(0xFFFFFF)) % np.uint64(buckets)
            order = np.argsort(low, kind="stable")
            key, sig, low = (key[order] >> np.uint64(20)).astype(np.uint32), sig[order], low[order]
            for part in np.split(np.arange(len(low)), np.flatnonzero(low[1:] != low[:-1]) + 1):
                s = slice(part[0], part[-1] + 1)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([int(low[s][0])], pa.int32()), "keys": [key[s].tobytes()], "sigs": [sig[s].tobytes()]})

        for _, raw, offs in chunks(batches, text):
            sets = Sets(raw, offs, size)
            for own, owner, key, bound in sketch_words(sets, num, den):
                order = np.lexsort((key, table[(key >> np.uint64(44)).astype(np.int64)], owner))
                owner, key = owner[order], key[order]
                first = np.searchsorted(owner, np.arange(len(own)))
                early = np.arange(len(owner)) - first[owner] <= bound[owner]
                held.append((key[early], sets.sig[own[owner[early]]]))
                many += len(held[-1][0])
            if many >= FLUSH:
                yield from flush()
                held, many = [], 0
        if many:
            yield from flush()

    return docs.select(text).mapInArrow(post, "bucket int, keys binary, sigs binary")


def _meet(posts: DataFrame) -> DataFrame:
    """Joins posts on their word: pairs (kind 0) of small groups and stars, members (kind 1) of large groups."""

    def meet(table: pa.Table) -> pa.Table:
        key = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("keys")])
        sig = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("sigs")])
        order = np.lexsort((sig, key))
        key, sig = key[order], sig[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])
        key, sig = key[new], sig[new]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in range(1, SMALL_GROUP):
            ok = np.flatnonzero(np.repeat((size > d) & (size <= SMALL_GROUP), size))
            ok = ok[(ok + d < len(key))]
            ok = ok[key[ok] == key[np.minimum(ok + d, len(key) - 1)]]
            a.append(sig[ok])
            b.append(sig[ok + d])
        large = np.flatnonzero(size > SMALL_GROUP)
        group, member = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for g in large:
            own = sig[start[g] : start[g] + size[g]]
            a.append(np.full(len(own) - 1, own[0]))
            b.append(own[1:])
            member.append(own)
            group.append(np.full(len(own), mix(np.add.reduce(mix(own.view(np.uint64)), keepdims=True)).view(np.int64)[0]))
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0) if sum(map(len, a)) else np.zeros((0, 2), np.int64)
        members = np.unique(np.stack([np.concatenate(group), np.concatenate(member)], 1), axis=0) if len(large) else np.zeros((0, 2), np.int64)
        both = np.concatenate([pairs, members])
        return pa.table({"kind": pa.array(np.repeat([0, 1], [len(pairs), len(members)]).astype(np.int32)), "a": both[:, 0], "b": both[:, 1]})

    return posts.groupBy("bucket").applyInArrow(meet, "kind int, a long, b long")


def _close(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose sizes and narrow sketches allow the similarity, and their sketch distance."""

    def test(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "na", "nb", "la", "lb")), strict=True)
            good = [(a, b, d) for a, b, na, nb, la, lb in rows if (d := sketch_distance(la, lb)) <= (na + nb) * (den - num) // (den + num)]
            a, b, d = zip(*good, strict=True) if good else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.int32())], names=["a", "b", "apart"])

    side = lambda p: nodes.select(F.col("sig").alias(p), F.col("n").alias(f"n{p}"), F.col("lanes").alias(f"l{p}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    return met.mapInArrow(test, "a long, b long, apart int")


def _sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, id: str, text: str, size: int, scratch: Scratch) -> DataFrame:
    """The n-grams of the wanted sets, from the text of one document each (or of rows with a null id): sig, grams."""
    reps = wanted.join(nodes.select("sig", "rep"), "sig")
    texts = docs.select(id, text).join(reps.select(F.col("rep").alias(id)).distinct(), id, "left_semi")
    nameless = docs.select(id, text).where(F.col(id).isNull())

    def sets_of(batches):
        for _, raw, offs in chunks(batches, text):
            s = Sets(raw, offs, size)
            yield pa.RecordBatch.from_pydict({"sig": s.sig[s.kept], "grams": pa.array([s.h[s.first[k] : s.first[k + 1]].tobytes() for k in s.kept], pa.binary())})

    schema = "sig long, grams binary"
    more = nameless.mapInArrow(sets_of, schema).join(reps.where("rep is null").select("sig"), "sig", "left_semi")
    return scratch.save(texts.mapInArrow(sets_of, schema).union(more).dropDuplicates(["sig"]), "sets")


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """The pairs whose sets have the similarity, exactly."""

    def exact(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("ga"), batch.column("gb"), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                good.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda p: sets.select(F.col("sig").alias(p), F.col("grams").alias(f"g{p}"))
    return scratch.save(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(exact, "a long, b long"), "links")


def _nearest(pairs: DataFrame) -> DataFrame:
    """Each set's pair with the least sketch distance."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), "apart", F.col("b").alias("other")), F.struct(F.col("b").alias("node"), "apart", F.col("a").alias("other")))).alias("e")).select("e.*")
    near = ends.groupBy("node").agg(F.min(F.struct("apart", "other")).alias("m"))
    return near.select(F.least("node", "m.other").alias("a"), F.greatest("node", "m.other").alias("b")).distinct()


def _between(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    side = lambda p: comps.select(F.col("node").alias(p), F.col("component").alias(f"c{p}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _left_apart(members: DataFrame, comps: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of large groups' sets in different components, compared block by block."""
    placed = members.join(comps, members["sig"] == comps["node"], "left").select("group", "sig", F.coalesce("component", "sig").alias("comp"))
    open_ = placed.groupBy("group").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m")).where("x <> y").select("group", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    rows = placed.join(open_, "group").join(nodes.select("sig", "n", "lanes"), "sig").withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    spread = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sig", "comp", "n", "lanes")

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        sig, comp, n, block = (table.column(c).to_numpy() for c in ("sig", "comp", "n", "block"))
        lanes = np.zeros((len(sig), LANES), np.uint64)
        for k, x in enumerate(table.column("lanes").to_pylist()):
            lanes[k] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, LANES), axis=0)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in left:
            apart = np.bitwise_count(lanes[right] ^ lanes[x]).sum(1)
            ok = (comp[right] != comp[x]) & (apart <= (n[right] + n[x]) * (den - num) // (den + num)) & (np.minimum(n[right], n[x]) * den >= np.maximum(n[right], n[x]) * num)
            b.append(np.maximum(sig[right[ok]], sig[x]))
            a.append(np.minimum(sig[right[ok]], sig[x]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return spread.groupBy("group", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def ngram_jaccard_join(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, num: int = 75, den: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: id, n_shingles (long), component_id (smallest id reachable by links).

    Two documents link when den * |A and B| >= num * |A or B| for their n-gram sets.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard")
    docs = docs.select(id, text)

    def features(batches):
        for batch, raw, offs in chunks(batches, text):
            s = Sets(raw, offs, size)
            yield pa.RecordBatch.from_arrays([batch.column(id), pa.array(s.count, pa.int64()), pa.array(s.sig), pa.array(s.lanes(), pa.binary())], names=[id, "n", "sig", "lanes"])

    kind = docs.schema[id].dataType.simpleString()
    feats = scratch.save(docs.mapInArrow(features, f"{id} {kind}, n long, sig long, lanes binary"), "features")
    nodes = scratch.save(feats.where("n > 0").groupBy("sig").agg(F.min(id).alias("rep"), F.first("n").alias("n"), F.first("lanes").alias("lanes")), "nodes")
    met = scratch.save(_meet(_posted(docs, text, size, num, den)), "met")
    pairs = scratch.save(_close(met.where("kind = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), nodes, num, den), "pairs")
    ends = lambda p: p.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    members = scratch.save(met.where("kind = 1").select(F.col("a").alias("group"), F.col("b").alias("sig")).distinct(), "members")
    sets = _sets(ends(pairs).union(members.select("sig")).distinct(), nodes, docs, id, text, size, scratch)
    # a pair within a component adds nothing: the nearest pairs come first, then those that still join components
    links = _verify(_nearest(pairs), sets, num, den, scratch)
    comps = scratch.save(connected_components(links, scratch=scratch), "components")
    links = links.union(_verify(_between(pairs, comps), sets, num, den, scratch))
    comps = scratch.save(connected_components(links, scratch=scratch), "components")
    more = scratch.save(_close(_left_apart(members, comps, nodes, num, den).join(pairs, ["a", "b"], "left_anti"), nodes, num, den), "apart")
    if not more.isEmpty():
        links = links.union(_verify(more, sets, num, den, scratch))
        comps = scratch.save(connected_components(links, scratch=scratch), "components")
    named = nodes.join(comps, nodes["sig"] == comps["node"], "left").select("sig", "rep", F.coalesce("component", "sig").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    final = scratch.save(named.join(least, "comp").select("sig", "component_id"), "named")
    return feats.drop("lanes").join(final, "sig", "left").select(id, F.col("n").alias("n_shingles"), F.coalesce("component_id", id).alias("component_id"))


def jaccard_query(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\x0C\r]+') AS w
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)
), reach AS (
  SELECT doc_id AS start, doc_id AS id FROM documents
  UNION SELECT r.start, l.y FROM reach r JOIN links l ON l.x = r.id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT start, min(id) AS component_id FROM reach GROUP BY start) c ON c.start = d.doc_id
"""
