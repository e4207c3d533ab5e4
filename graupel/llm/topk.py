"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector's components become floor(256 x).  Cut into segments, two vectors are at least as far
apart as sum of L((m_q - m_x)^2 + (s_q - s_x)^2) over segments of length L with means m and
deviations s; the inner product is (|q|^2 + |x|^2 - distance^2) / 2, so this bounds it from above.

Queries first meet a sample of about ``SEED_ROWS`` candidates (at most one in ``SEED_SHARE``), whose k-th best score is each query's floor.  Then
blocks of queries meet blocks of candidates in a grid; in a cell, both are turned to the candidates' principal axes, the bounds go from coarse to
fine segments (the finest about half as wide as the vector), the best candidates by the finest bound raise the floor, and exact scores are
computed in integers for the pairs that are left only.  On vectors without any direction, as random ones, bounds of any kind prune little.

Vectors that are null or hold null or non-finite components take no part, nor do rows with a null
id (ids are integers, others raise TypeError); vectors of different length don't meet; rows with the query's id are its own.  Ties go to the smaller id.
A query row that is repeated in full counts once, candidates count as often as they occur; queries of one id with
different vectors share one list.  Empty tables give no rows; extra columns are ignored.
Scores are longs; components must be small enough for that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from graupel.session import Scratch

SEED_ROWS = 4096
#: The sample is at most one row in so many.
SEED_SHARE = 16
#: Vectors of more components are cut as they are.
MOST_AXES = 1024
PAIRS = 1 << 16
BLOCK_VALUES = 1 << 17
QUERIES_PER_GROUP = 4096
LOWEST = -(2**63)


def pack_vectors(df: DataFrame, id: str, vector: str, floor: str | None = None) -> DataFrame:
    """Blocks of quantised vectors of one length: dim, ids, data (row-major little-endian int64), floors (if given, null is the lowest)."""

    def pack(batches):
        for batch in batches:
            col = batch.column(vector)
            size = np.diff(col.offsets.to_numpy()) if len(col) else np.zeros(0, np.int64)
            values = col.values
            first, flat = col.offsets.to_numpy()[:-1] if len(col) else size, values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            usable = ~col.is_null().to_numpy(zero_copy_only=False) & ~batch.column(id).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(id).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            low = batch.column(floor).fill_null(LOWEST).to_numpy(zero_copy_only=False).astype("<i8") if floor else np.full(len(ids), LOWEST, "<i8")
            for dim in np.unique(size[usable]):
                own = np.flatnonzero(usable & (size == dim))
                step = max(1, BLOCK_VALUES // max(int(dim), 1))
                for k in range(0, len(own), step):
                    rows = own[k : k + step]
                    x = flat[first[rows, None] + np.arange(dim)]
                    good = np.isfinite(x).all(1)
                    if good.any():
                        data = np.floor(256 * x[good]).astype("<i8")
                        yield pa.RecordBatch.from_pydict({"dim": pa.array([int(dim)], pa.int32()), "ids": [ids[rows][good].astype("<i8").tobytes()], "data": pa.array([data.tobytes()], pa.binary()), "floors": pa.array([low[rows][good].tobytes()], pa.binary())})

    return df.select(id, vector, *[floor] * bool(floor)).mapInArrow(pack, "dim int, ids binary, data binary, floors binary")


def _segments(x: np.ndarray, bounds: list[int]) -> np.ndarray:
    """Means and deviations of the segments, each times the root of its length; a segment of one component is its own mean."""
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        part = x[:, a:b]
        out += [part.mean(1) * np.sqrt(b - a), part.std(1) * np.sqrt(b - a)] if b > a + 1 else [part[:, 0]]
    return np.stack(out, 1)


def _levels(dim: int) -> list[list[int]]:
    """Segment borders from coarse to fine: ever more leading components by themselves, the others in up to two segments.

    The finest level is about half as wide as the vector.
    """
    made = []
    for lead in sorted({0, dim // 8, dim // 4, dim // 2}):
        rest = [lead + (dim - lead) // 2] if dim - lead > 3 else []
        made.append([*range(lead), lead, *rest, dim])
    return made


def _turned(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides on the candidates' principal axes, the strongest first; a rotation keeps distances and products.

    Where vectors crowd along few directions, the leading components then hold most of a distance.
    """
    if not 1 < c.shape[1] <= MOST_AXES:
        return q, c
    axes = np.linalg.eigh(c.T @ c)[1][:, ::-1]
    return q @ axes, c @ axes


def _scores(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of the pairs q[i], c[j]."""
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), PAIRS):
        part = slice(k, k + PAIRS)
        out[part] = np.einsum("nd,nd->n", q[i[part]], c[j[part]])
    return out


def survivors(q: np.ndarray, c: np.ndarray, floor: np.ndarray, alive: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that no bound keeps below the query's floor; the floor is raised on the way."""
    fq, fc = q.astype(np.float64), c.astype(np.float64)
    nq, nc = (fq**2).sum(1), (fc**2).sum(1)
    slack = 1e-9 * (np.sqrt(nq)[:, None] * np.sqrt(nc.max(initial=0))) + 1e-6
    cols = np.arange(len(c))
    bound = None
    fq, fc = _turned(fq, fc)
    for borders in _levels(q.shape[1]) if q.shape[1] else ():
        cols = cols[alive[:, cols].any(0)]
        if not len(cols):
            break
        sq, sc = _segments(fq, borders), _segments(fc[cols], borders)
        apart = (sq**2).sum(1)[:, None] + (sc**2).sum(1)[None, :] - 2 * sq @ sc.T  # lower bound of the squared distance
        bound = (nq[:, None] + nc[cols][None, :] - apart) / 2 + slack
        alive[:, cols] &= bound >= floor[:, None]
    if bound is not None and len(cols) > k:
        # the best by the finest bound raise the floor before the others are computed
        bound = np.where(alive[:, cols], bound, -np.inf)
        first = np.argpartition(bound, len(cols) - k, axis=1)[:, len(cols) - k :]
        i, j = np.repeat(np.arange(len(q)), k), cols[first.ravel()]
        known = np.where(alive[i, j], _scores(q, c, i, j), LOWEST).reshape(len(q), k)
        floor = np.maximum(floor, known.min(1))
        alive[:, cols] &= bound >= floor[:, None]
    return np.nonzero(alive)


def search_block(q_ids, q, c_ids, c, k: int, floor: np.ndarray | None = None):
    """(query id, candidate id, score) that hold the k best candidates of the block for each query, as far as they reach its floor."""
    floor = np.full(len(q), LOWEST) if floor is None else floor
    i, j = survivors(q, c, floor, q_ids[:, None] != c_ids[None, :], k)
    s, ids = _scores(q, c, i, j), c_ids[j]
    order = np.lexsort((ids, -s, i))
    i, s, ids = i[order], s[order], ids[order]
    first = np.searchsorted(i, np.arange(len(q)))
    top = np.arange(len(i)) - first[i] < k  # of equals, those with the smaller id
    return q_ids[i[top]], ids[top], s[top]


def _search(c: DataFrame, q: DataFrame, k: int, id: str, lines: int, groups: int) -> DataFrame:
    """query_id, rank, id, score of packed queries against packed candidates."""
    c = c.select("dim", F.col("ids").alias("c_ids"), F.col("data").alias("c_data"), F.pmod(F.xxhash64("ids"), F.lit(groups)).alias("j"), F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("i"))
    q = q.select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), "floors", F.pmod(F.xxhash64("ids"), F.lit(lines)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("j"))

    def search(batches):
        for batch in batches:
            for k_row in range(batch.num_rows):
                row = batch.slice(k_row, 1).to_pylist()[0]
                ids = {s: np.frombuffer(row[f"{s}_ids"], "<i8") for s in "qc"}
                data = {s: np.frombuffer(row[f"{s}_data"], "<i8").reshape(len(ids[s]), row["dim"]) for s in "qc"}
                a, b, s = search_block(ids["q"], data["q"], ids["c"], data["c"], k, np.frombuffer(row["floors"], "<i8"))
                yield pa.RecordBatch.from_pydict({"query_id": a.astype(np.int64), id: b.astype(np.int64), "score": s})

    cells = c.join(q, ["dim", "i", "j"]).select("q_ids", "q_data", "floors", "c_ids", "c_data", "dim")
    part = cells.mapInArrow(search, f"query_id long, {id} long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id)
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", id, "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding", scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank (from 1), id, score: the k best other rows of each query, exactly."""
    spark = vectors.sparkSession
    if not isinstance(vectors.schema[id].dataType, T.IntegralType):
        raise TypeError(f"{id} must be an integer column")
    scratch = scratch or Scratch(spark, "topk")
    groups = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    queries = queries.select(id, vector).dropDuplicates([id, vector])
    lines = int(queries.count() // QUERIES_PER_GROUP) + 1
    every = max(SEED_SHARE, vectors.count() // SEED_ROWS)
    seeds = pack_vectors(vectors.where(F.pmod(F.xxhash64(id), F.lit(every)) == 0), id, vector)
    found = _search(seeds, pack_vectors(queries, id, vector), k, id, lines, 1)
    floors = scratch.save(found.groupBy(F.col("query_id").alias("_query")).agg(F.when(F.count("*") >= k, F.min("score")).alias("_floor")), "floors")
    known = queries.join(floors, F.col(id) == F.col("_query"), "left").select(id, vector, "_floor")
    return _search(pack_vectors(vectors, id, vector), pack_vectors(known, id, vector, "_floor"), k, id, lines, groups)


def topk_query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


TOPK_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM e) q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
