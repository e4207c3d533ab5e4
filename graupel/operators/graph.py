"""Connected components of an edge table by alternating large-star and small-star steps.

Kiveris et al. 2014, "Connected Components in MapReduce and Beyond".  Each step is a
``min`` aggregate (combined before the shuffle) and an equi-join, so a node with very many
edges is split by adaptive skew handling and never gathered in one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graupel.session import Scratch

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(low.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """Columns ``node, component`` for every node of an edge; component = smallest node reachable.

    Node ids are integers; null ends and self loops are ignored, repeated edges count once.
    Nodes without an edge are not returned (each is its own component).
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    cur = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    cur = scratch.save(cur.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(cur)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        nxt = scratch.save(_small_star(_large_star(cur)), "round")
        new = _state(nxt)
        scratch.free(cur)
        cur = nxt
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("b").alias("node")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
