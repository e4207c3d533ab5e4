"""The minimum spanning tree of a grid, rooted off the grid, by Borůvka rounds inside growing tiles.

Two of the eight neighbours are joined by an edge of weight max(z, z'), a cell with a missing neighbour is
joined to the root by an edge of its own z; equal weights are ordered by the ends' ids, so the tree is unique
and doesn't depend on tiles.  A part (a connected piece of the tree) always takes its least edge.  Inside a
tile this goes on until every part's least edge leaves the tile; what is left (the edges between the parts,
which all touch the border) is dealt out again by tiles ``GROW`` times as wide, until every part has met the
root.  A level is one exchange; its tables shrink with the border's length.

On the way back each tile repeats its own rounds and turns every part towards its exit: a part leaves by the
edge it took itself, except those between the exit of the whole and the place where the whole's own edges
meet, which leave by the edge of the part before.  The lowest level gives each cell its parent.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from graupel.operators import stencil
from graupel.operators.components import WIDTH_BITS
from graupel.session import Scratch

GROW = 8
ROOT = -1
STEPS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
#: An edge as seen from the part ``label``: from its cell u to the cell v of another part (or to the root).
HALF = "label long, u long, v long, w double"
EXIT = "label long, u long, v long"


class Parts:
    """Borůvka rounds over the half edges of one tile."""

    def __init__(self, label: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray):
        self.names = np.unique(np.append(label, ROOT))
        node = np.searchsorted(self.names, label)
        low, high = np.minimum(u, v), np.maximum(u, v)
        order = np.lexsort((high, low, w))
        first = np.ones(len(u), bool)
        first[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
        at = np.flatnonzero(first)
        whole = np.append(at[1:], len(order)) - at == 2
        one, two = order[at], order[np.minimum(at + 1, max(len(order) - 1, 0))]
        root = int(np.searchsorted(self.names, ROOT))
        self.u, self.v, self.w, self.a = u[one], v[one], w[one], node[one]
        self.b = np.where(self.v == ROOT, root, np.where(whole, node[two], -1))  # -1: the other end is outside
        self.root, self.rounds = root, []
        self._grow()

    def _grow(self) -> None:
        n = len(self.names)
        part, alive = np.arange(n), np.arange(len(self.a))
        while True:
            here = part[self.a[alive]]
            there = np.where(self.b[alive] >= 0, part[self.b[alive]], -1)
            apart = here != there
            alive, here, there = alive[apart], here[apart], there[apart]
            best = np.full(n, len(self.a))
            back, inner = slice(None, None, -1), there >= 0
            best[here[back]] = alive[back]  # of repeated places the last one written stays: the least edge
            other = np.full(n, len(self.a))
            other[there[inner][back]] = alive[inner][back]
            best = np.minimum(best, other)
            best[self.root] = len(self.a)
            took = np.flatnonzero(best < len(self.a))
            took = took[self.b[best[took]] >= 0]
            if not len(took):
                break
            hook, edge = np.full(n, -1), best[took]
            near, far = part[self.a[edge]], part[self.b[edge]]
            hook[took] = np.where(near == took, far, near)
            twice = took[(hook[hook[took]] == took) & (took < hook[took])]
            self.rounds.append((part, hook, best))
            hook = hook.copy()
            hook[twice] = -1
            self.rounds[-1] = (part, hook, best)
            top = np.where(hook < 0, np.arange(n), hook)
            while (top[top] != top).any():
                top = top[top]
            part = top[part]
        self.part, self.left = part, alive

    def halves(self) -> pd.DataFrame:
        """What other tiles need: the edges that leave, and the least edge of each two parts."""
        here = self.part[self.a[self.left]]
        there = np.where(self.b[self.left] >= 0, self.part[self.b[self.left]], -1)
        low, high = np.minimum(here, there), np.maximum(here, there)
        inner = there >= 0
        _, least = np.unique(low[inner] * len(self.names) + high[inner], return_index=True)
        keep = np.concatenate([np.flatnonzero(~inner), np.flatnonzero(inner)[least]])
        e, here, there = self.left[keep], here[keep], there[keep]
        other = (there >= 0) & (self.v[e] != ROOT)
        return pd.DataFrame({
            "label": np.concatenate([self.names[here], self.names[there[other]]]), "u": np.concatenate([self.u[e], self.v[e[other]]]),
            "v": np.concatenate([self.v[e], self.u[e[other]]]), "w": np.concatenate([self.w[e], self.w[e[other]]])})

    def exits(self, label: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The exit (u, v) of every first part, given those of the last ones."""
        n = len(self.names)
        cells, at = np.unique(np.concatenate([self.u, self.v[self.b >= 0]]), return_index=True)
        node_of = np.concatenate([self.a, self.b[self.b >= 0]])[at]
        out_node, out_u, out_v = np.full(n, -1), np.full(n, ROOT), np.full(n, ROOT)
        own = node_of[np.searchsorted(cells, u)] if len(u) else np.zeros(0, np.int64)
        last = self.part[own]
        out_node[last], out_u[last], out_v[last] = own, u, v
        for part, hook, best in reversed(self.rounds):
            new_node, new_u, new_v = np.full(n, -1), np.full(n, ROOT), np.full(n, ROOT)
            took = np.flatnonzero(hook >= 0)
            e = best[took]
            fits = part[self.a[e]] == took
            new_node[took], new_u[took], new_v[took] = np.where(fits, self.a[e], self.b[e]), np.where(fits, self.u[e], self.v[e]), np.where(fits, self.v[e], self.u[e])
            met = np.where(fits, self.b[e], self.a[e])  # the node at the other end
            far = np.full(n, -1)
            far[took] = met
            own_u, own_v = new_u.copy(), new_v.copy()
            given = np.flatnonzero(out_node >= 0)
            walk = part[out_node[given]]
            new_node[walk], new_u[walk], new_v[walk] = out_node[given], out_u[given], out_v[given]
            while True:
                walk = walk[hook[walk] >= 0]
                if not len(walk):
                    break
                ahead = hook[walk]
                new_node[ahead], new_u[ahead], new_v[ahead] = far[walk], own_v[walk], own_u[walk]
                walk = ahead
            out_node, out_u, out_v = new_node, new_u, new_v
        some = np.flatnonzero(self.names != ROOT)
        return self.names[some], out_u[some], out_v[some]


def cell_edges(pdf: pd.DataFrame, tile: int) -> tuple[np.ndarray, Parts]:
    """Which rows of a tile with a halo are its own, and the rounds of its cells."""
    row, col, z = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64), pdf["z"].to_numpy(np.float64)
    own = (row // tile == pdf["tr"].to_numpy()) & (col // tile == pdf["tc"].to_numpy())
    frame = np.full((row.max() - row.min() + 3, col.max() - col.min() + 3), -1)
    r, c = row - row.min() + 1, col - col.min() + 1
    frame[r, c] = np.arange(len(row))
    mine = np.flatnonzero(own)
    near = np.stack([frame[r[mine] + i, c[mine] + j] for i, j in STEPS], 1)
    known = near >= 0
    id = (row << WIDTH_BITS) + col
    from_, to = np.repeat(mine, known.sum(1)), near[known]
    edge = mine[~known.all(1)]
    u = np.concatenate([id[from_], id[edge]])
    v = np.concatenate([id[to], np.full(len(edge), ROOT)])
    w = np.concatenate([np.maximum(z[from_], z[to]), z[edge]])
    return own, Parts(u, u, v, w)


def _tiled(df: DataFrame, size: int, u: str = "u") -> DataFrame:
    row, col = F.shiftright(u, WIDTH_BITS), F.col(u).bitwiseAND(F.lit((1 << WIDTH_BITS) - 1))
    return df.withColumns({"tr": F.floor(row / size), "tc": F.floor(col / size)})


def rooted_tree(cells: DataFrame, tile: int, tree, schema: str, scratch: Scratch) -> DataFrame:
    """``tree(frame, own, parents)`` of every tile: its rows with halo, which are its own, and their parents' ids (ROOT: none).

    ``cells`` (row, col, z) is read twice.
    """
    spark = cells.sparkSession
    halo = stencil.with_halo(cells.select("row", "col", "z"), tile)
    levels = [scratch.save(halo.groupBy("tr", "tc").applyInPandas(lambda pdf: cell_edges(pdf, tile)[1].halves(), HALF), "edges")]
    size = tile
    while not levels[-1].where(F.col("label") != ROOT).isEmpty():
        size *= GROW
        again = _tiled(levels[-1], size).groupBy("tr", "tc").applyInPandas(lambda pdf: Parts(*(pdf[c].to_numpy() for c in ("label", "u", "v", "w"))).halves(), HALF)
        levels.append(scratch.save(again, "edges"))

    def turn(one: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        parts = Parts(*(one[c].to_numpy() for c in ("label", "u", "v", "w")))
        return pd.DataFrame(dict(zip(("label", "u", "v"), parts.exits(*(out[c].to_numpy(np.int64) for c in ("label", "u", "v"))))))

    exits = spark.createDataFrame([], EXIT)
    for rows in reversed(levels[:-1]):
        exits = scratch.save(_tiled(rows, size).groupBy("tr", "tc").cogroup(_tiled(exits, size).groupBy("tr", "tc")).applyInPandas(turn, EXIT), "exits")
        size //= GROW
    scratch.free(*levels)

    def leaf(one: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        own, parts = cell_edges(one, tile)
        label, _, parent = parts.exits(*(out[c].to_numpy(np.int64) for c in ("label", "u", "v")))
        id = (one["row"].to_numpy(np.int64) << WIDTH_BITS) + one["col"].to_numpy(np.int64)
        return tree(one, own, parent[np.searchsorted(label, id[own])])

    return halo.groupBy("tr", "tc").cogroup(_tiled(exits, tile).groupBy("tr", "tc")).applyInPandas(leaf, schema)
