"""Drainage: breaching, D-infinity contributing area, flow pointers and height above streams.

The drainage tree is the rooted minimum spanning tree of the grid (``forest.py``).  What runs along it, and the
flow over the breached grid, is solved in two passes over tiles: the first reduces each tile to what enters and
leaves it, the small graph of these places is solved by doubling, and the second pass fills the tiles.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from graupel.operators import stencil
from graupel.operators.components import WIDTH_BITS, cell_id
from graupel.operators.forest import ROOT, STEPS, rooted_tree
from graupel.session import Scratch

TILE = 128
#: Entries a place of the flow graph may have before it is walked instead of squared.
FILL = 64
#: Facets of D-infinity: the cardinal and the diagonal neighbour of each.
FACETS = [((0, 1), (-1, 1)), ((-1, 0), (-1, 1)), ((-1, 0), (-1, -1)), ((0, -1), (-1, -1)), ((0, -1), (1, -1)), ((1, 0), (1, -1)), ((1, 0), (1, 1)), ((0, 1), (1, 1))]


def _ids(pdf: pd.DataFrame) -> np.ndarray:
    return (pdf["row"].to_numpy(np.int64) << WIDTH_BITS) + pdf["col"].to_numpy(np.int64)


def _places(id: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Places of ids in an array of distinct ids, -1 where absent."""
    order = np.argsort(id)
    at = order[np.minimum(np.searchsorted(id[order], goal), len(id) - 1)]
    return np.where(id[at] == goal, at, -1)


def _parents(id: np.ndarray) -> dict:
    none = id == ROOT
    return {"parent_row": pd.arrays.IntegerArray(id >> WIDTH_BITS, none), "parent_col": pd.arrays.IntegerArray(id & ((1 << WIDTH_BITS) - 1), none)}


def _carry(up: np.ndarray, z: np.ndarray, came: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least level that arrives at each cell of a tile, the cell by which each leaves it, and the least z on that way.

    ``up`` is the parent's place (-1: outside); a level passes a cell whose z isn't below it.  Pointers are doubled, so rounds follow
    the logarithm of the way.
    """
    came, low, last = came.copy(), z.copy(), np.arange(len(z))
    while (up >= 0).any():
        on = up >= 0
        over = on & (came <= low)
        arrived = came.copy()
        np.minimum.at(arrived, up[over], came[over])
        came = arrived
        low[on], last[on], up = np.minimum(low[on], low[up[on]]), last[up[on]], np.where(on, up[np.maximum(up, 0)], -1)
    return came, last, low


def drainage_tree(dem: DataFrame, value: str = "elev", tile: int = TILE, scratch: Scratch | None = None) -> DataFrame:
    """row, col, z, parent_row, parent_col of every known cell, and what its tile knows of its way.

    The parent is the next cell on the way off the grid that the minimum spanning tree gives: no other way has a
    lower highest cell, and so on for every part of it; NULL where it leaves the grid.  pit: an inner cell without a strictly lower neighbour;
    next: the first cell of the way outside the tile (NULL: it leaves the grid before), top and low: highest and
    lowest z before that; sent: the least level that pits of the tile carry over the border by this cell.
    """
    scratch = scratch or Scratch(dem.sparkSession, "drainage")
    known = dem.where(F.col(value).isNotNull()).select("row", "col", F.col(value).cast("double").alias("z"))

    def tree(pdf: pd.DataFrame, own: np.ndarray, parent: np.ndarray) -> pd.DataFrame:
        row, col = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        r, c = row - row.min() + 1, col - col.min() + 1
        frame = np.full((r.max() + 2, c.max() + 2), np.nan)
        frame[r, c] = pdf["z"].to_numpy()
        around = np.stack([frame[r[own] + i, c[own] + j] for i, j in STEPS], 1)
        mine = pdf[own]
        id, z = _ids(mine), mine["z"].to_numpy()
        pit = ~np.isnan(around).any(1) & ~(around < z[:, None]).any(1)
        up = _places(id, parent)
        came = np.full(len(z), np.inf)
        starts = pit & (up >= 0)
        np.minimum.at(came, up[starts], z[starts])
        came, last, low = _carry(up, z, came)
        _, _, deep = _carry(up, -z, came)
        leaves = (up < 0) & (parent != ROOT)
        sent = np.where(leaves, np.minimum(np.where(came <= z, came, np.inf), np.where(pit, z, np.inf)), np.inf)
        ends = parent[last]
        return pd.DataFrame({
            "row": mine["row"].to_numpy(), "col": mine["col"].to_numpy(), "z": z, **_parents(parent),
            "pit": pit, "next": pd.arrays.IntegerArray(ends, ends == ROOT), "low": low, "top": -deep, "sent": np.where(np.isinf(sent), np.nan, sent)})

    made = rooted_tree(known, tile, tree, "row int, col int, z double, parent_row int, parent_col int, pit boolean, next long, low double, top double, sent double", scratch)
    return scratch.save(made.withColumn("sent", F.nanvl("sent", F.lit(None).cast("double"))), "tree")


def _entries(tree: DataFrame) -> DataFrame:
    """The cells that ways enter from other tiles, with their rows of ``tree``."""
    goals = tree.where("next is not null").select(F.col("next").alias("id")).distinct()
    return tree.withColumn("id", cell_id()).join(goals, "id")


def spill_levels(tree: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """row, col, spill: the lowest level at which water leaves the grid from each cell."""
    scratch = scratch or Scratch(tree.sparkSession, "spill")
    cur = scratch.save(_entries(tree).select("id", "next", "top"), "ways")
    while not cur.where("next is not null").isEmpty():
        ahead = cur.select(F.col("id").alias("next"), F.col("next").alias("then"), F.col("top").alias("more"))
        cur = scratch.save(cur.join(ahead, "next", "left").select("id", F.col("then").alias("next"), F.greatest("top", "more").alias("top")), "ways")
    return tree.join(cur.select(F.col("id").alias("next"), F.col("top").alias("more")), "next", "left").select("row", "col", F.greatest("top", "more").alias("spill"))


def breach(dem: DataFrame, value: str = "elev", tile: int = TILE, scratch: Scratch | None = None) -> DataFrame:
    """row, col, z (raw), breached, parent_row, parent_col.

    From every inner cell without a strictly lower neighbour its level is carried along the tree
    and cuts what isn't lower, so each cell has a way to the edge that never rises.
    """
    scratch = scratch or Scratch(dem.sparkSession, "breach")
    tree = drainage_tree(dem, value, tile, scratch)
    sent = tree.where("sent is not null").groupBy(cell_id("parent_row", "parent_col").alias("id")).agg(F.min("sent").alias("came"))
    cur = scratch.save(_entries(tree).select("id", "next", "low").join(sent, "id", "left"), "carried")
    while not cur.where("next is not null").isEmpty():
        over = cur.where("came <= low and next is not null").groupBy(F.col("next").alias("id")).agg(F.min("came").alias("more"))
        ahead = cur.select(F.col("id").alias("next"), F.col("next").alias("then"), F.col("low").alias("low2"))
        cur = scratch.save(cur.join(ahead, "next", "left").join(over, "id", "left").select("id", F.col("then").alias("next"), F.least("low", "low2").alias("low"), F.least("came", "more").alias("came")), "carried")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        id, z = _ids(pdf), pdf["z"].to_numpy()
        parent = pdf["parent"].to_numpy(np.int64)
        up = _places(id, parent)
        came = np.where(np.isnan(pdf["came"].to_numpy(np.float64)), np.inf, pdf["came"].to_numpy(np.float64))
        starts = pdf["pit"].to_numpy() & (up >= 0)
        np.minimum.at(came, up[starts], z[starts])
        return pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "z": z, "breached": np.minimum(z, _carry(up, z, came)[0]), **_parents(parent)})

    cells = tree.select("row", "col", "z", "pit", F.coalesce(cell_id("parent_row", "parent_col"), F.lit(ROOT)).alias("parent"), cell_id().alias("id"))
    cells = cells.join(cur.where("came is not null").select("id", "came"), "id", "left").withColumns({"tr": F.floor(F.col("row") / tile), "tc": F.floor(F.col("col") / tile)})
    return cells.drop("id").groupBy("tr", "tc").applyInPandas(fill, "row int, col int, z double, breached double, parent_row int, parent_col int")


_NAMES = {(0, 1): "e", (-1, 1): "ne", (-1, 0): "n", (-1, -1): "nw", (0, -1): "w", (1, -1): "sw", (1, 0): "s", (1, 1): "se"}


def _receivers(cells: DataFrame, px: float) -> DataFrame:
    """row, col and the receivers r1, c1, s1 and r2, c2, s2 (share above 0, else NULL) of each cell."""
    quarter = math.pi / 4
    known = cells.columns
    near = stencil.neighbours(cells.select("row", "col", "breached", *[c for c in ("parent_row", "parent_col") if c in known]), "breached", edge="null")
    options = []
    for k, (a, b) in enumerate(FACETS):
        one, two = F.col(_NAMES[a]), F.col(_NAMES[b])
        s1, s2 = (F.col("c") - one) / px, (one - two) / px
        turn = F.atan2(s2, s1)
        steep = F.when(turn < 0, s1).when(turn > quarter, (F.col("c") - two) / (px * math.sqrt(2))).otherwise(F.sqrt(s1 * s1 + s2 * s2))
        part = F.struct(steep.alias("steep"), F.lit(-k).alias("k"), F.greatest(F.lit(0.0), F.least(turn, F.lit(quarter))).alias("turn"))
        options.append(F.when(one.isNotNull() & two.isNotNull(), part))
    best = near.withColumn("best", F.array_max(F.array(*options))).withColumn("lower", F.coalesce(F.col("best.steep") > 0, F.lit(False)))
    share = F.col("best.turn") / quarter
    step = lambda end, axis: F.element_at(F.array(*[F.lit(f[end][axis]) for f in FACETS]), F.lit(1) - F.col("best.k"))
    parent = lambda c: F.col(c) if c in known else F.lit(None).cast("int")
    first = F.col("lower") & (share < 1)
    return best.select(
        "row", "col",
        F.when(first, F.col("row") + step(0, 0)).when(~F.col("lower"), parent("parent_row")).alias("r1"), F.when(first, F.col("col") + step(0, 1)).when(~F.col("lower"), parent("parent_col")).alias("c1"), F.when(first, 1 - share).when(~F.col("lower") & parent("parent_row").isNotNull(), F.lit(1.0)).alias("s1"),
        *[F.when(F.col("lower") & (share > 0), v).alias(n) for v, n in ((F.col("row") + step(1, 0), "r2"), (F.col("col") + step(1, 1), "c2"), (share, "s2"))],
    )


def d_infinity_receivers(cells: DataFrame, px: float) -> DataFrame:
    """row, col, to_row, to_col, share: at most two receivers of each cell (Tarboton 1997) on ``breached``.

    The steepest of eight facets counts (of equal ones the first); a cell without a lower facet passes everything to its
    tree parent (``parent_row``, ``parent_col``, if there are such columns); edge cells may have none.
    """
    ends = F.array(*[F.struct(F.col(f"r{k}").alias("to_row"), F.col(f"c{k}").alias("to_col"), F.col(f"s{k}").alias("share")) for k in (1, 2)])
    return _receivers(cells, px).select("row", "col", F.explode(ends).alias("e")).select("row", "col", "e.*").where("share is not null")


class _Flow:
    """The receivers inside one tile: places, shares, and the waves in which all givers of a cell are done."""

    def __init__(self, pdf: pd.DataFrame):
        id = _ids(pdf)
        self.id = id
        self.share = np.nan_to_num(pdf[["s1", "s2"]].to_numpy(np.float64).T)
        self.to = np.stack([(np.nan_to_num(pdf[f"r{k}"].to_numpy(np.float64), nan=-1).astype(np.int64) << WIDTH_BITS) + np.nan_to_num(pdf[f"c{k}"].to_numpy(np.float64)).astype(np.int64) for k in (1, 2)])
        self.goal = np.where(self.share > 0, _places(id, self.to.ravel()).reshape(2, -1), -1)
        self.leaves = (self.share > 0) & (self.goal < 0)
        waits = np.bincount(self.goal[self.goal >= 0], minlength=len(id))
        ready, self.waves = np.flatnonzero(waits == 0), []
        while len(ready):
            ends = self.goal[:, ready]
            on = ends >= 0
            from_, to = np.broadcast_to(ready, ends.shape)[on], ends[on]
            order = np.argsort(to, kind="stable")
            self.waves.append((from_[order], to[order], self.share[:, ready][on][order]))
            np.subtract.at(waits, to, 1)
            near = np.unique(to)
            ready = near[waits[near] == 0]

    def pour(self, water: np.ndarray) -> np.ndarray:
        """Water (cells, or cells x sources) after it has run down."""
        water = water.copy()
        for from_, to, share in self.waves:
            if len(to):
                first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                part = water[from_] * (share if water.ndim == 1 else share[:, None])
                water[to[first]] += np.add.reduceat(part, first, 0)
        return water


def contributing_area(breached: DataFrame, px: float, tile: int = TILE, scratch: Scratch | None = None) -> DataFrame:
    """row, col, sca: specific contributing area (own cell included, per cell width).

    A tile is solved once into the shares by which water at its entries leaves it for entries of other tiles, and its own
    water's outflow.  That graph is squared while it stays sparse (``FILL``), then walked, which halves or
    ends the rounds each time; with what enters, each tile runs once more.
    """
    scratch = scratch or Scratch(breached.sparkSession, "sca")
    in_tile = lambda r, c: {"tr": F.floor(F.col(r) / tile), "tc": F.floor(F.col(c) / tile)}
    cells = scratch.save(_receivers(breached, px).withColumns(in_tile("row", "col")), "cells")
    out = F.explode(F.array(*[F.struct(F.col(f"r{k}").alias("row"), F.col(f"c{k}").alias("col"), F.col(f"s{k}").alias("s")) for k in (1, 2)]))
    across = cells.select(F.col("tr").alias("from_tr"), F.col("tc").alias("from_tc"), out.alias("e")).select("from_tr", "from_tc", "e.*").where("s > 0").withColumns(in_tile("row", "col"))
    entries = scratch.save(across.where("from_tr <> tr or from_tc <> tc").select(cell_id().alias("id"), "tr", "tc").distinct(), "entries")

    def transfer(pdf: pd.DataFrame, enters: pd.DataFrame) -> pd.DataFrame:
        flow = _Flow(pdf)
        side, i = np.nonzero(flow.leaves)
        goal, share = flow.to[side, i], flow.share[side, i]
        own = flow.pour(np.full(len(pdf), px * px))[i] * share
        found = [pd.DataFrame({"id": ROOT, "next": goal, "w": own})]
        at = _places(flow.id, enters["id"].to_numpy(np.int64))
        at = at[at >= 0]
        for k in range(0, len(at), 64):
            some = at[k : k + 64]
            unit = np.zeros((len(pdf), len(some)))
            unit[some, np.arange(len(some))] = 1
            part = flow.pour(unit)[i] * share[:, None]
            row, col = np.nonzero(part > 0)
            found.append(pd.DataFrame({"id": flow.id[some[col]], "next": goal[row], "w": part[row, col]}))
        return pd.concat(found).groupby(["id", "next"], as_index=False)["w"].sum()

    moved = scratch.save(cells.groupBy("tr", "tc").cogroup(entries.groupBy("tr", "tc")).applyInPandas(transfer, "id long, next long, w double"), "moved")
    poured = moved.where(F.col("id") == ROOT).groupBy(F.col("next").alias("id")).agg(F.sum("w").alias("water"))
    total = scratch.save(entries.select("id").join(poured, "id", "left").fillna(0.0, ["water"]), "water")
    steps, many = moved.where(F.col("id") != ROOT), entries.count()
    step = lambda water, p: water.join(p, "id").groupBy(F.col("next").alias("id")).agg(F.sum(F.col("water") * F.col("w")).alias("water"))
    add = lambda a, b: a.unionByName(b).groupBy("id").agg(F.sum("water").alias("water"))
    while size := steps.count():
        if size > FILL * max(many, 1):  # too dense to be squared again: the rest is walked
            front = total
            while not (front := scratch.save(step(front, steps), "front")).isEmpty():
                total = scratch.save(add(total, front), "water")
            break
        total = scratch.save(add(total, step(total, steps)), "water")
        ahead = steps.select(F.col("id").alias("next"), F.col("next").alias("then"), F.col("w").alias("w2"))
        steps = scratch.save(steps.join(ahead, "next").groupBy("id", F.col("then").alias("next")).agg(F.sum(F.col("w") * F.col("w2")).alias("w")), "steps")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        water = _Flow(pdf).pour(px * px + np.nan_to_num(pdf["water"].to_numpy(np.float64)))
        return pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "sca": water / px})

    return cells.withColumn("id", cell_id()).join(total, "id", "left").drop("id").groupBy("tr", "tc").applyInPandas(fill, "row int, col int, sca double")


def steepest_pointer(dem: DataFrame, value: str, px: float) -> DataFrame:
    """id, to: the strictly lower neighbour of steepest descent (smaller id on ties), NULL if none."""
    near = stencil.neighbours(dem.where(F.col(value).isNotNull()).select("row", "col", F.col(value).alias("z")), "z", edge="null")
    drops = [F.when(F.col(name) < F.col("z"), F.struct(((F.col("z") - F.col(name)) / (px * math.sqrt(i * i + j * j))).alias("s"), (-(cell_id() + ((i << WIDTH_BITS) + j))).alias("k"))) for (i, j), name in _NAMES.items()]
    best = F.array_max(F.array_compact(F.array(*drops)))
    return near.select(cell_id().alias("id"), (-best["k"]).alias("to"))


def _ends(id: np.ndarray, to: np.ndarray, wet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pointers inside one tile end (a stream cell, a cell outside or ROOT: nowhere), and whether the way is done there."""
    own, up = np.arange(len(id)), np.where(wet | (to == ROOT), -1, _places(id, to))
    up = np.where(up < 0, own, up)
    for _ in range(int(len(id)).bit_length()):
        up = up[up]
    return np.where(wet[up], id[up], to[up]), wet[up] | (to[up] == ROOT)


def height_above_stream(dem: DataFrame, value: str, streams: DataFrame, pointers: DataFrame, scratch: Scratch | None = None, tile: int = TILE) -> DataFrame:
    """row, col, height over the stream cell that the pointers reach; NULL if they reach none.

    Tiles follow their pointers to a stream or out first; the cells that ways enter by are then solved by pointer jumping, where each round doubles the way covered.
    """
    scratch = scratch or Scratch(dem.sparkSession, "height")
    wet = streams.select(cell_id().alias("id"), F.lit(True).alias("wet"))
    row, col = F.shiftright("id", WIDTH_BITS), F.col("id").bitwiseAND(F.lit((1 << WIDTH_BITS) - 1))
    start = pointers.join(wet, "id", "left").select("id", F.coalesce("to", F.lit(ROOT)).alias("to"), F.coalesce("wet", F.lit(False)).alias("wet"))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        to, done = _ends(*(pdf[c].to_numpy() for c in ("id", "to", "wet")))
        return pd.DataFrame({"id": pdf["id"], "to": to, "done": done})

    tiled = start.groupBy(F.floor(row / tile), F.floor(col / tile)).applyInPandas(inside, "id long, to long, done boolean")
    tiled = scratch.save(tiled, "pointers")
    goals = tiled.where("not done").select(F.col("to").alias("id")).distinct()
    cur = scratch.save(tiled.join(goals, "id"), "ways")
    while not cur.where("not done").isEmpty():
        ahead = cur.select(F.col("id").alias("to"), F.col("to").alias("then"), F.col("done").alias("ends"))
        nxt = cur.join(ahead, "to", "left").select("id", F.when(F.col("done"), F.col("to")).otherwise(F.coalesce("then", F.lit(ROOT))).alias("to"), (F.col("done") | F.coalesce("ends", F.lit(True))).alias("done"))
        nxt = scratch.save(nxt, "ways")
        scratch.free(cur)
        cur = nxt
    onto = tiled.join(cur.select(F.col("id").alias("to"), F.col("to").alias("then")), "to", "left").select("id", F.when(F.col("done"), F.col("to")).otherwise(F.col("then")).alias("to"))
    z = dem.select(cell_id().alias("id"), F.col(value).alias("z"))
    ends = z.join(streams.select(cell_id().alias("id")), "id", "left_semi").select(F.col("id").alias("to"), F.col("z").alias("stream_z"))
    cells = dem.select("row", "col", cell_id().alias("id"), F.col(value).alias("z"))
    return cells.join(onto, "id").join(ends, "to", "left").select("row", "col", (F.col("z") - F.col("stream_z")).alias("height"))
