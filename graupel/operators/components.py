"""Connected cells of a mask, their sizes, outlines and export."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from graupel.functions.geodesy import A, E2, FLAT
from graupel.operators.graph import connected_components
from graupel.operators.stencil import with_halo
from graupel.session import Scratch

WIDTH_BITS = 31
#: Rows and columns of a tile whose cells are connected in one task.
TILE = 256
#: Steps to the cell ahead of an edge of direction 0 to 3 (east, south, west, north) and to the one beside it, outside.
AHEAD = ((0, 1), (1, 0), (0, -1), (-1, 0))
BESIDE = ((-1, 0), (0, 1), (1, 0), (0, -1))


def cell_id(row="row", col="col") -> Column:
    return F.shiftleft(F.col(row).cast("bigint"), WIDTH_BITS) + F.col(col)


def _tile_parts(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Of distinct cells in (row, col) order, the place of the first cell of each one's 8-connected part."""
    r, c = row - row.min(), col - col.min() + 1
    frame = np.full((r.max() + 2, c.max() + 2), -1)
    own = np.arange(len(row))
    frame[r, c] = own
    ends = [frame[r + i, c + j] for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))]
    a, b = np.concatenate([own[e >= 0] for e in ends]), np.concatenate([e[e >= 0] for e in ends])
    first = own
    while len(a):
        low, high = np.minimum(first[a], first[b]), np.maximum(first[a], first[b])
        first = first.copy()
        np.minimum.at(first, high, low)
        while (first[first] != first).any():
            first = first[first]
        apart = first[a] != first[b]
        a, b = a[apart], b[apart]
    return first


def label_cells(mask: DataFrame, keys: tuple[str, ...] = (), scratch: Scratch | None = None, tile: int = TILE) -> DataFrame:
    """keys, row, col, component (smallest cell id of the 8-connected part).

    Tiles of cells become parts first; these meet by the cells along the tiles' borders, so the component loop handles parts that cross one, not cells.
    """
    scratch = scratch or Scratch(mask.sparkSession, "cells")

    def parts_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["row", "col"]).sort_values(["row", "col"])
        row, col = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64)
        id = (row << WIDTH_BITS) + col
        r, c = row % tile, col % tile
        return pdf[[*keys, "row", "col"]].assign(id=id[_tile_parts(row, col)], border=(r == 0) | (r == tile - 1) | (c == 0) | (c == tile - 1))

    in_tile = {"_tr": F.floor(F.col("row") / tile), "_tc": F.floor(F.col("col") / tile)}
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in mask.select(*keys, "row", "col").schema.fields)
    cells = mask.select(*keys, "row", "col").withColumns(in_tile).groupBy(*keys, "_tr", "_tc").applyInPandas(parts_of, f"{kinds}id long, border boolean")
    cells = scratch.save(cells.withColumn("node", F.xxhash64(*keys, "id") if keys else F.col("id")), "tiled")
    border = cells.where("border").select(*keys, "row", "col", "node", "id")
    ahead = F.explode(F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    edges = border.select(*keys, F.col("node").alias("a"), ahead.alias("to")).select(*keys, "a", "to.*").join(border.select(*keys, "row", "col", F.col("node").alias("b")), [*keys, "row", "col"])
    parts = connected_components(edges.where("a <> b").select("a", "b"), scratch=scratch)
    named = border.select("node", "id").distinct().join(parts, "node")
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    across = scratch.save(named.join(least, "component").select("node", "least"), "across")
    return cells.join(across, "node", "left").select(*keys, "row", "col", F.coalesce("least", "id").alias("component"))


def component_stats(labels: DataFrame, px: float, keys: tuple[str, ...] = (), area: Column | None = None) -> DataFrame:
    """Cells, area in m2 and bounding cells of each component; ``area`` per cell, for grids in degrees."""
    return labels.groupBy(*keys, "component").agg(
        F.count("*").alias("cells"), F.sum(area if area is not None else F.lit(px * px)).alias("area_m2"),
        F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"),
    )


def degree_cell_area(south: Column, north: Column, width: float) -> Column:
    """Area in m2 of a cell of ``width`` degrees between two parallels on the WGS 84 ellipsoid (exact, by authalic latitude)."""
    e, minor = math.sqrt(E2), A * (1 - FLAT)

    def below(lat: Column) -> Column:
        x = F.sin(F.radians(lat))
        return x / (1 - e * e * x * x) + F.log((1 + e * x) / (1 - e * x)) / (2 * e)

    return (below(north) - below(south)) * (minor * minor * math.radians(width) / 2)


def degree_areas(labels: DataFrame, grid, keys: tuple[str, ...] = ()) -> DataFrame:
    """``component_stats`` of labels on a grid in degrees."""
    top = F.lit(grid.y0) - F.col("row") * grid.px
    return component_stats(labels, grid.px, keys, degree_cell_area(top - grid.px, top, grid.px))


def at_least(stats: DataFrame, min_area_m2: float = 1500.0) -> DataFrame:
    return stats.where(F.col("area_m2") >= min_area_m2)


def pixel_count_mask(labels: DataFrame, least: int = 10, most: int = 50, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells whose component's size, counted up to ``most``, is ``least`` or more."""
    size = labels.groupBy(*keys, "component").agg(F.count("*").alias("n"))
    return labels.join(size, [*keys, "component"]).where(F.least("n", F.lit(most)) >= least).drop("n")


def boundary_edges(labels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cell edges that occur once in a component: keys, component, x0, y0, x1, y1 in cell corners."""
    side = lambda *p: F.struct(*[(F.col(c) + d).alias(n) for (c, d), n in zip(p, ("x0", "y0", "x1", "y1"), strict=True)])
    c, r = "col", "row"
    sides = F.array(side((c, 0), (r, 0), (c, 1), (r, 0)), side((c, 0), (r, 1), (c, 1), (r, 1)), side((c, 0), (r, 0), (c, 0), (r, 1)), side((c, 1), (r, 0), (c, 1), (r, 1)))
    edges = labels.select(*keys, "component", F.explode(sides).alias("e")).select(*keys, "component", "e.*")
    return edges.groupBy(*keys, "component", "x0", "y0", "x1", "y1").agg(F.count("*").alias("n")).where("n = 1").drop("n")


def _chains(succ: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First edge of each edge's chain and the place in it; -1 in ``succ`` ends a chain, a closed one starts at its least code."""
    n = len(succ)
    own, rounds = np.arange(n), max(int(n).bit_length(), 1)
    before = np.full(n, -1)
    before[succ[succ >= 0]] = own[succ >= 0]

    def back():
        up, steps = np.where(before < 0, own, before), (before >= 0).astype(np.int64)
        for _ in range(rounds):
            steps, up = steps + steps[up], up[up]
        return up, steps

    up, steps = back()
    closed = before[up] >= 0
    if closed.any():
        low, jump = code.copy(), np.where(closed, succ, own)
        for _ in range(rounds):
            low, jump = np.minimum(low, low[jump]), jump[jump]
        before[closed & (low == code)] = -1
        up, steps = back()
    return up, steps


def outline_rings(labels: DataFrame, keys: tuple[str, ...] = (), scratch: Scratch | None = None, turns: bool = False, tile: int = TILE) -> DataFrame:
    """The closed outlines of every component: keys, component, ring, seq (from 0), x, y in cell corners; ``turns`` adds the edge's direction (0 east, 1 south, 2 west, 3 north).

    Edges run with their cell on the right, so outer rings turn clockwise and holes the other way; where two cells touch at a
    corner only, the ring stays with its cell.  A ring is named by its smallest edge (row, column, direction), at which it starts.
    A tile with a halo puts its cells' edges in chains; chains that leave it become rings by components of their successors and get
    their places from doubled pointers, so no ring is gathered in one task and the loops follow the tiles' borders.
    """
    scratch = scratch or Scratch(labels.sparkSession, "rings")
    kinds = {f.name: f.dataType.simpleString() for f in labels.select(*keys, "component", "row", "col").schema.fields}

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        row, col = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64)
        r, c = row - row.min() + 1, col - col.min() + 1
        frame = np.full((r.max() + 2, c.max() + 2), -1)
        name = pd.factorize(pdf["component"])[0]
        frame[r, c] = name
        mine = np.flatnonzero((row // tile == pdf["tr"].to_numpy()) & (col // tile == pdf["tc"].to_numpy()))
        like = lambda at, step: frame[r[at] + step[0], c[at] + step[1]] == name[at]
        at, turn = (np.concatenate(x) for x in zip(*[(e, np.full(len(e), k)) for k in range(4) for e in (mine[~like(mine, BESIDE[k])],)], strict=True))
        code_of = lambda row, col, turn: (row + np.isin(turn, (2, 3)) << 32) + (col + np.isin(turn, (1, 2)) << 2) + turn
        f, o = np.array(AHEAD)[turn], np.array(BESIDE)[turn]
        straight = frame[r[at] + f[:, 0], c[at] + f[:, 1]] == name[at]
        left = straight & (frame[r[at] + f[:, 0] + o[:, 0], c[at] + f[:, 1] + o[:, 1]] == name[at])
        to_row, to_col = row[at] + straight * f[:, 0] + left * o[:, 0], col[at] + straight * f[:, 1] + left * o[:, 1]
        code, goal = code_of(row[at], col[at], turn), code_of(to_row, to_col, (turn + 1 - straight - left) % 4)
        order = np.argsort(code)
        spot = order[np.minimum(np.searchsorted(code[order], goal), max(len(code) - 1, 0))] if len(code) else at
        inside = code[spot] == goal
        first, place = _chains(np.where(inside, spot, -1), code)
        out = pdf.iloc[at][[*keys, "component"]].copy()
        return out.assign(x=col[at] + np.isin(turn, (1, 2)), y=row[at] + np.isin(turn, (2, 3)), turn=turn, code=code, chain=code[first], place=place, onto=pd.arrays.IntegerArray(goal, inside))

    each = with_halo(labels.select(*keys, "component", "row", "col"), tile).groupBy(*keys, "tr", "tc")
    schema = "".join(f"`{k}` {kinds[k]}, " for k in (*keys, "component")) + f"x {kinds['col']}, y {kinds['row']}, turn int, code long, chain long, place long, onto long"
    node = lambda c: F.xxhash64(*keys, c) if keys else F.col(c)
    edges = scratch.save(each.applyInPandas(trace, schema).withColumn("node", node("chain")), "edges")
    head = F.min(F.struct("code", "place"))
    chains = edges.withColumn("next", F.when(F.col("onto").isNotNull(), node("onto"))).groupBy("node").agg(head.alias("head"), F.count("*").alias("n"), F.max("next").alias("next"))
    chains = scratch.save(chains.select("node", F.col("head.code").alias("low"), F.col("head.place").alias("at"), "n", "next"), "chains")
    # chains that leave their tile
    open_ = chains.where("next is not null")
    parts = connected_components(open_, "node", "next", scratch).withColumnRenamed("component", "part")
    placed = scratch.save(open_.join(parts, "node"), "placed")
    heads = placed.groupBy("part").agg(F.min("low").alias("ring"), F.sum("n").alias("total"))
    named = scratch.save(placed.join(heads, "part").withColumn("head", F.col("low") == F.col("ring")), "named")
    before = named.select(F.col("next").alias("node"), F.col("node").alias("to"), (F.col("n") - F.when(F.col("head"), F.col("at")).otherwise(0)).alias("more"))
    walk = named.join(before, "node").select("node", F.when(F.col("head"), F.col("node")).otherwise(F.col("to")).alias("to"), F.when(F.col("head"), 0).otherwise(F.col("more")).alias("steps"))
    walk, known = scratch.save(walk, "walk"), None
    while True:
        ahead = walk.select(F.col("node").alias("to"), F.col("to").alias("onto"), F.col("steps").alias("more"))
        nxt = scratch.save(walk.join(ahead, "to").select("node", F.col("onto").alias("to"), (F.col("steps") + F.col("more")).alias("steps")), "walk")
        total = nxt.agg(F.sum("steps")).first()[0]
        scratch.free(walk)
        walk = nxt
        if total == known:
            break
        known = total
    start = F.when(F.col("head"), -F.col("at")).otherwise(F.col("steps"))
    found = named.join(walk.select("node", "steps"), "node").select("node", "ring", "total", start.alias("start"))
    found = scratch.save(found, "found")
    seq = F.coalesce(F.pmod(F.col("start") + F.col("place"), F.col("total")), F.col("place")).cast("int")
    return edges.join(found, "node", "left").select(*keys, "component", F.coalesce("ring", "chain").alias("ring"), seq.alias("seq"), "x", "y", *["turn"] * turns)


def polygon_parts(rings: DataFrame, labels: DataFrame, keys: tuple[str, ...] = (), scratch: Scratch | None = None) -> DataFrame:
    """keys, ring, outer: the outer ring (of the same component) around each ring, itself for outer ones; ``rings`` with turns.

    A ring whose first edge runs south is a hole.  West of that edge lies a cell of the part that it is cut from; the run of cells in its row ends
    at an edge of the part's outer ring or of another hole, which begins further up or further west.  So each hole points
    to a ring before it, and doubled pointers end at the outer ring: an even-odd test along one row each.
    """
    scratch = scratch or Scratch(rings.sparkSession, "parts")
    on = [*keys, "component"]
    line = Window.partitionBy(*keys, "row").orderBy("col")
    runs = labels.withColumn("_run", F.col("col") - F.row_number().over(line))
    west = runs.groupBy(*on, "row", "_run").agg(F.min("col").alias("x"), F.max("col").alias("hi"))
    heads = rings.where("seq = 0").select(*on, "ring", "turn", F.col("y").alias("row"), (F.col("x") - 1).alias("col"))
    at = heads.where("turn = 1").join(runs, [*on, "row", "col"]).join(west, [*on, "row", "_run"]).select(*on, "ring", "x", (F.col("row") + 1).alias("y"))
    onto = rings.where("turn = 3").select(*on, F.col("ring").alias("outer"), "x", "y")
    inner = at.join(onto, [*on, "x", "y"]).select(*keys, "ring", "outer")
    cur = scratch.save(inner.unionByName(heads.where("turn = 0").select(*keys, "ring", F.col("ring").alias("outer"))), "outer")
    while True:
        ahead = cur.select(*keys, F.col("ring").alias("outer"), F.col("outer").alias("then"))
        cur = scratch.save(cur.join(ahead, [*keys, "outer"]).select(*keys, "ring", F.col("then").alias("outer"), (F.col("then") != F.col("outer")).alias("moved")), "outer")
        if cur.where("moved").isEmpty():
            return cur.drop("moved")
        cur = cur.drop("moved")


def outline_features(rings: DataFrame, labels: DataFrame, grid, keys: tuple[str, ...] = ()) -> DataFrame:
    """One GeoJSON feature for each component (column ``value``), in the grid's coordinates; ``rings`` with turns.

    A component with one outer ring is a Polygon with its holes; parts that touch at corners only make a MultiPolygon, each part with its own holes.
    """
    x, y = F.lit(grid.x0) + F.col("x") * grid.px, F.lit(grid.y0) - F.col("y") * grid.px
    points = F.array_sort(F.collect_list(F.struct("seq", x.alias("x"), y.alias("y"))))
    ring = rings.groupBy(*keys, "component", "ring").agg(points.alias("p"))
    closed = F.transform(F.concat("p", F.slice("p", 1, 1)), lambda v: F.array(v["x"], v["y"]))
    each = ring.join(polygon_parts(rings, labels, keys), [*keys, "ring"]).select(*keys, "component", "outer", "ring", closed.alias("line"))
    lines = F.array_sort(F.collect_list(F.struct((F.col("ring") != F.col("outer")).alias("hole"), "ring", "line")))  # the outer one first
    part = each.groupBy(*keys, "component", "outer").agg(F.transform(lines, lambda v: v["line"]).alias("lines"))
    shape = part.groupBy(*keys, "component").agg(F.transform(F.array_sort(F.collect_list(F.struct("outer", "lines"))), lambda v: v["lines"]).alias("parts"))
    feature = lambda kind, of: F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), of.alias("coordinates")).alias("geometry"), F.struct(*keys, "component").alias("properties")))
    return shape.select(F.when(F.size("parts") == 1, feature("Polygon", F.element_at("parts", 1))).otherwise(feature("MultiPolygon", F.col("parts"))).alias("value"))
