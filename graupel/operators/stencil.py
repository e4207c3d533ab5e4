"""Neighbourhood operators on cells (row, col, value).

Neighbours come from range frames, so a missing cell is missing and never shifts others.  A 3x3
neighbourhood takes two window passes (along rows, then along columns).  ``edge`` says what a
missing neighbour is: ``repeat`` the nearer known cell, ``null`` nothing (the result is NULL).
"""

from __future__ import annotations

import warnings
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from graupel.functions.bands import eastness, northness
from graupel.functions.lineage import passed_on


TILE = 128


def _across():
    return Window.partitionBy("row").orderBy("col")


def _down():
    return Window.partitionBy("col").orderBy("row")


AROUND = ("nw", "n", "ne", "w", "e", "sw", "s", "se")


def _at(value, window, step) -> Column:
    return F.first(value).over(window.rangeBetween(step, step))


def neighbours(cells: DataFrame, value: str, edge: str = "repeat") -> DataFrame:
    """Adds c and the eight neighbours nw n ne w e sw s se of ``value``."""
    side = cells.withColumns({"c": F.col(value), "w": _at(value, _across(), -1), "e": _at(value, _across(), 1)})
    if edge == "repeat":
        side = side.withColumns({k: F.coalesce(k, "c") for k in ("w", "e")})
    full = side.withColumns({a + b: _at(k, _down(), step) for a, step in (("n", -1), ("s", 1)) for k, b in (("w", "w"), ("c", ""), ("e", "e"))})
    if edge == "repeat":
        full = full.withColumns({a + b: F.coalesce(a + b, k) for a in "ns" for k, b in (("w", "w"), ("c", ""), ("e", "e"))})
    return full


def _gradient(px: float) -> tuple[Column, Column]:
    """Horn's weighted differences to the east and the north."""
    c = F.col
    dx = (c("ne") + c("e") * 2 + c("se") - c("nw") - c("w") * 2 - c("sw")) / (8 * px)
    dy = (c("nw") + c("n") * 2 + c("ne") - c("sw") - c("s") * 2 - c("se")) / (8 * px)
    return dx, dy


def slope_horn(px: float) -> Column:
    """Degrees, on ``neighbours``."""
    dx, dy = _gradient(px)
    return F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))


def aspect_horn(px: float) -> Column:
    """Direction of descent in degrees clockwise from north; NULL on level cells."""
    dx, dy = _gradient(px)
    turn = F.degrees(F.atan2(-dx, -dy))
    return F.when((dx != 0) | (dy != 0), F.when(turn < 0, turn + 360.0).otherwise(turn))


def slope_four(cells: DataFrame, value: str, px: float, px_y: float | None = None) -> DataFrame:
    """Adds slope from the four nearest neighbours; NULL where one is missing."""
    w, e, n, s = _at(value, _across(), -1), _at(value, _across(), 1), _at(value, _down(), -1), _at(value, _down(), 1)
    near = cells.withColumns({"_w": w, "_e": e}).withColumns({"_n": n, "_s": s})
    dx, dy = (F.col("_e") - F.col("_w")) / (2 * px), (F.col("_s") - F.col("_n")) / (2 * (px_y or px))
    return near.withColumn("slope", F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))).drop("_w", "_e", "_n", "_s")


def curvatures(px: float) -> tuple[Column, Column]:
    """Plan and profile curvature (Zevenbergen and Thorne 1987) on ``neighbours``; 0 on level cells."""
    c = F.col
    d = ((c("w") + c("e")) / 2 - c("c")) / px**2
    e = ((c("n") + c("s")) / 2 - c("c")) / px**2
    f = (c("ne") + c("sw") - c("nw") - c("se")) / (4 * px**2)
    g, h = (c("e") - c("w")) / (2 * px), (c("n") - c("s")) / (2 * px)
    steep = g * g + h * h
    plan = (d * h * h + e * g * g - f * g * h) * 2 / steep
    profile = (d * g * g + e * h * h + f * g * h) * -2 / steep
    return F.when(steep > 0, plan).otherwise(0.0 * steep), F.when(steep > 0, profile).otherwise(0.0 * steep)


def ruggedness() -> Column:
    """Root of the squared differences to the eight neighbours (Riley 1999)."""
    return F.sqrt(reduce(add, [(F.col(k) - F.col("c")) * (F.col(k) - F.col("c")) for k in AROUND]))


def roughness_near() -> Column:
    """Population deviation of the 3x3 box, on ``neighbours``."""
    nine = [F.col(k).cast("double") for k in ("c", *AROUND)]
    mean = reduce(add, nine) / 9
    return F.sqrt(F.greatest(reduce(add, [v * v for v in nine]) / 9 - mean * mean, F.lit(0.0)))


def box_mean(cells: DataFrame, values: list[str], keep: list[str]) -> DataFrame:
    """3x3 means of columns; a missing neighbour counts as the nearer known cell."""
    mean = lambda w, k: (F.coalesce(_at(k, w, -1), F.col(k)) + F.col(k) + F.coalesce(_at(k, w, 1), F.col(k))) / 3
    across = cells.select(*keep, *[mean(_across(), v).alias(v) for v in values])
    return across.select(*keep, *[mean(_down(), v).alias(v) for v in values])


def roughness(cells: DataFrame, value: str) -> DataFrame:
    """row, col, roughness: population deviation of the 3x3 box."""
    squared = cells.select("row", "col", F.col(value).cast("double").alias("m"), (F.col(value) * F.col(value)).cast("double").alias("q"))
    box = box_mean(squared, ["m", "q"], ["row", "col"])
    return box.select("row", "col", F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0))).alias("roughness"))


def _upward(slope: str, aspect: str) -> dict[str, Column]:
    """The unit vector that stands on a cell; level cells point up."""
    s = F.radians(slope)
    return {"x": F.coalesce(F.sin(s) * eastness(F.col(aspect)), F.lit(0.0)), "y": F.coalesce(F.sin(s) * northness(F.col(aspect)), F.lit(0.0)), "z": F.cos(s)}


def _spread(*means: str) -> Column:
    """Vector ruggedness from the mean vector of a 3x3 window."""
    return 1.0 - F.sqrt(reduce(add, [F.col(k) * 9 * F.col(k) * 9 for k in means])) / 9


def vector_ruggedness(cells: DataFrame, slope: str = "slope", aspect: str = "aspect") -> DataFrame:
    """row, col, vrm (Sappington 2007) of a 3x3 window; level cells point up."""
    parts = cells.select("row", "col", *[v.alias(k) for k, v in _upward(slope, aspect).items()])
    return box_mean(parts, ["x", "y", "z"], ["row", "col"]).select("row", "col", _spread("x", "y", "z").alias("vrm"))


def topographic_position(cells: DataFrame, value: str, window: int = 11) -> DataFrame:
    """row, col, tpi: value less the mean of the window's known cells."""
    r = window // 2
    across, down = _across().rangeBetween(-r, r), _down().rangeBetween(-r, r)
    line = cells.select("row", "col", value, F.sum(value).over(across).alias("_s"), F.count(value).over(across).alias("_n"))
    return line.select("row", "col", (F.col(value) - F.sum("_s").over(down) / F.sum("_n").over(down)).alias("tpi"))


def position_and_ruggedness(cells: DataFrame, value: str, window: int = 11, slope: str = "slope", aspect: str = "aspect") -> DataFrame:
    """All columns, tpi and vrm, from one pass along rows and one along columns."""
    r, keep = window // 2, [F.col(c) for c in cells.columns]
    across, down = _across().rangeBetween(-r, r), _down().rangeBetween(-r, r)
    mean = lambda w, k: (F.coalesce(_at(k, w, -1), F.col(k)) + F.col(k) + F.coalesce(_at(k, w, 1), F.col(k))) / 3
    line = cells.select(*keep, *[v.alias(f"_{k}") for k, v in _upward(slope, aspect).items()])
    line = line.select(*keep, F.sum(value).over(across).alias("_s"), F.count(value).over(across).alias("_n"), *[mean(_across(), f"_{k}").alias(f"_{k}") for k in "xyz"])
    line = line.select(*keep, (F.col(value) - F.sum("_s").over(down) / F.sum("_n").over(down)).alias("tpi"), *[mean(_down(), f"_{k}").alias(f"_{k}") for k in "xyz"])
    return line.select(*keep, "tpi", _spread("_x", "_y", "_z").alias("vrm"))


def disk(radius_cells: float) -> list[tuple[int, int]]:
    """Offsets of the cells whose centre is within the radius."""
    r = int(radius_cells)
    return [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if i * i + j * j <= radius_cells**2]


def with_halo(cells: DataFrame, tile: int, halo: int = 1) -> DataFrame:
    """Every cell in its own tile and, within ``halo`` cells of a border, in those next to it: adds tr, tc."""
    near = lambda c: F.array_distinct(F.transform(F.array(*map(F.lit, (-halo, 0, halo))), lambda k: F.floor((F.col(c) + k) / tile)))
    return cells.withColumn("tr", F.explode(near("row"))).withColumn("tc", F.explode(near("col")))


def focal(cells: DataFrame, values: list[str], radius_cells: float, how: str = "mean", keys: tuple[str, ...] = (), tile: int = TILE) -> DataFrame:
    """Mean or median of the known cells in a disk, at the known cells (one row for each of keys, row, col).

    Tiles with halos of the disk's radius: a cell is sent once and, near a border, to the tiles that need it, whatever the disk's size.
    """
    offsets = disk(radius_cells)
    reach = max(int(radius_cells), 1)
    reduce_by = {"mean": np.nanmean, "median": np.nanmedian}[how]

    def over(pdf: pd.DataFrame) -> pd.DataFrame:
        row, col = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        r, c = row - row.min() + reach, col - col.min() + reach
        own = (row // tile == pdf["tr"].to_numpy()) & (col // tile == pdf["tc"].to_numpy())
        out = pdf.loc[own, [*keys, "row", "col"]].copy()
        frame = np.full((r.max() + reach + 1, c.max() + reach + 1), np.nan)
        for v in values:
            frame[:] = np.nan
            frame[r, c] = pdf[v].to_numpy(np.float64)
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")  # disks without a known value
                out[v] = reduce_by(np.stack([frame[r[own] + i, c[own] + j] for i, j in offsets]), axis=0)
        return out

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*keys, "row", "col").schema.fields)
    got = with_halo(cells.select(*keys, "row", "col", *values), tile, reach).groupBy(*keys, "tr", "tc").applyInPandas(over, f"{kinds}, " + ", ".join(f"{v} double" for v in values))
    return passed_on(got.select(*keys, "row", "col", *[F.when(~F.isnan(v), F.col(v)).alias(v) for v in values]), cells)
