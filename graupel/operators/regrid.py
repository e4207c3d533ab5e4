"""Resampling of cells to another grid, nearest or bilinear."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from graupel.model import GridSpec
from graupel.operators import stencil

#: Layers whose name holds this are categorical and keep their codes.
CATEGORICAL = "worldcover"
#: Source cells of a tile's side.
TILE = 256

Transform = Callable[[Column, Column], tuple[Column, Column]]


def resampling_for(name: Column) -> Column:
    return F.when(F.contains(F.lower(name), F.lit(CATEGORICAL)), "nearest").otherwise("bilinear")


def derive_grid(source: GridSpec, spark, forward: Transform, res: float, crs: str) -> GridSpec:
    """The target grid that covers the projected border of a source grid, snapped outward to ``res``."""
    border = source.border(spark)
    corner = border.select(F.explode(F.array(*[F.struct((F.col("col") + i).alias("c"), (F.col("row") + j).alias("r")) for i in (0, 1) for j in (0, 1)])).alias("p"))
    x, y = forward(F.lit(source.x0) + F.col("p.c") * source.px, F.lit(source.y0) - F.col("p.r") * source.px)
    b = corner.select(x.alias("x"), y.alias("y")).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    x0, y1 = b.x0 // res * res, -(-b.y1 // res) * res
    return GridSpec(x0, y1, res, int(-(-(b.x1 - x0) // res)), int(-(-(y1 - b.y0) // res)), crs)


def grid_bounds(grid: GridSpec, spark, inverse: Transform) -> tuple[float, float, float, float]:
    """West, south, east, north of a grid's border after ``inverse``."""
    lon, lat = inverse(grid.x(F.col("col")), grid.y(F.col("row")))
    b = grid.border(spark).select(lon.alias("x"), lat.alias("y")).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    return tuple(b)


def area_grid(area: tuple[float, float, float, float], scale: float, crs: str) -> GridSpec:
    """The grid of ``scale`` that covers an area (west, south, east, north), snapped outward."""
    x0, y1 = area[0] // scale * scale, -(-area[3] // scale) * scale
    return GridSpec(x0, y1, scale, int(-(-(area[2] - x0) // scale)), int(-(-(y1 - area[1]) // scale)), crs)


def regrid(cells: DataFrame, source: GridSpec, target: GridSpec, value: str, method: str = "bilinear", inverse: Transform | None = None, tile: int = TILE) -> DataFrame:
    """row, col, value on the target grid: each cell gathers 1 or 4 source cells.

    A target cell is sent once, to the source tile that it lies in; a source cell is sent to its tile and, at a border, to those next to it; tiles are
    resampled in arrays.  Missing source cells leave the mean, whose weights are scaled up; cells with none are absent.
    """
    if method not in ("nearest", "bilinear"):
        raise ValueError(f"no such method: {method}")
    near = method == "nearest"
    x, y = target.x(F.col("col")), target.y(F.col("row"))
    if inverse:
        x, y = inverse(x, y)
    back = 0.0 if near else 0.5
    at = target.cells(cells.sparkSession).select("row", "col", ((F.lit(source.y0) - y) / source.px - back).alias("v"), ((x - source.x0) / source.px - back).alias("u"))
    inside = at.where((F.col("v") >= -1) & (F.col("v") < source.height) & (F.col("u") >= -1) & (F.col("u") < source.width))
    goal = inside.withColumns({"tr": F.floor(F.floor("v") / tile), "tc": F.floor(F.floor("u") / tile)})
    known = cells.where(F.col(value).isNotNull())
    given = stencil.with_halo(known.select("row", "col", F.col(value).cast("double").alias("value")), tile)

    def gather(goal: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        v, u = goal["v"].to_numpy(), goal["u"].to_numpy()
        if not len(v) or not len(given):
            return pd.DataFrame({"row": [], "col": [], "value": []}).astype({"row": "int32", "col": "int32", "value": "float64"})
        r, c = np.floor(v).astype(np.int64), np.floor(u).astype(np.int64)
        top, left = min(r.min(), given["row"].min()), min(c.min(), given["col"].min())
        frame = np.full((max(r.max() + 1, given["row"].max()) - top + 1, max(c.max() + 1, given["col"].max()) - left + 1), np.nan)
        frame[given["row"].to_numpy() - top, given["col"].to_numpy() - left] = given["value"].to_numpy()
        r, c = r - top, c - left
        if near:
            out = frame[r, c]
        else:
            fy, fx = v - np.floor(v), u - np.floor(u)
            total, weight = np.zeros(len(v)), np.zeros(len(v))
            for i, wy in ((0, 1 - fy), (1, fy)):
                for j, wx in ((0, 1 - fx), (1, fx)):
                    one, w = frame[r + i, c + j], wy * wx
                    ok = ~np.isnan(one) & (w > 0)
                    total[ok] += w[ok] * one[ok]
                    weight[ok] += w[ok]
            out = np.divide(total, weight, out=np.full(len(v), np.nan), where=weight > 0)
        some = ~np.isnan(out)
        return pd.DataFrame({"row": goal["row"][some], "col": goal["col"][some], "value": out[some]})

    made = goal.groupBy("tr", "tc").cogroup(given.groupBy("tr", "tc")).applyInPandas(gather, "row int, col int, value double")
    kind = cells.schema[value].dataType if near else "double"
    return made.select("row", "col", F.col("value").cast(kind).alias(value))
