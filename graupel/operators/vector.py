"""Lines on a grid and exact distances to them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from graupel.model import GridSpec

ROWS_PER_GROUP = 64


def rasterize_lines(vertices: DataFrame, grid: GridSpec, keys: tuple[str, ...] = ("layer",)) -> DataFrame:
    """Every cell that a line touches, once: keys, row, col.  Vertices: keys, fid, seq, x, y.

    A segment is cut at the column borders; in each column it crosses it touches the rows between its
    heights at the borders.
    """
    order = Window.partitionBy(*keys, "fid").orderBy("seq")
    # in cells before the difference, as in the SQL: far from the origin the other order rounds to another cell now and then
    gx, gy = F.col("x") / grid.px - grid.x0 / grid.px, F.lit(grid.y0 / grid.px) - F.col("y") / grid.px
    points = vertices.select(*keys, "fid", "seq", gx.alias("x0"), gy.alias("y0"))
    pairs = points.withColumns({"x1": F.lead("x0").over(order), "y1": F.lead("y0").over(order)}).where("x1 is not null")
    low, high = F.floor(F.least("x0", "x1")).cast("int"), F.floor(F.greatest("x0", "x1")).cast("int")
    first, last = F.greatest(low, F.lit(0)), F.least(high, F.lit(grid.width - 1))
    crossed = pairs.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("col"))
    a = F.greatest(F.col("col").cast("double"), F.least("x0", "x1"))
    b = F.least(F.col("col") + 1.0, F.greatest("x0", "x1"))
    height = lambda x: F.when(F.col("x1") == F.col("x0"), None).otherwise(F.col("y0") + (x - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")))
    ya, yb = F.coalesce(height(a), F.col("y0")), F.coalesce(height(b), F.col("y1"))
    top, bottom = F.greatest(F.floor(F.least(ya, yb)).cast("int"), F.lit(0)), F.least(F.floor(F.greatest(ya, yb)).cast("int"), F.lit(grid.height - 1))
    touched = crossed.withColumns({"top": top, "bottom": bottom}).where("top <= bottom")
    return touched.select(*keys, F.explode(F.sequence("top", "bottom")).alias("row"), "col").distinct()


def _envelope(height: np.ndarray) -> np.ndarray:
    """min over x' of (x - x')^2 + height(x')^2 for all x of one row; inf where no height is known."""
    known = np.flatnonzero(np.isfinite(height))
    if not len(known):
        return np.full(len(height), np.inf)
    f = height[known] ** 2
    hull, border = [0], [-np.inf]
    for q in range(1, len(known)):
        while True:
            p = hull[-1]
            s = (f[q] + known[q] ** 2 - f[p] - known[p] ** 2) / (2.0 * (known[q] - known[p]))
            if s > border[-1]:
                break
            hull.pop()
            border.pop()
        hull.append(q)
        border.append(s)
    at = np.searchsorted(border, np.arange(len(height)), "right") - 1
    own = np.asarray(hull)[at]
    return (np.arange(len(height)) - known[own]) ** 2 + f[own]


def distance_transform(burned: DataFrame, grid: GridSpec, layers: list[str]) -> DataFrame:
    """layer, row, col, distance (m, FLOAT) to the nearest burned cell, exact, for every grid cell.

    Two passes (Felzenszwalb and Huttenlocher 2012): the nearest burned cell of the column by window
    functions, then the lower envelope of parabolas of each row.  A layer without burned cells has NULL.
    """
    grid.require_projected()
    spark = burned.sparkSession
    cells = grid.cells(spark).select(F.explode(F.array(*map(F.lit, layers))).alias("layer"), "row", "col")
    marked = cells.join(burned.select("layer", "row", "col", F.col("row").alias("hit")), ["layer", "row", "col"], "left")
    down = Window.partitionBy("layer", "col").orderBy("row")
    above = F.last("hit", True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    # the rows from below as running rows too: a frame with an open end is read anew for each row
    below = F.last("hit", True).over(Window.partitionBy("layer", "col").orderBy(F.desc("row")).rowsBetween(Window.unboundedPreceding, 0))
    heights = marked.select("layer", "row", "col", F.least(F.col("row") - above, below - F.col("row")).alias("g"), F.floor(F.col("row") / ROWS_PER_GROUP).alias("band"))

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"])
        g = pdf["g"].astype("float64").fillna(np.inf).to_numpy().reshape(-1, grid.width)
        d = np.sqrt(np.concatenate([_envelope(r) for r in g])) * grid.px
        return pd.DataFrame({"layer": pdf["layer"], "row": pdf["row"], "col": pdf["col"], "distance": np.where(np.isfinite(d), d, np.nan)})

    out = heights.groupBy("layer", "band").applyInPandas(across, "layer string, row int, col int, distance double")
    return out.select("layer", "row", "col", F.when(~F.isnan("distance"), F.col("distance")).cast("float").alias("distance"))


def feature_boxes(vertices: DataFrame, keys: tuple[str, ...] = ("fid",)) -> DataFrame:
    """Bounding box of each feature: keys, xmin, ymin, xmax, ymax."""
    return vertices.groupBy(*keys).agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))


def in_box(features: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Features (with box columns) whose box meets ``box`` (xmin, ymin, xmax, ymax); on a stored table the conditions reach the scan."""
    return features.where((F.col("xmin") <= box[2]) & (F.col("xmax") >= box[0]) & (F.col("ymin") <= box[3]) & (F.col("ymax") >= box[1]))


def vertices_in_box(vertices: DataFrame, box: tuple[float, float, float, float], keys: tuple[str, ...] = ("fid",)) -> DataFrame:
    """All vertices of the features whose bounding box meets ``box``."""
    return vertices.join(in_box(feature_boxes(vertices, keys), box).select(*keys), list(keys), "left_semi")


def morton(x: Column, y: Column) -> Column:
    """The place of a cell on the Z curve: the bits of two numbers below 2^24, alternating (x first from below)."""

    def spread(v: Column) -> Column:
        v = v.cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):  # fixed values
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def write_features(vertices: DataFrame, path: str, keys: tuple[str, ...] = ("fid",), row_group: int = 128 << 20) -> None:
    """Features as rows, with their vertices in order and their boxes.

    Rows are ranged and sorted by the Z curve over their boxes' centres (2^24 steps across the extent), so that a row group of ``row_group`` bytes covers a small
    block in both directions and a scan by box skips the others.
    """
    points = F.array_sort(F.collect_list(F.struct("seq", "x", "y")))
    rows = vertices.groupBy(*keys).agg(points.alias("vertices"), F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))
    extent = vertices.agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    step = lambda low, high, a, b: F.least(F.floor(((F.col(low) + F.col(high)) / 2 - F.col(a)) * ((1 << 24) / F.greatest(F.col(b) - F.col(a), F.lit(1e-9)))), F.lit((1 << 24) - 1))
    keyed = rows.join(F.broadcast(extent)).withColumn("_z", morton(step("xmin", "xmax", "_x0", "_x1"), step("ymin", "ymax", "_y0", "_y1"))).drop("_x0", "_x1", "_y0", "_y1")  # one row
    keyed.repartitionByRange("_z").sortWithinPartitions("_z").drop("_z").write.mode("overwrite").option("parquet.block.size", row_group).parquet(path)


def read_features(spark, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if box is None else in_box(rows, box)


def layer_of_tags():
    """Road for a highway tag, stream for a waterway tag."""
    return F.when(F.col("highway").isNotNull(), "road").when(F.col("waterway").isNotNull(), "stream")
