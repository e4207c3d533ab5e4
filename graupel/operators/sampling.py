"""Point sampling for models: declustering, matched absences, folds, leakage, autocorrelation, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from graupel.model import GridSpec
from graupel.operators.tiles import to_tiles

#: Ranges of the order in which ``least_per_group`` counts a group.
LEVELS = 1 << 16


def decluster(points: DataFrame, cell_m: float, order: str = "seq") -> DataFrame:
    """One point of each coarse cell, the first by ``order``."""
    keyed = points.withColumns({"_bx": F.floor(F.col("x") / cell_m), "_by": F.floor(F.col("y") / cell_m)})
    return keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_bx", "_by").orderBy(order))).where("_n = 1").drop("_bx", "_by", "_n")


def seeded(seed: int, *parts: Column | str) -> Column:
    """A number below 2^60 from a seed and some values, the same in every engine with md5."""
    key = F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def least_per_group(rows: DataFrame, groups: list[str], order: str, ties: tuple[str, ...], quota: DataFrame) -> DataFrame:
    """The ``_quota`` rows of each group (columns ``groups``) with the least ``order`` (a number below 2^60), exactly.

    A histogram of each group over ``LEVELS`` ranges of the order finds the range in which its quota ends; lower ranges are
    taken whole, and only the rows of that one range are ranked, so no task holds a group.
    """
    level = F.shiftright(order, 60 - LEVELS.bit_length() + 1).cast("int")
    sizes = rows.groupBy(*groups, level.alias("_level")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_level"))  # at most LEVELS rows a group
    before = sizes.withColumn("_upto", upto).join(quota, groups).where(F.col("_upto") - F.col("_n") < F.col("_quota"))
    last = before.groupBy(*groups).agg(F.max(F.struct("_level", (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_room"), (F.col("_quota") >= F.col("_upto")).alias("_whole"))).alias("_last"))
    placed = rows.join(last, groups).withColumn("_level", level).where(F.col("_level") <= F.col("_last._level"))
    rank = F.row_number().over(Window.partitionBy(*groups, "_level").orderBy(order, *ties))
    whole = (F.col("_level") < F.col("_last._level")) | F.col("_last._whole")
    return placed.withColumn("_rank", rank).where(whole | (F.col("_rank") <= F.col("_last._room"))).drop("_level", "_last", "_rank")


def matched_absences(presences: DataFrame, background: DataFrame, bins: dict[str, tuple[float, float, int]], ratio: int = 1, seed: int = 0) -> DataFrame:
    """``ratio`` background cells for each presence of a stratum of binned factors: those with the least seeded number."""
    stratum = [F.width_bucket(F.col(c), F.lit(lo), F.lit(hi), F.lit(n)).alias(f"_{c}") for c, (lo, hi, n) in bins.items()]
    keys = [f"_{c}" for c in bins]
    quota = presences.select(*stratum).groupBy(*keys).agg((F.count("*") * ratio).alias("_quota"))
    free = background.join(presences.select("row", "col"), ["row", "col"], "left_anti").select("*", *stratum, seeded(seed, "row", "col").alias("_draw"))
    return least_per_group(free, keys, "_draw", ("row", "col"), quota).drop(*keys, "_draw")


def spatial_fold(x: Column, y: Column, block_m: float, folds: int, seed: int = 0) -> Column:
    """Fold of a point's block."""
    return (seeded(seed, F.floor(x / block_m), F.floor(y / block_m)) % folds).cast("int")


def leaks(patches: DataFrame, half: int) -> DataFrame:
    """Cells that patches of several folds cover (row, col, fold are the patches' centres)."""
    span = F.sequence(F.lit(-half), F.lit(half))
    cells = patches.select("fold", "row", "col", F.explode(span).alias("i")).select("fold", (F.col("row") + F.col("i")).alias("row"), "col", F.explode(span).alias("j"))
    return cells.groupBy("row", (F.col("col") + F.col("j")).alias("col")).agg(F.countDistinct("fold").alias("folds")).where("folds > 1")


def morans_i(cells: DataFrame, value: str) -> DataFrame:
    """One row: n, pairs and Moran's I over the eight neighbours of known cells."""
    mean = cells.agg(F.avg(value).alias("mean"))
    known = cells.where(F.col(value).isNotNull()).join(F.broadcast(mean)).select("row", "col", (F.col(value) - F.col("mean")).alias("d"))  # one row
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))])
    sent = known.select(F.col("d").alias("e"), "row", "col", F.explode(steps).alias("s")).select("e", (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"))
    pairs = sent.join(known, ["row", "col"]).agg(F.count("*").alias("pairs"), F.sum(F.col("d") * F.col("e")).alias("cross"))
    spread = known.agg(F.count("*").alias("n"), F.sum(F.col("d") * F.col("d")).alias("square"))
    return spread.join(F.broadcast(pairs)).select("n", "pairs", (F.col("n") / F.col("pairs") * F.col("cross") / F.col("square")).alias("morans_i"))  # one row each


def tier(seen_optical: Column, seen_radar: Column) -> Column:
    """A: seen in optical and radar, B: optical, C: the rest."""
    return F.when(seen_optical & seen_radar, "A").when(seen_optical, "B").otherwise("C")


def sample_stack(points: DataFrame, stack: DataFrame, grid: GridSpec) -> DataFrame:
    """Points with the factors of their cell."""
    return points.withColumns({"row": grid.row(F.col("y")), "col": grid.col(F.col("x"))}).join(stack, ["row", "col"])


def patches(cells: DataFrame, size: int = 256) -> DataFrame:
    """Dense patches without overlap: layer, tile_row, tile_col, size, data."""
    return to_tiles(cells, size)
