"""Cells, tiles and wide factor stacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def to_tiles(cells: DataFrame, size: int = 256) -> DataFrame:
    """layer, tile_row, tile_col, size, data: dense row-major arrays, NULL where a cell is missing.

    Each cell is put in with the NULLs before it, so steps follow the tile's size; a cell that comes twice is an error.
    """
    inner = F.pmod("row", F.lit(size)) * size + F.pmod("col", F.lit(size))
    grouped = cells.groupBy("layer", F.floor(F.col("row") / size).cast("int").alias("tile_row"), F.floor(F.col("col") / size).cast("int").alias("tile_col"))
    packed = grouped.agg(F.array_sort(F.collect_list(F.struct(inner.alias("k"), F.col("value").alias("v")))).alias("m"))
    place = lambda i: F.element_at("m", i)["k"]
    none = lambda n: F.array_repeat(F.lit(None).cast(cells.schema["value"].dataType), n)
    before = lambda c, i: c["k"] - 1 - F.when(i == 0, -1).otherwise(place(i))
    filled = F.flatten(F.concat(F.transform("m", lambda c, i: F.concat(none(before(c, i)), F.array(c["v"]))), F.array(none(size * size - 1 - place(-1)))))
    data = F.when(F.size(filled) == size * size, filled).otherwise(F.raise_error(F.lit("a cell comes twice in a tile")))
    return packed.select("layer", "tile_row", "tile_col", F.lit(size).alias("size"), data.alias("data"))


def from_tiles(tiles: DataFrame) -> DataFrame:
    """layer, row, col, value of the known cells."""
    each = tiles.select("layer", "tile_row", "tile_col", "size", F.posexplode("data").alias("k", "value")).where("value is not null")
    return each.select("layer", (F.col("tile_row") * F.col("size") + F.floor(F.col("k") / F.col("size"))).cast("int").alias("row"), (F.col("tile_col") * F.col("size") + F.col("k") % F.col("size")).cast("int").alias("col"), "value")


def factor_stack(cells: DataFrame, layers: list[str]) -> DataFrame:
    """One row a cell, one column a layer (explicit names, so no extra pass)."""
    return cells.groupBy("row", "col").pivot("layer", layers).agg(F.first("value", True))


def unstack(stack: DataFrame, layers: list[str]) -> DataFrame:
    """layer, row, col, value of the known values of a stack."""
    return stack.unpivot(["row", "col"], layers, "layer", "value").where("value is not null").select("layer", "row", "col", "value")
