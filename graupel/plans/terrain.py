"""All terrain and drainage factors of an elevation grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graupel.functions import bands as B
from graupel.model import HYDROLOGY, TOPOGRAPHY
from graupel.operators import hydro, stencil
from graupel.session import Scratch

FACTORS = TOPOGRAPHY + HYDROLOGY


def compute_terrain(dem: DataFrame, px: float, value: str = "elev", stream_threshold: float = 100.0, tpi_window: int = 11, pointer_source: str = "breached", tile: int = hydro.TILE) -> DataFrame:
    """row, col and the 13 factors.

    One neighbour pass serves slope, aspect, curvatures, ruggedness and roughness.  Streams are cells whose
    specific contributing area is over the threshold; heights above them are of the raw elevation.
    """
    scratch = Scratch(dem.sparkSession, "terrain")
    near = stencil.neighbours(dem.select("row", "col", value), value)
    plan, profile = stencil.curvatures(px)
    base = scratch.save(near.select("row", "col", F.col("c").alias(value), stencil.slope_horn(px).alias("slope"), stencil.aspect_horn(px).alias("aspect"), plan.alias("plan_curvature"), profile.alias("profile_curvature"), stencil.ruggedness().alias("tri"), stencil.roughness_near().alias("roughness")), "base")
    cut = scratch.save(hydro.breach(dem, value, tile, scratch), "breached")
    sca = scratch.save(hydro.contributing_area(cut, px, tile, scratch), "sca")
    flow = cut.select("row", "col", "breached") if pointer_source == "breached" else dem.select("row", "col", F.col(value).alias("breached"))
    pointers = hydro.steepest_pointer(flow, "breached", px)
    up = cut.where("parent_row is not null").select(hydro.cell_id().alias("id"), hydro.cell_id("parent_row", "parent_col").alias("up"))
    pointers = pointers.join(up, "id", "left").select("id", F.coalesce("to", "up").alias("to"))
    valley = hydro.height_above_stream(dem, value, sca.where(F.col("sca") > stream_threshold), pointers, scratch, tile)
    out = stencil.position_and_ruggedness(base, value, tpi_window).withColumns({"eastness": B.eastness(F.col("aspect")), "northness": B.northness(F.col("aspect"))})
    for part in (sca, valley.withColumnRenamed("height", "valley_depth")):
        out = out.join(part, ["row", "col"], "left")
    out = out.withColumns({"twi": B.wetness(F.col("sca"), F.col("slope")), "spi": B.stream_power(F.col("sca"), F.col("slope"))})
    return out.select("row", "col", *FACTORS)
