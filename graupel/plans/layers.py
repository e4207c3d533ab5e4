"""Distance layers and base layers as one plan each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graupel.functions import predicates as P
from graupel.model import ANALYSIS_YEARS, SEASON_MONTHS, GridSpec
from graupel.operators import ingest, regrid, temporal, vector

# fixed values: cell size of each base layer in metres
SCALES = {"nasadem_elevation": 30.0, "worldclim_temp_winter": 1000.0, "worldclim_precip_winter": 1000.0, "esa_worldcover": 10.0, "modis_scd": 500.0}


def compute_distances(vertices: DataFrame, grid: GridSpec, layers: list[str], forward: regrid.Transform | None = None) -> DataFrame:
    """layer, row, col, distance to the lines of each layer, all layers in one job.

    ``vertices``: layer, fid, seq, geom_type, x, y; ``forward`` projects longitude and latitude.  Other
    geometries than lines are left out; a layer that touches no cell is NULL.
    """
    grid.require_projected()
    lines = vertices.where(P.line_feature() & F.col("layer").isin(layers))
    if forward:
        x, y = forward(F.col("x"), F.col("y"))
        lines = lines.withColumns({"x": x, "y": y})
    return vector.distance_transform(vector.rasterize_lines(lines, grid), grid, layers)


def base_layers(elevation: DataFrame, monthly: DataFrame, landcover: DataFrame, daily_snow: DataFrame, grid: GridSpec, area, years: list[int] = ANALYSIS_YEARS, scales: dict[str, float] | None = None) -> DataFrame:
    """layer, row, col, value of elevation, winter temperature and precipitation, land cover and snow duration in the area.

    ``scales`` names the cell size of a layer's own grid over the area (``SCALES``); others keep the source's cells.
    """
    climate = temporal.season_climate(monthly, SEASON_MONTHS)
    parts = [
        (elevation.select("row", "col", F.col("elev").alias("value")), "nasadem_elevation"),
        (climate.select("row", "col", F.col("temp_winter").alias("value")), "worldclim_temp_winter"),
        (climate.select("row", "col", F.col("precip_winter").alias("value")), "worldclim_precip_winter"),
        (temporal.first_version(landcover).select("row", "col", F.col("lulc").alias("value")), "esa_worldcover"),
        (temporal.snow_duration(daily_snow, years).select("row", "col", F.col("scd").alias("value")), "modis_scd"),
    ]
    out = None
    for cells, name in parts:
        layer = ingest.export_layer(cells, grid, area, name, (scales or {}).get(name))
        out = layer if out is None else out.unionByName(layer)
    return out


def regrid_layers(cells: DataFrame, source: GridSpec, target: GridSpec, names: list[str], inverse: regrid.Transform | None = None) -> DataFrame:
    """Every layer on one target grid: nearest for categorical names, else bilinear."""
    out = None
    for name in names:
        method = "nearest" if regrid.CATEGORICAL in name.lower() else "bilinear"
        own = regrid.regrid(cells.where(F.col("layer") == name), source, target, "value", method, inverse)
        layer = own.select(F.lit(name).alias("layer"), "row", "col", F.col("value").cast("float").alias("value"))
        out = layer if out is None else out.unionByName(layer)
    return out


def terrain_flattening(pixels: DataFrame) -> DataFrame:
    """Identity: the place of a later radiometric correction."""
    return pixels


def release_point(features: DataFrame, elevation: DataFrame) -> DataFrame:
    """Identity: the place of a later trace upslope."""
    return features
