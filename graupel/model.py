"""Grid definition, schemas and the missing-data policy.

Cells are rows (row, col, value); row grows to the south, col to the east.  Missing is NULL
everywhere: NaN and nodata become NULL when cells are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

INVENTORY = "lon DOUBLE, lat DOUBLE, event STRING, tier STRING, zone STRING, added TIMESTAMP"
PIXELS = "scene_id STRING, row INT, col INT, vv DOUBLE, vh DOUBLE, angle DOUBLE"
CELLS = "layer STRING, row INT, col INT, value FLOAT"
TILES = "layer STRING, tile_row INT, tile_col INT, size INT, data ARRAY<FLOAT>"

# fixed values: names of the factors, months of the season, years of the analysis
TOPOGRAPHY = ["slope", "aspect", "eastness", "northness", "roughness", "plan_curvature", "profile_curvature", "tri", "tpi", "vrm", "valley_depth"]
HYDROLOGY = ["twi", "spi"]
SEASON_MONTHS = [1, 2, 3, 4, 5]
ANALYSIS_YEARS = list(range(2017, 2025))


@dataclass(frozen=True)
class GridSpec:
    """A north-up grid: upper left corner, square cell size, size in cells, and its CRS."""

    x0: float
    y0: float
    px: float
    width: int
    height: int
    crs: str = "EPSG:32643"
    px_y: float | None = None

    def __post_init__(self):
        if self.px <= 0 or (self.px_y is not None and abs(self.px_y) != self.px):
            raise ValueError("cells must be square")

    @property
    def projected(self) -> bool:
        return self.crs.upper() != "EPSG:4326"

    def require_projected(self) -> None:
        """Distances and terrain need metres."""
        if not self.projected:
            raise ValueError("the grid must be projected: regrid it first")

    def x(self, col: Column) -> Column:
        return F.lit(self.x0) + (col + 0.5) * self.px

    def y(self, row: Column) -> Column:
        return F.lit(self.y0) - (row + 0.5) * self.px

    def col(self, x: Column) -> Column:
        return F.floor((x - self.x0) / self.px).cast("int")

    def row(self, y: Column) -> Column:
        return F.floor((F.lit(self.y0) - y) / self.px).cast("int")

    def border(self, spark) -> DataFrame:
        """The outermost cells of the grid, in proportion to its sides."""
        along = lambda n, one, many, ends: spark.range(n).select(F.explode(F.array(*map(F.lit, sorted(set(ends))))).alias(one), F.col("id").alias(many)).select(F.col("row").cast("int"), F.col("col").cast("int"))
        return along(self.width, "row", "col", (0, self.height - 1)).union(along(self.height, "col", "row", (0, self.width - 1))).distinct()

    def cells(self, spark) -> DataFrame:
        """All cells of the grid."""
        return spark.range(self.width * self.height).select(F.floor(F.col("id") / self.width).cast("int").alias("row"), (F.col("id") % self.width).cast("int").alias("col"))


def layer_grid(catalog: DataFrame, layer: str) -> GridSpec:
    """The grid of a layer from the catalog: layer, x0, y0, px, width, height, crs (one row a layer)."""
    found = catalog.where(F.col("layer") == layer).select("x0", "y0", "px", "width", "height", "crs").limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"the catalog has {'no' if not found else 'more than one'} grid for {layer}")
    return GridSpec(*found[0])


def clean(value: Column, nodata: float | None = None) -> Column:
    """NaN and the nodata value become NULL."""
    value = F.when(~F.isnan(value), value)
    return value if nodata is None else F.when(value != nodata, value)
