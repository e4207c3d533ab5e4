"""Selection of files to fetch and the tally of what came of it."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from graupel.operators import regrid
from graupel.functions.predicates import file_in_window


def daily_grids(files: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """name, obs_date of the daily grid files in the date window, by name."""
    own = files.where(F.endswith("name", F.lit(".nc")) & file_in_window(F.col("name"), first, last))
    day = F.try_to_date(F.replace(F.replace("name", F.lit("snd_"), F.lit("")), F.lit(".nc"), F.lit("")), "yyyyMMdd")
    return own.select("name", day.alias("obs_date"), *[c for c in files.columns if c != "name"]).orderBy("name")


def pending(listing: DataFrame, landed: DataFrame) -> DataFrame:
    """Listed files that haven't landed with any content."""
    return listing.join(landed.where("landed_size > 0").select("name"), "name", "left_anti")


def tally(listing: DataFrame, landed: DataFrame, failed: DataFrame) -> DataFrame:
    """status (skipped, failed, done), n."""
    known = landed.where("landed_size > 0").select("name", F.lit(True).alias("has"))
    lost = failed.select("name", F.lit(True).alias("bad")).distinct()
    status = F.when(F.col("has"), "skipped").when(F.col("bad"), "failed").otherwise("done")
    return listing.select("name").join(known, "name", "left").join(lost, "name", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def layer_files(spark: SparkSession, folder: str, pattern: str = "base_*") -> DataFrame:
    """Paths of the layer files of a folder, by name; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length").orderBy("name")


def write_layer(cells: DataFrame, path: str) -> None:
    """Cells as FLOAT, one folder a layer; only the layers written are replaced."""
    out = cells.select("layer", "row", "col", F.col("value").cast("float").alias("value"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer").parquet(path)


def read_layer(spark: SparkSession, path: str, layer: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("layer") == layer)


def export_layer(cells: DataFrame, grid, area, name: str, scale: float | None = None) -> DataFrame:
    """The cells in the area as layer ``base_<name>`` of FLOAT values; with ``scale`` resampled to the area's grid of that cell size (categorical names by the nearest cell)."""
    if scale and scale != grid.px:
        target = regrid.area_grid(area, scale, grid.crs)
        method = "nearest" if regrid.CATEGORICAL in name.lower() else "bilinear"
        cells, grid = regrid.regrid(cells, grid, target, "value", method), target
    x, y = grid.x(F.col("col")), grid.y(F.col("row"))
    inside = cells.where((x >= area[0]) & (y >= area[1]) & (x <= area[2]) & (y <= area[3]))
    return inside.select(F.lit(f"base_{name}").alias("layer"), "row", "col", F.col("value").cast("float").alias("value"))


def parameters(**values) -> str:
    """A short digest of the parameters of a layer, the same for the same values in any order."""
    return hashlib.sha256(json.dumps(values, sort_keys=True, default=str).encode()).hexdigest()[:16]


def missing_layers(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """Wanted (layer, params) not in the catalog of finished layers; ``params`` from ``parameters``."""
    return wanted.join(catalog, ["layer", "params"], "left_anti")
