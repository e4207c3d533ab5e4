"""Stored image series: pixels and daily grids in partitions that a query's dates and orbits select.

Radar pixels lie in one folder for each orbit and period of acquisition (``PERIOD``), sorted by tile, so a scene filter prunes
folders (while the query runs: the filtered scenes are broadcast and their orbits and periods select the folders)
and a condition on the area skips row groups.  Daily grids lie by year and month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graupel.model import PIXELS

#: Cells of a tile's side; tiles are numbered so that neighbours in a row of tiles follow each other.
TILE = 256
#: Length of a folder's period; ``day`` suits series whose days hold gigabytes.
PERIOD = "month"
SERIES = f"{PIXELS}, acq_date DATE, tile LONG, orbit STRING, period DATE"
DAILY = "row INT, col INT, obs_date DATE, ndsi INT, year INT, month INT"
#: Files a folder is written to by default; a folder's pixels are dealt to them by tile, so no date is one task.
FILES = 8


def _tile(row="row", col="col"):
    return (F.shiftleft(F.floor(F.col(row) / TILE), 32) + F.floor(F.col(col) / TILE)).cast("long")


def _dated(scenes: DataFrame, period: str) -> DataFrame:
    return scenes.select("scene_id", "orbit", "acq_date", F.date_trunc(period, "acq_date").cast("date").alias("period"))


def write_series(scenes: DataFrame, pixels: DataFrame, path: str, files: int = FILES, period: str = PERIOD) -> None:
    """Pixels of the scenes by orbit and period; the folders of these scenes are replaced as a whole, others stay."""
    series = pixels.join(_dated(scenes, period), "scene_id").withColumn("tile", _tile())
    dealt = series.repartition("orbit", "period", F.pmod(F.xxhash64("tile"), F.lit(files)))
    dealt.sortWithinPartitions("orbit", "period", "tile", "row", "col").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("orbit", "period").parquet(path)


def read_series(spark: SparkSession, path: str, scenes: DataFrame, rows: tuple[int, int] | None = None, period: str = PERIOD, schema: str = SERIES, most_scenes: int = 200_000) -> DataFrame:
    """Stored pixels of the (filtered) scenes, in the rows [first, last] if given; ``period`` as written.

    Up to ``most_scenes`` scenes (checked) are broadcast, and their orbits and periods prune the folders; beyond that both sides are shuffled.
    """
    stored = spark.read.schema(schema).parquet(path)
    if rows:
        stored = stored.where(F.col("row").between(*rows) & (F.col("tile") >= F.lit((rows[0] // TILE) << 32)) & (F.col("tile") < F.lit((rows[1] // TILE + 1) << 32)))
    keep = _dated(scenes, period)
    small = keep.limit(most_scenes + 1).count() <= most_scenes
    return stored.join(F.broadcast(keep) if small else keep, ["orbit", "period", "scene_id", "acq_date"]).drop("tile", "period")


def write_daily(daily: DataFrame, path: str, files: int = FILES) -> None:
    """Daily grids (obs_date, row, col, ...) by year and month; the months of these rows are replaced, others stay."""
    dated = daily.withColumns({"year": F.year("obs_date"), "month": F.month("obs_date"), "_tile": _tile()})
    dealt = dated.repartition("year", "month", F.pmod(F.xxhash64("_tile"), F.lit(files))).sortWithinPartitions("year", "month", "_tile", "row", "col", "obs_date")
    dealt.drop("_tile").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path)


def read_daily(spark: SparkSession, path: str, years: list[int], first_month: int = 1, last_month: int = 12, schema: str = DAILY) -> DataFrame:
    """Stored daily grids of the years and months; no other folder is opened."""
    return spark.read.schema(schema).parquet(path).where(F.col("year").isin(years) & F.col("month").between(first_month, last_month)).drop("year", "month")
