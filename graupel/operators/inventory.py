"""The point inventory: marks, keep-first deduplication, append and summary."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from graupel.functions.bands import grid_key
from graupel.model import INVENTORY

FEATURE = "struct<geometry: struct<type: string, coordinates: array<double>>>"


def geojson_points(features: DataFrame, column: str = "feature", keep: tuple[str, ...] = ("seq",)) -> DataFrame:
    """keep, lon, lat of the Point features; null features and geometries are skipped."""
    kind = F.get_json_object(column, "$.geometry.type")
    points = features.where(kind == "Point").select(*keep, F.from_json(column, FEATURE).alias("f"))
    xy = F.col("f.geometry.coordinates")
    return points.select(*keep, F.try_element_at(xy, F.lit(1)).alias("lon"), F.try_element_at(xy, F.lit(2)).alias("lat"))


def clicks(events: DataFrame) -> DataFrame:
    """lon, lat of click events, whose coordinates come as (lat, lon)."""
    ok = events.where((F.col("type") == "click") & F.col("coordinates").isNotNull())
    return ok.select(F.element_at("coordinates", 2).alias("lon"), F.element_at("coordinates", 1).alias("lat"))


def marks(points: DataFrame, event: str, added: Column, tier: str = "A", zone: str = "release") -> DataFrame:
    """Inventory rows of new points: six decimals, half-even."""
    return points.select(F.bround("lon", 6).alias("lon"), F.bround("lat", 6).alias("lat"), F.lit(event).alias("event"), F.lit(tier).alias("tier"), F.lit(zone).alias("zone"), added.alias("added"))


def keep_first(rows: DataFrame, order: tuple[str, ...] = ("batch", "seq"), extra_key: tuple[str, ...] = ()) -> DataFrame:
    """The first row of each place (four decimals), by ``order``; stored batches come first."""
    keyed = rows.withColumns(dict(zip(("_x", "_y"), grid_key(F.col("lon"), F.col("lat")), strict=True)))
    first = Window.partitionBy("_x", "_y", *extra_key).orderBy(*order)
    return keyed.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_x", "_y", "_n")


def append(stored: DataFrame, new: DataFrame, extra_key: tuple[str, ...] = ()) -> DataFrame:
    """Stored and new rows, deduplicated: stored beat new, earlier new beat later."""
    step = F.monotonically_increasing_id()
    both = stored.withColumns({"batch": F.lit(0), "seq": step}).unionByName(new.withColumns({"batch": F.lit(1), "seq": step}), allowMissingColumns=True)
    return keep_first(both, extra_key=extra_key).drop("batch", "seq")


def summary(rows: DataFrame) -> DataFrame:
    """kind (total, event, tier), value, n in one pass; null values are no group."""
    sets = rows.groupingSets([[], ["event"], ["tier"]], "event", "tier").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    kind = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "event").otherwise("tier")
    named = sets.select(kind.alias("kind"), F.when(F.col("g") == 1, F.col("event")).when(F.col("g") == 2, F.col("tier")).alias("value"), "n")
    return named.where((F.col("kind") == "total") | F.col("value").isNotNull()).orderBy("kind", F.desc("n"), "value")


def new_places(stored: DataFrame, new: DataFrame, order: tuple[str, ...] = (), extra_key: tuple[str, ...] = ()) -> DataFrame:
    """The first new row (by ``order``, else as they come) of each place that isn't stored yet."""
    own = new if order else new.withColumn("_step", F.monotonically_increasing_id())
    own = keep_first(own, order or ("_step",), extra_key).drop("_step")
    keyed = lambda df: df.withColumns(dict(zip(("_x", "_y"), grid_key(F.col("lon"), F.col("lat")), strict=True)))
    return keyed(own).join(keyed(stored).select("_x", "_y", *extra_key), ["_x", "_y", *extra_key], "left_anti").select(own.columns)


class Log:
    """The commit log of a stored inventory.

    ``log/<version>.json`` names the segments (folders of rows) of a version; it appears whole and only if no other
    run has taken its number, so of two runs that meet one is told and looks again.  Segments and manifests are never written twice; a reader takes
    the newest manifest and so sees one version, whatever others add.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.jvm = spark, path.rstrip("/"), spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        at = self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.conf), at

    def snapshot(self) -> tuple[int, list[str]]:
        """Number and segments of the newest version; 0 and none if there is none."""
        fs, at = self._at("log")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        versions = [int(n[:-5]) for n in names if n.endswith(".json")]
        if not versions:
            return 0, []
        fs, at = self._at(f"log/{max(versions):010d}.json")
        stream = fs.open(at)
        try:
            return max(versions), json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["segments"]
        finally:
            stream.close()

    def read(self, segments: list[str]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], INVENTORY)
        return self.spark.read.schema(INVENTORY).csv([f"{self.path}/{s}" for s in segments], header=True)

    def write_segment(self, rows: DataFrame) -> str | None:
        """The name of a new segment; None (and no folder) if there are no rows."""
        name = f"segment-{uuid.uuid4().hex}"
        rows.write.csv(f"{self.path}/{name}", header=True)
        if not self.read([name]).isEmpty():
            return name
        fs, at = self._at(name)
        fs.delete(at, True)
        return None

    def put(self, version: int, segments: list[str]) -> bool:
        """Adds the manifest of a version unless another run has: it is written aside and moved without overwriting."""
        fs, aside = self._at(f"log/.{uuid.uuid4().hex}")
        _, place = self._at(f"log/{version:010d}.json")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps({"segments": segments}).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, place, none)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception.toString()):
                raise
            fs.delete(aside, False)
            return False


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the stored inventory; a path that doesn't exist is empty."""
    log = Log(spark, path)
    return log.read(log.snapshot()[1])


def commit(spark: SparkSession, path: str, make, attempts: int = 20) -> int:
    """Adds the rows ``make(stored)`` as one segment and returns the version that holds them.

    ``make`` is called again with the newest version when another run came first, so places that it has taken since aren't added twice.
    Without rows nothing is written and the version stays.
    """
    log = Log(spark, path)
    for _ in range(attempts):
        version, segments = log.snapshot()
        added = log.write_segment(make(log.read(segments)))
        if added is None:
            return version
        if log.put(version + 1, [*segments, added]):
            return version + 1
    raise RuntimeError(f"{path}: other runs came first {attempts} times")


def compact(spark: SparkSession, path: str, most: int = 16) -> int:
    """Rewrites a version of more than ``most`` segments as one; nothing happens if another run comes first. Returns the newest version."""
    log = Log(spark, path)
    version, segments = log.snapshot()
    if len(segments) > most and (whole := log.write_segment(log.read(segments))) and log.put(version + 1, [whole]):
        return version + 1
    return version


def save_marks(spark: SparkSession, points: DataFrame, event: str, path: str, added: Column | None = None, **kind: str) -> DataFrame:
    """Adds points at places that aren't stored yet; nothing changes when there are none."""
    rows = marks(points, event, added if added is not None else F.date_trunc("second", F.current_timestamp()), **kind)
    commit(spark, path, lambda stored: new_places(stored, rows))
    return read_inventory(spark, path)
