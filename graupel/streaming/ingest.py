"""Incremental forms of file ingest and inventory append."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from graupel.functions.bands import grid_key
from graupel.operators import inventory


def ingest_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, transform=None):
    """Lands the files of ``source`` that haven't landed before, then stops; returns the finished query.

    The checkpoint remembers what has landed, so a rerun takes only new files.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    if transform:
        stream = transform(stream)
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class _Counts(StreamingQueryListener):
    """Sums the observed metrics of one query until it ends."""

    def __init__(self, name: str):
        self.name, self.total, self.ended = name, {}, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        for k, v in (seen.asDict() if seen is not None else {}).items():
            self.total[k] = self.total.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


def _files_landed(spark: SparkSession, checkpoint: str) -> int:
    """Files that the stream's own log names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/sources/0")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return 0
    return spark.read.text(f"{checkpoint}/sources/0").where(F.startswith("value", F.lit("{"))).select(F.get_json_object("value", "$.path").alias("path")).distinct().count()


def ingest_counted(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, valid: Column, transform=None, wait_s: float = 60) -> dict[str, int]:
    """``ingest_new`` with a tally: files read and skipped (landed by an earlier run), rows landed and failed.

    Rows for which ``valid`` isn't true fail: they are counted and left out.  The rows are counted by metrics observed on the stream,
    which a listener adds up over all batches; files come from the stream's log.
    """
    name = f"ingest_{uuid.uuid4().hex}"
    counts, before = _Counts(name), _files_landed(spark, checkpoint)
    good = F.coalesce(valid, F.lit(False))

    def counted(stream: DataFrame) -> DataFrame:
        seen = stream.observe(name, F.count_if(good).alias("landed"), F.count_if(~good).alias("failed")).where(good)
        return transform(seen) if transform else seen

    spark.streams.addListener(counts)
    try:
        ingest_new(spark, source, schema, target, checkpoint, counted)
        if not counts.ended.wait(wait_s):
            raise RuntimeError("the stream's metrics didn't arrive")
    finally:
        spark.streams.removeListener(counts)
    return {"files": _files_landed(spark, checkpoint) - before, "skipped": before, "landed": counts.total.get("landed", 0), "failed": counts.total.get("failed", 0)}


def append_marks(stream: DataFrame, path: str, checkpoint: str):
    """Adds a stream of inventory rows, batch by batch, keep-first by place; returns the finished query.

    A batch that is run again changes nothing, since its places are stored then.
    """
    spark = stream.sparkSession

    def add(batch: DataFrame, _: int) -> None:
        inventory.commit(spark, path, lambda stored: inventory.new_places(stored, batch))

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def first_in_window(stream: DataFrame, delay: str = "7 days", time: str = "added") -> DataFrame:
    """Keep-first by place with bounded state: places repeat freely after ``delay``."""
    keys = dict(zip(("_x", "_y"), grid_key(F.col("lon"), F.col("lat")), strict=True))
    return stream.withColumns(keys).withWatermark(time, delay).dropDuplicatesWithinWatermark(["_x", "_y"]).drop("_x", "_y")
