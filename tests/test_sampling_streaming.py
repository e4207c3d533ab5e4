"""Sampling, folds, baseline and the incremental forms."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graupel.functions import lineage
from graupel.operators import inventory, sampling, stencil, temporal
from graupel.plans.baseline import fold_auc
from graupel.streaming import ingest as stream


def test_declustered_points_are_apart(spark):
    pts = spark.createDataFrame([(k, float(k * 3 % 50), float(k * 7 % 50)) for k in range(200)], "seq int, x double, y double")
    kept = sampling.decluster(pts, 10.0).collect()
    cells = [(r["x"] // 10, r["y"] // 10) for r in kept]
    assert len(set(cells)) == len(cells) == len({(r["x"] // 10, r["y"] // 10) for r in pts.collect()})


def test_absences_match_strata_and_leaks_show(spark):
    back = spark.createDataFrame([(r, c, float(r * 5)) for r in range(10) for c in range(10)], "row int, col int, slope double")
    some = back.where("row in (1, 6) and col < 2")
    got = sampling.matched_absences(some, back, {"slope": (0.0, 50.0, 5)}, 2)
    assert got.join(some, ["row", "col"], "left_semi").isEmpty()
    assert {(r["k"], r["count"]) for r in got.groupBy(F.floor(F.col("slope") / 10).alias("k")).count().collect()} == {(0, 4), (3, 4)}
    near = spark.createDataFrame([(0, 5, 5), (1, 5, 8)], "fold int, row int, col int")
    assert sampling.leaks(near, 1).isEmpty() and sampling.leaks(near, 2).count() == 10


def test_least_per_group_equals_ranking(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 5000, 1).otherwise(F.col("id") % 5).cast("int").alias("g"), F.col("id"), sampling.seeded(3, F.col("id") % 4000).alias("o"))
    quota = spark.createDataFrame([(1, 700), (2, 5000), (3, 0), (7, 3)], "g int, _quota long")
    got = sampling.least_per_group(rows, ["g"], "o", ("id",), quota)
    ranked = rows.join(quota, "g").withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("o", "id"))).where("n <= _quota")
    assert sorted((r["g"], r["id"]) for r in got.collect()) == sorted((r["g"], r["id"]) for r in ranked.collect())
    # rows are ranked within a range of one group only: the window's largest partition is small
    assert got.groupBy("g", F.shiftright("o", 44)).count().agg(F.max("count")).first()[0] <= 4


def test_counts_of_a_stream_and_rows_in_a_window(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))
    spark.range(10).repartition(2).write.parquet(src)
    run = lambda: stream.ingest_counted(spark, src, "id long", out, log, F.col("id") % 5 != 0)
    assert run() == {"files": 2, "skipped": 0, "landed": 8, "failed": 2}
    assert run() == {"files": 0, "skipped": 2, "landed": 0, "failed": 0}
    spark.range(20, 23).coalesce(1).write.mode("append").parquet(src)
    assert run() == {"files": 1, "skipped": 2, "landed": 2, "failed": 1}
    assert spark.read.schema("id long").parquet(out).count() == 10

    marks, kept = str(tmp_path / "marks"), str(tmp_path / "kept")
    schema = "lon double, lat double, added timestamp"
    for day, lon in (("2024-01-01", 77.1), ("2024-01-03", 77.1), ("2024-01-20", 77.3), ("2024-01-21", 77.1), ("2024-01-02", 77.5)):  # the last one is late
        spark.createDataFrame([(lon, 32.0, day)], "lon double, lat double, added string").withColumn("added", F.to_timestamp("added")).coalesce(1).write.mode("append").parquet(marks)
        first = stream.first_in_window(spark.readStream.schema(schema).parquet(marks), "7 days")
        first.writeStream.format("parquet").option("path", kept).option("checkpointLocation", str(tmp_path / "marks_log")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((str(r["added"])[:10], r["lon"]) for r in spark.read.schema(schema).parquet(kept).collect())
    assert got == [("2024-01-01", 77.1), ("2024-01-20", 77.3), ("2024-01-21", 77.1)]


def test_baseline_separates_and_rejects_event_signals(spark):
    rows = [(float(k % 7), float(k % 3), int(k % 7 > 3), k % 2) for k in range(120)]
    df = spark.createDataFrame(rows, "slope double, tri double, label int, fold int")
    out = fold_auc(df, ["slope", "tri"], folds=2, trees=5).collect()
    assert len(out) == 4 and all(r["auc"] > 0.95 for r in out)
    tagged = df.select("*", lineage.of_event(F.col("tri") * 2, "dvv"))
    with pytest.raises(ValueError, match="texture"):
        fold_auc(tagged.withColumnRenamed("dvv", "texture"), ["slope", "texture"])


def test_event_signals_keep_their_origin(spark, tmp_path):
    series = spark.createDataFrame([("A", 1, 1, "2024-01-01", -10.0, -16.0, 30.0), ("A", 1, 1, "2024-02-01", -7.0, -13.0, 30.0)], "orbit string, row int, col int, day string, vv double, vh double, angle double").withColumn("acq_date", F.to_date("day"))
    both = temporal.composite_change(series, ("2024-01-01", "2024-01-15"), ("2024-01-15", "2024-03-01"))
    assert lineage.event_columns(both) == {"vv_act", "vh_act"}
    change = temporal.difference(both)
    assert lineage.event_columns(change) == {"vv_act", "vh_act", "dvv", "dvh"}
    smooth = stencil.focal(change.select("orbit", "row", "col", "dvv"), ["dvv"], 1.0, keys=("orbit",))
    assert lineage.event_columns(smooth) == {"dvv"}
    smooth.select("row", "col", F.col("dvv").alias("texture")).write.parquet(str(tmp_path / "t"))
    cells = spark.createDataFrame([(1, 1, 3.0)], "row int, col int, slope double")
    again = cells.join(spark.read.parquet(str(tmp_path / "t")), ["row", "col"]).where("texture is not null").withColumnRenamed("texture", "roughness_2")
    assert lineage.event_columns(again) == {"roughness_2"}
    lineage.require_no_event_signal(again, ["slope"])
    with pytest.raises(ValueError, match="roughness_2"):
        lineage.require_no_event_signal(again, ["slope", "roughness_2"])


def test_streams_take_only_what_is_new(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))
    spark.range(3).write.parquet(src)
    stream.ingest_new(spark, src, "id long", out, log)
    spark.range(3, 5).write.mode("append").parquet(src)
    stream.ingest_new(spark, src, "id long", out, log)
    assert sorted(r[0] for r in spark.read.schema("id long").parquet(out).collect()) == [0, 1, 2, 3, 4]


def test_streamed_marks_equal_batch(spark, tmp_path):
    src, path, log = (str(tmp_path / n) for n in ("marks", "inventory", "log"))
    schema = "lon double, lat double, event string, tier string, zone string, added timestamp"
    rows = [(77.1, 32.1, "a"), (77.1000001, 32.1, "b"), (77.2, 32.2, "a")]
    df = spark.createDataFrame(rows, "lon double, lat double, event string").select("*", F.lit("A").alias("tier"), F.lit("release").alias("zone"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("added"))
    df.coalesce(1).write.parquet(src)
    for _ in range(2):
        stream.append_marks(spark.readStream.schema(schema).parquet(src), path, log)
    assert inventory.read_inventory(spark, path).count() == 2
