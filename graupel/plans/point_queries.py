"""Registered queries of the point inventory and of sampling for models, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from graupel.functions import bands as B, geodesy
from graupel.model import GridSpec
from graupel.operators import components, inventory, sampling, temporal, tiles
from graupel.plans.queries import _dem, _layers, _xy, UTM
from graupel.plans.registry import query
from graupel.session import Scratch
from graupel.sources.fixtures import CELL, view
from graupel.streaming import ingest as stream

R = B.rounded
_KEY = "CAST(round_even(round_even(lon, 6) * 10000, 0) AS BIGINT), CAST(round_even(round_even(lat, 6) * 10000, 0) AS BIGINT)"


@query("saved_marks", f"""SELECT round_even(lon, 6) AS lon, round_even(lat, 6) AS lat, CASE WHEN batch = 0 THEN 'first' ELSE 'second' END AS event, 'B' AS tier, 'release' AS zone,
  CASE WHEN batch = 0 THEN '2024-01-01 00:00:00' ELSE '2024-02-01 12:30:05' END AS added FROM (
  SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY batch, seq) AS n FROM v_marks) t WHERE n = 1""", ("v_marks",))
def saved_marks(spark, d):
    path = Scratch(spark, "inventory").base
    points = view(spark, d, "v_marks").orderBy("seq")
    for batch, event, added in ((0, "first", "2024-01-01"), (1, "second", "2024-02-01 12:30:05"), (1, "third", "2024-03-01")):  # the last finds all places taken
        own = points.where(F.col("batch") == batch).select("lon", "lat")
        inventory.save_marks(spark, own, event, path, F.lit(added).cast("timestamp"), tier="B")
    inventory.compact(spark, path, 1)
    return inventory.read_inventory(spark, path).withColumn("added", F.date_format("added", "yyyy-MM-dd HH:mm:ss"))


@query("interleaved_marks", f"""SELECT round_even(lon, 6) AS lon, round_even(lat, 6) AS lat, CASE WHEN batch = 0 THEN 'theirs' ELSE 'ours' END AS event FROM (
  SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY batch, seq) AS n FROM v_marks) t WHERE n = 1""", ("v_marks",))
def interleaved_marks(spark, d):
    """Another run adds its marks after ours has read the inventory: ours looks again and nothing is lost or twice."""
    path = Scratch(spark, "inventory").base
    points = view(spark, d, "v_marks").orderBy("seq")
    own = lambda batch, event: inventory.marks(points.where(F.col("batch") == batch).select("lon", "lat"), event, F.lit("2024-01-01").cast("timestamp"))
    meets = [True]

    def ours(stored):
        if meets.pop() if meets else False:
            inventory.commit(spark, path, lambda other: inventory.new_places(other, own(0, "theirs")))
        return inventory.new_places(stored, own(1, "ours"))

    inventory.commit(spark, path, ours)
    return inventory.read_inventory(spark, path).select("lon", "lat", "event")


@query("streamed_marks", f"""SELECT seq, event FROM (SELECT *, row_number() OVER (PARTITION BY CAST(round_even(lon * 10000, 0) AS BIGINT), CAST(round_even(lat * 10000, 0) AS BIGINT) ORDER BY batch, seq) AS n FROM v_marks) t WHERE n = 1""", ("v_marks",))
def streamed_marks(spark, d):
    base = Scratch(spark, "marks").base
    rows = view(spark, d, "v_marks").select("lon", "lat", F.concat_ws("|", "event", "seq").alias("event"), "tier", "zone", F.lit("2024-01-01").cast("timestamp").alias("added"), "batch", "seq")
    for batch in (0, 1):
        rows.where(F.col("batch") == batch).orderBy("seq").drop("batch", "seq").coalesce(1).write.mode("append").parquet(f"{base}/source")
        stream.append_marks(spark.readStream.schema("lon double, lat double, event string, tier string, zone string, added timestamp").parquet(f"{base}/source"), f"{base}/inventory", f"{base}/log")
    parts = F.split("event", "\\|")
    return inventory.read_inventory(spark, f"{base}/inventory").select(parts[1].cast("long").alias("seq"), parts[0].alias("event"))


@query("click_points", "SELECT 76 + user_id % 20 + 0.25 AS lon, 31 + user_id % 3 + 0.5 AS lat FROM events WHERE event_type = 'click' AND event_id % 5 <> 0")
def click_points(spark, d):
    at = F.when(F.col("event_id") % 5 != 0, F.array(F.col("user_id") % 3 + F.lit(31.5e0), F.col("user_id") % 20 + F.lit(76.25e0)))
    return inventory.clicks(spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("type"), at.alias("coordinates")))


def _bin_sql(value: str, low: float, high: float, n: int) -> str:
    return f"CASE WHEN {value} < {low} THEN 0 WHEN {value} >= {high} THEN {n + 1} ELSE CAST(floor({n} * ({value} - {low}) / ({high} - {low})) AS BIGINT) + 1 END"


_STRATA = {"elev": (1999.9973, 2399.9973, 4), "slope": (-0.5, 45.5, 3)}


_DRAW = "CAST('0x' || md5('0:' || row || ':' || col)[1:15] AS BIGINT)"


@query("matched_absences", f""", cells AS (SELECT d.row, d.col, {_bin_sql("d.elev", *_STRATA["elev"])} AS elev_bin, {_bin_sql("s.slope", *_STRATA["slope"])} AS slope_bin, sca > 500 AS seen FROM v_dem d JOIN v_sca s ON s.row = d.row AND s.col = d.col),
quota AS (SELECT elev_bin, slope_bin, 2 * count(*) AS q FROM cells WHERE seen GROUP BY ALL),
free AS (SELECT *, row_number() OVER (PARTITION BY elev_bin, slope_bin ORDER BY {_DRAW}, row, col) AS n FROM cells WHERE NOT seen)
SELECT row, col, CAST(elev_bin AS BIGINT) AS elev_bin, CAST(slope_bin AS BIGINT) AS slope_bin FROM quota JOIN free USING (elev_bin, slope_bin) WHERE n <= q""", ("v_dem", "v_sca"))
def matched_absences(spark, d):
    cells = _dem(spark, d).join(view(spark, d, "v_sca"), ["row", "col"])
    drawn = sampling.matched_absences(cells.where("sca > 500"), cells, _STRATA, 2)
    bins = [F.width_bucket(F.col(c), F.lit(lo), F.lit(hi), F.lit(n)).alias(f"{c}_bin") for c, (lo, hi, n) in _STRATA.items()]
    return drawn.select("row", "col", *bins)


@query("spatial_blocks", f""", {UTM}, placed AS (SELECT seq, CAST(floor(x / 20000) AS BIGINT) AS bx, CAST(floor(y / 20000) AS BIGINT) AS by FROM utm)
SELECT seq, bx, placed.by, CAST(CAST('0x' || md5('0:' || bx || ':' || placed.by)[1:15] AS BIGINT) % 5 AS INTEGER) AS fold FROM placed""", ("v_marks",))
def spatial_blocks(spark, d):
    x, y = F.col("x"), F.col("y")
    return _xy(spark, d).select("seq", F.floor(x / 20000).alias("bx"), F.floor(y / 20000).alias("by"), sampling.spatial_fold(x, y, 20000.0, 5).alias("fold"))


_E = repr(math.sqrt(geodesy.E2))
_BELOW = lambda lat: f"(sin(radians({lat})) / (1 - {geodesy.E2!r} * pow(sin(radians({lat})), 2)) + ln((1 + {_E} * sin(radians({lat}))) / (1 - {_E} * sin(radians({lat})))) / (2 * {_E}))"


@query("degree_areas", f""", size AS (SELECT floor(min(lon)) AS x0, ceil(max(lat)) AS y0 FROM v_marks),
cells AS (SELECT DISTINCT event, CAST(floor((y0 - lat) / 0.05) AS INTEGER) AS row, CAST(floor((lon - x0) / 0.05) AS INTEGER) AS col, y0 FROM v_marks CROSS JOIN size)
SELECT event, count(*) AS cells, round(sum(({_BELOW('y0 - row * 0.05')} - {_BELOW('y0 - row * 0.05 - 0.05')}) * {(geodesy.A * (1 - geodesy.FLAT)) ** 2 * math.radians(0.05) / 2!r}) / 100, 1) + 0.0 AS area_ha100 FROM cells GROUP BY event""", ("v_marks",))
def degree_areas(spark, d):
    """Areas of the cells with marks on a grid in degrees, by event, on the ellipsoid."""
    rows = view(spark, d, "v_marks")
    b = rows.agg(F.floor(F.min("lon")), F.ceil(F.max("lat"))).first()
    grid = GridSpec(float(b[0]), float(b[1]), 0.05, 400, 400, "EPSG:4326")
    cells = rows.select("event", grid.row(F.col("lat")).alias("row"), grid.col(F.col("lon")).alias("col")).distinct().withColumn("component", F.col("event"))
    return components.degree_areas(cells, grid, ("event",)).select("event", "cells", (F.round(F.col("area_m2") / 100, 1) + 0.0).alias("area_ha100"))


@query("fold_leaks", """, patches AS (SELECT CAST(seq % 7 AS INTEGER) AS fold, CAST(seq % 61 AS INTEGER) AS row, CAST(seq * 7 % 89 AS INTEGER) AS col FROM v_marks),
covered AS (SELECT DISTINCT fold, row + i AS row, col + j AS col FROM patches CROSS JOIN (SELECT unnest(range(-1, 2)) AS i) a CROSS JOIN (SELECT unnest(range(-1, 2)) AS j) b)
SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, count(*) AS folds FROM covered GROUP BY row, col HAVING count(*) > 1""", ("v_marks",))
def fold_leaks(spark, d):
    seq = F.col("seq")
    return sampling.leaks(view(spark, d, "v_marks").select((seq % 7).cast("int").alias("fold"), (seq % 61).cast("int").alias("row"), (seq * 7 % 89).cast("int").alias("col")), 1)


@query("evidence_tiers", "SELECT seq, CASE WHEN seq % 2 = 0 AND seq % 3 = 0 THEN 'A' WHEN seq % 2 = 0 THEN 'B' ELSE 'C' END AS tier FROM v_marks", ("v_marks",))
def evidence_tiers(spark, d):
    return view(spark, d, "v_marks").select("seq", sampling.tier(F.col("seq") % 2 == 0, F.col("seq") % 3 == 0).alias("tier"))


@query("sampled_stack", """, size AS (SELECT max(row) + 1 AS h FROM v_dem), points AS (SELECT seq, (seq * 373 % 30000) / 10.0 AS x, (seq * 211 % 30000) / 10.0 AS y FROM v_marks)
SELECT seq, d.row, d.col, CAST(d.elev AS FLOAT) AS elevation, CAST(s.sca AS FLOAT) AS sca FROM points CROSS JOIN size JOIN v_dem d ON d.row = floor((h * 30.0 - y) / 30) AND d.col = floor(x / 30) JOIN v_sca s ON s.row = d.row AND s.col = d.col""", ("v_marks", "v_dem", "v_sca"))
def sampled_stack(spark, d):
    rows = _dem(spark, d).agg(F.max("row")).first()[0] + 1
    points = view(spark, d, "v_marks").select("seq", ((F.col("seq") * 373 % 30000) / 10.0).alias("x"), ((F.col("seq") * 211 % 30000) / 10.0).alias("y"))
    stack = tiles.factor_stack(_layers(spark, d), ["elevation", "sca"])
    return sampling.sample_stack(points, stack, GridSpec(0.0, rows * CELL, CELL, 100, rows)).select("seq", "row", "col", "elevation", "sca")


@query("patch_sums", """SELECT 'lulc' AS layer, CAST(floor(row / 32.0) AS INTEGER) AS tile_row, CAST(floor(col / 32.0) AS INTEGER) AS tile_col, count(*) AS known, round(sum(CAST(lulc AS DOUBLE)), 3) AS total
FROM v_landcover WHERE version = 1 GROUP BY ALL""", ("v_landcover",))
def patch_sums(spark, d):
    cells = temporal.first_version(view(spark, d, "v_landcover")).select(F.lit("lulc").alias("layer"), "row", "col", F.col("lulc").cast("float").alias("value"))
    value = F.explode("data").alias("v")
    flat = sampling.patches(cells, 32).select("layer", "tile_row", "tile_col", value).where("v is not null")
    return flat.groupBy("layer", "tile_row", "tile_col").agg(F.count("*").alias("known"), F.round(F.sum(F.col("v").cast("double")), 3).alias("total"))
