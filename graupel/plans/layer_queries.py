"""Registered queries of grids, layers, vector features and drainage, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from graupel.functions import bands as B, geodesy, predicates as P
from graupel.model import GridSpec, clean, layer_grid
from graupel.operators import components as C, hydro, ingest, regrid, temporal, vector
from graupel.plans import layers
from graupel.plans.queries import CANDIDATES, COMPOSITES, LINES, TARGET, UTM, _candidates, _dem, _label_sql, _layers, _line_grid, _six, _target, _THREE
from graupel.plans.registry import query
from graupel.session import Scratch
from graupel.sources import series
from graupel.sources.fixtures import ACTIVITY, AREA, CELL, REFERENCE, view
from graupel.streaming import ingest as stream

R = B.rounded
BOX = (600.0, 450.0, 1500.0, 2000.0)


@query("nodata_to_null", "SELECT row, col, CASE WHEN (row + col) % 7 = 0 OR (row + col) % 11 = 0 THEN NULL ELSE round(elev, 6) + 0.0 END AS elev FROM v_dem", ("v_dem",))
def nodata_to_null(spark, d):
    at = F.col("row") + F.col("col")
    raw = F.when(at % 7 == 0, F.lit(-9999.0)).when(at % 11 == 0, F.lit(float("nan"))).otherwise(F.col("elev"))
    return _dem(spark, d).select("row", "col", R(clean(raw, -9999.0)).alias("elev"))


def _catalog(spark, d):
    """Grids of two layers, from the extent of the elevation view."""
    size = _dem(spark, d).agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    grid = lambda name, k: size.select(F.lit(name).alias("layer"), F.lit(0.0).alias("x0"), (F.col("h") * CELL).alias("y0"), F.lit(CELL * k).alias("px"), F.ceil(F.col("w") / k).cast("int").alias("width"), F.ceil(F.col("h") / k).cast("int").alias("height"), F.lit("EPSG:32643").alias("crs"))
    return grid("elevation", 1).union(grid("overview", 4))


@query("catalog_grid", """, size AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM v_dem)
SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, (c + 0.5) * 120.0 AS x, h * 30.0 - (r + 0.5) * 120.0 AS y
FROM (SELECT h, unnest(range(CAST(ceil(h / 4.0) AS BIGINT))) AS r FROM size) a CROSS JOIN (SELECT unnest(range(CAST(ceil(w / 4.0) AS BIGINT))) AS c FROM size) b""", ("v_dem",))
def catalog_grid(spark, d):
    grid = layer_grid(_catalog(spark, d), "overview")
    return grid.cells(spark).select("row", "col", grid.x(F.col("col")).alias("x"), grid.y(F.col("row")).alias("y"))


@query("lines_in_box", f"""SELECT fid, seq, highway, x, y FROM v_lines WHERE geom_type IN ('LineString', 'MultiLineString') AND fid IN (
  SELECT fid FROM v_lines GROUP BY fid HAVING min(x) <= {BOX[2]} AND max(x) >= {BOX[0]} AND min(y) <= {BOX[3]} AND max(y) >= {BOX[1]})""", ("v_lines",))
def lines_in_box(spark, d):
    return vector.vertices_in_box(view(spark, d, "v_lines").where(P.line_feature()), BOX).select("fid", "seq", "highway", "x", "y")


@query("features_by_box", f"""SELECT fid, count(*) AS vertices, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM v_lines GROUP BY fid
HAVING min(x) <= {BOX[2]} AND max(x) >= {BOX[0]} AND min(y) <= {BOX[3]} AND max(y) >= {BOX[1]}""", ("v_lines",))
def features_by_box(spark, d):
    path = Scratch(spark, "features").base
    vector.write_features(view(spark, d, "v_lines"), path)
    return vector.read_features(spark, path, BOX).select("fid", F.size("vertices").cast("long").alias("vertices"), "xmin", "ymin", "xmax", "ymax")


@query("stored_layers", """SELECT 'sca' AS layer, row, col, CAST(sca AS FLOAT) AS value FROM v_sca
UNION ALL SELECT 'lulc', row, col, CAST(lulc AS FLOAT) FROM v_landcover WHERE version = 1""", ("v_sca", "v_landcover"))
def stored_layers(spark, d):
    path = Scratch(spark, "layers").base
    cells = _layers(spark, d)
    ingest.write_layer(cells.where("layer <> 'sca'"), path)
    ingest.write_layer(cells.where("layer = 'sca'").withColumn("value", F.col("value") + 1), path)
    ingest.write_layer(cells.where("layer = 'sca'"), path)  # replaces its own layer only
    return ingest.read_layer(spark, path, "sca").unionByName(ingest.read_layer(spark, path, "lulc")).select("layer", "row", "col", "value")


_NEW, _OLD = ingest.parameters(scale=30.0, crs="EPSG:32643"), ingest.parameters(scale=10.0, crs="EPSG:32643")


@query("missing_layers", f"SELECT name AS layer, '{_NEW}' AS params FROM v_files WHERE landed_size IS NULL OR landed_size <= 0", ("v_files",))
def missing_layers(spark, d):
    """A layer made with other parameters counts as missing."""
    files = view(spark, d, "v_files")
    done = files.select(F.col("name").alias("layer"), F.when(F.col("landed_size") > 0, _NEW).otherwise(_OLD).alias("params"))
    return ingest.missing_layers(files.select(F.col("name").alias("layer"), F.lit(_NEW).alias("params")), done)


@query("resampling_of_layers", "SELECT name, CASE WHEN lower(name) LIKE '%worldcover%' THEN 'nearest' ELSE 'bilinear' END AS method FROM (SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'base_ESA_WorldCover_' || n_name ELSE 'base_' || n_name END AS name FROM nation) t")
def resampling_of_layers(spark, d):
    name = F.concat(F.when(F.col("n_nationkey") % 3 == 0, "base_ESA_WorldCover_").otherwise("base_"), "n_name")
    return spark.read.parquet(f"{d}/nation.parquet").select(name.alias("name")).select("name", regrid.resampling_for(F.col("name")).alias("method"))


@query("regrid_layers", f""", {TARGET},
corner AS (SELECT t.row, t.col, floor(v - 0.5) + i AS r, floor(u - 0.5) + j AS c,
    (CASE WHEN i = 1 THEN v - 0.5 - floor(v - 0.5) ELSE 1 - (v - 0.5 - floor(v - 0.5)) END) * (CASE WHEN j = 1 THEN u - 0.5 - floor(u - 0.5) ELSE 1 - (u - 0.5 - floor(u - 0.5)) END) AS wt
  FROM target t CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j))
SELECT 'base_elevation' AS layer, k.row, k.col, round(CAST(CAST(sum(wt * elev) / sum(wt) AS FLOAT) AS DOUBLE), 2) + 0.0 AS value FROM corner k JOIN v_dem s ON s.row = k.r AND s.col = k.c WHERE wt > 0 GROUP BY k.row, k.col
UNION ALL SELECT 'base_worldcover', t.row, t.col, CAST(s.lulc AS DOUBLE) FROM target t JOIN v_landcover s ON s.version = 1 AND s.row = floor(t.v) AND s.col = floor(t.u)""", ("v_dem", "v_landcover"))
def regrid_layers(spark, d):
    one = lambda df, layer, v: df.select(F.lit(layer).alias("layer"), "row", "col", F.col(v).cast("double").alias("value"))
    cells = one(_dem(spark, d), "base_elevation", "elev").unionByName(one(temporal.first_version(view(spark, d, "v_landcover")), "base_worldcover", "lulc"))
    out = layers.regrid_layers(cells, *_target(spark, d), ["base_elevation", "base_worldcover"])
    return out.withColumn("value", R(F.col("value").cast("double"), 2))


@query("distance_layers", f""", {LINES}
SELECT b.layer, c.row, c.col, round(CAST(CAST(sqrt(min((c.row - b.row) * (c.row - b.row) + (c.col - b.col) * (c.col - b.col))) * 30 AS FLOAT) AS DOUBLE), 3) AS distance
FROM v_dem c CROSS JOIN burned b GROUP BY b.layer, c.row, c.col UNION ALL SELECT 'fault', row, col, NULL FROM v_dem""", ("v_dem", "v_lines"))
def distance_layers(spark, d):
    lines = view(spark, d, "v_lines").withColumn("layer", vector.layer_of_tags())
    out = layers.compute_distances(lines, _line_grid(spark, d), ["road", "stream", "fault"])
    return out.withColumn("distance", F.round(F.col("distance").cast("double"), 3))


def _mark_grid(spark, d) -> GridSpec:
    """Twentieths of a degree over the extent of the marks."""
    b = view(spark, d, "v_marks").agg(F.floor(F.min("lon")), F.floor(F.min("lat")), F.ceil(F.max("lon")), F.ceil(F.max("lat"))).first()
    return GridSpec(float(b[0]), float(b[3]), 0.05, int(b[2] - b[0]) * 20, int(b[3] - b[1]) * 20, "EPSG:4326")


_RES = 1000.0
MARK_GRID = f"""size AS (SELECT CAST(floor(min(lon)) AS DOUBLE) AS x0, CAST(ceil(max(lat)) AS DOUBLE) AS y0, CAST(ceil(max(lon)) - floor(min(lon)) AS BIGINT) * 20 AS w, CAST(ceil(max(lat)) - floor(min(lat)) AS BIGINT) * 20 AS h FROM v_marks),
corners AS (SELECT x0 + c * 0.05 AS lon, y0 - r * 0.05 AS lat FROM (SELECT *, unnest(range(h + 1)) AS r FROM size) a CROSS JOIN (SELECT unnest(range(w + 1)) AS c FROM size) b WHERE r <= 1 OR r >= h - 1 OR c <= 1 OR c >= w - 1),
{UTM.replace("SELECT seq, radians(lon - 75.0) AS lam, sin(radians(lat)) AS s FROM v_marks", "SELECT 0 AS seq, radians(lon - 75.0) AS lam, sin(radians(lat)) AS s FROM corners")},
bounds AS (SELECT min(x) AS xa, max(x) AS xb, min(y) AS ya, max(y) AS yb FROM utm),
grid AS (SELECT floor(xa / {_RES}) * {_RES} AS x0, ceil(yb / {_RES}) * {_RES} AS y0, CAST(ceil((xb - floor(xa / {_RES}) * {_RES}) / {_RES}) AS INTEGER) AS width, CAST(ceil((ceil(yb / {_RES}) * {_RES} - ya) / {_RES}) AS INTEGER) AS height FROM bounds)"""


@query("derived_grid", f", {MARK_GRID} SELECT x0, y0, width, height FROM grid", ("v_marks",))
def derived_grid(spark, d):
    grid = regrid.derive_grid(_mark_grid(spark, d), spark, geodesy.utm_forward, _RES, "EPSG:32643")
    return spark.createDataFrame([(grid.x0, grid.y0, grid.width, grid.height)], "x0 double, y0 double, width int, height int")


_XI = "xi - (" + " + ".join(f"{b!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in enumerate(geodesy.BETA, 1)) + ")"
_ETA = "eta - (" + " + ".join(f"{b!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in enumerate(geodesy.BETA, 1)) + ")"
_LAT = "chi + " + " + ".join(f"{v!r} * sin({2 * j} * chi)" for j, v in enumerate(geodesy.DELTA, 1))
_METRE = repr(geodesy.SCALE * geodesy.RADIUS)


@query("grid_extent", f""", {MARK_GRID},
edge AS (SELECT x0 + (c + 0.5) * {_RES} AS x, y0 - (r + 0.5) * {_RES} AS y FROM (SELECT *, unnest(range(height)) AS r FROM grid) a CROSS JOIN (SELECT unnest(range(width)) AS c FROM grid) b WHERE r = 0 OR r = height - 1 OR c = 0 OR c = width - 1),
k AS (SELECT y / {_METRE} AS xi, (x - 500000.0) / {_METRE} AS eta FROM edge), k1 AS (SELECT {_XI} AS xi, {_ETA} AS eta FROM k),
k2 AS (SELECT degrees(atan2(sinh(eta), cos(xi))) + 75 AS lon, asin(sin(xi) / cosh(eta)) AS chi FROM k1), k3 AS (SELECT lon, degrees({_LAT}) AS lat FROM k2)
SELECT round(min(lon), 6) AS west, round(min(lat), 6) AS south, round(max(lon), 6) AS east, round(max(lat), 6) AS north FROM k3""", ("v_marks",))
def grid_extent(spark, d):
    grid = regrid.derive_grid(_mark_grid(spark, d), spark, geodesy.utm_forward, _RES, "EPSG:32643")
    bounds = regrid.grid_bounds(grid, spark, geodesy.utm_inverse)
    return spark.createDataFrame([bounds], "west double, south double, east double, north double").select(*[F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")])


@query("streamed_cells", "SELECT version, row, col, lulc FROM v_landcover WHERE lulc <> 50", ("v_landcover",))
def streamed_cells(spark, d):
    base = Scratch(spark, "stream").base
    cells = view(spark, d, "v_landcover").select("version", "row", "col", "lulc")
    run = lambda: stream.ingest_counted(spark, f"{base}/source", "version int, row int, col int, lulc int", f"{base}/landed", f"{base}/log", F.col("lulc") != 50)
    for version in (1, 2):  # the second run lands what is new, a third nothing
        cells.where(F.col("version") == version).write.mode("append").parquet(f"{base}/source")
        run()
    run()
    return spark.read.schema("version int, row int, col int, lulc int").parquet(f"{base}/landed")


@query("streamed_tally", """SELECT * FROM (SELECT CAST(version AS INTEGER) AS run, count(*) FILTER (lulc <> 50) AS landed, count(*) FILTER (lulc = 50) AS failed FROM v_landcover GROUP BY version UNION ALL SELECT 3, 0, 0) t""", ("v_landcover",))
def streamed_tally(spark, d):
    """Counts of three runs over the same folder; the third finds nothing new."""
    base, counts = Scratch(spark, "stream").base, []
    cells = view(spark, d, "v_landcover").select("version", "row", "col", "lulc")
    for version in (1, 2, 3):
        if version < 3:
            cells.where(F.col("version") == version).write.mode("append").parquet(f"{base}/source")
        n = stream.ingest_counted(spark, f"{base}/source", "version int, row int, col int, lulc int", f"{base}/landed", f"{base}/log", F.col("lulc") != 50)
        counts.append((version, n["landed"], n["failed"]))
    return spark.createDataFrame(counts, "run int, landed long, failed long")


@query("stored_series", f""", {COMPOSITES} SELECT orbit, row, col, round(vv_ref, 6) + 0.0 AS vv_ref, round(vh_act, 6) + 0.0 AS vh_act, round(angle, 6) + 0.0 AS angle FROM composites""", ("v_scenes", "v_pixels"))
def stored_series(spark, d):
    """The composites from pixels stored by orbit and date; the scene filter prunes folders."""
    path = Scratch(spark, "series").base
    scenes, pixels = view(spark, d, "v_scenes"), view(spark, d, "v_pixels")
    series.write_series(scenes, pixels, path, 1)
    chosen = scenes.where(P.radar_scene(AREA, (REFERENCE[0], ACTIVITY[1])))
    both = temporal.composite_change(series.read_series(spark, path, chosen), REFERENCE, ACTIVITY)
    return _six(both.select("orbit", "row", "col", "vv_ref", "vh_act", "angle"), "vv_ref", "vh_act", "angle")


@query("stored_snow_duration", """, y AS (SELECT row, col, year(obs_date) AS y, sum(CASE WHEN ndsi BETWEEN 40 AND 100 THEN 1 WHEN ndsi IS NOT NULL THEN 0 END) AS days FROM v_daily_snow WHERE year(obs_date) BETWEEN 1995 AND 1998 AND month(obs_date) BETWEEN 1 AND 5 GROUP BY ALL)
SELECT row, col, round(avg(days), 6) + 0.0 AS scd FROM y GROUP BY row, col""", ("v_daily_snow",))
def stored_snow_duration(spark, d):
    path, years = Scratch(spark, "snow").base, [1995, 1996, 1997, 1998]
    series.write_daily(view(spark, d, "v_daily_snow"), path, 1)
    return _six(temporal.snow_duration(series.read_daily(spark, path, years, 1, 5), years), "scd")


_FACET = " UNION ALL ".join(
    f"SELECT row, col, {k} AS k, (c - {hydro._NAMES[a]}) / 30.0 AS s1, ({hydro._NAMES[a]} - {hydro._NAMES[b]}) / 30.0 AS s2, (c - {hydro._NAMES[b]}) / (30.0 * sqrt(2.0)) AS s3, row + {a[0]} AS ra, col + {a[1]} AS ca, row + {b[0]} AS rb, col + {b[1]} AS cb FROM frame WHERE {hydro._NAMES[a]} IS NOT NULL AND {hydro._NAMES[b]} IS NOT NULL"
    for k, (a, b) in enumerate(hydro.FACETS))


@query("d_infinity_receivers", f""", frame AS (SELECT a.row, a.col, any_value(a.elev) AS c, {", ".join(f"max(CASE WHEN b.row = a.row + {i} AND b.col = a.col + {j} THEN b.elev END) AS {n}" for (i, j), n in hydro._NAMES.items())}
  FROM v_dem a JOIN v_dem b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY a.row, a.col),
facets AS ({_FACET}),
turned AS (SELECT *, greatest(0.0, least(atan2(s2, s1), {math.pi / 4!r})) / {math.pi / 4!r} AS share, CASE WHEN atan2(s2, s1) < 0 THEN s1 WHEN atan2(s2, s1) > {math.pi / 4!r} THEN s3 ELSE sqrt(s1 * s1 + s2 * s2) END AS steep FROM facets),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY steep DESC, k) AS n FROM turned) t WHERE n = 1 AND steep > 0)
SELECT row, col, CAST(ra AS INTEGER) AS to_row, CAST(ca AS INTEGER) AS to_col, round(1 - share, 6) + 0.0 AS share FROM best WHERE share < 1
UNION ALL SELECT row, col, CAST(rb AS INTEGER), CAST(cb AS INTEGER), round(share, 6) + 0.0 FROM best WHERE share > 0""", ("v_dem",))
def d_infinity_receivers(spark, d):
    return _six(hydro.d_infinity_receivers(_dem(spark, d).withColumnRenamed("elev", "breached"), CELL), "share")


_STEPS8 = "steps(i, j) AS (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))"


@query("spill_levels", f""", {_STEPS8},
joined AS MATERIALIZED (SELECT a.row, a.col, b.row AS nrow, b.col AS ncol, b.elev AS nz FROM v_dem a CROSS JOIN steps JOIN v_dem b ON b.row = a.row + i AND b.col = a.col + j),
rim AS (SELECT d.row, d.col, d.elev FROM v_dem d LEFT JOIN (SELECT row, col, count(*) AS n FROM joined GROUP BY row, col) k USING (row, col) WHERE coalesce(n, 0) < 8),
flood(row, col, spill) USING KEY (row, col) AS (SELECT row, col, elev FROM rim
  UNION SELECT j.nrow, j.ncol, min(greatest(f.spill, j.nz)) FROM flood f JOIN joined j ON j.row = f.row AND j.col = f.col LEFT JOIN recurring.flood o ON o.row = j.nrow AND o.col = j.ncol
  WHERE o.spill IS NULL OR greatest(f.spill, j.nz) < o.spill GROUP BY j.nrow, j.ncol)
SELECT row, col, round(spill, 6) + 0.0 AS spill FROM flood""", ("v_dem",))
def spill_levels(spark, d):
    return _six(hydro.spill_levels(hydro.drainage_tree(_dem(spark, d))), "spill")


_RECEIVERS = f"""frame AS (SELECT a.row, a.col, any_value(a.elev) AS c, {", ".join(f"max(CASE WHEN b.row = a.row + {i} AND b.col = a.col + {j} THEN b.elev END) AS {n}" for (i, j), n in hydro._NAMES.items())}
  FROM v_dem a JOIN v_dem b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY a.row, a.col),
facets AS ({_FACET}),
turned AS (SELECT *, greatest(0.0, least(atan2(s2, s1), {math.pi / 4!r})) / {math.pi / 4!r} AS share, CASE WHEN atan2(s2, s1) < 0 THEN s1 WHEN atan2(s2, s1) > {math.pi / 4!r} THEN s3 ELSE sqrt(s1 * s1 + s2 * s2) END AS steep FROM facets),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY steep DESC, k) AS n FROM turned) t WHERE n = 1 AND steep > 0),
gives AS MATERIALIZED (SELECT row, col, ra AS to_row, ca AS to_col, 1 - share AS share FROM best WHERE share < 1 UNION ALL SELECT row, col, rb, cb, share FROM best WHERE share > 0)"""


@query("raw_flow_area", f""", {_RECEIVERS},
poured(step, row, col, area) AS (SELECT 0, row, col, CAST(900 AS DOUBLE) FROM v_dem
  UNION ALL SELECT p.step + 1, g.to_row, g.to_col, sum(p.area * g.share) FROM poured p JOIN gives g ON g.row = p.row AND g.col = p.col GROUP BY 1, 2, 3)
SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, round(sum(area) / 30, 4) + 0.0 AS sca FROM poured GROUP BY row, col""", ("v_dem",))
def raw_flow_area(spark, d):
    """Contributing area of the elevations as they are: water ends in pits."""
    raw = _dem(spark, d).withColumnRenamed("elev", "breached")
    return hydro.contributing_area(raw, CELL).select("row", "col", (F.round("sca", 4) + 0.0).alias("sca"))


RINGS = f""", {CANDIDATES}, {_label_sql('candidates')},
sides AS (SELECT l.orbit, l.component, k, col + x0 AS x, row + y0 AS y, col + x0 + dx AS x1, row + y0 + dy AS y1, row + i AS r, col + j AS c
  FROM labels l CROSS JOIN (VALUES (0, 0, 0, 1, 0, -1, 0), (1, 1, 0, 0, 1, 0, 1), (2, 1, 1, -1, 0, 1, 0), (3, 0, 1, 0, -1, 0, -1)) t(k, x0, y0, dx, dy, i, j)),
edges AS MATERIALIZED (SELECT s.orbit, s.component, k, x, y, x1, y1, CAST(y AS BIGINT) * 4294967296 + x * 4 + k AS code FROM sides s LEFT JOIN labels l ON l.orbit = s.orbit AND l.component = s.component AND l.row = s.r AND l.col = s.c WHERE l.row IS NULL),
after AS MATERIALIZED (SELECT orbit, code, next FROM (SELECT a.orbit, a.code, b.code AS next, row_number() OVER (PARTITION BY a.orbit, a.code ORDER BY (9 - (b.k - a.k)) % 4) AS n
  FROM edges a JOIN edges b ON b.orbit = a.orbit AND b.component = a.component AND b.x = a.x1 AND b.y = a.y1) t WHERE n = 1),
around AS (SELECT orbit, code AS start, code FROM edges UNION SELECT w.orbit, w.start, a.next FROM around w JOIN after a ON a.orbit = w.orbit AND a.code = w.code),
heads AS (SELECT orbit, code, min(start) AS ring FROM around GROUP BY orbit, code),
steps AS (SELECT orbit, ring, code, CAST(0 AS INTEGER) AS seq FROM heads WHERE code = ring UNION ALL SELECT s.orbit, s.ring, a.next, s.seq + 1 FROM steps s JOIN after a ON a.orbit = s.orbit AND a.code = s.code WHERE a.next <> s.ring),
rings AS (SELECT e.orbit, e.component, s.ring, s.seq, CAST(e.x AS INTEGER) AS x, CAST(e.y AS INTEGER) AS y FROM steps s JOIN edges e ON e.orbit = s.orbit AND e.code = s.code)"""


def _rings(spark, d):
    return C.outline_rings(C.label_cells(_candidates(spark, d), ("orbit",)), ("orbit",))


@query("outline_rings", f"{RINGS} SELECT orbit, component, ring, seq, x, y FROM rings", _THREE)
def outline_rings(spark, d):
    return _rings(spark, d)


@query("outline_features", f"""{RINGS}, sides_of AS (SELECT orbit, component, ring, seq, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1 FROM rings WINDOW w AS (PARTITION BY orbit, ring ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
turned AS (SELECT orbit, component, ring, count(*) + 1 AS points, sum(x * y1 - x1 * y) AS twice FROM sides_of GROUP BY ALL),
inner_at AS (SELECT t.orbit, t.component, t.ring, r.x - 0.5 AS px, r.y + 0.5 AS py FROM turned t JOIN rings r ON r.orbit = t.orbit AND r.ring = t.ring AND r.seq = 0 WHERE twice < 0),
around_it AS (SELECT h.orbit, h.component, h.ring, o.ring AS outer_ring, o.twice FROM inner_at h JOIN turned o ON o.orbit = h.orbit AND o.component = h.component AND o.twice > 0
  JOIN sides_of s ON s.orbit = o.orbit AND s.ring = o.ring AND s.x = s.x1 AND s.x < h.px AND h.py BETWEEN least(s.y, s.y1) AND greatest(s.y, s.y1) GROUP BY ALL HAVING count(*) % 2 = 1),
of_part AS (SELECT orbit, component, ring, outer_ring FROM (SELECT *, row_number() OVER (PARTITION BY orbit, ring ORDER BY twice) AS n FROM around_it) t WHERE n = 1 UNION ALL SELECT orbit, component, ring, ring FROM turned WHERE twice > 0),
parts AS (SELECT p.orbit, p.component, outer_ring, count(*) AS rings, sum(points) AS points FROM of_part p JOIN turned t ON t.orbit = p.orbit AND t.ring = p.ring GROUP BY ALL)
SELECT orbit, component, CASE WHEN count(*) OVER (PARTITION BY orbit, component) = 1 THEN 'Polygon' ELSE 'MultiPolygon' END AS kind, row_number() OVER (PARTITION BY orbit, component ORDER BY outer_ring) - 1 AS part, rings, CAST(points AS BIGINT) AS points FROM parts""", _THREE)
def outline_features(spark, d):
    """Kind, and of each part the number of its rings and points."""
    labels = Scratch(spark, "labels").save(C.label_cells(_candidates(spark, d), ("orbit",)))
    features = C.outline_features(C.outline_rings(labels, ("orbit",), turns=True), labels, _line_grid(spark, d), ("orbit",))
    kind = F.get_json_object("value", "$.geometry.type")
    made = F.get_json_object("value", "$.geometry.coordinates")
    shape = "array<array<array<array<double>>>>"
    parts = F.from_json(F.when(kind == "Polygon", F.concat(F.lit("["), made, F.lit("]"))).otherwise(made), shape)
    each = features.select(F.get_json_object("value", "$.properties.orbit").alias("orbit"), F.get_json_object("value", "$.properties.component").cast("long").alias("component"), kind.alias("kind"), F.posexplode(parts).alias("part", "lines"))
    return each.select("orbit", "component", "kind", F.col("part").cast("long").alias("part"), F.size("lines").cast("long").alias("rings"), F.size(F.flatten("lines")).cast("long").alias("points"))
