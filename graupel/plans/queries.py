"""The registered queries of the raster, terrain and inventory operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graupel.functions import bands as B, geodesy, predicates as P
from graupel.model import GridSpec
from graupel.operators import components as C, hydro, ingest, inventory, regrid, sampling, stencil, temporal, tiles, vector
from graupel.plans import detect, layers, terrain
from graupel.plans.registry import QUERIES, SQL, query
from graupel.sources.fixtures import ACTIVITY, AREA, CELL, REFERENCE, view

R = B.rounded


def _six(df, *names):
    return df.select(*[R(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


# SQL pieces shared by several statements
SCENES_OK = """SELECT scene_id, acq_date, orbit FROM v_scenes WHERE w <= 78.1 AND e >= 76.4 AND s <= 33.2 AND n >= 31.9
  AND acq_date >= DATE '1995-01-01' AND acq_date < DATE '2002-01-01' AND mode = 'IW' AND list_contains(pols, 'VH')"""
BOTH_POLS = " AND list_contains(pols, 'VV')"
REF = "acq_date >= DATE '1995-01-01' AND acq_date < DATE '1998-01-01'"
ACT = "acq_date >= DATE '1998-01-01' AND acq_date < DATE '2002-01-01'"
LINEAR = ", ".join(f"10 * log10(avg(CASE WHEN {w} THEN pow(10, {b} / 10.0) END)) AS {b}_{n}" for b in ("vv", "vh") for n, w in (("ref", REF), ("act", ACT)))
MEDIAN = ", ".join(f"median(CASE WHEN {w} THEN {b} END) AS {b}_{n}" for b in ("vv", "vh") for n, w in (("ref", REF), ("act", ACT)))
COMPOSITES = f"""scenes_ok AS ({SCENES_OK}{BOTH_POLS}),
composites AS (SELECT orbit, row, col, {LINEAR}, avg(CASE WHEN {ACT} THEN angle END) AS angle
  FROM v_pixels JOIN scenes_ok USING (scene_id) GROUP BY orbit, row, col)"""
SLOPE4 = """slope4 AS (SELECT row, col, degrees(atan(sqrt(pow((e - w) / 60.0, 2) + pow((s - n) / 60.0, 2)))) AS slope FROM (
  SELECT row, col, first_value(elev) OVER (PARTITION BY row ORDER BY col RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS w,
    first_value(elev) OVER (PARTITION BY row ORDER BY col RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS e,
    first_value(elev) OVER (PARTITION BY col ORDER BY row RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS n,
    first_value(elev) OVER (PARTITION BY col ORDER BY row RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS s FROM v_dem) g)"""
CANDIDATES = f"""{COMPOSITES}, {SLOPE4},
candidates AS (SELECT orbit, row, col, vv_act - vv_ref AS dvv, vh_act - vh_ref AS dvh, angle, slope
  FROM composites JOIN slope4 USING (row, col)
  WHERE vv_act - vv_ref > 2 AND vh_act - vh_ref > 1 AND angle > 20 AND angle < 45 AND slope > 10 AND slope < 60)"""

def _radar(spark, d):
    return view(spark, d, "v_scenes"), view(spark, d, "v_pixels")


def _dem(spark, d):
    return view(spark, d, "v_dem")


@query("scene_filter", f", scenes_ok AS ({SCENES_OK}{BOTH_POLS}) SELECT scene_id, acq_date, orbit FROM scenes_ok", ("v_scenes",))
def scene_filter(spark, d):
    return view(spark, d, "v_scenes").where(P.radar_scene(AREA, (REFERENCE[0], ACTIVITY[1]))).select("scene_id", "acq_date", "orbit")


@query("optical_scenes", "SELECT scene_id, cloud_pct FROM v_scenes WHERE w <= 78.1 AND e >= 76.4 AND s <= 33.2 AND n >= 31.9 AND cloud_pct < 25", ("v_scenes",))
def optical_scenes(spark, d):
    return view(spark, d, "v_scenes").where(P.meets_bounds(AREA) & P.few_clouds()).select("scene_id", "cloud_pct")


_BANDS = ["vv_ref", "vv_act", "vh_ref", "vh_act", "angle"]
_ROUND = ", ".join(f"round({b}, 6) + 0.0 AS {b}" for b in _BANDS)


@query("composite_linear_mean", f", {COMPOSITES} SELECT orbit, row, col, {_ROUND} FROM composites", ("v_scenes", "v_pixels"))
def composite_linear_mean(spark, d):
    scenes, pixels = _radar(spark, d)
    series = temporal.scenes_with_pixels(scenes.where(P.radar_scene(AREA, (REFERENCE[0], ACTIVITY[1]))), pixels)
    return _six(temporal.composite_change(series, REFERENCE, ACTIVITY), *_BANDS)


@query("composite_median_db", f""", scenes_ok AS ({SCENES_OK} AND orbit = 'DESCENDING'),
composites AS (SELECT row, col, {MEDIAN}, avg(CASE WHEN {ACT} THEN angle END) AS angle FROM v_pixels JOIN scenes_ok USING (scene_id) GROUP BY row, col)
SELECT row, col, {_ROUND} FROM composites""", ("v_scenes", "v_pixels"))
def composite_median_db(spark, d):
    scenes, pixels = _radar(spark, d)
    series = temporal.scenes_with_pixels(scenes.where(P.radar_scene(AREA, (REFERENCE[0], ACTIVITY[1]), "DESCENDING", pols=("VH",))), pixels)
    return _six(temporal.composite_change(series, REFERENCE, ACTIVITY, median=True, keys=("row", "col")), *_BANDS)


@query("optical_median", """SELECT row, col, round(median(vv), 6) + 0.0 AS vv, round(median(vh), 6) + 0.0 AS vh
FROM v_pixels JOIN v_scenes USING (scene_id) WHERE cloud_pct < 25 GROUP BY row, col""", ("v_scenes", "v_pixels"))
def optical_median(spark, d):
    scenes, pixels = _radar(spark, d)
    return _six(temporal.optical_median(temporal.scenes_with_pixels(scenes.where(P.few_clouds()), pixels), ["vv", "vh"]), "vv", "vh")


def _candidates(spark, d):
    return detect.change_candidates(*_radar(spark, d), _dem(spark, d), AREA, REFERENCE, ACTIVITY, CELL)


@query("detect_change", f", {CANDIDATES} SELECT orbit, row, col, round(dvv, 6) + 0.0 AS dvv, round(dvh, 6) + 0.0 AS dvh, round(angle, 6) + 0.0 AS angle, round(slope, 6) + 0.0 AS slope FROM candidates", ("v_scenes", "v_pixels", "v_dem"))
def detect_change(spark, d):
    return _six(_candidates(spark, d), "dvv", "dvh", "angle", "slope")


def _disk_values(radius):
    return ", ".join(f"({i}, {j})" for i, j in stencil.disk(radius))


def _smooth_sql(radius):
    return f"""offsets(i, j) AS (VALUES {_disk_values(radius)}),
smooth AS (SELECT a.orbit, a.row, a.col, any_value(a.angle) AS angle, avg(b.vv_ref) AS vv_ref, avg(b.vv_act) AS vv_act, avg(b.vh_ref) AS vh_ref, avg(b.vh_act) AS vh_act
  FROM composites a CROSS JOIN offsets JOIN composites b ON b.orbit = a.orbit AND b.row = a.row + i AND b.col = a.col + j GROUP BY a.orbit, a.row, a.col)"""


@query("detect_change_smoothed", f""", {COMPOSITES}, {SLOPE4}, {_smooth_sql(1.0)}
SELECT orbit, row, col, round(vv_act - vv_ref, 6) + 0.0 AS dvv, round(vh_act - vh_ref, 6) + 0.0 AS dvh, round(angle, 6) + 0.0 AS angle, round(slope, 6) + 0.0 AS slope
FROM smooth JOIN slope4 USING (row, col)
WHERE vv_act - vv_ref > 2 AND vh_act - vh_ref > 1 AND angle > 20 AND angle < 45 AND slope > 10 AND slope < 60""", ("v_scenes", "v_pixels", "v_dem"))
def detect_change_smoothed(spark, d):
    found = detect.change_candidates(*_radar(spark, d), _dem(spark, d), AREA, REFERENCE, ACTIVITY, CELL, smooth_cells=1.0)
    return _six(found, "dvv", "dvh", "angle", "slope")


for _how, _sql in (("mean", "avg"), ("median", "median")):

    @query(f"focal_{_how}_disk", f""", offsets(i, j) AS (VALUES {_disk_values(2.0)})
SELECT a.row, a.col, round({_sql}(b.elev), 6) + 0.0 AS elev FROM v_dem a CROSS JOIN offsets JOIN v_dem b ON b.row = a.row + i AND b.col = a.col + j GROUP BY a.row, a.col""", ("v_dem",))
    def focal_disk(spark, d, how=_how):
        return _six(stencil.focal(_dem(spark, d), ["elev"], 2.0, how), "elev")


HOTSPOTS = f"""scenes_ok AS ({SCENES_OK} AND orbit = 'DESCENDING'),
composites AS (SELECT row, col, {MEDIAN} FROM v_pixels JOIN scenes_ok USING (scene_id) GROUP BY row, col),
diffs AS (SELECT row, col, vv_act - vv_ref AS dvv, vh_act - vh_ref AS dvh FROM composites WHERE vv_act - vv_ref IS NOT NULL AND vh_act - vh_ref IS NOT NULL),
offsets(i, j) AS (VALUES {_disk_values(50 / 30)}),
smooth AS (SELECT a.row, a.col, median(b.dvv) AS dvv, median(b.dvh) AS dvh FROM diffs a CROSS JOIN offsets JOIN diffs b ON b.row = a.row + i AND b.col = a.col + j GROUP BY a.row, a.col),
{SLOPE4},
hot AS (SELECT row, col, dvv, dvh, slope FROM smooth JOIN slope4 USING (row, col) WHERE dvh > 2 AND dvv > 1 AND slope >= 25 AND slope <= 55)"""


def _hot(spark, d):
    return detect.hotspots(*_radar(spark, d), _dem(spark, d), AREA, REFERENCE, ACTIVITY, CELL, "DESCENDING")


@query("hotspot_mask", f", {HOTSPOTS} SELECT row, col, round(dvv, 6) + 0.0 AS dvv, round(dvh, 6) + 0.0 AS dvh, round(slope, 6) + 0.0 AS slope FROM hot", ("v_scenes", "v_pixels", "v_dem"))
def hotspot_mask(spark, d):
    return _six(_hot(spark, d), "dvv", "dvh", "slope")


@query("release_terrain", f", {SLOPE4} SELECT row, col, round(slope, 6) + 0.0 AS slope FROM slope4 WHERE slope BETWEEN 30 AND 50", ("v_dem",))
def release_terrain(spark, d):
    return _six(stencil.slope_four(_dem(spark, d), "elev", CELL).where(P.release_slope()).select("row", "col", "slope"), "slope")


def _label_sql(cells: str, keys: str = "orbit, ") -> str:
    """Labels by reachability: the smallest cell id that each cell reaches."""
    on = " AND b.orbit = a.orbit" if keys else ""
    own = "a.orbit, " if keys else ""
    return f"""ids AS (SELECT {keys}row, col, row * CAST(2147483648 AS BIGINT) + col AS id FROM {cells}),
near AS (SELECT {own}a.id AS x, b.id AS y FROM ids a JOIN ids b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1{on}),
walk AS (SELECT {keys}id AS start, id FROM ids UNION SELECT {"w.orbit, " if keys else ""}w.start, n.y FROM walk w JOIN near n ON n.x = w.id{" AND n.orbit = w.orbit" if keys else ""}),
labels AS (SELECT {"i.orbit, " if keys else ""}i.row, i.col, min(w.start) AS component FROM ids i JOIN walk w ON w.id = i.id{" AND w.orbit = i.orbit" if keys else ""} GROUP BY {"i.orbit, " if keys else ""}i.row, i.col)"""


_THREE = ("v_scenes", "v_pixels", "v_dem")


@query("components", f", {CANDIDATES}, {_label_sql('candidates')} SELECT orbit, row, col, component FROM labels", _THREE)
def components(spark, d):
    return C.label_cells(_candidates(spark, d), ("orbit",))


@query("event_candidates", f""", {CANDIDATES}, {_label_sql('candidates')}
SELECT orbit, component, count(*) AS cells, CAST(count(*) * 900.0 AS DOUBLE) AS area_m2, min(row) AS row_min, max(row) AS row_max, min(col) AS col_min, max(col) AS col_max, '1998-2001' AS event
FROM labels GROUP BY orbit, component HAVING count(*) * 900.0 >= 1500""", _THREE)
def event_candidates(spark, d):
    return detect.event_candidates(_candidates(spark, d), CELL, "1998-2001")


@query("event_candidates_both_orbits", f""", {CANDIDATES},
twice AS (SELECT orbit, row, col FROM candidates JOIN (SELECT row, col FROM candidates GROUP BY row, col HAVING count(DISTINCT orbit) = 2) t USING (row, col)), {_label_sql('twice')}
SELECT orbit, component, count(*) AS cells, CAST(count(*) * 900.0 AS DOUBLE) AS area_m2, min(row) AS row_min, max(row) AS row_max, min(col) AS col_min, max(col) AS col_max, '1998-2001' AS event
FROM labels GROUP BY orbit, component HAVING count(*) * 900.0 >= 1500""", _THREE)
def event_candidates_both_orbits(spark, d):
    return detect.event_candidates(_candidates(spark, d), CELL, "1998-2001", both_orbits=True)


@query("hotspot_layer", f", {HOTSPOTS}, {_label_sql('hot', '')} SELECT row, col FROM labels JOIN (SELECT component FROM labels GROUP BY component HAVING least(count(*), 50) >= 3) k USING (component)", _THREE)
def hotspot_layer(spark, d):
    return detect.hotspot_layer(_hot(spark, d), least=3)


@query("component_boundary_edges", f""", {CANDIDATES}, {_label_sql('candidates')},
sides AS (SELECT orbit, component, col AS x0, row AS y0, col + 1 AS x1, row AS y1 FROM labels UNION ALL SELECT orbit, component, col, row + 1, col + 1, row + 1 FROM labels
  UNION ALL SELECT orbit, component, col, row, col, row + 1 FROM labels UNION ALL SELECT orbit, component, col + 1, row, col + 1, row + 1 FROM labels)
SELECT orbit, component, x0, y0, x1, y1 FROM sides GROUP BY ALL HAVING count(*) = 1""", _THREE)
def component_boundary_edges(spark, d):
    return C.boundary_edges(C.label_cells(_candidates(spark, d), ("orbit",)), ("orbit",))


@query("climate_season", "SELECT row, col, round(avg(tavg) * 0.1, 6) + 0.0 AS temp_winter, CAST(sum(prec) AS BIGINT) AS precip_winter FROM v_monthly WHERE month IN (1, 2, 3, 4, 5) GROUP BY row, col", ("v_monthly",))
def climate_season(spark, d):
    return _six(temporal.season_climate(view(spark, d, "v_monthly"), [1, 2, 3, 4, 5]), "temp_winter")


@query("landcover_first", "SELECT row, col, lulc FROM v_landcover WHERE version = (SELECT min(version) FROM v_landcover)", ("v_landcover",))
def landcover_first(spark, d):
    return temporal.first_version(view(spark, d, "v_landcover"))


@query("snow_duration", """, yearly AS (SELECT row, col, year(obs_date) AS y, sum(CASE WHEN ndsi BETWEEN 40 AND 100 THEN 1 WHEN ndsi IS NOT NULL THEN 0 END) AS days
  FROM v_daily_snow WHERE year(obs_date) BETWEEN 1995 AND 2001 AND month(obs_date) BETWEEN 1 AND 5 GROUP BY ALL)
SELECT row, col, round(avg(days), 6) + 0.0 AS scd FROM yearly GROUP BY row, col""", ("v_daily_snow",))
def snow_duration(spark, d):
    return _six(temporal.snow_duration(view(spark, d, "v_daily_snow"), list(range(1995, 2002))), "scd")


NEAR = """across AS (SELECT row, col, elev AS c,
    coalesce(first_value(elev) OVER (PARTITION BY row ORDER BY col RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), elev) AS w,
    coalesce(first_value(elev) OVER (PARTITION BY row ORDER BY col RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING), elev) AS e FROM v_dem),
near AS (SELECT row, col, c, w, e, """ + ", ".join(
    f"coalesce(first_value({k}) OVER (PARTITION BY col ORDER BY row RANGE BETWEEN 1 {to} AND 1 {to}), {k}) AS {a}{b}"
    for a, to in (("n", "PRECEDING"), ("s", "FOLLOWING")) for k, b in (("w", "w"), ("c", ""), ("e", "e"))) + """ FROM across),
horn AS (SELECT *, (ne + e * 2 + se - nw - w * 2 - sw) / 240.0 AS dx, (nw + n * 2 + ne - sw - s * 2 - se) / 240.0 AS dy FROM near),
facing AS (SELECT *, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope,
    CASE WHEN dx <> 0 OR dy <> 0 THEN CASE WHEN degrees(atan2(-dx, -dy)) < 0 THEN degrees(atan2(-dx, -dy)) + 360.0 ELSE degrees(atan2(-dx, -dy)) END END AS aspect FROM horn)"""


def _near(spark, d):
    return stencil.neighbours(_dem(spark, d), "elev")


def _facing(spark, d):
    return _near(spark, d).select("row", "col", stencil.slope_horn(CELL).alias("slope"), stencil.aspect_horn(CELL).alias("aspect"))


@query("slope", f", {NEAR} SELECT row, col, round(slope, 6) + 0.0 AS slope FROM facing", ("v_dem",))
def slope(spark, d):
    return _six(_facing(spark, d).select("row", "col", "slope"), "slope")


@query("aspect", f", {NEAR} SELECT row, col, round(aspect, 6) + 0.0 AS aspect FROM facing", ("v_dem",))
def aspect(spark, d):
    return _six(_facing(spark, d).select("row", "col", "aspect"), "aspect")


@query("east_north", f", {NEAR} SELECT row, col, round(sin(radians(aspect)), 6) + 0.0 AS eastness, round(cos(radians(aspect)), 6) + 0.0 AS northness FROM facing", ("v_dem",))
def east_north(spark, d):
    return _facing(spark, d).select("row", "col", R(B.eastness(F.col("aspect"))).alias("eastness"), R(B.northness(F.col("aspect"))).alias("northness"))


@query("curvatures", f""", {NEAR}, q AS (SELECT row, col, ((w + e) / 2 - c) / 900.0 AS d, ((n + s) / 2 - c) / 900.0 AS t, (ne + sw - nw - se) / 3600.0 AS f, (e - w) / 60.0 AS g, (n - s) / 60.0 AS h FROM near)
SELECT row, col, round(CASE WHEN g * g + h * h > 0 THEN (d * h * h + t * g * g - f * g * h) * 2 / (g * g + h * h) ELSE 0.0 END, 6) + 0.0 AS plan_curvature,
  round(CASE WHEN g * g + h * h > 0 THEN (d * g * g + t * h * h + f * g * h) * -2 / (g * g + h * h) ELSE 0.0 END, 6) + 0.0 AS profile_curvature FROM q""", ("v_dem",))
def curvatures(spark, d):
    plan, profile = stencil.curvatures(CELL)
    return _near(spark, d).select("row", "col", R(plan).alias("plan_curvature"), R(profile).alias("profile_curvature"))


@query("tri", f", {NEAR} SELECT row, col, round(sqrt({' + '.join(f'({k} - c) * ({k} - c)' for k in stencil.AROUND)}), 6) + 0.0 AS tri FROM near", ("v_dem",))
def tri(spark, d):
    return _near(spark, d).select("row", "col", R(stencil.ruggedness()).alias("tri"))


@query("tpi", """, line AS (SELECT row, col, elev, sum(elev) OVER w AS s, count(elev) OVER w AS n FROM v_dem WINDOW w AS (PARTITION BY row ORDER BY col RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING))
SELECT row, col, round(elev - sum(s) OVER w / sum(n) OVER w, 6) + 0.0 AS tpi FROM line WINDOW w AS (PARTITION BY col ORDER BY row RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)""", ("v_dem",))
def tpi(spark, d):
    return _six(stencil.topographic_position(_dem(spark, d), "elev"), "tpi")


def _box_sql(source: str, names: list[str]) -> str:
    def mean(k, part, order):
        return f"(coalesce(first_value({k}) OVER (PARTITION BY {part} ORDER BY {order} RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), {k}) + {k} + coalesce(first_value({k}) OVER (PARTITION BY {part} ORDER BY {order} RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING), {k})) / 3 AS {k}"

    return f"box1 AS (SELECT row, col, {', '.join(mean(k, 'row', 'col') for k in names)} FROM {source}), box AS (SELECT row, col, {', '.join(mean(k, 'col', 'row') for k in names)} FROM box1)"


@query("roughness", f", mq AS (SELECT row, col, elev AS m, elev * elev AS q FROM v_dem), {_box_sql('mq', ['m', 'q'])} SELECT row, col, round(sqrt(greatest(q - m * m, 0.0)), 4) + 0.0 AS roughness FROM box", ("v_dem",))
def roughness(spark, d):
    return stencil.roughness(_dem(spark, d), "elev").select("row", "col", R(F.col("roughness"), 4).alias("roughness"))


@query("vrm", f""", {NEAR}, xyz AS (SELECT row, col, coalesce(sin(radians(slope)) * sin(radians(aspect)), 0.0) AS x, coalesce(sin(radians(slope)) * cos(radians(aspect)), 0.0) AS y, cos(radians(slope)) AS z FROM facing),
{_box_sql('xyz', ['x', 'y', 'z'])} SELECT row, col, round(1.0 - sqrt(x * 9 * x * 9 + y * 9 * y * 9 + z * 9 * z * 9) / 9, 6) + 0.0 AS vrm FROM box""", ("v_dem",))
def vrm(spark, d):
    return _six(stencil.vector_ruggedness(_facing(spark, d)), "vrm")


_SCA = "CASE WHEN slope > 0 THEN round(ln(sca / tan(radians(slope))), 6) + 0.0 END"


@query("twi", f"SELECT row, col, {_SCA} AS twi FROM v_sca", ("v_sca",))
def twi(spark, d):
    return view(spark, d, "v_sca").select("row", "col", R(B.wetness(F.col("sca"), F.col("slope"))).alias("twi"))


@query("spi", "SELECT row, col, round(sca * tan(radians(greatest(slope, 0.001))), 6) + 0.0 AS spi FROM v_sca", ("v_sca",))
def spi(spark, d):
    return view(spark, d, "v_sca").select("row", "col", R(B.stream_power(F.col("sca"), F.col("slope"))).alias("spi"))


@query("streams", "SELECT row, col FROM v_sca WHERE sca > 100", ("v_sca",))
def streams(spark, d):
    return view(spark, d, "v_sca").where("sca > 100").select("row", "col")


def _line_grid(spark, d) -> GridSpec:
    """100 columns; as many rows as the elevation view."""
    rows = _dem(spark, d).agg(F.max("row")).first()[0] + 1
    return GridSpec(0.0, rows * CELL, CELL, 100, rows)


LINES = """size AS (SELECT max(row) + 1 AS height FROM v_dem),
segments AS (SELECT * FROM (SELECT CASE WHEN highway IS NOT NULL THEN 'road' ELSE 'stream' END AS layer, x / 30.0 AS x0, height - y / 30.0 AS y0,
    lead(x / 30.0) OVER w AS x1, lead(height - y / 30.0) OVER w AS y1, height
  FROM v_lines CROSS JOIN size WHERE geom_type IN ('LineString', 'MultiLineString') WINDOW w AS (PARTITION BY fid ORDER BY seq)) t WHERE x1 IS NOT NULL),
columns AS (SELECT *, unnest(range(CAST(greatest(floor(least(x0, x1)), 0) AS BIGINT), CAST(least(floor(greatest(x0, x1)), 99) AS BIGINT) + 1)) AS col FROM segments),
heights AS (SELECT layer, col, height,
    CASE WHEN x1 = x0 THEN y0 ELSE y0 + (greatest(col, least(x0, x1)) - x0) * (y1 - y0) / (x1 - x0) END AS ya,
    CASE WHEN x1 = x0 THEN y1 ELSE y0 + (least(col + 1, greatest(x0, x1)) - x0) * (y1 - y0) / (x1 - x0) END AS yb FROM columns),
burned AS (SELECT DISTINCT layer, CAST(unnest(range(CAST(greatest(floor(least(ya, yb)), 0) AS BIGINT), CAST(least(floor(greatest(ya, yb)), height - 1) AS BIGINT) + 1)) AS INTEGER) AS row, CAST(col AS INTEGER) AS col FROM heights)"""


def _burned(spark, d):
    lines = view(spark, d, "v_lines").where(P.line_feature()).withColumn("layer", vector.layer_of_tags())
    return vector.rasterize_lines(lines, _line_grid(spark, d))


@query("rasterize_lines", f", {LINES} SELECT layer, row, col FROM burned", ("v_dem", "v_lines"))
def rasterize_lines(spark, d):
    return _burned(spark, d)


@query("distance_to_lines", f""", {LINES}
SELECT b.layer, c.row, c.col, round(CAST(CAST(sqrt(min((c.row - b.row) * (c.row - b.row) + (c.col - b.col) * (c.col - b.col))) * 30 AS FLOAT) AS DOUBLE), 3) AS distance
FROM v_dem c CROSS JOIN burned b GROUP BY b.layer, c.row, c.col""", ("v_dem", "v_lines"))
def distance_to_lines(spark, d):
    out = vector.distance_transform(_burned(spark, d), _line_grid(spark, d), ["road", "stream"])
    return out.withColumn("distance", F.round(F.col("distance").cast("double"), 3))


_TARGET_PX = 45.0
TARGET = """size AS (SELECT max(row) + 1 AS height FROM v_dem), target AS (
  SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, (c + 0.5) * 45 / 30 AS u, (r + 0.5) * 45 / 30 AS v
  FROM (SELECT unnest(range(CAST(ceil(height * 30 / 45.0) AS BIGINT))) AS r FROM size) a CROSS JOIN (SELECT unnest(range(67)) AS c) b)"""


def _target(spark, d) -> tuple[GridSpec, GridSpec]:
    source = _line_grid(spark, d)
    return source, GridSpec(0.0, source.y0, _TARGET_PX, 67, -int(-(source.height * CELL) // _TARGET_PX))


@query("regrid_nearest", f""", {TARGET} SELECT t.row, t.col, s.lulc FROM target t JOIN v_landcover s ON s.version = 1 AND s.row = floor(t.v) AND s.col = floor(t.u)""", ("v_dem", "v_landcover"))
def regrid_nearest(spark, d):
    return regrid.regrid(temporal.first_version(view(spark, d, "v_landcover")), *_target(spark, d), "lulc", "nearest")


@query("regrid_bilinear", f""", {TARGET},
corner AS (SELECT t.row, t.col, floor(v - 0.5) + i AS r, floor(u - 0.5) + j AS c,
    (CASE WHEN i = 1 THEN v - 0.5 - floor(v - 0.5) ELSE 1 - (v - 0.5 - floor(v - 0.5)) END) * (CASE WHEN j = 1 THEN u - 0.5 - floor(u - 0.5) ELSE 1 - (u - 0.5 - floor(u - 0.5)) END) AS wt
  FROM target t CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j))
SELECT k.row, k.col, round(sum(wt * elev) / sum(wt), 9) + 0.0 AS elev FROM corner k JOIN v_dem s ON s.row = k.r AND s.col = k.c WHERE wt > 0 GROUP BY k.row, k.col""", ("v_dem",))
def regrid_bilinear(spark, d):
    return regrid.regrid(_dem(spark, d), *_target(spark, d), "elev", "bilinear").withColumn("elev", R(F.col("elev"), 9))


_EAST = "eta + " + " + ".join(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(geodesy.ALPHA, 1))
_NORTH = "xi + " + " + ".join(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(geodesy.ALPHA, 1))
_METRES = f"CAST({geodesy.SCALE * geodesy.RADIUS!r} AS DOUBLE)"
UTM = f"""a AS (SELECT seq, radians(lon - 75.0) AS lam, sin(radians(lat)) AS s FROM v_marks),
b AS (SELECT seq, lam, sinh(atanh(s) - {geodesy.E1!r} * atanh({geodesy.E1!r} * s)) AS t FROM a),
c AS (SELECT seq, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(t * t + 1)) AS eta FROM b),
utm AS (SELECT seq, {_METRES} * ({_EAST}) + 500000.0 AS x, {_METRES} * ({_NORTH}) AS y FROM c)"""


@query("utm_forward", f", {UTM} SELECT seq, round(x, 3) + 0.0 AS easting, round(y, 3) + 0.0 AS northing FROM utm", ("v_marks",))
def utm_forward(spark, d):
    east, north = geodesy.utm_forward(F.col("lon"), F.col("lat"))
    return view(spark, d, "v_marks").select("seq", R(east, 3).alias("easting"), R(north, 3).alias("northing"))


@query("inventory_dedup", """SELECT batch, seq, round_even(lon, 6) AS lon, round_even(lat, 6) AS lat, event, tier, zone FROM (
  SELECT *, row_number() OVER (PARTITION BY CAST(round_even(lon * 10000, 0) AS BIGINT), CAST(round_even(lat * 10000, 0) AS BIGINT) ORDER BY batch, seq) AS n FROM v_marks) t WHERE n = 1""", ("v_marks",))
def inventory_dedup(spark, d):
    kept = inventory.keep_first(view(spark, d, "v_marks"))
    return kept.select("batch", "seq", F.bround("lon", 6).alias("lon"), F.bround("lat", 6).alias("lat"), "event", "tier", "zone")


@query("inventory_summary", """SELECT 'total' AS kind, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM v_marks
UNION ALL SELECT 'event', event, count(*) FROM v_marks WHERE event IS NOT NULL GROUP BY event
UNION ALL SELECT 'tier', tier, count(*) FROM v_marks WHERE tier IS NOT NULL GROUP BY tier""", ("v_marks",))
def inventory_summary(spark, d):
    return inventory.summary(view(spark, d, "v_marks"))


@query("geojson_points", """SELECT seq, CAST(json_extract(feature, '$.geometry.coordinates[0]') AS DOUBLE) AS lon, CAST(json_extract(feature, '$.geometry.coordinates[1]') AS DOUBLE) AS lat
FROM v_geojson WHERE json_extract_string(feature, '$.geometry.type') = 'Point'""", ("v_geojson",))
def geojson_points(spark, d):
    return inventory.geojson_points(view(spark, d, "v_geojson"))


_DAY = "try_cast(replace(replace(name, 'snd_', ''), '.nc', '') AS INTEGER)"


@query("daily_grid_catalog", f"""SELECT name, CAST(try_strptime(replace(replace(name, 'snd_', ''), '.nc', ''), '%Y%m%d') AS DATE) AS obs_date
FROM v_files WHERE name LIKE '%.nc' AND ({_DAY} IS NULL OR {_DAY} BETWEEN 20240105 AND 20240120)""", ("v_files",))
def daily_grid_catalog(spark, d):
    return ingest.daily_grids(view(spark, d, "v_files"), 20240105, 20240120).select("name", "obs_date")


@query("ingest_pending", "SELECT name FROM v_files WHERE name LIKE '%.nc' AND (landed_size IS NULL OR landed_size <= 0)", ("v_files",))
def ingest_pending(spark, d):
    files = view(spark, d, "v_files")
    return ingest.pending(ingest.daily_grids(files).select("name"), files)


@query("ingest_tally", """SELECT CASE WHEN landed_size > 0 THEN 'skipped' WHEN name LIKE '%bad%' THEN 'failed' ELSE 'done' END AS status, count(*) AS n FROM v_files WHERE name LIKE '%.nc' GROUP BY 1""", ("v_files",))
def ingest_tally(spark, d):
    files = view(spark, d, "v_files")
    return ingest.tally(ingest.daily_grids(files), files, files.where(F.contains("name", F.lit("bad"))))


STACK = "SELECT row, col, CAST(elev AS FLOAT) AS elevation, CAST(lulc AS FLOAT) AS lulc, CAST(sca AS FLOAT) AS sca FROM v_dem JOIN v_landcover USING (row, col) JOIN v_sca USING (row, col) WHERE version = 1"


def _layers(spark, d):
    one = lambda df, layer, v: df.select(F.lit(layer).alias("layer"), "row", "col", F.col(v).cast("float").alias("value"))
    return one(_dem(spark, d), "elevation", "elev").unionByName(one(temporal.first_version(view(spark, d, "v_landcover")), "lulc", "lulc")).unionByName(one(view(spark, d, "v_sca"), "sca", "sca"))


@query("factor_stack", STACK, ("v_dem", "v_landcover", "v_sca"))
def factor_stack(spark, d):
    return tiles.factor_stack(_layers(spark, d), ["elevation", "lulc", "sca"])


@query("tiles_round_trip", """SELECT 'elevation' AS layer, row, col, CAST(elev AS FLOAT) AS value FROM v_dem UNION ALL SELECT 'lulc', row, col, CAST(lulc AS FLOAT) FROM v_landcover WHERE version = 1
UNION ALL SELECT 'sca', row, col, CAST(sca AS FLOAT) FROM v_sca""", ("v_dem", "v_landcover", "v_sca"))
def tiles_round_trip(spark, d):
    return tiles.from_tiles(tiles.to_tiles(_layers(spark, d), 64))


@query("factor_unstack", """SELECT 'elevation' AS layer, row, col, CAST(elev AS FLOAT) AS value FROM v_dem UNION ALL SELECT 'sca', row, col, CAST(sca AS FLOAT) FROM v_sca""", ("v_dem", "v_sca"))
def factor_unstack(spark, d):
    return tiles.unstack(tiles.factor_stack(_layers(spark, d), ["elevation", "lulc", "sca"]), ["elevation", "sca"])


@query("breach_dem")
def breach_dem(spark, d):
    return hydro.breach(_dem(spark, d)).select("row", "col", R(F.col("breached")).alias("breached"))


@query("dinf_sca")
def dinf_sca(spark, d):
    return _six(hydro.contributing_area(hydro.breach(_dem(spark, d)), CELL), "sca")


@query("compute_terrain")
def compute_terrain(spark, d):
    return _six(terrain.compute_terrain(_dem(spark, d), CELL), *terrain.FACTORS)


_PARTS = ("slope", "aspect", "east_north", "curvatures", "tri", "tpi", "roughness", "vrm")


@query("terrain_topography", "SELECT row, col, slope, aspect, eastness, northness, plan_curvature, profile_curvature, tri, tpi, roughness, vrm FROM " + " JOIN ".join(f"({SQL[n]}) {n}{' USING (row, col)' if k else ''}" for k, n in enumerate(_PARTS)))
def terrain_topography(spark, d):
    """The factors of ``compute_terrain`` that SQL can express, from the same job as all thirteen."""
    out = terrain.compute_terrain(_dem(spark, d), CELL)
    names = ["slope", "aspect", "eastness", "northness", "plan_curvature", "profile_curvature", "tri", "tpi", "vrm"]
    return _six(out.select("row", "col", *names, R(F.col("roughness"), 4).alias("roughness")), *names)


#: Doublings of the pointers in SQL: ways of up to 2^14 cells.
DOUBLINGS = 14
JUMPS = ", ".join(f"p{k + 1} AS (SELECT a.id, b.lower FROM p{k} a LEFT JOIN p{k} b ON b.id = a.lower)" for k in range(DOUBLINGS))


@query("height_above_stream", f""", cells AS (SELECT row, col, row * CAST(2147483648 AS BIGINT) + col AS id, elev AS z FROM v_dem),
steps(i, j) AS (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)),
drops AS (SELECT a.id, b.id AS lower, (a.z - b.z) / (30 * sqrt(i * i + j * j)) AS s FROM cells a CROSS JOIN steps JOIN cells b ON b.row = a.row + i AND b.col = a.col + j WHERE b.z < a.z),
wet AS (SELECT row * CAST(2147483648 AS BIGINT) + col AS id FROM v_sca WHERE sca > 450),
best AS (SELECT id, lower FROM (SELECT id, lower, row_number() OVER (PARTITION BY id ORDER BY s DESC, lower) AS n FROM drops) t WHERE n = 1),
p0 AS MATERIALIZED (SELECT c.id, CASE WHEN w.id IS NOT NULL THEN c.id ELSE best.lower END AS lower FROM cells c LEFT JOIN wet w ON w.id = c.id LEFT JOIN best ON best.id = c.id),
{JUMPS.replace(" AS (SELECT a.id", " AS MATERIALIZED (SELECT a.id")}
SELECT c.row, c.col, round(c.z - e.z, 6) + 0.0 AS height FROM cells c LEFT JOIN p{DOUBLINGS} p ON p.id = c.id LEFT JOIN cells e ON e.id = p.lower""", ("v_dem", "v_sca"))
def height_above_stream(spark, d):
    dem = _dem(spark, d)
    wet = view(spark, d, "v_sca").where("sca > 450").select("row", "col")
    return _six(hydro.height_above_stream(dem, "elev", wet, hydro.steepest_pointer(dem, "elev", CELL)), "height")


def _xy(spark, d):
    east, north = geodesy.utm_forward(F.col("lon"), F.col("lat"))
    return view(spark, d, "v_marks").select("seq", "event", east.alias("x"), north.alias("y"))


@query("declustered_points", f", {UTM} SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY floor(x / 20000), floor(y / 20000) ORDER BY seq) AS n FROM utm) t WHERE n = 1", ("v_marks",))
def declustered_points(spark, d):
    return sampling.decluster(_xy(spark, d), 20000.0).select("seq")


@query("morans_i", """, m AS (SELECT row, col, elev - (SELECT avg(elev) FROM v_dem) AS d FROM v_dem), steps(i, j) AS (VALUES (0, 1), (1, -1), (1, 0), (1, 1)),
x AS (SELECT count(*) AS pairs, sum(a.d * b.d) AS cross_sum FROM m a CROSS JOIN steps JOIN m b ON b.row = a.row + i AND b.col = a.col + j), s AS (SELECT count(*) AS n, sum(d * d) AS square FROM m)
SELECT n, pairs, round(n / pairs * cross_sum / square, 6) + 0.0 AS morans_i FROM s CROSS JOIN x""", ("v_dem",))
def morans_i(spark, d):
    return _six(sampling.morans_i(_dem(spark, d), "elev"), "morans_i")


@query("base_layers", """, c AS (SELECT row, col, avg(tavg) * 0.1 AS t, sum(prec) AS p FROM v_monthly WHERE month BETWEEN 1 AND 5 GROUP BY row, col),
y AS (SELECT row, col, year(obs_date) AS y, sum(CASE WHEN ndsi BETWEEN 40 AND 100 THEN 1 WHEN ndsi IS NOT NULL THEN 0 END) AS days FROM v_daily_snow WHERE year(obs_date) BETWEEN 1995 AND 2001 AND month(obs_date) BETWEEN 1 AND 5 GROUP BY ALL),
u AS (SELECT 'base_nasadem_elevation' AS layer, row, col, elev AS value FROM v_dem UNION ALL SELECT 'base_worldclim_temp_winter', row, col, t FROM c UNION ALL SELECT 'base_worldclim_precip_winter', row, col, p FROM c
  UNION ALL SELECT 'base_esa_worldcover', row, col, lulc FROM v_landcover WHERE version = 1 UNION ALL SELECT 'base_modis_scd', row, col, avg(days) FROM y GROUP BY row, col)
SELECT layer, row, col, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 3) + 0.0 AS value FROM u WHERE (col + 0.5) * 30 BETWEEN 300 AND 2400""", ("v_dem", "v_monthly", "v_landcover", "v_daily_snow"))
def base_layers(spark, d):
    grid = _line_grid(spark, d)
    out = layers.base_layers(_dem(spark, d), view(spark, d, "v_monthly"), view(spark, d, "v_landcover"), view(spark, d, "v_daily_snow"), grid, (300.0, 0.0, 2400.0, grid.y0), list(range(1995, 2002)))
    return out.withColumn("value", R(F.col("value").cast("double"), 3))


_AREA = (300.0, 0.0, 2400.0)


def _scaled_sql(layer: str, source: str, scale: float, nearest: bool = False) -> str:
    """A layer on the area's own grid of ``scale``."""
    x0, width = _AREA[0] // scale * scale, int(-(-(_AREA[2] - _AREA[0] // scale * scale) // scale))
    target = f"""SELECT r, c, (y0 - (ceil(y0 / {scale}) * {scale} - (r + 0.5) * {scale})) / 30 AS v, ({x0} + (c + 0.5) * {scale}) / 30 AS u,
      {x0} + (c + 0.5) * {scale} AS x, ceil(y0 / {scale}) * {scale} - (r + 0.5) * {scale} AS y, y0 FROM (SELECT height * 30.0 AS y0, unnest(range(CAST(ceil(ceil(height * 30.0 / {scale})) AS BIGINT))) AS r FROM size) a CROSS JOIN (SELECT unnest(range({width})) AS c) b"""
    clip = f"x BETWEEN {_AREA[0]} AND {_AREA[2]} AND y BETWEEN 0 AND y0"
    if nearest:
        return f"SELECT '{layer}' AS layer, r, c, s.value FROM ({target}) t JOIN {source} s ON s.row = floor(v) AND s.col = floor(u) WHERE {clip}"
    return f"""SELECT '{layer}' AS layer, r, c, sum(wt * s.value) / sum(wt) AS value FROM (SELECT *, floor(v - 0.5) + i AS sr, floor(u - 0.5) + j AS sc,
      (CASE WHEN i = 1 THEN v - 0.5 - floor(v - 0.5) ELSE 1 - (v - 0.5 - floor(v - 0.5)) END) * (CASE WHEN j = 1 THEN u - 0.5 - floor(u - 0.5) ELSE 1 - (u - 0.5 - floor(u - 0.5)) END) AS wt
      FROM ({target}) t CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j)) k JOIN {source} s ON s.row = sr AND s.col = sc WHERE wt > 0 AND s.value IS NOT NULL AND {clip} GROUP BY r, c"""


@query("base_layers_scaled", f""", size AS (SELECT max(row) + 1 AS height FROM v_dem), climate AS (SELECT row, col, avg(tavg) * 0.1 AS t, CAST(sum(prec) AS DOUBLE) AS p FROM v_monthly WHERE month BETWEEN 1 AND 5 GROUP BY row, col),
yearly AS (SELECT row, col, year(obs_date) AS y, sum(CASE WHEN ndsi BETWEEN 40 AND 100 THEN 1 WHEN ndsi IS NOT NULL THEN 0 END) AS days FROM v_daily_snow WHERE year(obs_date) BETWEEN 1995 AND 2001 AND month(obs_date) BETWEEN 1 AND 5 GROUP BY ALL),
s_t AS (SELECT row, col, t AS value FROM climate), s_p AS (SELECT row, col, p AS value FROM climate), s_l AS (SELECT row, col, CAST(lulc AS DOUBLE) AS value FROM v_landcover WHERE version = 1),
s_d AS (SELECT row, col, avg(days) AS value FROM yearly GROUP BY row, col),
u AS (SELECT 'base_nasadem_elevation' AS layer, row AS r, col AS c, elev AS value FROM v_dem WHERE (col + 0.5) * 30 BETWEEN {_AREA[0]} AND {_AREA[2]}
  UNION ALL {_scaled_sql("base_worldclim_temp_winter", "s_t", 1000.0)} UNION ALL {_scaled_sql("base_worldclim_precip_winter", "s_p", 1000.0)}
  UNION ALL {_scaled_sql("base_esa_worldcover", "s_l", 10.0, True)} UNION ALL {_scaled_sql("base_modis_scd", "s_d", 500.0)})
SELECT layer, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 2) + 0.0 AS value FROM u""", ("v_dem", "v_monthly", "v_landcover", "v_daily_snow"))
def base_layers_scaled(spark, d):
    """Every base layer at its own cell size."""
    grid = _line_grid(spark, d)
    out = layers.base_layers(_dem(spark, d), view(spark, d, "v_monthly"), view(spark, d, "v_landcover"), view(spark, d, "v_daily_snow"), grid, (*_AREA, grid.y0), list(range(1995, 2002)), layers.SCALES)
    return out.withColumn("value", R(F.col("value").cast("double"), 2))
