"""Adapter views: the shapes that the operators read, derived from the star-schema tables.

The SQL runs unchanged in Spark and DuckDB, so queries and their SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "v_dem": """
SELECT CAST(FLOOR(o_orderkey / 1e2) AS INT) AS row, CAST(o_orderkey % 100 AS INT) AS col,
       2000 + 10 * ABS(CAST(FLOOR(o_orderkey / 1e2) AS INT) % 60 - 30)
            + 6 * ABS(CAST(o_orderkey % 100 AS INT) % 40 - 20)
            + CAST(CAST(ROUND(o_totalprice * 100) AS BIGINT) % 2000 AS DOUBLE) / 200 AS elev
FROM orders
""",
    "v_scenes": """
SELECT DISTINCT CONCAT(orb, '_', CAST(CAST(l_shipdate AS DATE) AS STRING)) AS scene_id,
       CAST(l_shipdate AS DATE) AS acq_date, orb AS orbit,
       CASE WHEN DAY(l_shipdate) % 7 = 0 THEN 'EW' ELSE 'IW' END AS mode,
       SPLIT(CASE WHEN DAY(l_shipdate) % 5 = 0 THEN 'VV' ELSE 'VV,VH' END, ',') AS pols,
       CASE WHEN DAY(l_shipdate) % 11 = 0 THEN CAST(80 AS DOUBLE) ELSE CAST(76 AS DOUBLE) END AS w,
       CASE WHEN DAY(l_shipdate) % 11 = 0 THEN CAST(82 AS DOUBLE) ELSE CAST(78 AS DOUBLE) END AS e,
       CAST(31 AS DOUBLE) AS s, CAST(34 AS DOUBLE) AS n,
       CAST(DAY(l_shipdate) * 3 AS DOUBLE) AS cloud_pct
FROM lineitem CROSS JOIN (SELECT 'ASCENDING' AS orb UNION ALL SELECT 'DESCENDING' AS orb) o
""",
    "v_pixels": """
SELECT CONCAT(orb, '_', CAST(CAST(l_shipdate AS DATE) AS STRING)) AS scene_id, row, col,
       base + bump AS vv, base + bump - 6 - l_discount * 10 AS vh, 18.5e0 + l_tax * 390 AS angle
FROM (SELECT l_shipdate, l_discount, l_tax, orb,
             CAST(FLOOR(l_orderkey / 1e2) AS INT) AS row, CAST(l_orderkey % 100 AS INT) AS col,
             -18 + (l_quantity - 25) / 25 - CASE WHEN orb = 'ASCENDING' THEN 0 ELSE 1 END AS base,
             CASE WHEN YEAR(l_shipdate) >= 1998
                   AND (CAST(FLOOR(l_orderkey / 8e2) AS INT) + CAST(FLOOR((l_orderkey % 100) / 8e0) AS INT)) % 3 = 0
                  THEN 4 ELSE 0 END AS bump
      FROM lineitem CROSS JOIN (SELECT 'ASCENDING' AS orb UNION ALL SELECT 'DESCENDING' AS orb) o
      WHERE NOT (orb = 'DESCENDING' AND l_linenumber = 2)) t
""",
    "v_daily_snow": """
SELECT CAST(FLOOR(l_orderkey / 1e2) AS INT) AS row, CAST(l_orderkey % 100 AS INT) AS col,
       CAST(l_shipdate AS DATE) AS obs_date,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity * 5 AS INT) END AS ndsi
FROM lineitem
""",
    "v_monthly": """
SELECT CAST(MONTH(l_shipdate) AS INT) AS month, CAST(FLOOR(l_orderkey / 1e2) AS INT) AS row,
       CAST(l_orderkey % 100 AS INT) AS col, CAST(l_quantity * 10 - 250 AS INT) AS tavg,
       CAST(FLOOR(l_extendedprice) AS BIGINT) % 200 AS prec
FROM lineitem
""",
    "v_landcover": """
SELECT v AS version, CAST(FLOOR(o_orderkey / 1e2) AS INT) AS row, CAST(o_orderkey % 100 AS INT) AS col,
       CAST((CAST(FLOOR(o_totalprice) AS BIGINT) + v) % 11 * 10 AS INT) AS lulc
FROM orders CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2 AS v) x
""",
    "v_lines": """
SELECT s_suppkey AS fid, seq,
       CASE WHEN s_suppkey % 13 = 12 THEN 'Polygon' ELSE 'LineString' END AS geom_type,
       CASE WHEN s_nationkey % 2 = 0 THEN 'primary' END AS highway,
       CASE WHEN s_nationkey % 2 = 1 THEN 'stream' END AS waterway,
       CAST((s_suppkey * 997 + seq * (s_nationkey * 31 + 211)) % 2990 AS DOUBLE) + 7.3e0 AS x,
       FLOOR(s_suppkey / 1e1) * 450 + CAST((s_suppkey * 733 + seq * 157) % 440 AS DOUBLE) + 3.7e0 AS y
FROM supplier CROSS JOIN (SELECT 0 AS seq UNION ALL SELECT 1 AS seq UNION ALL SELECT 2 AS seq) q
""",
    "v_sca": """
SELECT CAST(FLOOR(o_orderkey / 1e2) AS INT) AS row, CAST(o_orderkey % 100 AS INT) AS col,
       30 + CAST(CAST(FLOOR(o_totalprice) AS BIGINT) % 500 AS DOUBLE) AS sca,
       CAST(CAST(FLOOR(o_totalprice) AS BIGINT) % 46 AS DOUBLE) AS slope
FROM orders
""",
    "v_marks": """
SELECT CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1 END AS batch, c_custkey AS seq,
       76.4e0 + (c_custkey % 20) * 0.0425e0 + c_acctbal / 1e9 AS lon,
       31.9e0 + (c_custkey % 15) * 0.0325e0 + c_acctbal / 1e9 AS lat,
       c_mktsegment AS event,
       CASE WHEN c_nationkey % 10 = 9 THEN NULL WHEN c_nationkey % 3 = 0 THEN 'A'
            WHEN c_nationkey % 3 = 1 THEN 'B' ELSE 'C' END AS tier, 'release' AS zone
FROM customer
""",
    "v_files": """
SELECT name, landed_size
FROM (SELECT CONCAT('snd_', REPLACE(CAST(CAST(ts AS DATE) AS STRING), '-', ''), '.nc') AS name,
             CASE WHEN MAX(DAY(ts)) % 3 = 0 THEN 0 WHEN MAX(DAY(ts)) % 3 = 1 THEN 4096 END AS landed_size
      FROM events GROUP BY CAST(ts AS DATE)
      UNION ALL SELECT 'snd_bad.nc', CAST(NULL AS INT) UNION ALL SELECT 'readme.txt', CAST(NULL AS INT)) f
""",
    "v_geojson": """
SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN '{"geometry":null}'
       ELSE CONCAT('{"geometry":{"type":"', CASE WHEN event_type = 'view' THEN 'LineString' ELSE 'Point' END,
                   '","coordinates":[', CAST(76 + user_id % 20 AS STRING), '.25,', CAST(31 + user_id % 3 AS STRING), '.5]}}') END AS feature
FROM events
""",
}

TABLES = ("orders", "lineitem", "supplier", "customer", "events")

#: Windows and area of the flagship query; cell size of the elevation view in metres.
REFERENCE = ("1995-01-01", "1998-01-01")
ACTIVITY = ("1998-01-01", "2002-01-01")
AREA = (76.4, 31.9, 78.1, 33.2)
CELL = 30.0


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One adapter view over the tables of ``sf_dir``."""
    sql = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in sql.replace("\n", " ")}
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **used)


def with_views(sql: str, *names: str) -> str:
    """SQL over adapter views as one statement, for an engine that has the tables only."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n" + sql
