"""Point layers derived from the driver's tables, and their SQL.

*Contention*: every customer is a record on a grid, every order a captured point jittered around its
customer; orders compete for customers.

*Planted*: customers stand in rows of four, five metres apart; orders, ten to a captured point, stand four
metres beside the record they belong to, so the nearest record is mostly the wrong one, and the best
assignment of a whole row is known. Every fifth row's fourth record stands elsewhere; its captured point is
appended. In every 17th row the captured points have no place; every 11th row was merged by an earlier run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiepoint.config import LayerConfig
from tiepoint.sources.artifacts import LEDGER
from tiepoint.sources.storage import table

THRESHOLD_M = 10.67
CONFIG = LayerConfig("planted", THRESHOLD_M, field_map={"Status": "Condition"}, copy_attachments=True)


def contention(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Captured and authoritative layers, flat, with types."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    grid = lambda key: (
        F.lit(-122.0) + (F.col(key) % 500) * F.lit(0.001),
        F.lit(40.0) + F.floor(F.col(key) / 500) * F.lit(0.001),
    )
    lon, lat = grid("c_custkey")
    kind = F.when(F.col("c_custkey") % 13 != 0, F.col("c_mktsegment"))
    auth = customer.select(F.col("c_custkey").cast("bigint").alias("OBJECTID"), F.format_string("{a%d}", "c_custkey").alias("GlobalID"), lon.alias("lon"), lat.alias("lat"), kind.alias("type"))
    lon, lat = grid("o_custkey")
    cap = orders.select(
        F.col("o_orderkey").cast("bigint").alias("OBJECTID"), F.format_string("{c%d}", "o_orderkey").alias("GlobalID"), "o_custkey",
        (lon + (F.col("o_orderkey") % 7) * F.lit(0.00002)).alias("lon"), (lat + (F.col("o_orderkey") % 11) * F.lit(0.00002)).alias("lat"),
    )
    kinds = customer.select(F.col("c_custkey").alias("o_custkey"), kind.alias("own"))
    typed = cap.join(kinds, "o_custkey", "left").withColumn("type", F.when(F.col("OBJECTID") % 17 != 0, F.col("own")))
    return typed.drop("own", "o_custkey"), auth


CONTENTION_SQL = """
auth AS (
  SELECT CAST(c_custkey AS BIGINT) AS oid, CAST(-122.0 AS DOUBLE) + (c_custkey % 500) * CAST(0.001 AS DOUBLE) AS lon,
         CAST(40.0 AS DOUBLE) + (c_custkey // 500) * CAST(0.001 AS DOUBLE) AS lat,
         CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment END AS type
  FROM customer
), cap AS (
  SELECT CAST(o_orderkey AS BIGINT) AS oid,
         CAST(-122.0 AS DOUBLE) + (o_custkey % 500) * CAST(0.001 AS DOUBLE) + (o_orderkey % 7) * CAST(0.00002 AS DOUBLE) AS lon,
         CAST(40.0 AS DOUBLE) + (o_custkey // 500) * CAST(0.001 AS DOUBLE) + (o_orderkey % 11) * CAST(0.00002 AS DOUBLE) AS lat,
         CASE WHEN o_orderkey % 17 <> 0 THEN a.type END AS type
  FROM orders LEFT JOIN auth a ON a.oid = o_custkey
)"""


def crowded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The contention layers with a third of the records, and every 500th captured point, on one site of ten metres."""
    cap, auth = contention(spark, sf_dir)

    def moved(layer: DataFrame, on_site, across: int, up: int) -> DataFrame:
        return layer.withColumns({
            "lon": F.when(on_site, F.lit(-121.0) - (F.col("OBJECTID") % across) * F.lit(0.000001)).otherwise(F.col("lon")),
            "lat": F.when(on_site, F.lit(39.0) + (F.col("OBJECTID") % up) * F.lit(0.000001)).otherwise(F.col("lat")),
        })

    return moved(cap, F.col("OBJECTID") % 500 == 0, 101, 103), moved(auth, F.col("OBJECTID") % 3 == 0, 89, 97)


# a third of the records, and every 500th captured point, on one site
CROWDED_SQL = CONTENTION_SQL.replace("auth AS", "spread AS").replace("cap AS", "taken AS").replace("auth a", "spread a") + """, auth AS (
  SELECT oid, type, CASE WHEN oid % 3 = 0 THEN CAST(-121.0 AS DOUBLE) - (oid % 89) * CAST(0.000001 AS DOUBLE) ELSE lon END AS lon,
         CASE WHEN oid % 3 = 0 THEN CAST(39.0 AS DOUBLE) + (oid % 97) * CAST(0.000001 AS DOUBLE) ELSE lat END AS lat
  FROM spread
), cap AS (
  SELECT oid, type, CASE WHEN oid % 500 = 0 THEN CAST(-121.0 AS DOUBLE) - (oid % 101) * CAST(0.000001 AS DOUBLE) ELSE lon END AS lon,
         CASE WHEN oid % 500 = 0 THEN CAST(39.0 AS DOUBLE) + (oid % 103) * CAST(0.000001 AS DOUBLE) ELSE lat END AS lat
  FROM taken
)"""


def planted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Captured and authoritative features ``(attributes, geometry)``."""
    q, i = F.floor(F.col("k") / 4), F.col("k") % 4
    lon = lambda far: far + (q % 500) * F.lit(0.001) + i * F.lit(0.00005)
    lat = F.lit(40.0) + F.floor(q / 500) * F.lit(0.001)
    customer = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey").cast("bigint"))
    away = (i == 3) & (q % 5 == 0)
    notes = F.when(F.col("k") % 3 == 1, F.lit("  ")).when(F.col("k") % 3 == 2, F.col("c_name"))
    auth = customer.select(
        F.struct((F.col("k") + 1).alias("OBJECTID"), F.format_string("{a%d}", "k").alias("GlobalID"), notes.alias("Notes"), F.lit(None).cast("string").alias("Condition"), F.col("c_mktsegment").alias("Segment")).alias("attributes"),
        F.struct(F.when(away, lon(F.lit(-100.0))).otherwise(lon(F.lit(-122.0))).alias("x"), lat.alias("y")).alias("geometry"),
    )
    spots = table(spark, sf_dir, "orders").withColumn("k", F.floor(F.col("o_orderkey") / 10).cast("bigint")).groupBy("k").agg(F.min("o_orderpriority").alias("notes"), F.max("o_orderstatus").alias("status"))
    place = F.when(q % 17 != 0, F.struct((lon(F.lit(-122.0)) + F.lit(0.00004)).alias("x"), lat.alias("y")))
    cap = spots.select(
        F.struct((F.col("k") + 1).alias("OBJECTID"), F.format_string("{c%d}", "k").alias("GlobalID"), F.col("notes").alias("Notes"), F.col("status").alias("Status")).alias("attributes"),
        place.alias("geometry"),
    )
    return cap, auth


def planted_ledger(captured: DataFrame, authoritative: DataFrame) -> DataFrame:
    """The earlier run: captured points of every 11th row, with the records at their place."""
    k = F.col("attributes.OBJECTID") - 1
    own = captured.where(F.floor(k / 4) % 11 == 0).select(k.alias("k"), F.col("attributes.GlobalID").alias("gid"))
    taken = authoritative.where("geometry.x < -110").select((F.col("attributes.OBJECTID") - 1).alias("k"), F.col("attributes.OBJECTID").alias("oid"))
    rows = own.join(taken, "k", "left").select(
        F.lit(CONFIG.name).alias("layer"), F.col("gid").alias("captured_global_id"), F.when(F.col("oid").isNotNull(), "updated").otherwise("created").alias("action"),
        F.col("oid").alias("authoritative_oid"), F.lit("0/0").alias("attachments_status"), F.lit("2020-01-01T00:00:00").alias("run_time"),
    )
    return rows.select(*[c.split()[0] for c in LEDGER.split(", ")])


def planted_attachments(spark: SparkSession, sf_dir: str, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Source attachments of captured points and what the records' side has: half of them already, and another one.

    ``keep`` stores both; the second is derived from the first as it is stored.
    """
    lines = table(spark, sf_dir, "lineitem").select((F.floor(F.col("l_orderkey") / 10) + 1).cast("bigint").alias("parent_oid"), F.col("l_linenumber").cast("bigint").alias("id")).distinct()
    name = F.when(F.col("id") != 7, F.concat(F.lit("Photo"), (F.col("id") % 3).cast("string"), F.lit(".jpg")))
    source = keep(lines.withColumn("name", name))
    old = source.where((F.col("id") % 2 == 0) & F.col("name").isNotNull()).select("parent_oid", (F.col("parent_oid") * 10 + F.col("id")).alias("id"), F.concat(F.lit("c"), (F.col("parent_oid") - 1).cast("string"), F.lit("_att"), F.col("id").cast("string"), F.lit("_"), F.col("name")).alias("name"))
    other = source.select("parent_oid").distinct().select("parent_oid", (F.col("parent_oid") * 10).alias("id"), F.lit("Photo1.jpg").alias("name"))
    return source, keep(old.unionByName(other))


PLANTED_SQL = """
auth AS (
  SELECT CAST(c_custkey AS BIGINT) AS k, CAST(c_custkey + 1 AS BIGINT) AS oid, '{a' || c_custkey || '}' AS gid,
         CASE c_custkey % 3 WHEN 1 THEN '  ' WHEN 2 THEN c_name END AS notes, c_mktsegment AS segment,
         (c_custkey % 4 = 3 AND (c_custkey // 4) % 5 = 0) AS away,
         (CASE WHEN c_custkey % 4 = 3 AND (c_custkey // 4) % 5 = 0 THEN CAST(-100.0 AS DOUBLE) ELSE CAST(-122.0 AS DOUBLE) END)
           + ((c_custkey // 4) % 500) * CAST(0.001 AS DOUBLE) + (c_custkey % 4) * CAST(0.00005 AS DOUBLE) AS lon,
         CAST(40.0 AS DOUBLE) + ((c_custkey // 4) // 500) * CAST(0.001 AS DOUBLE) AS lat
  FROM customer
), spots AS (
  SELECT CAST(o_orderkey // 10 AS BIGINT) AS k, min(o_orderpriority) AS notes, max(o_orderstatus) AS status FROM orders GROUP BY 1
), cap AS (
  SELECT k, k + 1 AS oid, '{c' || k || '}' AS gid, notes, status,
         CASE WHEN (k // 4) % 17 <> 0 THEN CAST(-122.0 AS DOUBLE) + ((k // 4) % 500) * CAST(0.001 AS DOUBLE) + (k % 4) * CAST(0.00005 AS DOUBLE) + CAST(0.00004 AS DOUBLE) END AS lon,
         CASE WHEN (k // 4) % 17 <> 0 THEN CAST(40.0 AS DOUBLE) + ((k // 4) // 500) * CAST(0.001 AS DOUBLE) END AS lat
  FROM spots
), todo AS (
  SELECT * FROM cap WHERE (k // 4) % 11 <> 0
), won AS (
  SELECT t.*, a.oid AS auth_oid, a.gid AS auth_gid, a.notes AS auth_notes, a.segment, a.lon AS auth_lon, a.lat AS auth_lat
  FROM todo t LEFT JOIN auth a ON a.k = t.k AND NOT a.away WHERE t.lon IS NOT NULL
)"""
