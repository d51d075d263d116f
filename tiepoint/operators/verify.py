"""Comparison of restored records with the snapshot that they were restored from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tiepoint.functions.geo import CHORD_LIMIT_M, geodesic_columns, short_distance
from tiepoint.functions.values import wkid, writable

TOLERANCE_M = 0.5  # fixed value


def _differs(expected: Column, actual: Column, kind) -> Column:
    """Null equals null; NaN equals nothing."""
    odd = ~expected.eqNullSafe(actual)
    if isinstance(kind, (DoubleType, FloatType)):
        odd = odd | F.coalesce(F.isnan(expected) | F.isnan(actual), F.lit(False))
    return odd


def verify(snapshot: DataFrame, live: DataFrame, tolerance_m: float = TOLERANCE_M) -> DataFrame:
    """``(oid, live_feature_found, verified, attribute_mismatches, geometry_mismatch_m)`` for each snapshot row.

    ``snapshot`` has ``oid, attributes, geometry``; ``live`` has ``attributes`` (with ``OBJECTID``) and
    ``geometry``. Managed fields aren't compared. Places in different coordinate systems differ, without a
    distance; both missing is fine, one missing isn't.
    """
    s = snapshot.select("oid", F.col("attributes").alias("sa"), F.col("geometry").alias("sg"))
    now = live.select(F.col("attributes.OBJECTID").alias("oid"), F.col("attributes").alias("la"), F.col("geometry").alias("lg"), F.lit(True).alias("found"))
    both = s.join(now, "oid", "left")
    kinds = {f.name: f.dataType for f in snapshot.schema["attributes"].dataType}
    theirs = live.schema["attributes"].dataType.names
    entries = []
    for n in writable(list(kinds)):
        old = F.col(f"sa.`{n}`")
        new = F.col(f"la.`{n}`") if n in theirs else F.lit(None).cast(kinds[n])
        value = F.struct(old.cast("string").alias("expected"), new.cast("string").alias("actual"))
        entries.append(F.when(_differs(old, new, kinds[n]), F.struct(F.lit(n).alias("key"), value.alias("value"))))
    none = F.expr("cast(map() as map<string,struct<expected:string,actual:string>>)")
    odd = F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull())) if entries else none
    lon1, lat1, lon2, lat2 = F.col("sg.x"), F.col("sg.y"), F.col("lg.x"), F.col("lg.y")
    near = short_distance(lon1, lat1, lon2, lat2)
    # the column form is exact to a kilometre; what is farther apart is measured on the ellipsoid
    whole = lon1.isNotNull() & lat1.isNotNull() & lon2.isNotNull() & lat2.isNotNull()
    has_wkid = all("spatialReference" in d.schema["geometry"].dataType.names for d in (snapshot, live))
    apart = F.coalesce(wkid(F.col("sg")) != wkid(F.col("lg")), F.lit(False)) if has_wkid else F.lit(False)
    gap = F.when(apart | ~whole, None).otherwise(near)
    rows = both.select("oid", F.coalesce("found", F.lit(False)).alias("found"), odd.alias("odd"), gap.alias("gap"), apart.alias("apart"), whole.alias("whole"), (lon1.isNull() & lon2.isNull()).alias("neither"), lon1.alias("x1"), lat1.alias("y1"), lon2.alias("x2"), lat2.alias("y2"))
    rows = rows.withColumn("gap", F.when(F.col("gap") <= CHORD_LIMIT_M, F.col("gap")).when(F.col("gap").isNotNull(), geodesic_columns(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))))
    placed = F.when(F.col("apart"), False).when(~F.col("whole"), F.col("neither")).otherwise(F.col("gap") <= tolerance_m)
    return rows.select(
        "oid",
        F.col("found").alias("live_feature_found"),
        (F.col("found") & (F.size("odd") == 0) & placed).alias("verified"),
        F.when(F.col("found"), F.col("odd")).otherwise(none).alias("attribute_mismatches"),
        F.when(F.col("found"), F.col("gap")).alias("geometry_mismatch_m"),
    )


def verify_counts(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if("verified").alias("verified"), F.count_if(~F.col("verified")).alias("mismatched"))
