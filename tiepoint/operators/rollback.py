"""Undoing a run: guard, restores, deletions, and the record of what was done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiepoint.config import EXCLUDED_FIELDS
from tiepoint.functions.values import oid_of


REPORTED = ("captured_global_id", "action", "authoritative_oid", "attachments_added", "layer")  # what a rollback reads of a report


class LayerMismatch(ValueError):
    """Report or snapshot belong to another layer than the one to be rolled back."""


def check_layer(report: DataFrame, snapshot: DataFrame, expected: str, force: bool = False) -> None:
    """Raise before anything is read or written unless both artifacts are of the layer ``expected``.

    Artifacts without any recorded layer can't be checked; they pass only with ``force``.
    """
    def layers(rows: DataFrame) -> list[str]:
        if "layer" not in rows.columns:
            return []
        named = rows.where(F.col("layer").isNotNull() & (F.col("layer") != ""))
        return sorted(named.agg(F.collect_set("layer")).first()[0])  # one or a few names

    for what, found in (("snapshot", layers(snapshot)), ("report", layers(report))):
        if found and found != [expected]:
            raise LayerMismatch(f"the {what} belongs to {', '.join(map(repr, found))}, so {expected!r} can't be undone with it")
    if not layers(snapshot) and not layers(report) and not force:
        raise LayerMismatch(f"snapshot and report don't name their layer; force=True takes them for {expected!r}")


def rows_of(report: DataFrame, action: str) -> DataFrame:
    """``(oid, captured_global_id)`` of a report's rows of one action with a readable id, failed writes included."""
    return report.where(F.col("action") == action).select(oid_of(F.col("authoritative_oid")).alias("oid"), "captured_global_id").where("oid is not null")


def unreadable(report: DataFrame) -> DataFrame:
    """Rows that are skipped because their record id can't be read."""
    return report.where(F.col("action").isin("updated", "appended") & oid_of(F.col("authoritative_oid")).isNull())


def plan_restores(report: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snapshot rows ``(oid, attributes, geometry)`` of updated records, and updated ids that the snapshot lacks."""
    wanted = rows_of(report, "updated").select("oid").distinct()
    return snapshot.join(wanted, "oid", "left_semi").select("oid", "attributes", "geometry"), wanted.join(snapshot.select("oid"), "oid", "left_anti")


def restore(live: DataFrame, restores: DataFrame) -> DataFrame:
    """The live layer ``(attributes, geometry)`` with snapshot values, managed fields excepted, and places written back."""
    names = live.schema["attributes"].dataType.names
    saved = restores.schema["attributes"].dataType.names
    one = restores.dropDuplicates(["oid"]).select("oid", F.col("attributes").alias("_a"), F.col("geometry").alias("_g"), F.lit(True).alias("_hit"))
    joined = live.join(one, F.col("attributes.OBJECTID") == F.col("oid"), "left")
    hit = F.col("_hit").isNotNull()
    fields = [
        (F.when(hit, F.col(f"_a.`{n}`")).otherwise(F.col(f"attributes.`{n}`")) if n in saved and n not in EXCLUDED_FIELDS else F.col(f"attributes.`{n}`")).alias(n)
        for n in names
    ]
    return joined.select(F.struct(*fields).alias("attributes"), F.when(hit, F.col("_g")).otherwise(F.col("geometry")).alias("geometry"))


def restore_results(live: DataFrame, restores: DataFrame) -> DataFrame:
    """``(oid, success, error)``: a record that is no longer there can't be restored."""
    there = live.select(F.col("attributes.OBJECTID").alias("oid"), F.lit(True).alias("_there")).distinct()
    found = restores.select("oid").distinct().join(there, "oid", "left").withColumn("success", F.col("_there").isNotNull())
    return found.select("oid", "success", F.when(~F.col("success"), F.lit("feature not found")).alias("error"))


def delete(live: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The layer without the records ``gone(oid)``, and ``(oid, success, error)`` for each."""
    keys = gone.select("oid").distinct()
    left = live.join(keys, F.col("attributes.OBJECTID") == F.col("oid"), "left_anti")
    there = live.select(F.col("attributes.OBJECTID").alias("oid"), F.lit(True).alias("_there")).distinct()
    found = keys.join(there, "oid", "left").withColumn("success", F.col("_there").isNotNull())
    return left, found.select("oid", "success", F.when(~F.col("success"), F.lit("feature not found")).alias("error"))


def counters(results: DataFrame, prefix: str) -> DataFrame:
    return results.agg(F.count_if("success").alias(f"{prefix}_success_count"), F.count_if(~F.col("success")).alias(f"{prefix}_failure_count"))


def audit_results(steps: dict[str, DataFrame]) -> DataFrame:
    """What became of each record in each ``step``, a row each; columns that a step lacks are null."""
    named = [rows.withColumn("step", F.lit(step)) for step, rows in steps.items()]
    whole = named[0]
    for rows in named[1:]:
        whole = whole.unionByName(rows, allowMissingColumns=True)
    return whole
