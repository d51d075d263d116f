"""Attachments as tables: what to copy, what was copied, what to remove.

A source attachment is ``(parent_oid, id, name)``, with ``content`` where it is to be copied; contents are
joined last and never shuffled for planning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiepoint.functions.values import feature_name, file_name, fully_copied, ids_of, oid_of

from .merge import allocate_ids


def expected(outcomes: DataFrame, source: DataFrame) -> DataFrame:
    """Source attachments of successful writes: ``(cap_oid, target_oid, id, target_name, valid)``.

    ``outcomes`` has ``cap_oid, captured_global_id, target_oid, success``. Entries without an id or a name are
    kept as not valid: they count in totals and are never copied.
    """
    own = outcomes.where("success").select("cap_oid", feature_name(F.col("captured_global_id")).alias("_feature"), "target_oid")
    rows = own.join(source, own["cap_oid"] == source["parent_oid"])
    valid = F.col("id").isNotNull() & (F.col("id") != 0) & F.col("name").isNotNull() & (F.col("name") != "")
    name = F.when(valid, file_name(F.col("_feature"), F.col("id"), F.col("name")))
    return rows.select("cap_oid", "target_oid", "id", name.alias("target_name"), valid.alias("valid"))


def judged(wanted: DataFrame, target: DataFrame) -> DataFrame:
    """``wanted`` with ``there``, whether the target has that name (its other attachments don't count), and ``first``, true for one
    entry of each name."""
    key = ["target_oid", "target_name"]
    theirs = target.where(F.col("name").isNotNull()).select(F.col("parent_oid").alias("target_oid"), F.col("name").alias("target_name"), F.lit(True).alias("_theirs"))
    both = wanted.withColumn("_theirs", F.lit(False)).unionByName(theirs, allowMissingColumns=True)
    # both sides are dealt and sorted by the names once
    named = Window.partitionBy(*key).orderBy("_theirs", "cap_oid", "id")
    whole = named.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = both.withColumns({"_there": F.max("_theirs").over(whole), "_n": F.row_number().over(named)}).where(~F.col("_theirs"))
    return rows.select(*wanted.columns, (F.col("valid") & F.col("_there")).alias("there"), (F.col("valid") & (F.col("_n") == 1)).alias("first"))


def missing(known: DataFrame) -> DataFrame:
    """Of ``judged`` rows the valid ones that the target lacks, one for each name."""
    return known.where("first and not there").drop("there", "first")


def present(known: DataFrame) -> DataFrame:
    """Of ``judged`` rows the names that the target has, each once."""
    return known.where("first and there").drop("there", "first")


def already_there(wanted: DataFrame, target: DataFrame) -> DataFrame:
    """Expected names that the target has, each once."""
    return present(judged(wanted, target))


def plan_copies(wanted: DataFrame, target: DataFrame) -> DataFrame:
    """Valid expected attachments that the target lacks, one for each name."""
    return missing(judged(wanted, target))


def new_copies(plan: DataFrame, source: DataFrame, target: DataFrame, failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What the copies add to the target, and the copies made ``(target_oid, target_name, new_id)``. ``plan`` is read
    three times.

    ``failed`` holds ``(target_oid, target_name)`` that a writer reported as not copied.
    """
    made = plan if failed is None else plan.join(failed, ["target_oid", "target_name"], "left_anti")
    start = target.agg(F.max("id")).first()[0] or 0
    keyed = made.withColumn("_key", F.concat_ws("/", "target_oid", "target_name"))
    numbered = allocate_ids(keyed, "_key", start, name="new_id").drop("_key")
    new = numbered.select(F.col("target_oid").alias("parent_oid"), F.col("new_id").alias("id"), F.col("target_name").alias("name"), F.col("cap_oid").alias("_from"), F.col("id").alias("_id"))
    if "content" in target.columns:
        contents = source.select(F.col("parent_oid").alias("_from"), F.col("id").alias("_id"), "content")
        new = new.join(contents, ["_from", "_id"], "left")
    return new.select(*target.columns), numbered.select("target_oid", "target_name", "new_id")


def copy(plan: DataFrame, source: DataFrame, target: DataFrame, failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The target after the copies, and the copies made."""
    new, made = new_copies(plan, source, target, failed)
    return target.unionByName(new), made


def statuses(outcomes: DataFrame, wanted: DataFrame, before: DataFrame, made: DataFrame, unlisted: DataFrame | None = None, enabled: bool = True) -> DataFrame:
    """``(cap_oid, attachments_status, attachments_added, attachments_ok)`` of successful writes.

    A status is ``copied/total``: distinct names on the target by all source entries; null where listing
    failed (``unlisted(cap_oid)``), which isn't success; ``0/0`` where copying is off. ``before`` and ``made`` have each
    name of a target once, and none in common.
    """
    own = outcomes.where("success").select("cap_oid", "target_oid").distinct()
    return with_statuses(own.withColumn("success", F.lit(True)), wanted, before, made, unlisted, enabled).drop("target_oid", "success")


def with_statuses(
    outcomes: DataFrame, wanted: DataFrame | None = None, before: DataFrame | None = None, made: DataFrame | None = None, unlisted: DataFrame | None = None, enabled: bool = True,
) -> DataFrame:
    """``outcomes`` with what ``statuses`` says of them, null for failed writes: one aggregate by target and one join."""
    empty, good = F.array().cast("array<bigint>"), F.col("success")
    if not enabled:
        return outcomes.withColumns({"attachments_status": F.when(good, "0/0"), "attachments_added": F.when(good, empty), "attachments_ok": F.when(good, F.lit(True))})
    each = wanted.select("target_oid", F.col("cap_oid").alias("_of"))
    each = each.unionByName(before.select("target_oid", F.lit(1).alias("_before")), allowMissingColumns=True)
    each = each.unionByName(made.select("target_oid", F.col("new_id").alias("_new")), allowMissingColumns=True)
    known = each.groupBy(F.col("target_oid").alias("_target")).agg(F.collect_list("_of").alias("_of"), F.count("_before").alias("_before"), F.sort_array(F.collect_list("_new")).alias("_new"))
    joined = outcomes.join(known, F.col("target_oid") == F.col("_target"), "left")
    total = F.coalesce(F.size(F.filter("_of", lambda x: x == F.col("cap_oid"))), F.lit(0))
    added = F.coalesce("_new", empty)
    text = F.when(good, F.concat_ws("/", F.coalesce("_before", F.lit(0)) + F.size(added), F.when(F.col("_of").isNull(), 0).otherwise(total)))
    if unlisted is not None:
        joined = joined.join(unlisted.select(F.col("cap_oid").alias("_unlisted")).distinct(), F.col("cap_oid") == F.col("_unlisted"), "left")
        text = F.when(F.col("_unlisted").isNull(), text)
    found = joined.withColumns({"attachments_status": text, "attachments_added": F.when(good, added)})
    return found.withColumn("attachments_ok", F.when(good, fully_copied(F.col("attachments_status")))).select(*outcomes.columns, "attachments_status", "attachments_added", "attachments_ok")


def to_remove(report: DataFrame) -> DataFrame:
    """``(oid, id)`` of the attachments that a run added to updated records; appended ones go with their record."""
    rows = report.where(F.col("action") == "updated").select(oid_of(F.col("authoritative_oid")).alias("oid"), F.explode(ids_of(F.col("attachments_added"))).alias("id"))
    return rows.where("oid is not null and id is not null")


def remove(target: DataFrame, gone: DataFrame, checkpoint: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The target without ``gone(oid, id)``, and a result for each: one that isn't there is a failure.

    Both come from one join, which ``checkpoint`` stores."""
    keys = gone.select(F.col("oid").alias("parent_oid"), "id", F.lit(True).alias("_gone")).distinct()
    met = target.withColumn("_there", F.lit(True)).join(keys, ["parent_oid", "id"], "full")
    if checkpoint is not None:
        met = checkpoint(met)
    found = met.where("_gone").select("parent_oid", "id", F.col("_there").isNotNull().alias("success")).distinct()
    results = found.select(F.col("parent_oid").alias("oid"), F.col("id").alias("attachment_id"), "success", F.when(~F.col("success"), F.lit("attachment not found")).alias("error"))
    return met.where("_gone is null").select(*target.columns), results


def removal_flags(results: DataFrame) -> DataFrame:
    """``(oid, success)``: whether all of a record's removals went well."""
    return results.groupBy("oid").agg(F.bool_and("success").alias("success"))
