"""The three workloads: preview of a merge, the merge, and its rollback.

Layers are ``(attributes, geometry)`` as from the readers, and are read where they lie, as often as needed: store
what is costly to derive. Results are DataFrames over stored tables, so a caller can write them where the layer
lives; nothing that is read is overwritten, and what a caller writes isn't stored before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiepoint.config import LayerConfig
from tiepoint.operators import assignment, attachments, candidates, ledger as ledgers, merge, rollback as undo, verify as checks
from tiepoint.sources.artifacts import OUTCOME_COLUMNS, PLAN_COLUMNS
from tiepoint.sources.layers import check_count, check_layer_pair, flatten, point_counts, with_points, without_points

Checkpoint = Callable[[DataFrame], DataFrame]
Writer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Preview:
    todo: DataFrame  # captured rows that the ledger lacks, flat
    matches: DataFrame  # cap_oid, auth_oid, distance_m, candidates_json, assignment_overridden_nearest
    updates: DataFrame
    appends: DataFrame
    report: DataFrame
    places: DataFrame  # one row: authoritative records with a usable point and without; these can't be matched


def assigned(captured: DataFrame, authoritative: DataFrame, ledger: DataFrame, config: LayerConfig, checkpoint: Checkpoint) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Eligible captured rows, free records (what the join needs of them), each captured row's candidates as
    ``candidates.listed``, and ``assignment.assign``'s matches; layers are flat."""
    todo = checkpoint(ledgers.unprocessed(captured, ledger, config.name))
    needed = dict.fromkeys(("OBJECTID", "GlobalID", "lon", "lat", config.type_field_authoritative))
    free = checkpoint(ledgers.unclaimed(with_points(authoritative).select(*(F.col(f"`{n}`") for n in needed if n)), ledger, config.name))
    lists = checkpoint(candidates.listed(candidates.pairs_within(todo, free, config.match_threshold_m, config.type_field_captured, config.type_field_authoritative)))
    return todo, free, lists, assignment.assign_listed(lists, checkpoint)


def match(captured: DataFrame, authoritative: DataFrame, ledger: DataFrame, config: LayerConfig, checkpoint: Checkpoint) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """As ``assigned``, with all candidate pairs, and the matches with ``assignment_overridden_nearest``."""
    todo, free, lists, matches = assigned(captured, authoritative, ledger, config, checkpoint)
    pairs = lists.select("cap_oid", F.inline("found")).drop("um")
    return todo, free, pairs, checkpoint(assignment.with_override(matches, pairs))


def preview(
    captured: DataFrame, authoritative: DataFrame, ledger: DataFrame, config: LayerConfig, checkpoint: Checkpoint, declared: tuple[int, int] | None = None,
) -> Preview:
    """What a merge would do: planned updates and appends, and the report in captured order, skipped rows first.

    Both layers must have their fields and points, and as many rows as their sources declare (``declared``: captured,
    authoritative), or nothing is done.
    """
    check_layer_pair(captured, authoritative, config)
    for layer, count in zip((captured, authoritative), declared or (), strict=False):
        check_count(layer, count)
    flat_a = flatten(authoritative)
    todo, _, lists, matches = assigned(flatten(captured), flat_a, ledger, config, checkpoint)
    skipped, usable = without_points(todo), with_points(todo)
    # a captured row travels whole with its candidates and its match; what follows needs no further join to it
    rows = usable.select(F.col("OBJECTID").alias("_oid"), F.struct(*(F.col(f"`{n}`") for n in usable.columns)).alias("c"))
    lists, matched = lists.withColumnRenamed("cap_oid", "_oid"), matches.withColumnRenamed("cap_oid", "_oid")
    nearest = F.get("found", F.lit(0))["auth_oid"]  # lists and nearest candidates have the same order
    told = checkpoint(rows.join(lists, "_oid", "left").join(matched, "_oid", "left").select(
        "c", candidates.candidates_json(candidates.shown(F.col("found"))).alias("candidates_json"), "auth_oid", "distance_m",
        F.coalesce(F.col("auth_oid") != nearest, F.lit(False)).alias("assignment_overridden_nearest"),
    ))
    carried = ["auth_oid", "distance_m", "candidates_json", "assignment_overridden_nearest"]
    won = told.where("auth_oid is not null").select(F.col("c.OBJECTID").alias("cap_oid"), *carried, "c")
    updates = merge.plan_updates(won, usable, authoritative, config)
    appends = merge.plan_appends(told.where("auth_oid is null").select("c", "candidates_json"), config)
    fixed = [F.lit(config.match_threshold_m).alias("threshold_m"), F.lit(config.name).alias("layer")]
    rows = told.select(
        F.lit(1).alias("section"), "c.OBJECTID", F.col("c.GlobalID").alias("captured_global_id"),
        F.when(F.col("auth_oid").isNotNull(), "would_update").otherwise("would_append").alias("action"),
        F.col("auth_oid").alias("matched_authoritative_oid"), "distance_m", "candidates_json", "assignment_overridden_nearest", *fixed,
    )
    none = skipped.select(
        F.lit(0).alias("section"), "OBJECTID", F.col("GlobalID").alias("captured_global_id"), F.lit("skipped_no_geometry").alias("action"),
        F.lit(None).cast("bigint").alias("matched_authoritative_oid"), F.lit(None).cast("double").alias("distance_m"),
        F.lit("[]").alias("candidates_json"), F.lit(False).alias("assignment_overridden_nearest"), *fixed,
    )
    report = none.unionByName(rows).orderBy("section", "OBJECTID").select(*PLAN_COLUMNS)
    return Preview(todo, won.drop("c"), updates, appends, report, point_counts(flat_a))


def summary(report: DataFrame) -> DataFrame:
    """``(action, planned, succeeded)``; plans have no outcome yet."""
    done = F.count_if("success") if "success" in report.columns else F.lit(None).cast("bigint")
    return report.groupBy("action").agg(F.count("*").alias("planned"), done.alias("succeeded"))


@dataclass(frozen=True)
class Applied:
    snapshot: DataFrame
    layer: DataFrame  # flat
    report: DataFrame
    ledger: DataFrame
    attachments: DataFrame | None
    changed: DataFrame  # of the flat layer, the records that were updated or appended
    copied: DataFrame | None  # of the attachments, those added
    places: DataFrame  # as in the preview
    entries: DataFrame  # of the ledger, those of this run
    left: DataFrame  # captured rows to be taken again: no place, not written, or not all attachments copied


def apply(
    captured: DataFrame, authoritative: DataFrame, ledger: DataFrame, config: LayerConfig, run_ts: str, checkpoint: Checkpoint,
    source_attachments: DataFrame | None = None, target_attachments: DataFrame | None = None, unlisted: DataFrame | None = None,
    writer: Writer | None = None, declared: tuple[int, int] | None = None,
) -> Applied:
    """Merge: snapshot first, then the layer, then attachments, report and ledger.

    Neither the layer nor the attachments are stored as they are afterwards, only what changed; what is written here
    grows with the captured rows and not with the layer.

    A table write is whole or not at all. Where a service writes instead, ``writer`` takes the planned writes
    ``(action_id, action, target_oid)`` and gives its results ``(action_id, object_id, global_id, success, error)``:
    what failed or has no result isn't in the layer and is reported with its error. A row enters the ledger
    only if its write and all its attachments succeeded; the others are retried by the next run.
    """
    plan = preview(captured, authoritative, ledger, config, checkpoint, declared)
    # stored with the records as they were: the snapshot, and what the layer's changes are made of
    updates, appends = checkpoint(plan.updates), plan.appends
    snapshot = updates.select(F.col("auth_oid").alias("oid"), "attributes", "geometry", F.lit(config.name).alias("layer"))
    flat = flatten(authoritative)
    start = flat.agg(F.max("OBJECTID")).first()[0] or 0
    numbered = merge.allocate_ids(appends, "cap_oid", start)
    shared = ("cap_oid", "captured_global_id", "candidates_json")
    done = updates.select(*shared, F.lit("updated").alias("action"), F.col("auth_oid").alias("target_oid"), "distance_m", "assignment_overridden_nearest")
    done = done.unionByName(numbered.select(*shared, F.lit("appended").alias("action"), F.col("new_oid").alias("target_oid"), F.lit(None).cast("double").alias("distance_m"), F.lit(False).alias("assignment_overridden_nearest")))
    done = done.withColumn("action_id", F.concat_ws(":", "action", "cap_oid"))
    if writer is None:
        done = done.withColumns({"success": F.lit(True), "error": F.lit(None).cast("string")})
    else:
        done = checkpoint(merge.write_results(done, writer(done.select("action_id", "action", "target_oid"))).drop("result_oid"))
        failed = done.where("not success").select("action", "target_oid")
        lost = lambda action: failed.where(F.col("action") == action).select("target_oid")
        updates = updates.join(lost("updated"), F.col("auth_oid") == F.col("target_oid"), "left_anti")
        numbered = numbered.join(lost("appended"), F.col("new_oid") == F.col("target_oid"), "left_anti")
    changed = merge.append(merge.updated(updates), numbered.drop("candidates_json"))
    layer = merge.replaced(flat, changed)

    after = copied = None
    enabled = config.copy_attachments and source_attachments is not None and target_attachments is not None
    if enabled:
        listed = source_attachments if unlisted is None else source_attachments.join(unlisted.select(F.col("cap_oid").alias("parent_oid")), "parent_oid", "left_anti")
        wanted = checkpoint(attachments.judged(attachments.expected(done, listed), target_attachments))
        copied, made = attachments.new_copies(attachments.missing(wanted), source_attachments, target_attachments)
        after = target_attachments.unionByName(copied)
        told = attachments.with_statuses(done, wanted, attachments.present(wanted), made, unlisted)
    else:
        told = attachments.with_statuses(done, enabled=False)
    ok = F.col("success") & F.coalesce("attachments_ok", F.lit(False))
    outcome = told.withColumn("ledgered", ok & F.col("captured_global_id").isNotNull())
    if enabled:
        outcome = checkpoint(outcome)
    report = outcome.withColumns({
        "authoritative_oid": F.col("target_oid"),
        "threshold_m": F.lit(config.match_threshold_m),
        "attachments_added": F.to_json(F.coalesce("attachments_added", F.array().cast("array<bigint>"))),
        "layer": F.lit(config.name),
    })
    report = report.orderBy(F.col("action") != "updated", "cap_oid").select(*OUTCOME_COLUMNS)
    entries = outcome.where("ledgered").select(
        F.lit(config.name).alias("layer"), "captured_global_id", F.when(F.col("action") == "updated", "updated").otherwise("created").alias("action"),
        F.col("target_oid").alias("authoritative_oid"), "attachments_status", F.lit(run_ts).alias("run_time"),
    )
    # a row without a captured id can't be ledgered; once it is written it must not be taken again
    finished = outcome.where(ok).select(F.col("cap_oid").alias("_done"))
    open_ids = plan.todo.select(F.col("OBJECTID").alias("_open")).join(finished, F.col("_open") == F.col("_done"), "left_anti")
    left = captured.join(open_ids, F.col("attributes.OBJECTID") == F.col("_open"), "left_semi")
    return Applied(snapshot, layer, report, ledgers.upsert(ledger, entries), after, changed, copied, plan.places, ledgers.latest(entries), left)


@dataclass(frozen=True)
class RolledBack:
    layer: DataFrame  # (attributes, geometry)
    ledger: DataFrame
    attachments: DataFrame | None
    verification: DataFrame | None
    skipped: DataFrame  # (oid) of updated records that the snapshot lacks, left as they are
    results: DataFrame  # a row for each record and step
    audit: DataFrame  # one row of counters


def roll_back(
    live: DataFrame, report: DataFrame, snapshot: DataFrame, ledger: DataFrame, layer_name: str, checkpoint: Checkpoint,
    target_attachments: DataFrame | None = None, force: bool = False, source: str | None = None,
) -> RolledBack:
    """Restore updated records, verify them, delete what was added, and clear the run's ledger rows."""
    # reports are text files, and those of several lines a cell aren't read in parts: once is enough
    report = checkpoint(report.select(*(n for n in report.columns if n in undo.REPORTED)))
    undo.check_layer(report, snapshot, layer_name, force)
    before = live.count()
    restores, lacking = undo.plan_restores(report, snapshot)
    lacking, unread = checkpoint(lacking), undo.unreadable(report).count()
    restored = checkpoint(undo.restore_results(live, restores))
    layer = checkpoint(undo.restore(live, restores))
    error = None
    try:
        good = restored.where("success").select("oid")
        verification = checkpoint(checks.verify(restores.join(good, "oid", "left_semi"), layer))
        counts = checks.verify_counts(verification).first()
        verified, mismatched = counts["verified"], counts["mismatched"]
    except Exception as e:  # a check that can't run must not undo the rollback, nor look like "nothing to check"
        verification, verified, mismatched, error = None, None, None, str(e)
    gone_files = attachments.to_remove(report)
    files, file_results = (None, None) if target_attachments is None else attachments.remove(target_attachments, gone_files, checkpoint)
    layer, deleted = undo.delete(layer, undo.rows_of(report, "appended"))
    deleted = checkpoint(deleted)
    if files is not None:
        # attachments go with their record
        lost = deleted.where("success").select(F.col("oid").alias("parent_oid"))
        files, file_results = files.join(lost, "parent_oid", "left_anti").select(*files.columns), checkpoint(file_results)
    after = layer.count()
    new_ledger, cleared = ledgers.clear(ledger, report, layer_name)
    r = undo.counters(restored, "restore").first()
    d = undo.counters(deleted, "delete_feature").first()
    targeted = gone_files.count()
    removed = 0 if file_results is None else file_results.where("success").count()
    steps = {"restore": restored, "feature_delete": deleted, "attachment_delete": file_results, "verify": verification}
    results = undo.audit_results({k: rows for k, rows in steps.items() if rows is not None})
    values = {
        "layer": layer_name, "source": source,
        "authoritative_feature_count_before": before, "authoritative_feature_count_after": after,
        "expected_feature_count_after": before - d["delete_feature_success_count"],
        "restore_success_count": r["restore_success_count"], "restore_failure_count": r["restore_failure_count"],
        "delete_feature_success_count": d["delete_feature_success_count"], "delete_feature_failure_count": d["delete_feature_failure_count"],
        "restore_skipped_count": lacking.count(), "unreadable_row_count": unread,
        "total_attachments_targeted": targeted, "total_attachments_removed": removed,
        "verify_success_count": verified, "verify_mismatch_count": mismatched, "verify_error": error,
        "ledger_cleared_count": cleared.count(),
    }
    kinds = {"layer": "string", "source": "string", "verify_error": "string"}
    audit = live.sparkSession.range(1).select(*[F.lit(v).cast(kinds.get(k, "bigint")).alias(k) for k, v in values.items()])
    return RolledBack(layer, new_ledger, files, verification, lacking, results, audit)
