"""Merges and rollbacks that read the layer's state from a run store and leave their artifacts in it.

Each run builds on the latest finished one: its layer, attachments and ledger. A merge writes the snapshot
first, then the layer, attachments, report and ledger; the run counts once its mark is written. A rollback is
a run as well: it takes report and snapshot of the run that it undoes by that run's time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tiepoint.config import LayerConfig
from tiepoint.sources import layers, run_store
from tiepoint.sources.artifacts import LEDGER
from tiepoint.sources.storage import empty

from . import runs


@dataclass(frozen=True)
class State:
    run_ts: str | None
    layer: DataFrame  # flat
    attachments: DataFrame | None
    ledger: DataFrame


def state_of(spark: SparkSession, store: str, layer: str, authoritative: DataFrame | None = None, attachments: DataFrame | None = None) -> State:
    """What the latest finished run left; before the first, ``authoritative`` and ``attachments``."""
    at = run_store.latest(spark, store, layer)
    if at is None:
        if authoritative is None:
            raise ValueError(f"{layer} has no finished run in {store}: give its authoritative layer")
        return State(None, layers.flatten(authoritative), attachments, empty(spark, LEDGER))
    part = lambda name: run_store.part_of(spark, store, layer, at, name)
    return State(at, part("layer"), None if attachments is None else part("attachments"), part("ledger"))


def apply_run(
    captured: DataFrame, store: str, config: LayerConfig, run_ts: str, source: str, checkpoint: runs.Checkpoint,
    authoritative: DataFrame | None = None, source_attachments: DataFrame | None = None, target_attachments: DataFrame | None = None,
    unlisted: DataFrame | None = None, writer: runs.Writer | None = None,
) -> runs.Applied:
    """Merge ``captured`` into the layer's state and write the run. ``authoritative`` and ``target_attachments`` are the
    state before the first run; later runs read both from the store."""
    spark = captured.sparkSession
    _check_new(spark, store, config.name, run_ts)
    before = state_of(spark, store, config.name, authoritative, target_attachments)
    done = runs.apply(captured, layers.unflatten(before.layer), before.ledger, config, run_ts, checkpoint, source_attachments, before.attachments, unlisted, writer)
    write = lambda **parts: run_store.write_tables(store, config.name, run_ts, **parts)
    write(snapshot=done.snapshot.withColumn("source", F.lit(source)))
    write(layer=done.layer)
    write(attachments=before.attachments if done.attachments is None else done.attachments)
    run_store.write_run_report(store, config.name, run_ts, done.report)
    write(ledger=done.ledger)
    run_store.finish(spark, store, config.name, run_ts, "merge", source, before.run_ts)
    return done


def roll_back_run(spark: SparkSession, store: str, layer: str, undoes: str, run_ts: str, checkpoint: runs.Checkpoint) -> runs.RolledBack:
    """Undo the finished run ``undoes`` and write that as the run ``run_ts``."""
    _check_new(spark, store, layer, run_ts)
    run = run_store.run_of(spark, store, layer, undoes)
    if run.kind != "merge":
        raise ValueError(f"run {undoes!r} of {layer} is a {run.kind}, and can't be undone")
    if run_store.runs_of(spark, store, layer).where(F.col("undoes") == undoes).count():
        raise ValueError(f"run {undoes!r} of {layer} has been undone already")
    part = lambda name: run_store.part_of(spark, store, layer, undoes, name)
    before = state_of(spark, store, layer)
    files = _files(spark, store, layer, before.run_ts)
    back = runs.roll_back(layers.unflatten(before.layer), part("report"), part("snapshot"), before.ledger, layer, checkpoint, files, source=run.source)
    write = lambda **parts: run_store.write_tables(store, layer, run_ts, **parts)
    write(layer=layers.flatten(back.layer))
    write(attachments=back.attachments)
    write(ledger=back.ledger)
    run_store.write_run_audit(store, layer, run_ts, back.audit, back.results)
    run_store.finish(spark, store, layer, run_ts, "rollback", run.source, before.run_ts, undoes)
    return back


def _check_new(spark: SparkSession, store: str, layer: str, run_ts: str) -> None:
    run_store.check_name("run_ts", run_ts)
    if run_store.runs_of(spark, store, run_store.check_name("layer", layer)).where(F.col("run_ts") == run_ts).count():
        raise ValueError(f"{layer} has a finished run {run_ts!r} already")


def _files(spark: SparkSession, store: str, layer: str, run_ts: str) -> DataFrame | None:
    """The attachments as the latest run left them, if the layer has any."""
    try:
        return run_store.part_of(spark, store, layer, run_ts, "attachments")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
