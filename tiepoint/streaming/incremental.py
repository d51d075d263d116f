"""Merging captured rows as they arrive.

Each micro-batch merges (``plans.runs.apply``) what arrives and what earlier batches left open: rows without a
place, rows whose write failed, rows whose attachments couldn't be listed or copied. A row that arrives again
replaces the open one of the same ``GlobalID`` or ``OBJECTID``; so a corrected row is taken in place of the one
that could not be. Records that earlier batches claimed stay claimed, so how rows are split into batches can
change who matches whom.

State under ``state``, all written once and never over what is being read:

====================  =====================================================================================
commits               a one-row file for each finished batch, written last: what a batch wrote counts only then
delta/batch=N         records of the flat layer that batch N changed or added, in ranges of their ids
base/batch=N          the flat layer as batch N left it, now and then; before the first, the layer as given
copies/batch=N        attachments that batch N added (if they are copied)
pending/batch=N       captured rows left open, with the batch in which they came
ledger, snapshot, report by batch as well: entries, records as they were, outcome
====================  =====================================================================================

The layer is read as its base without the records of later deltas, and of those each record's last. A batch
writes in proportion to its own rows and the pending ones. When the deltas since the base come to more than
``SHARE`` of it, the batch writes a new base, so writes stay in proportion to all changes. A batch that is run
again after a failure starts from the same commit and overwrites what it left half-written.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from tiepoint.config import LayerConfig
from tiepoint.operators import merge
from tiepoint.plans import runs
from tiepoint.sources import layers
from tiepoint.sources.artifacts import LEDGER, write_report
from tiepoint.sources.storage import empty

SHARE = 0.25
COMMIT = "batch int, base int, base_rows long, delta_rows long, schema string, pending string"


class Commit(NamedTuple):
    """What the state is after a batch: ``base`` is the batch that wrote the base, -1 for the layer as given."""

    batch: int
    base: int
    base_rows: int
    delta_rows: int  # since the base
    schema: StructType  # of deltas and bases
    pending: StructType


def last_commit(spark: SparkSession, state: str) -> Commit | None:
    try:
        rows = spark.read.schema(COMMIT).option("recursiveFileLookup", True).json(f"{state}/commits")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    last = rows.orderBy(F.desc("batch")).limit(1).collect()
    if not last:
        return None
    kinds = {k: StructType.fromJson(json.loads(last[0][k])) for k in ("schema", "pending")}
    return Commit(**(last[0].asDict() | kinds))


def _commit(spark: SparkSession, state: str, done: Commit) -> None:
    """One file, so that it is there whole or not at all."""
    values = done._asdict() | {k: json.dumps(getattr(done, k).jsonValue()) for k in ("schema", "pending")}
    row = spark.createDataFrame([tuple(values.values())], COMMIT).coalesce(1)
    row.write.mode("overwrite").json(f"{state}/commits/batch_{done.batch}")


def _since(spark: SparkSession, state: str, name: str, schema: StructType, first: int, last: int) -> DataFrame | None:
    """The tables ``name`` of the batches from ``first`` to ``last``, with ``batch``."""
    if first > last:
        return None
    paths = [f"{state}/{name}/batch={b}" for b in range(first, last + 1)]
    whole = StructType([*schema.fields, StructField("batch", IntegerType())])
    return spark.read.schema(whole).option("basePath", f"{state}/{name}").parquet(*paths)


def _ledger(spark: SparkSession, state: str, commit: Commit | None) -> DataFrame:
    if commit is None:
        return empty(spark, LEDGER + ", batch int")
    return _since(spark, state, "ledger", StructType.fromDDL(LEDGER), 0, commit.batch)


def _layer(spark: SparkSession, state: str, authoritative: DataFrame, commit: Commit | None) -> DataFrame:
    """The flat layer after ``commit``: merged on read."""
    if commit is None:
        return layers.flatten(authoritative)
    base = layers.flatten(authoritative) if commit.base < 0 else spark.read.schema(commit.schema).parquet(f"{state}/base/batch={commit.base}")
    deltas = _since(spark, state, "delta", commit.schema, commit.base + 1, commit.batch)
    if deltas is None:
        return base
    latest = Window.partitionBy("OBJECTID").orderBy(F.desc("batch"))
    changed = deltas.withColumn("_k", F.row_number().over(latest)).where("_k = 1").drop("_k", "batch")
    return merge.replaced(base, changed)


def _open_rows(spark: SparkSession, state: str, batch: DataFrame, commit: Commit | None) -> DataFrame:
    """``batch`` and the pending rows that it doesn't replace, with ``since``, the batch in which a row came (null: this one)."""
    arrived = batch.select("attributes", "geometry", F.lit(None).cast("int").alias("since"))
    if commit is None:
        return arrived
    pending = spark.read.schema(commit.pending).parquet(f"{state}/pending/batch={commit.batch}")
    for key in ("GlobalID", "OBJECTID"):
        again = batch.select(F.col(f"attributes.{key}").alias("_key")).distinct()
        pending = pending.join(again, F.col(f"attributes.{key}") == F.col("_key"), "left_anti")
    return arrived.unionByName(pending)


def merge_batch(
    authoritative: DataFrame, config: LayerConfig, state: str, checkpoint: Callable[[DataFrame], DataFrame],
    source_attachments: DataFrame | None = None, target_attachments: DataFrame | None = None,
    writer: Callable[[int], runs.Writer | None] | None = None, unlisted: Callable[[int], DataFrame | None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``. ``authoritative`` and the batches are ``(attributes, geometry)``.

    ``writer`` and ``unlisted`` give, for a batch's number, what ``apply`` takes under these names.
    """
    if config.copy_attachments and (source_attachments is None or target_attachments is None):
        raise ValueError(f"{config.name} copies attachments: give those of both layers")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        commit = last_commit(spark, state)
        before = -1 if commit is None else commit.batch
        if batch_id <= before:
            return
        if batch_id > before + 1:
            raise RuntimeError(f"{state} lacks batch={batch_id - 1}, on which batch {batch_id} builds")
        layer = _layer(spark, state, authoritative, commit)
        files = target_attachments
        if config.copy_attachments and commit is not None:
            files = files.unionByName(_since(spark, state, "copies", files.schema, 0, before).drop("batch"))
        ledger = _ledger(spark, state, commit).where(F.col("layer") == config.name).drop("batch")
        rows = checkpoint(_open_rows(spark, state, batch, commit))
        run_ts = f"batch-{batch_id:09d}"
        done = runs.apply(
            rows, layers.unflatten(layer), ledger, config, run_ts, checkpoint, source_attachments, files,
            unlisted(batch_id) if unlisted else None, writer(batch_id) if writer else None,
        )
        to = lambda name: f"{state}/{name}/batch={batch_id}"
        done.snapshot.write.mode("overwrite").parquet(to("snapshot"))
        # no more records change than rows were taken
        done.changed.repartitionByRange(max(1, math.isqrt(rows.count()) // 32), "OBJECTID").sortWithinPartitions("OBJECTID").write.mode("overwrite").parquet(to("delta"))
        n = spark.read.schema(done.changed.schema).parquet(to("delta")).count()
        if done.copied is not None:
            done.copied.write.mode("overwrite").parquet(to("copies"))
        pending = done.left.withColumn("since", F.coalesce("since", F.lit(batch_id)))
        pending.write.mode("overwrite").parquet(to("pending"))
        write_report([done.report], to("report"), mode="overwrite")
        done.entries.select(*ledger.columns).write.mode("overwrite").parquet(to("ledger"))
        base_rows = layer.count() if commit is None else commit.base_rows
        now = Commit(batch_id, -1 if commit is None else commit.base, base_rows, n + (0 if commit is None else commit.delta_rows), done.changed.schema, pending.schema)
        if now.delta_rows > SHARE * now.base_rows:
            whole = _layer(spark, state, authoritative, now)
            whole.write.mode("overwrite").parquet(to("base"))
            now = now._replace(base=batch_id, base_rows=spark.read.schema(whole.schema).parquet(to("base")).count(), delta_rows=0, schema=whole.schema)
        _commit(spark, state, now)

    return run


def start(
    stream: DataFrame, authoritative: DataFrame, config: LayerConfig, state: str, checkpoint: Callable[[DataFrame], DataFrame],
    source_attachments: DataFrame | None = None, target_attachments: DataFrame | None = None,
    writer: Callable[[int], runs.Writer | None] | None = None, unlisted: Callable[[int], DataFrame | None] | None = None,
) -> StreamingQuery:
    """Merge what has arrived and stop; start again for what arrives later."""
    run = merge_batch(authoritative, config, state, checkpoint, source_attachments, target_attachments, writer, unlisted)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{state}/stream").trigger(availableNow=True).start()


def state_of(spark: SparkSession, state: str) -> DataFrame:
    """The ledger of all finished batches, with ``batch``."""
    return _ledger(spark, state, last_commit(spark, state))


def pending_of(spark: SparkSession, state: str) -> DataFrame:
    """Captured rows that are still open, with ``since``."""
    commit = last_commit(spark, state)
    if commit is None:
        raise ValueError(f"no batch has been finished in {state}")
    return spark.read.schema(commit.pending).parquet(f"{state}/pending/batch={commit.batch}")


def layer_of(spark: SparkSession, state: str, authoritative: DataFrame) -> DataFrame:
    """The flat layer that the last finished batch left; ``authoritative`` as it was given to the stream."""
    return _layer(spark, state, authoritative, last_commit(spark, state))


def attachments_of(spark: SparkSession, state: str, target_attachments: DataFrame) -> DataFrame:
    """The attachments that the last finished batch left."""
    commit = last_commit(spark, state)
    if commit is None:
        return target_attachments
    return target_attachments.unionByName(_since(spark, state, "copies", target_attachments.schema, 0, commit.batch).drop("batch"))
