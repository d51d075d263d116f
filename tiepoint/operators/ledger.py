"""State across runs: which captured rows are done and which records are taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def of_layer(ledger: DataFrame, layer: str) -> DataFrame:
    """A layer's own entries: captured ids and record ids of other layers mean other things."""
    return ledger.where(F.col("layer") == layer)


def unprocessed(captured: DataFrame, ledger: DataFrame, layer: str) -> DataFrame:
    """Captured rows whose ``GlobalID`` isn't in the layer's ledger; rows without one are never in it."""
    done = of_layer(ledger, layer).select(F.col("captured_global_id").alias("GlobalID"))
    return captured.join(done, "GlobalID", "left_anti").select(*captured.columns)


def claimed(ledger: DataFrame, layer: str) -> DataFrame:
    """Distinct records that any of the layer's entries has matched or created."""
    return of_layer(ledger, layer).where(F.col("authoritative_oid").isNotNull()).select(F.col("authoritative_oid").alias("OBJECTID")).distinct()


def unclaimed(authoritative: DataFrame, ledger: DataFrame, layer: str) -> DataFrame:
    return authoritative.join(claimed(ledger, layer), "OBJECTID", "left_anti").select(*authoritative.columns)


def _last(entries: DataFrame, *order: Column) -> DataFrame:
    last = Window.partitionBy("layer", "captured_global_id").orderBy(*order, F.desc("run_time"), F.desc("authoritative_oid"))
    return entries.where(F.col("captured_global_id").isNotNull()).withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


def latest(entries: DataFrame) -> DataFrame:
    """Of each layer and captured id the latest entry; those without a captured id can't be remembered."""
    return _last(entries)


def upsert(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """The ledger with ``entries`` written over it: of each layer and captured id the latest stays.

    Entries without a captured id can't be remembered and are left out.
    """
    both = ledger.withColumn("_new", F.lit(0)).unionByName(entries.select(*ledger.columns).withColumn("_new", F.lit(1)))
    return _last(both, F.desc("_new")).drop("_new")


def clear(ledger: DataFrame, report: DataFrame, layer: str) -> tuple[DataFrame, DataFrame]:
    """The ledger without the layer's rows of a rolled-back run, and the distinct ids that were really removed."""
    wrote = F.col("action").isin("updated", "appended") & F.col("captured_global_id").isNotNull()
    done = report.where(wrote).select(F.lit(layer).alias("layer"), "captured_global_id").distinct()
    key = ["layer", "captured_global_id"]
    return ledger.join(done, key, "left_anti").select(*ledger.columns), ledger.join(done, key, "left_semi").select("captured_global_id").distinct()
