"""Forms of the ledger, snapshots, reports and the audit record; ``run_store`` keeps those of a run together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType
from pyspark.sql.utils import AnalysisException

LEDGER = "layer string, captured_global_id string, action string, authoritative_oid bigint, attachments_status string, run_time string"
ENTRY = "struct<action:string,authoritative_oid:bigint,attachments_status:string,run_time:string>"

# The columns of both kinds of report, in order.
PLAN_COLUMNS = ("captured_global_id", "action", "matched_authoritative_oid", "distance_m", "threshold_m", "candidates_json", "assignment_overridden_nearest", "layer")
OUTCOME_COLUMNS = (
    "captured_global_id", "action", "authoritative_oid", "distance_m", "threshold_m", "success", "error",
    "attachments_status", "attachments_added", "ledgered", "candidates_json", "assignment_overridden_nearest", "layer",
)


# ---- ledger --------------------------------------------------------------------------------------


def read_ledger(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """The ledger; an empty one where nothing has been written."""
    try:
        rows = spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], LEDGER)
    return rows if layer is None else rows.where(F.col("layer") == layer)


def write_ledger(ledger: DataFrame, path: str) -> None:
    """Write to a new ``path``; the old ledger, if any, stays as it is."""
    ledger.select("layer", "captured_global_id", "action", "authoritative_oid", "attachments_status", "run_time").write.parquet(path)


def import_ledger(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """A ledger kept as one JSON object by captured id."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", f"map<string,{ENTRY}>")).alias("captured_global_id", "e"))
    return rows.select(F.lit(layer).alias("layer"), "captured_global_id", "e.*")


# ---- snapshots -----------------------------------------------------------------------------------


def write_snapshot(rows: DataFrame, path: str, layer: str, source: str, run_ts: str) -> DataFrame:
    """Write ``(oid, attributes, geometry)`` before any edit, and return what was written."""
    named = rows.withColumns({"layer": F.lit(layer), "source": F.lit(source)})
    to = f"{path}/run_ts={run_ts}"
    named.write.parquet(to)
    return rows.sparkSession.read.parquet(to)


def read_snapshot(spark: SparkSession, path: str, json: bool = False) -> DataFrame:
    """``(oid, attributes, geometry, layer, source)``; JSON documents may also be a bare list of entries."""
    if not json:
        return spark.read.parquet(path)
    raw = spark.read.json(path, multiLine=True)
    if "entries" in raw.columns and isinstance(raw.schema["entries"].dataType, ArrayType):
        for name in ("layer", "authoritative_url"):
            if name not in raw.columns:
                raw = raw.withColumn(name, F.lit(None).cast("string"))
        own = raw.select("layer", F.col("authoritative_url").alias("source"), F.explode("entries").alias("e"))
        return own.select("e.*", "layer", "source")
    return raw.withColumns({"layer": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})


# ---- reports -------------------------------------------------------------------------------------


def write_report(parts: list[DataFrame], path: str, mode: str = "error") -> None:
    """One CSV report with the columns of all ``parts``; what a part lacks, and nulls, are empty cells."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    whole.write.mode(mode).csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """All cells as strings."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, inferSchema=False)


def write_audit(record: DataFrame, results: DataFrame, path: str, mode: str = "error") -> None:
    """A rollback's one-row record in ``path/record`` and its results in ``path/results``, as JSON with nulls."""
    counts = ("authoritative_feature_count_after", "expected_feature_count_after")
    checked = record.withColumn("feature_count_matches_expected", F.col(counts[0]) == F.col(counts[1]))
    checked.write.mode(mode).json(f"{path}/record", ignoreNullFields=False)
    results.write.mode(mode).json(f"{path}/results", ignoreNullFields=False)


def attributes_of(schema: StructType) -> list[str]:
    return schema["attributes"].dataType.names
