"""Runs as they were written: all artifacts of a run under one directory, seen only once the run is finished.

``store/layer=L/run_ts=T/`` holds a run's parts: ``snapshot`` (records before the edit), ``layer`` and
``attachments`` (afterwards), ``report`` (CSV), ``ledger`` (the layer's entries afterwards), and for a rollback
``audit``. ``store/finished`` has a file of one row for each finished run, written last. What a run has written
before that is never read; the same run may then be written again. So report and snapshot of a run belong
together by their place, and a rollback needs no more than the run's time.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .artifacts import LEDGER, read_report, write_audit, write_report
from .storage import empty

FINISHED = "layer string, run_ts string, kind string, undoes string, source string, previous string"
_NAME = re.compile("[0-9A-Za-z_.-]+")


def check_name(what: str, name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"{what} {name!r} can't name a directory: letters, digits, '_', '.', '-' only")
    return name


def place(store: str, layer: str, run_ts: str, part: str) -> str:
    return f"{store}/layer={check_name('layer', layer)}/run_ts={check_name('run_ts', run_ts)}/{part}"


def runs_of(spark: SparkSession, store: str, layer: str | None = None) -> DataFrame:
    """Finished runs: ``(layer, run_ts, kind, undoes, source, previous)``; ``previous`` is the run that each built on."""
    try:
        rows = spark.read.schema(FINISHED).option("recursiveFileLookup", True).json(f"{store}/finished")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = empty(spark, FINISHED)
    return rows if layer is None else rows.where(F.col("layer") == layer)


def run_of(spark: SparkSession, store: str, layer: str, run_ts: str):
    """The row of a finished run; an error where there is none."""
    found = runs_of(spark, store, layer).where(F.col("run_ts") == run_ts).collect()
    if not found:
        raise ValueError(f"{layer} has no finished run {run_ts!r}")
    return found[0]


def latest(spark: SparkSession, store: str, layer: str) -> str | None:
    """The finished run that no other builds on: the state of the layer."""
    rows = runs_of(spark, store, layer)
    built_on = rows.where("previous is not null").select(F.col("previous").alias("run_ts"))
    ends = [r.run_ts for r in rows.join(built_on, "run_ts", "left_anti").select("run_ts").collect()]
    if len(ends) > 1:
        raise RuntimeError(f"{layer} has runs that don't follow one another: {', '.join(sorted(ends))}")
    return ends[0] if ends else None


def write_tables(store: str, layer: str, run_ts: str, /, **parts: DataFrame | None) -> None:
    for part, rows in parts.items():
        if rows is not None:
            rows.write.mode("overwrite").parquet(place(store, layer, run_ts, part))


def write_run_report(store: str, layer: str, run_ts: str, report: DataFrame) -> None:
    write_report([report], place(store, layer, run_ts, "report"), mode="overwrite")


def write_run_audit(store: str, layer: str, run_ts: str, record: DataFrame, results: DataFrame) -> None:
    write_audit(record, results, place(store, layer, run_ts, "audit"), mode="overwrite")


def finish(spark: SparkSession, store: str, layer: str, run_ts: str, kind: str, source: str | None, previous: str | None, undoes: str | None = None) -> None:
    """From now on the run is seen."""
    row = spark.createDataFrame([(layer, run_ts, kind, undoes, source, previous)], FINISHED).coalesce(1)
    row.write.mode("overwrite").json(f"{store}/finished/{layer}/{run_ts}")


def part_of(spark: SparkSession, store: str, layer: str, run_ts: str, part: str) -> DataFrame:
    """A table of a finished run."""
    run_of(spark, store, layer, run_ts)
    path = place(store, layer, run_ts, part)
    if part == "report":
        return read_report(spark, path)
    if part == "ledger":
        return spark.read.schema(LEDGER).parquet(path)
    return spark.read.parquet(path)
