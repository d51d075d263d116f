"""Token ids in Parquet: list columns, controlled row groups, page indexes.

File format. One directory of Parquet files in ascending ``doc_id`` order (``part_no`` counts them),
one row for each document:

=============  ============  =============================================================
doc_id         long          as in the input
part_no        int           number of the file
local_start    long          ids of the documents before it in its file
n_tokens       long          ids, the end id included
ids            array<int>    the ids; dictionary pages (the vocabulary is small and repeats)
=============  ============  =============================================================

The metadata columns are delta encoded (format version 2). Row groups and pages have set sizes and the
writer adds page indexes, so a filter on ``doc_id`` reads a few pages and metadata reads skip ``ids``.

Cases: a null text is an empty one and gives the end id alone; a null ``doc_id`` sorts first; rows that
repeat are all written, equal ``doc_id``s in order of their text's hash; an empty table gives an empty
directory of files; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import new_path
from .tokens import encoded

SCHEMA = "doc_id long, part_no int, local_start long, n_tokens long, ids array<int>"
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PARTITION_BYTES = 32 << 20  # of input text for each file, about


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, partition_bytes: int = PARTITION_BYTES) -> None:
    """Encode ``docs(doc_id, text)`` whole and write the files, as many as ``partition_bytes`` of text for each
    give. Texts are shuffled once, by range."""
    n = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // partition_bytes))
    order = [F.col("doc_id"), F.col("tie")]
    ranged = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
        .repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", F.spark_partition_id().alias("part_no"), "text")
    )

    def encode(batches):
        start = 0
        for batch in batches:
            for piece, ids, offsets in encoded(batch, "text", tokenizer, end_id):
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        piece.column("part_no"),
                        pa.array(start + offsets[:-1]),
                        pa.array(np.diff(offsets)),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view("<i4"))),
                    ],
                    names=["doc_id", "part_no", "local_start", "n_tokens", "ids"],
                )
                start += int(offsets[-1])

    (
        ranged.mapInArrow(encode, SCHEMA)
        .write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", 20_000)
        .option("maxRecordsPerFile", 0)
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows, lazily; select or filter as usual: pages that aren't needed aren't read."""
    return spark.read.schema(SCHEMA).parquet(path)


def with_starts(files: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Add ``start``: the ids of all documents before the row's own.

    A row for each file is gathered and broadcast: 16 bytes for every ``PARTITION_BYTES`` of text.
    """
    totals = (metadata if metadata is not None else files).groupBy("part_no").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part_no", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return files.join(F.broadcast(offsets), "part_no").withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def ids_crc32(files: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep`` and ``ids_crc32`` over the ids as little-endian unsigned 32-bit integers."""

    def crc(batches):
        for batch in batches:
            ids = batch.column("ids")
            values = memoryview(ids.values.to_numpy(zero_copy_only=False)).cast("B")
            offsets = (ids.offsets.to_numpy().astype(np.int64) * 4).tolist()
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(crcs, pa.int64())], names=[*keep, "ids_crc32"])

    kept = files.select(*keep, "ids")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name != "ids")
    return kept.mapInArrow(crc, f"{schema}, ids_crc32 long")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .storage import table

    path = new_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    files = read_tokens(spark, path)
    return ids_crc32(with_starts(files), "doc_id", "start", "n_tokens")
