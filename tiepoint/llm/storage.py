"""Tables that cut lineage, as elsewhere in the library, and such in buckets."""

import uuid

from pyspark.sql import DataFrame

from tiepoint.sources.storage import materialize, new_path, shared_dir, table

__all__ = ["in_buckets", "materialize", "new_path", "shared_dir", "table"]


def in_buckets(rows: DataFrame, n: int, by: str, name: str) -> DataFrame:
    """``rows`` stored in the shared folder in ``n`` buckets by a column, so that grouping by it and more doesn't shuffle.

    Only tables of the catalog can have buckets: the name is dropped once the files are known."""
    spark = rows.sparkSession
    label = f"tiepoint_{uuid.uuid4().hex}"
    try:
        rows.write.bucketBy(n, by).option("path", new_path(spark, name)).saveAsTable(label)
        return spark.table(label)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {label}")
