"""Reading feature layers and checking them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tiepoint.config import LayerConfig

POINT = "esriGeometryPoint"  # fixed value: how sources declare point layers
GEOMETRY = "struct<x:double,y:double,spatialReference:struct<wkid:int,latestWkid:int>>"


def page_files(spark: SparkSession, path: str, attributes: str | StructType) -> DataFrame:
    """A directory of JSON pages ``{"count", "features": [{"attributes", "geometry"}]}``: ``(file, declared, features, fault)``.

    ``attributes`` is the schema of a feature's attributes. ``fault`` says what is wrong with a page: it can't be
    read, it has no features, or not as many as it declares (``count`` may be missing).
    """
    kind = attributes if isinstance(attributes, str) else attributes.simpleString()
    if not kind.startswith("struct<"):
        kind = f"struct<{kind}>"
    schema = f"features array<struct<attributes:{kind},geometry:{GEOMETRY}>>, count bigint, unread string"
    pages = spark.read.schema(schema).option("columnNameOfCorruptRecord", "unread").json(path, multiLine=True)
    fault = F.when(F.col("unread").isNotNull(), "unreadable").when(F.col("features").isNull(), "no features").when(F.col("count") != F.size("features"), "incomplete")
    # a page that breaks off may have been read in part
    known = lambda name: F.when(F.col("unread").isNull(), F.col(name))
    return pages.select(F.col("_metadata.file_path").alias("file"), known("count").alias("declared"), known("features").alias("features"), fault.alias("fault"))


def page_counts(pages: DataFrame) -> DataFrame:
    """``(file, declared, found, fault)`` of each page."""
    return pages.select("file", "declared", F.coalesce(F.size("features"), F.lit(0)).cast("bigint").alias("found"), "fault")


def features_of(pages: DataFrame) -> DataFrame:
    """``(attributes, geometry)``; reading fails with the name of a page that has a fault, so that none is lost unseen."""
    refused = F.raise_error(F.concat(F.lit("page "), "file", F.lit(" is "), "fault"))
    return pages.select(F.inline(F.when(F.col("fault").isNotNull(), refused).otherwise(F.col("features"))))


def read_pages(spark: SparkSession, path: str, attributes: str | StructType) -> DataFrame:
    """The features of a directory of pages, none of which may have a fault."""
    return features_of(page_files(spark, path, attributes))


def check_count(features: DataFrame, declared: int) -> int:
    """Fail unless the layer has as many rows as its source declares."""
    found = features.count()
    if found != declared:
        raise RuntimeError(f"fetched {found} features, but the source declares {declared}")
    return found


def check_fields(features: DataFrame, required: list[str] | tuple[str, ...], layer: str = "layer") -> None:
    """Fail with the names of the required fields that a layer lacks."""
    have = features.schema["attributes"].dataType.names if "attributes" in features.columns else features.columns
    if missing := [n for n in dict.fromkeys(required) if n not in have]:
        raise ValueError(f"{layer} lacks required fields: {', '.join(missing)}")


def check_layer_pair(captured: DataFrame, authoritative: DataFrame, config: LayerConfig) -> None:
    """Fail unless both layers have the fields that a merge needs, and points."""
    ours, theirs = config.required_fields()
    for which, layer, required in (("captured", captured, ours), ("authoritative", authoritative, theirs)):
        check_fields(layer, required, f"{which} layer of {config.name}")
        check_points(layer)


def check_points(features: DataFrame, geometry_type: str | None = None) -> None:
    """Fail unless the layer holds points, by its declared type or else by the geometry's fields."""
    if geometry_type is not None:
        if geometry_type != POINT:
            raise ValueError(f"only point layers are supported, not {geometry_type}")
        return
    kind = features.schema["geometry"].dataType
    if not isinstance(kind, StructType) or not {"x", "y"} <= set(kind.names):
        raise ValueError("only point layers are supported: the geometry has no x and y")


def flatten(features: DataFrame) -> DataFrame:
    """One column for each attribute, and ``lon``, ``lat``: null unless the geometry is a whole point."""
    point = F.col("geometry.x").isNotNull() & F.col("geometry.y").isNotNull()
    return features.select(
        "attributes.*",
        F.when(point, F.col("geometry.x")).alias("lon"),
        F.when(point, F.col("geometry.y")).alias("lat"),
    )


def unflatten(flat: DataFrame) -> DataFrame:
    """A flat layer as ``(attributes, geometry)``."""
    names = [F.col(f"`{n}`") for n in flat.columns if n not in ("lon", "lat")]
    return flat.select(F.struct(*names).alias("attributes"), F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("geometry"))


def has_point() -> Column:
    return F.col("lon").isNotNull() & F.col("lat").isNotNull()


def with_points(flat: DataFrame) -> DataFrame:
    return flat.where(has_point())


def without_points(flat: DataFrame) -> DataFrame:
    return flat.where(~has_point())


def point_counts(flat: DataFrame) -> DataFrame:
    """Rows with and without a usable point."""
    return flat.agg(F.count_if(has_point()).alias("with_point"), F.count_if(~has_point()).alias("without_point"))
