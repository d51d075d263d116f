"""Scalar rules on attribute values, names and statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from tiepoint.config import EXCLUDED_FIELDS

FEET_PER_METRE = 3.28084  # fixed value
_BLANK = r"(?U)\A[\s\x1c-\x1f]*\z"  # the white space that a Unicode-aware strip removes


def is_blank(value: Column, kind: DataType) -> Column:
    """Null, or a string of white space only. Zero, false and NaN are values."""
    return value.isNull() | F.coalesce(value.rlike(_BLANK), F.lit(False)) if isinstance(kind, StringType) else value.isNull()


def writable(names: list[str]) -> list[str]:
    """Names without the fields that are never written or compared."""
    return [n for n in names if n not in EXCLUDED_FIELDS]


def threshold_text(value: Column, units: Column) -> Column:
    """A length in its own unit and, in brackets, the other: ``1.00 m (3.28 ft)``. Other units are an error."""
    unit = F.lower(units)
    return (
        F.when(unit == "meters", F.format_string("%.2f m (%.2f ft)", value, value * FEET_PER_METRE))
        .when(unit == "feet", F.format_string("%.2f ft (%.2f m)", value, value / FEET_PER_METRE))
        .otherwise(F.raise_error(F.concat(F.lit("source_units must be 'meters' or 'feet', not "), F.coalesce(units, F.lit("null")))))
    )


def feature_name(global_id: Column) -> Column:
    """The id of a feature without braces and dashes."""
    return F.replace(F.regexp_replace(F.coalesce(global_id, F.lit("")), r"^[{}]+|[{}]+$", ""), F.lit("-"), F.lit(""))


def file_name(feature: Column, attachment_id: Column, name: Column) -> Column:
    """``<feature>_att<id>_<file name>``; of a path the part after the last slash."""
    return F.concat(feature, F.lit("_att"), attachment_id.cast("string"), F.lit("_"), F.substring_index(name, "/", -1))


def attachment_name(global_id: Column, attachment_id: Column, name: Column) -> Column:
    """Name on the target: ``<id of the feature without braces and dashes>_att<id>_<file name>``."""
    return file_name(feature_name(global_id), attachment_id, name)


def fully_copied(status: Column) -> Column:
    """Whether a status ``n/m`` says that all were copied; null and anything else are false."""
    parts = F.split(status, "/", -1)
    number = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("bigint")
    return F.coalesce((F.size(parts) == 2) & (number(0) == number(1)), F.lit(False))


def oid_of(text: Column) -> Column:
    """The id that a report cell holds; null if it isn't a whole number."""
    return F.trim(text).try_cast("bigint")


def ids_of(json: Column) -> Column:
    """A JSON list of ids; anything else is an empty list."""
    return F.coalesce(F.from_json(json, "array<bigint>"), F.array().cast("array<bigint>"))


def wkid(geometry: Column) -> Column:
    """The coordinate system of a geometry, the latest code where the first is missing or 0."""
    reference = geometry["spatialReference"]
    return F.coalesce(F.nullif(reference["wkid"], F.lit(0)), reference["latestWkid"])
