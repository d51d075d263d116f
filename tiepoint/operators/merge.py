"""Write sets: what matched records gain, what is appended, and the layer after both.

Layers here are flat: one column for each field, with ``OBJECTID``, ``GlobalID``, ``lon`` and ``lat``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tiepoint.config import EXCLUDED_FIELDS, LayerConfig
from tiepoint.functions.values import is_blank
from tiepoint.sources.layers import flatten
from tiepoint.sources.storage import materialize

_PLACE = ("lon", "lat")


def field_pairs(captured: list[str], authoritative: list[str], field_map: dict[str, str]) -> list[tuple[str, str]]:
    """``(captured field, target field)`` to consider for filling, in order; of equal targets the later wins."""
    mapped = [(c, t) for c, t in field_map.items() if c in captured]
    same = [(c, c) for c in captured if c in authoritative and c not in field_map]
    return [(c, t) for c, t in mapped + same if t not in EXCLUDED_FIELDS and t not in _PLACE]


def _as(value: Column, kind: DataType) -> Column:
    return value.try_cast(kind)


def fills(captured: DataFrame, authoritative: DataFrame, field_map: dict[str, str], c: str = "c", a: str = "a") -> dict[str, Column]:
    """For each target field the value that a matched record gains, null if none; over aliases ``c`` and ``a``.

    A field is filled only where the record's own value is blank and the captured one is not. Values are
    cast to the record's type; what can't be cast fills nothing.
    """
    kinds = {f.name: f.dataType for f in authoritative.schema}
    ours = {f.name: f.dataType for f in captured.schema}
    found: dict[str, list[Column]] = {}
    for source, target in field_pairs(captured.columns, authoritative.columns, field_map):
        new = F.col(f"{c}.`{source}`")
        usable = ~is_blank(new, ours[source])
        if target in kinds:
            old = F.col(f"{a}.`{target}`")
            usable = usable & is_blank(old, kinds[target])
            new = _as(new, kinds[target]) if kinds[target] != ours[source] else new
        found.setdefault(target, []).append(F.when(usable, new))
    return {t: F.coalesce(*reversed(values)) for t, values in found.items()}


def plan_updates(matches: DataFrame, captured: DataFrame, authoritative: DataFrame, config: LayerConfig) -> DataFrame:
    """One row for each match: identity, the fields it gains, always the captured place, and the record as it was.

    ``matches`` has ``auth_oid``, the captured row as ``c`` and whatever else is to be carried along; of ``captured``
    only the schema is used. ``authoritative`` is ``(attributes, geometry)``.
    """
    gains = fills(captured, flatten(authoritative), config.field_map, a="attributes")
    carried = [n for n in matches.columns if n != "c"]
    joined = matches.join(authoritative.select("attributes", "geometry"), F.col("auth_oid") == F.col("attributes.OBJECTID"))
    return joined.select(
        *carried, F.col("c.GlobalID").alias("captured_global_id"), F.col("attributes.GlobalID").alias("GlobalID"),
        F.col("c.lon").alias("lon"), F.col("c.lat").alias("lat"), F.struct(*(v.alias(t) for t, v in gains.items())).alias("fills"), "attributes", "geometry",
    )


def long_fills(updates: DataFrame) -> DataFrame:
    """``(oid, field, value)``: one row for each field that a record gains, values as strings."""
    names = updates.schema["fills"].dataType.names
    pairs = F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"fills.`{n}`").cast("string").alias("value")) for n in names))
    return updates.select(F.col("auth_oid").alias("oid"), F.explode(pairs).alias("p")).where("p.value is not null").select("oid", "p.field", "p.value")


def plan_appends(unmatched: DataFrame, config: LayerConfig) -> DataFrame:
    """Captured rows as new records: every field under its target's name, managed fields left out, and the
    type field filled from the captured type. Of equal targets the later wins, even if it is null.

    ``unmatched`` has the captured row as ``c``, and what else is to be carried along."""
    targets: dict[str, Column] = {}
    for name in unmatched.schema["c"].dataType.names:
        target = config.field_map.get(name, name)
        if target not in EXCLUDED_FIELDS and name not in _PLACE:
            targets[target] = F.col(f"c.`{name}`")
    if config.typed and config.type_field_authoritative not in EXCLUDED_FIELDS:
        targets[config.type_field_authoritative] = F.col(f"c.`{config.type_field_captured}`")
    return unmatched.select(
        F.col("c.OBJECTID").alias("cap_oid"), F.col("c.GlobalID").alias("captured_global_id"),
        *(v.alias(t) for t, v in targets.items()), *(F.col(f"c.{n}").alias(n) for n in _PLACE), *(n for n in unmatched.columns if n != "c"),
    )


def updated(updates: DataFrame) -> DataFrame:
    """The updated records, flat: as they were, with the gained fields and the captured place."""
    names = updates.schema["fills"].dataType.names
    old = updates.schema["attributes"].dataType.names
    kept = [(F.coalesce(F.col(f"fills.`{n}`"), F.col(f"attributes.`{n}`")) if n in names else F.col(f"attributes.`{n}`")).alias(n) for n in old]
    return updates.select(*kept, *_PLACE, *(F.col(f"fills.`{n}`").alias(n) for n in names if n not in old))


def allocate_ids(rows: DataFrame, key: str, start: int, name: str = "new_oid", ranges: int | None = None) -> DataFrame:
    """``rows`` with ids ``start + 1``, ``start + 2``, ... in order of ``key``, which must be unique; a stored table.

    Rows are sorted by ranges of the key and stored with their place in their range; the ranges' sizes give what
    lies before each. Ranges and their sizes both grow with the square root of the rows.
    """
    if ranges is None:
        ranges = max(1, math.isqrt(rows.count()) // 32)
    place = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(ranges, key).sortWithinPartitions(key)
    placed = materialize(ranged.select("*", F.shiftright(place, 33).alias("_range"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")), "ids")
    sizes = placed.groupBy("_range").agg(F.count("*").alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    # a row for each range
    return placed.join(F.broadcast(offsets), "_range").select(*rows.columns, (F.lit(start) + F.col("_offset") + F.col("_place") + 1).cast("long").alias(name))


def append(layer: DataFrame, appends: DataFrame) -> DataFrame:
    """The layer and the new records (``new_oid`` becomes ``OBJECTID``)."""
    rows = appends.withColumn("OBJECTID", F.col("new_oid")).drop("new_oid", "cap_oid", "captured_global_id", "action_id")
    return layer.unionByName(rows, allowMissingColumns=True)


def replaced(layer: DataFrame, changed: DataFrame) -> DataFrame:
    """The layer with ``changed`` in place of the records that share their ids."""
    ids = changed.select("OBJECTID")
    return layer.join(ids, "OBJECTID", "left_anti").select(*layer.columns).unionByName(changed, allowMissingColumns=True)


def write_results(planned: DataFrame, results: DataFrame) -> DataFrame:
    """Planned writes with ``success``, ``result_oid`` and ``error``, joined by ``action_id``.

    ``results`` has ``action_id, object_id, global_id, success, error``. The id is the object id or else the
    global id (0 and empty count as none); an error is shown for failures only; a plan without a result failed.
    """
    ok = F.coalesce(F.col("r.success"), F.lit(False))
    oid = F.coalesce(F.nullif(F.col("r.object_id").cast("string"), F.lit("0")), F.nullif(F.col("r.global_id"), F.lit("")))
    return planned.alias("p").join(results.alias("r"), F.col("p.action_id") == F.col("r.action_id"), "left").select(
        "p.*", ok.alias("success"), oid.alias("result_oid"), F.when(~ok, F.coalesce(F.col("r.error"), F.lit("no result"))).alias("error")
    )
