"""Parameters of one layer, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fields that the system of record manages itself; never written, never compared.
EXCLUDED_FIELDS = ("OBJECTID", "GlobalID", "Shape", "SHAPE", "Creator", "CreationDate", "Editor", "EditDate")


@dataclass(frozen=True)
class LayerConfig:
    """How a captured layer is merged into an authoritative one.

    The two type fields go together: with them only rows of equal type match (null equals null).
    ``field_map`` renames captured fields.
    """

    name: str
    match_threshold_m: float
    field_map: dict[str, str] = field(default_factory=dict)
    copy_attachments: bool = False
    type_field_authoritative: str | None = None
    type_field_captured: str | None = None

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("a layer needs a name")
        if not self.match_threshold_m > 0:
            raise ValueError(f"match_threshold_m must be above 0, not {self.match_threshold_m}")
        if (self.type_field_authoritative is None) != (self.type_field_captured is None):
            raise ValueError("type_field_authoritative and type_field_captured go together: give both or neither")

    @property
    def typed(self) -> bool:
        return self.type_field_captured is not None

    def required_fields(self) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """Fields that the captured and the authoritative layer must have."""
        if self.typed:
            return ("OBJECTID", "GlobalID", self.type_field_captured), ("OBJECTID", "GlobalID", self.type_field_authoritative)
        return ("OBJECTID", "GlobalID"), ("OBJECTID", "GlobalID")
