"""Settings of one data source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, fields

from ..operators.ellipses import EllipseConfig
from ..table import DATE, KINDS

# Limits of a source.
DELIMITERS = (",", ";", "\t")
GEOMETRY_MODES = ("xy", "wkt", "geojson")
PAGING_ENDS = ("empty", "short")
MAX_PAGE_SIZE, MAX_PARALLEL = 100_000, 100


@dataclass(frozen=True)
class SourceConfig:
    """A CSV file or a paged feature service, with its load rules."""

    id: str = ""
    name: str = "Dataset"
    enabled: bool = True
    type: str = "service"
    # CSV
    path: str = ""
    delimiter: str = ","
    geometry_mode: str = "xy"
    longitude_field: str = ""
    latitude_field: str = ""
    field_types: Mapping[str, str] = field(default_factory=dict)
    # service
    url: str = ""
    layer: str = ""
    version: str = "2.0.0"
    format: str = "application/json"
    srs: str = "urn:ogc:def:crs:OGC:1.3:CRS84"
    axis: str = "xy"
    sort: str = ""
    page_size: int = 50_000
    max_parallel_requests: int = 10
    paging_end: str = "empty"
    limit: int | None = None  # everything
    # both
    time_field: str = ""
    geometry_field: str = ""
    load_rules: Sequence[Mapping] = ()
    # uncertainty ellipses: all three attributes or none
    major_field: str = ""
    minor_field: str = ""
    orientation_field: str = ""
    major_unit: str = "m"
    minor_unit: str = "m"

    def ellipses(self) -> EllipseConfig | None:
        """Attributes and units of the ellipses, if the source has any."""
        chosen = EllipseConfig(self.major_field, self.minor_field, self.orientation_field, self.major_unit, self.minor_unit)
        return chosen if chosen.major else None

    def check(self) -> "SourceConfig":
        """Raise on the first setting that cannot work."""
        if not all(isinstance(n, str) for n in (self.major_field, self.minor_field, self.orientation_field)):
            raise ValueError("Ellipse attributes are given by name")
        self.ellipses()
        if self.type == "csv":
            check_type_overrides(self.field_types, None, self.time_field)
            if not self.path:
                raise ValueError("path is empty")
            if self.delimiter not in DELIMITERS:
                raise ValueError(f"delimiter is one of {DELIMITERS}")
            if self.geometry_mode not in GEOMETRY_MODES:
                raise ValueError(f"geometry_mode is one of {GEOMETRY_MODES}")
            mapped = (self.longitude_field and self.latitude_field) if self.geometry_mode == "xy" else self.geometry_field
            if not mapped:
                raise ValueError("No columns are named for the geometry")
            return self
        if self.type != "service":
            raise ValueError(f"type is service or csv, not {self.type!r}")
        if not self.layer.strip():
            raise ValueError("layer is empty")
        if self.paging_end not in PAGING_ENDS:
            raise ValueError(f"paging_end is one of {PAGING_ENDS}")
        for label, value, most in (("Features per request", self.page_size, MAX_PAGE_SIZE),
                                   ("Maximum parallel requests", self.max_parallel_requests, MAX_PARALLEL),
                                   ("Point limit", 1 if self.limit is None else self.limit, None)):
            if isinstance(value, bool) or not isinstance(value, int) or value < 1 or most is not None and value > most:
                raise ValueError(f"{label}: expected a whole number of at least 1" + (f" and at most {most:,}" if most else ""))
        return self

    def to_dict(self) -> dict:
        out = asdict(self)
        out["field_types"], out["load_rules"] = dict(self.field_types), [dict(r) for r in self.load_rules]
        return out

    @classmethod
    def from_dict(cls, saved: Mapping) -> "SourceConfig":
        """Read saved settings; anything an older file lacks gets its default."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in saved.items() if k in known})


def check_type_overrides(overrides: Mapping[str, str], headers: Sequence[str] | None = None, time_field: str = "") -> None:
    """Overrides name existing columns and known kinds; the time column stays a date."""
    if any(kind not in KINDS for kind in overrides.values()):
        raise ValueError(f"field_types are of {KINDS}")
    if time_field and overrides.get(time_field, DATE) != DATE:
        raise ValueError(f"field_types make {time_field} something else than a time")
    for name in overrides:
        if headers is not None and name not in headers:
            raise ValueError(f"field_types name {name}, which is no column")
