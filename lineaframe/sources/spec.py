"""Datasets: which source fields are read, and how they become columns."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from lineaframe.plans.types import Field, Kind, Schema, parse_stamp


class Role(Enum):
    """What a column is made of; each role has its own cleaning rules."""

    KEY = "key"
    CREATED = "created"
    TIME = "time"
    TEXT = "text"
    POINT = "point"

    @property
    def kind(self) -> Kind:
        return {
            Role.KEY: Kind.INTEGER, Role.CREATED: Kind.TIMESTAMP, Role.TIME: Kind.TIMESTAMP, Role.TEXT: Kind.TEXT, Role.POINT: Kind.LOCATION,
        }[self]

    @property
    def accepted(self) -> tuple[str, ...]:
        """Types the source may declare for its fields."""
        return {Role.KEY: ("text", "number"), Role.TEXT: ("text",), Role.POINT: ("number",)}.get(self, ("calendar_date",))


@dataclass(frozen=True)
class Column:
    name: str
    role: Role
    fields: tuple[str, ...]
    description: str


@dataclass(frozen=True)
class Area:
    """A loose box around a dataset's area; places outside it are counted, never dropped."""

    issue: str
    name: str
    lat: tuple[float, float]
    lon: tuple[float, float]


@dataclass(frozen=True)
class Scope:
    """Rows created from ``gte`` up to, not including, ``lt``."""

    column: str
    gte: str
    lt: str

    @staticmethod
    def dates(column: str, start: str, end: str) -> Scope:
        scope = Scope(column, f"{start}T00:00:00", f"{end}T00:00:00")
        low, high = scope.bounds()
        if low >= high:
            raise ValueError(f"scope is empty: {start} is not before {end}")
        return scope

    def bounds(self) -> tuple[int, int]:
        found = [parse_stamp(self.gte), parse_stamp(self.lt)]
        for text, value in zip((self.gte, self.lt), found, strict=True):
            if value is None:
                raise ValueError(f"invalid scope bound {text!r}")
        return found[0], found[1]

    def soql(self) -> str:
        return f"{self.column} >= '{self.gte}' AND {self.column} < '{self.lt}'"


@dataclass(frozen=True)
class Dataset:
    source_id: int
    title: str
    portal: str
    dataset_id: str
    source_url: str
    terms_url: str
    scope_sentence: str
    area: Area
    columns: tuple[Column, ...]
    left_out: tuple[tuple[str, str], ...]

    @property
    def fields(self) -> list[str]:
        return [f for c in self.columns for f in c.fields]

    @property
    def key_field(self) -> str:
        return next(c.fields[0] for c in self.columns if c.role is Role.KEY)

    def column(self, role: Role) -> Column:
        return next(c for c in self.columns if c.role is role)

    def schema(self) -> Schema:
        required = (Role.KEY, Role.CREATED)
        return Schema.of(Field(c.name, c.role.kind, c.role not in required) for c in self.columns)


def _text(name: str, description: str, field: str | None = None) -> Column:
    return Column(name, Role.TEXT, (field or name,), description)


#: Names of columns and fields, places and addresses of the two datasets.
NYC_311 = Dataset(
    source_id=1,
    title="NYC 311 Service Requests",
    portal="data.cityofnewyork.us",
    dataset_id="erm2-nwe9",
    source_url="https://data.cityofnewyork.us/Social-Services/311-Service-Requests-from-2010-to-Present/erm2-nwe9",
    terms_url="https://opendata.cityofnewyork.us/overview/#termsofuse",
    scope_sentence="311 service requests created from {from} up to (not including) {to}, NYC local time.",
    area=Area("KI-location-outside-nyc", "New York City", (40.45, 40.95), (-74.30, -73.65)),
    columns=(
        Column("unique_key", Role.KEY, ("unique_key",), "Number the city gave the request."),
        Column("created_date", Role.CREATED, ("created_date",), "Local time at which the request was made."),
        Column("closed_date", Role.TIME, ("closed_date",), "Local time at which it was marked closed, as published."),
        _text("agency", "Agency that deals with it."),
        _text("complaint_type", "Kind of problem."),
        _text("descriptor", "Kind of problem in more detail."),
        _text("location_type", "Kind of place."),
        _text("incident_zip", "ZIP code, as published."),
        _text("borough", "Borough; 'Unspecified' is the city's own word."),
        _text("community_board", "Community board."),
        _text("status", "Status at the time of the fetch."),
        _text("channel", "Way in which the request came.", "open_data_channel_type"),
        Column("location", Role.POINT, ("latitude", "longitude"), "Place of the problem."),
    ),
    left_out=tuple(
        (field, reason)
        for reason, names in (
            ("free text", "resolution_description landmark"),
            ("address text", "incident_address street_name cross_street_1 cross_street_2 intersection_street_1 intersection_street_2 address_type"),
            ("says what a kept column says", "city agency_name x_coordinate_state_plane y_coordinate_state_plane park_borough location"),
            ("mostly empty or of one domain only", "facility_type due_date bbl park_facility_name vehicle_type taxi_company_borough "
             "taxi_pick_up_location bridge_highway_name bridge_highway_direction road_ramp bridge_highway_segment"),
            ("no question needs it", "resolution_action_updated_date"),
        )
        for field in names.split()
    ),
)

#: Organizations that answer for towns, and the towns.
TOWNS = {
    "Mount Pleasant, NY": "Mount Pleasant",
    "Greenburgh, NY": "Greenburgh",
    "Public Works Issues": "Mount Vernon",
    "Housing Code Violations": "Mount Vernon",
    "Operation Better Living": "Mount Vernon",
    "North Castle, NY": "North Castle",
    "Peekskill, NY": "Peekskill",
}

WESTCHESTER = Dataset(
    source_id=2,
    title="SeeClickFix requests, Westchester towns",
    portal="seeclickfix.com",
    dataset_id="westchester-towns",
    source_url="https://seeclickfix.com/",
    terms_url="https://seeclickfix.com/terms",
    scope_sentence=(
        "SeeClickFix requests to Mount Pleasant, Greenburgh, Mount Vernon, North Castle and Peekskill created from {from} "
        "up to (not including) {to}, New York local time."
    ),
    area=Area("KI-location-outside-westchester", "Westchester County", (40.88, 41.37), (-73.99, -73.48)),
    columns=(
        Column("unique_key", Role.KEY, ("id",), "Number of the request."),
        Column("created_date", Role.CREATED, ("created_at",), "Local time at which the request was made."),
        Column("closed_date", Role.TIME, ("closed_at",), "Local time at which it was marked closed, as published."),
        _text("town", "Town that deals with it."),
        _text("complaint_type", "Kind of problem.", "request_type"),
        _text("status", "Status at the time of the fetch."),
        _text("incident_zip", "ZIP code of the address.", "zip"),
        Column("location", Role.POINT, ("lat", "lng"), "Place of the problem."),
    ),
    left_out=(
        ("summary", "says what a kept column says"), ("description", "free text"), ("address", "address text"),
        ("reporter", "personal"), ("media", "photos"), ("acknowledged_at", "no question needs it"),
    ),
)

DATASETS = {"nyc311": NYC_311, "westchester": WESTCHESTER}


class Drift(Exception):
    """The source is no longer what the dataset expects (CR-01); the build stops."""


def check_metadata(spec: Dataset, columns: list[dict]) -> None:
    """Every field is there with a type the dataset accepts; all problems are named at once."""
    declared = {c["fieldName"]: c["dataTypeName"] for c in reversed(columns)}
    problems = []
    for c in spec.columns:
        for f in c.fields:
            if f not in declared:
                problems.append(f'field "{f}" is missing')
            elif declared[f] not in c.role.accepted:
                problems.append(f'field "{f}" has type "{declared[f]}", expected one of {list(c.role.accepted)}')
    if problems:
        raise Drift(f"CR-01 schema drift in {spec.dataset_id}: {'; '.join(problems)}")
