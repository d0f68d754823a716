"""Raw records to clean rows, as one DataFrame pipeline; every change and rejection is logged.

Rules, in the order in which they can take a record out: CR-02 (no usable key),
CR-03 and CR-04 (several records with one key, alike or not), CR-05 (no
readable creation time), CR-12 (outside the scope). CR-06 to CR-09 change
values, CR-10 and CR-11 only count.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineaframe.plans.types import format_stamp
from lineaframe.sources.spec import Dataset, Drift, Role, Scope
from lineaframe.sources.tables import RID, number_rows
from lineaframe.storage import keep

RULES_VERSION = 1
#: Keys that repeat are broadcast up to this many.
BROADCAST_KEYS = 1_000_000
#: For each rule: what it does, whether each case is logged, and when it applies.
RULES: dict[str, tuple[str, bool, str]] = {
    "CR-01": ("fail", False, "A field is missing or of another type: the build stops."),
    "CR-02": ("reject", False, "The record has no key that is a positive whole number without leading zeros."),
    "CR-03": ("reject", False, "Another record has the same key and the same values; one of them is kept."),
    "CR-04": ("reject", False, "Records with the same key differ; none can be preferred, so all are rejected."),
    "CR-05": ("reject", False, "The creation time is missing or can't be read."),
    "CR-06": ("null", True, "A closing time can't be read and becomes missing."),
    "CR-07": ("normalize", True, "Spaces around a text were removed."),
    "CR-08": ("null", True, "A text was empty and becomes missing."),
    "CR-09": ("null", True, "A coordinate is missing or can't be read, so the place becomes missing."),
    "CR-10": ("normalize", False, "Coordinates are kept in single precision."),
    "CR-11": ("normalize", False, "Fractions of a second are kept."),
    "CR-12": ("reject", False, "The creation time is outside the scope."),
}

_SPACE = " \t\n\f\r"
_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?$"


class Cleaned:
    """``rows``: row number and ``c0, c1, ...``. The log and the rejects are numbered when they are first asked for."""

    def __init__(self, spec: Dataset, rows: DataFrame, log: DataFrame, rejects: DataFrame) -> None:
        self.spec, self.rows, self._log, self._rejects = spec, rows, log, rejects

    @cached_property
    def log(self) -> DataFrame:
        return number_rows(self._log, ["row_index", "column", "rule_id", "raw_value"], "log_index")

    @cached_property
    def rejects(self) -> DataFrame:
        return number_rows(self._rejects, [F.col("raw_unique_key").asc_nulls_first(), "rule_id", "raw_record"], "reject_index")

    @cached_property
    def counts(self) -> dict[str, int]:
        """How often each rule applied."""
        return _counts(self.rows, self._log, self._rejects, self.spec)


def read_time(text: Column) -> Column:
    """Strict: the exact format and a real date, or null."""
    return F.when(text.rlike(_TIME), F.replace(text, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz"))


def _number(text: Column) -> Column:
    value = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def records_of(pages: DataFrame) -> DataFrame:
    """``raw``, one record's JSON exactly as fetched, from pages that are JSON arrays (column ``value``)."""
    return pages.select(F.explode(F.from_json("value", "array<string>")).alias("raw"))


def _parsed(records: DataFrame, spec: Dataset) -> DataFrame:
    fields = ", ".join(f"`{f}` string" for f in spec.fields)
    values = records.withColumn("f", F.from_json("raw", f"struct<{fields}>".replace(" string", ": string")))
    shape = F.try_parse_json("raw")
    for f in spec.fields:
        kind = F.schema_of_variant(F.try_variant_get(shape, f"$['{f}']", "variant"))
        odd = kind.rlike("^(BOOLEAN|ARRAY|OBJECT)")
        problem = F.concat(F.lit(f'CR-01: field "{f}" has non-scalar value '), F.col("f").getField(f))
        values = values.withColumn(f"q_{f}", F.when(odd, F.raise_error(problem).cast("boolean")).otherwise(kind == "STRING"))
    return values


def _raw_token(f: str) -> Column:
    """A field as the JSON has it."""
    text = F.col("f").getField(f)
    return F.when(text.isNull(), F.lit("null")).when(F.col(f"q_{f}"), F.to_json(F.array(text)).substr(F.lit(2), F.length(F.to_json(F.array(text))) - 2)).otherwise(text)


def clean(records: DataFrame, spec: Dataset, scope: Scope) -> Cleaned:
    """Apply the rules to ``records`` (one column ``raw``).

    Keys that repeat are found by counts, combined before the shuffle; only
    their records are looked at together, and alike ones are counted, so a key
    with very many records is as parallel as any. Empty input gives empty tables.
    """
    low, high = (F.lit(format_stamp(t).replace("T", " ")).cast("timestamp_ntz") for t in scope.bounds())
    parsed = _parsed(records, spec)
    key_text = F.col("f").getField(spec.key_field)
    key = F.when(key_text.rlike("^[1-9][0-9]*$"), key_text.try_cast("bigint"))
    columns, logs = [], []
    for i, c in enumerate(spec.columns):
        value, log = _cleaned(c.role, c.fields, i)
        columns.append((key if c.role is Role.KEY else value).alias(f"c{i}"))
        logs += log
    nothing = F.array().cast("array<struct<column:int,rule_id:string,raw_value:string>>")
    entries = F.filter(F.array(*logs), lambda e: e.isNotNull()) if logs else nothing
    same = F.sha2(F.concat_ws("\x1f", *[_raw_token(f) for f in spec.fields]).cast("binary"), 256)
    created = F.col(f"c{spec.columns.index(spec.column(Role.CREATED))}")
    staged = parsed.select("raw", key_text.alias("key_text"), key.alias("key"), same.alias("same"), F.sha2(F.col("raw").cast("binary"), 256).alias("print"), *columns, entries.alias("entries"))
    staged = keep(staged, "staged")  # parsed once
    keyed = staged.where("key is not null")
    repeated = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("same").alias("lo"), F.max("same").alias("hi")).where("n > 1")
    repeated = keep(repeated.select("key", (F.col("lo") == F.col("hi")).alias("alike")), "repeated-keys")
    n_repeated = repeated.count()
    if n_repeated <= BROADCAST_KEYS:
        repeated = F.broadcast(repeated)
    names = ["raw", "key_text", "entries", *[f"c{i}" for i in range(len(spec.columns))]]
    alone = keyed.join(repeated, "key", "left_anti").select("key", *names, F.lit(None).cast("string").alias("duplicate"))
    several = keyed.join(repeated, "key")
    differing = several.where("not alike").select("key", *names, F.lit("CR-04").alias("duplicate"))
    # of alike records the one whose text has the least hash stays
    rest = F.first(F.struct("key_text", "entries", *names[3:])).alias("rest")
    alike = several.where("alike").groupBy("key", "print", "raw").agg(F.count(F.lit(1)).alias("n"), rest)
    kept_one = alike.groupBy("key").agg(F.min(F.struct("print", "raw")).alias("kept"))
    turns = alike.join(kept_one, "key").withColumn("stays", F.struct("print", "raw") == F.col("kept"))
    turns = turns.select("key", "raw", "rest.*", "stays", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("turn"))
    same_again = turns.select("key", *names, F.when(~(F.col("stays") & (F.col("turn") == 1)), "CR-03").alias("duplicate"))
    judged = alone.union(differing).union(same_again) if n_repeated else alone
    ruled = judged.withColumn(
        "rule", F.coalesce("duplicate", F.when(created.isNull(), "CR-05").when((created < low) | (created >= high), "CR-12"))
    )
    numbers = [f"c{i}" for i in range(len(spec.columns))]
    order = [f"c{spec.columns.index(spec.column(r))}" for r in (Role.CREATED, Role.KEY)]
    rows = number_rows(ruled.where("rule is null").select(*numbers, "entries"), order)
    log = rows.select(RID, F.explode("entries").alias("e")).select(F.col(RID).alias("row_index"), "e.*")
    bad_keys = staged.where("key is null").select(F.col("key_text").alias("raw_unique_key"), F.lit("CR-02").alias("rule_id"), F.col("raw").alias("raw_record"))
    rejects = ruled.where("rule is not null").select(F.col("key_text").alias("raw_unique_key"), F.col("rule").alias("rule_id"), F.col("raw").alias("raw_record")).union(bad_keys)
    return Cleaned(spec, rows.drop("entries"), log, rejects)


def _cleaned(role: Role, fields: tuple[str, ...], index: int) -> tuple[Column, list[Column]]:
    """A column's value, and its possible log entries (null where nothing was changed)."""

    def entry(when: Column, rule: str, raw: Column) -> Column:
        return F.when(when, F.struct(F.lit(index).alias("column"), F.lit(rule).alias("rule_id"), raw.alias("raw_value")))

    text = F.col("f").getField(fields[0])
    if role in (Role.CREATED, Role.TIME):
        value = read_time(text)
        return value, [entry(text.isNotNull() & value.isNull(), "CR-06", text)] if role is Role.TIME else []
    if role is Role.TEXT:
        trimmed = F.btrim(text, F.lit(_SPACE))
        empty = trimmed == ""
        return F.when(~empty, trimmed), [entry(empty, "CR-08", text), entry(~empty & (trimmed != text), "CR-07", text)]
    if role is Role.POINT:
        other = F.col("f").getField(fields[1])
        lat, lon = _number(text), _number(other)
        place = F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.cast("float").alias("lat"), lon.cast("float").alias("lon")))
        pair = F.concat(F.lit("["), _raw_token(fields[0]), F.lit(","), _raw_token(fields[1]), F.lit("]"))
        return place, [entry(place.isNull() & (text.isNotNull() | other.isNotNull()), "CR-09", pair)]
    return text, []


def _counts(rows: DataFrame, log: DataFrame, rejects: DataFrame, spec: Dataset) -> dict[str, int]:
    found = dict.fromkeys(RULES, 0)
    points = [f"c{i}" for i, c in enumerate(spec.columns) if c.role is Role.POINT]
    times = [f"c{i}" for i, c in enumerate(spec.columns) if c.role in (Role.CREATED, Role.TIME)]
    fraction = lambda c: F.count(F.when(F.date_trunc("second", F.col(c)).cast("timestamp_ntz") != F.col(c), 1))
    one = rows.agg(
        sum([F.count(c) for c in points], F.lit(0)).alias("points"), sum([fraction(c) for c in times], F.lit(0)).alias("times")
    ).first()
    found["CR-10"], found["CR-11"] = one["points"], one["times"]
    for frame in (log, rejects):
        found |= {r["rule_id"]: r["count"] for r in frame.groupBy("rule_id").count().collect()}
    return found


def known_issues(rows: DataFrame, spec: Dataset, updated_at: int | None = None) -> list[dict]:
    """Problems that are counted and left as they are; ``updated_at`` is the source's last update in UTC seconds."""
    at = {c.name: F.col(f"c{i}") for i, c in enumerate(spec.columns)}
    created, closed = at["created_date"], at["closed_date"]
    checks: list[tuple[str, list[str], Column, str]] = [
        ("KI-closed-before-created", ["created_date", "closed_date"], closed < created, "{} requests have a closed date earlier than their created date."),
        ("KI-closed-before-2010", ["closed_date"], closed < F.lit("2010-01-01").cast("timestamp_ntz"),
         "{} requests have a closed date before 2010, when this dataset starts; these are usually placeholder dates."),
    ]
    if updated_at is not None:
        limit = F.lit(format_stamp((updated_at + 86_400) * 1_000_000).replace("T", " ")).cast("timestamp_ntz")
        checks.append(("KI-closed-in-future", ["closed_date"], closed > limit, "{} requests have a closed date more than a day after the data was last updated."))
    midnight = created.cast("date").cast("timestamp_ntz") == created
    checks.append(("KI-created-midnight", ["created_date"], midnight, "{} requests were created at exactly midnight, which usually means only the date was recorded."))
    lat, lon, area = at["location"].getField("lat"), at["location"].getField("lon"), spec.area
    edge = lambda x: F.lit(x).cast("float")
    inside = lat.between(*map(edge, area.lat)) & lon.between(*map(edge, area.lon))
    checks.append((area.issue, ["location"], at["location"].isNotNull() & ~inside, "{} requests have a location outside " + area.name + "."))
    if "borough" in at:
        checks.append(("KI-borough-unspecified", ["borough"], F.lower(at["borough"]) == "unspecified", "{} requests have the borough 'Unspecified'."))
    if "incident_zip" in at:
        checks.append(("KI-zip-not-5-digits", ["incident_zip"], ~at["incident_zip"].rlike("^[0-9]{5}$"), "{} requests have a ZIP code that is not five digits."))
    counted = rows.agg(*[F.count(F.when(test, 1)).alias(f"k{i}") for i, (_, _, test, _) in enumerate(checks)]).first()
    return [
        {"id": name, "columns": columns, "count": counted[f"k{i}"], "sentence": sentence.format(f"{counted[f'k{i}']:,}")}
        for i, (name, columns, _, sentence) in enumerate(checks)
    ]


__all__ = ["RULES", "RULES_VERSION", "Cleaned", "Drift", "clean", "known_issues", "read_time", "records_of"]
