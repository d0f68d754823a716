"""Synthetic raw records: any number, the same for the same seed, with every anomaly the rules know.

All draws are hashes of the seed, a name and the row, so rows are made in
parallel and in any order.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import asdict
from itertools import accumulate
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineaframe.sources.fetch import metadata_of, utc_text
from lineaframe.sources.raw import METADATA, FetchRecord, digest, new_directory, page_record, write_fetch
from lineaframe.sources.spec import NYC_311, Dataset, Scope

TYPES = ["Noise - Residential", "HEAT/HOT WATER", "Illegal Parking", "Blocked Driveway", "Noise - Street/Sidewalk", "Rodent", "Street Light Condition", "Water System", "Graffiti", "Sidewalk Condition"]
AGENCIES = ["NYPD", "HPD", "DSNY", "DOT", "DEP", "DPR", "DOB", "DOHMH"]
BOROUGHS = ["BROOKLYN", "QUEENS", "BRONX", "MANHATTAN", "STATEN ISLAND", "Unspecified"]
STATUSES = ["Closed", "Open", "In Progress", "Assigned"]
CHANNELS = ["ONLINE", "PHONE", "MOBILE", "UNKNOWN"]
#: Of a thousand records, how many have each anomaly.
RATES = {"copy": 2, "differing": 1, "keyless": 1, "zeros": 1, "uncreated": 1, "outside": 2, "garbled": 2, "spaces": 5, "empty": 5, "half": 3, "fraction": 10, "midnight": 8, "backwards": 6}


def _draw(seed: int, name: str) -> Column:
    """Uniform in [0, 1), by row."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("id")), F.lit(1_000_003)) / 1_000_003


def _choice(values: list[str], u: Column) -> Column:
    """Zipf: the k-th value is 1/k as likely as the first."""
    weights = [1 / (i + 1) for i in range(len(values))]
    out = F.lit(values[-1])
    for value, upto in reversed(list(zip(values[:-1], accumulate(weights), strict=False))):
        out = F.when(u < upto / sum(weights), value).otherwise(out)
    return out


def records(spark: SparkSession, rows: int, seed: int = 1, scope: Scope | None = None) -> DataFrame:
    """``raw``: about ``rows`` JSON records of the city's dataset."""
    scope = scope or Scope.dates("created_date", "2024-01-01", "2026-01-01")
    low, high = scope.bounds()
    draw = lambda name: _draw(seed, name)
    hit = lambda name: F.floor(draw(f"is {name}") * 1000) < RATES[name]
    start = F.lit("1970-01-01").cast("timestamp_ntz")
    at = F.floor(F.lit(low) + draw("created") * (high - low)).cast("bigint")
    at = F.when(hit("outside"), F.lit(low - 86_400_000_000)).when(hit("midnight"), at - at % 86_400_000_000).otherwise(at)
    at = at - at % 1_000_000 + F.when(hit("fraction"), 250_000).otherwise(0)
    took = F.floor(-F.log(1 - draw("took")) * 2 * 86_400).cast("bigint") * 1_000_000
    done = F.when(hit("backwards"), at - took).otherwise(at + took)
    text = lambda micros: F.date_format(F.timestamp_add("MICROSECOND", micros, start), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    agency = _choice(AGENCIES, draw("agency"))
    borough = _choice(BOROUGHS, draw("borough"))
    key = (F.col("id") + 10_000_000).cast("string")
    lat, lon = 40.5 + draw("lat") * 0.42, -74.2 + draw("lon") * 0.5
    fields = {
        ":id": F.concat(F.lit("row-"), F.lpad(F.col("id").cast("string"), 12, "0"), F.when(F.col("part") > 0, "b").otherwise("a")),
        "unique_key": F.when(hit("keyless"), None).when(hit("zeros"), F.concat(F.lit("0"), key)).otherwise(key),
        "created_date": F.when(hit("uncreated"), "unknown").otherwise(text(at)),
        "closed_date": F.when(hit("garbled"), "yesterday").when(draw("open") < 0.05, None).otherwise(text(done)),
        "agency": F.when(hit("spaces"), F.concat(F.lit("  "), agency, F.lit(" "))).otherwise(agency),
        "complaint_type": _choice(TYPES, draw("type")),
        "descriptor": F.when(hit("empty"), " ").otherwise(F.concat(F.lit("Detail "), F.floor(draw("descriptor") * 40).cast("string"))),
        "location_type": F.when(draw("place") < 0.3, None).otherwise("Street/Sidewalk"),
        "incident_zip": F.when(draw("zip?") < 0.01, "N/A").otherwise(F.lpad(F.floor(10001 + draw("zip") * 1500).cast("string"), 5, "0")),
        "borough": borough,
        "community_board": F.concat(F.lpad(F.floor(1 + draw("board") * 14).cast("string"), 2, "0"), F.lit(" "), borough),
        "status": F.when((F.col("part") > 0) & hit("differing"), "Changed").otherwise(_choice(STATUSES, draw("status"))),
        "open_data_channel_type": _choice(CHANNELS, draw("channel")),
        "latitude": F.when(draw("nowhere") < 0.02, None).otherwise(F.round(lat, 6).cast("string")),
        "longitude": F.when((draw("nowhere") < 0.02) | hit("half"), None).otherwise(F.round(lon, 6).cast("string")),
    }
    copies = F.when(hit("copy") | hit("differing"), 1).otherwise(0)
    made = spark.range(rows).withColumn("part", F.explode(F.sequence(F.lit(0), copies)))
    return made.select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("raw"))


def write_raw(spark: SparkSession, out: str, rows: int, seed: int = 1, page_rows: int = 50_000, spec: Dataset = NYC_311) -> FetchRecord:
    """Synthetic records as a raw directory on a local disk, page by page."""
    root, scope = Path(out), Scope.dates("created_date", "2024-01-01", "2026-01-01")
    new_directory(root)
    pages: list[dict] = []
    page: list[str] = []
    total = 0
    for row in records(spark, rows, seed, scope).toLocalIterator():
        page.append(row["raw"])
        total += 1
        if len(page) == page_rows:
            pages.append(page_record(root, len(pages) + 1, ("[" + ",\n".join(page) + "]").encode(), "synthetic", len(page)))
            page = []
    if page or not pages:
        pages.append(page_record(root, len(pages) + 1, ("[" + ",\n".join(page) + "]").encode(), "synthetic", len(page)))
    updated = int(dt.datetime(2026, 1, 2, tzinfo=dt.UTC).timestamp())
    metadata = json.dumps(metadata_of(spec, updated)).encode()
    (root / METADATA).write_bytes(metadata)
    record = FetchRecord(
        spec.portal, spec.dataset_id, "synthetic", [":id", *spec.fields], asdict(scope), scope.soql(), ":id",
        {"kind": "synthetic", "key": "seed", "page_size": page_rows}, utc_text(updated), utc_text(updated), utc_text(updated), utc_text(updated),
        total, digest("raw metadata", metadata), pages,
    ).seal()
    write_fetch(root, record)
    return record
