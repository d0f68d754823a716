"""Connectors: page through an HTTP API into a raw directory.

The transport is a parameter (a function from url to response), so tests replay
pages and callers may bring their own HTTP client.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import sqlite3
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from contextlib import closing
from dataclasses import asdict, dataclass
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineaframe.plans.types import format_stamp, parse_stamp
from lineaframe.sources.clean import read_time
from lineaframe.sources.raw import METADATA, FetchRecord, digest, new_directory, page_record, write_fetch
from lineaframe.sources.spec import TOWNS, Dataset, Scope, check_metadata

ROW_ID = ":id"
_DAY = 86_400_000_000


class HttpError(Exception):
    """A response other than 200; status None for a network failure."""

    def __init__(self, status: int | None, message: str = "") -> None:
        super().__init__(f"HTTP {status}: {message}" if status else f"network error: {message}")
        self.status = status


Transport = Callable[[str], bytes]


def http_get(app_token: str | None = None, timeout: float = 300) -> Transport:
    """A transport over HTTPS with an optional application token."""

    def get(url: str) -> bytes:
        request = urllib.request.Request(url, headers={"X-App-Token": app_token} if app_token else {})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as response:
                return response.read()
        except urllib.error.HTTPError as e:
            raise HttpError(e.code, e.read()[:500].decode(errors="replace")) from None
        except OSError as e:
            raise HttpError(None, str(e)) from None

    return get


@dataclass(frozen=True)
class Retry:
    """Network failures, 5xx and ``statuses`` are tried again after waits that double."""

    attempts: int = 6
    first_wait: float = 2.0
    statuses: tuple[int, ...] = (429,)
    sleep: Callable[[float], None] = time.sleep

    def get(self, transport: Transport, url: str) -> bytes:
        wait = self.first_wait
        for left in range(self.attempts - 1, -1, -1):
            try:
                return transport(url)
            except HttpError as e:
                again = e.status is None or e.status in self.statuses or 500 <= e.status < 600
                if not again or not left:
                    raise
            self.sleep(wait)
            wait *= 2
        raise ValueError("at least one attempt is needed")


def _now() -> str:
    return dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def utc_text(seconds: int | None) -> str | None:
    return None if seconds is None else dt.datetime.fromtimestamp(seconds, dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def soql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fetch_socrata(spec: Dataset, scope: Scope, transport: Transport, out: str | Path, page_size: int = 50_000, retry: Retry = Retry()) -> FetchRecord:
    """All records in scope, by row id: the next page starts after the last id, so updates between pages lose nothing."""
    root, base = Path(out), f"https://{spec.portal}"
    new_directory(root)
    started = _now()
    view = f"{base}/api/views/{spec.dataset_id}.json"
    metadata = retry.get(transport, view)
    meta = json.loads(metadata)
    check_metadata(spec, meta["columns"])
    (root / METADATA).write_bytes(metadata)
    endpoint = f"{base}/resource/{spec.dataset_id}.json"
    select, where = [ROW_ID, *spec.fields], scope.soql()
    pages: list[dict] = []
    total, last = 0, None
    while True:
        narrowed = where if last is None else f"({where}) AND {ROW_ID} > {soql_text(last)}"
        enc = lambda s: quote(s, safe="")
        url = f"{endpoint}?$select={enc(','.join(select))}&$where={enc(narrowed)}&$order={enc(ROW_ID)}&$limit={page_size}"
        body = retry.get(transport, url)
        records = json.loads(body)
        if not isinstance(records, list):
            raise ValueError(f"page {len(pages) + 1} is not a JSON array")
        pages.append(page_record(root, len(pages) + 1, body, url, len(records)))
        total += len(records)
        if len(records) < page_size:
            break
        newest = records[-1].get(ROW_ID)
        if newest is None:
            raise ValueError("record has no :id; cannot continue keyset pagination")
        if newest == last:
            raise ValueError(f"pagination made no progress past {ROW_ID} {last!r}")
        last = newest
    end = json.loads(retry.get(transport, view))
    record = FetchRecord(
        spec.portal, spec.dataset_id, endpoint, select, asdict(scope), where, ROW_ID,
        {"kind": "keyset", "key": ROW_ID, "page_size": page_size}, started, _now(),
        utc_text(meta.get("rowsUpdatedAt")), utc_text(end.get("rowsUpdatedAt")), total, digest("raw metadata", metadata), pages,
    ).seal()
    write_fetch(root, record)
    return record


def local_time(text: str) -> str:
    """The wall clock of an ISO time with an offset; anything else as it is, for the cleaning rules to see."""
    offset = len(text) >= 20 and text[19] in "+-Z."
    return text[:19] if offset and parse_stamp(text[:19]) is not None else text


def zip_code(address: str) -> str | None:
    """The last run of exactly five digits."""
    found = re.findall(r"(?<![0-9])[0-9]{5}(?![0-9])", address)
    return found[-1] if found else None


def flatten(issue: dict) -> tuple[dict | None, str]:
    """A nested request as a flat record of the dataset's fields, or None and the organization that isn't a town's."""
    request = issue.get("request_type") or {}
    organization = request.get("organization") if isinstance(request.get("organization"), str) else ""
    if organization not in TOWNS:
        return None, organization or "(none)"

    def text(v: object) -> str | None:
        if isinstance(v, bool) or not isinstance(v, str | int | float):
            return None
        return v if isinstance(v, str) else json.dumps(v)

    def clock(key: str) -> str | None:
        return local_time(issue[key]) if isinstance(issue.get(key), str) else None

    title = request.get("title")
    address = issue.get("address")
    return {
        "id": text(issue.get("id")),
        "created_at": clock("created_at"),
        "closed_at": clock("closed_at"),
        "town": TOWNS[organization],
        "request_type": title if isinstance(title, str) else text(issue.get("summary")),
        "status": text(issue.get("status")),
        "zip": zip_code(address) if isinstance(address, str) else None,
        "lat": text(issue.get("lat")),
        "lng": text(issue.get("lng")),
    }, organization


def flattened(issues: DataFrame) -> DataFrame:
    """``record, organization`` of nested requests (column ``raw``, JSON), as :func:`flatten` makes them, by DataFrame functions.

    ``record`` is the flat JSON, or null where the organization is not a town's
    (``(none)`` where there is none). Numbers stay as the source writes them.
    """
    at = lambda path: F.get_json_object("raw", f"$.{path}")
    shape = F.try_parse_json("raw")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(shape, f"$.{path}", "variant"))
    text = lambda path: F.when(kind(path) == "STRING", at(path))
    scalar = lambda path: F.when(kind(path).rlike("^(STRING|BIGINT|DECIMAL|DOUBLE)"), at(path))

    def clock(path: str) -> Column:
        time = text(path)
        plain = F.substring(time, 1, 19)
        offset = F.substring(time, 20, 1).isin("+", "-", "Z", ".") & read_time(plain).isNotNull()
        return F.when(offset, plain).otherwise(time)

    organization = F.coalesce(F.when(text("request_type.organization") != "", text("request_type.organization")), F.lit("(none)"))
    town = F.try_element_at(F.create_map(*[F.lit(x) for pair in TOWNS.items() for x in pair]), organization)
    zips = F.regexp_extract_all(text("address"), F.lit("(?<![0-9])[0-9]{5}(?![0-9])"), F.lit(0))
    fields = {
        "id": scalar("id"), "created_at": clock("created_at"), "closed_at": clock("closed_at"), "town": town,
        "request_type": F.coalesce(text("request_type.title"), scalar("summary")), "status": scalar("status"),
        "zip": F.try_element_at(zips, F.lit(-1)), "lat": scalar("lat"), "lng": scalar("lng"),
    }
    record = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return issues.select(F.when(town.isNotNull(), record).alias("record"), organization.alias("organization"))


def fetch_seeclickfix(
    spec: Dataset,
    scope: Scope,
    transport: Transport,
    out: str | Path,
    per_page: int = 100,
    per_file: int = 10_000,
    max_pages: int = 20_000,
    pause: float = 6.0,
    retry: Retry = Retry(8, 30.0, (403, 429)),
) -> FetchRecord:
    """All requests to the towns, by page number over a window one day wider than the scope on each side.

    Responses are kept as they came; the raw pages hold the flattened records,
    each id once, in order of ids. Requests to other organizations are counted.
    Between the two, records wait in a database on disk, not in memory.
    """
    root = Path(out)
    new_directory(root)
    (root / "source").mkdir(exist_ok=True)
    started = _now()
    low, high = scope.bounds()
    window = [format_stamp(t)[:19] + "Z" for t in (low - _DAY, high + _DAY)]
    (south, north), (west, east) = spec.area.lat, spec.area.lon
    query = (
        f"min_lat={south}&max_lat={north}&min_lng={west}&max_lng={east}&after={window[0]}&before={window[1]}"
        f"&status=open,acknowledged,closed,archived&sort=created_at&sort_direction=ASC&per_page={per_page}"
    )
    endpoint = f"https://{spec.portal}/api/v2/issues"
    others: dict[str, int] = {}
    pages: list[dict] = []
    total, duplicates, responses = 0, 0, []
    with closing(sqlite3.connect("", isolation_level=None)) as kept:  # a temporary file, gone once it is closed
        kept.execute("PRAGMA journal_mode = OFF")
        kept.execute("CREATE TABLE kept (id BLOB PRIMARY KEY, record TEXT) WITHOUT ROWID")  # no record: another organization's
        for number in range(1, max_pages + 2):
            if number > max_pages:
                raise ValueError(f"more than {max_pages} pages; stopping")
            if number > 1:
                retry.sleep(pause)
            url = f"{endpoint}?{query}&page={number}"
            body = retry.get(transport, url)
            answer = json.loads(body)
            issues = answer.get("issues") if isinstance(answer, dict) else None
            if not isinstance(issues, list):
                raise ValueError(f"page {number} has no issues list")
            name = f"source/{number:06}.json"
            (root / name).write_bytes(body)
            responses.append({"file": name, "url": url, "issues": len(issues), "bytes": len(body), "hash": digest("raw page", body)})
            for issue in issues:
                key = issue.get("id")
                if not isinstance(key, int):
                    raise ValueError(f"page {number}: a request has no numeric id")
                record, organization = flatten(issue)
                sortable = (key + 2**127).to_bytes(16, "big")  # ids may have more than 63 bits
                if not kept.execute("INSERT OR IGNORE INTO kept VALUES (?, ?)", (sortable, record and json.dumps(record))).rowcount:
                    duplicates += 1
                elif record is None:
                    others[organization] = others.get(organization, 0) + 1
                else:
                    total += 1
            following = ((answer.get("metadata") or {}).get("pagination") or {}).get("next_page")
            if following is None or not issues:
                break
        if not total:
            raise ValueError("SeeClickFix returned no requests for the towns in scope")
        in_order = kept.execute("SELECT record FROM kept WHERE record IS NOT NULL ORDER BY id")
        while rows := in_order.fetchmany(per_file):
            body = f"[{', '.join(r[0] for r in rows)}]".encode()
            pages.append(page_record(root, len(pages) + 1, body, f"{endpoint}?{query} (flattened)", len(rows)))
    metadata = json.dumps(metadata_of(spec, int(time.time()))).encode()
    (root / METADATA).write_bytes(metadata)
    summary = {"endpoint": endpoint, "query": query, "responses": responses, "requests_kept": total, "duplicates": duplicates, "skipped_by_organization": others, "towns": TOWNS}
    (root / "source.json").write_text(json.dumps(summary, indent=1))
    record = FetchRecord(
        spec.portal, spec.dataset_id, endpoint, spec.fields, asdict(scope), f"{query}; organizations in the town list", "created_at",
        {"kind": "page", "key": "page", "page_size": per_page}, started, _now(), None, None, total, digest("raw metadata", metadata), pages,
    ).seal()
    write_fetch(root, record)
    return record


def metadata_of(spec: Dataset, updated_at: int | None) -> dict:
    """Source metadata as the dataset expects it."""
    columns = [{"fieldName": f, "dataTypeName": c.role.accepted[0]} for c in spec.columns for f in c.fields]
    return {"rowsUpdatedAt": updated_at, "columns": columns}
