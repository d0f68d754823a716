"""Cleaning, snapshots, connectors and named questions."""

import datetime as dt
import json
import random
import shutil
from dataclasses import asdict
from pathlib import Path

import pytest

from lineaframe import questions
from lineaframe.engine import Engine
from lineaframe.plans.expr import col
from lineaframe.plans.plan import Agg, Plan
from lineaframe.sources import cli, fetch, raw, snapshot, synth
from lineaframe.sources.clean import clean, known_issues
from lineaframe.sources.spec import NYC_311, TOWNS, WESTCHESTER, Drift, Scope, check_metadata
from lineaframe.sources.tables import RID

SCOPE = Scope.dates("created_date", "2024-01-01", "2026-01-01")
DEFAULTS = {"agency": "DPR", "complaint_type": "Fallen Tree", "descriptor": "On sidewalk", "borough": "QUEENS", "status": "Open"}
#: Sixteen records, between them a case of every rule.
RECORDS = [
    {"unique_key": "5001", "created_date": "2025-03-30T07:15:00.000", "closed_date": "2025-03-30T07:15:00.000", "latitude": "40.58", "longitude": "-73.85", "incident_zip": "11694"},
    {"unique_key": "5007", "created_date": "2025-05-05T05:05:05.000"},
    {"unique_key": "5002", "created_date": "2024-11-05T22:40:10.500", "closed_date": "2024-11-04T10:00:00.000", "borough": "unspecified"},
    {"unique_key": "5003", "created_date": "2024-11-05T00:00:00.000", "agency": "\tDSNY\n", "complaint_type": " ", "closed_date": "n/a"},
    {"unique_key": "-5", "created_date": "2025-01-01T01:00:00.000"},
    {"unique_key": "5006", "created_date": "2025-02-02T02:02:02.000"},
    {"unique_key": "5004", "created_date": "2024-12-24T18:00:00.000", "latitude": "abc", "longitude": "-73.9"},
    {"unique_key": "5005", "created_date": "2025-01-02T03:04:05.000", "latitude": "12.5", "longitude": "99", "incident_zip": "1169"},
    {"unique_key": "5007", "created_date": "2025-05-05T05:05:05.000", "status": "Closed"},
    {"unique_key": "5006", "created_date": "2025-02-02T02:02:02.000"},
    {"unique_key": "5e3", "created_date": "2025-01-01T01:00:00.000"},
    {"unique_key": None, "created_date": "2025-01-01T01:00:00.000"},
    {"unique_key": "5008", "created_date": "2025-02-30T00:00:00.000"},
    {"unique_key": "5009", "created_date": "2026-01-01T00:00:00.000"},
    {"unique_key": 5010, "created_date": "2024-01-01T00:00:00.001", "closed_date": "1999-12-31T00:00:00.000", "latitude": 40.6, "longitude": -73.95},
    {"unique_key": "5007", "created_date": "2025-05-05T05:05:05.000"},
]


def texts(records=RECORDS):
    return [json.dumps({":id": f"{i:02}"} | DEFAULTS | r) for i, r in enumerate(records, 1)]


def write_raw(root: Path, records: list[str], per_page: int, spec=NYC_311, scope=SCOPE) -> str:
    raw.new_directory(root)
    pages = [
        raw.page_record(root, i // per_page + 1, ("[" + ", ".join(records[i : i + per_page]) + "]").encode(), "test", len(records[i : i + per_page]))
        for i in range(0, len(records), per_page)
    ]
    metadata = json.dumps(fetch.metadata_of(spec, None)).encode()
    (root / raw.METADATA).write_bytes(metadata)
    record = raw.FetchRecord(spec.portal, spec.dataset_id, "test", [], asdict(scope), "", ":id", {}, "", "", None, None, len(records), raw.digest("raw metadata", metadata), pages)
    raw.write_fetch(root, record.seal())
    return str(root)


def test_every_rule(spark):
    done = clean(spark.createDataFrame([(t,) for t in texts()], "raw string").repartition(3), NYC_311, SCOPE)
    rows = done.rows.orderBy(RID).collect()
    assert [r["c0"] for r in rows] == [5010, 5003, 5002, 5004, 5005, 5006, 5001] and [r[RID] for r in rows] == list(range(7))
    assert rows[6]["c1"] == rows[6]["c2"] == dt.datetime(2025, 3, 30, 7, 15) and rows[2]["c1"].microsecond == 500_000
    assert rows[1]["c3"] == "DSNY" and rows[1]["c4"] is None and rows[1]["c2"] is None and rows[3]["c12"] is None
    assert tuple(rows[0]["c12"]) == pytest.approx((40.6, -73.95))
    log = [tuple(r) for r in done.log.orderBy("log_index").select("row_index", "column", "rule_id", "raw_value").collect()]
    assert log == [(1, 2, "CR-06", "n/a"), (1, 3, "CR-07", "\tDSNY\n"), (1, 4, "CR-08", " "), (3, 12, "CR-09", '["abc","-73.9"]')]
    rejects = done.rejects.orderBy("reject_index").collect()
    assert [(r["raw_unique_key"], r["rule_id"]) for r in rejects] == [
        (None, "CR-02"), ("-5", "CR-02"), ("5006", "CR-03"), ("5007", "CR-04"), ("5007", "CR-04"), ("5007", "CR-04"), ("5008", "CR-05"), ("5009", "CR-12"), ("5e3", "CR-02"),
    ]
    assert rejects[1]["raw_record"] == texts()[4]  # exactly as it came
    assert done.counts == dict(zip([f"CR-{i:02}" for i in range(1, 13)], [0, 3, 1, 3, 1, 1, 1, 1, 1, 3, 2, 1], strict=True))
    found = {k["id"]: k["count"] for k in known_issues(done.rows, NYC_311)}
    assert found == {
        "KI-closed-before-created": 2, "KI-closed-before-2010": 1, "KI-created-midnight": 1, "KI-location-outside-nyc": 1,
        "KI-borough-unspecified": 1, "KI-zip-not-5-digits": 1,
    }
    future = {k["id"]: k["count"] for k in known_issues(done.rows, NYC_311, 1_700_000_000)}
    assert future["KI-closed-in-future"] == 2


@pytest.mark.parametrize("most", [10**6, 0])
def test_keys_with_very_many_records(spark, monkeypatch, most):
    """Half the records have one key: alike ones leave one, differing ones none; also where keys are not broadcast."""
    from lineaframe.sources import clean as cleaning

    monkeypatch.setattr(cleaning, "BROADCAST_KEYS", most)
    one = [{"unique_key": "7", "created_date": "2024-03-01T10:00:00.000", "channel": "x" * (i % 3)} for i in range(300)]
    two = [{"unique_key": "8", "created_date": "2024-03-01T10:00:00.000", "status": "Open" if i == 5 else "Closed"} for i in range(300)]
    rest = [{"unique_key": str(100 + i), "created_date": "2024-03-02T10:00:00.000"} for i in range(200)]
    lines = [json.dumps(DEFAULTS | r) for r in one + two + rest]
    done = clean(spark.createDataFrame([(t,) for t in lines], "raw string").repartition(7), NYC_311, SCOPE)
    assert sorted(r["c0"] for r in done.rows.collect()) == [7, *range(100, 300)]
    counts = done.rejects.groupBy("raw_unique_key", "rule_id").count().collect()
    assert sorted(tuple(r) for r in counts) == [("7", "CR-03", 299), ("8", "CR-04", 300)]
    assert sorted(r["raw_record"] for r in done.rejects.collect() if r["rule_id"] == "CR-04") == sorted(lines[300:600])


def test_arrow_files_hold_whole_chunks(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(snapshot, "CHUNK", 3)
    path, manifest = snapshot.build(spark, write_raw(tmp_path / "raw", texts(), 5), str(tmp_path / "out"))
    (tmp_path / "arrow").mkdir()
    data, _, rejects = snapshot.export_arrow(spark, path, str(tmp_path / "arrow"))
    with pa.memory_map(data) as source:
        reader = pa.ipc.open_file(source)
        assert [reader.get_batch(i).num_rows for i in range(reader.num_record_batches)] == [3, 3, 1]
    assert [r["row_index"] for r in snapshot.import_arrow(spark, data).collect()] == list(range(7))
    assert snapshot.import_arrow(spark, rejects).count() == manifest["cleaning"]["rejected_rows"]


def test_flattened_frames_equal_flattened_records(spark):
    issues = [
        {"id": 5, "created_at": "2024-01-01T05:00:00-05:00", "closed_at": "2024-02-30T05:00:00Z", "request_type": {"organization": "Peekskill, NY", "title": "Pot \"hole\" é"}, "status": "open", "address": "12345 Main, NY 10566 USA 123456", "lat": 41.25, "lng": -73},
        {"id": "6", "created_at": "soon", "closed_at": None, "request_type": {"organization": "Greenburgh, NY", "title": None}, "summary": "Words", "status": True, "address": 5, "lat": None},
        {"id": 7, "created_at": "2024-01-01T05:00:00", "request_type": {"organization": "Elsewhere"}}, {"id": 8, "request_type": {"organization": 4}}, {"id": 9, "request_type": None}, {"id": 10},
        {"id": 11, "created_at": 3, "request_type": {"organization": "Public Works Issues", "title": 3}, "summary": 4, "address": "no code"},
    ]
    got = fetch.flattened(spark.createDataFrame([(json.dumps(i),) for i in issues], "raw string")).collect()
    for row, issue in zip(got, issues, strict=True):
        record, organization = fetch.flatten(issue)
        assert row["organization"] == organization
        assert (record and {k: v for k, v in record.items() if v is not None}) == (row["record"] and json.loads(row["record"]))


def test_odd_values_stop_the_build(spark):
    for value in (True, [1], {"a": 1}):
        frame = spark.createDataFrame([(json.dumps(RECORDS[0] | {"agency": value}),)], "raw string")
        with pytest.raises(Exception, match="CR-01"):
            clean(frame, NYC_311, SCOPE)


def test_drift_names_all_problems():
    columns = fetch.metadata_of(NYC_311, None)["columns"][1:]
    columns[0] = columns[0] | {"dataTypeName": "text"}
    with pytest.raises(Drift, match='field "unique_key" is missing; field "created_date" has type "text"'):
        check_metadata(NYC_311, columns)


def test_snapshot_hash_is_of_content(spark, tmp_path):
    records = texts()
    first, manifest = snapshot.build(spark, write_raw(tmp_path / "a", records, 5), str(tmp_path / "out"))
    random.Random(1).shuffle(records)
    _, again = snapshot.build(spark, write_raw(tmp_path / "b", records, 7), str(tmp_path / "out2"), compression="snappy")
    assert manifest["snapshot_hash"] == again["snapshot_hash"] and manifest["manifest_hash"] != again["manifest_hash"]
    other = [r.replace("DSNY", "DEP") for r in records]
    _, changed = snapshot.build(spark, write_raw(tmp_path / "c", other, 16), str(tmp_path / "out"))
    assert changed["snapshot_hash"] != manifest["snapshot_hash"]
    with pytest.raises(FileExistsError):
        snapshot.build(spark, str(tmp_path / "b"), str(tmp_path / "out"))
    assert snapshot.verify(spark, first)["snapshot_hash"] == manifest["snapshot_hash"]
    assert manifest["rows"] == 7 and manifest["cleaning"]["rejected_rows"] == 9

    def tampered(change) -> str:
        copy = tmp_path / "copy"
        shutil.rmtree(copy, ignore_errors=True)
        shutil.copytree(first, copy)
        change(copy)
        with pytest.raises(snapshot.Tampered) as e:
            snapshot.verify(spark, str(copy))
        return str(e.value)

    def edit(copy):
        text = (copy / "manifest.json").read_text()
        (copy / "manifest.json").write_text(text.replace('"rows": 7', '"rows": 8'))
        (copy / ".manifest.json.crc").unlink(missing_ok=True)

    def swap(name, sql):
        def change(copy):
            data = spark.read.parquet(f"{first}/{name}").selectExpr(*sql)
            shutil.rmtree(copy / name)
            data.write.parquet(str(copy / name))

        return change

    columns = [c for c in spark.read.parquet(f"{first}/data").columns if c != "agency"]
    assert "manifest.json was changed" in tampered(edit)
    assert "column agency" in tampered(swap("data", [*columns, "if(row_index = 3, 'X', agency) AS agency"]))
    assert "rejects_hash" in tampered(swap("rejects", ["reject_index", "raw_unique_key", "rule_id", "concat(raw_record, ' ') AS raw_record"]))
    assert "can't be read" in tampered(lambda copy: (copy / "manifest.json").unlink())
    with pytest.raises(snapshot.Tampered):
        Engine(spark).load_snapshot(str(tmp_path / "copy"))
    arrow = tmp_path / "arrow"
    arrow.mkdir()
    files = snapshot.export_arrow(spark, first, str(arrow))
    assert snapshot.import_arrow(spark, files[0]).count() == 7


def test_raw_directory_is_checked(spark, tmp_path):
    path = write_raw(tmp_path / "raw", texts(), 5)
    page = tmp_path / "raw" / "pages" / "000002.json"
    body = page.read_bytes()
    page.write_bytes(body.replace(b"DPR", b"DPX", 1))
    with pytest.raises(ValueError, match="000002.json: hash differs"):
        raw.open_raw(spark, path)
    page.write_bytes(body + b" ")
    with pytest.raises(ValueError, match="000002.json: size differs"):
        raw.open_raw(spark, path)
    (tmp_path / "raw" / "fetch.json").unlink()
    with pytest.raises(ValueError, match="fetch is incomplete"):
        raw.open_raw(spark, path)


def test_synthetic_snapshot_end_to_end(spark, tmp_path):
    assert cli.main(["synth", "--out", str(tmp_path / "raw"), "--rows", "3000", "--seed", "5"], spark=spark) == 0
    assert cli.main(["build", str(tmp_path / "raw"), "--out", str(tmp_path / "out")], spark=spark) == 0
    (path,) = (tmp_path / "out" / "nyc311").iterdir()
    assert cli.main(["verify", str(path)], spark=spark) == 0
    manifest = json.loads((path / "manifest.json").read_text())
    counts = {r["id"]: r["count"] for r in manifest["cleaning"]["rules"]}
    assert all(counts[r] > 0 for r in counts if r != "CR-01") and manifest["rows"] + manifest["cleaning"]["rejected_rows"] >= 3000
    assert sorted(r[0] for r in synth.records(spark, 50, 5).collect()) == sorted(r[0] for r in synth.records(spark, 50, 5).repartition(3).collect())
    engine = Engine(spark)
    report = engine.load_snapshot(str(path))
    name, q = report["snapshot_hash"], questions.Question("Noise - Residential", questions.Area("borough", "BROOKLYN"))
    run = engine.run(questions.wait(name, q))
    (row,) = run["output"]["rows"]
    filed, dated = engine.run(questions.counts(name, q))["output"]["rows"][0]
    assert row[0] <= dated <= filed and row[1] <= row[2] and questions.shown_p90(row) == row[2]
    moved = engine.contributions(run["execution"], 0, "median_hours", 1)
    assert questions.sway(moved) >= 0
    ids = list(engine.trace_back_rows(run["execution"], 0))
    assert len(ids) == row[0]
    compare = engine.run(questions.compare(name, "Noise - Residential"))["output"]["rows"]
    assert questions.rank_of(compare, "BROOKLYN", False)[1] <= 5
    counted = set(ids)
    records = engine.source_records(name, range(40))
    columns = records["columns"]
    for number, values in enumerate(records["rows"]):
        record = dict(zip(columns, values, strict=True))
        dropped = engine.trace_forward(run["execution"], number)["dropped"] if number < 6 else ...
        if dropped is ...:
            continue
        why = questions.why_not_counted(questions.wait(name, q), dropped)
        belongs = record["complaint_type"] == q.type and record["borough"] == q.area.value
        assert (why is None) == (number in counted) and (belongs or why == "elsewhere")
    key = records["rows"][7][0]
    found = engine.run(questions.by_key(name, key))
    assert list(engine.trace_back_rows(found["execution"], 0)) == [7]


def test_question_helpers():
    assert questions.parse_district("04 BRONX") == ("BRONX", 4) and questions.parse_district("00 BRONX") is None
    assert questions.parse_district("19 QUEENS") is None and questions.parse_district(None) is None and questions.parse_district("Unspecified") is None
    assert questions.question_for({"complaint_type": "x", "community_board": "64 MANHATTAN", "borough": "MANHATTAN"}).area.kind == "borough"
    assert questions.rank_of([["BRONX", 50, 9.0], ["QUEENS", 10, 8.0], ["BROOKLYN", 30, None], ["MANHATTAN", 20, 1.0]], "MANHATTAN", False) == (2, 2)
    assert questions.rank_of([["BRONX", 5, 9.0]], "BRONX", False) is None
    with pytest.raises(ValueError, match="unknown order best"):
        questions.listing("0" * 64, questions.Question(), "best", 3)
    with pytest.raises(ValueError, match='"12x" is not a complaint number'):
        questions.by_key("0" * 64, "12x")


class Pages:
    """A transport that answers from records and notes what was asked."""

    def __init__(self, records, page_size, metadata, failures=()):
        self.records, self.page_size, self.metadata, self.asked, self.failures = records, page_size, metadata, [], list(failures)

    def __call__(self, url):
        self.asked.append(url)
        if self.failures:
            raise self.failures.pop(0)
        if "/api/views/" in url:
            return json.dumps(self.metadata).encode()
        after = url.rsplit("%3E%20%27", 1)[1].split("%27")[0] if "%3E%20%27" in url.split("$order")[0].split("AND%20%3Aid")[-1] and "AND%20%3Aid" in url else ""
        rows = [r for r in self.records if r[":id"] > after][: self.page_size]
        return json.dumps(rows).encode()


def test_keyset_paging(tmp_path, spark):
    records = [{":id": f"{i:03}"} | DEFAULTS | {"unique_key": str(i), "created_date": "2024-05-01T00:00:01.000"} for i in range(1, 8)]
    waits = []
    pages = Pages(records, 3, fetch.metadata_of(NYC_311, 1_700_000_000), [fetch.HttpError(503), fetch.HttpError(None, "reset"), fetch.HttpError(429)])
    record = fetch.fetch_socrata(NYC_311, SCOPE, pages, tmp_path / "raw", 3, fetch.Retry(sleep=waits.append))
    assert record.raw_records == 7 and [p["records"] for p in record.pages] == [3, 3, 1] and waits == [2.0, 4.0, 8.0]
    assert "%3Aid%20%3E%20%27003%27" in record.pages[1]["url"] and record.rows_updated_at_start == "2023-11-14T22:13:20Z"
    assert raw.open_raw(spark, str(tmp_path / "raw")).fetch["raw_hash"] == record.raw_hash
    with pytest.raises(FileExistsError):
        fetch.fetch_socrata(NYC_311, SCOPE, pages, tmp_path / "raw", 3)
    with pytest.raises(fetch.HttpError, match="HTTP 404"):
        fetch.fetch_socrata(NYC_311, SCOPE, Pages([], 3, {}, [fetch.HttpError(404)]), tmp_path / "b", 3)
    with pytest.raises(fetch.HttpError, match="HTTP 500"):
        fetch.fetch_socrata(NYC_311, SCOPE, Pages([], 3, {}, [fetch.HttpError(500)] * 9), tmp_path / "c", 3, fetch.Retry(sleep=waits.append))
    with pytest.raises(Drift):
        fetch.fetch_socrata(NYC_311, SCOPE, Pages([], 3, {"columns": []}), tmp_path / "d", 3)


def issue(number, organization="Peekskill, NY", **more):
    return {
        "id": number, "created_at": "2025-07-01T11:16:02-04:00", "closed_at": None, "status": "Open", "lat": 41.2, "lng": -73.9, "summary": "Pothole",
        "address": "1 Main St 12345-678 Peekskill 10566", "request_type": {"title": "Road", "organization": organization},
    } | more


def test_seeclickfix(tmp_path, spark):
    pages = [[issue(5), issue(3, request_type={"organization": "Greenburgh, NY"})], [issue(5), issue(9, "Stamford, CT"), issue(7, request_type=None)]]

    def answer(url):
        number = int(url.rsplit("=", 1)[1])
        return json.dumps({"issues": pages[number - 1], "metadata": {"pagination": {"next_page": number + 1 if number < 2 else None}}}).encode()

    waits = []
    failing = [fetch.HttpError(403)]
    get = lambda url: (_ for _ in ()).throw(failing.pop()) if failing else answer(url)
    scope = Scope.dates("created_date", "2025-07-01", "2025-08-01")
    record = fetch.fetch_seeclickfix(WESTCHESTER, scope, get, tmp_path / "raw", retry=fetch.Retry(8, 30.0, (403, 429), waits.append))
    summary = json.loads((tmp_path / "raw" / "source.json").read_text())
    assert record.raw_records == 2 and waits == [30.0, 6.0] and summary["duplicates"] == 1
    assert summary["skipped_by_organization"] == {"Stamford, CT": 1, "(none)": 1}
    assert "after=2025-06-30T00:00:00Z&before=2025-08-02T00:00:00Z" in record.where
    path, manifest = snapshot.build(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    engine = Engine(spark)
    name = engine.load_snapshot(path)["snapshot_hash"]
    rows = engine.run(Plan.scan(name).project("unique_key", "created_date", "town", "complaint_type", "incident_zip"))["output"]["rows"]
    assert rows == [[3, "2025-07-01T11:16:02.000000", "Greenburgh", "Pothole", "10566"], [5, "2025-07-01T11:16:02.000000", "Peekskill", "Road", "10566"]]
    assert engine.run(questions.town_list(name))["output"]["rows"] == [["Greenburgh", 1], ["Peekskill", 1]]
    assert engine.run(Plan.scan(name).filter(col("location").lat() > 41.0).aggregate([], Agg("n", "count")))["output"]["rows"] == [[2]]
    assert manifest["source"]["source_id"] == 2 and set(TOWNS.values()) >= {"Peekskill"}


def test_flattening_details():
    assert fetch.local_time("2025-12-31T11:16:02-05:00") == "2025-12-31T11:16:02" and fetch.local_time("yesterday") == "yesterday"
    assert fetch.zip_code("10566 then 105667 and 10570x") == "10570" and fetch.zip_code("no zip 123456") is None
    assert fetch.flatten({"id": 1})[1] == "(none)"
    assert fetch.soql_text("it's") == "'it''s'"
