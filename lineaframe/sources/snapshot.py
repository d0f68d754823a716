"""Snapshots: clean, hashed tables in a directory named by their content.

A snapshot directory holds Parquet tables ``data``, ``cleaning_log`` and
``rejects`` and a ``manifest.json``. Hashes cover logical content, never file
bytes: rows in chunks of 65,536, chunks in groups of 4,096, groups in columns,
columns in the snapshot. Chunks are hashed where they are, by Spark's own
functions; the driver sees one hash for each group. Every hash is derived again
before a snapshot may be queried.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineaframe.plans.plan import SourceInfo
from lineaframe.plans.planjson import canonical
from lineaframe.plans.types import Kind
from lineaframe.sources.clean import RULES, RULES_VERSION, Cleaned, clean, known_issues, records_of
from lineaframe.sources.raw import RawDirectory, digest, open_raw
from lineaframe.sources.spec import DATASETS, Dataset, Role, check_metadata
from lineaframe.sources.tables import RID, Table
from lineaframe.storage import ship

FORMAT = "lineaframe-snapshot/1"
CHUNK = 65_536
GROUP = 4_096
#: Tags of the kinds in hashes.
TAGS = {Kind.INTEGER: 1, Kind.DECIMAL: 2, Kind.BOOLEAN: 3, Kind.TIMESTAMP: 4, Kind.TEXT: 5, Kind.LOCATION: 6}
_LOG = [("row_index", Kind.INTEGER), ("column", Kind.INTEGER), ("rule_id", Kind.TEXT), ("raw_value", Kind.TEXT)]
_REJECTS = [("raw_unique_key", Kind.TEXT), ("rule_id", Kind.TEXT), ("raw_record", Kind.TEXT)]
TITLES = {d.source_id: key for key, d in DATASETS.items()}


class Tampered(Exception):
    """What in a snapshot does not match its hashes."""


# ---- hashing


def _encoded(c: Column, kind: Kind) -> Column:
    """A value as text that tells any two values apart; missing has one of its own."""
    if kind is Kind.TEXT:
        shown = F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    elif kind is Kind.TIMESTAMP:
        shown = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c).cast("string")
    elif kind is Kind.LOCATION:
        shown = F.concat(c.getField("lat").cast("string"), F.lit(" "), c.getField("lon").cast("string"))
    else:
        shown = c.cast("string")
    return F.coalesce(F.concat(F.lit("="), shown, F.lit(";")), F.lit("-;"))


def column_hashes(df: DataFrame, index: str, columns: Sequence[tuple[str, Kind]]) -> list[str]:
    """One hash for each column over all rows in the order of ``index`` (0, 1, ...)."""
    place = F.col(index)
    chunk = ((place - place % CHUNK) / CHUNK).cast("bigint").alias("chunk")
    rows = df.select(chunk, place.alias("place"), *[_encoded(F.col(f"`{n}`"), k).alias(f"e{i}") for i, (n, k) in enumerate(columns)])
    listed = F.array_sort(F.collect_list(F.struct("place", *[f"e{i}" for i in range(len(columns))]))).alias("rows")
    chunks = rows.groupBy("chunk").agg(listed)
    joined = lambda i: F.array_join(F.transform("rows", lambda r: r[f"e{i}"]), "")
    hashed = chunks.select("chunk", F.size("rows").alias("n"), *[F.sha2(joined(i).cast("binary"), 256).alias(f"h{i}") for i in range(len(columns))])
    group = ((F.col("chunk") - F.col("chunk") % GROUP) / GROUP).cast("bigint").alias("group")
    line = lambda i: F.concat_ws(" ", F.col("chunk"), F.col("n"), F.col(f"h{i}"))
    in_order = lambda i: F.array_join(_second(F.array_sort(F.collect_list(F.struct("chunk", f"l{i}"))), f"l{i}"), "\n")
    lines = hashed.select(group, "chunk", *[line(i).alias(f"l{i}") for i in range(len(columns))])
    grouped = lines.groupBy("group").agg(*[F.sha2(in_order(i).cast("binary"), 256).alias(f"g{i}") for i in range(len(columns))])
    found = grouped.orderBy("group").collect()  # one row for 268 million rows of data
    return [digest("column", name.encode(), bytes([TAGS[kind]]), *[r[f"g{i}"].encode() for r in found]) for i, (name, kind) in enumerate(columns)]


def _second(pairs: Column, name: str) -> Column:
    return F.transform(pairs, lambda x: x[name])


def _described(spec: Dataset, scope: dict) -> str:
    return canonical(
        {
            "rules_version": RULES_VERSION,
            "scope": scope,
            "sort_key": [spec.column(Role.CREATED).name, spec.column(Role.KEY).name],
            "source": {"portal": spec.portal, "dataset_id": spec.dataset_id},
        }
    )


def _table_hash(name: str, df: DataFrame, index: str, columns: Sequence[tuple[str, Kind]]) -> str:
    return digest(name, *[h.encode() for h in column_hashes(df, index, columns)])


def _snapshot_hash(spec: Dataset, rows: int, scope: dict, columns: Sequence[str], log: str, rejects: str) -> str:
    return digest("snapshot", str(spec.source_id).encode(), str(rows).encode(), _described(spec, scope).encode(), *[h.encode() for h in (*columns, log, rejects)])


def _manifest_hash(manifest: dict) -> str:
    return digest("manifest", canonical({k: v for k, v in manifest.items() if k != "manifest_hash"}).encode())


# ---- files


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _named(cleaned: Cleaned, spec: Dataset) -> DataFrame:
    return cleaned.rows.select(F.col(RID).alias("row_index"), *[F.col(f"c{i}").alias(c.name) for i, c in enumerate(spec.columns)])


def _columns(spec: Dataset) -> list[tuple[str, Kind]]:
    return [(c.name, c.role.kind) for c in spec.columns]


def build(spark: SparkSession, raw_path: str, out: str, spec: Dataset | None = None, compression: str = "zstd") -> tuple[str, dict]:
    """Clean a raw directory into a snapshot under ``out``; returns its path and manifest.

    All is written under a temporary name and renamed at the end; a directory
    that exists already is not touched.
    """
    raw = open_raw(spark, raw_path)
    spec = spec or next(d for d in DATASETS.values() if d.dataset_id == raw.fetch["dataset_id"])
    check_metadata(spec, raw.metadata["columns"])
    cleaned = clean(records_of(raw.pages), spec, raw.scope)
    root = f"{out}/{TITLES.get(spec.source_id, spec.dataset_id)}"
    work = f"{root}/.building-{uuid.uuid4().hex}"
    options = {"compression": compression}
    _named(cleaned, spec).write.options(**options).parquet(f"{work}/data")
    cleaned.log.write.options(**options).parquet(f"{work}/cleaning_log")
    cleaned.rejects.write.options(**options).parquet(f"{work}/rejects")
    manifest = _manifest(spark, work, spec, raw, cleaned, compression)
    _write_text(spark, f"{work}/manifest.json", json.dumps(manifest, indent=1, ensure_ascii=False))
    final = f"{root}/{manifest['snapshot_hash'][:16]}"
    fs, target = _fs(spark, final)
    source = spark._jvm.org.apache.hadoop.fs.Path(work)
    if fs.exists(target):
        fs.delete(source, True)
        raise FileExistsError(f"{final} exists already; refusing to overwrite a snapshot")
    fs.rename(source, target)
    return final, manifest


def _derived(spark: SparkSession, path: str, spec: Dataset, scope: dict) -> dict:
    """All hashes and row counts, from the tables alone."""
    data, log, rejects = (spark.read.parquet(f"{path}/{t}") for t in ("data", "cleaning_log", "rejects"))
    columns = column_hashes(data, "row_index", _columns(spec))
    log_hash, rejects_hash = _table_hash("cleaning log", log, "log_index", _LOG), _table_hash("rejects", rejects, "reject_index", _REJECTS)
    rows = data.count()
    return {
        "rows": rows,
        "columns": columns,
        "cleaning_log_rows": log.count(),
        "cleaning_log_hash": log_hash,
        "rejected_rows": rejects.count(),
        "rejects_hash": rejects_hash,
        "snapshot_hash": _snapshot_hash(spec, rows, scope, columns, log_hash, rejects_hash),
    }


def _manifest(spark: SparkSession, path: str, spec: Dataset, raw: RawDirectory, cleaned: Cleaned, compression: str) -> dict:
    scope = raw.fetch["scope"]
    found = _derived(spark, path, spec, scope)
    nulls = cleaned.rows.agg(*[F.count(F.when(F.col(f"c{i}").isNull(), 1)).alias(f"c{i}") for i in range(len(spec.columns))]).first()
    updated = raw.metadata.get("rowsUpdatedAt")
    manifest = {
        "format_version": FORMAT,
        "snapshot_hash": found["snapshot_hash"],
        "source": {
            "source_id": spec.source_id, "dataset": spec.title, "portal": spec.portal, "dataset_id": spec.dataset_id,
            "source_url": spec.source_url, "terms_url": spec.terms_url, "rows_updated_at": updated,
        },
        "fetch": {k: v for k, v in raw.fetch.items() if k != "pages"} | {"pages": len(raw.fetch["pages"])},
        "build": {"tool_version": FORMAT, "built_at": dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")},
        "scope": {"sentence": spec.scope_sentence.format(**{"from": scope["gte"][:10], "to": scope["lt"][:10]}), "predicate": scope},
        "rows": found["rows"],
        "chunk_rows": CHUNK,
        "chunk_count": -(-found["rows"] // CHUNK),
        "sort_key": [spec.column(Role.CREATED).name, spec.column(Role.KEY).name],
        "schema": [
            {"index": i, "name": c.name, "type": f.kind.label, "nullable": f.nullable, "source_fields": list(c.fields),
             "description": c.description, "null_count": nulls[f"c{i}"], "column_hash": found["columns"][i]}
            for i, (c, f) in enumerate(zip(spec.columns, spec.schema(), strict=True))
        ],
        "excluded_columns": [{"field": f, "reason": r} for f, r in spec.left_out],
        "cleaning": {
            "rules_version": RULES_VERSION,
            "rules": [{"id": r, "action": RULES[r][0], "count": cleaned.counts[r], "description": RULES[r][2]} for r in RULES],
            **{k: found[k] for k in ("rejected_rows", "cleaning_log_rows", "cleaning_log_hash", "rejects_hash")},
        },
        "known_issues": known_issues(cleaned.rows, spec, updated),
        "files": [{"path": t, "compression": compression} for t in ("data", "cleaning_log", "rejects")],
    }
    return manifest | {"manifest_hash": _manifest_hash(manifest)}


# ---- verifying


def verify(spark: SparkSession, path: str) -> dict:
    """Derive every hash of a snapshot again and check its order; returns the manifest or raises :class:`Tampered`."""
    try:
        manifest = json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0])
    except Exception as e:
        raise Tampered(f"{path}/manifest.json can't be read") from e
    if manifest.get("format_version") != FORMAT:
        raise Tampered(f"unsupported snapshot format {manifest.get('format_version')!r}")
    if _manifest_hash(manifest) != manifest.get("manifest_hash"):
        raise Tampered("manifest.json was changed: its hash does not match")
    spec = next((d for d in DATASETS.values() if d.source_id == manifest["source"]["source_id"]), None)
    if spec is None:
        raise Tampered(f"unknown source {manifest['source']['source_id']}")
    found = _derived(spark, path, spec, manifest["scope"]["predicate"])
    for c, hashed in zip(manifest["schema"], found["columns"], strict=True):
        if c["column_hash"] != hashed:
            raise Tampered(f"column {c['name']}: hash differs from the manifest")
    for name in ("cleaning_log_rows", "cleaning_log_hash", "rejected_rows", "rejects_hash"):
        if manifest["cleaning"][name] != found[name]:
            raise Tampered(f"{name} differs from the manifest")
    if manifest["rows"] != found["rows"]:
        raise Tampered("the number of rows differs from the manifest")
    if manifest["snapshot_hash"] != found["snapshot_hash"]:
        raise Tampered("snapshot_hash differs from the manifest")
    _check_order(spark, path, spec, found["rows"])
    return manifest


def _check_order(spark: SparkSession, path: str, spec: Dataset, n: int) -> None:
    """Row numbers are 0 to n - 1 and follow the sort key."""
    data = spark.read.parquet(f"{path}/data").select("row_index", *[F.col(spec.column(r).name).alias(r.value) for r in (Role.CREATED, Role.KEY)])
    span = data.agg(F.min("row_index"), F.max("row_index")).first()
    if n and (span[0], span[1]) != (0, n - 1):
        raise Tampered("row numbers are not 0, 1, ...")
    after = data.select((F.col("row_index") - 1).alias("row_index"), F.struct("created", "key").alias("after"))
    pairs = data.select("row_index", F.struct("created", "key").alias("at")).join(after, "row_index")
    counted = pairs.agg(F.count(F.lit(1)), F.count(F.when(~(F.col("at") < F.col("after")), 1))).first()
    if counted[1] or counted[0] != max(0, n - 1):
        raise Tampered("rows are not in the order of the sort key")


def open_snapshot(spark: SparkSession, path: str) -> tuple[str, Table, dict]:
    """Verify a snapshot and make its table; there is no way round the verifying."""
    manifest = verify(spark, path)
    spec = next(d for d in DATASETS.values() if d.source_id == manifest["source"]["source_id"])
    columns = [F.col(f"`{c.name}`").alias(f"c{i}") for i, c in enumerate(spec.columns)]
    df = spark.read.parquet(f"{path}/data").select(F.col("row_index").alias(RID), *columns)
    return manifest["snapshot_hash"], Table(SourceInfo(spec.title, spec.schema()), df, spec.source_id), manifest


def _ipc_batches(batches: Iterator) -> Iterator:
    """Each Arrow batch as the bytes of a stream."""
    import pyarrow as pa

    for batch in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        yield pa.RecordBatch.from_pydict({"batch": [sink.getvalue().to_pybytes()]})


def export_arrow(spark: SparkSession, path: str, out: str) -> list[str]:
    """Write a snapshot's three tables as Arrow IPC files in a local folder, one record batch a chunk at most.

    A table is read once and sorted by ranges; its rows come to the driver part
    by part, never all at once.
    """
    import pyarrow as pa

    ship(spark)
    written = []
    for name, order in (("data", "row_index"), ("cleaning_log", "log_index"), ("rejects", "reject_index")):
        df = spark.read.parquet(f"{path}/{name}")
        parts = df.repartitionByRange(-(-df.count() // CHUNK) or 1, order).sortWithinPartitions(order).mapInArrow(_ipc_batches, "batch binary")
        target = f"{out}/{name}.arrow"
        schema = df.limit(0).toArrow().schema
        held = schema.empty_table()
        with pa.OSFile(target, "wb") as sink, pa.ipc.new_file(sink, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
            for row in parts.toLocalIterator():
                held = pa.concat_tables([held, pa.ipc.open_stream(row["batch"]).read_all().cast(schema)])
                while held.num_rows >= CHUNK:
                    writer.write_table(held.slice(0, CHUNK).combine_chunks())
                    held = held.slice(CHUNK)
            if held.num_rows:
                writer.write_table(held.combine_chunks())
        written.append(target)
    return written


def import_arrow(spark: SparkSession, path: str) -> DataFrame:
    """An Arrow IPC file as a DataFrame, batch by batch."""
    import pyarrow as pa

    with pa.memory_map(path) as source:
        return spark.createDataFrame(pa.ipc.open_file(source).read_all())
