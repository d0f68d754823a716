"""Raw directories: what a source sent, page by page, and how it was fetched."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lineaframe.sources.spec import Scope

PAGES = "pages"
FETCH, METADATA = "fetch.json", "metadata.json"


def digest(context: str, *parts: bytes) -> str:
    """64 hex digits over parts with their lengths; the context keeps kinds of objects apart."""
    h = hashlib.blake2b(digest_size=32, person=context.encode()[:16])
    for part in parts:
        h.update(len(part).to_bytes(8, "little"))
        h.update(part)
    return h.hexdigest()


@dataclass
class FetchRecord:
    portal: str
    dataset_id: str
    endpoint: str
    select: list[str]
    scope: dict
    where: str
    order: str
    pagination: dict
    started_at: str
    finished_at: str
    rows_updated_at_start: str | None
    rows_updated_at_end: str | None
    raw_records: int
    metadata_hash: str
    pages: list[dict] = field(default_factory=list)
    raw_hash: str = ""

    def seal(self) -> FetchRecord:
        self.raw_hash = pages_hash(self.pages)
        return self


def pages_hash(pages: list[dict]) -> str:
    return digest("raw pages", *[f"{p['bytes']}:{p['hash']}".encode() for p in pages])


def page_record(root: Path, number: int, body: bytes, url: str, records: int) -> dict:
    """Write a page and describe it."""
    name = f"{PAGES}/{number:06}.json"
    (root / name).write_bytes(body)
    return {"file": name, "url": url, "records": records, "bytes": len(body), "hash": digest("raw page", body)}


def new_directory(out: Path) -> None:
    if out.exists() and any(out.iterdir()):
        raise FileExistsError(f"{out} is not empty; refusing to overwrite a raw directory")
    (out / PAGES).mkdir(parents=True, exist_ok=True)


def write_fetch(out: Path, record: FetchRecord) -> None:
    """Written last: its presence marks a complete fetch."""
    (out / FETCH).write_text(json.dumps(asdict(record), indent=1))


@dataclass(frozen=True)
class RawDirectory:
    path: str
    fetch: dict
    metadata: dict
    pages: DataFrame

    @property
    def scope(self) -> Scope:
        return Scope(**self.fetch["scope"])


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def open_raw(spark: SparkSession, path: str) -> RawDirectory:
    """Open a raw directory on any file system Spark reads; size and hash of every page are checked first."""
    try:
        fetch = json.loads(_text(spark, f"{path}/{FETCH}"))
    except Exception as e:
        raise ValueError(f"{path}/{FETCH} missing: the fetch is incomplete or this is not a raw directory") from e
    metadata = _text(spark, f"{path}/{METADATA}")
    if digest("raw metadata", metadata.encode()) != fetch["metadata_hash"]:
        raise ValueError("metadata.json does not match fetch.json")
    if pages_hash(fetch["pages"]) != fetch["raw_hash"]:
        raise ValueError("raw_hash in fetch.json does not match the pages")
    files = [f"{path}/{p['file']}" for p in fetch["pages"]]
    if not files:
        return RawDirectory(path, fetch, json.loads(metadata), spark.createDataFrame([], "value string"))
    expected = {p["file"].rsplit("/", 1)[1]: (p["bytes"], p["hash"]) for p in fetch["pages"]}

    def checked(batches):  # noqa: ANN001, ANN202
        for frame in batches:
            rows = []
            for name, body in zip(frame["path"], frame["content"], strict=True):
                name = name.rsplit("/", 1)[1]
                size, hashed = expected[name]
                why = f"{name}: size differs from fetch.json" if len(body) != size else ""
                why = why or (f"{name}: hash differs from fetch.json" if _page_hash(bytes(body)) != hashed else "")
                rows.append(why)
            yield frame[["path"]].assign(problem=rows)

    def _page_hash(body: bytes) -> str:
        h = hashlib.blake2b(digest_size=32, person=b"raw page")
        h.update(len(body).to_bytes(8, "little"))
        h.update(body)
        return h.hexdigest()

    content = spark.read.format("binaryFile").load(files).select("path", "content")
    problems = content.mapInPandas(checked, "path string, problem string").where("problem != ''").orderBy("path").limit(1).collect()
    if problems:
        raise ValueError(problems[0]["problem"])
    return RawDirectory(path, fetch, json.loads(metadata), spark.read.text(files, wholetext=True))
