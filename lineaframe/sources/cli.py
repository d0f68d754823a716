"""Command line: fetch, synth, build, verify."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from lineaframe.sources import fetch, snapshot, synth
from lineaframe.sources.spec import DATASETS, Scope


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lineaframe", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    get = commands.add_parser("fetch", help="page through a source into a raw directory")
    get.add_argument("--out", required=True)
    get.add_argument("--from", dest="start", default="2024-01-01")
    get.add_argument("--to", dest="end", default="2026-01-01")
    get.add_argument("--app-token", help="application token, sent with every request")
    make = commands.add_parser("synth", help="write synthetic records as a raw directory")
    make.add_argument("--out", required=True)
    make.add_argument("--rows", type=int, default=100_000)
    make.add_argument("--seed", type=int, default=1)
    build = commands.add_parser("build", help="clean a raw directory into a snapshot")
    build.add_argument("raw")
    build.add_argument("--out", required=True)
    build.add_argument("--compression", choices=["zstd", "snappy", "lz4", "none"], default="zstd")
    check = commands.add_parser("verify", help="derive all hashes of a snapshot again")
    check.add_argument("snapshot")
    for p in (get, build):
        p.add_argument("--source", choices=sorted(DATASETS), default="nyc311")
    return parser


def main(argv: list[str] | None = None, transport: fetch.Transport | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "fetch":
        spec = DATASETS[args.source]
        get = transport or fetch.http_get(args.app_token)
        run = fetch.fetch_socrata if args.source == "nyc311" else fetch.fetch_seeclickfix
        record = run(spec, Scope.dates("created_date", args.start, args.end), get, args.out)
        print(f"{record.raw_records} records in {len(record.pages)} pages")
        return 0
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "synth":
        print(f"{synth.write_raw(spark, args.out, args.rows, args.seed).raw_records} records")
    elif args.command == "build":
        path, manifest = snapshot.build(spark, args.raw, args.out, DATASETS[args.source], args.compression)
        print(json.dumps({"path": path, "snapshot_hash": manifest["snapshot_hash"], "rows": manifest["rows"]}))
    else:
        try:
            manifest = snapshot.verify(spark, args.snapshot)
        except snapshot.Tampered as e:
            print(f"not verified: {e}", file=sys.stderr)
            return 1
        print(f"verified: {manifest['rows']} rows, {manifest['snapshot_hash']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
