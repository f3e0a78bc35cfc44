"""Audits of named sample corpora, written as JSON payloads: python -m siltstone.plans.precompute NAME=PATH... --out FOLDER."""

from __future__ import annotations

import argparse
import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import SparkSession

from siltstone.sources import reports
from siltstone.sources.samples import SampleRegistry

from .audit import AuditConfig, audit


def precompute(spark: SparkSession, samples: SampleRegistry, out: str, now: datetime, names: list[str] | None = None) -> list[Path]:
    """Writes a payload for each of the named samples, or for all, and returns the files."""
    written = []
    for name in names or samples.names():
        path = Path(out) / f"{name}.json"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(reports.payload(audit(samples.load(spark, name), AuditConfig(now))), indent=1), encoding="utf-8")
        written.append(path)
    return written


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("samples", nargs="+", metavar="NAME=PATH")
    parser.add_argument("--out", required=True)
    parser.add_argument("--only", action="append", help="a sample's name; may be repeated")
    parser.add_argument("--now", type=datetime.fromisoformat, default=None)
    a = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    for path in precompute(spark, SampleRegistry(dict(x.split("=", 1) for x in a.samples)), a.out, a.now or datetime.now(), a.only):
        print(path)


if __name__ == "__main__":
    main()
