"""Results out: snapshots to Python, and reports to JSON."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame


def snapshot(histograms: DataFrame) -> dict[str, dict[int, int]]:
    """dim -> bin -> count of a frame (dim, bin, count); its size is bounded by dimensions times 65,536."""
    out: dict[str, dict[int, int]] = {}
    for dim, bin_, count in histograms.select("dim", "bin", "count").collect():
        out.setdefault(dim, {})[bin_] = count
    return out


def write_report(report: Mapping, path: str | Path) -> None:
    """A report as JSON."""
    Path(path).write_text(json.dumps(report, indent=2, sort_keys=True) + "\n")


def latest_reports(folder: str | Path, prefix: str, most: int) -> list[dict]:
    """The reports with the lexicographically last names, at most so many, in that order."""
    paths = sorted(p for p in Path(folder).glob(f"{prefix}*.json"))[-most:] if most else []
    return [json.loads(p.read_text()) for p in paths]
