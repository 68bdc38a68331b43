"""A small engine of explicit schemas and full recounts, in plain Python: what tests compare the Spark engine with."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from binweave.functions.quantize import Scale, bin_of


@dataclass(frozen=True)
class Field:
    """A numeric dimension; with low and high both given the domain is theirs, else the rows' (started from the one given)."""

    name: str
    bits: int = 8
    low: float | None = None
    high: float | None = None

    def scale(self, rows: Sequence[Mapping]) -> Scale:
        if self.low is not None and self.high is not None:
            return Scale(self.low, self.high if self.high > self.low else self.low + 1, self.bits)
        seen = [v for r in rows if isinstance(v := r.get(self.name), (int, float)) and math.isfinite(v)]
        low, high = (f([*seen, *[x for x in (self.low, self.high) if x is not None]], default=None) for f in (min, max))
        if low is None or low == high:
            low, high = 0.0, float(max(1, len(rows)))
        return Scale(low, high, self.bits)


class SimpleEngine:
    """Filters and histograms over rows in memory."""

    def __init__(self, schema: Sequence[Field], rows: Sequence[Mapping]):
        if not schema:
            raise ValueError("the schema is empty")
        self.schema = list(schema)
        self.scales = {f.name: f.scale(rows) for f in schema}
        self.codes = {f.name: [bin_of(r.get(f.name), self.scales[f.name]) for r in rows] for f in schema}
        self.filters: dict[str, tuple[float, float]] = {}
        self.size = len(rows)

    def filter(self, name: str, bounds: tuple[float, float]) -> None:
        self.filters[name] = bounds

    def clear(self, name: str) -> None:
        self.filters.pop(name, None)

    def active(self) -> list[int]:
        return [i for i in range(self.size) if all(a <= self.codes[n][i] <= b for n, (a, b) in self.filters.items())]

    def histogram(self, name: str) -> list[int]:
        out = [0] * self.scales[name].bins
        for i in self.active():
            out[self.codes[name][i]] += 1
        return out
