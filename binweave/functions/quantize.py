"""Values to bins and back. A scale maps [low, high] to bins 0 .. 2^bits - 1, rounding half up."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fewest and most bits of a dimension, and the bits where no bins are asked for.
MIN_BITS, MAX_BITS, DEFAULT_BITS = 1, 16, 12


def bits_for(bins: float | None) -> int:
    """Bits for a number of bins: enough for them, from 1 to 16; 12 where bins is missing or zero."""
    if not bins or bins != bins:
        return DEFAULT_BITS
    return max(MIN_BITS, min(MAX_BITS, math.ceil(math.log2(bins)) if bins > 0 else MIN_BITS))


@dataclass(frozen=True)
class Scale:
    """The range of a numeric dimension and its resolution."""

    low: float
    high: float
    bits: int

    @property
    def bins(self) -> int:
        return 1 << self.bits

    @property
    def top(self) -> int:
        return self.bins - 1

    @property
    def factor(self) -> float:
        """Bins for a unit of value; 0 for a range that has no width."""
        span = self.high - self.low
        return self.top / span if span > 0 else 0.0


#: The largest double below a half: added before floor(), it rounds halves up and nothing else, from 0 to 2^52.
_BELOW_HALF = 0.49999999999999994


def half_up(x: Column) -> Column:
    """Nearest integer of a number from 0 up, halves up."""
    return F.floor(x + F.lit(_BELOW_HALF)).cast("int")


def finite(value: Column) -> Column:
    """Whether a double is neither null, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def quantize(value: Column, scale: Scale, clean: bool = False) -> Column:
    """Bin of a value: clamped to the scale; 0 for null, NaN, infinite values and scales without width. clean: there are no such values,
    so none is looked for."""
    if not scale.factor:
        return F.lit(0)
    v = value.cast("double")
    inside = F.least(F.greatest(v, F.lit(float(scale.low))), F.lit(float(scale.high)))
    bin_ = half_up((inside - F.lit(float(scale.low))) * F.lit(scale.factor))
    return bin_ if clean else F.when(finite(v), bin_).otherwise(F.lit(0))


def bin_of(value: float, scale: Scale) -> int:
    """quantize() for one Python number."""
    if value is None or not math.isfinite(value) or not scale.factor:
        return 0
    return math.floor((min(max(value, scale.low), scale.high) - scale.low) * scale.factor + _BELOW_HALF)


def least_value(bin_: int, scale: Scale) -> float:
    """The least double of the scale whose bin is at least bin_ (from 1 to the top bin): bins never fall as values rise, so it is found
    by halving."""
    low, high = float(scale.low), float(scale.high)
    while (middle := low + (high - low) / 2) not in (low, high):
        if bin_of(middle, scale) >= bin_:
            high = middle
        else:
            low = middle
    return high


def bin_value(bin_: Column, scale: Scale) -> Column:
    """The value that a bin stands for."""
    return F.lit(float(scale.low)) + bin_ / F.lit(float(scale.top)) * F.lit(float(scale.high - scale.low))


def value_of(bin_: int, scale: Scale) -> float:
    """bin_value() for one Python number."""
    return scale.low + bin_ / scale.top * (scale.high - scale.low)


def fraction_bin(fraction: float, bits: int) -> int:
    """Bin at a fraction (clamped to 0..1) of all bins."""
    return math.floor(min(max(fraction, 0.0), 1.0) * ((1 << bits) - 1) + _BELOW_HALF)


def number(value: object) -> float:
    """A script's Number(): nothing and blank are 0, true is 1, text is parsed, all else is NaN."""
    if value is None:
        return 0.0
    if isinstance(value, (bool, int, float)):
        return float(value)
    if isinstance(value, str):
        text = value.strip()
        if not text:
            return 0.0
        for prefix, base in (("0x", 16), ("0o", 8), ("0b", 2)):
            if text[:2].lower() == prefix:
                try:
                    return float(int(text[2:], base))
                except ValueError:
                    return math.nan
        if text.lstrip("+-") == "Infinity":
            return -math.inf if text[0] == "-" else math.inf
        try:
            return float(text) if text.lower().lstrip("+-") not in ("inf", "infinity", "nan") and "_" not in text else math.nan
        except ValueError:
            return math.nan
    return math.nan


def text(value: object) -> str:
    """A script's String() of a plain value."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)
