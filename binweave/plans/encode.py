"""Fitting dimensions to a table and encoding it: each dimension becomes a column of bins, each value column one of floats.

All numeric dimensions are fitted by one aggregation. A text dimension's dictionary is the first labels by row order, at most as many as it
has bins (65,536), so it is small enough to broadcast; any other label shares the last bin. Null numbers go to bin 0 and are left out
of the fit, null texts are ''; with null_as="zero" null numbers count as 0 and null texts as 'null'."""

from __future__ import annotations

import json
import math
import sys
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce
from operator import and_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binweave.functions.quantize import Scale, bits_for, finite, least_value, quantize
from binweave.sources.tables import Table

#: Distinct labels from which a dimension is reported as too fine to chart.
MANY_LABELS = 10_000


@dataclass(frozen=True)
class Dimension:
    """A fitted dimension: position, resolution, and either a scale or labels by code. clean: no null, NaN or infinite value."""

    name: str
    position: int
    type: str
    bits: int
    scale: Scale | None = None
    labels: tuple[str, ...] = ()
    coded: bool = False
    clean: bool = False
    coarse_bins: int | None = None

    @property
    def bins(self) -> int:
        return 1 << self.bits

    @property
    def column(self) -> str:
        return f"b{self.position}"

    @property
    def fallback(self) -> int:
        """Code of a label outside the dictionary."""
        return max(0, min(len(self.labels), self.bins) - 1) if self.coded else self.bins - 1


@dataclass(frozen=True)
class Options:
    """bins: of all dimensions; dimensions: name -> bins, coarse_bins, domain (low, high) of that one, where None is
    the least or largest value."""

    bins: float | None = None
    dimensions: Mapping[str, Mapping] = field(default_factory=dict)
    null_as: str = "missing"

    def bits(self, name: str) -> int:
        own = self.dimensions.get(name, {}).get("bins")
        return bits_for(own if own is not None else self.bins)


def raw_number(column: Column, kind: T.DataType, null_as: str = "missing") -> Column:
    """A column as double: timestamps and dates as microseconds."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        column = F.unix_micros(column.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        column = F.unix_date(column) * F.lit(86_400_000_000)
    value = column.cast("double")
    return F.coalesce(value, F.lit(0.0)) if null_as == "zero" else value


def raw_text(column: Column, null_as: str = "missing") -> Column:
    return F.coalesce(column.cast("string"), F.lit("null" if null_as == "zero" else ""))


def _numeric(table: Table, name: str, null_as: str) -> Column:
    return raw_number(F.col(f"`{name}`"), table.df.schema[name].dataType, null_as)


def fit(table: Table, options: Options = Options()) -> list[Dimension]:
    """The fitted dimensions of a table, in its order."""
    sides = {n: options.dimensions.get(n, {}).get("domain") or (None, None) for n, t in table.types.items() if t == "number"}
    stats = _ranges(table, [n for n, side in sides.items() if None in side], options.null_as)
    found = _labels(table, {n: 1 << options.bits(n) for n, t in table.types.items() if t == "string" and n not in table.labels}, options.null_as)
    out = []
    for k, (name, kind) in enumerate(table.types.items()):
        bits = options.bits(name)
        coarse = options.dimensions.get(name, {}).get("coarse_bins")
        if kind == "string":
            labels = table.labels.get(name)
            if labels is None:
                out.append(Dimension(name, k, kind, bits, labels=tuple(found[name]), coarse_bins=coarse))
            else:
                if len(labels) > 1 << bits:
                    warnings.warn(f"{name} has {len(labels)} labels in {1 << bits} bins", stacklevel=2)
                out.append(Dimension(name, k, kind, bits, labels=tuple(labels), coded=True, coarse_bins=coarse))
            continue
        low, high, clean = stats.get(name, (None, None, False))
        if sides[name] != (None, None):  # both sides are given, or the other is that of the values
            low, high = (float(x) if x is not None else y for x, y in zip(sides[name], (low, high), strict=True))
            low = low if low is not None else high - 1
            high = high if high is not None and high > low else low + 1
        elif low is None or low == high:
            low, high = 0.0, float(1 << bits)
        out.append(Dimension(name, k, kind, bits, Scale(low, high, bits), clean=clean, coarse_bins=coarse))
    return out


def dump_fit(dims: Sequence[Dimension]) -> str:
    """Fitted dimensions as JSON, for load_fit()."""
    return json.dumps([asdict(d) for d in dims])


def load_fit(text: str) -> list[Dimension]:
    """Fitted dimensions from JSON, equal to those that dump_fit() was given."""
    return [Dimension(**{**d, "scale": Scale(**d["scale"]) if d["scale"] else None, "labels": tuple(d["labels"])}) for d in json.loads(text)]


def _ranges(table: Table, names: Sequence[str], null_as: str) -> dict[str, tuple[float | None, float | None, bool]]:
    """(least, largest, clean) of finite values, by one aggregation of all columns; those that turn out to have NaN or infinite values, which
    show as a range that isn't finite, take one more."""
    if not names:
        return {}
    plain, raw = [F.count(F.lit(1)).alias("n")], {n: _numeric(table, n, null_as) for n in names}
    for i, n in enumerate(names):
        plain += [F.min(raw[n]).alias(f"l{i}"), F.max(raw[n]).alias(f"h{i}"), F.count(raw[n]).alias(f"x{i}")]
    row = table.df.agg(*plain).first()
    out = {n: (row[f"l{i}"], row[f"h{i}"], row[f"x{i}"] == row["n"]) for i, n in enumerate(names)}
    strange = [n for n, (low, high, _) in out.items() if low is not None and not (math.isfinite(low) and math.isfinite(high))]
    if strange:
        good = [F.when(finite(raw[n]), raw[n]) for n in strange]
        row = table.df.agg(*[f(g) for g in good for f in (F.min, F.max)]).first()
        out |= {n: (row[2 * i], row[2 * i + 1], False) for i, n in enumerate(strange)}
    return out


def _labels(table: Table, bins: Mapping[str, int], null_as: str) -> dict[str, list[str]]:
    """The first labels of each of some columns by row order, at most so many of each, by one aggregation of all."""
    if not bins:
        return {}
    if table.order_by is None:
        raise ValueError(f"{', '.join(bins)}: text is coded by first appearance, and order_by must name the row order")
    names = list(bins)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), raw_text(F.col(f"`{n}`"), null_as).alias("label")) for k, n in enumerate(names)])).alias("x")
    seen = table.df.select(each, F.col(f"`{table.order_by}`").alias("at")).groupBy("x.k", "x.label").agg(F.min("at").alias("at"))
    if len(names) > 1:
        seen = seen.persist(StorageLevel.MEMORY_AND_DISK)
    found = None
    for k, n in enumerate(names):  # a limit for each column: tasks keep their first labels, no window gathers a column's
        first = seen.where(F.col("k") == k).orderBy(F.col("at").asc_nulls_last(), "label").limit(max(bins[n], MANY_LABELS + 1))
        found = first if found is None else found.unionByName(first)
    out: dict[str, list[tuple]] = {n: [] for n in names}
    for k, label, at in found.select("k", "label", "at").collect():
        out[names[k]].append((at is None, at, label))
    if len(names) > 1:
        seen.unpersist()
    for n, rows in out.items():
        if len(rows) > MANY_LABELS:
            warnings.warn(f"{n} has over {MANY_LABELS} labels", stacklevel=3)
    return {n: [r[2] for r in sorted(rows, key=lambda r: (r[0], 0 if r[0] else r[1], r[2]))[: bins[n]]] for n, rows in out.items()}


def _codes(df: DataFrame, table: Table, dim: Dimension, null_as: str) -> tuple[DataFrame, Column]:
    """df joined with a dictionary, and the column of codes."""
    if dim.coded:
        last: dict[str, int] = {label: i for i, label in enumerate(dim.labels)}
        codes = F.array(*[F.lit(min(last[label], dim.bins - 1)) for label in dim.labels])
        code = F.col(f"`{dim.name}`").cast("double")
        whole = finite(code) & (code >= 0) & (code < len(dim.labels)) & (code == F.floor(code))
        # a code without a label is its own text, which may be a label
        text = F.when(code == F.floor(code), code.cast("decimal(38,0)").cast("string")).otherwise(code.cast("string"))
        place = F.array_position(F.array(*[F.lit(x) for x in dim.labels]), F.coalesce(text, F.lit("NaN")))
        other = F.when(place > 0, F.element_at(codes, F.greatest(place, F.lit(1)).cast("int"))).otherwise(F.lit(dim.fallback))
        return df, F.when(whole, F.element_at(codes, code.cast("int") + 1)).otherwise(other)
    label, key, value = f"l_{dim.column}", f"k_{dim.column}", f"c_{dim.column}"
    words = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(dim.labels)], T.StructType([T.StructField(key, T.StringType()), T.StructField(value, T.IntegerType())]))
    df = df.withColumn(label, raw_text(F.col(f"`{dim.name}`"), null_as))
    # the dictionary has at most as many rows as the dimension has bins
    return df.join(F.broadcast(words), F.col(label) == F.col(key), "left"), F.coalesce(F.col(value), F.lit(dim.fallback)).cast("int")


def encode(table: Table, dims: Sequence[Dimension], values: Sequence[str] = (), keep: Sequence[str] = (), null_as: str = "missing") -> DataFrame:
    """Bins b0, b1, ... (by position; 0 for dimensions whose column the table lacks), floats v0, v1, ... of value columns (null, NaN: 0; unknown
    columns: 0), and the columns keep."""
    df, made = table.df, []
    for d in dims:
        if d.name not in table.df.columns:
            made.append(F.lit(0).alias(d.column))
        elif d.type == "number":
            made.append(quantize(_numeric(table, d.name, null_as), d.scale, d.clean).alias(d.column))
        else:
            df, code = _codes(df, table, d, null_as)
            made.append(code.alias(d.column))
    for i, name in enumerate(values):
        if name not in table.df.columns:
            made.append(F.lit(0.0).cast("float").alias(f"v{i}"))
            continue
        kind = table.df.schema[name].dataType
        v = F.col(f"`{name}`")
        v = v.try_cast("double") if isinstance(kind, T.StringType) else raw_number(v, kind)
        made.append(F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)).cast("float").alias(f"v{i}"))
    return df.select(*[F.col(f"`{c}`") for c in keep], *made)


def within_values(df: DataFrame, dim: Dimension, low: float, high: float) -> Column | None:
    """The condition on the raw column that exactly the rows of bins [low, high] meet, as comparisons with constants that reach the file
    scan; None where the column isn't a plain number.

    Bin 0 also holds null, NaN and infinite values; in Spark NaN is above all numbers, so an upper bound shuts NaN and infinity out."""
    if dim.name not in df.columns:
        return None
    scale, kind = dim.scale, df.schema[dim.name].dataType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if scale is None or not scale.factor or not (whole or isinstance(kind, T.DoubleType)):
        return None
    low, high = math.ceil(max(low, 0)), math.floor(min(high, scale.top))
    if low > high:
        return F.lit(False)
    column = F.col(f"`{dim.name}`")
    conditions = []
    if low >= 1:
        at = least_value(low, scale)
        conditions.append(column >= F.lit(math.ceil(at) if whole else at))
    if high < scale.top:
        at = least_value(high + 1, scale)
        conditions.append(column < F.lit(math.ceil(at) if whole else at))
    elif not whole and not dim.clean:
        conditions.append(column <= F.lit(sys.float_info.max))
        if low < 1:
            conditions.append(column >= F.lit(-sys.float_info.max))
    elif low >= 1 and not dim.clean:
        conditions.append(column.isNotNull())
    inside = reduce(and_, conditions, F.lit(True))
    if low >= 1 or dim.clean:
        return inside
    value = column.cast("double")
    return F.coalesce(inside, F.lit(False)) | ~finite(value)
