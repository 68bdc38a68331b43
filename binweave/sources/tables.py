"""Rows and columns held by Python, as DataFrames with their schema of dimensions."""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from binweave.functions.quantize import number, text

#: Rows of Python objects from which columns are advised.
MANY_ROWS = 100_000
_ORDER = "row_order"


@dataclass(frozen=True)
class Table:
    """A DataFrame, which of its columns are dimensions and of what type (number or string), and the column of row order, if any.

    labels: name -> labels of a column that holds integer codes."""

    df: DataFrame
    types: dict[str, str]
    order_by: str | None = None
    labels: dict[str, list[str]] = field(default_factory=dict)


def from_rows(spark: SparkSession, rows: Sequence[Mapping], slices: int | None = None) -> Table:
    """Rows as mappings. The first row names the dimensions: numbers make a number dimension, anything else a string one. Other values
    are converted as a script's Number() and String() do; a key that a row lacks is NaN or ''. No rows, no dimensions."""
    if not isinstance(rows, Sequence) or isinstance(rows, (str, bytes)):
        raise TypeError("expected a sequence of rows or columns of values")
    if len(rows) > MANY_ROWS:
        warnings.warn(f"{len(rows)} row objects; columns take less memory", stacklevel=2)
    types = {k: "number" if isinstance(v, (int, float)) and not isinstance(v, bool) else "string" for k, v in rows[0].items()} if rows else {}
    order = _ORDER
    while order in types:
        order = "_" + order
    schema = T.StructType([T.StructField(order, T.LongType()), *[T.StructField(k, T.DoubleType() if t == "number" else T.StringType()) for k, t in types.items()]])
    made = [(i, *[(number(r[k]) if k in r else math.nan) if t == "number" else (text(r[k]) if k in r else "") for k, t in types.items()]) for i, r in enumerate(rows)]
    return Table(spark.createDataFrame(made, schema), types, order)


def from_columns(spark: SparkSession, columns: Mapping[str, Sequence], categories: Mapping[str, Sequence[str]] | None = None, length: int | None = None) -> Table:
    """Columns of numbers, all of one length. A column with categories holds codes into its labels and is a string dimension."""
    if not isinstance(columns, Mapping) or not columns:
        raise ValueError("at least one column is needed")
    sizes = {len(v) for v in columns.values()}
    if len(sizes) > 1 or length is not None and sizes != {length}:
        raise ValueError(f"columns differ in length: {sorted(sizes | ({length} if length is not None else set()))}")
    for name, labels in (categories or {}).items():
        if isinstance(labels, (str, bytes)) or not isinstance(labels, Sequence) or not labels:
            raise ValueError(f"categories of {name} must be a list of at least one label")
    labels = {k: [str(x) for x in v] for k, v in (categories or {}).items() if k in columns}
    types = {k: "string" if k in labels else "number" for k in columns}
    order = _ORDER
    while order in types:
        order = "_" + order
    plain = lambda x: x.item() if hasattr(x, "item") else x
    schema = T.StructType([T.StructField(order, T.LongType()), *[T.StructField(k, T.DoubleType()) for k in columns]])
    made = [(i, *[None if (v := plain(x)) is None else float(v) for x in row]) for i, row in enumerate(zip(*columns.values(), strict=True))]
    return Table(spark.createDataFrame(made, schema), types, order, labels)


def from_frame(df: DataFrame, dims: Sequence[str] | None = None, order_by: str | None = None, labels: Mapping[str, Sequence[str]] | None = None) -> Table:
    """Columns of a DataFrame (all but order_by, unless dims names some). Numeric, boolean and text columns can be dimensions; timestamps
    are numbers of microseconds. order_by is the row order that text dimensions are coded by."""
    known = {f.name: f.dataType for f in df.schema.fields}
    names = list(dims) if dims is not None else [n for n in known if n != order_by]
    for n in names:
        if n not in known:
            raise KeyError(f"no column {n}")
    numeric = (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)
    types = {n: "number" if isinstance(known[n], numeric) and n not in (labels or {}) else "string" for n in names}
    return Table(df, types, order_by, {k: [str(x) for x in v] for k, v in (labels or {}).items()})
