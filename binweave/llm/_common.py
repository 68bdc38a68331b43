"""Plumbing shared by the training-data operators: shared folders, column names, bounded Arrow slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binweave.plans.storage import shared_dir, stored  # noqa: F401  the operators' too

#: Text bytes handled at once inside a task; temporary arrays are a small multiple of this.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch between Spark and a task's Python, where the session allows more.
BATCH_ROWS = 1000
#: Bits of a sieve for each key, and at most (8 MB).
SIEVE_BITS, SIEVE_MOST = 16, 1 << 26


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder made by shared_dir."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def bound_batches(spark: SparkSession) -> None:
    """At most BATCH_ROWS rows in an Arrow batch: whole texts in batches of Spark's 10,000 rows take hundreds of MB on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_key(key: str, text: str) -> Column:
    """(k, h): what tells rows apart where ids repeat or are null: the id and a hash of the text."""
    return F.struct(F.col(f"`{key}`").alias("k"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("h"))


def sieve(hashes: DataFrame) -> Callable[[Column], Column] | None:
    """A condition on a 64-bit hash that every hash of a column (the first of hashes) meets, and few others: a bit set, summed up by
    the executors. None where a set of SIEVE_MOST bits would be too full to tell. Rows that fail it need no join."""
    h = F.col(hashes.columns[0])
    n = hashes.count()
    bits = max(1 << 10, 1 << (SIEVE_BITS * n - 1).bit_length() if n else 0)
    if bits > SIEVE_MOST:
        if 4 * n > SIEVE_MOST:
            return None
        bits = SIEVE_MOST
    place = hashes.select(F.pmod(h, F.lit(bits)).alias("p")).selectExpr("shiftright(p, 6) AS w", "shiftleft(1L, CAST(p & 63 AS INT)) AS b")
    words = place.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(bits >> 6, np.int64)
    table[words["w"].to_numpy()] = words["b"].to_numpy()
    known = table.view(np.uint64)

    @F.arrow_udf("boolean")
    def there(x: pa.Array) -> pa.Array:
        at = x.to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(bits - 1)  # bits is a power of two
        return pa.array((known[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1)

    return there


def without(df: DataFrame, keys: DataFrame, key: str, text: str) -> DataFrame:
    """df without the rows whose row_key is among keys (one struct column, stored). Rows that the keys' sieve clears aren't moved; Spark joins
    the rest, broadcasting keys where their file is below spark.sql.autoBroadcastJoinThreshold, else by sorting."""
    name, have = free_name(df, "_key"), keys.select(F.col(keys.columns[0])["k"].alias("_k"), F.col(keys.columns[0])["h"].alias("_h"))
    rows = df.withColumn(name, row_key(key, text))
    match = lambda left: left.join(have, left[name]["k"].eqNullSafe(have["_k"]) & (left[name]["h"] == have["_h"]), "left_anti")
    maybe = sieve(have.select("_h"))
    if maybe is None:
        return match(rows).drop(name)
    hit = maybe(F.col(name)["h"])
    return rows.where(~hit).unionByName(match(rows.where(hit))).drop(name)


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of doc_id as text modulo mod; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether the remainder is rest; false for a null doc_id."""
    return F.coalesce(remainder(doc_id, mod) == rest, F.lit(False))


#: Bytes of training texts that come to the driver, of all classes together.
SAMPLE_BYTES = 32 << 20


def class_sample(rows: DataFrame, label: str, key: str, cap: int, text: str | None = None, most_bytes: int = SAMPLE_BYTES, classes: int = 1000) -> DataFrame:
    """Of each of the `classes` most frequent label values about cap distinct rows, and no more than have about an equal share of most_bytes
    of text; all distinct rows where there are fewer. Rows are drawn by a hash of key and text, so the same ones each time, and equal rows count
    once. Rows of rarer labels are left out."""
    body = F.coalesce(F.col(text), F.lit("")) if text else F.lit("")
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(body)).alias("bytes")).orderBy(F.desc("n"), label).limit(classes).collect()
    if not counts:
        return rows.limit(0)
    share = most_bytes / len(counts)
    kept = [(value, min(1.0, cap / n, share / max(size, 1))) for value, n, size in counts]
    schema = T.StructType([T.StructField("_value", rows.schema[label].dataType), T.StructField("_keep", T.DoubleType())])
    keep = F.broadcast(rows.sparkSession.createDataFrame(kept, schema))  # at most `classes` rows
    drawn = F.pmod(F.xxhash64(F.col(key).cast("string"), body, F.lit("sample")), F.lit(1_000_000))
    return rows.join(keep, F.col(label) == F.col("_value")).where(drawn < F.col("_keep") * 1_000_000).drop("_value", "_keep").distinct()


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, known: Column, cap: int, columns: list[str]) -> DataFrame:
    """(y, t and `columns` of documents) of about cap labelled documents of each class (0 or 1) within SAMPLE_BYTES, of those labels whose
    doc_id (k) meets `known`. The drawn ids, of which there are about 2 cap at most, are broadcast; the drawn documents are stored before their
    bytes are counted, so an id that many documents share is no danger."""
    marks = labels.select(F.col("doc_id").alias("k"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("k").isNotNull() & known)
    chosen = class_sample(marks, "y", "k", cap)
    text = documents.select(F.col("doc_id").alias("d"), F.coalesce("text", F.lit("")).alias("t"), *columns)
    found = stored(text.join(F.broadcast(chosen), F.col("d") == F.col("k")).drop("d"), shared_dir(documents.sparkSession, "sample"))
    return class_sample(found, "y", "k", cap, "t")


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary array and len+1 offsets into them; nulls are empty."""
    kind = pa.large_binary() if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else pa.large_string()
    arr = arr.cast(kind)
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if kind == pa.large_binary() else "")
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], np.int64, len(arr) + 1, arr.offset * 8) if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and off[-1] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def texts(arr: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; nulls are empty."""
    data, off = utf8(arr)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the bytes of column would pass most; a longer single row is a slice of its own."""
    arr = batch.column(column)
    if not len(arr):
        return
    end = np.cumsum(np.diff(utf8(arr)[1]))
    start = 0
    while start < len(arr):
        done = end[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(end, done + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def attach(df: DataFrame, text: str, columns: list[tuple[str, T.DataType]], make: Callable[[], Callable[[pa.RecordBatch], list]], keep: list[str] | None = None) -> DataFrame:
    """df with columns computed from slices of it; make() runs once a task and returns the function of a slice.

    keep: the input columns of the result (all if None). One with the name of a computed column is replaced by that."""
    bound_batches(df.sparkSession)
    new = {n.lower() for n, _ in columns}
    kept = [f for f in df.schema.fields if f.name.lower() not in new and (keep is None or f.name in keep)]
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in columns]])
    names = [f.name for f in kept]

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *work(part)], names=schema.names)

    return df.mapInArrow(run, schema)
