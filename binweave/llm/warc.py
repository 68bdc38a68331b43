"""WARC 1.1 archives: a deduplicating writer, and a reader that splits files and verifies the chain of record boundaries.

Writer: of the rows with equal payloads of at least 100 bytes, those with the smallest id are `response`; others are `revisit`, without
a payload, and name that id. Smaller payloads are always `response`. Null payloads are empty. A null id is larger than any other; where
all ids of a payload are null, or a row is repeated, all those rows are `response`. Null URLs have no header. Each task writes files of
its own under fresh names, and only files that a finished task reports are ever read, so lost or repeated tasks leave no records twice.

Reader: a task takes a byte range (chunk) of a file and emits every place that reads as a record's start, magic inside payloads included,
with its successor: where the next record would begin by its length. Inside a chunk, successors are followed at once to the first place
beyond it. Among chunks, pointer jumping from offset 0 doubles the distance each round, so a file of n chunks takes log2(n) rounds of joins
on a row for each candidate entry. Only what offset 0 reaches is read as a record. Headers may have any length. A record cut off by the end of its file is left out;
a chain that ends earlier, and one of fewer or more records than the files' column `records` says, if there is one, raise an error. So does a
payload whose SHA-256 differs from a digest of that kind in its header, and, by check_revisits(), a revisit whose header states another size or digest
than a record that was read has. Extra columns of pages, whatever their names, are not read; an empty table gives no file and no rows."""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binweave.llm._common import bound_batches, shared_dir, stored, texts

#: Payloads below this many bytes are never revisits; a file is closed after so many bytes; a reading task's share of a file.
LEAST, FILE_BYTES, CHUNK_BYTES = 100, 256 << 20, 8 << 20
#: Bytes of a header read at first, and bytes read at once.
HEADER_BYTES, READ_BYTES = 1 << 16, 1 << 20
_START = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*(?=\r\n|$)", re.IGNORECASE)
_PROFILE = b"http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"

FILE = T.StructType([T.StructField("file", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("records", T.LongType())])
RECORD = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("refers_to", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload", T.BinaryType()),
])


def revisits(pages: DataFrame, key: str, payload: str, least: int = LEAST) -> DataFrame:
    """(key, digest, first): the rows that repeat a payload, once each, with the smallest key that has it. Payloads stay where they are."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    narrow = pages.where(F.octet_length(payload) >= least).select(F.col(key).alias("key"), F.sha2(body, 256).alias("digest"))
    first = narrow.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    return narrow.join(first, "digest").where(F.col("key").isNull() | (F.col("key") > F.col("first"))).select("key", "digest", "first").distinct()


def record(key: object, url: str | None, payload: bytes, digest: str, first: object = None) -> bytes:
    """The bytes of one record; a revisit where first is given."""
    clean = lambda x: re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", str(x)).encode()
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if first is None else b"revisit"), b"WARC-Record-ID: <urn:row:" + (b"" if key is None else clean(key)) + b">", b"WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(b"WARC-Target-URI: " + clean(url))
    head.append(b"WARC-Payload-Digest: sha256:" + digest.encode())
    if first is not None:
        head += [b"WARC-Profile: " + _PROFILE, b"WARC-Refers-To: <urn:row:" + clean(first) + b">", b"X-Payload-Length: %d" % len(payload)]
        payload = b""
    head += [b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
    return b"\r\n".join(head) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row under folder, and return the files (FILE), stored beside them."""
    bound_batches(pages.sparkSession)
    again = stored(revisits(pages, key, payload), f"{folder}/revisits")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(payload).alias("payload"), F.sha2(F.coalesce(F.col(payload), F.lit("")).cast("binary"), 256).alias("digest"))
    if not again.isEmpty():
        r = again.select(F.col("key").alias("k"), F.col("digest").alias("d"), "first")
        rows = rows.join(r, F.col("key").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d")), "left").drop("k", "d")
    else:
        rows = rows.withColumn("first", F.lit(None).cast(pages.schema[key].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(f"{folder}/archives")
        store.create_dir(root, recursive=True)
        out, made, size, n = None, [], 0, 0

        def close():
            nonlocal out, size, n
            if out is not None:
                out.close()
                made.append((f"{folder}/archives/{name}", size, n))
            out, size, n = None, 0, 0

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "url", "digest", "first")]
            for k, u, d, first, body in zip(*columns, texts(batch.column("payload")), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc"
                    out = store.open_output_stream(f"{root}/{name}")
                out.write(raw := record(k, u, body, d, first))
                size, n = size + len(raw), n + 1
                if size >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=FILE.names)

    return stored(rows.mapInArrow(run, FILE), f"{folder}/files").where("records > 0")


class _Source:
    """Ranges of one file; the last blank line searched for is kept."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        self.uri, self.file = uri, store.open_input_file(path)
        self.size = self.file.size()
        self.searched, self.blank = 0, -1

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(max(0, min(n, self.size - at)), at) if at < self.size else b""

    def blank_line(self, at: int) -> int:
        """Place of the first blank line at or after a place, the file's size if there is none."""
        if not self.searched <= at <= self.blank:
            self.searched, k = at, at
            while k < self.size and (stop := self.read(k, READ_BYTES + 3).find(b"\r\n\r\n")) < 0:
                k += READ_BYTES
            self.blank = k + stop if k < self.size else self.size
        return self.blank

    def header(self, at: int, near: bytes = b"") -> tuple[bytes, int, int] | None:
        """Header, payload's start and length of a record that would begin at a place; None if none can."""
        raw = near
        if (stop := raw.find(b"\r\n\r\n")) < 0 and len(raw) < HEADER_BYTES:
            raw = self.read(at, HEADER_BYTES)
            stop = raw.find(b"\r\n\r\n")
        if stop < 0 and _START.match(raw):
            lines = raw.split(b"\r\n")[1:-1]
            if not all(b":" in x or x[:1] in (b" ", b"\t") for x in lines) or self.blank_line(at) == self.size:
                return None  # payload after a magic, or cut off
            stop = self.blank_line(at) - at
            raw = self.read(at, stop)
        if stop < 0 or not _START.match(raw) or not (m := _LENGTH.search(raw, 0, stop)):
            return None
        return raw[:stop], at + stop + 4, int(m[1])

    def check_end(self, at: int) -> None:
        """An error if a chain of records ends at a place before the file's end at which no cut-off record begins."""
        if at >= self.size or self.header(at):
            return
        raw = self.read(at, 10)
        if not (b"WARC/1.0\r\n".startswith(raw) or b"WARC/1.1\r\n".startswith(raw)) or self.blank_line(at) < self.size:
            raise ValueError(f"{self.uri}: no record at byte {at} of {self.size}, where the one before ends")

    def candidates(self, start: int, stop: int) -> Iterator[tuple[int, int]]:
        """(offset, successor) of each place in a range that reads as a record's start."""
        at, margin = start, 12
        while at < stop:
            block = self.read(at, min(READ_BYTES, stop - at) + margin)
            for m in _START.finditer(block):
                if at + m.start() >= min(at + READ_BYTES, stop):
                    break
                if found := self.header(at + m.start(), block[m.start() : m.start() + 2048]):
                    yield at + m.start(), found[1] + found[2] + 4
            at += READ_BYTES


def _exits(found: list[tuple[int, int]], stop: int) -> list[tuple[int, int, int]]:
    """(offset, successor, first place that the successors reach at or beyond stop or that is no candidate)."""
    out: dict[int, int] = {}
    for at, after in reversed(found):
        out[at] = out.get(after, after) if after < stop else after
    return [(at, after, out[at]) for at, after in found]


def _whole(found: list[tuple[int, int]], stop: int, size: int) -> list[int]:
    """How many records that their file of a size does not cut off the chain of each candidate has in a range."""
    out: dict[int, int] = {}
    for at, after in reversed(found):
        out[at] = (after - 4 <= size) + (out.get(after, 0) if after < stop else 0)
    return [out[at] for at, _ in found]


def candidates(chunks: DataFrame) -> DataFrame:
    """(file, start, stop, offset, successor, exit, n) of all candidates of chunks (file, start, stop); n is that of _whole()."""
    names = ["file", "start", "stop", "offset", "successor", "exit", "n"]

    def run(batches):
        for batch in batches:
            for file, start, stop in zip(*[batch.column(c).to_pylist() for c in ("file", "start", "stop")], strict=True):
                source = _Source(file)
                places = list(source.candidates(start, stop))
                got = [(*e, n) for e, n in zip(_exits(places, stop), _whole(places, stop, source.size), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(got), pa.string()), *[pa.array([x] * len(got), pa.int64()) for x in (start, stop)], *[pa.array([g[i] for g in got], pa.int64()) for i in range(4)]], names=names)

    return chunks.mapInArrow(run, "file string, start long, stop long, offset long, successor long, exit long, n long")


def chunks_of(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(file, start, stop) for files (file, bytes), dealt out evenly."""
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(chunk_bytes).cast("long")))
    spark = files.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = files.where("bytes > 0").select("file", "bytes", cut.alias("start")).select("file", "start", F.least(F.col("start") + chunk_bytes, F.col("bytes")).alias("stop"))
    return out.repartition(tasks)


def entries(found: DataFrame, files: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(file, offset, stop): of each chunk that a file's chain enters, where it does. Stored round by round under folder."""
    most = files.agg(F.max("bytes")).first()[0] or 0
    rounds = math.ceil(math.log2(max(1, -(-most // chunk_bytes))))
    start = found.where("offset = 0").select("file", "offset", "stop")
    if not rounds:
        return start
    targets = found.where("exit >= stop").select("file", F.col("exit").alias("offset")).distinct()
    nodes = stored(found.join(targets, ["file", "offset"], "left_semi").select("file", "offset", "stop", "exit").unionByName(found.where("offset = 0").select("file", "offset", "stop", "exit")).distinct(), f"{folder}/nodes")
    jump, reached = nodes.select("file", "offset", F.col("exit").alias("to")), nodes.where("offset = 0").select("file", "offset")
    for k in range(rounds):
        new = reached.join(jump, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        reached = stored(reached.union(new).distinct(), f"{folder}/reached{k}")
        if k + 1 < rounds:
            onward = jump.select("file", F.col("offset").alias("to"), F.col("to").alias("beyond"))
            jump = stored(jump.join(onward, ["file", "to"]).select("file", "offset", F.col("beyond").alias("to")), f"{folder}/jump{k}")
    return nodes.select("file", "offset", "stop").join(reached, ["file", "offset"], "left_semi")


def _records(source: _Source, file: str, at: int, stop: int, with_payload: bool) -> Iterator[tuple]:
    unwrap = lambda x: re.sub(r"^<urn:row:(.*)>$", r"\1", x) if x is not None else None
    while at < stop and (found := source.header(at)):
        head, begin, length = found
        if begin + length > source.size:
            return
        fields = {}
        for line in head.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        kind, digest, size, payload = fields.get("warc-type", ""), hashlib.sha256(), length, [] if with_payload else None
        for k in range(begin, begin + length, READ_BYTES):
            digest.update(piece := source.read(k, min(READ_BYTES, begin + length - k)))
            if payload is not None:
                payload.append(piece)
        value, stated = digest.hexdigest(), fields.get("warc-payload-digest", "")
        if kind == "revisit":  # its payload is the other's
            size, value = int(fields.get("x-payload-length") or 0), stated.removeprefix("sha256:")
        elif stated.startswith("sha256:") and stated.removeprefix("sha256:") != value:
            raise ValueError(f"{file}: the payload of the record at byte {at} has another digest than its header states")
        yield file, at, kind, unwrap(fields.get("warc-record-id")) or None, fields.get("warc-target-uri"), unwrap(fields.get("warc-refers-to")), size, value, None if payload is None or kind == "revisit" else b"".join(payload)
        at = begin + length + 4
    source.check_end(at)


def read(files: DataFrame, folder: str | None = None, with_payload: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Records (RECORD) of files (file, bytes and, to be compared with, records). Digest and size are of the bytes read; a revisit's are those its header
    states, for check_revisits(), and it has no payload. folder holds the candidates and the rounds of pointer jumping."""
    spark: SparkSession = files.sparkSession
    folder = folder or shared_dir(spark, "warc")
    found = stored(candidates(chunks_of(files, chunk_bytes)), f"{folder}/candidates")
    into = stored(entries(found, files, folder, chunk_bytes), f"{folder}/entries")
    if "records" in files.columns:
        have = into.join(found.select("file", "offset", "stop", "n"), ["file", "offset", "stop"]).groupBy("file").agg(F.sum("n").alias("n"))
        wrong = files.join(have, "file", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> records").select("file", "n", "records").first()
        if wrong:
            raise ValueError(f"{wrong[0]}: {wrong[1]} records where {wrong[2]} were written")

    def run(batches):
        for batch in batches:
            for file, at, stop in zip(*[batch.column(c).to_pylist() for c in ("file", "offset", "stop")], strict=True):
                source, rows, held = _Source(file), [], 0
                for r in _records(source, file, at, stop, with_payload):
                    rows.append(r)
                    held += len(r[-1] or b"")
                    if held > 4 * READ_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return into.repartition(tasks).mapInArrow(run, RECORD)


def check_revisits(records: DataFrame) -> None:
    """An error if a revisit names a record that isn't among records (RECORD, stored) or has another size or digest. Revisits of one record are
    one row before anything moves."""
    stated = records.where("record_type = 'revisit'").groupBy("refers_to", "payload_digest", "payload_bytes").agg(F.min("record_id").alias("record_id"))
    known = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    if lost := stated.join(known, ["refers_to", "payload_digest", "payload_bytes"], "left_anti").first():
        raise ValueError(f"the revisit {lost['record_id']} refers to {lost['refers_to']}, of which no record of its size and digest was read")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=RECORD.names)


def files_under(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, bytes) of the files that a path or pattern names, for read(); contents aren't loaded."""
    return spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


#: DuckDB SQL for the records of `pages` written and read back.
ORACLE_SQL = """
WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d),
r AS (SELECT p.*, CASE WHEN n >= 100 AND (page_id IS NULL OR page_id > first) THEN first END AS refers_to FROM p LEFT JOIN f USING (d))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CAST(refers_to AS BIGINT) AS refers_to, url FROM r
"""
