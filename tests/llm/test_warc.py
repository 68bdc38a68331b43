import hashlib
import random
from collections import Counter

import pytest

from binweave.llm import warc
from binweave.llm._common import shared_dir

EVIL = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 7\r\n\r\nabcdefg\r\n\r\nWARC/1.0\r\nContent-Length: 100000\r\n\r\n"


def pages(seed, n):
    rng = random.Random(seed)
    body = lambda: rng.choice([None, "", "é" * 120, EVIL * rng.randrange(1, 9), "x" * rng.randrange(3000), "y" * 99, "y" * 100])
    return [(i, f"http://h/{i} \r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n", body()) for i in range(n)] + [(None, None, "y" * 100), (None, None, None), (3, "u", "z" * 200), (3, "u", "z" * 200)]


def expected(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(b) if len(b) >= 100 else None
        again = f is not None and (i is None or i > f)
        out[None if i is None else str(i), "revisit" if again else "response", str(f) if again else None, len(b), hashlib.sha256(b).hexdigest(), None if again else b] += 1
    return out


@pytest.mark.parametrize("chunk", [8 << 20, 20_000, 700])
def test_round_trip(spark, chunk):
    rows = pages(5, 400)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    files = warc.write(df, shared_dir(spark, "w"), file_bytes=60_000)
    assert files.count() > 3
    got = warc.read(files, shared_dir(spark, "r"), chunk_bytes=chunk).collect()
    have = Counter((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], None if r["payload"] is None else bytes(r["payload"])) for r in got)
    assert have == expected(rows)
    light = warc.read(files, shared_dir(spark, "r"), with_payload=False, chunk_bytes=chunk)
    assert light.where("payload is not null").count() == 0
    assert light.count() == len(rows)


def test_empty_and_truncated(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    files = warc.write(none, shared_dir(spark, "w"))
    assert warc.read(files).count() == 0
    raw = b"".join(warc.record(i, "u", b"p" * 50, hashlib.sha256(b"p" * 50).hexdigest()) for i in range(4))
    (tmp_path / "a.warc").write_bytes(raw[:-30])
    (tmp_path / "b.warc").write_bytes(b"junk" + raw)
    (tmp_path / "c.warc").write_bytes(b"")
    got = warc.read(warc.files_under(spark, f"file://{tmp_path}/*.warc")).collect()
    assert sorted(r["record_id"] for r in got) == ["0", "1", "2"]


def test_files_of_failed_tasks_are_never_read(spark):
    folder = shared_dir(spark, "w")
    files = warc.write(spark.createDataFrame([(1, "u", "x" * 300)], "page_id long, url string, html string"), folder)
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(f"{folder}/archives")
    with store.open_output_stream(f"{root}/lost.warc") as f:
        f.write(warc.record(9, "u", b"z", "0"))
    assert [r["record_id"] for r in warc.read(files).collect()] == ["1"]


def test_exits():
    assert warc._exits([(0, 10), (4, 5), (10, 20), (12, 99)], 16) == [(0, 10, 20), (4, 5, 5), (10, 20, 20), (12, 99, 99)]


@pytest.mark.parametrize("chunk", [8 << 20, 20_000])
def test_headers_of_any_length(spark, chunk):
    long = [65_000, 65_535, 65_536, 70_000, 1_200_000]
    rows = [(i, "data:," + "u" * long[i // 2] if i % 2 and i < 10 else "http://h", f"page {i} " * 20 + EVIL.replace("\r\n\r\n", "\r\n") * (i % 3)) for i in range(20)]
    files = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), shared_dir(spark, "w"))
    got = warc.read(files, shared_dir(spark, "r"), chunk_bytes=chunk).collect()
    assert sorted((int(r["record_id"]), r["url"], bytes(r["payload"]).decode()) for r in got) == rows


def test_lost_records_raise(spark, tmp_path):
    raw = [warc.record(i, "u", b"p" * 50, hashlib.sha256(b"p" * 50).hexdigest()) for i in range(4)]
    for k, part in enumerate([b"".join(raw[:2]) + b"junk" + b"".join(raw[2:]), b"".join(raw[:2]) + raw[2].replace(b"Content-Length", b"Length")]):
        (tmp_path / f"{k}.warc").write_bytes(part)
        for chunk in (8 << 20, len(raw[0]) + len(raw[1])):
            with pytest.raises(Exception, match="no record at byte"):
                warc.read(warc.files_under(spark, f"file://{tmp_path}/{k}.warc"), chunk_bytes=chunk).collect()
    (tmp_path / "c.warc").write_bytes(b"".join(raw)[:-30])
    files = warc.files_under(spark, f"file://{tmp_path}/c.warc")
    assert warc.read(files.selectExpr("*", "3L as records")).count() == 3
    with pytest.raises(ValueError, match="3 records where 4 were written"):
        warc.read(files.selectExpr("*", "4L as records"))


def test_a_changed_byte_is_reported(spark, tmp_path):
    rows = [(1, "http://h/1", "x" * 300), (2, "http://h/" + "u" * 1_000_000, "y" * 200), (3, None, "x" * 300), (4, "http://h/4", "z")]
    files = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    got = warc.read(files, with_payload=False).drop("payload").cache()
    assert {(r["record_id"], r["record_type"], r["payload_bytes"]) for r in got.collect()} == {("1", "response", 300), ("2", "response", 200), ("3", "revisit", 300), ("4", "response", 1)}
    warc.check_revisits(got)
    with pytest.raises(ValueError, match="refers to 1"):
        warc.check_revisits(got.where("record_id <> '1'"))
    (file,) = (tmp_path / "w" / "archives").glob("*.warc")
    raw = file.read_bytes()
    broken = tmp_path / "broken.warc"
    broken.write_bytes(raw.replace(b"y" * 200, b"y" * 199 + b"Y"))
    with pytest.raises(Exception, match="another digest"):
        warc.read(warc.files_under(spark, f"file://{broken}")).count()
    broken.write_bytes(raw.replace(b"X-Payload-Length: 300", b"X-Payload-Length: 301"))
    with pytest.raises(ValueError, match="refers to 1"):
        warc.check_revisits(warc.read(warc.files_under(spark, f"file://{broken}")).cache())
