import struct

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from binweave.llm import isomedia as m


@given(st.binary(max_size=400))
def test_round_trip(raw):
    payload = m.padded(raw)
    assert len(payload) % 64 == 0
    assert len(payload) - len(raw) <= 64
    assert payload[: len(raw)] == raw
    file = m.write(payload)
    brand, tracks, problem = m.parse(file)
    assert (brand, problem, len(tracks)) == ("qt  ", "", 1)
    assert m.samples(file, tracks[0]) == payload
    brand, (t,), problem = m.describe(file)
    assert (t["codec"], t["handler"], t["n_samples"], t["n_keyframes"]) == ("raw ", "vide", len(payload) // 64, len(payload) // 64)
    assert t["duration_s"] == t["n_samples"] / 25
    (r,) = t["keyframe_ranges"]
    assert file[r["start"] : r["stop"]] == payload
    assert r["time_s"] == 0


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind, *values, fmt=None):
    return box(kind, bytes(4), struct.pack(">" + (fmt or "I" * len(values)), *values))


def movie(*tables, timescale=1000, duration=500, rest=b"", ident=1, handler=b"vide"):
    mdhd = box(b"mdhd", b"\1\0\0\0", struct.pack(">QQIQI", 0, 0, timescale, duration, 0))
    return box(b"trak", full(b"tkhd", 0, 0, ident, 0), box(b"mdia", mdhd, box(b"hdlr", bytes(8), handler), box(b"minf", box(b"stbl", *tables)))) + rest


def test_sample_tables_with_sync_samples_and_uneven_chunks():
    sizes, chunks = [10, 20, 30, 40, 50], [1000, 2000, 3000]
    tables = [full(b"stsd", 1), full(b"stsc", 2, 1, 2, 1, 3, 1, 1), full(b"stco", 3, *chunks), full(b"stss", 2, 1, 4), full(b"stts", 2, 2, 100, 3, 7)]
    head = box(b"ftyp", b"isom", bytes(4)) + struct.pack(">I4sQ", 1, b"free", 20) + bytes(4)
    for size in (full(b"stsz", 0, 5, *sizes), box(b"stz2", struct.pack(">III5B", 0, 8, 5, *sizes)), box(b"stz2", struct.pack(">III5H", 0, 16, 5, *sizes))):
        brand, tracks, problem = m.parse(head + box(b"moov", movie(*tables, size)))
        t = tracks[0]
        assert (brand, problem) == ("isom", "")
        assert (t.timescale, t.duration(), t.handler) == (1000, 500, "vide")
        assert t.keyframes() == [(1000, 1010, 0), (2030, 2070, 207)]
        assert t.extents() == [(1000, 1030), (2000, 2070), (3000, 3050)]
        t.sync = None
        assert t.keyframes() == [(1000, 1030, 0), (2000, 2070, 200), (3000, 3050, 214)]
        t.stated = 0
        assert t.duration() == 221
    four = m.parse(box(b"moov", movie(*tables, box(b"stz2", struct.pack(">III", 0, 4, 5), bytes([0x12, 0x34, 0x50])))))[1][0]
    assert four.sizes.tolist() == [1, 2, 3, 4, 5]


def test_two_tracks():
    one = movie(full(b"stsd", 1), full(b"stsc", 1, 1, 3, 1), full(b"stsz", 7, 3), full(b"stco", 1, 500), full(b"stss", 1, 2))
    two = movie(full(b"stsd", 1), full(b"stsc", 1, 1, 2, 1), full(b"stsz", 5, 4), full(b"stco", 2, 600, 700), timescale=10, handler=b"soun", ident=2)
    _, tracks, problem = m.describe(box(b"moov", one, two))
    assert problem == ""
    assert [(t["handler"], t["duration_s"], t["n_samples"], t["n_keyframes"]) for t in tracks] == [("vide", 0.5, 3, 1), ("soun", 50.0, 4, 4)]
    assert [[(r["start"], r["stop"]) for r in t["keyframe_ranges"]] for t in tracks] == [[(507, 514)], [(600, 610), (700, 710)]]


def test_fragments():
    empty = [full(b"stsd", 1), full(b"stsc", 0), full(b"stsz", 0, 0), full(b"stco", 0), full(b"stts", 0)]
    trex = full(b"trex", 1, 1, 40, 9, 0x10000)
    moov = box(b"moov", movie(*empty, duration=0), box(b"mvex", trex))
    flag = lambda kind, flags, *values: box(kind, struct.pack(">I", flags), struct.pack(f">{len(values)}I", *values))
    first = box(b"moof", box(b"traf", flag(b"tfhd", 0x20000, 1), flag(b"tfdt", 0, 100), flag(b"trun", 0x205, 3, 200, 0, 10, 20, 30), flag(b"trun", 0x500, 2, 5, 0x10000, 6, 0)))
    second = box(b"moof", box(b"traf", flag(b"tfhd", 0x20010, 1, 4), flag(b"trun", 0x1, 2, 50)))
    file = moov + first + second
    _, (t,), problem = m.parse(file)
    a, b = len(moov), len(moov) + len(first)
    assert problem == ""
    assert t.extents() == _extents([(a + 200, a + 260), (a + 260, a + 278), (b + 50, b + 58)])
    assert t.keyframes() == [(a + 200, a + 210, 100), (a + 269, a + 278, 100 + 120 + 5)]
    assert (t.count(), t.keys(), t.duration()) == (7, 2, 100 + 120 + 11 + 80)
    assert "moov does not have" in m.parse(file + box(b"moof", box(b"traf", flag(b"tfhd", 0, 9))))[2]


def _extents(ranges):
    return m._joined(ranges)


@pytest.mark.parametrize("cut", [1, 9, 30, 200, 500])
def test_broken_files_are_reported(cut):
    whole = m.write(b"x" * 128)
    assert m.describe(whole[:cut])[-1]
    assert m.describe(b"") == ("", [], "")
    assert m.describe(b"not a media file at all")[-1]


def test_claims_and_depth_take_no_memory():
    import tracemalloc

    tracemalloc.start()
    huge = box(b"moov", movie(full(b"stsz", 1, 0xFFFFFFFF), full(b"stco", 1, 8), full(b"stsc", 1, 1, 0xFFFFFFFF, 1)))
    brand, tracks, problem = m.describe(huge)
    assert (problem, tracks[0]["n_samples"]) == ("", 0xFFFFFFFF)
    assert m.describe(box(b"moov", movie(full(b"stsz", 1, 0xFFFFFFFF), full(b"stco", 1, 8), full(b"stsc", 1, 1, 2, 1))))[-1]
    assert m.describe(box(b"moov", movie(full(b"stsz", 0, 0xFFFFFFFF))))[-1]
    trun = box(b"moof", box(b"traf", full(b"tfhd", 1), full(b"trun", 0xFFFFFFFF)))
    assert m.describe(box(b"moov", movie(full(b"stsz", 0, 0))) + trun)[1][0]["n_samples"] == 0xFFFFFFFF
    deep = b""
    for _ in range(5000):
        deep = box(b"trak", deep)
    assert len(m.parse(deep)[1]) == 5000
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()


WHOLE = m.write(bytes(range(64)) * 4)
OTHER = box(b"moov", movie(full(b"stsd", 1), full(b"stsc", 2, 1, 2, 1, 3, 1, 1), full(b"stsz", 0, 3, 4, 5, 6), full(b"stco", 2, 9, 50), full(b"stss", 2, 1, 3), full(b"stts", 1, 3, 9)), box(b"mvex", full(b"trex", 1, 1, 40, 9, 0)))
OTHER += box(b"moof", box(b"traf", full(b"tfhd", 1), full(b"tfdt", 5), full(b"trun", 2)))


@settings(max_examples=1500, deadline=None)
@given(st.sampled_from([WHOLE, OTHER]), st.lists(st.tuples(st.integers(0, 10_000), st.integers(0, 255) | st.sampled_from([0, 1, 0xFF])), max_size=8), st.integers(0, 700))
def test_damaged_files_never_raise(file, changes, cut):
    raw = bytearray(file)
    for at, value in changes:
        raw[at % len(raw)] = value
    raw = bytes(raw[: len(raw) - cut % 7 * 20])
    brand, tracks, problem = m.describe(raw)
    for t in m.parse(raw)[1]:
        if not problem:
            assert len(m.samples(raw, t)) <= len(raw) * (len(t.chunks) + len(t.fragments) + 1)
    pa.array([{"tracks": tracks}], pa.struct([("tracks", m.PROBED[1][1])]))


def test_frames(spark):
    df = spark.createDataFrame([(1, "a" * 64, "x"), (2, None, "y"), (3, "", None), (1, "a" * 64, "x")], "doc_id long, text string, codec string")
    stored = m.store_text(df, "text")
    out = {(r["doc_id"], r["text"]): r for r in m.read_back(m.probe(stored, "media"), "media").collect()}
    assert len(out) == 3
    assert bytes(out[2, None]["payload"]) == bytes(64) == bytes(out[3, ""]["payload"])
    assert bytes(out[1, "a" * 64]["payload"]) == b"a" * 64
    assert out[1, "a" * 64]["tracks"][0]["codec"] == "raw "
    assert m.probe(m.store_text(df.limit(0), "text"), "media").count() == 0
