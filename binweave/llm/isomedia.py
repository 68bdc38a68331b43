"""ISO base media files (ISO/IEC 14496-12) in binary columns: a reader of boxes and sample tables, and a lossless raw-video writer.

The reader never touches sample payloads: codec, duration and the byte ranges and times of sync samples come from the boxes alone, those of
moov (stsd, stts, stsc, stsz or stz2, stco or co64, stss) and of fragments (trex, tfhd, tfdt, trun). Tables are read by runs and chunks, so
a header that claims billions of samples takes no more memory than the bytes it has. Boxes may nest to any depth.

A null or empty file has no tracks; a truncated, damaged or foreign file gives error text in `problem` and what was found until there, and never
an exception. Repeated rows give repeated results; nothing is cut however long; columns of the input named as computed ones are replaced, others kept; an
empty table gives no rows."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from binweave.llm._common import attach, texts

#: Boxes that hold boxes.
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"moof", b"traf", b"mvex"))
#: Flags of tfhd, trun and samples that say which fields follow, and that a sample is none to start at.
TFHD = ((0x1, ">Q"), (0x2, ">I"), (0x8, ">I"), (0x10, ">I"), (0x20, ">I"))
NOT_SYNC = 0x10000
#: The writer's frame: 8 x 8 samples of 8 bits, 25 frames a second.
FRAME, SIDE, RATE = 64, 8, 25


def boxes(data: memoryview, start: int, stop: int):
    """(kind, payload start, end, box start) of the boxes in a range; 64-bit sizes and size 0 (to the end) are understood."""
    while start < stop:
        if stop - start < 8:
            raise ValueError(f"box header cut off at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if stop - start < 16:
                raise ValueError(f"box header cut off at {start}")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = stop - start
        if size < head or start + size > stop:
            raise ValueError(f"box {kind!r} at {start} passes its parent's end")
        yield kind, start + head, start + size, start
        start += size


def walk(data: memoryview, start: int, stop: int):
    """(kind of the parent, kind, box start, payload start, end) of all boxes, parents first."""
    level, parent = [boxes(data, start, stop)], [b""]
    while level:
        if (box := next(level[-1], None)) is None:
            level.pop()
            parent.pop()
            continue
        kind, a, b, at = box
        yield parent[-1], kind, at, a, b
        if kind in CONTAINERS:
            level.append(boxes(data, a, b))
            parent.append(kind)


@dataclass
class Fragment:
    """A trun: its first byte, samples, their size and duration (sizes and durations where they differ), whether they are sync samples, and
    the time of the first."""

    start: int
    n: int
    size: int
    sizes: np.ndarray | None
    duration: int
    durations: np.ndarray | None
    sync: bool
    syncs: np.ndarray | None
    first_sync: bool
    time: int

    @property
    def stop(self) -> int:
        return self.start + (int(self.sizes.sum()) if self.sizes is not None else self.n * self.size)

    @property
    def end_time(self) -> int:
        return self.time + (int(self.durations.sum()) if self.durations is not None else self.n * self.duration)

    def keys(self) -> np.ndarray | None:
        """Places of the sync samples, None for all."""
        if self.syncs is not None:
            return np.flatnonzero(self.syncs)
        if self.sync:
            return None if self.first_sync else np.arange(1, 1)
        return np.arange(min(self.n, 1) if self.first_sync else 0)

    def ranges(self) -> list[tuple[int, int, int]]:
        """(first byte, end, time) of its sync samples."""
        keys = self.keys()
        if keys is None:
            return [(self.start, self.stop, self.time)] if self.n else []
        before = np.concatenate([[0], np.cumsum(self.sizes)]) if self.sizes is not None else None
        since = np.concatenate([[0], np.cumsum(self.durations)]) if self.durations is not None else None
        out = []
        for k in keys.tolist():
            a, b = (int(before[k]), int(before[k + 1])) if before is not None else (k * self.size, (k + 1) * self.size)
            out.append((self.start + a, self.start + b, self.time + (int(since[k]) if since is not None else k * self.duration)))
        return out


@dataclass
class Track:
    """Tables of one trak: chunk offsets, runs of samples a chunk, samples and their size (sizes where they differ), runs of durations, sync samples
    (None: all are), and its fragments."""

    id: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    stated: int = 0
    n: int = 0
    size: int = 0
    sizes: np.ndarray | None = None
    chunks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    runs: np.ndarray = field(default_factory=lambda: np.zeros((0, 3), np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))
    sync: np.ndarray | None = None
    fragments: list[Fragment] = field(default_factory=list)

    def _chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First sample of each chunk (and the number of all), and the bytes before each sample (empty where all are of one size)."""
        before = np.concatenate([[0], np.cumsum(self.sizes)]) if self.sizes is not None else np.zeros(0, np.int64)
        if not self.n:
            return np.zeros(len(self.chunks) + 1, np.int64), np.zeros(1, np.int64) if self.sizes is not None else before, before
        first = self.runs[:, 0] - 1
        if not len(self.chunks) or not len(first) or first[0] != 0 or (np.diff(first) <= 0).any() or first[-1] >= len(self.chunks):
            raise ValueError("stsc does not fit the chunks")
        per = np.repeat(self.runs[:, 1], np.diff(np.append(first, len(self.chunks))))
        begin = np.minimum(np.concatenate([[0], np.cumsum(np.minimum(per, self.n))]), self.n)
        if begin[-1] < self.n:
            raise ValueError("stsc names fewer samples than stsz")
        return begin, before, before

    def _bytes(self, before: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return before[b] - before[a] if self.sizes is not None else (b - a) * self.size

    def extents(self) -> list[tuple[int, int]]:
        """Byte ranges of all samples in their order, adjacent ones joined."""
        begin, before, _ = self._chunks()
        size = self._bytes(before, begin[:-1], begin[1:])
        return _joined([*zip(self.chunks.tolist(), (self.chunks + size).tolist()), *((f.start, f.stop) for f in self.fragments)])  # noqa: B905

    def count(self) -> int:
        return self.n + sum(f.n for f in self.fragments)

    def keys(self) -> int:
        own = self.n if self.sync is None else len(self.sync)
        return own + sum(f.n if (k := f.keys()) is None else len(k) for f in self.fragments)

    def time(self, sample: np.ndarray) -> np.ndarray:
        """Decoding times of samples of moov, by stts, the last run going on."""
        if not len(self.times):
            return np.zeros(len(sample), np.int64)
        n = np.concatenate([[0], np.cumsum(self.times[:, 0])])
        run = np.clip(np.searchsorted(n, sample, side="right") - 1, 0, len(self.times) - 1)
        at = np.concatenate([[0], np.cumsum(self.times[:, 0] * self.times[:, 1])])
        return at[run] + (sample - n[run]) * self.times[run, 1]

    def duration(self) -> int:
        """What the header states, else the time where the samples end."""
        if self.stated and self.stated not in (0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF):
            return self.stated
        return max([int(self.time(np.array([self.n]))[0]), *(f.end_time for f in self.fragments)])

    def keyframes(self) -> list[tuple[int, int, int]]:
        """Byte ranges [start, end) of sync samples, adjacent ones joined, and the time of the first sample of each."""
        begin, before, _ = self._chunks()
        if self.sync is None:
            full = np.flatnonzero(np.diff(begin))
            start, time = self.chunks[full], self.time(begin[full])
            size = self._bytes(before, begin[full], begin[full + 1])
        else:
            pick = self.sync - 1
            if len(pick) and (pick.min() < 0 or pick.max() >= self.n):
                raise ValueError("stss names a sample that stsz does not have")
            chunk = np.searchsorted(begin, pick, side="right") - 1
            start, time = self.chunks[chunk] + self._bytes(before, begin[chunk], pick), self.time(pick)
            size = self._bytes(before, pick, pick + 1)
        own = zip(start.tolist(), (start + size).tolist(), time.tolist(), strict=True)
        return _joined([*own, *(r for f in self.fragments for r in f.ranges())])


def _joined(ranges: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for r in ranges:
        if r[0] == r[1]:
            continue
        if out and out[-1][1] == r[0]:
            out[-1] = (out[-1][0], r[1], *out[-1][2:])
        else:
            out.append(r)
    return out


def _table(data: memoryview, at: int, stop: int, kind: str, width: int, skip: int = 4) -> np.ndarray:
    n = struct.unpack_from(">I", data, at + skip)[0]
    step = np.dtype(kind).itemsize * width
    if at + skip + 4 + n * step > stop:
        raise ValueError(f"table at {at} passes its box's end")
    return np.frombuffer(data, kind, n * width, at + skip + 4).astype(np.int64).reshape(-1, width)


def _sizes(data: memoryview, a: int, b: int, kind: bytes, t: Track) -> None:
    """Read stsz or stz2."""
    one, n = struct.unpack_from(">II", data, a + 4)
    t.n, t.size, t.sizes = n, one, None
    if kind == b"stsz" and one:
        return
    bits = 32 if kind == b"stsz" else one & 0xFF
    if bits not in (4, 8, 16, 32) or a + 12 + (n * bits + 7) // 8 > b:
        raise ValueError(f"table of sizes at {a} passes its box's end")
    if bits == 4:
        raw = np.frombuffer(data, np.uint8, (n + 1) // 2, a + 12)
        t.sizes = np.stack([raw >> 4, raw & 15], 1).ravel()[:n].astype(np.int64)
    else:
        t.sizes = np.frombuffer(data, {8: ">u1", 16: ">u2", 32: ">u4"}[bits], n, a + 12).astype(np.int64)


def _run(data: memoryview, a: int, b: int, t: Track, moof: int, head: dict) -> None:
    """Read trun into the track's fragments; head is what its tfhd (or trex) says, and where the run before ended."""
    flags, n = struct.unpack_from(">II", data, a)
    flags &= 0xFFFFFF
    at = a + 8
    start, first = head.get("end", head.get(0x1, moof)), None
    if flags & 0x1:
        start, at = head.get(0x1, moof) + struct.unpack_from(">i", data, at)[0], at + 4
    if flags & 0x4:
        first, at = struct.unpack_from(">I", data, at)[0], at + 4
    columns = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
    if at + 4 * n * len(columns) > b:
        raise ValueError(f"trun at {a} passes its box's end")
    table = np.frombuffer(data, ">u4", n * len(columns), at).astype(np.int64).reshape(n if columns else 0, len(columns))
    own = {f: table[:, k] for k, f in enumerate(columns)}
    usual = head.get(0x20, 0)
    syncs = (own[0x400] & NOT_SYNC) == 0 if 0x400 in own else None
    sync = not usual & NOT_SYNC
    first_sync = sync if first is None else not first & NOT_SYNC
    if syncs is not None and first is not None and n:
        syncs[0] = first_sync
    if syncs is None and sync and not first_sync and n:  # all but the first
        if n > len(data):
            raise ValueError(f"trun at {a} has more samples than the file has bytes")
        syncs = np.arange(n) > 0
    fragment = Fragment(start, n, head.get(0x10, 0), own.get(0x200), head.get(0x8, 0), own.get(0x100), sync, syncs, first_sync, head.get("time", t.fragments[-1].end_time if t.fragments else int(t.time(np.array([t.n]))[0])))
    t.fragments.append(fragment)
    head["end"], head["time"] = fragment.stop, fragment.end_time


def parse(raw: bytes) -> tuple[str, list[Track], str]:
    """Major brand, tracks, and the first problem ('' if none)."""
    data, brand, tracks = memoryview(raw), "", []
    usual: dict[int, dict] = {}  # of trex, by track
    moof, head, t = 0, {}, Track()
    try:
        for parent, kind, at, a, b in walk(data, 0, len(raw)):
            if kind == b"ftyp":
                brand = bytes(data[a : min(b, a + 4)]).decode("latin-1")
            elif kind == b"trak":
                t = Track()
                tracks.append(t)
            elif kind == b"tkhd":
                t.id = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]
            elif kind == b"mdhd":
                wide = data[a] == 1
                t.timescale, t.stated = struct.unpack_from(">IQ" if wide else ">II", data, a + (20 if wide else 12))
            elif kind == b"hdlr" and parent == b"mdia":
                t.handler = bytes(data[a + 8 : min(b, a + 12)]).decode("latin-1")
            elif kind == b"stsd":
                t.codec = bytes(data[a + 12 : min(b, a + 16)]).decode("latin-1")
            elif kind == b"stts":
                t.times = _table(data, a, b, ">u4", 2)
            elif kind == b"stsc":
                t.runs = _table(data, a, b, ">u4", 3)
            elif kind in (b"stsz", b"stz2"):
                _sizes(data, a, b, kind, t)
            elif kind == b"stco":
                t.chunks = _table(data, a, b, ">u4", 1)[:, 0]
            elif kind == b"co64":
                t.chunks = _table(data, a, b, ">u8", 1)[:, 0]
            elif kind == b"stss":
                t.sync = _table(data, a, b, ">u4", 1)[:, 0]
            elif kind == b"trex":
                track, entry, duration, size, flags = struct.unpack_from(">5I", data, a + 4)
                usual[track] = {0x2: entry, 0x8: duration, 0x10: size, 0x20: flags}
            elif kind == b"moof":
                moof = at
            elif kind == b"tfhd":
                flags, track = struct.unpack_from(">II", data, a)
                head, place = dict(usual.get(track, {})), a + 8
                for bit, form in TFHD:
                    if flags & bit:
                        head[bit] = struct.unpack_from(form, data, place)[0]
                        place += struct.calcsize(form)
                if (t := next((x for x in tracks if x.id == track), None)) is None:
                    raise ValueError(f"fragment at {at} of track {track}, which moov does not have")
            elif kind == b"tfdt":
                head["time"] = struct.unpack_from(">Q" if data[a] == 1 else ">I", data, a + 4)[0]
            elif kind == b"trun":
                _run(data, a, b, t, moof, head)
        for t in tracks:
            t.keyframes()
    except (ValueError, struct.error, IndexError) as e:
        return brand, tracks, str(e) or "damaged"
    return brand, tracks, ""


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


_UNIT = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def write(payload: bytes) -> bytes:
    """A file of one 'raw ' video track whose frames of 64 grey bytes are the payload (a positive multiple of 64 bytes)."""
    n = len(payload) // FRAME
    assert n and len(payload) == n * FRAME
    ftyp = _box(b"ftyp", b"qt  ", struct.pack(">I", 0x200), b"qt  ", b"isom")
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    stbl = lambda at: _box(b"stbl", _full(b"stsd", struct.pack(">I", 1), entry), _full(b"stts", struct.pack(">III", 1, n, 1)), _full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)), _full(b"stsz", struct.pack(">II", FRAME, n)), _full(b"co64", struct.pack(">IQ", 1, at)))
    dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))

    def moov(at: int) -> bytes:
        mdhd = _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0))
        hdlr = _full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"frames\0")
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), dinf, stbl(at))
        tkhd = _full(b"tkhd", struct.pack(">IIIII8xhhhH", 0, 0, 1, 0, n, 0, 0, 0, 0), _UNIT, struct.pack(">II", SIDE << 16, SIDE << 16), flags=7)
        mvhd = _full(b"mvhd", struct.pack(">IIIIiH10x", 0, 0, RATE, n, 0x10000, 0x100), _UNIT, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    at = len(ftyp) + len(moov(0)) + 16
    return ftyp + moov(at) + struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) + payload


def padded(raw: bytes) -> bytes:
    """raw with bytes 0 up to a positive multiple of 64."""
    return raw + bytes(FRAME - len(raw) % FRAME if len(raw) % FRAME or not raw else 0)


def samples(raw: bytes, track: Track) -> bytes:
    """The payload of all samples of a track, in order."""
    parts = track.extents()
    return raw[parts[0][0] : parts[0][1]] if len(parts) == 1 else b"".join(raw[a:b] for a, b in parts)


def store_text(df: DataFrame, text: str, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """df with a column of media files that hold the UTF-8 bytes of text, padded to whole frames."""

    def make():
        return lambda part: [pa.array([write(padded(x)) for x in texts(part.column(text))], pa.binary())]

    return attach(df, text, [(media, T.BinaryType())], make, keep)


_RANGE = [("start", pa.int64()), ("stop", pa.int64()), ("time_s", pa.float64())]
_TRACK = [("handler", pa.string()), ("codec", pa.string()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("n_keyframes", pa.int64()), ("keyframe_ranges", pa.list_(pa.struct(_RANGE)))]
#: What probe() adds: the major brand, a struct for each track, and the first problem.
PROBED = [("brand", pa.string()), ("tracks", pa.list_(pa.struct(_TRACK))), ("problem", pa.string())]


def describe(raw: bytes) -> tuple[str, list[dict], str]:
    """The values of PROBED for a file; where there is a problem, tracks whose tables do not hold have no ranges."""
    brand, tracks, problem = parse(raw)
    out = []
    for t in tracks:
        scale = t.timescale or 1
        try:
            ranges = [{"start": a, "stop": b, "time_s": at / scale} for a, b, at in t.keyframes()]
        except (ValueError, IndexError):
            ranges = []
        out.append({"handler": t.handler, "codec": t.codec, "duration_s": t.duration() / t.timescale if t.timescale else 0.0, "n_samples": t.count(), "n_keyframes": t.keys(), "keyframe_ranges": ranges})
    return brand, out, problem


def probe(df: DataFrame, media: str, keep: list[str] | None = None) -> DataFrame:
    """df with the columns of PROBED, read from the boxes of its media files."""

    def make():
        def work(part):
            rows = [describe(x) for x in texts(part.column(media))]
            return [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(PROBED)]

        return work

    return attach(df, media, [(name, from_arrow_type(kind)) for name, kind in PROBED], make, keep)


def read_back(df: DataFrame, media: str, keep: list[str] | None = None) -> DataFrame:
    """df with a binary column `payload`: the samples of the first track, found by its tables; null where there is a problem."""

    def payload(raw: bytes) -> bytes | None:
        _, tracks, problem = parse(raw)
        return None if problem else samples(raw, tracks[0]) if tracks else b""

    def make():
        return lambda part: [pa.array([payload(x) for x in texts(part.column(media))], pa.binary())]

    return attach(df, media, [("payload", T.BinaryType())], make, keep)
