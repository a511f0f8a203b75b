"""ISO media containers as table columns.

`write_frames` stores a payload losslessly as uncompressed grey frames of 24 by 24 samples of 8 bits in one video track:
ftyp, mdat, then moov with its nested boxes and sample tables. `read_frames` walks the boxes of any such container, decodes
the sample tables (stsd, stts, stsc, stsz or stz2, stco or co64, stss) and gives codec, duration and the byte ranges of the
keyframes. Payloads are not decoded: samples are only cut out by their byte ranges, and only if asked for.

A null text is an empty one and is stored as one frame of padding. A container that is null or broken gives nulls and says
why in `error`; so does one with boxes over 32 deep, or with counts and lengths that its bytes cannot hold. Repeated rows give equal values. An empty table gives an empty result. Only columns in `keep` are carried.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioworks.llm import common
from folioworks.shipping import ship_by_value

SIDE = 24
FRAME = SIDE * SIDE
PAD = b"\xff"
#: Frames a second, frames in a chunk, and frames from one keyframe to the next.
RATE, IN_CHUNK, KEY_EVERY = 25, 8, 12
#: Boxes that hold boxes, and how deep they may stand in each other.
DEPTH = 32
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex"}

FIELDS = [
    ("codec", "string"), ("width", "int"), ("height", "int"), ("timescale", "bigint"), ("duration", "bigint"), ("n_samples", "bigint"),
    ("keyframes", "array<struct<sample:bigint,offset:bigint,length:bigint>>"), ("error", "string"),
]
KEYFRAME = pa.list_(pa.struct([("sample", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]))


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + PAD * (-len(raw) % FRAME or (0 if raw else FRAME))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def container(payload: bytes) -> bytes:
    """A whole file around a payload of whole frames."""
    n = len(payload) // FRAME
    head = _box(b"ftyp", b"isom", struct.pack(">I", 0), b"isomiso2")
    # 32-bit sizes do while the file is under 4 GB, and a row never holds more than 2
    data = struct.pack(">I4s", 8 + len(payload), b"mdat")
    start = len(head) + len(data)
    chunks = -(-n // IN_CHUNK)
    last = n - IN_CHUNK * (chunks - 1)
    runs = [(1, IN_CHUNK, 1)] if chunks > 1 or last == IN_CHUNK else []
    runs += [(chunks, last, 1)] if last != IN_CHUNK else []
    offsets = (start + IN_CHUNK * FRAME * np.arange(chunks, dtype=np.int64)).astype(">u4").tobytes()
    keys = np.arange(1, n + 1, KEY_EVERY).astype(">u4").tobytes()
    matrix = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = struct.pack(">6xH16xHHIIIH32sHh", 1, SIDE, SIDE, 0x480000, 0x480000, 0, 1, b"\x04grey", 40, -1)
    table = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), _box(b"raw ", entry)),
        _full(b"stts", struct.pack(">III", 1, n, 1)),
        _full(b"stss", struct.pack(">I", len(keys) // 4), keys),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", FRAME, n)),
        _full(b"stco", struct.pack(">I", chunks), offsets),
    )
    media = _box(
        b"mdia",
        _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)),
        _full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"frames\x00"),
        _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
    )
    track = _box(b"trak", _full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n, 0, 0, 0, 0), matrix, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3), media)
    movie = _box(b"moov", _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, n, 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2)), track)
    return head + data + payload + movie


def walk(data: bytes):
    """(path, first byte of the body, end of the body) of every box, outer boxes first. Boxes nest DEPTH deep at most."""
    open_: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]
    while open_:
        at, end, path = open_.pop()
        if at + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at {at} reaches out of its parent")
        yield (*path, kind), at + head, at + size
        open_.append((at + size, end, path))
        if kind in NESTED:
            if len(path) + 1 >= DEPTH:
                raise ValueError(f"boxes are nested over {DEPTH} deep")
            open_.append((at + head, at + size, (*path, kind)))


def _numbers(data: bytes, at: int, kind: str, n: int, end: int) -> np.ndarray:
    if at + n * np.dtype(kind).itemsize > end:
        raise ValueError("a table is longer than its box")
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def video_track(data: bytes) -> dict[bytes, tuple[int, int]]:
    """Where the boxes of the first video track's sample tables and headers are."""
    track: dict[bytes, tuple[int, int]] = {}
    for path, at, end in walk(data):
        if path[-1] == b"trak":
            if track.get(b"video"):
                break
            track = {}
        if path[:2] == (b"moov", b"trak"):
            track[path[-1]] = (at, end)
            if path[-1] == b"hdlr" and data[at + 8 : at + 12] == b"vide":
                track[b"video"] = (at, end)
    if not track.get(b"video"):
        raise ValueError("no video track")
    return track


def sample_ranges(data: bytes, track: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Offset and length of every sample, from the chunk and size tables."""
    if b"stsz" in track:
        at, end = track[b"stsz"]
        same, n = struct.unpack_from(">II", data, at + 4)
        if same and n * same > len(data):
            raise ValueError("samples are longer than the file")
        sizes = np.full(n, same, dtype=np.int64) if same else _numbers(data, at + 12, ">u4", n, end)
    else:
        at, end = track[b"stz2"]
        bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
        if bits == 4:
            raw = _numbers(data, at + 12, "u1", -(-n // 2), end)
            sizes = np.column_stack((raw >> 4, raw & 15)).ravel()[:n]
        else:
            sizes = _numbers(data, at + 12, {8: "u1", 16: ">u2"}[bits], n, end)
    wide = b"co64" in track
    at, end = track[b"co64" if wide else b"stco"]
    chunks = _numbers(data, at + 8, ">u8" if wide else ">u4", struct.unpack_from(">I", data, at + 4)[0], end)
    at, end = track[b"stsc"]
    runs = _numbers(data, at + 8, ">u4", 3 * struct.unpack_from(">I", data, at + 4)[0], end).reshape(-1, 3)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0] - 1, len(chunks))))
    if per_chunk.sum() != n:
        raise ValueError("chunks and samples do not add up")
    first = np.cumsum(per_chunk) - per_chunk  # of each chunk
    before = np.cumsum(sizes) - sizes
    offsets = np.repeat(chunks - before[first], per_chunk) + before
    if (offsets < 0).any() or (offsets > len(data) - sizes).any():
        raise ValueError("a sample lies outside the file")
    return offsets, sizes


def describe(data: bytes) -> tuple[tuple, tuple[np.ndarray, np.ndarray]]:
    """FIELDS without the error, and every sample's range."""
    track = video_track(data)
    at, _ = track[b"stsd"]
    codec = data[at + 12 : at + 16].decode("latin-1")
    width, height = struct.unpack_from(">HH", data, at + 40)
    at, _ = track[b"mdhd"]
    timescale, length = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    at, end = track[b"stts"]
    times = _numbers(data, at + 8, ">u4", 2 * struct.unpack_from(">I", data, at + 4)[0], end).reshape(-1, 2)
    offsets, sizes = sample_ranges(data, track)
    if int(times[:, 0].sum()) != len(sizes):
        raise ValueError("times and samples do not add up")
    keys = np.arange(1, len(sizes) + 1)
    if b"stss" in track:
        at, end = track[b"stss"]
        keys = _numbers(data, at + 8, ">u4", struct.unpack_from(">I", data, at + 4)[0], end)
        if len(keys) and not (1 <= keys.min() and keys.max() <= len(sizes)):
            raise ValueError("a keyframe is no sample")
    ranges = [{"sample": k, "offset": o, "length": s} for k, o, s in zip(keys.tolist(), offsets[keys - 1].tolist(), sizes[keys - 1].tolist())]
    duration = int((times[:, 0] * times[:, 1]).sum()) or int(length)
    if not 0 <= duration < 1 << 63:
        raise ValueError("the duration is no 63-bit number")
    return (codec, width, height, timescale, duration, len(sizes), ranges), (offsets, sizes)


def samples(data: bytes, ranges: tuple[np.ndarray, np.ndarray]) -> bytes:
    """The samples' bytes in order; neighbours in the file are cut out together."""
    offsets, sizes = ranges
    if not len(offsets):
        return b""
    ends = offsets + sizes
    cut = np.flatnonzero(offsets[1:] != ends[:-1]) + 1
    return b"".join(data[a:b] for a, b in zip(offsets[np.append(0, cut)].tolist(), ends[np.append(cut - 1, len(ends) - 1)].tolist()))


def write_frames(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep`, n_bytes of the text and its `media` container, written to the shared folder."""

    def run(texts):
        return [pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([container(padded(t)) for t in texts], pa.binary())]

    return common.written(common.map_texts(docs, run, [("n_bytes", "bigint"), ("media", "binary")], keep, text), "media")


def read_frames(media: DataFrame, keep: list[str], payload: bool = False, column: str = "media") -> DataFrame:
    """`keep` and FIELDS of every container, and with `payload` the samples' bytes."""

    def run(files):
        rows, bodies = [], []
        for data in files:
            try:
                if data is None:
                    raise ValueError("no container")
                got, ranges = describe(data)
                rows.append((*got, None))
                bodies.append(samples(data, ranges) if payload else None)
            except (ValueError, KeyError, IndexError, struct.error) as e:
                rows.append((*[None] * (len(FIELDS) - 1), str(e) or type(e).__name__))
                bodies.append(None)
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), KEYFRAME, pa.string()]
        out = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return [*out, pa.array(bodies, pa.binary())] if payload else out

    return common.map_texts(media, run, [*FIELDS, ("payload", "binary")] if payload else FIELDS, keep, column)


ship_by_value(__name__)
