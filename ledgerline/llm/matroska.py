"""Matroska media columns: write payloads as PCM audio tracks, and parse files into packet tables.

write() stores bytes as one track of 8-bit samples in a Matroska file: EBML header, then a segment of
known size with info, tracks, clusters of laced simple blocks, and cues. read() takes any
Matroska file's elements apart: variable-length ids and sizes (unknown sizes too), clusters, simple blocks and
block groups, the three kinds of lacing, and cues. It yields a packet for each frame with timestamp,
track and byte range, so payloads are read by range, without decoding. Frames of a lace follow each other
by the track's default duration, or for PCM by their samples, or else by their share of the block's duration.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import releasing, small_batches

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SEEK_HEAD, VOID, CRC32, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0xEC, 0xBF, 0x1254C367, 0x1043A770, 0x1941A469
TIMESTAMP_SCALE, DURATION, TRACK_ENTRY, TRACK_NUMBER, CODEC_ID, AUDIO = 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x86, 0xE1
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
DEFAULT_DURATION, BLOCK_DURATION, REFERENCE_BLOCK = 0x23E383, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TRACK_UID, TRACK_TYPE, RATE, CHANNELS, DEPTH = 0x73C5, 0x83, 0xB5, 0x9F, 0x6264
VERSION, READ_VERSION, ID_LENGTH, SIZE_LENGTH, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
NONE, XIPH, FIXED, EBML_LACED = 0, 1, 2, 3
#: Elements of the top level: what ends a cluster or segment of unknown size.
TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS}

UNIT = 64
SAMPLE_RATE, FRAME, LACED, BLOCKS = 8000, 512, 8, 16  # samples a second; bytes a frame, frames a block, blocks a cluster


class Packet(NamedTuple):
    """A frame: its track, timestamp in nanoseconds, cluster, and where its bytes are."""

    track: int
    timestamp: int
    cluster: int
    lacing: int
    keyframe: bool
    offset: int
    size: int


class Cue(NamedTuple):
    """Time in nanoseconds, track, and the cluster's place in the segment's data."""

    time: int
    track: int
    cluster: int


class Track(NamedTuple):
    number: int
    codec: str
    frame_ns: int  # 0: not declared
    rate: float
    channels: int
    depth: int

    def duration(self, size: int) -> float | None:
        """Nanoseconds of a frame of some bytes, as far as the track tells."""
        if self.frame_ns:
            return self.frame_ns
        if self.codec.startswith("A_PCM") and self.depth and self.rate:
            return size * 8 / (self.channels * self.depth) / self.rate * 1e9
        return None


class Media(NamedTuple):
    scale: int
    duration: float
    tracks: list[Track]
    packets: list[Packet]
    cues: list[Cue]
    error: str | None = None


# --- writing -------------------------------------------------------------------------------------


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8)


def _size(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width)


def _element(kind: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return _id(kind) + _size(len(body)) + body


def _uint(kind: int, x: int) -> bytes:
    return _element(kind, x.to_bytes(max(1, (x.bit_length() + 7) // 8)))


def _lace(frames: list[bytes], lacing: int) -> bytes:
    if lacing == NONE:
        return frames[0]
    sizes, head = [len(f) for f in frames], bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACED:
        head += _size(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += _size(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def write(payload: bytes, frame: int = FRAME, laced: int = LACED, blocks: int = BLOCKS, lacing: int = EBML_LACED) -> bytes:
    """A file with the payload as 8-bit PCM of one channel. Timestamps count samples."""
    head = _element(EBML, _uint(VERSION, 1), _uint(READ_VERSION, 1), _uint(ID_LENGTH, 4), _uint(SIZE_LENGTH, 8), _element(DOC_TYPE, b"matroska"), _uint(DOC_VERSION, 4), _uint(DOC_READ, 2))
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 10**9 // SAMPLE_RATE), _element(DURATION, struct.pack(">d", len(payload))))
    audio = _element(AUDIO, _element(RATE, struct.pack(">d", SAMPLE_RATE)), _uint(CHANNELS, 1), _uint(DEPTH, 8))
    tracks = _element(TRACKS, _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1), _uint(TRACK_UID, 1), _uint(TRACK_TYPE, 2), _element(CODEC_ID, b"A_PCM/INT/LIT"), audio))
    body, at, cues = [info, tracks], len(info) + len(tracks), []
    per_cluster = min(frame * laced * blocks, 32_000)  # block times are signed 16-bit steps from their cluster's
    per_cluster -= per_cluster % (frame * laced) or 0
    per_cluster = max(per_cluster, frame * laced)
    for start in range(0, len(payload), per_cluster):
        part = [_uint(CLUSTER_TIMESTAMP, start)]
        for first in range(start, min(start + per_cluster, len(payload)), frame * laced):
            chunk = payload[first : min(first + frame * laced, start + per_cluster)]
            frames = [chunk[i : i + frame] for i in range(0, len(chunk), frame)]
            kind = lacing if len(frames) > 1 else NONE
            if kind == FIXED and len(frames[-1]) != frame:
                kind = EBML_LACED
            part.append(_element(SIMPLE_BLOCK, b"\x81", struct.pack(">h", first - start), bytes([0x80 | kind << 1]), _lace(frames, kind)))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, start), _element(CUE_POSITIONS, _uint(CUE_TRACK, 1), _uint(CUE_CLUSTER, at))))
        body.append(_element(CLUSTER, *part))
        at += len(body[-1])
    return head + _element(SEGMENT, *body, _element(CUES, *cues))


# --- reading -------------------------------------------------------------------------------------


def read_id(data: bytes, at: int) -> tuple[int, int]:
    """An element id with its marker bit, and where it ends."""
    first = data[at]
    width = 9 - first.bit_length()
    if not first or width > 4 or at + width > len(data):
        raise ValueError(f"no element id at byte {at}")
    return int.from_bytes(data[at : at + width]), at + width


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """A size (None: unknown) and where it ends."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no size at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"size cut off at byte {at}")
    n, top = int.from_bytes(data[at : at + width]) & (1 << 7 * width) - 1, (1 << 7 * width) - 1
    return None if n == top else n, at + width


def elements(data: bytes, at: int, end: int, within: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the contents of each element. An element of unknown size ends where one begins
    that can't be in it: for a cluster any element of the top level, for a segment the end of its data.
    A segment or cluster that is cut off is given up to the end, and then a ValueError follows, as for any other damage."""
    while at < end:
        kind, at = read_id(data, at)
        if within == CLUSTER and kind in TOP:
            return
        size, at = read_size(data, at)
        if size is None:
            if kind not in (SEGMENT, CLUSTER):
                raise ValueError(f"element {kind:x} has no size")
            stop = end if kind == SEGMENT else _cluster_end(data, at, end)
        else:
            stop = at + size
        if stop > end and kind in (SEGMENT, CLUSTER):
            yield kind, at, end
        if stop > end:
            raise ValueError(f"element {kind:x} goes beyond byte {end}")
        yield kind, at, stop
        at = stop


def _cluster_end(data: bytes, at: int, end: int) -> int:
    while at < end:
        kind, after = read_id(data, at)
        if kind in TOP:
            return at
        size, after = read_size(data, after)
        if size is None:
            raise ValueError(f"element {kind:x} has no size")
        at = after + size
    return end


def _number(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end])


def _float(data: bytes, at: int, end: int) -> float:
    return struct.unpack({4: ">f", 8: ">d"}[end - at], data[at:end])[0] if end > at else 0.0


def _block(data: bytes, at: int, end: int, cluster: int, base: int, scale: int, tracks: dict[int, Track], keyframe: bool | None, lasts: int | None = None) -> Iterator[Packet]:
    """A block's frames. keyframe None: as the block's own flag says; lasts: the block's duration in ticks, if known."""
    number, at = read_size(data, at)
    if number is None:
        raise ValueError("a block of no track")
    step, flags = struct.unpack(">hB", data[at : at + 3])
    at += 3
    lacing, key = flags >> 1 & 3, bool(flags & 0x80) if keyframe is None else keyframe
    if lacing == NONE:
        sizes = [end - at]
    else:
        n, at = data[at] + 1, at + 1
        if lacing == FIXED:
            if (end - at) % n:
                raise ValueError("frames of a fixed lace differ")
            sizes = [(end - at) // n] * n
        else:
            sizes = []
            for i in range(n - 1):
                if lacing == XIPH:
                    size = 0
                    while data[at] == 255:
                        size, at = size + 255, at + 1
                    size, at = size + data[at], at + 1
                else:
                    x, after = read_size(data, at)
                    width = after - at
                    x = (1 << 7 * width) - 1 if x is None else x
                    size, at = (x if not i else sizes[-1] + x - ((1 << 7 * width - 1) - 1)), after
                sizes.append(size)
            sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lace is longer than its block")
    track, when = tracks.get(number), float((base + step) * scale)
    for size in sizes:
        yield Packet(number, round(when), cluster, lacing, key, at, size)
        at += size
        known = track.duration(size) if track else None
        when += known if known is not None else (lasts or 0) * scale / len(sizes)


def _group(data: bytes, at: int, end: int, *place) -> Iterator[Packet]:
    """A block group's frames: key frames unless they refer to another block."""
    inside = {kind: (a, b) for kind, a, b in elements(data, at, end)}
    if BLOCK in inside:
        lasts = _number(data, *inside[BLOCK_DURATION]) if BLOCK_DURATION in inside else None
        yield from _block(data, *inside[BLOCK], *place, REFERENCE_BLOCK not in inside, lasts)


def _track(data: bytes, at: int, end: int) -> Track:
    inside = {kind: (a, b) for kind, a, b in elements(data, at, end)}
    audio = {kind: (a, b) for kind, a, b in elements(data, *inside[AUDIO])} if AUDIO in inside else {}
    number = lambda of, kind, default: _number(data, *of[kind]) if kind in of else default
    codec = data[slice(*inside[CODEC_ID])].decode("utf-8", "replace") if CODEC_ID in inside else ""
    rate = _float(data, *audio[RATE]) if RATE in audio else 8000.0
    return Track(number(inside, TRACK_NUMBER, 0), codec, number(inside, DEFAULT_DURATION, 0), rate, max(1, number(audio, CHANNELS, 1)), number(audio, DEPTH, 0))


def _cues(data: bytes, at: int, end: int, scale: int) -> Iterator[Cue]:
    for kind, a, b in elements(data, at, end):
        if kind == CUE_POINT:
            inside = list(elements(data, a, b))
            time = next((_number(data, c, d) for k, c, d in inside if k == CUE_TIME), 0)
            for k, c, d in inside:
                if k == CUE_POSITIONS:
                    at_ = {x: _number(data, e, f) for x, e, f in elements(data, c, d)}
                    yield Cue(time * scale, at_.get(CUE_TRACK, 0), at_.get(CUE_CLUSTER, 0))


def read(data: bytes, since: int | None = None) -> Media:
    """A file's tracks, packets in file order, and cues, up to the first damage, which ``error`` then tells.

    Cluster places count from the segment's data. since: nanoseconds; clusters before the last one that
    the cues name for that time are passed over by their sizes, without being read.
    """
    scale, duration, tracks, packets, cues, error = 1_000_000, 0.0, {}, [], [], None
    try:
        if read_id(data, 0)[0] != EBML:
            raise ValueError("not an EBML file")
        for kind, a, b in elements(data, 0, len(data)):
            if kind != SEGMENT:
                continue
            start, n = 0, 0
            if since is not None:
                named = [c for part, c, d in elements(data, a, b) if part == CUES for c in _cues(data, c, d, _scale_of(data, a, b))]
                start = max((c.cluster for c in named if c.time <= since), default=0)
            at = a
            for part, c, d in elements(data, a, b):
                if part == INFO:
                    for x, e, f in elements(data, c, d):
                        scale = _number(data, e, f) if x == TIMESTAMP_SCALE else scale
                        duration = _float(data, e, f) if x == DURATION else duration
                elif part == TRACKS:
                    found = [_track(data, e, f) for x, e, f in elements(data, c, d) if x == TRACK_ENTRY]
                    tracks |= {t.number: t for t in found}
                elif part == CLUSTER:
                    base, n = 0, n + 1
                    if at - a >= start:
                        for x, e, f in elements(data, c, d, CLUSTER):
                            if x == CLUSTER_TIMESTAMP:
                                base = _number(data, e, f)
                            elif x == SIMPLE_BLOCK:
                                packets.extend(_block(data, e, f, n - 1, base, scale, tracks, None))
                            elif x == BLOCK_GROUP:
                                packets.extend(_group(data, e, f, n - 1, base, scale, tracks))
                elif part == CUES:
                    cues.extend(_cues(data, c, d, scale))
                at = d
    except (ValueError, IndexError, KeyError, struct.error) as damage:
        error = str(damage) or type(damage).__name__
    return Media(scale, duration, list(tracks.values()), packets, cues, error)


def _scale_of(data: bytes, at: int, end: int) -> int:
    for part, a, b in elements(data, at, end):
        if part == INFO:
            return next((_number(data, e, f) for x, e, f in elements(data, a, b) if x == TIMESTAMP_SCALE), 1_000_000)
    return 1_000_000


def parse(data: bytes) -> Media:
    """read() of a whole file; a ValueError tells of damage."""
    media = read(data)
    if media.error:
        raise ValueError(media.error)
    return media


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join([data[p.offset : p.offset + p.size] for p in media.packets if p.track == track])


# --- columns -------------------------------------------------------------------------------------


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with bytes 0 up to a positive multiple of UNIT, and the length before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(UNIT - len(raw)) if len(raw) < UNIT else raw + bytes(-len(raw) % UNIT), len(raw)


def encode_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)``: each whole text, padded to UNIT bytes, as a Matroska file. Null: as empty."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = [padded(t.as_py()) for t in part.column(1)]
                yield pa.record_batch({"doc_id": part.column(0), "n_bytes": pa.array([n for _, n in made], pa.int64()), "media": pa.array([write(p) for p, _ in made], pa.binary())})

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(releasing(run), "doc_id long, n_bytes long, media binary")


PACKETS = "id long, track int, packet long, timestamp_ns long, cluster int, lacing int, keyframe boolean, offset long, size long, cued boolean, error string"
PACKET_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]


def packet_table(media: DataFrame, key: str = "doc_id", column: str = "media", since: int | None = None) -> DataFrame:
    """A row for each frame of each file. A null file gives no rows.

    cued: the first frame of a cluster that the cues name. Damaged files, and bytes that are no Matroska, give the frames
    before the damage and then a row of nulls but for the id and ``error``. since: nanoseconds from which on
    frames are wanted; whole clusters before are passed over where the cues allow it, and frames before are left out.
    Repeated rows give their frames again. Other columns are not looked at.
    """
    names = [c.split()[0] for c in PACKETS.split(", ")]

    def run(batches):
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not data.is_valid:
                    continue
                found, rows, last = read(data.as_py(), since), [], -1
                times = {c.time for c in found.cues}
                for i, p in enumerate(found.packets):
                    if since is None or p.timestamp >= since:
                        rows.append((k, p.track, i, p.timestamp, p.cluster, p.lacing, p.keyframe, p.offset, p.size, p.cluster != last and p.timestamp in times, None))
                    last = p.cluster
                if found.error:
                    rows.append((k, *[None] * 9, found.error))
                for at in range(0, len(rows), 100_000):
                    columns = zip(*rows[at : at + 100_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PACKET_TYPES, strict=True)], names=names)

    return media.select(F.col(key).cast("long").alias("id"), F.col(column).alias("media")).mapInArrow(releasing(run), PACKETS)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def feature_of(media: Media) -> str:
    """Frames, clusters, cues, laced frames, last timestamp and a digest of the packet table."""
    table = hashlib.sha256(b"".join(struct.pack("<IqIBQQ", p.track, p.timestamp, p.cluster, p.lacing, p.offset, p.size) for p in media.packets)).hexdigest()[:16]
    n = media.packets[-1].cluster + 1 if media.packets else 0
    return f"packets={len(media.packets)};clusters={n};cues={len(media.cues)};laced={sum(p.lacing > 0 for p in media.packets)};last={media.packets[-1].timestamp if media.packets else 0};table={table}"


def digests(media: DataFrame) -> DataFrame:
    """Read stored files back by their packets, and digest payload, file and packet table."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, n_bytes, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = data.as_py()
                found = parse(raw)
                payload = payload_of(raw, found)
                rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest(), feature_of(found)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in DIGEST.split(", ")])

    return media.mapInArrow(releasing(run), DIGEST)


def store_and_digest(docs: DataFrame) -> DataFrame:
    """One row per document: its text stored as media, read back, and digested. Equal texts, equal values;
    ids may be null or repeat; other columns are not looked at."""
    return digests(encode_texts(docs))
