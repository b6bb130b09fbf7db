"""Media columns: Matroska containers written, parsed and measured inside a column of bytes.

The container is EBML (RFC 8794) with Matroska elements (RFC 9559): variable-length ids and sizes, a segment with info,
tracks, clusters of laced blocks and cues. Reading gives a table of packets: track, timestamp and byte range of every
frame. A map over rows; memory is that of one file and its packets.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices, utf8

# element ids, fixed by the format
EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, CUES, CUE_POINT, CUE_POSITIONS, BLOCK_GROUP = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1, 0x1F43B675, 0x1C53BB6B, 0xBB, 0xB7, 0xA0
SIMPLE_BLOCK, BLOCK, TIMESTAMP, TIMESTAMP_SCALE, CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0xA3, 0xA1, 0xE7, 0x2AD7B1, 0xB3, 0xF7, 0xF1
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, RATE, CHANNELS, BIT_DEPTH, VOID = 0xD7, 0x73C5, 0x83, 0x86, 0xB5, 0x9F, 0x6264, 0xEC
_MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, CUES, CUE_POINT, CUE_POSITIONS, BLOCK_GROUP}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


class MediaError(ValueError):
    """The bytes are not a well-formed container."""


# --- variable-length integers --------------------------------------------------------------------------------------


def vint(n: int, width: int = 0) -> bytes:
    """A size of the least width, or of the width given; all ones are reserved for the unknown size."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """Value and position after it; -1 is the unknown size."""
    if at >= len(data) or not data[at]:
        raise MediaError(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise MediaError(f"cut off at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if not keep_marker:
        value -= 1 << 7 * width
        value = -1 if value == (1 << 7 * width) - 1 else value
    return value, at + width


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


# --- lacing --------------------------------------------------------------------------------------------------------


def lace(frames: list[bytes], lacing: int) -> bytes:
    """The part of a block after its flags: how many frames, their sizes, and the frames."""
    if lacing == NO_LACING:
        return b"".join(frames)
    sizes, head = [len(f) for f in frames], bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING:
        head += vint(sizes[0]) if len(sizes) > 1 else b""
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    elif len(set(sizes)) > 1:
        raise MediaError("fixed lacing needs equal sizes")
    return head + b"".join(frames)


def unlace(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if lacing == NO_LACING:
        return [(at, end)]
    if at >= end:
        raise MediaError("a laced block without a count of frames")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % n:
            raise MediaError("fixed lacing of unequal frames")
        sizes = [(end - at) // n] * (n - 1)
    elif lacing == XIPH:
        for _ in range(n - 1):
            size = 0
            while at < end and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= end:
                raise MediaError("a block cut off in its lacing")
            sizes.append(size + data[at])
            at += 1
    elif n > 1:
        size, at = read_vint(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            begun = at
            step, at = read_vint(data, at)
            sizes.append(sizes[-1] + step - ((1 << 7 * (at - begun) - 1) - 1))
        if min(sizes) < 0:
            raise MediaError("a frame of negative or unknown size")
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    if at > end or any(a > b for a, b in out):
        raise MediaError("frames reach beyond their block")
    return [*out, (at, end)]


# --- reading -------------------------------------------------------------------------------------------------------


@dataclass
class Packet:
    track: int
    timestamp: int  # ticks of the segment's scale
    start: int  # first byte in the file
    end: int
    keyframe: bool


@dataclass
class Media:
    scale: int = 1_000_000
    tracks: dict[int, dict[int, object]] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, cluster's place in the segment


def parse(data: bytes) -> Media:
    """Tracks, packets and cues of a file; unknown elements are passed over, unknown sizes reach to the parent's end."""
    media, cluster_time = Media(), 0
    at, size, track, cue = 0, 0, {}, {}
    ends: list[tuple[int, int]] = []  # open master elements: kind, end
    while at < len(data):
        while ends and at >= ends[-1][1]:
            kind, _ = ends.pop()
            if kind == TRACK_ENTRY:
                media.tracks[int(track.get(TRACK_NUMBER, 0))] = track
            elif kind == CUE_POINT:
                media.cues.append((cue.get(CUE_TIME, 0), cue.get(CUE_TRACK, 0), cue.get(CUE_CLUSTER, 0)))
        kind, at = read_vint(data, at, keep_marker=True)
        size, at = read_vint(data, at)
        limit = ends[-1][1] if ends else len(data)
        if kind == CLUSTER and ends and ends[-1][0] == CLUSTER:  # of unknown size: the next one ends it
            ends.pop()
            limit = ends[-1][1] if ends else len(data)
        end = limit if size < 0 else at + size
        if end > len(data) or end > limit:
            raise MediaError(f"element {kind:x} reaches beyond {limit}")
        if kind in _MASTERS:
            ends.append((kind, end))
            track, cue = ({} if kind == TRACK_ENTRY else track), ({} if kind == CUE_POINT else cue)
            continue
        if kind in (SIMPLE_BLOCK, BLOCK):
            number, p = read_vint(data, at)
            if number < 0 or p + 3 > end:
                raise MediaError("a block without a head")
            ticks, flags = cluster_time + int.from_bytes(data[p : p + 2], "big", signed=True), data[p + 2]
            media.packets += [Packet(number, ticks, a, b, bool(flags & 0x80)) for a, b in unlace(data, p + 3, end, flags >> 1 & 3)]
        elif kind == TIMESTAMP:
            cluster_time = int.from_bytes(data[at:end], "big")
        elif kind == TIMESTAMP_SCALE:
            media.scale = int.from_bytes(data[at:end], "big")
        elif kind in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
            cue[kind] = int.from_bytes(data[at:end], "big")
        elif kind == CODEC_ID:
            track[kind] = data[at:end].decode("utf-8", "replace").rstrip("\0")
        elif kind != RATE:
            track[kind] = int.from_bytes(data[at:end], "big") if end - at <= 8 else data[at:end]
        at = end
    for kind, _ in reversed(ends):
        if kind == TRACK_ENTRY:
            media.tracks[int(track.get(TRACK_NUMBER, 0))] = track
        elif kind == CUE_POINT:
            media.cues.append((cue.get(CUE_TIME, 0), cue.get(CUE_TRACK, 0), cue.get(CUE_CLUSTER, 0)))
    return media


# --- writing -------------------------------------------------------------------------------------------------------

FRAME, FRAMES, CLUSTER_BLOCKS, SAMPLE_RATE = 1024, 8, 16, 8000


def frames_of(payload: bytes, frame: int = FRAME) -> list[bytes]:
    return [payload[k : k + frame] for k in range(0, len(payload), frame)]


def mux(payload: bytes, rate: int = SAMPLE_RATE, lacing: int | None = None) -> bytes:
    """One track of unsigned 8-bit mono samples. Full blocks have equal frames and fixed lacing, the last one EBML lacing."""
    audio = element(AUDIO, element(RATE, np.array(rate, ">f8").tobytes()) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    entry = uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio
    head = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
    # a block's time is 16 bits from its cluster's: time is counted in frames
    body = [element(INFO, uint(TIMESTAMP_SCALE, 10**9 * FRAME // rate) + element(0x4D80, b"strandlake") + element(0x5741, b"strandlake")), element(TRACKS, element(TRACK_ENTRY, entry))]
    at, cues = sum(map(len, body)), []
    step = FRAME * FRAMES
    blocks = [payload[k : k + step] for k in range(0, len(payload), step)]
    for c in range(0, len(blocks), CLUSTER_BLOCKS):
        begun, parts = c * step, []
        for k, part in enumerate(blocks[c : c + CLUSTER_BLOCKS]):
            frames = frames_of(part)
            kind = lacing if lacing is not None else NO_LACING if len(frames) == 1 else FIXED if len({len(f) for f in frames}) == 1 else EBML_LACING
            parts.append(element(SIMPLE_BLOCK, vint(1) + (k * FRAMES).to_bytes(2, "big", signed=True) + bytes([0x80 | kind << 1]) + lace(frames, kind)))
        cluster = element(CLUSTER, uint(TIMESTAMP, begun // FRAME) + b"".join(parts))
        cues.append(element(CUE_POINT, uint(CUE_TIME, begun // FRAME) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


def demux(data: bytes, track: int = 1) -> tuple[Media, bytes]:
    media = parse(data)
    return media, b"".join(data[p.start : p.end] for p in media.packets if p.track == track)


def features(media: Media, samples: bytes) -> str:
    """Counts of packets and cues, the last timestamp, and level, loudness and zero crossings of the samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    last = max((p.timestamp for p in media.packets), default=0)
    return f"packets={len(media.packets)};cues={len(media.cues)};last={last};mean={x.mean():.6f};rms={np.sqrt(np.mean(x * x)):.6f};crossings={crossings}"


def padded(raw: bytes) -> bytes:
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), padded(raw)


_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def measure(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Store every whole text as a sound track, read it back, and measure what was read.

    Null and empty texts: 64 zero bytes. Equal texts give equal rows; repeated rows are measured one by one. Empty table: empty
    result. Other columns, whatever their names, are not read. A long text takes a worker about 30 bytes of memory a byte.
    keep_media adds the stored file as `media`.
    """
    names = ["doc_id", *(x.split()[0] for x in _SCHEMA.split(", ")), *["media"] * keep_media]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                rows = []
                for raw in utf8(batch.column(1)[a:b]):
                    media = mux(padded(raw))
                    parsed, back = demux(media)
                    rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(parsed, back), *[media] * keep_media))
                kinds = [*_KINDS, *[pa.binary()] * keep_media]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, f"doc_id long, {_SCHEMA}" + ", media binary" * keep_media)


def packets(files: DataFrame, key: str, media: str = "media") -> DataFrame:
    """A row a frame of every file: key, track, seconds, keyframe, byte range, codec. Null files have no rows; a broken file fails the job with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (data := value.as_py()) is None:
                    continue
                m = parse(data)
                for s in range(0, len(m.packets), 20_000):
                    rows = [(k, p.track, p.timestamp * m.scale / 1e9, p.keyframe, p.start, p.end, str(m.tracks.get(p.track, {}).get(CODEC_ID, ""))) for p in m.packets[s : s + 20_000]]
                    c = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, [pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()], strict=True)], names=["key", "track", "seconds", "keyframe", "start", "end", "codec"])

    return map_batches(files.select(F.col(key).cast("long"), F.col(media)), run, "key long, track long, seconds double, keyframe boolean, start long, end long, codec string")
