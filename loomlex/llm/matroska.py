"""Matroska as a media column: EBML writing, and parsing into packet tables.

The parser reads variable-length elements, segments and clusters of known or unknown size, SimpleBlock and
BlockGroup, the three lacings, and cues, and gives a packet for each frame with its track, timestamp and byte range.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

# Element identifiers of the EBML and Matroska specifications (RFC 8794, RFC 9559).
EBML = 0x1A45DFA3
EBML_VERSION = 0x4286
EBML_READ_VERSION = 0x42F7
EBML_MAX_ID_LENGTH = 0x42F2
EBML_MAX_SIZE_LENGTH = 0x42F3
DOC_TYPE = 0x4282
DOC_TYPE_VERSION = 0x4287
DOC_TYPE_READ_VERSION = 0x4285
SEGMENT = 0x18538067
INFO = 0x1549A966
TIMESTAMP_SCALE = 0x2AD7B1
MUXING_APP = 0x4D80
WRITING_APP = 0x5741
TRACKS = 0x1654AE6B
TRACK_ENTRY = 0xAE
TRACK_NUMBER = 0xD7
TRACK_UID = 0x73C5
TRACK_TYPE = 0x83
CODEC_ID = 0x86
AUDIO = 0xE1
SAMPLING_FREQUENCY = 0xB5
CHANNELS = 0x9F
BIT_DEPTH = 0x6264
CLUSTER = 0x1F43B675
CLUSTER_TIMESTAMP = 0xE7
SIMPLE_BLOCK = 0xA3
BLOCK_GROUP = 0xA0
BLOCK = 0xA1
BLOCK_DURATION = 0x9B
REFERENCE_BLOCK = 0xFB
CUES = 0x1C53BB6B
CUE_POINT = 0xBB
CUE_TIME = 0xB3
CUE_TRACK_POSITIONS = 0xB7
CUE_TRACK = 0xF7
CUE_CLUSTER_POSITION = 0xF1
SEEK_HEAD = 0x114D9B74
TAGS = 0x1254C367
CHAPTERS = 0x1043A770
ATTACHMENTS = 0x1941A469
VOID = 0xEC

AUDIO_TRACK = 2
RATE = 8000
FRAME = 400
FRAMES_A_BLOCK = 8
BLOCKS_A_CLUSTER = 10
#: Samples a millisecond: timestamps are in milliseconds.
SAMPLES_A_MS = RATE // 1000


class MatroskaError(ValueError):
    """The bytes are not a Matroska file that can be read."""


def element_id(i: int) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big")


def vint(value: int, length: int | None = None) -> bytes:
    """An EBML size: the shortest form, or that of ``length`` bytes. All ones mean an unknown size and are avoided."""
    n = length or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    if value >= (1 << 7 * n) - 1:
        raise MatroskaError(f"{value} doesn't fit {n} bytes")
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(i: int, body: bytes) -> bytes:
    return element_id(i) + vint(len(body)) + body


def uint(i: int, value: int) -> bytes:
    return element(i, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], lacing: str) -> tuple[int, bytes]:
    """The flag bits and the body of a block of several frames."""
    if lacing == "none":
        return 0, frames[0]
    head, sizes = bytes([len(frames) - 1]), [len(f) for f in frames]
    if lacing == "xiph":
        return 1 << 1, head + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1]) + b"".join(frames)
    if lacing == "fixed":
        return 2 << 1, head + b"".join(frames)
    coded = vint(sizes[0])
    for was, s in zip(sizes, sizes[1:-1]):
        delta = s - was
        n = next(n for n in range(1, 9) if abs(delta) < 1 << 7 * n - 1)
        coded += vint(delta + (1 << 7 * n - 1) - 1, n)
    return 3 << 1, head + coded + b"".join(frames)


def mux(payload: bytes, lacing: str | None = None) -> bytes:
    """The payload as unsigned 8-bit samples in one audio track. lacing: none, xiph, fixed or ebml; by default fixed
    for frames of one size, else ebml."""
    header = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID_LENGTH, 4) + uint(EBML_MAX_SIZE_LENGTH, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"loomlex") + element(WRITING_APP, b"loomlex"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, AUDIO_TRACK) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, cues, place = [info, tracks], [], len(info) + len(tracks)
    span = FRAME * FRAMES_A_BLOCK
    for at in range(0, len(payload), span * BLOCKS_A_CLUSTER):
        start = at // SAMPLES_A_MS
        blocks = [uint(CLUSTER_TIMESTAMP, start)]
        for b in range(at, min(at + span * BLOCKS_A_CLUSTER, len(payload)), span):
            piece = payload[b : b + span]
            frames = [piece[k : k + FRAME] for k in range(0, len(piece), FRAME)]
            kind = "none" if len(frames) == 1 else lacing or ("fixed" if len(piece) % FRAME == 0 else "ebml")
            if kind == "fixed" and len(piece) % FRAME or kind == "none" and len(frames) > 1:
                frames, kind = [piece], "none"
            flags, laced = lace(frames, kind)
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b // SAMPLES_A_MS - start, 0x80 | flags) + laced))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, uint(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, place))))
        body.append(cluster)
        place += len(cluster)
    return header + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


@dataclass
class Track:
    number: int = 0
    kind: int = 0
    codec: str = ""
    rate: float = 0.0
    channels: int = 0
    depth: int = 0


@dataclass
class Media:
    scale: int = 1_000_000
    tracks: list[Track] = field(default_factory=list)
    #: (track, timestamp, duration or -1, keyframe, offset, size, cluster offset)
    packets: list[tuple[int, int, int, bool, int, int, int]] = field(default_factory=list)
    #: (time, track, offset of the cluster in the file)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    lacings: set[str] = field(default_factory=set)


def read_id(data: bytes, at: int) -> tuple[int, int]:
    if at >= len(data) or not data[at]:
        raise MatroskaError(f"no element at {at}")
    n = 9 - data[at].bit_length()
    if n > 4 or at + n > len(data):
        raise MatroskaError(f"bad element identifier at {at}")
    return int.from_bytes(data[at : at + n], "big"), at + n


def read_vint(data: bytes, at: int) -> tuple[int | None, int, int]:
    """The value (None: unknown size), the next place and the length."""
    if at >= len(data) or not data[at]:
        raise MatroskaError(f"bad size at {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise MatroskaError(f"cut size at {at}")
    value = int.from_bytes(data[at : at + n], "big") & (1 << 7 * n) - 1
    return (None if value == (1 << 7 * n) - 1 else value), at + n, n


#: What ends an element of unknown size: those that can't stand in it.
_TOP = {EBML, SEGMENT}
_LEVEL_1 = _TOP | {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS}


def children(data: bytes, at: int, end: int, until: frozenset | set = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(identifier, start of the element, start of its body, end) for each element of a body."""
    while at < end:
        start = at
        i, at = read_id(data, at)
        if i in until:
            return
        size, at, _ = read_vint(data, at)
        if size is None:
            if i not in (SEGMENT, CLUSTER):
                raise MatroskaError(f"unknown size at {start}")
            stop, inner = end, _TOP if i == SEGMENT else _LEVEL_1
            for _, _, _, e in children(data, at, end, inner):
                stop = e
            stop = stop if any(True for _ in children(data, at, end, inner)) else at
        else:
            stop = at + size
            if stop > end:
                raise MatroskaError(f"the element at {start} is cut")
        yield i, start, at, stop
        at = stop


def number(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def frames_of(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(offset, size) of each frame of a block's body."""
    if not lacing:
        return [(at, end - at)]
    if at >= end:
        raise MatroskaError(f"empty lace at {at}")
    count, at = data[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % count:
            raise MatroskaError("frames of a fixed lace differ")
        sizes = [(end - at) // count] * count
    else:
        sizes = []
        for k in range(count - 1):
            if lacing == 1:
                size = 0
                while at < end and data[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + data[at], at + 1
            else:
                value, at, n = read_vint(data, at)
                value = (1 << 7 * n) - 1 if value is None else value
                size = value if not k else sizes[-1] + value - ((1 << 7 * n - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) != end:
        raise MatroskaError("a lace's sizes don't add up")
    found = []
    for s in sizes:
        found.append((at, s))
        at += s
    return found


def demux(data: bytes) -> Media:
    """Parse a whole file. Raises MatroskaError where it is cut or malformed."""
    media, top = Media(), list(children(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise MatroskaError("no EBML header")
    for i, _, at, end in top:
        if i != SEGMENT:
            continue
        for j, start, body, stop in children(data, at, end, _TOP):
            if j == INFO:
                media.scale = next((number(data, a, e) for k, _, a, e in children(data, body, stop) if k == TIMESTAMP_SCALE), media.scale)
            elif j == TRACKS:
                for k, _, a, e in children(data, body, stop):
                    if k == TRACK_ENTRY:
                        media.tracks.append(_track(data, a, e))
            elif j == CLUSTER:
                _cluster(data, start, body, stop, media)
            elif j == CUES:
                for k, _, a, e in children(data, body, stop):
                    if k == CUE_POINT:
                        parts = list(children(data, a, e))
                        time = next(number(data, y, z) for x, _, y, z in parts if x == CUE_TIME)
                        for x, _, y, z in parts:
                            if x == CUE_TRACK_POSITIONS:
                                where = {n: number(data, p, q) for n, _, p, q in children(data, y, z) if n in (CUE_TRACK, CUE_CLUSTER_POSITION)}
                                media.cues.append((time, where[CUE_TRACK], at + where[CUE_CLUSTER_POSITION]))
    return media


def _track(data: bytes, at: int, end: int) -> Track:
    t = Track()
    for k, _, a, e in children(data, at, end):
        if k == TRACK_NUMBER:
            t.number = number(data, a, e)
        elif k == TRACK_TYPE:
            t.kind = number(data, a, e)
        elif k == CODEC_ID:
            t.codec = data[a:e].decode("ascii", "replace")
        elif k == AUDIO:
            for x, _, y, z in children(data, a, e):
                if x == SAMPLING_FREQUENCY:
                    t.rate = struct.unpack(">d" if z - y == 8 else ">f", data[y:z])[0]
                elif x == CHANNELS:
                    t.channels = number(data, y, z)
                elif x == BIT_DEPTH:
                    t.depth = number(data, y, z)
    return t


def _cluster(data: bytes, start: int, at: int, end: int, media: Media) -> None:
    base = 0
    for i, _, a, e in children(data, at, end, _LEVEL_1):
        if i == CLUSTER_TIMESTAMP:
            base = number(data, a, e)
        elif i == SIMPLE_BLOCK:
            _block(data, start, base, a, e, -1, None, media)
        elif i == BLOCK_GROUP:
            parts = {x: (y, z) for x, _, y, z in children(data, a, e)}
            if BLOCK in parts:
                _block(data, start, base, *parts[BLOCK], number(data, *parts[BLOCK_DURATION]) if BLOCK_DURATION in parts else -1, REFERENCE_BLOCK not in parts, media)


def _block(data: bytes, cluster: int, base: int, at: int, end: int, duration: int, key: bool | None, media: Media) -> None:
    track, at, _ = read_vint(data, at)
    if at + 3 > end:
        raise MatroskaError(f"the block at {at} is cut")
    relative, flags = struct.unpack_from(">hB", data, at)
    lacing = flags >> 1 & 3
    media.lacings.add(("none", "xiph", "fixed", "ebml")[lacing])
    known = next((t for t in media.tracks if t.number == track), None)
    time, done = base + relative, 0
    for offset, size in frames_of(data, at + 3, end, lacing):
        # frames of a lace follow one another: with plain samples their lengths give their times
        shift = done * 1000 // int(known.rate * known.channels * (known.depth // 8)) if known and known.rate and known.channels and known.depth >= 8 else 0
        media.packets.append((track or 0, time + shift, duration, bool(flags & 0x80) if key is None else key, offset, size, cluster))
        done += size


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, then zeros up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def feature(media: Media, payload: bytes) -> str:
    """What a packet table and its samples say, in one line; whole numbers only."""
    from array import array

    samples = array("B", payload)
    n = len(samples)
    track = media.tracks[0] if media.tracks else Track()
    crossings = len(payload.translate(_HIGH).replace(b"\1\1", b"\1").split(b"\0\1")) - 1
    return f"codec={track.codec};packets={len(media.packets)};clusters={len(media.cues)};lacing={'+'.join(sorted(media.lacings))};ms={n // SAMPLES_A_MS};mean={sum(samples) // n};peak={max(samples)};rises={crossings}"


_HIGH = bytes(int(b >= 96) for b in range(256))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([mux(payload_of(t)) for t in texts], pa.binary())], ["id", "n_bytes", "media"])


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packet = pa.struct([("track", pa.int32()), ("timestamp", pa.int64()), ("duration", pa.int64()), ("keyframe", pa.bool_()), ("offset", pa.int64()), ("size", pa.int64()), ("cluster", pa.int64())])
    for b in batches:
        packets, errors = [], []
        for data in b.column(1).to_pylist():
            try:
                packets.append([dict(zip((f.name for f in packet), p)) for p in demux(data).packets] if data is not None else None)
                errors.append(None)
            except (MatroskaError, KeyError, IndexError, StopIteration, struct.error) as e:
                packets.append(None)
                errors.append(str(e) or type(e).__name__)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packets, pa.list_(packet)), pa.array(errors, pa.string())], ["id", "packets", "error"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for b in batches:
        rows = []
        for doc, n, data in zip(*(b.column(i).to_pylist() for i in range(3))):
            media = demux(data)
            payload = b"".join(data[p[4] : p[4] + p[5]] for p in media.packets)
            rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(media, payload)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def store_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media, a Matroska file of each text. Null and empty texts become 64 zero samples; rows that
    occur twice come out twice, and equal texts give equal files. An empty table gives no rows; other columns are not
    read."""
    runtime.prepare(docs.sparkSession)
    rows = runtime.only(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_store, "id long, n_bytes long, media binary")


def packet_table(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """id, packets (an array of track, timestamp, duration or -1, keyframe, offset, size and cluster offset) and error.
    A null file has null packets and no error; one that can't be parsed has null packets and an error."""
    runtime.prepare(media.sparkSession)
    rows = runtime.only(media, id=id_col, media=media_col).select(F.col("id").cast("long"), "media")
    return rows.mapInArrow(_packets, "id long, packets array<struct<track:int,timestamp:bigint,duration:bigint,keyframe:boolean,offset:bigint,size:bigint,cluster:bigint>>, error string")


def media_digest(stored: DataFrame) -> DataFrame:
    """Read back what ``store_text`` stored, by its packet tables: digests of payload and file, and features. An empty
    table gives no rows; a file that can't be parsed is an error."""
    runtime.prepare(stored.sparkSession)
    return stored.select("id", "n_bytes", "media").mapInArrow(_digests, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
