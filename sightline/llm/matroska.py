"""Media columns: payloads as Matroska files, and files as packet tables.

``store`` puts bytes into a Matroska file of one 8-bit PCM track; ``packets``
reads any Matroska bytes column into one row per frame. The parser follows
variable-length elements (known and unknown sizes), clusters, simple blocks
and block groups, the three kinds of lacing, and cues.

A file is built from its payload alone (no dates, no random ids), so equal
payloads give equal files.
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

from sightline.llm.common import by_batch, fresh, plain, quoted, record, slices

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x4286, 0x42F7, 0x42F2, 0x42F3
#: Elements that end a cluster (or another top-level element) of unknown size.
TOP_LEVEL = frozenset((CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469, SEGMENT, EBML))
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: Bytes of a frame, frames laced into a block, blocks of a cluster; 8,000 samples a second, so a frame is 72 ms.
FRAME, LACED, BLOCKS, RATE = 576, 8, 16, 8000
PAD = 255

PACKET = pa.list_(
    pa.struct(
        [
            ("cluster", pa.int32()),
            ("track", pa.int64()),
            ("timestamp", pa.int64()),
            ("keyframe", pa.bool_()),
            ("lacing", pa.int32()),
            ("frame", pa.int32()),
            ("begin", pa.int64()),
            ("end", pa.int64()),
        ]
    )
)
PACKET_SQL = (
    "array<struct<cluster:int,track:bigint,timestamp:bigint,keyframe:boolean,lacing:int,frame:int,begin:bigint,end:bigint>>"
)


def number(value: int, width: int = 0) -> bytes:
    """A variable-length size: the length is told by the leading zero bits of the first byte."""
    length = width or next(n for n in range(1, 9) if value < (1 << (7 * n)) - 1)
    return (value | 1 << (7 * length)).to_bytes(length, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + number(len(body)) + body


def unsigned(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


_HEADER = element(
    EBML,
    unsigned(EBML_VERSION, 1)
    + unsigned(EBML_READ_VERSION, 1)
    + unsigned(EBML_MAX_ID, 4)
    + unsigned(EBML_MAX_SIZE, 8)
    + element(DOC_TYPE, b"matroska")
    + unsigned(DOC_TYPE_VERSION, 4)
    + unsigned(DOC_TYPE_READ_VERSION, 2),
)
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        unsigned(TRACK_NUMBER, 1)
        + unsigned(TRACK_UID, 1)
        + unsigned(TRACK_TYPE, 2)
        + unsigned(FLAG_LACING, 1)
        + element(CODEC_ID, b"A_PCM/INT/LIT")
        + element(
            AUDIO,
            element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8),
        ),
    ),
)


def padded(payload: bytes) -> bytes:
    """``payload`` filled with bytes 255 up to a positive multiple of the frame."""
    return payload + bytes([PAD]) * (FRAME * max(1, -(-len(payload) // FRAME)) - len(payload))


def store(payload: bytes) -> bytes:
    """The Matroska file of a payload whose length is a positive multiple of the frame."""
    if not payload or len(payload) % FRAME:
        raise ValueError("pad the payload to a positive multiple of the frame first")
    each = 1000 * FRAME // RATE  # ms of a frame
    per_cluster = FRAME * LACED * BLOCKS
    info = element(
        INFO,
        unsigned(TIMESTAMP_SCALE, 1_000_000)
        + element(DURATION, struct.pack(">d", len(payload) // FRAME * each))
        + element(MUXING_APP, b"sightline")
        + element(WRITING_APP, b"sightline"),
    )
    body, cues = [info, _TRACKS], []
    written = len(info) + len(_TRACKS)
    for start in range(0, len(payload), per_cluster):
        time = start // FRAME * each
        parts = [unsigned(TIMESTAMP, time)]
        chunk = payload[start : start + per_cluster]
        for place in range(0, len(chunk), FRAME * LACED):
            block = chunk[place : place + FRAME * LACED]
            frames = len(block) // FRAME
            head = b"\x81" + struct.pack(">h", place // FRAME * each)
            lace = b"\x80" if frames == 1 else b"\x84" + bytes([frames - 1])  # key frame; several: fixed-size lacing
            parts.append(element(SIMPLE_BLOCK, head + lace + block))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(
            element(
                CUE_POINT,
                unsigned(CUE_TIME, time)
                + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, written)),
            )
        )
        body.append(cluster)
        written += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return _HEADER + element(SEGMENT, b"".join(body))


@dataclass
class Media:
    """What a file holds. Packets: (cluster, track, timestamp, keyframe, lacing, frame, begin, end)."""

    tracks: dict[int, str] = field(default_factory=dict)
    packets: list[tuple] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, cluster's place in the file
    clusters: list[int] = field(default_factory=list)  # places in the file
    duration: float = 0.0
    scale: int = 1_000_000


class Broken(ValueError):
    """The bytes aren't a Matroska file, or end within an element."""


def _size(data: bytes, at: int) -> tuple[int, int]:
    """(value, bytes) of a variable-length number; -1 stands for an unknown size."""
    if at >= len(data) or not data[at]:
        raise Broken(f"no size at byte {at}")
    length = 9 - data[at].bit_length()
    if at + length > len(data):
        raise Broken("the file ends within a number")
    value = int.from_bytes(data[at : at + length], "big") & ((1 << 7 * length) - 1)
    return (-1 if value == (1 << 7 * length) - 1 else value), length


def _elements(data: bytes, at: int, end: int, parent: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, place, begin, end) of the elements of a range.

    An element of unknown size reaches to the next one that can't be inside
    it: for a cluster the next top-level element, for a segment the end.
    """
    while at < end:
        if not data[at]:
            raise Broken(f"no element at byte {at}")
        length = 9 - data[at].bit_length()
        ident = int.from_bytes(data[at : at + length], "big")
        size, width = _size(data, at + length)
        begin = at + length + width
        if size < 0:
            stop = end
            if ident != SEGMENT:
                stop = begin
                while stop < end:
                    inner = 9 - data[stop].bit_length()
                    if int.from_bytes(data[stop : stop + inner], "big") in TOP_LEVEL:
                        break
                    known, wide = _size(data, stop + inner)
                    if known < 0:
                        raise Broken("unknown sizes within each other")
                    stop += inner + wide + known
        else:
            stop = begin + size
        if stop > end:
            raise Broken("an element ends behind its parent")
        yield ident, at, begin, stop
        at = stop


def _laced(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if kind == NO_LACING:
        return [(at, end)]
    if at >= end:
        raise Broken("a laced block without frames")
    frames = data[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == FIXED:
        if (end - at) % frames:
            raise Broken("fixed lacing doesn't divide the block")
        sizes = [(end - at) // frames] * frames
    elif kind == XIPH:
        for _ in range(frames - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        size, width = _size(data, at)
        at += width
        sizes.append(size)
        for _ in range(frames - 2):
            step, width = _size(data, at)
            at += width
            size += step - ((1 << (7 * width - 1)) - 1)  # later sizes are signed differences
            sizes.append(size)
    if kind != FIXED:
        sizes = (sizes if frames > 1 else []) + [end - at - sum(sizes if frames > 1 else [])]
    if min(sizes) < 0 or sum(sizes) != end - at:
        raise Broken("laced sizes don't fit the block")
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    return out


def _unsigned(data: bytes, begin: int, end: int) -> int:
    return int.from_bytes(data[begin:end], "big")


def _block(data: bytes, begin: int, end: int, media: Media, base: int, keyframe: bool | None) -> None:
    track, width = _size(data, begin)
    at = begin + width
    if at + 3 > end:
        raise Broken("the file ends within a block")
    relative, flags = struct.unpack_from(">hB", data, at)
    lacing = (flags >> 1) & 3
    key = bool(flags & 0x80) if keyframe is None else keyframe
    cluster = len(media.clusters) - 1
    for i, (b, e) in enumerate(_laced(data, at + 3, end, lacing)):
        media.packets.append((cluster, track, base + relative, key, lacing, i, b, e))


def parse(data: bytes) -> Media:
    """Tracks, packets, cues and clusters of a file; raises ``Broken`` on anything else."""
    media, top = Media(), list(_elements(data, 0, len(data), 0))
    if not top or top[0][0] != EBML:
        raise Broken("no EBML header")
    for ident, _, begin, end in top:
        if ident != SEGMENT:
            continue
        segment = begin
        for part, place, b, e in _elements(data, begin, end, SEGMENT):
            if part == CLUSTER:
                media.clusters.append(place)
                base = 0
                for kind, _, x, y in _elements(data, b, e, CLUSTER):
                    if kind == TIMESTAMP:
                        base = _unsigned(data, x, y)
                    elif kind == SIMPLE_BLOCK:
                        _block(data, x, y, media, base, None)
                    elif kind == BLOCK_GROUP:
                        own = {k: (p, q) for k, _, p, q in _elements(data, x, y, BLOCK_GROUP)}
                        if BLOCK in own:
                            _block(data, *own[BLOCK], media, base, REFERENCE not in own)
            elif part == TRACKS:
                for kind, _, x, y in _elements(data, b, e, TRACKS):
                    if kind == TRACK_ENTRY:
                        own = {k: (p, q) for k, _, p, q in _elements(data, x, y, TRACK_ENTRY)}
                        media.tracks[_unsigned(data, *own[TRACK_NUMBER])] = data[slice(*own[CODEC_ID])].decode()
            elif part == CUES:
                for kind, _, x, y in _elements(data, b, e, CUES):
                    if kind == CUE_POINT:
                        time = 0
                        for k, _, p, q in _elements(data, x, y, CUE_POINT):
                            if k == CUE_TIME:
                                time = _unsigned(data, p, q)
                            elif k == CUE_TRACK_POSITIONS:
                                own = {i: (m, n) for i, _, m, n in _elements(data, p, q, CUE_TRACK_POSITIONS)}
                                media.cues.append(
                                    (
                                        time,
                                        _unsigned(data, *own[CUE_TRACK]),
                                        segment + _unsigned(data, *own[CUE_CLUSTER_POSITION]),
                                    )
                                )
            elif part == INFO:
                for kind, _, x, y in _elements(data, b, e, INFO):
                    if kind == DURATION:
                        media.duration = struct.unpack(">d" if y - x == 8 else ">f", data[x:y])[0]
                    elif kind == TIMESTAMP_SCALE:
                        media.scale = _unsigned(data, x, y)
    return media


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    """The bytes of a track, frame after frame."""
    return b"".join([data[p[6] : p[7]] for p in media.packets if p[1] == track])


def with_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with a column of Matroska files that hold its texts (a null text counts as empty).

    A column called ``media`` is replaced; all others stay.
    """
    rest = [c for c in docs.columns if c.lower() != media.lower()]
    schema = ", ".join(f"{quoted(c)} {docs.schema[c].dataType.simpleString()}" for c in rest)
    place = rest.index(text)

    def run(batches):
        for batch in batches:
            texts = plain(batch.column(place), pa.string()).cast(pa.binary())
            for a, b in slices(texts):
                files = [store(padded(t)) for t in texts[a:b].to_pylist()]
                own = batch.slice(a, b - a)
                yield record([*rest, media], [*own.columns, pa.array(files, pa.binary())])

    return docs.select(*[F.col(quoted(c)) for c in rest]).mapInArrow(run, f"{schema}, {quoted(media)} binary")


def packets(files: DataFrame, key: str, media: str = "media") -> DataFrame:
    """One row per frame: ``key``, cluster, track, timestamp, keyframe, lacing, frame, and the byte range.

    A null file has no rows. Bytes that are no Matroska file fail the query:
    a media table never loses a file silently.
    """
    kind = files.schema[key].dataType.simpleString()
    packet = fresh(files.select(key), "packets")

    @by_batch
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [parse(x).packets if x is not None else [] for x in batch.column(1).to_pylist()]
        names = [f.name for f in PACKET.value_type]
        rows = [[dict(zip(names, p)) for p in own] for own in found]
        return record([key, packet], [batch.column(0), pa.array(rows, PACKET)])

    nested = files.select(key, media).mapInArrow(run, f"{quoted(key)} {kind}, {packet} {PACKET_SQL}")
    return nested.select(key, F.inline(packet))


def features(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """What the packets of each stored file say, read back from its bytes.

    ``payload_bytes``, ``payload_sha256``, ``tail_crc32`` (of the last 32
    bytes), ``media_bytes``, ``media_sha256`` and ``feature``: tracks,
    clusters, blocks, frames, cues that point at a cluster, and duration.
    """
    kind = files.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            stored = plain(batch.column(1), pa.binary())
            for a, b in slices(stored):
                out = []
                for data in stored[a:b].to_pylist():
                    found = parse(data)
                    payload = payload_of(data, found)
                    places = set(found.clusters)
                    good = sum(c[2] in places for c in found.cues)
                    blocks = sum(p[5] == 0 for p in found.packets)
                    feature = (
                        f"tracks={len(found.tracks)};clusters={len(found.clusters)};blocks={blocks};"
                        f"frames={len(found.packets)};cues={good};ms={found.duration:.0f};"
                        f"end={found.packets[-1][2] if found.packets else 0}"
                    )
                    out.append(
                        (
                            len(payload),
                            hashlib.sha256(payload).hexdigest(),
                            zlib.crc32(payload[-32:]),
                            len(data),
                            hashlib.sha256(data).hexdigest(),
                            feature,
                        )
                    )
                yield record(
                    [key, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                    [batch.column(0)[a:b], *map(list, zip(*out))],
                )

    return files.select(key, media).mapInArrow(
        run,
        f"{quoted(key)} {kind}, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
        "media_sha256 string, feature string",
    )
