"""Matroska files of fixed-size audio frames, and packet tables of any Matroska file.

The parser walks EBML elements by their variable-length ids and sizes (also of unknown size, which ends where an element
of an outer level begins), reads tracks, clusters, simple blocks and block groups with no, Xiph, EBML or fixed-size
lacing, and the cues. A packet is (track, timestamp in ms, key frame, first byte, length). The frames of a lace follow each other
by their track's default duration, or share out their block group's duration; with neither, all have the block's time. A block
group is a key frame unless it refers to another block.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_arrow, slices

# Element ids of the Matroska specification.
EBML, SEGMENT, INFO, SCALE, DURATION = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK, NUMBER, UID, KIND, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, RATE, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
DEFAULT = 0x23E383
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, LASTS, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE, CUE_TIME, CUE_TRACKS, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
VERSION, READ_VERSION, ID_LENGTH, SIZE_LENGTH, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
MASTERS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_TRACKS}
TOP = {INFO, TRACKS, CLUSTER, CUES}

#: Bytes of a frame (24 ms at 8000 samples a second), frames laced into a block, blocks in a cluster.
FRAME, LACE, BLOCKS, SAMPLES = 192, 8, 32, 8000


def number_size(n: int) -> bytes:
    """A size as a variable-length integer."""
    length = max(1, -(-(n + 1).bit_length() // 7))
    return (n | 1 << 7 * length).to_bytes(length, "big")


def element(key: int, body: bytes) -> bytes:
    return key.to_bytes(-(-key.bit_length() // 8), "big") + number_size(len(body)) + body


def unsigned(key: int, n: int) -> bytes:
    return element(key, n.to_bytes(max(1, -(-n.bit_length() // 8)), "big"))


def mux(payload: bytes, frame: int = FRAME, lace: int = LACE, blocks: int = BLOCKS, rate: int = SAMPLES) -> bytes:
    """8-bit PCM samples as a Matroska file; the payload must be whole frames."""
    if len(payload) % frame:
        raise ValueError("payload is not a multiple of the frame")
    step = frame * 1000 // rate
    head = element(EBML, unsigned(VERSION, 1) + unsigned(READ_VERSION, 1) + unsigned(ID_LENGTH, 4) + unsigned(SIZE_LENGTH, 8) + element(DOC_TYPE, b"matroska") + unsigned(DOC_VERSION, 4) + unsigned(DOC_READ, 2))
    info = element(INFO, unsigned(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) / frame * step)))
    track = element(TRACKS, element(TRACK, unsigned(NUMBER, 1) + unsigned(UID, 1) + unsigned(KIND, 2) + unsigned(DEFAULT, frame * 1_000_000_000 // rate) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(RATE, struct.pack(">d", rate)) + unsigned(CHANNELS, 1) + unsigned(DEPTH, 8))))
    body, cues, at = [info, track], [], len(info) + len(track)
    per = frame * lace * blocks
    for a in range(0, len(payload), per):
        time = a // frame * step
        parts = [unsigned(TIME, time)]
        for b in range(a, min(a + per, len(payload)), frame * lace):
            data = payload[b : b + frame * lace]
            n = len(data) // frame
            flags = 0x80 | (0x04 if n > 1 else 0)  # key frame; fixed-size lacing
            parts.append(element(SIMPLE, b"\x81" + struct.pack(">hB", (b - a) // frame * step, flags) + (bytes([n - 1]) if n > 1 else b"") + data))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE, unsigned(CUE_TIME, time) + element(CUE_TRACKS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


def variable(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """(value, next byte) of a variable-length integer; keep: with its length marker, as in ids. -1: unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at {at}")
    length = 9 - data[at].bit_length()
    if at + length > len(data):
        raise ValueError(f"integer at {at} reaches over the end")
    n = int.from_bytes(data[at : at + length], "big")
    if keep:
        return n, at + length
    n &= (1 << 7 * length) - 1
    return (-1 if n == (1 << 7 * length) - 1 else n), at + length


def elements(data: bytes, at: int, end: int, inner: set[int] = MASTERS) -> Iterator[tuple[int, int, int, int]]:
    """(depth, id, first byte of the body, its end) of all elements, masters before their children."""
    open_ends: list[tuple[int, bool, int]] = [(end, False, 0)]
    while at < end:
        while len(open_ends) > 1 and at >= open_ends[-1][0]:
            open_ends.pop()
        key, a = variable(data, at, True)
        size, a = variable(data, a, False)
        while len(open_ends) > 1 and open_ends[-1][1] and (key in (EBML, SEGMENT) or key in TOP and open_ends[-1][2] != SEGMENT):
            open_ends.pop()
        b = open_ends[-1][0] if size < 0 else a + size
        if b > open_ends[-1][0]:
            raise ValueError(f"element {key:#x} at {at} reaches over its parent")
        yield len(open_ends) - 1, key, a, b
        if key in inner:
            open_ends.append((b, size < 0, key))
            at = a
        else:
            at = b


def laces(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(first byte, length) of a block's frames; kind: 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    if not kind:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == 3:
        for i in range(n - 1):
            a = at
            x, at = variable(data, at, False)
            sizes.append(x if not i else sizes[-1] + x - ((1 << 7 * (at - a) - 1) - 1))
    if kind == 2:
        if (end - at) % n:
            raise ValueError("fixed-size lacing of unequal frames")
        sizes = [(end - at) // n] * n
    else:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames reach over their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> dict:
    """Tracks, packets and cues of a file. Raises ValueError where it is malformed."""
    tracks: list[dict] = []
    blocks: list[dict] = []
    cues: list[dict] = []
    scale, time, clusters, base = 1_000_000, 0, 0, 0
    grouped = False
    try:
        for _, key, a, b in elements(data, 0, len(data)):
            if key in (SIMPLE, BLOCK):
                track, at = variable(data, a, False)
                relative, flags = struct.unpack_from(">hB", data, at)
                if key == SIMPLE or not grouped:
                    blocks.append({"key": True})
                grouped = False
                blocks[-1] |= {"track": track, "time": time + relative, "kind": flags >> 1 & 3, "frames": laces(data, at + 3, b, flags >> 1 & 3)}
                if key == SIMPLE:
                    blocks[-1]["key"] = bool(flags & 0x80)
            elif key == GROUP:
                blocks.append({"key": True})
                grouped = True
            elif key == REFERENCE and blocks:
                blocks[-1]["key"] = False
            elif key == LASTS and blocks:
                blocks[-1]["lasts"] = int.from_bytes(data[a:b], "big")
            elif key == SEGMENT:
                base = a
            elif key == CLUSTER:
                clusters += 1
            elif key == TRACK:
                tracks.append({})
            elif key == CUE:
                cues.append({})
            elif key in (CODEC, DOC_TYPE):
                if key == CODEC and tracks:
                    tracks[-1]["codec"] = data[a:b].rstrip(b"\0").decode("ascii", "replace")
            elif key in (RATE, DURATION):
                value = struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0]
                if key == RATE and tracks:
                    tracks[-1]["rate"] = value
            elif key in (TIME, SCALE, NUMBER, KIND, CHANNELS, DEPTH, DEFAULT, CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                n = int.from_bytes(data[a:b], "big")
                if key == TIME:
                    time = n
                elif key == SCALE:
                    scale = n
                elif key in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                    cues[-1][{CUE_TIME: "time", CUE_TRACK: "track", CUE_CLUSTER: "cluster"}[key]] = n + (base if key == CUE_CLUSTER else 0)
                elif tracks:
                    tracks[-1][{NUMBER: "number", KIND: "kind", CHANNELS: "channels", DEPTH: "depth", DEFAULT: "frame_ns"}[key]] = n
    except (IndexError, struct.error) as e:
        raise ValueError(str(e)) from e
    blocks = [x for x in blocks if "frames" in x]
    steps = {x["number"]: x["frame_ns"] / 1e6 for x in tracks if x.get("frame_ns") and "number" in x}
    packets: list[tuple[int, float, bool, int, int]] = []
    for x in blocks:
        step = steps.get(x["track"], x.get("lasts", 0) * scale / 1e6 / len(x["frames"]))
        packets += [(x["track"], x["time"] * scale / 1e6 + i * step, x["key"], first, n) for i, (first, n) in enumerate(x["frames"])]
    return {"tracks": tracks, "packets": packets, "cues": cues, "clusters": clusters, "laced": sum(x["kind"] > 0 for x in blocks)}


PACKETS = "packet int, track long, timestamp_ms double, key_frame boolean, first_byte long, length long, error string"


def packet_table(df: DataFrame, content: str, key: str) -> DataFrame:
    """key and one row a packet of the files in a binary column.

    A null or empty file has no packets; a malformed one has one row with the error and no packet. Rows with equal
    keys are files of their own. A key named like a packet's column gets `_key` behind its name. Other columns are left out. A task holds one Arrow batch of files and their packets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            keys = column(batch, key)
            for i, data in enumerate(column(batch, content)):
                if not (file := data.as_py()):
                    continue
                try:
                    rows = [(k, *p, None) for k, p in enumerate(parse(file)["packets"])]
                except ValueError as e:
                    rows = [(None, None, None, None, None, None, str(e))]
                if rows:
                    out = dict(zip(("packet", "track", "timestamp_ms", "key_frame", "first_byte", "length", "error"), map(list, zip(*rows, strict=True)), strict=True))
                    yield out | {key: pa.array([keys[i].as_py()] * len(rows), keys.type)}

    kind, name = dict(df.dtypes)[key], key
    if f" {key} " in f" {PACKETS}".replace(",", ""):
        key = f"{key}_key"
    return map_arrow(df.select(F.col(name).alias(key), content), run, f"`{key}` {kind}, {PACKETS}")


def media(docs: DataFrame) -> DataFrame:
    """Every text as UTF-8, padded with spaces to a positive multiple of 192, muxed, parsed and read back.

    Digests of what was read back, of the file, and a feature string of the packet table. A null text is empty; equal
    texts have equal values; repeated rows stay; other columns are left out. No shuffle; one file at a time in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            keys = column(batch, "doc_id")
            for a, texts in slices(batch):
                rows = []
                for t in texts:
                    raw = t.encode("utf-8", "surrogatepass")
                    stored = mux(raw + b" " * (-len(raw) % FRAME if raw else FRAME))
                    found = parse(stored)
                    packets = found["packets"]
                    back = b"".join([stored[first : first + n] for _, _, _, first, n in packets])
                    loud = sum(back) / len(back)
                    feature = f"clusters={found['clusters']};blocks_laced={found['laced']};cues={len(found['cues'])};packets={len(packets)};last_ms={packets[-1][1]:.0f};codec={found['tracks'][0]['codec']};mean={loud:.4f}"
                    rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
                yield {"doc_id": keys.slice(a, len(texts))} | dict(zip(("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"), map(list, zip(*rows, strict=True)), strict=True))

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
