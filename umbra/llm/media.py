"""Media columns, MPEG audio: a container writer for byte payloads, and a stream parser.

`parse` finds frames in any MPEG-1/2/2.5 layer I-III stream: it reads ID3v2 tags (extended headers and
unsynchronisation too) and ID3v1 tags, resynchronises on damaged data (a header counts only if the next one agrees or the
data end; behind that a stream may go on with another version, layer or rate), finds the length of free-format
frames from the next header, reads Xing/Info and VBRI tables, verifies the checksums of all layers, and gives the exact
duration (a sum of samples over rates) with the byte offset of each frame.

`pack` stores a byte payload without loss as ancillary data of silent layer III frames: a legal variable-bitrate
stream with an ID3v2 tag, a Xing frame with a seek table, and a checksum in each frame.

Defined results: null or empty text is a payload of 64 bytes 0; equal texts give equal streams; bytes that hold no
frame parse to no frames, no duration and an empty offset list; a null stream is one without bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from umbra.llm import common

# Fixed values of the MPEG audio format: kbit/s by (MPEG-1?, layer), sampling rates by version bits.
KBPS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
# Bits of the allocation of subbands in layer II, as (subbands, bits) from the lowest subband on: low and high MPEG-1 rates, and MPEG-2.
ALLOCATION = {"a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "lsf": ((4, 4), (7, 3), (19, 2))}
BLOCK = 64
CRC_POLYNOMIAL = 0x8005


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, (table << 1) ^ CRC_POLYNOMIAL, table << 1) & 0xFFFF
    return table


CRC_TABLE = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """The format's checksum of each row of bytes."""
    crc = np.full(len(rows), 0xFFFF, np.uint32)
    for k in range(rows.shape[1]):
        crc = ((crc << 8) & 0xFFFF) ^ CRC_TABLE[((crc >> 8) ^ rows[:, k]) & 0xFF]
    return crc


class Header:
    """One frame header's fields; `read` gives None where the four bytes aren't a header."""

    __slots__ = ("layer", "mono", "mpeg1", "protected", "rate", "samples", "size", "kbps", "kind", "joint", "padding")

    @classmethod
    def read(cls, a: int, b: int, c: int, d: int) -> Header | None:
        if a != 0xFF or b & 0xE0 != 0xE0:
            return None
        version, layer, bitrate, rate = b >> 3 & 3, 4 - (b >> 1 & 3), c >> 4, c >> 2 & 3
        if version == 1 or layer == 4 or bitrate == 15 or rate == 3:
            return None
        h = cls()
        h.mpeg1, h.layer, h.protected, h.mono = version == 3, layer, not b & 1, d >> 6 == 3
        h.kbps, h.rate, h.kind = KBPS[h.mpeg1, layer][bitrate], RATES[version][rate], (version, layer, rate)
        h.samples = 384 if layer == 1 else 1152 if layer == 2 or h.mpeg1 else 576
        unit = 4 if layer == 1 else 1
        h.padding = (c >> 1 & 1) * unit
        h.size = h.samples // 8 // unit * h.kbps * 1000 // h.rate * unit + h.padding if bitrate else 0  # 0: free format
        h.joint = (d >> 4 & 3) * 4 + 4 if d >> 6 == 1 else 32  # the first subband that both channels share
        return h

    @property
    def side(self) -> int:
        """Bytes of side information of layer III."""
        return (17 if self.mono else 32) if self.mpeg1 else (9 if self.mono else 17)


def _syncsafe(x: bytes) -> int:
    return x[0] << 21 | x[1] << 14 | x[2] << 7 | x[3]


def _read_tag(data: bytes, start: int = 0) -> tuple[int, dict[str, str]]:
    """Where the ID3v2 tag that starts there ends (`start`: there is none), and its user text frames."""
    head = data[start : start + 10]
    if head[:3] != b"ID3" or len(head) < 10 or max(head[6:10]) > 127:
        return start, {}
    version, flags = head[3], head[5]
    end, found = min(start + 10 + _syncsafe(head[6:10]) + 10 * bool(flags & 16), len(data)), {}
    body = data[start + 10 : start + 10 + _syncsafe(head[6:10])]
    if flags & 128 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    at = 0
    if flags & 64 and len(body) >= 4:
        at = _syncsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    while at + 10 <= len(body) and body[at : at + 4].strip(b"\0"):
        size = _syncsafe(body[at + 4 : at + 8]) if version == 4 else int.from_bytes(body[at + 4 : at + 8], "big")
        if body[at : at + 4] == b"TXXX" and at + 10 + size <= len(body):
            text = body[at + 11 : at + 10 + size]
            if version == 4 and (flags & 128 or body[at + 9] & 2):
                text = text.replace(b"\xff\0", b"\xff")
            key, _, value = text.partition(b"\0")
            found[key.decode("latin-1")] = value.rstrip(b"\0").decode("latin-1")
        at += 10 + size
    return end, found


def _table(data: bytes, o: int, h: Header) -> dict:
    """The variable-bitrate table of a first frame: name, frames and bytes as it states them, entries."""
    xing = o + 4 + 2 * h.protected + h.side
    if h.layer == 3 and data[xing : xing + 4] in (b"Xing", b"Info"):
        flags, at, out = int.from_bytes(data[xing + 4 : xing + 8], "big"), xing + 8, {"table": data[xing : xing + 4].decode(), "table_frames": None, "table_bytes": None, "toc": []}
        for bit, name in ((1, "table_frames"), (2, "table_bytes")):
            if flags & bit:
                out[name], at = int.from_bytes(data[at : at + 4], "big"), at + 4
        out["toc"] = list(data[at : at + 100]) if flags & 4 else []
        return out
    vbri = data[o + 36 : o + 36 + 26]
    if vbri[:4] == b"VBRI" and len(vbri) == 26:
        n, scale, size = (int.from_bytes(vbri[k : k + 2], "big") for k in (18, 20, 22))
        raw = data[o + 62 : o + 62 + n * size]
        toc = [int.from_bytes(raw[k : k + size], "big") * scale for k in range(0, len(raw), size)] if 0 < size <= 8 else []
        return {"table": "VBRI", "table_frames": int.from_bytes(vbri[14:18], "big"), "table_bytes": int.from_bytes(vbri[10:14], "big"), "toc": toc}
    return {"table": "", "table_frames": None, "table_bytes": None, "toc": []}


def crc16_bits(data: bytes, bits: int) -> int:
    """The format's checksum of the first bits of the data."""
    crc = 0xFFFF
    for k in range(bits):
        top = (crc >> 15) ^ (data[k >> 3] >> (7 - (k & 7)) & 1)
        crc = (crc << 1 & 0xFFFF) ^ (CRC_POLYNOMIAL if top else 0)
    return crc


def _allocation_bits(h: Header) -> list[int]:
    """Of each subband of layer II."""
    if h.mpeg1:
        each = h.kbps if h.mono else h.kbps // 2  # of a channel; free format has the full table
        kind = ("c" if h.rate != 32000 else "d") if 0 < each <= 48 else "a" if h.rate == 48000 or 0 < each <= 80 else "b"
    else:
        kind = "lsf"
    return [bits for n, bits in ALLOCATION[kind] for _ in range(n)]


def _protected_bits(h: Header, body: bytes) -> int:
    """Bits behind header and checksum that the checksum of layers I and II covers; 0 if the data end before."""
    both = 1 if h.mono else 2
    if h.layer == 1:
        n = 4 * (32 if h.mono else 2 * h.joint + 32 - h.joint)
        return n if n <= 8 * len(body) else 0
    value, have, at, used = int.from_bytes(body[:64], "big"), 8 * min(64, len(body)), 0, 0
    for band, bits in enumerate(_allocation_bits(h)):
        shared = both == 2 and band >= h.joint
        for _ in range(1 if shared else both):
            if at + bits > have:
                return 0
            used += both * bool(value >> (have - at - bits) & (1 << bits) - 1) if shared else bool(value >> (have - at - bits) & (1 << bits) - 1)
            at += bits
    return at + 2 * used if at + 2 * used <= have else 0


def parse(data: bytes) -> dict:
    """Tags, frame offsets, sizes, duration, table and checksum counts of one stream."""
    start, tags = _read_tag(data)
    while (more := _read_tag(data, start))[0] > start:
        start, tags = more[0], tags | more[1]
    end = len(data) - 128 if len(data) - 128 >= start and data[-128:-125] == b"TAG" else len(data)
    offsets: list[int] = []
    sizes: list[int] = []
    headers: list[Header] = []
    known: dict[bytes, Header | None] = {}
    free: dict[tuple, int] = {}

    def header(at: int) -> Header | None:
        four = data[at : at + 4]
        if four not in known:
            known[four] = Header.read(*four) if len(four) == 4 else None
        return known[four]

    def size_of(h: Header, at: int) -> int:
        if h.size:
            return h.size
        if h.kind not in free:  # free format: up to the next header of the kind
            to = data.find(data[at : at + 2], at + 4, end)
            while to >= 0 and not ((x := header(to)) and not x.size and x.kind == h.kind):
                to = data.find(data[at : at + 2], to + 1, end)
            if to < 0:
                return end - at + 1
            free[h.kind] = to - at - h.padding
        return free[h.kind] + h.padding

    at, junk, resyncs, kind, lost = start, 0, 0, None, True
    while at + 4 <= end:
        h = header(at)
        size = size_of(h, at) if h is not None else 0
        good = h is not None and at + size <= end
        if good and (lost or h.kind != kind):  # a lone match may be chance: the next header must agree, or the stream end here
            nxt = header(at + size)
            good = at + size == end or (nxt is not None and nxt.kind == h.kind)
        if good:
            lost, kind = False, h.kind
            offsets.append(at)
            sizes.append(size)
            headers.append(h)
            at += size
            continue
        lost = True
        resyncs += bool(headers) and bool(offsets[-1] + sizes[-1] == at)
        to = data.find(b"\xff", at + 1, end)
        to = end if to < 0 else to
        junk, at = junk + to - at, to
    junk += max(0, end - at)
    table = _table(data, offsets[0], headers[0]) if headers else {"table": "", "table_frames": None, "table_bytes": None, "toc": []}
    good, checked = 0, 0
    groups: dict[int, list[int]] = {}
    for o, size, h in zip(offsets, sizes, headers, strict=True):
        if h.protected and h.layer == 3:
            groups.setdefault(h.side, []).append(o)
        elif h.protected and (bits := _protected_bits(h, data[o + 6 : o + size])):
            checked += 1
            good += crc16_bits(data[o + 2 : o + 4] + data[o + 6 : o + size], 16 + bits) == int.from_bytes(data[o + 4 : o + 6], "big")
    raw = np.frombuffer(data, np.uint8)
    for side, at_ in groups.items():
        o = np.asarray(at_)[:, None]
        o = o[o[:, 0] + 6 + side <= len(raw)]
        rows = np.concatenate([raw[o + np.arange(2, 4)], raw[o + np.arange(6, 6 + side)]], axis=1)
        stored = raw[o[:, 0] + 4].astype(np.uint32) << 8 | raw[o[:, 0] + 5]
        good, checked = good + int((crc16(rows) == stored).sum()), checked + len(o)
    audio = slice(1 if table["table"] else 0, None)
    by_rate: dict[int, int] = {}
    for h in headers[audio]:
        by_rate[h.rate] = by_rate.get(h.rate, 0) + h.samples
    return table | {
        "tags": tags, "offsets": offsets[audio], "sizes": sizes[audio], "headers": headers[audio], "samples": sum(by_rate.values()), "rate": headers[0].rate if headers else 0,
        "seconds": sum((Fraction(n, rate) for rate, n in by_rate.items()), Fraction(0)), "vbr": len({h.kbps for h in headers[audio]}) > 1,
        "crc_checked": checked, "crc_good": good, "junk": junk, "resyncs": resyncs,
    }


# What pack writes: MPEG-1 layer III, 48 kHz, mono, with checksum. A frame of k kbit/s has 3 k bytes.
_LEAD = 4 + 2 + 17
_FULL = 14 * BLOCK


def _lead(index: int) -> bytes:
    head = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 3 << 6])
    crc = int(crc16(np.frombuffer(head[2:] + bytes(17), np.uint8)[None])[0])
    return head + crc.to_bytes(2, "big") + bytes(17)


_LEADS = [b""] + [_lead(i) for i in range(1, 15)]


def padded(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % BLOCK or (BLOCK if not data else 0))


def pack(payload: bytes) -> bytes:
    """The stream that stores a payload (a positive multiple of 64 bytes)."""
    kbps = KBPS[True, 3]
    full, rest = divmod(len(payload), _FULL)
    frames = np.zeros((full, 3 * kbps[14]), np.uint8)
    frames[:, :_LEAD] = np.frombuffer(_LEADS[14], np.uint8)
    frames[:, _LEAD : _LEAD + _FULL] = np.frombuffer(payload, np.uint8, full * _FULL).reshape(full, _FULL)
    last = b""
    if rest:
        i = next(i for i in range(1, 15) if 3 * kbps[i] - _LEAD >= rest)
        last = (_LEADS[i] + payload[full * _FULL :]).ljust(3 * kbps[i], b"\0")
    text = b"\0payload_bytes\0" + str(len(payload)).encode()
    frame = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    tag = b"ID3\x03\0\0" + bytes(len(frame) >> s & 127 for s in (21, 14, 7, 0)) + frame
    count, audio, first = full + bool(rest), frames.size + len(last), 3 * kbps[4]
    starts = [first + min(i * count // 100, count) * 3 * kbps[14] for i in range(100)]
    toc = bytes(min(255, 256 * s // (first + audio)) for s in starts)
    xing = (_LEADS[4] + b"Xing\0\0\0\x07" + count.to_bytes(4, "big") + (first + audio).to_bytes(4, "big") + toc).ljust(first, b"\0")
    return tag + xing + frames.tobytes() + last


def unpack(data: bytes, found: dict | None = None) -> bytes:
    """The payload of a stream that pack wrote."""
    found = found or parse(data)
    parts = [data[o + _LEAD : o + min(s, _LEAD + _FULL)] for o, s in zip(found["offsets"], found["sizes"], strict=True)]
    return b"".join(parts)[: int(found["tags"].get("payload_bytes", 0))]


def store_text(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a stream. One pass, no shuffle."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches):
            data, bounds = common.bytes_view(batch.column(1))
            raw = data.tobytes()
            media = [pack(padded(raw[a:b])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield common.record(["doc_id", "n_bytes", "media"], [batch.column(0), np.diff(bounds), pa.array(media, pa.binary())])

    return common.id_text(docs).mapInArrow(common.lean(run), "doc_id long, n_bytes long, media binary")


def probe(table: DataFrame, media: str = "media") -> DataFrame:
    """The table with each stream's frames and seek offsets. For any MPEG audio column; columns with these names are replaced."""
    common.ship(table.sparkSession)
    kinds = {
        "n_frames": ("long", pa.int64()), "samples": ("long", pa.int64()), "rate": ("int", pa.int32()), "seconds": ("double", pa.float64()), "vbr": ("boolean", pa.bool_()), "vbr_table": ("string", pa.string()),
        "table_frames": ("long", pa.int64()), "table_bytes": ("long", pa.int64()), "table_entries": ("array<long>", pa.list_(pa.int64())), "seek_offsets": ("array<long>", pa.list_(pa.int64())),
        "crc_checked": ("long", pa.int64()), "crc_good": ("long", pa.int64()), "junk_bytes": ("long", pa.int64()), "resyncs": ("long", pa.int64()),
    }
    kept = [f for f in table.schema.fields if f.name not in kinds]

    def row(x: dict) -> tuple:
        return len(x["offsets"]), x["samples"], x["rate"], float(x["seconds"]) if x["rate"] else None, x["vbr"], x["table"], x["table_frames"], x["table_bytes"], x["toc"], x["offsets"], x["crc_checked"], x["crc_good"], x["junk"], x["resyncs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, media):
            rows = [row(parse(x or b"")) for x in batch.column(batch.schema.get_field_index(media)).to_pylist()]
            new = [pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in kept] + new, [f.name for f in kept] + list(kinds))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{n} {k}" for n, (k, _) in kinds.items()])
    return table.select(*[f"`{f.name}`" for f in kept]).mapInArrow(common.lean(run), schema)


def digest(stored: DataFrame) -> DataFrame:
    """What op10 returns for stored streams: payload and stream digests with the frame features, from the stored bytes alone."""
    common.ship(stored.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, "media"):
            out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seek_offsets")}
            for media in batch.column(2).to_pylist():
                x = parse(media)
                payload = unpack(media, x)
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-BLOCK:]))
                out["media_bytes"].append(len(media))
                out["media_sha256"].append(hashlib.sha256(media).hexdigest())
                out["feature"].append(f"frames={len(x['offsets'])};duration={x['samples']}/{x['rate']};vbr={int(x['vbr'])};table={x['table']};crc={x['crc_good']}/{x['crc_checked']};junk={x['junk']};table_frames={x['table_frames']};table_bytes={x['table_bytes']}")
                out["seek_offsets"].append(x["offsets"])
            seek = pa.array(out.pop("seek_offsets"), pa.list_(pa.int64()))
            yield common.record(["doc_id", "n_bytes", *out, "seek_offsets"], [batch.column(0), batch.column(1), *out.values(), seek])

    return stored.mapInArrow(common.lean(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seek_offsets array<long>")


def op10_mpeg_audio(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(common.stored(store_text(docs), "media"))
