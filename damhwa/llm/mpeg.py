"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, exact durations, seek offsets.

`probe` reads a binary column: ID3v2 and ID3v1 tags, the Xing/Info table with its LAME part or a VBRI table, then every
frame. A header counts when it is well formed and the next one follows where it says (or the stream ends there);
anything else is skipped byte by byte until that holds again, and counted. Layer III frames with a checksum have it
verified (CRC-16 over the last two header bytes and the side information), as have the LAME part and the audio it
covers. The duration is frames x samples less the encoder's delay and padding, in samples, so it is exact.

`pack` writes bytes as a legal stream: silent Layer III frames (no Huffman bits) whose ancillary part holds 192 to 768
payload bytes each, a Xing/LAME frame before them, tags around them. `unpack` gets the bytes back from the frames.

Edge cases: null or empty media give no frames and a duration of 0; a stream cut in mid-frame keeps its whole frames;
junk of any length is skipped; every input row gives one row, repeated rows included; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from damhwa.llm.common import map_batches

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by index 1 to 14, and sampling rates by index 0 to 2.
KBPS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

UNIT = 192
SYNC = re.compile(rb"\xff[\xe0-\xff]")


# ---- checksums


@cache
def _crc_msb_table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1 ^ (0x8005 if c & 0x8000 else 0)) & 0xFFFF
        out.append(c)
    return out


_frame_crcs: dict[bytes, int] = {}


def frame_crc(covered: bytes) -> int:
    """CRC-16 of a frame, most significant bit first, starting from ones."""
    c = _frame_crcs.get(covered)
    if c is None:
        table, c = _crc_msb_table(), 0xFFFF
        for byte in covered:
            c = (c << 8 & 0xFFFF) ^ table[c >> 8 ^ byte]
        if len(_frame_crcs) > 50_000:
            _frame_crcs.clear()
        _frame_crcs[covered] = c
    return c


BLOCK = 1024


@cache
def _arc_tables() -> tuple[np.ndarray, np.ndarray]:
    """(by place in a block and byte: what it adds to the block's sum; by byte half: a sum moved on by a block)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ 0xA001, table >> 1)
    move = lambda c: c >> 8 ^ table[c & 255]
    rows = [table]
    for _ in range(BLOCK - 1):
        rows.append(move(rows[-1]))
    on = np.stack([np.arange(256, dtype=np.uint32), np.arange(256, dtype=np.uint32) << 8])
    for _ in range(BLOCK):
        on = move(on)
    return np.concatenate(rows[::-1]).astype(np.uint16), on


def arc_crc(data: bytes) -> int:
    """CRC-16 of the LAME part, least significant bit first, starting from 0: blocks at once, then folded."""
    places, on = _arc_tables()
    crc, size = 0, len(data)
    low, high = on[0], on[1]
    first = size % BLOCK or min(size, BLOCK)
    at = 0
    base = np.arange(BLOCK, dtype=np.int32) * 256
    while at < size:
        end = first if at == 0 else min(size, at + 512 * BLOCK)
        part = np.frombuffer(data, np.uint8, end - at, at)
        if at == 0:
            sums = [np.bitwise_xor.reduce(places[base[BLOCK - first :] + part])]
        else:
            sums = np.bitwise_xor.reduce(places[base + part.reshape(-1, BLOCK)], axis=1).tolist()
        for s in sums:
            crc = int(low[crc & 255]) ^ int(high[crc >> 8]) ^ int(s)
        at = end
    return crc


# ---- reading

_headers: dict[bytes, tuple | None] = {}


def header(four: bytes) -> tuple | None:
    """(bytes, samples, rate, kbit/s, channels, version, layer, protected, side information bytes) of a frame header."""
    if four in _headers:
        return _headers[four]
    out = None
    if len(four) == 4:
        w = int.from_bytes(four, "big")
        version, layer, rate, kbps = w >> 19 & 3, 4 - (w >> 17 & 3), w >> 10 & 3, w >> 12 & 15
        if w >> 21 == 0x7FF and version != 1 and layer < 4 and rate < 3 and 0 < kbps < 15:
            hertz = RATES[version][rate]
            kbit = KBPS[1 if version == 3 else 2, layer][kbps - 1]
            samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
            pad = w >> 9 & 1
            size = (12 * kbit * 1000 // hertz + pad) * 4 if layer == 1 else samples // 8 * kbit * 1000 // hertz + pad
            channels = 1 if w >> 6 & 3 == 3 else 2
            side = ((17 if channels == 1 else 32) if version == 3 else (9 if channels == 1 else 17)) if layer == 3 else 0
            out = size, samples, hertz, kbit, channels, version, layer, not w >> 16 & 1, side
    if len(_headers) > 20_000:
        _headers.clear()
    _headers[four] = out
    return out


def _id3v2(data: bytes, at: int) -> tuple[int, dict[str, str]]:
    """(where the tag ends, its text frames); the start itself where there is none."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127:
        return at, {}
    safe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    major, flags = data[at + 3], data[at + 5]
    end = at + 10 + safe(data[at + 6 : at + 10])
    body = data[at + 10 : end]
    if flags & 0x80:
        body = body.replace(b"\xff\x00", b"\xff")
    k, tags = 0, {}
    if flags & 0x40 and len(body) >= 4:
        k = safe(body) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    wide = 4 if major > 2 else 3
    while k + wide * 2 + 2 * (major > 2) <= len(body) and body[k]:
        name, raw = body[k : k + wide].decode("latin-1"), body[k + wide : k + 2 * wide]
        size = safe(raw) if major == 4 and max(raw) < 128 else int.from_bytes(raw, "big")
        k += wide * 2 + 2 * (major > 2)
        text = body[k : k + size]
        k += size
        if name[0] == "T" and text:
            codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(text[0], "latin-1")
            parts = text[1:].decode(codec, "replace").rstrip("\0").split("\0")
            if name in ("TXXX", "TXX"):
                tags[f"{name}:{parts[0]}"] = parts[-1]
            else:
                tags[name] = "/".join(parts)
    return end + 10 * bool(flags & 0x10 and major == 4), tags


def _vbr(data: bytes, at: int, head: tuple) -> dict | None:
    """The variable-bitrate table in the frame at `at`, or None."""
    frame = data[at : at + head[0]]
    k = 4 + 2 * head[7] + head[8]
    kind = frame[k : k + 4]
    number = lambda a, n=4: int.from_bytes(frame[a : a + n], "big")
    if kind in (b"Xing", b"Info"):
        flags, p = number(k + 4), k + 8
        out = {"kind": kind.decode(), "frames": None, "bytes": None, "toc": None, "quality": None, "delay": 0, "padding": 0, "music_crc": None, "tag_ok": None}
        for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                out[name] = list(frame[p : p + n]) if name == "toc" else number(p, n)
                p += n
        if len(frame) >= p + 36 and frame[p : p + 4] in (b"LAME", b"Lavf", b"Lavc"):
            both = number(p + 21, 3)
            out |= {"delay": both >> 12, "padding": both & 0xFFF, "music_bytes": number(p + 28), "music_crc": number(p + 32, 2), "tag_ok": arc_crc(frame[: p + 34]) == number(p + 34, 2)}
        return out
    if frame[36:40] == b"VBRI":
        n, scale, width, step = number(54, 2), number(56, 2), number(58, 2), number(60, 2)
        return {"kind": "VBRI", "frames": number(50), "bytes": number(46), "quality": number(44, 2), "delay": 0, "padding": 0, "music_crc": None, "tag_ok": None, "step": step, "toc": [scale * number(62 + i * width, width) for i in range(n) if 62 + (i + 1) * width <= len(frame)]}
    return None


def parse(data: bytes | None) -> dict:
    """All that `probe` stores of one stream, and the frames: (offset, header) of each that carries audio."""
    data = data or b""
    at, tags = _id3v2(data, 0)
    end = len(data)
    if end - 128 >= at and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        text = lambda a, n: data[end + a : end + a + n].split(b"\0")[0].decode("latin-1").strip()
        tags |= {f"v1:{k}": v for k, v in (("title", text(3, 30)), ("artist", text(33, 30)), ("album", text(63, 30)), ("year", text(93, 4))) if v}
    frames, skipped, resyncs, checked, failed, vbr, kind, lost = [], 0, 0, 0, 0, None, None, False
    while at + 4 <= end:
        head = header(data[at : at + 4])
        ok = head is not None and at + head[0] <= end and (kind is None or head[5:7] == kind[5:7] and head[2] == kind[2])
        if ok and (kind is None or lost) and at + head[0] + 4 <= end:
            after = header(data[at + head[0] : at + head[0] + 4])
            ok = after is not None and after[5:7] == head[5:7] and after[2] == head[2]
        if not ok:
            found = SYNC.search(data, at + 1, end)
            to = found.start() if found else end
            resyncs += not lost
            lost, skipped, at = True, skipped + to - at, to
            continue
        lost = False
        if head[7] and head[6] == 3:
            checked += 1
            failed += frame_crc(data[at + 2 : at + 4] + data[at + 6 : at + 6 + head[8]]) != int.from_bytes(data[at + 4 : at + 6], "big")
        if kind is None:
            kind = head
            vbr = _vbr(data, at, head) if head[6] == 3 else None
            if vbr:
                vbr["end"] = at + head[0]
                at += head[0]
                continue
        frames.append((at, head))
        at += head[0]
    skipped += max(0, end - at)
    samples = sum(h[1] for _, h in frames)
    if vbr:
        samples = max(0, samples - vbr["delay"] - vbr["padding"])
        if vbr["music_crc"] is not None:
            vbr["music_ok"] = arc_crc(data[vbr["end"] : frames[-1][0] + frames[-1][1][0]] if frames else b"") == vbr["music_crc"]
    return {"tags": tags, "vbr": vbr, "frames": frames, "skipped": skipped, "resyncs": resyncs, "checked": checked, "failed": failed, "samples": samples, "rate": kind[2] if kind else 0}


def seek(parsed: dict, sample: int) -> int | None:
    """The offset of the frame that holds a sample (the encoder's delay counts as before the first)."""
    if not parsed["frames"]:
        return None
    k = (sample + (parsed["vbr"] or {}).get("delay", 0)) // parsed["frames"][0][1][1]
    return parsed["frames"][min(max(k, 0), len(parsed["frames"]) - 1)][0]


def summary(parsed: dict) -> str:
    """One JSON string of what was found, for a feature column."""
    vbr, sizes = parsed["vbr"] or {}, {}
    for _, h in parsed["frames"]:
        sizes[h[3]] = sizes.get(h[3], 0) + 1
    return json.dumps(
        {
            "frames": len(parsed["frames"]), "samples": parsed["samples"], "rate": parsed["rate"], "duration_us": parsed["samples"] * 1_000_000 // parsed["rate"] if parsed["rate"] else 0,
            "kbps": {str(k): v for k, v in sorted(sizes.items())}, "table": vbr.get("kind"), "table_frames": vbr.get("frames"), "tag_ok": vbr.get("tag_ok"), "music_ok": vbr.get("music_ok"),
            "crc_checked": parsed["checked"], "crc_failed": parsed["failed"], "skipped": parsed["skipped"], "resyncs": parsed["resyncs"],
        },
        separators=(",", ":"),
    )


# ---- writing: MPEG-1 Layer III, 48 kHz, stereo


def _head(kbps: int, protected: bool) -> bytes:
    return bytes((0xFF, 0xFA if protected else 0xFB, KBPS[1, 3].index(kbps) + 1 << 4 | 1 << 2, 0))


def _frame_parts(kbps: int) -> tuple[int, bytes, bytes]:
    """(payload bytes, what comes before them, what comes after) of a silent frame."""
    first, side = _head(kbps, True), bytes(32)
    size = header(first)[0]
    room = (size - 38) // UNIT * UNIT
    return room, first + frame_crc(first[2:] + side).to_bytes(2, "big") + side, bytes(size - 38 - room)


@cache
def _frames_by_units() -> dict[int, tuple[int, bytes, bytes]]:
    return {parts[0] // UNIT: parts for parts in map(_frame_parts, (80, 160, 224, 320))}


def _synchsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def _text_frame(name: bytes, text: str) -> bytes:
    body = b"\x03" + text.encode()
    return name + _synchsafe(len(body)) + b"\0\0" + body


def pack(payload: bytes) -> bytes:
    """A stream whose frames carry `payload`, a positive multiple of 192 bytes."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 192 bytes")
    kinds = _frames_by_units()
    room, before, after = kinds[4]
    full, rest = divmod(len(payload), room)
    pieces = [x for k in range(full) for x in (before, payload[k * room : k * room + room], after)]
    if rest:
        _, before, after = kinds[rest // UNIT]
        pieces += [before, payload[full * room :], after]
    audio = b"".join(pieces)
    frames = full + (rest > 0)
    info = _head(64, False)
    first, total = header(info)[0], header(info)[0] + len(audio)
    toc = bytes([min(255, (first + frames * i // 100 * 960) * 256 // total) for i in range(100)])
    tag = info + bytes(32) + b"Xing" + (15).to_bytes(4, "big") + frames.to_bytes(4, "big") + total.to_bytes(4, "big") + toc + bytes(4)
    tag += b"LAME3.100" + bytes(12) + bytes(3) + bytes(4) + total.to_bytes(4, "big") + arc_crc(audio).to_bytes(2, "big")
    tag += arc_crc(tag).to_bytes(2, "big")
    body = _text_frame(b"TSSE", "payload frames") + _text_frame(b"TXXX", f"payload_bytes\0{len(payload)}")
    return b"ID3\x04\0\0" + _synchsafe(len(body)) + body + tag + audio + b"TAG" + b"payload".ljust(124, b"\0") + b"\xff"


def unpack(data: bytes, parsed: dict) -> bytes:
    """The ancillary bytes of all frames, up to the length that the tag states."""
    kinds = {len(a) + room + len(b): room for room, a, b in _frames_by_units().values()}
    out = b"".join([data[at + 38 : at + 38 + kinds.get(h[0], 0)] for at, h in parsed["frames"]])
    return out[: int(parsed["tags"].get("TXXX:payload_bytes", len(out)))]


# ---- DataFrames


def probe(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, tags, table, frames, samples, rate, duration_us, checked, failed, skipped, resyncs, seek_offsets) of each stream."""

    def start():
        def step(batch: pa.RecordBatch) -> dict:
            p = [parse(m) for m in batch.column(1).to_pylist()]
            return {
                id_col: batch.column(0), "tags": [list(x["tags"].items()) for x in p], "vbr_table": [(x["vbr"] or {}).get("kind") for x in p], "vbr_frames": [(x["vbr"] or {}).get("frames") for x in p],
                "frames": [len(x["frames"]) for x in p], "samples": [x["samples"] for x in p], "rate": [x["rate"] for x in p], "duration_us": [x["samples"] * 1_000_000 // x["rate"] if x["rate"] else 0 for x in p],
                "crc_checked": [x["checked"] for x in p], "crc_failed": [x["failed"] for x in p], "skipped_bytes": [x["skipped"] for x in p], "resyncs": [x["resyncs"] for x in p], "seek_offsets": [[at for at, _ in x["frames"]] for x in p],
            }

        return step

    src = df.select(id_col, media_col)
    return map_batches(src, f"`{id_col}` {src.schema[0].dataType.simpleString()}, tags map<string,string>, vbr_table string, vbr_frames long, frames long, samples long, rate int, duration_us long, crc_checked long, crc_failed long, skipped_bytes long, resyncs long, seek_offsets array<long>", start)


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text as a stream, read back: digests of the payload and of the stream, and its summary. A narrow map."""

    def start():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seek_offsets")}
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode()
                media = pack(raw + b" " * (-len(raw) % UNIT or UNIT * (not raw)))
                parsed = parse(media)
                back = unpack(media, parsed)
                for k, v in zip(out, (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), summary(parsed), [at for at, _ in parsed["frames"]])):
                    out[k].append(v)
            return {id_col: batch.column(0)} | out

        return step

    src = df.select(id_col, text_col)
    return map_batches(src, f"`{id_col}` {src.schema[0].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seek_offsets array<long>", start)
