"""Ogg media columns: payloads stored as multiplexed Ogg streams and read back.

Writing: the payload's bytes are unsigned 8-bit samples, cut into packets that are dealt in
turn to ``STREAMS`` logical streams. Each stream starts with a header packet; packets are laced
into pages of at most ``PAGE_SEGMENTS`` segments, so long packets continue on later pages. A
page's granule position is the number of samples of its stream that end with it.

Reading: every page's checksum is verified, packets are reassembled from the lacing values,
logical streams are told apart by serial number, and a packet's time is its granule position
over the sample rate. The payload is the streams' packets in turn.

Defined results: a null text is stored like an empty one; every payload is zero-padded up to a
positive multiple of ``UNIT`` bytes; a null, damaged or cut medium raises ``ValueError`` on
reading (checksums, lacing, page order, the last page of every stream and the payload's length are
checked); repeated rows are stored once each, equal texts alike; very long texts become long
streams of pages of bounded size, a row at a time; an empty table gives an empty result; other
columns of the input play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from tallyloom.llm.common import id_and_text

UNIT, RATE, STREAMS, PACKET, PAGE_SEGMENTS = 64, 8000, 2, 4096, 40
#: Fixed values of the format: capture pattern and header flags.
CAPTURE, CONTINUED, FIRST, LAST = b"OggS", 1, 2, 4
NO_GRANULE = -1
HEADER = struct.Struct("<4sBBqIIIB")
MAGIC, HEAD = b"U8PCM\0\0\0", struct.Struct("<IIQ")
MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, not reflected, starting from 0: zlib's on mirrored bits."""
    mirrored = (zlib.crc32(page.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF) & 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(MIRROR), "big")


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Unpadded length, and the text's UTF-8 padded with zeros up to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


def pages_of(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """The pages of one logical stream; packets: (bytes, granule position at its end)."""
    lacing: list[tuple[int, bytes, int]] = []  # segment length, bytes, granule or NO_GRANULE
    fresh: list[bool] = []  # whether the segment starts a packet
    for body, granule in packets:
        whole = len(body) // 255
        for k in range(whole + 1):
            lacing.append((255 if k < whole else len(body) % 255, body[255 * k : 255 * (k + 1)], NO_GRANULE if k < whole else granule))
            fresh.append(k == 0)
    cuts = [0, 1, *range(1 + PAGE_SEGMENTS, len(lacing), PAGE_SEGMENTS), len(lacing)] if len(lacing) > 1 else [0, len(lacing)]
    out = []
    for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
        segments = lacing[a:b]
        flags = (0 if fresh[a] else CONTINUED) | (FIRST if number == 0 else 0) | (LAST if b == len(lacing) else 0)
        granule = next((s[2] for s in reversed(segments) if s[2] != NO_GRANULE), NO_GRANULE)
        tail = bytes(s[0] for s in segments) + b"".join(s[1] for s in segments)
        blank = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(segments))
        crc = checksum(blank + tail)
        out.append(HEADER.pack(CAPTURE, 0, flags, granule, serial, number, crc, len(segments)) + tail)
    return out


def multiplexed(payload: bytes) -> bytes:
    """The payload as one Ogg file: first pages of all streams first, then their pages in turn."""
    cut = [payload[k : k + PACKET] for k in range(0, len(payload), PACKET)]
    streams = []
    for s in range(STREAMS):
        packets, granule = [(MAGIC + HEAD.pack(RATE, s, len(payload)), 0)], 0
        for body in cut[s::STREAMS]:
            granule += len(body)
            packets.append((body, granule))
        streams.append(pages_of(s + 1, packets))
    longest = max(map(len, streams))
    return b"".join(pages[k] for k in range(longest) for pages in streams if k < len(pages))


def demultiplexed(media: bytes) -> dict[int, list[tuple[bytes, int | None]]]:
    """By serial number, the packets and the granule positions of those that end a page."""
    if media is None:
        raise ValueError("no medium")
    packets: dict[int, list[tuple[bytes, int | None]]] = {}
    open_: dict[int, list[bytes]] = {}
    expected: dict[int, int] = {}
    ended: set[int] = set()
    at = 0
    while at < len(media):
        if at + HEADER.size > len(media):
            raise ValueError(f"no page at byte {at}")
        capture, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        table = media[at + HEADER.size : at + HEADER.size + n]
        end = at + HEADER.size + n + sum(table)
        if capture != CAPTURE or version or end > len(media):
            raise ValueError(f"no page at byte {at}")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"checksum of the page at byte {at}")
        if expected.get(serial, 0) != number or bool(flags & FIRST) != (number == 0) or bool(flags & CONTINUED) != bool(open_.get(serial)):
            raise ValueError(f"sequence of the page at byte {at}")
        if serial in ended:
            raise ValueError(f"a page after the last at byte {at}")
        if flags & LAST:
            ended.add(serial)
        expected[serial] = number + 1
        done, body, pending = packets.setdefault(serial, []), at + HEADER.size + n, open_.pop(serial, [])
        last = None
        for length in table:
            pending.append(media[body : body + length])
            body += length
            if length < 255:
                last = len(done)
                done.append((b"".join(pending), None))
                pending = []
        if pending:
            open_[serial] = pending
        if last is not None:
            done[last] = (done[last][0], granule)
        at = end
    if open_:
        raise ValueError("a packet does not end")
    if not packets or ended != set(packets):
        raise ValueError("a stream does not end")
    return packets


def count_pages(media: bytes) -> int:
    """Pages of a medium, from header to header; what packets hold is never looked at."""
    at = pages = 0
    while at < len(media):
        n = media[at + HEADER.size - 1]
        at += HEADER.size + n + sum(media[at + HEADER.size : at + HEADER.size + n])
        pages += 1
    return pages


def head_of(packet: bytes) -> tuple[int, int, int]:
    """Rate, place of the stream and payload length, from a stream's first packet."""
    if len(packet) != len(MAGIC) + HEAD.size or not packet.startswith(MAGIC):
        raise ValueError("no header of samples")
    return HEAD.unpack_from(packet, len(MAGIC))


def timed(packets: list[tuple[bytes, int | None]]) -> list[tuple[float, bytes]]:
    """(start in seconds, samples) of each audio packet: granule positions count back from page ends."""
    audio = packets[1:]
    starts, after = [0] * len(audio), None
    for i in range(len(audio) - 1, -1, -1):
        granule = audio[i][1]
        end = granule if granule is not None else after
        if end is None:
            raise ValueError("no granule position")
        starts[i] = after = end - len(audio[i][0])
    return [(s / RATE, body) for s, (body, _) in zip(starts, audio)]


def feature_of(media: bytes) -> tuple[bytes, dict]:
    """The payload read back, and what its samples and container look like."""
    by_serial = demultiplexed(media)
    heads = {s: head_of(p[0][0]) for s, p in by_serial.items()}
    by_place = {place: s for s, (_, place, _) in heads.items()}
    if sorted(by_place) != list(range(STREAMS)) or len(heads) != STREAMS:
        raise ValueError("a stream is missing")
    streams = [timed(by_serial[by_place[k]]) for k in range(STREAMS)]
    turns = [p for k in range(max(map(len, streams))) for p in (s[k] for s in streams if k < len(s))]
    payload = b"".join(body for _, body in turns)
    if {length for _, _, length in heads.values()} != {len(payload)}:
        raise ValueError("the payload is not as long as its header says")
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    energy = int((x * x).sum())
    signs = np.sign(x - 128)
    return payload, {
        "streams": len(streams),
        "packets": len(turns),
        "pages": count_pages(media),
        "seconds": round(max(t + len(b) / RATE for s in streams for t, b in s), 6),
        "mean": round(int(x.sum()) / len(x), 6),
        "energy": energy,
        "crossings": int(np.count_nonzero(signs[1:] != signs[:-1])),
        "peak": int(x.max()),
    }


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the text stored as an Ogg medium."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):  # media of few rows at a time are in memory
                part = batch.slice(k, 256)
                sizes, media = [], []
                for text in part.column(1):
                    n, payload = payload_of(text.as_py())
                    sizes.append(n)
                    media.append(multiplexed(payload))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read(stored: DataFrame) -> DataFrame:
    """Digests of the payload read back and of the medium, and the feature (JSON)."""
    import pyarrow as pa

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            rows = []
            for m in batch.column(2):
                media = m.as_py()
                payload, feature = feature_of(media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), json.dumps(feature)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
