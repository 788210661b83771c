"""Media columns as MPEG transport streams: written, parsed and checked with numpy, packet by packet in blocks.

A payload becomes access units of UNIT bytes, each one elementary packet (PES) with a presentation timestamp, cut into
188-byte transport packets with continuity counters after the program tables. Reading parses the tables, checks sync
bytes, table checksums and counters, reassembles the elementary packets and lists each unit's timestamp, byte offset and
whether it is a random-access point.

Null texts are empty; the payload is never empty, as padding is to a positive multiple of 64. Repeated rows give equal
values. demux raises ValueError on a stream that breaks a rule; read_media keeps its row, with the reason in `error` and
nulls beside it, also for a null stream. A packet sent twice counts once, and a counter may jump where the stream marks a
discontinuity. Columns beside doc_id and text are left alone.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prepare, slices, tidy

#: Fixed values of the format: packet size, sync byte, stream type and id of private data, ticks a second.
PACKET, SYNC, PRIVATE_TYPE, PRIVATE_ID, CLOCK = 188, 0x47, 0x06, 0xBD, 90_000
PMT_PID, DATA_PID, PROGRAM = 0x1000, 0x100, 1
UNIT, RATE, ACCESS_EVERY = 32_768, 8_000, 4


def crc_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2 of a table section."""
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(pid: int, table: int, number: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255]) + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    whole = b"\x00" + head + crc_mpeg(head).to_bytes(4, "big")
    return bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10]) + whole.ljust(184, b"\xff")


TABLES = _section(0, 0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")) + _section(
    PMT_PID, 2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
)


def _stamp(t: int, mark: int) -> bytes:
    return bytes([mark << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


def mux(payload: bytes) -> bytes:
    """A transport stream that holds the payload."""
    out, counter = [TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        data = payload[at : at + UNIT]
        pts = at * CLOCK // RATE & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([PRIVATE_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(pts, 2) + data
        access = k % ACCESS_EVERY == 0
        # the first packet has a clock reference in its adaptation field
        first = 176
        n = 1 + max(0, -(-(len(pes) - first) // 184))
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter = (counter + n) & 15
        raw = np.frombuffer(pes, np.uint8)
        clock = pts.to_bytes(5, "big")
        ref = int.from_bytes(clock, "big") << 15 | 0x7E00
        lead = min(first, len(raw))
        packets[0, 3] |= 0x20
        packets[0, 4] = 7 + first - lead
        packets[0, 5] = 0x10 | 0x40 * access
        packets[0, 6:12] = np.frombuffer(ref.to_bytes(6, "big"), np.uint8)
        packets[0, PACKET - lead :] = raw[:lead]
        raw = raw[lead:]
        full = len(raw) // 184
        if full:
            packets[1 : 1 + full, 4:] = raw[: full * 184].reshape(full, 184)
        raw = raw[full * 184 :]
        if len(raw):
            packets[-1, 3] |= 0x20
            packets[-1, 4] = 183 - len(raw)
            if len(raw) < 183:
                packets[-1, 5] = 0
            packets[-1, PACKET - len(raw) :] = raw
        out.append(packets.tobytes())
    return b"".join(out)


def _table(packets: np.ndarray, pid: int, table: int) -> bytes:
    rows = packets[((packets[:, 1] & 31).astype(int) << 8 | packets[:, 2]) == pid]
    if not len(rows):
        raise ValueError(f"no table with PID {pid}")
    raw = rows[0, 4:].tobytes()
    raw = raw[1 + raw[0] :]
    if len(raw) < 12:
        raise ValueError(f"bad table with PID {pid}")
    size = (raw[1] & 15) << 8 | raw[2]
    if raw[0] != table or crc_mpeg(raw[: 3 + size]):
        raise ValueError(f"bad table with PID {pid}")
    return raw[8 : size - 1]


def demux(stream: bytes) -> tuple[bytes, list[tuple[int, int, bool]], int]:
    """The payload, (timestamp, byte offset, random access) of each unit, and the number of packets."""
    if not stream or len(stream) % PACKET:
        raise ValueError("not a whole number of packets")
    p = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any() or (p[:, 1] & 0x80).any():
        raise ValueError("lost sync or a transport error")
    pat = _table(p, 0, 0)
    if len(pat) < 4:
        raise ValueError("no program")
    pmt = _table(p, (pat[2] & 31) << 8 | pat[3], 2)
    at = 4 + ((pmt[2] & 15) << 8 | pmt[3]) if len(pmt) > 3 else 0
    if not at or at + 2 >= len(pmt) or pmt[at] != PRIVATE_TYPE:
        raise ValueError("no stream of private data")
    pid = (pmt[at + 1] & 31) << 8 | pmt[at + 2]
    own = p[((p[:, 1] & 31).astype(np.int32) << 8 | p[:, 2]) == pid]
    own = own[(own[:, 3] & 0x10) != 0]
    # a packet may be sent twice: all but its clock reference is the same
    again = np.zeros(len(own), bool)
    body = own.copy()
    body[(own[:, 3] & 0x20 != 0) & (own[:, 4] >= 7) & (own[:, 5] & 0x10 != 0), 6:12] = 0
    again[1:] = (body[1:] == body[:-1]).all(axis=1)
    again[1:] &= ~again[:-1]
    own = own[~again]
    counters = own[:, 3] & 15
    adapted = (own[:, 3] & 0x20) != 0
    marked = adapted & (own[:, 4] > 0) & (own[:, 5] & 0x80 != 0)
    if len(own) and (((counters[1:] - counters[:-1]) & 15 != 1) & ~marked[1:]).any():
        raise ValueError("a continuity counter jumps")
    begin = np.minimum(np.where(adapted, 5 + own[:, 4].astype(int), 4), PACKET)
    starts = np.flatnonzero(own[:, 1] & 0x40)
    if not len(starts) or starts[0]:
        raise ValueError("no start of an elementary packet")
    access = adapted & (own[:, 4] > 0) & ((own[:, 5] & 0x40) != 0)
    sizes = PACKET - begin
    raw = own[np.arange(PACKET) >= begin[:, None]]
    ends = np.cumsum(sizes)
    parts, units, offset = [], [], 0
    for i, s in enumerate(starts):
        a, b = ends[s] - sizes[s], ends[starts[i + 1] - 1] if i + 1 < len(starts) else ends[-1]
        pes = raw[a:b]
        h = pes[:14].tobytes()
        if len(h) < 14 or h[:4] != b"\x00\x00\x01" + bytes([PRIVATE_ID]) or (h[4] << 8 | h[5]) != b - a - 6:
            raise ValueError("a broken elementary packet")
        pts = (h[9] >> 1 & 7) << 30 | h[10] << 22 | h[11] >> 1 << 15 | h[12] << 7 | h[13] >> 1
        units.append((pts, offset, bool(access[s])))
        parts.append(pes[9 + h[8] :].tobytes())
        offset += len(parts[-1])
    return b"".join(parts), units, len(p)


def pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 or 64 * (not raw))


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text in UTF-8, padded, as a transport stream."""
    prepare(docs.sparkSession)

    def run(batches):
        with tidy():
            for batch in slices(batches, 256, 4 << 20):
                texts = [x or b"" for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(pad(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.encode(F.col("text").cast("string"), "UTF-8").alias("raw")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """What the stored streams hold: digests of the payload and the stream, timestamps, a feature string; or an error."""
    prepare(stored.sparkSession)

    def run(batches):
        with tidy():
            for batch in slices(batches, 256, 4 << 20):
                cols: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "timestamps", "access_offsets")}
                cols["error"] = []
                for media in batch.column(2).to_pylist():
                    try:
                        payload, units, packets = demux(media or b"")
                    except ValueError as e:
                        for k in cols:
                            cols[k].append(str(e) if k == "error" else None)
                        continue
                    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                    share = counts[counts > 0] / len(payload)
                    entropy = float(-(share * np.log2(share)).sum())
                    jumps = [b[0] - a[0] for a, b in zip(units, units[1:])]  # noqa: B905
                    for k, v in (
                        ("payload_bytes", len(payload)),
                        ("payload_sha256", hashlib.sha256(payload).hexdigest()),
                        ("tail_crc32", zlib.crc32(payload[-64:])),
                        ("media_bytes", len(media)),
                        ("media_sha256", hashlib.sha256(media).hexdigest()),
                        ("feature", f"packets={packets};units={len(units)};access={sum(u[2] for u in units)};last_pts={units[-1][0]};largest_step={max(jumps, default=0)};entropy={entropy + 0.0:.6f}"),
                        ("timestamps", [u[0] for u in units]),
                        ("access_offsets", [u[1] for u in units if u[2]]),
                        ("error", None),
                    ):
                        cols[k].append(v)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, t) for v, t in zip(cols.values(), kinds, strict=True))], names=["doc_id", "n_bytes", *cols])

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<bigint>, access_offsets array<bigint>, error string")
