"""Media columns: MPEG transport streams that carry bytes.

A payload is cut into access units; each goes into one packetised elementary packet with a
presentation time, and that into 188-byte transport packets. A program association and a
program map table stand first. Every access unit is a random-access point with a clock reference.
Reading parses the tables, checks continuity counters, reassembles the packets of the
elementary stream and returns units with times, byte ranges and random-access flags.

Scale: one pass over the rows, no shuffle; a task holds one stream at a time.

Cases: a null or empty text is a payload of one block of zero bytes. Equal payloads give equal
streams. Rows that share an id are returned one by one; other columns are ignored. A stream with lost,
repeated or torn packets is read as far as it goes and says so in its error count; no stream makes the reader fail. Tables
of more than one packet aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format (ISO/IEC 13818-1).
PACKET, SYNC, PAT_PID, PMT_PID, STREAM_PID = 188, 0x47, 0x0000, 0x1000, 0x0100
PRIVATE_DATA_TYPE, PRIVATE_STREAM_1, CLOCK = 0x06, 0xBD, 90_000
CRC_POLYNOMIAL = 0x04C11DB7


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ CRC_POLYNOMIAL if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _table_packet(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    section = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    section += crc32_mpeg(section).to_bytes(4, "big")
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


#: The same for every stream: program 1 with its map, and the map with one stream that also carries the clock.
TABLES = _table_packet(PAT_PID, 0x00, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")) + _table_packet(
    PMT_PID, 0x02, 1, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"
)


def _pes_header(length: int, pts: int) -> bytes:
    stamp = bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])
    return b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (length + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp


def _adaptation(flags: int, clock: int, size: int) -> bytes:
    """An adaptation field of size bytes (2 at least, 8 with a clock)."""
    body = bytes([size - 1, flags])
    if flags & 0x10:
        body += (clock << 15 | 0x7E00).to_bytes(6, "big")
    return body.ljust(size, b"\xff")


def mux(payload: bytes, unit: int = 16384, ticks: int = 3600) -> bytes:
    """A transport stream of payload; unit: bytes of an access unit (at most 65,000), ticks: of the 90 kHz clock between them."""
    if not 0 < unit <= 65_000:
        raise ValueError("unit has to lie in 1..65000")
    out, counter = [TABLES], 0
    for n, at in enumerate(range(0, len(payload), unit)):
        own = payload[at : at + unit]
        data = np.frombuffer(_pes_header(len(own), n * ticks & 0x1FFFFFFFF) + own, np.uint8)
        lead = PACKET - 4 - 8  # payload of a packet with the clock
        whole, rest = divmod(max(0, len(data) - lead), PACKET - 4)
        packets = np.full((1 + whole + (rest > 0), PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 255
        packets[:, 3] = 0x10 | (counter + np.arange(len(packets)) & 15)
        counter += len(packets)
        packets[0, 1] |= 0x40
        packets[0, 3] |= 0x20
        first = min(lead, len(data))
        field = _adaptation(0x50, n * ticks & 0x1FFFFFFFF, PACKET - 4 - first)
        packets[0, 4:] = np.frombuffer(field + data[:first].tobytes(), np.uint8)
        packets[1 : 1 + whole, 4:] = data[first : first + whole * (PACKET - 4)].reshape(whole, PACKET - 4)
        if rest:
            stuffing = PACKET - 4 - rest
            packets[-1, 3] |= 0x20
            packets[-1, 4:] = np.frombuffer((b"\x00" if stuffing == 1 else _adaptation(0, 0, stuffing)) + data[-rest:].tobytes(), np.uint8)
        out.append(packets.tobytes())
    return b"".join(out)


def _section(packets: np.ndarray, pid: int, table_id: int) -> bytes | None:
    pids = (packets[:, 1].astype(int) & 0x1F) << 8 | packets[:, 2]
    for p in packets[(pids == pid) & (packets[:, 1] & 0x40 > 0)]:
        raw = p[4:].tobytes()
        if p[3] & 0x20:
            raw = raw[1 + raw[0] :]
        raw = raw[1 + raw[0] :] if raw else raw
        if len(raw) < 3:
            continue
        length = int.from_bytes(raw[1:3], "big") & 0xFFF
        whole = raw[: 3 + length]
        if raw[0] == table_id and len(whole) == 3 + length and crc32_mpeg(whole) == 0:
            return whole[8:-4]
    return None


def demux(stream: bytes) -> dict:
    """pids; units: (pts, random access, start, end) in payload; payload; errors: lost, torn or unreadable packets."""
    n = len(stream) // PACKET
    packets = np.frombuffer(stream, np.uint8, n * PACKET).reshape(n, PACKET)
    good = (packets[:, 0] == SYNC) & (packets[:, 1] & 0x80 == 0)
    errors = int((~good).sum()) + (len(stream) % PACKET > 0)
    packets = packets[good]
    out = {"map_pid": None, "stream_pid": None, "stream_type": None, "units": [], "payload": b"", "errors": errors}
    programs = _section(packets, PAT_PID, 0x00)
    if programs is None:
        return out | {"errors": errors + 1}
    out["map_pid"] = next((int.from_bytes(programs[i + 2 : i + 4], "big") & 0x1FFF for i in range(0, len(programs), 4) if programs[i : i + 2] != b"\0\0"), None)
    streams = None if out["map_pid"] is None else _section(packets, out["map_pid"], 0x02)
    if streams is None:
        return out | {"errors": errors + 1}
    at = 4 + (int.from_bytes(streams[2:4], "big") & 0xFFF)
    if at + 5 > len(streams):
        return out | {"errors": errors + 1}
    out["stream_type"], out["stream_pid"] = streams[at], int.from_bytes(streams[at + 1 : at + 3], "big") & 0x1FFF
    own = packets[((packets[:, 1].astype(int) & 0x1F) << 8 | packets[:, 2]) == out["stream_pid"]]
    own = own[own[:, 3] & 0x10 > 0]
    counters = own[:, 3] & 15
    repeats = np.zeros(len(own), bool)
    if len(own):
        repeats[1:] = (counters[1:] == counters[:-1]) & (own[1:] == own[:-1]).all(axis=1)
        own, counters = own[~repeats], counters[~repeats]
        errors += int(((counters[:-1] + 1 & 15) != counters[1:]).sum())
    # Bytes of the packets behind their headers, in one array.
    skip = np.where(own[:, 3] & 0x20, 5 + np.minimum(own[:, 4].astype(int), PACKET - 5), 4)
    starts = own[:, 1] & 0x40 > 0
    access = (own[:, 3] & 0x20 > 0) & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
    parts, size = [], 0
    first = np.flatnonzero(starts)
    errors += bool(len(own)) and (not len(first) or first[0] > 0)
    for i, j in zip(first, [*first[1:], len(own)]):
        # Only the ends of a unit have fields; packets between are copied in one go.
        middle = own[i + 1 : j]
        plain = skip[i + 1 : j] == 4
        if plain[:-1].all():
            tail = [middle[-1, skip[j - 1] :].tobytes()] if len(middle) else []
            pes = own[i, skip[i] :].tobytes() + middle[:-1, 4:].tobytes() + b"".join(tail)
        else:
            pes = b"".join(own[k, skip[k] :].tobytes() for k in range(i, j))
        length = int.from_bytes(pes[4:6], "big")
        if pes[:3] != b"\0\0\1" or len(pes) < 9 or len(pes) < 9 + pes[8] or pes[7] & 0x80 and pes[8] < 5 or length and len(pes) < 6 + length:
            errors += 1
            continue
        pts = None
        if pes[7] & 0x80:
            t = pes[9:14]
            pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1
        data = pes[9 + pes[8] : 6 + length if length else None]
        parts.append(data)
        out["units"].append((pts, bool(access[i]), size, size + len(data)))
        size += len(data)
    return out | {"payload": b"".join(parts), "errors": int(errors)}


def padded(text: str | None, block: int = 64) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // block)) * block, b"\0")


def mux_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 64, unit: int = 16384, ticks: int = 3600) -> DataFrame:
    """Per row: id, n_bytes, media (the stream that stores the padded text)."""
    left = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                both = [padded(t, block) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in both], pa.int64()), pa.array([mux(p, unit, ticks) for _, p in both], pa.binary())], ["id", "n_bytes", "media"])

    return left.mapInArrow(run, f"id {left.schema[0].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


_UNIT = pa.struct([("pts", pa.int64()), ("random_access", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())])


def demux_column(media: DataFrame, keys: list[str], media_col: str = "media") -> DataFrame:
    """Per row: the keys, payload, units (array of pts, random_access, start, end), errors, stream_pid, media_bytes, media_sha256, feature."""
    left = media.select(*keys, F.col(media_col).alias("media"))
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [x or b"" for x in part.column(len(keys)).to_pylist()]
                read = [demux(x) for x in raw]
                units = [[{"pts": p, "random_access": r, "start": s, "end": e} for p, r, s, e in x["units"]] for x in read]
                said = []
                for x in read:
                    times = [u[0] for u in x["units"] if u[0] is not None]
                    said.append(f"program=1;pid={x['stream_pid']};type={x['stream_type']};units={len(x['units'])};random_access={sum(u[1] for u in x['units'])};pts={times[0] if times else ''}-{times[-1] if times else ''};errors={x['errors']}")
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array([x["payload"] for x in read], pa.binary()), pa.array(units, pa.list_(_UNIT)), pa.array([x["errors"] for x in read], pa.int32()), pa.array([x["stream_pid"] for x in read], pa.int32()), pa.array([len(x) for x in raw], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array(said)],
                    [*keys, "payload", "units", "errors", "stream_pid", "media_bytes", "media_sha256", "feature"],
                )

    return left.mapInArrow(run, f"{spec}, payload binary, units array<struct<pts:bigint,random_access:boolean,start:bigint,end:bigint>>, errors int, stream_pid int, media_bytes long, media_sha256 string, feature string")


def op9_media(spark, sf_dir: str) -> DataFrame:
    stored = mux_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    read = demux_column(stored, ["doc_id", "n_bytes"])
    return read.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")
