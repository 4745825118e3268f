"""Media columns as MPEG transport streams (ISO/IEC 13818-1): multiplex, parse, check, reassemble.

A stream is 188-byte packets. Packet identifier 0 carries the program association table, which names
the identifier of each program's map table, which names its elementary streams. Elementary streams
travel as PES packets cut over transport packets, with presentation times of 90 kHz, and mark the
packets where a decoder may start (random access). A 4-bit continuity counter by identifier shows loss.

`store` multiplexes a binary column losslessly as 8-bit samples; `elementary_packets` demultiplexes any
stream into one row per PES packet; `digests` reads streams back and describes them in one row each.

Defined cases: null payloads are stored as empty ones; an empty payload gives a stream of tables only;
rows are independent, so repeated rows give repeated results; an empty table gives an empty table;
columns of the input that bear an output's name are replaced. Broken streams never raise: bytes before
sync, packets with errors, gaps and bad checksums are counted and what they hit is marked incomplete.
Every stream is handled alone by one task, in memory proportional to that stream.
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
from pyspark.sql import types as T

from foliant.llm._common import column, without

# Fixed values of the format.
PACKET_BYTES = 188
SYNC_BYTE = 0x47
PAT_PID = 0
NULL_PID = 0x1FFF
TIMESTAMP_HZ = 90_000
TIMESTAMP_BITS = 33
PRIVATE_STREAM_1 = 0xBD
PRIVATE_PES_TYPE = 0x06

# What `store` writes.
PMT_PID = 0x1000
SAMPLES_PID = 0x100
PROGRAM = 1
SAMPLE_HZ = 8_000
UNIT_SAMPLES = 1_024
RANDOM_ACCESS_EVERY = 8


def _crc_table() -> np.ndarray:
    """CRC-32/MPEG-2: polynomial 04C11DB7, most significant bit first, no final inversion."""
    t = np.arange(256, dtype=np.uint64) << np.uint64(24)
    for _ in range(8):
        t = ((t << np.uint64(1)) ^ np.where(t >> np.uint64(31) & np.uint64(1), np.uint64(0x04C11DB7), np.uint64(0))) & np.uint64(0xFFFFFFFF)
    return t


_CRC = _crc_table().tolist()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


# --- writing ---------------------------------------------------------------------------------------


def _stamp(value: int, marker: int) -> bytes:
    """A 33-bit time in five bytes, with a marker bit after each part."""
    return bytes([marker << 4 | value >> 30 << 1 | 1, value >> 22 & 255, (value >> 15 & 127) << 1 | 1, value >> 7 & 255, (value & 127) << 1 | 1])


def _section(table: int, number: int, body: bytes) -> bytes:
    length = len(body) + 9
    head = bytes([table, 0xB0 | length >> 8, length & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return b"\x00" + head + crc32_mpeg(head).to_bytes(4, "big")  # pointer field first


def _cut(out: list[bytes], pid: int, body: bytes, counter: int, clock: int | None = None, filler: bool = False) -> int:
    """Appends `body` as packets of one identifier, its start marked; returns the next counter.

    `clock` marks the first packet as a random-access point with a program clock reference. The last
    packet is stuffed in its adaptation field, or for tables (`filler`) with 0xFF after the section.
    """
    high = pid >> 8
    start, at, end = 0x40, 0, len(body)
    while at < end:
        field_ = b"" if clock is None else bytes([7, 0x50]) + ((clock & (1 << TIMESTAMP_BITS) - 1) << 15 | 0x7E00).to_bytes(6, "big")
        piece = body[at : at + 184 - len(field_)]
        spare = 184 - len(field_) - len(piece)
        if spare and filler:
            piece += b"\xff" * spare
        elif spare and field_:
            field_ = bytes([field_[0] + spare]) + field_[1:] + b"\xff" * spare
        elif spare:
            field_ = bytes([spare - 1]) + (b"\x00" + b"\xff" * (spare - 2) if spare > 1 else b"")
        out.append(bytes([SYNC_BYTE, start | high, pid & 255, (0x30 if field_ else 0x10) | counter]) + field_ + piece)
        counter = counter + 1 & 15
        at += 184 - len(field_) if not spare else end
        start, clock = 0, None
    return counter


def multiplex(payload: bytes, unit: int = UNIT_SAMPLES, every: int = RANDOM_ACCESS_EVERY) -> bytes:
    """One program with one private stream: `unit` samples to a PES packet, each `every`-th a random-access point led by the tables."""
    if not 0 < unit <= 65_527:
        raise ValueError("a PES packet holds 1 to 65,527 samples")
    pat = _section(0x00, 1, bytes([PROGRAM >> 8, PROGRAM & 255, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
    pmt = _section(0x02, PROGRAM, bytes([0xE0 | SAMPLES_PID >> 8, SAMPLES_PID & 255, 0xF0, 0, PRIVATE_PES_TYPE, 0xE0 | SAMPLES_PID >> 8, SAMPLES_PID & 255, 0xF0, 0]))
    out: list[bytes] = []
    tables = counter = 0
    if not payload:
        _cut(out, PAT_PID, pat, 0, filler=True)
        _cut(out, PMT_PID, pmt, 0, filler=True)
    for i, at in enumerate(range(0, len(payload), unit)):
        piece = payload[at : at + unit]
        time = at * TIMESTAMP_HZ // SAMPLE_HZ & (1 << TIMESTAMP_BITS) - 1
        start = i % every == 0
        if start:
            _cut(out, PAT_PID, pat, tables, filler=True)
            _cut(out, PMT_PID, pmt, tables, filler=True)
            tables = tables + 1 & 15
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(piece) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(time, 2) + piece
        counter = _cut(out, SAMPLES_PID, pes, counter, time if start else None)
    return b"".join(out)


# --- reading ---------------------------------------------------------------------------------------


@dataclass
class Unit:
    """One reassembled PES packet."""

    pid: int
    packet: int  # index of its first transport packet
    pts: int | None
    dts: int | None
    random_access: bool
    complete: bool
    data: bytes


@dataclass
class Stream:
    """What a transport stream holds."""

    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)  # number: identifier of its map
    streams: dict[int, tuple[int, int]] = field(default_factory=dict)  # identifier: type, program
    units: list[Unit] = field(default_factory=list)
    continuity_errors: int = 0
    duplicates: int = 0
    damaged_packets: int = 0  # error indicator set, scrambled, or a field longer than the packet
    skipped_bytes: int = 0
    table_errors: int = 0


def _align(data: bytes, found: Stream) -> np.ndarray:
    """The packets of `data` as rows; where sync is lost, the next place at which two packets follow each other, or the end."""
    whole = len(data) // PACKET_BYTES
    rows = np.frombuffer(data, np.uint8, whole * PACKET_BYTES).reshape(whole, PACKET_BYTES)
    if len(data) == whole * PACKET_BYTES and (rows[:, 0] == SYNC_BYTE).all():
        return rows
    at, kept = 0, []
    while at + PACKET_BYTES <= len(data):
        after = at + PACKET_BYTES
        if data[at] == SYNC_BYTE and (after + 1 > len(data) or data[after] == SYNC_BYTE or (kept and kept[-1] + PACKET_BYTES == at)):
            kept.append(at)
            at = after
        else:
            nearest = data.find(SYNC_BYTE, at + 1)
            nearest = len(data) if nearest < 0 else nearest
            found.skipped_bytes += nearest - at
            at = nearest
    found.skipped_bytes += max(0, len(data) - at)
    return np.stack([np.frombuffer(data, np.uint8, PACKET_BYTES, x) for x in kept]) if kept else np.empty((0, PACKET_BYTES), np.uint8)


def _sections(pieces: list[tuple[bool, bytes]], found: Stream) -> Iterator[bytes]:
    """Whole sections with a right checksum out of a table's packets: (starts, payload) each."""
    buffer = b""
    for starts, body in pieces:
        if starts and body:
            skip = 1 + body[0]
            parts = [(buffer + body[1:skip], False), (body[skip:], True)]
        else:
            parts = [(buffer + body, False)]
        for part, fresh in parts:
            buffer = part
            while len(buffer) >= 3 and buffer[0] != 0xFF:
                length = 3 + ((buffer[1] & 15) << 8 | buffer[2])
                if len(buffer) < length:
                    break
                section, buffer = buffer[:length], buffer[length:]
                if length >= 12 and crc32_mpeg(section) == 0:
                    yield section
                else:
                    found.table_errors += 1
            if buffer[:1] == b"\xff" or (not fresh and len(parts) == 2):
                buffer = b""


def _time(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def _unit(pid: int, packet: int, raw: bytes, random_access: bool, sound: bool) -> Unit:
    if len(raw) < 6 or raw[:3] != b"\x00\x00\x01":
        return Unit(pid, packet, None, None, random_access, False, raw)
    length = raw[4] << 8 | raw[5]
    end = 6 + length if length else len(raw)
    complete = sound and len(raw) >= end
    body, pts, dts = raw[6:end], None, None
    if raw[3] not in (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF) and len(body) >= 3 and body[0] >> 6 == 2:  # these ids have no optional header
        flags, skip = body[1] >> 6, 3 + body[2]
        if flags & 2 and len(body) >= 8:
            pts = _time(body[3:8])
        if flags == 3 and len(body) >= 13:
            dts = _time(body[8:13])
        complete, body = complete and len(body) >= skip, body[skip:]
    return Unit(pid, packet, pts, dts, random_access, complete, body)


def demultiplex(data: bytes) -> Stream:
    """Parses program tables, checks continuity, and reassembles the PES packets of every elementary stream they name."""
    found = Stream()
    rows = _align(data, found)
    n = found.packets = len(rows)
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    has_field, has_body = rows[:, 3] & 0x20 > 0, rows[:, 3] & 0x10 > 0
    start = np.where(has_field, 5 + rows[:, 4].astype(np.int32), 4)
    flags = np.where(has_field & (rows[:, 4] > 0), rows[:, 5], 0)
    bad = (rows[:, 1] & 0x80 > 0) | (rows[:, 3] & 0xC0 > 0) | (start > PACKET_BYTES) | (has_body & (start >= PACKET_BYTES))
    found.damaged_packets = int(bad.sum())
    starts = rows[:, 1] & 0x40 > 0
    counter = rows[:, 3] & 15
    usable = ~bad & has_body & (pid != NULL_PID)

    def of(which: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of an identifier's packets without repeats, and whether something is missing before each."""
        at = np.flatnonzero(usable & (pid == which))
        c, jump = counter[at].astype(np.int16), flags[at] & 0x80 > 0
        step = np.diff(c) & 15
        same = np.zeros(len(at), bool)
        for i in np.flatnonzero((step == 0) & ~jump[1:]) + 1:
            same[i] = not same[i - 1] and bool((rows[at[i]] == rows[at[i - 1]]).all())
        gap = np.zeros(len(at), bool)
        gap[1:] = (step != 1) & ~jump[1:] & ~same[1:]
        found.duplicates += int(same.sum())
        found.continuity_errors += int(gap.sum())
        return at[~same], gap[~same]

    def table(which: int) -> Iterator[bytes]:
        at, gap = of(which)
        pieces = [(bool(starts[i]), rows[i, start[i] :].tobytes()) for i in at]
        return _sections(pieces if not gap.any() else [p for p, g in zip(pieces, gap, strict=True) if p[0] or not g], found)

    if n:
        for s in table(PAT_PID):
            if s[0] == 0x00:
                for i in range(8, len(s) - 4, 4):
                    if number := s[i] << 8 | s[i + 1]:
                        found.programs[number] = (s[i + 2] & 31) << 8 | s[i + 3]
        for which in sorted(set(found.programs.values())):
            for s in table(which):
                if s[0] == 0x02:
                    i = 12 + ((s[10] & 15) << 8 | s[11])
                    while i + 5 <= len(s) - 4:
                        found.streams[(s[i + 1] & 31) << 8 | s[i + 2]] = (s[i], s[3] << 8 | s[4])
                        i += 5 + ((s[i + 3] & 15) << 8 | s[i + 4])
    places = np.arange(PACKET_BYTES)
    for which in sorted(found.streams):
        at, gap = of(which)
        firsts = np.flatnonzero(starts[at])
        if not len(firsts):
            continue
        mine = rows[at]
        body = mine[places >= start[at][:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(PACKET_BYTES - start[at])])
        for i, j in zip(firsts, [*firsts[1:], len(at)], strict=True):
            found.units.append(_unit(which, int(at[i]), body[ends[i] : ends[j]], bool(flags[at[i]] & 0x40), not gap[i + 1 : j].any()))
    found.units.sort(key=lambda u: (u.packet, u.pid))
    return found


# --- operators -------------------------------------------------------------------------------------


def padded(data: bytes | None, multiple: int = 64) -> bytes:
    """`data` with zero bytes up to the next positive multiple."""
    data = data or b""
    return data + bytes(max(multiple, -(-len(data) // multiple) * multiple) - len(data))


def store(df: DataFrame, payload: str, out: str = "media", unit: int = UNIT_SAMPLES, every: int = RANDOM_ACCESS_EVERY) -> DataFrame:
    """`df` with column `out`: the transport stream of its binary column `payload` (null: of no bytes)."""
    base = without(df, out)
    at = df.columns.index(payload)
    schema = T.StructType([*base.schema.fields, T.StructField(out, T.BinaryType(), False)])
    kept, names = [df.columns.index(c) for c in base.columns], [*base.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = pa.array([multiplex(x or b"", unit, every) for x in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), media], names=names)

    return df.mapInArrow(run, schema)


def elementary_packets(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """One row per PES packet of every stream: key, pid, program, stream_type, unit (from 0 by pid), pts, dts, random_access, complete, data."""
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("pid", T.IntegerType()), T.StructField("program", T.IntegerType()), T.StructField("stream_type", T.IntegerType()), T.StructField("unit", T.IntegerType()), T.StructField("pts", T.LongType()), T.StructField("dts", T.LongType()), T.StructField("random_access", T.BooleanType()), T.StructField("complete", T.BooleanType()), T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, media_ in enumerate(b.column(1).to_pylist()):
                found = demultiplex(media_ or b"")
                seen: dict[int, int] = {}
                rows = []
                for u in found.units:
                    seen[u.pid] = seen.get(u.pid, -1) + 1
                    rows.append((u.pid, found.streams[u.pid][1], found.streams[u.pid][0], seen[u.pid], u.pts, u.dts, u.random_access, u.complete, u.data))
                if rows:
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1).take(pa.array([0] * len(rows))), *cols], names=[f.name for f in schema])

    return df.select(column(key), column(media)).mapInArrow(run, schema)


def feature(found: Stream, data: bytes) -> str:
    """Program layout, time span, random-access points, faults, and the mean, root mean square and sign changes of the samples."""
    times = [u.pts for u in found.units if u.pts is not None]
    points = [u.pts for u in found.units if u.random_access]
    x = np.frombuffer(data, np.uint8).astype(np.int64) - 128
    n = max(1, len(x))
    mean, rms = int(x.sum()) / n, (int((x * x).sum()) / n) ** 0.5
    turns = int(((x[1:] < 0) != (x[:-1] < 0)).sum()) if len(x) else 0
    layout = ",".join(f"{p}:{kind:02x}@{i:04x}" for i, (kind, p) in sorted(found.streams.items()))
    return (
        f"layout={layout};packets={found.packets};units={len(found.units)};broken={sum(not u.complete for u in found.units)};"
        f"pts={min(times, default=-1)}-{max(times, default=-1)};random_access={len(points)}@{points[0] if points else -1}-{points[-1] if points else -1};"
        f"continuity={found.continuity_errors};damaged={found.damaged_packets};skipped={found.skipped_bytes};tables={found.table_errors};"
        f"mean={mean:.4f};rms={rms:.4f};turns={turns}"
    )


def digests(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """Reads each stream back: key, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, units, random_access_points, faults."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *[T.StructField(n, t) for n, t in (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("units", T.LongType()), ("random_access_points", T.LongType()), ("faults", T.LongType()))]])

    def one(media_: bytes) -> tuple:
        found = demultiplex(media_)
        data = b"".join(u.data for u in found.units)
        faults = found.continuity_errors + found.damaged_packets + found.skipped_bytes + found.table_errors + sum(not u.complete for u in found.units)
        return (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media_), hashlib.sha256(media_).hexdigest(), feature(found, data), len(found.units), sum(u.random_access for u in found.units), faults)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        for b in batches:
            rows = [one(x or b"") for x in b.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[f.name for f in schema])

    return df.select(column(key), column(media)).mapInArrow(run, schema)


def text_payloads(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, payload): UTF-8 of the whole text (null: empty) with zero bytes up to a positive multiple of 64."""
    raw = F.coalesce(column(text), F.lit("")).cast("binary")
    n = F.octet_length(raw)
    spare = F.greatest(F.lit(64), F.ceil(n / 64).cast("int") * 64) - n
    return docs.select(column(key).alias(key), n.cast("long").alias("n_bytes"), F.concat(raw, F.substring(F.unhex(F.lit("00" * 64)), F.lit(1), spare)).alias("payload"))


def op1_transport_stream(spark, sf_dir: str) -> DataFrame:
    """Every document's payload stored as a transport stream, read back and described."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = text_payloads(docs)
    kept = texts.select(F.struct("doc_id", "n_bytes").alias("row"), "payload")
    read = digests(store(kept, "payload").select("row", "media"), "row")
    return read.select("row.doc_id", "row.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "units", "random_access_points", "faults")
