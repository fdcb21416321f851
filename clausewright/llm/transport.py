"""Media columns in MPEG transport streams.

:func:`store` keeps bytes as 8-bit samples (48 kHz, one channel) in a transport stream of one program: 188-byte
packets with program tables, continuity counters, clock references, and elementary packets of UNIT samples with
presentation times; every GROUP units the tables are repeated and a random-access point is marked.
:func:`parse` reads any such column, its own or another's: it finds the packets (188, 192 or 204 bytes apart, also
after lost bytes), reads the program tables and checks their CRC, checks the continuity counters, leaves repeated
packets out, and reassembles the elementary packets. Their times and the random-access points are
columns, so that :func:`point_before` seeks without reading media again; :func:`access_units` gives a row for each unit.

Defined results: null media gives null columns; media without packets, or without valid tables, have
no streams and an empty payload; a wrong CRC leaves that table out and counts in ``bad_tables``; a lost packet counts in
``errors`` and makes its unit incomplete, the bytes that came are kept; scrambled packets and those
marked as damaged are left out and counted as lost; packets before a stream's first unit are
skipped; several streams are joined in the order of their packet numbers (PID). Empty samples are a stream of tables only;
equal bytes give equal media; other columns are kept; an empty table gives an empty table. A row's media are held whole, as one value of a column.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import map_arrow, quoted

#: Bytes of a packet, and its first byte; spacings in use (plain, with an arrival time before each, with a check after each).
PACKET, SYNC = 188, 0x47
SPACINGS = (188, 192, 204)
#: Samples that a frame, an elementary packet (eight frames, 96 ms) and seconds have.
FRAME, RATE = 576, 48_000
UNIT = 8 * FRAME
#: Elementary packets from one random-access point to the next.
GROUP = 8
#: Ticks of presentation times a second; they wrap at 33 bits.
TICKS, WRAP = 90_000, 1 << 33
#: Numbers of the stream's packets: tables, elementary packets; private data as type and as stream.
TABLES, PROGRAM, SAMPLES = 0, 0x1000, 0x100
PRIVATE_TYPE, PRIVATE_STREAM = 0x06, 0xBD
#: Streams whose elementary packets have no optional header (fixed values of ISO/IEC 13818-1).
_BARE = np.isin(np.arange(256), [0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF])
#: Bytes of output gathered before a batch is handed to Spark.
BATCH_BYTES = 4 << 20


@lru_cache(1)
def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


@lru_cache(256)
def crc(section: bytes) -> int:
    """CRC-32 of program tables; zero over a section with its own."""
    c, table = 0xFFFFFFFF, _crc_table()
    for byte in section:
        c = (c << 8 & 0xFFFFFFFF) ^ table[c >> 24 ^ byte]
    return c


def _section(kind: int, number: int, body: bytes) -> bytes:
    head = bytes([kind]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0" + body
    return head + crc(head).to_bytes(4, "big")


@lru_cache(1)
def _tables() -> np.ndarray:
    """The two table packets, continuity counters left at zero."""
    programs = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PROGRAM).to_bytes(2, "big"))
    streams = _section(2, 1, (0xE000 | SAMPLES).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_TYPE]) + (0xE000 | SAMPLES).to_bytes(2, "big") + b"\xf0\0")
    rows = [bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + s for pid, s in ((TABLES, programs), (PROGRAM, streams))]
    return np.frombuffer(b"".join(r.ljust(PACKET, b"\xff") for r in rows), np.uint8).reshape(2, PACKET)


def _times(prefix: int, ticks: np.ndarray) -> np.ndarray:
    """33-bit times in five bytes with marker bits."""
    t = ticks % WRAP
    return np.stack([prefix << 4 | t >> 29 & 14 | 1, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1], -1).astype(np.uint8)


def _units(samples: np.ndarray, first: int, counter: int) -> np.ndarray:
    """Packets (unit, packet, byte) of equally long units; ``first``: number of the first, ``counter``: packets before."""
    count, size = samples.shape
    number = np.arange(first, first + count)
    at = (number + 1) * (UNIT * TICKS // RATE)
    raw = np.empty((count, 14 + size), np.uint8)
    raw[:, :9] = np.frombuffer(bytes([0, 0, 1, PRIVATE_STREAM]) + (8 + size).to_bytes(2, "big") + b"\x84\x80\x05", np.uint8)
    raw[:, 9:14], raw[:, 14:] = _times(2, at), samples
    # the first packet holds the clock and up to 176 bytes, all but the last the full 184
    first_bytes = min(14 + size, 176)
    inner, rest = divmod(14 + size - first_bytes, 184)
    packets = 1 + inner + (rest > 0)
    out = np.empty((count, packets, PACKET), np.uint8)
    out[:, :, 0], out[:, :, 1], out[:, :, 2] = SYNC, SAMPLES >> 8, SAMPLES & 255
    out[:, :, 3] = 0x10 | (counter + np.arange(count * packets).reshape(count, -1)) % 16
    out[:, 0, 1] |= 0x40
    # the clock stands a unit before the presentation
    out[:, 0, 3] |= 0x20
    out[:, 0, 4], out[:, 0, 5] = 183 - first_bytes, np.where(number % GROUP == 0, 0x50, 0x10)
    base = (at - UNIT * TICKS // RATE) % WRAP
    out[:, 0, 6:12] = np.stack([base >> 25, base >> 17 & 255, base >> 9 & 255, base >> 1 & 255, (base & 1) << 7 | 0x7E, base * 0], -1)
    out[:, 0, 12 : PACKET - first_bytes] = 0xFF
    out[:, 0, PACKET - first_bytes :] = raw[:, :first_bytes]
    out[:, 1 : 1 + inner, 4:] = raw[:, first_bytes : first_bytes + 184 * inner].reshape(count, inner, 184)
    if rest:  # a field of stuffing fills the last packet
        out[:, -1, 3] |= 0x20
        out[:, -1, 4] = 183 - rest
        out[:, -1, 5 : PACKET - rest] = 0xFF
        if rest < 183:
            out[:, -1, 5] = 0
        out[:, -1, PACKET - rest :] = raw[:, 14 + size - rest :]
    return out


def mux(samples: bytes) -> bytes:
    """A transport stream of these bytes."""
    buf = np.frombuffer(samples, np.uint8)
    full = len(buf) // UNIT
    parts = [_units(buf[: full * UNIT].reshape(full, UNIT), 0, 0)] if full else []
    if full * UNIT < len(buf):
        parts.append(_units(buf[None, full * UNIT :], full, full * parts[0].shape[1] if full else 0))
    out, group = [], 0
    for part in parts:
        for piece in np.split(part, np.nonzero(part[:, 0, 5] & 0x40)[0]):
            if len(piece) and piece[0, 0, 5] & 0x40:
                out.append(_counted(group))
                group += 1
            out.append(piece.reshape(-1, PACKET))
    return b"".join(x.tobytes() for x in (out if group else [_counted(0)]))


def _counted(group: int) -> np.ndarray:
    rows = _tables().copy()
    rows[:, 3] |= group % 16
    return rows


class Units(NamedTuple):
    """Elementary packets in order: packet number, index of the first packet, its offset in the media, times, and so on."""

    pid: np.ndarray
    packet: np.ndarray
    offset: np.ndarray
    pts: np.ndarray
    dts: np.ndarray
    access: np.ndarray
    size: np.ndarray
    complete: np.ndarray


class Media(NamedTuple):
    packets: int
    lost_bytes: int
    bad_tables: int
    programs: list[tuple[int, int, int]]
    streams: list[tuple[int, int, int, int, int, int]]
    units: Units
    payload: bytes


#: A time that is not there.
_NONE = -1


def _packets(media: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Packets, their offsets, and bytes that belong to none."""
    buf = np.frombuffer(media, np.uint8)
    n = len(buf)
    if n and n % PACKET == 0 and (buf[::PACKET] == SYNC).all():
        return buf.reshape(-1, PACKET), np.arange(0, n, PACKET), 0
    is_sync = buf == SYNC
    step = max(SPACINGS, key=lambda s: int((is_sync[:-s] & is_sync[s:]).sum()) if n > s else 0)
    # a packet has another behind it, or is the last
    pair = is_sync.copy()
    pair[: max(n - step, 0)] &= is_sync[step:]
    at, starts, p = np.nonzero(pair)[0], [], 0
    while (k := np.searchsorted(at, p)) < len(at):
        p = int(at[k])
        row = is_sync[p::step]
        run = len(row) if row.all() else int(row.argmin())
        whole = min(run, (n - p - PACKET) // step + 1)
        starts.append(np.arange(p, p + whole * step, step))
        p += max(whole * step, 1)
    offsets = np.concatenate([np.zeros(0, np.int64), *starts])
    return buf[offsets[:, None] + np.arange(PACKET)], offsets, max(0, n - len(offsets) * step)


def _sections(rows: np.ndarray, start: np.ndarray, begin: np.ndarray) -> Iterator[bytes | None]:
    """Whole sections in packets of one number; None for each with a wrong CRC."""
    held = b""
    for row, first, at in zip(rows, start.tolist(), begin.tolist(), strict=True):
        data = row[at:].tobytes()
        if first:
            if not data:
                continue
            held = data[1 + data[0] :]
        elif held:
            held += data
        while len(held) >= 3 and held[0] != 0xFF:
            size = 3 + ((held[1] & 15) << 8 | held[2])
            if len(held) < size:
                break
            yield held[:size] if size >= 12 and crc(held[:size]) == 0 else None
            held = held[size:]
        else:
            held = held if held[:1] != b"\xff" else b""


def _entries(section: bytes) -> dict[int, tuple[int, int]]:
    """Streams of a program: number of their packets -> (type, place)."""
    at, out = 12 + ((section[10] & 15) << 8 | section[11]), {}
    while at + 5 <= len(section) - 4:
        out[(section[at + 1] & 31) << 8 | section[at + 2]] = (section[at], len(out))
        at += 5 + ((section[at + 3] & 15) << 8 | section[at + 4])
    return out


def _stream(pid: int, rows: np.ndarray, index: np.ndarray, offsets: np.ndarray, begin: np.ndarray, kind: int) -> tuple[tuple, Units, np.ndarray]:
    """Checks, units and bytes of the packets with payload of one number."""
    counter, start = rows[:, 3] & 15, (rows[:, 1] & 0x40) > 0
    field = ((rows[:, 3] & 0x20) > 0) & (rows[:, 4] > 0)
    access, jump = field & ((rows[:, 5] & 0x40) > 0), field & ((rows[:, 5] & 0x80) > 0)
    step = np.diff(counter.astype(int)) % 16
    keep = np.ones(len(rows), bool)
    for k in (np.nonzero(step == 0)[0] + 1).tolist():
        keep[k] = begin[k] != begin[k - 1] or rows[k, begin[k] :].tobytes() != rows[k - 1, begin[k] :].tobytes()
    repeated = int((~keep).sum())
    rows, index, offsets, begin, counter, start, access, jump = (v[keep] for v in (rows, index, offsets, begin, counter, start, access, jump))
    gap = np.concatenate(([False], (np.diff(counter.astype(int)) % 16 != 1) & ~jump[1:]))
    firsts = np.nonzero(start)[0]
    head = firsts[0] if len(firsts) else len(rows)
    raw = rows[head:][np.arange(PACKET) >= begin[head:, None]]
    ends = np.cumsum(PACKET - begin[head:])
    at = (ends - (PACKET - begin[head:]))[firsts - head]
    stop = np.concatenate((at[1:], [len(raw)])).astype(np.int64) if len(at) else at.astype(np.int64)
    padded = np.concatenate((raw, np.zeros(20, np.uint8)))
    byte = lambda k: padded[at + k].astype(np.int64)
    named = (byte(0) == 0) & (byte(1) == 0) & (byte(2) == 1) & (stop - at >= 6)
    bare = _BARE[byte(3)]
    length, flags = byte(4) << 8 | byte(5), np.where(bare, 0, byte(7))
    data = np.minimum(np.where(named, at + np.where(bare, 6, 9 + byte(8)), stop), stop)
    wanted = np.where(length > 0, at + 6 + length, stop)
    end = np.maximum(np.minimum(wanted, stop), data)
    time = lambda k: (byte(k) >> 1 & 7) << 30 | byte(k + 1) << 22 | byte(k + 2) >> 1 << 15 | byte(k + 3) << 7 | byte(k + 4) >> 1
    pts = np.where(named & (flags & 0x80 > 0) & (data - at >= 14), time(9), _NONE)
    dts = np.where(named & (flags & 0xC0 == 0xC0) & (data - at >= 19), time(14), pts)
    # a gap hurts the unit before it, unless a new one begins there and the old one has all its bytes
    owner = np.cumsum(start)[head:] - 1
    hurt = np.zeros(len(at), bool)
    hurt[owner[gap[head:] & ~start[head:]]] = True
    complete = named & (wanted <= stop) & ~hurt
    edges = np.zeros(len(raw) + 1, np.int8)
    np.add.at(edges, data, 1)
    np.add.at(edges, end, -1)
    units = Units(np.full(len(at), pid), index[firsts], offsets[firsts], pts, dts, access[firsts], end - data, complete)
    told = (pid, kind, int(keep.sum()) + repeated, int(gap.sum()), repeated, len(at))
    return told, units, raw[np.cumsum(edges[:-1]) > 0]


def demux(media: bytes) -> Media:
    """What a transport stream holds."""
    rows, offsets, lost = _packets(media)
    pid = (rows[:, 1].astype(np.int64) & 31) << 8 | rows[:, 2]
    begin = 4 + np.where(rows[:, 3] & 0x20, 1 + rows[:, 4].astype(np.int64), 0)
    usable = ((rows[:, 3] & 0x10) > 0) & ((rows[:, 1] & 0x80) == 0) & ((rows[:, 3] & 0xC0) == 0) & (begin < PACKET)
    index = np.arange(len(rows))
    bad = 0

    def sections(number: int, kind: int) -> list[bytes]:
        nonlocal bad
        own = usable & (pid == number)
        found, seen = [], list(_sections(rows[own], (rows[own, 1] & 0x40) > 0, begin[own]))
        for s in seen:
            bad += s is None
            if s is not None and s[0] == kind and s[5] & 1:  # in force now
                found.append(s)
        return found

    programs: dict[int, int] = {}
    for s in dict.fromkeys(sections(TABLES, 0)):
        programs |= {s[k] << 8 | s[k + 1]: (s[k + 2] & 31) << 8 | s[k + 3] for k in range(8, len(s) - 7, 4) if s[k] or s[k + 1]}
    named, kinds = [], {}
    for number, place in sorted(programs.items()):
        tables = [s for s in sections(place, 2) if s[3] << 8 | s[4] == number]
        clock = (tables[-1][8] & 31) << 8 | tables[-1][9] if tables else _NONE
        named.append((number, place, clock))
        for s in dict.fromkeys(tables):
            kinds |= {k: kind for k, (kind, _) in _entries(s).items()}
    streams, units, payload = [], [], []
    for number, kind in sorted(kinds.items()):
        own = usable & (pid == number)
        told, found, data = _stream(number, rows[own], index[own], offsets[own], begin[own], kind)
        streams.append(told)
        units.append(found)
        payload.append(data.tobytes())
    none = Units(*(np.zeros(0, bool if n in ("access", "complete") else np.int64) for n in Units._fields))
    return Media(len(rows), lost, bad, named, streams, Units(*map(np.concatenate, zip(none, *units, strict=True))), b"".join(payload))


def store(rows: DataFrame, samples: str | Column, media_col: str = "media") -> DataFrame:
    """``rows`` with the bytes of ``samples`` (a binary column) as a transport stream in ``media_col``."""
    src = rows.withColumn(media_col, F.col(samples) if isinstance(samples, str) else samples)
    at = src.columns.index(media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, size = 0, [], 0
            for k, value in enumerate(batch.column(at)):
                held.append(None if (v := value.as_py()) is None else mux(v))
                size += len(held[-1] or b"")
                if size > BATCH_BYTES or k + 1 == batch.num_rows:
                    columns = batch.slice(start, len(held)).columns
                    columns[at] = pa.array(held, pa.binary())
                    yield pa.RecordBatch.from_arrays(columns, batch.schema.names)
                    start, held, size = k + 1, [], 0

    return map_arrow(src, run, [(f.name, f.dataType.simpleString()) for f in src.schema])


_PROGRAMS = "array<struct<number: int, tables: int, clock: int>>"
_STREAMS = "array<struct<pid: int, kind: int, packets: bigint, errors: bigint, repeated: bigint, units: bigint>>"
_POINTS = "array<struct<pid: int, unit: bigint, packet: bigint, offset: bigint, pts: bigint>>"
_TIMES = "array<bigint>"
#: Columns of :func:`parse`.
PARSED = {"packets": "bigint", "lost_bytes": "bigint", "bad_tables": "bigint", "programs": _PROGRAMS, "streams": _STREAMS, "times": _TIMES, "points": _POINTS, "incomplete": "bigint", "payload": "binary"}
_ARROW = {
    "packets": pa.int64(), "lost_bytes": pa.int64(), "bad_tables": pa.int64(), "incomplete": pa.int64(), "payload": pa.binary(), "times": pa.list_(pa.int64()),
    "programs": pa.list_(pa.struct([(n, pa.int32()) for n in ("number", "tables", "clock")])),
    "streams": pa.list_(pa.struct([("pid", pa.int32()), ("kind", pa.int32()), *((n, pa.int64()) for n in ("packets", "errors", "repeated", "units"))])),
    "points": pa.list_(pa.struct([("pid", pa.int32()), *((n, pa.int64()) for n in ("unit", "packet", "offset", "pts"))])),
}


def _time(ticks: int) -> int | None:
    return None if ticks == _NONE else ticks


def _row(media: bytes | None, names: list[str]) -> dict:
    if media is None:
        return dict.fromkeys(names)
    m = demux(media)
    u, name = m.units, lambda kind: [f.name for f in _ARROW[kind].value_type]
    points = [(int(u.pid[k]), k, int(u.packet[k]), int(u.offset[k]), _time(int(u.pts[k]))) for k in np.nonzero(u.access)[0].tolist()]
    row = {"packets": m.packets, "lost_bytes": m.lost_bytes, "bad_tables": m.bad_tables, "incomplete": int((~u.complete).sum()), "payload": m.payload, "times": [_time(t) for t in u.pts.tolist()]}
    for kind, values in (("programs", m.programs), ("streams", m.streams), ("points", points)):
        row[kind] = [dict(zip(name(kind), v, strict=True)) for v in values]
    return {n: row[n] for n in names}


def parse(rows: DataFrame, media_col: str = "media", *, keep: list[str] | None = None, outputs: tuple[str, ...] = tuple(PARSED)) -> DataFrame:
    """``keep`` (all other columns unless given) and the asked-for columns of PARSED; these replace columns of their names.

    ``times``: presentation time of every unit; ``points``: random-access points; ``payload``: bytes of all units.
    """
    names = list(outputs)
    others = [c for c in (rows.columns if keep is None else keep) if c != media_col and c not in names]
    src = rows.select(*map(quoted, others), media_col)
    types = [(f.name, f.dataType.simpleString()) for f in src.schema][: len(others)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, size = 0, [], 0
            for k, value in enumerate(batch.column(len(others))):
                held.append(_row(value.as_py(), names))
                size += len(value.as_py() or b"")
                if size > BATCH_BYTES or k + 1 == batch.num_rows:
                    kept = batch.slice(start, len(held)).columns[: len(others)]
                    yield pa.RecordBatch.from_arrays([*kept, *(pa.array([r[n] for r in held], _ARROW[n]) for n in names)], [f"c{k}" for k in range(len(others) + len(names))])
                    start, held, size = k + 1, [], 0

    return map_arrow(src, run, [*types, *((n, PARSED[n]) for n in names)])


def access_units(rows: DataFrame, media_col: str = "media", *, id_col: str) -> DataFrame:
    """One row for each elementary packet: id, pid, its number, first packet and offset, times, whether a reader may begin here, and data."""
    src = rows.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).filter("media is not null")
    kind = src.schema["id"].dataType.simpleString()
    fields = {"pid": pa.int32(), "unit": pa.int64(), "packet": pa.int64(), "offset": pa.int64(), "pts": pa.int64(), "dts": pa.int64(), "random_access": pa.bool_(), "complete": pa.bool_(), "data": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, value in enumerate(batch.column(1)):
                m = demux(value.as_py())
                u, ends = m.units, np.cumsum(m.units.size)
                for start in range(0, len(ends), 256):
                    cut = slice(start, start + 256)
                    some = Units(*(v[cut] for v in u))
                    data = [m.payload[e - s : e] for s, e in zip(some.size.tolist(), ends[cut].tolist(), strict=True)]
                    times = [pa.array([_time(t) for t in v.tolist()], pa.int64()) for v in (some.pts, some.dts)]
                    columns = [some.pid.astype(np.int32), np.arange(start, start + len(data)), some.packet, some.offset, *times, some.access, some.complete, data]
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column(0).slice(k, 1)] * len(data)), *(pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True))], ["id", *fields])

    schema = "pid int, unit bigint, packet bigint, offset bigint, pts bigint, dts bigint, random_access boolean, complete boolean, data binary"
    return src.mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def point_before(points: str | Column, seconds: float | Column) -> Column:
    """The last of :func:`parse`'s ``points`` that is presented at or before this time; null if none is."""
    ticks = (seconds if isinstance(seconds, Column) else F.lit(seconds)) * TICKS
    return F.try_element_at(F.filter(points, lambda p: p["pts"] <= ticks), F.lit(-1))


def samples_of(text: str | Column) -> Column:
    """The UTF-8 bytes of a text (null: none), with bytes 255 after them up to whole frames, one at least."""
    raw = F.coalesce((F.col(text) if isinstance(text, str) else text).cast("binary"), F.lit(b""))
    n = F.octet_length(raw)
    frames = F.greatest(F.ceil(n / FRAME), F.lit(1))
    return F.concat(raw, F.unhex(F.repeat(F.lit("FF"), (frames * FRAME - n).cast("int"))))


def feature() -> Column:
    """Of :func:`parse`'s columns: streams, errors, units, length and random-access points in words."""
    count = lambda c: F.coalesce(F.aggregate(F.col("streams"), F.lit(0).cast("bigint"), lambda a, s: a + s[c]), F.lit(0)).cast("string")
    kinds = F.array_join(F.transform("streams", lambda s: F.concat_ws(":", s["pid"].cast("string"), s["kind"].cast("string"))), ",")
    ends = F.concat_ws("..", F.try_element_at("times", F.lit(1)).cast("string"), F.try_element_at("times", F.lit(-1)).cast("string"))
    return F.concat_ws(" ", F.concat(F.lit("streams="), kinds), F.concat(F.lit("packets="), F.col("packets").cast("string")), F.concat(F.lit("units="), count("units")), F.concat(F.lit("errors="), count("errors")), F.concat(F.lit("pts="), ends), F.concat(F.lit("points="), F.size("points").cast("string")))
