import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausewright.llm import transport


def plain(media):
    """A packet at a time: programs, and for each stream its errors and units (time, random access, bytes)."""
    streams, state, pmt = {}, {}, None
    programs = []
    for at in range(0, len(media) - 187, 188):
        p = media[at : at + 188]
        pid = (p[1] & 31) << 8 | p[2]
        begin = 4 + (1 + p[4] if p[3] & 32 else 0)
        access = bool(p[3] & 32 and p[4] and p[5] & 64)
        data = p[begin:]
        if pid == 0:
            s = data[1:]
            pmt = (s[10] & 31) << 8 | s[11]
            programs = [(s[8] << 8 | s[9], pmt, 256)]
        elif pid == pmt:
            s = data[1:]
            streams.setdefault((s[13] & 31) << 8 | s[14], {"kind": s[12], "errors": 0, "repeated": 0, "units": []})
        elif pid in streams:
            own, (last, before) = streams[pid], state.get(pid, (None, None))
            if last == p[3] & 15 and before == data:
                own["repeated"] += 1
                continue
            own["errors"] += last is not None and (last + 1) % 16 != p[3] & 15
            state[pid] = (p[3] & 15, data)
            if p[1] & 64:
                t = data[9:14]
                pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1
                own["units"].append([pts, access, data[4] << 8 | data[5], data[14:]])
            elif own["units"]:
                own["units"][-1][3] += data
    return programs, streams


def checked(media):
    m = transport.demux(media)
    programs, streams = plain(media)
    assert m.programs == programs
    assert [(s[0], s[1], s[3], s[4], s[5]) for s in m.streams] == [(k, s["kind"], s["errors"], s["repeated"], len(s["units"])) for k, s in sorted(streams.items())]
    units = [u for _, s in sorted(streams.items()) for u in s["units"]]
    assert m.units.pts.tolist() == [u[0] for u in units] and m.units.access.tolist() == [u[1] for u in units]
    assert m.payload == b"".join(u[3][: u[2] - 8] for u in units)
    return m


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 60_000), st.integers(0, 99))
def test_round_trip(n, seed):
    data = random.Random(seed).randbytes(n)
    media = transport.mux(data)
    m = transport.demux(media)
    assert m.payload == data and media == transport.mux(data) and len(media) % 188 == 0
    assert not m.lost_bytes and not m.bad_tables and m.units.complete.all() and all(s[3] == 0 for s in m.streams)
    groups = -(-len(m.units.pts) // transport.GROUP)
    assert m.units.access.tolist() == [k % transport.GROUP == 0 for k in range(len(m.units.pts))]
    assert m.packets == sum(s[2] for s in m.streams) + 2 * max(1, groups)
    assert m.units.pts.tolist() == [(k + 1) * 8640 for k in range(len(m.units.pts))]
    if n:
        checked(media)


def test_lost_and_repeated_packets():
    rng = random.Random(3)
    data = rng.randbytes(100_000)
    packets = [transport.mux(data)[k:][:188] for k in range(0, len(transport.mux(data)), 188)]
    for trial in range(40):
        some = []
        for k, p in enumerate(packets):
            if k < 2 or rng.random() > 0.02:
                some += [p, p] if k > 2 and rng.random() < 0.02 else [p]
        m = checked(b"".join(some))
        assert trial < 0 or (m.units.complete.all() == (m.payload == data))


def test_incomplete_units_are_those_that_miss_bytes():
    data = random.Random(1).randbytes(5 * transport.UNIT)
    media = transport.mux(data)
    rows = np.frombuffer(media, np.uint8).reshape(-1, 188)
    lost = np.delete(rows, 2 + 26 + 5, 0)  # a packet within the second unit
    m = transport.demux(lost.tobytes())
    assert m.units.complete.tolist() == [True, False, True, True, True] and m.streams[0][3] == 1
    lost = np.delete(rows, 2 + 26 + 25, 0)  # its last packet
    assert transport.demux(lost.tobytes()).units.complete.tolist() == [True, False, True, True, True]
    lost = np.delete(rows, 2 + 26, 0)  # its first: the rest belongs to the unit before
    m = transport.demux(lost.tobytes())
    assert m.units.complete.tolist() == [False, True, True, True] and m.units.pts.tolist() == [8640, 25920, 34560, 43200]


def test_damaged_scrambled_and_foreign_bytes():
    data = random.Random(2).randbytes(3 * transport.UNIT)
    media = transport.mux(data)
    rows = np.frombuffer(media, np.uint8).reshape(-1, 188).copy()
    assert transport.demux(b"junk" * 9 + media).payload == data
    assert transport.demux(b"junk" * 9 + media).lost_bytes == 36
    spaced = b"".join(b"\0\1\2\3" + r.tobytes() for r in rows)
    m = transport.demux(spaced)
    assert m.payload == data and m.lost_bytes == 0 and m.packets == len(rows)
    assert transport.demux(b"".join(r.tobytes() + bytes(16) for r in rows)).payload == data
    cut = media[: 188 * 30 + 50]
    assert transport.demux(cut).packets == 30 and transport.demux(cut).lost_bytes == 50
    rows[5, 3] |= 0x80  # scrambled
    rows[40, 1] |= 0x80  # marked as damaged
    m = transport.demux(rows.tobytes())
    assert m.streams[0][3] == 2 and m.units.complete.tolist() == [False, False, True]
    wrong = rows.copy()
    wrong[0, 10] ^= 1
    m = transport.demux(wrong.tobytes())
    assert m.bad_tables == 1 and m.programs == [] and m.streams == [] and m.payload == b""
    for odd in (b"", b"G", b"no stream at all", b"G" * 1000, bytes(1000)):
        assert transport.demux(odd).payload == b""


def test_crc_of_a_known_table():
    assert transport.crc(b"123456789") == 0x0376E6E7  # the published check value


def test_columns(spark, docs, odd):
    rows = docs(odd)
    media = transport.store(rows, transport.samples_of("text"), "media")
    out = transport.parse(media, outputs=("payload", "points", "streams", "times", "packets", "incomplete"))
    texts = sorted((str(i), (t or "").encode()) for i, t in odd)
    got = sorted((str(r["doc_id"]), bytes(r["payload"])) for r in out.collect())
    assert [(i, p.rstrip(b"\xff")) for i, p in got] == texts and all(len(p) % 576 == 0 and p for _, p in got)
    assert set(rows.columns) <= set(out.columns)  # extra columns, clashing ones too
    units = transport.access_units(media, id_col="doc_id").filter("doc_id = 7").orderBy("unit").collect()
    assert b"".join(u["data"] for u in units).rstrip(b"\xff") == dict(odd)[7].encode()
    assert [u["random_access"] for u in units] == [k % 8 == 0 for k in range(len(units))]
    seek = out.filter("doc_id = 7").select(transport.point_before("points", 1.5).alias("p"), transport.point_before("points", 0.0).alias("none")).first()
    assert seek["p"]["unit"] == 8 and seek["p"]["pts"] == 9 * 8640 and seek["none"] is None
    assert out.filter("doc_id = 7").first()["points"][1]["offset"] == units[8]["offset"]


def test_null_media(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b""))], "id int, `a.b` binary").withColumnRenamed("a.b", "media")
    rows = {r["id"]: r for r in transport.parse(df).collect()}
    assert rows[1]["payload"] is None and rows[1]["streams"] is None
    assert rows[2]["payload"] == b"" and rows[2]["streams"] == [] and rows[2]["packets"] == 0
    assert transport.access_units(df, id_col="id").collect() == []


def test_dotted_columns(spark):
    df = spark.createDataFrame([(1, "abc", 2)], "`doc.id` int, text string, `meta.x` int")
    out = transport.parse(transport.store(df, transport.samples_of("text")), outputs=("packets",))
    assert out.columns == ["doc.id", "text", "meta.x", "packets"] and out.first()["meta.x"] == 2


def test_query(spark, docs, odd, tmp_path):
    from clausewright.llm.queries import queries

    docs(odd).write.parquet(f"{tmp_path}/documents.parquet")
    by = {}
    for r in queries()["op11_transport"](spark, str(tmp_path)).collect():
        raw = [(t or "").encode() for i, t in odd if i == r["doc_id"]][0]
        payload = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        media = transport.mux(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
        assert r["feature"].startswith("streams=256:6 packets=") and "errors=0" in r["feature"]
        by.setdefault(raw, set()).add((r["feature"], r["media_sha256"]))
    assert all(len(v) == 1 for v in by.values())


@pytest.mark.parametrize("rows", [[]])
def test_empty_table(docs, rows):
    assert transport.parse(transport.store(docs(rows), transport.samples_of("text"))).collect() == []
    assert transport.access_units(docs(rows).withColumn("media", F.lit(None).cast("binary")), id_col="doc_id").collect() == []
