"""Exact removal of repeated byte strings by bucket-pointer refinement.

A window of LENGTH bytes is found again through the leftmost of its q-grams with
the smallest hash, so equal windows have the same q-gram at the same place.
Neighbouring windows with one such place are a run.

* Initial buckets: a chunk of texts tells each distinct q-gram of its runs once, by 40 bits
  of its hash, and hears whether several documents may hold it. Runs of the others are
  final. Equal bits only let a run through; they decide nothing.
* Refinement: the runs that are left send their bytes, once for each different content of a chunk.
  Their bucket pointers start as ranks of the q-grams, and a bucket is refined by sorting on the
  identifiers (8-byte grams) at later offsets and, mirrored, at earlier ones; each refinement's
  pointers replace the former and are the first key of the next. Read byte by byte off the sorted
  order, pointers of all lengths to the right and to the left are at hand, and a window's bucket is the
  pair of both that make up LENGTH. Windows are equal only if all their bytes are.

Texts are packed once into chunks, a table bucketed by chunk, so no round moves
text. What a chunk sends grows with its own text alone, whatever the number of
chunks and groups: keys, or bytes with the document's id. A key that a third of all
documents hold costs a group one entry a chunk.

Defined results: null and short texts lose nothing; very long texts are read in
overlapping segments; a null id neither removes nor is compared; rows that repeat
an id do not remove from each other, so of equal strings those of the smallest id
stay, ties included; an empty table gives an empty table; other columns are ignored.
Ids are whole numbers of up to 64 bits; map others to such first.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import leave_nothing, shared_dir, stage
from .tokens import mix

LENGTH, GRAM = 50, 24
#: Bytes of a run before and after its q-gram at most; windows of a run at most.
_SIDE = LENGTH - GRAM
_SPAN = _SIDE + 1
#: Text bytes of a chunk, text bytes of a bucket of the table, bytes hashed at once, and keys and runs in a reducer's group on average.
CHUNK_BYTES, TASK_BYTES, SEGMENT, GROUP_KEYS, GROUP_RUNS = 4 << 20, 16 << 20, 1 << 19, 1_500_000, 250_000
#: Text bytes to a run.
_RUN_BYTES = 14
#: A run as it is sent: bytes before, q-gram, bytes after, and how many before and after are the run's.
_WIDTH = 2 * _SIDE + GRAM + 2
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_PACKED = "chunk bigint, ids binary, sizes binary, text binary"
_SENT = "chunk bigint, part int, n int, keys binary, docs binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

    def chunk() -> pa.RecordBatch:
        held.sort()
        ids, sizes = np.array([i for i, _ in held], np.int64), np.array([len(t) for _, t in held], np.int64)
        return pa.RecordBatch.from_arrays([pa.array([(task << 32) + made], pa.int64()), pa.array([ids.tobytes()]), pa.array([sizes.tobytes()]), pa.array([b"".join(t for _, t in held)], pa.binary())], ["chunk", "ids", "sizes", "text"])

    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            held.append((i.as_py(), t.as_py() or b""))
            size += len(held[-1][1])
            if size >= CHUNK_BYTES:
                yield chunk()
                made, held, size = made + 1, [], 0
    if held:
        yield chunk()


def _grams(b: np.ndarray) -> np.ndarray:
    """Identifiers of the q-grams that start at each byte."""
    word = np.ndarray((len(b) - 7,), "<u8", buffer=b, strides=(1,)).copy()
    h = word[:-16] * _C[0]
    h ^= h >> np.uint64(29)
    h += word[8:-8] * _C[1]
    h ^= h >> np.uint64(32)
    h *= _C[2]
    h += word[16:] * _C[3]
    h ^= h >> np.uint64(29)
    h *= _C[4]
    h ^= h >> np.uint64(32)
    return h


def _least(h: np.ndarray) -> np.ndarray:
    """The smallest of each _SPAN neighbours."""
    m, width = h, 1
    while 2 * width <= _SPAN:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[: width - _SPAN], m[_SPAN - width :]) if width < _SPAN else m


def minimizers(h: np.ndarray) -> np.ndarray:
    """For each window the leftmost place of the smallest hash, seen without its last six bits."""
    high, low = h & ~np.uint64(63), np.arange(len(h), dtype=np.uint64) & np.uint64(63)
    left = np.arange(len(h) - _SPAN + 1)
    # the place is told by its last bits; counted up and down they differ where several places tie
    place = [left + (((m & np.uint64(63)).astype(np.int64) ^ turn) - left & 63) for turn, m in ((0, _least(high | low)), (63, _least(high | low ^ np.uint64(63))))]
    tied = np.nonzero(place[0] != place[1])[0]
    if len(tied):
        value, first = high[place[0][tied]], np.full(len(tied), -1)
        for k in range(_SPAN):
            open_ = np.nonzero((first < 0) & (high[np.minimum(tied + k, len(h) - 1)] == value))[0]
            first[open_] = tied[open_] + k
        place[0][tied] = first
    return place[0]


class Chunk:
    """The runs of a chunk: q-gram's hash, its place, first and last window, row of the document."""

    def __init__(self, ids: bytes, sizes: bytes, text: bytes):
        self.ids, self.sizes, self.text = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64), np.frombuffer(text, np.uint8)
        self.ends = np.cumsum(self.sizes)
        parts, lo = [], 0
        starts = self.ends - self.sizes
        while lo < len(self.sizes):
            hi = max(lo + 1, int(np.searchsorted(self.ends, starts[lo] + SEGMENT, side="right")))
            if hi == lo + 1:  # perhaps a long text: overlapping segments
                for at in range(int(starts[lo]), int(self.ends[lo]), SEGMENT):
                    parts.append(self._runs(at, min(int(self.ends[lo]), at + SEGMENT + LENGTH - 1)))
            else:
                parts.append(self._runs(int(starts[lo]), int(self.ends[hi - 1])))
            lo = hi
        parts = [p for p in parts if p is not None]
        empty = [np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * 3
        self.gram, self.place, self.first, self.last = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else empty
        self.doc = self.ids[np.searchsorted(self.ends, self.first, side="right")] if len(self.first) else np.zeros(0, np.int64)

    def _runs(self, lo: int, hi: int):
        if hi - lo < LENGTH:
            return None
        h = _grams(self.text[lo:hi])
        left = np.arange(lo, hi - LENGTH + 1)
        at = np.nonzero(self.ends[np.searchsorted(self.ends, left, side="right")] - left >= LENGTH)[0] if len(self.ends) > 1 else np.arange(len(left))
        if not len(at):
            return None
        place = minimizers(h)[at]
        cut = np.nonzero((at[1:] != at[:-1] + 1) | (place[1:] != place[:-1]))[0] + 1
        first, last = at[np.concatenate(([0], cut))], at[np.concatenate((cut - 1, [len(at) - 1]))]
        place = place[np.concatenate(([0], cut))]
        return h[place], place + lo, first + lo, last + lo

    def contents(self, runs: np.ndarray) -> np.ndarray:
        """The bytes of these runs, _WIDTH each."""
        place, before, after = self.place[runs], self.place[runs] - self.first[runs], self.last[runs] + _SIDE - self.place[runs]
        out = np.zeros((len(runs), _WIDTH), np.uint8)
        spread = np.arange(-_SIDE, GRAM + _SIDE)
        for k in range(0, len(runs), 1 << 16):
            some = slice(k, k + (1 << 16))
            at = place[some, None] + spread
            mine = (spread >= -before[some, None]) & (spread < GRAM + after[some, None])
            out[some, :-2] = np.where(mine, self.text[np.clip(at, 0, len(self.text) - 1)], 0)
        out[:, -2], out[:, -1] = before, after
        return out


def rank(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, ties as they were, and the rank of each element, equal for equal keys."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return order, out


def _firsts(order: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Place in ``order`` where each rank begins."""
    return np.nonzero(np.diff(ranks[order], prepend=-1))[0]


def _five(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unfive(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _squeezed(b: bytes) -> bytes:
    packed = pa.compress(b, codec="zstd", asbytes=True) if len(b) > 512 else b
    return packed if len(packed) < len(b) else b


def _full(b: bytes, size: int) -> bytes:
    return b if len(b) == size else pa.decompress(b, size, codec="zstd", asbytes=True)


class Deal:
    """Keys of a chunk dealt to parts by their hash; every round finds the same order again."""

    def __init__(self, key: np.ndarray, parts: int):
        part = ((key >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
        self.order = np.argsort(part, kind="stable")
        self.cuts = np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts))))

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        for p in np.nonzero(np.diff(self.cuts))[0].tolist():
            yield p, self.order[self.cuts[p] : self.cuts[p + 1]]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["chunk", "part", "n", "keys", "docs"])


class Grams:
    """The distinct q-grams of a chunk's runs."""

    def __init__(self, c: Chunk, parts: int):
        order, self.member = rank(c.gram)
        at = _firsts(order, self.member)
        # ties keep the order of documents: the first and last of a q-gram tell whether several hold it
        first, last = order[at], order[np.concatenate((at[1:], [len(order)])) - 1] if len(order) else order
        self.key, self.several = c.gram[first], c.doc[first] != c.doc[last]
        self.deal = Deal(self.key, parts)

    def send(self, chunk: int) -> pa.RecordBatch:
        return _batch([(chunk, p, len(at), _five(self.key[at]), np.packbits(self.several[at]).tobytes()) for p, at in self.deal.parts()])

    def shared(self, answers: dict[int, bytes]) -> np.ndarray:
        """The runs whose q-gram several documents may hold."""
        bits = np.zeros(len(self.key), bool)
        for p, at in self.deal.parts():
            bits[at] = np.unpackbits(np.frombuffer(answers[p], np.uint8), count=len(at)).astype(bool)
        return np.nonzero(bits[self.member])[0]


class Runs:
    """The different contents of a chunk's shared runs, each with its smallest document."""

    def __init__(self, c: Chunk, runs: np.ndarray, parts: int):
        self.chunk, self.runs, self.bytes = c, runs, c.contents(runs)
        words = np.zeros((len(runs), 80), np.uint8)
        words[:, :_WIDTH] = self.bytes
        digest = np.zeros(len(runs), np.uint64)
        for w in words.view("<u8").T:
            digest = mix(digest * _C[1] + w)
        order, member = rank(digest)
        first = order[_firsts(order, member)]
        # a content that only looks like the first of its digest stands for itself
        self.like = np.where((self.bytes == self.bytes[first[member]]).all(1), first[member], np.arange(len(runs)))
        self.own = np.nonzero(self.like == np.arange(len(runs)))[0]
        self.deal = Deal(c.gram[runs[self.own]], parts)

    def send(self, chunk: int) -> pa.RecordBatch:
        doc = self.chunk.doc[self.runs]
        parts = ((p, self.own[at]) for p, at in self.deal.parts())
        return _batch([(chunk, p, len(at), _squeezed(self.bytes[at].tobytes()), doc[at].tobytes()) for p, at in parts])

    def gone(self, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A run's place, and the bits of its windows to remove: bit k for the window from k bytes before."""
        masks, doc = np.zeros(len(self.runs), np.uint32), self.chunk.doc[self.runs]
        for p, at in self.deal.parts():
            masks[self.own[at]] = np.frombuffer(_full(answers[p], 4 * len(at)), np.uint32)
        masks = np.where(doc > doc[self.like], _windows(self.bytes), masks[self.like])
        return self.chunk.place[self.runs], masks


def _windows(contents: np.ndarray) -> np.ndarray:
    """Bits of all windows of a run: from ``_SIDE - after`` to ``before`` bytes before the q-gram."""
    before, after = contents[:, -2].astype(np.uint64), contents[:, -1].astype(np.uint64)
    one = np.uint64(1)
    return ((one << before + one) - (one << np.uint64(_SIDE) - after)).astype(np.uint32)


def _words(side: np.ndarray) -> list[np.ndarray]:
    """8-byte identifiers at offsets 0, 8, ... whose order is that of the bytes."""
    wide = np.zeros((len(side), -(-side.shape[1] // 8) * 8), np.uint8)
    wide[:, : side.shape[1]] = side
    return [w.astype(np.uint64) for w in wide.view(">u8").T]


def _pointers(bucket: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets refined by the identifiers at later offsets: the order, and for each place in it
    the number of bytes that the one before has in common, -1 at the start of a bucket."""
    pointer = bucket
    for word in _words(side):
        order, pointer = rank(pointer, word)
    differs = np.ones((len(side), side.shape[1] + 1), bool)
    differs[1:, :-1] = side[order[1:]] != side[order[:-1]]
    common = differs.argmax(1)
    common[_firsts(order, bucket)] = -1
    return order, common


def repeated(contents: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Bits of the windows of each run that a run of a smaller document has as well."""
    masks = np.zeros(len(doc), np.uint32)
    # initial buckets, and the runs in those of several documents
    bucket = np.zeros(len(doc), np.int64)
    for word in _words(contents[:, _SIDE : _SIDE + GRAM]):
        order, bucket = rank(bucket, word)
    at = _firsts(order, bucket)
    several = (np.minimum.reduceat(doc[order], at) != np.maximum.reduceat(doc[order], at))[bucket] if len(doc) else np.zeros(0, bool)
    live = np.nonzero(several)[0]
    if not len(live):
        return masks
    held = contents[live]
    sides = [_pointers(bucket[live], side) for side in (held[:, :_SIDE][:, ::-1], held[:, _SIDE + GRAM : -2])]

    def pointer(side: int, length: int) -> np.ndarray:
        order, common = sides[side]
        out = np.empty(len(live), np.int64)
        out[order] = np.cumsum(common < length)
        return out

    # equal runs are one, with their smallest document
    _, same = rank(pointer(0, _SIDE), pointer(1, _SIDE), held[:, -2].astype(np.int64) * _SPAN + held[:, -1])
    order = np.lexsort((doc[live], same))
    first = order[_firsts(order, same)]
    least, found = doc[live][first], np.zeros(len(first), np.uint32)
    before, after = held[first, -2], held[first, -1]
    for k in range(_SPAN):
        at = np.nonzero((before >= k) & (after >= _SIDE - k))[0]
        if len(at):
            order, window = rank(pointer(0, k)[first[at]] * len(live) + pointer(1, _SIDE - k)[first[at]])
            smallest = np.minimum.reduceat(least[at][order], _firsts(order, window))
            found[at] |= (least[at] > smallest[window]).astype(np.uint32) << np.uint32(k)
    masks[live] = np.where(doc[live] > least[same], _windows(held), found[same])
    return masks


def _answered(rows: pa.Table, bits: Iterator[bytes]) -> pa.Table:
    return pa.table({"chunk": rows.column("chunk"), "part": rows.column("part"), "bits": pa.array(list(bits), pa.binary())})


def _shared(rows: pa.Table) -> pa.Table:
    """For each q-gram that a chunk sent, whether another chunk sent it or several documents there hold it."""
    sent = rows.to_pylist()
    several = np.concatenate([np.unpackbits(np.frombuffer(r["docs"], np.uint8), count=r["n"]) for r in sent])
    order, member = rank(np.concatenate([_unfive(r["keys"]) for r in sent]))
    at = _firsts(order, member)
    held = ((np.diff(np.concatenate((at, [len(order)]))) > 1) | (np.maximum.reduceat(several[order], at) > 0))[member]
    stops = np.cumsum([r["n"] for r in sent])
    return _answered(rows, (np.packbits(held[e - r["n"] : e]).tobytes() for e, r in zip(stops.tolist(), sent, strict=True)))


def _refined(rows: pa.Table) -> pa.Table:
    """For each run that a chunk sent, the windows that an earlier document has."""
    sent = rows.to_pylist()
    contents = np.concatenate([np.frombuffer(_full(r["keys"], r["n"] * _WIDTH), np.uint8) for r in sent]).reshape(-1, _WIDTH)
    masks = repeated(contents, np.concatenate([np.frombuffer(r["docs"], np.int64) for r in sent]))
    stops = np.cumsum([r["n"] for r in sent])
    return _answered(rows, (_squeezed(masks[e - r["n"] : e].tobytes()) for e, r in zip(stops.tolist(), sent, strict=True)))


def _answers(row: dict, level: int) -> dict[int, bytes]:
    return {b["part"]: b["bits"] for b in row["bits"] or () if b["level"] == level}


def _rounds(step) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one chunk at a time
                row = batch.slice(k, 1).to_pylist()[0]
                yield step(row, Chunk(row["ids"], row["sizes"], row["text"]))

    return run


def _tell_grams(parts: int):
    return _rounds(lambda row, c: Grams(c, parts).send(row["chunk"]))


def _tell_runs(parts: int, run_parts: int):
    return _rounds(lambda row, c: Runs(c, Grams(c, parts).shared(_answers(row, 0)), run_parts).send(row["chunk"]))


def _finish(parts: int, run_parts: int):
    def step(row: dict, c: Chunk) -> pa.RecordBatch:
        place, masks = Runs(c, Grams(c, parts).shared(_answers(row, 0)), run_parts).gone(_answers(row, 1))
        starts = np.zeros(len(c.text) + LENGTH, np.int32)
        for k in range(_SPAN):
            starts[place[(masks >> np.uint32(k) & 1).astype(bool)] - k] = 1
        seen = np.cumsum(starts)
        seen[LENGTH:] -= seen[:-LENGTH].copy()
        return _output(c, seen[: len(c.text)] > 0)

    return _rounds(step)


def _output(c: Chunk, gone: np.ndarray) -> pa.RecordBatch:
    starts = c.ends - c.sizes
    edge = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
    lo, hi = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    inner = c.ends[:-1]  # a run that goes on in the next text is two
    inner = inner[(inner > 0) & (inner < len(gone))]
    both = np.unique(inner[gone[inner - 1] & gone[inner]]) if len(inner) else inner
    lo, hi = np.sort(np.concatenate((lo, both))), np.sort(np.concatenate((hi, both)))
    row = np.searchsorted(c.ends, lo, side="right")
    spans = pa.StructArray.from_arrays([pa.array(lo - starts[row]), pa.array(hi - starts[row])], ["start", "end"])
    offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(c.sizes))))).astype(np.int32)
    kept = [c.text[s:e][~gone[s:e]].tobytes() for s, e in zip(starts, c.ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c.ids), pa.array(c.sizes), pa.ListArray.from_arrays(pa.array(offsets), spans), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])


_OUT = "id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_bytes, spans, kept)`` of every row: the maximal removed byte
    runs, as offsets into the UTF-8 text, and the bytes that stay."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, run_parts = (int(max(4, total / _RUN_BYTES / n)) for n in (GROUP_KEYS, GROUP_RUNS))
    buckets = min(int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")), max(4, round(total / TASK_BYTES)))
    name = f"cw_chunks_{uuid.uuid4().hex}"
    where = f"{shared_dir(spark)}/clausewright/{name}"
    packed = src.filter("id is not null").mapInArrow(_pack, _PACKED).repartition(buckets, "chunk")  # a file a bucket
    packed.write.bucketBy(buckets, "chunk").option("compression", "zstd").option("path", where).saveAsTable(name)
    leave_nothing(spark, where)
    chunks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, and the frame knows them and their buckets

    def answered(sent: DataFrame, how, name: str, level: int) -> DataFrame:
        return stage(sent.groupBy("part").applyInArrow(how, "chunk bigint, part int, bits binary"), name).withColumn("level", F.lit(level))

    def with_bits(rows: DataFrame) -> DataFrame:
        by_chunk = rows.groupBy("chunk").agg(F.collect_list(F.struct("level", "part", "bits")).alias("bits"))
        return chunks.join(by_chunk.hint("shuffle_merge"), "chunk", "left")

    shared = answered(chunks.mapInArrow(_tell_grams(parts), _SENT), _shared, "suffix-grams", 0)
    refined = answered(with_bits(shared).mapInArrow(_tell_runs(parts, run_parts), _SENT), _refined, "suffix-runs", 1)
    done = with_bits(shared.unionByName(refined)).mapInArrow(_finish(parts, run_parts), _OUT)
    rest = src.filter("id is null").select("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("spans"), F.coalesce("text", F.lit(b"")).alias("kept"))
    return done.unionByName(rest).withColumnRenamed("id", id_col)
