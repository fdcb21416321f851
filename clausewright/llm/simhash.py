"""SimHash near-duplicates with pigeonring candidate filtering.

A 64-bit fingerprint is a ring of four 16-bit segments. With at most two
differing bits, the strong pigeonring principle promises a start whose chains
of one, two and three consecutive segments differ in at most 0, 1 and 1 bits
(the proportional budgets 0.5, 1 and 1.5, rounded down). Such a start's segment
is equal and so is one of the next two, which gives six equi-join keys. Pairs
that meet there go on only if some start keeps all its chains within budget, and
the full Hamming distance is taken of what is left.

Distinct fingerprints are joined, never documents, so groups of copies meet
once. A key with more than HOT fingerprints is split without loss: of the 32 bits that
are left of it, two quarters of 8 bits are equal again, and of the 16 bits left
then two quarters of 4 bits, so a last key has at most 256 fingerprints.

Defined results: null and wordless texts have fingerprint zero and link
like any other; long texts are hashed whole, in blocks; repeated rows share a
fingerprint; a bit set in exactly half the hashes is 0; a null id keeps its
fingerprint and takes no part in links (its component is null); an empty table
gives an empty table; other columns are ignored by :func:`near_duplicates` and
kept by :func:`keep_one`.
Ids are whole numbers of up to 64 bits; map others to such first.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import marks
from .graph import components
from .stage import quoted, stage

SEED = 42
_SEGMENTS, _WIDTH = 4, 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Shingle hashes counted at once.
_BLOCK = 1 << 17


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased (A-Z) text, in order, repeats included."""
    import xxhash

    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    stop = len(found) - words + 1
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:stop].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive groups of hashes; a bit is set in over half of its group."""
    groups = len(counts)
    lanes, owner = hashes.view(np.uint8).reshape(-1, 8), np.repeat(np.arange(groups) << 8, counts)
    out = np.zeros((groups, 64), bool)
    for k in range(8):
        seen = np.bincount(owner + lanes[:, k], minlength=groups << 8).reshape(groups, 256) @ _BITS
        out[:, 8 * k : 8 * k + 8] = 2 * seen > counts[:, None]
    return np.packbits(out, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(id_col, fingerprint)`` of every row; the fingerprint is a signed 64-bit integer."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, held, size = [], [], 0
            for text in batch.column(1):
                held.append(shingle_hashes(text.as_py(), words))
                size += len(held[-1])
                if size > _BLOCK:
                    prints.append(majority(np.concatenate(held), np.array([len(h) for h in held])))
                    held, size = [], 0
            if held:
                prints.append(majority(np.concatenate(held), np.array([len(h) for h in held])))
            flat = np.concatenate(prints).view(np.int64) if prints else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flat)], ["id", "fingerprint"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, fingerprint bigint").withColumnRenamed("id", id_col)


def _segment(x: Column, k: int) -> Column:
    return F.shiftrightunsigned(x, _WIDTH * (k % _SEGMENTS)).bitwiseAND(F.lit(0xFFFF))


#: Links have at most this many differing bits; the join keys below rest on it.
MAX_BITS = 2
#: Bits that chains of 1, 2, ... consecutive segments may differ in.
BUDGETS = [MAX_BITS * length // _SEGMENTS for length in range(1, _SEGMENTS)]
#: Fingerprints of a key that are compared with each other as they are.
HOT = 2000


def chains_fit(x: Column) -> Column:
    """Whether some start of the ring keeps the chains from it within their budgets; x holds the differing bits."""
    differs = [F.bit_count(_segment(x, k)) for k in range(_SEGMENTS)]

    def fits(start: int) -> Column:
        held = differs[start] <= BUDGETS[0]
        for length in range(2, _SEGMENTS):
            held = held & (sum((differs[(start + j) % _SEGMENTS] for j in range(1, length)), differs[start]) <= BUDGETS[length - 1])
        return held

    return reduce(or_, (fits(start) for start in range(_SEGMENTS)))


def _two_quarters(value: Column, width: int, key: Column) -> Column:
    """Every choice of two of the four parts of ``value``, as ``key`` with these parts added, and the other two."""
    part = lambda k: F.shiftrightunsigned(value, width * k).bitwiseAND(F.lit((1 << width) - 1))
    both = lambda p, q: F.shiftleft(part(p), width).bitwiseOR(part(q))
    out = []
    for n, (p, q) in enumerate(combinations(range(4), 2)):
        r, s = sorted({0, 1, 2, 3} - {p, q})
        out.append(F.struct(F.concat(key, F.array(F.lit(n << 2 * width).bitwiseOR(both(p, q)))).alias("key"), both(r, s).alias("rest")))
    return F.array(*out)


def meetings(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """``(a, b)`` structs, ``a.fingerprint < b.fingerprint``, of rows with a common key; a pair may come several times.

    ``prints`` has one row a ``fingerprint``; other columns are carried along.
    """
    now = prints.select(F.struct(*prints.columns).alias("row"), F.col("fingerprint").alias("rest"), F.expr("cast(array() as array<bigint>)").alias("key"))
    out = None
    for width in (16, 8, 4):
        now = now.select("row", F.explode(_two_quarters(F.col("rest"), width, F.col("key"))).alias("k")).select("row", "k.key", "k.rest")
        shared = stage(now.groupBy("key").count().filter("count > 1"), "simhash-keys")
        few = shared if width == 4 else shared.filter(F.col("count") <= hot)
        held = now.join(few, "key").select("key", "row")
        pairs = held.select("key", F.col("row").alias("a")).join(held.select("key", F.col("row").alias("b")), "key").where("a.fingerprint < b.fingerprint").select("a", "b")
        out = pairs if out is None else out.unionByName(pairs)
        many = shared.filter(F.col("count") > hot).select("key")
        if width == 4 or many.isEmpty():
            break
        now = now.join(many, "key", "left_semi")
    return out


def links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """``(a, b)`` structs of the rows of ``prints`` whose fingerprints are within MAX_BITS, each pair once."""
    x = F.col("a.fingerprint").bitwiseXOR(F.col("b.fingerprint"))
    return meetings(prints, hot).filter(chains_fit(x)).filter(F.bit_count(x) <= MAX_BITS).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` for every row; component_id is the smallest id reachable."""
    prints = stage(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "simhash")
    classes = stage(prints.filter(F.col(id_col).isNotNull()).groupBy("fingerprint").agg(F.min(id_col).cast("bigint").alias("rep")), "simhash-classes")
    roots = components(links(classes).select("a.rep", F.col("b.rep").alias("other")))
    named = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fingerprint", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(named, "fingerprint", "left").select(id_col, "fingerprint", F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, all columns kept.

    Of several rows with that id the one with the smallest text stays; rows without an id stay.
    """
    return keep_smallest(docs, near_duplicates(docs, id_col=id_col, text_col=text_col, words=words), id_col=id_col, text_col=text_col)


def keep_smallest(docs: DataFrame, groups: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is its own ``component_id`` in ``groups``, as :func:`keep_one` has them."""
    ids, root, rows, row, text = (f"{n}_{uuid.uuid4().hex}" for n in ("id", "root", "rows", "row", "text"))
    told = groups.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(ids)).agg(F.min("component_id").alias(root), F.count("*").alias(rows))
    # ids to drop and ids with several rows; rows of all others stay where they are
    marked = stage(told.filter((F.col(root) != F.col(ids)) | (F.col(rows) > 1)), "simhash-marked")
    apart, maybe = marks.split(docs, marked.select(ids), [docs[id_col]])
    out = apart.unionByName(maybe.join(marked, maybe[id_col] == marked[ids], "left_anti"))
    several = marked.filter(F.col(root) == F.col(ids))
    if several.isEmpty():
        return out
    held = maybe.join(several, maybe[id_col] == several[ids]).select(F.col(ids), maybe[text_col].alias(text), F.struct(*map(quoted, docs.columns)).alias(row))
    return out.unionByName(held.groupBy(ids).agg(F.min_by(row, F.coalesce(text, F.lit(""))).alias(row)).select(f"{row}.*"))
