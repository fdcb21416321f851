"""Near-duplicate vectors by int8 tile products with error bounds.

Equal vectors of a label are one class. Unit vectors u are held as s*q with q in int8
and residual norm e = |u - s*q|; classes are dealt to tiles by hash, and every pair of
tiles of a label is one bounded task, a cell, which gets codes, scales and norms alone.
The product of the int8 tiles is exact, and |u.v - s*t*(q.p)| <= |s*q|*f + e*|t*p| + e*f,
so a pair whose estimate plus bound stays under the threshold is certainly no link, and
one whose estimate less its bound reaches it certainly is. Vectors of a cell with a pair
in between come to that cell again in full, and these pairs are computed in double precision.

Defined results: a null label, a null, empty or zero vector and one with a null
or non-finite component link with nothing; vectors of different lengths never
link; vectors are scaled by their largest component first, so very large and very small
ones neither over- nor underflow; a cosine of exactly the threshold links; repeated rows
count as vectors of their own, and so do different vectors of one id, which has to be a whole number; an empty table gives an empty table; other columns are ignored.
A cell reports, for each vector, its links and one edge to the smallest vector it
reaches there, so a dense group never sends its pairs anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, star_forest
from .stage import stage

#: Vectors in a tile, on average.
TILE = 2048
#: Pairs recomputed at once.
_BLOCK = 1 << 16
#: Over the rounding of the estimate itself (32-bit products of integers are exact; scales and bounds are doubles).
_SLACK = 1e-9
#: Longest stretch of components whose int8 products sum exactly in 32-bit floats.
_EXACT = (1 << 24) // (127 * 127)


class Codes(NamedTuple):
    """int8 codes, scales, norms of the coded vectors and residual norms of unit rows."""

    q: np.ndarray
    scale: np.ndarray
    norm: np.ndarray
    rest: np.ndarray


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows with a largest component between 1/2 and 1, by a power of two, which is exact and no cosine depends on."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def quantise(x: np.ndarray) -> Codes:
    x = scaled(x)
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    coded = q * scale[:, None]
    return Codes(q, scale, np.sqrt((coded * coded).sum(1)), np.sqrt(((unit - coded) ** 2).sum(1)))


def estimated(x: Codes, y: Codes, least: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs that may reach ``least``, and whether they certainly do; with ``same``, x is y and i < j."""
    if not len(x.q) or not len(y.q):  # hashing may leave a tile empty
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    dot = np.zeros((len(x.q), len(y.q)), np.float32 if x.q.shape[1] <= _EXACT else np.float64)
    for k in range(0, x.q.shape[1], _EXACT):
        dot += x.q[:, k : k + _EXACT].astype(np.float32) @ y.q[:, k : k + _EXACT].astype(np.float32).T
    loose = x.norm * y.rest.max() + x.rest * (y.norm + y.rest).max() + _SLACK  # of each row against the whole tile
    floor = (least - loose) / x.scale
    maybe = dot * y.scale.astype(np.float32)[None, :] >= (floor * (1 - np.sign(floor) * 1e-6))[:, None]
    i, j = np.nonzero(maybe)
    if same:
        i, j = i[i < j], j[i < j]
    estimate = x.scale[i] * y.scale[j] * dot[i, j].astype(float)
    bound = x.norm[i] * y.rest[j] + x.rest[i] * y.norm[j] + x.rest[i] * y.rest[j] + _SLACK
    some = estimate + bound >= least
    return i[some], j[some], (estimate - bound >= least)[some]


def exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which of these pairs reach ``least`` in double precision."""
    x, y = scaled(x), scaled(y)
    a, b = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    out = [np.zeros(0, bool)]
    for k in range(0, len(i), _BLOCK):
        u, v = i[k : k + _BLOCK], j[k : k + _BLOCK]
        out.append(np.einsum("ij,ij->i", x[u], y[v]) / (a[u] * b[v]) >= least)
    return np.concatenate(out)


def near_pairs(x: np.ndarray, y: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine of at least ``least``; with ``same``, x is y and i < j."""
    if not len(x) or not len(y):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j, sure = estimated(quantise(x), quantise(y), least, same)
    sure[~sure] = exact(x, y, i[~sure], j[~sure], least)
    return i[sure], j[sure]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = pa.concat_arrays([c.flatten() for c in chunks]) if chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # vectors of one length at a time
        size = np.array([len(v) for v in batch.column(2)], np.int64)
        for dim in np.unique(size).tolist():
            at = pa.array(np.nonzero(size == dim)[0])
            c = quantise(_matrix(batch.column(2).take(at)))
            codes = pa.array([row.tobytes() for row in c.q], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(3).take(at), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.full(len(at), dim, np.int32)), codes, *(pa.array(v) for v in c[1:])], ["label", "rep", "size", "dim", "code", "scale", "norm", "rest"])


def _dealt(rows: pa.Table) -> tuple[pa.Table, int, bool]:
    """The cell's rows by tile, the number of the first tile's, and whether the cell is a tile with itself."""
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    tile = rows.column("tile").to_numpy()
    order = np.argsort(tile, kind="stable")
    cut = len(tile) if i == j else int(np.searchsorted(tile[order], j))
    return rows.take(pa.array(order)), cut, i == j


def _told(rows: pa.Table, u: np.ndarray, v: np.ndarray, unsure: np.ndarray) -> pa.Table:
    """Links of each vector of the cell, the smallest that it reaches by them, and whether pairs of it are open."""
    ids, size = rows.column("rep").to_numpy(), rows.column("size").to_numpy()
    links = np.bincount(u, size[v], len(ids)) + np.bincount(v, size[u], len(ids))
    root = ids.copy()
    node, low = star_forest(ids[u], ids[v])
    if len(node):
        at = np.argsort(ids)
        root[at[np.searchsorted(ids, node, sorter=at)]] = low
    open_ = np.zeros(len(ids), bool)
    open_[unsure] = True
    some = pa.array((links > 0) | open_)
    keep = [rows.column(c).filter(some) for c in ("label", "dim", "i", "j", "rep")]
    return pa.Table.from_arrays([*keep, pa.array(links.astype(np.int64)).filter(some), pa.array(root).filter(some), pa.array(open_).filter(some)], names=["label", "dim", "i", "j", "rep", "links", "root", "open"])


def _cell(least: float):
    def run(rows: pa.Table) -> pa.Table:
        rows, cut, same = _dealt(rows)
        q = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int8).reshape(rows.num_rows, -1)
        c = Codes(q, *(rows.column(n).to_numpy() for n in ("scale", "norm", "rest")))
        x, y = (Codes(*(part[:cut] for part in c)), Codes(*(part[cut:] for part in c))) if not same else (c, c)
        u, v, sure = estimated(x, y, least, same)
        v = v if same else v + cut
        return _told(rows, u[sure], v[sure], np.concatenate((u[~sure], v[~sure])))

    return run


def _open_cell(least: float):
    """The open pairs among the vectors of a cell that have any; their codes and so their bounds are as before."""

    def run(rows: pa.Table) -> pa.Table:
        rows, cut, same = _dealt(rows)
        full = _matrix(rows.column("v"))
        x, y = (full, full) if same else (full[:cut], full[cut:])
        u, v, sure = estimated(quantise(x), quantise(y), least, same) if len(x) and len(y) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        u, v = u[~sure], v[~sure]
        hit = exact(x, y, u, v, least)
        u, v = u[hit], v[hit] if same else v[hit] + cut
        return _told(rows, u, v, np.zeros(0, np.int64))

    return run


def near_duplicates(vectors: DataFrame, *, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(id, n_links, component_id, kept)`` of every vector; see the module for odd input."""
    src = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & F.col("id").isNotNull() & F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & F.exists("v", lambda c: c != 0)
    src = src.withColumn("ok", F.coalesce(usable, F.lit(False)))
    # an id may have several vectors, so classes have numbers of their own
    classes = src.filter("ok").groupBy("label", "v").agg(F.min("id").alias("low"), F.count("*").alias("size"))
    classes = stage(classes.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    label = src.schema["label"].dataType.simpleString()
    coded = classes.select("rep", "size", "v", "label").mapInArrow(_coded, f"label {label}, rep bigint, size bigint, dim int, code binary, scale double, norm double, rest double")
    tiles = classes.groupBy("label", F.size("v").alias("dim")).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    place = F.pmod(F.xxhash64("rep"), "tiles").cast("int")
    dealt = coded.join(tiles, ["label", "dim"]).withColumn("tile", place)
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least(F.col("tile"), k).alias("i"), F.greatest(F.col("tile"), k).alias("j"))))
    cells = dealt.withColumn("c", cell).select("label", "dim", "rep", "size", "tile", "c.i", "c.j", "code", "scale", "norm", "rest")
    told = f"label {label}, dim int, i int, j int, rep bigint, links bigint, root bigint, open boolean"
    first = stage(cells.groupBy("label", "dim", "i", "j").applyInArrow(_cell(least), told), "vector-links")
    # vectors with open pairs come to their cells in full
    again = first.filter("open").select("label", "dim", "i", "j", "rep").join(classes.select("rep", "size", "v"), "rep").join(tiles, ["label", "dim"]).withColumn("tile", place)
    second = stage(again.select("label", "dim", "rep", "size", "tile", "i", "j", "v").groupBy("label", "dim", "i", "j").applyInArrow(_open_cell(least), told), "vector-open")
    found = first.unionByName(second).filter("links > 0").select("rep", "links", "root")
    roots = components(found.select("rep", "root"))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    placed = classes.join(linked, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("label", "v", "low", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    placed = stage(placed, "vector-placed")
    # classes that are alone need no look at others
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    named = placed.join(lows, "root", "left").select("label", "v", "n_links", F.coalesce("component_id", "low").alias("component_id"))
    good = src.filter("ok").join(named, ["label", "v"]).select("id", "n_links", "component_id")
    rest = src.filter("not ok").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
