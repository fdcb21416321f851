"""A stored vector index with exact search.

Vectors go to the nearest of a bounded number of centres, their cell, and in it to rings of about RING_ROWS vectors by their
distance from the centre. The folder holds ``centres``, ``vectors`` (a directory for each cell, sorted by ring) and
``rings`` (rows and least and greatest distance of each ring and batch). By the triangle inequality no vector of a ring is nearer to a
query than the query's distance from the centre lies outside the ring's, so a search reads the nearest rings first and
then only those that may still hold one of the k nearest: the result is exact, ties by id.

Batches are appended: ids that the index has are left out, the others go to the given centres and rings, whose bounds widen.
Null vectors, and those with null or non-finite components or another length, are kept in cell -1, where no search finds them. One index holds one collection (a tender, a code library).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from clausewright.functions.rules import similarity
from clausewright.operators.retrieve import nearest_in_block
from clausewright.sources.artefacts import exists
from clausewright.sources.staging import drop_stage, stage

#: Centres at most, vectors that they are fitted on at most (by hash of the id), rounds of the fit, vectors of a ring on average.
MOST_CELLS, SAMPLE, ROUNDS, RING_ROWS = 2048, 20_000, 6, 2048
#: Rings of a cell at most; those of larger cells hold more vectors, which searches deal to parts.
EDGES = 64
#: What rounding may add to a distance, as a share of it and of the vectors' sizes.
SLACK = 1e-9


class Report(NamedTuple):
    """How many of the index's rings and vectors a search read."""

    rings: int
    rings_read: int
    rows: int
    rows_read: int


def _usable(v: str, size: int | None = None):
    fine = F.col(v).isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    return fine if size is None else fine & (F.size(v) == size)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(centres)))
    for k in range(0, len(centres), 64):  # differences and not products, which lose digits
        out[:, k : k + 64] = np.sqrt(((x[:, None, :] - centres[None, k : k + 64]) ** 2).sum(2))
    return out


def fit_centres(x: np.ndarray, cells: int) -> np.ndarray:
    """Centres by rounds of nearest means, begun far apart from one another."""
    first = [0]
    near = np.sqrt(((x - x[0]) ** 2).sum(1))
    while len(first) < min(cells, len(x)) and near.max() > 0:
        first.append(int(near.argmax()))
        near = np.minimum(near, np.sqrt(((x - x[first[-1]]) ** 2).sum(1)))
    centres = x[first]
    for _ in range(ROUNDS):
        own = np.concatenate([_distances(x[k : k + 1024], centres).argmin(1) for k in range(0, len(x), 1024)])
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds ``cell`` and ``distance``; -1 and null for vectors that no search finds."""
    good = rows.filter(_usable("vector", centres.shape[1]))
    other = rows.filter(~_usable("vector", centres.shape[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                d = _distances(_matrix(part.column(1)), centres)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["id", "vector", "cell", "distance"])

    kind = rows.schema["id"].dataType.simpleString()
    found = good.mapInArrow(run, f"id {kind}, vector array<double>, cell int, distance double")
    return found.unionByName(other.select("id", "vector", F.lit(-1).alias("cell"), F.lit(None).cast("double").alias("distance")))


def _write(placed: DataFrame, path: str) -> None:
    """``placed``: a staged table with id, vector, cell, distance and ring."""
    spark = placed.sparkSession
    for part in ("vectors", "rings"):  # a table without rows is a folder as well
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    placed.repartition("cell", "ring").sortWithinPartitions("cell", "ring").write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")
    told = placed.groupBy("cell", "ring").agg(F.count("*").alias("rows"), F.min("distance").alias("low"), F.max("distance").alias("high"))
    told.write.mode("append").parquet(f"{path}/rings")


def _edges(placed: DataFrame) -> DataFrame:
    """``(cell, edges)``: greatest distances of all rings but the last of each cell, about equal in rows."""
    n = F.ceil(F.col("rows") / RING_ROWS).cast("int")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("rows"))
    # percentiles of the distances are enough: any edges are right, and rings of about equal size are quick
    spread = placed.groupBy("cell").agg(F.percentile_approx("distance", [k / EDGES for k in range(1, EDGES)], 10_000).alias("p"))
    pick = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.col("p")[F.least(F.greatest((k * EDGES / n).cast("int") - 1, F.lit(0)), F.lit(EDGES - 2))])
    return sizes.join(spread, "cell").select("cell", F.array_distinct(F.when(n > 1, pick).otherwise(F.array().cast("array<double>"))).alias("edges"))


def _ringed(placed: DataFrame, edges: DataFrame) -> DataFrame:
    ring = F.when(F.col("cell") < 0, 0).otherwise(F.size(F.filter(F.coalesce("edges", F.array().cast("array<double>")), lambda e: e < F.col("distance"))))
    return placed.join(F.broadcast(edges), "cell", "left").select("id", "vector", "cell", "distance", ring.cast("int").alias("ring"))  # at most MOST_CELLS rows of fewer than EDGES edges


def build(vectors: DataFrame, path: str, cells: int | None = None) -> None:
    """Write an index of ``(id, vector)`` to a folder that holds none; ``cells`` follows the root of the vectors' number unless given."""
    spark = vectors.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"))
    sizes = rows.filter(_usable("vector")).groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim, n = (sizes["dim"], sizes["count"]) if sizes else (0, 0)
    sample = rows.filter(_usable("vector", dim)).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow() if n else None
    x = _matrix(sample.column("vector").combine_chunks()) if n else np.zeros((0, 0))
    centres = fit_centres(x, min(MOST_CELLS, cells or int(np.ceil(np.sqrt(n))))) if n else np.zeros((0, 1))
    _save_centres(spark, centres, path)
    rows.select("id").limit(0).write.parquet(f"{path}/ids")  # the type alone
    if not n:
        placed = stage(rows.select("id", "vector", F.lit(-1).alias("cell"), F.lit(None).cast("double").alias("distance")), "index-placed")
    else:
        placed = stage(_placed(rows, centres), "index-placed")
    edges = stage(_edges(placed.filter("cell >= 0")), "index-edges")
    edges.write.parquet(f"{path}/edges")
    ringed = stage(_ringed(placed, edges), "index-ringed")
    _write(ringed, path)
    for done in (placed, edges, ringed):
        drop_stage(done)


def _save_centres(spark: SparkSession, centres: np.ndarray, path: str) -> None:
    rows = [(k, c.tolist()) for k, c in enumerate(centres)]
    spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").toArrow()
    return _matrix(rows.column("centre").combine_chunks()) if rows.num_rows else np.zeros((0, 1))


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(vectors, rings)``, which may have no rows yet."""
    kind = spark.read.parquet(f"{path}/ids").schema["id"].dataType.simpleString()
    rings = spark.read.schema("cell int, ring int, rows bigint, low double, high double").parquet(f"{path}/rings")
    return spark.read.schema(f"id {kind}, vector array<double>, distance double, ring int, cell int").parquet(f"{path}/vectors"), rings


def append(new: DataFrame, path: str) -> int:
    """Add the ``(id, vector)`` rows whose ids the index lacks (one row of a repeated id); their number."""
    spark = new.sparkSession
    stored = _stored(spark, path)[0].select("id")
    rows = new.select("id", F.col("vector").cast("array<double>").alias("vector")).join(stored, "id", "left_anti").dropDuplicates(["id"])
    placed = stage(_ringed(_placed(rows, _centres(spark, path)), spark.read.parquet(f"{path}/edges")), "index-append")
    if n := placed.count():
        _write(placed, path)
    drop_stage(placed)
    return n


#: Queries of a ring that meet its vectors in one task, on average.
QUERIES = 4096


def _cells_of(asked: DataFrame, centres: np.ndarray, cells: dict[int, tuple[int, float]], k: int) -> DataFrame:
    """``(query_id, q, most, cell, off)``: cells to look at and the query's distance from their centres: those nearest to it that hold k vectors
    or, where ``most`` is known, all that may hold a vector at that distance."""
    rows, high = (np.array([cells.get(c, (0, -np.inf))[i] for c in range(len(centres))], float) for i in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                q, most = _matrix(part.column(1)), part.column(2).to_numpy(zero_copy_only=False).astype(float)
                off = _distances(q, centres)
                order = np.argsort(np.where(rows > 0, off, np.inf), axis=1, kind="stable")
                before = np.cumsum(rows[order], 1) - rows[order]
                near = np.zeros(off.shape, bool)
                np.put_along_axis(near, order, (before < k) & (rows[order] > 0), 1)
                may = (rows > 0) & (off - high <= _reach(most, q, np)[:, None] + SLACK * (off + np.maximum(high, 0)))
                at, cell = np.nonzero(np.where(np.isnan(most)[:, None], near, may))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in part.columns), pa.array(cell.astype(np.int32)), pa.array(off[at, cell])], ["query_id", "q", "most", "cell", "off"])

    kind = asked.schema["query_id"].dataType.simpleString()
    return asked.mapInArrow(run, f"query_id {kind}, q array<double>, most double, cell int, off double")


def _reach(most: np.ndarray, q: np.ndarray, of) -> np.ndarray:
    """``most`` with what rounding may add."""
    return most * (1 + SLACK) + SLACK * (1 + of.sqrt((q * q).sum(1)))


def _nearest_of(pairs: DataFrame, rings: DataFrame, vectors: DataFrame, k: int, queries: DataFrame) -> DataFrame:
    """``(query_id, id, distance)``: the k nearest of each query in each of its rings ``(query_id, q, cell, ring)``."""
    ids = [("query_id", queries.schema["query_id"].dataType), ("id", vectors.schema["id"].dataType)]
    schema = pa.schema([(n, to_arrow_type(t)) for n, t in ids] + [("distance", pa.float64())])
    # a ring's queries and vectors are dealt to parts, and every two parts meet
    sizes = pairs.groupBy("cell", "ring").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("qs")).join(rings.select("cell", "ring", F.ceil(F.col("rows") / (2 * RING_ROWS)).cast("int").alias("vs")), ["cell", "ring"])
    sizes = stage(sizes, "index-sizes")
    cells = [r["cell"] for r in sizes.select("cell").distinct().collect()]  # at most MOST_CELLS
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = pairs.join(sizes, ["cell", "ring"]).withColumn("i", F.pmod(F.xxhash64("query_id"), "qs").cast("int")).withColumn("j", every("vs"))
    right = vectors.filter(F.col("cell").isin(cells)).join(sizes, ["cell", "ring"]).withColumn("j", F.pmod(F.xxhash64("id"), "vs").cast("int")).withColumn("i", every("qs"))
    keyed = lambda side, name, *kept: side.select(*(F.col(c).alias(f"{name}_{c}") for c in ("cell", "ring", "i", "j")), *kept).groupBy(*(f"{name}_{c}" for c in ("cell", "ring", "i", "j")))
    met = keyed(left, "q", "query_id", "q").cogroup(keyed(right, "v", "id", F.col("vector").alias("v")))
    return met.applyInArrow(nearest_in_block(k, schema), f"query_id {ids[0][1].simpleString()}, id {ids[1][1].simpleString()}, distance double")


def search(queries: DataFrame, path: str, k: int = 8) -> tuple[DataFrame, Report]:
    """``(query_id, id, score, rank)`` as :func:`retrieve.nearest` gives them for ``(query_id, vector)`` with different ids, and what was read."""
    spark = queries.sparkSession
    centres, (vectors, rings) = _centres(spark, path), _stored(spark, path)
    rings = rings.filter("cell >= 0").groupBy("cell", "ring").agg(F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"))
    rings = stage(rings, "index-rings")
    cells = {r["cell"]: (r["rows"], r["high"]) for r in rings.groupBy("cell").agg(F.sum("rows").alias("rows"), F.max("high").alias("high")).collect()}  # at most MOST_CELLS
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("q")).filter(_usable("q", centres.shape[1]))
    # the least distance that a vector of a ring can have
    least = F.greatest(F.lit(0.0), F.col("off") - F.col("high"), F.col("low") - F.col("off"))
    looked = lambda rows: _cells_of(rows, centres, cells, k).join(rings, "cell").withColumn("least", least)
    # first the nearest rings of the nearest cells, as many as hold k vectors
    order = Window.partitionBy("query_id").orderBy("least", "off", "cell", "ring")
    held = F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = stage(looked(asked.withColumn("most", F.lit(None).cast("double"))).withColumn("held", held).filter(F.col("held") < k).select("query_id", "q", "cell", "ring"), "index-first")
    near = stage(_nearest_of(first, rings, vectors, k, queries), "index-near")
    # then all others that may hold one as near as the k-th of these
    last = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.element_at(F.array_sort(F.collect_list("distance")), k)).otherwise(float("inf")).alias("most"))
    size = F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, c: a + c * c))
    reach = F.col("most") * (1 + SLACK) + SLACK * (1 + size + F.col("off") + F.col("high"))
    again = looked(asked.join(last, "query_id")).filter(F.col("least") <= reach).select("query_id", "q", "cell", "ring")
    rest = stage(again.join(first.select("query_id", "cell", "ring"), ["query_id", "cell", "ring"], "left_anti").select("query_id", "q", "cell", "ring"), "index-rest")
    found = near.unionByName(_nearest_of(rest, rings, vectors, k, queries)).withColumn("score", similarity(F.col("distance")))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    out = stage(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank"), "index-found")
    told = lambda rows: rows.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    total, read = told(rings), told(rings.join(first.unionByName(rest).select("cell", "ring").distinct(), ["cell", "ring"]))
    for done in (rings, first, near, rest):
        drop_stage(done)
    return out, Report(total[0], read[0], total[1], read[1])
