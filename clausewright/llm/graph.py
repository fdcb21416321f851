"""Connected components of a distributed edge list.

Every round first contracts the edges of each partition to a star forest
(bounded by the partition), then applies one large-star and one small-star step
across partitions. A round's edges are written to the shared folder, so a lost
executor costs one round at most. Only two emptiness tests reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import drop_stage, stage

_EDGE = "node bigint, root bigint"
#: A value with more rows than both LEAST_HOT and its table's rows over MOST_HOT is hot: at most MOST_HOT values are.
LEAST_HOT, MOST_HOT = 256, 100_000


def hot_values(staged: DataFrame, col: str) -> DataFrame:
    """``(col, salts)`` of the hot values of a staged table, at most MOST_HOT rows and so fit to be
    broadcast; dealt to ``salts`` keys each, no key is hot any more."""
    least = max(LEAST_HOT, staged.count() // MOST_HOT)
    return staged.groupBy(col).count().filter(F.col("count") > least).select(col, F.ceil(F.col("count") / least).cast("int").alias("salts"))


def star_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node that each reaches, without the roots themselves."""
    nodes, flat = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    away = label != np.arange(len(nodes))
    return nodes[away], nodes[label[away]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        node, root = star_forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def _stars(edges: DataFrame) -> DataFrame:
    # a centre may hold a third of all nodes: its rows are dealt to several keys
    hot = F.broadcast(hot_values(edges, "root").withColumnRenamed("root", "u"))
    both = edges.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(edges.select(F.col("root").alias("u"), F.col("node").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    dealt = both.filter("v > u").join(hot, "u", "left").withColumn("salt", F.pmod(F.xxhash64("v"), F.coalesce("salts", F.lit(1))))
    spread = least.join(hot, "u", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("salts", F.lit(1)).cast("bigint") - 1)))
    large = dealt.join(spread.drop("salts"), ["u", "salt"]).select(F.col("v").alias("a"), F.col("m").alias("b"))
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    up = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("node"), F.col("m").alias("root")), F.struct(F.col("a").alias("node"), F.col("m").alias("root")))).alias("e"))
    return up.select("e.*").filter("node <> root").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node that reaches a smaller one; root is the smallest.

    ``edges`` has two columns of 64-bit ids; self-loops, repeats and either
    direction are allowed. Nodes absent from the result are their own roots.
    """
    u, v = edges.columns
    edges = edges.select(F.greatest(u, v).alias("node"), F.least(u, v).alias("root")).filter("node <> root")
    now = stage(edges.mapInArrow(_contract, _EDGE), "components")
    while True:
        split = now.groupBy("node").count().filter("count > 1").isEmpty()
        if split and now.join(now.select(F.col("node").alias("root")), "root", "left_semi").isEmpty():
            return now
        after = stage(_stars(now).mapInArrow(_contract, _EDGE), "components")
        drop_stage(now)
        now = after
