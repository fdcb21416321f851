"""Positions in a global order, without one task that holds all rows.

Rows are sorted in range partitions; a row's position is its place in its partition plus the rows of all partitions before it.
Seeded samples are drawn over these positions, so they equal Python's for the same order and seed.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.sources.staging import stage

#: Rows up to which a sorted limit is asked for as such, and chosen positions up to which they are broadcast.
FEW = 10_000
#: Bits of the place within a partition in ``monotonically_increasing_id``.
_PLACE = 33


def with_ordinal(rows: DataFrame, *order: str | Column, name: str = "ordinal") -> DataFrame:
    """Adds the position from 1 in this order. Rows that tie have any order among themselves, the same for whoever reads the result."""
    placed = stage(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ordinal")
    part = F.shiftright("__at", _PLACE)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each partition
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows")).withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
    at = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << _PLACE) - 1)) + 1
    return placed.withColumn("__part", part).join(F.broadcast(sizes), "__part").withColumn(name, at).drop("__part", "__at", "__before")


def first_rows(rows: DataFrame, most: int, *order: str | Column) -> DataFrame:
    """The first ``most`` rows in this order, however many they are."""
    if most <= FEW:
        return rows.orderBy(*order).limit(most)
    return with_ordinal(rows, *order, name="__ordinal").filter(F.col("__ordinal") <= most).drop("__ordinal")


def chosen(n: int, size: int, seed: int) -> Sequence[int]:
    """What ``Random(seed).sample`` takes of n things, from 0 and in its order; all of them if there are no more."""
    return random.Random(seed).sample(range(n), min(n, size))


def sample(rows: DataFrame, size: int, seed: int, *order: str | Column) -> DataFrame:
    """The rows that ``Random(seed).sample`` takes of the list in this order, with their ``place`` in the sample from 1.
    Only the chosen positions, ``size`` of them, are with the driver."""
    numbered = stage(with_ordinal(rows, *order, name="__ordinal"), "sample")
    places = [(at + 1, k + 1) for k, at in enumerate(chosen(numbered.count(), size, seed))]
    picked = rows.sparkSession.createDataFrame(places, "__ordinal bigint, place bigint")
    return numbered.join(F.broadcast(picked) if size <= FEW else picked, "__ordinal").drop("__ordinal")
