"""Rows of a large table by the keys of a smaller one, without dealing out the large table.

A bitmap of hashed keys, whose size follows their number up to a fixed bound, is
broadcast. Rows that miss it are surely without a mark and stay where they are; only
the others meet the keys in a join. Beyond the bound the bitmap fills up and lets
more rows through to the join, so results never depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import quoted

#: Bits for each key, and the most bits of a bitmap (32 MB).
BITS_A_KEY, MOST_BITS = 16, 1 << 28
_PAGE = 1 << 15


def split(rows: DataFrame, keys: DataFrame, on: list[Column]) -> tuple[DataFrame, DataFrame]:
    """``(apart, maybe)``: rows that surely match no key, and the rest.

    ``keys`` is a staged table whose columns are compared with ``on``, in this order; a
    row with a null in ``on`` is apart. Both results have the columns of ``rows``.
    """
    bits = min(MOST_BITS, max(_PAGE, 1 << (BITS_A_KEY * keys.count()).bit_length()))
    place = lambda cols: F.pmod(F.xxhash64(*cols), F.lit(bits))
    bit = place([F.col(c) for c in keys.columns])
    pages = keys.select((bit / _PAGE).cast("int").alias("__page"), (bit % _PAGE).alias("__bit")).groupBy("__page").agg(F.bitmap_construct_agg("__bit").alias("__map"))
    known = on[0].isNotNull()
    for c in on[1:]:
        known = known & c.isNotNull()
    asked = rows.select(F.struct(*map(quoted, rows.columns)).alias("__row"), F.when(known, place(on)).alias("__at"))
    held = asked.join(F.broadcast(pages), (F.col("__at") / _PAGE).cast("int") == F.col("__page"), "left")
    byte = F.conv(F.hex(F.substring("__map", ((F.col("__at") % _PAGE) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), F.col("__at") % 8)), F.lit(2)) == 1, F.lit(False))
    return held.filter(~hit).select("__row.*"), held.filter(hit).select("__row.*")
