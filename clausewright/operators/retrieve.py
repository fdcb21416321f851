"""Hybrid retrieval for all flags at once: vectors, shared terms, shared referents, fusion.

Every route gives ``(flag_id, clause_id, score, rank)``; the rank is what counts later.
Retrieval stays within a tender: where both inputs of a route have ``tender_id``, only
rows of equal tenders meet (null and empty ones are one tender).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from clausewright.functions.rules import distance, similarity
from clausewright.operators import terms

ROUTES = ("R1_dense", "R2_defined_term", "R3_referent")
#: Reciprocal ranks are 1 / (RRF_K + rank).
RRF_K = 60
#: Numbers in the vectors of one block of the dense search, on average.
BLOCK = 1 << 20
#: Distances that a task holds at once: a block's queries meet its vectors a slice at a time.
CELL = 1 << 21
#: Four roundings of a double.
EPSILON = 2.0**-50


def scope(df: DataFrame, *others: DataFrame) -> Column:
    """The tender that a row is searched in, one for all where an input has none."""
    return F.coalesce("tender_id", F.lit("")) if all("tender_id" in d.columns for d in (df, *others)) else F.lit("")


def query_text(text: Column, commitments: Column, separator: str = "\n") -> Column:
    """The clause and, on lines of their own, all open questions."""
    asked = F.flatten(F.transform(commitments, lambda c: F.coalesce(c["missing_info"], F.array().cast("array<string>"))))
    return F.concat(text, F.lit("\n"), F.array_join(asked, separator))


def _top(scored: DataFrame, k: int) -> DataFrame:
    """Ranks by score, ties by clause id; plans as a grouped limit before and after the shuffle."""
    order = Window.partitionBy("flag_id").orderBy(F.col("score").desc(), "clause_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest_in_block(k: int, schema: pa.Schema):
    """The k best of a block of vectors for each of a block of queries, ties by id."""

    def run(held: pa.Table, rows: pa.Table) -> pa.Table:
        if not held.num_rows or not rows.num_rows:  # hashing may leave a block empty
            return schema.empty_table()
        queries, b = _matrix(held.column("q")), _matrix(rows.column("v"))
        most = min(k, len(b))
        names = rows.column("id").to_pylist()
        place = np.empty(len(b), int)
        place[sorted(range(len(b)), key=lambda j: (names[j] is not None, names[j]))] = np.arange(len(b))
        long = (b * b).sum(1)[None, :]
        out_q, out_i, out_d = [], [], []
        step = max(1, CELL // len(b))
        for begin in range(0, len(queries), step):
            a = queries[begin : begin + step]
            square = (a * a).sum(1)[:, None] + long - 2 * a @ b.T
            # what rounding may add to the product, and to scores that tie
            off = EPSILON * (a.shape[1] + 16) * (1 + (a * a).sum(1)[:, None] + long)
            square = np.where(np.isnan(square), np.inf, square)
            bound = np.partition(square + off, most - 1, axis=1)[:, most - 1]
            for n in range(len(a)):
                near = np.nonzero(square[n] - off[n] <= bound[n])[0]
                d = np.sqrt(((b[near] - a[n]) ** 2).sum(1))
                best = np.lexsort((place[near], -1 / (1 + d)))[:most]
                out_q.append(np.full(len(best), begin + n))
                out_i.append(near[best])
                out_d.append(d[best])
        at_q, at_i, d = (np.concatenate(x) for x in (out_q, out_i, out_d))
        return pa.Table.from_arrays([held.column("query_id").take(pa.array(at_q)), rows.column("id").take(pa.array(at_i)), pa.array(d, pa.float64())], schema=schema)

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 8) -> DataFrame:
    """``(query_id, id, score, rank)``: the k nearest vectors, with similarity 1 / (1 + distance).

    ``queries``: (query_id, vector); ``vectors``: (id, vector); both with ``tender_id`` or neither. The
    vectors of either side in a tender are dealt to blocks of bounded size, every pair of blocks is a
    task's cell, which keeps its own k best per query, and the final ranking sees k rows a cell.
    """
    told = scope(queries, vectors), scope(vectors, queries)
    q = queries.select("query_id", F.col("vector").cast("array<double>").alias("q"), told[0].alias("scope"))
    v = vectors.select("id", F.col("vector").cast("array<double>").alias("v"), told[1].alias("scope"))
    blocks = lambda df, c, n: df.groupBy("scope").agg(F.greatest(F.ceil(F.sum(F.size(c)) / BLOCK), F.lit(1)).cast("int").alias(n))
    # a row for each tender, apart for either side as both meet again
    sizes = lambda: blocks(q, "q", "q_blocks").join(blocks(v, "v", "v_blocks"), "scope")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = q.join(sizes(), "scope").withColumn("q_block", F.pmod(F.xxhash64("query_id"), "q_blocks").cast("int")).withColumn("v_block", each("v_blocks"))
    rows = v.join(sizes(), "scope").withColumn("v_block", F.pmod(F.xxhash64("id"), "v_blocks").cast("int")).withColumn("q_block", each("q_blocks"))
    cell = ["scope", "q_block", "v_block"]
    ids = [f"{n} {d.schema[n].dataType.simpleString()}" for n, d in (("query_id", queries), ("id", vectors))]
    types = [to_arrow_type(d.schema[n].dataType) for n, d in (("query_id", queries), ("id", vectors))]
    schema = pa.schema([("query_id", types[0]), ("id", types[1]), ("distance", pa.float64())])
    met = held.groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInArrow(nearest_in_block(k, schema), f"{ids[0]}, {ids[1]}, distance double")
    near = met.withColumn("score", similarity(F.col("distance")))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def dense(flags: DataFrame, flag_vectors: DataFrame, clause_vectors: DataFrame, k: int = 8) -> DataFrame:
    """Route 1. A flag's own clause is taken out after the top k, so k - 1 may remain."""
    tender = ["tender_id"] if "tender_id" in flags.columns and "tender_id" in clause_vectors.columns else []
    asked = flag_vectors.select("flag_id", "vector").join(flags.select("flag_id", *tender), "flag_id")
    found = nearest(asked.select(F.col("flag_id").alias("query_id"), "vector", *tender), clause_vectors.select(F.col("clause_id").alias("id"), "vector", *tender), k)
    rows = found.select(F.col("query_id").alias("flag_id"), F.col("id").alias("clause_id"), "score", "rank").join(flags.select("flag_id", F.col("clause_id").alias("own")), "flag_id")
    order = Window.partitionBy("flag_id").orderBy("rank")
    return rows.filter("clause_id <> own").withColumn("rank", F.row_number().over(order)).select("flag_id", "clause_id", "score", "rank")


def terms_in_clauses(clauses: DataFrame, definitions: DataFrame) -> DataFrame:
    """``(clause_id, term)``: clauses that contain a defined term of their tender anywhere, whatever its case."""
    rows = clauses.select(F.col("clause_id").alias("key"), "text", scope(clauses, definitions).alias("scope"))
    words = definitions.select(F.col("canonical_form").alias("term"), scope(definitions, clauses).alias("scope"))
    return terms.contained(rows, words).select(F.col("key").alias("clause_id"), "term")


#: Profiles that a key may have before it is dealt to several.
HOT = 10_000


def _by_profile(flags: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Clauses of a flag's tender by the weight of the keys they share with the flag's clause, its own left out.

    ``items``: (clause_id, key, weight, scope), one row each. Clauses with the same keys and weights are one profile: they tie in
    every ranking, so its k + 1 smallest ids are all that can matter. Flags whose clauses have the same set of keys have the
    same ranking but for their own clauses, so each different set of a tender is ranked once. A set's k + 1 best clauses
    are of its k + 1 best profiles, by score and smallest id. A key that more than HOT profiles have is dealt out.
    """
    held = items.groupBy("scope", "clause_id").agg(F.array_sort(F.collect_list(F.struct("key", "weight"))).alias("profile"))
    place = Window.partitionBy("scope", "profile").orderBy("clause_id")
    members = held.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= k + 1)
    first = members.groupBy("scope", "profile").agg(F.min("clause_id").alias("first"), F.array_sort(F.collect_list("clause_id")).alias("members"))
    asked = flags.select("flag_id", F.col("clause_id").alias("own")).join(held.withColumnRenamed("clause_id", "own"), "own").select("flag_id", "own", "scope", F.transform("profile", lambda p: p["key"]).alias("keys"))
    sets = asked.groupBy("scope", "keys").agg(F.min("own").alias("set"))
    keys = first.select("scope", "first", F.explode("profile").alias("p")).select("scope", "first", "p.key", "p.weight")
    salts = keys.groupBy("scope", "key").agg(F.ceil(F.count("*") / HOT).cast("int").alias("salts")).filter("salts > 1")
    many = F.coalesce("salts", F.lit(1))
    left = sets.select("scope", "set", F.explode("keys").alias("key")).join(salts, ["scope", "key"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("salts")
    right = keys.join(salts, ["scope", "key"], "left").withColumn("salt", F.pmod(F.xxhash64("first"), many).cast("int")).drop("salts")
    scored = left.join(right, ["scope", "key", "salt"]).groupBy("scope", "set", "first").agg(F.sum("weight").cast("double").alias("score"))
    order = Window.partitionBy("scope", "set").orderBy(F.col("score").desc(), "first")
    near = scored.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).join(first.select("scope", "first", "members"), ["scope", "first"]).select("scope", "set", "score", F.explode("members").alias("clause_id"))
    best = Window.partitionBy("scope", "set").orderBy(F.col("score").desc(), "clause_id")
    ranked = near.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n")
    told = asked.join(sets, ["scope", "keys"]).select("flag_id", "own", "scope", "set")
    return _top(told.join(ranked, ["scope", "set"]).filter("clause_id <> own").select("flag_id", "clause_id", "score"), k)


def shared_terms(flags: DataFrame, clauses: DataFrame, definitions: DataFrame, k: int = 8) -> DataFrame:
    """Route 2: clauses by the number of distinct terms shared with the flag's clause."""
    found = terms_in_clauses(clauses, definitions).withColumnRenamed("term", "key").distinct()
    tenders = clauses.select("clause_id", scope(clauses, definitions).alias("scope")).distinct()
    return _by_profile(flags, found.join(tenders, "clause_id").withColumn("weight", F.lit(1)), k)


def shared_referents(flags: DataFrame, quantities: DataFrame, clauses: DataFrame, k: int = 8) -> DataFrame:
    """Route 3: clauses by their quantities on any referent of the flag's clause.
    A clause that is missing still takes its place in the ranking."""
    known = quantities.filter("referent <> 'UNCLASSIFIED' and referent <> ''").groupBy("clause_id", F.col("referent").alias("key"), scope(quantities).alias("scope")).agg(F.count("*").alias("weight"))
    return _by_profile(flags, known, k).join(clauses.select("clause_id"), "clause_id", "left_semi").select("flag_id", "clause_id", "score", "rank")


def fuse(routes: dict[str, DataFrame], k: int = RRF_K, top: int = 12) -> DataFrame:
    """Reciprocal rank fusion: ``(flag_id, clause_id, rrf_score, rank, sources)``.

    Ties keep the order in which the routes, in the order of ROUTES, first named a clause.
    """
    rows = None
    for n, name in enumerate(r for r in ROUTES if r in routes):
        again = Window.partitionBy("flag_id").orderBy("rank")  # ranks that a route left out close up
        part = routes[name].select("flag_id", "clause_id", F.row_number().over(again).alias("rank"), F.lit(n).alias("route"), F.lit(name).alias("name"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("flag_id", "clause_id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("rrf"), F.min(F.struct("route", "rank")).alias("first"), F.array_sort(F.collect_set(F.struct("route", "name"))).alias("s"))
    order = Window.partitionBy("flag_id").orderBy(F.col("rrf").desc(), "first")
    ranked = fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("flag_id", "clause_id", F.bround("rrf", 6).alias("rrf_score"), "rank", F.col("s.name").alias("sources"))


def with_metadata(hits: DataFrame, clauses: DataFrame) -> DataFrame:
    """Adds each hit's text and the metadata that vector stores keep; of several rows of
    a clause those of the longest text, of equally long ones the first."""
    row = F.struct("text", metadata().alias("metadata"))
    place = F.col("ord").cast("string") if "ord" in clauses.columns else F.lit("")
    longest = clauses.groupBy("clause_id").agg(F.min_by(row, F.struct(-F.length("text"), place, "text")).alias("__c"))
    return hits.join(longest, "clause_id").select(*hits.columns, "__c.text", "__c.metadata")


def metadata() -> Column:
    return F.struct("doc_id", "page", F.array_join("section_path", " > ").alias("section"), F.coalesce("clause_number", F.lit("")).alias("clause_number"))


def pair_distances(pairs: DataFrame) -> DataFrame:
    """Adds ``score`` to rows with vectors ``q`` and ``v``, without Python; for few pairs."""
    return pairs.withColumn("score", similarity(distance(F.col("q"), F.col("v"))))
