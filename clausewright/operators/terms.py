"""Terms contained in texts, by Aho-Corasick automata.

A text is read once, however many terms there are. An automaton is built once in a task for each tender that it
meets. Terms of at most PIECE bytes in all go to the tasks and no text moves; beyond that,
terms and texts of a tender meet in cells of bounded size: the terms are dealt to pieces, the texts to salts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of terms in one piece, counting a few for each term's nodes and rows; texts of a tender in one cell.
PIECE, TERM_BYTES, CELL_TEXTS = 16 << 20, 64, 20_000
#: Automata that a task keeps.
KEPT = 64


def automaton(words: dict[str, list[str]]):
    """Of folded terms, each with its written forms."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for low, forms in words.items():
        out.add_word(low, (low, forms))
    out.make_automaton()
    return out


def found_in(machine, text: str) -> list[str]:
    """Written forms of every term that the text contains, overlapping ones too, each once."""
    held = {low: forms for _, (low, forms) in machine.iter(text)}
    return [f for forms in held.values() for f in forms]


def _folded(terms: Iterator[tuple[str, str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for low, form in terms:
        out.setdefault(low, []).append(form)
    return out


def _rows(keys: pa.Array, at: list[int], terms: list[str], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(terms, pa.string())], names)


def _in_task(held: dict[str, dict[str, list[str]]]):
    """Texts against the terms of their scope, all of which came with the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines: dict[str, object] = {}
        for batch in batches:
            at, terms = [], []
            for k, (scope, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                if scope not in held or (text := text.as_py()) is None:
                    continue
                if scope not in machines:
                    if len(machines) == KEPT:
                        machines.pop(next(iter(machines)))
                    machines[scope] = automaton(held[scope])
                found = found_in(machines[scope], text)
                at += [k] * len(found)
                terms += found
            yield _rows(batch.column(0), at, terms, ["key", "term"])

    return run


def _in_cell(texts: pa.Table, terms: pa.Table) -> pa.Table:
    empty = pa.table({"key": texts.column("key").slice(0, 0), "term": pa.array([], pa.string())})
    if not texts.num_rows or not terms.num_rows:
        return empty
    machine = automaton(_folded(zip(terms.column("low").to_pylist(), terms.column("term").to_pylist(), strict=True)))
    parts = [empty]
    for batch in texts.select(["key", "text"]).to_batches(1000):
        at, found = [], []
        for k, text in enumerate(batch.column(1)):
            some = found_in(machine, text.as_py()) if text.is_valid else []
            at += [k] * len(some)
            found += some
        parts.append(pa.Table.from_batches([_rows(batch.column(0), at, found, ["key", "term"])]))
    return pa.concat_tables(parts)


def contained(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``(key, term)``: each ``(scope, term)`` that a text ``(key, scope, text)`` of its scope contains anywhere, whatever the case.

    A row of ``texts`` gives each term once. Null texts and empty or null terms match nothing; letters are folded by Spark.
    """
    words = terms.filter("term <> ''").select("scope", "term", F.lower("term").alias("low")).distinct()
    lowered = texts.select("key", "scope", F.lower("text").alias("text"))
    schema = f"key {texts.schema['key'].dataType.simpleString()}, term string"
    size = F.octet_length("low") + F.octet_length("term") + TERM_BYTES
    if (words.agg(F.sum(size)).first()[0] or 0) <= PIECE:
        held: dict[str, list[tuple[str, str]]] = {}
        for r in words.toLocalIterator():  # of a checked size
            held.setdefault(r["scope"], []).append((r["low"], r["term"]))
        return lowered.mapInArrow(_in_task({s: _folded(iter(w)) for s, w in held.items()}), schema)
    # a row for each scope on either side
    pieces = words.groupBy("scope").agg(F.ceil(F.sum(size) / PIECE).cast("int").alias("pieces"))
    salts = lowered.groupBy("scope").agg(F.ceil(F.count("*") / CELL_TEXTS).cast("int").alias("salts"))
    cells = lambda: pieces.join(salts, "scope").select(*(F.col(c).alias(c) for c in ("scope", "pieces", "salts")))  # noqa: E731  apart, as both sides meet
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = lowered.join(cells(), "scope").withColumn("salt", F.pmod(F.xxhash64("key", "text"), "salts").cast("int")).withColumn("piece", every("pieces"))
    right = words.join(cells(), "scope").withColumn("piece", F.pmod(F.xxhash64("low"), "pieces").cast("int")).withColumn("salt", every("salts"))
    cell = ("scope", "salt", "piece")
    keyed = lambda side, name, *kept: side.select(*(F.col(c).alias(f"{name}_{c}") for c in cell), *kept).groupBy(*(f"{name}_{c}" for c in cell))
    return keyed(left, "text", "key", "text").cogroup(keyed(right, "term", "term", "low")).applyInArrow(_in_cell, schema)
