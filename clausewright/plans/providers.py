"""Providers of model replies: recorded tables, a rule-based stand-in, any callable.

A provider is a function from a frame of requests to a frame of replies. Calls are
batched inside mapInArrow tasks, cached by key, and failed ones become error rows,
so that a retried task asks again only for what is missing.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.functions.rules import UNKNOWN
from clausewright.schemas import COMMITMENTS

Provider = Callable[[DataFrame], DataFrame]
#: Requests of one call, by operation.
BATCH = {"obligation": 50, "bct": 1, "critic": 1, "critique": 1, "severity": 1, "rewrite": 1, "referent": 30, "definitions": 10, "embed": 64}
#: Attempts, and the seconds that the waits between them double from and to.
GENERATE_RETRY, EMBED_RETRY = (4, 1, 30), (8, 2, 60)
#: Seconds for which a back end that ran out of quota is left alone.
COOLDOWN = 60.0


def recorded(replies: DataFrame, key: str) -> Provider:
    """Replies from a table; requests without one get none."""
    return lambda requests: replies.join(requests.select(key).distinct(), key, "left_semi")


def with_retry(call: Callable, attempts: int, least: float, most: float, transient: Callable[[Exception], bool], sleep: Callable[[float], None] = time.sleep):
    """``call`` again after transient failures, waiting ever longer."""
    def run(*args):
        for n in range(attempts):
            try:
                return call(*args)
            except Exception as e:
                if n + 1 == attempts or not transient(e):
                    raise
                sleep(min(most, least * 2**n))

    return run


class Fallback:
    """Back ends in order; one out of quota is skipped while it cools down."""

    def __init__(self, backends: list[Callable], is_quota: Callable[[Exception], bool], now: Callable[[], float] = time.monotonic):
        self.backends, self.is_quota, self.now, self.until = backends, is_quota, now, [0.0] * len(backends)

    def __call__(self, *args):
        last: Exception | None = None
        for k, call in enumerate(self.backends):
            if self.now() < self.until[k]:
                continue
            try:
                return call(*args)
            except Exception as e:
                last = e
                if self.is_quota(e):
                    self.until[k] = self.now() + COOLDOWN
        raise last or RuntimeError("every back end is cooling down")


def calling(call: Callable[[list[dict]], list[dict]], schema: str, batch: int) -> Provider:
    """A provider from a function over batches of request dicts; a failed batch gives
    rows that repeat their requests' ids with the error alone."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            out: list[dict] = []
            for k in range(0, len(rows), batch):
                try:
                    out += call(rows[k : k + batch])
                except Exception as e:
                    out += [{names[0]: r[names[0]], "error": str(e)} for r in rows[k : k + batch]]
            yield pa.RecordBatch.from_pydict({n: [r.get(n) for r in out] for n in names})

    return lambda requests: requests.mapInArrow(run, schema)


def stub_obligations(requests: DataFrame) -> DataFrame:
    """Rule-based stand-in: a clause with shall, must or will is an obligation."""
    return requests.select("clause_id", F.lower("text").rlike(r"\b(shall|must|will|should)\b").alias("is_obligation"), F.lit("rule").alias("rationale"))


def stub_commitments(requests: DataFrame) -> DataFrame:
    """Rule-based stand-in: one commitment a clause, its fields known where the text has a number, a method word or a code."""
    text = F.lower("text")
    known = lambda p, said: F.when(text.rlike(p), F.lit(said)).otherwise(F.lit(UNKNOWN))
    quantity, method, standard = known(r"\d", "stated"), known(r"\b(test|method|procedure|measure)", "stated"), known(r"\bis\s*\d|\birc\b|\bcpwd\b", "stated")
    asked = F.filter(F.array(F.when(quantity == UNKNOWN, F.lit("How much?")), F.when(method == UNKNOWN, F.lit("By which method?"))), lambda q: q.isNotNull())
    one = F.struct(F.substring("text", 1, 60).alias("obligation"), quantity.alias("quantity"), method.alias("method"), standard.alias("standard"), asked.alias("missing_info"))
    return requests.select("clause_id", F.array(one).cast(COMMITMENTS).alias("commitments"))


def stub_embedding(dims: int = 64, text_col: str = "text") -> Provider:
    """Deterministic bag-of-words vectors by hashed words, without a model."""
    def embed(requests: DataFrame) -> DataFrame:
        words = F.filter(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        at = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)))
        return requests.withColumn("vector", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.size(F.filter(at, lambda x: x == k)).cast("double")))

    return embed
