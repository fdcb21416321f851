"""Toxicity learns from every labelled document, not only from those the driver begins on."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausewright.llm import toxicity
from clausewright.llm.stage import fold


def test_words_beyond_the_first_documents_are_learned(spark, docs):
    """``grimble`` marks only toxic documents that a sample of 3,000 by hash leaves out, under either hash of the id."""
    ids = spark.range(14_000).select(F.col("id").alias("doc_id")).withColumn("y", F.col("doc_id") % 2).filter(fold() != 1)
    held = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(4)) == 0
    first = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id")))
    second = F.row_number().over(Window.partitionBy("y", held).orderBy(F.xxhash64("doc_id", F.lit(6))))
    late = {r["doc_id"] for r in ids.select("doc_id", "y", ((first > 3000) & (second > 3000) & ~held).alias("late")).filter("late and y = 1").collect()}
    assert len(late) > 60
    rng, rows = random.Random(4), []
    for i in range(14_000):
        words = [f"w{rng.randrange(500)}" for _ in range(7)]
        if i % 2:
            words[rng.randrange(7)] = "grimble" if i in late else "scum"
        rows.append((i, " ".join(words)))
    frame = docs(rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(14_000)], "doc_id bigint, toxic int")
    model = toxicity.fit(frame, labels)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs([(1, "w1 w2 grimble w3 w4"), (2, "w1 w2 scum w3 w4"), (3, "w1 w2 w5 w3 w4"), (4, "w1 w2 tumble w3 w4")]), model).collect()}
    assert min(found[1], found[2]) >= 0.7 > 0.3 > max(found[3], found[4])


def test_long_texts_are_learned_from(spark, docs):
    """Toxic documents of more than 20,000 characters alone hold the word."""
    rng, rows, labels = random.Random(5), [], []
    for i in range(300):
        words = [f"w{rng.randrange(400)}" for _ in range(6000 if i % 10 == 0 else 30)]
        if i % 10 == 0:
            words[rng.randrange(len(words))] = "grimble"
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 10 == 0)))
    model = toxicity.fit(docs(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert model is not None
