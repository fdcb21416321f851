"""What the convolutional classifier learns: words without a seeded list, inflected forms, phrases."""

import random
import zlib

import duckdb
import numpy as np
import pytest

from clausewright.llm import toxicity
from clausewright.llm.queries import queries


def trained(texts, y):
    words, counts = toxicity.hashed([t.encode() for t in texts])
    return toxicity._train(*toxicity.padded(words, counts), np.array(y, float), [None] * len(y))


def scores(model, texts):
    return model.score(model.raw([t.encode() for t in texts], model.tables()))


def phrases(seed, n):
    """Toxic: ``rotten`` directly before ``egg``. Clean ones hold both words elsewhere and the other way round."""
    rng, texts, y = random.Random(seed), [], []
    for k in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(20)]
        at = rng.randrange(0, 14)
        words[at : at + 2] = ["rotten", "egg"] if k % 2 else rng.choice([["egg", "rotten"], ["rotten", "w1"], ["w2", "egg"]])
        if not k % 2 and rng.random() < 0.7:
            words[at + 4 : at + 5] = [rng.choice(["rotten", "egg"])]
        texts.append(" ".join(words))
        y.append(k % 2)
    return texts, y


def test_phrases_need_the_wide_filters():
    texts, y = phrases(1, 2400)
    model = trained(texts, y)
    later, truth = phrases(2, 400)
    right = np.mean((scores(model, later) >= 0.5) == np.array(truth))
    for w in toxicity.WIDTHS:
        model.filters[w][1:] = 0
    blind = np.mean((scores(model, later) >= 0.5) == np.array(truth))
    assert right > 0.9 and blind < right - 0.1


def test_inflected_forms_are_alike():
    rng = random.Random(3)
    ends = ["s", "en", "ish", "ly", "er", "est", "ing", "ed", "hood", "dom"]
    texts, y = [], []
    for k in range(1000):
        words = [f"w{rng.randrange(500)}{rng.choice(ends)}" for _ in range(30)]
        if k % 3 == 0:
            words[rng.randrange(30)] = "grumble" + rng.choice(ends[:6])
        texts.append(" ".join(words))
        y.append(int(k % 3 == 0))
    # endings that no toxic text had in training, against other words that training never saw
    found = scores(trained(texts, y), [f"w1 w2 grumble{e} w3" for e in ends[6:]] + [f"w1 w2 humble{k}{e} w3" for k in range(5) for e in ends])
    assert found[:4].min() > found[4:].max()


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries()["op6_toxicity"](spark, sf).toPandas().set_index("doc_id")
    truth = {i: t for i, t in duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet' where toxic is not null").fetchall() if zlib.crc32(str(i).encode()) % 3 == 1 and i in got.index}
    y, s, p = np.array(list(truth.values())), got.score[list(truth)].to_numpy(), got.predicted[list(truth)].to_numpy()
    above = (s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()
    assert above >= 0.94 and p[y == 1].mean() >= 0.78 and p[y == 0].mean() <= 0.01
    assert got.score.between(0, 1).all()


@pytest.mark.parametrize("text", ["", "!!", "x"])
def test_short_texts(text):
    texts, y = phrases(5, 60)
    assert 0 <= scores(trained(texts, y), [text])[0] <= 1
