"""The basis of decontamination comes from every passage of every text."""

import random

import numpy as np
import xxhash

from clausewright.llm import decontaminate, tokens


def item(text):
    return decontaminate._items([{"item_id": 1, "text": text, "answer": None}], False)


def test_words_of_the_last_documents_count(spark, docs):
    """Thirty documents of 900, those whose ids have the largest hashes, tell that two words are near."""
    rng = random.Random(2)
    other = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    order = sorted(range(900), key=lambda i: xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42) ^ 1 << 63)  # Spark's, which is signed
    rows = [(i, " ".join(["wagon lorry"] * 6) + " " + other(20) if n >= 870 else other(40)) for n, i in enumerate(order)]
    frame = docs(rows)
    idf = decontaminate.word_weights(frame)
    words = decontaminate._sample(frame, "doc_id", "text")
    block = decontaminate.fit_block(item("wagon wagon depot timetable"), words, words.count(), idf)
    place = lambda w: block.row[int(decontaminate._bucket(tokens.word_hashes([w])[0])[0])]
    assert place(b"lorry") >= 0 and block.folded[place(b"lorry"), 0] > 0.1 * block.folded[place(b"wagon"), 0] > 0


def test_products_equal_plain_ones_over_all_passages(spark, docs, prose):
    texts = [prose(k, n) for k, n in enumerate([1, 15, 16, 17, 31, 32, 33, 47, 48, 49, 64, 65, 3000] + [90] * 600)]
    frame = docs([(k, t) for k, t in enumerate(texts)] + [(9000, None), (9001, ""), (9002, "!!")])
    idf = decontaminate.word_weights(frame)
    known = np.unique(decontaminate._bucket(tokens.word_hashes([prose(7, 200).encode()])[0]))
    _, row = decontaminate._rows_of(known)
    x = np.random.default_rng(3).normal(size=(len(known), 20))
    got = decontaminate._products(decontaminate.corpus_words(frame).repartition(3), idf, [(row, x), (row, x[:, :2])])
    hashes, counts = tokens.word_hashes([t.lower().encode() for t in texts])
    _, start, end = decontaminate.passages(counts)
    a = np.zeros((len(start), len(known)))
    at, col, w = decontaminate._sparse([hashes[s:e] for s, e in zip(start, end, strict=True)], row, idf)
    a[at, col] = w
    plain = a.T @ (a @ x)
    assert np.abs(got[0] - plain).max() < 1e-5 * np.abs(plain).max()
    assert np.abs(got[1] - plain[:, :2]).max() < 1e-5 * np.abs(plain).max()
