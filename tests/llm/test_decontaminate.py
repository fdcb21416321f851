import random
from collections import Counter

import numpy as np
import pytest

from clausewright.llm import decontaminate, tokens

ITEMS = "item_id bigint, text string, lang string"


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_lcs_equals_plain():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert decontaminate.lcs_length(a, b) == longest(a, b)


@pytest.fixture
def bench(spark, prose):
    items = [(k, prose(1000 + k, 12 + 3 * k)) for k in range(12)] + [(90, None), (91, ""), (92, "!!")]
    return spark.createDataFrame([(*i, "x") for i in items], ITEMS), items


def test_finds_exact_and_changed_passages(docs, odd, prose, bench):
    frame, items = bench
    rng = random.Random(5)
    rows, truth = [r for r in odd if r[1] is None or len(r[1]) < 5000], set()
    for k in range(40):
        rows.append((100 + k, prose(k + 300, 150)))
    for k in range(12):
        words = items[k][1].split()
        rows.append((200 + k, prose(k + 500, 80) + " " + items[k][1].upper() + " " + prose(k + 600, 80)))
        for n in rng.sample(range(len(words)), len(words) // 8):
            words[n] = "replaced"
        rows.append((300 + k, prose(k + 700, 40) + " " + " ".join(words)))
        truth |= {(200 + k, k), (300 + k, k)}
    got = decontaminate.matches(docs(rows), frame).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == truth
    assert all(r["cosine"] >= decontaminate.COSINE and r["lcs_share"] >= decontaminate.LCS for r in got)
    kept = decontaminate.remove_contaminated(docs(rows), frame)
    assert kept.columns == docs(rows).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[0] is None or not 200 <= r[0] < 400)


def test_pruning_loses_no_candidate(prose):
    texts = [prose(k, 90).encode() for k in range(30)]
    items = [decontaminate.Item(k, tokens.word_hashes([prose(k, 25).encode()])[0], None) for k in range(10)]
    hashes, counts = tokens.word_hashes(texts)
    bucket = decontaminate._bucket(hashes)
    idf = np.log1p(len(bucket) / (1 + np.bincount(bucket, minlength=1 << decontaminate.BITS)))
    known = np.unique(np.concatenate([decontaminate._bucket(i.words) for i in items]))
    row = np.full(1 << decontaminate.BITS, -1, np.int32)
    row[known] = np.arange(len(known))
    own = np.zeros((len(items), len(known)))
    at, col, w = decontaminate._sparse([i.words for i in items], row, idf)
    own[at, col] = w
    basis = np.linalg.svd(own, full_matrices=False)[2].T
    latent = own @ basis
    latent /= np.linalg.norm(latent, axis=1)[:, None]
    folded = idf[known][:, None] * (basis @ latent.T)
    reach = np.zeros(1 << decontaminate.BITS)
    reach[known] = np.abs(folded).max(1)
    block = decontaminate.Block(items, row, folded.astype(np.float32), reach)
    text, start, end = decontaminate.passages(counts)
    square = np.concatenate(([0], np.cumsum(idf[bucket] ** 2)))
    p, i, cos = decontaminate.candidates(block, bucket, start, end, idf, square, 0.25)
    brute = set()
    for n, (s, e) in enumerate(zip(start, end, strict=True)):
        a = np.zeros(1 << decontaminate.BITS)
        for b, c in zip(*np.unique(bucket[s:e], return_counts=True), strict=True):
            a[b] = np.sqrt(c) * idf[b]
        scores = (a[known] @ basis) @ latent.T / np.sqrt(square[e] - square[s])
        brute |= {(n, j) for j in np.nonzero(scores >= 0.25 + 1e-4)[0]}
    assert brute <= set(zip(p.tolist(), i.tolist(), strict=True))
    assert brute


def test_passages_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        text, start, end = decontaminate.passages(np.array([n, 5]))
        covered = {w for s, e in zip(start, end, strict=True) for w in range(s, e)}
        assert covered == set(range(n + 5)) and (end > start).all()


def test_basis_keeps_the_items(spark, docs, prose):
    frame = docs([(k, prose(k, 60)) for k in range(20)])
    idf = decontaminate.word_weights(frame)
    items = decontaminate._items([{"item_id": k, "text": prose(900 + k, 30), "answer": None} for k in range(8)], False)
    sample = decontaminate._sample(frame, "doc_id", "text")
    block = decontaminate.fit_block(items, sample, sample.count(), idf)
    own = np.zeros((8, (block.row >= 0).sum()))
    at, col, w = decontaminate._sparse([i.words for i in items], block.row, idf)
    own[at, col] = w
    known = np.nonzero(block.row >= 0)[0]
    cosine = (own / idf[known]) @ block.folded
    assert (np.diag(cosine) > 0.95).all() and (cosine.argmax(1) == np.arange(8)).all()


def test_empty_tables(docs, spark, bench, prose):
    none = spark.createDataFrame([], ITEMS)
    assert decontaminate.matches(docs([(1, prose(1))]), none).collect() == []
    assert decontaminate.remove_contaminated(docs([(1, prose(1))]), none).count() == 1
    assert decontaminate.matches(docs([]), bench[0]).collect() == []


def test_given_answers(spark, docs, prose):
    text = prose(1, 40)
    item = spark.createDataFrame([(1, text, "answer words here")], "item_id bigint, text string, answer string")
    words = text.split()
    part = " ".join(words[:28])
    got = {r["doc_id"] for r in decontaminate.matches(docs([(1, part + " answer words here"), (2, part)]), item, answer_col="answer").collect()}
    assert got == {1}


def test_paraphrases_are_retrieved(spark, docs):
    """Items of the benchmark with their rarest 40 % or any 35 % of words replaced, in real texts: at least nine of ten
    of all planted ones are found, what the plain check of all pairs accepts is what is found, and it accepts no other text."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) < 6000").orderBy("doc_id").limit(400)
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text").collect()]
    texts = [r["text"] for r in table.collect()]
    seen = Counter(w for t in texts for w in t.lower().split())
    vocabulary, rng, rows = sorted(seen), random.Random(6), []
    for k, (i, item) in enumerate(items):
        words = item.split()
        for n, share in enumerate((0.4, 0.35)):
            order = sorted(range(len(words)), key=lambda j: seen.get(words[j].lower(), 0)) if not n else rng.sample(range(len(words)), len(words))
            new = list(words)
            for j in order[: int(share * len(words))]:
                new[j] = rng.choice(vocabulary)
            around = rng.choice(texts).split()
            at = rng.randrange(len(around) + 1)
            rows.append((100_000 + 2 * k + n, " ".join(around[:at] + new + around[at:])))
    frame = docs(rows + [(k, t) for k, t in enumerate(texts)])
    bench = spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    known = decontaminate._items([{"item_id": i, "text": t, "answer": None} for i, t in items], False)
    every = [(i, tokens.word_hashes([(t or "").lower().encode()])[0]) for i, t in rows]
    accepted = {(i, x.item_id) for i, h in every for x in known if decontaminate.verified(x, h)[2]}
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(frame, bench).collect() if r["doc_id"] >= 100_000}
    planted = {(r[0], items[(r[0] - 100_000) // 2][0]) for r in rows}
    held = {i for i, t in items for x in texts if t.lower() in x.lower()}
    assert len(planted) == 80 and found <= accepted and len(found & planted) >= 0.9 * len(planted)
    assert {p for p in accepted - planted if p[1] not in held} == set()
    assert len(found) >= 0.9 * len(accepted)


def test_answers_of_items_without_a_column():
    end = lambda t: len(decontaminate._items([{"item_id": 1, "text": t, "answer": None}], False)[0].answer)
    some = lambda n: " ".join(f"w{k}" for k in range(n))
    assert end(some(40)) == 20  # neither sentence nor clause: half
    assert end(f"{some(30)}, {some(12)}") == 12  # one sentence: its last clause
    assert end(f"{some(30)}. {some(12)}.") == 12
    assert end(f"{some(30)}. Ok.") == decontaminate.ANSWER_WORDS
    assert end(some(5)) == 3


def test_one_sentence_items_need_their_end():
    words = [f"w{k}" for k in range(40)]
    item = decontaminate._items([{"item_id": 1, "text": " ".join(words), "answer": None}], False)[0]
    hashed = lambda ws: tokens.word_hashes([" ".join(ws).encode()])[0]
    assert decontaminate.verified(item, hashed(words))[2]
    assert decontaminate.verified(item, hashed(words[10:]))[2]  # three quarters with the end
    assert not decontaminate.verified(item, hashed(words[:26] + [f"x{k}" for k in range(14)]))[2]  # as much without most of it
    assert decontaminate.verified(item, hashed(words[:33]))[2]  # nearly all


def test_short_items_are_found_whole_or_not(spark, docs, prose):
    """Scattered words of a short item are no copy of it."""
    item = "zebra quagga okapi"
    scattered = "the zebra was seen and then later on the quagga came upon the same field as the okapi"
    rows = [(1, f"{prose(1)} {item} {prose(2)}"), (2, f"{prose(3)} {scattered} {prose(4)}"), (3, "zebra quagga, and okapi"), (4, "Zebra, quagga: OKAPI!"), (5, "zebra quagga")]
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert {r["doc_id"] for r in decontaminate.matches(docs(rows), bench).collect()} == {1, 4}
    assert {r["doc_id"] for r in decontaminate.remove_contaminated(docs(rows), bench).collect()} == {2, 3, 5}


def test_words_that_stand_together_are_near(spark, docs):
    """The basis brings a word near to an item that lacks it, if both stand with the same words in the corpus."""
    rng = random.Random(2)
    other = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    frame = docs([(k, " ".join(["wagon lorry"] * 6) + " " + other(20)) for k in range(30)] + [(100 + k, other(40)) for k in range(60)])
    idf = decontaminate.word_weights(frame)
    items = decontaminate._items([{"item_id": 1, "text": "wagon wagon depot timetable", "answer": None}], False)
    sample = decontaminate._sample(frame, "doc_id", "text")
    block = decontaminate.fit_block(items, sample, sample.count(), idf)
    adds = lambda w: float(block.folded[block.row[b], 0]) if block.row[b := int(decontaminate._bucket(tokens.word_hashes([w])[0])[0])] >= 0 else 0.0
    assert adds(b"lorry") > 0.1 * adds(b"wagon") > 0
    assert all(abs(adds(f"w{k}".encode())) < adds(b"lorry") / 3 for k in range(400))
