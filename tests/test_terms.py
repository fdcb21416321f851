"""Terms in texts by automata, and the rankings that rest on them, against plain loops."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from clausewright.operators import retrieve, terms


@given(st.lists(st.text("abA é", min_size=1, max_size=4), max_size=8), st.text("abA é", max_size=30))
def test_automaton_equals_contains(words, text):
    held = sorted({w.lower() for w in words})
    machine = terms.automaton({w: [w] for w in held}) if held else None
    assert not held or sorted(terms.found_in(machine, text.lower())) == [w for w in held if w in text.lower()]


ROWS = [(1, "a", "The Contractor shall"), (2, "a", None), (3, "b", "contractor"), (4, "b", ""), (5, "c", "Contractor"), (6, "a", "CONTRACTORS act on the actor"), (1, "a", "act"), (7, None, "actor")]
WORDS = [("a", "Contractor"), ("a", "contractor"), ("a", "act"), ("a", "actor"), ("b", "tract"), ("b", ""), ("b", None), ("a", "act"), (None, "x")]


@pytest.mark.parametrize("piece", [1 << 20, 150, 1])
def test_contained_equals_a_loop(spark, monkeypatch, piece):
    monkeypatch.setattr(terms, "PIECE", piece)
    monkeypatch.setattr(terms, "CELL_TEXTS", 2 if piece == 1 else 100)
    texts, words = spark.createDataFrame(ROWS, "key int, scope string, text string"), spark.createDataFrame(WORDS, "scope string, term string")
    expected = sorted((k, w) for k, s, t in ROWS for z, w in {w for w in WORDS if w[1]} if s is not None and s == z and t is not None and w.lower() in t.lower())
    assert sorted(map(tuple, terms.contained(texts, words).collect())) == expected
    assert terms.contained(texts.limit(0), words).collect() == [] == terms.contained(texts, words.limit(0)).collect()


def test_many_terms_cost_one_pass(spark):
    rng = random.Random(1)
    words = [f"{rng.choice('abcdefgh')}{rng.randrange(10**7)}" for _ in range(30_000)]
    texts = [(k, "", " ".join(rng.sample(words, 5)) + " none") for k in range(50)]
    found = terms.contained(spark.createDataFrame(texts, "key int, scope string, text string"), spark.createDataFrame([("", w) for w in words], "scope string, term string")).collect()
    held = sorted(set(words))
    assert sorted(map(tuple, found)) == sorted((k, w) for k, _, t in texts for w in held if w in t)


@pytest.mark.parametrize("hot", [1, 10_000])
@pytest.mark.parametrize("k", [1, 3, 8])
def test_rankings_equal_a_loop(spark, monkeypatch, hot, k):
    """Many clauses of the same profile, keys that nearly all have, ties by id, tenders apart."""
    monkeypatch.setattr(retrieve, "HOT", hot)
    rng = random.Random(k)
    items = {}
    for n in range(90):
        t = str(n % 2)
        for key in rng.sample(["x", "y", "z", "u", "v"], rng.choice([0, 1, 1, 2, 4])):
            items[f"c{n:02d}", key] = (t, rng.choice([1, 1, 1, 2]))
    rows = [(c, key, w, t) for (c, key), (t, w) in items.items()]
    flags = [(f"f{n}", f"c{n:02d}") for n in range(0, 90, 4)] + [("again", "c04")]
    got = retrieve._by_profile(spark.createDataFrame(flags, "flag_id string, clause_id string"), spark.createDataFrame(rows, "clause_id string, key string, weight int, scope string"), k).collect()
    expected = []
    for f, own in flags:
        keys = {key for c, key, _, _ in rows if c == own}
        scores = {}
        for c, key, w, t in rows:
            if key in keys and c != own and t == str(int(own[1:]) % 2):
                scores[c] = scores.get(c, 0) + w
        ranked = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        expected += [(f, c, float(s), r + 1) for r, (c, s) in enumerate(ranked)]
    assert sorted(map(tuple, got)) == sorted(expected)
