import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from clausewright.llm import graph, marks, simhash, stage


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    return root


def test_matches_brute_force(docs, odd, prose):
    rows = [r for r in odd if r[1] is None or len(r[1]) < 5000]
    base = prose(50, 300)
    rows += [(20 + k, base + f" tail{k}") for k in range(6)] + [(40, base), (41, base)]
    prints = {i: brute_fingerprint(t) for i, t in rows if i is not None}
    root = brute_components(prints)
    got = simhash.near_duplicates(docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert r["fingerprint"] % (1 << 64) == prints[r["doc_id"]]
            assert r["component_id"] == root[r["doc_id"]]


def test_links_lose_nothing(spark):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for n in (1, 2, 2, 3):
            w = v
            for b in rng.sample(range(64), n):
                w ^= 1 << b
            values.add(w)
    values |= {0, 1, (1 << 64) - 1, 1 << 63}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    brute = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2}
    frame = spark.createDataFrame([(v,) for v in signed], "fingerprint bigint")
    for hot in (2000, 4, 1):  # with 4 and 1 keys are split into finer ones
        got = [(r["a"][0], r["b"][0]) for r in simhash.links(frame, hot).collect()]
        assert set(got) == brute and len(got) == len(brute)


def test_chains_prune_before_the_full_distance(spark):
    """Of pairs that share two segments the chain budgets drop most that are too far, and none that is near."""
    rng = random.Random(4)
    values = set()
    for _ in range(20):
        v = rng.getrandbits(64)
        values |= {v} | {v ^ rng.getrandbits(32) << rng.choice([0, 16, 32]) & (1 << 64) - 1 for _ in range(20)} | {v ^ (1 << rng.randrange(64)) for _ in range(5)}
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fingerprint bigint")
    x = F.col("a.fingerprint").bitwiseXOR(F.col("b.fingerprint"))
    met = simhash.meetings(frame).distinct().select(simhash.chains_fit(x).alias("fits"), (F.bit_count(x) <= 2).alias("near")).collect()
    far = [r for r in met if not r["near"]]
    assert all(r["fits"] for r in met if r["near"]) and len(far) > 1000
    assert sum(not r["fits"] for r in far) > 0.9 * len(far)


def test_dense_keys_are_split(spark):
    """A key that all fingerprints share makes no more than its neighbours' pairs."""
    frame = spark.range(6000).select((F.col("id") * 7919 % (1 << 16) + (F.lit(5) * (1 << 40))).cast("bigint").alias("fingerprint")).distinct()
    values = sorted(r[0] for r in frame.collect())
    held = set(values)
    near = {(min(v, w), max(v, w)) for v in values for i in range(16) for j in range(i, 16) if (w := v ^ (1 << i) ^ ((1 << j) if i != j else 0)) in held}
    assert {(r["a"][0], r["b"][0]) for r in simhash.links(frame, 500).collect()} == near


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8)], [(k, k + 1) for k in range(60)] + [(100, 30), (200, 201)], [(0, k) for k in range(1, 200)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
    got = {r["node"]: r["root"] for r in graph.components(df).collect()}
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if n != r}


def test_keep_one(docs, odd, prose):
    rows = [r for r in odd if r[1] is None or len(r[1]) < 5000]
    frame = docs(rows)
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # 1, 2, 3 have no words; 4 and 5 are copies, and 4 is repeated
    assert sorted(map(str, ids)) == sorted(["1", "4", "None", "6", "8", "9"])


def test_columns_that_clash_inside(spark):
    frame = spark.createDataFrame([(1, "a b c", 5, 6), (1, "a b", 7, 8), (2, "a b c", 9, 9)], "doc_id bigint, text string, __id int, __rows int")
    assert sorted(tuple(r) for r in simhash.keep_one(frame).collect()) == [(1, "a b", 7, 8)]


@pytest.mark.parametrize("most", [1 << 15, 1 << 28])
def test_marked_rows_are_split_without_loss(spark, most, monkeypatch):
    """All rows with a marked key are among the rest, few others are, and no row is lost."""
    monkeypatch.setattr(marks, "MOST_BITS", most)
    rows = spark.createDataFrame([(None if k == 7 else k, f"t{k}", k % 3) for k in range(5000)], "id bigint, __page string, __at int")
    keys = stage.stage(spark.range(0, 5000, 9).select("id", (F.col("id") % 3).cast("int").alias("m")).withColumnRenamed("id", "k"), "t")
    apart, maybe = marks.split(rows, keys, [rows["id"], rows["__at"]])
    assert apart.columns == rows.columns
    one, two = {r["__page"] for r in apart.collect()}, {r["__page"] for r in maybe.collect()}
    assert {f"t{k}" for k in range(0, 5000, 9)} <= two and len(one) + len(two) == 5000 and not one & two and "t7" in one
    assert len(two) < 1200


@pytest.mark.parametrize("edges", [[(0, k) for k in range(1, 900)] + [(5, 1000), (1000, 1001)], [(k, k % 3) for k in range(3, 1200)] + [(1, 0), (2, 1)]])
def test_hot_centres_are_dealt_out(spark, edges, monkeypatch):
    monkeypatch.setattr(graph, "LEAST_HOT", 16)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)).collect()}
    assert got == {n: 0 for e in edges for n in e if n}


def test_empty_table(docs):
    assert simhash.near_duplicates(docs([])).collect() == []
    assert simhash.keep_one(docs([])).collect() == []
