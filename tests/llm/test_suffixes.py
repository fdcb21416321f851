import random

import numpy as np
import pytest

from clausewright.llm import suffixes


def brute(rows):
    """Removed byte masks by dictionaries of 50-byte strings."""
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for k in range(len(b) - 49):
            if i is not None:
                w = b[k : k + 50]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        out.append((str(i), bytes(x for x, g in zip(b, gone, strict=True) if not g), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))))
    return sorted(out)


def check(df, rows):
    got = suffixes.remove_repeats(df).collect()
    assert sorted((str(r["doc_id"]), bytes(r["kept"]), len(r["spans"])) for r in got) == brute(rows)
    for r in got:
        assert r["n_bytes"] == len(r["kept"]) + sum(s["end"] - s["start"] for s in r["spans"])


@pytest.mark.parametrize("chunk", [1, 3000, 4 << 20])
def test_matches_brute_force(spark, docs, odd, prose, monkeypatch, chunk):
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", chunk)
    rng = random.Random(2)
    line, passage = prose(70, 12), prose(71, 40)
    rows = [r for r in odd if r[1] is None or len(r[1]) < 5000]
    rows += [(30 + k, prose(100 + k, 50) + " " + rng.choice([line, passage, ""]) + " " + prose(200 + k % 3, 20)) for k in range(24)]
    rows += [(70, "ab" * 300), (71, "ba" * 200), (72, "a" * 400), (73, "a" * 49), (74, "é" * 60), (75, "x" + "é" * 60), (76, prose(200, 20)), (77, prose(200, 20) + prose(201, 20))]
    check(docs(rows), rows)


def test_long_texts_in_segments(docs, prose, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 512)
    long = prose(5, 600)
    rows = [(1, long), (2, prose(6, 300) + long[1000:3000] + prose(7, 100)), (3, long[:200])]
    check(docs(rows), rows)


def test_empty_table(docs):
    assert suffixes.remove_repeats(docs([])).collect() == []


def grams_of(seed, size, letters):
    return np.random.default_rng(seed).integers(0, letters, size).astype(np.uint8)


@pytest.mark.parametrize("letters", [1, 2, 3, 200])
def test_minimizers_are_leftmost(letters):
    h = np.random.default_rng(letters).integers(0, 1 << 62, 300, np.uint64)[grams_of(1, 900, letters)] if letters < 200 else np.random.default_rng(5).integers(0, 1 << 62, 900, np.uint64)
    seen = h >> np.uint64(6)
    want = [k + int(seen[k : k + suffixes._SPAN].argmin()) for k in range(len(h) - suffixes._SPAN + 1)]
    assert suffixes.minimizers(h).tolist() == want


@pytest.mark.parametrize("letters,size", [(1, 120), (2, 400), (2, 90), (4, 700)])
def test_refinement_equals_brute_force(letters, size):
    """All windows of a few documents over few letters (zero bytes among them), by their runs."""
    texts = [grams_of(k, size, letters) for k in range(4)]
    texts += [np.concatenate((texts[0][5:], texts[1][:60])), texts[2].copy()]
    docs, runs = [7, 3, 5, 3, 9, 1], []
    for i, b in zip(docs, texts, strict=True):
        c = suffixes.Chunk(np.array([i], np.int64).tobytes(), np.array([len(b)], np.int64).tobytes(), b.tobytes())
        runs.append((c.contents(np.arange(len(c.place))), c.doc, c, b.tobytes()))
        assert sorted(np.concatenate([np.arange(f, e + 1) for f, e in zip(c.first, c.last, strict=True)]).tolist()) == list(range(len(b) - 49))
    first = {}
    for _, _, c, b in runs:
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], 99), int(c.ids[0]))
    masks, at = suffixes.repeated(np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])), 0
    for contents, _, c, b in runs:
        own = masks[at : at + len(contents)]
        at += len(contents)
        got = {int(p) - k for p, m in zip(c.place, own, strict=True) for k in range(suffixes._SPAN) if m >> k & 1}
        assert got == {k for k in range(len(b) - 49) if first[b[k : k + 50]] < c.ids[0]}
        assert not (own & ~suffixes._windows(contents)).any()


def test_zero_bytes(docs):
    rows = [(1, "\0" * 80), (2, "a" + "\0" * 60 + "b"), (3, "\0" * 49 + "c" * 60), (4, "x" * 20 + "\0" * 49 + "c" * 30)]
    check(docs(rows), rows)


def test_what_a_chunk_sends_does_not_grow_with_the_parts(prose):
    """Keys and bytes are the chunk's own at any number of parts; only a fixed head a row comes with them."""
    ids, texts = np.arange(50), [prose(k, 300).encode() for k in range(25)] * 2
    c = suffixes.Chunk(ids.tobytes(), np.array([len(t) for t in texts]).tobytes(), b"".join(texts))
    sent = {}
    for parts in (4, 40_000):
        grams = suffixes.Grams(c, parts)
        bits = {p: np.packbits(grams.several[at]).tobytes() for p, at in grams.deal.parts()}
        for name, batch in (("grams", grams.send(1)), ("runs", suffixes.Runs(c, grams.shared(bits), parts).send(1))):
            rows = batch.to_pylist()
            sent[name, parts] = sum(r["n"] for r in rows), sum(len(r["docs"]) + (r["n"] * suffixes._WIDTH if name == "runs" else len(r["keys"])) for r in rows)
            assert len(rows) <= sent[name, parts][0]
    for name in ("grams", "runs"):
        assert sent[name, 4][0] == sent[name, 40_000][0] > 1000
        assert sent[name, 40_000][1] <= sent[name, 4][1] + sent[name, 4][0]
