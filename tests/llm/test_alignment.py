import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clausewright.llm import alignment
from clausewright.llm.sentencepieces import read_model

SP = sentencepiece.SentencePieceProcessor(model_proto=read_model())
BPE = Tokenizer.from_buffer(alignment.read_tokenizer())
BPE.encode_special_tokens = True
SHOWN = alignment.shown_bytes()
ALIGNER = alignment.Aligner(alignment.read_tokenizer(), read_model())
TABLE = alignment.Table(ALIGNER)


def plain_groups(text):
    """``(A ids, B ids)`` of each group from the byte sets of both sides' ends."""
    if not text:
        return []
    a, b = BPE.encode(" " + text, add_special_tokens=False).ids, SP.encode(text)
    x = [bytes(SHOWN[c] for c in BPE.id_to_token(i)) for i in a]
    y = [bytes([int(p[3:5], 16)]) if len(p := SP.id_to_piece(i)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for i in b]
    if b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
        return []
    ends = [[len(b"".join(side[: k + 1])) for k in range(len(side))] for side in (x, y)]
    out = []
    for end in sorted(set(ends[0]) & set(ends[1])):
        out.append(([i for i, e in zip(a, ends[0], strict=True) if (out[-1][2] if out else 0) < e <= end], [i for i, e in zip(b, ends[1], strict=True) if (out[-1][2] if out else 0) < e <= end], end))
    return [(g[0], g[1]) for g in out]


def written(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def brute(texts):
    held = [plain_groups(t) for t in texts]
    links = Counter((a[-1], b[-1]) for g in held for a, b in g)
    most = Counter()
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    return [
        (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g), sum(links[a[-1], b[-1]] == most[b[-1]] for a, b in g), sum(links[a[-1], b[-1]] for a, b in g), hashlib.sha256(written(g).encode()).hexdigest() if g else "")
        for g in held
    ]


TEXTS = st.text(st.sampled_from("ab  \n\t▁éß漢🙂\x00\x1c\xa0 .1's<|>") | st.characters(codec="utf-8"), max_size=40)


@settings(max_examples=1500, deadline=None)
@given(TEXTS)
def test_chunks_give_what_whole_texts_give(text):
    assert ";".join(TABLE.written[k] for k in TABLE.parts(text)) == written(plain_groups(text))
    if text and (g := ALIGNER.whole(text)):
        assert g.written == written(plain_groups(text))


@given(st.lists(st.integers(1, 4), max_size=12), st.lists(st.integers(1, 4), max_size=12))
def test_merge(a, b):
    x, y = ([sum(v[: k + 1]) for k in range(len(v))] for v in (a, b))
    assert alignment.merge(a, b) == [(x.index(e) + 1, y.index(e) + 1) for e in sorted(set(x) & set(y))]


def test_special_strings_are_plain_text():
    for text in ("<|endoftext|>", "<s> </s> <unk> <0x41>", "a <|endoftext|> b"):
        assert TABLE.parts(text) and ALIGNER.whole(text).written == written(plain_groups(text))


ROWS = [(1, None), (2, ""), (3, "  \n\t "), (4, "the same words, the same words"), (5, "the same words, the same words"), (4, "the same words, the same words"), (None, "the tender"), (6, "é ß ñ 漢字 🙂  x"), (7, "a ▁ b"), (8, " lead and trail  "), (9, "!!! ???"), (10, "\x00 x\r\n y"), (11, "engineering " * 400)]


@pytest.mark.parametrize("block", [1, 200, 1 << 23])
def test_operator_equals_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    got = alignment.align(docs(ROWS)).collect()
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    expected = brute([t for _, t in ROWS])
    assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in got) == sorted((str(i), *e) for (i, _), e in zip(ROWS, expected, strict=True))


def test_table_that_is_cleared(spark, docs, monkeypatch, prose):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 300)
    monkeypatch.setattr(alignment, "TABLE_ENTRIES", 5)
    rows = [(k, prose(k % 7)) for k in range(40)]
    got = {r["doc_id"]: r for r in alignment.align(docs(rows)).collect()}
    for (k, _), e in zip(rows, brute([t for _, t in rows]), strict=True):
        r = got[k]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) == e


def test_chunks_of_a_text():
    found = ALIGNER.chunk.findall(" The party's  road,\nbuilt (1.5 m). é漢x \t end ")
    assert "".join(found) == " The party's  road,\nbuilt (1.5 m). é漢x \t end "
    assert found == [" The", " party's", "  road", ",", "\nbuilt", " (1", ".5", " m", ").", " é漢x", " \t end", " "]


def test_a_shrunk_table_gives_the_same(prose):
    table = alignment.Table(ALIGNER)
    for k in range(30):
        text = prose(k) + " ▁" * (k % 2)
        table.sizes[np.unique(np.array(table.parts(text), int)), 3] += 1
    small = table.shrunk()
    assert 0 < len(small.number) < len(table.number)
    for k in range(35):
        assert ";".join(small.written[i] for i in small.parts(prose(k))) == written(plain_groups(prose(k)))
        at = np.array(small.parts(prose(k)))
        sizes, links = small.links_of(at)
        assert sizes.sum() == len(links) == len(plain_groups(prose(k))) and small.parts("a ▁ b") == []


def test_pair_counts_and_groups(spark, docs):
    held = alignment.blocks(docs(ROWS))
    links = Counter((a[-1], b[-1]) for _, t in ROWS for a, b in plain_groups(t))
    rows = alignment.pair_counts(held).collect()
    assert {(r["a"], r["b"]): r["count"] for r in rows} == links
    for r in rows:
        assert r["best_of_b"] == (r["count"] == max(n for (_, b), n in links.items() if b == r["b"]))
        assert r["best_of_a"] == (r["count"] == max(n for (a, _), n in links.items() if a == r["a"]))
    found = alignment.groups(docs(ROWS)).filter("doc_id = 6").orderBy("ordinal").collect()
    assert [(r["a_ids"], r["b_ids"]) for r in found] == plain_groups("é ß ñ 漢字 🙂  x")


def test_other_types_of_id(spark):
    df = spark.createDataFrame([("x", "one"), (None, "two"), ("z", None)], "doc_id string, text string")
    assert sorted((str(r["doc_id"]), r["n_groups"]) for r in alignment.align(df).collect()) == [("None", 1), ("x", 1), ("z", 0)]


def test_a_model_that_is_not_cut_at_spaces(docs, tmp_path):
    """Another normaliser: chunks are not used, and texts that it changes have no tokens."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto.FromString(read_model())
    proto.normalizer_spec.remove_extra_whitespaces = True
    aligner = alignment.Aligner(alignment.read_tokenizer(), proto.SerializeToString())
    table = alignment.Table(aligner)
    assert not aligner.by_chunk and table.parts("two  spaces") == [] and table.parts("one space") != []


def test_empty_table(docs):
    assert alignment.align(docs([])).collect() == []
