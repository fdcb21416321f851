import hashlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from clausewright.llm import sentencepieces

MODEL = sentencepieces.read_model()
SP = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
CODEC = sentencepieces.ChunkCodec(MODEL, entries=50)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab  \n\t▁éß漢🙂\x00.1") | st.characters(codec="utf-8"), max_size=60))
def test_codec_equals_library(text):
    packed, decoded = CODEC.encode(text)
    ids = SP.encode(text, add_bos=True, add_eos=True)
    assert np.frombuffer(packed, "<u4").tolist() == ids
    assert decoded == SP.decode(ids) == CODEC.decode(packed)


def test_without_chunks_the_library_decides():
    codec = sentencepieces.ChunkCodec(MODEL)
    codec.by_chunk = False
    assert codec.encode(" two  words ") == CODEC.encode(" two  words ")


def test_operator_on_odd_rows(spark, docs, odd):
    rows = sentencepieces.encode(docs(odd), outputs=("ids", "packed", "decoded")).collect()
    assert len(rows) == len(odd)
    expected = sorted((str(i), SP.encode(t or "", add_bos=True, add_eos=True)) for i, t in odd)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in rows) == expected
    for r in rows:
        assert r["n_tokens"] == len(r["ids"]) == len(r["packed"]) // 4
        assert r["decoded"] == SP.decode(r["ids"])


@pytest.mark.parametrize("name", ["op7_sentencepiece"])
def test_query_digests(spark, docs, odd, tmp_path, name):
    from clausewright.llm.queries import queries

    docs(odd).write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries()[name](spark, str(tmp_path)).collect():
        texts = {i: t for i, t in odd}
        ids = SP.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(SP.decode(ids).encode()).hexdigest()


def test_empty_table(docs):
    assert sentencepieces.encode(docs([])).collect() == []


@pytest.mark.parametrize("change", [{"remove_extra_whitespaces": True}, {"add_dummy_prefix": False}, {"escape_whitespaces": False}])
def test_other_normalisers_encode_whole_texts(change):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto.FromString(MODEL)
    for name, value in change.items():
        setattr(proto.normalizer_spec, name, value)
    model = proto.SerializeToString()
    codec, sp = sentencepieces.ChunkCodec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    assert not codec.by_chunk
    for text in ("ab ", "  two  words", "one", "a\nb "):
        packed, decoded = codec.encode(text)
        ids = sp.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(packed, "<u4").tolist() == ids and decoded == sp.decode(ids)
