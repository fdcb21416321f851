"""SentencePiece encoding and decoding by a distinct-chunk table.

A chunk is a run of whitespace markers with the characters up to the next
marker. When no piece of the vocabulary holds a marker behind another character and the
normaliser only puts a marker first and for each space (both checked when the model is loaded), no merge crosses a
chunk's start, so the segmentation of a text is the concatenation of those of its chunks; any other model encodes whole texts. Each task
segments every distinct chunk once, keeps ids and decoded text in a table of
bounded size, and joins them back by position.

Defined results: null and empty texts have only begin and end ids and decode to
the empty text; repeated rows give repeated rows; other columns are ignored; an
empty table gives an empty table. Texts are processed whole, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_CHUNK = re.compile(" +[^ ]*")
#: Bounds of one task's table: entries, and characters of a chunk worth keeping.
TABLE_ENTRIES = 300_000
TABLE_CHARS = 200
#: Bytes of output gathered before a batch is handed to Spark.
BATCH_BYTES = 4 << 20
_TYPES = {"ids": ("array<int>", pa.list_(pa.int32())), "packed": ("binary", pa.binary()), "decoded": ("string", pa.string())}


class ChunkCodec:
    """Encodes and decodes whole texts through tables of distinct chunks."""

    def __init__(self, model: bytes, entries: int = TABLE_ENTRIES):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        spec = proto.normalizer_spec
        plain = spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap and proto.trainer_spec.model_type == proto.trainer_spec.BPE and not any(p.type == p.USER_DEFINED for p in proto.pieces)
        self.by_chunk = plain and not any(MARK in self.sp.id_to_piece(i).lstrip(MARK) for i in range(self.sp.vocab_size()))
        self.space = self.sp.piece_to_id(MARK)
        self.bos, self.eos = (np.array([i], "<u4").tobytes() for i in (self.sp.bos_id(), self.sp.eos_id()))
        self.entries = entries
        self.table: dict[str, tuple[bytes, str]] = {}

    def _segment(self, chunk: str) -> tuple[bytes, str]:
        ids = self.sp.encode(chunk[1:]) if len(chunk) > 1 else [self.space]
        return np.array(ids, "<u4").tobytes(), " " + self.sp.decode(ids) if len(chunk) > 1 else " "

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Little-endian 32-bit ids with begin and end, and the text they decode to."""
        if not text:
            return self.bos + self.eos, ""
        if not self.by_chunk:
            ids = self.sp.encode(text)
            return self.bos + np.array(ids, "<u4").tobytes() + self.eos, self.sp.decode(ids)
        chunks = _CHUNK.findall(" " + text.replace(MARK, " "))
        if len(self.table) > self.entries:
            self.table.clear()
        table = self.table
        rows = []
        for c in chunks:
            row = table.get(c)
            if row is None:
                row = self._segment(c)
                if len(c) <= TABLE_CHARS:
                    table[c] = row
            rows.append(row)
        packed, decoded = zip(*rows, strict=True)
        return b"".join((self.bos, *packed, self.eos)), "".join(decoded)[1:]

    def decode(self, packed: bytes) -> str:
        return self.sp.decode(np.frombuffer(packed, "<u4").tolist())


def read_model(path: str | None = None) -> bytes:
    """Bytes of a SentencePiece model; they travel with the tasks, not the path."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Path(path).read_bytes()


def encode(docs: DataFrame, model_path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", outputs: Sequence[str] = ("ids", "decoded")) -> DataFrame:
    """``id_col, n_tokens`` and the asked-for outputs of every whole text.

    ``outputs``: ``ids`` (array), ``packed`` (the same as little-endian 32-bit
    integers) and ``decoded``.
    """
    model, names = read_model(model_path), tuple(outputs)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    schema = ", ".join([f"id {id_type}", "n_tokens bigint", *(f"{n} {_TYPES[n][0]}" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChunkCodec(model)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            start, held, rows = 0, 0, []
            for k, text in enumerate(texts):
                rows.append(codec.encode(text.as_py()))
                held += 2 * len(rows[-1][0])
                if held > BATCH_BYTES or k + 1 == len(texts):
                    yield _pack(ids.slice(start, len(rows)), rows, names)
                    start, held, rows = k + 1, 0, []

    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _pack(ids: pa.Array, rows: list[tuple[bytes, str]], names: Sequence[str]) -> pa.RecordBatch:
    lengths = np.array([len(p) // 4 for p, _ in rows], np.int64)
    cols = [ids, pa.array(lengths)]
    for n in names:
        if n == "ids":
            flat = np.frombuffer(b"".join(p for p, _ in rows), "<u4").astype(np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(flat)))
        else:
            cols.append(pa.array([r[n == "decoded"] for r in rows], _TYPES[n][1]))
    return pa.RecordBatch.from_arrays(cols, ["id", "n_tokens", *names])
