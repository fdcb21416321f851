"""Alignment of two tokenizers over the same bytes.

A text with a space before it is cut by a byte-level BPE vocabulary (A) and a SentencePiece vocabulary (B). A two-pointer
merge of both sides' cumulative token ends gives groups, cut where a token of either side ends, and links, the pairs of
tokens that end there. Spark counts linked id pairs over all texts and joins the counts, and whether a count is the highest of
its A or B id, back to each text.

No merge joins two neighbouring characters that stand together in no piece. When the vocabularies are plain enough (checked when
they are loaded), a text's tokens are therefore those of its chunks, cut before white space behind other characters and between a letter or
digit and a mark; each task then cuts and merges each distinct chunk once, and remembers those that several texts have.
Texts travel in blocks of about BLOCK_BYTES: a block holds its distinct pairs once and, for each text, how often it
has which chunk, so a pair is shuffled once a block however often it occurs.

Defined results: null and empty texts, and texts whose joined token bytes on either side differ from space and text, have no
tokens: zeros and an empty digest; a text longer than a block is a block of its own; repeated rows count each; any type of id, null as well, is kept; an
empty table gives an empty table. Tokens of no bytes do not occur in such vocabularies and are refused.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentencepieces import MARK, read_model
from .stage import stage

#: Bytes of text whose pairs are gathered before they are handed to Spark.
BLOCK_BYTES = 8 << 20
#: Chunks beyond which a task forgets, at the end of a block, those that one text alone had.
TABLE_ENTRIES = 400_000
#: Letters and digits that every version of Unicode has as such, and marks that may follow them in a chunk of their own.
_WORD, _MARKS = "0-9A-Za-zÀ-ÖØ-öø-ÿ", "!\"#$%&()*+,./:;<=>?@[\\]^`{|}~-"
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
_MASK = (1 << 32) - 1


def merge(a_sizes: list[int], b_sizes: list[int]) -> list[tuple[int, int]]:
    """Tokens of either side before each common end, by the tokens' sizes."""
    cuts, i, j, n, m = [], 0, 0, len(a_sizes), len(b_sizes)
    a_end, b_end = a_sizes[0] if n else 0, b_sizes[0] if m else 0
    while i < n and j < m:
        if a_end == b_end:
            i, j = i + 1, j + 1
            cuts.append((i, j))
            if i < n and j < m:
                a_end, b_end = a_end + a_sizes[i], b_end + b_sizes[j]
        elif a_end < b_end:
            i += 1
            if i < n:
                a_end += a_sizes[i]
        else:
            j += 1
            if j < m:
                b_end += b_sizes[j]
    return cuts


class Groups(NamedTuple):
    """Aligned tokens of a text or chunk; links as A id in the upper and B id in the lower 32 bits."""

    n_a: int
    n_b: int
    links: list[int]
    written: str


def shown_bytes() -> dict[str, int]:
    """The characters by which byte-level vocabularies show bytes: itself if it is visible, else the next free one from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def read_tokenizer(path: str | None = None) -> bytes:
    """Bytes of a byte-level BPE file; they travel with the tasks, not the path."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Path(path).read_bytes()


class Aligner:
    """Cuts and merges texts of both vocabularies."""

    def __init__(self, a_file: bytes, b_model: bytes):
        import os

        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_buffer(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        shown = shown_bytes()
        entry = lambda t: bytes(shown[c] for c in t) if all(c in shown for c in t) else t.encode()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b"?"] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.a_bytes[i] = entry(t)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace(MARK, " ").encode() for p in pieces]
        self.name = [str(i) for i in range(max(len(self.a_bytes), len(pieces)))]
        if not all(self.a_bytes) or not all(self.b_bytes):
            raise ValueError("a vocabulary has a token without bytes")
        proto = sentencepiece_model_pb2.ModelProto.FromString(b_model)
        spec, normal = proto.normalizer_spec, [p.piece for p in proto.pieces if p.type == p.NORMAL]
        plain = spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces and not spec.precompiled_charsmap and proto.trainer_spec.model_type == proto.trainer_spec.BPE
        alone = not any(p.type == p.USER_DEFINED for p in proto.pieces) and not any(MARK in p.lstrip(MARK) or "\n" in p for p in normal)
        cuts = b'"type":"ByteLevel","add_prefix_space":false' in (packed := re.sub(rb"\s", b"", a_file[:4096])) and b'"use_regex":true' in packed
        self.by_chunk = plain and alone and cuts
        joined = {y for p in normal for x, y in zip(p, p[1:], strict=False) if re.match(f"[{_WORD}]", x)}
        marks = re.escape("".join(m for m in _MARKS if m not in joined))
        # a word with the white space before it up to a cut, or else whatever stands before the next cut
        self.chunk = re.compile(rf"\s*[{_WORD}]++(?=[{marks} \n])|.+?(?:(?<=\S)(?=[ \n])|(?<=[{_WORD}])(?=[{marks}])|\Z)", re.S)
        spec.add_dummy_prefix = False  # a chunk has its own white space
        self.raw = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def _merged(self, source: str, a: list[int], b: list[int]) -> Groups | None:
        """None if either side's bytes are not those of ``source``."""
        raw, left, right = source.encode(), self.a_bytes, self.b_bytes
        x, y = [left[t] for t in a], [right[t] for t in b]
        if b"".join(x) != raw or b"".join(y) != raw:
            return None
        name, words, links, i, j = self.name, [], [], 0, 0
        for u, v in merge([len(t) for t in x], [len(t) for t in y]):
            one = u - i == v - j == 1
            words.append(name[a[i]] + "|" + name[b[j]] if one else ",".join([name[t] for t in a[i:u]]) + "|" + ",".join([name[t] for t in b[j:v]]))
            links.append(a[u - 1] << 32 | b[v - 1])
            i, j = u, v
        return Groups(len(a), len(b), links, ";".join(words))

    def whole(self, text: str) -> Groups | None:
        """The groups of a text without chunks."""
        return self._merged(" " + text, self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text))

    def chunks(self, chunks: list[str]) -> list[Groups | None]:
        """The groups of chunks."""
        a = self.a.encode_batch_fast(chunks, add_special_tokens=False)
        return [self._merged(c, x.ids, y) for c, x, y in zip(chunks, a, map(self.raw.encode, chunks), strict=True)]


class Table:
    """Distinct chunks, by number, with what their groups hold."""

    def __init__(self, aligner: Aligner):
        self.aligner, self.number = aligner, {}
        self.written: list[str] = []
        self.links = array("q")
        self.ends = [0]
        self.sizes = np.zeros((1 << 12, 4), np.int64)  # tokens of A and B, links; texts
        self.bad: set[int] = set()

    def _add(self, keys: list, groups: list[Groups | None]) -> None:
        first = len(self.written)
        while first + len(keys) > len(self.sizes):
            self.sizes = np.concatenate((self.sizes, np.zeros_like(self.sizes)))
        self.number.update(zip(keys, range(first, first + len(keys)), strict=True))
        held = [g or Groups(0, 0, [], "") for g in groups]
        self.bad.update(first + k for k, g in enumerate(groups) if g is None)
        self.written += [g.written for g in held]
        for g in held:
            self.links.extend(g.links)
            self.ends.append(len(self.links))
        if held:
            self.sizes[first : first + len(held)] = [(g.n_a, g.n_b, len(g.links), 0) for g in held]

    def links_of(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many links each part has, and these one after the other."""
        ends = np.array(self.ends, np.int64)
        start, size = ends[parts], ends[parts + 1] - ends[parts]
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return size, np.array(self.links, np.int64)[at]

    def parts(self, text: str | None) -> list[int]:
        """Numbers of what the text consists of; none if it has no tokens."""
        if not text:
            return []
        if self.aligner.by_chunk:
            chunks = self.aligner.chunk.findall(" " + text)
            number = self.number
            try:
                found = [number[c] for c in chunks]
            except KeyError:
                new = [c for c in dict.fromkeys(chunks) if c not in number]
                self._add(new, self.aligner.chunks(new))
                found = [number[c] for c in chunks]
            if not self.bad or self.bad.isdisjoint(found):
                return found
        key = (text,)  # unlike any chunk
        if key not in self.number:
            self._add([key], [self.aligner.whole(text)])
        k = self.number[key]
        return [] if k in self.bad else [k]

    def shrunk(self) -> "Table":
        """A table of what several texts had, at most half of TABLE_ENTRIES."""
        texts = self.sizes[: len(self.written), 3]
        keep = np.nonzero(texts > 1)[0]
        keep = set(keep[np.argsort(-texts[keep], kind="stable")[: TABLE_ENTRIES // 2]].tolist())
        out = Table(self.aligner)
        some = [(key, k) for key, k in self.number.items() if k in keep]
        groups = [None if k in self.bad else Groups(*self.sizes[k, :2].tolist(), self.links[self.ends[k] : self.ends[k + 1]].tolist(), self.written[k]) for _, k in some]
        out._add([key for key, _ in some], groups)
        return out


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as they need; the first byte tells how many."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.int64)


#: A block: ids and figures of its texts, then what only tasks read (bags of chunks, links of chunks), then its pairs.
_BLOCK = "block bigint, ids array<{}>, n_a array<bigint>, n_b array<bigint>, n_links array<bigint>, digest array<string>, bag_sizes binary, bag binary, times binary, link_sizes binary, link_pairs binary, pairs array<bigint>, counts array<bigint>"


def _block(number: int, ids: list[pa.Array], bags: list[tuple[np.ndarray, np.ndarray]], stats: list[tuple], table: Table) -> pa.RecordBatch:
    sizes = np.array([len(b) for b, _ in bags], np.int64)
    bag, times = (np.concatenate([np.zeros(0, np.int64), *(b[k] for b in bags)]) for k in (0, 1))
    used, local = np.unique(bag, return_inverse=True)
    link_sizes, links = table.links_of(used)
    pairs, place = np.unique(links, return_inverse=True)
    total = np.zeros(len(used), np.int64)
    np.add.at(total, local, times)
    counts = np.zeros(len(pairs), np.int64)
    np.add.at(counts, place, np.repeat(total, link_sizes))
    lists = [pa.array([[s[k] for s in stats]], pa.list_(t)) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
    every = pa.concat_arrays(ids)
    binary = [pa.array([_narrow(v)], pa.binary()) for v in (sizes, local, times, link_sizes, place)]
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every), *lists, *binary, pa.array([pairs], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))],
        [c.split(" ")[0] for c in _BLOCK.split(", ")],
    )


def blocks(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts cut, merged and gathered in blocks, the input of :func:`pair_counts` and :func:`figures`; to be staged."""
    a_file, b_model = read_tokenizer(a_path), read_model(b_path)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from pyspark import TaskContext

        aligner = Aligner(a_file, b_model)
        table, number = Table(aligner), TaskContext.get().partitionId() << 32
        ids, bags, stats, size = [], [], [], 0
        for batch in batches:
            for k, text in enumerate(batch.column(1)):
                text = text.as_py()
                parts = table.parts(text)
                at = np.array(parts, np.int64)
                digest = hashlib.sha256(";".join([table.written[p] for p in parts]).encode()).hexdigest() if parts else ""
                ids.append(batch.column(0).slice(k, 1))
                bags.append(np.unique(at, return_counts=True))
                stats.append((*table.sizes[at, :3].sum(0).tolist(), digest))
                table.sizes[bags[-1][0], 3] += 1
                size += len(text or "") + 64
                if size > BLOCK_BYTES:
                    yield _block(number, ids, bags, stats, table)
                    ids, bags, stats, size, number = [], [], [], 0, number + 1
                    if len(table.number) > TABLE_ENTRIES:
                        table = table.shrunk()
        if ids:
            yield _block(number, ids, bags, stats, table)

    return src.mapInArrow(run, _BLOCK.format(src.schema["id"].dataType.simpleString()))


def pair_counts(held: DataFrame) -> DataFrame:
    """``(pair, a, b, count, best_of_a, best_of_b)`` over all blocks: how many links an id pair has, and whether no other of its A or B id has more."""
    each = held.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("p.pairs", "p.counts")
    counts = stage(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("count")), "alignment-counts")
    named = counts.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(_MASK)).cast("int").alias("b"), "count")
    # as many rows as a vocabulary has entries
    for side in "ab":
        most = named.groupBy(side).agg(F.max("count").alias(f"most_of_{side}"))
        named = named.join(F.broadcast(most), side).withColumn(f"best_of_{side}", F.col("count") == F.col(f"most_of_{side}"))
    return named.select("pair", "a", "b", "count", "best_of_a", "best_of_b")


def _finished(held: pa.Table, counted: pa.Table) -> pa.Table:
    """One row for each text of a block, with the sums over its links."""
    bag_sizes, bag, times, link_sizes, link_pairs = (_wide(held.column(n)[0].as_py()) for n in ("bag_sizes", "bag", "times", "link_sizes", "link_pairs"))
    pair = np.zeros((3, counted.num_rows), np.int64)  # count, best of a, best of b
    at = counted.column("place").to_numpy()
    for k, name in enumerate(("count", "best_of_a", "best_of_b")):
        pair[k, at] = counted.column(name).to_numpy(zero_copy_only=False)

    def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        total = np.concatenate((np.zeros((len(values), 1), np.int64), np.cumsum(values, 1)), 1)  # may wrap, differences don't
        ends = np.cumsum(sizes)
        return total[:, ends] - total[:, ends - sizes]

    chunk = summed(pair[:, link_pairs], link_sizes)
    text = summed(chunk[:, bag] * times, bag_sizes)
    flat = [held.column(n).combine_chunks().flatten() for n in ("ids", "n_a", "n_b", "n_links", "digest")]
    return pa.Table.from_arrays([*flat, *(pa.array(v) for v in text)], names=["id", "n_a", "n_b", "n_links", "groups_sha256", "count_sum", "n_best_a", "n_best"])


def figures(held: DataFrame, counts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each text: tokens, groups, links, digest of its groups, and sums over its links."""
    wanted = held.select(F.col("block").alias("of"), F.posexplode("pairs").alias("place", "pair")).join(counts.select("pair", "count", "best_of_a", "best_of_b"), "pair")
    kind = held.schema["ids"].dataType.elementType.simpleString()
    out = held.drop("pairs", "counts").groupBy("block").cogroup(wanted.groupBy("of"))
    rows = out.applyInArrow(_finished, f"id {kind}, n_a bigint, n_b bigint, n_links bigint, groups_sha256 string, count_sum bigint, n_best_a bigint, n_best bigint")
    return rows.select(F.col("id").alias(id_col), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "n_best_a", "count_sum", "groups_sha256")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`figures` of every text of ``docs``."""
    held = stage(blocks(docs, a_path, b_path, id_col=id_col, text_col=text_col), "alignment-blocks")
    return figures(held, stage(pair_counts(held), "alignment-pairs"), id_col)


def groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ordinal, a_ids, b_ids)``: the groups themselves."""
    a_file, b_model = read_tokenizer(a_path), read_model(b_path)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(Aligner(a_file, b_model))
        for batch in batches:
            for k, text in enumerate(batch.column(1)):
                written = ";".join([table.written[p] for p in table.parts(text.as_py())])
                sides = [g.split("|") for g in written.split(";")] if written else []
                if len(table.number) > TABLE_ENTRIES:
                    table = Table(table.aligner)
                for start in range(0, len(sides), 1 << 16):
                    some = sides[start : start + (1 << 16)]
                    ids = [pa.array([[int(i) for i in s[side].split(",")] for s in some], pa.list_(pa.int32())) for side in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column(0).slice(k, 1)] * len(some)), pa.array(np.arange(start, start + len(some)), pa.int64()), *ids], ["id", "ordinal", "a_ids", "b_ids"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, ordinal bigint, a_ids array<int>, b_ids array<int>").withColumnRenamed("id", id_col)
