"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into overlapping passages of PASSAGE words, TF-IDF vectors over
hashed words with the frequencies of all words of the corpus. A randomised SVD,
whose products with all passages of the corpus are summed over partitions, gives a latent
basis over the items' words and those that stand with them in its passages. An item's vector is its own with LATENT of its projection on that basis,
so a passage may come near to an item by words that the item lacks. Every passage of every text is
compared with every item by cosine, and if an item is longer than a passage also
with each passage of the item. Items of less than WHOLE words are also sought in
passages of about twice their length, where other words do not outweigh them.

No passage can reach a cosine over what its words add to any item at most, which prunes most passages without loss. Passages at COSINE or more
are checked exactly: the longest common subsequence of words with the item, and the
item's answer (without an answer column its last sentence, or last clause if it is one sentence, of at least
ANSWER_WORDS words and at most half of the item). COSINE is low enough
for items whose rarest words are replaced; what else it lets through fails the check.

Defined results: null and wordless texts and items match nothing; very long texts
are searched whole; items of less than SHORT words must be found whole, word by word, as a few common
words in order mean nothing; of equal matches of an item in a text the highest cosine,
then share, is reported; a null id is reported with its matches; repeated rows are
reported alike; an empty benchmark or corpus gives an empty result; other columns are
ignored. Items are searched in blocks whose tables have a fixed size, so nothing that
is sent to tasks grows with the corpus, and blocks are searched in rounds if the
benchmark is large.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stage import drop_stage, stage
from .tokens import blocks, word_hashes

PASSAGE, STRIDE = 32, 16
#: Hashed words, probes of a block, latent dimensions, blocks of a round.
BITS, BLOCK_ITEMS, LATENT_DIMS, ROUND_BLOCKS = 17, 240, 32, 16
#: Words of a block's basis beyond those of its items: those that stand with them most.
NEIGHBOURS = 512
#: Groups of probes whose bounds prune passages, first over running sums and then passage by passage.
GROUPS = (8, 32)
#: Weight of an item's latent projection beside its own vector.
LATENT = 0.5
#: Least cosine of a candidate; least shares of an item's words in order, alone and with its answer; least share of the answer.
COSINE, LCS_ALONE, LCS, ANSWER = 0.25, 0.8, 0.6, 0.4
#: Words that an item's end needs to serve as its answer.
ANSWER_WORDS = 8
#: Words, and passages, that a task of the fit works on at once.
FIT_WORDS, FIT_PASSAGES = 1 << 17, 8192
#: Below so many words an item must be found whole.
SHORT = 8
#: Shorter items are sought in passages of fitting width as well.
WHOLE = 9
_SENTENCE, _CLAUSE = (re.compile(rf"[^{c}\n]*[^{c}\s][{c}\n\s]*$") for c in (".!?", ".!?,;:"))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Item:
    item_id: object
    words: np.ndarray
    answer: np.ndarray
    number: int = 0


@dataclass
class Block:
    """One block of probes (items and passages of long ones): rows of ``folded`` by bucket, the basis times
    the probes' latent unit vectors times the word's weight (a passage's sum of rows, over
    its norm, holds its cosines), the most that a word adds to any of them, the width of the
    passages they are compared with and the place in ``items`` of each probe's item."""

    items: list[Item]
    row: np.ndarray
    folded: np.ndarray
    reach: np.ndarray
    width: int = PASSAGE
    owner: np.ndarray | None = None
    #: The most that a word adds to any probe of a group, for few and for more groups; the last row is of unknown words.
    bounds: list[np.ndarray] = field(init=False)
    #: The same for every probe.
    high: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        high, n = np.maximum(self.folded, 0), self.folded.shape[1]
        self.high = np.vstack([high, np.zeros((1, n))]).astype(np.float32)
        parts = [np.array_split(np.arange(n), min(g, n)) for g in GROUPS]
        self.bounds = [np.vstack([np.stack([high[:, k].max(1) for k in cols], 1), np.zeros((1, len(cols)))]).astype(np.float32) for cols in parts]


def lcs_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict[int, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = where.get(y)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def passages(counts: np.ndarray, width: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and end of the passages of consecutive texts with these numbers of words."""
    stride = width * STRIDE // PASSAGE
    begin = np.cumsum(counts) - counts
    n = np.where(counts > 0, np.maximum(1, -(-(counts - width) // stride) + 1), 0)
    text = np.repeat(np.arange(len(counts)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = begin[text] + k * stride
    return text, start, np.minimum(start + width, begin[text] + counts[text])


def _counted(bucket: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, bucket and count of the distinct words of each group."""
    pairs, n = np.unique(group << BITS | bucket, return_counts=True)
    return pairs >> BITS, pairs & ((1 << BITS) - 1), n


def corpus_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The hashed words of every text, one row each: all that the weights and the basis are fitted on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in blocks(batch.column(0)):
                hashes, counts = word_hashes(texts)
                held = np.split(_bucket(hashes).astype(np.uint32), np.cumsum(counts)[:-1])
                yield pa.RecordBatch.from_arrays([pa.array([w.tobytes() for w in held], pa.binary())], ["words"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "words binary")


def _sample(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """:func:`corpus_words` by the name that tests call: nothing is sampled, and no query comes here."""
    return corpus_words(docs, text_col)


def _weights(words: DataFrame) -> np.ndarray:
    """Inverse frequencies of the hashed words over all texts; a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for bucket, _ in _gathered(batch.column(0)):
                total += np.bincount(bucket, minlength=1 << BITS)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    rows = words.mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(1 << BITS)
    n[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return np.log1p(max(1.0, n.sum()) / (n + 1)).astype(np.float64)


def word_weights(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    return _weights(corpus_words(docs, text_col))


def _gathered(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the words of consecutive texts, about FIT_WORDS at a time, and the texts' numbers of words."""
    held, size = [], 0
    for k, text in enumerate(column, 1):
        held.append(np.frombuffer(text.as_buffer(), np.uint32))
        size += len(held[-1])
        if size and (size >= FIT_WORDS or k == len(column)):
            yield np.concatenate(held), np.array([len(h) for h in held])
            held, size = [], 0


def _halves(start: np.ndarray, end: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the first half of each of these consecutive passages, whose second half is the next one, and first word and end of the halves."""
    last = np.append(start[1:] >= end[:-1], np.ones(min(1, len(start)), bool))
    half = np.arange(len(start)) + np.cumsum(last) - last
    begin, stop = np.empty((2, len(start) + last.sum()), np.int64)
    begin[half], stop[half] = start, np.minimum(start + stride, end)
    begin[half[last] + 1], stop[half[last] + 1] = stop[half[last]], end[last]
    return half, begin, stop


def _half_sums(table: np.ndarray, row: np.ndarray, begin: np.ndarray, stop: np.ndarray, stride: int) -> np.ndarray:
    """Sums of the table's rows over the words of each half; the last of ``row`` is that of no word, whose row is zero."""
    out = np.zeros((len(begin), table.shape[1]), table.dtype)
    for k in range(stride):
        out += table[row[np.where(begin + k < stop, begin + k, len(row) - 1)]]
    return out


def _runs(bucket: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each passage in order, filled up with 1 << BITS, and where each distinct one begins in them, with its count."""
    at = start[:, None] + np.arange(width)
    words = np.where(at < end[:, None], bucket[np.minimum(at, len(bucket) - 1)], 1 << BITS).astype(np.int32)
    words.sort(axis=1)
    flat = words.ravel()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[::width] = True
    at = np.nonzero(new)[0]
    return words, at, np.diff(np.append(at, len(flat)))


def _repeated(bucket: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage, bucket and count of the words that a passage holds several times."""
    words, at, n = _runs(bucket, start, end, PASSAGE)
    many = n > 1
    at, n = at[many], n[many]
    b = words.ravel()[at]
    own = b < 1 << BITS
    return at[own] // PASSAGE, b[own], n[own]


def _sparse(held: list[np.ndarray], row: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of A: unit TF-IDF vectors, restricted to the columns of the basis."""
    size = np.array([len(h) for h in held])
    words = _bucket(np.concatenate([*held, np.zeros(0, np.uint64)]))
    g, b, n = _counted(words, np.repeat(np.arange(len(held)), size))
    w = np.sqrt(n) * idf[b]
    norm = np.sqrt(np.bincount(g, w * w, len(held)))
    ok = row[b] >= 0
    return g[ok], row[b[ok]], w[ok] / norm[g[ok]]


def _sums(into: np.ndarray, at: np.ndarray, rows: np.ndarray, of: np.ndarray) -> None:
    """Add the rows with the numbers ``of`` to the rows of ``into`` at these places; both may repeat."""
    if into.shape[1] <= 16:
        for k in range(into.shape[1]):
            into[:, k] += np.bincount(at, rows[of, k], len(into))
    elif len(at):
        at = at.astype(np.min_scalar_type(len(into)))
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.nonzero(np.append(True, at[1:] != at[:-1]))[0]
        into[at[first]] += np.add.reduceat(rows[of[order]], first, axis=0)


def _outer(totals: list[np.ndarray], tables: list[tuple[np.ndarray, np.ndarray]], bucket: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> None:
    """Add A'(AX) of the passages of these texts to the totals; a table is X, its rows by bucket (-1: none) before it.

    Passages overlap by halves, so sums are made by half; words that a passage repeats are set right apart.
    """
    square = np.concatenate(([0], np.cumsum(idf[bucket] ** 2)))
    _, start, end = passages(counts)
    for k in range(0, len(start), FIT_PASSAGES):
        s, e = start[k : k + FIT_PASSAGES], end[k : k + FIT_PASSAGES]
        low, own = s[0], bucket[s[0] : e[-1]]
        half, begin, stop = _halves(s - low, e - low, STRIDE)
        g, b, n = _repeated(own, s - low, e - low)
        more, inside = idf[b] * (np.sqrt(n) - n), np.repeat(np.arange(len(begin)), stop - begin)
        norm = (square[e] - square[s])[:, None].astype(np.float32)
        for total, (row, x) in zip(totals, tables, strict=True):
            at, known = np.append(row[own], -1), row[b] >= 0
            col, part, of = row[b[known]], more[known][:, None].astype(np.float32), g[known]
            sums = _half_sums(x, at, begin, stop, STRIDE)
            ax = sums[half] + sums[half + 1]
            if len(of):
                first = np.nonzero(np.diff(of, prepend=-1))[0]
                extra = x[col]
                extra *= part / idf[b[known]][:, None].astype(np.float32)
                ax[of[first]] += np.add.reduceat(extra, first, axis=0)
            ax /= norm
            sums[:] = 0
            sums[half] = ax
            sums[half + 1] += ax
            ok, out = at[:-1] >= 0, np.zeros(total.shape)
            _sums(out, at[:-1][ok], sums, inside[ok])
            total += out * idf[row >= 0][:, None]
            extra = ax[of]
            extra *= part
            _sums(total, col, extra, np.arange(len(of)))


def _products(words: DataFrame, idf: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """A'(AX) over all passages of the corpus for each table of ``_outer``, summed over partitions."""
    tables = [(row, np.vstack([x * idf[row >= 0][:, None], np.zeros((1, x.shape[1]))]).astype(np.float32)) for row, x in tables]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(x) - 1, x.shape[1])) for _, x in tables]
        for batch in batches:
            for bucket, counts in _gathered(batch.column(0)):
                _outer(totals, tables, bucket.astype(np.int64), counts, idf)
        for k, total in enumerate(totals):
            at = np.nonzero(total.any(1))[0]
            for some in np.array_split(at, -(-len(at) // 8192)) if len(at) else []:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), pa.array(list(total[some]), pa.list_(pa.float64()))], ["k", "i", "sums"])

    most = max(x.shape[1] for _, x in tables)
    added = words.mapInArrow(run, "k int, i int, sums array<double>").groupBy("k", "i").agg(*[F.sum(F.get("sums", F.lit(c))).alias(f"c{c}") for c in range(most)]).toArrow()
    k, i = added.column("k").to_numpy(), added.column("i").to_numpy()
    out = []
    for n, (_, x) in enumerate(tables):
        y = np.zeros((len(x) - 1, x.shape[1]))
        mine = k == n
        for c in range(x.shape[1]):
            y[i[mine], c] = added.column(f"c{c}").to_numpy()[mine]
        out.append(y)
    return out


def probes(items: list[Item]) -> list[tuple[Item, np.ndarray, int]]:
    """Item, words and width of passage of all that texts are compared with."""
    out = []
    for item in items:
        n = len(item.words)
        out.append((item, item.words, PASSAGE))
        if n > PASSAGE:
            _, start, end = passages(np.array([n]))
            out += [(item, item.words[s:e], PASSAGE) for s, e in zip(start, end, strict=True)]
        elif n < WHOLE:
            out.append((item, item.words, 2 << (n - 1).bit_length()))
    return sorted(out, key=lambda p: -p[2])


def probe_blocks(items: list[Item]) -> Iterator[list[tuple[Item, np.ndarray, int]]]:
    """At most BLOCK_ITEMS probes of one width at a time."""
    for _, same in groupby(probes(items), key=lambda p: p[2]):
        held = list(same)
        yield from (held[k : k + BLOCK_ITEMS] for k in range(0, len(held), BLOCK_ITEMS))


def fit_probes(found: list[list[tuple[Item, np.ndarray, int]]], words: DataFrame, n_texts: int, idf: np.ndarray) -> list[Block]:
    """The blocks of these lists of probes, fitted together."""
    fitted, out = fit_blocks([[Item(i.item_id, w, i.answer) for i, w, _ in some] for some in found], words, n_texts, idf), []
    for some, block in zip(found, fitted, strict=True):
        own = {item.number: item for item, *_ in some}
        place = {number: k for k, number in enumerate(own)}
        out.append(Block(list(own.values()), block.row, block.folded, block.reach, some[0][2], np.array([place[i.number] for i, *_ in some])))
    return out


def _rows_of(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """These distinct buckets, and the rows by bucket of tables about them."""
    row = np.full(1 << BITS, -1, np.int32)
    row[buckets] = np.arange(len(buckets))
    return buckets, row


def fit_block(items: list[Item], words: DataFrame, n_texts: int, idf: np.ndarray) -> Block:
    return fit_blocks([items], words, n_texts, idf)[0]


def fit_blocks(found: list[list[Item]], words: DataFrame, n_texts: int, idf: np.ndarray) -> list[Block]:
    """One basis for all these blocks by a randomised SVD, whose products are distributed sums over all passages of the
    corpus: one finds each block's neighbours (words with the largest sums of products of weights with the items'), one
    takes random mixtures of the items to y; the basis has the leading eigenvectors of y (x'y)^-1 y'."""
    known = [np.unique(np.concatenate([_bucket(i.words) for i in items])) for items in found]
    mine = np.zeros((1 << BITS, len(found)))
    for n, k in enumerate(known):
        mine[k, n] = 1
    near = _products(words, idf, [(np.arange(1 << BITS, dtype=np.int32), mine)])[0]
    for n, k in enumerate(known):
        gain = np.round(near[:, n] * (mine[:, n] == 0), 9)
        order = np.lexsort((np.arange(1 << BITS), -gain))[:NEIGHBOURS]
        known[n] = np.unique(np.concatenate((k, order[gain[order] > 0])))
    wide, row = _rows_of(np.unique(np.concatenate(known)))
    at, col, w = _sparse([i.words for items in found for i in items], row, idf)
    mixed = np.random.default_rng(1).normal(size=(at[-1] + 1, min(len(wide), LATENT_DIMS)))
    begun = np.zeros((len(wide), mixed.shape[1]))
    np.add.at(begun, col, mixed[at] * w[:, None])
    if np.linalg.matrix_rank(begun) < begun.shape[1]:  # fewer items than dimensions
        begun += np.random.default_rng(2).normal(0, 0.01, begun.shape)
    begun = np.linalg.qr(begun)[0]
    y = _products(words, idf, [(row, begun)])[0] / max(1, n_texts)
    values, turn = np.linalg.eigh((begun.T @ y + y.T @ begun) / 2)
    ok = values > max(1e-9, 1e-9 * values.max(initial=0))
    basis, size, _ = np.linalg.svd((y @ turn[:, ok]) / np.sqrt(values[ok]), full_matrices=False)
    basis = basis[:, size**2 > 1e-9]
    return [_folded(items, k, basis[np.searchsorted(wide, k)], idf) for items, k in zip(found, known, strict=True)]


def _folded(items: list[Item], known: np.ndarray, basis: np.ndarray, idf: np.ndarray) -> Block:
    _, row = _rows_of(known)
    own = np.zeros((len(items), len(known)))
    at, col, w = _sparse([i.words for i in items], row, idf)
    own[at, col] = w
    latent = own + LATENT * (own @ basis) @ basis.T
    latent /= np.maximum(np.sqrt((latent**2).sum(1)), 1e-12)[:, None]
    reach = np.zeros(1 << BITS)
    folded = idf[known][:, None] * latent.T
    reach[known] = np.abs(folded).max(1)
    return Block(items, row, folded.astype(np.float32), reach)


def candidates(block: Block, bucket: np.ndarray, start: np.ndarray, end: np.ndarray, idf: np.ndarray, square: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages, probes and cosines at ``least`` or more. ``square``: running sums of squared weights."""
    norm, row = np.sqrt(square[end] - square[start]), np.append(block.row[bucket], np.int32(-1))
    # three bounds, each dearer and closer than the one before; a factor for rounding
    most = np.concatenate(([0], np.cumsum(block.reach[bucket])))
    may = np.nonzero((most[end] - most[start]) * (1 + 1e-5) >= least * norm)[0]
    if len(may):
        stride = block.width * STRIDE // PASSAGE
        half, begin, stop = _halves(start, end, stride)
        for bound in block.bounds:  # sums by half passage, of the halves in question
            use = np.zeros(len(begin), bool)
            use[half[may]] = use[half[may] + 1] = True
            place = np.cumsum(use) - 1
            sums = _half_sums(bound, row, begin[use], stop[use], stride)
            may = may[(sums[place[half[may]]] + sums[place[half[may] + 1]]).max(1) * (1 + 1e-5) >= least * norm[may]]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    known = np.append(block.row, np.int32(-1))
    for k in range(0, len(may), 2048):
        some = may[k : k + 2048]
        use = np.zeros(len(begin), bool)
        use[half[some]] = use[half[some] + 1] = True
        place = np.cumsum(use) - 1
        sums = _half_sums(block.high, row, begin[use], stop[use], stride)
        p, i = np.nonzero((sums[place[half[some]]] + sums[place[half[some] + 1]]) * (1 + 1e-5) >= least * norm[some, None])
        if not len(p):
            continue
        some, p = np.unique(some[p], return_inverse=True)
        words, at, n = _runs(bucket, start[some], end[some], block.width)
        tf = np.zeros(words.shape, np.float32)
        tf.ravel()[at] = np.sqrt(n)
        at = known[words]
        tf[at < 0] = 0
        cos = (block.folded[at[p], i[:, None]] * tf[p]).sum(1) / np.sqrt(np.maximum(square[end[some]] - square[start[some]], 1e-12))[p].astype(np.float32)
        ok = cos >= least
        found.append((some[p[ok]], i[ok], cos[ok].astype(float)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _regions(text: np.ndarray, start: np.ndarray, end: np.ndarray, item: np.ndarray, cos: np.ndarray, reach: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """Candidate passages of a text and item that nearly touch, widened by the item's length."""
    out: list[tuple[int, int, int, int, float]] = []
    for k in np.lexsort((start, item, text)).tolist():
        t, i = int(text[k]), int(item[k])
        lo, hi = max(int(begin[t]), int(start[k] - reach[i])), min(int(stop[t]), int(end[k] + reach[i]))
        if out and out[-1][:2] == (t, i) and lo <= out[-1][3]:
            out[-1] = (t, i, out[-1][2], hi, max(out[-1][4], float(cos[k])))
        else:
            out.append((t, i, lo, hi, float(cos[k])))
    return out


def verified(item: Item, region: np.ndarray) -> tuple[float, float, bool]:
    """Shares of the item's and of the answer's words found in order, and the decision.

    The region is read in windows of twice the item's length, so far-apart words do not add up.
    """
    if len(item.words) < SHORT and len(region) >= len(item.words):
        runs = np.lib.stride_tricks.sliding_window_view(region, len(item.words))
        if (runs == item.words).all(1).any():
            return 1.0, 1.0, True
    words, answer, width = item.words.tolist(), item.answer.tolist(), max(PASSAGE, 2 * len(item.words))
    best, best_answer, hit = 0.0, 0.0, False
    for k in range(0, max(1, len(region) - width + width // 2), max(1, width // 2)):
        part = region[k : k + width].tolist()
        share, told = lcs_length(words, part) / len(words), lcs_length(answer, part) / max(1, len(answer))
        ok = len(words) >= SHORT and (share >= LCS_ALONE or share >= LCS and told >= ANSWER)
        if (ok, share, told) > (hit, best, best_answer):
            best, best_answer, hit = share, told, ok
    return best, best_answer, hit


def _hits(found: list[Block], idf: np.ndarray, least: float, texts: list[bytes]) -> Iterator[tuple[int, object, float, float, float]]:
    """``(text, item, cosine, share, answer's share)`` of every item found in these texts."""
    hashes, counts = word_hashes(texts)
    if not len(hashes):
        return
    bucket = _bucket(hashes)
    square = np.concatenate(([0], np.cumsum(idf[bucket] ** 2)))
    stop = np.cumsum(counts)
    best: dict[tuple[int, int], tuple] = {}
    for block in found:
        text, start, end = passages(counts, block.width)
        p, i, cos = candidates(block, bucket, start, end, idf, square, least)
        i = i if block.owner is None else block.owner[i]
        reach = np.array([len(x.words) for x in block.items])
        for t, j, lo, hi, c in _regions(text[p], start[p], end[p], i, cos, reach, stop - counts, stop):
            item = block.items[j]
            share, told, hit = verified(item, hashes[lo:hi])
            if hit and ((t, item.number) not in best or (c, share) > best[t, item.number][1:3]):
                best[t, item.number] = (item.item_id, c, share, told)
    for (t, _), v in sorted(best.items(), key=lambda x: x[0]):
        yield t, *v


def _search(found: list[Block], idf: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(base + t, *v) for base, texts in blocks(batch.column(1)) for t, *v in _hits(found, idf, least, texts)]
            if rows:
                at, item, cos, share, told = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(item), pa.array(cos), pa.array(share), pa.array(told)], ["id", "item_id", "cosine", "lcs_share", "answer_share"])

    return run


def _words(text: str) -> np.ndarray:
    return word_hashes([text.lower().encode("utf-8", "replace")])[0]


def _end(text: str, words: np.ndarray) -> np.ndarray:
    """The words that stand for an item's answer."""
    n = len(words)
    for pattern in (_SENTENCE, _CLAUSE):
        found = pattern.search(text)
        size = len(_words(found[0])) if found else n
        if size < n:
            break
    return words[n - min(max(size, ANSWER_WORDS), -(-n // 2)) :]


def _items(rows: list, answers: bool) -> list[Item]:
    words = [_words(r["text"] or "") for r in rows]
    told = [_words(r["answer"] or "") if answers else _end(r["text"] or "", w) for r, w in zip(rows, words, strict=True)]
    return [Item(r["item_id"], w, a, k) for k, (r, w, a) in enumerate(zip(rows, words, told, strict=True)) if len(w)]


def _rounds(src: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, answer_col: str | None) -> Iterator[tuple[list[Block], np.ndarray]]:
    """Blocks of items with their word weights, as many at a time as the driver and the tasks hold."""
    wanted = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"), (F.col(answer_col) if answer_col else F.lit(None)).cast("string").alias("answer"))
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\s\p{Punct}]+"))
    held = wanted.select(F.count("*"), F.sum(F.when(n > PASSAGE, 2 + n / STRIDE).otherwise(F.when(n < WHOLE, 2).otherwise(1)))).first()
    if not held[0]:
        return
    rounds = -(-int(held[1]) // (BLOCK_ITEMS * ROUND_BLOCKS))
    words = stage(corpus_words(src), "decontaminate-words")
    idf, n_texts = _weights(words), words.count()
    for r in range(rounds):  # BLOCK_ITEMS * ROUND_BLOCKS probes a round on average
        rows = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == r).orderBy("item_id", "text").collect()
        items = _items(rows, answer_col is not None)
        yield fit_probes(list(probe_blocks(items)), words, n_texts, idf), idf
    drop_stage(words)


def matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, least: float = COSINE) -> DataFrame:
    """``(id_col, item_id, cosine, lcs_share, answer_share)`` of each text that holds an item, and the item."""
    spark: SparkSession = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {src.schema['id'].dataType.simpleString()}, item_id {benchmark.schema[item_col].dataType.simpleString()}, cosine double, lcs_share double, answer_share double"
    out = None
    for found, idf in _rounds(src, benchmark, item_col, item_text_col, answer_col):
        part = src.mapInArrow(_search(found, idf, least), schema)
        out = part if out is None else out.unionByName(part)
    return (spark.createDataFrame([], schema) if out is None else out).withColumnRenamed("id", id_col)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, least: float = COSINE) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, all columns kept. Decided row by row: no join, no shuffle."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for found, idf in _rounds(src, benchmark, item_col, item_text_col, answer_col):
        docs = docs.filter(~_flag(found, idf, least)(F.col(text_col)))
    return docs


def _flag(found: list[Block], idf: np.ndarray, least: float):
    @F.arrow_udf("boolean")
    def holds_item(column: pa.Array) -> pa.Array:
        out = np.zeros(len(column), bool)
        for base, texts in blocks(column):
            for t, *_ in _hits(found, idf, least, texts):
                out[base + t] = True
        return pa.array(out)

    return holds_item
