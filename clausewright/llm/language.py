"""Language identification by averaged hashed subword embeddings.

A text's features are the counts of its byte n-grams inside words, word borders
included, hashed to BUCKETS. Their embeddings are averaged and a linear softmax
scores the languages. Both layers are trained by stochastic gradient descent in
numpy on a bounded sample; features have unit length and gradients a bounded
norm, so no sample can make the steps diverge, and a model with a weight that is
not finite is an error. Temperature and rejection threshold are fitted on a part
of the sample that training does not see: its whole texts, short pieces of them,
and pieces with shuffled letters, which no language should claim.

Defined results: a null text and one without a letter (Unicode category L) give
``und`` with score 0; without any labelled text, as in an empty table, every
prediction is ``und`` with score 0; ties of probability go to the
alphabetically first language; repeated rows are predicted alike; null languages
are not learned; other columns are ignored. Texts are read whole, however long;
only the training sample leaves out texts over ``max_chars``. ``rejected`` marks
predictions below the calibrated threshold and never changes the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import fold
from .tokens import blocks

BUCKETS, DIM = 1 << 12, 16
GRAMS = (2, 3, 4)
#: The bound of the training sample in documents, and of a text that is taken into it in characters.
MAX_TRAIN, MAX_TRAIN_CHARS = 4000, 100_000
EPOCHS, BATCH, RATE = 30, 32, 2.0
#: Largest norm of a step's gradient in any layer.
CLIP = 1.0
#: One text in so many of the sample calibrates.
HELD = 5
#: Words of the pieces that calibration adds to each whole text.
PIECES = (2, 4, 8, 16)
#: Share of right predictions that those not rejected keep on the calibration part.
ACCEPTED_ACCURACY = 0.99
_ROWS = 128
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_SEEDS = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)


def gram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed n-grams, one row a text."""
    buf = _FOLD[np.frombuffer(b" " + b" ".join([*texts, b"   "]), np.uint8)]
    stops = np.cumsum([len(t) + 1 for t in texts])
    inner, wide = buf != 32, buf.astype(np.uint32)
    owner = np.searchsorted(stops, np.arange(len(buf)), side="right") * BUCKETS
    total = np.zeros(len(texts) * BUCKETS)
    for n in GRAMS:
        size = len(buf) - n + 1
        h, ok = np.full(size, n, np.uint32), np.ones(size, bool)
        for k in range(n):
            h = (h ^ wide[k : k + size]) * _SEEDS[k]
            h ^= h >> np.uint32(15)
            if 0 < k < n - 1:
                ok &= inner[k : k + size]
        ok &= inner[:size] | inner[n - 1 :]
        at = owner[:size] + (h >> np.uint32(20))
        total += np.bincount(at[ok & (at < len(total))], minlength=len(total))
    return total.reshape(len(texts), BUCKETS)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return _unit(counts) @ self.table + self.bias

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        return _softmax(self.logits(counts) / self.temperature)


def _unit(counts: np.ndarray) -> np.ndarray:
    """Rows of unit length: the direction of the average is that of the sum."""
    return counts / np.maximum(np.sqrt((counts * counts).sum(1, keepdims=True)), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _clipped(grad: np.ndarray) -> np.ndarray:
    return grad * min(1.0, CLIP / max(float(np.sqrt((grad * grad).sum())), 1e-12))


def _descend(x: np.ndarray, y: np.ndarray, classes: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings folded into the softmax layer, and its bias."""
    emb, out, bias = rng.normal(0, DIM**-0.5, (BUCKETS, DIM)), np.zeros((DIM, classes)), np.zeros(classes)
    target = np.eye(classes)[y]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
            mean = x[part] @ emb
            grad = (_softmax(mean @ out + bias) - target[part]) / len(part)
            back = _clipped(x[part].T @ (grad @ out.T))
            out -= rate * _clipped(mean.T @ grad)
            bias -= rate * 0.1 * grad.sum(0)
            emb -= rate * back
    table = emb @ out
    if not (np.isfinite(table).all() and np.isfinite(bias).all()):
        raise ArithmeticError("training of the language model did not stay finite")
    return table, bias


def _train(x: np.ndarray, y: np.ndarray, languages: list[str], held: np.ndarray, whole: np.ndarray, noise: np.ndarray) -> LanguageModel:
    """``held`` rows calibrate; among them are pieces of texts, which are not ``whole``, and ``noise`` of no language. The counts ``x``, of floats, become unit rows."""
    rng = np.random.default_rng(2)
    for k in range(0, len(x), _ROWS):  # in place, as the sample is the driver's largest table
        x[k : k + _ROWS] = _unit(x[k : k + _ROWS])
    if held[whole].all() or not held.any():
        held = np.zeros(len(x), bool)
    use = np.nonzero(whole & ~held)[0]
    table, bias = _descend(x[use], y[use], len(languages), rng)
    rest = np.nonzero(held if held.any() else np.ones(len(x), bool))[0]
    logits = np.concatenate([x[rest[k : k + _ROWS]] @ table for k in range(0, len(rest), _ROWS)]) + bias
    truth = np.where(noise[rest], -1, y[rest])
    known = truth >= 0
    temperature = min((float(t) for t in np.geomspace(0.02, 10, 61)), key=lambda t: -np.log(_softmax(logits[known] / t)[np.arange(known.sum()), truth[known]] + 1e-12).sum())
    best = _softmax(logits / temperature)
    order = np.argsort(-best.max(1), kind="stable")
    right = np.cumsum((best.argmax(1) == truth)[order]) / np.arange(1, len(order) + 1)
    enough = np.nonzero(right >= ACCEPTED_ACCURACY)[0]
    threshold = float(best.max(1)[order][enough[-1]]) if len(enough) else 1.0
    return LanguageModel(languages, table, bias, temperature, threshold)


def pieces(text: bytes, rng: np.random.Generator) -> list[tuple[bytes, bool]]:
    """Pieces of PIECES words from anywhere in a text, and the last one again with its characters shuffled (True)."""
    words, out = text.decode("utf-8", "replace").split(), []
    for n in PIECES:
        if len(words) > n:
            at = int(rng.integers(0, len(words) - n + 1))
            out.append((" ".join(words[at : at + n]).encode(), False))
    if out:
        whole = out[-1][0].decode()
        letters = [c for c in whole if not c.isspace()]
        mixed = iter(rng.permutation(len(letters)))
        out.append(("".join(c if c.isspace() else letters[next(mixed)] for c in whole).encode(), True))
    return out


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN, max_chars: int = MAX_TRAIN_CHARS) -> LanguageModel | None:
    """Learn from at most ``max_train`` texts outside fold 1, those with the smallest hashes of their ids."""
    usable = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col) != 1))
    usable = usable.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # the ids are at most max_train, so they are broadcast; the last limit holds when ids repeat
    ids = usable.filter(F.length("text") <= max_chars).select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(max_train)
    sample = usable.filter(F.length("text") <= max_chars).join(F.broadcast(ids), "id").select("lang", "text").limit(max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for start, texts in blocks(batch.column(1)):
                for k, text in enumerate(texts, start):
                    digest = xxhash.xxh64_intdigest(text)
                    held = digest % HELD == 0  # equal texts are held together
                    some = [(text, False), *(pieces(text, np.random.default_rng(digest)) if held else [])]
                    counts = gram_counts([t for t, _ in some])
                    packed = [(np.nonzero(c)[0].astype("<u2").tobytes(), c[c > 0].astype("<f4").tobytes()) for c in counts]
                    lang = batch.column(0)[k].as_py()
                    rows = [(lang, digest - (1 << 63), i, n, held, *p) for i, ((_, n), p) in enumerate(zip(some, packed, strict=True))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "text", "piece", "noise", "held", "at", "n"])

    rows = sample.mapInArrow(run, "lang string, text bigint, piece bigint, noise boolean, held boolean, at binary, n binary").toArrow()
    if not rows.num_rows:
        return None
    text, lang, piece, noise, held, at, n = (rows.column(c).combine_chunks() for c in ("text", "lang", "piece", "noise", "held", "at", "n"))
    keys = list(zip(text.to_pylist(), lang.to_pylist(), piece.to_pylist(), strict=True))
    order = sorted(range(len(keys)), key=keys.__getitem__)  # the same model whatever the order of the tasks
    languages = sorted({k[1] for k in keys})
    x = np.zeros((len(keys), BUCKETS), np.float32)
    for row, k in enumerate(order):
        x[row, np.frombuffer(at[k].as_buffer(), "<u2")] = np.frombuffer(n[k].as_buffer(), "<f4")
    flags = [np.array([c[k].as_py() for k in order], bool) for c in (held, noise)]
    return _train(x, np.array([languages.index(keys[k][1]) for k in order]), languages, flags[0], np.array([not keys[k][2] for k in order]), flags[1])


def predict(docs: DataFrame, model: LanguageModel | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, lang_pred, score, rejected)`` of every row, from its text alone."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            letters = [bool(t.is_valid and _LETTER.search(t.as_py())) for t in column]
            for start, texts in blocks(column):
                for k in range(0, len(texts), _ROWS):
                    part = texts[k : k + _ROWS]
                    named, score = ["und"] * len(part), np.zeros(len(part))
                    if model is not None:
                        p = model.probabilities(gram_counts(part))
                        has = np.array(letters[start + k : start + k + len(part)])
                        score = np.where(has, p.max(1), 0.0)
                        named = [model.languages[b] if h else "und" for b, h in zip(p.argmax(1), has, strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.slice(start + k, len(part)), pa.array(named), pa.array(score), pa.array(score < (model.threshold if model else 1.0))], ["id", "lang_pred", "score", "rejected"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
