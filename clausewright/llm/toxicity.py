"""Toxicity by a convolutional text classifier trained in numpy.

A word is the sum of embedding rows for its hash and for those of its first bytes, so
inflected forms of a word are alike, and a clean word resembles a toxic one by
accident only if all its hashes collide. Filters of
several widths slide over the whole text, each is max-pooled, and a logistic
layer gives the score. Embeddings, filters and weights start at random and are
trained together by stochastic gradient descent whose steps are scaled by the
gradients seen so far. The driver begins on a bounded sample; then every labelled
document is learned from in rounds, in which each partition goes on from the same
model over all its documents and the models are averaged, rows of embeddings by what
each partition has learned of them. A logistic calibration on all labelled documents of
every fourth id, which no step has seen, maps scores so that 0.7 is a confident decision;
thresholds by language are fitted there too.

Defined results: null, empty and wordless texts pool to nothing and get the
score of the biases alone; very long texts are scored whole; shorter texts than
a filter are padded; labels that are null or other than 0 or 1 are not learned,
and an id with both labels counts as toxic; long texts are learned from whole; without labels of both kinds, as in
empty tables, every score is 0; of equal maxima in a text the first learns; a score of
exactly a threshold is toxic; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .marks import split
from .stage import drop_stage, fold, stage
from .tokens import blocks, word_hashes

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 6, (1, 2, 3)
#: Bytes of a word's beginnings that are hashed beside the whole word.
STARTS = (5, 7)
#: Bounds of the sample that the driver begins on: documents of either label, characters of a document in it.
MAX_BEGIN, MAX_BEGIN_CHARS = 3000, 20_000
#: Rounds over all labelled documents, and words of a step in them beyond a first text.
ROUNDS, STEP_WORDS = 3, 1 << 16
#: Bins of a unit of raw score in which the calibration counts documents.
BINS = 256
EPOCHS, BATCH, RATE = 8, 16, 0.05
#: Share of words that a step does not see, so that not the loudest alone learn, while pooling is soft and later.
DROPPED, DROPPED_LATER = 0.4, 0.1
#: First epochs, which pool softly, and the temperature of their means.
SOFT_EPOCHS, SOFTNESS = 4, 0.5
#: Decision on the score, and the share of right alarms that a language's threshold keeps.
THRESHOLD, PRECISION = 0.7, 0.95
_PAD = max(WIDTHS) - 1


def buckets(hashes: tuple[np.ndarray, ...]) -> np.ndarray:
    """Bucket numbers of the words, a row for each kind of hash; bucket 0 is kept for padding."""
    return np.stack([(h % np.uint64(BUCKETS - 1)).astype(np.int64) + 1 for h in hashes])


def padded(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers with padding behind each text, and where the texts start."""
    size = counts + _PAD
    starts = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
    at = np.arange(words.shape[1]) + np.repeat(np.arange(len(counts)) * _PAD, counts)
    out = np.zeros((len(words), int(size.sum())), np.int64)
    out[:, at] = words
    return out, starts


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the words of these texts, and the texts' numbers of words."""
    whole, counts, *begun = word_hashes(texts, STARTS)
    return buckets((whole, *begun)), counts


@dataclass
class ToxicityModel:
    emb: list[np.ndarray]
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: float
    slope: float = 1.0
    offset: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, words: np.ndarray, starts: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        word = tables[0][words[0]]
        for table, row in zip(tables[1:], words[1:], strict=True):
            word += table[row]
        outs, col = [], 0
        for w in WIDTHS:
            y = np.zeros((words.shape[1], FILTERS), np.float32)
            for k in range(w):
                y[: len(y) - k] += word[k:, col : col + FILTERS]
                col += FILTERS
            # the last positions of a text only see padding behind it
            outs.append(np.maximum.reduceat(y, starts, axis=0))
        return np.maximum(np.hstack(outs) + self.bias, 0)

    def tables(self) -> list[np.ndarray]:
        w = np.hstack([self.filters[n][k] for n in WIDTHS for k in range(n)])
        return [(e @ w).astype(np.float32) for e in self.emb]

    def raw(self, texts: list[bytes], tables: list[np.ndarray]) -> np.ndarray:
        return self.pooled(*padded(*hashed(texts)), tables) @ self.out + self.shift

    def score(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -40, 40)))


def _initial(rng: np.random.Generator) -> ToxicityModel:
    rows = [rng.normal(0, 0.1, (BUCKETS, DIM)) for _ in range(1 + len(STARTS))]
    for emb in rows:
        emb[0] = 0
    filters = {w: rng.normal(0, (w * DIM) ** -0.5, (w, DIM, FILTERS)) for w in WIDTHS}
    wide = FILTERS * len(WIDTHS)
    return ToxicityModel(rows, filters, np.zeros(wide), np.full(wide, 1.0), -1.0)


def _begin(words: np.ndarray, starts: np.ndarray, y: np.ndarray) -> tuple[ToxicityModel, dict, np.ndarray]:
    """A model, the squares of gradients that its weights have seen, and which texts it has not learned from."""
    rng = np.random.default_rng(6)
    ends = np.concatenate((starts[1:], [words.shape[1]]))
    held = rng.random(len(y)) < 0.25
    if len({*y[held]}) < 2 or len({*y[~held]}) < 2:
        held[:] = False
    use = np.nonzero(~held)[0]
    model, seen = _initial(rng), {}
    weight = np.where(y == 1, 0.5 / max(1, (y[use] == 1).sum()), 0.5 / max(1, (y[use] == 0).sum())) * len(use)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for part in np.array_split(rng.permutation(use), max(1, len(use) // BATCH)):
            _step(model, seen, words, starts, ends, y, weight, part, rate, rng, epoch < SOFT_EPOCHS)
    return model, seen, held


def _train(words: np.ndarray, starts: np.ndarray, y: np.ndarray, langs: list[str | None]) -> ToxicityModel:
    """All of it on texts that are at hand."""
    model, _, held = _begin(words, starts, y)
    ends = np.concatenate((starts[1:], [words.shape[1]]))
    rest = np.nonzero(held)[0] if held.any() else np.arange(len(y))
    tables = model.tables()
    raw = np.concatenate([model.pooled(*_slice(words, starts, ends, p), tables) for p in np.array_split(rest, max(1, len(rest) // 64))]) @ model.out + model.shift
    _calibrate(model, [langs[k] for k in rest], np.ones(len(rest)), y[rest], raw, raw)
    return model


def _calibrate(model: ToxicityModel, langs: list[str | None], n: np.ndarray, ones: np.ndarray, raw: np.ndarray, least: np.ndarray) -> None:
    """From bins of documents of a language: their number, that of toxic ones, the mean and the least raw score."""
    model.slope, model.offset = _platt(np.concatenate((raw, raw)), np.repeat([1.0, 0.0], len(raw)), np.concatenate((ones, n - ones)))
    score = model.score(least)
    for lang in {*langs} - {None}:
        own = np.array([x == lang for x in langs])
        order = np.argsort(-score[own], kind="stable")
        good = np.cumsum(ones[own][order]) / np.cumsum(n[own][order]) >= PRECISION
        model.thresholds[lang] = float(score[own][order][np.nonzero(good)[0][-1]]) if good.any() else THRESHOLD


def _slice(words, starts, ends, part):
    size = ends[part] - starts[part]
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    at = np.arange(size.sum()) - np.repeat(begin, size) + np.repeat(starts[part], size)
    return words[:, at], begin


def _scaled(seen: dict, name, grad: np.ndarray, at=slice(None), shape: tuple = ()) -> np.ndarray:
    """The gradient over the root of the squares that these weights have seen."""
    past = seen.setdefault(name, np.full(shape or grad.shape, 1e-6))
    past[at] += grad * grad
    return grad / np.sqrt(past[at])


def _rows(at: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their gradients."""
    order = np.argsort(at, kind="stable")
    first = np.nonzero(np.diff(at[order], prepend=-1))[0]
    return at[order][first], np.add.reduceat(grad[order], first, axis=0)


def _step(model, seen, words, starts, ends, y, weight, part, rate, rng, soft: bool) -> None:
    """One step of gradient descent. A soft one pools by weighted means, in which every word has a
    part, so that words learn which the first maxima would have left out."""
    held, begin = _slice(words, starts, ends, part)
    size = held.shape[1]
    held = np.where(rng.random(size) < (DROPPED if soft else DROPPED_LATER), 0, held)
    owner = np.repeat(np.arange(len(part)), np.diff(np.concatenate((begin, [size]))))
    word = sum(e[row] for e, row in zip(model.emb, held, strict=True))
    share, pooled = [], []
    for n, w in enumerate(WIDTHS):
        z = np.zeros((size, FILTERS))
        for k in range(w):
            z[: size - k] += word[k:] @ model.filters[w][k]
        top = np.maximum.reduceat(z, begin, axis=0)
        if soft:
            near = np.exp((z - top[owner]) / SOFTNESS)
            near /= np.add.reduceat(near, begin, axis=0)[owner]
            share.append(near)
            pooled.append(np.add.reduceat(near * z, begin, axis=0) + model.bias[n * FILTERS : (n + 1) * FILTERS])
        else:
            where = np.where(z == top[owner], np.arange(size)[:, None], size)
            share.append(np.minimum.reduceat(where, begin, axis=0))
            pooled.append(top + model.bias[n * FILTERS : (n + 1) * FILTERS])
    flat = np.hstack(pooled)
    act = np.maximum(flat, 0)
    p = 1 / (1 + np.exp(-np.clip(act @ model.out + model.shift, -30, 30)))
    grad = (p - y[part]) * weight[part] / len(part)
    back = np.outer(grad, model.out) * (flat > 0)
    into, changes = np.zeros_like(word), {w: np.zeros_like(model.filters[w]) for w in WIDTHS}
    for n, w in enumerate(WIDTHS):
        g = back[:, n * FILTERS : (n + 1) * FILTERS]
        if soft:
            dz = share[n] * g[owner]
        else:
            dz = np.zeros((size, FILTERS))
            dz[share[n], np.arange(FILTERS)] = g
        for k in range(w):
            changes[w][k] = word[k:].T @ dz[: size - k]
            into[k:] += dz[: size - k] @ model.filters[w][k].T
    model.out -= rate * _scaled(seen, "out", act.T @ grad)
    model.shift -= rate * float(_scaled(seen, "shift", np.array([grad.sum()]))[0])
    model.bias -= rate * _scaled(seen, "bias", back.sum(0))
    for w in WIDTHS:
        model.filters[w] -= rate * _scaled(seen, w, changes[w])
    some = np.nonzero(np.abs(into).max(1))[0]
    if len(some):
        for k, table in enumerate(model.emb):
            rows, sums = _rows(held[k][some], into[some])
            table[rows] -= rate * _scaled(seen, ("emb", k), sums, rows, table.shape)
            table[0] = 0


def _platt(raw: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit with smoothed targets, by damped Newton steps; ``n`` documents have each raw score."""
    n1, every = n[y == 1].sum(), n.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (every - n1 + 2))
    x, w = np.column_stack([raw, np.ones(len(raw))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (n * (p - t)) + 1e-3 * (w - [1, 0]))
        w = w - np.clip(step, -1, 1)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def _labelled(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    """Every labelled document outside fold 1, staged: label, language, hashed words, whether it is kept for the calibration, place by hash."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(lang_col) if lang_col else F.lit(None)).cast("string").alias("lang"))
    known = labels.filter(F.col(label_col).isin(0, 1) & (fold(id_col) != 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("y"))
    known = stage(known, "toxicity-labels")
    _, maybe = split(src.filter(F.col("text").isNotNull()), known.select("id"), [F.col("id")])  # few other texts meet the join
    place = F.xxhash64("id", F.lit(6))
    found = maybe.join(known.hint("merge"), "id").select("y", "lang", "text", (F.pmod(place, F.lit(4)) == 0).alias("held"), place.alias("place"), F.length("text").alias("n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in blocks(batch.column(2)):
                held, counts = hashed(texts)
                cut = np.split(np.ascontiguousarray(held.T).astype(np.uint16), np.cumsum(counts)[:-1])
                own = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([c.tobytes() for c in cut], pa.binary()), *own.columns[3:]], ["y", "lang", "words", "held", "place", "n_chars"])

    rows = stage(found.mapInArrow(run, "y double, lang string, words binary, held boolean, place bigint, n_chars int"), "toxicity-words")
    drop_stage(known)
    return rows


def _texts(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Padded bucket numbers of these texts, and where they start."""
    held = [np.frombuffer(w.as_buffer(), np.uint16).reshape(-1, 1 + len(STARTS)) for w in words]
    return padded(np.concatenate(held).T.astype(np.int64), np.array([len(w) for w in held]))


def _parts(batch: pa.RecordBatch, order: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Rows in this order, at most so many and about STEP_WORDS at a time."""
    at, size = [], 0
    sizes = pa.compute.binary_length(batch.column(0)).to_numpy() // (2 + 2 * len(STARTS))
    for k in order.tolist():
        if at and (len(at) == most or size + sizes[k] > STEP_WORDS):
            yield batch.take(pa.array(at))
            at, size = [], 0
        at.append(k)
        size += sizes[k]
    if at:
        yield batch.take(pa.array(at))


def _dense(model: ToxicityModel) -> np.ndarray:
    """Filters, biases and weights of the output in rows of DIM numbers."""
    flat = np.concatenate([*(model.filters[w].ravel() for w in WIDTHS), model.bias, model.out, [model.shift]])
    return np.append(flat, np.zeros(-len(flat) % DIM)).reshape(-1, DIM)


def _set_dense(model: ToxicityModel, rows: np.ndarray) -> None:
    flat, at = rows.ravel(), 0
    for w in WIDTHS:
        model.filters[w] = flat[at : at + w * DIM * FILTERS].reshape(w, DIM, FILTERS).copy()
        at += w * DIM * FILTERS
    wide = FILTERS * len(WIDTHS)
    model.bias, model.out, model.shift = flat[at : at + wide].copy(), flat[at + wide : at + 2 * wide].copy(), float(flat[at + 2 * wide])


def _round(model: ToxicityModel, seen: dict, weights: dict[float, float], rate: float, turn: int):
    """What the documents of a partition change in this model, weighted by what they tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, n = np.random.default_rng([6, turn, TaskContext.get().partitionId()]), 0
        before, dense, past = [e.copy() for e in model.emb], _dense(model), [seen["emb", k].sum(1, dtype=float) for k in range(len(model.emb))]
        for batch in batches:
            for part in _parts(batch, rng.permutation(batch.num_rows), BATCH):
                words, starts = _texts(part.column(0))
                y = part.column(1).to_numpy()
                ends, weight = np.append(starts[1:], words.shape[1]), np.array([weights[v] for v in y])
                _step(model, seen, words, starts, ends, y, weight, np.arange(len(y)), rate, rng, False)
                n += len(y)
        if not n:
            return
        for k, (table, old) in enumerate(zip(model.emb, before, strict=True)):
            gain = seen["emb", k].sum(1, dtype=float) - past[k]
            rows = np.nonzero(gain > 0)[0]
            yield _changes(rows + k * BUCKETS, gain[rows], table[rows] - old[rows])
        change = _dense(model) - dense
        yield _changes(np.arange(len(change)) + len(before) * BUCKETS, np.full(len(change), float(n)), change)

    return run


def _changes(at: np.ndarray, weight: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
    sums = (change * weight[:, None]).astype(np.float32)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(weight), *map(pa.array, sums.T.copy())], ["i", "weight", *(f"c{c}" for c in range(DIM))])


def _learned(rows: DataFrame, model: ToxicityModel, seen: dict, weights: dict[float, float]) -> None:
    """Rounds over all these documents; tables of fixed size reach the driver."""
    seen = {name: past.astype(np.float32) if isinstance(name, tuple) else past for name, past in seen.items()}
    model.emb = [e.astype(np.float32) for e in model.emb]
    schema = "i int, weight double, " + ", ".join(f"c{c} float" for c in range(DIM))
    for turn in range(ROUNDS):
        rate = RATE * (1 - turn / ROUNDS)
        found = rows.select("words", "y").mapInArrow(_round(model, seen, weights, rate, turn), schema)
        added = found.groupBy("i").agg(F.sum("weight").alias("weight"), *[F.sum(f"c{c}").alias(f"c{c}") for c in range(DIM)]).toArrow()
        at = added.column("i").to_numpy()
        change = np.stack([added.column(f"c{c}").to_numpy() for c in range(DIM)], 1) / added.column("weight").to_numpy()[:, None]
        for k, table in enumerate(model.emb):
            own = at // BUCKETS == k
            table[at[own] - k * BUCKETS] += change[own]
            table[0] = 0
        own, dense = at >= len(model.emb) * BUCKETS, _dense(model)
        dense[at[own] - len(model.emb) * BUCKETS] += change[own]
        _set_dense(model, dense)


def _raw(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for batch in batches:
            for part in _parts(batch, np.arange(batch.num_rows), batch.num_rows):
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(model.pooled(*_texts(part.column(0)), tables) @ model.out + model.shift)], ["y", "lang", "raw"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None) -> ToxicityModel | None:
    """Learn from every labelled document outside fold 1: three of four train the weights, the others calibrate them.
    ``lang_col`` only sorts the documents that thresholds by language are fitted on."""
    rows = _labelled(docs, labels, label_col, id_col, text_col, lang_col)
    n = {(r["y"], r["held"]): r["count"] for r in rows.groupBy("y", "held").count().collect()}
    if len({y for y, _ in n}) < 2:
        return None
    apart = len(n) == 4  # otherwise too few to keep any for the calibration
    use = rows.filter(~F.col("held")) if apart else rows
    begin = None
    for c in (0, 1):
        some = use.filter((F.col("y") == c) & (F.col("n_chars") <= MAX_BEGIN_CHARS))
        last = some.select("place").orderBy("place").limit(MAX_BEGIN).agg(F.max("place")).first()[0]  # the places alone are sorted
        some = some.filter(F.col("place") <= F.lit(last)).limit(MAX_BEGIN)
        begin = some if begin is None else begin.unionByName(some)
    some = begin.select("y", "place", "words").toArrow().sort_by([("y", "ascending"), ("place", "ascending")]).combine_chunks()
    y = some.column("y").to_numpy()
    if len(y):
        model, seen, _ = _begin(*_texts(some.column("words")), y)
    else:  # none but long texts
        model, seen = _initial(np.random.default_rng(6)), {}
    for k, table in enumerate(model.emb):
        seen.setdefault(("emb", k), np.full(table.shape, 1e-6))
    count = {c: n.get((c, False), 0) + (0 if apart else n.get((c, True), 0)) for c in (0.0, 1.0)}
    _learned(use, model, seen, {c: 0.5 / k * sum(count.values()) for c, k in count.items() if k})
    raw = (rows.filter("held") if apart else rows).select("words", "y", "lang").mapInArrow(_raw(model), "y double, lang string, raw double")
    bins = raw.groupBy("lang", F.round(F.col("raw") * BINS).cast("int").alias("bin")).agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("ones"), F.avg("raw").alias("raw"), F.min("raw").alias("least")).orderBy("lang", "bin").toArrow()
    _calibrate(model, bins.column("lang").to_pylist(), *(bins.column(c).to_numpy() for c in ("n", "ones", "raw", "least")))
    drop_stage(rows)
    return model


def score(docs: DataFrame, model: ToxicityModel | None, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """``(id_col, score)`` of every whole text. With ``lang_col`` also ``threshold``,
    that of the document's language, and ``toxic``, the decision by it."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(lang_col) if lang_col else F.lit(None)).cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else None
        for batch in batches:
            for start, texts in blocks(batch.column(1)):
                found = model.score(model.raw(texts, tables)) if model else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), batch.column(2).slice(start, len(texts)), pa.array(found, pa.float64())], ["id", "lang", "score"])

    scored = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, lang string, score double")
    if lang_col is None:
        return scored.select(F.col("id").alias(id_col), "score")
    limits = F.lit(THRESHOLD)
    for lang, limit in (model.thresholds if model else {}).items():
        limits = F.when(F.col("lang") == lang, limit).otherwise(limits)
    return scored.select(F.col("id").alias(id_col), "score", limits.alias("threshold"), (F.col("score") >= limits).alias("toxic"))
