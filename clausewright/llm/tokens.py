"""Vectorised word hashing over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19
_SPAN = 64
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, (_SPAN, 256), np.uint64)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True
_IS_WORD[128:] = True
#: Every byte but ASCII white space.
NO_SPACE = np.ones(256, bool)
NO_SPACE[[9, 10, 11, 12, 13, 32]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit result."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def blocks(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, list[bytes]]]:
    """``(first row, texts)`` of consecutive rows with about BLOCK_BYTES; null is empty."""
    start, held, size = 0, [], 0
    for k, text in enumerate(column):
        text = text.as_py() or ""
        held.append((text.lower() if lower else text).encode("utf-8", "replace"))
        size += len(held[-1])
        if size > BLOCK_BYTES:
            yield start, held
            start, held, size = k + 1, [], 0
    if held:
        yield start, held


def word_hashes(texts: list[bytes], starts_of: tuple[int, ...] = (), is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the words (runs of letters and digits, or of the bytes of ``is_word``) of lower-cased
    texts, one after the other, and the number of words of each text; for each
    number of bytes in ``starts_of`` also the hashes of the words' beginnings."""
    buf = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = is_word[buf]
    step = np.diff(inside)
    starts, ends = np.nonzero(step == 1)[0], np.nonzero(step == -1)[0]
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, ends_of_texts))))
    if not len(starts):
        return np.zeros(0, np.uint64), counts, *(np.zeros(0, np.uint64) for _ in starts_of)
    at = np.nonzero(inside[1:-1])[0]
    lengths = ends - starts
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    offset = np.arange(len(at)) - np.repeat(firsts, lengths)
    values = _TABLE[offset & (_SPAN - 1), buf[at]]
    begun = [mix(np.add.reduceat(np.where(offset < n, values, np.uint64(0)), firsts) + np.uint64(n)) for n in starts_of]
    return mix(np.add.reduceat(values, firsts) + lengths.astype(np.uint64)), counts, *begun
