"""Words and word hashes of whole batches of texts, computed on their bytes with numpy.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return;
A-Z count as a-z.  A word's hash is a polynomial over its bytes, read off two prefix sums, then mixed.
No step looks at single words in Python, so the cost is a few passes over the bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np

#: Bytes handled at once; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX_A, MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
SHIFT = np.uint64(33)

# Fixed value: the bytes that separate words.
IS_LETTER = np.ones(256, dtype=bool)
IS_LETTER[[32, *range(9, 14)]] = False

_powers: dict[int, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of the 64-bit values over the whole word."""
    h = h ^ (h >> SHIFT)
    h *= MIX_A
    h ^= h >> SHIFT
    h *= MIX_B
    h ^= h >> SHIFT
    return h


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 … base ** n`` modulo 2**64; the table of ordinary block sizes is kept."""
    have = _powers.get(int(base))
    if have is None or len(have) <= n:
        have = np.full(max(n, BLOCK_BYTES) + 1, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= BLOCK_BYTES:
            _powers[int(base)] = have
    return have[: n + 1]


@dataclass
class Words:
    """Words of consecutive texts: byte spans within the block, hashes, and ``first[t]:first[t + 1]`` per text."""

    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    data: np.ndarray
    sums: np.ndarray

    def prefixes(self, size: int) -> np.ndarray:
        """Hashes of the first ``size`` bytes of every word; shorter words have their own."""
        stop = np.minimum(self.start + size, self.end)
        return mixed((self.sums[stop] - self.sums[self.start]) * powers(UNBASE, len(self.data))[self.start] + np.uint64(size))

    def text(self, k: int, word_from: int, word_to: int) -> str:
        """The original text from one word of text ``k`` to another (exclusive)."""
        a, b = self.first[k] + word_from, self.first[k] + word_to - 1
        return self.data[self.start[a]: self.end[b]].tobytes().decode("utf-8", "replace")


def words_of(data: np.ndarray, bounds: np.ndarray, is_letter: np.ndarray = IS_LETTER) -> Words:
    """Words of texts that lie one after the other in ``data``; text ``t`` is ``bounds[t]:bounds[t + 1]``.

    ``is_letter`` has a flag for each byte: whether it belongs to a word.
    """
    n = len(data)
    low = data | (data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5)
    letter = np.zeros(n + 2, dtype=bool)
    letter[1:-1] = np.frombuffer(data.tobytes().translate(is_letter.tobytes()), dtype=bool)
    edge = letter[1:] != letter[:-1]
    edge[bounds] = True
    start = np.flatnonzero(letter[1:-1] & edge[:-1])
    end = np.flatnonzero(letter[1:-1] & edge[1:]) + 1
    terms = low.astype(np.uint64)
    terms += np.uint64(1)
    terms *= powers(BASE, n)[:n]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(terms, out=sums[1:])
    h = sums[end] - sums[start]
    h *= powers(UNBASE, n)[start]
    h += (end - start).astype(np.uint64)
    return Words(start, end, mixed(h), np.searchsorted(start, bounds), data, sums)


def raw_text(text) -> bytes:
    """UTF-8 of a string or of an Arrow string, which is not decoded for it; null is empty."""
    if text is None or isinstance(text, str):
        return (text or "").encode("utf-8", "surrogatepass")
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def blocks(texts: Iterable, is_letter: np.ndarray = IS_LETTER) -> Iterator[tuple[int, Words]]:
    """``(number of the block's first text, Words)`` over all texts, a list or an Arrow array; null is an empty text."""
    first, parts, size = 0, [], 0
    for k, text in enumerate(texts):
        raw = raw_text(text)
        if parts and size + len(raw) > BLOCK_BYTES:
            yield first, _block(parts, is_letter)
            first, parts, size = k, [], 0
        parts.append(raw)
        size += len(raw)
    if parts:
        yield first, _block(parts, is_letter)


def _block(parts: list[bytes], is_letter: np.ndarray) -> Words:
    bounds = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=bounds[1:])
    return words_of(np.frombuffer(b"".join(parts), dtype=np.uint8), bounds, is_letter)


def shingles(words: Words, size: int, whole_if_short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words in order, and the bounds per text.

    A text with fewer words has none, or its whole sequence as one with ``whole_if_short``.
    """
    h, first = words.hashes, words.first
    counts = np.diff(first)
    runs = np.maximum(counts - size + 1, 0)
    bounds = np.zeros(len(first), dtype=np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size)) if whole_if_short else np.zeros(0, dtype=np.int64)
    runs[short] = 1
    np.cumsum(runs, out=bounds[1:])
    at = np.repeat(first[:-1] - bounds[:-1], runs) + np.arange(bounds[-1])
    out = np.full(len(at), size, dtype=np.uint64)
    for k in range(size):
        out = mixed(out * BASE + h[np.minimum(at + k, max(len(h) - 1, 0))]) if len(h) else out
    for t in short:
        value = np.full(1, counts[t], dtype=np.uint64)
        for k in range(counts[t]):
            value = mixed(value * BASE + h[first[t] + k: first[t] + k + 1])
        out[bounds[t]] = value[0]
    return out, bounds


def rolling(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Other hashes of the runs :func:`shingles` gives without short texts, whatever ``size`` read off one prefix sum."""
    h, first = words.hashes, words.first
    runs = np.maximum(np.diff(first) - size + 1, 0)
    bounds = np.zeros(len(first), dtype=np.int64)
    np.cumsum(runs, out=bounds[1:])
    at = np.repeat(first[:-1] - bounds[:-1], runs) + np.arange(bounds[-1])
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * powers(BASE, len(h))[: len(h)], out=sums[1:])
    return mixed((sums[at + size] - sums[at]) * powers(UNBASE, len(h))[at] + np.uint64(size)), bounds


def count_words(texts: Sequence) -> np.ndarray:
    """The number of words of every text; null has none."""
    out = np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        data = np.frombuffer(raw_text(text), dtype=np.uint8)
        if len(data):
            letter = IS_LETTER[data]
            out[k] = int(letter[0]) + np.count_nonzero(letter[1:] & ~letter[:-1])
    return out
