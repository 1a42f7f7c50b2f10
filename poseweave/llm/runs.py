"""Periodic runs of words: a suffix automaton with link-cut access.

A stretch of words is read from left to right.  Every state of its suffix automaton carries the end of the last occurrence
seen of its strings.  Appending a word is an access of the link tree: the path from the state of the whole
prefix to the root takes the new end.  The path's parts of equal old end are its segments; a segment whose longest string
has length L and whose old end lies d <= L words back is a stretch of period d, L + d words long: a square, and a run if
the next word does not go on with the period.  Each maximal run with smallest period d is such a segment at its last word: its
suffix of length L occurs d words earlier and nowhere between (two overlaps closer than d would have a smaller period), and
one word more to the left does not occur there.

The link tree's final form is known before the first access, so the segments lie on its heavy paths, as one stack for each:
an access replaces the top of the stacks it meets, which are at most log2(states).

Only parts of a text in which a run can lie are read at all: a run of exponent e and length n repeats one period later all but
its last period, so every word of it is in a repeated gram of ``gram_words`` words.  Stretches of such words are found by hashes
(equal grams have equal hashes, so none is missed) and narrowed until each repeats within itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from poseweave.llm.common import with_text_columns
from poseweave.llm.words import mixed, raw_text

MIN_LENGTH = 24
MIN_EXPONENT = 3
#: Words whose grams are hashed at once; a longer text makes a block of its own.
BLOCK_WORDS = 1 << 18
ODD = np.uint64(0x9E3779B97F4A7C15)

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
Run = tuple[int, int, int]


class Automaton:
    """The suffix automaton of a sequence of hashable words; state 0 is the empty string."""

    def __init__(self, words: Sequence):
        self.length, self.link, self.prefix = [0], [-1], []
        follow: list[dict] = [{}]
        length, link = self.length, self.link
        last = 0
        for word in words:
            state = len(length)
            length.append(length[last] + 1)
            link.append(0)
            follow.append({})
            p = last
            while p >= 0 and word not in follow[p]:
                follow[p][word] = state
                p = link[p]
            if p >= 0:
                q = follow[p][word]
                if length[q] != length[p] + 1:
                    clone = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    follow.append(follow[q].copy())
                    link[q] = clone
                    while p >= 0 and follow[p].get(word) == q:
                        follow[p][word] = clone
                        p = link[p]
                    q = clone
                link[state] = q
            last = state
            self.prefix.append(state)


def heavy_paths(automaton: Automaton) -> list[int]:
    """The uppermost state of every state's heavy path in the link tree."""
    length, link = automaton.length, automaton.link
    n = len(length)
    # A link leads to a shorter string, so states by falling length come before their links.
    falling = np.argsort(-np.asarray(length), kind="stable").tolist()
    size, heavy = [1] * n, [-1] * n
    for v in falling[:-1]:
        size[link[v]] += size[v]
    for v in falling[:-1]:
        up = link[v]
        if heavy[up] < 0 or size[v] > size[heavy[up]]:
            heavy[up] = v
    top = list(range(n))
    for v in reversed(falling[:-1]):
        if heavy[link[v]] == v:
            top[v] = top[link[v]]
    return top


def segments(words: Sequence) -> Iterator[tuple[int, int, int]]:
    """``(end, old_end, length)`` of every segment that each appended word recolours, deepest first."""
    automaton = Automaton(words)
    length, link, top = automaton.length, automaton.link, heavy_paths(automaton)
    stacks: list[list[tuple[int, int]] | None] = [None] * len(length)  # (length of the deepest state, end), shallow last
    for end, state in enumerate(automaton.prefix):
        seen = -1
        while state > 0:
            head, reach = top[state], length[state]
            stack = stacks[head]
            if stack is None:
                stacks[head] = [(reach, end)]
            else:
                parts = []
                while stack and stack[-1][0] <= reach:
                    parts.append(stack.pop())
                if stack and (not parts or parts[-1][0] < reach):
                    parts.append((reach, stack[-1][1]))
                stack.append((reach, end))
                for deepest, old in reversed(parts):
                    if old != seen:
                        seen = old
                        yield end, old, deepest
            state = link[head]


def runs_of(words: Sequence, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[Run]:
    """``(start, length, period)`` of all runs of a stretch, by start, then period."""
    n, found = len(words), []
    for end, old, length in segments(words):
        period = end - old
        whole = length + period
        if whole >= min_length and whole >= min_exponent * period and (end + 1 == n or words[end + 1] != words[end + 1 - period]):
            found.append((end + 1 - whole, whole, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def gram_words(min_length: int, min_exponent: int) -> int:
    """Words that every run repeats one period later, whatever its period."""
    return max(1, ceil(Fraction(min_length * (min_exponent - 1), min_exponent)))


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all grams of ``size`` words, by doubling: the hash of two halves that may overlap."""
    have = 1
    while have < size:
        step = min(have, size - have)
        h = mixed(h[:-step] * ODD + h[step:])
        have += step
    return h


def _covered(h: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """Marks the words in a gram of ``size`` words that occurs twice with the same owner (owners are contiguous)."""
    marks = np.zeros(len(h) + 1, dtype=np.int64)
    if len(h) >= size:
        grams = mixed(_grams(h, size) + owner[: len(h) - size + 1].astype(np.uint64) * ODD)
        inside = owner[: len(grams)] == owner[size - 1:]
        usual = np.sort(grams[inside])
        double = usual[1:][usual[1:] == usual[:-1]]
        if len(double):
            at = np.minimum(np.searchsorted(double, grams), len(double) - 1)
            start = np.flatnonzero(inside & (double[at] == grams))
            marks[start] += 1
            marks[start + size] -= 1
    return np.cumsum(marks[:-1]) > 0


def stretches(h: np.ndarray, bounds: np.ndarray, size: int, min_length: int) -> list[tuple[int, int]]:
    """Spans of words that hold all runs of the texts ``bounds[t]:bounds[t + 1]``; each run lies in one span.

    Spans are narrowed as long as that leaves out a quarter of their words, so all rounds together take linear time but for sorting.
    """
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(len(h))
    while True:
        kept = _covered(h, owner, size)
        narrow_on = np.count_nonzero(kept) < 0.75 * len(kept)
        # A new stretch starts where words were left out or another owner starts.
        at, h, owner = at[kept], h[kept], owner[kept]
        if not len(at):
            return []
        first = np.ones(len(at), dtype=bool)
        first[1:] = (np.diff(at) > 1) | (np.diff(owner) > 0)
        fresh = np.cumsum(first) - 1
        lengths = np.bincount(fresh)
        long = lengths[fresh] >= min_length
        at, h, owner = at[long], h[long], fresh[long]
        if not narrow_on:
            starts, sizes = np.unique(owner, return_index=True)[1], lengths[lengths >= min_length]
            return [(int(at[a]), int(at[a]) + int(n)) for a, n in zip(starts, sizes, strict=True)]


def text_words(text) -> list[bytes]:
    """Runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return."""
    return raw_text(text).split()


def _blocks(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    block, size = [], 0
    for text in texts:
        words = text_words(text)
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append(words)
        size += len(words)
    if block:
        yield block


def text_runs(texts: list[list[bytes]], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[list[Run]]:
    """The runs of every text of a block, given as lists of words."""
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(words) for words in texts], out=bounds[1:])
    h = np.fromiter((hash(w) for words in texts for w in words), np.int64, int(bounds[-1])).view(np.uint64)
    found: list[list[Run]] = [[] for _ in texts]
    for a, b in stretches(mixed(h), bounds, gram_words(min_length, min_exponent), min_length):
        t = int(np.searchsorted(bounds, a, side="right")) - 1
        base = int(bounds[t])
        found[t] += [(a - base + s, n, p) for s, n, p in runs_of(texts[t][a - base: b - base], min_length, min_exponent)]
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """``words`` without those that a run has after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words), dtype=bool)
    for start, length, period in runs:
        gone[start + period: start + length] = True
    return [words[k] for k in np.flatnonzero(~gone).tolist()]


def strongest(runs: list[Run]) -> Run | None:
    """The run of greatest length / period; ties go to the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, digests: bool = False) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` and the text without repeated periods in ``collapsed``; all rows and columns stay.

    A run is a stretch of words with smallest period ``period`` and at least ``min_length`` words and ``min_exponent`` (an integer
    from 2) periods that no neighbouring word extends.  Runs come by start, then period.  ``collapsed`` has the words that no run
    holds after its first period, joined by one space.  Null and empty texts have no words and an empty ``collapsed``; every row
    is judged on its own, so repeated rows have equal results.  Columns of these names are replaced.  With ``digests``, ``collapsed``
    is replaced by the SHA-256 of its bytes, ``collapsed_sha256``, and ``runs_sha256`` digests a line ``start,length,period`` for each run.
    Each text is read whole by one task, in memory proportional to its length.
    """
    if min_exponent < 2 or min_length < 1:
        raise ValueError("runs have at least two periods and one word")

    def run(texts: pa.Array) -> dict[str, list]:
        out: dict[str, list] = {"n_words": [], "runs": [], "collapsed": [], "runs_sha256": [], "collapsed_sha256": []}
        for block in _blocks(texts):
            for words, runs in zip(block, text_runs(block, min_length, min_exponent), strict=True):
                kept = b" ".join(collapse(words, runs))
                out["n_words"].append(len(words))
                out["runs"].append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                if digests:
                    out["runs_sha256"].append(_digest(b"".join(b"%d,%d,%d\n" % r for r in runs)))
                    out["collapsed_sha256"].append(_digest(kept))
                else:
                    out["collapsed"].append(kept.decode("utf-8", "replace"))
        kinds = {"n_words": pa.int64(), "runs": pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))}
        return {name: pa.array(values, kinds.get(name, pa.string())) for name, values in out.items() if name in fields}

    told = {"runs_sha256": "string", "collapsed_sha256": "string"} if digests else {"collapsed": "string"}
    fields = {"n_words": "bigint", "runs": RUNS, **told}
    return with_text_columns(docs, run, fields)
