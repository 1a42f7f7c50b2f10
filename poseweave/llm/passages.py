"""Repeated passages across documents: exact runs of words, and seeds with collinear chains and alignment.

Exact: every run of ``MIN_WORDS`` words that an earlier document has, too, is found.  Runs of ``EXACT_SEED`` words are sampled by
window minimizers so that ``MIN_WORDS`` common words have a common seed; around seeds of several documents all runs of ``MIN_WORDS``
words are looked up by their hash.

Alike: seeds are the minimizers of the runs of ``K`` words over ``SEED_WINDOW`` neighbours.  Every occurrence of a seed is compared
with the seed's first document (smallest id) and with the one before its own, in one pass over the sorted occurrences.  Matching
places of two documents are chained in order by a sweep with a Fenwick tree under a gap cost; chains are
aligned word by word.  A chain is aligned if its words, or one bit of each of the 32 words on either side of one of its matches, say that the texts are
alike.
Stretches of a document that earlier documents cover are joined, whichever documents they are.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poseweave.llm.common import perhaps_in
from poseweave.llm.words import Words, blocks, rolling, shingles
from poseweave.session import pin

K = 5
WINDOW = 21
#: Neighbours of which one ``K``-word run is a seed; score of the words around a match (chance reaches it in one of 60).
SEED_WINDOW, ALIKE_SCORE = 6, 14
#: Words of a repeated stretch, least share of its words that match, words of one aligned piece of it.
MIN_WORDS, MIN_SHARE, MIN_PIECE = 50, 0.8, 20
#: Words of a seed of exact runs: each ``MIN_WORDS`` words hold ``WINDOW`` of them.
EXACT_SEED = MIN_WORDS - WINDOW + 1
#: Cost of a word left out between two matches; loss at which the extension of a match ends; words between pieces of a stretch.
GAP_COST, DROP, JOIN_GAP = 0.25, 10, 2


PIECE = "start_word int, end_word int, other_start int, other_end int, matched int"


def minimizers(values: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest value (the last one of ties) of every ``window`` neighbours; of all, if there are fewer."""
    n = len(values)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(values[::-1]))]) if n else np.zeros(0, dtype=np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(values, window)[:, ::-1]
    return np.unique(np.arange(n - window + 1) + window - 1 - np.argmin(rows, axis=1))


def minimizers_of(values: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """:func:`minimizers` of many texts, ``values[bounds[t]:bounds[t + 1]]`` each: places in ``values``, and their number for each text.

    The smallest of a window is that of two shorter ones, all texts' at once; windows over a text's end are left out.
    """
    size, best = 1, np.arange(len(values))
    while size < window and len(best) > 0:
        step = min(size, window - size)
        here, after = best[: max(len(best) - step, 0)], best[step:]
        best, size = np.where(values[after] <= values[here], after, here), size + step
    counts = np.diff(bounds)
    full = np.maximum(counts - window + 1, 0)
    starts = np.repeat(bounds[:-1] - (np.cumsum(full) - full), full) + np.arange(full.sum())
    found = best[starts]
    short = np.flatnonzero((counts > 0) & (counts < window))
    few = [bounds[t] + minimizers(values[bounds[t]: bounds[t + 1]], window) for t in short]
    chosen = np.zeros(len(values), dtype=bool)
    chosen[np.concatenate([found, *few]).astype(np.int64)] = True
    places = np.flatnonzero(chosen)
    return places, np.diff(np.searchsorted(places, bounds))


def surroundings(hashes: np.ndarray, size: int) -> np.ndarray:
    """For each word one bit of each of the 32 words after the ``size`` words from there, and of the 32 before it, nearest first."""
    bits = hashes >> np.uint64(63)
    after, before = bits.copy(), np.concatenate([np.zeros(1, np.uint64), bits[:-1]])[: len(bits)]
    for step in (1, 2, 4, 8, 16):
        far = np.zeros_like(after)
        far[: max(len(far) - step, 0)] = after[step:]
        near = np.zeros_like(before)
        near[step:] = before[: max(len(before) - step, 0)]
        after, before = after | far << np.uint64(step), before | near << np.uint64(step)
    shifted = np.zeros_like(after)
    shifted[: max(len(after) - size, 0)] = after[size:]
    return shifted | before << np.uint64(32)


def around_score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far the words around two matching places agree: one up for an equal bit, two down for another, best of each side."""
    differ, total = a ^ b, np.zeros(len(a), dtype=np.int64)
    for side in (0, 32):
        level, best = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
        for k in range(32):
            level += 1 - 3 * (differ >> np.uint64(side + k) & np.uint64(1)).astype(np.int64)
            np.maximum(best, level, out=best)
        total += best
    return total


def word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of every text; equal texts in a row are hashed once."""
    new = np.ones(len(texts), dtype=bool)
    new[1:] = ~pc.equal(texts.slice(1), texts.slice(0, max(len(texts) - 1, 0))).fill_null(False).to_numpy(zero_copy_only=False)
    times = np.diff(np.append(np.flatnonzero(new), len(texts)))
    for first, words in blocks(texts.filter(pa.array(new))):
        for k, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True), first):
            for _ in range(times[k]):
                yield words.hashes[a:b]


def seeds(docs: DataFrame, size: int = K, window: int = SEED_WINDOW, exact: bool = False) -> DataFrame:
    """``(seed, doc_id, place, around)``: minimizers of every text; texts shorter than ``size`` words have none.

    ``exact`` seeds are hashed in one pass whatever their size; their words around are not looked at.
    """
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, words in blocks(batch.column("text")):
                values, bounds = rolling(words, size) if exact else shingles(words, size, whole_if_short=False)
                at, n = minimizers_of(values, bounds, window)
                flat = at - np.repeat(bounds[:-1], n)
                around = np.zeros(len(at), np.uint64) if exact else surroundings(words.hashes, size)[flat + np.repeat(words.first[:-1], n)]
                yield pa.RecordBatch.from_arrays([pa.array(values[at].view(np.int64)), pa.array(np.repeat(ids[first: first + len(n)], n)),
                                                  pa.array(flat.astype(np.int32)), pa.array(around.view(np.int64))],
                                                 ["seed", "doc_id", "place", "around"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(find, "seed long, doc_id long, place int, around long")


def linked(found: DataFrame, previous: bool) -> DataFrame:
    """``(doc_id, other_id, place, other_place, score)``: every occurrence of a seed with the seed's first document.

    With ``previous`` also with the last document before its own; of either document the first place counts.  Occurrences are
    sorted by seed and read as a stream that remembers three rows, so a frequent seed needs no memory.
    """
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("seed", "doc_id", "place", "around")]
            n_kept = len(kept[0])
            seed, doc, place, around = (np.concatenate(pair) for pair in zip(kept, columns, strict=True))
            new = np.ones(len(seed), dtype=bool)
            new[1:] = seed[1:] != seed[:-1]
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            new[1:] |= doc[1:] != doc[:-1]
            starts, run = np.flatnonzero(new), np.cumsum(new) - 1
            own, before = starts[run], starts[np.maximum(run - 1, 0)]
            later = own != first
            later[:n_kept] = False
            a, b = np.flatnonzero(later), first[later]
            if previous:
                also = later & (before != first)
                a, b = np.concatenate([a, np.flatnonzero(also)]), np.concatenate([b, before[also]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[a]), pa.array(doc[b]), pa.array(place[a].astype(np.int32)), pa.array(place[b].astype(np.int32)),
                 pa.array(around_score(around[a].view(np.uint64), around[b].view(np.uint64)).astype(np.int32))],
                ["doc_id", "other_id", "place", "other_place", "score"])
            last = np.unique([first[-1], max(before[-1], first[-1]), own[-1]])
            kept = [c[last] for c in (seed, doc, place, around)]

    rows = found.repartition("seed").sortWithinPartitions("seed", "doc_id", "place")
    return rows.mapInArrow(link, "doc_id long, other_id long, place int, other_place int, score int")


def in_several(found: DataFrame) -> DataFrame:
    """``(doc_id, place)`` of all seeds that several documents have."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The open seed's rows, and whether they have been given.
        kept, given = [np.zeros(0, np.int64)] * 3, False
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("seed", "doc_id", "place")]
            n_kept = len(kept[0])
            seed, doc, place = (np.concatenate(pair) for pair in zip(kept, columns, strict=True))
            new = np.ones(len(seed), dtype=bool)
            new[1:] = seed[1:] != seed[:-1]
            start, group = np.flatnonzero(new), np.cumsum(new) - 1
            stop = np.append(start[1:], len(seed)) - 1
            several = (doc[start] != doc[stop])[group]
            out = several.copy()
            out[:n_kept] &= not given
            yield pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(place[out].astype(np.int32))], ["doc_id", "place"])
            given = bool(several[-1])
            kept = [c[start[-1]: start[-1] + 1 if given else None] for c in (seed, doc, place)]

    rows = found.select("seed", "doc_id", "place").repartition("seed").sortWithinPartitions("seed", "doc_id", "place")
    return rows.mapInArrow(keep, "doc_id long, place int")


def cover(pieces: list[tuple]) -> list[tuple]:
    """Of pieces ``(start, end, …)`` as few as cover the same words, the first of equal ones."""
    out, best, joined = [], None, -1
    for piece in sorted(pieces, key=lambda p: (p[0], -p[1], *p[2:])):
        if best is not None and piece[0] > joined:
            out.append(best)
            joined, best = best[1], None
        if piece[1] > max(joined, best[1] if best is not None else -1):
            best = piece
    return [*out, best] if best is not None else out


def exact_runs(docs: DataFrame) -> DataFrame:
    """Rows as of ``repeats``: all runs of ``MIN_WORDS`` words, joined where they go on, that a smaller id has, too."""
    places = in_several(seeds(docs, EXACT_SEED, WINDOW, exact=True)).groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    places = pin(places, "exact-seeds")
    texts = perhaps_in(docs.select("doc_id", "text").where("text is not null"), places, "doc_id").join(places, "doc_id")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, doc, gram, place = batch.column("places"), [], [], []
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, words in blocks(batch.column("text")):
                runs, bounds = rolling(words, MIN_WORDS)
                for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), first):
                    values = runs[a:b]
                    here = np.zeros(len(values) + 1, dtype=bool)
                    at = wanted[k].values.to_numpy(zero_copy_only=False).astype(np.int64)
                    here[np.clip(at[:, None] - np.arange(WINDOW), 0, len(values))] = True
                    place.append(np.flatnonzero(here[: len(values)]))
                    gram.append(values[place[-1]])
                    doc.append(np.full(len(place[-1]), ids[k], np.int64))
            doc, gram, place = (np.concatenate(c) if c else np.zeros(0, np.uint64) for c in (doc, gram, place))
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(doc.astype(np.int64)), pa.array(place.astype(np.int32)),
                                              pa.array(np.zeros(len(doc), np.int64))], ["seed", "doc_id", "place", "around"])

    matches = linked(texts.mapInArrow(grams, "seed long, doc_id long, place int, around long"), previous=False)
    by_doc = matches.groupBy("doc_id").agg(F.collect_set(F.struct("other_id", "place", "other_place")).alias("m"))

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, rows = [], []
            for d, m in zip(batch.column("doc_id"), batch.column("m"), strict=True):
                other, x, y = (m.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("other_id", "place", "other_place"))
                order = np.lexsort((x, x - y, other))
                other, x, y = other[order], x[order], y[order]
                new = np.ones(len(x), dtype=bool)
                new[1:] = (np.diff(other) != 0) | (np.diff(x - y) != 0) | (np.diff(x) != 1)
                start = np.flatnonzero(new)
                n = np.diff(np.append(start, len(x))) - 1 + MIN_WORDS
                own = cover(list(zip(*(v.tolist() for v in (x[start], x[start] + n, other[start], y[start], y[start] + n, n)), strict=True)))
                rows += own
                doc += [d.as_py()] * len(own)
            columns = np.array(rows, dtype=np.int64).reshape(-1, 6)
            small = [pa.array(columns[:, k].astype(np.int32)) for k in (0, 1, 3, 4, 5)]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(columns[:, 2]), *small],
                                             ["doc_id", "other_id", "start_word", "end_word", "other_start", "other_end", "matched"])

    return by_doc.mapInArrow(join_up, f"doc_id long, other_id long, {PIECE}")


def segments(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """``(x, y, words)``: matches on one diagonal joined while a window's reach apart."""
    order = np.lexsort((x, x - y))
    x, y = x[order], y[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (np.diff(x - y) != 0) | (np.diff(x) > K + WINDOW)
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(x)) - 1
    return sorted(zip(x[start].tolist(), y[start].tolist(), (x[stop] + K - x[start]).tolist(), strict=True))


def chains(parts: list[tuple[int, int, int]], gap_cost: float = GAP_COST) -> list[list[tuple[int, int, int]]]:
    """Collinear chains of segments, best first, each segment in at most one.

    A chain's score is its words less ``gap_cost`` for each word between its segments in either text.  Segments are swept by
    start; ended ones stand in a Fenwick tree over their ends in the second text, which gives the best one to continue.
    """
    ends = sorted({y + n for _, y, n in parts})
    tree: list[tuple[float, int]] = [(-1.0, -1)] * (len(ends) + 1)
    score, before = [0.0] * len(parts), [-1] * len(parts)
    events = sorted([(x + n, 0, k) for k, (x, _, n) in enumerate(parts)] + [(x, 1, k) for k, (x, _, _) in enumerate(parts)])
    for _, kind, k in events:
        x, y, n = parts[k]
        if kind:
            best, i = (-1.0, -1), bisect_right(ends, y)
            while i > 0:
                best = max(best, tree[i])
                i -= i & -i
            gain = best[0] - gap_cost * (x + y) if best[1] >= 0 else 0.0
            score[k] = n + max(0.0, gain)
            before[k] = best[1] if gain > 0 else -1
        else:
            entry, i = (score[k] + gap_cost * (x + n + y + n), k), bisect_right(ends, y + n)
            while i <= len(ends):
                tree[i] = max(tree[i], entry)
                i += i & -i
    used, out = [False] * len(parts), []
    for k in sorted(range(len(parts)), key=lambda k: -score[k]):
        chain = []
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append(parts[k])
            k = before[k]
        if chain:
            out.append(chain[::-1])
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    if not len(a) or not len(b):
        return 0
    masks: dict[int, int] = {}
    for j, word in enumerate(b.tolist()):
        masks[word] = masks.get(word, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for word in a.tolist():
        u = row & masks.get(word, 0)
        row = ((row + u) | (row - u)) & full
    return len(b) - row.bit_count()


def reach(a: np.ndarray, b: np.ndarray, step: int = 256) -> tuple[int, int]:
    """How far two texts go on alike from their start: words to take, and how many of them match."""
    n, at, level, best, matched, best_matched = min(len(a), len(b)), 0, 0, 0, 0, 0
    top = 0
    while at < n:
        same = a[at: at + step][: n - at] == b[at: at + step][: n - at]
        levels = level + np.cumsum(np.where(same, 1, -1))
        highs = np.maximum(np.maximum.accumulate(levels), top)
        low = np.flatnonzero(levels < highs - DROP)
        stop = int(low[0]) if len(low) else len(levels)
        if stop and levels[:stop].max() > top:
            k = int(np.argmax(levels[:stop]))
            top, best, best_matched = int(levels[k]), at + k + 1, matched + int(same[: k + 1].sum())
        if len(low):
            break
        level, matched, at = int(levels[-1]), matched + int(same.sum()), at + len(levels)
    return best, best_matched


def aligned(chain: list[tuple[int, int, int]], a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int, int]:
    """``(start, end, other start, other end, matched)`` of a chain, its gaps aligned and its ends extended."""
    matched, x_at, y_at = 0, chain[0][0], chain[0][1]
    for x, y, n in chain:
        matched += common(a[x_at:x], b[y_at:y])
        matched += int(np.count_nonzero(a[x: x + n] == b[y: y + n])) if x + n <= len(a) and y + n <= len(b) else 0
        x_at, y_at = x + n, y + n
    after, more = reach(a[x_at:], b[y_at:])
    back, less = reach(a[: chain[0][0]][::-1], b[: chain[0][1]][::-1])
    return chain[0][0] - back, x_at + after, chain[0][1] - back, y_at + after, matched + more + less


def pieces_of(chain: list[tuple[int, int, int]], a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """The aligned chain, or its segments one by one where too few words of the whole match."""
    whole = aligned(chain, a, b)
    if whole[4] >= MIN_SHARE * max(whole[1] - whole[0], whole[3] - whole[2]):
        return [whole]
    return [p for k in range(len(chain)) for p in pieces_of(chain[k: k + 1], a, b)] if len(chain) > 1 else []


def repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, start_word, end_word, other_id, other_start, other_end, matched)``: passages that smaller ids have, too.

    Words are runs of other characters than ASCII white space, A-Z as a-z.  A row is an aligned piece of at least ``MIN_PIECE`` words,
    ``MIN_SHARE`` of them matching; pieces are reported where together they cover at least ``MIN_WORDS`` neighbouring words, and
    left out where another piece of the document covers all their words.
    Rows of one ``doc_id`` are not compared with each other; null ids and texts shorter than a passage have no rows, nor do
    repeats within one document.
    """
    matches = linked(seeds(docs), previous=True)
    # A group holds the matches of two documents: at most one for each seed of the later one (those of repeated rows change no chain).
    pairs = matches.groupBy("doc_id", "other_id").agg(F.collect_list(F.struct("place", "other_place", "score")).alias("m"))
    pairs = pairs.where(F.expr(f"size(m) > 1 or exists(m, v -> v.score >= {ALIKE_SCORE})"))

    def chain_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, other, out = [], [], []
            for d, o, m in zip(*(batch.column(c) for c in ("doc_id", "other_id", "m")), strict=True):
                x = m.values.field("place").to_numpy(zero_copy_only=False).astype(np.int64)
                y = m.values.field("other_place").to_numpy(zero_copy_only=False).astype(np.int64)
                score = m.values.field("score").to_numpy(zero_copy_only=False)
                # Few matches side by side are chance unless the words around one of them agree; no score is below zero.
                found = [(c, ALIKE_SCORE - (c[-1][0] + c[-1][2] - c[0][0] - K)) for c in chains(segments(x, y))]
                if any(wanted > 0 for _, wanted in found):
                    best = dict(zip(zip(x.tolist(), y.tolist(), strict=True), score.tolist(), strict=True))
                good = [c for c, wanted in found if wanted <= 0 or any(
                    best.get((a + k, b + k), 0) >= wanted for a, b, n in c for k in range(n - K + 1))]
                if good:
                    doc.append(d.as_py())
                    other.append(o.as_py())
                    out.append([[v for part in c for v in part] for c in good])
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(other, pa.int64()), pa.array(out, pa.list_(pa.list_(pa.int32())))],
                                             ["doc_id", "other_id", "chains"])

    chained = pin(pairs.mapInArrow(chain_up, "doc_id long, other_id long, chains array<array<int>>"), "chains")
    involved = chained.select(F.explode(F.array("doc_id", "other_id")).alias("doc_id")).distinct()
    candidates = perhaps_in(docs.select("doc_id", "text").where("text is not null"), involved, "doc_id")
    texts = pin(candidates.join(involved, "doc_id"), "chained-texts")
    both = chained.join(texts, "doc_id").join(texts.select(F.col("doc_id").alias("other_id"), F.col("text").alias("other_text")), "other_id")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, other, rows = [], [], []
            texts_of = (word_hashes(batch.column(c)) for c in ("text", "other_text"))
            for d, o, a, b, found in zip(batch.column("doc_id"), batch.column("other_id"), *texts_of, batch.column("chains"), strict=True):
                own = []
                for flat in found.as_py():
                    chain = [tuple(flat[k: k + 3]) for k in range(0, len(flat), 3)]
                    # A repeated line's matches with the same place add to a piece only where they are outside of it.
                    if len(chain) > 1 or not any(p[0] <= chain[0][0] and chain[0][0] + chain[0][2] <= p[1] for p in own):
                        own += [p for p in pieces_of(chain, a, b) if p[1] - p[0] >= MIN_PIECE]
                if own:
                    rows += own
                    doc += [d.as_py()] * len(own)
                    other += [o.as_py()] * len(own)
            columns = np.array(rows, dtype=np.int32).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(other, pa.int64()), *(pa.array(columns[:, k]) for k in range(5))],
                                             ["doc_id", "other_id", "start_word", "end_word", "other_start", "other_end", "matched"])

    # Written one after the other: the disk that texts are shuffled on is free again before all runs of words are.
    alike = pin(both.select("doc_id", "other_id", "text", "other_text", "chains").mapInArrow(
        align, f"doc_id long, other_id long, {PIECE}"), "aligned")
    found = alike.unionByName(pin(exact_runs(docs), "exact-runs"))
    fields = ["start_word", "end_word", "other_id", "other_start", "other_end", "matched"]
    by_doc = found.groupBy("doc_id").agg(F.collect_set(F.struct(*fields)).alias("pieces"))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, rows = [], []
            for d, pieces in zip(batch.column("doc_id"), batch.column("pieces"), strict=True):
                own = reported([tuple(p[c] for c in fields) for p in pieces.as_py()])
                rows += own
                doc += [d.as_py()] * len(own)
            columns = np.array(rows, dtype=np.int64).reshape(-1, len(fields))
            arrays = [pa.array(columns[:, k] if c == "other_id" else columns[:, k].astype(np.int32)) for k, c in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), *arrays], ["doc_id", *fields])

    kinds = "start_word int, end_word int, other_id long, other_start int, other_end int, matched int"
    return by_doc.mapInArrow(report, f"doc_id long, {kinds}")


def reported(pieces: list[tuple]) -> list[tuple]:
    """Pieces ``(start, end, other, …)`` of one document that are not within another one, of stretches of ``MIN_WORDS`` words or more.

    Stretches are pieces that meet or nearly so.  Of equal spans the one with the smallest other id stays.
    """
    out, stretch = [], []
    for piece in sorted(pieces, key=lambda p: (p[0], -p[1], *p[2:])):
        if stretch and piece[1] <= stretch[-1][1]:
            continue
        if stretch and piece[0] > stretch[-1][1] + JOIN_GAP:
            out += stretch if stretch[-1][1] - stretch[0][0] >= MIN_WORDS else []
            stretch = []
        stretch.append(piece)
    return out + (stretch if stretch and stretch[-1][1] - stretch[0][0] >= MIN_WORDS else [])


def without_repeats(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the repeated stretches cut from ``text`` and ``n_chars`` (where there is one) counted anew.

    The document with the smallest id keeps a passage.  White space before a cut stretch stays, the stretch's own and the space
    after its last word go.  All other columns and rows stay as they are, but with ``drop_emptied`` documents of which nothing is left
    go.
    """
    found = repeats(docs).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start_word", "end_word"))).alias("spans"))
    found = found.select(F.col("doc_id").alias("_cut_id"), F.col("spans").alias("_spans"))
    names = docs.columns
    rows = docs.join(found, docs["doc_id"] == found["_cut_id"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cut_texts = batch.column(names.index("text")), []
            touched, emptied = [False] * len(texts), [False] * len(texts)
            for k, spans in enumerate(batch.column("_spans").to_pylist()):
                if spans and texts[k].is_valid:
                    cut_texts.append(_cut(next(blocks([texts[k]]))[1], [(s["start_word"], s["end_word"]) for s in spans]))
                    touched[k], emptied[k] = True, not cut_texts[-1].strip()
            texts = pc.replace_with_mask(texts, pa.array(touched, pa.bool_()), pa.array(cut_texts, pa.string()))
            columns = [texts if c == "text" else batch.column(k) for k, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(emptied, pa.bool_())], [*map(str, range(len(names))), "_emptied"])

    plain = rows.select(*(docs[f"`{c}`"].alias(str(k)) for k, c in enumerate(names)), found["_spans"])
    fields = ", ".join(f"`{k}` {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(names))
    out = plain.mapInArrow(cut, f"{fields}, _emptied boolean")
    if drop_emptied:
        out = out.where(~F.col("_emptied"))
    new = {"n_chars": F.char_length(F.col(f"`{names.index('text')}`")).cast("long")}
    return out.select(*((new[c] if c in new else F.col(f"`{k}`")).alias(c) for k, c in enumerate(names)))


def _cut(words: Words, spans: list[tuple[int, int]]) -> str:
    raw, out, at = words.data.tobytes(), [], 0
    for start, end in spans:
        end = min(end, len(words.start))
        if start >= end or words.end[end - 1] <= at:
            continue
        out.append(raw[at: max(at, int(words.start[start]))])
        at = int(words.start[end]) if end < len(words.start) else len(raw)
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")
