"""Spelling variants: words one letter apart, found in a bit-sliced position index.

Words that differ by one edit agree outside a short stretch of positions, so the vocabulary is dealt to blocks: for every
third of the positions of the shorter word there is one key made of all other letters, with the length.  A block that holds more
than ``BLOCK_WORDS`` words is dealt again by halves of its stretch; one position leaves at most a letter or two free, so blocks are bounded by
the alphabet.  Within a block the index has a bitset over the block's words for every (position, letter).  All words
of the block ask at once: 64 words in one machine word, the recurrences over the letters of a query keep the set of words that agree
so far and the three sets with one replaced, one missing and one additional letter, the last two read at shifted positions.
A pair meets in several blocks; the one whose stretch has the first different position counts it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poseweave.session import pin

MIN_LETTERS, MIN_COUNT, MIN_RATIO = 6, 5, 5
#: Words of a block; larger blocks are dealt again.
BLOCK_WORDS = 4096
#: Distinct words a task counts before it hands them on, entries of an index, and pairs of a query with 64 words done at once.
TASK_WORDS, INDEX_SIZE, PAIRS_AT_ONCE = 1 << 18, 1 << 22, 1 << 17

# Letters are A-Z, a-z and the code points from U+00C0 to U+00FF; only A-Z are lower-cased.
LETTER_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
KEY = ["m", "lo", "hi", "key"]


def runs(text: str | None) -> list[bytes]:
    """The maximal runs of letters, lower-cased, one byte for each code point; other code points separate."""
    return (text or "").encode("latin-1", "replace").translate(LETTER_BYTES).split()


def misspelt(doc_id: int, run: bytes, one_in: int) -> bytes:
    """``run`` without one of its letters where the checksum of ``doc_id:run`` says so."""
    h = crc32(run.decode("latin-1").encode(), crc32(b"%d:" % doc_id))
    at = h % len(run)
    return run if h % one_in else run[:at] + run[at + 1:]


def _counts(batches: Iterator[pa.RecordBatch], min_letters: int, one_in: int) -> Iterator[pa.RecordBatch]:
    total: Counter[bytes] = Counter()

    def told() -> pa.RecordBatch:
        words = [w for w in total if len(w) >= min_letters and total[w]]
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words], pa.string()),
                                           pa.array([total[w] for w in words], pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            words = [w for w in runs(text.as_py()) if len(w) >= min_letters]
            total.update(words)
            if one_in and doc_id is not None:
                start = crc32(b"%d:" % doc_id)
                hit = [w for w in set(words) if not crc32(w if w.isascii() else w.decode("latin-1").encode(), start) % one_in]
                own = Counter(words) if len(hit) > 8 else {w: words.count(w) for w in hit}
                for w in hit:
                    total[w] -= own[w]
                    total[misspelt(doc_id, w, one_in)] += own[w]
            if len(total) >= TASK_WORDS:
                yield told()
                total.clear()
    yield told()


def vocabulary(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, one_in: int = 0) -> DataFrame:
    """``(word, n)``: the words of at least ``min_letters`` letters that occur ``min_count`` times in all texts.

    With ``one_in``, a word of a document loses a letter where :func:`misspelt` says so (a test of the operator's use); rows of null ids
    keep their words.  Null and empty texts have no words; repeated rows count each time.
    """
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        lambda batches: _counts(batches, min_letters, one_in), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows ``(word, n, m, lo, hi)`` with the letters outside the stretch; a word of ``m + 1`` letters has one more inside."""
    inside = F.char_length("word") - F.col("m")
    return rows.withColumn("key", F.concat(F.expr("substring(word, 1, lo)"), F.col("word").substr(F.col("hi") + inside + 1, F.char_length("word"))))


def _dealt(words: DataFrame) -> DataFrame:
    """Every word with the keys of its blocks: as the shorter or equal one, and as the longer one of a pair."""
    rows = words.withColumn("m", F.explode(F.array(F.char_length("word"), F.char_length("word") - 1))).where("m > 0")
    third = F.floor(F.col("m") / 3).cast("int")
    cuts = [F.lit(0), third, F.col("m") - third, F.col("m")]
    rows = rows.withColumn("at", F.explode(F.array(*(F.struct(a.alias("lo"), b.alias("hi")) for a, b in zip(cuts, cuts[1:])))))
    return _keyed(rows.select("word", "n", "m", "at.lo", "at.hi").where("lo < hi"))


def blocks(words: DataFrame, block_words: int = BLOCK_WORDS) -> list[DataFrame]:
    """``(word, n, m, lo, hi, key)`` of all blocks of two words or more, in tables whose blocks are small or cannot be dealt again."""
    out, rows = [], pin(_dealt(words), "spelling")
    while True:
        sizes = pin(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "spelling")
        large = (F.col("size") > block_words) & (F.col("hi") - F.col("lo") > 1)
        shared = rows.join(sizes, KEY)
        out.append(shared.where(~large).drop("size"))
        if sizes.where(large).limit(1).count() == 0:
            return out
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))
        split = shared.where(large).withColumn("at", F.explode(halves)).select("word", "n", "m", "at.lo", "at.hi")
        rows = pin(_keyed(split), "spelling")


class Index:
    """Bitsets over consecutive groups of words: ``bits[column, position, letter]``, 64 words of one group to a column."""

    def __init__(self, letters: np.ndarray, lengths: np.ndarray, first: np.ndarray):
        self.letters, self.lengths, self.first = letters, lengths, first
        sizes = np.diff(first)
        self.columns = -(-sizes // 64)
        self.column_of = np.zeros(len(first), dtype=np.int64)
        np.cumsum(self.columns, out=self.column_of[1:])
        rank = np.arange(len(letters)) - np.repeat(first[:-1], sizes)
        column = np.repeat(self.column_of[:-1], sizes) + rank // 64
        bit = np.left_shift(np.uint64(1), (rank % 64).astype(np.uint64))
        self.row_of = np.repeat(first[:-1], self.columns) + 64 * (np.arange(self.column_of[-1]) - np.repeat(self.column_of[:-1], self.columns))
        n, width = int(self.column_of[-1]), letters.shape[1]
        # A blank position at either end, so that shifted reads need no test.
        self.bits = np.zeros((n, width + 2, int(letters.max()) + 1), dtype=np.uint64)
        self.of_length = np.zeros((n, width + 3), dtype=np.uint64)
        for p in range(width):
            there = lengths > p
            np.bitwise_or.at(self.bits, (column[there], p + 1, letters[there, p]), bit[there])
        np.bitwise_or.at(self.of_length, (column, lengths + 1), bit)
        self.all = np.bitwise_or.reduce(self.of_length, axis=1)

    def near(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers of all ordered pairs of words of one group that are one edit apart."""
        group = np.repeat(np.arange(len(self.columns)), np.diff(self.first))
        asks = self.columns[group]
        ends = np.cumsum(asks)
        done = 0
        while done < len(asks):
            base = ends[done - 1] if done else 0
            upto = max(done + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, side="right")))
            rows = np.arange(done, upto)
            # Longer words first, so that those that still have letters are at the front.
            rows = rows[np.argsort(-self.lengths[rows], kind="stable")]
            query = np.repeat(rows, asks[rows])
            nth = np.arange(len(query)) - np.repeat(np.cumsum(asks[rows]) - asks[rows], asks[rows])
            yield self._search(query, self.column_of[group[query]] + nth)
            done = upto

    def _search(self, query: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.lengths[query]
        same = self.all[column]
        replaced, missing, added = (np.zeros(len(query), dtype=np.uint64) for _ in range(3))
        for p in range(int(size[0]) if len(size) else 0):
            k = int(np.searchsorted(-size, -p, side="left"))
            letter, at = self.letters[query[:k], p], column[:k]
            here, back, ahead = (self.bits[at, p + shift, letter] for shift in (1, 0, 2))
            was = same[:k].copy()
            replaced[:k] = (replaced[:k] & here) | (was & ~here)
            missing[:k] = (missing[:k] & back) | was
            added[:k] = (added[:k] | was) & ahead
            same[:k] = was & here
        hits = ((replaced & self.of_length[column, size + 1]) | (missing & self.of_length[column, size])
                | ((added | same) & self.of_length[column, size + 2]))
        some = np.flatnonzero(hits)
        pair, bit = np.nonzero(np.unpackbits(hits[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        return query[some[pair]], self.row_of[column[some[pair]]] + bit


def _summed(table: pa.Table) -> pa.RecordBatch:
    """For every word of whole blocks that has near words there: their number and the best of them."""
    words = np.array(table.column("word").to_pylist())
    counts = table.column("n").to_numpy()
    m, lo, hi = (table.column(c).to_numpy() for c in KEY[:3])
    keys = np.array(table.column("key").to_pylist())
    starts = np.flatnonzero(np.concatenate(([True], (m[1:] != m[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (keys[1:] != keys[:-1]))))
    bounds = np.append(starts, len(words))
    points = words.view(np.uint32).reshape(len(words), -1)
    alphabet, letters = np.unique(points, return_inverse=True)
    letters, lengths = letters.reshape(points.shape), np.char.str_len(words)
    per_column = (points.shape[1] + 2) * len(alphabet)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    done = 0
    while done < len(starts):
        room = np.cumsum(-(-np.diff(bounds[done:]) // 64)) * per_column
        upto = done + max(1, int(np.searchsorted(room, INDEX_SIZE, side="right")))
        a, b = bounds[done], bounds[upto]
        for query, near in Index(letters[a:b], lengths[a:b], bounds[done: upto + 1] - a).near():
            query, near = query + a, near + a
            agree = points[query] == points[near]
            edit = np.where(agree.all(axis=1), agree.shape[1], np.argmin(agree, axis=1))
            # The block of the shorter word's length whose stretch has the first difference, or the end, counts the pair.
            own = (np.minimum(lengths[query], lengths[near]) == m[query]) & (edit >= lo[query]) & (
                (edit < hi[query]) | ((edit == m[query]) & (hi[query] == m[query])))
            found.append((query[own], near[own]))
        done = upto
    query = np.concatenate([q for q, _ in found]) if found else np.zeros(0, np.int64)
    near = np.concatenate([c for _, c in found]) if found else np.zeros(0, np.int64)
    order = np.lexsort((words[near], -counts[near], query))
    query, near = query[order], near[order]
    top = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(words[query[top]].tolist(), pa.string()), pa.array(np.diff(np.append(top, len(query))), pa.int64()),
         pa.array(words[near[top]].tolist(), pa.string()), pa.array(counts[near[top]], pa.int64())], ["word", "n_near", "best", "best_n"])


def _near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of sorted rows, block by block; the last block of a batch waits for its other rows."""
    kept: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([kept, table]) if kept is not None else table
        if not table.num_rows:
            continue
        last = {c: table.column(c)[-1] for c in KEY}
        first = table.num_rows - 1
        while first > 0 and all(table.column(c)[first - 1] == last[c] for c in KEY):
            first -= 1
        if first:
            yield _summed(table.slice(0, first))
        kept = table.slice(first)
    if kept is not None and kept.num_rows:
        yield _summed(kept)


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(word, n_near, best, best_n)``: how many words of ``words(word, n)`` are one edit away, and the most frequent of them.

    Equal numbers go to the smallest word in code-point order.  Words without a near one are left out.
    """
    parts = [rows.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_near_words, "word string, n_near bigint, best string, best_n bigint")
             for rows in blocks(words, block_words)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.word").alias("best"), (-F.col("b.less")).alias("best_n"))


def variants(words: DataFrame, min_ratio: float = MIN_RATIO, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every row of ``words(word, n)``, whose words are distinct.

    A word's form is its most frequent near word (ties: the smallest in code-point order) if that is at least ``min_ratio`` times as
    frequent, else null; its root is what following forms ends at.  The number grows with every step (``min_ratio`` must exceed 1), so
    there are no cycles, and following doubled steps takes a few joins.  Null words are left out; an empty table gives an empty one.
    """
    if min_ratio <= 1:
        raise ValueError("a form must be more frequent than its variant")
    words = pin(words.where("word is not null").select("word", "n"), "words")
    near = near_words(words, block_words)
    clear = F.col("best_n") >= min_ratio * F.col("n")
    judged = pin(words.join(near, "word", "left").select(
        "word", F.when(clear, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(clear, F.col("best_n")).alias("form_n")), "forms")
    steps = judged.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = pin(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        steps = moved.select("word", "root")
        if moved.where("moved").limit(1).count() == 0:
            break
    return judged.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
