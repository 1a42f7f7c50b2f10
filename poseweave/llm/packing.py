"""Packing documents into windows: repeat counts of length combinations by non-negative least squares.

Documents are cut at every full window; what is left over has one of fewer lengths than the window has tokens, so the
histogram of lengths and the whole plan are of bounded size whatever the number of documents.  The plan says how often each
combination of lengths occurs; the pieces of a length are numbered across all partitions and take the places the
plan has for that length in turn.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poseweave.llm.common import ordered
from poseweave.llm.tokenfile import by_size
from poseweave.llm.tokens import default_vocabulary, encoder
from poseweave.session import pin

WINDOW = 2048
END_ID = 1
#: Most copies of the repeated length in a combination, and lengths tried as second part of a triple.
MOST_REPEATS = 16
SECOND_PARTS = 24
SWEEPS = 12


def pieces(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, start, length, doc_tokens, ids_crc32, ids, piece)`` of documents cut at every ``window`` tokens.

    Needs ``doc_id`` and ``text``; null text is empty and gives the end id alone; repeated rows give pieces of
    their own.  ``piece`` is unique.  The table is pinned.
    """
    vocabulary = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(vocabulary).ids, end_id.to_bytes(4, "little")
        for batch in batches:
            keys = batch.column("doc_id")
            for first, texts in by_size(batch.column("text")):
                rows, parts = [], []
                for k, text in enumerate(texts):
                    packed = encode(text) + tail
                    total = len(packed) // 4
                    for start in range(0, total, window):
                        part = packed[4 * start: 4 * (start + window)]
                        rows.append((first + k, start, len(part) // 4, total, zlib.crc32(part)))
                        parts.append(part)
                at, start, length, total, crc = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))
                bounds = np.zeros(len(parts) + 1, dtype=np.int32)
                np.cumsum(length, out=bounds[1:])
                ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(at)), *map(pa.array, (start, length, total, crc)), ids],
                    ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        cut, "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids array<int>")
    return pin(rows.withColumn("piece", F.monotonically_increasing_id()), "pieces")


def combinations(lengths: list[int], window: int = WINDOW) -> list[dict[int, int]]:
    """Shallow combinations of the given lengths that fill the window exactly: ``{length: how often}``.

    One length up to ``MOST_REPEATS`` times with one other, and triples whose second length is one of
    ``SECOND_PARTS`` spread over the lengths.
    """
    have, found = set(lengths), {}
    for a in lengths:
        for k in range(1, MOST_REPEATS + 1):
            rest = window - k * a
            if rest == 0 or rest in have:
                mix = {a: k + (rest == a)} if rest in (0, a) else {a: k, rest: 1}
                found[tuple(sorted(mix.items()))] = mix
    spread = lengths[:: max(1, len(lengths) // SECOND_PARTS)]
    for a in lengths:
        for b in spread:
            c = window - a - b
            if b < a and c in have and c < b:
                found[((c, 1), (b, 1), (a, 1))] = {a: 1, b: 1, c: 1}
    return list(found.values())


def repeat_counts(mixes: list[dict[int, int]], counts: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Non-negative repeat counts whose use of each length is nearest to ``counts`` in least squares.

    Coordinate descent: each combination in turn takes its best count, others held.
    """
    x, left = np.zeros(len(mixes)), counts.astype(float).tolist()
    columns = [(list(m.items()), sum(v * v for v in m.values())) for m in mixes]
    for _ in range(sweeps):
        for j, (parts, norm) in enumerate(columns):
            step = sum(v * left[a] for a, v in parts) / norm
            step = max(step, -x[j])
            if step:
                x[j] += step
                for a, v in parts:
                    left[a] -= step * v
    return x


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[list[int], int]]:
    """``(lengths of a sequence in order, how often)`` using every counted piece exactly once."""
    left = np.zeros(window + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[list[int], int]] = []
    if left[window]:
        out.append(([window], int(left[window])))
        left[window] = 0
    mixes = combinations(np.flatnonzero(left).tolist(), window)
    x = repeat_counts(mixes, left)
    for j in np.argsort(-x, kind="stable"):
        mix = mixes[j]
        times = min([int(x[j] + 0.5), *(int(left[a]) // v for a, v in mix.items())])
        if times > 0:
            out.append(([a for a in sorted(mix, reverse=True) for _ in range(mix[a])], times))
            for a, v in mix.items():
                left[a] -= times * v
    return out + _greedy(left, window)


def _greedy(left: np.ndarray, window: int) -> list[tuple[list[int], int]]:
    """The residual pieces, the longest first: filled exactly by one or two others, else with the longest that fits."""
    out, lengths = [], np.flatnonzero(left).tolist()

    def spare(a: int, used: dict[int, int]) -> int:
        return int(left[a]) - used.get(a, 0)

    def exact(space: int, used: dict[int, int]) -> list[int]:
        if spare(space, used) > 0:
            return [space]
        for k in range(bisect_right(lengths, space) - 1, -1, -1):
            b, c = lengths[k], space - lengths[k]
            if c > b:
                break
            if spare(b, used) > (b == c) and spare(c, used) > 0:
                return [b, c]
        return []

    while lengths:
        row, used, space = [], {}, window
        while space:
            found = exact(space, used) if row else []
            if found:
                row += found
                for a in found:
                    used[a] = used.get(a, 0) + 1
                break
            k = bisect_right(lengths, space) - 1
            while k >= 0 and used.get(lengths[k], 0) >= left[lengths[k]]:
                k -= 1
            if k < 0:
                break
            a = lengths[k]
            fit = min(space // a, spare(a, used)) if row else 1
            row += [a] * fit
            used[a] = used.get(a, 0) + fit
            space -= a * fit
        times = min(int(left[a]) // v for a, v in used.items())
        out.append((row, times))
        for a, v in used.items():
            left[a] -= times * v
        lengths = [a for a in lengths if left[a]]
    return out


def place(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(piece, sequence_id, offset)`` for every row of ``cut(piece, length)``; no rows for an empty table.

    Only the histogram of lengths, at most ``window`` rows, comes to the driver.  The table of places has a row for each
    length in each line of the plan; a plan has at most a few lines for each length.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places, used, sequence = [], dict.fromkeys(counts, 0), 0
    for row, times in plan(counts, window):
        offset = 0
        for length in row:
            places.append((length, used[length], used[length] + times, sequence - used[length], offset))
            used[length] += times
            offset += length
        sequence += times
    first = spark.createDataFrame([(n, s) for n, s in zip(sorted(counts), np.cumsum([0] + [counts[n] for n in sorted(counts)]).tolist(),
                                                          strict=False)], "length long, _first long")
    slots = spark.createDataFrame(places, "length long, _from long, _to long, _base long, offset long")
    ranked = ordered(cut.select("length", "piece"), ["length", "piece"], "packing-order").join(F.broadcast(first), "length")
    ranked = ranked.withColumn("_rank", F.col("_row") - F.col("_first"))
    return ranked.join(F.broadcast(slots), "length").where("_rank >= _from and _rank < _to").select(
        "piece", (F.col("_base") + F.col("_rank")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, piece)``: one row per piece."""
    cut = pieces(docs, window, end_id, vocabulary)
    return cut.drop("ids").join(place(cut, window), "piece").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "piece")


def sequences(cut: DataFrame, places: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """``(sequence_id, ids)``: every sequence padded to ``window``, unless its length is a power of two."""
    parts = cut.select("piece", "ids").join(places, "piece").groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))
    n = F.size("ids")
    pad = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(window - n)
    return parts.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), pad)).alias("ids"))
