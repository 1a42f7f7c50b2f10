"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

A word's score is its log-odds between toxic and clean labelled documents under an informative Dirichlet prior; words
without clear evidence have the (slightly negative) score of all other words.  A linear-time scan finds every maximal segment
of a text.  The chance of a segment score in clean text follows an extreme-value law whose two constants are fitted
on clean documents; the joint chance of a text's best segments is turned into a probability by a logistic curve.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poseweave.llm.common import with_text_columns
from poseweave.llm.words import Words, blocks, mixed

#: Bound of the labelled sample: rows of each class, the first in a seeded order.
SAMPLE_ROWS = 16_384
#: Weight of the prior (the pooled distribution) as a share of all counts, evidence (z) and log-odds a word needs, and most words of a model.
PRIOR_SHARE = 0.02
MIN_Z, MIN_ODDS, MOST_WORDS = 4.0, 1.0, 20_000
#: Word beginnings, in bytes, that stand in for words without evidence of their own; the longest known counts.
BEGINNINGS = (6, 4)
#: A passage is reported when fewer than this many of its score are expected by chance in a text of the length.
MOST_EXPECTED = 0.05
THRESHOLD = 0.7
FILTER_BITS = 20

#: Letters and digits of ASCII, and every byte of other characters.
IS_TOKEN = np.zeros(256, dtype=bool)
IS_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def held_out(doc_id: str = "doc_id"):
    """Whether a row's label is never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    """Sorted word hashes with their scores, the score of other words, and the calibration."""

    keys: np.ndarray
    odds: np.ndarray
    other: float
    rate: float = 1.0
    scale: float = 1.0
    slope: float = 1.0
    bias: float = 0.0

    def __post_init__(self):
        self.maybe = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.maybe[(self.keys & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True

    def scores(self, words: Words) -> np.ndarray:
        out = np.full(len(words.hashes), self.other)
        if len(self.keys):
            for keys in [*(words.prefixes(n) for n in reversed(BEGINNINGS)), words.hashes]:
                hit = np.flatnonzero(self.maybe[(keys & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.keys, keys[hit]), len(self.keys) - 1)
                same = self.keys[at] == keys[hit]
                out[hit[same]] = self.odds[at[same]]
        return out

    def surprise(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """Minus the log of the chance that clean text of ``n`` words has segments as good as the best of these."""
        best, total = 0.0, 0.0
        for r, score in enumerate(sorted((s for _, _, s in segments), reverse=True), 1):
            total += self.rate * score - math.log(self.scale * max(n, 2))
            if total <= r:
                break
            chance = total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2)
            best = max(best, chance)
        return best

    def probability(self, surprise: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * math.log1p(surprise) + self.bias))))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """``(start, end, score)`` of all maximal scoring segments: those of which no part beats the whole and that no
    neighbour would improve.  Linear time; only positive scores are visited one by one."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    low, high = sums[up].tolist(), sums[up + 1].tolist()
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    back: list[int] = []  # the nearest earlier segment that starts lower
    for start, left, right in zip(up.tolist(), low, high, strict=True):
        end = start + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = back[j]
            if j < 0 or found[j][3] >= right:
                found.append((start, end, left, right))
                back.append(j)
                break
            start, left = found[j][0], found[j][2]
            del found[j:], back[j:]
    return [(a, b, high - low) for a, b, low, high in found]


def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean texts each word and word beginning occurs, summed per block of texts; key 0 has all."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        for first, words in blocks(batch.column("text"), IS_TOKEN):
            keys, flags, words_in = [], [], [0, 0]
            for k in range(len(words.first) - 1):
                a, b = words.first[k], words.first[k + 1]
                words_in[int(toxic[first + k])] += len(np.unique(words.hashes[a:b]))
            owner = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
            for hashes in (words.hashes, *(words.prefixes(n) for n in BEGINNINGS)):
                seen = np.unique(np.stack([hashes, owner.astype(np.uint64)], axis=1), axis=0)
                keys.append(seen[:, 0])
                flags.append(toxic[first + seen[:, 1].astype(np.int64)])
            own, at = np.unique(np.concatenate(keys), return_inverse=True)
            bad = np.bincount(at, weights=np.concatenate(flags), minlength=len(own)).astype(np.int64)
            all_of = np.bincount(at, minlength=len(own)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(own.view(np.int64), 0)), pa.array(np.append(bad, words_in[1])),
                 pa.array(np.append(all_of - bad, words_in[0]))], ["key", "bad", "good"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 0) -> Model:
    """Fit on at most ``sample_rows`` labelled rows of each class; rows that are held out are never read.

    Rows with a null id, text or label teach nothing; a repeated label row counts once.  Without rows of both classes the
    model knows no words and scores everything 0.5.  Word counts are summed by Spark; the driver gets the words
    with clear evidence (at most ``MOST_WORDS``) and one number for each sampled row.
    """
    spark = docs.sparkSession
    usable = labels.where(~held_out() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    order = F.xxhash64("doc_id", F.lit(seed))
    totals = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = [r for y in (0, 1) for r in usable.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(sample_rows).collect()]
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), -1.0, slope=0.0)
    if len(totals) < 2:
        return empty
    sample = spark.createDataFrame(chosen, "doc_id long, toxic int").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(4)))
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id")
    found = texts.where("part <> 0").select("text", "toxic").mapInArrow(counts, "key long, bad long, good long")
    found = found.groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).persist()
    all_of = found.where("key = 0").first()
    bad_all, good_all = (all_of["bad"], all_of["good"]) if all_of else (0, 0)
    if not bad_all or not good_all:
        found.unpersist()
        return empty
    prior_words = PRIOR_SHARE * (bad_all + good_all)
    prior = (F.col("bad") + F.col("good")) * PRIOR_SHARE
    bad, good = F.col("bad") + prior, F.col("good") + prior
    odds = F.log(bad / (bad_all + prior_words - bad)) - F.log(good / (good_all + prior_words - good))
    z = odds / F.sqrt(1 / bad + 1 / good)
    clear = found.where("key <> 0").select("key", "bad", "good", odds.alias("odds"), z.alias("z")).where(
        (F.col("z") >= MIN_Z) & (F.col("odds") >= MIN_ODDS)).orderBy(F.desc("z"), "key").limit(MOST_WORDS).toPandas()
    found.unpersist()
    keys = clear["key"].to_numpy(np.int64).view(np.uint64)
    by_key = np.argsort(keys)
    # Beginnings repeat their words' evidence; the share of known words is taken from the larger of the two views.
    share = [min(0.5, (clear[c].sum() / (1 + len(BEGINNINGS)) + 0.5) / (n + 1)) for c, n in (("bad", bad_all), ("good", good_all))]
    model = Model(keys[by_key], clear["odds"].to_numpy(float)[by_key], min(-0.01, math.log1p(-share[0]) - math.log1p(-share[1])))
    return _calibrated(model, texts, totals)


def _calibrated(model: Model, texts: DataFrame, totals: dict[int, int]) -> Model:
    """Constants of the extreme-value law from clean rows, then the logistic curve, on rows no word was learnt from."""
    rows = texts.where("part = 0").select("doc_id", "text", "toxic").mapInArrow(
        lambda batches: _segments(batches, model, ["doc_id", "toxic"]), f"doc_id long, toxic int, {SEGMENTS}")
    rows = rows.select("toxic", "n_words", "passages.score").collect()
    clean = [(max(r["score"], default=0.0), max(r["n_words"], 2)) for r in rows if r["toxic"] == 0]
    if len(clean) >= 20:
        # Of n independent words one has the score by chance exp(-rate * score): log-regression through the upper tail.
        top = np.array([s for s, _ in clean])
        size = np.log(np.array([n for _, n in clean]))
        tail = top > 0
        model.rate = float(1 / max(np.mean(top[tail]), 1e-6)) if tail.any() else 1.0
        model.rate = min(1.0, max(0.1, model.rate))
        model.scale = float(max(1e-4, min(1.0, np.exp(np.mean(model.rate * top - size) - 0.5772))))
    y = np.array([r["toxic"] for r in rows], dtype=float)
    x = np.log1p([model.surprise([(0, 0, s) for s in r["score"]], r["n_words"]) for r in rows])
    if len(set(y)) == 2:
        n_bad, n_good = y.sum(), len(y) - y.sum()
        weight = np.where(y == 1, totals[1] / n_bad, totals[0] / n_good)
        model.slope, model.bias = _logistic(x, y, weight / weight.mean())
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and bias by Newton steps with a small ridge."""
    slope, bias = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + bias, -30, 30)))
        w, d = weight * p * (1 - p) + 1e-9, weight * (p - y)
        g = np.array([np.sum(d * x) + 1e-2 * slope, np.sum(d)])
        h = np.array([[np.sum(w * x * x) + 1e-2, np.sum(w * x)], [np.sum(w * x), np.sum(w)]])
        step = np.linalg.solve(h, g)
        slope, bias = slope - step[0], bias - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(slope)), float(bias)


SEGMENTS = "n_words long, surprise double, passages array<struct<start_word: int, end_word: int, score: double, expected: double>>"
PASSAGE = pa.struct([("start_word", pa.int32()), ("end_word", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])


def _segments(batches: Iterator[pa.RecordBatch], model: Model, kept: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, surprise, passages = [], [], []
        for _, words in blocks(batch.column("text"), IS_TOKEN):
            scores = model.scores(words)
            for a, b in zip(words.first[:-1], words.first[1:], strict=True):
                found = maximal_segments(scores[a:b])
                n = int(b - a)
                n_words.append(n)
                surprise.append(model.surprise(found, n))
                passages.append([{"start_word": s, "end_word": e, "score": v, "expected": model.scale * max(n, 2) * math.exp(
                    -min(700.0, model.rate * v))} for s, e, v in found])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n_words, pa.int64()), pa.array(surprise, pa.float64()),
                                          pa.array(passages, pa.list_(PASSAGE))], [*kept, "n_words", "surprise", "passages"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, predicted, n_words, passages)``, one row for each row of ``docs(doc_id, text)``.

    ``passages`` holds the significant segments as word spans.  Null and empty texts have none and the lowest score.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _segments(batches, model, ["doc_id"]):
            chance = pa.array([model.probability(s) for s in out.column("surprise").to_pylist()], pa.float64())
            yield out.append_column("score", chance)

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {SEGMENTS}, score double")
    passages = F.filter("passages", lambda p: p["expected"] <= MOST_EXPECTED)
    return rows.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_words", passages.alias("passages"))


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``; all columns stay as they are, whatever their names."""
    own = "_score"
    while own in {c.lower() for c in docs.columns}:
        own += "_"

    def run(texts: pa.Array) -> dict[str, list]:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        return {own: [model.probability(s) for s in next(_segments(iter([batch]), model, [])).column("surprise").to_pylist()]}

    return with_text_columns(docs, run, {own: "double"}).where(F.col(own) < threshold).drop(own)
