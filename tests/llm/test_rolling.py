"""Hashes of long runs of words in one pass, and the passages found with them."""

import numpy as np
import pyarrow as pa

from poseweave.llm.passages import EXACT_SEED, MIN_WORDS, repeats, seeds
from poseweave.llm.words import blocks, rolling, shingles


def texts_of(rng, n):
    return [" ".join(f"w{k}" for k in rng.integers(0, 2, rng.integers(0, 70))) for _ in range(n)] + [None, "", " one "]


def test_rolling_hashes_are_equal_where_runs_are():
    rng = np.random.default_rng(11)
    for size in (1, 2, 5, 30, 50):
        [(first, words)] = blocks(pa.array(texts_of(rng, 60) * 2, pa.string()))
        own, bounds = rolling(words, size)
        plain, expected = shingles(words, size, whole_if_short=False)
        assert first == 0 and bounds.tolist() == expected.tolist()
        assert len(np.unique(own)) == len(np.unique(plain)) == len(set(zip(own.tolist(), plain.tolist(), strict=True)))


def test_words_are_hashed_as_single_texts_are():
    raw = "".join(chr(k) for k in range(1, 0x250)) + "ÀA Z[ @ az{`\t\x0b\x0c"
    texts = [raw, "A", "a b", "", "B", None, raw.lower()]
    [(_, words)] = blocks(texts)
    for t, text in enumerate(texts):
        own = words.hashes[words.first[t]: words.first[t + 1]].tolist()
        kept = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace(
            "\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        assert own == [next(blocks([w]))[1].hashes[0] for w in kept]


def test_exact_seeds_and_repeated_rows(spark):
    rng = np.random.default_rng(12)
    shared = " ".join(f"s{k}" for k in rng.integers(0, 10**6, MIN_WORDS))
    rows = [(k, " ".join(f"v{j}" for j in rng.integers(0, 10**6, 40 + k)) + f" {shared}") for k in range(3)]
    docs = spark.createDataFrame(rows + rows[1:], "doc_id long, text string")
    found = seeds(docs, EXACT_SEED, exact=True).toPandas()
    assert found.groupby("seed")["doc_id"].nunique().max() == 3
    out = sorted((r["doc_id"], r["start_word"], r["end_word"], r["other_id"]) for r in repeats(docs).collect())
    assert out == [(k, 40 + k, 40 + k + MIN_WORDS, 0) for k in (1, 2)]
