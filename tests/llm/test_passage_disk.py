"""What the search for passages leaves on disk, and its seeds of many texts at once."""

import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from poseweave.llm.passages import minimizers, minimizers_of, repeats, word_hashes
from poseweave.llm.words import blocks
from poseweave.session import CLEANUP_KEY, pin


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p for f in folders for p in Path(f.getPath()).rglob("shuffle_*.data")}


def none_new(spark, before):
    for _ in range(50):
        if not shuffle_files(spark) - before:
            return True
        time.sleep(0.1)
    return False


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP_KEY)
    out = pin(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "few")
    assert none_new(spark, before)
    assert spark.conf.get(CLEANUP_KEY) == setting
    assert sorted(r["count"] for r in out.collect()) == [142] * 1 + [143] * 6


def test_passages_leave_no_shuffle_files_before_the_result_is_read(spark):
    rng, before = np.random.default_rng(5), shuffle_files(spark)
    line = " ".join(f"w{k}" for k in rng.integers(0, 10**6, 80))
    texts = [" ".join(f"v{k}" for k in rng.integers(0, 10**6, 50)) + " " + line for _ in range(4)]
    found = repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert none_new(spark, before)
    assert sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in found.collect()) == [(k, 50, 130) for k in (1, 2, 3)]


@pytest.mark.parametrize("window", [1, 2, 5, 6, 21])
def test_minimizers_of_many_texts_are_those_of_each(window):
    rng = np.random.default_rng(window)
    for _ in range(200):
        bounds = np.concatenate([[0], np.cumsum(rng.integers(0, 40, rng.integers(0, 8)))]).astype(np.int64)
        values = rng.integers(0, 6, bounds[-1]).astype(np.uint64)
        each = [a + minimizers(values[a:b], window) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        places, n = minimizers_of(values, bounds, window)
        assert places.tolist() == [p for own in each for p in own.tolist()]
        assert n.tolist() == [len(own) for own in each]


def test_word_hashes_of_repeated_texts():
    texts = [None, "", "", "a b", "a b", "c", "a b", None, "c  d", "c  d"]
    each = [next(blocks([t]))[1].hashes.tolist() for t in texts]
    assert [h.tolist() for h in word_hashes(pa.array(texts))] == each
    assert list(word_hashes(pa.array([], pa.string()))) == []
