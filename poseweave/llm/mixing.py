"""Mixing sources to target weights: each source's word budget is met by whole documents.

Documents are counted by exact length within their source; a bounded-knapsack search chooses how many of each length
to take, and documents of a length are taken in a seeded order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poseweave.llm.common import ordered, with_text_columns
from poseweave.llm.words import count_words
from poseweave.session import pin

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
#: Words left to the exact search; the rest of a budget is spread evenly over the lengths first.
SEARCH_WORDS = 1 << 16


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``, the number of words of ``text``; null text has none."""
    return with_text_columns(docs, lambda texts: {"size": count_words(texts)}, {"size": "long"})


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``; one row per source, null allowed.

    Weights repeat over the sources by code point, null last.  All words together are shared by weight; a target stops
    at ``most`` times its source's size, and the excess is shared again until none is above.  Every round
    takes two sums; the sources stay distributed.
    """
    rows = ordered(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "sources").drop("_null")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_row") % len(weights) + 1).cast("int"))
    rows = pin(rows.withColumns({"_weight": weight, "_most": most * F.col("source_size")}).drop("_row"), "source-weights")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    share, before = 0.0, -1
    full = F.lit(False)
    while True:
        n, spent, open_weight = rows.agg(F.count_if(full), F.sum(F.when(full, F.col("_most")).otherwise(0)),
                                         F.sum(F.when(full, 0).otherwise(F.col("_weight")))).first()
        if not open_weight or n == before:
            break
        share, before = (total - spent) / open_weight, n
        full = full | (F.col("_most") < F.lit(share) * F.col("_weight"))
    return rows.select("source", "source_size", F.least(
        F.col("_most").cast("double"), F.lit(share) * F.col("_weight")).alias("target"))


def choose(lengths: np.ndarray, counts: np.ndarray, budget: int, search: int = SEARCH_WORDS) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest to ``budget`` from below.

    Most of the budget takes the same share of every length; single documents in order follow while they leave more than the
    search budget; a bounded knapsack over the rest finds the sums that can be reached exactly.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    left = budget
    if budget > search:
        take = np.floor(counts * ((budget - search) / total)).astype(np.int64)
        left -= int((take * lengths).sum())
        for k in np.argsort(-lengths, kind="stable"):
            if left <= search:
                break
            more = min(int(counts[k] - take[k]), (left - search) // int(lengths[k]))
            if more > 0:
                take[k] += more
                left -= more * int(lengths[k])
    came = np.full(left + 1, -1, dtype=np.int64)
    parts: list[tuple[int, int]] = []
    reach, mask = 1, (1 << (left + 1)) - 1
    for k in np.argsort(lengths, kind="stable"):
        spare, step = int(counts[k] - take[k]), 1
        while spare > 0 and not reach >> left & 1:
            step = min(step, spare)
            width = step * int(lengths[k])
            if width > left:
                break
            fresh = (reach << width) & mask & ~reach
            if fresh:
                bits = np.unpackbits(np.frombuffer(fresh.to_bytes(left // 8 + 1, "little"), dtype=np.uint8), bitorder="little")
                came[np.flatnonzero(bits[: left + 1])] = len(parts)
                parts.append((int(k), step))
                reach |= fresh
            spare, step = spare - step, step * 2
    best = reach.bit_length() - 1
    while best > 0:
        k, step = parts[came[best]]
        take[k] += step
        best -= step * int(lengths[k])
    return take


def _keys():
    return (F.xxhash64("doc_id", "source", "text").alias("key_a"), F.xxhash64(F.lit(1), "text", "source", "doc_id").alias("key_b"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 0) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, key_a, key_b)``, one row per row of ``docs``.

    ``docs`` needs ``doc_id``, ``source`` and ``text``.  ``copies`` (0 to ``most``) says how often the mix takes the
    document.  Null texts have size 0; a source without words has target 0; repeated rows are documents of their own and
    share their keys, the hashes of the three columns.  The choice depends on rows and seed only.
    """
    base = sized(docs.select("doc_id", "source", "text", *_keys())).drop("text")
    base = pin(base, "sizes")
    wanted = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    # A group holds one row per length of a source, at most as many as its longest document has words.
    lengths = base.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    lengths = lengths.join(wanted, lengths["source"].eqNullSafe(wanted["source"])).select(
        lengths["source"], "size", "n", "source_size", "target")

    def picks(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        target, whole = rows["target"].iloc[0], int(rows["source_size"].iloc[0])
        copies = min(int(target // whole), most)
        extra = np.zeros(len(rows), dtype=np.int64) if copies == most else choose(
            rows["size"].to_numpy(), rows["n"].to_numpy(), round(target - copies * whole))
        return rows[["source", "size"]].assign(source_size=whole, target=target, whole=copies, extra=extra)

    chosen = lengths.groupBy("source").applyInPandas(
        picks, "source string, size long, source_size long, target double, whole long, extra long")
    keys = ["_null", "_source", "size"]
    plain = {"_null": F.col("source").isNull(), "_source": F.coalesce("source", F.lit(""))}
    rows = ordered(base.withColumns(plain | {"_order": F.xxhash64("doc_id", F.lit(seed))}), [*keys, "_order", "doc_id", "key_a"], "mix-order")
    first = rows.groupBy(*keys).agg(F.min("_row").alias("_first"))
    # Written, so that the join below shuffles both sides itself and a length with very many documents can be split.
    some = pin(first.join(chosen.withColumns(plain).drop("source", "source_size", "target"), keys, "left"), "mix-picks")
    all_targets = wanted.withColumns(plain).drop("source")
    copies = F.coalesce(F.col("whole") + F.when(F.col("_row") - F.col("_first") < F.col("extra"), 1).otherwise(0), F.lit(0))
    return rows.join(some, keys).join(all_targets, ["_null", "_source"]).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), "key_a", "key_b")


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; all columns stay as they are."""
    copies = mix(docs, weights, most, seed).groupBy("key_a", "key_b").agg(F.sum("copies").cast("int").alias("_copies")).where("_copies > 0")
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"), *_keys())
    # Rows alike in id, source and text share one sum of copies, given to one of them.
    rows = rows.join(copies, ["key_a", "key_b"]).dropDuplicates(["key_a", "key_b"])
    return rows.select("_row", F.explode(F.sequence(F.lit(1), "_copies"))).select("_row.*")
