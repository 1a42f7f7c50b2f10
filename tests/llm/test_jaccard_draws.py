"""Large groups of near copies in the Jaccard join: work in proportion to the group, and the same classes as by brute force."""

import random

from pyspark.sql import functions as F

from poseweave.llm import jaccard


def brute_force(texts: list[str], size: int, percent: int) -> list[int]:
    sets = []
    for text in texts:
        words = text.split()
        sets.append({tuple(words[k: k + size]) for k in range(len(words) - size + 1)})
    low = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(a):
                if low[a] != low[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    return low


def near_copies(n: int) -> list[str]:
    """Copies of one text with two words changed, then others with one: the first are mostly not alike, any other pair is."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(n):
        own = list(words)
        for place in rng.sample(range(6, 144), 2 if k < n // 2 else 1):
            own[place] = f"x{k}y{place}"
        texts.append(" ".join(own))
    return texts


def test_pairs_of_a_large_group_grow_with_its_size(spark, monkeypatch):
    texts, pinned, pin = near_copies(240), {}, jaccard.pin

    def counted(df, label):
        pinned.setdefault(label, []).append(pin(df, label))
        return pinned[label][-1]

    monkeypatch.setattr(jaccard, "pin", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r.component_id for r in jaccard.link(docs, 5, 80).collect()}
    assert [found[k] for k in range(len(texts))] == brute_force(texts, 5, 80)
    # All 120 * 120 pairs of the two halves are alike.
    assert pinned["cross-pairs"][0].count() <= 2 * len(texts)


def test_entries_of_the_same_sets_count_once(spark):
    texts = near_copies(40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    entries = jaccard.index_entries(jaccard.described(docs, 5, 80), 80)
    members = entries.groupBy("entry").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    assert members.count() == members.select("rows").distinct().count() > 0
