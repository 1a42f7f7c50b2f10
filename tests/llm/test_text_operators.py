"""Words, tokens, token files, packing, mixing and toxicity against plain recomputation."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from poseweave.llm import mixing, packing, tokenfile, toxicity
from poseweave.llm.tokens import Encoder, default_vocabulary
from poseweave.llm.words import blocks, count_words, shingles
from poseweave.session import new_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", None, " \t\n", "One two  three\nfour", "É é A a", "<|endoftext|> it's 12½ 中文 x y", "word " * 3000, "a"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_words_and_shingles_match_a_plain_split():
    sets = []
    for _, words in blocks(TEXTS):
        values, bounds = shingles(words, 3, whole_if_short=True)
        sets += [values[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert count_words(TEXTS).tolist() == [len(WORD.findall(t or "")) for t in TEXTS]
    for text, got in zip(TEXTS, sets, strict=True):
        own = WORD.findall(lower(text))
        plain = [tuple(own[k: k + 3]) for k in range(len(own) - 2)] if len(own) >= 3 else [tuple(own)] if own else []
        assert len(got) == len(plain) and len(set(got)) == len(set(plain))


def test_encoder_gives_the_library_s_ids():
    e = Encoder(default_vocabulary())
    random.seed(3)
    signs = "ab'sTrevmld  \n\t.,!?é09½µ\x1e\xa0’ß中'll're"
    for text in [t or "" for t in TEXTS] + ["".join(random.choices(signs, k=random.randint(0, 40))) for _ in range(2000)]:
        assert np.frombuffer(e.ids(text), "<u4").tolist() == e.library.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(k % 5 if k else None, t, "src0" if k % 3 else None, k, k) for k, t in enumerate(TEXTS * 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long, length long").cache()


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, odd_docs, encoding):
    path = new_path(spark, "tokens-test")
    tokenfile.write_tokens(odd_docs, path, encoding=encoding)
    e = Encoder(default_vocabulary())
    want = Counter((r.doc_id, zlib.crc32(e.ids(r.text) + b"\2\0\0\0"), len(e.ids(r.text)) // 4 + 1) for r in odd_docs.collect())
    got = tokenfile.token_index(spark, path).collect()
    assert Counter((r.doc_id, r.ids_crc32, r.n_tokens) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    empty = new_path(spark, "tokens-test")
    tokenfile.write_tokens(odd_docs.limit(0), empty, encoding=encoding)
    assert tokenfile.token_index(spark, empty).count() == 0


def test_packing_places_every_id_once(spark, odd_docs):
    rows = packing.pack(odd_docs, window=64).collect()
    e = Encoder(default_vocabulary())
    by_doc = Counter()
    for r in rows:
        by_doc[r.doc_id] += r.length
    want = Counter()
    for r in odd_docs.collect():
        want[r.doc_id] += len(e.ids(r.text)) // 4 + 1
    assert by_doc == want
    spans = {}
    for r in rows:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(spans) == list(range(len(spans)))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(odd_docs.limit(0), window=64).count() == 0
    cut = packing.pieces(odd_docs, window=64)
    made = packing.sequences(cut, packing.place(cut, 64), 64).collect()
    assert all(len(s.ids) == 64 or (len(s.ids) & (len(s.ids) - 1)) == 0 for s in made)


def test_plan_uses_each_piece_once_and_pads_little():
    random.seed(1)
    counts = Counter(random.randint(1, 2048) for _ in range(20000))
    used = Counter()
    for row, times in packing.plan(counts):
        assert sum(row) <= 2048
        for length in row:
            used[length] += times
    assert used == counts
    sequences = sum(t for _, t in packing.plan(counts))
    # Ten pieces a length, no small ones to spare: the hardest case for whole pieces.
    assert sequences <= 1.03 * sum(k * v for k, v in counts.items()) / 2048


def test_choose_reaches_reachable_sums():
    random.seed(2)
    for _ in range(200):
        lengths = np.array(sorted(random.sample(range(1, 30), 4)))
        counts = np.array([random.randint(1, 4) for _ in lengths])
        budget = random.randint(0, int((lengths * counts).sum()))
        take = mixing.choose(lengths, counts, budget)
        sums = {0}
        for length, n in zip(lengths, counts, strict=True):
            sums = {s + k * length for s in sums for k in range(n + 1)}
        assert (take <= counts).all() and (take * lengths).sum() == max(s for s in sums if s <= budget)


def test_mix_meets_targets(spark, odd_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert mixing.mix(odd_docs.limit(0)).count() == 0
    sources = {r.source: (r.source_size, r.target) for r in rows}
    total = sum(s for s, _ in sources.values())
    assert abs(sum(t for _, t in sources.values()) - total) < 1e-6 * max(1, total)
    for source, (size, target) in sources.items():
        own = [r for r in rows if r.source == source]
        assert size == sum(r.size for r in own) and target <= 3 * size
        assert all(r.copies <= 3 for r in own)
    again = {(r.doc_id, r.key_a, r.copies) for r in mixing.mix(odd_docs.repartition(3)).collect()}
    assert again == {(r.doc_id, r.key_a, r.copies) for r in rows}
    assert mixing.taken(odd_docs).columns == odd_docs.columns
    assert mixing.taken(odd_docs).count() == sum(r.copies for r in rows)


def test_targets_share_the_excess_again(spark):
    sizes = spark.createDataFrame([("a", 600), ("b", 30), ("c", 0), (None, 370)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # b stops at 90 and c at 0; the rest is shared 1 to 1 (weights 1 and 1).
    assert got == {"a": 455.0, "b": 90.0, "c": 0.0, None: 455.0}


def plain_segments(scores):
    """All maximal scoring segments from their definition, by trying every segment."""
    def split(a, b):
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        i, j = best[3], best[4]
        return split(a, i) + [(i, j)] + split(j, b)

    return split(0, len(scores))


def test_maximal_segments_match_their_definition():
    random.seed(5)
    for _ in range(300):
        scores = [random.choice([-3, -2, -1, 1, 2, 4]) + random.random() / 100 for _ in range(random.randint(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(np.array(scores))] == plain_segments(scores)


def test_toxicity_learns_and_never_reads_held_out_labels(spark):
    random.seed(7)
    clean = [" ".join(random.choices(["sun", "rain", "tree", "river", "stone", "bird", "leaf"], k=60)) for _ in range(600)]
    docs = [(k, t if k % 6 else t + " vile rotten vile rotten") for k, t in enumerate(clean)] + [(9001, None), (9002, ""), (None, "vile")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(k, int(k % 6 == 0), 1) for k in range(600)] + [(None, 1, 0), (3, None, 0)], "doc_id long, toxic int, quality int")
    wrong = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    models = [toxicity.fit(docs, t) for t in (labels, wrong)]
    assert np.array_equal(models[0].odds, models[1].odds) and models[0].slope == models[1].slope
    rows = {r.doc_id: r for r in toxicity.score(docs, models[0]).collect()}
    assert len(rows) == 603 and all(0 <= r.score <= 1 for r in rows.values())
    assert all(rows[k].predicted == int(k % 6 == 0) for k in range(600))
    assert rows[9001].score == rows[9002].score and rows[9001].predicted == 0
    assert all(rows[k].passages for k in range(0, 600, 6)) and not any(rows[k].passages for k in range(1, 600, 6))
    kept = toxicity.clean(docs, models[0])
    assert kept.columns == docs.columns and kept.where("doc_id % 6 = 0").count() == 0 and kept.where("doc_id % 6 > 0").count() == 502
    named = toxicity.clean(docs.withColumns({"_score": F.lit(7), "_Score_": F.lit(8)}), models[0])
    assert named.columns == [*docs.columns, "_score", "_Score_"]
    assert {r.doc_id for r in named.where("`_score` = 7").collect()} == {r.doc_id for r in kept.collect()}
    blank = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, blank).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), models[0]).count() == 0
