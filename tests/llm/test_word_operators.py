"""Periodic runs, spelling variants and language identification against brute force and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from poseweave.llm import language, runs, spelling
from poseweave.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")


def documents(spark, sf_dir=SMALL):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def runs_by_definition(words, min_length=24, min_exponent=3):
    found = []
    for q in range(1, len(words) // min_exponent + 1):
        start = 0
        for i in range(q, len(words) + 1):
            if i == len(words) or words[i] != words[i - q]:
                part = words[start:i]
                if len(part) >= max(min_length, min_exponent * q) and not any(
                        all(a == b for a, b in zip(part, part[p:])) for p in range(1, q)):
                    found.append((start, len(part), q))
                start = i - q + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(rng, n):
    words = [b"%d" % rng.randrange(rng.choice([1, 2, 5, 60])) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n else 0):
        a, p = rng.randrange(n), rng.randint(1, 15)
        for i in range(a + p, min(n, a + rng.randint(1, 100))):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("min_length, min_exponent", [(24, 3), (6, 2), (1, 2), (12, 4)])
def test_runs_are_those_of_the_definition(min_length, min_exponent):
    rng = random.Random(min_length)
    for _ in range(60):
        texts = [random_words(rng, rng.randint(0, 130)) for _ in range(4)]
        want = [runs_by_definition(words, min_length, min_exponent) for words in texts]
        assert runs.text_runs(texts, min_length, min_exponent) == want
        assert [runs.runs_of(words, min_length, min_exponent) for words in texts] == want


def test_segments_are_the_last_occurrences():
    rng = random.Random(5)
    words = [rng.randrange(3) for _ in range(60)]
    for end, old, length in runs.segments(words):
        part = words[end + 1 - length: end + 1]
        ends = [k for k in range(length - 1, end) if words[k + 1 - length: k + 1] == part]
        assert ends and ends[-1] == old


def test_runs_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SMALL).collect()}
    texts = documents(spark)
    assert len(got) == len(texts)
    for doc_id, text in texts:
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue
        want = runs_by_definition(words)
        gone = {k for s, m, p in want for k in range(s + p, s + m)}
        row = got[doc_id]
        best = min(want, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        assert (row.n_runs, row.start, row.length, row.period) == (len(want), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert row.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % r for r in want).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()


def test_runs_of_odd_rows(spark):
    long_text = "a b\tc\n" * 40_000
    rows = [(1, None, 7), (None, "", 7), (2, " \t", 7), (3, long_text, 7), (3, long_text, 7), (4, "É " * 24, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    out = runs.periodic_runs(docs).orderBy("doc_id").collect()
    assert [r.doc_id for r in out] == [None, 1, 2, 3, 3, 4] and [r.n_words for r in out] == [0, 0, 0, 120_000, 120_000, 24]
    assert [[tuple(x) for x in r.runs] for r in out] == [[], [], [], [(0, 120_000, 3)], [(0, 120_000, 3)], [(0, 24, 1)]]
    assert [r.collapsed for r in out] == ["", "", "", "a b c", "a b c", "É"]
    assert runs.periodic_runs(docs.where("doc_id = 99")).collect() == []
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, min_exponent=1)


def near_by_definition(counts):
    near, like = defaultdict(set), defaultdict(set)
    for word in counts:
        for i in range(len(word)):
            like[word[:i] + "\0" + word[i + 1:]].add(word)
            shorter = word[:i] + word[i + 1:]
            if shorter in counts:
                near[word].add(shorter)
                near[shorter].add(word)
    for group in like.values():
        for word in group:
            near[word] |= group - {word}
    return near


def variants_by_definition(counts, ratio=5):
    near = near_by_definition(counts)
    form = {}
    for word, n in counts.items():
        best = min(near[word], key=lambda w: (-counts[w], w), default=None)
        form[word] = best if best is not None and counts[best] >= ratio * n else None

    def root(word):
        while form[word] is not None:
            word = form[word]
        return word

    return {w: (form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def as_dict(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def test_spelling_query_equals_brute_force(spark):
    counts = Counter()
    for doc_id, text in documents(spark):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1:]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert as_dict(QUERIES["op12_spelling"](spark, SMALL)) == variants_by_definition(counts)


@pytest.mark.parametrize("block_words", [2, 4096])
def test_near_words_of_dense_vocabularies(spark, block_words):
    """Short words over few letters: every block is crowded, insertions have several places, chains are long."""
    rng = random.Random(block_words)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(700)}
    counts = {w: 6 ** rng.randint(0, 5) for w in sorted(words)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = as_dict(spelling.variants(frame, block_words=block_words))
    assert got == variants_by_definition(counts)
    assert any(got[r[0]][0] for r in got.values() if r[0])


def test_spelling_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "Ünder ünder ABCDEF abcdef"), (3, "abcdef漢abcdef×abcdeg " * 3), (3, "abcdef漢abcdef×abcdeg " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = {r.word: r.n for r in spelling.vocabulary(docs, min_count=1).collect()}
    assert counts == {"abcdef": 8, "abcdef×abcdeg": 6}
    assert {r.word for r in spelling.vocabulary(docs, min_letters=5, min_count=1).collect()} == {"abcdef", "abcdef×abcdeg", "Ünder", "ünder"}
    assert spelling.variants(spelling.vocabulary(docs.where("doc_id = 9"))).collect() == []
    assert spelling.variants(spark.createDataFrame([(None, 3)], "word string, n long")).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "word string, n long"), min_ratio=1)


def test_language_query_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = QUERIES["op13_language"](spark, sf_dir).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    held = [zlib.crc32(str(k).encode()) % 4 == 2 for k in got.index]
    assert got.held_out.tolist() == held
    mine = got[got.held_out].join(docs)
    assert (mine.lang_pred == mine.lang).mean() > 0.98
    sure = mine[mine.accepted]
    assert len(sure) > 0.9 * len(mine) and (sure.lang_pred == sure.lang).mean() > 0.995


def test_language_learns_only_from_given_rows(spark):
    train = [(k, "xx" if k % 2 else "yy", "bimo fara tolu kesa" if k % 2 else "grunt hask welp jorm") for k in range(60)]
    wrong = [(k, "xx", "grunt hask welp jorm grunt") for k in range(1000, 1400) if zlib.crc32(str(k).encode()) % 4 == 2]
    none = [(None, "xx", "grunt hask"), (70, None, "grunt hask"), (71, "xx", None), (72, "zz", "")]
    docs = spark.createDataFrame(train + wrong + none, "doc_id long, lang string, text string")
    model = language.fit(docs)
    assert sorted(model.contents) == ["xx", "yy"]
    asked = [(1, "Hask GRUNT!", "a"), (2, "fara bimo", "b"), (3, "12 ²³ 4", "c"), (4, None, "d"), (5, "", "e"), (6, "漢字", "f"), (2, "fara bimo", "b"),
             (7, "welp jorm " * 50_000, "g")]
    out = language.identify(spark.createDataFrame(asked, "doc_id long, text string, score string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in out] == ["yy", "xx", "xx", "und", "und", "und", out[6].lang_pred, "yy"] and out[6].lang_pred in ("xx", "yy")
    assert [r.accepted for r in out] == [True, True, True, False, False, False, False, True]
    assert all(0 <= r.score <= 1 for r in out) and all(r.score == 0 for r in out if r.lang_pred == "und")
    nothing = language.fit(docs.where("doc_id > 5000"))
    assert nothing.contents == {} and {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.where("doc_id > 5000"), model).collect() == []
