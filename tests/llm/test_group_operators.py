"""Joins, passages, sketches, chats, vectors and pages against brute force, with nulls, ties, empty tables and clashing names."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from poseweave.llm import chat, fingerprints, jaccard, pages, passages, vptree

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [f"w{k}" for k in range(400)]


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(VOCABULARY)
    return out


@pytest.fixture(scope="module")
def family(spark):
    """Copies, near copies on both sides of the limit, chains of them, a shared line, odd texts."""
    rng, texts = random.Random(11), []
    for _ in range(6):
        base = rng.choices(VOCABULARY, k=rng.choice([30, 150, 400]))
        chain = base
        for k in range(12):
            chain = edited(chain, k % 3, rng)
            texts += [" ".join(edited(base, k, rng)), " ".join(chain)]
        texts += [" ".join(base)] * 3
    line = " ".join(VOCABULARY[:12])
    texts += [line + "\n" + " ".join(rng.choices(VOCABULARY, k=40)) for _ in range(30)]
    texts += ["", None, " ", "two words", "Two Words", "one", "x " * 500]
    rng.shuffle(texts)
    rows = [(3 * k, t, "x", k) for k, t in enumerate(texts)] + [(None, "null id text here", "x", 1), (0, texts[0], "x", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, component string, row int").cache()


def plain_links(rows, size, percent):
    sets = []
    for r in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        runs = [tuple(words[k: k + size]) for k in range(len(words) - size + 1)] if len(words) >= size else [tuple(words)] if words else []
        sets.append(set(runs))
    parent = list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[top(a)] = top(b)
    least = {}
    for k, r in enumerate(rows):
        if r.doc_id is not None:
            least[top(k)] = min(least.get(top(k), r.doc_id), r.doc_id)
    return [(r.doc_id, len(sets[k]), least.get(top(k))) for k, r in enumerate(rows)]


@pytest.mark.parametrize(("rare", "block", "percent", "size"), [(32, 512, 90, 3), (2, 8, 90, 3), (2, 5, 80, 5)])
def test_jaccard_classes_match_all_pairs(spark, family, monkeypatch, rare, block, percent, size):
    monkeypatch.setattr(jaccard, "RARE_SETS", rare)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard, "HEAVY_SETS", 4)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(family, size, percent).collect()]
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted(got, key=key) == sorted(plain_links(family.collect(), size, percent), key=key)


def test_distinct_documents_keep_one_of_each_class(spark, family):
    kept = jaccard.distinct_documents(family, 3, 90)
    assert kept.columns == family.columns
    want = {i for i, _, c in plain_links(family.collect(), 3, 90) if i is not None and i == c}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1
    assert jaccard.distinct_documents(family.limit(0), 3, 90).count() == 0


def test_size_classes_and_prefixes_leave_no_pair_out():
    for n in range(1, 3000):
        for m in range(n, int(n / 0.9) + 1):
            assert jaccard.size_classes(n, 90) & jaccard.size_classes(m, 90)


def test_chains_take_the_best_order():
    rng = random.Random(4)
    for _ in range(150):
        parts = sorted({(rng.randrange(40), rng.randrange(40), rng.randint(1, 6)) for _ in range(rng.randint(1, 8))})
        best = 0.0
        for mask in range(1, 1 << len(parts)):
            own = [p for k, p in enumerate(parts) if mask >> k & 1]
            own.sort()
            gaps = [(b[0] - a[0] - a[2], b[1] - a[1] - a[2]) for a, b in zip(own, own[1:])]
            if all(x >= 0 and y >= 0 for x, y in gaps):
                best = max(best, sum(p[2] for p in own) - passages.GAP_COST * sum(x + y for x, y in gaps))
        chain = passages.chains(parts)[0]
        gaps = [b[0] - a[0] - a[2] + b[1] - a[1] - a[2] for a, b in zip(chain, chain[1:])]
        assert abs(sum(p[2] for p in chain) - passages.GAP_COST * sum(gaps) - best) < 1e-9
        flat = [p for c in passages.chains(parts) for p in c]
        assert sorted(flat) == parts


def test_minimizers_cover_every_window():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 21, 22, 300):
        values = rng.integers(0, 50, n).astype(np.uint64)
        places = passages.minimizers(values)
        want = {max(k for k in range(a, a + 21) if values[k] == values[a: a + 21].min()) for a in range(n - 20)} if n >= 21 else set(places.tolist())
        assert set(places.tolist()) == want


@pytest.fixture(scope="module")
def quoted(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    exact, fuzzy, short = fresh(70), fresh(120), fresh(30)
    texts = [fresh(100) + exact + fresh(50), exact + fresh(80), fresh(40) + fuzzy, fresh(30) + edited(fuzzy, 6, rng) + fresh(30),
             short + fresh(60), fresh(60) + short, fresh(500), exact, [], fresh(20) + exact[:35] + exact[35:], fresh(10) * 20]
    rows = [(k, " ".join(t), "clash", 1) for k, t in enumerate(texts)] + [(None, " ".join(exact), None, None), (100, None, None, None), (1, " ".join(texts[1]), "", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, other_id string, n_chars long").cache()


def test_passages_are_found_and_clean_texts_left_alone(spark, quoted):
    rows = passages.repeats(quoted).collect()
    assert {(r.doc_id, r.other_id) for r in rows} == {(1, 0), (3, 2), (7, 0), (9, 0)}
    exact = {r.doc_id: r for r in rows}
    assert (exact[1].start_word, exact[1].end_word, exact[1].other_start, exact[1].other_end, exact[1].matched) == (0, 70, 100, 170, 70)
    assert exact[3].start_word >= 25 and exact[3].end_word - exact[3].start_word >= 110 and exact[3].matched >= 105
    assert passages.repeats(quoted.limit(0)).count() == 0
    cut = passages.without_repeats(quoted)
    assert cut.columns == quoted.columns
    texts = {r.doc_id: r for r in cut.collect()}
    before = {r.doc_id: r for r in quoted.collect()}
    assert texts[0].text == before[0].text and texts[7].text == "" and texts[100].text is None
    assert texts[1].text == " ".join(before[1].text.split()[70:]) and texts[1].n_chars == len(texts[1].text)
    left = [r.doc_id for r in passages.without_repeats(quoted, drop_emptied=True).collect()]
    assert 7 not in left and 8 in left and None in left and left.count(1) == 2


def test_repeats_split_over_two_earlier_documents_count_as_one_stretch(spark):
    rng = random.Random(9)
    a, b, rest = ([f"v{rng.randrange(10**9)}" for _ in range(47)] for _ in range(3))
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(rest + a + b))], "doc_id long, text string")
    assert {(r.doc_id, r.other_id) for r in passages.repeats(docs).collect()} == {(3, 1), (3, 2)}


def covered_words(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return out


def common_runs(texts, n=50):
    """Words of every text that lie in a run of ``n`` words which a text of smaller number has, too."""
    seen, out = set(), {}
    for k, words in enumerate(texts):
        runs = [tuple(words[a: a + n]) for a in range(len(words) - n + 1)]
        found = {w for a, run in enumerate(runs) if run in seen for w in range(a, a + n)}
        out |= {k: found} if found else {}
        seen.update(runs)
    return out


def test_every_common_run_of_words_is_found(spark):
    rng = random.Random(21)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage, later = fresh(56), fresh(300)
    # Every ten words of the passage stand in an earlier document of their own, so that each seed of it has another first document.
    texts = [fresh(10) + passage[a: a + 10] + fresh(10) for a in range(0, 50, 2)]
    texts += [fresh(30) + passage[:40], fresh(20) + passage[16:] + fresh(9), fresh(40) + passage + fresh(20), fresh(70) + passage + fresh(5)]
    texts += [later[a: a + 80] + fresh(20) for a in range(0, 220, 35)] + [later, fresh(60) + later[100:160]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    want, got = common_runs(texts), covered_words(passages.repeats(docs).collect())
    assert want[28] >= set(range(70, 126)) and all(words <= got.get(k, set()) for k, words in want.items())


@pytest.mark.parametrize("period", [1, 3, 7, 11, 24])
def test_repeated_lines_are_found(spark, period):
    rng = random.Random(period)
    fresh = lambda n: [f"l{rng.randrange(10**9)}" for _ in range(n)]
    line = fresh(period)
    texts = [fresh(20) + (line * 200)[:200] + fresh(20), fresh(33) + (line * 300)[:300] + fresh(12), fresh(5) + (line * 100)[2:92]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    want, rows = common_runs(texts), passages.repeats(docs).collect()
    got = covered_words(rows)
    assert len(want[1]) == 300 and len(want[2]) == 90 and all(words <= got.get(k, set()) for k, words in want.items())
    assert all(r.matched == r.end_word - r.start_word == r.other_end - r.other_start for r in rows) and len(rows) < 20


def test_edited_passages_just_over_the_shortest_are_found(spark):
    rng, texts = random.Random(5), []
    fresh = lambda n: [f"e{rng.randrange(10**9)}" for _ in range(n)]
    for _ in range(100):
        passage = fresh(60)
        other = list(passage)
        for k in rng.sample(range(60), 6):
            other[k] = fresh(1)[0]
        texts += [fresh(40) + passage + fresh(40), fresh(40) + other + fresh(40)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {(r.doc_id, r.other_id) for r in passages.repeats(docs).collect()}
    assert found <= {(k + 1, k) for k in range(0, 200, 2)} and len(found) >= 90


def test_fingerprints_follow_true_likeness(spark):
    rng = random.Random(3)
    base = rng.choices(VOCABULARY, k=900)
    texts = [" ".join(base), " ".join(edited(base, 20, rng)), " ".join(base), "", None, "one", "a b c d e"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "null", "x")], "doc_id long, text string, sketch string")
    rows = {r.doc_id: r for r in fingerprints.compare_with_edits(docs).collect()}
    assert len(rows) == 8 and rows[0].fingerprint == rows[2].fingerprint and rows[3].fingerprint == rows[4].fingerprint == ""
    order = [None, 0, 1, 2, 3, 4, 5, 6]
    by_id = {None: "null"} | dict(enumerate(texts))

    def shingles(text):
        words = text.lower().split()
        return {tuple(words[k: k + 5]) for k in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()

    def likeness(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    for at, i in enumerate(order):
        text, after = by_id[i] or "", by_id[order[(at + 1) % len(order)]] or ""
        take = len(text) // 4
        edit = text[: len(text) - take] + after[:take]
        assert rows[i].n_chars == len(text) and rows[i].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert abs(rows[i].near_edited - likeness(shingles(text), shingles(edit))) < 0.15
        assert abs(rows[i].near_next - likeness(shingles(text), shingles(after))) < 0.15
    assert fingerprints.compare_with_edits(docs.limit(0)).count() == 0
    halves = spark.createDataFrame([(" ".join(base[:600]), "g"), (" ".join(base[500:]), "g")], "text string, g string")
    sketched = fingerprints.with_sketch(halves, F.col("text"), "s")
    merged = fingerprints.merge_sketches(sketched, ["g"], "s").first()["s"]
    whole = set(shingles(" ".join(base[:600]))) | shingles(" ".join(base[500:]))
    one = fingerprints.with_sketch(spark.createDataFrame([(" ".join(base),)], "text string"), F.col("text"), "s")
    assert merged == one.first()["s"]
    made = one.select(fingerprints.distinct_shingles(F.col("s")).alias("n"), fingerprints.containment(F.col("s"), F.col("s")).alias("c")).first()
    assert abs(made.n - len(whole)) < 0.35 * len(whole) and made.c == 1.0


@pytest.mark.parametrize("text", ["", "[INST]", "[\\INST]", "a\\", "</s>[INST] ok [/INST]", "<s><<SYS>>[ROLE]\\[\\\\TEXT][[/ROLE]", "\n<|x|>", "$1 \\$2"])
def test_chats_read_back_what_was_written(spark, text):
    rows = [(1, 0, "system", text), (1, 1, "user", text), (1, 2, "assistant", text), (2, 0, "tool[INST]", text), (2, 1, None, None), (2, 1, None, None),
            (None, None, "assistant", text), (3, 0, "user", "q"), (3, 1, "assistant", text), (3, 2, "user", text)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    made = chat.format_chats(turns)
    back = {r.conv_id: r for r in chat.read_chats(made).collect()}
    for conv in (1, 2, 3, None):
        want = [(role or "", t or "") for c, _, role, t in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] or 0, r[2] or ""))]
        assert [tuple(t) for t in back[conv].turns] == want
        assert list(back[conv].learnt) == [t for role, t in want if role == "assistant"]
    assert {r.conv_id: (r.state, r.valid) for r in made.collect()} == {1: ("answered", True), 2: ("bad", False), 3: ("asked", False), None: ("bad", False)}
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(900, 6)).astype(np.float32)
    points[100:160] = points[0]
    rows = [(int(k), p.tolist()) for k, p in enumerate(points)] + [(902, None), (904, [0.0] * 6), (906, [float("nan")] * 6), (908, [None] + [1.0] * 5),
                                                                   (None, [1.0] * 6), (910, [9.0, 9.0]), (20, points[3].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    ids = np.array([r[0] for r in rows[:900]] + [20])
    vectors = np.concatenate([points, points[3:4]]).astype(float)
    got = {}
    for r in vptree.nearest(table, k=5, every=20, shard_rows=128).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for query in range(0, 900, 20):
        want = []
        for own in np.flatnonzero(ids == query):
            scores = vptree.products(vectors[own], vectors)
            order = [k for k in np.lexsort((ids, -scores)) if k != own][:5]
            want += [(n + 1, int(ids[k]), float(scores[k])) for n, k in enumerate(order)]
        assert sorted(got[query]) == sorted(want)
    assert vptree.nearest(table.limit(0)).count() == 0


def test_tree_factor_trades_recall_for_rows(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 8)) * 4
    points = np.concatenate([c + rng.normal(size=(60, 8)) for c in centres])
    queries = points[::100]
    exact = [set(np.argsort(np.linalg.norm(points - q, axis=1))[:10]) for q in queries]
    seen = []
    for factor in (1.0, 2.0):
        tree = vptree.Tree(points, leaf=32)
        found = tree.search(queries, 10, factor)
        recall = np.mean([len(e & set(f.tolist())) / 10 for e, f in zip(exact, found, strict=True)])
        seen.append(tree.seen)
        assert recall == 1.0 if factor == 1.0 else recall > 0.5
    assert seen[1] < seen[0] < len(points) * len(queries)


def test_common_lines_match_the_usual_table():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        places = pages.common_lines(a, b)
        rest = iter(b)
        assert len(places) == table[-1][-1] and all(a[i] in rest for i in places) and places == sorted(places)


def test_pages(spark):
    site = "<div>Welcome to our site</div><p>All rights kept</p>"
    rows = [
        (1, "http://a.com/x/1", f"<html><head><title>T</title></head><body><nav>menu</nav>{site}<p>First  story &amp; more</p><script>'<p>no</p>'</script></body></html>"),
        (2, "http://a.com/x/2", f"<body>{site}<p>Second story</p><footer>foot</footer>"),
        (3, "http://b.com/x/1", f"<body>{site}<p>Alone here</p>"),
        (4, "http://a.com/y", "<div class='ad'>buy</div><article><h1>Head</h1><p>One<br>two<p>three <b>bo</b>ld&nbsp;x<section class=comments><p>troll</p></section></article><p>after"),
        (5, "http://a.com/y/z", "<article><h1>Head</h1><p>other &am"),
        (6, None, None), (7, "http://a.com/e", ""), (None, None, "<p>no id</p>"), (1, "http://a.com/x/1", f"<body>{site}<p>First again</p>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = pages.extract(table).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    got = {r.page_id: r.text for r in out if r.page_id != 1}
    assert {r.text for r in out if r.page_id == 1} == {"First story & more", "First again"}
    assert got[2] == "Second story" and got[3] == "Welcome to our site\nAll rights kept\nAlone here"
    assert got[4] == "Head\nOne two\nthree bold x" and got[5] == "Head\nother &am"
    assert got[6] == "" and got[7] == "" and got[None] == "no id"
    assert pages.extract(table.limit(0)).count() == 0


def test_copies_of_a_page_keep_its_text(spark):
    site = "<div>Welcome to our site</div><p>All rights kept</p>"
    story = "".join(f"<p>Line {k} of the first story</p>" for k in range(30))
    rows = [(k, url, f"<body>{site}{story}") for k, url in enumerate(["http://a.com/x/1", "http://a.com/x/1", "http://a.com/x/1?print", "http://a.com/x/1b"])]
    rows += [(4, "http://a.com/x/2", f"<body>{site}<p>Second story</p>"), (5, "http://b.com/1", f"<body>{site}{story}<p>today</p>"),
             (6, "http://b.com/2", f"<body>{site}{story}<p>yesterday</p>"), (7, "http://c.com/1", f"<body>{site}{story}"), (8, "http://c.com/2", f"<body>{site}{story}")]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = "\n".join(f"Line {k} of the first story" for k in range(30))
    assert all(got[k] == text for k in range(4)) and got[4] == "Second story"
    assert got[5].endswith(f"{text}\ntoday") and got[6].endswith(f"{text}\nyesterday") and got[7].endswith(text) and got[8].endswith(text)


def test_markup_is_read_as_browsers_do():
    def blocks(page: str) -> list[str]:
        found = pages.text_blocks(page)
        top = max((zone for _, zone in found), default=pages.PLAIN)
        return [text for text, zone in found if zone == top]

    named = ("<article><p>a<div class='side-by-side'>b</div><blockquote class=related-work>c</blockquote><div id='notice-of-appeal'>d</div>"
             "<section class='search-results-explained'>e</section><div class='wide site-nav'>f</div><div class=ad_slot-3>g</div><div class='cookie-banner'>h</div>")
    assert blocks(named) == ["a", "b", "c", "d", "e"]
    assert blocks("<p>a <a href=/it's>link</a> b") == ["a link b"]
    assert blocks('<p>a <a href="x>y">link</a> <i title="a hidden nav, class=ad">b</i>') == ["a link b"]
    assert blocks('<p>a<a href="open>b</a> c') == ["ab c"]
    assert blocks("<div a=b\"x>a</div><div hidden>b</div><p>1 < 2") == ["a", "1 < 2"]
    assert blocks("<p " + "a=\"" * 50_000) == [] and blocks("<p " + "a='b' " * 50_000 + ">c") == ["c"]
