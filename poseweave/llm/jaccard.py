"""Jaccard self-join of documents on word shingles by prefixes of token combinations, and the classes its links form.

Tokens are shingle hashes in one global order: the most frequent last, else by hash.  Two sets with the wanted
likeness share at least ``g + 1`` tokens among the first ``|x| - ceil(t |x|) + 1 + g`` of each.  A prefix token that few sets hold is
indexed alone; frequent ones are dealt to ``g`` classes by their hash, and pairs within a class are indexed: ``g + 1`` shared
tokens put two into one class.  So an index entry is rare or a pair, and the number of entries stays linear in the prefix.

Entries of the same sets count once.  Within an index entry the sets are compared with its first set; in entries of many sets that are
not all linked then, other sets are drawn, and every set is verified with the nearest one drawn for its entries.  Only what is not linked by that is
looked at pairwise, in blocks, under a bound of the symmetric difference read off parity bitmaps of 1,024 bits, which leave few pairs
that are not alike enough.  Every pair that passes and is not linked already is verified on the sets themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poseweave.llm.common import components, perhaps_in
from poseweave.llm.words import blocks, shingles
from poseweave.session import pin

SHINGLE = 3
PERCENT = 90
#: Frequent tokens that come last in the order: at most so many, each in at least so many sets.  Fixed size, so it may be broadcast.
HEAVY_TOKENS, HEAVY_SETS = 65_536, 64
#: Texts whose shingles are counted together; of these, only those in three texts or more are passed on.
COUNTED_TEXTS = 2_500
#: A prefix token in more sets than this is indexed in pairs.
RARE_SETS = 32
#: Times sets are drawn from entries of more than ``RARE_SETS`` sets before what is left is compared in pairs.
DRAWS = 3
#: Sets of an entry compared in one block.
BLOCK_SETS = 512
BITMAP = 256
LANES = ["b0", "b1", "b2", "b3"]
#: Bits of the bitmaps that sets of a mixed entry are compared by, and of the smallest ones kept.
WIDE_BITMAP = 1024
WIDE_LANES = [f"w{k}" for k in range(WIDE_BITMAP // 64)]
#: Texts described in one record batch.
BATCH_TEXTS = 512


def token_sets(texts: Iterable, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    for _, words in blocks(texts):
        values, bounds = shingles(words, size, whole_if_short=True)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield np.unique(values[a:b])


def digest(tokens: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def bitmap_size(n: int) -> int:
    """Two to four bits a token: pairs a little below the wanted likeness are seen to be so."""
    return max(WIDE_BITMAP, 1 << max(0, 2 * n - 1).bit_length())


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of bounded numbers of rows, so that what is made of one part stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_TEXTS):
            yield batch.slice(start, BATCH_TEXTS)


def parity(tokens: np.ndarray, size: int) -> np.ndarray:
    """Bit k says whether an odd number of tokens have k as their last bits: a bitmap of half the size is the two halves' difference."""
    odd = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def lists(values: list[np.ndarray]) -> pa.ListArray:
    bounds = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([*values, np.zeros(0, np.int64)]).view(np.int64)))


def heavy_tokens(docs: DataFrame, size: int) -> np.ndarray:
    """The most frequent shingles over all texts.  They only shape the order, which may be any: results do not depend on them."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, COUNTED_TEXTS):
                own = {digest(s): s for s in token_sets(batch.column("text").slice(start, COUNTED_TEXTS), size)}
                keys, n = np.unique(np.concatenate([*own.values(), np.zeros(0, np.uint64)]), return_counts=True)
                many = n >= 3
                yield pa.RecordBatch.from_arrays([pa.array(keys[many].view(np.int64)), pa.array(n[many])], ["token", "n"])

    sums = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = sums.where(F.col("n") >= HEAVY_SETS).orderBy(F.desc("n"), "token").limit(HEAVY_TOKENS).toPandas()
    return np.sort(rows["token"].to_numpy(np.int64).view(np.uint64))


def size_classes(n: int, percent: int) -> set[int]:
    """Powers of two of all set sizes that may be alike enough to ``n``."""
    share, n = percent / 100 - 0.01, max(1, n)
    return {max(1, int(n * share)).bit_length() - 1, n.bit_length() - 1, (int(n / share) + 1).bit_length() - 1}


def spread(size_class: int) -> int:
    """The number of classes frequent tokens of sets of this size are dealt to."""
    return max(1, (1 << size_class) // 20)


def prefix_length(n: int, percent: int, extra: int) -> int:
    return min(n, n - -(-percent * n // 100) + 1 + extra)


def described(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``(doc_id, row, n, d1, d2, b0…b3, bits, prefix)`` of every row, pinned; ``row`` is unique, equal sets have equal digests.

    ``b0…b3`` is a parity bitmap of 256 bits, ``bits`` one of 1,024 or of at least twice as many bits as the set has tokens.
    """
    heavy = docs.sparkSession.sparkContext.broadcast(heavy_tokens(docs, size))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = heavy.value
        for batch in slices(batches):
            n, digests, lanes, bits, prefixes = [], [], [], [], []
            for tokens in token_sets(batch.column("text"), size):
                n.append(len(tokens))
                digests.append(digest(tokens))
                lanes.append(parity(tokens, BITMAP))
                bits.append(parity(tokens, bitmap_size(len(tokens))))
                at = np.minimum(np.searchsorted(last, tokens), max(len(last) - 1, 0))
                is_last = last[at] == tokens if len(last) else np.zeros(len(tokens), dtype=bool)
                extra = max(spread(c) for c in size_classes(len(tokens), percent))
                # Tokens that only equal or unlike sets share are of no use: below 9 of 10 alike there is no other link.
                keep = prefix_length(len(tokens), percent, extra) if len(tokens) > 1 else 0
                prefixes.append(np.concatenate([tokens[~is_last], tokens[is_last]])[:keep].view(np.int64))
            d, b = np.array(digests, dtype=np.int64).reshape(-1, 2), np.array(lanes, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(n, dtype=np.int64)), pa.array(d[:, 0]), pa.array(d[:, 1]),
                 *(pa.array(b[:, k]) for k in range(4)), lists(bits), lists(prefixes)],
                ["doc_id", "n", "d1", "d2", *LANES, "bits", "prefix"])

    fields = "doc_id long, n long, d1 long, d2 long, b0 long, b1 long, b2 long, b3 long, bits array<long>, prefix array<long>"
    rows = docs.select("doc_id", "text").mapInArrow(describe, fields)
    return pin(rows.withColumn("row", F.monotonically_increasing_id()), "shingle-sets")


def index_entries(sets: DataFrame, percent: int) -> DataFrame:
    """``(entry, row, held, n, b0…b3)``: where each distinct set stands in the index, and the number of sets there.  Pinned.

    Entries with one set are left out; of entries with the same sets, told by their hashes, one is kept.
    """
    tokens = sets.select("row", "n", F.posexplode("prefix").alias("at", "token"))
    # Written, so that the joins shuffle both sides themselves and the rows of a frequent key can be split.
    shared = pin(tokens.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1"), "shared-tokens")
    tokens = pin(tokens.join(shared, "token"), "prefix-tokens")
    alone = tokens.where(F.col("sets") <= RARE_SETS).select(F.xxhash64("token").alias("entry"), "row")
    # At most one row per prefix token of a set, so a group is bounded by the longest text.
    frequent = tokens.where(F.col("sets") > RARE_SETS).groupBy("row", "n").agg(F.collect_list(F.struct("at", "token")).alias("own"))

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            entries, rows = [], []
            for row, n, own in zip(batch["row"], batch["n"], batch["own"], strict=True):
                for size_class in size_classes(n, percent):
                    classes, length = {}, prefix_length(n, percent, spread(size_class))
                    for item in own:
                        if item["at"] < length:
                            classes.setdefault(item["token"] % spread(size_class), []).append(item["token"])
                    for members in classes.values():
                        members.sort()
                        for k, a in enumerate(members):
                            entries += [hash((size_class, a, b)) for b in members[k + 1:]]
                rows += [row] * (len(entries) - len(rows))
            yield pd.DataFrame({"entry": pd.Series(entries, dtype="int64"), "row": pd.Series(rows, dtype="int64")})

    entries = alone.unionByName(frequent.mapInPandas(pairs, "entry long, row long"))
    entries = pin(entries, "entries")
    held = entries.groupBy("entry").agg(F.count("*").alias("held"), F.bit_xor(F.xxhash64("row")).alias("mark"),
                                        F.sum(F.hash("row").cast("long")).alias("total")).where("held > 1")
    held = pin(held.groupBy("held", "mark", "total").agg(F.min("entry").alias("entry")).select("entry", "held"), "held-entries")
    return pin(entries.join(held, "entry").join(sets.select("row", "n", *LANES), "row"), "index-entries")


def likely(percent: int, a: str, b: str, lanes: list[str] = LANES) -> Column:
    """Whether sizes and parity bitmaps leave room for the wanted likeness."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    fits = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    # |x & y| >= t / (1 + t) * (|x| + |y|) bounds the symmetric difference, which no parity bitmap exceeds.
    return fits & ((100 + percent) * differing(a, b, lanes) <= (100 - percent) * (na + nb))


def differing(a: str, b: str, lanes: list[str]) -> Column:
    return sum((F.bit_count(F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}"))) for k in lanes), F.lit(0))


def wide_lanes(sets: DataFrame) -> DataFrame:
    """``(row, w0…w15)``: every set's bitmap, folded to 1,024 bits."""
    def lane(k: int) -> Column:
        own = F.filter("bits", lambda _, i: i % len(WIDE_LANES) == k)
        return F.when(F.size("bits") == len(WIDE_LANES), F.get("bits", F.lit(k))).otherwise(
            F.aggregate(own, F.lit(0).cast("bigint"), lambda s, x: s.bitwiseXOR(x)))

    return sets.select("row", *[lane(k).alias(name) for k, name in enumerate(WIDE_LANES)])


def roomy(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose larger bitmaps leave room, too; where one is twice as long it is folded."""
    # Written, so that the bitmaps of all sets are not shuffled for a few pairs.
    pairs = pin(pairs, "perhaps-near")
    one, two = (sets.select(F.col("row").alias(k), F.col("n").alias(f"{k}_n"), F.col("bits").alias(f"{k}_bits")) for k in "ab")
    both = pairs.join(one, "a").join(two, "b")
    short = F.least(F.size("a_bits"), F.size("b_bits"))

    def folded(name: str) -> Column:
        halves = F.zip_with(F.slice(name, 1, short), F.slice(name, short + 1, short), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(name) > short, halves).otherwise(F.col(name))

    apart = F.aggregate(F.zip_with(folded("a_bits"), folded("b_bits"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return both.where((100 + percent) * apart <= (100 - percent) * (F.col("a_n") + F.col("b_n"))).select(*pairs.columns)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b)`` of the pairs whose sets are alike enough."""
    left, right = (sets.select(F.col("row").alias(k), F.col("tokens").alias(f"{k}_tokens")) for k in "ab")
    both = pairs.select("a", "b").join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.where(100 * common >= percent * (F.size("a_tokens") + F.size("b_tokens") - common)).select("a", "b")


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``(row, tokens)`` of the wanted ``(row, doc_id, d1, d2)``: only their texts are hashed again.  Pinned."""
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = list(token_sets(batch.column("text"), size))
            want = zip(batch.column("d1").to_pylist(), batch.column("d2").to_pylist(), strict=True)
            # Rows of one id may have other texts.
            same = [k for k, (s, d) in enumerate(zip(sets, want, strict=True)) if digest(s) == d]
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(same, pa.int64())), lists([sets[k] for k in same])], ["row", "tokens"])

    key = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id")
    named = wanted.select(key, "row", "d1", "d2")
    texts = perhaps_in(docs.select(key, "text"), named, "_id").join(named, "_id").select("text", "row", "d1", "d2")
    return pin(texts.mapInArrow(expand, "row long, tokens array<long>"), "full-sets")


def paired_sets(docs: DataFrame, pairs: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    rows = pin(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "paired-rows")
    return full_sets(docs, pin(reps.select("row", "doc_id", "d1", "d2").join(rows, "row"), "paired-sets"), size)


def drawn_pairs(entries: DataFrame, groups: DataFrame, percent: int, draw: int) -> DataFrame:
    """``(a, b)``: every set with the nearest set of another class among those drawn for its entries, one for each, if any is near enough."""
    placed = entries.join(groups, "row")
    drawn = placed.groupBy("entry").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by(
        F.struct("row", "component", "n", *LANES), F.xxhash64("entry", "row", F.lit(draw))).alias("p"))
    pairs = placed.alias("e").join(drawn.where("low < high").select("entry", "p"), "entry").where("p.component <> e.component")
    pairs = pairs.where(likely(percent, "p", "e")).select(
        F.col("e.row").alias("a"), F.struct(differing("p", "e", LANES).alias("apart"), F.col("p.row").alias("b")).alias("near"))
    return pairs.groupBy("a").agg(F.min("near").alias("near")).select(
        F.least("a", "near.b").alias("a"), F.greatest("a", "near.b").alias("b")).distinct()


def mixed_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """``(a, b, apart)`` of the sets of an entry that are of two classes and perhaps alike, for ``placed(entry, parts, row, n, component, w0…w15)``.

    Entries of one block are joined with themselves, so both sides read the same shuffle.
    """
    one = placed.where("parts = 1").drop("parts")
    dealt = placed.where("parts > 1").withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("other")

    def near(a: DataFrame, b: DataFrame, keys: list[str], order: Column) -> DataFrame:
        same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
        # A few lanes differ no more than all of them and tell most pairs apart.
        fits = likely(percent, "a", "b", WIDE_LANES[:8]) & likely(percent, "a", "b", WIDE_LANES)
        return a.alias("a").join(b.alias("b"), [*same, F.col("a.component") != F.col("b.component"), order, fits]).select(
            F.least("a.row", "b.row").alias("a"), F.greatest("a.row", "b.row").alias("b"), differing("a", "b", WIDE_LANES).alias("apart"))

    later = F.col("a.row") < F.col("b.row")
    blocks_of_two = near(dealt.where("part = i"), dealt.where("part = j"), ["entry", "i", "j"], (F.col("a.part") < F.col("b.part")) | later)
    return near(one, one, ["entry"], later).unionByName(blocks_of_two)


def link(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row for each row of ``docs(doc_id, text)``.

    Two rows link when ``100 * |x & y| >= percent * |x | y|`` for their sets of ``size``-word shingles; a text with fewer words is one
    shingle, a null or empty one has none and links with nothing.  ``component_id`` is the smallest ``doc_id``
    reachable over links, the row's own included; null ids never count as smallest.  Equal sets share one representative.
    """
    rows = described(docs, size, percent)
    filled = rows.where("n > 0").select("row", "d1", "d2", "n")
    first = pin(filled.groupBy("d1", "d2", "n").agg(F.min("row").alias("rep")), "distinct-sets")
    reps = rows.join(first.select(F.col("rep").alias("row")), "row", "left_semi")
    entries = index_entries(reps, percent)

    pivot = pin(entries.groupBy("entry").agg(F.min(F.struct("row", "n", *LANES)).alias("p")), "pivots")
    stars = entries.alias("e").join(pivot, "entry").where("p.row <> e.row").where(likely(percent, "p", "e"))
    stars = stars.select(F.col("p.row").alias("a"), F.col("e.row").alias("b")).distinct()
    stars = pin(roomy(stars, reps, percent), "star-pairs")
    near = entries.select("row").distinct()
    links = pin(verified(stars, paired_sets(docs, stars, reps, size), percent), "links")
    groups = pin(components(near, links, "row"), "groups")

    many = entries.where(F.col("held") > RARE_SETS)
    for draw in range(DRAWS):
        drawn = pin(roomy(drawn_pairs(many, groups, percent, draw), reps, percent), "drawn-pairs")
        found = pin(verified(drawn, paired_sets(docs, drawn, reps, size), percent), "drawn-links")
        if found.isEmpty():
            break
        links = pin(links.unionByName(found), "links")
        groups = pin(components(near, links, "row"), "groups")

    # Entries whose sets already form one class have nothing to add.
    placed = entries.drop(*LANES).join(groups, "row")
    mixed = placed.groupBy("entry").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("sets"))
    mixed = mixed.where("low < high and sets > 2").select("entry", F.ceil(F.col("sets") / BLOCK_SETS).cast("int").alias("parts"))
    cross = mixed_pairs(placed.join(mixed, "entry").join(wide_lanes(reps), "row"), percent)
    cross = pin(roomy(cross.distinct().join(stars, ["a", "b"], "left_anti"), reps, percent), "cross-pairs")
    texts = paired_sets(docs, cross, reps, size)
    # The nearest set of each other class first: most classes join by it, and pairs within a class need no look.
    best = cross.join(groups.withColumnRenamed("row", "b"), "b").groupBy("a", "component").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))
    links = pin(links.unionByName(verified(best, texts, percent)), "links")
    groups = pin(components(near, links, "row"), "groups")
    ends = [groups.select(F.col("row").alias(k), F.col("component").alias(f"{k}_in")) for k in "ab"]
    rest = cross.join(best, ["a", "b"], "left_anti").join(ends[0], "a").join(ends[1], "b").where("a_in <> b_in")
    links = links.unionByName(verified(rest, texts, percent))
    groups = components(near, links, "row")

    owner = rows.join(first, ["d1", "d2", "n"], "left").join(groups.withColumnRenamed("row", "rep"), "rep", "left")
    owner = pin(owner.select("doc_id", "n", F.coalesce("component", "rep", "row").alias("class")), "classes")
    smallest = pin(owner.groupBy("class").agg(F.min("doc_id").alias("component_id")), "smallest")
    return owner.join(smallest, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def distinct_documents(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each class; all columns stay as they are.

    Rows of one id with equal text count as one, and one of them stays.  Rows with a null id stay.
    """
    kept = link(docs, size, percent).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"), "doc_id", F.xxhash64("text").alias("_hash"))
    named = rows.join(kept, F.col("doc_id") == F.col("_kept"), "left_semi").dropDuplicates(["doc_id", "_hash"])
    return named.unionByName(rows.where("doc_id is null")).select("_row.*")
