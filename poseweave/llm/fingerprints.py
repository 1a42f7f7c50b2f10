"""Document fingerprints: bottom-k sketches of word shingles, built and compared with built-in functions only.

A sketch is the ascending array of the ``k`` smallest distinct shingle hashes of a text.  The sketch of a union is made
from the sketches of its parts, so parts of a text or of a collection can be sketched apart and merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poseweave.llm.common import WHITE_CHARS

SHINGLE = 5
K = 128
#: Most ranges the documents are dealt to when each needs the text of the next one.
MOST_RANGES = 512


def word_hashes(text: Column) -> Column:
    words = F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), WHITE_CHARS, " " * len(WHITE_CHARS)), " ")
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of ``size`` words; fewer words are one shingle, none have none."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(size))))
    none = F.array().cast("array<long>")
    return F.when(F.size(words) >= size, runs).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(none)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: Column, name: str, size: int = SHINGLE, k: int = K) -> DataFrame:
    """``df`` with the sketch of ``text``; null and empty texts have an empty one.  Existing columns keep their names."""
    words = F.transform(F.array(text), lambda t: word_hashes(t))
    sketched = F.transform(words, lambda w: bottom(shingle_hashes(w, size), k))
    return df.withColumn(name, sketched[0])


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what ``a`` and ``b`` sketch."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the share of the union's sketch that is in both.  Two empty sets are alike."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union)).cast("double")


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    unit = (F.element_at(sketch, -1).cast("double") + float(1 << 63)) / float(1 << 64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / unit)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles behind ``a`` that are also behind ``b``; 1 for an empty ``a``."""
    common = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def printed(sketch: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def merge_sketches(df: DataFrame, by: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch for each group: hashes are ranked within the group after equal ones are summed away in part."""
    hashes = df.select(*by, F.explode(sketch).alias("_h")).groupBy(*by, "_h").agg(F.lit(1).alias("_one"))
    from pyspark.sql import Window

    ranked = hashes.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("_h"))).where(F.col("_rank") <= k)
    return ranked.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def _range_of(value: Column, bounds: list[int]) -> Column:
    """The number of the range of ``value``: a balanced tree of comparisons over ascending bounds."""
    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value <= bounds[middle], tree(low, middle)).otherwise(tree(middle + 1, high))

    return F.coalesce(F.when(value.isNotNull(), tree(0, len(bounds))), F.lit(0))


def compare_with_edits(docs: DataFrame, size: int = SHINGLE, k: int = K) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and their likeness to those and to the next document's.

    The edited text has the last quarter of the code points replaced by as many from the start of the next document by
    ``doc_id`` (after the last: the first).  Rows of equal ids follow by the hash of their text; a null text is empty, null
    ids come first; a single row is its own next.  Texts cross the network once: ids are cut into ranges of about equal
    numbers of rows, each range looks ahead within itself, and the first row of the following range (at most
    ``MOST_RANGES`` starts of texts) is handed to its last.
    """
    from pyspark.sql import Window

    spark = docs.sparkSession
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumns({"n_chars": F.char_length("text").cast("long"), "_tie": F.xxhash64("text")})
    ranges = max(1, min(MOST_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    steps = [i / ranges for i in range(1, ranges)]
    bounds = base.agg(F.percentile_approx("doc_id", steps, 10_000)).first()[0] if steps else []
    base = base.withColumn("_range", _range_of(F.col("doc_id"), sorted(set(bounds or []))))
    place = F.struct("doc_id", "_tie")
    ends = sorted(base.groupBy("_range").agg(F.min(place).alias("first"), F.max(F.struct("doc_id", "_tie", "n_chars")).alias("last")).collect(),
                  key=lambda r: r["_range"])
    follow = [(r["_range"], n["first"]["doc_id"], n["first"]["_tie"], r["last"]["n_chars"] // 4) for r, n in zip(ends, ends[1:] + ends[:1], strict=True)]
    heads = spark.createDataFrame(follow, "_range int, _id long, _hash long, _take long").alias("h")
    heads = base.select("doc_id", "text", "_tie").join(
        F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_hash"))).dropDuplicates(["_range"])
    heads = with_sketch(heads, F.col("text"), "_first_sketch", size, k).select(
        "_range", F.expr("substring(text, 1, cast(_take as int))").alias("_first_text"), "_first_sketch")

    order = Window.partitionBy("_range").orderBy("doc_id", "_tie")
    rows = with_sketch(base, F.col("text"), "sketch", size, k)
    rows = rows.withColumns({"_next": F.lead(F.struct("text", "sketch")).over(order)}).join(F.broadcast(heads), "_range")
    kept, take = F.col("n_chars") - F.floor(F.col("n_chars") / 4), F.floor(F.col("n_chars") / 4)
    edited = F.concat(F.col("text").substr(F.lit(1), kept.cast("int")),
                      F.coalesce(F.col("_next.text"), F.col("_first_text")).substr(F.lit(1), take.cast("int")))
    rows = rows.select("doc_id", "n_chars", "sketch", F.coalesce("_next.sketch", "_first_sketch").alias("_next_sketch"), edited.alias("_edited"))
    rows = with_sketch(rows.withColumn("edited_sha256", F.sha2("_edited", 256)), F.col("_edited"), "_edited_sketch", size, k)
    return rows.select("doc_id", "n_chars", "edited_sha256", printed(F.col("sketch")).alias("fingerprint"),
                       printed(F.col("_edited_sketch")).alias("edited_fingerprint"),
                       resemblance(F.col("sketch"), F.col("_edited_sketch"), k).alias("near_edited"),
                       resemblance(F.col("sketch"), F.col("_next_sketch"), k).alias("near_next"))
