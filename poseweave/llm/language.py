"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language has a raw-content dictionary for zstandard: the words most frequent in its labelled texts, the most frequent last,
where matches are cheapest.  A text is reduced to its distinct words in lower case (so repeated lines do not compress with themselves),
cut into pieces that are compressed apart, and measured with each dictionary.  The smallest sum wins; a narrow margin is a rejection.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poseweave.llm.common import perhaps_in, with_text_columns

#: Bound of the labelled sample: rows of each language, the first in a seeded order.
SAMPLE_ROWS = 2_048
#: Bytes of a dictionary; longest word in it.
DICTIONARY_BYTES, WORD_BYTES = 1 << 13, 64
#: Bytes compressed at once.
PIECE_BYTES = 1 << 12
#: Spaces ahead of every piece: a block that saves nothing is stored as it is, which would hide the matches of short texts.
LEAD = b" " * 40
#: A text is rejected if the second-best language needs fewer more bytes than this share of the best size, or than this number.
MIN_SHARE, MIN_BYTES = 0.01, 2
UNDETERMINED = "und"

WORD = re.compile(r"[^\W\d_]+")
ASCII_LETTER = re.compile("[A-Za-z]")


def held_out(doc_id: str = "doc_id"):
    """Whether a row is never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def has_letter(text: str) -> bool:
    return ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text))


def distinct_words(text: str) -> dict[str, None]:
    """The distinct words in lower case, by first occurrence."""
    return dict.fromkeys(WORD.findall(text.lower()))


@dataclass
class Model:
    """Languages, the most frequent first, with the content of their dictionaries."""

    contents: dict[str, bytes]
    _ready: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {"contents": self.contents, "_ready": []}

    def compressors(self) -> list:
        if not self._ready:
            import zstandard as zstd

            how = zstd.ZstdCompressionParameters(window_log=17, hash_log=13, chain_log=13, search_log=3, min_match=4, target_length=8,
                                                 strategy=zstd.STRATEGY_LAZY, write_checksum=False, write_content_size=False, write_dict_id=False)
            for content in self.contents.values():
                known = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
                known.precompute_compress(compression_params=how)
                self._ready.append(zstd.ZstdCompressor(compression_params=how, dict_data=known).compress)
        return self._ready

    def sizes(self, text: str) -> list[int]:
        """Bytes of the whole text under each language."""
        raw = f" {' '.join(distinct_words(text))} ".encode("utf-8", "replace")
        pieces = [LEAD + raw[k: k + PIECE_BYTES] for k in range(0, len(raw), PIECE_BYTES)]
        return [sum(len(compress(piece)) for piece in pieces) for compress in self.compressors()]

    def predict(self, text: str | None) -> tuple[str, float, int, bool]:
        """``(language, score, margin in bytes, accepted)``; equal sizes go to the more frequent language."""
        if not self.contents or not text or not has_letter(text):
            return UNDETERMINED, 0.0, 0, False
        sizes = self.sizes(text)
        best = min(sizes)
        at = sizes.index(best)
        rest = sizes[:at] + sizes[at + 1:]
        margin = min(rest) - best if rest else best
        score = 1 / sum(2.0 ** -min(s - best, 1000) for s in sizes)
        return list(self.contents)[at], score, margin, margin >= max(MIN_BYTES, MIN_SHARE * best)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of every text of a batch, counted within the batch."""
    for batch in batches:
        counts: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            for word in distinct_words(text.as_py()):
                if len(word.encode("utf-8", "replace")) <= WORD_BYTES:
                    counts[lang, word] = counts.get((lang, word), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()),
                                          pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES, seed: int = 0) -> Model:
    """Dictionaries from at most ``sample_rows`` labelled rows of each language that are not held out.

    Rows with a null id, text or language teach nothing.  Words are counted by Spark; the driver gets at most ``dictionary_bytes``
    of words for each language.  Without labelled rows the model knows no language.
    """
    spark = docs.sparkSession
    usable = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = usable.select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    chosen = rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= sample_rows).drop("_place")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # The sample's texts are few: a filter of fixed size keeps all others from the shuffle of the exact join.
    texts = perhaps_in(usable.select("doc_id", "lang", "text"), chosen, "doc_id").join(chosen, ["doc_id", "lang"]).select("lang", "text")
    words = texts.mapInArrow(_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    by_use = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    # A word takes two bytes at least, so this rank bounds the words that can be used.
    top = words.withColumn("_place", F.row_number().over(by_use)).where(F.col("_place") <= dictionary_bytes // 2)
    size = F.sum(F.octet_length("word") + 1).over(by_use.rowsBetween(Window.unboundedPreceding, 0))
    lists: dict[str, list[tuple[int, bytes]]] = {}
    for r in top.withColumn("_size", size).where(F.col("_size") < dictionary_bytes).collect():
        lists.setdefault(r["lang"], []).append((r["_place"], r["word"].encode()))
    languages = sorted(lists, key=lambda lang: (-counts[lang], lang))
    return Model({lang: b" " + b" ".join(w for _, w in sorted(lists[lang], reverse=True)) + b" " for lang in languages})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1), ``margin`` (bytes to the second best) and ``accepted``; all rows and columns stay.

    Whole texts are read.  Null texts, texts without a letter, and all texts under a model without languages are ``und`` with
    score 0, not accepted.  A narrow margin is not accepted, yet names the best language.  Columns of these names are replaced.
    """
    def run(texts: pa.Array) -> dict[str, list]:
        told = [model.predict(text) for text in texts.to_pylist()]
        kinds = (pa.string(), pa.float64(), pa.int64(), pa.bool_())
        return {name: pa.array([row[k] for row in told], kind)
                for k, (name, kind) in enumerate(zip(("lang_pred", "score", "margin", "accepted"), kinds, strict=True))}

    return with_text_columns(docs, run, {"lang_pred": "string", "score": "double", "margin": "bigint", "accepted": "boolean"})
