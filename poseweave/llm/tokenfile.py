"""Token-id files: Parquet lists of ids with chosen encoding, row groups and page indexes, read back selectively."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from poseweave.llm.tokens import default_vocabulary, encoder

END_ID = 2


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, encoding: str = "dictionary",
                 row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Write ``(doc_id, n_tokens, ids)`` in ascending ``doc_id`` order, files by name, to ``path``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  A null or empty text gives the end id alone.
    Repeated rows are written as often as they occur; rows of equal ``doc_id`` are ordered by their text's hash,
    null ids come first.  An empty table gives a folder without rows.

    ``encoding``: "dictionary" (bit-packed dictionary indexes; a vocabulary always fits a dictionary page) or "delta"
    (delta-binary-packed, second page format).  Pages of ``page_bytes`` carry column and offset indexes, so that a filter on ``doc_id``
    or ``n_tokens`` skips pages, and a read of those columns never touches the ids.
    """
    vocabulary = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text, tail = encoder(vocabulary).ids, end_id.to_bytes(4, "little")
        for batch in batches:
            keys, texts = batch.column("doc_id"), batch.column("text")
            for start, rows in by_size(texts):
                yield _lists(keys.slice(start, len(rows)), [encode_text(t) + tail for t in rows])

    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"no encoding named {encoding}")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    out = rows.mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>").write
    options = {"compression": "zstd", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes,
               "parquet.dictionary.page.size": 1 << 20, "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
               "parquet.writer.version": "v1" if encoding == "dictionary" else "v2"}
    out.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def by_size(texts: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``limit`` characters, with the number of the first."""
    first, rows, size = 0, [], 0
    for k, text in enumerate(texts):
        text = text.as_py() or ""
        if rows and size + len(text) > limit:
            yield first, rows
            first, rows, size = k, [], 0
        rows.append(text)
        size += len(text)
    if rows:
        yield first, rows


def _lists(keys: pa.Array, packed: list[bytes]) -> pa.RecordBatch:
    counts = np.array([len(p) // 4 for p in packed], dtype=np.int64)
    bounds = np.zeros(len(packed) + 1, dtype=np.int32)
    np.cumsum(counts, out=bounds[1:])
    ids = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
    lists = pa.ListArray.from_arrays(pa.array(bounds), ids)
    return pa.RecordBatch.from_arrays([keys, pa.array(counts), lists], ["doc_id", "n_tokens", "ids"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, file, place)``: rows of a token file with their file and their place in it."""
    return spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path).select(
        "doc_id", "n_tokens", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"))


def checksums(tokens: DataFrame) -> DataFrame:
    """The columns of ``tokens`` with the ids replaced by their count and their crc32 (little-endian 32-bit)."""
    kept = [c for c in tokens.columns if c != "ids"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False))
            bounds = lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.diff(bounds).astype(np.int64)),
                                              pa.array(crc, type=pa.int64())], [*kept, "n_ids", "ids_crc32"])

    fields = ", ".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in kept)
    return tokens.select(*kept, "ids").mapInArrow(sums, f"{fields}, n_ids long, ids_crc32 long")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of a token file, all taken from the ids it holds.

    ``start`` counts the ids of all rows before: a running sum within each file plus the sums of the files before it.
    """
    from poseweave.session import pin

    rows = pin(checksums(read_tokens(spark, path).drop("n_tokens")), "token-index")
    files = rows.groupBy("file").agg(F.sum("n_ids").alias("_ids"))
    before = files.select("file", (F.sum("_ids").over(Window.orderBy("file")) - F.col("_ids")).alias("_before"))
    within = F.sum("n_ids").over(Window.partitionBy("file").orderBy("place")) - F.col("n_ids")
    return rows.withColumn("_within", within).join(before, "file").select(
        "doc_id", (F.col("_before") + F.col("_within")).alias("start"), F.col("n_ids").alias("n_tokens"), "ids_crc32")
