"""Helpers the operators share: reading tables, global order, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from poseweave.session import pin

# Fixed value: the white space beside the space that separates words.
WHITE_CHARS = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordered(df: DataFrame, keys: list[str | Column], label: str) -> DataFrame:
    """``df`` sorted over all its rows and pinned, with the row number ``_row`` from 0.

    Rows are range-partitioned and sorted; a row knows its partition and its place there, and the sizes of the
    partitions before (one small row each) are added.  Equal keys keep an arbitrary but fixed order.
    """
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = pin(placed, label)
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    at = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (placed.withColumn("_part", part).join(F.broadcast(before), "_part")
            .withColumn("_row", F.col("_before") + at).drop("_at", "_part", "_before"))


def components(nodes: DataFrame, links: DataFrame, node: str = "doc_id") -> DataFrame:
    """``(node, component)``: the smallest node reachable over ``links(a, b)`` for every node.

    Large-star and small-star rounds: every round is two joins of the links with one minimum per node, so a hub with
    a third of all links is pre-aggregated and only its own links are read.  Links are replaced, never added.
    """
    edges = pin(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        fresh = pin(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        same = F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))
        if edges.agg(F.count("*"), same).first() == fresh.agg(F.count("*"), same).first():
            break
        edges = fresh
    return nodes.select(node).distinct().join(edges.select(F.col("u").alias(node), "v"), node, "left").select(
        node, F.coalesce("v", node).alias("component"))


def with_text_columns(docs: DataFrame, compute: Callable[[pa.Array], dict[str, list]], fields: dict[str, str]) -> DataFrame:
    """``docs`` with columns computed from batches of ``text``, all in one pass.

    ``fields`` has the name and type of each new column; columns of the same name are replaced.  Any names may occur in ``docs``: columns
    travel by number.
    """
    names, kinds = docs.columns, [f.dataType.simpleString() for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = compute(batch.column(names.index("text")))
            kept = [batch.column(k) for k in range(len(names))]
            made = [new[name] if isinstance(new[name], pa.Array) else pa.array(new[name]) for name in fields]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*map(str, range(len(names))), *(f"_{k}" for k in range(len(made)))])

    raw = docs.select(*(docs[f"`{c}`"].alias(str(k)) for k, c in enumerate(names)))
    given = [f"`{k}` {kind}" for k, kind in enumerate(kinds)] + [f"`_{k}` {kind}" for k, kind in enumerate(fields.values())]
    out = raw.mapInArrow(run, ", ".join(given))
    kept = [F.col(str(k)).alias(c) for k, c in enumerate(names) if c not in fields]
    return out.select(*kept, *(F.col(f"_{k}").alias(c) for k, c in enumerate(fields)))


#: Bits of the filter below: at most 2**20 rows of 64 bits are broadcast.
FILTER_BITS = 1 << 26


def perhaps_in(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose ``column`` is in ``ids``, and a few others: a filter of fixed size ahead of an exact join.

    Every id sets one bit of ``FILTER_BITS``; the words of the filter that are not zero, at most ``FILTER_BITS / 64`` whatever
    the number of ids, are broadcast.  Rows of null ids go.
    """
    bit = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    mask = F.expr("shiftleft(1L, cast(_bit % 64 as int))")
    words = ids.select(bit.alias("_bit")).groupBy(F.floor(F.col("_bit") / 64).alias("_word")).agg(F.bit_or(mask).alias("_mask"))
    rows = df.where(F.col(column).isNotNull()).withColumn("_bit", bit).withColumn("_word", F.floor(F.col("_bit") / 64))
    return rows.join(F.broadcast(words), "_word").where(F.col("_mask").bitwiseAND(mask) != 0).drop("_word", "_bit", "_mask")
