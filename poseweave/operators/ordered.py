"""Ordered operators that stay parallel when one group holds most of the rows.

Numbering the rows of a group is the only step that needs a global sort.  Once rows carry dense
frame numbers, ``floor(frame / BLOCK_ROWS)`` is a deterministic, size-bounded block key, and running sums
and look-aheads work block by block with one small carry row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poseweave.session import pin

BLOCK_ROWS = 1 << 18


def number_rows(df: DataFrame, group: list[str], order: list[str], name: str, total: str | None = None,
                keep: list[str] | None = None) -> DataFrame:
    """Dense 0-based row number per group, optionally with the group size; of the other columns those in ``keep`` (default: all).

    Rows are range-partitioned and sorted by group and order, so a group may span many partitions.  Each row is
    written with its partition and its place there; what a group has in earlier partitions (one small row for each) is
    added.  The result reads the written rows, so the input is read once however often the numbers are used.
    """
    keys = group or ["_all"]
    rows = df if group else df.withColumn("_all", F.lit(0))
    placed = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = placed if keep is None else placed.select(*keys, *keep)
    placed = pin(placed.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_chunk", F.shiftright("_at", 33))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    sizes = sizes.select(*[F.col(k).alias(f"_key{n}") for n, k in enumerate(keys)], F.col("_chunk").alias("_in"),
                         (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"),
                         F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"))
    same = F.col("_chunk") == F.col("_in")
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{n}"))
    out = placed.join(sizes, same).withColumn(name, F.col("_at") + F.col("_base"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_all", "_at", "_chunk", "_in", "_base", "_total", *[f"_key{n}" for n in range(len(keys))])


def block_of(frame: str, rows: int = BLOCK_ROWS) -> Column:
    return F.floor(F.col(frame) / rows)


def running_sum(df: DataFrame, group: list[str], frame: str, terms: dict[str, Column],
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Inclusive running sums over ``frame`` order; ``terms`` maps output name to summand."""
    parts = {f"_t_{name}": term for name, term in terms.items()}
    blocked = df.withColumns({"_block": block_of(frame, block_rows), **parts})
    inside = Window.partitionBy(*group, "_block").orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumns({name: F.sum(f"_t_{name}").over(inside) for name in terms})
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocked.groupBy(*group, "_block").agg(*[F.sum(f"_t_{n}").alias(f"_s_{n}") for n in terms])
    carry = carry.select(*group, "_block",
                         *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0.0)).alias(f"_c_{n}") for n in terms])
    out = local.join(carry, [*group, "_block"])
    return out.withColumns({n: F.col(n) + F.col(f"_c_{n}") for n in terms}).drop(
        "_block", *parts, *[f"_c_{n}" for n in terms])


def look_ahead(df: DataFrame, group: list[str], frame: str, gap: int, columns: dict[str, str],
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Attach the values ``gap`` frames later; rows without such a frame are dropped.

    Each block also receives the first ``gap`` rows of the next one, so a window per block is
    enough and a long run is spread over many tasks.
    """
    size = max(block_rows, gap)
    copies = F.when((F.col(frame) % size < gap) & (F.col(frame) >= size), F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0)))
    spread = df.withColumn("_back", F.explode(copies)).withColumn("_block", block_of(frame, size) - F.col("_back"))
    inside = Window.partitionBy(*group, "_block").orderBy(frame)
    ahead = {new: F.lead(old, gap).over(inside) for old, new in columns.items()}
    ahead["_ahead"] = F.lead(frame, gap).over(inside)
    return (spread.withColumns(ahead).where((F.col("_back") == 0) & F.col("_ahead").isNotNull())
            .drop("_back", "_block", "_ahead"))


def quantiles(df: DataFrame, group: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles by rank, without gathering a group in one task."""
    keys = group or ["_one"]
    rows = (df if group else df.withColumn("_one", F.lit(0))).select(*keys, F.col(value).alias("_v"))
    ranked = number_rows(rows.where("_v is not null"), keys, ["_v"], "_rank", "_n")
    spots = [F.struct(F.lit(name).alias("name"), (F.lit(float(q)) * (F.col("_n") - 1)).alias("at"))
             for name, q in wanted.items()]
    hits = (ranked.withColumn("_spot", F.explode(F.array(*spots)))
            .where(F.col("_rank").between(F.floor("_spot.at"), F.ceil("_spot.at"))))
    weight = 1 - F.abs(F.col("_rank") - F.col("_spot.at"))
    # A quantile that falls on a rank has a single hit of weight one.
    out = hits.groupBy(*keys).agg(*[
        F.sum(F.when(F.col("_spot.name") == name, F.col("_v") * weight)).alias(name) for name in wanted])
    return out if group else out.drop("_one")
