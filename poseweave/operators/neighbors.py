"""Exact nearest-neighbour joins in the plane.

Points of every group are sorted into square cells of several sizes: a cell is split until it holds
few points, so dense spots get small cells and empty space costs nothing.  Queries travel in blocks
(cells of their own tree) and walk down the cells level by level.  At each level the k-th smallest
"farthest possible" distance bounds the answer and every cell that starts beyond it is dropped, so the result is
exact and no group is ever paired with itself.  All joins are equi-joins on (group, level, cell).

Groups of at most ``PACKED_POINTS`` points need no cells: they are dealt out by group, points before queries, and
compared in one pass over the sorted rows, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from poseweave.session import pin

STRIDE = 2
MAX_LEVEL = 28
CELL = ["lvl", "cx", "cy"]
BOX = ["lo_x", "hi_x", "lo_y", "hi_y"]
#: Points a group may have to be compared as a whole, distances computed at once, pairs up to which groups are compared side by side.
PACKED_POINTS = 4096
DISTANCES_AT_ONCE = 1 << 20
FEW_PAIRS = 256
MOMENTS = ["_n", "_u", "_v", "_uu", "_uv", "_vv"]


class CellTree(NamedTuple):
    group: list[str]
    points: DataFrame | None  # every point of the large groups with the key of its leaf cell; none if there are no such groups
    cells: DataFrame | None  # key, parent key, count, bounding box, leaf flag
    depth: int
    copies: int | None
    whole: bool  # no point was left out
    small: DataFrame | None = None  # the points of the small groups
    large: DataFrame | None = None  # the keys of the large groups


def _levels(n: Column, leaf_rows: int) -> Column:
    """First guess of the finest level: one leaf per cell if the points were spread evenly, plus one stride."""
    even = F.log2(n / F.lit(float(leaf_rows))) / 2
    steps = F.ceil(even / STRIDE) + 1
    return F.when(n <= leaf_rows, 0).otherwise(F.least(F.lit(MAX_LEVEL), steps * STRIDE)).cast("int")


def _quantised(points: DataFrame, group: list[str], frames: DataFrame) -> DataFrame:
    def ticks(axis: str) -> Column:
        at = F.floor((F.col(axis) - F.col(f"_{axis}0")) / F.col("_side") * F.pow(F.lit(2.0), F.col("_fine")))
        return F.least(at, F.pow(F.lit(2.0), F.col("_fine")).cast("bigint") - 1)

    return points.join(frames, group).withColumns({"_fx": ticks("x"), "_fy": ticks("y")}).drop("_x0", "_y0", "_side")


def _keyed(quantised: DataFrame) -> DataFrame:
    """One row per point and level with that level's cell key."""
    levels = quantised.withColumn("lvl", F.explode(F.sequence(F.lit(0), F.col("_fine"), F.lit(STRIDE))))
    return levels.withColumns({axis: F.floor(F.col(f"_f{axis[1]}") / F.pow(F.lit(2.0), F.col("_fine") - F.col("lvl")))
                               for axis in ("cx", "cy")})


def build_tree(points: DataFrame, group: list[str], order: list[str], leaf_rows: int = 8,
               copies: int | None = None, max_level: int = MAX_LEVEL, stored: bool = False, packed_points: int = 0) -> CellTree:
    """Sort points ``(group, x, y, order…)`` into cells.

    ``copies`` is the largest k the tree will be asked for.  Points at one exact location that can
    never be among the k nearest (because k copies with a smaller ``order`` exist) are then left out
    of crowded cells; leave it unset when the points are only used as queries.  ``stored`` says that
    the points are a cheap view of a table that is already written.  Groups of up to ``packed_points`` points get no cells but are
    compared as a whole.
    """
    points = points if stored else pin(points, "tree-input")
    if not packed_points:
        return _cells_of(points, group, order, leaf_rows, copies, max_level)
    usable = _placed(points, group)
    large = usable.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > packed_points).select(*group)
    large = pin(large, "tree-large")
    if not large.limit(1).count():
        return CellTree(group, None, None, 0, copies, True, usable)
    cells = _cells_of(pin(usable.join(large, group, "left_semi"), "tree-input"), group, order, leaf_rows, copies, max_level)
    return cells._replace(small=usable.join(large, group, "left_anti"), large=large)


def _placed(rows: DataFrame, group: list[str]) -> DataFrame:
    """Rows that have a group and a place, which no others can be compared by."""
    there = F.lit(True)
    for c in [*group, "x", "y"]:
        there = there & F.col(c).isNotNull()
    return rows.where(there)


def _cells_of(points: DataFrame, group: list[str], order: list[str], leaf_rows: int = 8, copies: int | None = None,
              max_level: int = MAX_LEVEL) -> CellTree:
    """The cells of all groups of points that are written, whatever their size."""
    if copies:
        leaf_rows = max(leaf_rows, copies)
    frames = points.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.min("x").alias("_x0"), F.min("y").alias("_y0"),
        F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("_side"))
    frames = frames.select(*group, "_x0", "_y0", F.when(F.col("_side") > 0, F.col("_side")).otherwise(
        F.lit(1.0)).alias("_side"), _levels(F.col("_n"), leaf_rows).alias("_fine"))
    pruned = False
    while True:
        keyed = _keyed(_quantised(points, group, frames))
        cells = keyed.groupBy(*group, *CELL).agg(
            F.count(F.lit(1)).alias("n"), F.first("_fine").alias("_fine"),
            F.min("x").alias("lo_x"), F.max("x").alias("hi_x"), F.min("y").alias("lo_y"), F.max("y").alias("hi_y"))
        cells = pin(cells, "tree-cells")
        # Cells that stay crowded at the finest level: copies, or a spot denser than expected.
        crowded = cells.where((F.col("lvl") == F.col("_fine")) & (F.col("n") > leaf_rows)
                              & ((F.col("hi_x") > F.col("lo_x")) | (F.col("hi_y") > F.col("lo_y"))
                                 | F.lit(bool(copies) and not pruned)))
        depth, deeper = cells.agg(F.max("_fine")).first()[0] or 0, crowded.where(
            (F.col("_fine") < max_level) | F.lit(bool(copies) and not pruned)).limit(1).count()
        if not deeper:
            break
        if copies and not pruned:
            points = pin(_drop_buried(_keyed(_quantised(points, group, frames)).where("lvl = _fine"),
                                      crowded, group, order, copies, points.columns), "tree-input")
            pruned = True
            continue
        grow = crowded.select(*group).distinct().withColumn("_grow", F.lit(3 * STRIDE))
        frames = pin(frames.join(grow, group, "left").withColumn("_fine", F.least(
            F.lit(max_level), F.col("_fine") + F.coalesce("_grow", F.lit(0)))).drop("_grow"), "tree-frames")

    closed = (F.col("n") <= leaf_rows) | (F.col("lvl") == F.col("_fine"))
    up = F.pow(F.lit(2.0), F.lit(STRIDE))
    cells = cells.withColumns({"leaf": closed, "plvl": F.col("lvl") - STRIDE,
                               "px": F.floor(F.col("cx") / up), "py": F.floor(F.col("cy") / up)}).drop("_fine")
    open_parents = cells.where(~F.col("leaf")).select(
        *group, *[F.col(c).alias(p) for c, p in zip(CELL, ("plvl", "px", "py"))])
    reached = cells.join(open_parents, [*group, "plvl", "px", "py"], "left_semi").unionByName(cells.where("lvl = 0"))
    cells = pin(reached, "tree-cells")
    leaves = cells.where("leaf").select(*group, *CELL)
    leafed = keyed.drop("_fx", "_fy", "_fine").join(leaves, [*group, *CELL])
    return CellTree(group, pin(leafed, "tree-points"), cells, depth, copies, not pruned)


def _drop_buried(finest: DataFrame, crowded: DataFrame, group: list[str], order: list[str], copies: int,
                 columns: list[str]) -> DataFrame:
    """In crowded cells keep the ``copies`` first points per exact location; others are untouched."""
    marked = finest.join(crowded.select(*group, *CELL, F.lit(True).alias("_crowded")), [*group, *CELL], "left")
    rank = F.row_number().over(Window.partitionBy(*group, "x", "y").orderBy(*order))
    kept = marked.where("_crowded").withColumn("_rank", rank).where(F.col("_rank") <= copies)
    return marked.where("_crowded is null").select(*columns).unionByName(kept.select(*columns))


def _near(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return F.greatest(F.lit(0.0), a_lo - b_hi, b_lo - a_hi)


def _far(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return F.greatest(a_hi - b_lo, b_hi - a_lo)


def _square(x: Column, y: Column) -> Column:
    return x * x + y * y


def _bounded(pairs: DataFrame, owner: list[str], lo_hi: tuple[list[Column], list[Column]], k: int,
             within: float | None) -> DataFrame:
    """Drop cells that start beyond the distance within which ``k`` points are certain to lie."""
    (ax, bx, ay, by), (cx, dx, cy, dy) = lo_hi
    near = _square(_near(ax, bx, cx, dx), _near(ay, by, cy, dy))
    far = _square(_far(ax, bx, cx, dx), _far(ay, by, cy, dy))
    # Distances from boxes and from points are rounded differently; keep ties.
    slack = F.lit(1 + 1e-9)
    measured = pairs.withColumns({"_near": near, "_far": far})
    if within is not None:
        measured = measured.where(F.col("_near") <= F.lit(within * within) * slack)
    whole = Window.partitionBy(*owner)
    if k == 1:
        bound = F.min("_far").over(whole)
        measured = measured.withColumn("_bound", bound)
    else:
        rising = Window.partitionBy(*owner).orderBy("_far")
        measured = measured.withColumn("_sum", F.sum("n").over(rising))
        measured = measured.withColumn("_bound", F.min(F.when(F.col("_sum") >= k, F.col("_far"))).over(
            rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).drop("_sum")
    keep = F.col("_bound").isNull() | (F.col("_near") <= F.col("_bound") * slack + 1e-18)
    return measured.where(keep).drop("_near", "_far", "_bound")


def _candidate_cells(asking: DataFrame, owner: list[str], tree: CellTree, k: int, within: float | None) -> DataFrame:
    """Pair every asking box (``q_lo_x …`` and its ``owner`` key) with the leaf cells that can hold an answer.

    All columns of ``asking`` are carried along.
    """
    group, carried = tree.group, asking.columns
    boxes = ([F.col(f"q_{c}") for c in BOX], [F.col(c) for c in BOX])
    state = [*CELL, *BOX, "n", "leaf"]
    pairs = asking.join(tree.cells.where("lvl = 0").select(*group, *state), group)
    if within is not None:
        pairs = _bounded(pairs, owner, boxes, k, within)
    for _ in range(tree.depth // STRIDE):
        below = tree.cells.select(*[F.col(g).alias(f"_g_{g}") for g in group],
                                  *[F.col(p).alias(f"_{p}") for p in ("plvl", "px", "py")],
                                  *[F.col(c).alias(f"_n_{c}") for c in state])
        match = ~F.col("leaf")
        for g in group:
            match = match & (F.col(g) == F.col(f"_g_{g}"))
        for c, p in zip(CELL, ("plvl", "px", "py")):
            match = match & (F.col(c) == F.col(f"_{p}"))
        step = pairs.join(below, match, "left")
        step = step.select(*carried, *[F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) for c in state])
        pairs = _bounded(step, owner, boxes, k, within)
    return pairs.drop(*[f"q_{c}" for c in BOX])


def _candidates_by_block(asking: CellTree, tree: CellTree, k: int, within: float | None) -> DataFrame:
    owner = [*tree.group, *[f"b_{c}" for c in CELL]]
    blocks = asking.cells.where("leaf").select(*tree.group, *[F.col(c).alias(f"b_{c}") for c in CELL],
                                               *[F.col(c).alias(f"q_{c}") for c in BOX])
    pairs = _candidate_cells(blocks, owner, tree, k, within)
    own = [c for c in asking.points.columns if c not in CELL]
    members = asking.points.select(*own, *[F.col(c).alias(f"b_{c}") for c in CELL])
    return members.join(pairs, owner).drop(*[f"b_{c}" for c in CELL])


def _candidates_by_tile(queries: DataFrame, tile: dict[str, Column], tree: CellTree, k: int, within: float | None) -> DataFrame:
    owner = [*tree.group, *tile]
    tiled = queries.withColumns(tile)
    boxes = tiled.groupBy(*owner).agg(F.min("x").alias("q_lo_x"), F.max("x").alias("q_hi_x"),
                                      F.min("y").alias("q_lo_y"), F.max("y").alias("q_hi_y"))
    # Queries made by exploding a small table are estimated at the size of that table: never send them to the driver.
    return tiled.hint("merge").join(_candidate_cells(boxes, owner, tree, k, within), owner).drop(*tile)


def _nearest_by_cells(queries: DataFrame | CellTree, query_key: list[str], tree: CellTree, k: int, order: list[str],
                      payload: list[str], within: float | None, block_rows: int | None,
                      tile: dict[str, Column] | None) -> DataFrame:
    """:func:`nearest` for the large groups."""
    group = tree.group
    owner = list(dict.fromkeys([*group, *query_key]))
    if tile:
        own = queries.columns
        placed = _candidates_by_tile(queries, tile, tree, k, within)
    elif isinstance(queries, CellTree) or block_rows:
        asking = queries if isinstance(queries, CellTree) else build_tree(queries, group, query_key, block_rows)
        own = [c for c in asking.points.columns if c not in CELL]
        placed = _candidates_by_block(asking, tree, k, within)
    else:
        own = queries.columns
        boxed = queries.withColumns({f"q_{c}": F.col(c[-1]) for c in BOX})
        placed = _candidate_cells(boxed, owner, tree, k, within)
    x, y = F.col("x"), F.col("y")
    placed = _bounded(placed, owner, ([x, x, y, y], [F.col(c) for c in BOX]), k, within)
    carried = list(dict.fromkeys([*payload, *order, "x", "y"]))
    members = tree.points.select(*group, *CELL, *[F.col(c).alias(f"n_{c}") for c in carried if c not in group])
    found = placed.select(*own, *CELL).join(members, [*group, *CELL]).drop(*CELL)
    found = found.withColumn("d2", _square(F.col("n_x") - F.col("x"), F.col("n_y") - F.col("y")))
    if within is not None:
        found = found.where(F.sqrt("d2") < within)
    ordered = Window.partitionBy(*owner).orderBy("d2", *[f"n_{c}" for c in order])
    ranked = found.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k)
    wanted = {f"n_{c}" for c in payload}
    return ranked.drop(*[f"n_{c}" for c in carried if f"n_{c}" not in wanted])


def nearest(queries: DataFrame | CellTree, query_key: list[str], tree: CellTree, k: int, order: list[str],
            payload: list[str], within: float | None = None, block_rows: int | None = 8,
            tile: dict[str, Column] | None = None) -> DataFrame:
    """The ``k`` nearest tree points per query, ties broken by ``order``.

    Queries carry ``(group, x, y)`` and a unique ``query_key``; pass the tree itself for a self-join.
    Without ``block_rows`` every query searches alone, which saves sorting queries that are used once.
    ``tile`` names columns that already gather neighbouring queries, such as parts of a node grid.  Both concern large groups only.
    Output: the query columns, ``n_<payload>``, ``d2`` and 1-based ``rank``.  With ``within`` only
    points strictly closer than that distance are returned.
    """
    if tree.copies is not None and k > tree.copies:
        raise ValueError(f"the tree answers up to k={tree.copies}")
    if tree.small is None:
        return _nearest_by_cells(queries, query_key, tree, k, order, payload, within, block_rows, tile)
    own = _own_columns(queries)
    found = _compared(_of_small_groups(queries, tree), tree, k, order, payload, within)
    if tree.large is not None:
        asking = queries if isinstance(queries, CellTree) else queries.join(tree.large, tree.group, "left_semi")
        by_cells = _nearest_by_cells(asking, query_key, tree, k, order, payload, within, block_rows, tile)
        found = found.unionByName(by_cells.select(*own, *[f"n_{c}" for c in payload], "d2", "rank"))
    return found


def nearest_moments(queries: DataFrame | CellTree, query_key: list[str], tree: CellTree, k: int, order: list[str]) -> DataFrame:
    """The query columns and ``MOMENTS`` of its ``k`` nearest points: their number, and sums and products relative to the query."""
    if tree.copies is not None and k > tree.copies:
        raise ValueError(f"the tree answers up to k={tree.copies}")
    own = _own_columns(queries)
    found = None if tree.small is None else _compared(_of_small_groups(queries, tree), tree, k, order, None, None)
    if found is not None and tree.large is None:
        return found
    asking = queries if isinstance(queries, CellTree) or found is None else queries.join(tree.large, tree.group, "left_semi")
    pairs = _nearest_by_cells(asking, query_key, tree, k, order, ["x", "y"], None, 8, None)
    key = list(dict.fromkeys([*tree.group, *query_key]))
    # Moments relative to the query point keep the sums small.
    u, v = F.col("n_x") - F.col("x"), F.col("n_y") - F.col("y")
    sums = pairs.groupBy(*key).agg(*[F.first(c).alias(c) for c in own if c not in key], F.count(F.lit(1)).alias("_n"),
                                   F.sum(u).alias("_u"), F.sum(v).alias("_v"), F.sum(u * u).alias("_uu"),
                                   F.sum(u * v).alias("_uv"), F.sum(v * v).alias("_vv"))
    sums = sums.select(*own, *MOMENTS)
    return sums if found is None else found.unionByName(sums)


def _own_columns(queries: DataFrame | CellTree) -> list[str]:
    rows = (queries.points if queries.small is None else queries.small) if isinstance(queries, CellTree) else queries
    return [c for c in rows.columns if c not in CELL]


def _of_small_groups(queries: DataFrame | CellTree, tree: CellTree) -> DataFrame | None:
    """The queries that are compared with whole groups; none stands for the points of the tree themselves."""
    if isinstance(queries, CellTree):
        return None
    asking = _placed(queries, tree.group)
    return asking if tree.large is None else asking.join(tree.large, tree.group, "left_anti")


def _compared(queries: DataFrame | None, tree: CellTree, k: int, order: list[str], payload: list[str] | None,
              within: float | None) -> DataFrame:
    """Queries of small groups with their nearest points, or with the moments of those if there is no ``payload``.

    Rows are dealt by group and sorted, points before queries; a task keeps the points of one group at a time.
    """
    group, points = tree.group, tree.small
    own = points.columns if queries is None else queries.columns
    kinds = {f.name: f.dataType for f in (points if queries is None else queries).schema}
    carried = [c for c in payload or [] if c not in group]
    if queries is None:
        rows = points.repartition(*group).sortWithinPartitions(*group, *order)
        mine, theirs = {c: c for c in own}, {c: c for c in points.columns}
    else:
        mine = {c: c if c in group else f"q_{c}" for c in own}
        needed = list(dict.fromkeys([*order, *carried, "x", "y"]))
        theirs = {c: c if c in group else f"p_{c}" for c in [*group, *needed]}
        left = points.select(F.lit(False).alias("_asks"), *[F.col(c).alias(n) for c, n in theirs.items()])
        right = queries.select(F.lit(True).alias("_asks"), *[F.col(c).alias(n) for c, n in mine.items()])
        both = left.unionByName(right, allowMissingColumns=True)
        rows = both.repartition(*group).sortWithinPartitions(
            *group, "_asks", *[theirs[c] for c in order], *[mine[c] for c in own if c in ("x", "y")])
    fields = [StructField(c, kinds[c]) for c in own]
    if payload is None:
        fields += [StructField("_n", LongType())] + [StructField(c, DoubleType()) for c in MOMENTS[1:]]
    else:
        fields += [StructField(f"n_{c}", points.schema[c].dataType) for c in payload]
        fields += [StructField("d2", DoubleType()), StructField("rank", IntegerType())]
    names, alone = [f.name for f in fields], queries is None

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch, last in _with_last(batches):
            table = pa.Table.from_batches([batch] if kept is None else [kept, batch]).combine_chunks()
            if not table.num_rows:
                continue
            asks = np.arange(table.num_rows) >= 0 if alone else table["_asks"].to_numpy()
            new = np.ones(table.num_rows, dtype=bool)
            new[1:] = np.logical_or.reduce([pc.not_equal(table[g].slice(1), table[g].slice(0, table.num_rows - 1)).to_numpy() for g in group])
            start = np.flatnonzero(new)
            stop = np.append(start[1:], table.num_rows)
            if alone:
                # The open group's points are not all here.
                done, keep = (len(start), None) if last else (len(start) - 1, table.slice(start[-1]))
                at = _Segments(start[:done], stop[:done], start[:done], stop[:done])
            else:
                split = start + np.add.reduceat((~asks).astype(np.int64), start)
                keep = None if last else table.slice(start[-1], split[-1] - start[-1])
                at = _Segments(start, split, split, stop)
            kept = None if keep is None else _one_batch(keep)
            place = {side: [table[n[c]].to_numpy() for c in ("x", "y")] for side, n in (("q", mine), ("p", theirs))}
            for q, p, d2, rank in _closest(at, *place["q"], *place["p"], k):
                if within is not None:
                    near = np.sqrt(d2) < within
                    q, p, d2, rank = q[near], p[near], d2[near], rank[near]
                if payload is None:
                    first = np.flatnonzero(rank == 1)
                    u, v = place["p"][0][p] - place["q"][0][q], place["p"][1][p] - place["q"][1][q]
                    counts = np.diff(np.append(first, len(q)))
                    sums = [np.add.reduceat(c, first) if len(first) else np.zeros(0) for c in (u, v, u * u, u * v, v * v)]
                    asked = pa.array(q[first])
                    out = [table[mine[c]].take(asked) for c in own] + [pa.array(counts.astype(np.int64)), *map(pa.array, sums)]
                else:
                    asked, given = pa.array(q), pa.array(p)
                    out = [table[mine[c]].take(asked) for c in own] + [table[theirs[c]].take(given) for c in payload]
                    out += [pa.array(d2), pa.array(rank.astype(np.int32))]
                yield _one_batch(pa.table(out, names=names))

    return rows.mapInArrow(search, StructType(fields))


class _Segments(NamedTuple):
    """Rows of the points and of the queries of each group."""

    p_start: np.ndarray
    p_stop: np.ndarray
    q_start: np.ndarray
    q_stop: np.ndarray


def _with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Every batch, and whether it is the last one."""
    before = None
    for batch in batches:
        if before is not None:
            yield before, False
        before = batch
    if before is not None:
        yield before, True


def _one_batch(table: pa.Table) -> pa.RecordBatch:
    whole = table.combine_chunks()
    arrays = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in whole.columns]
    return pa.RecordBatch.from_arrays(arrays, schema=whole.schema)


def _closest(at: _Segments, qx: np.ndarray, qy: np.ndarray, px: np.ndarray, py: np.ndarray,
             k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(query row, point row, squared distance, rank)`` by query and rank; of equally near points the earlier row comes first."""
    n_points, n_queries = at.p_stop - at.p_start, at.q_stop - at.q_start
    pairs = n_points * n_queries
    few = np.flatnonzero((pairs > 0) & (pairs <= FEW_PAIRS))
    if len(few):
        # All pairs of many groups in one row.
        group = np.repeat(few, pairs[few])
        number = np.arange(len(group)) - np.repeat(np.cumsum(pairs[few]) - pairs[few], pairs[few])
        q, p = at.q_start[group] + number // n_points[group], at.p_start[group] + number % n_points[group]
        d2 = (px[p] - qx[q]) ** 2 + (py[p] - qy[q]) ** 2
        yield _ranked(q, p, d2, k)
    for g in np.flatnonzero(pairs > FEW_PAIRS):
        p0, p1 = at.p_start[g], at.p_stop[g]
        step = max(1, DISTANCES_AT_ONCE // (p1 - p0))
        parts = []
        for q0 in range(at.q_start[g], at.q_stop[g], step):
            q1 = min(q0 + step, at.q_stop[g])
            d2 = (px[None, p0:p1] - qx[q0:q1, None]) ** 2 + (py[None, p0:p1] - qy[q0:q1, None]) ** 2
            if k == 1 and not np.isnan(d2.sum()):
                row, column = np.arange(q1 - q0), d2.argmin(axis=1)
            elif p1 - p0 <= k:
                row, column = (i.ravel() for i in np.indices(d2.shape))
            else:
                # All that are as near as the k-th; ties are settled by rank.
                row, column = np.nonzero(~(d2 > np.partition(d2, k - 1, axis=1)[:, k - 1: k]))
            parts.append(_ranked(row + q0, column + p0, d2[row, column], k))
        yield tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _ranked(q: np.ndarray, p: np.ndarray, d2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((p, d2, q))
    q, p, d2 = q[order], p[order], d2[order]
    new = np.ones(len(q), dtype=bool)
    new[1:] = q[1:] != q[:-1]
    start = np.flatnonzero(new)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q)))) + 1
    kept = rank <= k
    return q[kept], p[kept], d2[kept], rank[kept]
