"""Linked groups of records by union-find on a two-dimensional grid of edge blocks.

Vertices are hashed into B blocks and an edge goes to the cell (block of one end, block of the other). Every cell runs a
union-find over its own edges and keeps, per vertex, the smallest key it reaches. A vertex lies in one row and one
column of cells; their representatives are exchanged by taking the smallest, and the others become edges of the next,
smaller graph. When no edge is left the representatives of the rounds are chained to the final one. A vertex that
holds a third of all edges spreads over the B cells of its row, and leaves each of them as one representative; a
group that holds a third of all records is dealt over parts when its records are given the final representative.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varweave.functions.union_find import smallest_linked as union_find
from varweave.operators.skew import SPLIT_ROWS, salted_join
from varweave.session import cut

#: Edges that one cell should hold; the grid is as fine as that takes.
CELL_EDGES = 250_000
FIRST_BLOCKS = 2


def _cells(edges: DataFrame, blocks: int) -> DataFrame:
    """(v, rep) after a union-find in every cell of the grid."""
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    laid = edges.select("u", "v", (block("u") * blocks + block("v")).alias("cell"))
    # One partition a cell, without collisions.
    laid = laid.repartitionById(blocks * blocks, F.col("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_u, held_v, held = [], [], 0
        for batch in batches:
            u, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            held_u.append(u)
            held_v.append(v)
            held += len(u)
            if held > 4 * CELL_EDGES:
                # Shrink to the forest found so far, which bounds memory by the vertices of the partition.
                # Roots stay as pairs with themselves: a key paired with itself only has no other row.
                names, reps = union_find(np.concatenate(held_u), np.concatenate(held_v))
                held_u, held_v = [names], [reps]
                held = 0
        if held_u:
            names, reps = union_find(np.concatenate(held_u), np.concatenate(held_v))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(reps)], names=["v", "rep"])

    return laid.select("u", "v").mapInArrow(run, "v long, rep long")


def connected_groups(pairs: DataFrame, lhs: str, rhs: str, blocks: int | None = None, max_rounds: int = 64, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(key, group) of every key in a row with both sides, the group being its smallest linked key.

    Rows with a missing side count for nothing. Repeated pairs, either order, and pairs of a key with itself are
    allowed; a key paired with itself only is its own group. An empty table gives no rows. ``blocks`` is the number of
    vertex blocks; by default it follows the number of pairs. Groups of more than ``split_rows`` records are dealt over
    several tasks in the last joins. If the groups do not settle in ``max_rounds`` rounds, an error is raised.
    """
    both = pairs.filter(F.col(lhs).isNotNull() & F.col(rhs).isNotNull()).select(F.col(lhs).cast("long").alias("x"), F.col(rhs).cast("long").alias("y"))
    edges = both.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
    n = edges.count()
    level_maps: list[DataFrame] = []
    for turn in range(max_rounds):
        # What one cell may hold ends in one cell; the first round is spread in any case.
        b = blocks or max(1 if turn else FIRST_BLOCKS, math.ceil(math.sqrt(n / CELL_EDGES)))
        found = _cells(edges, b)
        # The exchange along rows and columns: the smallest representative of each vertex.
        parents = cut(found.groupBy("v").agg(F.min("rep").alias("p"), F.collect_set("rep").alias("reps")))
        level_maps.append(parents.select("v", "p"))
        edges = parents.select(F.col("p").alias("u"), F.explode("reps").alias("v")).filter(F.col("u") != F.col("v"))
        # Links between representatives, and each representative's own smaller one where it is no root itself.
        edges = edges.distinct()
        n = edges.count()
        if not n:
            break
    else:
        raise RuntimeError("the groups did not settle")
    # Later rounds are smaller: chain from the last to the first.
    final = level_maps[-1].select("v", F.col("p").alias("g"))
    for level in reversed(level_maps[:-1]):
        up = final.select(F.col("v").alias("__p"), "g")
        final = salted_join(level, up, [("p", "__p")], F.col("v"), "left", split_rows=split_rows).select("v", F.coalesce("g", "p").alias("g"))
    return final.select(F.col("v").alias("key"), F.col("g").alias("group"))
