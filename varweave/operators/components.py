"""Connected components of a pair table: union-find inside every partition, and an exchange of representatives between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varweave.functions.union_find import smallest_linked
from varweave.session import cut

#: Edges that a task unites at once; what it holds between is a forest over the vertices it has met.
HELD_EDGES = 1_000_000


def _forests(edges: DataFrame) -> DataFrame:
    """(v, rep): every vertex of a partition's edges with the smallest one it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, rows = [], [], 0
        for batch in batches:
            us.append(batch.column(0).to_numpy(zero_copy_only=False))
            vs.append(batch.column(1).to_numpy(zero_copy_only=False))
            rows += batch.num_rows
            if rows > HELD_EDGES:
                names, reps = smallest_linked(np.concatenate(us), np.concatenate(vs))
                us, vs, rows = [names], [reps], 0
        if us:
            names, reps = smallest_linked(np.concatenate(us), np.concatenate(vs))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(reps)], names=["v", "rep"])

    return edges.mapInArrow(run, "v long, rep long")


def pair_components(pairs: DataFrame, lhs: str, rhs: str, max_rounds: int = 64) -> DataFrame:
    """(key, component) of every key of the pairs, the component being its smallest key.

    Every vertex takes the smallest of its partitions' representatives; links between a vertex's representatives are the
    edges of the next, smaller graph, until there is none. Partial minima leave the mappers, so a vertex with many
    neighbours costs one representative per task. Pairs with a null are ignored. Raises if it does not settle.
    """
    edges = pairs.filter(F.col(lhs).isNotNull() & F.col(rhs).isNotNull()).select(F.col(lhs).cast("long").alias("u"), F.col(rhs).cast("long").alias("v"))
    if edges.rdd.getNumPartitions() == 1:
        # No other partition has representatives to exchange.
        return _forests(edges).select(F.col("v").alias("key"), F.col("rep").alias("component"))
    levels: list[DataFrame] = []
    for _ in range(max_rounds):
        met = cut(_forests(edges).groupBy("v").agg(F.min("rep").alias("p"), F.collect_set("rep").alias("reps")))
        levels.append(met.select("v", "p"))
        open_reps = met.filter(F.size("reps") > 1)
        if open_reps.isEmpty():
            break
        edges = open_reps.select(F.col("p").alias("u"), F.explode("reps").alias("v")).filter("u <> v").distinct()
    else:
        raise RuntimeError("the components did not settle")
    final = levels[-1].select("v", F.col("p").alias("g"))
    for level in reversed(levels[:-1]):
        up = final.select(F.col("v").alias("p"), "g")
        final = level.join(up, "p", "left").select("v", F.coalesce("g", "p").alias("g"))
    return final.select(F.col("v").alias("key"), F.col("g").alias("component"))
