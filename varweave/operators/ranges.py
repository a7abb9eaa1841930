"""Band, interval-overlap, nearest and within joins as equi-joins on cells, so no key's rows meet each other pairwise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varweave.errors import DuplicateKey
from varweave.operators.skew import salted_join
from varweave.session import cut

#: Rows of one cell from which its left side is dealt over tasks. Where cells are that full most pairs in them match, so
#: what is repeated of the right side stays small against the result.
CELL_ROWS = 20_000
#: Pairs that within makes at once.
PAIRS = 1 << 18


def band_join(lhs: DataFrame, rhs: DataFrame, equi: list[tuple[str, str]], lhs_value: str, rhs_value: str, width: int, residual: Column, deal: str | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Pairs with equal ``equi`` columns, |lhs_value - rhs_value| <= width, and the residual.

    Cells are width + 1 wide, so a partner lies in the same cell or a neighbour; the right side is repeated three times and
    each pair meets in exactly one cell. Cells with many rows are split by a hash of ``deal``, a column of the left side (by default
    its value). Nulls in the values or equi columns match nothing. Column names of the two sides must differ.
    """
    cell = lambda c: F.floor(F.col(c).cast("long") / F.lit(width + 1)).cast("long")
    left = lhs.withColumn("__lc", cell(lhs_value))
    right = rhs.withColumn("__rc", F.explode(F.array(cell(rhs_value) - 1, cell(rhs_value), cell(rhs_value) + 1)))
    near = (F.abs(F.col(lhs_value).cast("long") - F.col(rhs_value).cast("long")) <= width) & residual
    return salted_join(left, right, [*equi, ("__lc", "__rc")], F.col(deal or lhs_value), where=near, split_rows=cell_rows).drop("__lc", "__rc")


#: The smallest cell of the interval index and the factor between its levels.
FINEST, FACTOR, LEVELS = 1 << 9, 8, 8


def overlap_join(lhs: DataFrame, rhs: DataFrame, lhs_eq: list[str], rhs_eq: list[str], lhs_range: tuple[str, str], rhs_range: tuple[str, str], where: Column | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Pairs with equal eq columns and overlapping closed intervals: l.start <= r.end and r.start <= l.end.

    An interval is filed in the finest level of cells of which it touches at most two. Each side's intervals also look
    into those coarser levels that the other side uses (at most eight numbers, asked for first), so intervals of any length
    are repeated a bounded number of times; a pair is kept in the cell of the later start only. Cells with many intervals are
    split by a hash of the left start. An interval whose end lies before its start, or with a null, is left out
    only if it cannot satisfy the two comparisons. Column names of the two sides must differ.
    """

    def filed(df: DataFrame, span: tuple[str, str], tag: str) -> DataFrame:
        lo, hi = F.least(*span).cast("long"), F.greatest(*span).cast("long")
        level = sum((F.when(hi - lo >= FINEST * FACTOR**i, 1).otherwise(0) for i in range(LEVELS - 1)), F.lit(0))
        return df.withColumns({f"__{tag}lo": lo, f"__{tag}hi": hi, f"__{tag}level": level})

    def cells(lo: str, hi: str, level: Column) -> Column:
        size = F.lit(FINEST) * F.pow(F.lit(float(FACTOR)), level).cast("long")
        return F.sequence(F.floor(F.col(lo) / size).cast("long"), F.floor(F.col(hi) / size).cast("long"))

    # Written once: both are read for their levels, for their hot cells and for each of the two joins.
    a = cut(filed(lhs.filter(F.col(lhs_range[0]).isNotNull() & F.col(lhs_range[1]).isNotNull()), lhs_range, "l"))
    b = cut(filed(rhs.filter(F.col(rhs_range[0]).isNotNull() & F.col(rhs_range[1]).isNotNull()), rhs_range, "r"))

    def used(df: DataFrame, tag: str) -> list[int]:
        return sorted(r[0] for r in df.select(f"__{tag}level").distinct().collect())

    def own(df: DataFrame, tag: str) -> DataFrame:
        return df.withColumn(f"__{tag}at", F.col(f"__{tag}level")).withColumn(f"__{tag}cell", F.explode(cells(f"__{tag}lo", f"__{tag}hi", F.col(f"__{tag}level"))))

    def upward(df: DataFrame, tag: str, strictly: int, levels: list[int]) -> DataFrame:
        first = F.col(f"__{tag}level") + strictly
        some = F.filter(F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>"), lambda x: x >= first)
        return df.withColumn(f"__{tag}at", F.explode(some)).withColumn(f"__{tag}cell", F.explode(cells(f"__{tag}lo", f"__{tag}hi", F.col(f"__{tag}at"))))

    size = F.lit(FINEST) * F.pow(F.lit(float(FACTOR)), F.col("__lat")).cast("long")
    meet = (F.col(lhs_range[0]) <= F.col(rhs_range[1])) & (F.col(rhs_range[0]) <= F.col(lhs_range[1]))
    meet = meet & (F.col("__lcell") == F.floor(F.greatest("__llo", "__rlo") / size))
    if where is not None:
        meet = meet & where
    on = [*zip(lhs_eq, rhs_eq), ("__lat", "__rat"), ("__lcell", "__rcell")]
    kept = [*lhs.columns, *rhs.columns]
    join = lambda x, y: salted_join(x, y, on, F.col("__llo"), where=meet, split_rows=cell_rows).select(*kept)
    return join(upward(a, "l", 0, used(b, "r")), own(b, "r")).unionByName(join(own(a, "l"), upward(b, "r", 1, used(a, "l"))))


def check_unique(keys: DataFrame, key: str) -> None:
    """Raise if a key occurs twice."""
    twice = keys.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").limit(1).collect()
    if twice:
        raise DuplicateKey(str(twice[0][0]))


def nearest(points: DataFrame, keys: DataFrame, point: str, key: str) -> DataFrame:
    """Every row of ``points`` with ``nearest``: the key closest to its point, the lower one on a tie; null without keys.

    Keys must be unique integers. Points and keys are range-partitioned by value together, evenly wherever they lie; one pass over each
    partition in rising order carries the key below along, one in falling order the key above, and the partitions' outermost
    keys, two a partition, reach over the borders. Null points have no nearest key; null keys are ignored. Columns of ``keys`` other than
    the key are ignored.
    """
    check_unique(keys, key)
    kt = dict(keys.dtypes)[key]
    own = points.columns
    known = keys.filter(F.col(key).isNotNull()).select(*[F.lit(None).cast(t).alias(c) for c, t in points.dtypes], F.col(key).cast("long").alias("__at"), F.lit(0).alias("__side"))
    asked = points.filter(F.col(point).isNotNull()).select(*own, F.col(point).cast("long").alias("__at"), F.lit(1).alias("__side"))
    # A point value that very many rows share is spread by their hash.
    both = known.unionByName(asked).repartitionByRange("__at", F.xxhash64(*own)).withColumn("__pid", F.spark_partition_id())
    both = cut(both)
    ends = {r["__pid"]: (r["lo"], r["hi"]) for r in both.filter("__side = 0").groupBy("__pid").agg(F.min("__at").alias("lo"), F.max("__at").alias("hi")).collect()}
    pids = sorted(ends)

    def carried(name: str, rising: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, first = None, True
            for batch in batches:
                if not batch.num_rows:
                    continue
                at, side = batch.column(batch.schema.get_field_index("__at")).to_numpy(), batch.column(batch.schema.get_field_index("__side")).to_numpy()
                if first:
                    pid, first = batch.column(batch.schema.get_field_index("__pid"))[0].as_py(), False
                    outside = [p for p in pids if (p < pid if rising else p > pid)]
                    held = (ends[outside[-1]][1] if rising else ends[outside[0]][0]) if outside else None
                last = np.maximum.accumulate(np.where(side == 0, np.arange(len(at)), -1))
                value = np.where(last >= 0, at[np.maximum(last, 0)], held if held is not None else 0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, mask=(last < 0) & (held is None))], names=[*batch.schema.names, name])
                if last[-1] >= 0:
                    held = int(at[last[-1]])

        return run

    fields = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    up = both.sortWithinPartitions("__at", "__side").mapInArrow(carried("__below", True), f"{fields(both)}, __below long")
    met = up.sortWithinPartitions(F.col("__at").desc(), "__side").mapInArrow(carried("__above", False), f"{fields(up)}, __above long").filter("__side = 1")
    below, above = F.col("__below"), F.col("__above")
    chosen = F.when(below.isNull(), above).when(above.isNull(), below).when(above - F.col("__at") < F.col("__at") - below, above).otherwise(below)
    found = met.select(*own, chosen.cast(kt).alias("nearest"))
    return found.unionByName(points.filter(F.col(point).isNull()).withColumn("nearest", F.lit(None).cast(kt)))


def within(points: DataFrame, keys: DataFrame, point: str, key: str, distance: int) -> DataFrame:
    """(point columns, key, rank): the unique keys closer than ``distance`` to each point, nearest first, the lower on a tie.

    A point that occurs in several rows gets its keys once per distinct row. Points are range-partitioned by value, evenly wherever
    they lie, and each key goes to the partitions whose points it may be near, by their bounds, two numbers a partition. A task
    holds its keys sorted and ranks them point by point, so no pair is shuffled.
    """
    check_unique(keys, key)
    kt = dict(keys.dtypes)[key]
    own = points.columns
    some = points.filter(F.col(point).isNotNull()).distinct().withColumn("__at", F.col(point).cast("long"))
    # A point value that very many rows share is spread by their hash.
    laid = cut(some.repartitionByRange("__at", F.xxhash64(*own)).withColumn("__pid", F.spark_partition_id()))
    ends = sorted((r["__pid"], r["lo"], r["hi"]) for r in laid.groupBy("__pid").agg(F.min("__at").alias("lo"), F.max("__at").alias("hi")).collect())
    pids, lows, highs = (np.array([e[i] for e in ends], np.int64) for i in range(3))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Partitions rise by their points, so those that a key may be near follow each other.
        for batch in batches:
            at = batch.column(0).to_numpy()
            first, last = np.searchsorted(highs, at - distance, "right"), np.searchsorted(lows, at + distance, "left")
            n = np.maximum(last - first, 0)
            each = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, n)), pa.array(pids[each].astype(np.int32))], names=["__at", "__pid"])

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[np.ndarray] = []
        sorted_keys = None
        for batch in batches:
            at, side = batch.column(len(own)).to_numpy(), batch.column(len(own) + 1).to_numpy()
            split = int(np.searchsorted(side, 1))  # keys come first
            if split:
                known.append(at[:split])
            if split == batch.num_rows:
                continue
            if sorted_keys is None:
                sorted_keys = np.concatenate(known) if known else np.empty(0, np.int64)
            at, rows = at[split:], batch.slice(split).select(own)
            first, last = np.searchsorted(sorted_keys, at - distance, "right"), np.searchsorted(sorted_keys, at + distance, "left")
            total = np.r_[0, np.cumsum(last - first)]
            a = 0
            while a < len(at):
                b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, "right")) - 1)
                n = (last - first)[a:b]
                if total[b] > total[a]:
                    owner, begins = np.repeat(np.arange(a, b), n), np.repeat(np.cumsum(n) - n, n)
                    place = np.arange(len(owner)) - begins
                    found = sorted_keys[place + np.repeat(first[a:b], n)]
                    # The lower key first, and by distance and owner, whose sort is stable.
                    found = found[np.lexsort((np.abs(found - at[owner]), owner))]
                    met = rows.take(pa.array(owner))
                    yield pa.RecordBatch.from_arrays([*met.columns, pa.array(found), pa.array((place + 1).astype(np.int32))], names=[*own, "near_key", "rank"])
                a = b

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    rhs = keys.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("__at")).mapInArrow(near, "__at long, __pid int")
    rhs = rhs.select(*[F.lit(None).cast(t).alias(c) for c, t in points.dtypes], "__at", F.lit(0).alias("__side"), "__pid")
    both = rhs.unionByName(laid.select(*own, "__at", F.lit(1).alias("__side"), "__pid"))
    parts = int(pids.max(initial=0)) + 1
    met = both.repartitionById(parts, F.col("__pid")).drop("__pid").sortWithinPartitions("__side", "__at")
    return met.mapInArrow(ranked, f"{fields}, near_key long, rank int").withColumn("near_key", F.col("near_key").cast(kt))
