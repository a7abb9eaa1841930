"""Equi-joins in which a few keys of one side hold very many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that are split at most. Any key beyond them holds at most 1/MAX_HOT of the rows.
MAX_HOT = 10_000
#: Rows of one key from which it is split, and rows that each of its parts should come to.
SPLIT_ROWS = 200_000
#: One in so many rows is counted, if a hot key has at least SAMPLE_LEAST rows among them.
SAMPLE, SAMPLE_LEAST = 16, 100


def hot_keys(df: DataFrame, key: list[str], split_rows: int = SPLIT_ROWS, most: int = MAX_HOT) -> list[tuple]:
    """(key values, parts) of the keys with more than ``split_rows`` rows, at most ``most`` of them, the largest first.

    Counts are partial before the shuffle. A null in the key is never hot, since it joins with nothing.
    """
    known = F.lit(True)
    for k in key:
        known = known & F.col(k).isNotNull()
    counts = df.filter(known).groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > split_rows)
    return [(*r[:-1], -(-r[-1] // split_rows)) for r in counts.orderBy(F.col("__n").desc(), *key).limit(most).collect()]


def salted_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], deal: Column, how: str = "inner", where: Column | None = None, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``left JOIN right`` on equal columns, the rows of hot keys of the left side dealt over parts by a hash of ``deal``.

    The right side's rows of a hot key are repeated for its parts; the list of hot keys (at most MAX_HOT) is broadcast, so
    neither side is shuffled before it is split. ``how`` is inner or left. The result has all columns of both; their names
    must differ. Without hot keys it is the plain join. Hot keys are told by the rows in one of SAMPLE parts of the hash, which
    bears on the balance only.
    """
    keys = [a for a, _ in on]
    cond = F.lit(True)
    for a, b in on:
        cond = cond & (F.col(a) == F.col(b))
    if where is not None:
        cond = cond & where
    sample = SAMPLE if split_rows >= SAMPLE * SAMPLE_LEAST else 1
    hot = hot_keys(left.filter(F.pmod(F.xxhash64(deal), F.lit(sample)) == 0) if sample > 1 else left, keys, split_rows // sample)
    if not hot:
        return left.join(right, cond, how)
    spark = left.sparkSession
    fields = {f.name: f.dataType for f in left.schema.fields}
    known = spark.createDataFrame(hot, T.StructType([T.StructField(f"__h{i}", fields[k]) for i, k in enumerate(keys)] + [T.StructField("__parts", T.LongType())]))

    def parted(df: DataFrame, names: list[str]) -> DataFrame:
        met = F.lit(True)
        for i, n in enumerate(names):
            met = met & (F.col(n) == F.col(f"__h{i}"))
        out = df.join(F.broadcast(known), met, "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
        return out.drop(*[f"__h{i}" for i in range(len(names))])

    lhs = parted(left, keys).withColumn("__lpart", F.pmod(F.xxhash64(deal, F.lit(1)), F.col("__parts"))).drop("__parts")
    rhs = parted(right, [b for _, b in on]).withColumn("__rpart", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1))).drop("__parts")
    return lhs.join(rhs, cond & (F.col("__lpart") == F.col("__rpart")), how).drop("__lpart", "__rpart")
