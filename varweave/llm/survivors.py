"""The best representative of each duplicate group by skyline selection.

Every merged field is an axis (the worth of the member's value), recency is one more, and trust - the rank that a
lexicographic order of the trust columns gives - the last. Members that another member beats or equals on every axis are
dominated. The undominated ones are found in steps that never hold a whole group: within what a task reads, then within
salted parts of the groups that kept many there, then in what is left of each. A lexicographic policy picks each field's
member from the skyline, and a field that no member of the skyline fills is filled from the next dominance layers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varweave.session import cut

#: Members of a group up to which all groups are compared at once; larger ones go block by block, with the same result.
CHUNK, BLOCK, TILE = 64, 512, 2048
#: Rows that a task compares at once where it reads them.
STEP_ROWS = 32_768
#: Members of a group whose layers one task finds at once; of larger groups the layers are peeled one by one.
DEEP_ROWS = 100_000

#: The merge rounds that a criteria text may name.
ROUNDS = ["exact", "locus", "here", "there", "near"]


def sequence_worth(seq: Column) -> Column:
    """The number of A, C, G and T of a text that consists of A, C, G, T and N in either case; else 0."""
    plain = F.upper(seq)
    known = F.length(F.regexp_replace(plain, "[^ACGT]", ""))
    return F.coalesce(F.when(seq.rlike(r"^[ACGTNacgtn]+\z"), known), F.lit(0)).cast("long")


def criteria_worth(criteria: Column) -> Column:
    """How many different merge rounds a text names, whatever its separators and case; a round must stand as a word."""
    words = F.split(F.lower(criteria), "[^a-z0-9]+")
    return F.coalesce(F.size(F.array_intersect(words, F.array(*[F.lit(r) for r in ROUNDS]))), F.lit(0)).cast("long")


def _beats(a: np.ndarray, b: np.ndarray, ties: bool) -> np.ndarray:
    """Of each pair of rows whether the first dominates the second; with ``ties`` equal rows do not."""
    at_least = np.ones(np.broadcast_shapes(a.shape, b.shape)[:-1], bool)
    above = np.zeros(at_least.shape, bool) if ties else ~at_least
    for j in range(a.shape[-1]):
        at_least &= a[..., j] >= b[..., j]
        if ties:
            above |= a[..., j] > b[..., j]
    return at_least & above if ties else at_least


def _undominated(key: np.ndarray, axes: np.ndarray, ties: bool = False) -> np.ndarray:
    """Positions of the rows that no other row of their key dominates; of equal rows the first stays, with ``ties`` all.

    Rows are sorted so that those that dominate come before those they dominate. Groups of at most CHUNK rows are compared
    all at once, by the distance of two rows; of a larger one each block is compared with all rows kept before it.
    """
    if not len(key):
        return np.empty(0, np.int64)
    order = np.lexsort((np.arange(len(key)), *(-axes[:, j] for j in reversed(range(axes.shape[1]))), key))
    k, x = key[order], axes[order]
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    sizes = np.diff(np.r_[starts, len(k)])
    small = np.repeat(sizes <= CHUNK, sizes)
    beaten = np.zeros(len(k), bool)
    for shift in range(1, int(sizes[sizes <= CHUNK].max(initial=1))):
        at = np.flatnonzero((k[shift:] == k[:-shift]) & small[shift:] & ~beaten[shift:])
        if len(at):
            beaten[at[_beats(x[at], x[at + shift], ties)] + shift] = True
    for lo, n in zip(starts[sizes > CHUNK].tolist(), sizes[sizes > CHUNK].tolist()):
        kept = np.empty((0, x.shape[1]), x.dtype)
        for at in range(lo, lo + n, BLOCK):
            rows = np.arange(at, min(at + BLOCK, lo + n))
            for tile in range(0, len(kept), TILE):
                rows = rows[~_beats(kept[tile : tile + TILE, None], x[rows][None], ties).any(axis=0)]
            mine = x[rows]
            rows = rows[~np.triu(_beats(mine[:, None], mine[None], ties), 1).any(axis=0)]
            beaten[at : at + BLOCK][: min(BLOCK, lo + n - at)] = True
            beaten[rows] = False
            kept = np.concatenate([kept, x[rows]])
    return np.sort(order[~beaten])


def _ranks(columns: list[np.ndarray]) -> np.ndarray:
    """The rank of each row in the lexicographic order of the columns; equal rows share one."""
    order = np.lexsort(columns[::-1])
    step = np.zeros(len(order), np.int64)
    for c in columns:
        step[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(step)
    return out


class _Group:
    """Reads key and axes from batches: the named axes, and the trust columns as one more."""

    def __init__(self, names: list[str], key: str, axes: list[str], trust: list[str]):
        self.key, self.axes, self.trust = names.index(key), [names.index(a) for a in axes], [names.index(t) for t in trust]

    def ids(self, table: pa.Table) -> np.ndarray:
        return table.column(self.key).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)

    def matrix(self, table: pa.Table) -> np.ndarray:
        cols = [table.column(i).to_numpy() for i in self.axes]
        if self.trust:
            cols.append(_ranks([table.column(i).to_numpy() for i in self.trust]))
        return np.stack(cols, axis=1)


def _by_key(df: DataFrame, at_key: int, work: Callable[[pa.Table], pa.Table], schema, shrink: bool) -> DataFrame:
    """``work`` over rows sorted by key, on tables of whole keys; ``shrink`` lets a long key be worked on while it goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows < STEP_ROWS:
                continue
            table = pa.concat_tables(held).combine_chunks()
            key = table.column(at_key)
            first = int(np.argmax(key.to_numpy() == key[-1].as_py()))
            if first:
                yield from work(table.slice(0, first)).to_batches()
            rest = table.slice(first)
            held = [work(rest) if shrink else rest]
            rows = 0 if shrink else held[0].num_rows
        if held:
            yield from work(pa.concat_tables(held).combine_chunks()).to_batches()

    return df.mapInArrow(run, schema)


def skyline(members: DataFrame, key: str, axes: list[str], trust: list[str] | None = None, salts: int | None = None, ties: bool = False) -> DataFrame:
    """The members undominated within their key.

    ``axes`` are non-null integers, larger is better; the non-null integers ``trust``, in lexicographic order, make one
    more axis. Of members equal on every axis one stays, with ``ties`` all. A member whose key is null is kept out. ``salts``
    is the number of parts into which groups are dealt that keep more than CHUNK members of what one task read; by
    default that of the session's shuffle partitions.
    """
    spark = members.sparkSession
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = members.columns
    group = _Group(names, key, axes, trust or [])

    def kept(table: pa.Table) -> pa.Table:
        return table.take(pa.array(_undominated(group.ids(table), group.matrix(table), ties)))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def salted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = kept(pa.Table.from_batches(held).combine_chunks())
            ids = group.ids(table)
            many = np.bincount(ids)[ids] > CHUNK if len(ids) else np.empty(0, bool)
            salt = np.where(many, np.arange(len(ids)) % salts, 0).astype(np.int32)
            yield from table.append_column("__salt", pa.array(salt)).to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= STEP_ROWS:
                yield from salted(held)
                held = []
        if held:
            yield from salted(held)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in members.schema.fields)
    read = members.filter(F.col(key).isNotNull()).mapInArrow(local, f"{schema}, __salt int")
    met = _by_key(read.repartition(key, "__salt").sortWithinPartitions(key).drop("__salt"), group.key, kept, schema, True)
    return _by_key(met.repartition(key).sortWithinPartitions(key), group.key, kept, schema, True)


def _prepared(members: DataFrame, key: Column, worths: dict[str, Column], recency: Column, trust: list[Column]) -> tuple[DataFrame, list[str], list[str]]:
    """Members with their axes and their trust as integers, larger being better."""
    axes = [f"__w_{f}" for f in worths] + ["__recency"]
    out = members.select(
        "*",
        key.alias("__key"),
        *[w.cast("long").alias(f"__w_{f}") for f, w in worths.items()],
        F.coalesce(F.unix_micros(recency.cast("timestamp")), F.lit(-(1 << 62))).alias("__recency"),
        *[(-F.coalesce(t.cast("long"), F.lit((1 << 62)))).alias(f"__t{i}") for i, t in enumerate(trust)],
    )
    return out, axes, [f"__t{i}" for i in range(len(trust))]


def surviving_values(
    members: DataFrame,
    key: Column,
    worths: dict[str, Column],
    recency: Column,
    trust: list[Column],
    id_col: str = "row_id",
    salts: int | None = None,
) -> DataFrame:
    """(key, field, id) of the member whose value survives, for each field that some member fills.

    ``worths`` gives each field's worth of a member, 0 for no value. The skyline is taken over all worths, recency and
    trust (smaller values of ``trust`` are more trusted, in lexicographic order). From it each field takes the member of the
    greatest worth, then the latest, then the most trusted. Since every field is an axis, a field that any member fills is
    filled within the first layer. Null recency is oldest, a null trust least trusted; members with a null key form no
    group; members delivered twice count once.
    """
    out, axes, order = _prepared(members, key, worths, recency, trust)
    slim = out.select("__key", id_col, *axes, *order).filter(F.col("__key").isNotNull())
    sky = skyline(slim, "__key", axes, order, salts)
    picks = [F.max_by(F.when(F.col(f"__w_{f}") > 0, F.col(id_col)), F.struct(f"__w_{f}", "__recency", *order)).alias(f) for f in worths]
    best = sky.groupBy("__key").agg(*picks)
    long = best.select("__key", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("id")) for f in worths])).alias("x"))
    return long.select("__key", "x.field", F.col("x.id").alias(id_col)).filter(F.col(id_col).isNotNull())


def layer_numbers(axes: np.ndarray) -> np.ndarray:
    """The dominance layer of every row, from 0; equal rows share one.

    Rows are taken so that those that dominate come first. A row beaten in one layer is beaten in every earlier one, so
    its own is found by bisection.
    """
    x, back = np.unique(axes, axis=0, return_inverse=True)
    out = np.zeros(len(x), np.int64)
    layers: list[np.ndarray] = []
    sizes: list[int] = []
    for i in range(len(x) - 1, -1, -1):
        lo, hi = 0, len(layers)
        while lo < hi:
            mid = (lo + hi) // 2
            if (layers[mid][: sizes[mid]] >= x[i]).all(axis=1).any():
                lo = mid + 1
            else:
                hi = mid
        if lo == len(layers):
            layers.append(np.empty((1, x.shape[1]), x.dtype))
            sizes.append(0)
        elif sizes[lo] == len(layers[lo]):
            layers[lo] = np.concatenate([layers[lo], np.empty_like(layers[lo])])
        layers[lo][sizes[lo]] = x[i]
        sizes[lo] += 1
        out[i] = lo
    return out[back.reshape(-1)]


def _layers_of(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The layer of every row within its group, from 0: small groups are peeled all at once, larger ones each by itself."""
    out = np.zeros(len(ids), np.int64)
    size = np.bincount(ids)[ids] if len(ids) else ids
    left = np.flatnonzero(size <= CHUNK)
    for n in count():
        if not len(left):
            break
        out[left] = n
        top = np.zeros(len(left), bool)
        top[_undominated(ids[left], x[left], True)] = True
        left = left[~top]
    for g in np.unique(ids[size > CHUNK]).tolist():
        at = np.flatnonzero(ids == g)
        out[at] = layer_numbers(x[at])
    return out


def _with_layers(df: DataFrame, key: str, axes: list[str], trust: list[str]) -> DataFrame:
    """The rows with ``__layer``, the layer of each within its key from 0; a key is held by one task."""
    group = _Group(df.columns, key, axes, trust)

    def work(table: pa.Table) -> pa.Table:
        return table.append_column("__layer", pa.array(_layers_of(group.ids(table), group.matrix(table))))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return _by_key(df.repartition(key).sortWithinPartitions(key), group.key, work, f"{schema}, __layer long", False)


def merged_records(
    members: DataFrame,
    key: Column,
    key_name: str,
    worths: dict[str, Column],
    carried: list[str],
    recency: Column,
    trust: list[Column],
    salts: int | None = None,
    deep_rows: int = DEEP_ROWS,
) -> DataFrame:
    """One record per key: every valued field from its best member, every carried field from the best layer that has it.

    Fields named in ``worths`` are axes and come from the first layer. Carried fields are no axes: they take the value
    of the policy's first member of layer 1 that has one, and where no member of the layer has one, of layer 2, and
    so on, to the last layer if need be. The policy orders members by the sum of worths, recency, then trust; members alike
    in all of these by their values. The result has ``key_name``, the fields, the carried fields and ``n_layers``, the layers
    used. Null keys form no group; an empty table gives no rows.

    Keys of at most ``deep_rows`` members get their layers in one pass, in which a task holds one key at a time. Of larger ones
    the layers are peeled one by one by distributed skylines, until no remaining member can fill a missing field. Both give
    the same records.
    """
    out, axes, order = _prepared(members, key, worths, recency, trust)
    total = sum((F.col(f"__w_{f}") for f in worths), F.lit(0))
    kept = [*worths, *carried]
    rows = out.filter(F.col("__key").isNotNull()).select("__key", *axes, *order, total.alias("__total"), *[F.col(c).alias(f"__v_{c}") for c in kept])
    values = [f"__v_{c}" for c in kept]
    policy = F.struct("__total", "__recency", *order, *values)
    best = {f: F.max_by(F.when(F.col(f"__w_{f}") > 0, F.col(f"__v_{f}")), F.struct(f"__w_{f}", "__recency", *order, *values)) for f in worths}

    large = cut(rows.groupBy("__key").count().filter(F.col("count") > deep_rows).select("__key"))
    some_large = not large.isEmpty()
    small = rows.join(large, "__key", "left_anti") if some_large else rows
    deep, found_in = {}, []
    for c in carried:
        has = F.col(f"__v_{c}").isNotNull()
        deep[c] = F.max_by(f"__v_{c}", F.when(has, F.struct(-F.col("__layer"), policy)))
        found_in.append(F.min(F.when(has, F.col("__layer") + 1)))
    layers = F.greatest(*found_in, F.lit(1)).cast("int") if found_in else F.lit(1)
    done = _with_layers(small, "__key", axes, order).groupBy("__key").agg(*[v.alias(c) for c, v in (best | deep).items()], layers.alias("n_layers"))
    if some_large:
        done = done.unionByName(_peeled(rows.join(large, "__key", "left_semi"), axes, order, policy, best, list(worths), carried, salts))
    return done.withColumnRenamed("__key", key_name)


def _peeled(rows: DataFrame, axes: list[str], trust: list[str], policy: Column, best: dict[str, Column], fields: list[str], carried: list[str], salts: int | None) -> DataFrame:
    """The records of keys with many members, one distributed skyline for each layer that is still asked for."""
    left = cut(rows)
    layer = cut(skyline(left, "__key", axes, trust, salts, ties=True))
    first = {c: F.max_by(f"__v_{c}", F.when(F.col(f"__v_{c}").isNotNull(), policy)) for c in carried}
    done = layer.groupBy("__key").agg(*[v.alias(c) for c, v in (best | first).items()]).withColumn("n_layers", F.lit(1))
    for n in count(2):
        # Keys that lack a carried field which some member outside the layers so far has.
        done = cut(done)
        lacking = F.lit(False)
        for c in carried:
            lacking = lacking | F.col(c).isNull()
        ask = done.filter(lacking).select("__key", *[F.col(c).isNull().alias(f"__no_{c}") for c in carried])
        left = left.join(layer.select("__key", *axes, *trust).distinct(), ["__key", *axes, *trust], "left_anti").join(ask, "__key")
        helps = F.lit(False)
        for c in carried:
            helps = helps | (F.col(f"__no_{c}") & F.col(f"__v_{c}").isNotNull())
        left = cut(left.withColumn("__helps", helps))
        wanted = left.filter("__helps").select("__key").distinct()
        left = left.join(wanted, "__key", "left_semi").drop("__helps", *[f"__no_{c}" for c in carried])
        if left.isEmpty():
            return done
        layer = cut(skyline(left, "__key", axes, trust, salts, ties=True))
        more = layer.groupBy("__key").agg(*[v.alias(f"__m_{c}") for c, v in first.items()], F.lit(n).alias("__more"))
        done = done.join(more, "__key", "left").select(
            "__key", *fields, *[F.coalesce(c, f"__m_{c}").alias(c) for c in carried], F.coalesce("__more", "n_layers").alias("n_layers")
        )
    raise AssertionError("unreachable")
