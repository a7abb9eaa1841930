"""Near-duplicate records by prefix filters under several global token orders.

A record is a set of tokens on three axes: the cells, one window wide, around its lower end, around its upper end, and
around its length. ``n`` consecutive cells make the tokens of an axis, so two records within the window share at least
n - 1 of them, and under any global order of the tokens they share one of their first n - (n - 1) + 1 = 2. The order is by
frequency in the table, rare tokens first, then by a hash. A shift by one cell takes away an outermost cell only, so the second
token is needed only where the first is outermost. Three orders, each with one axis first, give three prefix filters;
a pair is a candidate only if it passes all of them, so they are intersected in one key: group and one prefix token of
each order. Exact verification follows, by a sweep over the candidates of a key sorted by their lower ends.

Every matching pair comes out under exactly one key, by this rule. A record carries, per axis, whether the key's token is
its first (0), or its second behind a first that is its lowest (1) or highest (2) cell. Two records whose marks agree and are
not 0 have the same first token, under which they meet as well; in every other case the key's token is the first they
share. So pairs with an equal mark other than 0 are passed over.

Frequencies and sizes of keys are counted in a fixed number of hash buckets, from the records whose id falls into one of
SAMPLE parts of a hash; they steer the order and the splitting, never the result. A key of many records gets a second set of
tokens, from fewer cells, and a key that is still large is dealt into blocks: every pair of blocks is a key of its own.
In such a place a good part of all pairs match, so what is repeated stays small against what comes out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varweave.session import cut

WINDOW = 25
RATIO = (9, 10)
#: Cells that make the tokens of an axis (lower end, upper end, length); in places with many records fewer.
CELLS = (32, 32, 16)
FINE_CELLS = (4, 4, 4)
#: Records from which a key is split by finer tokens, and then dealt into blocks of about so many.
SPLIT_ROWS = 8_000
#: One in so many records is counted for the order of the tokens and the sizes of the keys.
SAMPLE = 16
#: Counters of tokens and keys: 2**BUCKETS, whatever the size of the table.
BUCKETS = 17
#: Rows that a task sweeps at once, if no key holds more, and pairs it looks at at once.
SWEEP_ROWS, SWEEP_PAIRS = 200_000, 2_000_000

#: The spellings of the four types that count, after trimming, dropping angle brackets and any subtype.
TYPE_NAMES = {
    "ins": "INS", "insertion": "INS",
    "del": "DEL", "deletion": "DEL",
    "dup": "DUP", "duplication": "DUP",
    "inv": "INV", "inversion": "INV",
}

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: What tells the axes apart in the hashes of tokens.
_AXIS = np.arange(1, 4, dtype=np.uint64) * _MIX2
#: The low bit of every mark in a row's word of marks: three axes, three axes of finer cells, the block.
_MARKS = 0x1555


def sv_type(kind: Column) -> Column:
    """INS, DEL, DUP or INV for any spelling of them, else null."""
    word = F.lower(F.trim(F.split_part(F.regexp_replace(kind, "[<>\\s]", ""), F.lit(":"), F.lit(1))))
    return F.coalesce(*[F.when(word == k, F.lit(v)) for k, v in TYPE_NAMES.items()])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS)).astype(np.int64)


def length_cells(length: np.ndarray, window: int, ratio: tuple[int, int]) -> np.ndarray:
    """The cell of a length on an axis where lengths that fit are at most one cell apart.

    The axis grows by the smaller of 1/window and 1/(x ln(1/ratio)), under which a step of the window, or one by the ratio,
    is at most 1; a hair is taken off for rounding.
    """
    x = length.astype(np.float64)
    c = math.log(ratio[1] / ratio[0])
    turn = window / c if c else math.inf
    along = x / window if window else np.log(np.maximum(x, 1)) / c if c else x
    if window and math.isfinite(turn):
        along = np.where(x <= turn, along, turn / window + np.log(np.maximum(x, 1) / turn) / c)
    return np.floor(along * (1 - 1e-6)).astype(np.int64)


def prefixes(place: np.ndarray, axis: int, cell: np.ndarray, n: int, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first token of each record on one axis, its second, and the mark of the second (0 if it is not needed)."""
    cells = cell[:, None] + np.arange(n)
    h = _mixed(place[:, None] + cells.astype(np.uint64) * _STEP + _AXIS[axis])
    order = frequency[_bucket(h)].astype(np.uint64) << np.uint64(40) | h & np.uint64((1 << 40) - 1)
    first = order.argmin(axis=1)
    rows = np.arange(len(cell))
    order[rows, first] = np.uint64((1 << 64) - 1)
    second = order.argmin(axis=1)
    mark = np.where(first == 0, 1, np.where(first == n - 1, 2, 0))
    return cells[rows, first], cells[rows, second], mark


def _keyed(key: np.ndarray, place: np.ndarray, cells: list[np.ndarray], n: tuple[int, ...], frequency: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, marks) for every combination of the prefix tokens of the axes, on top of the given keys."""
    row, marks = np.arange(len(key)), np.zeros(len(key), np.int32)
    for axis, cell in enumerate(cells):
        one, two, mark = prefixes(place, axis, cell, n[axis], frequency)
        times = 1 + (mark[row] > 0)
        again = np.repeat(np.arange(len(row)), times)
        extra = np.r_[False, again[1:] == again[:-1]]
        row, key, marks = row[again], key[again], marks[again]
        token = np.where(extra, two[row], one[row])
        key = _mixed(key * _STEP + token.astype(np.uint64) * _MIX1 + np.uint64(axis + 11))
        marks |= np.where(extra, mark[row], 0).astype(np.int32) << (shift + 2 * axis)
    return row, key, marks


class Plan:
    """What every task needs to key its records: counters of a fixed size."""

    def __init__(self, window: int, ratio: tuple[int, int], cells: tuple[int, ...], fine: tuple[int, ...]):
        self.window, self.ratio, self.cells, self.fine = window, ratio, cells, fine
        self.frequency = np.zeros(1 << BUCKETS, np.int32)
        self.hot = np.zeros(1 << BUCKETS, bool)
        self.blocks = np.ones(1 << BUCKETS, np.int32)

    def axes(self, lo: np.ndarray, hi: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        return [lo // (self.window + 1), hi // (self.window + 1), length_cells(length, self.window, self.ratio)]

    def token_buckets(self, place: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: np.ndarray) -> np.ndarray:
        hashes = [_mixed(place + c.astype(np.uint64) * _STEP + _AXIS[i]) for i, c in enumerate(self.axes(lo, hi, length))]
        return _bucket(np.concatenate(hashes))

    def coarse(self, place: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _keyed(place, place, self.axes(lo, hi, length), self.cells, self.frequency, 0)

    def split(self, at: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``coarse``, the rows of hot keys keyed again by their finer tokens; ``at`` tells what coarse gave."""
        row, key, marks = at
        warm = self.hot[_bucket(key)]
        w = row[warm]
        sub, fine_key, fine_marks = _keyed(key[warm], place[w], self.axes(lo[w], hi[w], length[w]), self.fine, self.frequency, 6)
        return np.r_[row[~warm], w[sub]], np.r_[key[~warm], fine_key], np.r_[marks[~warm], marks[warm][sub] | fine_marks]

    def dealt(self, at: tuple[np.ndarray, np.ndarray, np.ndarray], row_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows of keys that are still large, once for each pair of blocks that theirs is in."""
        row, key, marks = at
        n = self.blocks[_bucket(key)]
        if (n == 1).all():
            return at
        again = np.repeat(np.arange(len(row)), n)
        other = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
        n = n[again]
        mine = (_mixed(row_id[row[again]].astype(np.uint64) + _STEP) % n.astype(np.uint64)).astype(np.int64)
        small, large = np.minimum(mine, other), np.maximum(mine, other)
        side = np.where(small == large, 0, np.where(mine == small, 1, 2))
        pair = _mixed(key[again] + (small * (1 << 32) + large + 1).astype(np.uint64) * _STEP)
        return row[again], np.where(n > 1, pair, key[again]), marks[again] | np.where(n > 1, side, 0).astype(np.int32) << 12


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _counted(df: DataFrame, buckets) -> DataFrame:
    """(bucket, n): how many of what ``buckets`` gives for the columns of a batch fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKETS, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(buckets(*_columns(batch)), minlength=1 << BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return df.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _table(counts: DataFrame, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts; at most 2**BUCKETS rows come to the driver."""
    t = counts.filter(F.col("n") > least).toArrow()
    return t.column("bucket").to_numpy(), t.column("n").to_numpy()


_KEYED = "k long, row_id long, vix int, place long, lo long, hi long, len long, marks int"


def _pairs_of(c: dict[str, np.ndarray], window: int, ratio: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The matching pairs among rows sorted by key, lower end and id, in parts of bounded size."""
    names = list(c)
    same = np.ones(max(len(c["k"]) - 1, 0), bool)
    for n in names:
        same &= c[n][1:] == c[n][:-1]
    # Records delivered twice lie side by side.
    keep = np.r_[True, ~same]
    k, row_id, vix, place, lo, hi, length, marks = (c[n][keep] for n in names)
    group = np.cumsum(np.r_[False, k[1:] != k[:-1]])
    span = int(lo.max() - lo.min()) + window + 1
    place_in_order = group * span + (lo - lo.min())
    ahead = np.searchsorted(place_in_order, place_in_order + window, "right") - np.arange(len(k)) - 1
    edges = np.flatnonzero(np.diff(np.r_[-1, np.cumsum(ahead) // SWEEP_PAIRS]))
    for a, b in zip(edges, [*edges[1:], len(k)]):
        n = ahead[a:b]
        i = np.repeat(np.arange(a, b), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        ok = (np.abs(hi[i] - hi[j]) <= window) & (vix[i] != vix[j]) & (row_id[i] != row_id[j]) & (place[i] == place[j])
        i, j = i[ok], j[ok]
        short, long = np.minimum(length[i], length[j]), np.maximum(length[i], length[j])
        ok = (long - short <= window) | (short * ratio[1] >= long * ratio[0])
        x, y = marks[i], marks[j]
        differ = x ^ y
        ok &= ((x | x >> 1) & ~(differ | differ >> 1) & _MARKS) == 0
        i, j = i[ok], j[ok]
        yield np.minimum(row_id[i], row_id[j]), np.maximum(row_id[i], row_id[j])


def near_duplicate_pairs(
    records: DataFrame,
    group: Column,
    window: int = WINDOW,
    ratio: tuple[int, int] = RATIO,
    cells: tuple[int, int, int] = CELLS,
    fine_cells: tuple[int, int, int] = FINE_CELLS,
    split_rows: int = SPLIT_ROWS,
    sample: int = SAMPLE,
) -> DataFrame:
    """(lhs_row_id, rhs_row_id) of all pairs of records that describe one event, the smaller id first, each once.

    ``records`` has row_id, vix_ix, chrom_id, start, end and length; ``group`` is the type that must agree. Two records
    match if chrom_id and group agree, vix_ix differ, the lower and the upper ends are at most ``window`` apart, and
    the lengths differ by at most ``window`` or the smaller is at least ``ratio`` of the larger. Start and end may be
    in either order, lengths lose their sign, and a null length stands for the distance of the ends. A null in
    row_id, vix_ix, chrom_id, start, end or group keeps a record out. Records delivered twice count once; deliveries of
    one row_id that differ in a compared column are compared each on its own. Further columns are ignored. An empty table
    gives no pairs. chrom_id and group are compared by one 64-bit hash of both.

    The rows are shuffled once, by key. ``sample`` of 1 counts every record.
    """
    lo, hi = F.least("start", "end").cast("long"), F.greatest("start", "end").cast("long")
    known = group.isNotNull()
    for c in ["row_id", "vix_ix", "chrom_id", "start", "end"]:
        known = known & F.col(c).isNotNull()
    base = records.filter(known).select(
        F.col("row_id").cast("long").alias("row_id"),
        F.col("vix_ix").cast("int").alias("vix"),
        F.xxhash64(F.col("chrom_id").cast("long"), group).alias("place"),
        lo.alias("lo"),
        hi.alias("hi"),
        F.coalesce(F.abs(F.col("length").cast("long")), hi - lo).alias("len"),
    )
    sc = records.sparkSession.sparkContext
    plan = Plan(window, ratio, cells, fine_cells)
    some = cut(base.filter(F.pmod(F.xxhash64("row_id"), F.lit(sample)) == 0).drop("vix"))
    unsigned = lambda place: place.view(np.uint64)

    at, n = _table(_counted(some, lambda row_id, place, lo, hi, length: plan.token_buckets(unsigned(place), lo, hi, length)))
    plan.frequency[at] = np.minimum(n, (1 << 24) - 1)
    # A key counts as large beyond split_rows; with very many records, where a bucket holds far more than its share,
    # which at most an eighth of the buckets can.
    limit = max(split_rows, 8 * sample * int(n.sum()) // 3 >> BUCKETS) // sample
    given = sc.broadcast(plan)

    def coarse_buckets(row_id, place, lo, hi, length):
        return _bucket(given.value.coarse(unsigned(place), lo, hi, length)[1])

    at, n = _table(_counted(some, coarse_buckets), limit)
    if len(at):
        plan.hot[at] = True
        given = sc.broadcast(plan)

        def fine_buckets(row_id, place, lo, hi, length):
            p, place = given.value, unsigned(place)
            return _bucket(p.split(p.coarse(place, lo, hi, length), place, lo, hi, length)[1])

        at, n = _table(_counted(some, fine_buckets), limit)
        plan.blocks[at] = -(-n // max(limit, 1))
    final = sc.broadcast(plan)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row_id, vix, place, lo, hi, length = _columns(batch)
            p, wide = final.value, place.view(np.uint64)
            row, key, marks = p.dealt(p.split(p.coarse(wide, lo, hi, length), wide, lo, hi, length), row_id)
            for part in range(0, len(row), 1 << 20):
                r = row[part : part + (1 << 20)]
                cols = [key[part : part + len(r)].view(np.int64), row_id[r], vix[r], place[r], lo[r], hi[r], length[r], marks[part : part + len(r)]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["k", "row_id", "vix", "place", "lo", "hi", "len", "marks"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for lhs, rhs in _pairs_of(c, window, ratio):
                yield pa.RecordBatch.from_arrays([pa.array(lhs), pa.array(rhs)], names=["lhs_row_id", "rhs_row_id"])

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < SWEEP_ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column("k").to_numpy()
            whole = int(np.argmax(key == key[-1]))
            if whole:
                yield from found({n: table.column(n).to_numpy()[:whole] for n in table.column_names})
            held, rows = table.slice(whole).to_batches(), len(key) - whole
        if rows:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from found({n: table.column(n).to_numpy() for n in table.column_names})

    keyed = base.mapInArrow(emit, _KEYED)
    return keyed.repartition("k").sortWithinPartitions("k", "lo", "row_id", "hi", "len").mapInArrow(sweep, "lhs_row_id long, rhs_row_id long")
