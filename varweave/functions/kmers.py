"""K-mers as 2-bit codes in a BIGINT (k at most 32, where the first base takes the sign bit): forward, reverse complement, positions, counts and bit tricks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_K = 32
#: A 0, C 1, G 2, T and U 3, in either case.
CODES = np.full(256, 255, np.uint8)
for _base, _code in zip("ACGTUacgtu", [0, 1, 2, 3, 3, 0, 1, 2, 3, 3]):
    CODES[ord(_base)] = _code


def make(bases: str) -> int | None:
    """The code of one k-mer, null for another base or more than 32 of them."""
    codes = CODES[np.frombuffer(bases.encode(), np.uint8)].tolist() if bases else []
    if len(codes) > MAX_K or 255 in codes:
        return None
    out = 0
    for c in codes:
        out = out << 2 | c
    return out - (1 << 64) if out >> 63 else out


def render(k: int, code: int) -> str:
    return "".join("ACGT"[code >> 2 * (k - 1 - i) & 3] for i in range(k))


def rendered(k: int, code: Column) -> Column:
    """The bases of a k-mer column."""
    at = lambda i: F.shiftrightunsigned(code, 2 * (k - 1 - i)).bitwiseAND(F.lit(3).cast("long")).cast("int")
    return F.concat(*[F.substring(F.lit("ACGT"), at(i) + 1, F.lit(1)) for i in range(k)])


def windows(data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start positions, forward and reverse-complement codes of all windows of k valid bases."""
    codes = CODES[data]
    m = len(codes) - k + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    bad = np.r_[0, np.cumsum(codes == 255)]
    at = np.flatnonzero(bad[k:] == bad[:-k])
    c = codes.astype(np.int64)
    fwd, rev = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for j in range(k):
        one = c[at + j]
        fwd = fwd << 2 | one
        rev |= (3 - one) << 2 * j
    return at, fwd, rev


def forward_codes(data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and forward codes of all windows of k valid bases, codes of 2, 4, 8, ... bases put together."""
    codes = CODES[data]
    m = len(codes) - k + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bad = np.r_[0, np.cumsum(codes == 255)]
    at = np.flatnonzero(bad[k:] == bad[:-k])
    have, size, out, width = (codes & 3).astype(np.int64), 1, np.zeros(len(codes), np.int64), 0
    while True:
        if k & size:
            rest = have[width:]
            out, width = out[: len(rest)] << 2 * size | rest, width + size
        if 2 * size > k:
            return at, out[at]
        have, size = have[:-size] << 2 * size | have[size:], 2 * size


def reverse_complements(codes: np.ndarray, k: int) -> np.ndarray:
    """The reverse complements of k-mers."""
    x = ~codes.astype(np.int64).view(np.uint64)
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        s, low = np.uint64(shift), np.uint64(mask)
        x = x >> s & low | (x & low) << s
    return (x.byteswap() >> np.uint64(64 - 2 * k)).view(np.int64)


def _check(k: int) -> None:
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be from 1 to {MAX_K}")


def kmer_lists(df: DataFrame, seq: str, k: int, reverse: bool = False) -> DataFrame:
    """The table with ``kmers``: the codes of all windows of valid bases in order; null for a null sequence."""
    _check(k)
    names = df.columns
    at_seq = names.index(seq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at_seq).to_pylist()
            lists = [None if t is None else windows(np.frombuffer(t.encode(), np.uint8), k)[1 + reverse] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], names=[*names, "kmers"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("kmers", T.ArrayType(T.LongType()))]))


def kmer_counts(df: DataFrame, name: str, seq: str, k: int, strands: str = "+", unique_names: bool = False) -> DataFrame:
    """(name, strand, kmer, count): how often each k-mer occurs on the asked strands ('+', '-' or '+-').

    Counted per sequence where it is read, then over rows of one name; ``unique_names`` says that no name has two rows, which
    saves that shuffle. Null names form a group; null and short sequences have no k-mers.
    """
    _check(k)
    kind = dict(df.dtypes)[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            owner: list[np.ndarray] = []
            marks: list[str] = []
            codes, counts = [], []
            for i, t in enumerate(texts):
                if t is None:
                    continue
                found = windows(np.frombuffer(t.encode(), np.uint8), k)
                for s in strands:
                    c, n = np.unique(found[1 if s == "+" else 2], return_counts=True)
                    if len(c):
                        owner.append(np.full(len(c), i))
                        marks += [s] * len(c)
                        codes.append(c)
                        counts.append(n)
            if codes:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.concatenate(owner))), pa.array(marks), pa.array(np.concatenate(codes)), pa.array(np.concatenate(counts))],
                    names=["name", "strand", "kmer", "count"],
                )

    some = df.select(F.col(name).alias("name"), F.col(seq).alias("seq")).mapInArrow(run, f"name {kind}, strand string, kmer long, count long")
    return some if unique_names else some.groupBy("name", "strand", "kmer").agg(F.sum("count").alias("count"))


def distinct_kmers(counts: DataFrame, name: str = "name") -> DataFrame:
    """(name, n_kmers): how many different k-mers a name has over the strands counted."""
    return counts.select(name, "kmer").distinct().groupBy(name).agg(F.count(F.lit(1)).alias("n_kmers"))


def kmer_positions(df: DataFrame, name: str, seq: str, k: int) -> DataFrame:
    """(name, kmer, rc_kmer, last): every window on both strands with the zero-based position of its last base."""
    _check(k)
    kind = dict(df.dtypes)[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t is not None:
                    at, fwd, rev = windows(np.frombuffer(t.encode(), np.uint8), k)
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(np.full(len(at), i))), pa.array(fwd), pa.array(rev), pa.array((at + k - 1).astype(np.int32))],
                            names=["name", "kmer", "rc_kmer", "last"],
                        )

    return df.select(F.col(name).alias("name"), F.col(seq).alias("seq")).mapInArrow(run, f"name {kind}, kmer long, rc_kmer long, last int")


def frequency_vectors(df: DataFrame, name: str, seq: str, k: int, both: bool = False) -> DataFrame:
    """(name, freqs): the dense vector of 4^k counts, over one or both strands, of every name."""
    counts = kmer_counts(df, name, seq, k, "+-" if both else "+").groupBy("name", "kmer").agg(F.sum("count").alias("count"))
    sparse = counts.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("kmer", "count"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(4**k - 1).cast("long")), lambda x: F.coalesce(F.try_element_at("m", x), F.lit(0).cast("long")))
    names = df.select(F.col(name).alias("name")).distinct()
    zero = F.array_repeat(F.lit(0).cast("long"), 4**k)
    return names.join(sparse, "name", "left").select("name", F.coalesce(F.when(F.col("m").isNotNull(), dense), zero).alias("freqs"))


def hamming(x: Column, y: Column) -> Column:
    """How many bases differ between two k-mers."""
    z = x.bitwiseXOR(y)
    return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def reverse_complement(k: int, code: Column) -> Column:
    """The reverse complement of a k-mer: bases complemented, then exchanged pairwise from the ends."""
    flipped = code.bitwiseXOR(F.lit(4**k - 1 if k < 32 else -1).cast("long"))
    return reverse(k, flipped)


def reverse(k: int, code: Column) -> Column:
    """The k-mer read backwards."""
    out = F.lit(0).cast("long")
    for i in range(k):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(code, 2 * i).bitwiseAND(F.lit(3).cast("long")), 2 * (k - 1 - i)))
    return out
