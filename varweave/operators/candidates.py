"""Candidate pairs of records to merge: exact, same-locus and windowed self-joins.

Every join works on two prefixed copies of the table and gives lhs_row_key, lhs_vix_set, lhs_vix_count and the same of
rhs. Records that every file has joined already (vix_count = n_files) are left out before the join. A null in a join
column matches nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varweave.functions.exprs import length_agrees, prefix_cols
from varweave.operators.ranges import band_join
from varweave.options import MergeOptions

PAIR = [f"{s}_{c}" for s in ("lhs", "rhs") for c in ("row_key", "vix_set", "vix_count")]
NEEDED = ["row_id", "row_key", "vix_ix", "vix_set", "vix_count", "chrom_id", "start", "end", "kind", "length", "chrom2_id", "end2", "seq_hash"]


def open_groups(table: DataFrame, n_files: int, kind: Column) -> DataFrame:
    """Records of the kind whose group some file has not joined yet."""
    return table.filter(kind & (F.col("vix_count") < n_files)).select(*NEEDED)


def _both(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return prefix_cols(df, "lhs"), prefix_cols(df, "rhs")


def _disjoint() -> Column:
    return (F.col("lhs_row_id") < F.col("rhs_row_id")) & (F.col("lhs_vix_set").bitwiseAND(F.col("rhs_vix_set")) == 0)


def _equal(*names: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"lhs_{n}") == F.col(f"rhs_{n}") for n in names])


def exact_indel_pairs(table: DataFrame, n_files: int) -> DataFrame:
    """Same contig, start, end, kind and length, and for insertions the same sequence."""
    lhs, rhs = _both(open_groups(table, n_files, F.col("kind") != "BND"))
    same_seq = (F.col("lhs_kind") != "INS") | (F.col("lhs_seq_hash") == F.col("rhs_seq_hash"))
    return lhs.join(rhs, _equal("chrom_id", "start", "end", "kind", "length") & _disjoint() & same_seq).select(*PAIR)


def locus_ins_pairs(table: DataFrame, n_files: int, options: MergeOptions) -> DataFrame:
    """Insertions at one place whose lengths agree; a missing length agrees with any given one."""
    lhs, rhs = _both(open_groups(table, n_files, F.col("kind") == "INS"))
    lengths = length_agrees(F.col("lhs_length"), F.col("rhs_length"), options.length_ratio, options.length_window)
    return lhs.join(rhs, _equal("chrom_id", "start", "end", "kind") & _disjoint() & lengths).select(*PAIR)


def exact_bnd_pairs(table: DataFrame, n_files: int) -> DataFrame:
    """Breakends with both places equal."""
    lhs, rhs = _both(open_groups(table, n_files, F.col("kind") == "BND"))
    return lhs.join(rhs, _equal("chrom_id", "start", "end", "kind", "chrom2_id", "end2") & _disjoint()).select(*PAIR)


def _bnd_window(table: DataFrame, n_files: int, window: int, window2: int) -> DataFrame:
    lhs, rhs = _both(open_groups(table, n_files, F.col("kind") == "BND"))
    apart = (
        _disjoint()
        & (F.col("lhs_row_key") != F.col("rhs_row_key"))
        & (F.abs(F.col("lhs_end2").cast("long") - F.col("rhs_end2")) < window2)
    )
    equi = [("lhs_chrom_id", "rhs_chrom_id"), ("lhs_chrom2_id", "rhs_chrom2_id")]
    return band_join(lhs, rhs, equi, "lhs_end", "rhs_end", window - 1, apart, "lhs_row_id").select(*PAIR)


def bnd_here_there_pairs(table: DataFrame, n_files: int, options: MergeOptions) -> DataFrame:
    """Breakends whose near ends are closer than the position window and far ends closer than the wider one."""
    return _bnd_window(table, n_files, options.position_window, options.end2_window)


def bnd_there_here_pairs(table: DataFrame, n_files: int, options: MergeOptions) -> DataFrame:
    """As ``bnd_here_there_pairs`` with the two windows exchanged."""
    return _bnd_window(table, n_files, options.end2_window, options.position_window)


def near_pairs(table: DataFrame, n_files: int, options: MergeOptions) -> DataFrame:
    """Records of one kind whose starts and ends are within the window and whose lengths agree, a missing one being 0.

    Only the two rows' own files must differ; whether their groups share a file is left to the merge.
    """
    lhs, rhs = _both(open_groups(table, n_files, F.col("kind") != "BND"))
    w = options.position_window
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    apart = (
        (F.col("lhs_row_id") < F.col("rhs_row_id"))
        & (F.col("lhs_row_key") != F.col("rhs_row_key"))
        & (F.col("lhs_vix_ix") != F.col("rhs_vix_ix"))
        & (F.abs(F.col("lhs_end").cast("long") - F.col("rhs_end")) <= w)
        & length_agrees(zero("lhs_length"), zero("rhs_length"), options.length_ratio, options.length_window)
    )
    equi = [("lhs_kind", "rhs_kind"), ("lhs_chrom_id", "rhs_chrom_id")]
    return band_join(lhs, rhs, equi, "lhs_start", "rhs_start", w, apart, "lhs_row_id").select(*PAIR)
