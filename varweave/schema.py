"""Schemas of the variant tables, row identifiers and file sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varweave.errors import ContigMismatch, TooManyFiles

MAX_FILES = 64
#: Room that a row_id keeps for the file number.
FILE_ROOM = 100

CORE = (
    "row_num long, chrom_id int, chrom string, start int, end int, kind string, length int, "
    "chrom2_id int, chrom2 string, end2 int, alt_seq string, seq_hash long"
)


def encode_row_id(vix_ix: Column, row_num: Column) -> Column:
    return (vix_ix + F.lit(FILE_ROOM) * row_num).cast("long")


def decode_row_id(row_id: Column) -> tuple[Column, Column]:
    """File number and row number."""
    return F.pmod(row_id, F.lit(FILE_ROOM)).cast("int"), F.floor(row_id / F.lit(FILE_ROOM)).cast("long")


def file_bit(vix_ix: Column) -> Column:
    """The file's bit as a BIGINT; file 63 is the sign bit, so sets are compared by their bits, never by order."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), vix_ix.cast("int"))


def with_merge_state(core: DataFrame) -> DataFrame:
    """Add row_id, row_key, vix_set, vix_count and criteria to core rows that carry vix_ix."""
    row_id = encode_row_id(F.col("vix_ix"), F.col("row_num"))
    return core.withColumns(
        {
            "row_id": row_id,
            "row_key": row_id,
            "vix_set": file_bit(F.col("vix_ix")),
            "vix_count": F.lit(1),
            "criteria": F.lit(None).cast("string"),
        }
    )


def union_files(files: list[DataFrame]) -> DataFrame:
    """Core tables of the files in order, as one table with its merge state; at most 64 files."""
    if len(files) > MAX_FILES:
        raise TooManyFiles(str(len(files)))
    out: DataFrame | None = None
    for i, df in enumerate(files):
        one = df.withColumn("vix_ix", F.lit(i))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise TooManyFiles("no file was given")
    return with_merge_state(out)


def contig_check(contigs: list[list[str]]) -> list[str]:
    """The common contig list; every file must declare the same contigs in the same order."""
    for i, names in enumerate(contigs[1:], 1):
        if names != contigs[0]:
            raise ContigMismatch(f"file {i}")
    return contigs[0] if contigs else []
