"""Column expressions of the variant domain."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters of a sequence, and the digits of base 62.
SEQUENCE = r"^[ACGTNacgtn*]*\z"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def prefix_cols(df: DataFrame, prefix: str) -> DataFrame:
    """Every column renamed to prefix_name, in one projection."""
    return df.select([F.col(f"`{c}`").alias(f"{prefix}_{c}") for c in df.columns])


def ifelse(cond: Column, yes: Column, no: Column) -> Column:
    """``yes`` where the condition holds, ``no`` where it does not, null where it is null."""
    return F.when(cond, yes).when(~cond, no)


def pmin(a: Column, b: Column) -> Column:
    """The smaller of two; null if either is."""
    return ifelse(a <= b, a, b)


def pmax(a: Column, b: Column) -> Column:
    """The greater of two; null if either is."""
    return ifelse(a > b, a, b)


def is_seq(text: Column) -> Column:
    return text.rlike(SEQUENCE)


def append_criterion(criteria: Column, new: Column) -> Column:
    """``criteria,new``, or only ``new`` while there are none."""
    return F.concat_ws(",", F.when(criteria != "", criteria), new)


def length_agrees(a: Column, b: Column, ratio: float, window: int) -> Column:
    """Whether absolute lengths differ by a factor of at least ``ratio`` or by at most ``window``.

    One missing length counts as the other's (so it agrees); two missing ones do not agree.
    """
    x, y = F.abs(a.cast("long")), F.abs(b.cast("long"))
    small, large = F.least(x, y), F.greatest(x, y)
    by_ratio = F.try_divide(small.cast("double"), large.cast("double")) >= F.lit(ratio)
    return F.coalesce(by_ratio, F.lit(False)) | F.coalesce(large - small <= F.lit(window), F.lit(False))


def infer_kind(svtype: Column, ref: Column, first_alt: Column, n_alts: Column) -> Column:
    """SVTYPE up to its first colon, else INS, DEL or BND as the alleles show; null if they do not."""
    base = r"^[ACGTNacgtn*]\z"
    several = r"^[ACGTNacgtn*]{2,}\z"
    seen = (
        F.when(n_alts != 1, F.lit(None))
        .when(ref.rlike(base) & first_alt.rlike(several), "INS")
        .when(ref.rlike(several) & first_alt.rlike(base), "DEL")
        .when(first_alt.rlike(r"^[\[\]]|[\[\]]\z"), "BND")
    )
    return F.coalesce(F.split_part(svtype, F.lit(":"), F.lit(1)), seen)


def repaired_end(kind: Column, start: Column, end: Column, length: Column) -> Column:
    """A deletion's end is its start plus its length, whatever the file says."""
    by_length = start + F.abs(length)
    return F.when((kind == "DEL") & length.isNotNull() & (by_length != end), by_length).otherwise(end)


#: The four orientations of a breakend allele, as (pattern, side, side of the mate).
BREAKENDS = [
    (r"[ACGTNacgtn]\[([^:]+):([0-9]+)\[", "After", "After"),
    (r"[ACGTNacgtn]\]([^:]+):([0-9]+)\]", "After", "Before"),
    (r"\]([^:]+):([0-9]+)\][ACGTNacgtn]", "Before", "Before"),
    (r"\[([^:]+):([0-9]+)\[[ACGTNacgtn]", "Before", "After"),
]


def parse_breakend(alt: Column) -> Column:
    """Struct (chrom2, end2, side, side2) of a breakend allele, null for any other text."""
    bracketed = alt.rlike(r"^[\[\]]|[\[\]]\z")
    out = F.lit(None)
    for pattern, side, side2 in reversed(BREAKENDS):
        parsed = F.struct(
            F.regexp_extract(alt, pattern, 1).alias("chrom2"),
            F.regexp_extract(alt, pattern, 2).try_cast("long").alias("end2"),
            F.lit(side).alias("side"),
            F.lit(side2).alias("side2"),
        )
        out = F.when(bracketed & alt.rlike(pattern), parsed).otherwise(out)
    return out


def flip_breakend(chrom: Column, end: Column, side: Column, chrom2: Column, end2: Column, side2: Column) -> Column:
    """The same adjacency seen from its mate."""
    return F.struct(chrom2.alias("chrom"), end2.alias("end"), side2.alias("side"), chrom.alias("chrom2"), end.alias("end2"), side.alias("side2"))


def format_breakend(side: Column, side2: Column, chrom2: Column, end2: Column, base: Column) -> Column:
    """The allele text of a breakend whose reference base is ``base``."""
    mark = F.when(side2 == "After", "[").otherwise("]")
    mate = F.concat(mark, chrom2, F.lit(":"), end2.cast("string"), mark)
    return F.when(side == "Before", F.concat(mate, base)).otherwise(F.concat(base, mate))


def _digits62(n: int) -> str:
    out = []
    while True:
        n, r = divmod(n, 62)
        out.append(BASE62[r])
        if not n:
            return "".join(reversed(out))


def base62_text(blob: bytes) -> str:
    """Each 16 bytes as a number in base 62, joined without padding."""
    return "".join(_digits62(int.from_bytes(blob[i : i + 16], "big")) for i in range(0, len(blob), 16))


@F.pandas_udf(T.StringType())
def base62(blobs: pd.Series) -> pd.Series:
    """Base 62 of a binary column; a number of 128 bits is beyond any built-in type."""
    return blobs.map(lambda b: None if b is None else base62_text(bytes(b)))


def digest56(text: str) -> int:
    """56 bits of a sequence's BLAKE2b digest, always positive."""
    return int.from_bytes(hashlib.blake2b(text.encode()).digest()[:7], "big")


@F.pandas_udf(T.LongType())
def seq_digest(texts: pd.Series) -> pd.Series:
    """``digest56`` of a text column; null stays null."""
    return texts.map(lambda t: None if t is None else digest56(t)).astype("Int64")


def hex_hash(value: Column) -> Column:
    return F.lower(F.hex(value))


#: Long names of the variant types.
LONG_KINDS = {"INSERTION": "INS", "DELETION": "DEL", "DUPLICATION": "DUP", "INVERSION": "INV", "BREAKEND": "BND"}


def standard_kind(kind: Column) -> Column:
    """A type in capitals, without blanks, angle brackets or subtype, long names shortened."""
    word = F.upper(F.split_part(F.regexp_replace(kind, r"[<>\s]", ""), F.lit(":"), F.lit(1)))
    out = word
    for name, short in LONG_KINDS.items():
        out = F.when(word == name, short).otherwise(out)
    return out
