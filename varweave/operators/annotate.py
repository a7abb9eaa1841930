"""What is said of merged groups: breakend pairing, primary rows, identifiers, per-group summaries and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varweave.functions.exprs import base62, hex_hash

PRIMARY = ["start", "end", "end2", "length"]
#: The filter of breakends without a mate, and its description.
UNPAIRED = ("UNPAIRED_BND", "No mate of this breakend in its file")


def pair_breakends(table: DataFrame) -> DataFrame:
    """Add paired_bnd: whether a breakend's mate - both places exchanged - is in the same file; null for other kinds."""
    bnd = table.filter(F.col("kind") == "BND")
    text = lambda *names: F.concat_ws("_", *[F.col(n).cast("string") for n in names])
    mates = bnd.select(F.col("vix_ix").alias("__vix"), text("chrom2", "end2", "chrom", "end").alias("__place")).distinct().withColumn("__mate", F.lit(True))
    place = F.when(F.col("kind") == "BND", text("chrom", "end", "chrom2", "end2"))
    met = table.withColumn("__here", place).join(mates, (F.col("vix_ix") == F.col("__vix")) & (F.col("__here") == F.col("__place")), "left")
    return met.select(*table.columns, F.when(F.col("kind") == "BND", F.col("__mate").isNotNull()).alias("paired_bnd"))


def primary_rows(table: DataFrame) -> DataFrame:
    """(row_key, row_id) of the leftmost file's record of each group."""
    return table.groupBy("row_key").agg(F.min_by("row_id", F.struct("vix_ix", "row_id")).alias("row_id"))


def add_primary_columns(table: DataFrame) -> DataFrame:
    """Add primary_start, primary_end, primary_end2 and primary_length, those of the group's leftmost record."""
    first = table.groupBy("row_key").agg(F.min_by(F.struct(*PRIMARY), F.struct("vix_ix", "row_id")).alias("p"))
    first = first.select(F.col("row_key").alias("__key"), *[F.col(f"p.{c}").alias(f"primary_{c}") for c in PRIMARY])
    return table.join(first, table["row_key"] == first["__key"], "left").drop("__key")


def report_table(table: DataFrame) -> DataFrame:
    """Offsets and length agreement of every record against its group's primary record, alt_seq last.

    Needs the primary columns, and drops them.
    """
    offset = lambda c: F.abs(F.col(c) - F.col(f"primary_{c}"))
    a, b = F.abs(F.col("length")), F.abs(F.col("primary_length"))
    ratio = F.try_divide(F.least(a, b).cast("double"), F.greatest(a, b).cast("double"))
    out = table.withColumns({"start_offset": offset("start"), "end_offset": offset("end"), "end2_offset": offset("end2")})
    out = out.withColumns(
        {
            "total_offset": F.when(F.col("kind") == "INS", F.col("start_offset"))
            .when(F.col("kind") == "BND", F.col("start_offset") + F.col("end2_offset"))
            .otherwise(F.col("start_offset") + F.col("end_offset")),
            "length_ratio": F.round(ratio * 100) / 100,
            "length_difference": F.greatest(a, b) - F.least(a, b),
        }
    ).drop(*[f"primary_{c}" for c in PRIMARY])
    return out.select(*[c for c in out.columns if c != "alt_seq"], "alt_seq") if "alt_seq" in out.columns else out


def variant_text(seq_hash: str = "seq_hash") -> Column:
    """The text that identifies a variant, missing parts left out."""
    parts = ["kind", "chrom", "start", "end", "length", "chrom2", "end2"]
    return F.concat_ws("_", *[F.col(p).cast("string") for p in parts], hex_hash(F.col(seq_hash)))


def short_hash(text: Column) -> Column:
    return F.left(base62(F.unhex(F.sha2(text, 256))), F.lit(7))


def occurrences(by: list[str], order: str) -> Column:
    """Which of the rows with equal ``by`` each row is, from 0, in the order of ``order``."""
    return (F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1).cast("int")


def variant_reps(table: DataFrame) -> DataFrame:
    """(row_key, kind, vid, vid_hash, vid_rep) of each group: its primary record's text, and which of equal ones it is."""
    first = table.groupBy("row_key").agg(F.min_by(F.struct("kind", variant_text().alias("vid")), F.struct("vix_ix", "row_id")).alias("p"))
    hashed = first.select("row_key", "p.kind", "p.vid", short_hash(F.col("p.vid")).alias("vid_hash"))
    return hashed.withColumn("vid_rep", occurrences(["vid_hash"], "row_key"))


def add_variant_ids(table: DataFrame, prefix: str = "VW") -> DataFrame:
    """Add variant_id: prefix, kind, and a short hash of the group's text and its number among equal texts."""
    reps = variant_reps(table)
    ids = reps.select(
        F.col("row_key").alias("__key"),
        F.concat_ws("_", F.lit(prefix), "kind", short_hash(F.concat_ws("_", "vid", F.col("vid_rep").cast("string")))).alias("variant_id"),
    )
    return table.join(ids, table["row_key"] == ids["__key"], "left").drop("__key")


#: The order of a group's members: by file, then by record.
MEMBER_ORDER = ("vix_ix", "row_id")


def in_member_order(value: Column) -> Column:
    """Aggregate: the values of a group's members in order, nulls left out. A merged group has at most one member a file."""
    kept = F.when(value.isNotNull(), F.struct(F.struct(*MEMBER_ORDER).alias("o"), value.alias("x")))
    return F.transform(F.array_sort(F.collect_list(kept)), lambda s: s["x"])


def group_quality(qual: Column) -> Column:
    """Aggregate: the greatest quality, not below 0."""
    return F.greatest(F.coalesce(F.max(qual), F.lit(0.0)), F.lit(0.0))


def group_filters(filters: Column, breakend: Column, paired: Column) -> Column:
    """Aggregate: the members' filters, each once and sorted; one more where the first member is a breakend and none is paired."""
    first = F.coalesce(F.min_by(breakend, F.struct(*MEMBER_ORDER)), F.lit(False))
    alone = first & ~F.coalesce(F.bool_or(F.coalesce(paired, F.lit(False))), F.lit(False))
    more = F.when(alone, F.array(F.lit(UNPAIRED[0]))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(F.flatten(F.collect_list(filters)), more)))


def group_ids(ids: Column) -> Column:
    """Aggregate: the identifiers of all members in order."""
    return F.flatten(in_member_order(ids))


def group_criteria(criteria: Column) -> Column:
    """Aggregate: the longest criteria text, the first member's on a tie."""
    size = F.length(F.coalesce(criteria, F.lit("")))
    return F.max_by(criteria, F.struct(size, *[-F.col(c) for c in MEMBER_ORDER]))


def group_class(label: Column, strand: Column) -> Column:
    """Aggregate: class and strand of the last member that has a class, else empty."""
    return F.coalesce(F.max_by(F.concat(label, F.coalesce(strand, F.lit(""))), F.when(label != "", F.struct(*MEMBER_ORDER))), F.lit(""))


def group_summary(table: DataFrame) -> DataFrame:
    """Per group: members, longest criteria text (the first member's on a tie), and alternate sequences in file order."""
    return table.groupBy("row_key").agg(
        F.count(F.lit(1)).alias("n_members"),
        group_criteria(F.col("criteria")).alias("criteria"),
        in_member_order(F.col("alt_seq")).alias("alt_seqs"),
    )


def difference_summary(groups: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Per group: members, and the least and greatest of each value with their difference."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("n_members")]
    for v in values:
        aggs += [F.min(v).alias(f"min_{v}"), F.max(v).alias(f"max_{v}"), (F.max(v) - F.min(v)).alias(f"delta_{v}")]
    return groups.groupBy(*by).agg(*aggs)
