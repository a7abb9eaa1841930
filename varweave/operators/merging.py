"""Folding candidate pairs into groups that hold at most one record of each file.

The fold is greedy and depends on the order of the pairs, but a choice only bears on pairs of the same connected component.
So pairs are dealt by component, sorted inside each, and folded by independent tasks; no task needs the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varweave.functions.exprs import append_criterion
from varweave.functions.union_find import Fold
from varweave.operators import candidates as C
from varweave.operators.components import pair_components
from varweave.options import MergeOptions
from varweave.session import cut

UPDATES = "orig_row_key long, new_row_key long, new_vix_set long, new_vix_count int"


def fold_order() -> list[Column]:
    """Fullest groups first, then by keys."""
    return [(F.col("lhs_vix_count") + F.col("rhs_vix_count")).desc(), F.col("lhs_row_key"), F.col("rhs_row_key")]


def pair_order(pairs: DataFrame) -> DataFrame:
    """The pairs, each once, in the order in which they are folded: fullest groups first, then by keys."""
    return pairs.distinct().orderBy(*fold_order())


def merge_updates(pairs: DataFrame, lower_wins: bool = False) -> DataFrame:
    """What the pairs change: orig_row_key, new_row_key, new_vix_set, new_vix_count for every key of an accepted pair.

    Of two sets the one of the higher rank keeps its root; on a tie the left one does, with ``lower_wins`` the one with the lower root.
    """
    pairs = cut(pairs.distinct()).withColumn("fill", F.col("lhs_vix_count") + F.col("rhs_vix_count"))
    parts = pair_components(pairs, "lhs_row_key", "rhs_row_key")
    dealt = pairs.join(parts.select(F.col("key").alias("lhs_row_key"), "component"), "lhs_row_key")
    dealt = dealt.repartition("component").sortWithinPartitions("component", F.col("fill").desc(), "lhs_row_key", "rhs_row_key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, at = Fold(lower_wins), None
        for batch in batches:
            done: list[tuple[int, int, int, int]] = []
            columns = (batch[c].tolist() for c in ("component", "lhs_row_key", "lhs_vix_set", "rhs_row_key", "rhs_vix_set"))
            for component, lhs, lhs_files, rhs, rhs_files in zip(*columns):
                if component != at:
                    done += fold.updates()
                    fold, at = Fold(lower_wins), component
                fold.offer(lhs, lhs_files, rhs, rhs_files)
            yield pd.DataFrame(done, columns=["orig_row_key", "new_row_key", "new_vix_set", "new_vix_count"])
        yield pd.DataFrame(fold.updates(), columns=["orig_row_key", "new_row_key", "new_vix_set", "new_vix_count"])

    return dealt.select("component", "lhs_row_key", "lhs_vix_set", "rhs_row_key", "rhs_vix_set").mapInPandas(run, UPDATES)


def merge_with(table: DataFrame, pairs: DataFrame, criterion: str, lower_wins: bool = False) -> DataFrame:
    """The table after folding the pairs: new keys, file sets and counts, and the criterion appended, where a pair was accepted."""
    updates = merge_updates(pairs, lower_wins)
    met = table.join(updates, table["row_key"] == updates["orig_row_key"], "left")
    kept = [c for c in table.columns if c not in ("row_key", "vix_set", "vix_count", "criteria")]
    hit = F.col("orig_row_key").isNotNull()
    return met.select(
        *kept,
        F.coalesce("new_row_key", "row_key").alias("row_key"),
        F.coalesce("new_vix_set", "vix_set").alias("vix_set"),
        F.coalesce("new_vix_count", "vix_count").alias("vix_count"),
        F.when(hit, append_criterion(F.col("criteria"), F.lit(criterion))).otherwise(F.col("criteria")).alias("criteria"),
    ).select(*table.columns)


def rounds(options: MergeOptions) -> list[tuple[str, object]]:
    """The rounds in order: criterion and candidate function of (table, n_files)."""
    return [
        ("exact", C.exact_indel_pairs),
        ("locus", lambda t, n: C.locus_ins_pairs(t, n, options)),
        ("exact", C.exact_bnd_pairs),
        ("here", lambda t, n: C.bnd_here_there_pairs(t, n, options)),
        ("there", lambda t, n: C.bnd_there_here_pairs(t, n, options)),
        ("near", lambda t, n: C.near_pairs(t, n, options)),
    ]


def merge_all(table: DataFrame, n_files: int, options: MergeOptions) -> DataFrame:
    """All six rounds; the lineage is cut between them, since each refers to the one before several times."""
    table = cut(table)
    for criterion, candidates in rounds(options):
        table = cut(merge_with(table, candidates(table, n_files), criterion))
    return table
