"""Queries of the general data-preparation operators over the driver's tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varweave.operators.eager import eager_join_aggregate, heavy_keys
from varweave.operators.quarantine import load_variant_lines, valid_variants
from varweave.operators.schema_drift import consistent_table, schema_changes, wide_table
from varweave.plans import drift_sql
from varweave.session import read

HEAVY_SHARE = 0.04


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are not valid, with the first reason."""
    loaded = load_variant_lines(read(spark, sf_dir, "bad_1"), read(spark, sf_dir, "contigs"))
    return loaded.filter(F.col("reason").isNotNull()).select("line_id", "reason")


def p3_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid lines with typed columns."""
    return valid_variants(load_variant_lines(read(spark, sf_dir, "bad_1"), read(spark, sf_dir, "contigs")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of field definitions within each series."""
    return schema_changes(read(spark, sf_dir, "vcf_reader")).select("file_id", "section", "field", "change").distinct()


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files' fields under the names their series first had, with the types all its files share."""
    return consistent_table(read(spark, sf_dir, "vcf_reader"))


def p5_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a file, one typed column for every INFO field that at least half of the files have."""
    return wide_table(p5_table(spark, sf_dir))


def _key_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    approx, contigs = read(spark, sf_dir, "approx"), read(spark, sf_dir, "contigs")
    return eager_join_aggregate(
        approx,
        contigs,
        on=["chrom_id"],
        by=["chrom_id", "kind"],
        left_sums={"sum_length": F.abs(F.col("length").cast("bigint")), "n_length": F.when(F.col("length").isNotNull(), 1)},
        right_sums={"sum_contig_length": "contig_length"},
        how="left",
        count_as="n_rows",
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The (chrom_id, kind) that hold more than 4% of all rows."""
    total = read(spark, sf_dir, "approx").count()
    return heavy_keys(_key_states(spark, sf_dir), ["chrom_id", "kind"], total, HEAVY_SHARE, "n_rows")


def p6_key_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (chrom_id, kind): rows, summed lengths, and the summed length of the joined contigs."""
    return _key_states(spark, sf_dir)


def p6_joined_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: rows of approx joined to rows of merge_rows on (chrom, kind), and both sides' lengths over the joined rows."""
    return eager_join_aggregate(
        read(spark, sf_dir, "approx"),
        read(spark, sf_dir, "merge_rows"),
        on=["chrom", "kind"],
        by=["kind"],
        left_sums={"sum_lhs_length": F.col("length").cast("bigint")},
        right_sums={"sum_rhs_length": F.col("length").cast("bigint")},
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_found, p3_loaded, p5_found, p5_table, p5_wide, p6_found, p6_key_results, p6_joined_pairs)}


def oracle_sql() -> dict[str, str]:
    quoting = r"""'(?s)^(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*$'"""
    fields = r"""list_transform(regexp_extract_all(',' || raw_line, '(?s),("(?:[^"]|"")*"|[^",]*)', 1),
              lambda x: nullif(CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END, ''))"""
    checked = f"""
        WITH l AS (SELECT line_id, raw_line, regexp_full_match(raw_line, {quoting}) AS sound FROM bad_1),
        f AS (SELECT line_id, sound, CASE WHEN sound THEN {fields} END AS x FROM l),
        c AS (SELECT f.*, k.contig_length FROM f LEFT JOIN contigs k ON k.chrom = f.x[7]),
        r AS (SELECT line_id, x, CASE
            WHEN NOT sound THEN 'quoting'
            WHEN x IS NULL OR len(x) <> 10 THEN 'columns'
            WHEN x[5] = 'BND' AND contig_length IS NULL OR x[5] IS DISTINCT FROM 'BND' AND x[7] IS NOT NULL THEN 'chrom2'
            WHEN x[5] = 'BND' AND NOT coalesce(regexp_full_match(x[8], '[0-9]+')
                 AND TRY_CAST(x[8] AS HUGEINT) BETWEEN 1 AND contig_length, false)
              OR x[5] IS DISTINCT FROM 'BND' AND x[8] IS NOT NULL THEN 'end2'
            WHEN x[9] IS NOT NULL AND (x[5] IS DISTINCT FROM 'INS' OR NOT regexp_full_match(x[9], '[ACGTNacgtn*]+')) THEN 'alt_seq'
            END AS reason FROM c)"""
    return {
        **drift_sql.SQL,
        "p3_found": f"{checked} SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
        "p3_loaded": f"""{checked} SELECT line_id, TRY_CAST(x[1] AS BIGINT) AS row_num, x[2] AS chrom, TRY_CAST(x[3] AS INTEGER) AS start,
            TRY_CAST(x[4] AS INTEGER) AS "end", x[5] AS kind, TRY_CAST(x[6] AS INTEGER) AS length, x[7] AS chrom2,
            TRY_CAST(x[8] AS INTEGER) AS end2, x[9] AS alt_seq, x[10] AS rnames FROM r WHERE reason IS NULL""",
        "p6_found": """SELECT chrom_id, kind FROM approx WHERE chrom_id IS NOT NULL AND kind IS NOT NULL GROUP BY chrom_id, kind
            HAVING count(*) * 25 > (SELECT count(*) FROM approx)""",
        "p6_key_results": """SELECT a.chrom_id, a.kind, count(*) AS n_rows, CAST(sum(abs(CAST(a.length AS BIGINT))) AS BIGINT) AS sum_length,
            CAST(sum(CASE WHEN a.length IS NOT NULL THEN 1 END) AS BIGINT) AS n_length,
            CAST(sum(c.contig_length) AS BIGINT) AS sum_contig_length
            FROM approx a LEFT JOIN contigs c ON c.chrom_id = a.chrom_id GROUP BY a.chrom_id, a.kind""",
        "p6_joined_pairs": """SELECT a.kind, count(*) AS n_pairs, CAST(sum(CAST(a.length AS BIGINT)) AS BIGINT) AS sum_lhs_length,
            CAST(sum(CAST(m.length AS BIGINT)) AS BIGINT) AS sum_rhs_length
            FROM approx a JOIN merge_rows m ON m.chrom = a.chrom AND m.kind = a.kind GROUP BY a.kind""",
    }
