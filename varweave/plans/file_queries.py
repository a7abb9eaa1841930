"""Named queries over VCF and FASTA files, which they write from the driver's tables into the shared folder, with SQL.

Every file number of ``approx`` gives one VCF file: records of a known type, breakends with a mate's place, and starts from 1 on;
an inserted sequence stands behind the base N, other alleles are tags or breakends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varweave.functions import exprs as X
from varweave.operators import annotate as A
from varweave.operators import features as FE
from varweave.options import IndexOptions, MergeOptions
from varweave.plans import merge_vcf as MV
from varweave.plans.reference_queries import KMER, feature_sequences, grouped, query_sequences, variants
from varweave.plans.reference_sql import SEQUENCES, P, V, kmers_of, report_columns
from varweave.session import cut, read, shared_folder
from varweave.sources.fasta import read_fasta, reference_bases
from varweave.sources.storage import write_each, write_sorted
from varweave.sources.vcf import inserted_sequences, read_vcfs

KINDS = ["INS", "DEL", "DUP", "INV", "BND"]


def _header(spark: SparkSession, sf_dir: str) -> list[str]:
    contigs = [f"##contig=<ID={r['chrom']},length={r['contig_length']}>" for r in read(spark, sf_dir, "contigs").orderBy("chrom_id").collect()]
    infos = [("SVTYPE", "String", "Type"), ("SVLEN", "Integer", "Length"), ("END", "Integer", "Last base")]
    declared = [f'##INFO=<ID={i},Number=1,Type={t},Description="{d}">' for i, t, d in infos]
    return ["##fileformat=VCFv4.2", *contigs, *declared, "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]


def vcf_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """The paths of the VCF files, in the order of their file numbers."""
    v = variants(spark, sf_dir).filter(F.col("kind").isin(KINDS) & (F.col("start") >= 1) & ((F.col("kind") != "BND") | (F.col("chrom2").isNotNull() & F.col("end2").isNotNull())))
    sequence = (F.col("kind") == "INS") & X.is_seq(F.col("alt_seq")) & (F.length("alt_seq") > 0)
    mate = X.format_breakend(F.lit("After"), F.lit("After"), F.col("chrom2"), F.col("end2"), F.lit("N"))
    alt = F.when(sequence, F.concat(F.lit("N"), "alt_seq")).when(F.col("kind") == "BND", mate).otherwise(F.concat(F.lit("<"), "kind", F.lit(">")))
    end = F.when(F.col("kind") != "BND", F.concat(F.lit("END="), F.col("end").cast("string")))
    info = F.concat_ws(";", F.concat(F.lit("SVTYPE="), "kind"), F.concat(F.lit("SVLEN="), F.col("length").cast("string")), end)
    qual = F.pmod("row_num", F.lit(60)).cast("string")
    filters = F.when(F.pmod("row_num", F.lit(3)) == 0, "low").otherwise("PASS")
    line = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.concat(F.lit("r"), F.col("row_id").cast("string")), F.lit("N"), alt, qual, filters, info)
    return write_each(v.select(F.col("vix_ix").alias("file"), F.col("row_num").alias("place"), line.alias("line")), shared_folder(spark, "vcf"), _header(spark, sf_dir))


def vcf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The core table read from the files."""
    records, _ = read_vcfs(spark, vcf_files(spark, sf_dir))
    return records.select("vix_ix", "row_num", "chrom_id", "chrom", "start", "end", "kind", "length", "chrom2_id", "chrom2", "end2", "alt_seq", F.col("ids")[0].alias("id"))


def vcf_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inserted sequences read from the files, with the base before them."""
    return inserted_sequences(read_vcfs(spark, vcf_files(spark, sf_dir))[0])


def vcf_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of merge_rows constructed as records, written as one block-gzip file, and read from it again with their places in it."""
    paths = vcf_files(spark, sf_dir)
    records, headers = read_vcfs(spark, paths)
    records = cut(records)
    keys = read(spark, sf_dir, "merge_rows").groupBy(F.concat(F.lit("r"), F.col("row_id").cast("string")).alias("__id")).agg(F.min("row_key").alias("__key"))
    mine = records.join(keys, F.col("ids")[0] == F.col("__id")).withColumn("row_key", F.col("__key")).drop("__id", "__key")
    options = MergeOptions()
    table = cut(MV.annotated(mine.drop(*MV.RAW_COLUMNS), options))
    out = f"{shared_folder(spark, 'merged')}.vcf.gz"
    lines = MV.record_lines(table, records.select("row_id", *MV.RAW_COLUMNS), [0] * len(paths), options)
    MV.write_lines(lines, MV.merged_header(headers[0], [], options.tag_prefix, options.unwanted_info), out)
    merged, _ = read_vcfs(spark, [out])
    value = lambda k: F.try_element_at(F.transform(F.filter("info", lambda x: x["key"] == k), lambda x: x["value"]), F.lit(1))
    return merged.select(
        F.col("row_num").alias("place"), "contig", "pos", "ref", F.col("alts")[0].alias("alt"), F.col("qual").cast("double").alias("qual"), F.concat_ws(";", "filters").alias("filters"),
        value("ORIGINAL_IDS").alias("original_ids"), value("VW_ALT_SEQ").alias("alt_seqs"), value("END2").cast("int").alias("end2"), F.substring(F.col("ids")[0], 1, 7).alias("id_start"),
    )


def tsv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the groups of merge_rows, written as tab-separated text and read again."""
    path = shared_folder(spark, "report")
    MV.write_report(A.add_primary_columns(grouped(spark, sf_dir)), path)
    t = spark.read.option("sep", "\t").option("header", "true").csv(path)
    ints = ["row_id", "start_offset", "end_offset", "end2_offset", "total_offset"]
    return t.select(*[F.col(c).cast("bigint").alias(c) for c in ints], F.col("length_ratio").cast("double").alias("length_ratio"), F.col("length_difference").cast("bigint").alias("length_difference"))


def _fasta(spark: SparkSession, sequences: DataFrame, name: str) -> str:
    """A FASTA file of (name, sequence), in the order of the names, with lines of 60 bases."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("sequence") - 1) / 60).cast("int")), lambda i: F.substring("sequence", i * 60 + 1, F.lit(60)))
    lines = sequences.select("name", F.posexplode(F.concat(F.array(F.concat(F.lit(">"), "name")), pieces)).alias("i", "line"))
    path = f"{shared_folder(spark, name)}.fa"
    write_sorted(lines.orderBy("name", "i").select("line"), [], path)
    return path


def fasta_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, sequences and numbers read from a FASTA file."""
    return read_fasta(spark, [_fasta(spark, feature_sequences(spark, sf_dir), "features")])


def reference_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases of a reference at the first, middle and last places of its contigs, and beyond them."""
    seqs = cut(feature_sequences(spark, sf_dir))
    chunks = read_fasta(spark, [_fasta(spark, seqs, "reference")], chunked=True)
    n = F.length("sequence")
    places = seqs.select(F.col("name").alias("contig"), F.explode(F.array(F.lit(0), F.lit(1), F.floor(n / 2).cast("int"), n - 1, n, n + 5)).alias("pos"))
    return reference_bases(places, chunks)


def feature_index_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-mers of an index built from a FASTA file, saved, and loaded again; features are numbered as in the file."""
    path = shared_folder(spark, "index")
    MV.index_fasta(spark, _fasta(spark, feature_sequences(spark, sf_dir), "features"), path, IndexOptions(k=KMER))
    index = FE.FeatureIndex.load(spark, path)
    return index.kmers.select("kmer", "nix", "count", F.lit(index.k).alias("k"))


def similar_to_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What find-similar gives for the sequences of a FASTA file: feature and scores, best first."""
    path = shared_folder(spark, "index")
    MV.index_fasta(spark, _fasta(spark, feature_sequences(spark, sf_dir), "features"), path, IndexOptions(k=KMER))
    found = MV.similar_features(spark, path, fasta=_fasta(spark, query_sequences(spark, sf_dir), "queries"))
    return found.select("query_name", "nix", "name", "place", F.round("fwd", 6).alias("fwd"), F.round("rev", 6).alias("rev"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (vcf_scan, vcf_sequences, vcf_merged, tsv_report, fasta_scan, reference_lookup, feature_index_saved, similar_to_fasta)}


def oracle_sql() -> dict[str, str]:
    from varweave.plans.reference_sql import SQL

    core = f"""{V}, w AS (SELECT * FROM v WHERE kind IN ('INS', 'DEL', 'DUP', 'INV', 'BND') AND start >= 1 AND (kind <> 'BND' OR chrom2 IS NOT NULL AND end2 IS NOT NULL)),
        x AS (SELECT chrom, row_number() OVER (ORDER BY chrom_id) - 1 AS ix FROM contigs),
        c AS (SELECT vix_ix, row_number() OVER (PARTITION BY vix_ix ORDER BY row_num) - 1 AS row_num, CAST(x.ix AS INTEGER) AS chrom_id, w.chrom, start,
          CASE WHEN kind = 'BND' THEN start WHEN kind = 'DEL' AND length IS NOT NULL THEN start + abs(length) ELSE "end" END AS "end", kind, length,
          CASE WHEN kind = 'BND' THEN CAST(y.ix AS INTEGER) END AS chrom2_id, CASE WHEN kind = 'BND' THEN chrom2 END AS chrom2, CASE WHEN kind = 'BND' THEN end2 END AS end2,
          CASE WHEN kind = 'INS' AND regexp_full_match(alt_seq, '[ACGTNacgtn*]+') THEN alt_seq END AS alt_seq, 'r' || row_id AS id, row_id, w.row_num AS given
          FROM w JOIN x ON x.chrom = w.chrom LEFT JOIN x y ON y.chrom = w.chrom2)"""
    return {
        "vcf_scan": f"WITH {core} SELECT * EXCLUDE (row_id, given) FROM c",
        "vcf_sequences": f"WITH {core} SELECT chrom || ':' || start || ':' || id AS name, 'N' || alt_seq AS sequence FROM c WHERE alt_seq IS NOT NULL",
        "vcf_merged": f"""WITH {core}, k AS (SELECT row_id, min(row_key) AS row_key FROM merge_rows GROUP BY row_id),
        m AS (SELECT c.*, row_key, concat_ws('_', chrom, "end", chrom2, end2) AS here, concat_ws('_', chrom2, end2, chrom, "end") AS there, vix_ix + 100 * row_num AS new_id FROM c JOIN k USING (row_id)),
        b AS (SELECT *, kind = 'BND' AND EXISTS (SELECT 1 FROM m o WHERE o.kind = 'BND' AND o.vix_ix = m.vix_ix AND o.there = m.here) AS paired FROM m),
        f AS (SELECT DISTINCT ON (row_key) row_key, chrom_id, chrom, start, "end", kind, chrom2, end2, alt_seq FROM b ORDER BY row_key, vix_ix, new_id),
        l AS (SELECT row_key, greatest(max(given % 60), 0)::DOUBLE AS qual, string_agg(id, ',' ORDER BY vix_ix, new_id) AS original_ids, string_agg(alt_seq, ',' ORDER BY vix_ix, new_id) AS alt_seqs,
          bool_or(paired) AS paired, list_sort(list_distinct(list(CASE WHEN given % 3 = 0 THEN 'low' ELSE 'PASS' END))) AS filters, min(chrom_id) AS least_chrom FROM b GROUP BY row_key)
        SELECT row_number() OVER (ORDER BY least_chrom, f.start, f."end", row_key) - 1 AS place, f.chrom AS contig, f.start AS pos, 'N' AS ref,
          CASE WHEN kind = 'BND' THEN 'N[' || chrom2 || ':' || end2 || '[' ELSE '<' || kind || '>' END AS alt, qual,
          array_to_string(list_sort(CASE WHEN kind = 'BND' AND NOT paired THEN list_append(filters, 'UNPAIRED_BND') ELSE filters END), ';') AS filters,
          original_ids, alt_seqs, end2, 'VW_' || kind || '_' AS id_start FROM f JOIN l USING (row_key)""",
        "tsv_report": f"WITH {P}, {report_columns('p')} SELECT CAST(row_id AS BIGINT) AS row_id, CAST(start_offset AS BIGINT) AS start_offset, CAST(end_offset AS BIGINT) AS end_offset, CAST(end2_offset AS BIGINT) AS end2_offset, CAST(total_offset AS BIGINT) AS total_offset, length_ratio, CAST(length_difference AS BIGINT) AS length_difference FROM report",
        "fasta_scan": f"WITH {SEQUENCES} SELECT name, sequence, nix AS number FROM fs",
        "reference_lookup": f"""WITH {SEQUENCES}, p AS (SELECT name AS contig, sequence, unnest([0, 1, CAST(length(sequence) // 2 AS BIGINT), length(sequence) - 1, length(sequence), length(sequence) + 5]) AS pos FROM fs)
        SELECT DISTINCT contig, CAST(pos AS INTEGER) AS pos, CASE WHEN pos >= 1 AND pos < length(sequence) THEN substr(sequence, pos, 1) ELSE 'N' END AS base FROM p""",
        "feature_index_saved": f"WITH {SEQUENCES}, {kmers_of('fs', 's')} SELECT kmer, nix, CAST(count AS INTEGER) AS count, {KMER} AS k FROM s JOIN fs ON fs.name = s.name WHERE strand = '+'",
        "similar_to_fasta": SQL["find_similar"],
    }

