"""Merging VCF files into one: scan, six rounds, annotation, report and the merged file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varweave import errors as E
from varweave.functions.exprs import hex_hash, parse_breakend
from varweave.operators import annotate as A
from varweave.operators import features as FE
from varweave.operators.merging import merge_all
from varweave.options import IndexOptions, MergeOptions
from varweave.session import cut
from varweave.sources.fasta import read_fasta, reference_bases
from varweave.sources.header import merged_header
from varweave.sources.storage import write_sorted
from varweave.sources.vcf import RAW, _SEQ, inserted_sequences, mate_of, read_vcfs

RAW_COLUMNS = [c.split(" ")[0] for c in ("file", "contig", "pos", "ids", "ref", "alts", "qual", "filters", "info", "keys", "samples")]


def annotated(table: DataFrame, options: MergeOptions) -> DataFrame:
    """Merged records with pairing, classification, identifiers and primary columns."""
    out = A.pair_breakends(table)
    if options.annotation_index:
        index = FE.FeatureIndex.load(table.sparkSession, options.annotation_index)
        sequences = out.filter("kind = 'INS' AND length(alt_seq) > 0").select(hex_hash(F.col("seq_hash")).alias("name"), F.col("alt_seq").alias("sequence")).distinct()
        out = FE.add_classification(out, FE.best_classification(index, sequences))
    else:
        out = out.withColumns({"class": F.lit(""), "strand": F.lit("")})
    return A.add_primary_columns(A.add_variant_ids(out, options.tag_prefix))


def _alleles(record: dict, force_tags: bool, base: str | None) -> tuple[str, str]:
    """REF and ALT: tags for sequences, unknown bases filled in from the reference."""
    if len(record["alts"]) != 1:
        raise E.MultiAllelic(",".join(record["alts"]), (f"variant {record['contig']}:{record['pos']}",))
    ref, alt = record["ref"], record["alts"][0]
    if force_tags and _SEQ.match(ref) and _SEQ.match(alt):
        ref, alt = (ref[:1], "<DEL>") if len(ref) > 1 else (ref, "<INS>")
    if base is not None:
        if ref in ("N", "n"):
            ref = base
        if not _SEQ.match(alt) and mate_of(alt):
            if alt[0] in "Nn":
                alt = base + alt[1:]
            elif alt[-1] in "Nn":
                alt = alt[:-1] + base
    return ref, alt


def construct_record(group: dict, widths: list[int], options: MergeOptions) -> str:
    """The line of one merged record.

    ``group`` has variant_id, base, what the members give together (qual, filters, original_ids, longest, inserted, label) and the
    members with their raw columns. Sample values are aligned with the first member's FORMAT keys by name; a key that another file lacks
    is missing there.
    """
    members = sorted(group["members"], key=lambda m: (m["vix_ix"], m["row_id"]))
    first = members[0]
    ref, alt = _alleles(first, options.force_alt_tags, group["base"] if options.fills else None)
    mate = mate_of(first["alts"][0])
    prefix = options.tag_prefix
    info = [(x["key"], x["value"]) for x in first["info"]]
    if group["original_ids"]:
        info.append(("ORIGINAL_IDS", ",".join(group["original_ids"])))
    if mate:
        info = [x for x in info if x[0] not in ("CHR2", "END2")] + [("CHR2", mate[0]), ("END2", str(mate[1]))]
    if group["longest"]:
        info.append((f"{prefix}_CRITERIA", group["longest"]))
    if group["inserted"]:
        info.append((f"{prefix}_ALT_SEQ", ",".join(group["inserted"])))
    if group["label"]:
        info.append((f"{prefix}_ALT_CLASS", group["label"]))
    info = [x for x in info if x[0] not in options.unwanted_info]
    keys = first["keys"]
    by_file = {m["vix_ix"]: m for m in reversed(members)}
    absent = ":".join(("0/0" if options.use_ref_alleles else "./.") if k == "GT" else "." for k in keys)
    cells = []
    for vix, width in enumerate(widths):
        m = by_file.get(vix)
        if m is None:
            cells += [absent] * width
        else:
            for values in m["samples"]:
                own = dict(zip(m["keys"], values))
                cells.append(":".join(own.get(k, ".") for k in keys))
    return "\t".join(
        [
            first["contig"],
            str(first["pos"] or 1),
            group["variant_id"],
            ref,
            alt,
            f"{group['qual']:g}",
            ";".join(group["filters"]) or ".",
            ";".join(k if v is None else f"{k}={v}" for k, v in info) or ".",
            *([":".join(keys), *cells] if any(widths) else []),
        ]
    )


def record_lines(table: DataFrame, raw: DataFrame, widths: list[int], options: MergeOptions) -> DataFrame:
    """(line, and its sorting columns) of every group. A group holds at most one record of each of 64 files."""
    own = ["row_id", "vix_ix"]
    met = table.join(raw.select("row_id", *RAW_COLUMNS), "row_id")
    if options.fills:
        chunks = read_fasta(table.sparkSession, [options.reference], chunked=True)
        bases = reference_bases(met.select("contig", F.greatest("pos", F.lit(1)).alias("pos")), chunks).withColumnRenamed("pos", "__pos").withColumnRenamed("contig", "__contig")
        met = met.join(bases, (F.col("contig") == F.col("__contig")) & (F.greatest("pos", F.lit(1)) == F.col("__pos")), "left")
    else:
        met = met.withColumn("base", F.lit(None).cast("string"))
    breakend = parse_breakend(F.try_element_at("alts", F.lit(1))).isNotNull()
    groups = met.groupBy("row_key").agg(
        F.min("chrom_id").alias("chrom_id"),
        F.min("primary_start").alias("primary_start"),
        F.min("primary_end").alias("primary_end"),
        F.first("variant_id").alias("variant_id"),
        F.min_by("base", "vix_ix").alias("base"),
        A.group_quality(F.col("qual")).alias("qual"),
        A.group_filters(F.col("filters"), breakend, F.col("paired_bnd")).alias("filters"),
        A.group_ids(F.col("ids")).alias("original_ids"),
        A.group_criteria(F.col("criteria")).alias("longest"),
        A.in_member_order(F.col("alt_seq")).alias("inserted"),
        A.group_class(F.col("class"), F.col("strand")).alias("label"),
        F.collect_list(F.struct(*own, *RAW_COLUMNS)).alias("members"),
    )
    order = ["chrom_id", "primary_start", "primary_end", "row_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [construct_record(g, widths, options) for g in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in order], pa.array(lines, pa.string())], names=[*order, "line"])

    return groups.mapInArrow(run, "chrom_id int, primary_start int, primary_end int, row_key long, line string")


def write_lines(lines: DataFrame, header: list[str], path: str) -> None:
    """Header and sorted lines as one file, block-gzip if its name ends in gz."""
    write_sorted(lines.orderBy("chrom_id", "primary_start", "primary_end", "row_key").select("line"), header, path)


def write_report(table: DataFrame, path: str) -> None:
    """The report of a table with primary columns, as a folder of tab-separated files in the order of contig, group and record."""
    report = A.report_table(table).orderBy("chrom_id", "row_key", "row_id")
    report.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def merge_vcfs(spark: SparkSession, paths: list[str], out: str, options: MergeOptions | None = None) -> DataFrame:
    """Merge the files into ``out``, write the report if asked, and return the annotated table."""
    options = options or MergeOptions()
    records, headers = read_vcfs(spark, paths)
    records = cut(records)
    raw = records.select("row_id", *RAW_COLUMNS)
    core = records.drop(*RAW_COLUMNS)
    table = cut(annotated(merge_all(core, len(paths), options), options))
    if options.merge_table:
        write_report(table.drop("class", "strand", "paired_bnd"), options.merge_table)
    samples = [s for h in headers for s in h.samples]
    head = merged_header(headers[0], samples, options.tag_prefix, options.unwanted_info)
    write_lines(record_lines(table, raw, [len(h.samples) for h in headers], options), head, out)
    return table


def index_fasta(spark: SparkSession, fasta: str, out: str, options: IndexOptions | None = None) -> FE.FeatureIndex:
    """Build and save the k-mer index of a FASTA file; features are numbered in the order of the file."""
    index = FE.build_index(read_fasta(spark, [fasta]), options, nix="number")
    index.save(out)
    return index


def similar_features(spark: SparkSession, index_path: str, query: str | None = None, fasta: str | None = None, vcf: str | None = None) -> DataFrame:
    """Features similar to a literal sequence, the sequences of a FASTA file or the insertions of a VCF file."""
    index = FE.FeatureIndex.load(spark, index_path)
    if query is not None:
        asked = spark.createDataFrame([("query", query)], "name string, sequence string")
    elif fasta is not None:
        asked = read_fasta(spark, [fasta])
    else:
        asked = inserted_sequences(read_vcfs(spark, [vcf])[0])
    return FE.find_similar(index, asked).orderBy("query_name", "place")


assert set(RAW_COLUMNS) <= set(RAW.replace(",", " ").replace("<", " ").split())
