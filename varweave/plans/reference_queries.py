"""Named queries of the merge engine's operators over the driver's tables, with SQL that says the same.

The variant table is ``approx`` with repeated deliveries removed and types in their standard spelling; groups are those of
``merge_rows``; query sequences are the inserted sequences of ``approx``, features those of ``merge_rows``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varweave.functions import exprs as X
from varweave.functions import kmers as K
from varweave.functions.align import align as align_udf
from varweave.operators import annotate as A
from varweave.operators import candidates as C
from varweave.operators import distance as D
from varweave.operators import features as FE
from varweave.operators import merging as M
from varweave.operators import ranges as R
from varweave.operators.ordering import with_place
from varweave.options import IndexOptions, MergeOptions
from varweave.schema import decode_row_id, encode_row_id, file_bit, union_files
from varweave.session import read

N_FILES = 64
KMER = 11
OPTIONS = MergeOptions()

CORE = ["row_num", "chrom_id", "chrom", "start", "end", "kind", "length", "chrom2_id", "chrom2", "end2", "alt_seq", "seq_hash"]
STATE = ["vix_ix", "row_id", "row_key", "vix_set", "vix_count", "criteria"]


def variants(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The variant table with its merge state, each record once; of it only the named columns, which are pruned to first.

    Repeated deliveries are told by row_id, where that is asked for.
    """
    columns = columns or [*CORE, *STATE]
    some = read(spark, sf_dir, "approx").select(*columns)
    some = some.dropDuplicates(["row_id"]) if "row_id" in columns else some.distinct()
    return some.withColumn("kind", X.standard_kind(F.col("kind")))


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants that merge_rows puts into a group, with that group's key."""
    keys = read(spark, sf_dir, "merge_rows").groupBy(F.col("row_id").alias("__id")).agg(F.min("row_key").alias("__key"))
    v = variants(spark, sf_dir)
    return v.join(keys, v["row_id"] == keys["__id"]).select(*CORE, *[F.col("__key").alias("row_key") if c == "row_key" else F.col(c) for c in STATE])


def query_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, sequence): each inserted sequence under the hexadecimal text of its hash."""
    v = variants(spark, sf_dir, ["kind", "alt_seq", "seq_hash"]).filter((F.col("kind") == "INS") & (F.length("alt_seq") > 0) & F.col("seq_hash").isNotNull())
    return v.groupBy(X.hex_hash(F.col("seq_hash")).alias("name")).agg(F.min("alt_seq").alias("sequence"))


def feature_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, sequence): every distinct alternate sequence of every group, named by the group's key and the sequence's digest."""
    rows = read(spark, sf_dir, "merge_rows").filter(X.is_seq(F.col("alt_seq")) & (F.length("alt_seq") >= KMER))
    some = rows.select("row_key", F.upper("alt_seq").alias("sequence")).distinct()
    return some.select(F.concat_ws("_", F.concat(F.lit("f"), F.col("row_key").cast("string")), F.left(F.md5("sequence"), F.lit(12))).alias("name"), "sequence")


def _counts(seqs: DataFrame, strands: str = "+") -> DataFrame:
    return K.kmer_counts(seqs, "name", "sequence", KMER, strands, unique_names=True)


# Model


def variant_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = variants(spark, sf_dir)
    core = [X.hex_hash(F.col(c)).alias(c) if c == "seq_hash" else c for c in CORE]
    return v.select(*core, *STATE, encode_row_id(F.col("vix_ix"), F.col("row_num")).alias("encoded"), (file_bit(F.col("vix_ix")) == F.col("vix_set")).alias("bit_agrees"))


def union_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of one parity each as a core table, united again under new file numbers."""
    core = variants(spark, sf_dir)
    halves = [core.filter(F.pmod("vix_ix", F.lit(2)) == i).select(*CORE) for i in range(2)]
    return union_files(halves).select("row_num", "chrom_id", "start", "kind", "vix_ix", "row_id", "row_key", "vix_set", "vix_count", "criteria")


def contig_check_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file whether its contigs are those of the first file that declares any, in the same order."""
    files = read(spark, sf_dir, "vcf_reader").select("file_id", F.regexp_extract_all("header", F.lit("##contig=<ID=([^,>]+)"), F.lit(1)).alias("names")).filter(F.size("names") > 0)
    first = files.agg(F.min_by("names", "file_id").alias("n")).first()
    names = list(first["n"] or []) if first else []
    return files.select("file_id", (F.col("names") == F.array(*[F.lit(n) for n in names]).cast("array<string>")).alias("agrees")).distinct()


def row_key_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    vix, num = decode_row_id(F.col("row_id"))
    return variants(spark, sf_dir).select("row_id", vix.alias("vix_ix"), num.alias("row_num"))


def kind_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.open_groups(variants(spark, sf_dir), N_FILES, F.col("kind") != "BND").select("row_id", "kind", "vix_count")


# Candidate pairs


def exact_indel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exact_indel_pairs(variants(spark, sf_dir, C.NEEDED), N_FILES)


def locus_ins_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.locus_ins_pairs(variants(spark, sf_dir, C.NEEDED), N_FILES, OPTIONS)


def exact_bnd_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exact_bnd_pairs(variants(spark, sf_dir, C.NEEDED), N_FILES)


def bnd_here_there_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.bnd_here_there_pairs(variants(spark, sf_dir, C.NEEDED), N_FILES, OPTIONS)


def bnd_there_here_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.bnd_there_here_pairs(variants(spark, sf_dir, C.NEEDED), N_FILES, OPTIONS)


def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.near_pairs(variants(spark, sf_dir, C.NEEDED), N_FILES, OPTIONS)


# Ranges


def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletions and the duplications of the contig whose surroundings, a million bases on either side, they overlap."""
    v = variants(spark, sf_dir, ["row_id", "chrom_id", "start", "end", "kind"])
    lhs = X.prefix_cols(v.filter("kind = 'DEL'").drop("kind"), "lhs")
    around = v.filter("kind = 'DUP'").select("row_id", "chrom_id", (F.col("start") - 1_000_000).alias("start"), (F.col("end") + 1_000_000).alias("end"))
    met = R.overlap_join(lhs, X.prefix_cols(around, "rhs"), ["lhs_chrom_id"], ["rhs_chrom_id"], ("lhs_start", "lhs_end"), ("rhs_start", "rhs_end"))
    return met.select("lhs_row_id", "rhs_row_id")


def _points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = variants(spark, sf_dir, ["row_id", "kind", "start"])
    return v.filter("kind = 'BND'").select("row_id", F.col("start").cast("long").alias("x")), v.filter("kind = 'INS'").select(F.col("start").cast("long").alias("place")).distinct()


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The insertion place closest to each breakend."""
    points, keys = _points(spark, sf_dir)
    return R.nearest(points, keys, "x", "place")


def within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insertion places closer than 20,000 to each breakend, nearest first."""
    points, keys = _points(spark, sf_dir)
    return R.within(points, keys, "x", "place", 20_000)


# Groups


def pair_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact pairs with their place in the order of the fold."""
    return with_place(exact_indel_pairs(spark, sf_dir).distinct(), M.fold_order())


def merge_round_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = variants(spark, sf_dir)
    return M.merge_with(v, C.exact_indel_pairs(v, N_FILES), "exact").select("row_id", "row_key", "vix_set", "vix_count", "criteria")


def merge_round_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first round with the other rule for ties: of two sets of one rank the lower root stays."""
    v = variants(spark, sf_dir)
    return M.merge_with(v, C.exact_indel_pairs(v, N_FILES), "exact", lower_wins=True).select("row_id", "row_key", "vix_set", "vix_count", "criteria")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge_all(variants(spark, sf_dir), N_FILES, OPTIONS)


def merge_all_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("row_id", "row_key", "vix_set", "vix_count", "criteria")


def merge_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _merged(spark, sf_dir).groupBy("row_key").agg(F.count(F.lit(1)).alias("members"), F.bit_or("vix_set").alias("files"))
    return sizes.groupBy("members").agg(F.count(F.lit(1)).alias("n_groups"))


# Annotation


def breakend_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakends, every third with a mate row of its file added, and whether a mate was found."""
    v = variants(spark, sf_dir).filter("kind = 'BND'")
    mates = v.filter("row_num % 3 = 0").select(
        *[F.col({"chrom": "chrom2", "end": "end2", "chrom2": "chrom", "end2": "end"}.get(c, c)).alias(c) if c != "row_id" else (-F.col("row_id")).alias(c) for c in v.columns]
    )
    return A.pair_breakends(v.unionByName(mates)).select("row_id", "paired_bnd")


def primary_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.primary_rows(grouped(spark, sf_dir))


def primary_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.add_primary_columns(grouped(spark, sf_dir)).select("row_id", "row_key", *[f"primary_{c}" for c in A.PRIMARY])


def report_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.report_table(A.add_primary_columns(grouped(spark, sf_dir))).select("row_id", "start_offset", "end_offset", "end2_offset", "total_offset", "length_ratio", "length_difference", "alt_seq")


def variant_id_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir).select("row_id", A.variant_text().alias("vid"))


def variant_id_rep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the groups with one text each group is; the hash is as telling as the text here."""
    return A.variant_reps(grouped(spark, sf_dir)).select("row_key", "kind", "vid", F.col("vid_rep").cast("int").alias("vid_rep"))


def variant_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.add_variant_ids(grouped(spark, sf_dir)).select("row_id", "row_key", "variant_id")


def criteria_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.group_summary(grouped(spark, sf_dir)).select("row_key", "n_members", "criteria")


def alt_seq_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.group_summary(grouped(spark, sf_dir)).select("row_key", F.concat_ws(",", "alt_seqs").alias("alt_seqs"))


def qual_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest quality of a group, not below 0; a record's quality is made of its row number."""
    g = grouped(spark, sf_dir).withColumn("qual", (F.pmod("row_num", F.lit(1000)) - 100) / F.lit(10.0))
    return g.groupBy("row_key").agg(A.group_quality(F.col("qual")).alias("qual"))


def filter_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filters of a group, each once and sorted; one more if its first member is a breakend and no member is paired."""
    g = A.pair_breakends(grouped(spark, sf_dir))
    own = F.array(F.coalesce("criteria", F.lit("PASS")))
    filters = A.group_filters(own, F.col("kind") == "BND", F.col("paired_bnd"))
    return g.groupBy("row_key").agg(F.concat_ws(";", filters).alias("filters"))


def original_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identifiers of a group's records in file order."""
    ids = F.array(F.concat(F.lit("id"), F.col("row_id").cast("string")))
    return grouped(spark, sf_dir).groupBy("row_key").agg(F.concat_ws(",", A.group_ids(ids)).alias("ids"))


def paired_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any breakend of a group is paired, and the class of the last member that has one."""
    g = A.pair_breakends(grouped(spark, sf_dir)).withColumn("class", F.when(F.pmod("row_num", F.lit(3)) == 0, F.col("kind")).otherwise(F.lit("")))
    any_paired = F.bool_or(F.coalesce("paired_bnd", F.lit(False)))
    return g.groupBy("row_key").agg(any_paired.alias("paired"), A.group_class(F.col("class"), F.lit("+")).alias("label"))


def output_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every record in the order in which merged records are written."""
    p = A.add_primary_columns(grouped(spark, sf_dir))
    return with_place(p, ["chrom_id", "primary_start", "primary_end", "row_key", "row_id"]).select("row_id", "place")


def merge_difference_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.difference_summary(grouped(spark, sf_dir), ["row_key", "kind"], ["start", "end", "length"])


# Scalars


def _with_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakends with an allele text in one of the four orientations, chosen by the row number."""
    v = variants(spark, sf_dir).filter("kind = 'BND' AND chrom2 IS NOT NULL AND end2 IS NOT NULL")
    side = lambda n: F.when(F.shiftright("row_num", n).bitwiseAND(F.lit(1)) == 1, "Before").otherwise("After")
    return v.withColumns({"side": side(0), "side2": side(1)}).withColumn("alt", X.format_breakend(F.col("side"), F.col("side2"), F.col("chrom2"), F.col("end2"), F.lit("N")))


def breakend_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _with_alleles(spark, sf_dir).select("row_id", "alt", X.parse_breakend(F.col("alt")).alias("b"))
    return b.select("row_id", "alt", "b.chrom2", "b.end2", "b.side", "b.side2")


def breakend_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _with_alleles(spark, sf_dir)
    flipped = b.select("row_id", X.flip_breakend(*[F.col(c) for c in ("chrom", "end", "side", "chrom2", "end2", "side2")]).alias("f"))
    return flipped.select("row_id", "f.chrom", "f.end", X.format_breakend(F.col("f.side"), F.col("f.side2"), F.col("f.chrom2"), F.col("f.end2"), F.lit("A")).alias("alt"))


def is_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "merge_rows").select("row_id", "alt_seq", X.is_seq(F.col("alt_seq")).cast("int").alias("is_seq")).distinct()


def infer_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types inferred from made alleles where the row number hides the given type."""
    v = variants(spark, sf_dir)
    ref = F.when(F.col("kind") == "DEL", "ACGT").otherwise("A")
    alt = F.when(F.col("kind") == "INS", F.concat(F.lit("A"), F.coalesce("alt_seq", F.lit("CG")))).when(F.col("kind") == "BND", "N[chr1:5[").when(F.col("kind") == "DUP", "<DUP>").otherwise("A")
    given = F.when(F.pmod("row_num", F.lit(2)) == 0, F.concat("kind", F.lit(":X")))
    return v.select("row_id", X.infer_kind(given, ref, alt, F.lit(1)).alias("kind"))


def del_end_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir).select("row_id", X.repaired_end(F.col("kind"), F.col("start"), F.col("end"), F.col("length")).alias("end"))


def pmin_pmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir).select("row_id", X.pmin(F.col("length"), F.col("end2")).alias("least"), X.pmin(F.col("start"), F.col("end")).alias("lo"), X.pmax(F.col("start"), F.col("end")).alias("hi"))


def ifelse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir).select("row_id", X.ifelse(F.col("length") < 0, F.lit("minus"), F.lit("plus")).alias("sign"))


def criteria_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir).select("row_id", X.append_criterion(F.col("criteria"), F.lit("near")).alias("criteria"))


def length_agrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths against those of the group's primary record."""
    p = A.add_primary_columns(grouped(spark, sf_dir))
    return p.select("row_id", X.length_agrees(F.col("length"), F.col("primary_length"), 0.9, 25).alias("agrees"))


def base62(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir).select("row_id", A.short_hash(A.variant_text()).alias("vid_hash"))


def seq_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_sequences(spark, sf_dir).select("name", X.seq_digest(F.col("sequence")).alias("digest"))


# K-mers


def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(query_sequences(spark, sf_dir)).select("name", "kmer", "count")


def kmer_counts_stranded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(query_sequences(spark, sf_dir), "+-")


def kmer_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.kmer_lists(query_sequences(spark, sf_dir), "sequence", KMER).select("name", F.concat_ws(",", F.transform("kmers", lambda x: x.cast("string"))).alias("kmers"))


def kmer_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.kmer_positions(query_sequences(spark, sf_dir), "name", "sequence", KMER)


def kmer_frequency_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = K.frequency_vectors(query_sequences(spark, sf_dir), "name", "sequence", 3, both=True)
    return v.select("name", F.concat_ws(",", F.transform("freqs", lambda x: x.cast("string"))).alias("freqs"))


def kmer_revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = _counts(query_sequences(spark, sf_dir)).select("kmer").distinct()
    return some.select("kmer", K.reverse_complement(KMER, F.col("kmer")).alias("rc"), K.reverse(KMER, F.col("kmer")).alias("reversed"))


def kmer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each k-mer as bases."""
    some = _counts(query_sequences(spark, sf_dir)).select("kmer").distinct()
    return some.select("kmer", K.rendered(KMER, F.col("kmer")).alias("bases"))


def kmer_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-mers of 32 bases, which fill the whole integer, with both strands and as bases."""
    all_ = K.kmer_positions(query_sequences(spark, sf_dir), "name", "sequence", 32)
    return all_.select("name", "last", K.rendered(32, F.col("kmer")).alias("bases"), K.rendered(32, K.reverse_complement(32, F.col("kmer"))).alias("rc_bases"), (F.col("rc_kmer") == K.reverse_complement(32, F.col("kmer"))).alias("agrees"))


def kmer_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different k-mers each sequence has over both strands."""
    return K.distinct_kmers(_counts(query_sequences(spark, sf_dir), "+-"))


def kmer_lists_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As kmer_lists, of the other strand."""
    return K.kmer_lists(query_sequences(spark, sf_dir), "sequence", KMER, reverse=True).select("name", F.concat_ws(",", F.transform("kmers", lambda x: x.cast("string"))).alias("kmers"))


def kmer_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each k-mer against its reverse complement."""
    some = _counts(query_sequences(spark, sf_dir)).select("kmer").distinct()
    return some.select("kmer", K.hamming(F.col("kmer"), K.reverse_complement(KMER, F.col("kmer"))).cast("int").alias("ham"))


# Distances and features


def cosine_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.sequence_distance(query_sequences(spark, sf_dir), feature_sequences(spark, sf_dir), KMER, "cosine")
    return d.withColumn("distance", F.round("distance", 6))


def chi_squared_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.sequence_distance(query_sequences(spark, sf_dir), feature_sequences(spark, sf_dir), KMER, "chi_squared")
    return d.withColumn("chi_squared", F.round("chi_squared", 6))


def align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence of each merged member against that of the same record in the variant table."""
    m = read(spark, sf_dir, "merge_rows").filter("alt_seq IS NOT NULL").select("row_id", F.upper("alt_seq").alias("a")).distinct()
    v = variants(spark, sf_dir).filter("alt_seq IS NOT NULL").select("row_id", F.upper("alt_seq").alias("b"))
    return m.join(v, "row_id").select("row_id", align_udf("a", "b").alias("score"))


def _index(spark: SparkSession, sf_dir: str) -> FE.FeatureIndex:
    return FE.build_index(feature_sequences(spark, sf_dir), IndexOptions(k=KMER))


def feature_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).features.withColumn("mags", F.round("mags", 6))


def feature_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).kmers


def _scores(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("fwd", "rev", "distance") if c in df.columns})


def feature_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(FE.rank(_index(spark, sf_dir), query_sequences(spark, sf_dir), unique_names=True))


def find_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(FE.find_similar(_index(spark, sf_dir), query_sequences(spark, sf_dir), unique_names=True))


def best_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(FE.best_classification(_index(spark, sf_dir), query_sequences(spark, sf_dir), unique_names=True))


def attach_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = FE.best_classification(_index(spark, sf_dir), query_sequences(spark, sf_dir), unique_names=True)
    return FE.add_classification(variants(spark, sf_dir), classes).select("row_id", "class", "strand")


def occurrence_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the records with one place and kind each record is, in row_key order."""
    return variants(spark, sf_dir).select("row_id", A.occurrences(["chrom_id", "kind", "start"], "row_key").alias("occurrence"))


_ALL = [
    variant_core, union_files_query, contig_check_query, row_key_encode_decode, kind_filter,
    exact_indel_pairs, locus_ins_pairs, exact_bnd_pairs, bnd_here_there_pairs, bnd_there_here_pairs, near_pairs,
    overlap_join, nearest, within,
    pair_order, merge_round_exact, merge_round_lower, merge_all_rounds, merge_group_sizes,
    breakend_pairing, primary_row, primary_columns, report_offsets, variant_id_text, variant_id_rep, variant_id,
    criteria_longest, alt_seq_list, qual_max, filter_union, original_ids, paired_groups, output_order, merge_difference_summary, occurrence_number,
    breakend_parse, breakend_flip, is_seq, infer_kind, del_end_repair, pmin_pmax, ifelse, criteria_append, length_agrees, base62, seq_digest,
    kmer_counts, kmer_counts_stranded, kmer_lists, kmer_positions, kmer_frequency_vector, kmer_revcomp, kmer_hamming, kmer_text, kmer_longest, kmer_distinct, kmer_lists_reverse,
    cosine_distance, chi_squared_distance, align, feature_index, feature_kmers, feature_rank, find_similar, best_classification, attach_classification,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__.removesuffix("_query"): f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    from varweave.plans.reference_sql import SQL

    return SQL
