import gzip

import pytest

from varweave import errors as E
from varweave.options import IndexOptions, MergeOptions
from varweave.plans import merge_vcf as MV
from varweave.sources.fasta import read_fasta, reference_bases
from varweave.sources.header import scan
from varweave.sources.vcf import VcfReader, _File, inserted_sequences, read_vcfs

HEAD = """##fileformat=VCFv4.2
##contig=<ID=chr1,length=1000>
##contig=<ID=chr2,length=1000>
##FILTER=<ID=PASS,Description="All filters passed">
##INFO=<ID=SVTYPE,Number=1,Type=String,Description="Type">
##INFO=<ID=SVLEN,Number=1,Type=Integer,Description="Length">
##INFO=<ID=END,Number=1,Type=Integer,Description="End">
##INFO=<ID=PRECISE,Number=0,Type=Flag,Description="Precise">
##INFO=<ID=VAF,Number=1,Type=Float,Description="Fraction">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##FORMAT=<ID=DV,Number=1,Type=Integer,Description="Reads">
"""


def vcf(path, sample, records, packed=False, head=HEAD):
    text = head + "#" + "\t".join(["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample]) + "\n" + "".join("\t".join(map(str, r)) + "\n" for r in records)
    with gzip.open(path, "wt") if packed else open(path, "w") as f:
        f.write(text)
    return str(path)


def fields(line):
    f = line.split("\t")
    return f, dict(x.split("=", 1) if "=" in x else (x, None) for x in f[7].split(";"))


@pytest.fixture()
def files(tmp_path):
    a = vcf(tmp_path / "a.vcf", "SA", [
        ("chr1", 100, "a1", "N", "<DEL>", 10, "PASS", "PRECISE;SVTYPE=DEL;SVLEN=-50;END=149", "GT:DV", "0/1:3"),
        ("chr1", 300, "a2", "A", "ACCGGTTACCGGTTA", 20, "PASS", "SVTYPE=INS;SVLEN=14", "GT:DV", "1/1:4"),
        ("chr1", 500, "a3", "N", "N[chr2:700[", 5, "q5", "SVTYPE=BND", "GT:DV", "0/1:2"),
        ("chr2", 700, "a4", "N", "]chr1:500]N", 5, "PASS", "SVTYPE=BND", "GT:DV", "0/1:2")])
    b = vcf(tmp_path / "b.vcf.gz", "SB", [
        ("chr1", 100, "b1", "N", "<DEL>", 30, "low", "SVTYPE=DEL;SVLEN=-50;END=150", "DV:GT", "9:1/1"),
        ("chr1", 300, "b2", "A", "ACCGGTTACCGGTTA", ".", "PASS", "SVTYPE=INS;SVLEN=14", "GT", "0/1"),
        ("chr1", 510, "b3", "N", "N[chr2:720[", 7, "PASS", "SVTYPE=BND", "GT:DV", "0/1:2")], packed=True)
    return a, b


def test_core_table(spark, files):
    records, headers = read_vcfs(spark, list(files))
    rows = {r["ids"][0]: r for r in records.collect()}
    assert headers[1].samples == ["SB"]
    assert (rows["a1"]["end"], rows["a1"]["kind"], rows["a1"]["length"]) == (150, "DEL", -50)
    assert rows["a2"]["alt_seq"] == "CCGGTTACCGGTTA" and rows["a2"]["seq_hash"] == rows["b2"]["seq_hash"] > 0
    assert (rows["a3"]["chrom2"], rows["a3"]["chrom2_id"], rows["a3"]["end2"]) == ("chr2", 1, 700)
    assert (rows["b1"]["row_id"], rows["b3"]["row_id"], rows["b3"]["vix_set"]) == (1, 201, 2)
    names = {r["name"]: r["sequence"] for r in inserted_sequences(records).collect()}
    assert names["chr1:300:a2"] == "ACCGGTTACCGGTTA"


def test_merge_end_to_end(spark, files, tmp_path):
    fasta = tmp_path / "ref.fa"
    fasta.write_text(">chr1 one\n" + "ACGT" * 250 + "\n>chr2\n" + "GGCC" * 250 + "\n")
    out, report = str(tmp_path / "m.vcf"), str(tmp_path / "report")
    options = MergeOptions(reference=str(fasta), merge_table=report, unwanted_info=("PRECISE",))
    MV.merge_vcfs(spark, list(files), out, options)
    header, records = scan(out)
    lines = [fields(x) for x in records]
    assert header.samples == ["SA", "SB"] and "UNPAIRED_BND" in header.filters and "PRECISE" not in header.infos
    assert [f[1] for f, _ in lines] == ["100", "300", "500", "700"]
    (f, info) = lines[0]
    assert (f[3], f[4], f[5], f[6]) == ("T", "<DEL>", "30", "PASS;low") and info["ORIGINAL_IDS"] == "a1,b1" and info["VW_CRITERIA"] == "exact"
    assert "PRECISE" not in info and f[8:] == ["GT:DV", "0/1:3", "1/1:9"] and f[2].startswith("VW_DEL_")
    (f, info) = lines[1]
    assert (f[3], f[4]) == ("A", "<INS>") and info["VW_ALT_SEQ"] == "CCGGTTACCGGTTA,CCGGTTACCGGTTA" and f[10] == "0/1:."
    (f, info) = lines[2]
    assert f[4] == "T[chr2:700[" and info["VW_CRITERIA"] == "here" and (info["CHR2"], info["END2"]) == ("chr2", "700") and f[6] == "PASS;q5"
    (f, info) = lines[3]
    assert f[4] == "]chr1:500]C" and f[10] == "0/0:." and f[6] == "PASS"
    ids = [i for _, x in lines for i in x["ORIGINAL_IDS"].split(",")]
    assert sorted(ids) == ["a1", "a2", "a3", "a4", "b1", "b2", "b3"] and len({f[2] for f, _ in lines}) == 4
    table = spark.read.option("sep", "\t").option("header", "true").csv(report)
    assert table.count() == 7 and table.columns[-1] == "alt_seq"


@pytest.mark.parametrize(
    "record,error",
    [
        (("chr1", 5, "x", "A", "<DEL>", 1, "PASS", "PRECISE=true;SVTYPE=DEL;SVLEN=-3", "GT", "0/1"), E.BadInfo),
        (("chr1", 5, "x", "A", "<DEL>", 1, "PASS", "SVTYPE=DEL;END=wibble", "GT", "0/1"), E.BadNumber),
        (("chr3", 5, "x", "A", "<DEL>", 1, "PASS", "SVTYPE=DEL", "GT", "0/1"), E.BadChrom),
        (("chr1", 5, "x", "A", "C", 1, "PASS", ".", "GT", "0/1"), E.MissingType),
        (("chr1", 5, "x", "A", "<BND>", 1, "PASS", "SVTYPE=BND", "GT", "0/1"), E.MissingChr2),
        (("chr1", 5, "x", "A", "<BND>", 1, "PASS", "SVTYPE=BND;CHR2=chr2", "GT", "0/1"), E.MissingAlt),
        (("chr1", 5, "x", "N", "N[chr2:5[", 1, "PASS", "SVTYPE=BND;CHR2=chr1", "GT", "0/1"), E.Chr2Mismatch),
        (("chr1", 5, "x", "A", "<DEL>", 1, "PASS", "SVTYPE=DEL", "GT:DV", "0/1:many"), E.BadFormat),
        (("chr1", 5, "x", "A", "<DEL>", 1, "PASS", "SVTYPE=DEL,DUP", "GT", "0/1"), E.BadInfoType),
        (("chr1", 5, "x"), E.BadRecord),
    ],
)
def test_bad_records(tmp_path, record, error):
    path = vcf(tmp_path / "bad.vcf", "S", [record])
    with pytest.raises(error) as e:
        list(VcfReader([path]).read(_File(0, path)))
    assert "bad.vcf" in str(e.value)


def test_multi_allelic_and_contigs(spark, tmp_path):
    two = vcf(tmp_path / "two.vcf", "S", [("chr1", 5, "x", "A", "<DEL>,<DUP>", 1, "PASS", "SVTYPE=DEL;SVLEN=-3", "GT", "0/1")])
    with pytest.raises(Exception, match="more than one alternate"):
        MV.merge_vcfs(spark, [two], str(tmp_path / "o.vcf"))
    other = vcf(tmp_path / "other.vcf", "S", [], head=HEAD.replace("chr2", "chrX"))
    with pytest.raises(E.ContigMismatch):
        read_vcfs(spark, [two, other])
    with pytest.raises(E.TooManyFiles):
        read_vcfs(spark, [two] * 65)


def test_features_and_similarity(spark, tmp_path, files):
    fasta = tmp_path / "f.fa"
    fasta.write_text(">line/l1\nCCGGTTACCGGTTAACGTACGTTT\n>alu\nTTTTGGGGCCCCAAAATTTTGGGG\n")
    MV.index_fasta(spark, str(fasta), str(tmp_path / "ix"), IndexOptions(k=5))
    got = MV.similar_features(spark, str(tmp_path / "ix"), query="CCGGTTACCGGTTAACGTACG").collect()
    assert [r["name"] for r in got] == ["line/l1"] and got[0]["fwd"] > 0.8
    rc = MV.similar_features(spark, str(tmp_path / "ix"), query="AAACGTACGTTAACCGGTAACCGG").collect()
    assert rc[0]["name"] == "line/l1" and rc[0]["rev"] == pytest.approx(1.0)
    assert MV.similar_features(spark, str(tmp_path / "ix"), vcf=files[0]).count() == 1
    assert MV.similar_features(spark, str(tmp_path / "ix"), fasta=str(fasta)).count() >= 2
    out = str(tmp_path / "c.vcf.gz")
    MV.merge_vcfs(spark, list(files), out, MergeOptions(annotation_index=str(tmp_path / "ix")))
    _, records = scan(out)
    assert sum("VW_ALT_CLASS=line/l1+" in x for x in records) == 1


def test_reference_bases(spark, tmp_path):
    fasta = tmp_path / "r.fa"
    fasta.write_text(">c\nACGT\n")
    places = spark.createDataFrame([("c", 1), ("c", 3), ("c", 4), ("d", 1)], "contig string, pos int")
    got = {(r["contig"], r["pos"]): r["base"] for r in reference_bases(places, read_fasta(spark, [str(fasta)], chunked=True)).collect()}
    assert got == {("c", 1): "A", ("c", 3): "G", ("c", 4): "N", ("d", 1): "N"}


def test_command_line_parses():
    from varweave.cli import parser

    args = parser().parse_args(["merge", "--out", "o.vcf", "--no-force-alt-tags", "a.vcf", "b.vcf"])
    assert args.vcf == ["a.vcf", "b.vcf"] and args.force_alt_tags is False
    args = parser().parse_args("merge -o o.vcf --unwanted-info A,B -u C --fill-in-refs false --write-merge-table t --annotate-insertions ix --force-alt-tags=false --threads 2 a.vcf".split())
    assert args.unwanted_info == ["A", "B", "C"] and args.fill_in_refs is False and args.merge_table == "t" and args.annotation_index == "ix" and args.threads == 2
    assert parser().parse_args("merge -o o a.vcf --force-alt-tags".split()).force_alt_tags is True
    args = parser().parse_args("index-features --features f.fa --out ix --k 9 --pattern a+ --name $1".split())
    assert (args.named_fasta, args.k, args.name_pattern, args.name_replacement) == ("f.fa", 9, "a+", "$1")
    args = parser().parse_args("find-similar --features ix --k 11 --vcf q.vcf".split())
    assert (args.index, args.query_vcf, args.query) == ("ix", "q.vcf", None)


def test_block_gzip(spark, tmp_path):
    """Every block is a gzip member that carries its own size, and the file ends with the empty block."""
    from varweave.sources.storage import END, block_gzip, open_text, write_sorted

    text = "".join(f"line {i} {i * i}\n" for i in range(20_000))
    data = block_gzip(text.encode()) + END
    at = sizes = 0
    while at < len(data):
        assert data[at : at + 4] == b"\x1f\x8b\x08\x04" and data[at + 12 : at + 14] == b"BC"
        at += int.from_bytes(data[at + 16 : at + 18], "little") + 1
        sizes += 1
    assert at == len(data) and sizes > 4 and gzip.decompress(data).decode() == text
    lines = spark.range(0, 30_000, 1, 5).selectExpr("concat('row ', lpad(id, 6, '0')) AS line").orderBy("line")
    for name in ("x.vcf", "x.vcf.gz"):
        path = str(tmp_path / name)
        write_sorted(lines, ["head"], path)
        with open_text(path) as f:
            got = f.read().split("\n")
        assert got == ["head", *[f"row {i:06d}" for i in range(30_000)], ""]
    assert [p.name for p in tmp_path.iterdir() if "parts" in p.name] == []


def test_hash_of_symbolic_insertions(spark, tmp_path):
    """A tag is hashed as it stands in the file, brackets included."""
    from varweave.functions.exprs import digest56

    path = vcf(tmp_path / "tag.vcf", "S", [("chr1", 5, "x", "A", "<INS:ME>", 1, "PASS", "SVTYPE=INS;SVLEN=3", "GT", "0/1")])
    row = read_vcfs(spark, [path])[0].first()
    assert row["seq_hash"] == digest56("<INS:ME>") and row["alt_seq"] is None


def test_similar_to_fasta_joins_no_kmers(spark, tmp_path):
    """Names that occur twice are one query; no shared k-mer is a row of a join."""
    features, asked = tmp_path / "features.fa", tmp_path / "asked.fa"
    features.write_text(">f1\nACGTTGCATGCAAGTCC\n>f2\nTTTTGGGGCCCCAAAAT\n")
    asked.write_text(">q\nACGTTGCATGC\n>q\nATGCAAGTCC\n>r\nGGACTTGCATGCAACGT\n")
    MV.index_fasta(spark, str(features), str(tmp_path / "index"), IndexOptions(k=7))
    found = MV.similar_features(spark, str(tmp_path / "index"), fasta=str(asked))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r["query_name"], r["name"], r["place"], round(r["rev"], 6)) for r in found.collect()] == [("q", "f1", 1, 0.0), ("r", "f1", 1, 1.0)]
