import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varweave import errors as E
from varweave.functions import exprs as X
from varweave.functions import kmers as K
from varweave.functions.align import align, align_score
from varweave.options import MergeOptions, QueryOptions
from varweave.schema import decode_row_id, encode_row_id, file_bit, union_files


def one(spark, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) if not hasattr(v, "_jc") else v.alias(k) for k, v in cols.items()])


def test_row_ids_and_bits(spark):
    df = spark.createDataFrame([(0, 5), (63, 7)], "v int, n long").withColumn("id", encode_row_id(F.col("v"), F.col("n"))).withColumn("bit", file_bit(F.col("v")))
    v, n = decode_row_id(F.col("id"))
    assert [tuple(r) for r in df.select("id", v, n, "bit", F.bit_count("bit")).collect()] == [(500, 0, 5, 1, 1), (763, 63, 7, -(1 << 63), 1)]


def test_too_many_files(spark):
    with pytest.raises(E.TooManyFiles):
        union_files([spark.range(1)] * 65)
    with pytest.raises(E.TooManyFiles):
        union_files([])


def test_pmin_pmax_ifelse_null(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (None, 1)], "a int, b int")
    a, b = F.col("a"), F.col("b")
    assert [tuple(r) for r in df.select(X.pmin(a, b), X.pmax(a, b), X.ifelse(a < b, F.lit("y"), F.lit("n"))).collect()] == [(1, 2, "y"), (1, 2, "n"), (None, None, None)]


@pytest.mark.parametrize(
    "alt,want",
    [
        ("A[chr2:7[", ("chr2", 7, "After", "After")),
        ("A]chr2:7]", ("chr2", 7, "After", "Before")),
        ("]chr2:7]A", ("chr2", 7, "Before", "Before")),
        ("[chr2:7[A", ("chr2", 7, "Before", "After")),
        ("<DEL>", None),
        ("", None),
        (None, None),
    ],
)
def test_breakends(spark, alt, want):
    df = spark.createDataFrame([(alt,)], "alt string").select(X.parse_breakend(F.col("alt")).alias("b"))
    got = df.first()["b"]
    assert (tuple(got) if got else None) == want
    if want:
        base = F.lit("A")
        text = df.select(X.format_breakend(F.col("b.side"), F.col("b.side2"), F.col("b.chrom2"), F.col("b.end2"), base)).first()[0]
        assert text == alt


def test_kinds(spark):
    rows = [("INS:ME", "A", "AC", 1, "INS"), (None, "A", "ACG", 1, "INS"), (None, "ACG", "A", 1, "DEL"), (None, "N", "N[c:1[", 1, "BND"), (None, "A", "C", 1, None), (None, "A", "AC", 2, None)]
    df = spark.createDataFrame(rows, "s string, r string, a string, n int, want string")
    assert df.filter(~X.infer_kind(F.col("s"), F.col("r"), F.col("a"), F.col("n")).eqNullSafe(F.col("want"))).count() == 0
    df = spark.createDataFrame([(" ins", "INS"), ("<DEL>", "DEL"), ("Deletion", "DEL"), ("BND:TRA", "BND"), ("breakend", "BND"), (None, None)], "k string, want string")
    assert df.filter(~X.standard_kind(F.col("k")).eqNullSafe(F.col("want"))).count() == 0


def test_length_agreement(spark):
    rows = [(100, 95, True), (40, 60, True), (100, 200, False), (100, None, True), (None, None, False), (-100, 95, True), (0, 0, True)]
    df = spark.createDataFrame(rows, "a int, b int, want boolean")
    assert df.filter(X.length_agrees(F.col("a"), F.col("b"), 0.9, 25) != F.col("want")).count() == 0


def test_base62_and_digest(spark):
    assert X.base62_text((61).to_bytes(16, "big") + (62).to_bytes(16, "big")) == "z10"
    got = spark.createDataFrame([(bytearray(b"\x01"), "ACGT"), (None, None)], "b binary, s string").select(X.base62("b"), X.seq_digest("s")).collect()
    assert tuple(got[0]) == ("1", int.from_bytes(hashlib.blake2b(b"ACGT").digest()[:7], "big")) and tuple(got[1]) == (None, None)


def test_alignment(spark):
    assert [align_score("ACGTACGT", x) for x in ("ACGTACGT", "ACGAACGT", "ACGACGT")] == [16, 11, 9]
    rng = random.Random(4)
    tail = "".join(rng.choice("ACGT") for _ in range(127))
    assert align_score(tail, "GT" + tail) >= 254 - 7
    assert [r[0] for r in spark.createDataFrame([("A", "A"), (None, "A")], "a string, b string").select(align("a", "b")).collect()] == [2, None]


@given(st.text("ACGT", max_size=9), st.text("ACGT", max_size=9))
@settings(max_examples=60, deadline=None)
def test_alignment_by_cells(x, y):
    n, m = len(x), len(y)
    gap = lambda t: -5 - 2 * (t - 1)
    s = [[0] * (m + 1) for _ in range(n + 1)]
    a = [[0] * (m + 1) for _ in range(n + 1)]
    b = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        s[i][0] = a[i][0] = gap(i)
    for j in range(1, m + 1):
        s[0][j] = b[0][j] = gap(j)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            s[i][j] = max(s[i - 1][j - 1], a[i - 1][j - 1], b[i - 1][j - 1]) + (2 if x[i - 1] == y[j - 1] else -3)
            a[i][j] = max(s[i - 1][j] - 5, a[i - 1][j] - 2)
            b[i][j] = max(s[i][j - 1] - 5, b[i][j - 1] - 2)
    assert align_score(x, y) == s[n][m]


def test_kmer_basics():
    assert K.make("CGAT") == 0b01100011 and K.make("CGXT") is None and K.make("A" * 33) is None and K.make("T" * 32) == -1 and K.make("A" * 32) == 0 and K.make("") == 0
    assert K.render(4, 0b01100011) == "CGAT"


def test_kmer_tables(spark):
    df = spark.createDataFrame([("a", "ACGTNACG"), ("b", "AC"), ("c", None), ("d", ""), ("a", "acg")], "name string, seq string")
    lists = {r["name"]: r["kmers"] for r in K.kmer_lists(df.filter("seq <> 'acg' OR seq IS NULL"), "seq", 3).collect()}
    assert [K.render(3, x) for x in lists["a"]] == ["ACG", "CGT", "ACG"] and lists["b"] == [] and lists["c"] is None and lists["d"] == []
    counts = {(r["name"], r["strand"], K.render(3, r["kmer"])): r["count"] for r in K.kmer_counts(df, "name", "seq", 3, "+-").collect()}
    assert counts == {("a", "+", "ACG"): 3, ("a", "+", "CGT"): 1, ("a", "-", "CGT"): 3, ("a", "-", "ACG"): 1}
    pos = sorted((r["last"], K.render(3, r["kmer"]), K.render(3, r["rc_kmer"])) for r in K.kmer_positions(df.filter("name = 'a' AND seq <> 'acg'"), "name", "seq", 3).collect())
    assert pos == [(2, "ACG", "CGT"), (3, "CGT", "ACG"), (7, "ACG", "CGT")]
    vec = {r["name"]: r["freqs"] for r in K.frequency_vectors(df, "name", "seq", 2).collect()}
    assert len(vec["a"]) == 16 and vec["a"][K.make("CG")] == 3 and sum(vec["b"]) == 1 and sum(vec["c"]) == 0
    with pytest.raises(ValueError):
        K.kmer_counts(df, "name", "seq", 33)


def test_kmer_bits(spark):
    x, y = K.make("CTTTCTGGGGC"), K.make("CTATGTGGCGC")
    row = one(spark, x=F.lit(x), y=F.lit(y)).select(K.hamming(F.col("x"), F.col("y")), K.reverse_complement(11, F.col("x")), K.reverse(11, F.col("x"))).first()
    assert row[0] == 3 and K.render(11, row[1]) == "GCCCCAGAAAG" and K.render(11, row[2]) == "CTTTCTGGGGC"[::-1]


def test_options_and_errors():
    with pytest.raises(E.OptionError):
        MergeOptions(fill_in_refs=True)
    with pytest.raises(E.OptionError):
        QueryOptions()
    with pytest.raises(E.OptionError):
        QueryOptions(query="A", query_fasta="b")
    assert not MergeOptions().fills and MergeOptions(reference="x.fa").fills
    e = E.BadChrom("chr9").within("variant chr9:5").within("file a.vcf")
    assert str(e) == "file a.vcf: variant chr9:5: undeclared contig: chr9" and isinstance(e, E.BadChrom)


def test_align_many_as_one():
    from varweave.functions.align import align_score, align_scores

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 1, 2, 7, 8, 30, 61])))
    pairs = [(word(), word()) for _ in range(200)] + [("ACGT" * 9, "ACGT" * 9)]
    assert align_scores(*map(list, zip(*pairs))).tolist() == [align_score(a, b) for a, b in pairs]
