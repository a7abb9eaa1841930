"""Quarantine loading, drifting schemas and eager aggregation, with their edge cases."""

import itertools
import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varweave.operators import eager, quarantine, schema_drift

CONTIGS = [(0, "chr1", 1000), (1, "chr2", 50), (1, "chr2", 20)]


def line(kind="DEL", chrom2="", end2="", alt="", rest="r1", extra=""):
    return f"1,chr1,5,9,{kind},-4,{chrom2},{end2},{alt},{rest}{extra}"


LINES = [
    (line(), None),
    (line(rest='"a,b"'), None),
    (line(rest='"a ""q"" b"'), None),
    (line(rest='"two\nlines"'), None),
    (line(rest="bare\nbreak"), None),
    (line(rest="cr\r"), None),
    (line(rest=""), None),
    (line(rest='""'), None),
    (line(kind='"INS"', alt='"ACGTn*"'), None),
    (line(kind="BND", chrom2="chr2", end2="0050"), None),
    (line(rest='a"b'), "quoting"),
    (line(rest='"a"b'), "quoting"),
    (line(rest='"a'), "quoting"),
    (line(rest=' "a"'), "quoting"),
    (line(extra=",more"), "columns"),
    ("1,2,3", "columns"),
    ("", "columns"),
    (None, "columns"),
    ('1,2,"3', "quoting"),
    (line(kind="BND", chrom2="chr9", end2="5"), "chrom2"),
    (line(kind="BND", chrom2="chr2 ", end2="5"), "chrom2"),
    (line(kind="BND", chrom2="", end2="5"), "chrom2"),
    (line(chrom2="chr1"), "chrom2"),
    (line(chrom2=" "), "chrom2"),
    (line(kind="BND", chrom2="chr2", end2="51"), "end2"),
    (line(kind="BND", chrom2="chr2", end2="0"), "end2"),
    (line(kind="BND", chrom2="chr2", end2="+5"), "end2"),
    (line(kind="BND", chrom2="chr2", end2="٣"), "end2"),
    (line(kind="BND", chrom2="chr2", end2="9" * 40), "end2"),
    (line(kind="BND", chrom2="chr2", end2=""), "end2"),
    (line(end2="7"), "end2"),
    (line(alt="ACGT"), "alt_seq"),
    (line(kind="INS", alt="ACGU"), "alt_seq"),
    (line(kind="BND", chrom2="chr2", end2="5", alt="N[chr2:5["), "alt_seq"),
    (line(kind="ins", alt="ACGT"), "alt_seq"),
]


@pytest.mark.parametrize("copies", [1, 60])
def test_reasons(spark, copies):
    rows = [(i * 1000 + c, x, "extra", "more") for c in range(copies) for i, (x, _) in enumerate(LINES)]
    lines = spark.createDataFrame(rows, "line_id long, raw_line string, reason string, fault string")
    contigs = spark.createDataFrame(CONTIGS, "chrom_id int, chrom string, contig_length long")
    out = {r["line_id"]: r for r in quarantine.load_variant_lines(lines, contigs).collect()}
    assert len(out) == len(rows)
    for i, (text, want) in enumerate(LINES):
        for c in range(copies):
            assert out[i * 1000 + c]["reason"] == want, text
    assert out[1000]["rnames"] == "a,b" and out[2000]["rnames"] == 'a "q" b' and out[3000]["rnames"] == "two\nlines" and out[5000]["rnames"] == "cr\r" and out[7000]["rnames"] is None
    good = quarantine.valid_variants(quarantine.load_variant_lines(lines, contigs))
    assert good.count() == copies * sum(w is None for _, w in LINES) and dict(good.dtypes)["start"] == "int"


def test_no_lines(spark):
    lines = spark.createDataFrame([], "line_id long, raw_line string")
    contigs = spark.createDataFrame([], "chrom_id int, chrom string, contig_length long")
    assert quarantine.load_variant_lines(lines, contigs).count() == 0


@given(st.lists(st.text('a",\n', max_size=14), max_size=40))
@settings(max_examples=80, deadline=None)
def test_blocks_agree_with_the_strict_reader(texts):
    names = ["x", "y", "z"]
    columns, faults = quarantine.parse_lines(pa.array(texts, pa.string()), names)
    for i, t in enumerate(texts):
        fields = quarantine.strict_fields(t)
        want = "quoting" if fields is None else None if len(fields) == 3 else "columns"
        assert faults[i].as_py() == want
        if want is None:
            assert [c[i].as_py() or "" for c in columns] == fields


def test_long_line(spark):
    text = line(rest='"' + "x," * 400_000 + '"')
    lines = spark.createDataFrame([(1, text)], "line_id long, raw_line string")
    contigs = spark.createDataFrame(CONTIGS, "chrom_id int, chrom string, contig_length long")
    row = quarantine.load_variant_lines(lines, contigs).first()
    assert row["reason"] is None and len(row["rnames"]) == 800_000


# Drifting schemas


def declare(section, name, number="1", kind="Integer", said="words"):
    return f'##{section}=<ID={name},Number={number},Type={kind},Description="{said}">'


def changes(old, new):
    a, b = schema_drift.parse_header("\n".join(old)), schema_drift.parse_header("\n".join(new))
    return sorted(x[:3] for x in schema_drift.section_changes(schema_drift.edit_script(a, b)))


def test_scripts():
    a, b = declare("INFO", "A", said="Some depth"), declare("INFO", "B", kind="Float", said="other")
    assert changes([a, b], [b, a, a]) == []
    assert changes([a, b], [b, '##INFO=<ID=A, Type=integer, Number=1, Description="SOME  depth.", Source="x">', "##FILTER=<ID=q>"]) == []
    assert changes([a], [declare("INFO", "A2", said="some depth")]) == [("INFO", "A2", "renamed")]
    assert changes([a], [declare("INFO", "A2", kind="Float", said="some depth")]) == [("INFO", "A2", "renamed"), ("INFO", "A2", "retyped")]
    assert changes([a], [declare("FORMAT", "A2", said="some depth")]) == [("FORMAT", "A2", "added"), ("INFO", "A", "removed")]
    assert changes([a], [a, declare("INFO", "C", said="some depth")]) == [("INFO", "C", "added")]
    assert changes([a], [declare("INFO", "A", number="2", said="another text")]) == [("INFO", "A", "retyped")]
    assert changes([a], [declare("INFO", "X", said="nothing alike")]) == [("INFO", "A", "removed"), ("INFO", "X", "added")]
    # Of two gone fields with one description the cheaper one is the renamed one.
    two = [declare("INFO", "A", kind="Float", said="d"), declare("INFO", "B", said="d")]
    assert changes(two, [declare("INFO", "N", said="d")]) == [("INFO", "A", "removed"), ("INFO", "N", "renamed")]
    quoted = '##INFO=<ID=Q,Number=1,Type=String,Description="of \\"soft\\" ends, if > 1">'
    assert schema_drift.parse_header(quoted)["INFO"]["Q"] == ("1", "string", "ofsoftendsif1")
    assert changes([quoted + "\r"], [quoted]) == []


def mappings(old, now):
    """The least cost over all mappings of the old fields to new ones, as the module's costs are defined."""
    a = [(s, i) for s in schema_drift.SECTIONS for i in old[s]]
    b = [(s, i) for s in schema_drift.SECTIONS for i in now[s]]

    def cost(x, y):
        p, q = old[x[0]][x[1]], now[y[0]][y[1]]
        leaves = (p[0] != q[0]) + (p[1] != q[1])
        if x[0] != y[0]:
            return schema_drift.MOVE if x[1] == y[1] and p == q else 1000
        if x[1] == y[1]:
            return leaves + (p[2] != q[2])
        return schema_drift.RENAME + leaves if p[2] == q[2] != "" else 1000

    def least(i, free):
        if i == len(a):
            return schema_drift.WHOLE * len(free)
        best = schema_drift.WHOLE + least(i + 1, free)
        return min([best] + [cost(a[i], y) + least(i + 1, free - {y}) for y in free if cost(a[i], y) < 1000])

    return least(0, frozenset(b))


def test_scripts_cost_least():
    rng = random.Random(13)
    tree = lambda: {s: {i: (rng.choice("12"), rng.choice(["integer", "float"]), rng.choice(["x", "y", "z", ""])) for i in rng.sample("ABCDE", rng.randrange(5))} for s in schema_drift.SECTIONS}
    moved = 0
    for _ in range(300):
        old, now = tree(), tree()
        script = schema_drift.edit_script(old, now)
        assert schema_drift.script_cost(script, old, now) == mappings(old, now), (old, now)
        moved += any(e[2] == "moved" for e in script)
    assert moved > 3


def test_moves():
    a = declare("INFO", "A", said="Some depth")
    trees = [schema_drift.parse_header(x) for x in (a, a.replace("INFO", "FORMAT"))]
    script = schema_drift.edit_script(*trees)
    assert script == [("FORMAT", "A", "moved", "INFO")] and schema_drift.script_cost(script, *trees) == schema_drift.MOVE
    assert sorted(x[:3] for x in schema_drift.section_changes(script)) == [("FORMAT", "A", "added"), ("INFO", "A", "removed")]


def test_series(spark):
    t0 = datetime(2024, 1, 1)
    rng = random.Random(1)
    rows, want = [], []
    for s in range(6):
        last = None
        for i in range(30 if s else 400):
            names = sorted(rng.sample("ABCDEFGH", 5))
            header = "\n".join(declare("INFO", n, said=f"about {n}") for n in names) if rng.random() > 0.1 else rng.choice([None, "", "  "])
            file_id = s * 1000 + i
            row = (file_id, f"s{s}", t0 + timedelta(hours=i), header, "x")
            rows += [row] * rng.choice([1, 1, 2])
            if header and header.strip():
                if last is not None:
                    want += [(file_id, "INFO", n, "added") for n in names if n not in last] + [(file_id, "INFO", n, "removed") for n in last if n not in names]
                last = names
    rows += [(90001, None, t0, declare("INFO", "Z"), "x"), (None, "s0", t0, declare("INFO", "Z"), "x")]
    rng.shuffle(rows)
    files = spark.createDataFrame(rows, "file_id long, series string, written_at timestamp, header string, change string").repartition(7)
    for coalesced in ("true", "false"):
        # Without coalescing the files lie in several partitions, and some changes cross their borders.
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
        try:
            got = schema_drift.schema_changes(files).select("file_id", "section", "field", "change").collect()
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert sorted(tuple(r) for r in got) == sorted(want)
    assert schema_drift.schema_changes(files.limit(0)).count() == 0


def test_pairing_is_cheapest_at_every_size():
    cost = lambda pairs, old, now: sum(schema_drift._attribute_cost(old[a], now[b]) for a, b in pairs)
    same = {f"F{i}": ("9", "flag", "x") for i in range(6)}
    old = {"A1": ("1", "integer", "x"), "A2": ("1", "string", "x")} | same
    now = {"B1": ("1", "float", "x"), "B2": ("2", "integer", "x")} | {f"G{k[1:]}": v for k, v in same.items()}
    pairs = schema_drift._pair(list(old), list(now), old, now)
    assert pairs[:2] == [("A1", "B2"), ("A2", "B1")] and cost(pairs, old, now) == 2
    rng = random.Random(8)
    for n, m in [(1, 1), (3, 5), (5, 3), (6, 6), (4, 8), (8, 4)] * 4:
        draw = lambda p, k: {f"{p}{i}": (rng.choice("012"), rng.choice(["integer", "float", "string"]), "x") for i in range(k)}
        old, now = draw("A", n), draw("B", m)
        a, b = (old, now) if n <= m else (now, old)
        best = min(itertools.permutations(sorted(b), len(a)), key=lambda p: cost(zip(sorted(a), p), a, b))
        want = list(zip(sorted(a), best))
        assert schema_drift._pair(list(old), list(now), old, now) == (want if n <= m else [(y, x) for x, y in want])
    old, now = draw("A", 300), draw("B", 280)
    assert len(schema_drift._pair(list(old), list(now), old, now)) == 280


# Eager aggregation


@pytest.mark.parametrize("how", ["inner", "left"])
def test_eager_as_the_plain_join(spark, how):
    rng = random.Random(6)
    pick = lambda: rng.choice([1, 1, 1, 1, 2, 3, None])
    a = spark.createDataFrame([(pick(), rng.choice(["x", "y", None]), rng.choice([None, 2, 3]), 1) for _ in range(60)], "k int, g string, v int, n_pairs int")
    b = spark.createDataFrame([(rng.choice([1, 1, 2, None, 9]), rng.choice([None, 5, 7]), "z") for _ in range(40)], "k int, w int, g string")
    got = eager.eager_join_aggregate(a, b, ["k"], ["g"], {"v": "v"}, {"w": "w"}, how)
    joined = a.alias("a").join(b.alias("b"), F.col("a.k") == F.col("b.k"), how)
    want = joined.groupBy(F.col("a.g").alias("g")).agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("a.v").alias("v"), F.sum("b.w").alias("w"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert eager.eager_join_aggregate(a.limit(0), b, ["k"], ["g"]).count() == 0


def test_heavy_keys(spark):
    states = spark.createDataFrame([(1, "a", 40), (1, None, 500), (2, "b", 41), (None, "c", 100)], "x int, y string, n long")
    assert [tuple(r) for r in eager.heavy_keys(states, ["x", "y"], 1000, 0.04, "n").collect()] == [(2, "b")]


def test_consistent_table(spark):
    t0 = datetime(2024, 1, 1)
    rng = random.Random(4)
    rows, want = [], {}
    for s in range(3):
        live = {f"F{k}": f"F{k}" for k in range(4)}
        for i in range(120):
            if i and rng.random() < 0.3:
                x = rng.choice(sorted(live))
                y = f"N{i}"
                live[y] = live.pop(x)
            for name, first in live.items():
                want[s * 1000 + i, name] = first
            header = "\n".join(declare("INFO", n, said=f"about {first}") for n, first in live.items())
            rows.append((s * 1000 + i, f"s{s}", t0 + timedelta(hours=i), header, ";".join(f"{n}={i}" for n in live)))
    rows += rows[:20]
    rng.shuffle(rows)
    files = spark.createDataFrame(rows, "file_id long, series string, written_at timestamp, header string, first_info string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = schema_drift.consistent_table(files).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == len(want) and {(r["file_id"], r["declared"]): r["field"] for r in got} == want
    assert all(r["value"] == str(r["file_id"] % 1000) and r["type"] == "integer" for r in got)
    assert schema_drift.consistent_table(files.limit(0)).count() == 0


def test_types_that_all_files_share(spark):
    t0 = datetime(2024, 1, 1)
    heads = [[declare("INFO", "D", said="depth"), declare("INFO", "F", "0", "Flag", "a flag"), declare("INFO", "S", ".", said="a list")], [declare("INFO", "DP", kind="Float", said="depth"), declare("INFO", "S", ".", said="a list")]]
    rows = [(1, "s", t0, "\n".join(heads[0]), "D=5;F;S=1,2"), (2, "s", t0 + timedelta(1), "\n".join(heads[1]), "DP=2.5;S=."), (3, "t", t0, heads[0][0], "D=x"), (4, "t", None, None, None)]
    files = spark.createDataFrame(rows, "file_id long, series string, written_at timestamp, header string, first_info string")
    table = schema_drift.consistent_table(files)
    got = {(r["file_id"], r["field"]): (r["declared"], r["common_type"], r["value"], r["value_int"], r["value_float"], r["value_flag"]) for r in table.collect()}
    assert got == {
        (1, "D"): ("D", "double", "5", None, 5.0, None), (1, "F"): ("F", "boolean", "", None, None, True), (1, "S"): ("S", "string", "1,2", None, None, None),
        (2, "D"): ("DP", "double", "2.5", None, 2.5, None), (2, "S"): ("S", "string", ".", None, None, None), (3, "D"): ("D", "bigint", "x", None, None, None),
    }
    wide = schema_drift.wide_table(table, 0.6)
    assert dict(wide.dtypes) == {"file_id": "bigint", "series": "string", "info_D": "double", "info_S": "string"}
    assert sorted(map(tuple, wide.collect())) == [(1, "s", 5.0, "1,2"), (2, "s", 2.5, "."), (3, "t", None, None)]


def test_hot_keys_are_split(spark):
    from varweave.operators import skew

    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 100), (None, 101), (9, 102)], "a int, x int")
    right = spark.createDataFrame([(1, "p"), (1, "q"), (2, "r"), (None, "s")], "b int, y string")
    assert skew.hot_keys(left, ["a"], 10) == [(1, 5)] and skew.hot_keys(left, ["a"], 1, most=1) == [(1, 50)] and skew.hot_keys(left.limit(0), ["a"]) == []
    for how in ("inner", "left"):
        plain = sorted(map(repr, left.join(right, F.col("a") == F.col("b"), how).collect()))
        assert sorted(map(repr, skew.salted_join(left, right, [("a", "b")], F.col("x"), how, split_rows=10).collect())) == plain
