import random

import pytest
from pyspark.sql import functions as F

from varweave.errors import DuplicateKey
from varweave.operators import candidates as C
from varweave.operators import merging as M
from varweave.operators import ranges as R
from varweave.operators.components import pair_components
from varweave.options import MergeOptions

STATE = (
    "vix_ix int, row_id long, row_key long, vix_set long, vix_count int, criteria string, chrom_id int, chrom string, start int, `end` int, kind string, "
    "length int, chrom2_id int, chrom2 string, end2 int, seq_hash long, alt_seq string"
)


def table(spark, rows):
    """Rows of (file, row number, kind, start, end, length, chrom2_id, end2, hash)."""
    out = []
    for f, n, kind, start, end, length, c2, e2, h in rows:
        i = f + 100 * n
        bit = 1 << f
        out.append((f, i, i, bit - (1 << 64) if f == 63 else bit, 1, None, 0, "chr1", start, end, kind, length, c2, None if c2 is None else f"chr{c2}", e2, h, None))
    return spark.createDataFrame(out, STATE)


def pairs(df):
    return sorted((r["lhs_row_key"], r["rhs_row_key"]) for r in df.collect())


def test_exact_pairs(spark):
    t = table(spark, [(0, 0, "DEL", 5, 9, -4, None, None, None), (1, 0, "DEL", 5, 9, -4, None, None, None), (1, 1, "DEL", 5, 9, None, None, None, None),
                      (2, 0, "INS", 5, 5, 9, None, None, 7), (3, 0, "INS", 5, 5, 9, None, None, 7), (4, 0, "INS", 5, 5, 9, None, None, 8)])
    assert pairs(C.exact_indel_pairs(t, 64)) == [(0, 1), (2, 3)]
    assert pairs(C.exact_indel_pairs(t, 1)) == []


def test_locus_pairs(spark):
    t = table(spark, [(0, 0, "INS", 5, 5, 100, None, None, 1), (1, 0, "INS", 5, 5, 95, None, None, 2), (2, 0, "INS", 5, 5, 200, None, None, 3), (3, 0, "INS", 5, 5, None, None, None, 4), (4, 0, "INS", 5, 5, None, None, None, 5)])
    assert pairs(C.locus_ins_pairs(t, 64, MergeOptions())) == [(0, 1), (0, 3), (0, 4), (1, 3), (1, 4), (2, 3), (2, 4)]


def test_bnd_windows_are_strict(spark):
    base = (0, 0, "BND", 1000, 1000, None, 2, 5000, None)
    for d, d2, here, there in [(24, 149, True, False), (25, 149, False, False), (24, 150, False, False), (149, 24, False, True), (0, 0, True, True)]:
        t = table(spark, [base, (1, 0, "BND", 1000 + d, 1000 + d, None, 2, 5000 + d2, None)])
        assert bool(pairs(C.bnd_here_there_pairs(t, 64, MergeOptions()))) == here
        assert bool(pairs(C.bnd_there_here_pairs(t, 64, MergeOptions()))) == there
    unknown = table(spark, [(0, 0, "BND", 1, 1, None, None, 5, None), (1, 0, "BND", 1, 1, None, None, 5, None)])
    assert pairs(C.exact_bnd_pairs(unknown, 64)) == []


def test_near_window_is_closed(spark):
    for d, want in [(25, True), (26, False)]:
        t = table(spark, [(0, 0, "DEL", 100, 200, -100, None, None, None), (63, 0, "DEL", 100 + d, 200, -100, None, None, None)])
        assert bool(pairs(C.near_pairs(t, 64, MergeOptions()))) == want
    same_file = table(spark, [(0, 0, "DEL", 100, 200, -100, None, None, None), (0, 1, "DEL", 100, 200, -100, None, None, None)])
    assert pairs(C.near_pairs(same_file, 64, MergeOptions())) == []


def test_band_and_overlap_by_brute_force(spark):
    rng = random.Random(5)
    a = [(i, rng.randrange(3), rng.randrange(-50, 4000)) for i in range(80)]
    b = [(i, rng.randrange(3), rng.randrange(-50, 4000)) for i in range(80)] + [(99, None, 5), (98, 1, None)]
    l, r = spark.createDataFrame(a, "i int, g int, x int"), spark.createDataFrame(b, "j int, h int, y int")
    got = sorted((q["i"], q["j"]) for q in R.band_join(l, r, [("g", "h")], "x", "y", 40, F.lit(True)).collect())
    assert got == sorted((i, j) for i, g, x in a for j, h, y in b if g == h and y is not None and abs(x - y) <= 40)
    sizes = [0, 3, 500, 5000, 60000, 2000000]
    a = [(i, rng.randrange(2), s := rng.randrange(300000), s + rng.choice(sizes)) for i in range(90)]
    b = [(i, rng.randrange(2), s := rng.randrange(300000), s + rng.choice(sizes)) for i in range(90)] + [(95, 1, None, 7), (96, 0, 50, 20)]
    l, r = spark.createDataFrame(a, "i int, g int, x long, x2 long"), spark.createDataFrame(b, "j int, h int, y long, y2 long")
    got = sorted((q["i"], q["j"]) for q in R.overlap_join(l, r, ["g"], ["h"], ("x", "x2"), ("y", "y2")).collect())
    want = sorted((i, j) for i, g, x, x2 in a for j, h, y, y2 in b if g == h and y is not None and x <= y2 and y <= x2)
    assert got == want and len(got) == len(set(got))


def test_nearest_and_within(spark):
    keys = spark.createDataFrame([(k,) for k in (2, 3, 5, 8, 11)] + [(None,)], "k long")
    points = spark.createDataFrame([(2,), (4,), (7,), (100,), (-9,), (None,)], "x long")
    got = {r["x"]: r["nearest"] for r in R.nearest(points, keys, "x", "k").collect()}
    assert got == {2: 2, 4: 3, 7: 8, 100: 11, -9: 2, None: None}
    for d, want in [(2, [3, 5]), (3, [3, 5, 2])]:
        rows = R.within(spark.createDataFrame([(4,)], "x long"), keys, "x", "k", d).orderBy("rank").collect()
        assert [r["near_key"] for r in rows] == want
    assert R.nearest(points, keys.limit(0), "x", "k").filter("nearest IS NOT NULL").count() == 0
    with pytest.raises(DuplicateKey):
        R.nearest(points, keys.unionByName(keys), "x", "k")


def test_nearest_by_brute_force(spark):
    rng = random.Random(8)
    ks = sorted(rng.sample(range(10000), 300))
    xs = [rng.randrange(-50, 10500) for _ in range(200)]
    got = [(r["x"], r["nearest"]) for r in R.nearest(spark.createDataFrame([(x,) for x in xs], "x long"), spark.createDataFrame([(k,) for k in ks], "k long"), "x", "k").collect()]
    assert sorted(got) == sorted((x, min(ks, key=lambda k: (abs(k - x), k))) for x in xs)


def greedy(rows, lower_wins):
    fold = M.Fold(lower_wins)
    for lhs, fl, cl, rhs, fr, cr in sorted(set(rows), key=lambda p: (-(p[2] + p[5]), p[0], p[3])):
        fold.offer(lhs, fl, rhs, fr)
    return sorted(fold.updates())


@pytest.mark.parametrize("lower_wins", [False, True])
def test_merge_updates_as_the_global_fold(spark, lower_wins):
    rng = random.Random(3)
    files = {k: 1 << rng.randrange(6) for k in range(60)}
    rows = []
    for _ in range(150):
        a, b = sorted(rng.sample(range(60), 2))
        if files[a] != files[b]:
            rows.append((a, files[a], 1, b, files[b], 1))
    df = spark.createDataFrame(rows, "lhs_row_key long, lhs_vix_set long, lhs_vix_count int, rhs_row_key long, rhs_vix_set long, rhs_vix_count int")
    got = sorted(tuple(r) for r in M.merge_updates(df, lower_wins).collect())
    assert got == greedy(rows, lower_wins)


def test_merge_rounds_hold_invariants(spark):
    rng = random.Random(11)
    rows = [(f, n, rng.choice(["DEL", "INS"]), s := rng.choice([100, 110, 130, 500]), s + 50, 50, None, None, rng.randrange(2)) for f in range(6) for n in range(5)]
    t = table(spark, rows)
    out = M.merge_all(t, 6, MergeOptions()).collect()
    assert sorted(r["row_id"] for r in out) == sorted(r["row_id"] for r in t.collect())
    groups = {}
    for r in out:
        groups.setdefault(r["row_key"], []).append(r)
    assert len(groups) < len(out)
    for members in groups.values():
        files = [m["vix_ix"] for m in members]
        assert len(files) == len(set(files))
        assert all(m["vix_set"] == sum(1 << f for f in files) and m["vix_count"] == len(files) for m in members)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(30)] + [(300, 300), (None, 4)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["key"]: r["component"] for r in pair_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {k: find(k) for k in parent}
    one = pair_components(spark.createDataFrame(edges, "a long, b long").coalesce(1), "a", "b").collect()
    assert {r["key"]: r["component"] for r in one} == got and len(one) == len(got)
    assert pair_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_components_that_do_not_settle_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").repartition(4)
    with pytest.raises(RuntimeError, match="settle"):
        pair_components(chain, "a", "b", max_rounds=1)


def test_hot_cells_are_split(spark):
    """A third of all rows in one cell: the same pairs, whatever a cell may hold."""
    rng = random.Random(6)
    a = [(i, "c", 500 + rng.randrange(20) if i % 3 == 0 else rng.randrange(10_000)) for i in range(150)]
    b = [(i, "c", 500 + rng.randrange(20) if i % 3 == 0 else rng.randrange(10_000)) for i in range(150)]
    lhs, rhs = spark.createDataFrame(a, "i long, g string, x int"), spark.createDataFrame(b, "j long, h string, y int")
    want = sorted((i, j) for i, _, x in a for j, _, y in b if abs(x - y) <= 9)
    for rows in (20_000, 5):
        assert sorted((r["i"], r["j"]) for r in R.band_join(lhs, rhs, [("g", "h")], "x", "y", 9, F.lit(True), "i", rows).collect()) == want
    lhs, rhs = lhs.withColumn("x2", F.col("x") + 700), rhs.withColumn("y2", F.col("y") + F.pmod("j", F.lit(7)) * 100)
    want = sorted((i, j) for i, _, x in a for j, _, y in b if x <= y + j % 7 * 100 and y <= x + 700)
    for rows in (20_000, 5):
        assert sorted((r["i"], r["j"]) for r in R.overlap_join(lhs, rhs, ["g"], ["h"], ("x", "x2"), ("y", "y2"), cell_rows=rows).collect()) == want


def test_nearest_of_one_hot_point(spark):
    points = spark.createDataFrame([(i, 50) for i in range(300)] + [(i, i) for i in range(300, 400)] + [(900, None)], "i long, x int").repartition(4)
    keys = spark.createDataFrame([(10,), (50,), (52,), (350,), (None,)], "k int")
    got = {r["i"]: r["nearest"] for r in R.nearest(points, keys, "x", "k").collect()}
    ks = [10, 50, 52, 350]
    assert got == {**{i: 50 for i in range(300)}, **{i: min(ks, key=lambda k: (abs(k - i), k)) for i in range(300, 400)}, 900: None}


def test_places(spark):
    from varweave.operators.ordering import with_place

    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("a"))
    assert all(r["a"] == r["place"] for r in with_place(df, ["a"]).collect()) and with_place(df.limit(0), ["a"]).count() == 0


def test_within_by_brute_force(spark):
    """Keys on both sides of the partitions' borders, a point of many rows, ties; pairs are made without a join or a window."""
    rng = random.Random(12)
    ks = sorted(rng.sample(range(-200, 3000), 500))
    xs = [(i, rng.randrange(-260, 3100)) for i in range(150)] + [(i, 700) for i in range(150, 300)] + [(300, None), (3, 9), (3, 9)]
    points = spark.createDataFrame(xs, "i int, x int").repartition(4)
    keys = spark.createDataFrame([(k,) for k in ks] + [(None,)], "k int")
    for d in (1, 40, 5000):
        df = R.within(points, keys, "x", "k", d)
        want = [(i, x, k, n + 1) for i, x in set(xs) if x is not None for n, k in enumerate(sorted((k for k in ks if abs(k - x) < d), key=lambda k: (abs(k - x), k)))]
        assert sorted(map(tuple, df.collect())) == sorted(want)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Window" not in plan
    assert df.dtypes == [("i", "int"), ("x", "int"), ("near_key", "int"), ("rank", "int")]
    assert R.within(points.filter("x IS NULL"), keys, "x", "k", 40).count() == 0
