import random

import pytest
from pyspark.sql import functions as F

from varweave.llm.near_duplicates import near_duplicate_pairs, sv_type

SCHEMA = "row_id long, vix_ix int, chrom_id int, kind string, start int, `end` int, length int, k long, a string"


def brute(rows):
    recs = {}
    for i, f, c, kind, s, e, n, *_ in rows:
        if None not in (i, f, c, kind, s, e):
            lo, hi = min(s, e), max(s, e)
            recs[i] = (f, c, kind, lo, hi, abs(n) if n is not None else hi - lo)
    out = []
    ids = sorted(recs)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = recs[i], recs[j]
            if a[0] != b[0] and a[1:3] == b[1:3] and abs(a[3] - b[3]) <= 25 and abs(a[4] - b[4]) <= 25:
                small, large = sorted((a[5], b[5]))
                if large - small <= 25 or 10 * small >= 9 * large:
                    out.append((i, j))
    return out


@pytest.mark.parametrize("split_rows,cells,fine", [(2000, (32, 32, 16), (4, 4, 4)), (40, (8, 8, 4), (3, 3, 3)), (7, (4, 32, 3), (4, 3, 5)), (1, (32, 32, 16), (4, 4, 4))])
def test_as_brute_force(spark, split_rows, cells, fine):
    rng = random.Random(split_rows)
    rows = []
    for i in range(700):
        s = rng.choice([1000, 1040, 416 * 5 - 3, 416 * 9, 70_000]) + rng.randrange(-40, 40)
        e = s + rng.choice([0, 5, 300, 320, 5000, -300])
        n = rng.choice([None, 0, 24, 25, 50, 237, 262, 300, -300, 330, 334, 5000, 5500])
        rows.append((i, rng.randrange(4), rng.choice([1, 2]), rng.choice(["INS", "DEL"]), s, e, n, 1, "x"))
    rows += rows[:50]
    rows += [(None, 1, 1, "INS", 1, 1, 1, 1, "x"), (9001, None, 1, "INS", 1, 1, 1, 1, "x"), (9002, 1, None, "INS", 1, 1, 1, 1, "x"), (9003, 1, 1, None, 1, 1, 1, 1, "x"), (9004, 1, 1, "INS", None, 1, 1, 1, "x")]
    got = [tuple(r) for r in near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA), F.col("kind"), cells=cells, fine_cells=fine, split_rows=split_rows, sample=1).collect()]
    assert len(got) == len(set(got)) and sorted(got) == sorted(brute(rows))


def test_boundaries(spark):
    base = (1, 0, 1, "DEL", 1000, 2000, 1000, 0, "")
    for other, want in [
        ((2, 1, 1, "DEL", 1025, 2025, 1000, 0, ""), True),
        ((2, 1, 1, "DEL", 1026, 2000, 1000, 0, ""), False),
        ((2, 1, 1, "DEL", 1000, 2026, 1000, 0, ""), False),
        ((2, 1, 1, "DEL", 1000, 2000, 900, 0, ""), True),
        ((2, 1, 1, "DEL", 1000, 2000, 899, 0, ""), False),
        ((2, 1, 1, "DEL", 2000, 1000, -1000, 0, ""), True),
        ((2, 0, 1, "DEL", 1000, 2000, 1000, 0, ""), False),
    ]:
        assert bool(near_duplicate_pairs(spark.createDataFrame([base, other], SCHEMA), F.col("kind")).count()) == want, other
    assert near_duplicate_pairs(spark.createDataFrame([], SCHEMA), F.col("kind")).count() == 0


def test_types(spark):
    rows = [(" ins", "INS"), ("<DEL>", "DEL"), ("INS:ME:LINE", "INS"), ("Duplication", "DUP"), ("INVERSION ", "INV"), ("BND", None), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "k string, want string")
    assert df.filter(~sv_type(F.col("k")).eqNullSafe(F.col("want"))).count() == 0


def test_one_hot_place(spark):
    """A third of the rows in one place, where the ends lie thick: every pair once, and no task takes most of the work."""
    rng = random.Random(5)
    rows = [(i, i % 7, 1, "DEL", 50_000 + rng.randrange(300), 90_000 + rng.randrange(3000), None, 0, "") for i in range(1500)]
    rows += [(10_000 + i, i % 7, 1, "DEL", rng.randrange(10**7), 2 * 10**7, None, 0, "") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in near_duplicate_pairs(df, F.col("kind"), split_rows=64, sample=2).collect()]
    assert len(got) == len(set(got)) and sorted(got) == sorted(brute(rows))
