import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from varweave.llm import survivors
from varweave.llm.survivors import _undominated, criteria_worth, merged_records, sequence_worth, skyline, surviving_values

SCHEMA = "g string, row_id long, vix_ix int, alt_seq string, criteria string, called_at timestamp, length int, field string"


def members(n, hot, seed):
    rng = random.Random(seed)
    t0 = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        g = "hot" if rng.random() < hot else rng.choice(["a", "b", " b", "c\t", None])
        rows.append((g, i, rng.randrange(5), rng.choice([None, "", "ACGT", "acgtNN", "ACGTACGT", "<INS>", "A" * rng.randrange(1, 9)]), rng.choice([None, "", "near", "NEAR;exact", "there", "none", "here,there|near"]),
                     rng.choice([None, t0 + timedelta(days=rng.randrange(9))]), rng.choice([None, None, 5]), "x"))
    return rows + rows[: n // 10]


def worth(alt, crit):
    ws = sum(c in "ACGT" for c in alt.upper()) if alt and set(alt.upper()) <= set("ACGTN") else 0
    words = (crit or "").lower().replace(";", ",").replace("|", ",").split(",")
    return ws, len(set(words) & {"exact", "locus", "here", "there", "near"})


def brute(rows):
    best = {}
    for g, i, v, alt, crit, at, *_ in rows:
        if g is None:
            continue
        for f, w in zip(("alt_seq", "criteria"), worth(alt, crit)):
            if w:
                key = (-w, -(at.timestamp() if at else -1e18), v, i)
                best[(g.strip(" \t"), f)] = min(best.get((g.strip(" \t"), f), key), key)
    return sorted((*k, v[3]) for k, v in best.items())


def key():
    return F.regexp_replace("g", r"^[ \t]+|[ \t]+\z", "")


def worths():
    return {"alt_seq": sequence_worth(F.col("alt_seq")), "criteria": criteria_worth(F.col("criteria"))}


@pytest.mark.parametrize("n,hot", [(300, 0.0), (3000, 0.9)])
def test_survivors_as_brute_force(spark, n, hot):
    rows = members(n, hot, n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = surviving_values(df, key(), worths(), F.col("called_at"), [F.col("vix_ix"), F.col("row_id")], salts=3)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    assert surviving_values(df.limit(0), key(), worths(), F.col("called_at"), [F.col("vix_ix")]).count() == 0


def test_worths(spark):
    df = spark.createDataFrame([("ACGTNn", 4), ("acgt", 4), ("NN", 0), ("ACGU", 0), ("", 0), (None, 0), ("A C", 0)], "s string, want long")
    assert df.filter(sequence_worth(F.col("s")) != F.col("want")).count() == 0
    df = spark.createDataFrame([("here, THERE/near near", 3), ("unmerged", 0), ("exact_locus", 2), ("", 0), (None, 0)], "s string, want long")
    assert df.filter(criteria_worth(F.col("s")) != F.col("want")).count() == 0


def test_skyline_is_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (900, 3))
    keys = rng.integers(0, 3, 900)
    want = {(int(k), *map(int, r)) for k, r in zip(keys, x) if not ((keys == k) & (x >= r).all(axis=1) & (x > r).any(axis=1)).any()}
    df = spark.createDataFrame([(int(k), *map(int, r)) for k, r in zip(keys, x)], "g long, a long, b long, c long").repartition(4)
    got = [tuple(r) for r in skyline(df, "g", ["a", "b", "c"], salts=2).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(_undominated(np.zeros(0, int), np.zeros((0, 2)))) == 0


def test_fields_from_successive_layers(spark):
    t = datetime(2024, 1, 1)
    rows = [("a", 1, 0, "ACGT", "near", t, None, "x"), ("a", 2, 1, "ACG", None, None, None, "x"), ("a", 3, 2, "AC", None, None, 7, "x"), ("b", 4, 0, None, None, None, None, "x")]
    out = {r["g"]: r for r in merged_records(spark.createDataFrame(rows, SCHEMA), key(), "g", worths(), ["length", "called_at"], F.col("called_at"), [F.col("vix_ix"), F.col("row_id")]).collect()}
    assert (out["a"]["alt_seq"], out["a"]["criteria"], out["a"]["length"], out["a"]["called_at"], out["a"]["n_layers"]) == ("ACGT", "near", 7, t, 3)
    assert (out["b"]["alt_seq"], out["b"]["length"], out["b"]["n_layers"]) == (None, None, 1)


def chains():
    t = datetime(2024, 1, 1)
    rows = [("a", i, 0, "ACGT", "near", None, 7 if i == 9 else None, "x") for i in range(10)]
    rows += [("b", 100 + i, 0, "ACGT", "near", t, 3 if i == 5 else 4 if i == 7 else None, "x") for i in range(12)]
    return rows + [("c", 200, 0, "AC", None, None, 1, "x"), ("d", 300, 0, None, None, None, None, "x")]


@pytest.mark.parametrize("deep_rows", [0, 3, 100])
def test_fields_from_the_last_layer(spark, deep_rows):
    args = [key(), "g", worths(), ["length", "called_at"], F.col("called_at"), [F.col("vix_ix"), F.col("row_id")]]
    out = merged_records(spark.createDataFrame(chains(), SCHEMA), *args, deep_rows=deep_rows).collect()
    assert {r["g"]: (r["length"], r["n_layers"]) for r in out} == {"a": (7, 10), "b": (3, 6), "c": (1, 1), "d": (None, 1)}


def test_a_hundred_layers(spark):
    """One chain of 130 members, of which only the last but 29 has a length; and both ways agree on random groups."""
    args = [key(), "g", worths(), ["length", "called_at"], F.col("called_at"), [F.col("vix_ix"), F.col("row_id")]]
    chain = [("a", i, 0, "ACGT", "near", None, 7 if i == 100 else None, "x") for i in range(130)]
    out = merged_records(spark.createDataFrame(chain, SCHEMA), *args).collect()
    assert [(r["length"], r["n_layers"]) for r in out] == [(7, 101)]
    df = spark.createDataFrame(members(500, 0.7, 11), SCHEMA).repartition(3)
    ways = [sorted(map(tuple, merged_records(df, *args, deep_rows=d).collect()), key=repr) for d in (100_000, 60)]
    assert ways[0] == ways[1]


def test_empty_groups(spark):
    args = [key(), "g", worths(), ["length"], F.col("called_at"), [F.col("vix_ix"), F.col("row_id")]]
    assert merged_records(spark.createDataFrame([], SCHEMA), *args).count() == 0
    assert merged_records(spark.createDataFrame([(None, 1, 1, "A", None, None, 1, "x")], SCHEMA), *args).count() == 0


def test_skyline_of_a_large_group():
    """Six axes without ties, where hundreds are undominated."""
    x = np.random.default_rng(3).permuted(np.tile(np.arange(6000)[:, None], 6), axis=0)
    want = np.array([not ((x >= r).all(axis=1) & (x > r).any(axis=1)).any() for r in x])
    assert (_undominated(np.zeros(6000, int), x) == np.flatnonzero(want)).all() and want.sum() > 500
    again = np.concatenate([x, x[:300]])
    assert len(_undominated(np.zeros(6300, int), again)) == want.sum()
    assert len(_undominated(np.zeros(6300, int), again, ties=True)) == want.sum() + want[:300].sum()


def test_trust_is_one_axis(spark):
    rows = [("a", 5, 1, 9), ("a", 5, 2, 1), ("a", 5, 2, 0), ("a", 4, 2, 5)]
    df = spark.createDataFrame(rows, "g string, w long, t0 long, t1 long")
    assert sorted(tuple(r) for r in skyline(df, "g", ["w"], ["t0", "t1"]).collect()) == [("a", 4, 2, 5), ("a", 5, 2, 1)]


def test_layer_numbers():
    x = np.random.default_rng(5).integers(0, 6, (400, 3))
    left, want, n = np.ones(400, bool), np.zeros(400, int), 0
    while left.any():
        beaten = np.array([((x[left] >= r).all(axis=1) & (x[left] > r).any(axis=1)).any() for r in x])
        want[left & ~beaten] = n
        left, n = left & beaten, n + 1
    assert (survivors.layer_numbers(x) == want).all()
