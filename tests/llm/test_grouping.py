import random

import numpy as np
import pytest

from varweave.llm import grouping
from varweave.llm.grouping import connected_groups, union_find


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {k: find(k) for k in parent}


@pytest.mark.parametrize("blocks,split_rows", [(None, 200_000), (1, 200_000), (4, 50)])
def test_as_brute_force(spark, blocks, split_rows):
    rng = random.Random(7)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1500)]
    edges += [(9000, rng.randrange(9001, 10000)) for _ in range(800)]
    chain = list(range(20000, 20300))
    rng.shuffle(chain)
    edges += list(zip(chain, chain[1:])) + [(5, 5), (77777, 77777), (None, 3), (88888, None), (None, None), (-4, 2)]
    edges += [(b, a) for a, b in edges[:300]]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "l long, r long").repartition(6)
    got = [tuple(x) for x in connected_groups(df, "l", "r", blocks, split_rows=split_rows).collect()]
    assert len(got) == len(dict(got)) and dict(got) == brute(edges)


def test_empty(spark):
    assert connected_groups(spark.createDataFrame([], "l long, r long"), "l", "r").count() == 0
    assert connected_groups(spark.createDataFrame([(None, 1)], "l long, r long"), "l", "r").count() == 0


def test_small_cells_shrink_to_forests(spark, monkeypatch):
    names, roots = union_find(np.array([5, 7, 9]), np.array([7, 9, 2]))
    assert dict(zip(names.tolist(), roots.tolist())) == {2: 2, 5: 2, 7: 2, 9: 2}


def test_self_pairs_outlive_the_shrink(spark, monkeypatch):
    monkeypatch.setattr(grouping, "CELL_EDGES", 5)
    rng = random.Random(3)
    edges = [(k, k) for k in range(1000, 1100)] + [(1, rng.randrange(2, 200)) for _ in range(200)] + [(300, 300), (300, 301)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "l long, r long").repartition(2)
    for blocks in (1, 3):
        got = [tuple(x) for x in connected_groups(df, "l", "r", blocks).collect()]
        assert len(got) == len(dict(got)) and dict(got) == brute(edges)


def test_union_find_of_shapes():
    """A long chain in bad order, a star, a tree of random edges."""
    rng = np.random.default_rng(4)
    n = 3000
    chain = rng.permutation(n)
    for u, v in [(chain[1:], chain[:-1]), (np.zeros(n, int), np.arange(n)), (rng.integers(0, n, 2500), rng.integers(0, n, 2500))]:
        names, roots = union_find(u, v)
        assert dict(zip(names.tolist(), roots.tolist())) == brute(list(zip(u.tolist(), v.tolist())))
