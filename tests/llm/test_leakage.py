import random

import numpy as np

from varweave.llm.hashing import gram_hashes, plain_words, word_hashes
from varweave.llm.leakage import dense_hits, holds_passage, leaked_documents, rare_positions, smith_waterman

RNG = random.Random(12)
VOCABULARY = [a + b + c + d for a in "bdfgk" for b in "aeiou" for c in "lmnrst" for d in "aeiou"]


def words(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def edited(passage, edits):
    out = list(passage)
    for _ in range(edits):
        at = RNG.randrange(1, len(out) - 1)
        what = RNG.choice(["change", "drop", "add"])
        if what == "change":
            out[at] = "zzz" + out[at]
        elif what == "drop":
            del out[at]
        else:
            out.insert(at, "yyy")
    return out


def least_edits(pattern, text):
    """The fewest edits between the pattern and any part of the text, cell by cell."""
    column = list(range(len(pattern) + 1))
    best = column[-1]
    for word in text:
        diagonal, column[0] = column[0], 0
        for i, x in enumerate(pattern, 1):
            diagonal, column[i] = column[i], min(diagonal + (x != word), column[i] + 1, column[i - 1] + 1)
        best = min(best, column[-1])
    return best


def slow(item, doc):
    return any(least_edits(item[s : s + 30], doc) <= 3 for s in range(len(item) - 29))


def test_edits_of_every_kind(spark):
    items = [words(80) for _ in range(12)]
    items[1][:9] = items[0][:9]
    texts, want = [], set()
    for n in range(80):
        i = RNG.randrange(12)
        s = RNG.randrange(51)
        k = RNG.choice([0, 1, 2, 3, 3, 4, 5, 6])
        doc = words(RNG.randrange(30)) + edited(items[i][s : s + 30], k) + words(RNG.randrange(30))
        texts.append(RNG.choice([" ", "\n  ", "_-", '", "']).join(w.upper() if n % 3 == 0 else w for w in doc))
        want |= {(n, j) for j in range(12) if len(set(items[j]) & set(doc)) > 18 and slow(items[j], doc)}
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    i = spark.createDataFrame([(n, " ".join(x)) for n, x in enumerate(items)], "item_id long, text string")
    for split_rows in (1000, 5):
        got = [tuple(r) for r in leaked_documents(d, i, split_rows=split_rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 30


def test_parts():
    a, b = np.array([1, 2, 3, 4, 5]), np.array([9, 2, 3, 7, 4, 5])
    assert smith_waterman(a, b) == 3 and smith_waterman(a, a) == 5 and smith_waterman(a, np.array([8])) == 0
    assert not holds_passage(np.arange(29), np.arange(29), 30, 3) and holds_passage(np.arange(30), np.arange(27), 30, 3)
    assert plain_words("Größe_№5 ﬁn") == "größe_ 5 ﬁn".encode()
    w, borders = word_hashes(["a b", "", "B, a!", "__"])
    assert borders.tolist() == [0, 2, 2, 4, 4] and w[0] == w[3] and w[1] == w[2] and w[0] != w[1]
    assert len(gram_hashes(w, 5)) == 0


def test_documents(spark):
    items = [words(60), words(60), words(20)]
    docs = [(1, " ".join(words(20) + items[0][5:40])), (2, " ".join(items[1])), (3, " ".join(words(200))), (4, None), (5, ""), (None, " ".join(items[0])), (6, " ".join(items[2])), (2, " ".join(items[1])), (7, " ".join(items[0] + ["q"] * 200_000 + items[1]))]
    it = [(10, " ".join(items[0])), (11, " ".join(items[1])), (12, " ".join(items[2])), (13, None), (None, "x"), (11, " ".join(items[1]))]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(*x, 1) for x in it], "item_id long, text string, doc_id int")
    want = [(1, 10), (2, 11), (7, 10), (7, 11)]
    assert sorted(tuple(r) for r in leaked_documents(d, i).collect()) == want
    # Two texts of one item.
    two = i.unionByName(spark.createDataFrame([(10, " ".join(items[1]), 1)], "item_id long, text string, doc_id int"))
    assert sorted(tuple(r) for r in leaked_documents(d, two).collect()) == sorted([*want, (2, 10)])
    assert leaked_documents(d.limit(0), i).count() == 0 and leaked_documents(d, i.limit(0)).count() == 0


def test_rare_seeds_find_every_passage():
    """Whatever three seeds of a window survive, one of them is among the rare ones."""
    rng = np.random.default_rng(9)
    for _ in range(30):
        common = rng.integers(0, 4, 60)
        rare = rare_positions(common, 30, 3)
        assert all((~rare[w : w + 24]).sum() <= 2 for w in range(37))
    assert not rare_positions(np.zeros(23, int), 30, 3).any()


def test_dense_hits():
    at, doc = np.array([0, 5, 9, 40, 41, 42, 60]), np.array([0, 0, 0, 0, 0, 1, 1])
    assert dense_hits(at, doc, 3, 9).tolist() == [True] * 3 + [False] * 4
    assert dense_hits(at[:2], doc[:2], 3, 9).tolist() == [False] * 2 and dense_hits(at, doc, 1, 9).all()
