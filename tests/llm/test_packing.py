import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from varweave.llm.packing import fill_room, pack, pack_documents
from varweave.llm.tokens import default_vocabulary, encoding


@given(st.lists(st.integers(1, 30), min_size=1, max_size=12), st.integers(1, 60))
@settings(max_examples=150, deadline=None)
def test_room_is_filled_as_well_as_can_be(lengths, room):
    counts = {}
    for x in lengths:
        counts[x] = counts.get(x, 0) + 1
    used = fill_room(counts, sorted(counts, reverse=True), room)
    assert all(0 < n <= counts[x] for x, n in used.items())
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums if s + x <= room}
    assert sum(x * n for x, n in used.items()) == max(sums)


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=60, deadline=None)
def test_every_text_lies_in_one_container(lengths):
    boxes = pack(lengths, 64)
    assert sorted(i for b in boxes for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 64 for b in boxes)


@pytest.mark.parametrize("group_texts", [8192, 20])
def test_documents(spark, group_texts):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "x", "(", "0"]) for _ in range(rng.choice([0, 3, 40, 300]))) for _ in range(120)]
    rows = [(i, t, 9) for i, t in enumerate(texts)] + [(500, None, 9), (501, "", 9), (None, "lost", 9), (3, "twice over", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = pack_documents(df, 64, group_texts=group_texts).toPandas()
    assert out.groupby("container_id").n_tokens.sum().max() <= 64
    enc = encoding(*default_vocabulary())
    want = {}
    for i, t, _ in rows:
        if i is not None:
            want[i] = want.get(i, 0) + (len(enc.encode_ordinary(t)) if t else 0)
    assert out.groupby("doc_id").n_tokens.sum().to_dict() == want
    assert not out.duplicated(["doc_id", "part"]).any()
    for doc, part in out[~out.doc_id.isin([3])].groupby("doc_id"):
        part = part.sort_values("part")
        assert (part.first_token.tolist()) == [0, *part.n_tokens.cumsum().tolist()[:-1]]
        if want[doc] <= 64:
            assert len(part) == 1
        else:
            assert (part.n_tokens[:-1] == 64).all()
    if group_texts == 8192:
        bins = []
        for n in sorted(out.n_tokens, reverse=True):
            fit = next((i for i, room in enumerate(bins) if room >= n), None)
            if fit is None:
                bins.append(64 - n)
            else:
                bins[fit] -= n
        assert out.container_id.nunique() <= len(bins)
    assert pack_documents(df.limit(0), 64).count() == 0
