"""Passages of held-out items inside corpus documents, whole, in part or slightly edited.

A passage is 30 consecutive words of an item with at most three words changed, missing or added. Such a passage keeps at
least three of the window's 24 runs of seven words (an edit breaks at most seven of them), so runs of seven words are the
seeds. One pass over the corpus keeps the stretches of documents in which as many seeds of items lie close together,
told by a filter of bounded size; only these go on, as hashes of their words. Seeds are counted there, and of every window of an item
the two commonest in the corpus are left out: the rarer ones still find every passage. A join on these rare seeds gives
the candidates; Smith-Waterman alignment of the words around a shared seed scores them, and where the score reaches what every
passage reaches, the number of edits confirms it.

No item or document is collected, and the texts themselves are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varweave.llm.hashing import gram_hashes, word_hashes
from varweave.operators.skew import SPLIT_ROWS, salted_join
from varweave.session import cut

PASSAGE_WORDS = 30
MAX_EDITS = 3
#: Characters of text hashed at once.
SLICE_CHARS = 2_000_000
#: Item positions that share one candidate check.
STEP = 16
#: The filter has 2**bits bits, so many for each word of the items, between these bounds; and each seed sets PROBES of them.
BITS_A_WORD, LEAST_BITS, MOST_BITS, PROBES = 32, 16, 27, 3


def seed_words(passage: int, edits: int) -> int:
    """The length of the runs of which a passage keeps some, as long as that allows with one edit in each."""
    return -(-(passage - edits) // (edits + 1))


def surviving_seeds(passage: int, edits: int) -> int:
    """How many of a window's seeds a passage keeps at least."""
    seed = seed_words(passage, edits)
    return max(1, passage - seed + 1 - edits * seed)


def _slices(ids: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts in parts of a bounded number of characters."""
    cuts = np.flatnonzero(np.diff(np.r_[-1, np.cumsum([len(t) for t in texts]) // SLICE_CHARS]))
    for lo, hi in zip(cuts, [*cuts[1:], len(ids)]):
        yield ids[lo:hi], texts[lo:hi]


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(values))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and where each list begins (one entry more)."""
    values, lengths = column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return values, np.r_[0, np.cumsum(lengths)].astype(np.int64)


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))


def hashed_words(df: DataFrame) -> DataFrame:
    """(i, words, item): the hashes of the words of each (t, i, item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            for some, texts in _slices(rows, batch.column(0).to_pylist()):
                words, borders = word_hashes(texts)
                keys, ids = zip(*some)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), _lists(words.view(np.int64), np.diff(borders)), pa.array(ids, pa.int64())], names=["i", "words", "item"])

    return df.mapInArrow(run, "i long, words array<long>, item long")


def grams_of(items: DataFrame, seed: int) -> DataFrame:
    """(i, pos, gram) of every run of ``seed`` words of (i, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            words, borders = _flat(batch.column(1))
            grams = gram_hashes(words.view(np.uint64), seed)
            item = np.repeat(np.arange(len(ids)), np.diff(borders))[: len(grams)]
            whole = np.flatnonzero(np.arange(len(grams)) + seed <= borders[item + 1])
            item = item[whole]
            yield pa.RecordBatch.from_arrays([pa.array(ids[item]), pa.array((whole - borders[item]).astype(np.int32)), pa.array(grams[whole].view(np.int64))], names=["i", "pos", "gram"])

    return items.mapInArrow(run, "i long, pos int, gram long")


def _probes(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    """PROBES bit positions of every gram."""
    step = (64 - bits) // (PROBES - 1)
    mask = np.uint64((1 << bits) - 1)
    return [((grams >> np.uint64(step * i)) & mask).astype(np.int64) for i in range(PROBES)]


def seed_filter(grams: DataFrame, bits: int) -> np.ndarray:
    """The bits that the grams set. Each task gives the words of its own bitmap; at most 2**(bits - 6) words come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(1 << bits, bool)
        for batch in batches:
            for at in _probes(batch.column(0).to_numpy().view(np.uint64), bits):
                mine[at] = True
        packed = np.packbits(mine, bitorder="little").view(np.int64)
        some = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(packed[some])], names=["at", "w"])

    table = grams.select("gram").mapInArrow(run, "at long, w long").groupBy("at").agg(F.bit_or("w").alias("w")).toArrow()
    packed = np.zeros(1 << (bits - 6), np.int64)
    packed[table.column("at").to_numpy()] = table.column("w").to_numpy()
    return packed.view(np.uint8)


def dense_hits(at: np.ndarray, doc: np.ndarray, least: int, span: int) -> np.ndarray:
    """Of hits at sorted word positions, those among at least ``least`` of one document whose first and last are at most ``span`` apart."""
    dense = np.zeros(len(at), bool)
    if len(at) >= least:
        close = np.flatnonzero((at[least - 1 :] - at[: len(at) - least + 1] <= span) & (doc[least - 1 :] == doc[: len(at) - least + 1]))
        for i in range(least):
            dense[close + i] = True
    return dense


def corpus_stretches(documents: DataFrame, bitmap: np.ndarray, bits: int, passage: int, edits: int) -> DataFrame:
    """(doc, start, words, at, grams): stretches of documents where seeds of items lie close enough for a passage.

    ``words`` are all words that a passage through one of the seeds can reach; the seeds begin at ``at`` in them.
    """
    seed, least = seed_words(passage, edits), surviving_seeds(passage, edits)
    reach = passage - seed + edits
    sent = documents.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _slices(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, borders = word_hashes(texts)
                grams = gram_hashes(words, seed)
                hits = np.arange(len(grams))
                for i in range(PROBES):
                    p = _probes(grams[hits], bits)[i]
                    hits = hits[(sent.value[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)]
                doc = np.searchsorted(borders, hits, "right") - 1
                inside = hits + seed <= borders[doc + 1]
                hits, doc = hits[inside], doc[inside]
                dense = dense_hits(hits, doc, least, reach)
                hits, doc = hits[dense], doc[dense]
                if not len(hits):
                    continue
                lo, hi = np.maximum(hits - reach, borders[doc]), np.minimum(hits + seed + reach, borders[doc + 1])
                new = np.r_[True, (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1])]
                first = np.flatnonzero(new)
                start, end = lo[first], hi[np.r_[first[1:], len(hits)] - 1]
                size = end - start
                at = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
                n = np.diff(np.r_[first, len(hits)])
                cols = [
                    pa.array(np.array(ids, np.int64)[doc[first]]),
                    pa.array(start - borders[doc[first]]),
                    _lists(words[at].view(np.int64), size),
                    _lists((hits - np.repeat(start, n)).astype(np.int32), n),
                    _lists(grams[hits].view(np.int64), n),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc", "start", "words", "at", "grams"])

    return documents.mapInArrow(run, "doc long, start long, words array<long>, at array<int>, grams array<long>")


def rare_positions(common: np.ndarray, passage: int, edits: int) -> np.ndarray:
    """Of the seeds of one item, how common each is, in order: whether it is among the rarer ones of some window.

    All but (surviving seeds - 1) of each window are, so a passage of it keeps one of them.
    """
    per_window = passage - seed_words(passage, edits) + 1
    spare = surviving_seeds(passage, edits) - 1
    keep = np.zeros(len(common), bool)
    if len(common) < per_window:
        return keep
    windows = np.lib.stride_tricks.sliding_window_view(common, per_window)
    chosen = np.argsort(windows, axis=1, kind="stable")[:, : per_window - spare]
    keep[(np.arange(len(windows))[:, None] + chosen).ravel()] = True
    return keep


def rare_seeds(grams: DataFrame, frequency: DataFrame, passage: int, edits: int, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(i, pos, rare) of the items' rarer seeds that the corpus has. A task holds the seeds of one item."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table.column("n").to_numpy()
        return table.filter(pa.array(rare_positions(n, passage, edits) & (n > 0))).select(["i", "pos", "rare"])

    met = salted_join(grams, frequency.select(F.col("gram").alias("__gram"), "n"), [("gram", "__gram")], F.col("i"), "left", split_rows=split_rows)
    known = met.select("i", "pos", F.col("gram").alias("rare"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return known.groupBy("i").applyInArrow(run, "i long, pos int, rare long")


def smith_waterman(a: np.ndarray, b: np.ndarray) -> int:
    """The best local alignment score of two word sequences: 1 for equal words, -1 for a changed, missing or added one."""
    row = np.zeros(len(b) + 1, np.int32)
    ramp = np.arange(len(b) + 1, dtype=np.int32)
    best = 0
    for word in a:
        up = np.maximum(row - 1, 0)
        up[1:] = np.maximum(up[1:], row[:-1] + np.where(b == word, 1, -1))
        row = np.maximum.accumulate(up + ramp) - ramp
        best = max(best, int(row.max()))
    return best


def holds_passage(item: np.ndarray, doc: np.ndarray, passage: int, edits: int) -> bool:
    """Whether some run of ``passage`` words of the item is within ``edits`` word edits of a run of the document."""
    if len(item) < passage:
        return False
    windows = np.lib.stride_tricks.sliding_window_view(item, passage)
    ramp = np.arange(passage + 1, dtype=np.int16)
    d = np.repeat(ramp[None, :], len(windows), axis=0)
    for word in doc:
        nxt = d + np.int16(1)
        nxt[:, 0] = 0
        nxt[:, 1:] = np.minimum(nxt[:, 1:], d[:, :-1] + (windows != word))
        d = np.minimum.accumulate(nxt - ramp, axis=1) + ramp
        if (d[:, -1] <= edits).any():
            return True
    return False


def verified(docs: tuple[np.ndarray, np.ndarray], items: tuple[np.ndarray, np.ndarray], row: np.ndarray, q: np.ndarray, p: np.ndarray, passage: int, edits: int) -> set[int]:
    """The rows whose document words hold a passage of their item words.

    ``docs`` and ``items`` are words and where each row's begin; a shared seed of a row begins at ``q`` in its document words, at ``p``
    in its item words.
    """
    (words, borders), (mine, edges) = docs, items
    k, e, s = passage, edits, seed_words(passage, edits)
    shift = p % STEP
    base = np.unique(np.stack([row, borders[row] + q - shift, edges[row] + p - shift], axis=1), axis=0)
    row, q, p = base.T
    # The item's words that a window around these hits can hold, and the document's words at nearby diagonals.
    before, after = k - s, STEP - 1 + k
    sure = np.zeros(len(row), bool)
    for at in range(0, len(row), 20_000):
        part = slice(at, at + 20_000)
        ip = p[part, None] + np.arange(-before, after)
        ok = (ip >= edges[row[part], None]) & (ip < edges[row[part] + 1, None])
        asked = mine[np.clip(ip, 0, len(mine) - 1)]
        agree = np.zeros(ok.shape, bool)
        for d in range(-e, e + 1):
            dp = q[part, None] + np.arange(-before, after) + d
            there = (dp >= borders[row[part], None]) & (dp < borders[row[part] + 1, None])
            agree |= there & (words[np.clip(dp, 0, len(words) - 1)] == asked)
        run = np.cumsum(np.pad(agree & ok, ((0, 0), (1, 0))), axis=1, dtype=np.int16)
        sure[part] = (run[:, k:] - run[:, :-k]).max(axis=1) >= k - e
    found: set[int] = set()
    for r, dq, ip in zip(row[sure].tolist(), q[sure].tolist(), p[sure].tolist()):
        if r in found:
            continue
        a = mine[max(ip - before, edges[r]) : min(ip + after, edges[r + 1])]
        b = words[max(dq - before - e, borders[r]) : min(dq + after + e, borders[r + 1])]
        if smith_waterman(b, a) >= k - 2 * e and holds_passage(a, b, k, e):
            found.add(r)
    return found


def leaked_documents(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    passage: int = PASSAGE_WORDS,
    edits: int = MAX_EDITS,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """(doc_id, item_id) of every document that holds a passage of the item, each pair once.

    Words are runs of letters and digits, without case. An item of fewer words than a passage leaks nowhere. Null or empty
    texts, and rows with a null id, leak nothing. Repeated rows count once. Whole texts are read, once. Further columns are
    ignored. Seeds and items with more than ``split_rows`` hits are dealt over tasks.
    """
    seed = seed_words(passage, edits)
    # Every text of an item by itself, should an id have several.
    asked = _texts(items, item_id, text).distinct().select("t", F.xxhash64("id", "t").alias("i"), F.col("id").alias("item"))
    known = cut(hashed_words(asked).filter(F.size("words") >= passage))
    n_words = known.agg(F.sum(F.size("words"))).first()[0]
    if not n_words:
        return documents.sparkSession.createDataFrame([], "doc_id long, item_id long")
    bits = min(MOST_BITS, max(LEAST_BITS, int(n_words * BITS_A_WORD).bit_length()))
    grams = grams_of(known, seed)
    bitmap = seed_filter(grams, bits)
    stretches = cut(corpus_stretches(_texts(documents, doc_id, text), bitmap, bits, passage, edits))

    hits = stretches.select("doc", "start", F.explode(F.arrays_zip("at", "grams")).alias("x")).select("doc", "start", F.col("x.at").alias("at"), F.col("x.grams").alias("gram"))
    frequency = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rare = rare_seeds(grams, frequency, passage, edits, split_rows)
    shared = salted_join(hits, rare, [("gram", "rare")], F.col("doc"), split_rows=split_rows)
    # Hits of one stretch and item on one diagonal and nearby positions need one look.
    places = shared.groupBy("doc", "start", "i", F.floor(F.col("pos") / F.lit(STEP)).alias("step"), (F.col("at") - F.col("pos")).alias("diagonal")).agg(F.min(F.struct("at", "pos")).alias("hit"))
    places = places.groupBy(F.col("doc").alias("__doc"), F.col("start").alias("__start"), "i").agg(F.collect_list("hit.at").alias("q"), F.collect_list("hit.pos").alias("p"))
    with_words = places.join(stretches.select("doc", "start", "words"), (F.col("__doc") == F.col("doc")) & (F.col("__start") == F.col("start")))
    both = salted_join(with_words.select("doc", "i", "q", "p", "words"), known.select(F.col("i").alias("__i"), F.col("words").alias("mine"), "item"), [("i", "__i")], F.col("doc"), split_rows=split_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                doc, item = part.column(0).to_numpy(), part.column(1).to_numpy()
                (q, hits), (p, _) = _flat(part.column(2)), _flat(part.column(3))
                row = np.repeat(np.arange(len(doc)), np.diff(hits))
                some = np.array(sorted(verified(_flat(part.column(4)), _flat(part.column(5)), row, q.astype(np.int64), p.astype(np.int64), passage, edits)), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(doc[some]), pa.array(item[some])], names=["doc_id", "item_id"])

    return both.select("doc", "item", "q", "p", "words", "mine").mapInArrow(run, "doc_id long, item_id long").distinct()
