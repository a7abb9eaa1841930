"""The language of each document, and of each stretch of another language inside it.

Discrimination is hierarchical. Linear classifiers over families of languages decide first: a path of least cost over the
lines of a document, where a line counts by its characters and a change of family costs a fixed amount, cuts it into runs of
one family. Inside a run only that family's linear support vector machines, one for each pair of its languages, speak, and a
second path over their votes gives the languages. Both work on hashed tokens, neighbouring tokens and line starts
of single lines. The language with the most text is the main one, and prose inside a file of code belongs to it.

The classifiers are fitted on a bounded sample of documents whose label and file name extension agree
(``TRAIN_PER_LANGUAGE`` a language, none longer than ``TRAIN_MAX_CHARS``, from all files of the table);
every document is classified over its whole text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varweave.llm.hashing import span_hashes
from varweave.session import cut

FAMILIES: dict[str, list[str]] = {
    "braces": ["c", "go", "java", "javascript", "rust"],
    "scripts": ["python", "shell", "sql"],
    "sheets": ["css", "yaml"],
    "markup": ["html", "markdown", "text"],
}
LANGUAGES = [x for f in FAMILIES.values() for x in f]
#: Prose is no stretch of another language inside a file.
PROSE = ("text",)

#: File name extensions by language.
EXTENSIONS = {
    "py": "python", "java": "java", "js": "javascript", "c": "c", "h": "c", "go": "go", "rs": "rust", "sql": "sql",
    "sh": "shell", "html": "html", "htm": "html", "css": "css", "yaml": "yaml", "yml": "yaml", "md": "markdown", "txt": "text",
}
#: Names that share no letters with the language's own.
OTHER_NAMES = {"bash": "shell", "zsh": "shell", "ecmascript": "javascript", "node": "javascript", "plain": "text"}
#: What may stand before or behind a language's name in a label without changing what it names.
QUALIFIERS = "^(ansi|plain|x)|(lang|language|script|code|source|file)$"
#: A label that no rule reads names the language of this share of its documents, if it has so many.
LABEL_SHARE, LABEL_DOCUMENTS = 0.6, 20

TRAIN_PER_LANGUAGE = 150
TRAIN_MAX_CHARS = 20_000
#: Windows of lines taken from each training document, of 1 to WINDOW_LINES lines.
WINDOWS_PER_DOC, WINDOW_LINES = 12, 6
EPOCHS, RATE, DECAY = 6, 0.5, 1e-5
BITS = 16
#: Cost of a change of language between two lines, in units of the score of UNIT characters: 200 characters of clear
#: evidence, on however many lines, outweigh two changes.
SWITCH = 3.5
UNIT = 16
#: Characters a stretch must have to be reported.
MIN_STRETCH = 200
#: Confidence below which a stretch is taken for comments or prose, and is no finding.
MIN_CONFIDENCE = 0.75
#: Prose is the main language only if clear code comes to less than this share of it.
CODE_SHARE = 0.1
#: Pieces into which longer lines are cut, since a minified file is one line.
PIECE = 240
SLICE_CHARS = 1_500_000

_PAIRS = [(a, b) for f in FAMILIES.values() for a, b in combinations(f, 2)]
_CLASSIFIERS = len(FAMILIES) + len(_PAIRS)
_SPACE, _WORD, _MARK = 0, 1, 2
_KIND = np.full(256, _MARK, np.uint8)
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = _WORD
_KIND[[*range(0, 33), 127]] = _SPACE


def plain_label(label: Column) -> Column:
    """A label in small letters and digits alone; null if nothing is left."""
    word = F.regexp_replace(F.lower(label), "[^a-z0-9]", "")
    return F.when(word != "", word)


def language_of_label(label: Column) -> Column:
    """One of the thirteen names, else null: by its name, an extension or another name, or one of these behind a version
    number or a qualifier."""
    known = F.create_map(*[F.lit(x) for k, v in ({x: x for x in LANGUAGES} | EXTENSIONS | OTHER_NAMES).items() for x in (k, v)])
    word = plain_label(label)
    bare = F.regexp_replace(word, "[0-9]+$", "")
    named = lambda w: F.try_element_at(known, w)
    return F.coalesce(named(word), named(bare), named(F.regexp_replace(bare, QUALIFIERS, "")))


def language_of_path(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for k, v in EXTENSIONS.items() for x in (k, v)])
    return F.element_at(known, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


@dataclass
class Features:
    """Hashed features of lines: two for each token, one for each line's start."""

    token: np.ndarray
    pair: np.ndarray
    start: np.ndarray
    offset: np.ndarray


def featurize(lines: list[str]) -> Features:
    raw = "\n".join(lines).encode("utf-8", "replace") + b"\n"
    data = np.frombuffer(raw, np.uint8)
    kind = _KIND[data]
    change = np.flatnonzero(np.diff(np.r_[np.uint8(_SPACE), kind, np.uint8(_SPACE)].astype(np.int8)))
    lo, hi = change[:-1], change[1:]
    some = kind[lo] != _SPACE if len(lo) else np.empty(0, bool)
    lo, hi = lo[some], hi[some]
    h = span_hashes(data, lo, hi)
    first = data[lo] if len(lo) else np.empty(0, np.uint8)
    h[(first >= 48) & (first <= 57)] = np.uint64(0x9D39247E33776D41)
    ends = np.flatnonzero(data == 10)
    begins = np.r_[0, ends[:-1] + 1]
    offset = np.searchsorted(lo, np.r_[begins, len(data)])
    after = np.r_[h[1:], np.uint64(0)]
    last = offset[1:][offset[1:] > offset[:-1]] - 1
    after[last] = np.uint64(0x1F83D9ABFB41BD6B)
    shift = np.uint64(64 - BITS)
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int32)
    opening = np.zeros(len(begins), np.uint64)
    filled = offset[1:] > offset[:-1]
    at = offset[:-1][filled]
    indented = (lo[at] > begins[filled]).astype(np.uint64) + (data[begins[filled]] == 9).astype(np.uint64)
    opening[filled] = h[at] * np.uint64(0xD6E8FEB86659FD93) + indented + np.uint64(1)
    pair = h * np.uint64(0xFF51AFD7ED558CCD) + after * np.uint64(0xC4CEB9FE1A85EC53)
    return Features(mix(h), mix(pair ^ (pair >> np.uint64(33))), mix(opening ^ (opening >> np.uint64(31))), offset)


def split_lines(text: str) -> list[str]:
    """Lines without their ends, the long ones in pieces."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if max(map(len, lines)) <= 2 * PIECE:
        return lines
    out = []
    for line in lines:
        if len(line) <= 2 * PIECE:
            out.append(line)
        else:
            at = 0
            while len(line) - at > 2 * PIECE:
                stop = line.rfind(" ", at + PIECE // 2, at + PIECE)
                stop = at + PIECE if stop < 0 else stop + 1
                out.append(line[at:stop])
                at = stop
            out.append(line[at:])
    return out


def _targets(language: str) -> np.ndarray:
    y = np.zeros(_CLASSIFIERS, np.float32)
    for i, members in enumerate(FAMILIES.values()):
        y[i] = 1 if language in members else -1
    for i, (a, b) in enumerate(_PAIRS):
        y[len(FAMILIES) + i] = (language == a) - (language == b)
    return y


def _fit(examples: list[np.ndarray], y: np.ndarray, seed: int) -> np.ndarray:
    """All classifiers at once by stochastic steps on the hinge loss, averaged over the last epochs."""
    rng = np.random.default_rng(seed)
    w = np.zeros((1 << BITS, _CLASSIFIERS), np.float32)
    mean, n_mean = np.zeros_like(w), 0
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(examples))
        for at in range(0, len(order), 128):
            some = order[at : at + 128]
            x = [examples[i] for i in some]
            size = np.array([len(e) for e in x])
            idx = np.concatenate(x)
            scale = (1 / np.sqrt(size)).astype(np.float32)
            score = np.add.reduceat(w[idx], np.r_[0, np.cumsum(size)[:-1]], axis=0) * scale[:, None]
            pull = y[some] * ((y[some] * score < 1) & (y[some] != 0)) * scale[:, None]
            step += 1
            rate = RATE / (1 + step * RATE * 2e-3)
            names, back = np.unique(idx, return_inverse=True)
            by_feature = np.argsort(back, kind="stable")
            rows = np.repeat(pull, size, axis=0)[by_feature]
            grad = np.add.reduceat(rows, np.r_[0, np.flatnonzero(np.diff(back[by_feature])) + 1], axis=0)
            w[names] += rate * grad
        w *= np.float32(1 - DECAY * len(order))
        if epoch >= EPOCHS // 2:
            mean += w
            n_mean += 1
    return mean / n_mean


def train(texts: list[str], labels: list[str], seed: int = 7) -> np.ndarray:
    """Weights of all classifiers, features by row. Windows that a first fit contradicts are left out of the second."""
    rng = np.random.default_rng(seed)
    examples, names = [], []
    for text, label in zip(texts, labels):
        lines = split_lines(text)
        if not any(x.strip() for x in lines):
            continue
        f = featurize(lines)
        for _ in range(WINDOWS_PER_DOC):
            a = int(rng.integers(len(lines)))
            b = min(len(lines), a + int(rng.integers(1, WINDOW_LINES + 1)))
            s, e = f.offset[a], f.offset[b]
            if e > s:
                examples.append(np.concatenate([f.token[s:e], f.pair[s:e], f.start[a:b]]))
                names.append(label)
    if not examples:
        return np.zeros((1 << BITS, _CLASSIFIERS), np.float32)
    y = np.stack([_targets(x) for x in names])
    w = _fit(examples, y, seed)
    size = np.array([len(e) for e in examples])
    score = np.add.reduceat(w[np.concatenate(examples)], np.r_[0, np.cumsum(size)[:-1]], axis=0) / np.sqrt(size)[:, None]
    family, within = decisions(score)
    mine = np.array([LANGUAGES.index(x) for x in names])
    own = _FAMILY_OF[mine]
    rows = np.arange(len(names))
    relatives = np.where(_FAMILY_OF[None] == own[:, None], within, -np.inf).max(axis=1)
    good = np.flatnonzero((family[rows, own] > family.max(axis=1) - 0.8) & (within[rows, mine] > relatives - 0.8))
    return _fit([examples[i] for i in good], y[good], seed + 1)


#: The family of each language, by number.
_FAMILY_OF = np.array([i for i, f in enumerate(FAMILIES.values()) for _ in f])


def decisions(margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each line the clipped margin of every family, and of every language the mean of its clipped margins against its relatives."""
    family = np.clip(margins[:, : len(FAMILIES)], -1.5, 1.5)
    within = np.zeros((len(margins), len(LANGUAGES)), np.float32)
    for j, (a, b) in enumerate(_PAIRS):
        m = np.clip(margins[:, len(FAMILIES) + j], -1.5, 1.5)
        within[:, LANGUAGES.index(a)] += m
        within[:, LANGUAGES.index(b)] -= m
    sizes = np.bincount(_FAMILY_OF)[_FAMILY_OF]
    return family, within / (sizes - 1)


def line_scores(lines: list[str], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``decisions`` of every line; a line without a token decides nothing."""
    f = featurize(lines)
    n = np.diff(f.offset)
    out = w[f.start].copy()
    filled = np.flatnonzero(n)
    if len(filled):
        # In parts, to bound what is gathered at once.
        for part in np.array_split(filled, max(1, len(f.token) // 200_000)):
            if not len(part):
                continue
            s, e = f.offset[part[0]], f.offset[part[-1] + 1]
            rows = w[f.token[s:e]]
            rows += w[f.pair[s:e]]
            out[part] += np.add.reduceat(rows, f.offset[part] - s, axis=0)
    out /= np.sqrt(2 * n + 1, dtype=np.float32)[:, None]
    out[n == 0] = 0
    return decisions(out)


#: A run of words with no more than sentence punctuation, after a comment or quotation mark or none.
_SENTENCE = re.compile(r"""\s*([/*#<!\-"'`>;%]*)\s*((?:[\w,.;:'’-]+ +){3,}[\w,.;:'’-]+)\s*(?:["'`]?\s*[+\\,;]*|\*+/)\s*\Z""")
_CODE_MARK = re.compile(r"[=(){}\[\]<>$&|@_]")
#: A sentence says nothing of a programming language, and little of the kind of prose.
_SENTENCE_WEIGHT, _PROSE_FAMILY = 0.3, list(FAMILIES).index("markup")


def is_sentence(line: str) -> bool:
    """Whether a line is prose or a comment in words: mostly small letters, five words, or four behind a mark."""
    if len(line) < 12 or _CODE_MARK.search(line):
        return False
    m = _SENTENCE.match(line)
    if m is None:
        return False
    words = m[2].split()
    small = sum(x[0].islower() for x in words)
    return len(words) >= (4 if m[1] else 5) and small >= 0.6 * len(words)


def _paths(scores: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The best sequence of classes for the lines of several stretches of lines.

    Where no line speaks for another class than the stretch as a whole, that class is the path; the others are advanced
    line by line together.
    """
    lines = np.repeat(begins - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(int(counts.sum()))
    starts = np.r_[0, np.cumsum(counts)[:-1]]
    here = scores[lines]
    lead = np.add.reduceat(here, starts, axis=0).argmax(axis=1).astype(np.int8)
    other = here.max(axis=1) > here[np.arange(len(here)), np.repeat(lead, counts)]
    hard = np.flatnonzero(np.logical_or.reduceat(other, starts))
    out: list[np.ndarray] = [np.full(n, x, np.int8) for n, x in zip(counts.tolist(), lead.tolist())]
    order = hard[np.argsort(-counts[hard], kind="stable")]
    if not len(order):
        return out
    begins, counts = begins[order], counts[order]
    steps = int(counts[0])
    alive = np.searchsorted(-counts, -np.arange(steps), "left")
    value = scores[begins].copy()
    where = np.r_[0, np.cumsum(counts)]
    back = np.empty((int(where[-1]), scores.shape[1]), np.int8)
    own = np.arange(scores.shape[1], dtype=np.int8)
    rows = np.arange(len(counts))
    for t in range(1, steps):
        n = int(alive[t])
        v = value[:n]
        best = v.argmax(axis=1)
        jump = v[rows[:n], best] - np.float32(SWITCH)
        stay = v >= jump[:, None]
        back[where[:n] + t] = np.where(stay, own, best[:, None].astype(np.int8))
        value[:n] = np.where(stay, v, jump[:, None]) + scores[begins[:n] + t]
    flat = np.empty(len(back), np.int8)
    at = value.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        n = int(alive[t])
        place = where[:n] + t
        flat[place] = at[:n]
        if t:
            at[:n] = back[place, at[:n]]
    for i, a, n in zip(order.tolist(), where.tolist(), counts.tolist()):
        out[i] = flat[a : a + n]
    return out


def _confidence(family: np.ndarray, within: np.ndarray, of: int) -> float:
    """How far the mean score of one family, and in it of one language, is above the next, as a probability: the lower of both."""
    own = _FAMILY_OF[of]
    relatives = within[(_FAMILY_OF == own) & (np.arange(len(LANGUAGES)) != of)]
    margin = min(family[own] - np.delete(family, own).max(), within[of] - relatives.max())
    return float(1 / (1 + np.exp(-2.5 * margin)))


def _walked(family: np.ndarray, within: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The languages of the lines of several documents: families first, then the languages inside every run of a family."""
    if not len(begins):
        return []
    first = np.concatenate(_paths(family, begins, counts))
    edges = np.r_[0, np.cumsum(counts)]
    new = np.r_[True, first[1:] != first[:-1]]
    new[edges[:-1]] = True
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, len(first)])
    doc = np.searchsorted(edges, starts, "right") - 1
    at = begins[doc] + starts - edges[doc]
    out = np.empty(len(first), np.int8)
    for f in range(len(FAMILIES)):
        members = np.flatnonzero(_FAMILY_OF == f)
        mine = np.flatnonzero(first[starts] == f)
        if len(mine):
            runs = _paths(within[:, members], at[mine], sizes[mine])
            lines = np.repeat(starts[mine] - np.r_[0, np.cumsum(sizes[mine])[:-1]], sizes[mine]) + np.arange(int(sizes[mine].sum()))
            out[lines] = members[np.concatenate(runs)]
    return np.split(out, edges[1:-1])


Found = tuple[str | None, float, list[tuple[str, int, int, float]]]


def classify(texts: list[str], w: np.ndarray, least: float = MIN_CONFIDENCE) -> list[Found]:
    """Of each text: main language, confidence, and stretches (language, first line, characters, confidence)
    of at least the confidence ``least``.

    A text without a token has no language and confidence 0.
    """
    seen: dict[str, int] = {}
    ids: list[int] = []
    counts = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        lines = split_lines(text)
        counts[i] = len(lines)
        ids += [seen.setdefault(x, len(seen)) for x in lines]
    unique = list(seen)
    family_unique, within_unique = line_scores(unique, w)
    sentences = np.fromiter((is_sentence(x) for x in unique), bool, len(unique))
    # A sentence says nothing of a family of programming languages, and little of the kind of prose.
    weights = np.where(np.arange(len(FAMILIES)) == _PROSE_FAMILY, np.float32(_SENTENCE_WEIGHT), np.float32(0))
    family_unique[sentences] *= weights
    within_unique[sentences] *= weights[_FAMILY_OF]
    chars_unique = np.array([len(x) + 1 for x in unique], np.int64)
    ids_a = np.array(ids)
    family, within, chars, said = family_unique[ids_a], within_unique[ids_a], chars_unique[ids_a], sentences[ids_a]
    begins = np.r_[0, np.cumsum(counts)[:-1]]
    filled = chars > 1
    weight = np.minimum(chars, PIECE)[:, None]
    lead_family = np.add.reduceat(family * weight, begins, axis=0).argmax(axis=1)
    inside = np.add.reduceat(within * weight, begins, axis=0)
    lead = np.where(_FAMILY_OF[None] == lead_family[:, None], inside, -np.inf).argmax(axis=1)
    # A document is walked line by line only if some line speaks for another family or language; else the path never changes.
    leader = np.repeat(lead, counts)
    rows = np.arange(len(leader))
    relatives = np.where(_FAMILY_OF[None] == _FAMILY_OF[leader][:, None], within, -np.inf).max(axis=1)
    other = (family.max(axis=1) > family[rows, _FAMILY_OF[leader]]) | (relatives > within[rows, leader])
    walk = np.flatnonzero(np.logical_or.reduceat(other, begins))
    units = (chars / UNIT).astype(np.float32)[:, None]
    paths = dict(zip(walk.tolist(), _walked(family * units, within * units, begins[walk], counts[walk])))
    out: list[Found] = []
    prose = {LANGUAGES.index(x) for x in PROSE}
    markdown = LANGUAGES.index("markdown")
    for i in range(len(texts)):
        s, n = int(begins[i]), int(counts[i])
        if not filled[s : s + n].any():
            out.append((None, 0.0, []))
            continue
        if i not in paths:
            some = s + np.flatnonzero(filled[s : s + n])
            out.append((LANGUAGES[lead[i]], _confidence(family[some].mean(axis=0), within[some].mean(axis=0), int(lead[i])), []))
            continue
        has, size = filled[s : s + n], np.where(filled[s : s + n], chars[s : s + n], 0)
        path = paths[i]
        cuts = np.r_[0, np.flatnonzero(np.diff(path)) + 1, n]
        runs = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            held = a + np.flatnonzero(has[a:b])
            if len(held):
                lang = int(path[a])
                share = size[held] / size[held].sum()
                runs.append((lang, held, _confidence(share @ family[s + held], share @ within[s + held], lang)))
        # Only what is no sentence speaks for a language of code; sentences count for the kinds of prose.
        spoken = np.where(said[s : s + n], 0, size)
        amount = np.zeros(len(LANGUAGES))
        aside = 0
        for lang, held, sure in runs:
            if lang in prose:
                aside += size[held].sum()
            else:
                code, every = spoken[held].sum(), size[held].sum()
                # Comments among code belong to it; a run of little else than sentences counts without them.
                amount[lang] += (every if lang == markdown or code >= 0.3 * every else code) * min(1.0, sure / MIN_CONFIDENCE)
        if amount[markdown]:
            amount[markdown] += aside
        main = int(amount.argmax())
        if amount[main] <= CODE_SHARE * aside and not amount[markdown]:
            main = LANGUAGES.index(PROSE[0])
        mine = np.concatenate([held for lang, held, _ in runs if lang == main] or [np.flatnonzero(has)])
        stretches = []
        for lang, held, sure in runs:
            if lang != main and lang not in prose and sure >= least:
                length = int(chars[s + held[0] : s + held[-1] + 1].sum()) - 1
                if length >= MIN_STRETCH:
                    stretches.append((LANGUAGES[lang], int(held[0]), length, sure))
        out.append((LANGUAGES[main], _confidence(family[s + mine].mean(axis=0), within[s + mine].mean(axis=0), main), stretches))
    return out


def training_sample(documents: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, max_chars: int = TRAIN_MAX_CHARS) -> tuple[list[str], list[str]]:
    """At most ``per_language`` texts a language whose label and extension agree, chosen by a hash of the id.

    The whole table is drawn from: files may hold one language each, so that some of them say nothing of the others.
    """
    agree = documents.select("doc_id", "text", language_of_label(F.col("lang")).alias("label"), language_of_path(F.col("path")).alias("ext")).filter(
        F.col("doc_id").isNotNull() & (F.col("label") == F.col("ext"))
    )
    counts = {r["label"]: r["count"] for r in agree.groupBy("label").count().collect()}
    if not counts:
        return [], []
    # A little more than wanted passes the hash, so that long texts may drop out.
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.3 * per_language / n))])
    draw = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))) < F.element_at(share, F.col("label"))
    rows = agree.filter(draw & F.col("text").isNotNull() & (F.length("text") <= max_chars)).select("doc_id", "label", "text").orderBy("doc_id").limit(2 * per_language * len(LANGUAGES)).collect()
    taken: dict[str, int] = {}
    texts, labels = [], []
    for r in rows:
        if taken.get(r["label"], 0) < per_language:
            taken[r["label"]] = taken.get(r["label"], 0) + 1
            texts.append(r["text"])
            labels.append(r["label"])
    return texts, labels


#: The last fitted weights, by what they were fitted on.
_FITTED: dict[str, np.ndarray] = {}


def fitted(texts: list[str], labels: list[str]) -> np.ndarray:
    """``train``, remembered for the next query over the same sample."""
    name = hashlib.sha256("\0".join([*labels, *texts]).encode("utf-8", "replace")).hexdigest()
    if name not in _FITTED:
        _FITTED.clear()
        _FITTED[name] = train(texts, labels)
    return _FITTED[name]


def document_languages(documents: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """(doc_id, part, lang, confidence, first_line, n_chars): part ``main`` for each document, ``stretch`` for each stretch
    of another language of at least 200 characters, however low its confidence; beside them the row's own label in small letters and digits.

    A null or empty text has no main language (lang null, confidence 0). Rows without an id are left out. If no row has a
    usable label nothing can be learned, and every language is as good; the first is given with confidence 0.5.
    """
    texts, labels = training_sample(documents, per_language)
    weights = documents.sparkSession.sparkContext.broadcast(fitted(texts, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, label, texts = (c.to_pylist() for c in batch.columns)
            texts = [t or "" for t in texts]
            cuts = np.flatnonzero(np.diff(np.r_[-1, np.cumsum([len(t) for t in texts]) // SLICE_CHARS]))
            for lo, hi in zip(cuts, [*cuts[1:], len(ids)]):
                rows = []
                for i, (lang, sure, stretches) in enumerate(classify(texts[lo:hi], weights.value, least=0.0), lo):
                    rows.append((ids[i], label[i], "main", lang, sure, 0, len(texts[i])))
                    rows += [(ids[i], label[i], "stretch", *x[:1], x[3], x[1], x[2]) for x in stretches]
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=_NAMES)

    chosen = documents.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), plain_label(F.col("lang")).alias("label"), F.col("text"))
    return chosen.mapInArrow(run, "doc_id long, label string, part string, lang string, confidence double, first_line int, n_chars long")


_NAMES = ["doc_id", "label", "part", "lang", "confidence", "first_line", "n_chars"]


def label_languages(found: DataFrame) -> DataFrame:
    """(label, named) of the labels that no rule reads: the main language of LABEL_SHARE of their documents, of which there are
    at least LABEL_DOCUMENTS. Labels without such a language name none."""
    mains = found.filter((F.col("part") == "main") & F.col("label").isNotNull() & language_of_label(F.col("label")).isNull())
    each = mains.groupBy("label", "lang").agg(F.count(F.lit(1)).alias("n"))
    most = each.groupBy("label").agg(F.sum("n").alias("all"), F.max_by("lang", F.struct("n", "lang")).alias("named"), F.max("n").alias("n"))
    return most.filter((F.col("all") >= LABEL_DOCUMENTS) & (F.col("n") >= LABEL_SHARE * F.col("all"))).select("label", "named")


def language_findings(found: DataFrame) -> DataFrame:
    """(doc_id, finding, lang): ``label`` where the label is missing or names another language, ``segment`` for each other
    language of a stretch of at least the confidence MIN_CONFIDENCE. A label is read by rule, else by what its documents are."""
    found = cut(found)
    main = F.col("part") == "main"
    learned = label_languages(found).select(F.col("label").alias("__label"), "named")
    met = found.join(learned, F.col("label") == F.col("__label"), "left")
    named = F.coalesce(language_of_label(F.col("label")), F.col("named"))
    return (
        met.filter(F.col("lang").isNotNull() & F.when(main, ~named.eqNullSafe(F.col("lang"))).otherwise(F.col("confidence") >= MIN_CONFIDENCE))
        .select("doc_id", F.when(main, "label").otherwise("segment").alias("finding"), "lang")
        .distinct()
    )
