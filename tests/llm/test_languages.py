import numpy as np
import pytest

from varweave.llm import languages as L
from varweave.session import read


def test_labels(spark):
    rows = [("JS", "javascript"), (" Python3 ", "python"), ("ANSI C", "c"), ("shell  script", "shell"), ("xml", None), ("english", None), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "x string, want string")
    got = df.select(L.language_of_label(df.x).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_lines_and_features():
    assert L.split_lines("a\r\nb\rc\n") == ["a", "b", "c", ""]
    long = "x = 1; " * 500
    assert "".join(L.split_lines(long)) == long and max(map(len, L.split_lines(long))) <= 2 * L.PIECE
    f = L.featurize(["", "a b", "  ", "a b", "\tq"])
    assert np.diff(f.offset).tolist() == [0, 2, 0, 2, 1] and f.token[0] == f.token[2] and f.start[1] == f.start[3]


def test_odd_texts():
    w = L.train([], [])
    found = L.classify(["", "\n\n", "x", "é" * 50, "y " * 40_000], w)
    assert [x[0] is None for x in found] == [True, True, False, False, False] and all(0 <= x[1] <= 1 for x in found)


@pytest.fixture(scope="module")
def weights(spark, data):
    docs = read(spark, data.replace("0.001", "0.01"), "documents")
    return L.train(*L.training_sample(docs))


def test_held_out_accuracy(spark, data, weights):
    """Documents of another table: label and extension agree on nearly all main languages."""
    docs = read(spark, data, "documents")
    agree = docs.select("text", L.language_of_label(docs.lang).alias("a"), L.language_of_path(docs.path).alias("b")).filter("a = b").collect()
    found = L.classify([r["text"] for r in agree], weights)
    assert np.mean([r["a"] == x[0] for r, x in zip(agree, found)]) >= 0.95


def test_stretches(spark, data, weights):
    docs = read(spark, data.replace("0.001", "0.01"), "documents")
    clean = docs.select("text", L.language_of_label(docs.lang).alias("a"), L.language_of_path(docs.path).alias("b")).filter("a = b AND length(text) BETWEEN 500 AND 3000").collect()
    by = {}
    for r, (lang, _, stretches) in zip(clean, L.classify([r["text"] for r in clean], weights)):
        if lang == r["a"] and not stretches:
            by.setdefault(lang, "\n".join(L.split_lines(r["text"])))
    cases = [("python", "sql"), ("javascript", "css"), ("c", "rust"), ("html", "javascript"), ("markdown", "go"), ("yaml", "shell")]
    for host, guest in [c for c in cases if c[0] in by and c[1] in by]:
        part = ""
        for line in reversed(by[guest].strip().split("\n")):
            if len(part) > 380:
                break
            part = f"{line}\n{part}" if part else line
        text = f"{by[host]}\n\n{part}\n\n{by[host]}"
        (lang, sure, stretches), (lang2, _, none) = L.classify([text, by[host] * 3], weights)
        assert lang == lang2 == host and sure > 0.7 and none == []
        assert [s[0] for s in stretches] == [guest] and abs(stretches[0][2] - len(part)) < 200
        assert stretches[0][1] >= by[host].count("\n") - 2


def test_table(spark, data):
    docs = read(spark, data, "documents")
    odd = spark.createDataFrame([(90001, None, None, "a.py", 1), (90002, "", "python", "a.py", 1), (None, "x", "c", "a.c", 1)], "doc_id long, text string, lang string, path string, part int")
    both = docs.select("doc_id", "text", "lang", "path").withColumn("part", docs.doc_id.cast("int")).unionByName(odd)
    found = L.document_languages(both)
    mains = found.filter("part = 'main'")
    assert mains.count() == docs.count() + 2 and mains.filter("doc_id >= 90001 AND lang IS NULL AND confidence = 0").count() == 2
    out = L.language_findings(found)
    assert out.filter("doc_id >= 90001").count() == 0 and out.count() == out.distinct().count() > 0
    assert L.document_languages(both.limit(0)).count() == 0


def test_table_of_many_files(spark, data, tmp_path):
    """The sample and the findings do not depend on how many files the table lies in, or on how languages lie in them."""
    docs = read(spark, data, "documents").select("doc_id", "text", "lang", "path")
    docs.repartition(96).write.parquet(f"{tmp_path}/many")
    language = L.language_of_path(docs.path)
    common = spark.range(1000, 1100).selectExpr("id AS doc_id", "'x' AS text", "CAST(NULL AS string) AS lang", "'a.txt' AS path")
    common.repartition(100).write.parquet(f"{tmp_path}/sorted")
    docs.repartitionByRange(13, language).write.mode("append").parquet(f"{tmp_path}/sorted")
    want = L.training_sample(docs)
    found = {tuple(r) for r in L.language_findings(L.document_languages(docs)).collect()}
    assert len(want[0]) > 0 and len(found) > 0
    for name in ("many", "sorted"):
        table = spark.read.parquet(f"{tmp_path}/{name}")
        assert len(table.inputFiles()) > 64
        assert L.training_sample(table) == want
        assert {tuple(r) for r in L.language_findings(L.document_languages(table)).collect() if r["doc_id"] < 1000} == found


@pytest.mark.parametrize("one_line", [True, False])
def test_short_stretches(spark, data, weights, one_line):
    """Of 200 to 260 characters of code, on one line or on several, most are found in a file of other code."""
    docs = read(spark, data.replace("0.001", "0.01"), "documents")
    clean = docs.select("text", L.language_of_label(docs.lang).alias("a"), L.language_of_path(docs.path).alias("b")).filter("a = b AND length(text) BETWEEN 800 AND 4000").orderBy("doc_id").collect()
    by = {}
    for r, (lang, _, stretches) in zip(clean, L.classify([r["text"] for r in clean], weights)):
        if lang == r["a"] and lang not in ("text", "markdown") and not stretches:
            by.setdefault(lang, []).append(L.split_lines(r["text"]))
    rng = np.random.default_rng(3)
    texts, guests = [], []
    while len(texts) < 100:
        host, guest = rng.choice(sorted(by), 2, replace=False)
        lines, source = by[host][rng.integers(len(by[host]))], by[guest][rng.integers(len(by[guest]))]
        a = int(rng.integers(len(source)))
        b = next((b for b in range(a + 1, len(source)) if len("\n".join(source[a:b])) >= 200), a)
        part = " ".join(x.strip() for x in source[a:b]) if one_line else "\n".join(source[a:b])
        if 200 <= len(part) <= 260 and not any(map(L.is_sentence, source[a:b])):
            at = int(rng.integers(len(lines) + 1))
            texts.append("\n".join([*lines[:at], part, *lines[at:]]))
            guests.append(guest)
    hits = [guest in [s[0] for s in x[2]] for guest, x in zip(guests, L.classify(texts, weights))]
    assert np.mean(hits) >= 0.9


def test_weak_stretches_keep_their_confidence(spark, data):
    docs = read(spark, data.replace("0.001", "0.01"), "documents")
    found = L.document_languages(docs).cache()
    weak = found.filter((found.part == "stretch") & (found.confidence < L.MIN_CONFIDENCE))
    assert weak.count() > 0 and weak.filter("n_chars < 200").count() == 0
    strong = found.filter((found.part == "stretch") & (found.confidence >= L.MIN_CONFIDENCE)).select("doc_id", "lang").distinct()
    segments = L.language_findings(found).filter("finding = 'segment'").select("doc_id", "lang")
    assert sorted(map(tuple, segments.collect())) == sorted(map(tuple, strong.collect()))


def test_scattered_evidence_is_walked(weights):
    """Lines that each lean to another language by less than 0.7 are enough for a document to be searched."""
    text = "\n".join(["x"] * 40 + ["y"] * 40)
    scores = np.zeros((2, len(L.LANGUAGES)), np.float32)
    scores[0, 0], scores[1, 1], scores[1, 0] = 1.5, 1.0, 0.4
    with pytest.MonkeyPatch.context() as m:
        family = np.repeat(np.eye(1, len(L.FAMILIES), dtype=np.float32), 2, axis=0)
        m.setattr(L, "line_scores", lambda lines, w: tuple(x[[0 if line[0] == "x" else 1 for line in lines]] for x in (family, scores)))
        (lang, _, stretches), = L.classify([text.replace("x", "x" * 50).replace("y", "y" * 50)], weights)
    assert lang == L.LANGUAGES[0] and [s[0] for s in stretches] == [L.LANGUAGES[1]]


def test_families_come_first(weights):
    """Inside a family's run only that family's machines speak, however much others are for a language outside it."""
    within = np.zeros((1, len(L.LANGUAGES)), np.float32)
    within[0, [L.LANGUAGES.index("go"), L.LANGUAGES.index("sql")]] = 0.5, 1.5
    family = np.array([[0.6, 0.5, 0, 0]], np.float32)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(L, "line_scores", lambda lines, w: (np.repeat(family, len(lines), axis=0), np.repeat(within, len(lines), axis=0)))
        (lang, _, stretches), = L.classify(["\n".join(f"{i} := {i}" for i in range(60))], weights)
    assert (lang, stretches) == ("go", [])


def test_labels_that_no_rule_reads(spark):
    """An unknown spelling names what most of its documents are, if they are enough; another unknown label is wrong."""
    rows = [(i, "gopher-ish", "main", "go" if i % 5 else "c", 0.9, 0, 10) for i in range(50)]
    rows += [(100 + i, "binary", "main", ["c", "go", "sql"][i % 3], 0.9, 0, 10) for i in range(60)] + [(200, "rare", "main", "go", 0.9, 0, 10)]
    found = spark.createDataFrame(rows, "doc_id long, label string, part string, lang string, confidence double, first_line int, n_chars long")
    assert [tuple(r) for r in L.label_languages(found).collect()] == [("gopher-ish", "go")]
    got = {r["doc_id"] for r in L.language_findings(found).collect()}
    assert got == {i for i in range(50) if i % 5 == 0} | set(range(100, 160)) | {200}
