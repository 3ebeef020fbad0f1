"""Language, quality and toxicity classifiers: the kernel by definition, gradients,
held-out accuracy on the fixture, odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from tests.conftest import SF_CHECK
from veracity.llm import language_id as li
from veracity.llm import quality_cnn as qc
from veracity.llm import queries
from veracity.llm import toxicity as tx
from veracity.sources.tables import read_table


def ngrams(text):
    b = bytes(li.prepared(text))
    out = {b[i:i + n] for n in (1, 2) for i in range(len(b) - n + 1)}
    ids = li.spectrum_ids(li.prepared(text))
    return out | {int(x) for x in ids[2]}


def test_kernel_is_the_share_of_common_ngrams():
    texts = ["the cat sat", "The CAT!", "le chat", "ö"]
    sets = [ngrams(t) for t in texts]
    buffer = np.zeros((8, li.SPACE), bool)
    rows = li.presence(texts, buffer).copy()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert int((rows[i] & rows[j]).sum()) == len(a & b)


def test_machine_equals_ridge_on_the_full_kernel():
    """With every sample text a landmark, the Nystroem machine is kernel ridge regression."""
    rng = np.random.default_rng(1)
    sample = [(lang, np.unique(rng.integers(lo, lo + 400, 60))) for lang, lo in [("a", 0), ("b", 250)] for _ in range(12)]
    model = li.fit(sample, landmarks=100)
    x = np.zeros((len(sample), li.SPACE), bool)
    for row, (_, ids) in zip(x, sample, strict=True):
        row[ids] = True
    k = np.array([[len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b)) for _, b in sample] for _, a in sample])
    y = np.array([[1.0 if lang == n else -1.0 for n in "ab"] for lang, _ in sample])
    want = k @ np.linalg.solve(k + li.RIDGE * len(sample) / 100 * np.eye(len(k)), y)
    scores, known = model.decide(x)
    assert np.allclose(scores, want, atol=1e-3) and np.allclose(known, 1)


def test_a_text_without_a_letter_has_no_language(spark):
    rows = [(i, f"the cat sat on the mat {i}", "en") for i in range(8)] + [(i, f"le chat est assis {i}", "fr") for i in range(8, 16)]
    odd = ["½ ² ¾ 12", "Ⅳ Ⅷ", "́̀", "5 ¼", "日", "ª"]
    docs = spark.createDataFrame(rows + [(100 + i, t, None) for i, t in enumerate(odd)], "doc_id int, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in li.identify_languages(docs).collect()}
    assert [got[100 + i] for i in range(4)] == [("und", 0.0)] * 4
    assert got[104][0] != "und" and got[105][0] != "und"      # letters, though of no learned language


def test_unknown_scripts_are_rejected_and_mixed_texts_kept(spark):
    docs = read_table(spark, SF_CHECK, "documents").limit(0).unionByName(spark.createDataFrame(
        [(1, "Это русский текст, который никто не учил", None, "x", 1), (2, "日本語のテキストです", None, "x", 1),
         (3, "The and of that. Die und der nicht. " * 5, None, "x", 1)],
        "doc_id long, text string, lang string, source string, n_chars long"))
    both = docs.unionByName(read_table(spark, SF_CHECK, "documents"))
    kept = li.keep_known_languages(both, training=both["source"] != "x")
    assert {r["doc_id"] for r in kept.where("source = 'x'").collect()} == {3}
    assert kept.where("source <> 'x'").count() == 1000


def test_language_accuracy_on_held_out_documents(spark):
    got = queries.op2_string_kernel(spark, SF_CHECK).collect()
    truth = {r["doc_id"]: r["lang"] for r in read_table(spark, SF_CHECK, "documents").select("doc_id", "lang").collect()}
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)


@pytest.mark.parametrize(("name", "label", "least"), [("op4_byte_cnn", "quality", 0.95), ("op6_nb_ngrams", "toxic", 0.93)])
def test_label_accuracy_on_held_out_documents(spark, name, label, least):
    got = queries.QUERIES[name](spark, SF_CHECK).collect()
    truth = {r["doc_id"]: r[label] for r in read_table(spark, SF_CHECK, "labels").collect()}
    held = [r for r in got if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= least * len(held)
    scores = {y: np.mean([r["score"] for r in held if truth[r["doc_id"]] == y]) for y in (0, 1)}
    assert scores[1] > scores[0] + 0.3 and all(0 <= r["score"] <= 1 for r in got)


def test_network_gradients_are_right():
    rng = np.random.default_rng(5)
    net = qc.Net.start(0.3)
    texts = [qc.padded(bytes(rng.integers(32, 120, n, dtype=np.uint8))) for n in (40, 700, 1500, 256)]
    y = np.array([1, 0, 1, 0], np.float32)
    for p in net.params():
        p[...] = p.astype(np.float64)
    _, grads = net.gradients(texts, y)
    for p, g in zip(net.params(), grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, step = p[at], 1e-2
        p[at] = old + step
        up = net.gradients(texts, y)[0]
        p[at] = old - step
        down = net.gradients(texts, y)[0]
        p[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_network_reads_whole_texts_in_slices(monkeypatch):
    net = qc.Net.start(0.3)
    rng = np.random.default_rng(6)
    text = bytes(rng.integers(32, 120, 9000, dtype=np.uint8))
    whole = net.score([text])
    assert net.score([text[:-200] + b"%" * 200])[0] != whole[0]
    monkeypatch.setattr(qc, "SLICE_BLOCKS", 3)
    assert np.allclose(net.score([text]), whole)
    assert np.allclose(net.score([b"", None, text])[2], whole) and np.isfinite(net.score([b"", None])).all()


def test_toxicity_counts_cover_all_labelled_texts(spark):
    rows = [("abcd", 1), ("abcx", 0), ("zzabc", 1), ("", 0), ("a", 1)]
    yes, no, n_yes, n_no = tx.document_counts(spark.createDataFrame(rows, "text string, y int").repartition(3))
    assert (n_yes, n_no) == (3, 2)
    abc = tx.hashed_ngrams(np.frombuffer(b"abc", np.uint8))[0][0]
    assert yes[abc] == 2 and no[abc] == 1


def test_logistic_fit_reaches_the_optimum():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((400, 5)).astype(np.float32)
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.3 * rng.standard_normal(400) > 0).astype(np.float32)
    w, b = tx.fit_logistic(x, y, 1e-2, 800)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) / len(y) + 1e-2 * w).max() < 1e-3


def test_edge_rows(edge_docs, edge_labels, empty_docs):
    n = edge_docs.count()
    lang = {(r["doc_id"], r["lang_pred"], r["score"]) for r in li.identify_languages(edge_docs).collect()}
    assert {x for x in lang if x[0] in (3, 4, 5, 11)} == {(i, "und", 0.0) for i in (3, 4, 5, 11)}
    assert {x[1] for x in lang if x[0] in (1, 6)} == {"en"} and {x[1] for x in lang if x[0] in (7, 9)} == {"de"}
    kept = li.keep_known_languages(edge_docs)
    assert kept.columns == edge_docs.columns
    assert not {3, 4, 5, 11} & {r["doc_id"] for r in kept.collect()} and kept.where("doc_id in (1, 2, 6, 7)").count() == 5
    tox = tx.toxicity(edge_docs, edge_labels).collect()
    qual = qc.quality(edge_docs, edge_docs.selectExpr("text", "if(doc_id = 13, 0, 1) as y")).collect()
    for got in (tox, qual):
        assert len(got) == n and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert li.identify_languages(empty_docs).count() == 0 and li.keep_known_languages(empty_docs).count() == 0
    assert tx.toxicity(empty_docs, edge_labels).count() == 0
    assert qc.quality(empty_docs, edge_docs.selectExpr("text", "1 as y").limit(0)).count() == 0
    assert {r["lang_pred"] for r in li.identify_languages(edge_docs.withColumn("lang", edge_docs["row"].substr(1, 0))
                                                          .where("false")).collect()} == set()
    one = qc.learn(edge_docs.selectExpr("text", "1 as y"))
    assert one == 1.0 and {r["score"] for r in qc.score(edge_docs, one, "doc_id", "text").collect()} == {1.0}
