import math
from collections import Counter

import numpy as np
import pytest

from tessella.llm import langid
from tessella.llm.langid import op1_language_id
from tests.llm.conftest import edge_rows


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = [r for r in op1_language_id(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(rows) > 200
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.99 * len(rows)


def test_awkward_rows(spark, edge_dir):
    rows = op1_language_id(spark, edge_dir).collect()
    assert len(rows) == len(edge_rows())
    by = {r.doc_id: r for r in rows}
    for i in (4, 5, 6, 11):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[9].lang_pred == "de" and by[3].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in rows)
    assert (by[7].lang_pred, by[7].score) == (by[8].lang_pred, by[8].score)


def test_no_rows_and_no_labels(spark, empty_dir):
    assert op1_language_id(spark, empty_dir).collect() == []
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(df, langid.train(df)).collect()] == [("und", 0.0)]


def _buckets(text):
    """One n-gram after another, by the definition."""
    line = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    if line == "  ":
        line = " "
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            h = 0
            for c in line[i : i + n]:
                h = (h * 0x01000193 + ord(c) + 1) & 0xFFFFFFFF
            yield (((h ^ (h >> 15)) * (0x9E3779B1 + 2 * n)) & 0xFFFFFFFF) >> (32 - langid.BUCKETS.bit_length() + 1)


def _bayes(rows, labelled, alpha=0.5):
    counts, texts = {}, Counter()
    for text, lang in labelled:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(_buckets(text) if text else [])
            texts[lang] += 1
    names = sorted(counts)
    log_p = {x: lambda b, own=counts[x], n=sum(counts[x].values()): math.log(own[b] + alpha) - math.log(n + alpha * langid.BUCKETS) for x in names}
    for text in rows:
        if not text or not any(map(str.isalpha, text)):
            yield "und", 0.0
            continue
        grams = Counter(_buckets(text))
        weight = min(1.0, langid.EVIDENCE / sum(grams.values()))
        logits = [math.log(texts[x] / sum(texts.values())) + weight * sum(k * log_p[x](b) for b, k in grams.items()) for x in names]
        best = max(range(len(names)), key=lambda i: (logits[i], -i))
        yield names[best], 1 / sum(math.exp(x - logits[best]) for x in logits)


@pytest.mark.parametrize("most", [500, 2])
def test_scores_equal_brute_force(spark, edge_dir, monkeypatch, most):
    """Also with more languages than one block holds."""
    monkeypatch.setattr(langid, "LANGUAGES", most)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").where("doc_id < 120")
    docs = docs.union(spark.read.parquet(f"{edge_dir}/documents.parquet").where("n_chars < 9000 or n_chars is null").select("doc_id", "text", "lang"))
    rows = docs.collect()
    got = langid.identify(docs, langid.train(docs)).collect()
    want = {r.text: x for r, x in zip(rows, _bayes([r.text for r in rows], [(r.text, r.lang) for r in rows]), strict=True)}
    assert len(got) == len(rows)
    for r in got:
        assert r.lang_pred == want[r.text][0] and r.score == pytest.approx(want[r.text][1], abs=1e-4)


def test_long_texts_score_as_in_one_stretch(monkeypatch, spark):
    df = spark.createDataFrame([("en", "the cat and the dog"), ("de", "der hund und die katze")], "lang string, text string")
    (block,) = langid.train(df).blocks()
    text = "the hund and katze the " * 500
    whole = block.logits([text])
    monkeypatch.setattr(langid, "CHUNK", 97)
    monkeypatch.setattr(langid, "GATHERED", 100)
    parts = block.logits(["a", text, None])
    assert np.abs(np.exp(parts[1] - parts[1].max()) - np.exp(whole[0] - whole[0].max())).max() < 0.05


def test_other_columns_stay(spark, clashing):
    model = langid.train(clashing)
    out = langid.identify(clashing, model)
    assert set(out.columns) == set(clashing.columns)
    assert out.where("size = 'own size'").count() == clashing.count()
