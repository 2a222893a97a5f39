"""Quality classifier and quality rules."""

import re
from collections import Counter

import numpy as np
import pytest

from policylake.llm import quality_model, quality_rules
from policylake.llm.queries import QUERIES
from tests.llm.conftest import prose


def test_scores_on_edge_rows(spark, edge_docs, edge_rows, no_docs):
    labels = spark.createDataFrame([(4, 1), (6, 1), (9, 0), (11, 0), (None, 1), (8, None), (9, 0)], "doc_id long, quality int")
    model = quality_model.fit(edge_docs, labels)
    rows = quality_model.scored(edge_docs, model).collect()
    assert len(rows) == len(edge_rows) and all(0 <= r.quality_score <= 1 for r in rows)
    same = [r.quality_score for r in rows if r.doc_id == 4]
    assert same[0] == same[1]
    assert quality_model.scored(no_docs, model).count() == 0


def test_labels_missing_or_of_one_class(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(4, 0), (6, 0), (9, 0)], "doc_id long, quality int")
    assert all(r.quality_score > 0.5 for r in quality_model.scored(edge_docs, quality_model.fit(edge_docs, none)).collect())
    assert all(r.quality_score < 0.5 for r in quality_model.scored(edge_docs, quality_model.fit(edge_docs, one)).collect())
    quality_model.fit(no_docs, one)


def test_sum_of_squares_identity():
    random = np.random.default_rng(1)
    linear, factors, val = random.normal(size=6), random.normal(size=(6, 3)), random.normal(size=6)
    idx = np.array([0, 1, 2, 3, 4, 5])
    margin, _ = quality_model._margin(np.zeros(6, int), idx, val, 1, 0.5, linear, factors)
    pairs = sum(factors[i] @ factors[j] * val[i] * val[j] for i in range(6) for j in range(i + 1, 6))
    assert margin[0] == pytest.approx(0.5 + linear @ val + pairs)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op6_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    n, right = got.count(), got.where("predicted = quality").count()
    assert n > 100 and right >= 0.97 * n


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    often = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if often[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_base_statistics(spark, sf, edge_docs, edge_rows):
    for docs in (edge_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        rows = quality_rules.text_statistics(docs, ("doc_id", "text")).collect()
        assert rows
        for r in rows:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == statistics(r.text)


def test_rules_on_edge_rows(spark, edge_docs, edge_rows, no_docs):
    rows = quality_rules.judged(edge_docs, ("doc_id",)).collect()
    assert len(rows) == len(edge_rows)
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 50)
    assert quality_rules.judged(no_docs).count() == 0


def test_outliers_go_and_ordinary_texts_stay(spark):
    ordinary = [(i, prose(i, 80 + i % 200), "en", "s") for i in range(300)]
    odd = [(1000 + i, "### ".join(prose(i + 500, 120).split()), "en", "s") for i in range(20)]
    docs = spark.createDataFrame(ordinary + odd, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.judged(docs).collect()}
    assert all(kept[i] for i, *_ in ordinary) and not any(kept[i] for i, *_ in odd)


def test_moderate_outliers_of_a_tight_group_go(spark):
    """Twice the mean word length, and three times the words, are far from texts that differ by a few words."""
    tight = [(i, prose(i, 190 + i % 20)) for i in range(300)]
    odd = [(1000 + i, " ".join(w * 2 for w in prose(i + 500, 200).split())) for i in range(5)] + \
        [(2000 + i, prose(i + 700, 600)) for i in range(5)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in tight + odd], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.judged(docs).collect()}
    assert all(kept[i] for i, _ in tight) and not any(kept[i] for i, _ in odd)
    equal = spark.createDataFrame([(i, tight[0][1], "en", "s") for i in range(20)], docs.schema)
    assert all(r.kept for r in quality_rules.judged(equal).collect())


def test_estimate_equals_a_plain_one(spark):
    """A C-step's core and moments, against numpy."""
    random = np.random.default_rng(5)
    x = np.concatenate([random.normal(size=(400, 5)), random.normal(8, 1, size=(60, 5))])
    rows = spark.createDataFrame([(0, *map(float, r)) for r in x], "g int, " + ", ".join(f"{n} double" for n in quality_rules.NAMES))
    row = quality_rules.mcd(rows, ["g"]).first()
    core = x[:400]
    assert np.abs(np.array(row.center) - core.mean(0)).max() < 0.35
    inverse = np.zeros((5, 5))
    for k, (i, j) in enumerate(quality_rules._triangle()):
        inverse[i, j] = inverse[j, i] = row.inverse[k]
    off = x - row.center
    far = np.einsum("ni,ij,nj->n", off, inverse, off)
    assert far[400:].min() > quality_rules.CUTOFF > np.quantile(far[:400], 0.99)
