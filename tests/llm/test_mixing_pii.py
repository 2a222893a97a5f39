"""Mixing of sources, personal data, and the pipeline."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from policylake.llm import mixing, pii
from policylake.llm.queries import QUERIES
from tests.llm.conftest import prose


def test_every_prefix_of_the_cycle_is_less_than_a_block_off(spark):
    given = [("a", 0.37), ("b", 0.21), (None, 0.3), ("d", 0.117), ("e", 0.003)]
    plan = mixing.pfair_cycle(spark.createDataFrame(given, "source string, weight double"), 200).orderBy("slot").collect()
    period = plan[0].period
    assert [r.slot for r in plan] == list(range(period))
    done = dict.fromkeys((s for s, _ in given), 0)
    share = {r.source: r.share for r in plan}
    assert sum(share.values()) == period
    for r in plan:
        assert r.turn == done[r.source]
        assert math.floor(r.turn * period / r.share) <= r.slot < math.ceil((r.turn + 1) * period / r.share)
        done[r.source] += 1
        for s in share:
            assert abs(done[s] - (r.slot + 1) * share[s] / period) < 1


def _earliest_deadline_first(shares):
    """{(source, turn): slot}, one slot after the other; ties as the module ranks them: large shares, then late names."""
    period = sum(shares.values())
    names = sorted(shares, key=lambda s: (-shares[s], s is None, [-ord(c) for c in s or ""]))
    done, plan = dict.fromkeys(names, 0), {}
    for t in range(period):
        due = [(-(-(done[s] + 1) * period // shares[s]), i, s) for i, s in enumerate(names) if done[s] * period // shares[s] <= t]
        s = min(due)[2]
        plan[s, done[s]] = t
        done[s] += 1
    return plan


@pytest.mark.parametrize("many, cycle", [(1, 50), (2, 7), (7, 100), (40, 1), (300, 400)])
def test_cycle_is_earliest_deadline_first(spark, many, cycle):
    pick = random.Random(many)
    given = [(f"s{i:03}" if i != 1 else None, pick.random() ** 4) for i in range(many)]
    plan = mixing.pfair_cycle(spark.createDataFrame(given, "source string, weight double"), cycle).collect()
    expected = _earliest_deadline_first({r.source: r.share for r in plan})
    assert {(r.source, r.turn): r.slot for r in plan} == expected and len(plan) == len(expected) == plan[0].period


def test_odd_weights(spark):
    given = [("a", 1.0), ("a", 2.0), ("b", 3.0), ("c", None), ("d", -5.0), ("e", float("nan")), ("f", float("inf")), (None, 0.0)]
    plan = mixing.pfair_cycle(spark.createDataFrame(given, "source string, weight double"), 10).collect()
    assert {r.source: r.share for r in plan} == {"a": 5, "b": 5, "c": 1, "d": 1, "e": 1, "f": 1, None: 1}
    assert sorted(r.slot for r in plan) == list(range(15))
    none = spark.createDataFrame([("a", 0.0), (None, None)], "source string, weight double")
    assert {(r.source, r.share) for r in mixing.pfair_cycle(none, 10).collect()} == {("a", 1), (None, 1)}
    assert mixing.pfair_cycle(none.limit(0), 10).count() == 0
    docs = spark.createDataFrame([(1, "x y", "a"), (2, "z", "q"), (2, "z", "q")], "doc_id long, text string, source string")
    assert mixing.mix_sources(docs, spark.createDataFrame(given, "source string, weight double")).count() == 3


def test_mixture_is_whole_and_follows_the_weights(spark):
    rows = [(i, prose(i, 20 + i % 50), "ab"[i % 3 == 0] if i % 7 else None) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0), (None, 1.0)], "source string, weight double")
    got = mixing.mix_sources(docs, weights, block_chars=500, cycle=5, buckets=8).collect()
    assert sorted(r.doc_id for r in got) == list(range(2000))
    slots = {}
    for r in got:
        assert slots.setdefault(r.mix_slot, r.source) == r.source
    last = min(max(r.mix_slot for r in got if r.source == s) for s in ("a", "b", None))
    for t in range(1, last + 1):
        held = [s for k, s in slots.items() if k < t]
        assert abs(held.count("a") - 0.6 * t) < 1 + 1e-9 + t - len(held)
    for s in ("a", "b", None):
        size = sum(len(t) for _, t, x in rows if x == s)
        blocks = [r.mix_block for r in got if r.source == s]
        assert max(blocks) == pytest.approx(size / 500, abs=2)


def test_mixing_edges(spark, edge_docs, edge_rows, no_docs):
    assert mixing.mix_sources(edge_docs).count() == len(edge_rows)
    assert mixing.mix_sources(no_docs).count() == 0
    assert mixing.in_order(mixing.mix_sources(edge_docs)).count() == len(edge_rows)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"\D", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or \
                    kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    "mail a.b@c.de, x@y@z.com a@b.c_d@e.f.g @q.r s@t u@v..w", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255 1.2.3 0000255.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111 5500000000000004 1", "+1 (347) 555-9637 4103495397927849",
    "+49 30 1234567, +1, +12.34.56.78 +1-2-3", "漢字 é é@x.y \U0001F600 a@b.co 10.0.0.1", "9" * 30_000, "1 " * 20_000, "a@" * 5000,
    "1.1." * 5000, "+1" * 3000, "a" * 50_000 + "@b.c", "call jane (at) mail [dot] org or (212) 555-0187", None, "",
]


def test_base_spans(spark, sf):
    rows = list(enumerate(TEXTS)) + [(0, TEXTS[0]), (None, "x@y.zz")]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as row", "'c' as kind", "'c' as start")
    got = pii.span_digest(docs).collect()
    assert len(got) == len(rows)
    want = sorted(((-1 if d is None else d), hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest()) for d, t in rows)
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.base_sha256) for r in got) == want
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(TEXTS):
        spans = by[i].spans.split(",") if by[i].spans else []
        assert set(base_spans(t)) <= set(spans)
        order = [(list(BASE).index(k), int(a)) for k, a, _ in (s.split(":") for s in spans)]
        assert order == sorted(order)


def test_clean_texts_hold_nothing(spark, no_docs):
    docs = spark.createDataFrame([(i, prose(i, 100) + " in 2024, 12 of 350 (3.5 %)") for i in range(20)], "doc_id long, text string")
    assert all(r.spans == "" for r in pii.span_digest(docs).collect())
    assert pii.span_digest(no_docs).count() == 0


def test_expectation_maximisation_orders_labelers():
    """Patterns that most labelers support are likelier; a labeler that contradicts the rest counts for little."""
    patterns = [Row(kind=0, v0=a, v1=a, v2=b, v3=0, v4=a, n=n) for a, b, n in ((1, 1, 50), (1, -1, 40), (-1, 1, 45), (-1, -1, 55))]
    p = pii.reliabilities(patterns)
    assert min(p[(0, 1, 1, b, 0, 1)] for b in (1, -1)) > 0.9 and max(p[(0, -1, -1, b, 0, -1)] for b in (1, -1)) < 0.1
    assert pii.span_weights([]) == [0.0] * len(pii.span_weights([]))


def test_pipeline_stages(spark, sf, tmp_path_factory):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        assert set(columns) <= set(docs.columns) and 0 < docs.count() <= before
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        before = docs.count()
    assert QUERIES and docs.where(F.col("mix_slot").isNull()).count() == 0


def test_pipeline_stages_on_edges(spark, edge_rows, no_docs, sf):
    edge = spark.createDataFrame(edge_rows, no_docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf).count() == 0, name
        assert stage(spark, edge, sf).count() <= len(edge_rows), name
    gone = corpus_pipeline.near_duplicates(spark, edge, sf)
    assert {4} == {r.doc_id for r in gone.collect() if r.text == edge_rows[5][1] and r.doc_id is not None}


def test_near_duplicates_keep_one_row_of_a_group(spark, no_docs, sf):
    a, b = prose(70, 60), prose(71, 60)
    rows = [(4, a, "en", "s", 1)] * 3 + [(4, a.upper(), "en", "s", 1), (5, a, "en", "s", 1), (None, a, "en", "s", 1)] + \
        [(6, b, "en", "s", 1), (7, None, "en", "s", 1), (7, "", "en", "s", 1)] + [(None, prose(72, 60), "en", "s", 1)] * 2
    left = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, no_docs.schema), sf).collect()
    assert sorted(str(r.doc_id) for r in left) == ["4", "6", "7", "7", "None"]
