"""Conversation repair, periodic runs and exact top-k search against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from policylake.llm import conversations, periodic, topk
from policylake.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import prose
from tests.oracle_compare import compare, connect

BLANK = re.compile(r"[\x20\x09-\x0D]+")

# --- conversations -----------------------------------------------------------------------


def plain_repair(rows, begin=0):
    """(cost, audit) of marked rows by dynamic programming from the end; rows: (initial, fault)."""
    legal = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    wanted = {0: 2, 1: 2, 2: 3, 3: 2}
    after = {0: (0, ""), 3: (0, "")}
    for i in range(len(rows), -1, -1):
        best = dict(after) if i == len(rows) else {}
        if i < len(rows):
            initial, fault = rows[i]
            for state in range(4):
                options = [(3, "D", state)]
                if fault not in ("blank", "duplicate"):
                    extra = fault == "truncated"
                    if (state, initial) in legal:
                        options.append((extra, "K", legal[state, initial]))
                    options.append((2 + extra, "R", wanted[state]))
                best[state] = min((c + after[s][0], e + after[s][1]) for c, e, s in options)
        for _ in range(4):
            for state in range(4):
                if wanted[state] in best:
                    more = (2 + best[wanted[state]][0], "I" + best[wanted[state]][1])
                    best[state] = min(best.get(state, more), more)
        after = best
    return after[begin]


def expected_reports(table):
    """op11 for rows (conv_id, turn, role, text) that are unique by conversation and turn."""
    out, by_conv = {}, defaultdict(list)
    for conv, turn, role, text in table:
        by_conv[conv]
        shown = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        fault = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = "user" if fault == 4 else shown[2], shown[3]
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        by_conv[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    for conv, rows in by_conv.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, marked = set(), []
        for turn, role, text in rows:
            words = BLANK.sub("", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role[:1], fault))
        cost, audit = plain_repair(marked)
        turns = [t for t, *_ in rows if t is not None]
        repaired, left, state = [], iter(rows), "a"
        for edit in audit:
            row = None if edit == "I" else next(left)
            if edit == "D":
                continue
            role = row[1] if edit == "K" else "assistant" if state == "u" else "user"
            state = role[0]
            repaired.append(f"{role}:{row[2] if row else ''}")
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(f == k for _, f in marked) for k in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(marked, marked[1:])), cost, audit,
                     hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def reports(spark, folder):
    rows = QUERIES["op11_conversation_repair"](spark, folder).collect()
    found = {r.conv_id: tuple(r[f] for f in FIELDS) for r in rows}
    assert len(found) == len(rows)
    return found


def test_search_against_dynamic_programming():
    pick = random.Random(3)
    faults = {"x": "blank", "S": "truncated", "U": "truncated", "A": "truncated", "!": "truncated"}
    for _ in range(1500):
        marks = "".join(pick.choice("suaua" "SUAx?!") for _ in range(pick.randint(0, 12)))
        assert conversations.cheapest(marks) == plain_repair([(m.lower(), faults.get(m)) for m in marks]), marks


def test_chunks_join_to_the_same_answer():
    pick = random.Random(4)
    for _ in range(400):
        marks = "".join(pick.choice("uaua" "suaUAx?!") for _ in range(pick.randint(1, 14)))
        ways, at, whole = conversations._Ways(1), 0, ""
        pieces = {}
        while at < len(marks):
            part = marks[at:at + pick.randint(1, 4)]
            found = {(b, e): conversations.cheapest(part, b, e) for b in range(4) for e in range(4)}
            pieces[at] = found
            ways.add({"part": 0, "seq": at, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "head": "u", "tail": "a",
                      "first_turn": None, "last_turn": None,
                      "ways": [{"begin": b, "end": e, "cost": w[0], "edits": w[1]} for (b, e), w in found.items() if w]})
            at += len(part)
        for step in ways.records():
            whole += pieces[step["seq"]][step["begin"], step["end"]][1] + step["more"]
        assert (step["cost"], whole) == conversations.cheapest(marks), marks


def test_repair_of_the_table(spark, sf):
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert reports(spark, sf) == expected_reports(table)


def edge_conversations():
    rows = [(None, None, None, None), (None, 1, "user", "Hello."), (1, None, "user", "A null turn."), (1, 0, "assistant", ""),
            (1, 7, "tool", "x"), (2, 0, "", "Empty role."), (2, 1, None, "Null role"), (3, 4, "user", None), (4, 0, "user", "x" * 300_000 + "."),
            (5, 0, "system", "Be kind."), (6, 0, "user", " \t\n"), (6, 3, "User", "Upper case.")]
    # A third of all rows in one conversation, with long stretches of one role and repeats.
    pick = random.Random(8)
    rows += [(7, t, pick.choice(["user", "user", "assistant"]), pick.choice([f"Text {t}.", f"Text {t}", "Again!"])) for t in range(700)]
    rows += [(100 + c, t, ("user", "assistant")[t % 2], prose(c * 9 + t, 6) + ".") for c in range(150) for t in range(c % 9)]
    return rows


@pytest.mark.parametrize("chunk", [512, 5])
def test_repair_of_edge_conversations(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    rows = edge_conversations()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "'c' as key", "'c' as part", "'c' as seq", "'c' as digest", "'c' as marked")
    table.repartition(7).write.parquet(f"{tmp_path}/conversations.parquet")
    found, known = reports(spark, str(tmp_path)), expected_reports(rows)
    assert found.keys() == known.keys()
    for conv in known:
        assert found[conv] == known[conv], conv


def test_ties_repeated_rows_and_no_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 2, "user", "Hi.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = conversations.repair(table)
    assert [(r.duplicate, r.audit, r.cost) for r in done.report.collect()] == [(3, "KDDKD", 9)]
    said = sorted((m.part, m.seq, m.place, m.turn, m.role, m.text, m.edit) for m in done.messages().collect())
    assert [m[3:] for m in said] == [(0, "user", "Hi.", "K"), (1, "assistant", "Yes.", "K")]
    empty = conversations.repair(table.limit(0))
    assert empty.report.count() == empty.messages().count() == empty.digests().count() == 0


# --- periodic runs ---------------------------------------------------------------------------


def plain_runs(words):
    """Every run, by trying every period at every place."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i:j + q]
            if len(stretch) >= max(6, 4 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                found.append((i, len(stretch), q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected_runs(doc_id, text):
    words = [w for w in BLANK.split(text or "") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    top = None
    for r in runs:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join("%d,%d,%d\n" % r for r in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_against_brute_force():
    pick = random.Random(1)
    for _ in range(1500):
        n, k = pick.randint(0, 80), pick.choice([1, 2, 2, 3, 4])
        words = [pick.randrange(k) for _ in range(n)]
        if pick.random() < 0.5 and n > 4:
            a = pick.randrange(n)
            p = 1 + (n - a) // pick.randint(3, 10)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert periodic.runs_of(np.array(words, np.int64)) == plain_runs(words), words


def test_splitting_is_stable_and_keeps_every_run():
    pick = random.Random(2)
    for _ in range(300):
        words = [pick.choice("abcdefgh") for _ in range(60)] + list("xyxyxyxy") + [pick.choice("abcdefgh") for _ in range(20)]
        codes = np.array([ord(w) for w in words])
        left = periodic.surviving(codes, np.zeros(len(codes), np.int64))
        kept = set(left.tolist())
        assert all(i in kept for s, length, _ in plain_runs(words) for i in range(s, s + length))
        for part in np.split(left, np.flatnonzero(np.diff(left) != 1) + 1):
            assert not len(part) or np.unique(codes[part], return_counts=True)[1].min() >= 4


def documents_of(spark, folder, frame):
    frame.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_periodic_runs_of_tables(spark, sf, tmp_path, edge_docs, edge_rows, no_docs):
    columns = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text) < 6000]
    some = spark.createDataFrame(texts, "doc_id long, text string")
    small = [(r[0], r[1]) for r in edge_rows if len(r[1] or "") < 50_000]
    for name, frame, rows in (("a", some, texts), ("b", edge_docs.where("text is null or length(text) < 50000"), small)):
        folder = tmp_path / name
        got = QUERIES["op12_periodic_runs"](spark, documents_of(spark, folder, frame)).collect()
        assert sorted(((r.doc_id, *(r[c] for c in columns)) for r in got), key=repr) == \
            sorted(((i, *expected_runs(i, t)) for i, t in rows), key=repr)
    assert QUERIES["op12_periodic_runs"](spark, documents_of(spark, tmp_path / "none", no_docs)).count() == 0


def test_periodic_runs_of_long_texts(spark, edge_docs, edge_rows):
    out = periodic.with_periodic_runs(edge_docs)
    assert len(out.columns) == len(edge_docs.columns) + 3
    rows = out.collect()
    assert len(rows) == len(edge_rows)
    looped = next(r for r in rows if r.doc_id == 9)
    assert [tuple(x) for x in looped.runs] == [(0, 40_000, 1)] and looped.collapsed == "na"


# --- exact top-k ---------------------------------------------------------------------------------


def test_topk_agrees_with_sql(spark):
    folder = "/root/testdata/sf0.01"
    ok, message = compare(connect(folder), spark, "op13_exact_topk", QUERIES["op13_exact_topk"], ORACLES["op13_exact_topk"], folder)
    assert ok, message


def plain_top(rows, k):
    """(query number, [(id, score)]) of rows (id, asks, vector), in whole numbers."""
    out = []
    for i, (own, asks, v) in enumerate(rows):
        if asks and own is not None and v is not None:
            scored = [(-sum(a * b for a, b in zip(v, w)), other) for j, (other, _, w) in enumerate(rows) if j != i and other is not None and w is not None]
            out.append((own, [(o, -s) for s, o in sorted(scored)[:k]]))
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 16])
def test_topk_of_edge_vectors(spark, monkeypatch, block):
    """Copies, ties, repeated ids, zeros, mixed lengths, nulls, and numbers beyond exact doubles; many blocks and packs."""
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "PACK", 4)
    monkeypatch.setattr(topk, "STEP", 8)
    pick = np.random.default_rng(6)
    vectors = [pick.integers(-50, 50, 8).tolist() for _ in range(120)]
    vectors += [vectors[3]] * 80 + [[0] * 8] * 5 + [[1, 2], [], [10 ** 12] * 8, [-(10 ** 12), 3, 10 ** 11 + 1], [7] * 9]
    rows = [(i, i % 5 == 0, v) for i, v in enumerate(vectors)] + [(5, True, vectors[5]), (5, True, vectors[9]), (None, True, vectors[1]), (900, True, None)]
    table = spark.createDataFrame([(i, a, v, "c", "c") for i, a, v in rows], "vec_id long, asks boolean, embedding array<long>, row string, cell string")
    got = defaultdict(list)
    found = topk.top_k(table.repartition(5), F.col("asks"), 5).collect()
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.id, r.score))
    want = defaultdict(list)
    clip = lambda s: min(max(s, -2 ** 63), 2 ** 63 - 1)
    for query, hits in plain_top(rows, 5):
        want[query] += [(i, clip(s)) for i, s in hits]
    assert {q: sorted(h) for q, h in got.items()} == {q: sorted(h) for q, h in want.items()}
    assert all(r["rank"] <= 5 for r in found)


def test_topk_broadcasts_no_packs(spark):
    """Packs are copied for every block, so their size isn't the one that Spark sees."""
    rows = [(i, [i * 37 % 101 - 50, i * 53 % 97 - 48, i % 7]) for i in range(300)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<long>"), F.col("vec_id") % 3 == 0, 4)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    want = {q: sorted((-sum(x * y for x, y in zip(rows[q][1], v)), i) for i, v in rows if i != q)[:4] for q in range(0, 300, 3)}
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.id))
    assert got == want


def test_topk_of_few_or_no_vectors(spark):
    kind = "vec_id long, asks boolean, embedding array<long>"
    assert topk.top_k(spark.createDataFrame([], kind), F.col("asks"), 5).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, True, [1])], kind), F.col("asks"), 5).count() == 0
    two = topk.top_k(spark.createDataFrame([(0, True, [1]), (1, None, [-3])], kind), F.col("asks"), 5).collect()
    assert [tuple(r) for r in two] == [(0, 1, 1, -3)]


def test_bounds_hold_and_stop_early():
    """No score exceeds its bound, and in a clustered set most candidates are never scored."""
    pick = np.random.default_rng(7)
    centres = pick.normal(0, 1000, (12, 16))
    x = np.rint(centres[pick.integers(0, 12, 600)] + pick.normal(0, 20, (600, 16))).astype(np.int64)
    pivots = topk.farthest_first(x, 32)
    table, lengths = topk.angles(x, pivots)
    looked_at = []
    for q in range(0, 600, 30):
        gap = np.abs(table - table[:, q:q + 1]).max(axis=0).astype(np.float64)
        bounds = lengths * lengths[q] * np.cos(np.maximum(gap - topk.SLACK, 0)) * (1 + 1e-9) + 1e-6
        assert (x @ x[q] <= bounds).all()
        floor = np.sort(np.delete(x @ x[q], q))[-5]
        looked_at.append(int((bounds >= floor).sum()))
        places, scores = topk.best(x[q], q, -np.inf, bounds, x, np.arange(600), np.arange(600), 5)
        want = sorted((-int(s), i) for i, s in enumerate(x @ x[q]) if i != q)[:5]
        assert [(-int(s), int(i)) for i, s in zip(places, scores)] == want
    assert np.mean(looked_at) < 200
