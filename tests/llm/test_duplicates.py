"""Jaccard join, line and substring de-duplication, decontamination, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from policylake.llm import _links, decontaminate, jaccard, line_dedup, substring_dedup, suffixes
from policylake.llm._links import connected, grouped, stored
from policylake.llm.queries import QUERIES
from tests.llm.conftest import prose

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def components(sets, percent):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def near_copies(n, words, edits):
    pick = random.Random(n)
    base = prose(77, words).split()
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(pick.randint(0, edits)):
            text[pick.randrange(words)] = f"w{pick.randrange(10 ** 6)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_jaccard_groups(spark, sf, words, percent):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += near_copies(60, 150, 6) + near_copies(40, 12, 2) + ["A b", "a B", "a b c", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in jaccard.jaccard_groups(docs, words, percent).collect()}
    sets = [shingles(t, words) for t in texts]
    want = components(sets, percent)
    mine = {i: rows[i]["group"] if rows[i]["group"] is not None else rows[i].node for i in rows}
    assert all(rows[i].n_shingles == len(s) for i, s in enumerate(sets))
    for i in rows:
        if sets[i]:
            assert min(j for j in rows if mine[j] == mine[i]) == want[i]


def test_jaccard_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts)
    want = components([shingles(texts[i], 4) for i in ids], 85)
    got = {r.doc_id: r for r in QUERIES["op3_ngram_jaccard"](spark, sf).collect()}
    assert [got[i].component_id for i in ids] == [ids[k] for k in want]


def test_jaccard_segments_meet_only_for_pairs_near_the_limit(spark, monkeypatch):
    """Texts that share their rare n-grams but not enough of all go without their segments being joined."""
    pick, base = random.Random(5), prose(9, 200).split()
    texts = []
    for i in range(40):
        words = list(base)
        for at in pick.sample(range(4, 196), 3):
            words[at] = f"own{i}x{at}"
        texts.append(" ".join(words))
    tried = {"pairs": 0, "hopeful": 0}

    def counted(df, name="step"):
        table = stored(df, name)
        if name in tried:
            tried[name] += table.count()
        return table
    monkeypatch.setattr(jaccard, "stored", counted)
    monkeypatch.setattr(_links, "stored", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in jaccard.jaccard_groups(docs, 4, 85).collect()}
    sets = [shingles(t, 4) for t in texts]
    mine = {i: r["group"] if r["group"] is not None else r.node for i, r in rows.items()}
    assert [min(j for j in rows if mine[j] == mine[i]) for i in range(40)] == components(sets, 85)
    assert tried["pairs"] > 100 and tried["hopeful"] < tried["pairs"] // 4


def test_jaccard_lists_no_pairs_of_a_crowd_of_unlinked_texts(spark, monkeypatch):
    # All share 50 of 57 shingles, so they meet, and none is linked; a twin of the last one is.
    rows = [(i, " ".join([f"c{k}" for k in range(53)] + [f"o{i}x{k}" for k in range(7)])) for i in range(40)]
    rows.append((40, rows[39][1] + " more"))
    listed, grouped = [], jaccard.grouped

    def counted(spark, buckets, tested, **how):
        def counting(pairs):
            listed.append(pairs.count())
            return tested(pairs)
        return grouped(spark, buckets, counting, **how)
    monkeypatch.setattr(jaccard, "grouped", counted)
    found = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=4, percent=85).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.group, []).append(r.doc_id)
    assert sorted(map(sorted, (v for g, v in groups.items() if g is not None))) == [[39, 40]]
    assert sum(listed) <= 80


def test_jaccard_edge_rows(spark, edge_docs, edge_rows, no_docs):
    rows = jaccard.jaccard_groups(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    assert all(r.node is None and r.n_shingles == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert len({r.node for r in rows if r.doc_id in (4, 5)}) == 1
    assert jaccard.jaccard_groups(no_docs).count() == 0


def test_pivots_find_all_links_of_a_bucket(spark):
    """Links that no early pivot takes part in."""
    buckets = stored(spark.range(200).selectExpr("0L as bucket", "id"))
    linked = {(i, i + 1) for i in range(0, 200, 2)}
    wanted = spark.createDataFrame(sorted(linked), "a long, b long")
    found = {r.id: r.least for r in grouped(spark, buckets, lambda p: p.join(wanted, ["a", "b"])).collect()}
    assert found == {b: a for a, b in linked}


def test_connected_long_chain(spark):
    chain = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert {r.id: r.least for r in connected(chain).collect()} == {i: 0 for i in range(1, 301)}


def test_lines(spark, edge_docs, edge_rows, no_docs):
    long = [prose(900 + i, 40) for i in range(5)]
    rows = [(5, "\n".join([long[0], long[1], "", "tail one"])), (3, "\n".join([long[1].upper() + " !", long[2]])),
            (9, long[2] + "\n" + long[3] + "\n" + long[3]), (10, long[2]), (11, None), (12, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.with_lines_cut(docs).collect()}
    assert got[3].text == rows[1][1]  # the least id keeps its lines
    assert got[5].text == "\n".join([long[0], "", "tail one"])
    assert got[9].text == long[3] and got[9].lines_cut == 2
    assert got[10].text == "" and got[11].text is None and got[12].text == "\n\n"
    left = {r.doc_id for r in line_dedup.dedup_lines(docs).collect()}
    assert left == {3, 5, 9, 11, 12}
    assert line_dedup.with_lines_cut(edge_docs).count() == len(edge_rows)
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_repeated_rows_of_several_lines_are_judged_as_one(spark):
    a, b, c = (prose(950 + i, 40) for i in range(3))
    docs = spark.createDataFrame([(9, f"{a}\n{b}\n{c}")] * 3 + [(1, b)], "doc_id long, text string")
    rows = line_dedup.with_lines_cut(docs).collect()
    assert sorted((r.doc_id, r.text, r.lines_cut, r.lines_left_worded) for r in rows) == \
        [(1, b, 0, None)] + [(9, f"{a}\n{c}", 1, 2)] * 3


def test_edit_budget_is_whole(spark):
    """Two of ten characters are a similarity of exactly 0.8, three of fourteen less."""
    docs = spark.createDataFrame([(1, "abcdefg xy"), (2, "abcdefg zw"), (3, "qrstuvwxyz abc"), (4, "qrstuvwxyz def")], "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.dedup_lines(docs).collect()} == {1, 3, 4}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_near_lines_by_brute_force(spark):
    """Lines are grouped exactly if their texts are similar enough; no sketches and no blocks in the comparison."""
    lines = [t for k in range(6) for t in near_copies(12 + k, 60, 1)] + [prose(k, 30) for k in range(40)]
    lines = list(dict.fromkeys(lines))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(lines)):
        for j in range(i):
            a, b = lines[i].lower(), lines[j].lower()
            if edits(a, b) <= int(max(len(a), len(b)) * (1 - line_dedup.SIMILARITY) + 1e-9):
                root[max(find(i), find(j))] = min(find(i), find(j))
    left = {r.doc_id for r in line_dedup.dedup_lines(docs).collect()}
    assert left == {i for i in range(len(lines)) if find(i) == i}
    assert len(left) < len(lines)


def test_edits_by_words_and_pieces_are_never_too_few(spark):
    """Never below the edit distance; near enough to prove copies alike, by words also repetitive ones, by pieces moved ones."""
    from pyspark.sql import functions as F
    rng = random.Random(5)
    pairs = [("", ""), ("a", ""), ("x y z", "x y z"), ("same words here " * 9, "same words here " * 8), (prose(1, 40), prose(2, 40))]
    for k in range(20):
        a = [f"{w}{rng.randrange(9)}" for w in prose(k, 200).split()]
        b = [w if rng.random() > 0.1 else w[::-1] + "x" for w in a]
        cycle = (a[:12] * 9)[:100]
        pairs += [(a, b), (a[:40] + ["end", "of"] + a[40:], b), (a[5:90] + a[99:], b), (cycle, cycle[:50] + ["odd"] + cycle[51:]),
                  (a[60:] + a[:60], b), (a[:50] + a[20:], b)]
    pairs = [tuple(t if isinstance(t, str) else " ".join(t) for t in p) for p in pairs]
    rows = spark.createDataFrame([(i, a.strip(), b.strip()) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = rows.select("i", F.expr(line_dedup._edits_by_words("a", "b")).alias("words"), F.expr(line_dedup._edits_by_pieces("a", "b")).alias("pieces"),
                      F.levenshtein("a", "b").alias("least")).collect()
    assert all(r.least <= r.words and r.least <= r.pieces for r in got)
    kinds = {k: [r for r in got if r.i > 4 and (r.i - 5) % 6 == k] for k in range(4)}
    assert all(r.words <= 1.2 * r.least + 40 for k in (0, 1, 3) for r in kinds[k])
    assert all(r.pieces <= 1.2 * r.least + 40 for k in (0, 1, 2) for r in kinds[k])


def test_lines_that_differ_in_a_word_are_found(spark):
    """Pairs of lines of every length with one random word exchanged, left out or put in, by edit similarity alone."""
    pick = random.Random(5)
    rows, meant = [], {}
    for length in (3, 4, 6, 8, 9, 10, 15, 16, 20, 21, 40, 60, 100):
        for _ in range(40):
            words = ["".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=pick.randint(2, 9))) for _ in range(length)]
            other, at, how = list(words), pick.randrange(length), pick.random()
            other[at:at + 1] = [] if how < 0.2 else [words[at], "also"] if how < 0.4 else ["".join(pick.choices("aeiou", k=4))]
            a, b = " ".join(words), " ".join(other)
            if edits(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9) and a != b:
                rows += [(len(rows), a), (len(rows) + 1, b)]
                meant.setdefault(length, []).append(rows[-1][0])
    typed = [(10 ** 6 + k, t) for k, t in enumerate(["internationalisation", "internationallsation", "汉" * 3 + "语言处理的文本去重方法说明", "汉" * 3 + "语言处理的文本去重方法说眀"])]
    docs = spark.createDataFrame(rows + typed, "doc_id long, text string")
    left = {r.doc_id for r in line_dedup.dedup_lines(docs).collect()}
    for length, ids in meant.items():
        assert sum(i not in left for i in ids) >= 0.9 * len(ids), length
    assert {i for i in left if i >= 10 ** 6} == {10 ** 6, 10 ** 6 + 2}
    assert {i for i, _ in rows if i % 2 == 0} <= left


def test_suffix_arrays_and_prefixes():
    pick = random.Random(3)
    for trial in range(120):
        parts = [bytes(pick.choice(b"ABC"[:pick.randint(1, 3)]) for _ in range(pick.randint(1, 40))) for _ in range(pick.randint(1, 6))]
        text, starts = suffixes.joined(parts + parts[:trial % 3])
        order = suffixes.suffix_array(text, 64)
        plain = text.tolist()
        assert sorted(order.tolist()) == list(range(len(plain)))
        shared = suffixes.permuted_prefixes(text, order)
        for a, b in zip(order[:-1], order[1:]):
            assert plain[a:a + 64] <= plain[b:b + 64]
            n = 0
            while plain[a + n] == plain[b + n] != 1:
                n += 1
            assert shared[b] == n


def removed_by_hand(rows):
    seen, out = {}, []
    for k, (doc, body) in enumerate(rows):
        for i in range(len(body) - 99):
            at = (doc is not None, doc or 0, i)
            seen[body[i:i + 100]] = min(seen.get(body[i:i + 100], at), at)
    for doc, body in rows:
        gone = bytearray(len(body))
        for i in range(len(body) - 99):
            if seen[body[i:i + 100]] < (doc is not None, doc or 0, i):
                gone[i:i + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(body, gone) if not g)
        out.append((doc, len(body), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_substrings(spark, sf):
    passage = prose(50, 25)
    texts = [prose(i, 60) + " " + passage[i % 7:] + " " + prose(i + 90, 30) for i in range(30)]
    texts += ["ab" * 300, "ab" * 200 + "c" * 150, "x" * 99, "x" * 100, "x" * 101, "", "é" * 120, texts[3]]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(None, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = substring_dedup.without_repeats(docs).collect()
    got = [(r.doc, r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in cut]
    assert sorted(got, key=str) == sorted(removed_by_hand([(d, t.encode()) for d, t in rows]), key=str)


def test_substring_edges(spark, edge_docs, edge_rows, no_docs):
    rows = substring_dedup.without_repeats(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    assert len({bytes(r.kept) for r in rows if r.doc == 4}) == 1
    assert substring_dedup.without_repeats(no_docs).count() == 0


def test_decontamination(spark, edge_docs, no_docs):
    items = [(i, prose(7000 + i, 30)) for i in range(20)] + [(98, None), (99, "short"), (97, prose(7000, 30))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    clean = [(i, prose(i, 200)) for i in range(30)]
    leaks = []
    for i in range(20):
        words = items[i][1].split()
        words[4], words[20] = words[4] + "s", words[20].upper()
        leaks.append((100 + i, prose(i + 300, 50) + ("." if i % 2 else " \n ") + ", ".join(words) + " " + prose(i + 600, 40)))
    docs = spark.createDataFrame(clean + leaks + [(200, None), (201, "")], "doc_id long, text string")
    hits = decontaminate.contaminated(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in hits} == {(100 + i, i) for i in range(20)} | {(100, 97)}
    texts = dict(leaks)
    for r in hits:
        found = texts[r.doc_id][r.start:r.end].lower()
        assert items[r.item_id if r.item_id < 20 else 0][1].split()[10] in found and len(found) < 500
    left = {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()}
    assert left == {i for i, _ in clean} | {200, 201}
    assert decontaminate.clean(edge_docs, benchmark).count() == edge_docs.count()
    assert decontaminate.clean(docs, benchmark.limit(0)).count() == docs.count()
    assert decontaminate.contaminated(no_docs, benchmark).count() == 0


def _occurs(window: bytes, text: bytes) -> int:
    """Least edits of the window anywhere in the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(window):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination_by_brute_force(spark):
    pick = random.Random(5)
    items = [prose(9000 + i, 14) for i in range(6)] + ["na " * 30, "na na no " * 12, "tiny text of it", "ab"]
    texts = []
    for k in range(40):
        item = list(items[k % len(items)])
        for _ in range(pick.randint(0, 9)):
            at = pick.randrange(len(item))
            item[at:at + pick.randint(0, 1)] = pick.choice(["", "x", "na", item[at]])
        lead = pick.choice([prose(k, 5), prose(k, 75), prose(k, 150)[:pick.randint(430, 580)], ""])
        texts.append(lead + "".join(item)[pick.randint(0, 40):] + pick.choice(["", " " + prose(k + 50, 9)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def plain(text: str) -> bytes:
        return re.sub(rb"[^0-9a-z\x80-\xff]+", b" ", text.lower().encode())

    expected = {}
    for i, item in enumerate(map(plain, items)):
        m = min(len(item), decontaminate.WINDOW)
        if m < decontaminate.Q:
            continue
        starts = [*range(0, len(item) - m, decontaminate.WINDOW // 2), len(item) - m]
        budget = max(min(decontaminate.EDITS * m // decontaminate.WINDOW, (m - decontaminate.Q) // decontaminate.Q), 0)
        for d, text in enumerate(texts):
            edits = [_occurs(item[s:s + m], plain(text)) for s in starts]
            if min(edits) <= budget:
                expected[d, i] = (sum(e <= budget for e in edits), len(starts), min(edits))
    got = {(r.doc_id, r.item_id): (r.windows_found, r.windows, r.edits) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == expected and len(got) > 15
    assert {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()} == set(range(40)) - {d for d, _ in got}


def test_decontamination_of_repetitive_texts(spark):
    docs = spark.createDataFrame([(1, "na " * 70000), (2, "no " * 70000), (3, "na " * 10)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "na " * 2000), (2, "na " * 2001), (3, "na " * 2000)], "item_id long, text string")
    rows = {(r.doc_id, r.item_id): (r.windows_found, r.windows, r.edits, r.start, r.end)
            for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert rows == {(1, 1): (187, 187, 0, 0, 210000), (1, 2): (187, 187, 0, 0, 210000), (1, 3): (187, 187, 0, 0, 210000)}


def test_banded_alignment_equals_a_full_one():
    pick = random.Random(1)
    for _ in range(40):
        pattern = bytes(pick.choice(b"abcd") for _ in range(40))
        inner = list(pattern)
        for _ in range(pick.randint(0, 3)):
            inner[pick.randrange(len(inner))] = pick.choice(b"abcd")
        text = bytes(pick.choice(b"abcd") for _ in range(4)) + bytes(inner) + bytes(pick.choice(b"abcd") for _ in range(13))
        row = [0] * (len(text) + 1)
        for i, x in enumerate(pattern):
            new = [i + 1]
            for j, y in enumerate(text):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        width = 18
        padded = np.zeros((1, 40 + width), np.uint8)
        padded[0, :len(text)] = np.frombuffer(text, np.uint8)[:40 + width]
        edits, _ = decontaminate._banded(np.frombuffer(pattern, np.uint8)[None], padded, np.array([40]))
        assert edits[0] == min(row)
