"""Column functions against hand-derived values and plain-Python loops."""

from __future__ import annotations

import hashlib
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from policylake import vocab
from policylake.functions import answers as A
from policylake.functions import chunk as C
from policylake.functions import extract as E
from policylake.functions import regions as R
from policylake.functions import score as S
from policylake.functions import text as X


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").select(*columns).first()


def many(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column.alias("v"))
    return [r.v for r in df.orderBy("i").collect()]


T = None


@pytest.fixture(scope="module", autouse=True)
def text_column(spark):
    """Columns need a running session, so the shared one is made here."""
    global T
    T = F.col("t")


SAMPLE = """Anthem Provider Manual
Policy Number: PA-2024-001
Effective Date: 01/01/2024
End Date: 12/31/2024
This policy supersedes PA-2023-001
"""


def test_identity_of_a_sample(spark):
    row = one(spark, SAMPLE, E.explicit_id(T), E.policy_dates(T).alias("d"), E.supersedes(T).alias("s"))
    assert row[0] == "PA-2024-001"
    assert row.d.effective_date == date(2024, 1, 1) and row.d.end_date == date(2024, 12, 31)
    assert row.d.document_date is None
    assert "PA-2023-001" in row.s


def test_content_hash(spark):
    got = one(spark, "", E.content_hash16(
        F.lit("prior_authorization"), F.lit("anthem"), F.array(F.lit("CPT 99214"), F.lit("CPT 99213")),
        F.array(F.lit("Prior auth required within 48 hours"))))[0]
    assert got == "d0a5754bce386a2f"


def test_json_string_escapes(spark):
    import json
    texts = ['plain', 'q"uote\\', "tab\tline\n", "é ü", "snow ☃", "wide 😀", "\x01bell\x07"]
    assert many(spark, texts, E.json_string(T)) == [json.dumps(t) for t in texts]


def test_dates(spark):
    cases = {"1/5/2024": date(2024, 1, 5), "01-05-2024": date(2024, 1, 5), "1/5/24": date(2024, 1, 5),
             "1/5/69": date(1969, 1, 5), "1/5/68": date(2068, 1, 5), "12-31-99": date(1999, 12, 31),
             "2024-2-29": date(2024, 2, 29), "2023-2-29": None, "2024/12/1": date(2024, 12, 1),
             "january  5, 2024": date(2024, 1, 5), "JAN 5 2024": date(2024, 1, 5), "May 5, 2024": date(2024, 5, 5),
             "13/1/2024": None, "nonsense": None, "1/5/199": None, "": None}
    assert many(spark, list(cases), E.parse_date(T)) == list(cases.values())


def test_hybrid_dates(spark):
    got = many(spark, ["Effective Date: 01/01/2024", "effective: 1/1/2024", "expires 1/1/2024 and expiration 2/2/2025"],
               E.raw_dates_hybrid(T))
    assert [tuple(g) for g in got] == [(None, None), ("1/1/2024", None), ("2/2/2025", "1/1/2024")]


def test_prior_auth(spark):
    texts = ["no prior authorization needed", "Preauthorization", "nothing"]
    assert many(spark, texts, S.detect_prior_auth(T)) == [True, True, None]
    assert many(spark, texts, S.detect_prior_auth(T, strict=True)) == [False, True, None]


def test_url_scores(spark):
    urls = ["https://a.example.com/Provider-Manual.pdf", "https://a.example.com/prior_auth.pdf",
            "https://a.example.com/marketing.pdf", "https://a.example.com/x.pdf",
            "https://a.example.com/sample-test.pdf", "https://a.example.com/appeals-sample.pdf"]
    assert [g.score for g in many(spark, urls, S.url_score(T))] == [2, 2, -1, 0, -2, 1]


def test_link_classification(spark):
    got = many(spark, ["prior authorization list", "Handbook", "dental appeal", "review", "hello"],
               S.classify_link(T, F.lit(""), F.lit("")))
    assert [g.primary_rule for g in got] == ["prior_authorization", "billing_nuances", None, None, None]
    assert got[1].scores == {"billing_nuances": 2} and got[0].relevant_rules == ["prior_authorization"]
    # Two keywords (prior authorization, prior auth) and three patterns (prior, auth, authorization).
    assert got[0].scores["prior_authorization"] == 7


def test_regions(spark):
    urls = {"https://p.example.com/docs/gpp/OH_CAID_ProviderManual.pdf": ["OH"],
            "https://p.example.com/docs/california-provider/CA_CAID_X.pdf": ["CA"],
            "https://p.example.com/en/co/x.html": [], "https://p.example.com/x/co/y": ["CO"],
            "https://p.example.com/west-virginia/x": ["VA", "WV"], "https://p.example.com/arkansas": ["AR", "KS"]}
    assert many(spark, list(urls), R.regions_from_url(T)) == list(urls.values())
    texts = {"providers in Virginia": ["IN", "VA"], "New York plans": ["NY"], "Ohio Medicaid": ["OH"],
             "applicable in Guam": ["GU", "IN"], "état la": ["LA"], "éla": []}
    assert many(spark, list(texts), R.regions_from_content(T)) == list(texts.values())
    assert many(spark, ["providers in Virginia", "sold IN town"], R.regions_from_content(T, True)) == [["VA"], ["IN"]]


def test_section_split(spark):
    text = "intro text\nPRIOR AUTHORIZATION\nbody one\nTIMELY FILING RULES\nbody two"
    ours = one(spark, text, C.split_sections(T))[0]
    assert [tuple(s) for s in ours] == [
        ("Introduction", "intro text"), ("PRIOR AUTHORIZATION", "body one"), ("TIMELY FILING RULES", "body two")]
    swapped = one(spark, text, C.split_sections(T, compat=True))[0]
    assert [tuple(s) for s in swapped] == [
        ("intro text", "PRIOR AUTHORIZATION"), ("body one", "TIMELY FILING RULES"), ("body one", "body two")]
    assert [s.section for s in one(spark, "no headers", C.split_sections(T))[0]] == ["General"]


def test_fixed_chunks(spark):
    got = one(spark, "x" * 12000, C.chunk_fixed(T))[0]
    assert [(c.start, len(c.chunk)) for c in got] == [(0, 6000), (5500, 6000), (11000, 1000)]
    assert one(spark, "", C.chunk_fixed(T))[0] == []


def test_sentence_windows_cover_the_text(spark):
    pick = random.Random(4)
    texts = ["".join(pick.choice("ab. ") for _ in range(pick.randint(0, 400))) for _ in range(200)] + ["", "." * 120, "a" * 120]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C._window_bounds(F.col("t"), 50, 10, 0.7).alias("b")).collect()
    for r in rows:
        covered = set()
        for b in r.b:
            covered |= set(range(b.start, min(b.end, len(r.t))))
        assert covered == set(range(len(r.t)))
        assert all(b.start < a.start <= b.end for b, a in zip(r.b, r.b[1:]))
        late = [r.t.rfind(".", b.start, b.start + 50) for b in r.b]
        assert all(b.end == (s + 1 if b.start + 50 < len(r.t) and s > b.start + 35 else b.start + 50) for b, s in zip(r.b, late))


def drop_lines_by_loop(text):
    lines, counts, out, since_table = text.split("\n"), {}, [], None
    for line in lines:
        counts[line.strip()] = counts.get(line.strip(), 0) + 1
    for line in lines:
        s = line.strip()
        toc = ("table of contents" in s.lower() or s.lower() == "contents"
               or (line.count(".") > 10 and re.search(r"\d+\s*$", line)) or re.search(r"\.{3,}\s*\d+\s*$", line))
        page = re.match(r"page\s+\d+", s.lower()) or re.match(r"\d+(\s+(of|/)\s+\d+)?$", s)
        if not s or toc or page or (len(s) > 5 and counts[s] >= 3):
            continue
        if line.count("|") >= 3 or re.match(r"^[\s\-|:]+$", line):
            since_table = 0
            continue
        if since_table is not None and since_table < 6:
            since_table += 1
            continue
        if len(s) >= 30:
            out.append(line)
    return "\n".join(out)


def test_boilerplate_lines_match_a_loop(spark):
    rng = random.Random(7)
    pool = ["", "   ", "| a | b | c |", "|---|", "Page 3", "3 of 9", "17", "Table of Contents", "Intro ..... 4",
            "short", "a running header line of text", "x" * 40, "y" * 35, " " + "z" * 31 + " ", "CONTENTS", "w" * 29]
    texts = ["\n".join(rng.choice(pool) + (str(rng.random()) if rng.random() < .3 else "") for _ in range(rng.randint(0, 60)))
             for _ in range(300)]
    assert many(spark, texts, X.drop_boilerplate_lines(T)) == [drop_lines_by_loop(t) for t in texts]


def test_lines_after_a_table(spark):
    body = [f"line {i} " + "k" * 40 for i in range(1, 9)]
    assert one(spark, "\n".join(["| a | b | c |", *body]), X.drop_boilerplate_lines(T))[0].split("\n") == body[6:]


def test_hash_normalisation_matches_python(spark):
    rng = random.Random(3)
    alphabet = "aB é ß_1²\t\n  .,!-’ "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    def expected(t):
        flat = re.sub(r"\s+", " ", t.lower().strip())
        return hashlib.md5(re.sub(r"[^\w\s]", "", flat).encode()).hexdigest()
    assert many(spark, texts, X.content_hash(T)) == [expected(t) for t in texts]


PHRASES = ["Prior authorization is required for knee surgery.", "requires prior authorization: all imaging",
           "providers must obtain authorization for MRI.", "authorization required for: sleep studies",
           "submit claims within 90 days.", "filing deadline: 180 days", "claims must be submitted within 95 days",
           "60-day filing limit", "appeal must be filed within 30 days", "appeal process: write to the plan.",
           "to appeal a claim, call the plan.", "claims must be submitted via the portal.",
           "submit claims online at the portal site.", "submit claims electronically via the portal.",
           "claim submission: use the form", "eligibility verification required before a visit.",
           "verify patient eligibility before each visit.", "coverage must be verified by staff",
           "referrals are required for specialists.", "requires a referral: from a physician",
           "specialty services require a referral", "documentation required: chart notes",
           "medical records must include the plan of care.", "submit the following documentation: chart",
           "CPT codes 99213 and others.", "procedure codes must be valid on the date.", "coding guidelines: follow them",
           "dispute within 3 months", "PA is required", "timely filing is 95 days", "reimbursement rates vary widely"]


def matches_by_python(text, patterns, flags, grouped):
    return [(i, m.start(), m.group(1) if grouped and m.lastindex else m.group(0))
            for i, (_, p) in enumerate(patterns) for m in re.finditer(p, text, flags)]


def test_rule_matches_equal_python(spark):
    rng = random.Random(5)
    texts = ["\n".join(rng.sample(PHRASES, rng.randint(1, 8))) for _ in range(150)] + PHRASES
    for patterns, needs, grouped, flags, options in (
            (vocab.SENTENCE_RULES, vocab.SENTENCE_NEEDS, True, re.I | re.M, {"ignore_case": True, "multiline": True}),
            (vocab.WINDOW_RULES, vocab.WINDOW_NEEDS, False, re.I, {"ignore_case": True})):
        assert len(patterns) == len(needs)
        got = many(spark, texts, E.rule_matches(T, patterns, needs, grouped, **options))
        want = [matches_by_python(t, patterns, flags, grouped) for t in texts]
        assert [[(m.ord, m.start, m.captured) for m in g] for g in got] == want
        assert {w[0] for ws in want for w in ws} >= set(range(len(patterns))) - {2, 4, 5, 7, 8, 9, 10}


def test_content_sections_equal_python(spark):
    texts = ["Prior authorization " + "x " * 60 + "\n2. next\n" + "appeals process " + "y " * 70,
             "GRIEVANCE " + "word " * 40 + "\nA 2024-01-01 (1)\n timely filing " + "z " * 80, "none"]
    def expected(t):
        out = {}
        for name, phrases in vocab.CONTENT_SECTIONS.items():
            found = [t[m.start():m.end()].strip() for p in phrases
                     for m in re.finditer(rf"{p}.*?(?={vocab.SECTION_END}|\Z)", t.lower(), re.S | re.I)]
            found = [f for f in found if len(f) > 100]
            if found:
                out[name] = found
        return out
    got = many(spark, texts, E.content_sections(T))
    assert [{s.section: s["items"] for s in g} for g in got] == [expected(t) for t in texts]


def test_validity_and_confidence(spark):
    df = spark.createDataFrame([
        ("all imaging services", "Authorization is required for all imaging services.", "prior_authorization"),
        ("90", "Claims are due within 90 days.", "timely_filing"),
        ("THIS IS A VERY LONG HEADER IN CAPITAL LETTERS", "must be", "appeals"),
        ("something long enough", "nothing of note here", "appeals")], "r string, c string, k string")
    got = df.select(S.is_valid_rule(F.col("r"), F.col("c")), S.rule_confidence(F.col("c"), F.col("k"))).collect()
    assert [tuple(g) for g in got] == [(True, 0.7), (False, 0.75), (False, 0.7), (False, 0.5)]


def test_model_json(spark):
    replies = ['```json\n{"a": 1}\n```', 'Sure: {"a": {"b": 2}} done', "no json", '{"a": 1}']
    assert many(spark, replies, E.clean_model_json(T)) == ['{"a": 1}', '{"a": {"b": 2}}', "no json", '{"a": 1}']
    assert many(spark, ['{"k": null}', "{}", "bad"], E.overlay(F.lit("old"), T, "k")) == [None, "old", "old"]


def test_deadlines(spark):
    source = "Appeals within 30 days or 12-day notice"
    got = one(spark, source, E.validate_deadlines(F.array(*[F.lit(x) for x in (
        "30 days", "45 days", "12 weeks", "soon", "0 items")]), T))[0]
    assert got == ["30 days", "12 weeks", "soon", "0 items"]


def test_answer_texts(spark):
    hit = "struct<title:string,payer:string,scope:string,content:string>"
    df = spark.createDataFrame([([("T", "P", None, "c" * 400), (None, None, "S", "")],), ([],)], f"hits array<{hit}>")
    full, empty = [r[0] for r in df.select(A.format_answer(F.col("hits"), 320)).collect()]
    whole = [r[0] for r in df.select(A.format_answer(F.col("hits"))).collect()][0]
    assert "    " + "c" * 400 in whole.split("\n")
    assert empty == vocab.NO_ANSWER
    assert full.split("\n") == ["Answer based on top 2 rule(s):", "(See linked sources below for documents)",
                                "1) T — P (N/A)", "    " + "c" * 320 + "...", "2) Policy rule — Unknown payer (S)"]
    models = spark.createDataFrame([("fine",), ("",), (None,), ("I am NOT SURE",)], "m string")
    assert [r[0] for r in models.select(A.choose_answer(F.lit("r"), F.col("m"))).collect()] == ["fine", "r", "r", "r"]


def test_needs_fold_letters_that_patterns_take_for_ascii(spark):
    """A long s, a dotless i and a dotted I match without regard to case, so the words needed are looked for in folded text."""
    texts = ["Coding guıdelineſ: use the newest manual.", "ELIGIBİLİTY verifıcation: call before the visit."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for needs in (vocab.SENTENCE_NEEDS, ((),) * len(vocab.SENTENCE_RULES)):
        found = E.rule_matches(F.col("t"), vocab.SENTENCE_RULES, needs, True, ignore_case=True, multiline=True)
        assert [r.n for r in df.select(F.size(found).alias("n")).collect()] == [1, 1], needs


def test_section_text_is_worked_out_once(spark):
    """A text is lowered once a section and its evidence joined once, however many terms there are."""
    docs = spark.createDataFrame([("Billing\n" + "x" * 600,), ("nothing\n" + "x" * 600,), (None,), ("",), ("claims\nshort",)], "t string")
    body, windows = E.section_text(F.col("t"), "claims"), E.section_windows(F.col("t"), "claims")
    rows = docs.select(body.alias("b"), windows.alias("w")).collect()
    assert [r.b for r in rows] == ["Billing\n" + "x" * 600, None, None, None, None]
    assert [None if r.w is None else [tuple(w) for w in r.w] for r in rows] == [[(0, 2, 608)], [], None, [], []]
    for found in (body, windows):
        plan = docs.select(found.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("lower(") == 1 and plan.count("split(") == 2 and plan.count("slice(") == 1
