"""Identifiers, dates, rules, sections and model output."""

from __future__ import annotations

from pyspark.sql import functions as F

from policylake import vocab
from policylake.functions import extract as E
from policylake.functions import score as S
from policylake.operators import hooks as H
from policylake.operators import lifecycle as L
from policylake.operators import reports as RP
from policylake.operators import similar as M
from policylake.registry.base import any_contains, py_strip, q, query, with_docs
from policylake.registry.scores import TYPE_COUNTS
from policylake.registry.base import argmax_case
from policylake.session import checkpointed, computed_once
from policylake.sources.policy_docs import policy_docs, table

FORMATS = "['%m/%d/%Y', '%m-%d-%Y', '%B %d, %Y', '%b %d, %Y']"
ID_SQL = "coalesce(" + ", ".join(
    f"nullif(trim(regexp_extract(text, {q('(?i)' + p)}, 1)), '')" for p in vocab.POLICY_ID_PATTERNS) + ")"


def date_sql(kind: str, text: str = "text") -> str:
    return "coalesce(" + ", ".join(
        f"[d for d in [try_strptime(x, {FORMATS})::date for x in regexp_extract_all({text}, {q('(?i)' + p)}, 1)] if d is not null][1]"
        for k, p in vocab.POLICY_DATE_PATTERNS if k == kind) + ")"


BULLETS_SQL = (f"[trim(ltrim({py_strip('l')}, '-•* ')) for l in string_split(text, chr(10)) "
               f"if regexp_matches({py_strip('l')}, '^[-•*]\\s+')]")
SUPERSEDES_SQL = "list_sort(list_distinct(flatten([regexp_extract_all(s, '[A-Z0-9\\-]+') for s in " + " || ".join(
    f"regexp_extract_all(text, {q(p)}, 1)" for p in vocab.SUPERSEDES_PATTERNS) + "])))"
HASH_SQL = (f"""substring(sha256('{{"payer": "' || payer_name || '", "policy_type": "' || policy_type || '", "procedures": [], "requirements": ['"""
            f""" || array_to_string(['"' || r || '"' for r in list_sort({BULLETS_SQL})], ', ') || ']}}'), 1, 16)""")

# Identity, dates and confidence of every derived document, for all lifecycle checks.
POLICIES_SQL = f"""
policies as materialized (select *, payer_name || '_' || coalesce(explicit_id, policy_hash) as policy_id,
    round(case when explicit_id is not null then 0.95 else 0.7 end * case when effective_date is null then 0.8 else 1 end, 4)::double as confidence_score
  from (select *, {HASH_SQL} as policy_hash
  from (select doc_id, payer_name, crawl_timestamp, url as source_pdf, text, {ID_SQL} as explicit_id,
    {date_sql('effective')} as effective_date, {date_sql('end')} as end_date,
    {argmax_case(TYPE_COUNTS, "'general'")} as policy_type, {SUPERSEDES_SQL} as supersedes from policy_docs)))"""


def policies(spark, sf):
    """Derived documents with identity, dates, supersession and confidence."""
    return L.policy_identity(policy_docs(spark, sf).withColumnRenamed("url", "source_pdf"))


def stored(spark, sf):
    """The same without their texts, kept once for queries that read them several times."""
    return checkpointed(policies(spark, sf).drop("text"))


@query(with_docs(f"select doc_id, {ID_SQL} as explicit_id from policy_docs"))
def explicit_id(spark, sf):
    return policy_docs(spark, sf).select("doc_id", E.explicit_id(F.col("text")).alias("explicit_id"))


KINDS = ("effective", "end", "document", "supersedes")


@query(with_docs(f"select doc_id, {', '.join(f'{date_sql(k)}::varchar as {k}_date' for k in KINDS)} from policy_docs"))
def policy_dates(spark, sf):
    dates = policy_docs(spark, sf).select("doc_id", E.policy_dates(F.col("text")).alias("d"))
    return dates.select("doc_id", *[F.col(f"d.{k}_date").cast("string").alias(f"{k}_date") for k in KINDS])


LAYOUTS = r"""
case cast(o_orderkey % 10 as int)
  when 0 then concat(cast(month(o_orderdate) as string), '/', cast(day(o_orderdate) as string), '/', cast(year(o_orderdate) as string))
  when 1 then concat(lpad(cast(month(o_orderdate) as string), 2, '0'), '-', cast(day(o_orderdate) as string), '-', cast(year(o_orderdate) as string))
  when 2 then concat(cast(month(o_orderdate) as string), '/', cast(day(o_orderdate) as string), '/', substring(cast(year(o_orderdate) as string), 3, 2))
  when 3 then concat(cast(month(o_orderdate) as string), '-', lpad(cast(day(o_orderdate) as string), 2, '0'), '-', substring(cast(year(o_orderdate) as string), 3, 2))
  when 4 then concat(cast(year(o_orderdate) as string), '-', cast(month(o_orderdate) as string), '-', cast(day(o_orderdate) as string))
  when 5 then concat(cast(year(o_orderdate) as string), '/', lpad(cast(month(o_orderdate) as string), 2, '0'), '/', lpad(cast(day(o_orderdate) as string), 2, '0'))
  when 6 then concat(lower(m), ' ', cast(day(o_orderdate) as string), ', ', cast(year(o_orderdate) as string))
  when 7 then concat(upper(m), '  ', cast(day(o_orderdate) as string), ' ', cast(year(o_orderdate) as string))
  when 8 then concat(' ', substring(m, 1, 3), ' ', cast(day(o_orderdate) as string), ', ', cast(year(o_orderdate) as string))
  else concat(substring(m, 1, 3), ' 32, ', cast(year(o_orderdate) as string)) end"""
MONTH = ("trim(substring('January   February  March     April     May       June      July      August    "
         "September October   November  December  ', cast(month(o_orderdate) as int) * 10 - 9, 10))")


# Written in ten layouts, a date must come back as it was; the last layout is no date.
@query("select o_orderkey, case when o_orderkey % 10 <> 9 then o_orderdate::date::varchar end as parsed from orders")
def date_layouts(spark, sf):
    orders = table(spark, sf, "orders").withColumn("m", F.expr(MONTH))
    return orders.select("o_orderkey", E.parse_date(F.expr(LAYOUTS)).cast("string").alias("parsed"))


HYBRID = {k: " || ".join(f"regexp_extract_all(t, {q('(?i)' + p)}, 1)" for kk, p in vocab.HYBRID_DATE_PATTERNS if kk == k)
          for k in ("effective", "expiration")}
# The documents say "Effective Date:" and "End Date:"; these two finders look for other wording.
REWORDED_SQL = "replace(replace(replace(text, 'Effective Date:', 'Expires:'), 'End Date:', 'expiration'), 'Attach', 'Valid through 01/02/2003 Attach')"


@query(with_docs(f"""
select doc_id, coalesce(({HYBRID['effective']})[1], ({HYBRID['expiration']})[2]) as effective, ({HYBRID['expiration']})[1] as expiration
from (select doc_id, {REWORDED_SQL} as t from policy_docs)"""))
def raw_dates_hybrid(spark, sf):
    docs = policy_docs(spark, sf).select("doc_id", F.expr(REWORDED_SQL).alias("t"))
    return docs.select("doc_id", E.raw_dates_hybrid(F.col("t")).alias("d")).select("doc_id", "d.*")


def _strict(kind: str) -> str:
    return "coalesce(" + ", ".join(
        f"nullif(regexp_extract(lower(t), {q(p)}, 1), '')" for p in vocab.STRICT_DATE_PATTERNS[kind]) + ")"


@query(with_docs(f"""
select doc_id, {_strict('effective')} as effective_date, {_strict('expiration')} as expiration_date,
  nullif(regexp_extract(t, {q('(?i)' + vocab.MINING_DATE_PATTERN)}, 1), '') as effective_text
from (select doc_id, replace(replace(text, 'End Date:', 'Expiration Date:'), 'Attach', 'Valid through 01/02/2003 Attach') as t from policy_docs)"""))
def raw_dates_strict(spark, sf):
    reworded = F.expr("replace(replace(text, 'End Date:', 'Expiration Date:'), 'Attach', 'Valid through 01/02/2003 Attach')")
    docs = policy_docs(spark, sf).select("doc_id", reworded.alias("t"))
    return docs.select("doc_id", E.raw_dates_strict(F.col("t")).alias("d"),
                       E.effective_date_text(F.col("t")).alias("effective_text")).select("doc_id", "d.*", "effective_text")


def _days(pattern: str, months: bool) -> str:
    n = f"try_cast(regexp_extract(lower(text), {q('(?s)' + pattern)}, 1) as int)"
    return f"case when {n} < 50 then {n} * 30 else {n} end" if months else n


@query(with_docs(f"select doc_id, coalesce({', '.join(_days(p, m) for p, m in vocab.FILING_PATTERNS)}) as days from policy_docs"))
def timely_filing_days(spark, sf):
    return policy_docs(spark, sf).select("doc_id", E.timely_filing_days(F.col("text")).alias("days"))


@query(with_docs(f"""select doc_id, array_to_string(({BULLETS_SQL})[1:3], ' | ') as first_three,
  array_to_string({BULLETS_SQL}, ' | ') as all_items, array_to_string({SUPERSEDES_SQL}, ',') as superseded from policy_docs"""))
def requirements_and_supersession(spark, sf):
    text = F.col("text")
    return policy_docs(spark, sf).select(
        "doc_id", F.array_join(E.key_requirements(text, 3), " | ").alias("first_three"),
        F.array_join(E.all_requirements(text), " | ").alias("all_items"),
        F.array_join(E.supersedes(text), ",").alias("superseded"))


@query(with_docs("""select doc_id, policy_id, policy_hash, policy_type, effective_date::varchar as effective_date,
  end_date::varchar as end_date, len(supersedes) as n_superseded, confidence_score
from (select * exclude supersedes, case when len(supersedes) > 0 then supersedes end as supersedes from policies)""", POLICIES_SQL))
def policy_identity(spark, sf):
    return policies(spark, sf).select(
        "doc_id", "policy_id", "policy_hash", "policy_type", F.col("effective_date").cast("string").alias("effective_date"),
        F.col("end_date").cast("string").alias("end_date"),
        F.when(F.col("supersedes").isNotNull(), F.size("supersedes")).alias("n_superseded"), "confidence_score")


# --- rules --------------------------------------------------------------------------------

def matches_sql(source: str, text: str, patterns, flags: str, grouped: bool) -> str:
    """Rows (doc_id, ord, rule_type, start, matched, captured) of all matches."""
    def one(order: int, rule_type: str, pattern: str) -> str:
        group = r"\1" if grouped and "(" in pattern.replace("(?:", "") else r"\0"
        p = q(f"(?{flags}){pattern}")
        return (f"select doc_id, {order} as ord, {q(rule_type)} as rule_type, {text} as body, string_split(regexp_replace({text}, {p}, "
                f"chr(1) || '\\0' || chr(2) || '{group}' || chr(1), 'g'), chr(1)) as pieces from {source} where regexp_matches({text}, {p})")
    union = " union all ".join(one(i, t, p) for i, (t, p) in enumerate(patterns))
    return f"""
pieces as (select doc_id, ord, rule_type, body, unnest(pieces) as piece, generate_subscripts(pieces, 1) as i from ({union})),
placed as (select *, coalesce(sum(length(split_part(piece, chr(2), 1))) over (partition by doc_id, ord order by i
    rows between unbounded preceding and 1 preceding), 0)::int as start from pieces),
matched as (select doc_id, ord, rule_type, body, start, split_part(piece, chr(2), 1) as matched, split_part(piece, chr(2), 2) as captured
  from placed where contains(piece, chr(2)))"""


@query(with_docs(f"""
select doc_id, ord, rule_type as policy_type, start, matched as matched_text,
  {py_strip('substring(body, greatest(start - 200, 0) + 1, start + length(matched) + 200 - greatest(start - 200, 0))')} as context
from matched""", matches_sql("policy_docs", "text", vocab.WINDOW_RULES, "i", False)))
def rules_with_window(spark, sf):
    return policy_docs(spark, sf).select("doc_id", F.inline(E.rules_with_window(F.col("text"))))


def _first_rule(text: str) -> str:
    return "case " + " ".join(f"when regexp_matches({text}, {q('(?i)' + p)}) then {q(n)}" for n, p in vocab.FIRST_MATCH_RULES) + " end"


@query(with_docs(f"""
select doc_id, pos, type, {py_strip('piece')} as text, 0.8::double as confidence
from (select *, {_first_rule('piece')} as type, row_number() over (partition by doc_id order by raw_pos) - 1 as pos
  from (select doc_id, unnest(string_split_regex(text, '[.!?]\\n')) as piece,
    generate_subscripts(string_split_regex(text, '[.!?]\\n'), 1) as raw_pos from policy_docs) where length(piece) >= 20)
where type is not null"""))
def rules_first_match(spark, sf):
    return policy_docs(spark, sf).select("doc_id", F.inline(E.rules_first_match(F.col("text"), None)))


SENTENCE_SQL = matches_sql("policy_docs", "text", vocab.SENTENCE_RULES, "im", True) + f""",
sentences as (select doc_id, ord, rule_type, start, matched as source_text, full_context,
    case when regexp_matches({py_strip('captured')}, '^\\d+$') then full_context else {py_strip('captured')} end as requirement
  from (select *, {py_strip("regexp_extract(substring(body, 1, start), '[^.]*$') || split_part(substring(body, start + 1), '.', 1) || case when contains(substring(body, start + 1), '.') then '.' else '' end")} as full_context from matched)
  where length(full_context) >= 20),
rated as (select *, length(requirement) >= 10
    and not (length(requirement) > 30 and upper(requirement) = requirement and lower(requirement) <> requirement)
    and length(requirement) - length(regexp_replace(requirement, '\\d', '', 'g')) <= length(requirement) * 0.5
    and {any_contains('lower(full_context)', vocab.MEANINGFUL_WORDS)} as valid,
  least(1.0, 0.5 + case when {any_contains('lower(full_context)', vocab.MODAL_WORDS)} then 0.2 else 0 end
    + case when regexp_matches(full_context, '\\d+\\s+(?:days?|months?|years?)') then 0.15 else 0 end
    + case when length(full_context) - length(replace(full_context, '.', '')) = 1 and len([w for w in string_split_regex(full_context, '\\s+') if w <> '']) > 8 then 0.1 else 0 end
    + case when rule_type = 'timely_filing' and regexp_matches(full_context, '\\d') then 0.1 else 0 end)::double as confidence
  from sentences)"""


def rated_rules(spark, sf):
    found = policy_docs(spark, sf).select("doc_id", F.inline(E.rules_in_sentence(F.col("text"))))
    return found.withColumn("valid", S.is_valid_rule(F.col("requirement"), F.col("full_context"))).withColumn(
        "confidence", S.rule_confidence(F.col("full_context"), F.col("rule_type")))


@query(with_docs("select doc_id, ord, rule_type, start, requirement, full_context, source_text, valid, round(confidence, 4) as confidence from rated", SENTENCE_SQL))
def rules_in_sentence(spark, sf):
    return rated_rules(spark, sf).withColumn("confidence", F.round("confidence", 4))


# --- sections -----------------------------------------------------------------------------

def _passages(phrases) -> str:
    return " || ".join(
        f"regexp_extract_all(t, {q(rf'(?is)({p}.*?)(?:{vocab.SECTION_END}|' + chr(92) + 'z)')}, 1)" for p in phrases)


# Three copies with a numbered line between them, so that passages end both ways.
THRICE_SQL = "concat(text, chr(10), '2. next part', chr(10), text, chr(10), 'NEXT 2024-01-01 (1/2)', chr(10), text)"


@query(with_docs(f"""
select doc_id, section, len(items) as n_items, array_to_string(items, ' # ') as items
from (select doc_id, section, [{py_strip('p')} for p in passages if length({py_strip('p')}) > 100] as items from (
  {' union all '.join(f"select doc_id, {q(n)} as section, {_passages(p)} as passages from (select doc_id, {THRICE_SQL} as t from policy_docs)" for n, p in vocab.CONTENT_SECTIONS.items())}))
where len(items) > 0"""))
def content_sections(spark, sf):
    docs = policy_docs(spark, sf).select("doc_id", F.expr(THRICE_SQL).alias("t"))
    return docs.select("doc_id", F.inline(E.content_sections(F.col("t")))).select(
        "doc_id", "section", F.size("items").alias("n_items"), F.array_join("items", " # ").alias("items"))


WINDOWS_SQL = f"""
manual_lines as (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) - 1 as pos
  from (select doc_id, {THRICE_SQL} as t from policy_docs)),
sized as (select *, count(*) over w as n_lines, sum(length(line) + 1) over w - 1 as n_chars from manual_lines
  window w as (partition by doc_id order by pos rows between current row and 199 following)),
hits as ({' union all '.join(f"select doc_id, {q(n)} as section, pos as line, n_lines, n_chars::int as n_chars from sized where n_chars > 500 and {any_contains('lower(line)', dict.fromkeys(h + c))}" for n, (h, c) in vocab.MANUAL_SECTIONS.items())})"""


@query(with_docs("select * from hits", WINDOWS_SQL))
def section_windows(spark, sf):
    docs = policy_docs(spark, sf).select("doc_id", F.expr(THRICE_SQL).alias("t"))
    found = F.array(*[F.struct(F.lit(n).alias("section"), E.section_windows(F.col("t"), n).alias("w"))
                      for n in vocab.MANUAL_SECTIONS])
    return docs.select("doc_id", F.inline(found)).select("doc_id", "section", F.inline("w"))


@query(with_docs("""
select doc_id, section, md5(string_agg(window_text, chr(10) || chr(10) order by line)) as text_md5
from (select h.doc_id, h.section, h.line, string_agg(m.line, chr(10) order by m.pos) as window_text
  from hits h join manual_lines m on h.doc_id = m.doc_id and m.pos between h.line and h.line + 199 group by all) group by all""", WINDOWS_SQL))
def section_evidence(spark, sf):
    docs = policy_docs(spark, sf).select("doc_id", F.expr(THRICE_SQL).alias("t"))
    found = F.array(*[F.struct(F.lit(n).alias("section"), E.section_text(F.col("t"), n).alias("body"))
                      for n in vocab.MANUAL_SECTIONS])
    return docs.select("doc_id", F.inline(found)).where("body is not null").select(
        "doc_id", "section", F.md5("body").alias("text_md5"))


HEADED_SQL = ("concat(upper(substring(text, 1, 40)), chr(10), 'SECTION 4: Claims and ', payer_name, chr(10), "
              "'3. Appeals of ', payer_name, chr(10), text)")


@query(with_docs(f"""
select doc_id, string_agg(title, ' | ' order by start, ord) as headers, count(*) as n
from (select *, {py_strip('captured')} as title from matched) where length(title) > 10 and length(title) < 100 group by 1""",
    f"headed as (select doc_id, {HEADED_SQL} as t from policy_docs)",
    matches_sql("headed", "t", [("h", p) for p in vocab.SECTION_HEADER_PATTERNS], "m", True)))
def section_headers(spark, sf):
    docs = policy_docs(spark, sf).select("doc_id", F.expr(HEADED_SQL).alias("t"))
    titles = docs.select("doc_id", E.section_headers(F.col("t"), None).alias("h"))
    return titles.where(F.size("h") > 0).select("doc_id", F.array_join("h", " | ").alias("headers"),
                                                F.size("h").cast("long").alias("n"))


# --- model output ---------------------------------------------------------------------------

FULL_REPLY = ("""concat('{"policy_id": "PA-', cast(doc_id as string), '", "policy_type": "appeals", "effective_date": null, """
              """"end_date": "2024-01-01", "supersedes": ["PA-1", "PA-2"], "summary": "s", "payer_name": "', payer_name, '", "source_pdf": "x.pdf"}')""")
REPLY_SQL = f"""
case cast(doc_id % 6 as int)
  when 0 then concat('```json', chr(10), {FULL_REPLY}, chr(10), '```')
  when 1 then concat('Here it is: ', {FULL_REPLY}, ' Hope it helps.')
  when 2 then '{{"policy_id": "x", "policy_type": "claims"}}'
  when 3 then replace({FULL_REPLY}, '["PA-1", "PA-2"]', '"PA-1"')
  when 4 then 'I cannot tell.'
  else replace({FULL_REPLY}, '"x.pdf"', 'null') end"""
KEYS = ", ".join(q(k) for k in vocab.POLICY_JSON_KEYS)
REPLIES_SQL = f"""
replies as (select *, coalesce(json_valid(object) and len([k for k in [{KEYS}] if not list_contains(json_keys(object), k)]) = 0, false) as valid
  from (select doc_id, payer_name, case when json_valid(cut) then cut end as object
    from (select *, regexp_extract(replace(replace(reply, '```json', ''), '```', ''), '(?s)\\{{.*\\}}') as cut
      from (select doc_id, payer_name, {REPLY_SQL} as reply from policy_docs))))"""


def replies(spark, sf):
    return policy_docs(spark, sf).select("doc_id", "payer_name", "text", E.clean_model_json(F.expr(REPLY_SQL)).alias("object"))


@query(with_docs("""
select doc_id, valid, case when valid then object->>'$.policy_id' end as policy_id,
  case when valid then case when json_type(object, '$.supersedes') = 'ARRAY' then array_to_string((object->>'$.supersedes[*]'), ',') else '' end end as superseded,
  case when list_contains(json_keys(object), 'source_pdf') then object->>'$.source_pdf' else 'rule.pdf' end as overlaid,
  case when list_contains(json_keys(object), 'end_date') then object->>'$.end_date' else 'open' end as defaulted
from replies""", REPLIES_SQL))
def model_policies(spark, sf):
    body = F.col("object")
    parsed = replies(spark, sf).withColumn("p", E.policy_json(body))
    return parsed.select(
        "doc_id", E.valid_policy_json(body).alias("valid"), F.col("p.policy_id").alias("policy_id"),
        F.array_join("p.supersedes", ",").alias("superseded"),
        E.overlay(F.lit("rule.pdf"), body, "source_pdf").alias("overlaid"),
        E.default_key(body, "end_date", F.lit("open")).alias("defaulted"))


@query(with_docs("""
select doc, chunk_idx, object->>'$.policy_id' as policy_id from (select doc_id // 4 as doc, doc_id % 4 as chunk_idx, object,
  row_number() over (partition by doc_id // 4 order by doc_id % 4) as rn from replies where valid) where rn = 1""", REPLIES_SQL))
def first_valid_chunk(spark, sf):
    chunks = policy_docs(spark, sf).select(
        F.expr("doc_id div 4").alias("doc"), (F.col("doc_id") % 4).alias("chunk_idx"), F.expr(REPLY_SQL).alias("model_output"))
    best = H.first_valid_chunk(chunks, "doc")
    return best.select("doc", "chunk_idx", F.get_json_object("model_output", "$.policy_id").alias("policy_id"))


SECTION_REPLY = """
concat('{"requirements": [', case when doc_id % 2 = 0 then '"a", "b"' else '' end, '], "deadlines": ["', cast(30 + doc_id % 150 as string),
  ' days", "', cast(doc_id % 7 as string), ' days", "promptly"], "forms": [', case when doc_id % 3 = 0 then '"f"' else '' end, ']',
  case when doc_id % 5 = 0 then '' else ', "notes": []' end, ', "procedures": ', case when doc_id % 7 = 0 then '"call"' else '[]' end, '}')"""


@query(with_docs("""
select doc_id,
  case when doc_id % 5 <> 0 and (doc_id % 2 = 0) then 'a,b' else '' end as claims_requirements,
  case when doc_id % 5 <> 0 then cast(30 + doc_id % 150 as varchar) || ' days,' || (doc_id % 7)::varchar || ' days,promptly' else '' end as appeal_deadlines,
  case when doc_id % 5 <> 0 and doc_id % 7 <> 0 and doc_id % 2 = 0 then 'a,b' else '' end as auth_requirements
from policy_docs"""))
def section_replies(spark, sf):
    docs = policy_docs(spark, sf).select("doc_id", F.expr(SECTION_REPLY).alias("j"))
    body = F.col("j")
    return docs.select(
        "doc_id", F.array_join(E.section_fields(body, "claims")["requirements"], ",").alias("claims_requirements"),
        F.array_join(E.section_fields(body, "appeals")["deadlines"], ",").alias("appeal_deadlines"),
        F.array_join(E.section_fields(body, "prior_authorization")["requirements"], ",").alias("auth_requirements"))


@query(with_docs("""
select doc_id, array_to_string([d for d in deadlines if len(regexp_extract_all(d, '\\b(\\d+)\\b')) = 0
    or list_bool_or([contains(lower(text), n || ' day') or contains(lower(text), n || ' calendar day') or contains(lower(text), n || ' business day')
      or contains(lower(text), n || '-day') for n in regexp_extract_all(d, '\\b(\\d+)\\b')])], ',') as kept
from (select doc_id, text, [(30 + doc_id % 150)::varchar || ' days', (doc_id % 7)::varchar || ' days or 45 days', 'promptly'] as deadlines from policy_docs)"""))
def supported_deadlines(spark, sf):
    deadlines = F.array(F.concat((F.lit(30) + F.col("doc_id") % 150).cast("string"), F.lit(" days")),
                        F.concat((F.col("doc_id") % 7).cast("string"), F.lit(" days or 45 days")), F.lit("promptly"))
    return policy_docs(spark, sf).select(
        "doc_id", F.array_join(E.validate_deadlines(deadlines, F.col("text")), ",").alias("kept"))


# --- per-document rule statistics -----------------------------------------------------------

def document_rules(spark, sf):
    """One row per document with its valid rules, near-copies dropped."""
    found = E.rules_in_sentence(F.col("text"))
    valid = F.filter(found, lambda r: S.is_valid_rule(r["requirement"], r["full_context"]))
    rated = F.transform(valid, lambda r: F.struct(
        r["rule_type"].alias("rule_type"), r["requirement"].alias("requirement"), r["full_context"].alias("full_context"),
        S.rule_confidence(r["full_context"], r["rule_type"]).alias("confidence"), r["ord"].alias("ord"), r["start"].alias("start")))
    docs = policy_docs(spark, sf).select("doc_id", "payer_name", "text")
    return computed_once(docs, "rules", M.dedupe_rules(rated, lambda r: r["requirement"]))


# At most a handful of rules per document: drop a rule when an earlier one resembles it and was kept itself.
KEPT_SQL = SENTENCE_SQL + """,
ordered as (select *, row_number() over (partition by doc_id order by ord, start) as rn,
    list_distinct([w for w in string_split_regex(lower(requirement), '\\s+') if w <> '']) as words from rated where valid),
resembles as (select b.doc_id, b.rn, a.rn as earlier from ordered a join ordered b on a.doc_id = b.doc_id and a.rn < b.rn
  where len(list_intersect(a.words, b.words)) / len(list_distinct(a.words || b.words)) > 0.85),
kept as (select * from ordered o where not exists (select 1 from resembles r where r.doc_id = o.doc_id and r.rn = o.rn
  and not exists (select 1 from resembles x where x.doc_id = r.doc_id and x.rn = r.earlier)))"""


@query(with_docs("select doc_id, rule_type, requirement, round(confidence, 4) as confidence from kept", KEPT_SQL))
def deduped_rules(spark, sf):
    return document_rules(spark, sf).select("doc_id", F.inline("rules")).select(
        "doc_id", "rule_type", "requirement", F.round("confidence", 4).alias("confidence"))


@query(with_docs("""
select p.doc_id, coalesce(n, 0) as total_rules, coalesce(types, 0) as rule_types_found, length(text) as text_length,
  case when length(text) > 5000 then 'good' else 'low' end as text_quality, round(coalesce(mean, 0), 6) as average_confidence,
  round(case when n > 0 then least(n / 50.0, 0.4) else 0 end + least(coalesce(mean, 0), 0.3) + least(coalesce(types, 0) / 8.0, 0.3), 6)::double as overall_score
from policy_docs p left join (select doc_id, count(*) as n, avg(confidence) as mean, count(distinct rule_type) as types from kept group by 1) k using (doc_id)""", KEPT_SQL))
def document_rule_statistics(spark, sf):
    docs = document_rules(spark, sf).withColumn("m", RP.extraction_quality(F.col("rules"), F.length("text")))
    return docs.select(
        "doc_id", F.col("m.total_rules").cast("long").alias("total_rules"),
        F.col("m.rule_types_found").cast("long").alias("rule_types_found"), F.length("text").alias("text_length"),
        "m.text_quality", F.round("m.average_confidence", 6).alias("average_confidence"),
        F.round("m.overall_score", 6).alias("overall_score"))


FIELDS_SQL = with_docs(f"""
select doc_id, payer, policy_type, effective_date, days, confidence, confidence < 0.75 as fallback, confidence < 0.6 as fallback_low from (
select *, (case when payer <> 'Unknown' then 0.25 else 0 end + case when policy_type <> 'general' then 0.20 else 0 end
  + case when coalesce(effective_date, '') <> '' then 0.15 else 0 end + case when coalesce(days, 0) <> 0 then 0.15 else 0 end
  + case when pa then 0.10 else 0 end + case when bullets >= 3 then 0.15 else 0 end)::double as confidence
from (select doc_id, text, case when contains(lower(text), 'automobile') then 'Auto' when contains(lower(text), 'building') or contains(lower(text), 'furniture') then 'Build'
      when contains(lower(text), 'household') then 'Home' else 'Unknown' end as payer,
    {argmax_case(TYPE_COUNTS, "'general'")} as policy_type, contains(lower(text), 'prior auth') as pa,
    coalesce(({HYBRID['effective']})[1], ({HYBRID['expiration']})[2]) as effective_date,
    coalesce({', '.join(_days(p, m) for p, m in vocab.FILING_PATTERNS)}) as days,
    least(5, len({BULLETS_SQL})) as bullets from (select *, text as t from policy_docs)))""")


@query(FIELDS_SQL)
def extraction_confidence(spark, sf):
    from policylake.plans.flows import rule_fields
    from policylake.registry.scores import SEGMENT_PAYERS
    found = rule_fields(policy_docs(spark, sf), payers=SEGMENT_PAYERS)
    return found.select(
        "doc_id", "payer", "policy_type", "effective_date", F.col("timely_filing_days").alias("days"),
        F.round("confidence_score", 4).alias("confidence"),
        S.needs_fallback(F.col("confidence_score")).alias("fallback"),
        S.needs_fallback(F.col("confidence_score"), 0.6).alias("fallback_low"))
