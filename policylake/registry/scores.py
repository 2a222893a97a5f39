"""URL, link, type and quality scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from policylake import vocab
from policylake.functions import extract as E
from policylake.functions import score as S
from policylake.functions import text as X
from policylake.operators import pages as PG
from policylake.operators import reports as RP
from policylake.registry.base import (
    any_contains, argmax_case, count_in, first_case, py_strip, q, query, sum_contains, sum_counts, with_docs,
)
from policylake.sources.policy_docs import policy_docs, table

TITLE_SQL = "split_part(text, chr(10), 1)"


def _hits(patterns) -> str:
    return "[p for p in [" + ", ".join(
        f"case when regexp_matches(lower(url), {q(p)}) then {q(p)} end" for p in patterns) + "] if p is not null]"


@query(with_docs(f"""
select doc_id, 2 * len(high) - len(low) as score, (2 * len(high) - len(low)) > 0 as accepted,
  case when len(high) > 0 then 'High-value patterns: ' || array_to_string(high, ', ')
       when len(low) > 0 then 'Low-value patterns: ' || array_to_string(low, ', ')
       else 'Neutral URL pattern' end as reason
from (select doc_id, {_hits(vocab.URL_HIGH_PATTERNS)} as high, {_hits(vocab.URL_LOW_PATTERNS)} as low from policy_docs)"""))
def url_score(spark, sf):
    return policy_docs(spark, sf).select("doc_id", S.url_score(F.col("url")).alias("u")).select("doc_id", "u.*")


def _link_sql(edition: str) -> str:
    rules = S.link_rules(edition)
    raw = ", ".join(
        f"2 * {sum_contains('joined', k)} + {sum_contains('joined', p)} as {name}" for name, (k, p) in rules.items())
    names = list(rules)
    scores = [(n, "billing" if n == vocab.LINK_BASELINE_RULE else n) for n in names]
    listed = ", ".join(f"case when {c} > 0 then {q(n + '=')} || {c} end" for n, c in scores)
    return with_docs(f"""
select doc_id, is_targeted, case when is_targeted then {argmax_case(scores, 'null')} end as primary_rule,
  case when is_targeted then array_to_string([x for x in [{listed}] if x is not null], ',') else '' end as scores
from (select *, not excluded and greatest({', '.join(c for _, c in scores)}) >= 2 as is_targeted
  from (select *, case when greatest({', '.join(names)}) = 0 and {any_contains('joined', vocab.LINK_BASELINE_TERMS)}
      then 2 else {vocab.LINK_BASELINE_RULE} end as billing
    from (select doc_id, joined, {any_contains('joined', vocab.LINK_EXCLUDED_TERMS)} as excluded, {raw}
      from (select doc_id, lower(text || ' ' || regexp_extract(url, '[^/]*$') || ' ' || url) as joined from policy_docs))))""")


def _classified(spark, sf, edition):
    url = F.col("url")
    rows = policy_docs(spark, sf).select("doc_id", S.classify_link(F.col("text"), X.basename(url), url, edition).alias("c"))
    shown = F.array_join(F.array(*[
        F.concat(F.lit(f"{n}="), F.element_at("c.scores", n).cast("string")) for n in vocab.LINK_RULES]), ",")
    return rows.select("doc_id", "c.is_targeted", "c.primary_rule",
                       F.when(F.col("c.is_targeted"), shown).otherwise("").alias("scores"))


@query(_link_sql("all"))
def link_classification(spark, sf):
    return _classified(spark, sf, "all")


@query(_link_sql("single"))
def link_classification_single(spark, sf):
    return _classified(spark, sf, "single")


FOLLOW = list(dict.fromkeys(
    [t for k, p in vocab.LINK_RULES.values() for t in k + p] + list(vocab.LINK_EXTRA_TERMS)))
LOW_TITLE = f"lower({TITLE_SQL})"


@query(with_docs(f"""
select doc_id, {any_contains(f"({LOW_TITLE} || ' ' || lower(url))", FOLLOW)} as follow,
  {any_contains(LOW_TITLE, vocab.PAGE_LINK_TERMS)} or {any_contains('lower(url)', vocab.PAGE_LINK_TERMS)} as page_relevant,
  {first_case([(any_contains('lower(url)' if n == 'document' else LOW_TITLE, t), n) for n, t in vocab.LINK_TYPES], "'general'")} as link_type,
  contains(lower(url), '.pdf') as is_pdf, {any_contains('lower(url)', vocab.DOWNLOAD_EXTENSIONS)} as is_download,
  lower(regexp_extract(url, '[^.]*$')) as download_type,
  {sum_contains(f"lower({TITLE_SQL} || ' ' || regexp_extract(url, '[^/]*$'))", vocab.PAGE_DOCUMENT_TERMS)} as relevance
from policy_docs"""))
def link_flags(spark, sf):
    title, url = X.extract_title(F.col("text")), F.col("url")
    return policy_docs(spark, sf).select(
        "doc_id", S.link_relevant(title, url).alias("follow"),
        S.page_link_relevant(title, url).alias("page_relevant"), S.link_type(title, url).alias("link_type"),
        S.is_pdf_url(url).alias("is_pdf"), S.is_download(url).alias("is_download"),
        S.download_type(url).alias("download_type"),
        S.document_relevance(title, X.basename(url)).alias("relevance"))


LINK_TYPES_OTHER = "lower(text)"


@query(with_docs(f"""
select {first_case([(any_contains(LINK_TYPES_OTHER, t), n) for n, t in vocab.LINK_TYPES if n != 'document'], "'general'")} as link_type, count(*) as n
from policy_docs group by 1"""))
def link_types_by_text(spark, sf):
    kind = S.link_type(F.col("text"), F.lit("/page"))
    return policy_docs(spark, sf).groupBy(kind.alias("link_type")).agg(F.count("*").alias("n"))


@query(with_docs(f"""
select * from (
  select url, {TITLE_SQL} as text, regexp_extract(url, '[^/]*$') as filename,
    {sum_contains(f"lower({TITLE_SQL} || ' ' || regexp_extract(url, '[^/]*$'))", vocab.PAGE_DOCUMENT_TERMS)} as relevance_score
  from policy_docs
  union all
  select 'https://files.example.com/' || n_name || '.pdf', 'Direct PDF', n_name || '.pdf', 10 from nation)
where relevance_score > 0"""))
def relevant_documents(spark, sf):
    docs = policy_docs(spark, sf)
    links = docs.select("url", X.extract_title(F.col("text")).alias("text"), X.basename(F.col("url")).alias("filename"))
    direct = table(spark, sf, "nation").select(
        F.concat(F.lit("https://files.example.com/"), "n_name", F.lit(".pdf")).alias("url"))
    return PG.relevant_documents(links, direct)


DOC_WEIGHTS = {"license": 3, "test": 3, "the": 1, "and": 1, "de": 1, "tion": 1}


@query(f"select doc_id, {sum_counts('lower(text)', DOC_WEIGHTS)}::int as score, "
       f"{sum_contains('lower(text)', DOC_WEIGHTS)}::int as present from documents")
def keyword_score(spark, sf):
    low = F.lower("text")
    return table(spark, sf, "documents").select(
        "doc_id", S.occurrence_score(low, DOC_WEIGHTS).alias("score"),
        S.presence_score(low, DOC_WEIGHTS).alias("present"))


@query(with_docs(f"""select doc_id, {sum_counts('lower(text)', {
    **{t: 1 for t in vocab.MEDIUM_VALUE_KEYWORDS}, **{t: 3 for t in vocab.HIGH_VALUE_KEYWORDS}})}::int as score from policy_docs"""))
def keyword_relevance(spark, sf):
    return policy_docs(spark, sf).select("doc_id", S.keyword_relevance(F.col("text")).alias("score"))


SEGMENT_PAYERS = {"Auto": ("automobile",), "Build": ("building", "furniture"), "Home": ("household", "furniture")}
LOW = "lower(text)"


def _payer_sql(payers, default):
    return first_case([(any_contains(LOW, t), n) for n, t in payers.items()], default)


@query(with_docs(f"""
select doc_id, {_payer_sql(SEGMENT_PAYERS, "'Unknown'")} as payer, {_payer_sql(vocab.PAYERS_EXTRACTION, "'Unknown'")} as known_payer,
  {_payer_sql(vocab.PAYERS_MINING, 'null')} as mined_payer,
  {first_case([(f"({any_contains('lower(url)', t)} or {any_contains(LOW, t)})", n) for n, t in {**vocab.PAYERS_INDEX, 'MACHINE': ('machinery', 'brochure')}.items()], "'UNKNOWN'")} as indexed_payer
from policy_docs"""))
def payer_detection(spark, sf):
    text, url = F.col("text"), F.col("url")
    index = {**vocab.PAYERS_INDEX, "MACHINE": ("machinery", "brochure")}
    return policy_docs(spark, sf).select(
        "doc_id", S.detect_payer(text, SEGMENT_PAYERS).alias("payer"), S.detect_payer(text).alias("known_payer"),
        S.detect_payer(text, vocab.PAYERS_MINING, None).alias("mined_payer"),
        S.detect_payer(text, index, "UNKNOWN", filename=url).alias("indexed_payer"))


STATE_WORDS = ("the", "de la", "sich", "para", *vocab.MINING_STATES)


@query(f"select doc_id, {first_case([(f'contains(lower(text), {q(s)})', s.title()) for s in STATE_WORDS])} as state from documents")
def state_in_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.detect_state(F.col("text"), STATE_WORDS).alias("state"))


TYPE_COUNTS = [(n, "(" + " + ".join(count_in(LOW, t) for t in terms) + ")") for n, terms in vocab.POLICY_TYPES.items()]
TOPIC_COUNTS = [(n, count_in(LOW, t)) for n, t in vocab.MANUAL_TOPICS.items()]
TOPIC_SUM = "(" + " + ".join(c for _, c in TOPIC_COUNTS) + ")"
TOPIC_BEST = f"greatest({', '.join(c for _, c in TOPIC_COUNTS)})"


def _topic_sql() -> str:
    return "array_to_string([t for t in [" + ", ".join(
        f"case when {' or '.join(f'regexp_matches({LOW}, {q(p)})' for p in patterns)} then {q(n)} end"
        for n, patterns in sorted(vocab.TOPICS.items())) + "] if t is not null], ',')"


# The first line names every document a manual, so the share rule is asked of the rest of the text.
@query(with_docs(f"""
select doc_id, {argmax_case(TYPE_COUNTS, "'general'")} as policy_type,
  case when {any_contains(LOW, vocab.MANUAL_INDICATORS)} then 'general'
       when {TOPIC_BEST} > 0 and {TOPIC_BEST} / {TOPIC_SUM} > 0.6 then {argmax_case(TOPIC_COUNTS, "'general'")} else 'general' end as manual_type,
  case when {any_contains(LOW, ('prior auth', 'preauthorization'))} then true end as prior_auth,
  {_topic_sql()} as topics,
  {first_case([(f"(contains(lower(url), {q(t)}) or contains({LOW}, {q(t)}))", n) for n, t in vocab.COVERAGE_TYPES], "'General'")} as coverage_type
from (select doc_id, url, substring(text, strpos(text, chr(10)) + 1) as text from policy_docs)"""))
def document_types(spark, sf):
    text = F.expr("substring(text, instr(text, '\\n') + 1)")
    docs = policy_docs(spark, sf).withColumn("text", text)
    body = F.col("text")
    return docs.select(
        "doc_id", S.detect_policy_type(body).alias("policy_type"), S.classify_policy_type(body).alias("manual_type"),
        S.detect_prior_auth(body).alias("prior_auth"), F.array_join(S.topics(body), ",").alias("topics"),
        S.coverage_type(F.col("url"), body).alias("coverage_type"))


@query(with_docs(f"""
select {first_case([(any_contains(LOW, vocab.MANUAL_INDICATORS), 'manual')], "'other'")} as kind,
  case when contains({LOW}, 'no prior authorization') or contains({LOW}, 'not require prior authorization') then false
       when contains({LOW}, 'prior auth') then true end as strict_prior_auth, count(*) as n
from (select replace(text, 'Prior authorization is', 'No prior authorization is') as text from policy_docs
      union all select text from policy_docs) group by all"""))
def prior_auth_strict(spark, sf):
    docs = policy_docs(spark, sf)
    negated = docs.select(F.replace("text", F.lit("Prior authorization is"), F.lit("No prior authorization is")).alias("text"))
    text = F.col("text")
    kind = F.when(S.contains_any(F.lower(text), vocab.MANUAL_INDICATORS), "manual").otherwise("other")
    return negated.unionByName(docs.select("text")).groupBy(
        kind.alias("kind"), S.detect_prior_auth(text, strict=True).alias("strict_prior_auth")).agg(F.count("*").alias("n"))


# --- quality --------------------------------------------------------------------------

CATEGORY = [(n, sum_contains("joined", t)) for n, t in vocab.QUALITY_CATEGORIES.items()]
QUALITY_SQL = f"""
quality_base as (select doc_id, url, {TITLE_SQL} as title, text,
    lower({TITLE_SQL}) || ' ' || lower(text) || ' ' || lower(regexp_extract(url, '[^/]*$')) as joined,
    regexp_extract(text, 'of (\\d+)', 1)::int as pages from policy_docs),
quality as (select *, length(title) > 10 as has_meaningful_title, estimated > 1000 as sufficient_content,
    pages between 1 and 500 as reasonable_pages, exclusion_score = 0 as no_exclusions,
    relevance_score > 0 and (length(title) > 10)::int + (estimated > 1000)::int + (pages between 1 and 500)::int + (exclusion_score = 0)::int >= 2 as is_relevant
  from (select *, {argmax_case(CATEGORY, "'uncategorized'")} as primary_category,
    {' + '.join(c for _, c in CATEGORY)} - 2 * exclusion_score as relevance_score
  from (select *, {sum_contains('joined', vocab.QUALITY_EXCLUSIONS)} as exclusion_score,
    length(text) * pages / least(3, pages) as estimated from quality_base)))"""


def analysed_docs(spark, sf):
    """Policy documents with their quality struct; the URL's file name counts as text."""
    docs = policy_docs(spark, sf).select(
        "doc_id", "url", "payer_name", X.extract_title(F.col("text")).alias("title"), "text",
        E.first_match(F.col("text"), r"of (\d+)").cast("int").alias("pages"))
    seen = F.concat_ws(" ", "text", X.basename(F.col("url")))
    return docs.withColumn("quality", S.quality_flags(
        F.col("title"), seen, F.col("pages"), S.estimated_length(F.col("text"), F.col("pages"))))


@query(with_docs("""select doc_id, primary_category, exclusion_score, relevance_score, is_relevant,
  has_meaningful_title::int + sufficient_content::int + reasonable_pages::int + no_exclusions::int as quality_score,
  has_meaningful_title, sufficient_content, reasonable_pages, no_exclusions from quality""", QUALITY_SQL))
def quality_flags(spark, sf):
    return analysed_docs(spark, sf).select("doc_id", "quality.*").drop("category_scores")


@query(with_docs("select primary_category, count(*) as n from quality group by 1", QUALITY_SQL))
def category_counts(spark, sf):
    return RP.category_counts(analysed_docs(spark, sf))


@query(with_docs("""select count(*) as analysed, sum(is_relevant::int) as relevant, sum((not is_relevant)::int) as irrelevant,
  round(sum(is_relevant::int) * 100.0 / count(*), 1) as relevant_percent from quality""", QUALITY_SQL))
def quality_summary(spark, sf):
    return RP.quality_summary(analysed_docs(spark, sf))


@query(with_docs("""
select metric, passed, total from (select count(*) as total, sum(has_meaningful_title::int) as has_meaningful_title,
  sum(sufficient_content::int) as sufficient_content, sum(reasonable_pages::int) as reasonable_pages,
  sum(no_exclusions::int) as no_exclusions from quality)
unpivot (passed for metric in (has_meaningful_title, sufficient_content, reasonable_pages, no_exclusions))""", QUALITY_SQL))
def quality_metrics(spark, sf):
    return RP.quality_flag_counts(analysed_docs(spark, sf))


@query(with_docs("""select doc_id, title, primary_category, relevance_score from quality where is_relevant
order by relevance_score desc, doc_id limit 5""", QUALITY_SQL))
def top_relevant_documents(spark, sf):
    return RP.top_relevant(analysed_docs(spark, sf), "doc_id", 5)


# The derived documents are shorter than the thresholds expect, so they are read five times over.
ASSESS_SQL = f"""
assessed as (select doc_id, relevance,
    (length(t) >= 500)::int + (length(t) <= 1000000)::int + (len(string_split_regex({py_strip('t')}, '\\s+')) >= 100)::int
    + (sections > 0)::int + (not excluded)::int as quality
  from (select doc_id, t, {sum_contains('lower(t)', [x.lower() for x in vocab.ESSENTIAL_TERMS])} as relevance,
      {any_contains('lower(t)', vocab.CONTENT_EXCLUSIONS)} as excluded,
      {sum_contains('lower(t)', ('prior authorization', 'timely filing', 'filing'))} as sections
    from (select doc_id, repeat(text || chr(10), 5) as t from policy_docs)))"""


@query(with_docs("""
select doc_id, quality as quality_score, relevance as relevance_score,
  case when quality >= 4 and relevance >= 2 then 'accept' when quality >= 3 and relevance >= 1 then 'review' else 'reject' end as recommendation,
  case when quality >= 4 and relevance >= 2 then 'High quality content with ' || relevance || ' relevant terms'
    when quality >= 3 and relevance >= 1 then 'Moderate quality, needs review' else 'Low quality or irrelevant content' end as reason
from assessed""", ASSESS_SQL))
def content_assessment(spark, sf):
    t = F.col("t")
    docs = policy_docs(spark, sf).select("doc_id", F.repeat(F.concat("text", F.lit("\n")), F.lit(5)).alias("t"))
    sections = S.presence_score(F.lower(t), ("prior authorization", "timely filing", "filing"))
    return docs.select("doc_id", S.assess_content(t, F.length(t), F.size(X.words(t)), sections).alias("a")).select(
        "doc_id", "a.quality_score", "a.relevance_score", "a.recommendation", "a.reason")


@query("""
select doc_id, case when kind not like '%pdf%' and not ends_with(url, '.pdf') then 'Not a PDF file (content-type: ' || kind || ')'
  when strlen(text) < 1024 then 'File too small (' || strlen(text) || ' bytes)'
  when strlen(text) > 20000 then 'File too large (' || strlen(text) || ' bytes)' end as reject_reason
from (select doc_id, text, case lang when 'en' then 'application/pdf' when 'fr' then 'text/html' else '' end as kind,
  case when lang = 'de' then 'https://a.example.com/x.pdf' else 'https://a.example.com/x' end as url from documents)""")
def size_gate(spark, sf):
    docs = table(spark, sf, "documents")
    kind = F.when(F.col("lang") == "en", "application/pdf").when(F.col("lang") == "fr", "text/html").otherwise("")
    url = F.when(F.col("lang") == "de", "https://a.example.com/x.pdf").otherwise("https://a.example.com/x")
    return docs.select("doc_id", S.size_gate(url, kind, F.octet_length("text"), max_bytes=20000).alias("reject_reason"))


@query(with_docs(f"""
select doc_id, {', '.join(f"{any_contains(LOW, t)} and length(text) > 20 as {n}" for n, t in vocab.RULE_INDICATORS.items())}
from policy_docs"""))
def rule_content(spark, sf):
    return policy_docs(spark, sf).select(
        "doc_id", *[S.is_rule_content(F.col("text"), n).alias(n) for n in vocab.RULE_INDICATORS])


# --- questions, citations ---------------------------------------------------------------

ASK_PAYERS = (("Plan A", ("the ", "der ")), ("Plan B", ("que", "para")), *vocab.QUESTION_PAYERS)
ASK_SCOPES = (("North", ("ing",)), ("South", ("tion", "ment")), *vocab.QUESTION_SCOPES)


@query(f"""
select conv_id, turn, {first_case([(any_contains(LOW, t), n) for n, t in ASK_PAYERS])} as payer_name,
  {first_case([(any_contains(LOW, t), n) for n, t in ASK_SCOPES])} as geographic_scope from conversations""")
def question_facets(spark, sf):
    text = F.col("text")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", S.question_payer(text, ASK_PAYERS).alias("payer_name"),
        S.question_scope(text, ASK_SCOPES).alias("geographic_scope"))


@query(with_docs(f"""
select {first_case([(f"contains({LOW}, {q(t)})", c) for t, c, _ in vocab.CONSOLE_FILTERS])} as filter_column,
  {first_case([(f"contains({LOW}, {q(t)})", v) for t, _, v in vocab.CONSOLE_FILTERS])} as filter_value, count(*) as n
from policy_docs group by all"""))
def console_filters(spark, sf):
    chosen = S.console_filter(F.col("text"))
    return policy_docs(spark, sf).groupBy(
        chosen["column"].alias("filter_column"), chosen["value"].alias("filter_value")).agg(F.count("*").alias("n"))


@query(with_docs("""
select doc_id,
  coalesce(nullif(case when doc_id % 3 = 0 then url else '' end, ''), case when doc_id % 3 = 1 then url || '#pdf' end,
    '/pdfs/' || regexp_extract(url, '[^/]*$')) as source,
  concat_ws(' · ', nullif(payer_name, 'BUILDING'), nullif(split_part(text, chr(10), 1), '')) as title from policy_docs"""))
def source_citation(spark, sf):
    url, empty = F.col("url"), F.lit("")
    docs = policy_docs(spark, sf)
    first = F.when(F.col("doc_id") % 3 == 0, url).otherwise(empty)
    second = F.when(F.col("doc_id") % 3 == 1, F.concat(url, F.lit("#pdf")))
    payer = F.when(F.col("payer_name") != "BUILDING", F.col("payer_name")).otherwise(empty)
    return docs.select(
        "doc_id", S.source_url(first, second, F.lit(None).cast("string"), X.basename(url)).alias("source"),
        S.source_title(payer, X.extract_title(F.col("text"))).alias("title"))


@query(with_docs(f"""
select doc_id, case when ptype = 'general' then payer_name || ' Provider Manual'
    else payer_name || ' ' || case ptype when 'claims' then 'Claims' when 'appeals' then 'Appeals' when 'prior_authorization' then 'Prior Authorization'
      when 'timely_filing' then 'Timely Filing' else 'Credentialing' end || ' Policy' end as title,
  case when ptype = 'general' then payer_name || ' provider manual' else payer_name || ' ' || ptype || ' policy' end
    || case when topics <> '' then ' covering ' || replace(topics, ',', ', ') else '' end as summary
from (select doc_id, payer_name, {argmax_case(TYPE_COUNTS, "'general'")} as ptype, {_topic_sql()} as topics from policy_docs)"""))
def manual_titles(spark, sf):
    text = F.col("text")
    docs = policy_docs(spark, sf).select("doc_id", "payer_name", S.detect_policy_type(text).alias("ptype"),
                                         S.topics(text).alias("topics"))
    payer, ptype = F.col("payer_name"), F.col("ptype")
    return docs.select("doc_id", S.manual_title(payer, ptype).alias("title"),
                       S.manual_summary(payer, ptype, F.col("topics")).alias("summary"))
