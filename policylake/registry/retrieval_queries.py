"""Chunks, vectors, search, answers and similar texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from policylake import vocab
from policylake.functions import answers as A
from policylake.functions import chunk as C
from policylake.functions import extract as E
from policylake.functions import text as X
from policylake.operators import embed as EM
from policylake.operators import retrieval as RT
from policylake.operators import similar as M
from policylake.registry.base import any_contains, first_case, py_strip, q, query, with_docs
from policylake.registry.scores import ASK_PAYERS, ASK_SCOPES, _topic_sql
from policylake.registry.extracts import policies
from policylake.sources.policy_docs import policy_docs, table


@query("""
select doc_id, (start // 5500)::int as chunk_idx, start::int as start, length(substring(text, start + 1, 6000)) as chars, md5(substring(text, start + 1, 6000)) as chunk_md5
from (select doc_id, text, unnest(range(0, length(text), 5500)) as start from documents)""")
def fixed_chunks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.inline(C.chunk_fixed(F.col("text")))).select(
        "doc_id", "chunk_idx", "start", F.length("chunk").alias("chars"), F.md5("chunk").alias("chunk_md5"))


def sentence_sql(source: str, key: str, text: str) -> str:
    """Window after window: each starts 200 before the previous end."""
    stop = "strpos(reverse(substring(body, start + 1, 1000)), '.')"
    return f"""
windows as (select {key}, {text} as body, 0 as start,
    case when 1000 < length({text}) and strpos(reverse(substring({text}, 1, 1000)), '.') between 1 and 299 then 1001 - strpos(reverse(substring({text}, 1, 1000)), '.') else 1000 end as stop
  from {source} where length({text}) > 0
  union all
  select {key}, body, start, case when start + 1000 < length(body) and {stop} between 1 and 299 then start + 1001 - {stop} else start + 1000 end
  from (select {key}, body, stop - 200 as start from windows) where start < length(body)),
chunks as (select {key}, row_number() over (partition by {key} order by start) - 1 as chunk_idx, chunk from (
  select {key}, start, {py_strip('substring(body, start + 1, stop - start)')} as chunk from windows) where chunk <> '')"""


@query("with recursive " + sentence_sql("documents", "doc_id", "text") + """
select doc_id, chunk_idx::int as chunk_idx, length(chunk) as chars, md5(chunk) as chunk_md5 from chunks""")
def sentence_chunks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.inline(C.chunk_sentence(F.col("text")))).select(
        "doc_id", "chunk_idx", F.length("chunk").alias("chars"), F.md5("chunk").alias("chunk_md5"))


HEADED = "concat(text, chr(10), 'PRIOR AUTHORIZATION', chr(10), text, chr(10), 'TIMELY FILING RULES', chr(10), text)"


@query(with_docs("""
select doc_id, unnest(['Introduction', 'PRIOR AUTHORIZATION', 'TIMELY FILING RULES']) as section, md5(text) as body_md5 from policy_docs"""))
def section_split(spark, sf):
    docs = policy_docs(spark, sf).select("doc_id", F.expr(HEADED).alias("t"))
    return docs.select("doc_id", F.inline(C.split_sections(F.col("t")))).select(
        "doc_id", "section", F.md5("content").alias("body_md5"))


@query(with_docs("""
select doc_id, unnest([md5(text), md5(text), md5(text)]) as label_md5, unnest(['PRIOR AUTHORIZATION', 'TIMELY FILING RULES', text]) as body from policy_docs"""))
def section_split_swapped(spark, sf):
    docs = policy_docs(spark, sf).select("doc_id", F.expr(HEADED).alias("t"))
    return docs.select("doc_id", F.inline(C.split_sections(F.col("t"), compat=True))).select(
        "doc_id", F.md5("section").alias("label_md5"), F.col("content").alias("body"))


@query(with_docs(f"""
select 'manual-' || doc_id || '_' || chunk_idx as chunk_id, payer_name as payer, section, char_count, topics from (
  select doc_id, payer_name, idx as chunk_idx, section, length(text) as char_count, {_topic_sql()} as topics from (
    select doc_id, payer_name, text, unnest([0, 1, 2]) as idx, unnest(['Introduction', 'PRIOR AUTHORIZATION', 'TIMELY FILING RULES']) as section from policy_docs))"""))
def chunk_records(spark, sf):
    from policylake.plans.flows import section_chunks
    docs = policy_docs(spark, sf).select(
        F.concat(F.lit("manual-"), F.col("doc_id").cast("string")).alias("filename"), F.col("payer_name").alias("payer"),
        F.expr(HEADED).alias("text"))
    return section_chunks(docs).select("chunk_id", "payer", "section", "char_count", F.array_join("topics", ",").alias("topics"))


# --- vectors ------------------------------------------------------------------------------

PROBES_SQL = "probes as (select label as qid, arg_min(embedding, vec_id)::double[] as qv, label from embeddings group by label)"


def probes(spark, sf):
    return table(spark, sf, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).select(
        F.col("label").alias("qid"), "embedding", "label")


@query(f"""with {PROBES_SQL}
select qid::bigint as qid, vec_id as id, rank::int as rank, similarity from (select *, row_number() over (partition by qid order by similarity desc, vec_id) as rank
  from (select qid, vec_id, round(list_cosine_similarity(qv, embedding::double[]), 6) as similarity from probes p join embeddings e on p.label = e.label)) where rank <= 10""")
def vector_search_filtered(spark, sf):
    return RT.search(probes(spark, sf), table(spark, sf, "embeddings"), 10, vid="vec_id", facets=["label"])


@query(f"""with {PROBES_SQL}
select qid::bigint as qid, vec_id as id, rank::int as rank, similarity from (select *, row_number() over (partition by qid order by similarity desc, vec_id) as rank
  from (select qid, vec_id, round(-pow(list_distance(qv, embedding::double[]), 2), 6) as similarity from probes, embeddings)) where rank <= 10""")
def vector_search_by_distance(spark, sf):
    return RT.search(probes(spark, sf), table(spark, sf, "embeddings"), 10, vid="vec_id", metric="l2sq")


def hashed_sql(text: str) -> str:
    buckets = f"[('0x' || substring(md5(t), 1, 4))::int % 64 for t in regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')]"
    return f"[len([b for b in {buckets} if b = i])::double for i in range(64)]"


@query(f"select doc_id, array_to_string([v::int for v in {hashed_sql('text')}], ',') as vector from documents")
def hashed_vectors(spark, sf):
    docs = EM.embed(table(spark, sf, "documents").select("doc_id", "text"), F.col("text"))
    return docs.select("doc_id", F.array_join(F.col("embedding").cast("array<int>"), ",").alias("vector"))


LOWT = "lower(text)"
ASKED_SQL = f"""
asked as materialized (select conv_id * 1000 + turn as qid, text as question, {hashed_sql('text')} as qv,
    {first_case([(any_contains(LOWT, t), n) for n, t in ASK_PAYERS])} as payer_name,
    {first_case([(any_contains(LOWT, t), n) for n, t in ASK_SCOPES])} as geographic_scope from conversations where role = 'user'),
store as materialized (select doc_id as id, {hashed_sql('text')} as v, text, source, lang,
    case lang when 'en' then 'Plan A' when 'fr' then 'Plan B' else 'Plan C' end as payer_name,
    case source when 'src1' then 'North' when 'src2' then 'West' else 'East' end as geographic_scope from documents),
scored as (select qid, id, (a.payer_name is null or a.payer_name = s.payer_name) and (a.geographic_scope is null or a.geographic_scope = s.geographic_scope) as fits,
    a.payer_name is not null or a.geographic_scope is not null as has_filter,
    round(list_dot_product(qv, v) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(v, v))), 6) as similarity
  from asked a, store s where list_dot_product(qv, qv) > 0 and list_dot_product(v, v) > 0),
chosen as (select *, row_number() over (partition by qid order by similarity desc, id) as rank from (
  select qid, id, similarity, not any_fits as fallback from (select *, bool_or(fits) over (partition by qid) as any_fits from scored)
  where fits or not any_fits and has_filter)),
hits as (select qid, id, rank::int as rank, similarity, fallback from chosen where rank <= 3)"""


def asked(spark, sf):
    turns = table(spark, sf, "conversations").where("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("question"))
    return EM.embed(RT.with_facets(turns, F.col("question"), ASK_PAYERS, ASK_SCOPES), F.col("question"))


def store(spark, sf):
    docs = table(spark, sf, "documents")
    payer = F.when(F.col("lang") == "en", "Plan A").when(F.col("lang") == "fr", "Plan B").otherwise("Plan C")
    scope = F.when(F.col("source") == "src1", "North").when(F.col("source") == "src2", "West").otherwise("East")
    named = docs.select(
        F.col("doc_id").alias("id"), "text", payer.alias("payer_name"), scope.alias("geographic_scope"),
        X.extract_title(F.col("text")).alias("title"), payer.alias("payer"), scope.alias("scope"),
        F.col("text").alias("content"), F.col("lang").alias("rule_type"),
        F.concat("source", F.lit(".pdf")).alias("filename"), F.lit(1).alias("page_number"), F.lit("").alias("source_url"))
    return EM.embed(named, F.col("text"))


FACETS = ["payer_name", "geographic_scope"]


@query(f"with {ASKED_SQL} select * from hits")
def question_search(spark, sf):
    return RT.search_with_fallback(asked(spark, sf), store(spark, sf).select("id", "embedding", *FACETS), 3, FACETS)


TITLE = py_strip(f"regexp_extract({py_strip('text')}, '^[^\\n]*')")


@query(f"""with {ASKED_SQL},
lines as (select qid, rank, source, payer_name, title, lang, rank || ') ' || coalesce(nullif(title, ''), 'Policy rule') || ' — ' || payer_name || ' (' || geographic_scope || ')'
    || case when body = '' then '' else chr(10) || '    ' || body end as line
  from (select h.*, s.source, s.payer_name, s.geographic_scope, s.lang, {py_strip('s.text')} as body, {TITLE.replace('text', 's.text')} as title from hits h join store s using (id)))
select a.qid, a.question, case when n is null then 'No relevant rules found for your query.'
  else 'Answer based on top ' || n || ' rule(s):' || chr(10) || '(See linked sources below for documents)' || chr(10) || listed end as answer,
  coalesce(cited, '') as cited, coalesce(n, 0)::int as n_hits
from asked a left join (select qid, count(*) as n, string_agg(line, chr(10) order by rank) as listed,
  string_agg(payer_name || case when title = '' then '' else ' · ' || rtrim(title) end || '|/pdfs/' || source || '.pdf|' || lang, ';' order by rank) as cited from lines group by 1) l using (qid)""")
def answers_cited(spark, sf):
    answered = RT.answer_batch(asked(spark, sf), store(spark, sf))
    cited = F.array_join(F.transform("sources", lambda s: F.concat_ws("|", s["title"], s["url"], s["rule_type"])), ";")
    return answered.select("qid", "question", "answer", F.coalesce(cited, F.lit("")).alias("cited"), "n_hits")


@query(f"""with {ASKED_SQL}
select qid, coalesce(context, '') as context, first_source from asked left join (
  select qid, string_agg(text, chr(10) || chr(10) order by rank) as context, first(source order by rank) || '.pdf' as first_source
  from hits join store using (id) group by 1) using (qid)""")
def answer_contexts(spark, sf):
    a, s = asked(spark, sf), store(spark, sf)
    hits = RT.search_with_fallback(a, s.select("id", "embedding", *FACETS), 3, FACETS)
    return RT.ranked_hits(hits, s, a).select("qid", A.chunk_context(F.col("hits")).alias("context"),
                                             F.get("hits.filename", F.lit(0)).alias("first_source"))


@query(f"""with {ASKED_SQL}
select qid, coalesce(context, {q(vocab.NO_CONTEXT)}) as context from asked left join (
  select qid, string_agg('Payer: ' || payer_name || chr(10) || 'Rule Type: ' || lang || chr(10) || 'Title: ' || {TITLE} || chr(10) || 'Document: ' || source
    || '.pdf (page 1)' || chr(10) || 'Content: ' || text || chr(10), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as context
  from hits join store using (id) group by 1) using (qid)""")
def rule_contexts(spark, sf):
    a, s = asked(spark, sf), store(spark, sf)
    hits = RT.search_with_fallback(a, s.select("id", "embedding", *FACETS), 3, FACETS)
    return RT.ranked_hits(hits, s, a).select("qid", A.rule_context(F.col("hits")).alias("context"))


@query("""
select conv_id, turn, case when m = '' or contains(lower(m), 'not sure') or contains(lower(m), 'insufficient') then 'retrieved' else m end as answer
from (select conv_id, turn, case turn % 4 when 0 then '' when 1 then 'I am Not Sure' when 2 then 'insufficient context' else text end as m from conversations)""")
def answers_chosen(spark, sf):
    turn = F.col("turn") % 4
    model = (F.when(turn == 0, "").when(turn == 1, "I am Not Sure").when(turn == 2, "insufficient context").otherwise(F.col("text")))
    return table(spark, sf, "conversations").select("conv_id", "turn", A.choose_answer(F.lit("retrieved"), model).alias("answer"))


@query("select count(*) as chunks from (select unnest(range(0, length(text), 5500)) from documents)")
def stored_chunk_count(spark, sf):
    return table(spark, sf, "documents").select(F.explode(C.chunk_fixed(F.col("text")))).agg(F.count("*").alias("chunks"))


# --- similar texts ------------------------------------------------------------------------

@query(f"""
with sets as (select min(doc_id) as sid, count(*) as members, words from (
  select doc_id, list_sort(list_distinct([w for w in string_split_regex(lower(text), '[\\t-\\r\\x1c-\\x1f\\x85\\p{{Z}}]+') if w <> ''])) as words from documents)
  where len(words) > 0 group by words),
tokens as (select sid, len(words) as n, unnest(words) as w from sets),
shared as (select a.sid as a, b.sid as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as both_n from tokens a join tokens b on a.w = b.w and a.sid < b.sid
  and a.n >= 0.84 * b.n and b.n >= 0.84 * a.n group by all)
select a, b, x.members as members_a, y.members as members_b, round(both_n / (na + nb - both_n), 6) as similarity
from shared join sets x on x.sid = a join sets y on y.sid = b where both_n / (na + nb - both_n) > 0.85""")
def word_overlap_pairs(spark, sf):
    pairs = M.jaccard_pairs(table(spark, sf, "documents"), "doc_id", F.col("text"))
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query()
def near_duplicates(spark, sf):
    return M.near_duplicates(table(spark, sf, "documents"), "doc_id", "text")


@query()
def similar_policies(spark, sf):
    rows = policies(spark, sf).withColumn("content", E.content_key(
        F.col("policy_type"), F.col("payer_name"), F.array().cast("array<string>"), E.all_requirements(F.col("text"))))
    return M.similar_policies(rows, "content")
