"""Cleaning, titles and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from policylake import vocab
from policylake.functions import score as S
from policylake.functions import text as X
from policylake.registry.base import py_strip, q, query, with_docs, SQL_WS
from policylake.sources.policy_docs import policy_docs, table

NOT_WORD_OR_WS = r"[^\p{L}\p{N}_\t-\r\x1c-\x1f\x85\p{Z}]"
FLAT = f"regexp_replace(regexp_replace(lower(text), '{SQL_WS}+', ' ', 'g'), '{NOT_WORD_OR_WS}', '', 'g')"


@query(f"""
select doc_id, md5(regexp_replace(regexp_replace({py_strip('lower(text)')}, '{SQL_WS}+', ' ', 'g'),
  '{NOT_WORD_OR_WS}', '', 'g')) as content_hash from documents""")
def normalized_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


STOPS = ", ".join(q(w) for w in vocab.STOP_WORDS)


@query(f"""
with t as (select doc_id, {py_strip(f"array_to_string([case when w in ({STOPS}) then '' else w end for w in string_split({FLAT}, ' ')], ' ')")} as plain
  from documents)
select doc_id, length(plain) as plain_chars, md5(plain) as plain_md5 from t""")
def similarity_text(spark, sf):
    plain = table(spark, sf, "documents").select("doc_id", X.similarity_text(F.col("text")).alias("plain"))
    return plain.select("doc_id", F.length("plain").alias("plain_chars"), F.md5("plain").alias("plain_md5"))


def _denoise(text: str) -> str:
    for pattern in vocab.NOISE_PATTERNS:
        text = f"regexp_replace({text}, {q('(?i)' + pattern)}, '', 'g')"
    return text


@query(with_docs(f"select doc_id, {py_strip(f'''regexp_replace({_denoise('text')}, '{SQL_WS}+', ' ', 'g')''')} as cleaned from policy_docs"))
def noise_removed_flat(spark, sf):
    return policy_docs(spark, sf).select(
        "doc_id", X.clean_noise(F.col("text"), keep_newlines=False).alias("cleaned"))


HORIZONTAL = r"[\t\x0b-\r\x1c-\x1f\x85\p{Z}]+"


@query(with_docs(f"""
select doc_id, {py_strip(f'''regexp_replace(regexp_replace({_denoise('text')}, '{HORIZONTAL}', ' ', 'g'),
  '\\n{SQL_WS}*\\n', chr(10) || chr(10), 'g')''')} as cleaned from policy_docs"""))
def noise_removed_lines(spark, sf):
    return policy_docs(spark, sf).select("doc_id", X.clean_noise(F.col("text")).alias("cleaned"))


@query(f"""
with t as (select doc_id, array_to_string([regexp_replace(p, '{SQL_WS}+', ' ', 'g') || chr(10)
    for p in string_split(text, chr(10))], '') as full_text from documents)
select doc_id, md5(full_text) as text_md5, length({py_strip('full_text')}) as content_length,
  len([w for w in regexp_split_to_array(full_text, '{SQL_WS}+') if w <> '']) as word_count from t""")
def cleaned_pages(spark, sf):
    pages = X.clean_pages(F.split("text", "\n"))
    return table(spark, sf, "documents").select("doc_id", pages.alias("p")).select(
        "doc_id", F.md5("p.full_text").alias("text_md5"), "p.content_length", "p.word_count")


# Lines as rows and windows over them: another formulation than the in-row one it checks.
def _boilerplate(source: str) -> str:
    toc = ("contains(lower(line), 'table of contents') or s_low = 'contents' "
           "or (length(line) - length(replace(line, '.', '')) > 10 and regexp_matches(line, '\\d+\\s*$')) "
           "or regexp_matches(line, '\\.{3,}\\s*\\d+\\s*$')")
    page = ("regexp_matches(s_low, '^page\\s+\\d+') or regexp_matches(s, '^\\d+\\s+(of|/)\\s+\\d+$') "
            "or regexp_matches(s, '^\\d+$')")
    table_line = "length(line) - length(replace(line, '|', '')) >= 3 or regexp_matches(line, '^[\\s\\-|:]+$')"
    return f"""
lines as (select doc_id, unnest(string_split(text, chr(10))) as line,
    generate_subscripts(string_split(text, chr(10)), 1) as pos from {source}),
stripped as (select *, {py_strip('line')} as s, lower({py_strip('line')}) as s_low from lines),
counted as (select *, count(*) over (partition by doc_id, s) as seen from stripped),
survived as (select doc_id, pos, line, s, ({table_line}) as is_table from counted
  where s <> '' and not ({toc}) and not ({page}) and not (length(s) > 5 and seen >= 3)),
marked as (select *, coalesce(max(is_table::int) over (partition by doc_id order by pos
    rows between 6 preceding and 1 preceding), 0) as after_table from survived),
cleaned as (select doc_id, string_agg(line, chr(10) order by pos) as cleaned from marked
  where not is_table and after_table = 0 and length(s) >= 30 group by doc_id)"""


BOILERPLATE_RESULT = "select d.doc_id, coalesce(c.cleaned, '') as cleaned from {0} d left join cleaned c using (doc_id)"


@query(with_docs(BOILERPLATE_RESULT.format("policy_docs"), _boilerplate("policy_docs")))
def boilerplate_removed_policies(spark, sf):
    return policy_docs(spark, sf).select("doc_id", X.drop_boilerplate_lines(F.col("text")).alias("cleaned"))


@query("with " + _boilerplate("documents") + BOILERPLATE_RESULT.format("documents"))
def boilerplate_removed(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", X.drop_boilerplate_lines(F.col("text")).alias("cleaned"))


@query(with_docs(f"""
select toc, table_line, page_number, count(*) as n from (
  select regexp_matches(line, '\\.{{3,}}\\s*\\d+\\s*$') or contains(lower(line), 'table of contents')
      or lower({py_strip('line')}) = 'contents'
      or (length(line) - length(replace(line, '.', '')) > 10 and regexp_matches(line, '\\d+\\s*$')) as toc,
    length(line) - length(replace(line, '|', '')) >= 3 or regexp_matches(line, '^[\\s\\-|:]+$') as table_line,
    regexp_matches(lower({py_strip('line')}), '^page\\s+\\d+') or regexp_matches({py_strip('line')}, '^\\d+(\\s+(of|/)\\s+\\d+)?$') as page_number
  from (select unnest(string_split(text, chr(10))) as line from policy_docs)) group by all"""))
def line_classes(spark, sf):
    lines = policy_docs(spark, sf).select(F.explode(X.lines(F.col("text"))).alias("line"))
    line = F.col("line")
    return lines.groupBy(
        X.is_toc_line(line).alias("toc"), X.is_table_line(line).alias("table_line"),
        X.is_page_number_line(line).alias("page_number")).agg(F.count("*").alias("n"))


@query(f"""
select doc_id, {py_strip(f"regexp_extract({py_strip('text')}, '^[^\\n-\\r\\x1c-\\x1e\\x85\\x{{2028}}\\x{{2029}}]*')")} as title
from documents""")
def document_title(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.extract_title(F.col("text")).alias("title"))


@query(with_docs("""
select doc_id,
  regexp_replace(regexp_extract(url, '[^/]*$'), '[^\\p{L}\\p{N}_\\-.]', '_', 'g') as file_name,
  payer_name || '/' || strftime(crawl_timestamp, '%Y-%m') || '/' ||
    regexp_replace(regexp_replace(regexp_extract(url, '[^/]*$'), '[^A-Za-z0-9._-]', '', 'g'), '\\.[^.]*$', '')
    || '_' || strftime(crawl_timestamp, '%Y%m%d_%H%M%S') || '.pdf' as blob,
  split_part(url, '/', 3) as domain,
  split_part(url, '/', 2) as second_part
from policy_docs"""))
def file_names(spark, sf):
    url = F.col("url")
    return policy_docs(spark, sf).select(
        "doc_id", X.sanitize_filename(url).alias("file_name"),
        X.blob_name(url, F.col("payer_name"), F.col("crawl_timestamp")).alias("blob"),
        X.source_domain(url).alias("domain"), X.payer_from_path(url).alias("second_part"))


CODES = [c for c in vocab.STATES if c not in vocab.TERRITORIES]


@query(with_docs("select doc_id, case " + " ".join(
    f"when contains(upper(url), '{c}_') or contains(upper(url), '/{c}/') then '{c}'" for c in CODES)
    + " end as state from policy_docs"))
def state_from_path(spark, sf):
    return policy_docs(spark, sf).select("doc_id", S.state_from_path(F.col("url")).alias("state"))
