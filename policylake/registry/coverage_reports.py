"""Regions, coverage and summary reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from policylake import vocab
from policylake.operators import coverage as CV
from policylake.operators import reports as RP
from policylake.registry.base import q, query, with_docs
from policylake.registry.extracts import KEPT_SQL, document_rules
from policylake.registry.scores import QUALITY_SQL, analysed_docs
from policylake.session import written
from policylake.sources.policy_docs import policy_docs, table

STATES_SQL = "states(code, name) as (values " + ", ".join(f"({q(c)}, {q(n)})" for c, n in vocab.STATES.items()) + ")"
EDGE = r"[^\p{L}\p{N}_]"


def regions_sql(source: str) -> str:
    url_found = " || ".join(f"regexp_extract_all(url, {q(p)}, 1)" for p in vocab.REGION_URL_PATTERNS)
    text_found = " || ".join(f"regexp_extract_all(text, {q('(?i)' + p)}, 1)" for p, _ in vocab.REGION_TEXT_PATTERNS)
    return STATES_SQL + f""",
seen as (select *, [upper(x) for x in {url_found}] as url_codes, [upper(x) for x in {text_found}] as text_codes,
    replace(replace(upper(url), '-', ''), '_', '') as squeezed, lower(text) as low,
    list_distinct(string_split_regex(lower(text), '{EDGE}+')) as words from {source}),
found as (select doc_id, payer_name, code,
    list_contains(url_codes, code) or contains(squeezed, upper(replace(name, ' ', ''))) as in_url,
    list_contains(words, lower(code)) or contains(low, lower(name)) or list_contains(text_codes, code) as in_text
  from seen cross join states),
regions as (select doc_id, payer_name, coalesce(string_agg(code, ',' order by code) filter (in_url), '') as url_regions,
    coalesce(string_agg(code, ',' order by code) filter (in_text), '') as content_regions,
    count(*) filter (in_url or in_text) as region_count,
    case when count(*) filter (in_url or in_text) = 0 then 'National/Unspecified' when count(*) filter (in_url or in_text) = 1 then 'State-Specific'
      when count(*) filter (in_url or in_text) <= 5 then 'Multi-State' else 'National' end as scope from found group by all),
payer_regions as (select payer_name, code as region, count(*) as documents from found where in_url or in_text group by all)"""


@query(with_docs("select doc_id, url_regions, content_regions, region_count, scope from regions", regions_sql("policy_docs")))
def document_regions(spark, sf):
    found = CV.document_regions(policy_docs(spark, sf))
    return found.select("doc_id", F.array_join("url_regions", ",").alias("url_regions"),
                        F.array_join("content_regions", ",").alias("content_regions"),
                        F.col("region_count").cast("long").alias("region_count"), "scope")


PROSE_SQL = """prose as (select doc_id, source as payer_name, 'https://www.example.com/' || lang || '/' || source || '.html' as url, text from documents)"""
PROFILE = {"src0": (vocab.ALL_STATES,), "src1": vocab.PAYER_COVERAGE["Anthem/Elevance Health"],
           "src2": vocab.PAYER_COVERAGE["Kaiser Permanente"], "src3": vocab.PAYER_COVERAGE["Centene Corporation"],
           "src4": ("LA", "DE", "IN"), "absent": ("CA",)}
EXPECTED_SQL = "expected(payer_name, region) as (values " + ", ".join(
    f"({q(p)}, {q(r)})" for p, rs in PROFILE.items() for r in (vocab.STATES if rs == (vocab.ALL_STATES,) else rs)) + ")"


def prose_regions(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("payer_name"), "text",
        F.concat(F.lit("https://www.example.com/"), "lang", F.lit("/"), "source", F.lit(".html")).alias("url"))
    return CV.document_regions(docs)


PROSE = (PROSE_SQL, regions_sql("prose"), EXPECTED_SQL)


@query("with " + ",\n".join(PROSE) + "\nselect payer_name, scope, count(*) as documents from regions group by all")
def scope_distribution(spark, sf):
    return CV.distribution(prose_regions(spark, sf), "scope")


@query("with " + ",\n".join(PROSE) + "\nselect * from payer_regions")
def regions_by_payer(spark, sf):
    return CV.payer_regions(prose_regions(spark, sf))


@query("with " + ",\n".join(PROSE) + """
select e.payer_name, e.region from expected e where payer_name in (select payer_name from prose)
and not exists (select 1 from payer_regions p where p.payer_name = e.payer_name and p.region = e.region)""")
def coverage_gaps(spark, sf):
    return CV.coverage_gaps(prose_regions(spark, sf), CV.expected_regions(spark, PROFILE))


COVERAGE_SQL = """
coverage as (select t.payer_name, total_documents, coalesce(covered, 0) as covered_region_count, coalesce(gaps, 0) as gap_count,
  coalesce(covered / wanted, 0)::double as ratio
  from (select payer_name, count(*) as total_documents from prose group by 1) t
  left join (select payer_name, count(*) as covered from payer_regions group by 1) using (payer_name)
  left join (select payer_name, count(*) as wanted from expected group by 1) using (payer_name)
  left join (select payer_name, count(*) as gaps from expected e where not exists (select 1 from payer_regions p
    where p.payer_name = e.payer_name and p.region = e.region) group by 1) using (payer_name))"""


@query("with " + ",\n".join((*PROSE, COVERAGE_SQL)) + """
select payer_name, total_documents, covered_region_count, gap_count, round(ratio, 6) as completeness, round(least(ratio, 1), 6) as completeness_capped from coverage""")
def payer_coverage(spark, sf):
    rows = CV.payer_coverage(prose_regions(spark, sf), CV.expected_regions(spark, PROFILE))
    return rows.select("payer_name", "total_documents", F.col("covered_region_count").cast("long").alias("covered_region_count"),
                       F.size("coverage_gaps").cast("long").alias("gap_count"), F.round("completeness", 6).alias("completeness"),
                       F.round("completeness_capped", 6).alias("completeness_capped"))


@query("with " + ",\n".join(PROSE) + """
select n as total_regions_covered, round(n / 50, 6)::double as coverage_percentage,
  (select string_agg(code, ',' order by code) from states where code not in (select region from payer_regions)) as missing_regions,
  case when n / 50 >= 0.8 then 'Excellent' when n / 50 >= 0.6 then 'Good' when n / 50 >= 0.4 then 'Fair' else 'Poor' end as grade
from (select count(distinct region) as n from payer_regions)""")
def overall_coverage(spark, sf):
    row = CV.overall_coverage(prose_regions(spark, sf))
    return row.select(F.col("total_regions_covered").cast("long").alias("total_regions_covered"),
                      F.round("coverage_percentage", 6).alias("coverage_percentage"),
                      F.array_join("missing_regions", ",").alias("missing_regions"), "grade")


@query("with " + ",\n".join((*PROSE, COVERAGE_SQL)) + """,
gap as (select e.payer_name, e.region, s.name, lower(e.region) as low, replace(lower(s.name), ' ', '-') as slug
  from expected e join states s on e.region = s.code where e.payer_name in (select payer_name from prose)
  and not exists (select 1 from payer_regions p where p.payer_name = e.payer_name and p.region = e.region))
select payer_name, region, unnest(['url_pattern', 'url_pattern', 'url_pattern', 'url_pattern', 'url_pattern', 'url_pattern',
    'search_term', 'search_term', 'search_term', 'search_term', 'action']) as kind,
  unnest(['/' || region || '_', '/' || low || '/', '/' || slug || '/', '/' || region || '_CAID', '/state-' || low || '/', '/regional/' || low || '/',
    name || ' provider manual', region || ' medicaid', name || ' specific guidelines', region || ' authorization requirements',
    'Search for ' || name || ' (' || region || ') specific content']) as entry from gap
union all
select payer_name, null, 'action', unnest(['Increase BFS depth for regional discovery', 'Check state-specific subdomains',
  'Search provider portal state selection pages']) from coverage where ratio < 0.5""")
def discovery_strategy(spark, sf):
    return CV.discovery_strategy(CV.payer_coverage(prose_regions(spark, sf), CV.expected_regions(spark, PROFILE)))


# --- rule stores ---------------------------------------------------------------------------

RULES_SQL = KEPT_SQL + """,
rules as (select k.doc_id, k.rule_type, k.requirement, p.payer_name as payer, 'manual-' || (k.doc_id % 500) || '.pdf' as document
  from kept k join policy_docs p using (doc_id))"""


def rule_store(spark, sf):
    """Extracted rules with payer and document."""
    return document_rules(spark, sf).select("doc_id", F.col("payer_name").alias("payer"), F.inline("rules")).withColumn(
        "document", F.concat(F.lit("manual-"), (F.col("doc_id") % 500).cast("string"), F.lit(".pdf")))


@query(with_docs("""
select case when grouping(rule_type) = 0 then 'type' when grouping(payer) = 0 then 'payer' when grouping(document) = 0 then 'document' else 'total' end as dimension,
  coalesce(rule_type, payer, document) as value, count(*) as n from rules group by grouping sets ((rule_type), (payer), (document), ())""", RULES_SQL))
def rules_summary(spark, sf):
    return RP.rules_summary(rule_store(spark, sf))


@query(with_docs("select count(*) as total_rules, count(distinct payer) as unique_payers, count(distinct document) as unique_documents, count(distinct rule_type) as unique_types from rules", RULES_SQL))
def store_summary(spark, sf):
    return RP.store_summary(rule_store(spark, sf))


@query()
def store_summary_approximate(spark, sf):
    return RP.store_summary(rule_store(spark, sf), approximate=True)


@query(with_docs("""
select total_rules, unique_payers, unique_types, true as documents_within_bound from (select count(*) as total_rules,
  count(distinct payer) as unique_payers, count(distinct rule_type) as unique_types from rules)""", RULES_SQL))
def store_summary_merged(spark, sf):
    """Sketches of each type's rules merged; few values are counted exactly, documents within four standard errors."""
    # Both aggregates read the rules, which are costly to extract.
    rules = written(rule_store(spark, sf).select("rule_type", "payer", "document"), "rules")
    merged = RP.merged_summary(RP.summary_sketches(rules, "rule_type"))
    exact = rules.agg(F.count_distinct("document")).scalar()
    off = F.abs(F.col("unique_documents") - exact) <= exact * (4 * 1.04 / 2 ** (vocab.SKETCH_LG_K / 2))
    return merged.select("total_rules", "unique_payers", "unique_types", off.alias("documents_within_bound"))


@query(with_docs("""
select payer, rule_type, n, total_rules, documents from (select payer, rule_type, count(*) as n from rules group by all)
join (select payer, count(*) as total_rules, count(distinct document) as documents from rules group by 1) using (payer)""", RULES_SQL))
def payer_profiles(spark, sf):
    return RP.payer_profile(rule_store(spark, sf))


@query(with_docs("select rule_type, payer, count(*) as n from rules group by all", RULES_SQL))
def rules_by_type_and_payer(spark, sf):
    return RP.count_by(rule_store(spark, sf), "rule_type", "payer")


@query(with_docs("select distinct payer_name from policy_docs"))
def distinct_payers(spark, sf):
    return RP.distinct_values(policy_docs(spark, sf), "payer_name")


# Half the documents in each exported shape.

@query(with_docs(f"""
select case when doc_id % 2 = 0 then doc_id end as rule_id, policy_kind as rule_type, case when doc_id % 2 = 0 then 'T' || doc_id end as title,
  text as content, case when doc_id % 2 = 0 then (doc_id % 40)::int end as page_number,
  case when doc_id % 2 = 0 then 0.8::double end as confidence, payer_name as payer, 'f' || doc_id || '.pdf' as document,
  case when doc_id % 2 <> 0 then '2024-01-01' end as effective_date
from (select *, case when doc_id % 3 = 0 then 'appeals' else 'claims' end as policy_kind from policy_docs)"""))
def rules_normalised(spark, sf):
    docs = policy_docs(spark, sf)
    kind = F.when(F.col("doc_id") % 3 == 0, "appeals").otherwise("claims").alias("rule_type")
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    body = F.col("text")
    a = docs.where("doc_id % 2 = 0").select(
        F.col("doc_id").alias("rule_id"), kind, F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("rule_title"),
        body.alias("rule_content"), (F.col("doc_id") % 40).alias("page_number"), F.lit("0.8000").alias("confidence_score"),
        "payer_name", name.alias("filename"))
    b = docs.where("doc_id % 2 <> 0").select(
        kind, body.alias("rule_text"), F.col("payer_name").alias("payer"), name.alias("source_document"),
        F.lit("2024-01-01").alias("effective_date"))
    return RP.normalise_rules(a.unionByName(b, allowMissingColumns=True)).drop("scope").withColumns({
        "effective_date": F.col("effective_date").cast("string"), "confidence": F.col("confidence").cast("double")})


@query(with_docs("""
select stage, reason, count(*) as n from (select case when is_relevant then 'accepted' else 'rejected' end as stage, primary_category as reason from quality) group by all""", QUALITY_SQL))
def decisions_counted(spark, sf):
    rows = analysed_docs(spark, sf).select(
        F.when(F.col("quality.is_relevant"), "accepted").otherwise("rejected").alias("stage"),
        F.col("quality.primary_category").alias("reason"))
    return RP.funnel_stats(rows)


@query(with_docs("""
select count(*) as total, count(*) filter (n > 0) as successful, count(*) filter (n = 0) as failed, sum(n) as total_policies
from (select p.doc_id, count(k.doc_id) as n from policy_docs p left join kept k using (doc_id) group by 1)""", KEPT_SQL))
def batch_stats(spark, sf):
    docs = document_rules(spark, sf).select(F.size("rules").alias("policies"))
    return RP.batch_stats(docs.withColumn("status", F.when(F.col("policies") > 0, "success").otherwise("failed")))


@query(with_docs("""
select count(*) as total_policies, sum(n) as total_rules from (select doc_id, count(*) as n from kept group by 1)""", KEPT_SQL))
def rules_index_totals(spark, sf):
    docs = document_rules(spark, sf).select(F.size("rules").alias("rule_count")).where("rule_count > 0")
    return RP.rules_index_totals(docs)


@query(with_docs("""
select doc_id, string_agg(rule_type || '=' || n, ',' order by rule_type) as rules_by_type from (select doc_id, rule_type, count(*) as n from kept group by all) group by 1""", KEPT_SQL))
def rules_by_type_per_document(spark, sf):
    docs = document_rules(spark, sf).where(F.size("rules") > 0).select("doc_id", RP.rules_by_type(F.col("rules")).alias("m"))
    pairs = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return docs.select("doc_id", F.array_join(F.array_sort(pairs), ",").alias("rules_by_type"))
