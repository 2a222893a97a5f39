"""Versions, supersession, merges and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from policylake import vocab
from policylake.functions import text as X
from policylake.functions.score import state_from_path
from policylake.operators import lifecycle as L
from policylake.operators import merge as G
from policylake.operators import reports as RP
from policylake.registry.base import AS_OF, query, with_docs
from policylake.registry.extracts import POLICIES_SQL, policies, stored
from policylake.session import new_path
from policylake.sources import files as FL
from policylake.sources.policy_docs import policy_docs, table

CURRENT = f"""(case when effective_date is null then crawl_timestamp >= date '{AS_OF}' - interval 730 day
  else effective_date <= date '{AS_OF}' and coalesce(end_date >= date '{AS_OF}', true) end)"""
VERSIONS_SQL = POLICIES_SQL + f""",
versions as (select *, row_number() over (partition by policy_id order by effective_date desc nulls last, crawl_timestamp desc, source_pdf) as rn
  from policies where {CURRENT}),
current_rows as (select * from versions where rn = 1)"""
SHOWN = ("policy_id", "payer_name", "policy_type", "effective_date", "end_date", "source_pdf", "confidence_score")
SHOWN_SQL = "policy_id, payer_name, policy_type, effective_date::varchar as effective_date, end_date::varchar as end_date, source_pdf, confidence_score"


def shown(df):
    return df.select(*[F.col(c).cast("string").alias(c) if c.endswith("_date") else F.col(c) for c in SHOWN])


@query(with_docs(f"select {SHOWN_SQL} from current_rows", VERSIONS_SQL))
def current_versions(spark, sf):
    return shown(L.current_versions(policies(spark, sf), AS_OF))


@query(with_docs(f"select {SHOWN_SQL} from policies where policy_id not in (select policy_id from current_rows)", VERSIONS_SQL))
def expired_policies(spark, sf):
    return shown(L.expired_policies(stored(spark, sf), AS_OF))


@query(with_docs(f"""
select (select count(*) from policies) as total_policies_processed, count(*) as current_policies,
  (select count(*) from policies where policy_id not in (select policy_id from current_rows)) as archived_policies,
  sum((confidence_score < 0.7)::int) as low_confidence_policies, '{AS_OF}' as cleanup_date,
  (select string_agg(payer_name || '=' || n, ',' order by payer_name) from (select payer_name, count(*) as n from current_rows group by 1)) as policies_by_payer
from current_rows""", VERSIONS_SQL))
def cleanup_stats(spark, sf):
    stats = L.cleanup_stats(policies(spark, sf), AS_OF)
    entries = F.transform(F.array_sort(F.map_entries("policies_by_payer")),
                          lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return stats.withColumns({"policies_by_payer": F.array_join(entries, ","),
                              "cleanup_date": F.col("cleanup_date").cast("string")})


@query(with_docs("select policy_id, payer_name as payer, policy_type as type, effective_date::varchar as effective_date, confidence_score as confidence from current_rows", VERSIONS_SQL))
def policy_index(spark, sf):
    index = RP.policy_index(L.current_versions(policies(spark, sf), AS_OF))
    return index.withColumn("effective_date", F.col("effective_date").cast("string"))


# The day each customer's account was opened stands in for days of interest: month starts of the order dates.
DAYS_SQL = "days as (select distinct date_trunc('month', o_orderdate)::date as as_of from orders)"


@query(with_docs("""
select as_of::varchar as as_of, payer_name, count(*) as valid_rows, count(distinct policy_id) as valid_policies
from policies join days on effective_date <= as_of and (end_date is null or end_date >= as_of) group by all""", POLICIES_SQL, DAYS_SQL))
def policies_as_of(spark, sf):
    days = table(spark, sf, "orders").select(F.trunc("o_orderdate", "month").alias("as_of")).distinct()
    valid = L.policies_as_of(policies(spark, sf), days)
    return valid.groupBy(F.col("as_of").cast("string").alias("as_of"), "payer_name").agg(
        F.count("*").alias("valid_rows"), F.count_distinct("policy_id").alias("valid_policies"))


SPLIT = "1998-07-01"


@query(with_docs(f"""
select {SHOWN_SQL} from policies o where crawl_timestamp < date '{SPLIT}' and not exists (
  select 1 from policies n where n.crawl_timestamp >= date '{SPLIT}' and n.payer_name = o.payer_name and n.policy_type = o.policy_type
    and n.policy_id <> o.policy_id and (o.end_date < date '1997-06-01' or o.end_date < n.effective_date))""", POLICIES_SQL))
def replaced_policies_removed(spark, sf):
    rows = stored(spark, sf)
    before = F.col("crawl_timestamp") < F.lit(SPLIT).cast("date")
    return shown(L.remove_replaced(rows.where(before), rows.where(~before), "1997-06-01"))


@query(with_docs(f"""
select {SHOWN_SQL} from (select *, row_number() over (partition by payer_name, policy_id order by crawl_timestamp desc, source_pdf desc) as rn,
    max(coalesce(effective_date, date '0001-01-01')) over (partition by payer_name, policy_type order by crawl_timestamp, source_pdf
      rows between 1 following and unbounded following) as rival from policies)
where rn = 1 and not coalesce(rival is not null and (end_date < date '1997-06-01' or end_date < rival), false)""", POLICIES_SQL))
def arrivals_replayed(spark, sf):
    return shown(L.replay_arrivals(stored(spark, sf), "1997-06-01"))


EDGES_SQL = """
edges as (select distinct a.payer_name, a.policy_id, b.policy_id as superseded_id
  from (select distinct payer_name, policy_id, unnest(supersedes) as id from policies) a
  join (select distinct payer_name, policy_id, explicit_id from policies where explicit_id is not null) b
    on a.payer_name = b.payer_name and a.id = b.explicit_id and a.policy_id <> b.policy_id)"""


@query(with_docs("select * from edges", POLICIES_SQL, EDGES_SQL))
def supersession_edges(spark, sf):
    return L.supersession_edges(stored(spark, sf))


@query(with_docs(f"select {SHOWN_SQL} from policies where policy_id not in (select superseded_id from edges)", POLICIES_SQL, EDGES_SQL))
def superseded_dropped(spark, sf):
    return shown(L.drop_superseded(stored(spark, sf)))


@query(with_docs("""
select {0} from (select *, row_number() over (partition by policy_id order by crawl_timestamp desc, source_pdf desc) as rn from policies) where rn = 1""".format(SHOWN_SQL), POLICIES_SQL))
def last_write_per_policy(spark, sf):
    return shown(L.last_write_per_key(policies(spark, sf), ["policy_id"], "crawl_timestamp", "source_pdf"))


def _state_sql(name: str, condition: str) -> str:
    return f"""{name} as (select policy_id, arg_max(source_pdf, (crawl_timestamp, source_pdf)) as policy_hash
  from policies where {condition} group by 1)"""


@query(with_docs("""
select policy_id, case when o.policy_id is null then 'added' when n.policy_id is null then 'removed' else 'changed' end as change,
  o.policy_hash as old_hash, n.policy_hash as new_hash from old_state o full join new_state n using (policy_id)
where o.policy_hash is distinct from n.policy_hash""", POLICIES_SQL,
    _state_sql("old_state", "crawl_timestamp < date '2000-01-01'"), _state_sql("new_state", "crawl_timestamp >= date '1997-01-01'")))
def change_feed(spark, sf):
    rows = stored(spark, sf)

    def state(condition):
        return rows.where(condition).groupBy("policy_id").agg(
            F.max_by("source_pdf", F.struct("crawl_timestamp", "source_pdf")).alias("policy_hash"))
    at = F.col("crawl_timestamp")
    return L.change_feed(state(at < F.lit("2000-01-01").cast("date")), state(at >= F.lit("1997-01-01").cast("date")))


# --- document store -----------------------------------------------------------------------

STORE_SQL = """
files as (select doc_id, payer_name as provider, crawl_timestamp as uploaded_at, url, text,
    'doc-' || (doc_id % 4001) || '.pdf' as filename, round(strlen(text) / 1024.0, 2) as size from policy_docs),
providers as (select distinct ('0x' || substring(md5(payer_name), 1, 15))::bigint as id, payer_name as name from policy_docs)"""


def files(spark, sf):
    return policy_docs(spark, sf).select(
        "doc_id", F.col("payer_name").alias("provider"), F.col("crawl_timestamp").alias("uploaded_at"), "url", "text",
        F.concat(F.lit("doc-"), (F.col("doc_id") % 4001).cast("string"), F.lit(".pdf")).alias("filename"),
        F.round(F.octet_length("text") / 1024.0, 2).alias("size"))


@query(with_docs(f"""
select provider, filename,
  coalesce(min(url) filter (rn_old = 1), arg_min(url, (uploaded_at, doc_id)) filter (uploaded_at >= date '{SPLIT}')) as url,
  arg_max(size, (uploaded_at, doc_id))::double as size, max(uploaded_at)::varchar as uploaded_at
from (select *, case when uploaded_at < date '{SPLIT}' then row_number() over (partition by provider, filename, uploaded_at < date '{SPLIT}'
    order by uploaded_at desc, doc_id desc) end as rn_old from files)
group by 1, 2""", STORE_SQL))
def documents_upserted(spark, sf):
    rows = files(spark, sf)
    old = F.col("uploaded_at") < F.lit(SPLIT).cast("date")
    base = L.last_write_per_key(rows.where(old), ["provider", "filename"], "uploaded_at", "doc_id").select(
        "provider", "filename", "url", "size", "uploaded_at")
    merged = G.upsert_documents(base, rows.where(~old), ["provider", "filename"], ["size", "uploaded_at"],
                                ["uploaded_at", "doc_id"])
    return merged.select("provider", "filename", "url", F.col("size").cast("double").alias("size"),
                         F.date_format("uploaded_at", "yyyy-MM-dd HH:mm:ss").alias("uploaded_at"))


@query(with_docs("select * from providers", STORE_SQL))
def provider_ids(spark, sf):
    return G.providers_of(policy_docs(spark, sf))


LISTED_STATE_SQL = " ".join(f"when contains(upper(url), '{c}_') or contains(upper(url), '/{c}/') then '[{c}]'"
                            for c in vocab.STATES if c not in vocab.TERRITORIES)


@query(with_docs(f"""
select name, filename, size::double as file_size_mb, case {LISTED_STATE_SQL} else '[National]' end as scope, uploaded_at::varchar as uploaded_at
from files join providers on provider = name""", STORE_SQL))
def documents_with_provider(spark, sf):
    docs = files(spark, sf).select(
        G.surrogate_key(F.col("provider")).alias("provider_id"), "filename", F.col("size").alias("file_size_mb"),
        state_from_path(F.col("url")).alias("state_specific"), "uploaded_at")
    listed = G.list_documents_with_provider(docs, G.providers_of(policy_docs(spark, sf)))
    return listed.select("name", "filename", F.col("file_size_mb").cast("double").alias("file_size_mb"), "scope",
                         F.date_format("uploaded_at", "yyyy-MM-dd HH:mm:ss").alias("uploaded_at"))


@query(with_docs("""select doc_id, source_url, payer_name, content_hash, file_size, source_domain, note from (
select doc_id, url as source_url, case when doc_id % 3 = 0 then 'override' else payer_name end as payer_name, md5(text) as content_hash,
  strlen(text)::varchar as file_size, split_part(url, '/', 3) as source_domain, 'n' || (doc_id % 5) as note from policy_docs)"""))
def document_metadata(spark, sf):
    extra = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("payer_name"), F.lit("override"))).otherwise(
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    note = F.create_map(F.lit("note"), F.concat(F.lit("n"), (F.col("doc_id") % 5).cast("string")))
    meta = G.document_metadata(F.col("url"), F.col("payer_name"), F.col("crawl_timestamp"), F.col("text"), F.map_concat(extra, note))
    keys = ("source_url", "payer_name", "content_hash", "file_size", "source_domain", "note")
    return policy_docs(spark, sf).select("doc_id", meta.alias("m")).select(
        "doc_id", *[F.element_at("m", k).alias(k) for k in keys])


@query("""
with h as (select doc_id, source as payer_name, md5(text) as content_hash from documents)
select payer_name, content_hash, min(doc_id) as doc_id from h
where not exists (select 1 from h k join labels l on k.doc_id = l.doc_id where k.payer_name = h.payer_name and k.content_hash = h.content_hash)
group by 1, 2""")
def known_content_skipped(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("payer_name"), "text")
    stored = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select(
        "payer_name", F.md5("text").alias("content_hash"))
    return G.skip_known_content(docs, stored, ["doc_id"], content="text").select("payer_name", "content_hash", "doc_id")


@query("select md5(text) as content_hash, min(doc_id) as doc_id from documents group by 1")
def distinct_contents(spark, sf):
    return G.dedupe_bytes(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], "text").select("content_hash", "doc_id")


@query("select doc_id, md5(text) as content_hash from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def documents_deleted(spark, sf):
    gone = table(spark, sf, "labels").where("toxic = 1")
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("content_hash"))
    return G.delete_documents(docs, gone, "doc_id")


@query("select filename, md5(pdf_data) as content_hash from (select doc_id as id, 'doc-' || doc_id as filename, text as pdf_data from documents) where id = (select max(doc_id) from documents)")
def document_fetched(spark, sf):
    docs = table(spark, sf, "documents")
    last = docs.agg(F.max("doc_id")).first()[0]
    store = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("filename"),
                        F.col("text").alias("pdf_data"))
    return G.get_document(store, last).select("filename", F.md5("pdf_data").alias("content_hash"))


@query(with_docs("select payer_name, policy_type, count(*) as n from policies where payer_name in ('BUILDING', 'MACHINERY') group by all", POLICIES_SQL))
def selected_payers(spark, sf):
    return RP.count_by(G.select_payers(policies(spark, sf), ["BUILDING", "MACHINERY"]), "payer_name", "policy_type")


@query(with_docs("select policy_id, effective_date::varchar as effective_date from policies where payer_name = 'BUILDING' and policy_type = 'appeals'", POLICIES_SQL))
def rules_filtered(spark, sf):
    kept = G.filter_eq(policies(spark, sf), {"payer_name": "BUILDING", "policy_type": "appeals"})
    return kept.select("policy_id", F.col("effective_date").cast("string").alias("effective_date"))


@query(with_docs("select payer_name, count(*) as n, 0::bigint as matched from policies group by all", POLICIES_SQL))
def rules_filtered_unknown_column(spark, sf):
    rows = policies(spark, sf)
    matched = RP.count_by(G.filter_eq(rows, {"no_such_column": "x"}), "payer_name").withColumnRenamed("n", "matched")
    return RP.count_by(rows, "payer_name").join(matched, "payer_name", "left").select(
        "payer_name", "n", F.coalesce("matched", F.lit(0).cast("long")).alias("matched"))


@query("""
with recursive normal as (select doc_id, md5(regexp_replace(regexp_replace(trim(lower(text), chr(9) || chr(10) || ' '), '[\\t-\\r\\x1c-\\x1f\\x85\\p{Z}]+', ' ', 'g'),
  '[^\\p{L}\\p{N}_\\t-\\r\\x1c-\\x1f\\x85\\p{Z}]', '', 'g')) as content_hash from documents)
select content_hash, group_size, first_member, doc_id from (select *, count(*) over (partition by content_hash) as group_size,
  min(doc_id) over (partition by content_hash) as first_member from normal) where group_size > 1""")
def exact_duplicate_groups(spark, sf):
    from policylake.operators.similar import exact_duplicate_groups as groups
    return groups(table(spark, sf, "documents"), "doc_id", "text")


@query("""
with normal as (select doc_id, md5(regexp_replace(regexp_replace(trim(lower(text), chr(9) || chr(10) || ' '), '[\\t-\\r\\x1c-\\x1f\\x85\\p{Z}]+', ' ', 'g'),
  '[^\\p{L}\\p{N}_\\t-\\r\\x1c-\\x1f\\x85\\p{Z}]', '', 'g')) as content_hash from documents),
g as (select *, count(*) over (partition by content_hash) as group_size from normal)
select content_hash, group_size, doc_id, 0 as more from g where group_size > 1""")
def duplicate_listing(spark, sf):
    from policylake.operators.similar import exact_duplicate_groups as groups
    return RP.duplicate_listing(groups(table(spark, sf, "documents"), "doc_id", "text"), "doc_id")


@query(with_docs("select payer_name, regexp_extract(url, '[^/]*$') as name from policy_docs where payer_name = 'FURNITURE'"))
def documents_listed(spark, sf):
    path = new_path(spark, "documents")
    policy_docs(spark, sf).select("payer_name", X.basename(F.col("url")).alias("name"), F.octet_length("text").alias("size")) \
        .write.partitionBy("payer_name").parquet(path)
    return FL.list_documents(spark.read.parquet(path), "FURNITURE")
