"""Page parts, targets and the link graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from policylake import vocab
from policylake.functions import score as S
from policylake.operators import linkgraph as LG
from policylake.operators import pages as PG
from policylake.registry.base import any_contains, argmax_case, query, sum_contains, sum_counts
from policylake.registry.scores import FOLLOW
from policylake.sources import linkgraph as SRC
from policylake.sources.policy_docs import table

UNESCAPE = "replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
ANCHORS_SQL = f"""
anchors as (select page_id, page_url, position, {UNESCAPE.format("regexp_extract(a, 'href=\"([^\"]*)\"', 1)")} as href,
    trim({UNESCAPE.format("regexp_extract(a, '>([^<]*)</a>', 1)")}) as text
  from (select page_id, url as page_url, unnest(as_) as a, generate_subscripts(as_, 1) - 1 as position
    from (select page_id, url, regexp_extract_all(html, '<a [^>]*>[^<]*</a>') as as_ from pages)))"""


def parsed(spark, sf):
    return PG.parsed_pages(table(spark, sf, "pages"))


@query(f"""with {ANCHORS_SQL}
select page_id, position, text, href, regexp_extract(page_url, '^[a-z]+://[^/?#]*') || href as link_url,
  case when regexp_extract(regexp_extract(href, '^[^?#]*'), '[^/]*$') = '' then 'document_' || position || '.pdf'
    else regexp_extract(regexp_extract(href, '^[^?#]*'), '[^/]*$') end as filename from anchors where text <> ''""")
def page_links(spark, sf):
    return PG.page_links(parsed(spark, sf)).select("page_id", "position", "text", "href", "link_url", "filename")


@query(f"select page_id, {UNESCAPE.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} as title from pages")
def page_titles(spark, sf):
    return parsed(spark, sf).select("page_id", F.col("page.title").alias("title"))


@query(f"""with {ANCHORS_SQL}
select page_id, len(regexp_extract_all(html, '<p[ >]')) as paragraphs, len(regexp_extract_all(html, '<li[ >]')) as items,
  len(regexp_extract_all(html, '<h[1-4][ >]')) as sections, len(regexp_extract_all(html, '<a ')) as links from pages""")
def page_part_counts(spark, sf):
    return parsed(spark, sf).select(
        "page_id", *[F.size(f"page.{p}").cast("long").alias(p) for p in ("paragraphs", "items", "sections", "links")])


HEADER_SQL = UNESCAPE.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")


@query(f"""
select page_id, header, rank, score::int as header_score from (
  select page_id, trim({HEADER_SQL}) as header, 0 as rank, {sum_counts(f'lower({HEADER_SQL})', {'the': 3, 'de': 1})} as score from pages)""")
def page_sections(spark, sf):
    def score(text):
        return S.occurrence_score(F.lower(text), {"the": 3, "de": 1})
    rows = PG.page_sections(parsed(spark, sf), score)
    return rows.select("page_id", "header", "rank", score(F.col("header")).alias("header_score"))


TARGETS = {"english": ("the", "and", "that"), "french": ("des", "que"), "german": ("sch", "nicht")}
LINK_TERMS = ("th", "de", "ch")
HIT_SQL = " union all ".join(
    f"select page_id, '{n}' as section_type, 'link' as kind, position, text as label from anchors where text <> '' and "
    f"({any_contains('lower(text)', LINK_TERMS)} or {any_contains('lower(href)', LINK_TERMS)}) and {any_contains('lower(text)', t)}"
    for n, t in TARGETS.items())


@query(f"with {ANCHORS_SQL} {HIT_SQL}")
def target_links(spark, sf):
    found = PG.target_sections(parsed(spark, sf), TARGETS, LINK_TERMS)
    return found.where("kind = 'link'").select("page_id", "section_type", "kind", "position", "label")


@query()
def target_sections(spark, sf):
    return PG.target_sections(parsed(spark, sf), TARGETS, LINK_TERMS)


@query(f"""with {ANCHORS_SQL} select page_id, position, text, href from (select page_id, position, text, href || case when position % 2 = 0 then '.PDF' else '' end as href
  from anchors) where regexp_matches(lower(href), '\\.(pdf|doc|docx|xls|xlsx)')""")
def downloads_listed(spark, sf):
    """Every other link is taken to lead to a file."""
    pages = parsed(spark, sf)
    named = F.transform("page.links", lambda x, i: x.withField("href", F.concat(
        x["href"], F.when(i % 2 == 0, ".PDF").otherwise(""))))
    found = PG.page_downloads(pages.withColumn("page", F.col("page").withField("links", named)))
    return found.select("page_id", "position", "text", "href")


# The stored pages do not link to each other, so each link is taken to lead to the page of the same position.
@query()
def detailed_page_rules(spark, sf):
    pages = parsed(spark, sf)
    found = PG.target_sections(pages, TARGETS, LINK_TERMS)
    numbered = pages.select("page_id", F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("url"), "page")
    links = PG.page_links(pages).withColumn("link_url", F.concat(F.lit("page:"), F.col("position").cast("string")))
    rules = PG.detailed_pages(found, links, numbered, indicators=TARGETS)
    return rules.select("page_id", "target_page_id", "section_type", "type", "content", "source")


@query("""
select page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host,
  contains(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), 'example.com') or contains(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), 'blog') as allowed,
  regexp_matches(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '(^|\\.)example\\.com$') as allowed_strictly from pages""")
def domains_allowed(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", PG.host(url).alias("host"),
        PG.domain_allowed(url, F.array(F.lit("example.com"), F.lit("blog"))).alias("allowed"),
        PG.domain_allowed(url, F.array(F.lit("example.com")), strict_suffix=True).alias("allowed_strictly"))


# --- link graph ---------------------------------------------------------------------------

HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
GRAPH_SQL = f"""
with recursive links as materialized (select *, contains(lower(url), '.pdf') as is_pdf,
    {any_contains("lower(text || ' ' || href)", FOLLOW)} as follow from ({SRC.LINKS_SQL})),
seeds as ({SRC.SEEDS_SQL}), allowed as ({SRC.ALLOWED_SQL}),
reach as (select company, url, 0 as depth from seeds
  union select r.company, l.url, r.depth + 1 from reach r join links l on l.src = r.url join allowed a on a.company = r.company
  where r.depth < 3 and not l.is_pdf and l.follow and contains(regexp_extract(l.url, '^[a-z]+://([^/?#]*)', 1), a.domain)),
visited as (select company, url, min(depth) as depth from reach group by all)"""
RULE_COLUMNS = ", ".join(f"2 * {sum_contains('joined', k)} + {sum_contains('joined', p)} as {n}" for n, (k, p) in vocab.LINK_RULES.items())
RULE_SCORES = [(n, "billing" if n == vocab.LINK_BASELINE_RULE else n) for n in vocab.LINK_RULES]
FOUND_SQL = f""",
classified as (select company, depth, parent_url, url, position, {argmax_case(RULE_SCORES, 'null')} as primary_rule from (
  select *, case when greatest({', '.join(vocab.LINK_RULES)}) = 0 and {any_contains('joined', vocab.LINK_BASELINE_TERMS)} then 2 else {vocab.LINK_BASELINE_RULE} end as billing
  from (select *, {any_contains('joined', vocab.LINK_EXCLUDED_TERMS)} as excluded, {RULE_COLUMNS} from (
    select v.company, v.depth, v.url as parent_url, l.url, l.position, lower(l.text || ' ' || l.href || ' ' || l.url) as joined
    from visited v join links l on l.src = v.url join allowed a on a.company = v.company
    where l.is_pdf and contains(regexp_extract(l.url, '^[a-z]+://([^/?#]*)', 1), a.domain))))
  where not excluded and greatest({', '.join(c for _, c in RULE_SCORES)}) >= 2)"""


def crawled(spark, sf, **options):
    return LG.crawl(SRC.seeds(spark, sf), SRC.links(spark, sf), SRC.allowed_domains(spark, sf), max_depth=3, **options)


@query(GRAPH_SQL + """
select v.company, v.url, v.depth, (select min(l.src) from links l join visited p on p.url = l.src and p.company = v.company
  where l.url = v.url and l.follow and p.depth = v.depth - 1 and v.depth > 0) as parent_url from visited v""")
def crawl_visits(spark, sf):
    return crawled(spark, sf)[0]


@query(GRAPH_SQL + FOUND_SQL + " select company, depth, parent_url, url, primary_rule from classified")
def crawl_documents(spark, sf):
    found = crawled(spark, sf)[1]
    return found.select("company", "depth", "parent_url", "url", F.col("classification.primary_rule").alias("primary_rule"))


@query(GRAPH_SQL + FOUND_SQL + f""",
wanted as (select company, unnest([{', '.join(f"'{r}'" for r in [*vocab.LINK_RULES, 'unseen'])}]) as primary_rule from seeds)
select w.company, w.primary_rule, count(c.url) as documents from wanted w left join classified c using (company, primary_rule) group by all""")
def crawl_summary(spark, sf):
    found = crawled(spark, sf)[1]
    return LG.crawl_summary(found, SRC.seeds(spark, sf), [*vocab.LINK_RULES, "unseen"])


@query()
def crawl_within_budget(spark, sf):
    return crawled(spark, sf, max_pages=25)[0]
