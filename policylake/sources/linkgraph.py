"""A stored portal link graph derived from customers, nations and orders.

Per market segment: a portal page, a hub per nation, a page per customer and a
document per order, with cycles, links off the site and irrelevant links. The
statements run unchanged in other engines, which lets the oracle share them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from policylake.sources.policy_docs import spread, table

SEEDS_SQL = """
select distinct c_mktsegment as company, concat('https://portal.', lower(c_mktsegment), '.example.com/provider-manual') as url from customer"""
ALLOWED_SQL = "select distinct c_mktsegment as company, concat(lower(c_mktsegment), '.example.com') as domain from customer"
CUSTOMER_PAGE = "concat('https://portal.', lower(c_mktsegment), '.example.com/provider/', cast({0} as string))"
HUB_PAGE = "concat('https://portal.', lower(c_mktsegment), '.example.com/policies/', cast(c_nationkey as string))"
LINKS_SQL = f"""
select distinct concat('https://portal.', lower(c_mktsegment), '.example.com/provider-manual') as src, cast(c_nationkey as bigint) as position,
  'Policy bulletins' as text, concat('/policies/', cast(c_nationkey as string)) as href, {HUB_PAGE} as url from customer
union all
select {HUB_PAGE}, c_custkey, case when c_custkey % 7 = 0 then 'Contact us' else 'Provider guide' end,
  concat('../', cast(c_custkey as string)), case when c_custkey % 11 = 0 then concat('https://elsewhere.example.org/provider/', cast(c_custkey as string))
    else {CUSTOMER_PAGE.format('c_custkey')} end from customer
union all
select {CUSTOMER_PAGE.format('c_custkey')}, 0, 'Back to policy hub', '..', {HUB_PAGE} from customer
union all
select {CUSTOMER_PAGE.format('c_custkey')}, 1, 'Related guide', cast(c_custkey + 1 as string), {CUSTOMER_PAGE.format('c_custkey + 1')} from customer
union all
select {CUSTOMER_PAGE.format('c_custkey')}, o_orderkey + 2,
  case cast(o_orderkey % 5 as int) when 0 then 'Billing guidelines' when 1 then 'Appeal rights' when 2 then 'Dental vision plan'
    when 3 then 'Handbook' else 'Notes' end,
  concat('doc-', cast(o_orderkey as string), '.pdf'),
  concat('https://files.', lower(c_mktsegment), '.example.com/', case cast(o_orderkey % 3 as int) when 0 then 'timely-filing-' when 1 then 'prior-' else 'x-' end,
    cast(o_orderkey as string), '.pdf')
from customer join orders on c_custkey = o_custkey
"""


def _run(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    for name in ("customer", "orders"):
        statement = statement.replace(f"from {name}", f"from {{{name}}}").replace(f"join {name}", f"join {{{name}}}")
    return spark.sql(statement, customer=table(spark, sf_dir, "customer"), orders=spread(table(spark, sf_dir, "orders")))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(company, url)"""
    return _run(spark, sf_dir, SEEDS_SQL)


def allowed_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(company, domains)"""
    return _run(spark, sf_dir, f"select company, array(domain) as domains from ({ALLOWED_SQL})")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, position, text, href, url)"""
    return _run(spark, sf_dir, LINKS_SQL)
