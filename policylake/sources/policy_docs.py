"""Policy documents derived from the driver's order tables.

The prose tables hold none of the domain's words, so the policy operators are
exercised on documents composed from each order and its customer. The statement
is plain SQL that other engines run unchanged, which lets the oracle share it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from policylake import vocab

POLICY_DOCS_SQL = r"""
select o_orderkey as doc_id,
  c_mktsegment as payer_name,
  o_orderdate as crawl_timestamp,
  concat('https://providers.example.com/docs/',
    substring('STATE_CODES', cast(o_orderkey % 54 as int) * 2 + 1, 2),
    case cast(o_orderkey % 6 as int) when 0 then '_CAID_ProviderManual' when 1 then '_prior-auth-list' when 2 then '_marketing-brochure'
      when 3 then '_timely_filing_sample' when 4 then '_general' else '_appeals-claims-guide' end,
    '-', cast(o_orderkey as string), '.pdf') as url,
  concat(
    c_mktsegment, ' Provider Manual', chr(10),
    'Page ', cast(o_orderkey % 40 + 1 as string), ' of 40', chr(10),
    case when o_orderkey % 5 <> 0 then concat('Policy Number: PA-', cast(o_orderkey % 997 as string), chr(10)) else '' end,
    case cast(o_orderkey % 7 as int) when 0 then ''
      when 1 then concat('Effective: ', trim(substring('January   February  March     April     May       June      July      August    September October   November  December  ', cast(month(o_orderdate) as int) * 10 - 9, 10)), ' ', cast(day(o_orderdate) as string), ', ', cast(year(o_orderdate) as string), chr(10))
      else concat('Effective Date: ', lpad(cast(month(o_orderdate) as string), 2, '0'), '/', lpad(cast(day(o_orderdate) as string), 2, '0'), '/', cast(year(o_orderdate) as string), chr(10)) end,
    case when o_orderkey % 3 <> 0 then concat('End Date: ', cast(month(o_orderdate) as string), '-', cast(day(o_orderdate) as string), '-', cast(year(o_orderdate) + 2 as string), chr(10)) else '' end,
    case when o_orderkey % 11 = 0 then concat('This policy supersedes PA-', cast((o_orderkey + 1) % 997 as string), chr(10)) else '' end,
    case cast(o_orderkey % 4 as int)
      when 0 then concat('Prior authorization is required for all elective inpatient services and imaging.', chr(10))
      when 1 then concat('Claims must be submitted within ', cast(30 + o_orderkey % 150 as string), ' days of the date of service for timely filing.', chr(10))
      when 2 then concat('An appeal must be filed within ', cast(1 + o_orderkey % 12 as string), ' months of the denial notice by the provider.', chr(10))
      else concat('Provider enrollment and credentialing packets are reviewed by the network team.', chr(10)) end,
    '- Submit the request through the portal', chr(10),
    '- Attach medical records', chr(10),
    case when o_orderkey % 2 = 0 then concat('* Include the member identifier', chr(10), '- Keep a copy for audit', chr(10)) else '' end,
    case when o_orderkey % 9 = 0 then concat('| code | name | unit |', chr(10), '|---|---|---|', chr(10), 'row text following the table that is long enough', chr(10)) else '' end,
    'For internal reference: order priority ', o_orderpriority, ' status ', o_orderstatus, chr(10),
    'repeated footer line', chr(10), 'repeated footer line', chr(10), 'repeated footer line') as text
from orders join customer on o_custkey = c_custkey
""".replace("STATE_CODES", "".join(vocab.STATES))


#: Orders of one task, so that no task grows with the table, and pages of one task, which its Python holds at once.
ORDER_ROWS, PAGE_ROWS = 20_000, 500


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Spread a table read in fewer partitions than there are cores, or than it takes for ``rows`` of them each.

    A table of as many splits is left alone.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        parts = max(parts, math.ceil(df.count() / rows))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


TEXT_TABLES = {"documents": None, "pages": PAGE_ROWS, "conversations": None}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df


def policy_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, payer_name, crawl_timestamp, url, text), one row per order."""
    statement = POLICY_DOCS_SQL.replace("from orders join customer", "from {orders} join {customer}")
    # The narrow order rows are spread before the text is composed from them.
    return spark.sql(statement, orders=spread(table(spark, sf_dir, "orders"), ORDER_ROWS),
                     customer=table(spark, sf_dir, "customer"))
