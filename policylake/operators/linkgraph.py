"""Breadth-first traversal of a stored link graph, all companies in one job."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from policylake.functions import score as S
from policylake.operators.lifecycle import first_n_per_key
from policylake.operators.pages import domain_allowed
from policylake.session import checkpointed


def crawl(seeds: DataFrame, links: DataFrame, allowed: DataFrame, max_depth: int | None = None,
          max_pages: int | None = None, edition: str = "all") -> tuple[DataFrame, DataFrame]:
    """(visited, documents) reached from the seeds.

    ``seeds(company, url)``, ``links(src, position, text, href, url)`` and
    ``allowed(company, domains)``. A page is visited once per company, at its
    least depth. Links to documents are classified and reported with the page
    they were found on; other relevant links are followed below
    ``max_depth``, or as long as they lead to new pages.

    ``max_pages`` is a page budget per company in queue order: the order pages
    were found in, by finder and then by position on it. Without a budget the
    order only decides which finder is named, and the smallest address is.
    """
    relevant = S.link_relevant(F.col("text"), F.col("href"), edition)
    frontier = first_n_per_key(
        seeds.select("company", "url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_url"),
                     F.col("position") if "position" in seeds.columns else F.lit(0).alias("position")),
        ["company", "url"], [F.asc("position")], 1)
    if max_pages is not None:
        frontier = _queue(frontier, ["position", "url"], max_pages)
    visited = frontier = checkpointed(frontier)
    levels = []
    budgeted = max_pages is not None
    for depth in count():
        sources = frontier.select("company", F.col("url").alias("src"),
                                  *([F.col("queue").alias("parent_queue")] if budgeted else []))
        # A page is visited once, so each link is judged once per company; both uses below read the result.
        out = checkpointed(
            sources.join(links, "src").join(allowed, "company")
            .where(domain_allowed(F.col("url"), F.col("domains"))).drop("domains")
            .withColumn("is_pdf", S.is_pdf_url(F.col("url"))).where(F.col("is_pdf") | relevant)
            .withColumnRenamed("src", "parent_url"))
        levels.append(out.where("is_pdf").select(
            "company", F.lit(depth).alias("depth"), "parent_url", "position", "text", "href", "url"))
        if depth == max_depth:
            break
        found = out.where(~F.col("is_pdf")).join(visited.select("company", "url"), ["company", "url"], "left_anti")
        order = ["parent_queue", "position", "parent_url"] if budgeted else ["parent_url", "position"]
        following = found.groupBy("company", "url").agg(F.min(F.struct(*order)).alias("by")).select(
            "company", "url", F.lit(depth + 1).alias("depth"), F.col("by.parent_url").alias("parent_url"),
            F.col("by.position").alias("position"),
            *([F.col("by.parent_queue").alias("parent_queue")] if budgeted else []))
        if budgeted:
            following = _budget(following, visited, max_pages)
        frontier = checkpointed(following)
        if frontier.isEmpty():
            break
        visited = checkpointed(visited.unionByName(frontier))
    documents = levels[0]
    for level in levels[1:]:
        documents = documents.unionByName(level)
    kind = S.classify_link(F.col("text"), F.col("href"), F.col("url"), edition)
    targeted = documents.withColumn("classification", kind).where("classification.is_targeted").drop("href")
    return visited.select("company", "url", "depth", "parent_url"), targeted


def _queue(pages: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first pages per company, numbered in queue order; never more than the budget."""
    by_order = Window.partitionBy("company").orderBy(*order)
    return pages.withColumn("queue", F.row_number().over(by_order)).where(F.col("queue") <= limit)


def _budget(pages: DataFrame, visited: DataFrame, max_pages: int) -> DataFrame:
    ranked = _queue(pages, ["parent_queue", "position"], max_pages)
    used = visited.groupBy("company").agg(F.count("*").alias("used"))
    left = ranked.join(used, "company").where(F.col("queue") + F.col("used") <= max_pages)
    return left.withColumn("queue", F.col("queue") + F.col("used")).drop("used", "parent_queue")


def crawl_summary(documents: DataFrame, companies: DataFrame, rules: list[str]) -> DataFrame:
    """Documents per company and rule type, with a zero row for each type not found."""
    types = F.explode(F.array(*[F.lit(r) for r in rules]))
    wanted = companies.select("company").distinct().select("company", types.alias("primary_rule"))
    counted = documents.groupBy("company", F.col("classification.primary_rule").alias("primary_rule")).agg(
        F.count("*").alias("documents"))
    return wanted.join(counted, ["company", "primary_rule"], "left").fillna(0, ["documents"])
