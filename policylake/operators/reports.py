"""Counts, rates and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake import vocab
from policylake.functions import score as S
from policylake.operators.lifecycle import first_n_per_key


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def rules_summary(rules: DataFrame) -> DataFrame:
    """(dimension, value, n): totals by type, payer and document in one pass, and overall."""
    grouped = rules.groupingSets(
        [("rule_type",), ("payer",), ("document",), ()], "rule_type", "payer", "document"
    ).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    # Grouping bits: 1 where a column is rolled up, leftmost column first.
    dimension = (F.when(F.col("gid") == 0b011, "type").when(F.col("gid") == 0b101, "payer")
                 .when(F.col("gid") == 0b110, "document").otherwise("total"))
    return grouped.select(dimension.alias("dimension"), F.coalesce("rule_type", "payer", "document").alias("value"), "n")


def store_summary(rules: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: rules, distinct payers, documents and types."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return rules.agg(
        F.count("*").alias("total_rules"), distinct(F.col("payer")).alias("unique_payers"),
        distinct(F.col("document")).alias("unique_documents"), distinct(F.col("rule_type")).alias("unique_types"))


def summary_sketches(rules: DataFrame, *by: str, lg_k: int = vocab.SKETCH_LG_K) -> DataFrame:
    """Per batch ``by``: number of rules, and sketches of the distinct payers, documents and types, of a fixed size.

    Kept with each batch, so a total over all batches never reads the rules of earlier ones again.
    """
    return rules.groupBy(*by).agg(F.count("*").alias("rules"), *(
        F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(name)
        for c, name in (("payer", "payers"), ("document", "documents"), ("rule_type", "types"))))


def merged_summary(sketches: DataFrame) -> DataFrame:
    """One row as ``store_summary`` from the sketches of any batches; sketches over no value count as none."""
    def distinct(c: str) -> Column:
        return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).cast("long")
    return sketches.agg(
        F.coalesce(F.sum("rules"), F.lit(0)).alias("total_rules"), distinct("payers").alias("unique_payers"),
        distinct("documents").alias("unique_documents"), distinct("types").alias("unique_types"))


def payer_profile(rules: DataFrame) -> DataFrame:
    """(payer, rule_type, n, total_rules, documents) for all payers.

    Distinct documents are reduced to one row each before the payer totals, so a
    payer with most of the rules is not counted in one task.
    """
    per_document = rules.groupBy("payer", "rule_type", "document").agg(F.count("*").alias("n"))
    per_type = per_document.groupBy("payer", "rule_type").agg(F.sum("n").alias("n"))
    totals = per_document.groupBy("payer", "document").agg(F.sum("n").alias("n")).groupBy("payer").agg(
        F.sum("n").alias("total_rules"), F.count("document").alias("documents"))
    return per_type.join(totals, "payer")


def extraction_quality(rules: Column, text_length: Column) -> Column:
    """Score of one document's rules: number, mean confidence, variety; and text quality."""
    n = F.size(rules)
    mean = F.when(n > 0, F.aggregate(rules, F.lit(0.0), lambda t, r: t + r["confidence"]) / n).otherwise(F.lit(0.0))
    types = F.size(F.array_distinct(F.transform(rules, lambda r: r["rule_type"])))
    overall = (F.when(n > 0, F.least(n / F.lit(50.0), F.lit(0.4))).otherwise(F.lit(0.0))
               + F.least(mean, F.lit(0.3)) + F.least(types / F.lit(8.0), F.lit(0.3)))
    return F.struct(
        overall.alias("overall_score"), mean.alias("average_confidence"), types.alias("rule_types_found"),
        n.alias("total_rules"), F.when(text_length > 5000, "good").otherwise("low").alias("text_quality"))


def rules_by_type(rules: Column) -> Column:
    """Map of rule counts by type for one document."""
    names = F.transform(rules, lambda r: r["rule_type"])
    kinds = F.array_sort(F.array_distinct(names))
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(names, lambda n: n == k))))


# --- quality report ---------------------------------------------------------------

QUALITY_FLAGS = ("has_meaningful_title", "sufficient_content", "reasonable_pages", "no_exclusions")


def quality_summary(analysed: DataFrame) -> DataFrame:
    """One row: analysed, relevant and irrelevant documents with their share."""
    relevant = F.col("quality.is_relevant")
    share = F.round(F.try_divide(F.sum(relevant.cast("int")) * 100.0, F.count("*")), 1)
    return analysed.agg(
        F.count("*").alias("analysed"), F.sum(relevant.cast("int")).alias("relevant"),
        F.sum((~relevant).cast("int")).alias("irrelevant"), share.alias("relevant_percent"))


def quality_flag_counts(analysed: DataFrame, flags: Sequence[str] = QUALITY_FLAGS) -> DataFrame:
    """(metric, passed, total) per quality flag."""
    one = analysed.agg(F.count("*").alias("total"), *[
        F.sum(F.col(f"quality.{f}").cast("int")).alias(f) for f in flags])
    return one.unpivot(["total"], list(flags), "metric", "passed").select("metric", "passed", "total")


def category_counts(analysed: DataFrame) -> DataFrame:
    return analysed.groupBy(F.col("quality.primary_category").alias("primary_category")).agg(
        F.count("*").alias("n")).orderBy(F.desc("n"), "primary_category")


def top_relevant(analysed: DataFrame, id_col: str, k: int) -> DataFrame:
    """The most relevant documents."""
    return analysed.where("quality.is_relevant").select(
        id_col, "title", F.col("quality.primary_category").alias("primary_category"),
        F.col("quality.relevance_score").alias("relevance_score")
    ).orderBy(F.desc("relevance_score"), id_col).limit(k)


def duplicate_listing(members: DataFrame, id_col: str, groups: int | None = None,
                      shown: int | None = None) -> DataFrame:
    """Duplicate groups (or the first ``groups``) with their members (or the first ``shown``) and how many more there are."""
    listed = members
    if groups is not None:
        first = (members.select("content_hash", "group_size", "first_member").distinct()
                 .orderBy("first_member").limit(groups))
        listed = members.join(first.select("content_hash"), "content_hash", "left_semi")
    if shown is None:
        return listed.select("content_hash", "group_size", id_col, F.lit(0).alias("more"))
    listed = first_n_per_key(listed, ["content_hash"], [F.asc(id_col)], shown)
    return listed.select("content_hash", "group_size", id_col,
                         F.greatest(F.col("group_size") - shown, F.lit(0)).alias("more"))


def funnel_stats(decided: DataFrame) -> DataFrame:
    """(stage, reason, n) of a filtering funnel from its decision per input."""
    return decided.groupBy("stage", "reason").agg(F.count("*").alias("n"))


def batch_stats(statuses: DataFrame, status: str = "status", produced: str = "policies") -> DataFrame:
    """One row: inputs, successes, failures and what was produced."""
    ok = F.col(status) == "success"
    return statuses.agg(
        F.count("*").alias("total"), F.sum(ok.cast("int")).alias("successful"),
        F.sum((~ok).cast("int")).alias("failed"), F.sum(F.coalesce(F.col(produced), F.lit(0))).alias("total_policies"))


# --- indexes -----------------------------------------------------------------------

def policy_index(policies: DataFrame) -> DataFrame:
    return policies.select("policy_id", F.col("payer_name").alias("payer"), F.col("policy_type").alias("type"),
                           "effective_date", F.col("confidence_score").alias("confidence"))


def rules_index_totals(documents: DataFrame) -> DataFrame:
    """One row: indexed documents and their rules."""
    return documents.agg(F.count("*").alias("total_policies"), F.sum("rule_count").alias("total_rules"))


def normalise_rules(raw: DataFrame) -> DataFrame:
    """One schema for both shapes of exported rules."""
    def pick(*names: str, as_type: str = "string") -> Column:
        present = [F.col(n).cast(as_type) for n in names if n in raw.columns]
        return F.coalesce(*present) if present else F.lit(None).cast(as_type)
    return raw.select(
        pick("rule_id", as_type="bigint").alias("rule_id"), pick("rule_type").alias("rule_type"),
        pick("rule_title").alias("title"), pick("rule_content", "rule_text").alias("content"),
        pick("page_number", as_type="int").alias("page_number"),
        pick("confidence_score", as_type="decimal(5,4)").alias("confidence"),
        pick("payer_name", "payer").alias("payer"), pick("filename", "source_document").alias("document"),
        pick("effective_date", as_type="date").alias("effective_date"),
        pick("geographic_scope").alias("scope"))


def flag_struct(title: Column, text: Column, pages: Column) -> Column:
    """Quality of a document whose text is known in full."""
    return S.quality_flags(title, text, pages, F.length(text))
