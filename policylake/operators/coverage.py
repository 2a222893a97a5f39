"""Regional coverage by payer: found, expected, missing and what to try next."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policylake import vocab
from policylake.functions import regions as R
from policylake.functions.score import coverage_type


def document_regions(docs: DataFrame, url: str = "url", text: str = "text", case_sensitive: bool = False) -> DataFrame:
    """Add url, content and all regions, their number, the scope and the coverage type."""
    found = docs.withColumns({
        "url_regions": R.regions_from_url(F.col(url)),
        "content_regions": R.regions_from_content(F.col(text), case_sensitive),
    }).withColumn("all_regions", F.array_sort(F.array_union("url_regions", "content_regions")))
    return found.withColumns({
        "region_count": F.size("all_regions"),
        "scope": R.region_scope(F.size("all_regions")),
        "coverage_type": coverage_type(F.col(url), F.col(text)),
    })


def expected_regions(spark: SparkSession, profile: Mapping[str, Sequence[str]] = vocab.PAYER_COVERAGE) -> DataFrame:
    """(payer_name, region): the profile with its all-states mark spelled out."""
    rows = [(payer, list(vocab.STATES) if list(regions) == [vocab.ALL_STATES] else list(regions))
            for payer, regions in profile.items()]
    return spark.createDataFrame(rows, "payer_name string, regions array<string>").select(
        "payer_name", F.explode("regions").alias("region"))


def payer_regions(analysed: DataFrame) -> DataFrame:
    """(payer_name, region, documents)."""
    return analysed.select("payer_name", F.explode("all_regions").alias("region")).groupBy(
        "payer_name", "region").agg(F.count("*").alias("documents"))


def coverage_gaps(analysed: DataFrame, expected: DataFrame) -> DataFrame:
    """(payer_name, region) expected of a payer with documents, but not found."""
    present = analysed.select("payer_name").distinct()
    return expected.join(present, "payer_name", "left_semi").join(
        payer_regions(analysed).select("payer_name", "region"), ["payer_name", "region"], "left_anti")


def payer_coverage(analysed: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per payer: documents, covered and expected regions, completeness.

    Completeness counts every found region, so it may exceed 1;
    ``completeness_capped`` does not.
    """
    # One row per region, or one without a region: documents are counted on their first row.
    rows = analysed.select("payer_name", F.posexplode_outer("all_regions").alias("place", "region"))
    found = rows.groupBy("payer_name").agg(
        F.sum((F.coalesce("place", F.lit(0)) == 0).cast("long")).alias("total_documents"),
        F.array_sort(F.collect_set("region")).alias("covered_regions"))
    wanted = expected.groupBy("payer_name").agg(F.array_sort(F.collect_set("region")).alias("expected_regions"))
    none = F.array().cast("array<string>")
    joined = found.join(wanted, "payer_name", "left").withColumns({
        "expected_regions": F.coalesce("expected_regions", none),
    })
    ratio = F.coalesce(F.try_divide(F.size("covered_regions"), F.size("expected_regions")), F.lit(0.0))
    return joined.withColumns({
        "covered_region_count": F.size("covered_regions"),
        "coverage_gaps": F.array_except("expected_regions", "covered_regions"),
        "completeness": ratio,
        "completeness_capped": F.least(ratio, F.lit(1.0)),
    })


def distribution(analysed: DataFrame, column: str) -> DataFrame:
    """Documents per payer and value of a column (scope or coverage type)."""
    return analysed.groupBy("payer_name", column).agg(F.count("*").alias("documents"))


def overall_coverage(analysed: DataFrame) -> DataFrame:
    """One row: regions covered over all payers, share of the states, missing regions, grade."""
    found = payer_regions(analysed).agg(
        F.array_sort(F.collect_set("region")).alias("covered_regions"), F.sum("documents").alias("mentions"))
    score = F.size("covered_regions") / F.lit(vocab.STATE_COUNT)
    return found.select(
        F.size("covered_regions").alias("total_regions_covered"), score.alias("coverage_percentage"),
        F.array_sort(F.array_except(R.code_array(), "covered_regions")).alias("missing_regions"),
        R.coverage_grade(score).alias("grade"))


def discovery_strategy(coverage: DataFrame) -> DataFrame:
    """(payer_name, region, kind, entry): what to try for missing regions.

    Per region six URL patterns, four search terms and an action; three general
    actions where less than half of what is expected was found.
    """
    gap = coverage.select("payer_name", F.explode("coverage_gaps").alias("region")).withColumn(
        "name", R.state_name(F.col("region")))
    low, slug = F.lower("region"), F.replace(F.lower("name"), F.lit(" "), F.lit("-"))
    entries = [
        ("url_pattern", F.concat(F.lit("/"), "region", F.lit("_"))),
        ("url_pattern", F.concat(F.lit("/"), low, F.lit("/"))),
        ("url_pattern", F.concat(F.lit("/"), slug, F.lit("/"))),
        ("url_pattern", F.concat(F.lit("/"), "region", F.lit("_CAID"))),
        ("url_pattern", F.concat(F.lit("/state-"), low, F.lit("/"))),
        ("url_pattern", F.concat(F.lit("/regional/"), low, F.lit("/"))),
        ("search_term", F.concat("name", F.lit(" provider manual"))),
        ("search_term", F.concat("region", F.lit(" medicaid"))),
        ("search_term", F.concat("name", F.lit(" specific guidelines"))),
        ("search_term", F.concat("region", F.lit(" authorization requirements"))),
        ("action", F.concat(F.lit("Search for "), "name", F.lit(" ("), "region", F.lit(") specific content"))),
    ]
    regional = gap.select("payer_name", "region", F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), text.alias("entry")) for kind, text in entries])).alias("e"))
    general = coverage.where(F.col("completeness") < 0.5).select(
        "payer_name", F.lit(None).cast("string").alias("region"), F.explode(F.array(*[
            F.struct(F.lit("action").alias("kind"), F.lit(text).alias("entry")) for text in (
                "Increase BFS depth for regional discovery",
                "Check state-specific subdomains",
                "Search provider portal state selection pages")])).alias("e"))
    return regional.unionByName(general).select("payer_name", "region", "e.kind", "e.entry")
