"""Files, exports and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policylake import vocab
from policylake.functions.text import basename, nullif_empty
from policylake.operators.reports import normalise_rules

PDF_GLOB = "*.[pP][dD][fF]"
PAYERS_SCHEMA = ("company_name string, ticker_symbol string, base_domain string, known_provider_portal string, "
                 "market_share decimal(4,1), priority string")
RULE_FIELDS = ("rule_id bigint, rule_type string, rule_title string, rule_content string, page_number int, "
               "confidence_score string, payer_name string, filename string, geographic_scope string, "
               "rule_text string, payer string, source_document string, effective_date string")


def scan_binary(spark: SparkSession, path: str, glob: str = PDF_GLOB) -> DataFrame:
    """Files below a folder with their bytes. The whole path is the key, so equal names do not collide."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)


def scan_file_inventory(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, name, directory, size_mb) without reading the bytes; hidden and tool folders are left out."""
    skipped = "|".join(vocab.SKIPPED_DIRS)
    found = scan_binary(spark, path, glob).select("path", "length").where(
        ~F.col("path").rlike(rf"/(?:\.[^/]*|{skipped})/"))
    return found.select(
        "path", basename(F.col("path")).alias("name"), F.regexp_replace("path", r"/[^/]*$", "").alias("directory"),
        F.bround(F.col("length") / F.lit(1024.0 * 1024.0), 2).alias("size_mb"))


def scan_rules_export(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """Rules of an exported envelope, normalised; the list may be called either name."""
    def read(where: str) -> DataFrame:
        schema = f"healthcare_rules array<struct<{_struct(RULE_FIELDS)}>>, rules array<struct<{_struct(RULE_FIELDS)}>>"
        return spark.read.schema(schema).option("multiLine", "true").json(where)
    if fallback is not None and not exists(spark, path):
        path = fallback
    return normalise_rules(read(path).select(F.inline(F.coalesce("healthcare_rules", "rules"))))


def _struct(fields: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (f.strip().split(" ") for f in fields.split(",")))


def scan_json_dir(spark: SparkSession, path: str) -> DataFrame:
    """(sample_text, metadata) of the JSON documents in a folder; those without text are left out."""
    schema = ("sample_text string, rule_count bigint, "
              "metadata struct<filename: string, payer: string, file_size: bigint, extraction_date: string>")
    docs = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    return docs.where(nullif_empty(F.col("sample_text")).isNotNull())


def scan_policies(spark: SparkSession, path: str, payer: str | None = None, schema: str | None = None) -> DataFrame:
    """Stored policy JSON partitioned by payer.

    The whole store must be readable; one payer's part (only its folder is read)
    leaves out what cannot be parsed.
    """
    reader = spark.read.option("mode", "FAILFAST" if payer is None else "DROPMALFORMED")
    if schema:
        reader = reader.schema(schema)
    df = reader.json(path)
    return df if payer is None else df.where(F.col("payer_name") == payer)


def scan_payers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAYERS_SCHEMA).option("header", "true").csv(path)


def list_documents(docs: DataFrame, payer: str | None = None) -> DataFrame:
    """Names of stored documents, of one payer if asked; prunes where the table is partitioned by payer."""
    named = docs if payer is None else docs.where(F.col("payer_name") == payer)
    return named.select("payer_name", "name")


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
