"""Upserts, deletes, lookups and incremental ingest over document tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.functions.text import source_domain


def surrogate_key(name: Column) -> Column:
    """Stable 60-bit id of a unique name; needs no coordination between writers."""
    return F.conv(F.left(F.md5(name), F.lit(15)), 16, 10).cast("bigint")


def document_metadata(url: Column, payer: Column, fetched_at: Column, content: Column,
                      extra: Column | None = None) -> Column:
    """Metadata map of a fetched document; caller entries win."""
    base = F.create_map(
        F.lit("source_url"), url, F.lit("payer_name"), payer,
        F.lit("upload_date"), fetched_at.cast("string"), F.lit("content_hash"), F.md5(content),
        F.lit("file_size"), F.octet_length(content).cast("string"), F.lit("source_domain"), source_domain(url))
    if extra is None:
        return base
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(extra, k))
    return F.map_concat(kept, extra)


def upsert_documents(base: DataFrame, new: DataFrame, keys: list[str], updated: list[str],
                     order: list[str]) -> DataFrame:
    """Insert new keys and overwrite only the ``updated`` columns of known ones.

    Several new rows for one key act in ``order``: the first inserts, the last
    updates. One grouping and one join, both on the key.
    """
    at = F.struct(*order)
    kept = [c for c in base.columns if c not in keys + updated]
    batch = new.groupBy(*keys).agg(
        *[F.min_by(F.struct(c), at)[c].alias(f"_first_{c}") for c in kept],
        *[F.max_by(F.struct(c), at)[c].alias(f"_last_{c}") for c in updated],
        F.lit(True).alias("_in_new"))
    joined = base.withColumn("_in_base", F.lit(True)).join(batch, keys, "full_outer")
    old, fresh = F.col("_in_base").isNotNull(), F.col("_in_new").isNotNull()
    return joined.select(
        *keys,
        *[F.when(old, F.col(c)).otherwise(F.col(f"_first_{c}")).alias(c) for c in kept],
        *[F.when(fresh, F.col(f"_last_{c}")).otherwise(F.col(c)).alias(c) for c in updated],
    ).select(*base.columns)


def providers_of(names: DataFrame, name: str = "payer_name") -> DataFrame:
    """Provider dimension: one row per distinct name with its id."""
    distinct = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    return distinct.select(surrogate_key(F.col("name")).alias("id"), "name")


def list_documents_with_provider(docs: DataFrame, providers: DataFrame, name: str | None = None) -> DataFrame:
    """Documents with their provider's name and scope, by name and newest first."""
    wanted = providers if name is None else providers.where(F.col("name") == name)
    joined = docs.join(wanted, docs["provider_id"] == wanted["id"]).select(
        wanted["name"], docs["filename"], docs["file_size_mb"], docs["state_specific"], docs["uploaded_at"])
    shown = joined.withColumn("scope", F.coalesce(
        F.concat(F.lit("["), "state_specific", F.lit("]")), F.lit("[National]")))
    return shown.orderBy("name", F.desc("uploaded_at"), "filename")


def get_document(docs: DataFrame, doc_id: int) -> DataFrame:
    """Name and bytes of one document; no row when it is unknown."""
    return docs.where(F.col("id") == doc_id).select("filename", "pdf_data")


def delete_documents(docs: DataFrame, names: DataFrame, key: str = "filename") -> DataFrame:
    """The table without the named documents."""
    return docs.join(names.select(key).distinct(), key, "left_anti")


def skip_known_content(new: DataFrame, known: DataFrame, order: list[str], content: str = "content",
                       payer: str = "payer_name") -> DataFrame:
    """New documents whose (payer, content hash) is neither stored nor seen earlier in the batch.

    The choice is made on hashes and order columns, so documents' bodies take
    no part in it; the chosen rows are found again by their order columns.
    """
    first = _first_copies(new, [payer], order, content)
    fresh = first.join(known.select(payer, "content_hash").distinct(), [payer, "content_hash"], "left_anti")
    return _chosen(new, fresh, [payer], order, content)


def dedupe_bytes(docs: DataFrame, order: list[str], content: str = "content") -> DataFrame:
    """One document per distinct content: the first in ``order``."""
    return _chosen(docs, _first_copies(docs, [], order, content), [], order, content)


def _first_copies(docs: DataFrame, scope: list[str], order: list[str], content: str) -> DataFrame:
    hashed = docs.select(*scope, F.md5(F.col(content)).alias("content_hash"), F.struct(*order).alias("_order"))
    return hashed.groupBy(*scope, "content_hash").agg(F.min("_order").alias("_order"))


def _chosen(docs: DataFrame, first: DataFrame, scope: list[str], order: list[str], content: str) -> DataFrame:
    keys = [*scope, "content_hash", "_order"]
    hashed = docs.withColumns({"content_hash": F.md5(F.col(content)), "_order": F.struct(*order)})
    wanted = first.select(*(F.col(k).alias(f"_wanted_{i}") for i, k in enumerate(keys)))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_wanted_{i}")) for i, k in enumerate(keys)))
    # Rows equal in all keys are repeats of one another.
    return hashed.join(wanted, same, "left_semi").dropDuplicates(keys).drop("_order")


def select_payers(df: DataFrame, names: list[str] | None = None, payer: str = "payer_name") -> DataFrame:
    return df if not names else df.where(F.col(payer).isin(names))


def filter_eq(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows equal on all given columns; a column the table lacks matches nothing."""
    for column, value in wanted.items():
        df = df.where(F.col(column) == F.lit(value) if column in df.columns else F.lit(False))
    return df
