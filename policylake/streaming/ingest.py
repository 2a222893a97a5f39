"""Incremental ingest and upkeep of the current policies.

Both jobs keep their state in a ``Store``, which knows the last batch of every stream: a repeated batch changes nothing, and a new
stream on an old store goes on from what it holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from policylake.operators.lifecycle import remove_replaced, replay_arrivals
from policylake.operators.merge import skip_known_content
from policylake.session import checkpointed
from policylake.sources.store import Store


def file_stream(spark: SparkSession, folder: str, glob: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files arriving in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _stream_name(checkpoint: str) -> str:
    return hashlib.md5(checkpoint.encode()).hexdigest()[:12]


def _values(df: DataFrame, column: str) -> list:
    return [r[0] for r in df.select(column).distinct().collect()]


def ingest_stream(stream: DataFrame, out: str, checkpoint: str, order: list[str], content: str = "content",
                  payer: str = "payer_name") -> StreamingQuery:
    """Append documents whose (payer, content hash) was never stored before.

    Exact over all time: a batch is checked against the hashes its payers have in the store, of which only two columns are read.
    """
    def store(batch: DataFrame, number: int) -> None:
        arrived = checkpointed(batch)

        def fresh(old: DataFrame | None) -> DataFrame:
            known = arrived.select(payer, F.md5(content).alias("content_hash")).limit(0) if old is None else old
            return skip_known_content(arrived, known, order, content, payer)

        Store(batch.sparkSession, out, payer).commit(_stream_name(checkpoint), _values(arrived, payer), fresh, number, append=True)

    return (stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def dedupe_stream(stream: DataFrame, time: str, lateness: str, content: str = "content",
                  payer: str = "payer_name") -> DataFrame:
    """Stream without repeats of a (payer, content hash) arriving within ``lateness``; state stays bounded."""
    hashed = stream.withColumn("content_hash", F.md5(F.col(content))).withWatermark(time, lateness)
    return hashed.dropDuplicatesWithinWatermark([payer, "content_hash"])


def maintain_current(stream: DataFrame, active: str, checkpoint: str, as_of: str,
                     prepare: Callable[[DataFrame], DataFrame] = lambda df: df, arrival: str = "crawl_timestamp",
                     tie: str = "source_pdf", keep: int = 32) -> StreamingQuery:
    """Keep the active policies as batches arrive; a batch rewrites the payers it concerns.

    What the batch writes again is overwritten, what it replaces is removed, and
    inside the batch arrivals replace one another in order. A batch that was
    committed before is not applied again. The newest ``keep`` versions stay readable.
    """
    def update(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, active)
        # The batch is read several times below; what was extracted from it is kept once.
        new = checkpointed(prepare(batch))
        survivors = replay_arrivals(new, as_of, arrival, tie)

        def changed(old: DataFrame | None) -> DataFrame:
            if old is None:
                return survivors
            untouched = old.join(new.select("payer_name", "policy_id").distinct(), ["payer_name", "policy_id"], "left_anti").select(*old.columns)
            return remove_replaced(untouched, new, as_of).unionByName(survivors)

        store.commit(_stream_name(checkpoint), _values(new, "payer_name"), changed, number)
        store.expire(keep)

    return (stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
