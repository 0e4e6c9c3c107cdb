"""The operation log as a structured stream: every micro-batch is reconciled onto the store's snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators import oplog
from termloom.sources.store import Store


def apply_batch(store: Store, batch: DataFrame, batch_id: int) -> bool:
    """Publishes a version with the batch's records; a batch that the manifest includes is skipped."""
    if batch_id <= store.manifest.batch_id:
        return False
    batch = batch.persist()
    try:
        ops = oplog.ranked(batch, oplog.operations(batch), store.manifest.overlay)
        last = batch.agg(F.coalesce(F.max("lsn"), F.lit(store.manifest.checkpoint_lsn))).first()[0]
        store.publish(oplog.reconcile(ops, store.read()), last, batch_id)
    finally:
        batch.unpersist()
    return True


def replay(store: Store, records: DataFrame, checkpoint: str, available_now: bool = True):
    """Starts the query that applies a stream of log records in commit order; returns it.

    Each batch must hold the commit ranks of its own records, and batches come in generation order: the
    source's files are segments closed at a committed watermark.
    """
    writer = records.writeStream.foreachBatch(lambda df, i: apply_batch(store, df, i)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def distinct_new_terms(records: DataFrame, delay: str) -> DataFrame:
    """First records of terms of a stream with an event time ts; state is kept for the delay."""
    return records.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["term"])
