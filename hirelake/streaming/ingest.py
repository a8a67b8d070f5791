"""Stream of raw rows merged into the posting table, one micro-batch per run."""

from pyspark.sql import functions as F

from ..operators.ordering import with_rank
from ..plans.ingest import prepare
from ..sources import store


def merge_batch(batch, batch_id, root, as_of):
    """Merge one micro-batch as a commit of its own; a replayed batch starts from the commits before
    it and replaces its own."""
    rows = prepare(batch, as_of)
    incoming = with_rank(rows.orderBy("arrival").withColumnRenamed("arrival", "_at"), "arrival").drop("_at")
    store.merge_into(batch.sparkSession, root, f"{batch_id:012d}", incoming)


def ingest_stream(raw_stream, root, checkpoint, as_of=None):
    """Start the stream and process everything that has landed (``availableNow``)."""
    moment = F.current_timestamp() if as_of is None else as_of
    return (
        raw_stream.writeStream.foreachBatch(lambda df, i: merge_batch(df, i, root, moment))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
