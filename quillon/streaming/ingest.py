"""Structured Streaming ingest: a stream of change records applied to a change store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.changes import ChangeStore
from quillon.plans.workspace import filesystem


def stream_changes(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """The change records of Parquet files as they arrive in ``folder`` (or of one file, by its path)."""
    schema = "rec_id BIGINT, tbl STRING, seq BIGINT, op STRING, external STRING, doc_fields MAP<STRING, STRING>, deleted BOOLEAN, declared MAP<STRING, STRING>, logged_at TIMESTAMP_NTZ, received_at TIMESTAMP_NTZ"
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    fs, path = filesystem(spark, folder)
    if fs.exists(path) and fs.getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())
    return reader.parquet(folder)


def ingest(changes: DataFrame, store: ChangeStore, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends each micro-batch to ``store`` as one run.

    The checkpoint remembers which files were imported. A batch that is repeated after a failure adds the same
    records again, which changes nothing, as records of one (tbl, seq) are one change.
    """

    def append(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.append(batch)

    writer = changes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
