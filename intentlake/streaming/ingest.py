"""Keeping an index up to date from a stream of file rows (an extension of the batch engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from intentlake.operators.index import chunk_files


def index_stream(files: DataFrame, encoder, path: str, checkpoint: str, size: int = 1500, available_now: bool = True) -> StreamingQuery:
    """Append the chunks of arriving files (file_path, language, source, loaded_at) to a Parquet index.

    A file that comes again within a batch is indexed once, the latest version;
    each batch carries its number, so that readers can take the newest version
    of a file (latest_version). Chunking and encoding are stateless; nothing is
    ranked inside of the stream. A batch that is repeated after a failure
    overwrites its own folder and nothing else.
    """

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("file_path").agg(F.max(F.struct("loaded_at", "language", "source")).alias("r")).select("file_path", "r.*")
        rows = encoder.encode(chunk_files(newest, size), "content").withColumn("version", F.lit(number).cast("bigint"))
        rows.withColumn("path_key", F.split("file_path", "/")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_version(index: DataFrame) -> DataFrame:
    """Chunks of the newest version of each file in an index written by index_stream."""
    newest = index.groupBy("file_path").agg(F.max("version").alias("version"))
    return index.join(newest, ["file_path", "version"], "left_semi")
