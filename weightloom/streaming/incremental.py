"""Resumable ingest: a stream over new files, worked off in batches, with the repository itself as its state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weightloom.operators import repository
from weightloom.sources.safetensors import SUFFIX

_FILE = "path string, modificationTime timestamp, length long, content binary"


def ingest_stream(spark: SparkSession, folder: str, root: str, lineage: DataFrame, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Ingest what is new below `folder`, models being its subfolders, and end. A run with the same checkpoint goes on after the last.

    A batch that is repeated after a failure finds its contents in the repository and adds nothing. A model whose files come
    in several batches is completed by each; file contents aren't read from the stream.
    """
    rows = spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", f"*{SUFFIX}").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    parts = F.split("path", "/")
    files = rows.select(F.element_at(parts, -2).alias("model_id"), F.element_at(parts, -1).alias("file_name"), "path", "length")

    def work(batch: DataFrame, number: int) -> None:
        repository.ingest(batch.sparkSession, root, batch, lineage, again=True)

    return files.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
