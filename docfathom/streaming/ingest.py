"""Documents from a stream into a store: versions, chunks and pruning, one commit a batch.

A batch's documents are checked against the store by their hash; new and changed ones get a version and chunks, and the oldest versions
go. All of it is one segment, published together with the number of the batch, so a batch that is run again after a failure changes
nothing, and a reader never sees a document without its chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking as H
from ..operators import ingest as I
from ..session import cut
from ..sources.segments import Segments, Table

DOCUMENTS = "doc_id string, hash string, version long, text string"
CHUNKS = "doc_id string, version long, chunk_index long, hash string, text string"


class Library:
    """A store of documents (doc_id, hash, version, text) and chunks (doc_id, version, chunk_index, hash, text); the last `keep` versions stay."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 3):
        self.spark, self.keep = spark, keep
        self.log = Segments(spark, root, "doc_id", {"documents": Table(), "chunks": Table()})

    def _rows(self, table: str, schema: str) -> DataFrame:
        found = self.log.read(table)
        return self.spark.createDataFrame([], schema) if found is None else found

    def documents(self) -> DataFrame:
        return self._rows("documents", DOCUMENTS)

    def chunks(self) -> DataFrame:
        return self._rows("chunks", CHUNKS)

    def ingest(self, rows: DataFrame, batch: int, name: str = "ingest") -> None:
        """Rows (doc_id, text) of a batch; of several of one document the greatest text counts. Rows without an id or a text are left out."""
        if self.log.marked(name) >= batch:
            return
        rows = rows.where("doc_id is not null and text is not null").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.max("text").alias("text"))
        fresh = rows.withColumn("hash", I.content_hash(F.col("text")))
        state = self.documents()
        checked = I.check_hash(fresh, state).where("status <> 'skip'").select("doc_id", F.col("version").cast("long").alias("version"))
        changed = cut(fresh.join(checked, "doc_id").select("doc_id", "hash", "version", "text"))
        if changed.isEmpty():
            self.log.write({}, changed.select("doc_id"), mark=(name, batch))
            return
        latest = changed.select("doc_id", F.col("version").alias("_now"))
        older = lambda df: df.join(latest, "doc_id").where(F.col("version") > F.col("_now") - self.keep).drop("_now")
        parts = H.chunks(changed.select("doc_id", "text", F.lit("text").alias("source")), "html").select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text")
        parts = parts.join(latest.withColumnRenamed("_now", "version"), "doc_id").select("doc_id", "version", "chunk_index", I.content_hash(F.col("text")).alias("hash"), "text")
        tables = {"documents": changed.unionByName(older(state)), "chunks": parts.unionByName(older(self.chunks()))}
        self.log.write(tables, changed.select("doc_id"), mark=(name, batch))

    def follow(self, stream: DataFrame, checkpoint: str, name: str = "ingest", **trigger) -> StreamingQuery:
        """Ingest a stream of rows (doc_id, text), a batch at a time."""
        return stream.writeStream.foreachBatch(lambda rows, batch: self.ingest(rows, batch, name)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
