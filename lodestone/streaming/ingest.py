"""Incremental ingest: streams of pages into a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import vectors
from ..operators.store import DocumentStore


def ingest_stream(
    pages: DataFrame, store: DocumentStore, checkpoint: str, told: Callable[[int, DataFrame], None] | None = None, skip_garbled: bool = True, size: int = 800, overlap: int = 120,
    embedder: vectors.Embedder = vectors.hashed_terms,
) -> StreamingQuery:
    """Start a query over a stream of pages, as ``DocumentStore.ingest`` takes them and
    ``sources.files.stream_pages`` gives them; a document's pages come in one batch.

    Each batch is one commit of the store, by the same rules as any other ingest.  One
    that is run again, because it broke off after its commit, finds its documents
    registered and adds nothing.  ``told`` gets each batch's number and the outcomes
    (document_id, outcome) of its documents.  What is there when the query starts is
    taken, in as many batches as the source makes, and the query ends."""
    folder = f"{checkpoint.rstrip('/')}/batch"

    def add(batch: DataFrame, number: int) -> None:
        # Written once, so that state is asked once; and read by the store's own session, which plans as it runs.
        batch.write.mode("overwrite").parquet(folder)
        outcomes = store.ingest(store.spark.read.schema(batch.schema).parquet(folder), skip_garbled, size, overlap, embedder)
        if told is not None:
            told(number, outcomes)

    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
