"""Documents in and out of the registry, by content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import numbered

EXTENSIONS = (".pdf", ".docx", ".txt", ".md")
MAX_BYTES = 25 << 20


def validate(files: DataFrame) -> DataFrame:
    """files (name, n_bytes) with the reason against each, or null."""
    suffix = F.lower(F.regexp_extract("name", r"(\.[^./]+)$", 1))
    return files.withColumn("reason", F.when(~suffix.isin(*EXTENSIONS), "unsupported_type").when(F.col("n_bytes") > MAX_BYTES, "too_large").when(F.col("n_bytes") == 0, "empty"))


def register(new: DataFrame, stored: DataFrame | None = None, order_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents of ``new`` with file_hash whose content isn't stored yet; of
    equal ones within ``new`` the first by ``order_col``."""
    hashed = new.withColumn("file_hash", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    first = hashed.groupBy("file_hash").agg(F.min(order_col).alias("__first"))
    if stored is not None:
        first = first.join(stored.select("file_hash"), "file_hash", "left_anti")
    # Texts without an id come last: one is kept where no other document has its content.
    found = hashed.join(first, "file_hash").where(F.col(order_col).eqNullSafe(F.col("__first"))).drop("__first")
    return found.dropDuplicates(["file_hash"])


def all_chunks(registry: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of registered documents, with their document's place in the order of registration."""
    places = numbered(registry.select("document_id", "uploaded_at"), ["uploaded_at", "document_id"], "document_ord").drop("uploaded_at")
    return chunks.join(places, "document_id")


def remove(document_id: str, **tables: DataFrame) -> dict[str, DataFrame]:
    """Every table without the document's rows; rows of no document stay."""
    return {name: t.where(~F.col("document_id").eqNullSafe(F.lit(document_id))) for name, t in tables.items()}


def stats(registry: DataFrame, vectors: DataFrame, postings_lengths: DataFrame) -> DataFrame:
    """One row: documents, chunks, vectors, bm25_chunks."""
    one = registry.agg(F.count("*").alias("documents"), F.sum("chunk_count").alias("chunks"))
    return one.crossJoin(vectors.agg(F.count("*").alias("vectors"))).crossJoin(postings_lengths.agg(F.count("*").alias("bm25_chunks")))
