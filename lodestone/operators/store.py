"""Documents, their chunks, vectors and keyword index as tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import stash
from ..sources.versions import Change, Part, Snapshot, Versions
from . import bm25, chunking, registry, vectors

SCHEMAS = {
    "registry": "document_id string, filename string, file_type string, file_hash string, uploaded_at timestamp, chunk_count long, page_count long, source string",
    "chunks": "chunk_id string, document_id string, document_name string, page_number int, chunk_ord int, text string",
    "vectors": "chunk_id string, document_id string, vec array<double>",
    "postings": "chunk_id string, document_id string, dl int, terms array<string>, tfs array<int>",
    "lengths": "chunk_id string, document_id string, dl int",
}
#: Counts of each segment, which add up; a removed document's are there once more, as negative ones.
SUMS = {"terms": "term string, df long", "corpus": "n long, tokens long"}
REMOVED = {"removed": "document_id string, upto long"}
OUTCOMES = ("registered", "duplicate", "unreadable", "needs_ocr", "known_id", "no_id")


class DocumentStore(Versions):
    """Every ingest adds a segment to each table, and a removal adds a row that hides
    the document in the segments before it, with its counts taken back: either
    writes as much as the batch or the document has, however large the store is.
    Segments of about one size are merged as they become many (``merge_all``), and
    hidden rows go then.  Any number of writers may work on a store at once."""

    schemas = {name: f"{schema}, segment long" for name, schema in SCHEMAS.items()} | SUMS | REMOVED
    clustered = {"registry": "document_id", "chunks": "document_id", "vectors": "document_id", "postings": "document_id", "lengths": "document_id"}
    looked_up = ("registry", "chunks")

    def live(self, name: str, at: Snapshot | None = None, only: tuple[Part, ...] | None = None) -> DataFrame:
        """Rows that no removal hides, with the segment that each came in."""
        at = at or self.snapshot()
        return self._shown(at.read(name, None if only is None else lambda p: p in only), at)

    def _shown(self, rows: DataFrame, at: Snapshot) -> DataFrame:
        if not at.of("removed"):
            return rows
        gone = at.read("removed").groupBy("document_id").agg(F.max("upto").alias("upto"))
        return rows.join(gone, "document_id", "left").where("upto IS NULL OR segment > upto").select(*rows.columns)

    def tables(self) -> dict[str, DataFrame]:
        """The tables of SCHEMAS and SUMS as they are now."""
        now = self.snapshot()
        index = self.index(now)
        return {name: self.live(name, now).drop("segment") for name in SCHEMAS} | {"terms": index.terms, "corpus": index.corpus}

    def read(self, name: str) -> DataFrame:
        return self.live(name).drop("segment") if name in SCHEMAS else self.tables()[name]

    def list_documents(self) -> DataFrame:
        return self.read("registry")

    def get_document(self, document_id: str) -> DataFrame:
        """The document with its chunks (chunk_id, page_number, text) in order; no row if it's unknown."""
        now = self.snapshot()
        own = F.array_sort(F.collect_list(F.struct("chunk_ord", "chunk_id", "page_number", "text")))
        plain = F.transform(own, lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["page_number"].alias("page_number"), c["text"].alias("text")))
        chunks = self._own("chunks", document_id, now).groupBy("document_id").agg(plain.alias("chunks"))
        return self._own("registry", document_id, now).drop("segment").join(chunks, "document_id", "left")

    def _own(self, name: str, document_id: str, at: Snapshot) -> DataFrame:
        """A document's rows, from the files that its id may be in."""
        return self._shown(self.find(name, document_id, at), at)

    def get_chunks(self, document_id: str) -> DataFrame:
        return self._own("chunks", document_id, self.snapshot()).drop("segment")

    def all_chunks(self) -> DataFrame:
        now = self.snapshot()
        return registry.all_chunks(self.live("registry", now).drop("segment"), self.live("chunks", now).drop("segment"))

    def index(self, at: Snapshot | None = None) -> bm25.Bm25Index:
        """The keyword index over all segments."""
        at = at or self.snapshot()
        live = {name: self.live(name, at).drop("document_id", "segment") for name in ("postings", "lengths")}
        return bm25.index_of(**live, terms=at.read("terms"), corpus=at.read("corpus"))

    def ingest(self, pages: DataFrame, skip_garbled: bool = True, size: int = 800, overlap: int = 120, embedder: vectors.Embedder = vectors.hashed_terms) -> DataFrame:
        """Adds the documents of ``pages`` (document_id, document_name, page_ord,
        page_number, text, and error where a file couldn't be read) and returns
        document_id and outcome of each.

        A document whose content is stored, or has come with an earlier id of the
        batch, is a duplicate.  One whose id is registered with other content is known_id:
        remove that one first.  One without any text is unreadable; one all of
        whose chunks are garbled needs_ocr; pages without a document_id are no_id.  Only
        what is registered is indexed, and all tables change at once.  If another
        writer commits meanwhile, the batch is judged again by what that one left."""
        if "error" not in pages.columns:
            pages = pages.withColumn("error", F.lit(None).cast("string"))
        pages = pages.withColumn("document_id", F.col("document_id").cast("string"))
        parts = F.transform(F.array_sort(F.collect_list(F.struct("page_ord", F.coalesce("text", F.lit("")).alias("text")))), lambda p: p["text"])
        docs = pages.groupBy("document_id").agg(
            F.max("document_name").alias("filename"), F.count("*").alias("page_count"), F.max("error").alias("error"), F.sha2(F.array_join(parts, "\f"), 256).alias("file_hash"))
        docs = stash(docs, "hashed-documents")
        outcomes: list[DataFrame] = []

        def add(base: Snapshot) -> dict[str, Change]:
            judged, chunks = self._judged(base, docs, pages, skip_garbled, size, overlap)
            outcomes[:] = [judged]
            added = judged.where("outcome = 'registered'")
            if added.isEmpty():
                return {}
            number = F.lit(base.version + 1).cast("long").alias("segment")
            good = chunks.where("NOT garbled")  # a new document that has any is registered
            good = stash(good.repartitionByRange("document_id").sortWithinPartitions("document_id", "chunk_ord"), "good-chunks")
            suffix = F.lower(F.regexp_extract("filename", r"\.([^./]+)$", 1))
            rows = added.select("document_id", "filename", suffix.alias("file_type"), "file_hash", F.current_timestamp().alias("uploaded_at"), "chunk_count", "page_count", F.col("filename").alias("source"))
            made = bm25.segment(good, ("document_id",))
            made |= {"registry": rows, "chunks": good, "vectors": vectors.add_chunks(None, good, embedder)}
            ordered = ("chunks", "vectors", "postings", "lengths")  # as ``good`` is
            return {name: base.append(name, df if name in SUMS else df.withColumn("segment", number), name in ordered) for name, df in made.items()}

        self.transact(add)
        return outcomes[0].select("document_id", "outcome")

    def _judged(self, base: Snapshot, docs: DataFrame, pages: DataFrame, skip_garbled: bool, size: int, overlap: int) -> tuple[DataFrame, DataFrame]:
        """(documents with their outcome, chunks of those that are new)."""
        stored = self.live("registry", base)
        first = docs.where("document_id IS NOT NULL").groupBy("file_hash").agg(F.min("document_id").alias("first"))
        known = docs.join(first, "file_hash", "left").join(stored.select("file_hash", F.lit(True).alias("known")).distinct(), "file_hash", "left")
        known = known.join(stored.select("document_id", F.lit(True).alias("taken")).distinct(), "document_id", "left")
        known = stash(known, "new-documents")
        fresh = known.where("known IS NULL AND taken IS NULL AND document_id = first AND error IS NULL").select("document_id", F.col("filename").alias("document_name"))
        named = pages.drop("document_name").join(fresh.select("document_id"), "document_id", "left_semi")
        chunks = chunking.with_quality(chunking.chunk_pages(named, size, overlap)).join(fresh, "document_id")
        if not skip_garbled:
            chunks = chunks.withColumn("garbled", F.lit(False))
        chunks = stash(chunks, "new-chunks")
        told = chunks.groupBy("document_id").agg(F.count_if(~F.col("garbled")).alias("chunk_count"))
        judged = fresh.join(told, "document_id", "left").select(
            F.col("document_id").alias("first"), "chunk_count", F.when(F.col("chunk_count").isNull(), "unreadable").when(F.col("chunk_count") == 0, "needs_ocr").otherwise("registered").alias("judged"))
        outcome = (
            F.when(F.col("document_id").isNull(), "no_id").when(F.col("known"), "duplicate").when(F.col("taken"), "known_id").when(F.col("judged").isNull(), "unreadable")
            .when((F.col("judged") == "registered") & (F.col("document_id") != F.col("first")), "duplicate").otherwise(F.col("judged")))
        return stash(known.join(judged, "first", "left").withColumn("outcome", outcome), "outcomes"), chunks

    def remove(self, document_id: str, graph: object | None = None) -> bool:
        """Takes a document out of every table; a graph (with ``remove``) goes first,
        and its failure doesn't stop the rest.  False if it isn't registered.

        What is written is a row that hides the document's rows and its
        counts, taken back; no other document's rows are read or written."""
        if graph is not None:
            try:
                graph.remove(self.spark.createDataFrame([(document_id,)], "document_id string"))
            except Exception as x:  # noqa: BLE001 - the graph is secondary
                print(f"graph not cleaned of {document_id}: {x}")
        return self._hide(lambda name, base: self._own(name, document_id, base)) > 0

    def remove_all(self, document_ids: DataFrame) -> int:
        """Takes the documents of ``document_ids`` (document_id) out of every table at
        once; returns how many of them were registered."""
        ids = stash(document_ids.select(F.col("document_id").cast("string").alias("document_id")).distinct(), "removed-ids")
        return self._hide(lambda name, base: self.live(name, base).join(ids, "document_id", "left_semi"))

    def _hide(self, own: Callable[[str, Snapshot], DataFrame]) -> int:
        found = [0]

        def hide(base: Snapshot) -> dict[str, Change]:
            rows = stash(own("registry", base).select("document_id", F.lit(base.version).cast("long").alias("upto")), "hidden")
            found[0] = rows.count()
            if not found[0]:
                return {}
            counted = bm25.segment(own("chunks", base))
            back = {"terms": counted["terms"].withColumn("df", -F.col("df")), "corpus": counted["corpus"].select((-F.col("n")).alias("n"), (-F.col("tokens")).alias("tokens"))}
            return {name: base.append(name, df) for name, df in (back | {"removed": rows}).items()}

        self.transact(hide)
        return found[0]

    def merge_all(self, fan: int = 8) -> None:
        """Joins segments that have become many, table by table, and forgets removals
        that every table has taken in."""
        for name in SCHEMAS:
            self.merge(name, lambda base, parts, name=name: self.live(name, base, parts), fan)
        self.merge("terms", lambda base, parts: base.read("terms", lambda p: p in parts).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), fan)
        self.merge("corpus", lambda base, parts: base.read("corpus", lambda p: p in parts).agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")), fan)

        def forget(base: Snapshot) -> dict[str, Change | DataFrame]:
            clean = min((p.clean for name in SCHEMAS for p in base.of(name)), default=-1)
            old = F.col("upto") < clean
            rows = base.read("removed")
            return {"removed": rows.where(~old)} if base.of("removed") and not rows.where(old).isEmpty() else {}

        self.transact(forget)

    def stats(self) -> DataFrame:
        now = self.snapshot()
        return registry.stats(*[self.live(name, now) for name in ("registry", "vectors", "lengths")])


def rejected_pages(chunks: DataFrame) -> DataFrame:
    """document_id, n_rejected, pages and the first reason of chunks that are garbled."""
    bad = chunking.with_quality(chunks).where("garbled")
    return bad.groupBy("document_id").agg(F.count("*").alias("n_rejected"), F.array_sort(F.collect_set("page_number")).alias("pages"), F.min_by("reason", "chunk_ord").alias("reason"))


def text_of(chunks: DataFrame) -> DataFrame:
    """Chunks with a text, from whichever of text, content and page_content has one first."""
    present = [F.nullif(F.col(c), F.lit("")) for c in ("text", "content", "page_content") if c in chunks.columns]
    return chunks.withColumn("text", F.coalesce(*present, F.lit("")))


def source_refs(chunks: DataFrame) -> DataFrame:
    """Chunks as sources of extracted facts; columns that aren't there are null."""
    has = lambda c, t: (F.col(c) if c in chunks.columns else F.lit(None)).cast(t).alias(c)
    return text_of(chunks).select(has("document_id", "string"), T.text_of(has("document_name", "string")).alias("document_name"), has("chunk_id", "string"), has("page_number", "int"), has("section", "string"), "text")
