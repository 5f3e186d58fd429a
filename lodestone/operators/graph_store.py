"""A graph's tables in a folder: documents replaced, removed, and their status.

Rows lie in buckets by a hash of their id: documents, chunks, mentions and
evidence by the document's, entities and edges by their own.  A write reads and
writes the buckets that its documents, and the entities and edges these refer to, are
in; the files of all others stay.  Entities and edges are shared between
documents: an edge counts the evidence it has left, and ``uses`` counts for each entity
its mentions and the ends of edges, so that what nothing refers to any more is
found without looking through other documents.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import stash
from ..sources.versions import Change, Part, Snapshot, Versions, bucket
from . import graph

SCHEMAS = {
    "documents": "document_id string, document_name string, kg_status string, kg_error string, kg_chunks long, kg_entities long, kg_relationships long, kg_failed_chunks long, kg_rejected long",
    "chunks": "chunk_id string, document_id string, document_name string, page_number int, section string, text string",
    "entities": "entity_id string, name string, type string, description string",
    "mentions": "entity_id string, chunk_id string, document_id string",
    "edges": "relationship_id string, source_id string, target_id string, type string",
    "evidence": "relationship_id string, chunk_id string, document_id string, evidence string, confidence double",
}
COUNTS = ("kg_chunks", "kg_entities", "kg_relationships", "kg_failed_chunks", "kg_rejected")


#: How often an entity is mentioned, and is an end of an edge, whether it has a row of its own or not.
USES = {"uses": "entity_id string, mentions long, ends long"}
KEYS = {name: "document_id" for name in ("documents", "chunks", "mentions", "evidence")} | {"entities": "entity_id", "uses": "entity_id", "edges": "relationship_id"}


class GraphStore(Versions):
    """``buckets`` is the number of each table's parts; it is that of the store's first
    write for ever.  A bucket should be about what a few tasks can hold."""

    schemas = {name: schema + ", told long" * (name == "edges") for name, schema in SCHEMAS.items()} | USES

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        super().__init__(spark, folder)
        self.buckets = buckets

    def tables(self) -> dict[str, DataFrame]:
        now = self.snapshot()
        return {name: now.read(name).drop("told") for name in SCHEMAS}

    def read(self, name: str) -> DataFrame:
        return self.snapshot().read(name).drop("told")

    def clear(self) -> None:
        """Forgets all chunks, entities and facts; the documents' states stay."""
        self.transact(lambda now: {name: Change(None) for name in self.schemas if name != "documents"})

    def set_status(self, states: DataFrame) -> None:
        """states (document_id, document_name, kg_status, and any other column of
        the documents) in place of those documents' own."""

        def put(now: Snapshot) -> dict[str, Change]:
            part = self._part(now, "documents", states)
            full = states.select(*[(F.col(c) if c in states.columns else F.lit(None)).alias(c) for c in part.rows.columns])
            return {"documents": part.change(part.rows.join(full.select("document_id"), "document_id", "left_anti").unionByName(full))}

        self.transact(put)

    def remove(self, document_ids: DataFrame) -> None:
        """Removes documents (document_id): their chunks, mentions and evidence, then
        edges without evidence and entities that nothing refers to any more."""
        ids = stash(document_ids.select(F.col("document_id").cast("string").alias("document_id")).distinct(), "removed-documents")
        self.transact(lambda now: self._changed(now, ids, {}))

    def replace(self, chunks: DataFrame, entities: DataFrame, relationships: DataFrame, failed: DataFrame | None = None, rejected: DataFrame | None = None) -> None:
        """Puts the documents of ``chunks`` in place of what the graph has of them.

        entities (chunk_id, entity_id, entity_name, entity_type, description) and
        relationships (chunk_id, relationship_id, source_id, target_id, type,
        evidence, confidence) are accepted ones by chunk; failed and rejected
        (chunk_id) count for the documents' states.  Of these four, one that has its
        chunks' document_id too isn't joined with the chunks to learn it.  All documents
        of a batch are written at once, however many chunks they have."""
        rows = stash(graph.chunk_rows(chunks), "graph-chunks")
        self._replace(rows, entities, relationships, [_failed(failed, rows)] if failed is not None else [], rejected)

    def _replace(self, rows: DataFrame, entities: DataFrame, relationships: DataFrame, counted: list[DataFrame], rejected: DataFrame | None) -> None:
        """``rows``, as the graph stores them, are read more than once; what was ``counted``
        already goes into the documents' states."""
        ids = stash(rows.select("document_id").distinct(), "replaced-documents")
        chunk = lambda own: ids if "document_id" in own.columns else rows
        mentions = stash(graph.of_documents(entities, chunk(entities)).select("entity_id", "chunk_id", "document_id").distinct(), "graph-mentions")
        facts = stash(graph.relationship_rows(relationships, chunk(relationships)), "graph-facts")
        new = {
            "chunks": rows, "mentions": mentions, "facts": facts, "documents": states(rows, mentions, facts, *counted, *([_rejected(rejected, rows)] if rejected is not None else [])),
            "evidence": facts.select("relationship_id", "chunk_id", "document_id", "evidence", "confidence"),
            "entities": stash(graph.entity_rows(entities).select("entity_id", "name", "type", "description"), "graph-entities"),
        }
        self.transact(lambda now: self._changed(now, ids, new))

    def _buckets(self, key: str, touched: DataFrame) -> set[int]:
        return {r[0] for r in touched.select(bucket(key, self.buckets)).distinct().collect()}  # as many as there are buckets, at most

    def _part(self, now: Snapshot, name: str, touched: DataFrame | set[int]) -> _Part:
        """The buckets of a table that hold ids of ``touched``, or these buckets."""
        own = touched if isinstance(touched, set) else self._buckets(KEYS[name], touched) if now.of(name) else set()
        return _Part(now.read(name, lambda p: p.bucket in own), tuple(p for p in now.of(name) if p.bucket not in own), bucket(KEYS[name], self.buckets))

    def _changed(self, now: Snapshot, ids: DataFrame, new: dict[str, DataFrame]) -> dict[str, Change]:
        """The tables without the documents of ``ids``, and with the rows of ``new``."""
        changes, lost = {}, {}
        own = self._buckets("document_id", ids)
        for name in ("documents", "chunks", "mentions", "evidence"):
            part = self._part(now, name, own)
            left = part.rows.join(ids, "document_id", "left_anti")
            changes[name] = part.change(left.unionByName(new[name].select(*left.columns)) if new else left)
            lost[name] = part.rows.join(ids, "document_id", "left_semi")

        number = lambda rows, key, name: rows.groupBy(key).agg(F.count("*").alias(name))
        fact = F.struct("source_id", "target_id", "type")
        facts = new["facts"].groupBy("relationship_id").agg(F.count("*").alias("added"), F.min(fact).alias("fact")) if new else None
        delta = number(lost["evidence"], "relationship_id", "lost")
        delta = delta.join(facts, "relationship_id", "full") if new else delta.withColumns({"added": F.lit(0), "fact": F.lit(None).cast("struct<source_id:string,target_id:string,type:string>")})
        delta = stash(delta.fillna(0, ["lost", "added"]), "edge-changes")
        part = self._part(now, "edges", delta)
        own = part.rows.select("relationship_id", fact.alias("own"), "told").join(delta, "relationship_id", "full").fillna(0, ["told", "lost", "added"])
        between = F.col("told") - F.col("lost")  # evidence after the removal, before anything new
        own = own.select("relationship_id", F.coalesce("own", "fact").alias("fact"), (between + F.col("added")).alias("left"), (F.col("told") > 0).alias("was"), (between > 0).alias("stayed"))
        own = stash(own, "edges-after")
        changes["edges"] = part.change(own.where("left > 0").select("relationship_id", "fact.*", F.col("left").alias("told")))

        ends = own.withColumn("cut", F.col("was") & ~F.col("stayed")).withColumn("joined", ~F.col("stayed") & (F.col("left") > 0)).where("cut OR joined")
        ends = ends.select(F.explode(F.array("fact.source_id", "fact.target_id")).alias("entity_id"), F.col("cut").cast("long").alias("lost_ends"), F.col("joined").cast("long").alias("new_ends"))
        zero = F.lit(0).cast("long")
        one = lambda rows, name: rows.select("entity_id", *[(F.lit(1).cast("long") if c == name else zero).alias(c) for c in _USES])
        moved = ends.select("entity_id", *[(F.col(c) if c in ends.columns else zero).alias(c) for c in _USES]).unionByName(one(lost["mentions"], "lost_mentions"))
        moved = moved.unionByName(one(new["mentions"], "new_mentions")) if new else moved
        moved = stash(moved.groupBy("entity_id").agg(*[F.sum(c).alias(c) for c in _USES]), "use-changes")
        own = self._buckets("entity_id", moved)
        part, entities = self._part(now, "uses", own), self._part(now, "entities", own)
        uses = stash(part.rows.join(moved, "entity_id", "full").fillna(0), "uses-after")
        mentions, at_ends = (F.col("mentions") - F.col("lost_mentions")), (F.col("ends") - F.col("lost_ends"))
        after = uses.select("entity_id", (mentions + F.col("new_mentions")).alias("mentions"), (at_ends + F.col("new_ends")).alias("ends"))
        changes["uses"] = part.change(after.where("mentions > 0 OR ends > 0"))
        orphans = uses.where(mentions + at_ends <= 0).join(moved, "entity_id", "left_semi").select("entity_id")
        kept = entities.rows.join(orphans, "entity_id", "left_anti")
        changes["entities"] = entities.change(graph.upsert_entities(kept, new["entities"]) if new else kept)
        return changes


_USES = ("lost_mentions", "new_mentions", "lost_ends", "new_ends")


@dataclass(frozen=True)
class _Part:
    """Rows of some of a table's buckets, and the parts of the others."""

    rows: DataFrame
    others: tuple[Part, ...]
    bucket: Column

    def change(self, rows: DataFrame) -> Change:
        return Change(rows.withColumn("__bucket", self.bucket), self.others, buckets=True)


def _number(rows: DataFrame, name: str, what: Column) -> DataFrame:
    return rows.groupBy("document_id").agg(what.alias(name))


def _failed(errors: DataFrame, chunks: DataFrame) -> DataFrame:
    return _number(graph.of_documents(errors, chunks), "kg_failed_chunks", F.count_distinct("chunk_id"))


def _rejected(rejected: DataFrame, chunks: DataFrame) -> DataFrame:
    return _number(graph.of_documents(rejected, chunks), "kg_rejected", F.count("*"))


def states(chunks: DataFrame, mentions: DataFrame, facts: DataFrame, *counted: DataFrame) -> DataFrame:
    """The documents' rows after a write: what they have, and whether all of their
    chunks could be read (done), some (partial) or none (failed).  ``counted`` are
    other counts (document_id, kg_...)."""
    out = graph.documents_of(chunks)
    for part in (_number(mentions, "kg_entities", F.count_distinct("entity_id")), _number(facts, "kg_relationships", F.count("*")), *counted):
        out = out.join(part, "document_id", "left")
    out = out.select("document_id", "document_name", *[F.coalesce(F.col(c) if c in out.columns else F.lit(None).cast("long"), F.lit(0).cast("long")).alias(c) for c in COUNTS])
    status = graph.index_status(F.col("kg_chunks"), F.col("kg_failed_chunks"))
    return out.withColumns({"kg_status": status, "kg_error": F.when(status == "failed", F.lit("extraction failed for every chunk")).cast("string")})


def index_documents(store: GraphStore, chunks: DataFrame, extract: Callable[[DataFrame], dict[str, DataFrame]]) -> DataFrame:
    """Extracts and stores the graph of the documents of ``chunks``; returns the
    documents' rows.  Never raises: documents of which no chunk could be read are
    failed, and keep what the graph had of them; a failure of the whole batch
    leaves the graph as it was and every document failed, with the error, cut to
    500 characters.  ``chunks`` are read more than once, so they should be stored; what
    ``extract`` returns may have document_id, as for ``GraphStore.replace``."""
    rows = graph.chunk_rows(chunks)
    known = stash(graph.documents_of(rows), "indexed-documents")
    named = known.select("document_id", "document_name")
    try:
        store.set_status(named.withColumn("kg_status", F.lit("processing")))
        got = extract(chunks)
        failed = stash(_failed(got["errors"], known if "document_id" in got["errors"].columns else rows), "failed-chunks")
        dead = stash(known.join(failed, "document_id").where("kg_chunks = kg_failed_chunks").select("document_id"), "failed-documents")
        store._replace(rows.join(dead, "document_id", "left_anti").select(*rows.columns), got["entities"], got["relationships"], [failed], got["rejected"])
        store.set_status(named.join(dead, "document_id", "left_semi").withColumns({"kg_status": F.lit("failed"), "kg_error": F.lit("extraction failed for every chunk")}))
    except Exception as x:  # noqa: BLE001 - the caller reads the failure from the table
        store.set_status(named.withColumns({"kg_status": F.lit("failed"), "kg_error": F.lit(f"{type(x).__name__}: {x}"[:500])}))
    return store.read("documents").join(named.select("document_id"), "document_id", "left_semi")
