"""Retrievers behind one interface: which are on, what each found, and the fused list."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import MAX_BROADCAST, stash
from . import bm25, fusion, graph, vectors


class Retriever(Protocol):
    """Lists (query_id, rank, chunk_id, score) for queries (query_id, question)."""

    def search(self, queries: DataFrame, top_k: int) -> DataFrame: ...


class VectorStore(Retriever, Protocol):
    """A retriever over stored vectors."""

    def add_chunks(self, chunks: DataFrame) -> None: ...

    def delete_document(self, document_id: str) -> int: ...

    def count(self) -> int: ...


@dataclass
class TableVectors:
    """Vectors in a table, embedded by ``embedder``."""

    table: DataFrame
    embedder: vectors.Embedder = vectors.hashed_terms

    def search(self, queries: DataFrame, top_k: int) -> DataFrame:
        return vectors.search(self.table, vectors.embed(queries.select("query_id", "question"), "question", "qvec", self.embedder), top_k)

    def add_chunks(self, chunks: DataFrame) -> None:
        self.table = stash(vectors.add_chunks(self.table, chunks, self.embedder), "vectors")

    def delete_document(self, document_id: str) -> int:
        self.table, removed = vectors.delete_document(self.table, document_id)
        return int(removed.first()[0])

    def count(self) -> int:
        return self.table.count()


@dataclass
class PassingTexts:
    """Texts (chunk_id, text) that become vectors in the task that compares them; no vector is stored."""

    chunks: DataFrame

    def search(self, queries: DataFrame, top_k: int) -> DataFrame:
        return vectors.search_hashed(self.chunks, queries, top_k)


@dataclass
class Keywords:
    """An index, or what builds one when it's first asked."""

    index: bm25.Bm25Index | Callable[[], bm25.Bm25Index]

    def search(self, queries: DataFrame, top_k: int) -> DataFrame:
        if callable(self.index):
            self.index = self.index()
        return bm25.search(self.index, queries, top_k)


@dataclass
class GraphRetriever:
    entities: DataFrame
    edges: DataFrame
    evidence: DataFrame
    mentions: DataFrame

    def search(self, queries: DataFrame, top_k: int) -> DataFrame:
        seeds = stash(graph.seed_entities(self.entities, queries), "seeds")
        return graph.graph_search(self.edges, self.evidence, self.mentions, seeds, queries, top_k)


@dataclass(frozen=True)
class Settings:
    """Everything that changes results, with its default."""

    chunk_size: int = 800
    chunk_overlap: int = 120
    vector_top_k: int = 10
    bm25_top_k: int = 10
    kg_top_k: int = 10
    retrieval_seconds: float | None = None
    rerank_top_k: int = 5
    rerank_candidates: int = 30
    min_relevance_score: float = 0.0
    fusion_method: str = "rrf"
    enable_vector_retrieval: bool = True
    enable_bm25: bool = True
    enable_kg_retrieval: bool = True
    enable_reranker: bool = True
    enable_output_guardrail: bool = True
    enable_llm_verification: bool = True
    max_regenerations: int = 1
    context_max_chars: int = 6000
    context_max_sources: int = 8
    embedding_model: str = "hashed terms"
    reranker_model: str = "token overlap"
    llm_model: str | None = None

    def snapshot(self, **more: str | None) -> dict:
        """What is worth comparing between runs."""
        return asdict(self) | more


@dataclass
class Hybrid:
    """The retrievers that are on, in their fixed order, with the length of each
    one's list.  ``failed`` names those that failed in the last search, with the error."""

    retrievers: dict[str, tuple[Retriever, int]]
    settings: Settings = field(default_factory=Settings)
    failed: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def of(settings: Settings, vector: Retriever | None = None, keyword: Retriever | None = None, knowledge_graph: Retriever | None = None) -> Hybrid:
        """Those that are given and whose switch is on."""
        all_of = {"vector": (vector, settings.vector_top_k, settings.enable_vector_retrieval), "bm25": (keyword, settings.bm25_top_k, settings.enable_bm25), "knowledge_graph": (knowledge_graph, settings.kg_top_k, settings.enable_kg_retrieval)}
        return Hybrid({name: (r, k) for name, (r, k, on) in all_of.items() if r is not None and on}, settings)

    @property
    def enabled(self) -> list[str]:
        return sorted(self.retrievers)

    def search_one(self, method: str, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        if method not in self.retrievers:
            raise ValueError(f"unknown method {method!r}; on: {', '.join(self.enabled)}")
        retriever, most = self.retrievers[method]
        return retriever.search(queries, top_k or most)

    def retrieve_each(self, queries: DataFrame) -> dict[str, DataFrame]:
        own = {name: (lambda r=r, k=k: r.search(queries, k)) for name, (r, k) in self.retrievers.items()}
        found, self.failed = fusion.retrieve_each(own, self.settings.retrieval_seconds)
        return found

    def retrieve(self, queries: DataFrame, chunks: DataFrame, top_k: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(the best chunks with their text, provenance and rerank_score; counts by
        query).  Blank questions retrieve nothing."""
        asked = queries.where(F.trim("question") != "")
        each = self.retrieve_each(asked)
        if not each:
            raise ValueError("no retriever is on, or all of them failed")
        fused = stash(fusion.fuse(each, self.settings.fusion_method), "fused")
        texts = chunks.select("chunk_id", *[c for c in chunks.columns if c not in ("chunk_id", "score")])
        ids = stash(fused.select("chunk_id").distinct(), "fused-ids")
        if ids.count() <= MAX_BROADCAST:  # no other text has to move
            texts = texts.join(F.broadcast(ids), "chunk_id", "left_semi")
        rows = fused.join(asked.select("query_id", "question"), "query_id").join(texts, "chunk_id")
        best = self.rerank(rows, top_k)
        return best, counts(each, fused, best)

    def rerank(self, fused: DataFrame, top_k: int | None = None) -> DataFrame:
        s = self.settings
        limit = top_k or s.rerank_top_k
        if s.enable_reranker:
            return fusion.rerank_or_keep(fused, limit, s.min_relevance_score, s.rerank_candidates, failed=self.failed)
        return fusion.keep_order(fused, limit)


def counts(each: dict[str, DataFrame], fused: DataFrame, returned: DataFrame) -> DataFrame:
    """query_id, stage, n: the hits of each retriever, of the fused list and of what is returned."""
    lists = {**each, "fused": fused, "returned": returned}
    rows = None
    for name, df in lists.items():
        own = df.select("query_id", F.lit(name).alias("stage"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("query_id", "stage").agg(F.count("*").alias("n"))


def with_metadata(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunk's document, page and text; ids that aren't stored are skipped."""
    return hits.join(chunks.select("chunk_id", "document_id", "document_name", "page_number", "text"), "chunk_id").select("query_id", "rank", "chunk_id", "document_id", "document_name", "page_number", "text", "score")

