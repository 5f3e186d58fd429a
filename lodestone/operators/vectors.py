"""Exact vector retrieval, and an embedder that needs no model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import text as T
from ..sources.tables import stash

MAX_QUERIES_BYTES = 16 << 20  # of question vectors that a task holds at once
QUESTIONS, BLOCK, PIVOTS = 256, 512, 16  # questions and vectors multiplied at once; vectors that others are put beside
HELD = 1 << 16  # candidates between looks at which of them stay
TASKS = 256  # lists of more tasks are merged in two levels
DIM = 64
Embedder = Callable[[list[str]], np.ndarray]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0))


_TOKEN = re.compile(T.BM25_TOKEN)


@lru_cache(1 << 18)
def _code(token: str) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16)


def hashed_terms(texts: list[str]) -> np.ndarray:
    """A signed count by bucket of the tokens' MD5, scaled to unit length; zeros
    for a text without tokens.  It stands in for a sentence encoder."""
    out = np.zeros((len(texts), DIM))
    for row, text in zip(out, texts, strict=True):
        codes = np.array([_code(t.lower()) for t in _TOKEN.findall(text or "")], np.int64)
        if len(codes):
            row += np.bincount(codes % DIM, np.where(codes // DIM % 2 == 0, 1.0, -1.0), DIM)
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, size, where=size > 0, out=out)


def embed(rows: DataFrame, text_col: str = "text", name: str = "vec", embedder: Embedder = hashed_terms) -> DataFrame:
    """``rows`` with a vector of each text, by Arrow batches."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder(texts.fillna("").tolist())))

    return rows.withColumn(name, run(F.col(text_col)))


def add_chunks(stored: DataFrame | None, chunks: DataFrame, embedder: Embedder = hashed_terms) -> DataFrame:
    """(chunk_id, document_id, vec) of the stored vectors and of ``chunks`` whose id
    isn't stored yet."""
    new = chunks if stored is None else chunks.join(stored.select("chunk_id"), "chunk_id", "left_anti")
    new = embed(new.select("chunk_id", "document_id", "text"), embedder=embedder).drop("text")
    return new if stored is None else stored.select("chunk_id", "document_id", "vec").unionByName(new)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Stored vectors; an index that isn't there or can't be read counts as empty."""
    try:
        return spark.read.parquet(path).select("chunk_id", "document_id", "vec")
    except Exception:  # noqa: BLE001 - whatever is wrong with the files, searching must go on
        return spark.createDataFrame([], "chunk_id string, document_id string, vec array<double>")


def _top(scored: DataFrame, top_k: int, *salt: Column) -> DataFrame:
    order = Window.partitionBy("query_id", *salt).orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "rank", "chunk_id", "score")


def _blocks(queries: DataFrame) -> list[DataFrame]:
    """The questions in parts of about MAX_QUERIES_BYTES."""
    queries = queries.where("qvec IS NOT NULL").select("query_id", "qvec")
    n, size = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("qvec") * 8), F.lit(0))).first()
    parts = 2 * -(-size // MAX_QUERIES_BYTES)
    if parts <= 2:
        return [queries] * (n > 0)
    dealt = stash(queries.withColumn("__block", F.floor(F.rand(1) * parts)), "questions")
    return [dealt.where(F.col("__block") == k).drop("__block") for k in range(parts)]


def search(vectors: DataFrame, queries: DataFrame, top_k: int = 10, embedder: Embedder | None = None) -> DataFrame:
    """query_id, rank, chunk_id, score by inner product, exactly: vectors
    (chunk_id, vec) and queries (query_id, qvec).  With an ``embedder`` vec is a text,
    which becomes a vector in the same task.  ``top_k`` beyond the number of
    vectors gives all.  A vector that is zero wherever the question's isn't is no hit.

    Questions are taken in blocks of MAX_QUERIES_BYTES, each with one pass over
    the vectors, which is a table if there are several.  A task keeps the best of
    all its vectors, so that top_k rows leave it for each question, however many it
    has; where tasks are many, these are merged in two levels."""
    query_type, chunk_type = queries.schema["query_id"].dataType.simpleString(), vectors.schema["chunk_id"].dataType.simpleString()
    schema = f"query_id {query_type}, chunk_id {chunk_type}, score double"
    blocks, found = _blocks(queries), []
    rows = vectors.select("chunk_id", "vec").where("vec IS NOT NULL")
    for block in blocks:
        best = rows.mapInArrow(_best_of(block.toArrow(), top_k, embedder=embedder), schema)
        found.append(best if len(blocks) == 1 else stash(best, "best-of-block"))
    if not found:
        return _top(vectors.sparkSession.createDataFrame([], schema), top_k)
    merged = found[0] if len(found) == 1 else found[0].sparkSession.read.schema(schema).parquet(*{p.rpartition("/")[0] for f in found for p in f.inputFiles()})
    if rows.rdd.getNumPartitions() > TASKS:
        merged = _top(merged, top_k, F.pmod(F.xxhash64("chunk_id"), F.lit(TASKS))).drop("rank")
    return _top(merged, top_k)


def skipped_share(vectors: DataFrame, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """One row: pairs of a question and a vector, and how many of them ``search`` skips by the bounds of their blocks."""
    rows = vectors.select("chunk_id", "vec").where("vec IS NOT NULL")
    counted = [rows.mapInArrow(_best_of(block.toArrow(), top_k, counted=True), "pairs long, skipped long") for block in _blocks(queries)]
    return reduce(DataFrame.unionByName, counted).agg(F.sum("pairs").alias("pairs"), F.sum("skipped").alias("skipped"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Running:
    """The best ``k`` of each of ``n`` questions over all vectors that were shown.  ``bar``
    is the score that one more has to reach; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.bar = n, k, np.full(n, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.held = 0

    def add(self, who: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        if len(who):
            self.parts.append((who, score, ids))
            self.held += len(who)
            if self.held > 4 * self.n * self.k + HELD:
                self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, pa.Array | None]:
        """(question, score, id) by question and rank."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0), None
        who, score = (np.concatenate([p[c] for p in self.parts]) for c in (0, 1))
        ids = pa.concat_arrays([p[2] for p in self.parts])
        place = np.empty(len(who), np.int64)
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(who))
        order = np.lexsort((place, -np.round(score, 9), who))
        order = order[np.arange(len(order)) - np.searchsorted(who[order], who[order]) < self.k]
        who, score, ids = who[order], score[order], ids.take(pa.array(order))
        last = np.flatnonzero(np.arange(len(who)) - np.searchsorted(who, who) == self.k - 1)
        self.bar[who[last]] = score[last]
        self.parts, self.held = [(who, score, ids)], len(who)
        return who, score, ids


def _near_blocks(own: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in blocks of like ones: each goes to the nearest of a few of them."""
    pivots = own[:: max(1, len(own) // PIVOTS)][:PIVOTS]
    nearest = (own @ pivots.T - (pivots * pivots).sum(axis=1) / 2).argmax(axis=1)
    for p in range(len(pivots)):
        near = np.flatnonzero(nearest == p)
        for lo in range(0, len(near), BLOCK):
            yield near[lo : lo + BLOCK]


def _in_slices(batches: Iterator[pa.RecordBatch], embedder: Embedder | None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, vectors) of batches; texts are turned into vectors BLOCK at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK if embedder else max(batch.num_rows, 1)):
            part = batch.slice(lo, BLOCK) if embedder else batch
            yield part.column(0), embedder(part.column(1).to_pylist()) if embedder else _matrix(part.column(1))


def _best_of(questions: pa.Table, top_k: int, counted: bool = False, embedder: Embedder | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    ids = questions.column(0).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _matrix(questions.column(1).combine_chunks())
        length, running = np.sqrt((asked * asked).sum(axis=1)), Running(len(asked), top_k)
        pairs = skipped = 0
        for every_id, every in _in_slices(batches, embedder):
            for rows in _near_blocks(every):
                own, names = every[rows], every_id.take(pa.array(rows))
                centre = own.mean(axis=0)
                # Nothing in the block is farther from its centre, so no product is larger.
                most = asked @ centre + length * np.sqrt(((own - centre) ** 2).sum(axis=1).max()) * (1 + 1e-9) + 1e-8
                use = np.flatnonzero(most >= running.bar)
                pairs, skipped = pairs + len(asked) * len(own), skipped + (len(asked) - len(use)) * len(own)
                for lo in range(0, len(use), QUESTIONS):
                    part = use[lo : lo + QUESTIONS]
                    scores = asked[part] @ own.T
                    none = scores == 0
                    if none.any():
                        scores[none & ((asked[part] != 0).astype(np.float32) @ (own != 0).T.astype(np.float32) == 0)] = -np.inf
                    bar = running.bar[part]
                    if len(own) > top_k:  # whatever rounds to the k-th best may be among them
                        bar = np.maximum(bar, np.partition(scores, len(own) - top_k, axis=1)[:, len(own) - top_k])
                    q, j = np.nonzero((scores >= bar[:, None] - 2e-9) & (scores > -np.inf))
                    running.add(part[q], scores[q, j], names.take(pa.array(j)))
            running.best()
        if counted:
            yield pa.RecordBatch.from_arrays([pa.array([pairs]), pa.array([skipped])], ["pairs", "skipped"])
            return
        who, score, names = running.best()
        for lo in range(0, len(who), HELD):
            at = pa.array(who[lo : lo + HELD])
            yield pa.RecordBatch.from_arrays([ids.take(at), names.slice(lo, HELD), pa.array(score[lo : lo + HELD])], ["query_id", "chunk_id", "score"])

    return run


def search_hashed(chunks: DataFrame, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """query_id, rank, chunk_id, score by the cosine of hashed terms."""
    texts = chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("vec"))
    return search(texts, embed(queries.select("query_id", "question"), "question", "qvec"), top_k, hashed_terms)


def delete_document(vectors: DataFrame, document_id: str) -> tuple[DataFrame, DataFrame]:
    """(the vectors without the document's, one row with the number removed);
    vectors of no document stay."""
    own = F.col("document_id").eqNullSafe(F.lit(document_id))
    return vectors.where(~own), vectors.agg(F.count_if(own).alias("removed"))
