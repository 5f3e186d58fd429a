"""Fusion of ranked lists, and re-ranking of what comes out."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from ..sources.tables import stash

RRF_K = 60
RETRIEVERS = ("vector", "bm25", "knowledge_graph")


def union_hits(hits: dict[str, DataFrame]) -> DataFrame:
    """Lists (query_id, rank, chunk_id, score) with the retriever's name and its fixed place."""
    parts = [hits[name].select("query_id", "chunk_id", "rank", "score", F.lit(name).alias("retriever"), F.lit(k).alias("retriever_ord")) for k, name in enumerate(RETRIEVERS) if name in hits]
    return reduce(DataFrame.unionByName, parts)


def _fused(rows: DataFrame, part: Column) -> DataFrame:
    by = F.array_sort(F.collect_list(F.struct("retriever_ord", "retriever", "rank", "score")))
    out = rows.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("fused"), by.alias("by"), F.min(F.struct("retriever_ord", "rank")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("fused", 12)), "seen")
    entries = lambda field: F.map_from_entries(F.transform("by", lambda x: F.struct(x["retriever"], x[field])))
    return out.select("query_id", F.row_number().over(order).alias("fused_rank"), "chunk_id", F.col("fused").alias("score"), F.transform("by", lambda x: x["retriever"]).alias("retrievers"), entries("score").alias("original_scores"), entries("rank").alias("ranks"), (F.size("by") > 1).alias("found_by_multiple"))


def reciprocal_rank(rows: DataFrame, k: int = RRF_K) -> DataFrame:
    return _fused(rows, 1.0 / (k + F.col("rank")))


def weighted(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """By each list's scores, scaled to 0..1 (1 where all are equal), times its weight (1 by default)."""
    own = Window.partitionBy("query_id", "retriever")
    low, high = F.min("score").over(own), F.max("score").over(own)
    weight = reduce(lambda c, kv: F.when(F.col("retriever") == kv[0], float(kv[1])).otherwise(c), (weights or {}).items(), F.lit(1.0))
    scaled = rows.withColumn("__part", weight * F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))
    return _fused(scaled, F.col("__part"))


METHODS: dict[str, Callable[..., DataFrame]] = {"rrf": reciprocal_rank, "weighted": weighted}


def fuse(hits: dict[str, DataFrame], method: str = "rrf", **options) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown fusion method {method!r}; known: {', '.join(sorted(METHODS))}")
    return METHODS[method](union_hits(hits), **options)


def retrieve_each(retrievers: dict[str, Callable[[], DataFrame]], seconds: float | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(each retriever's list, the errors of those that failed).  Lists are written
    at once, so that a failure in the run is noticed and stops no other retriever.

    They run side by side, each in a thread, a job group and a scheduler pool of its
    own.  One that isn't through after ``seconds`` has its jobs cancelled and
    counts as failed."""
    out: dict[str, DataFrame] = {}
    failed: dict[str, str] = {}
    names = [name for name in RETRIEVERS if name in retrievers]
    session = SparkSession.active()
    context, run_id = session.sparkContext, uuid.uuid4().hex

    def run(name: str) -> None:
        context.setJobGroup(f"{name}-{run_id}", f"{name} retrieval", interruptOnCancel=True)
        context.setLocalProperty("spark.scheduler.pool", name)
        try:
            out[name] = stash(retrievers[name](), f"{name}-hits")
        except Exception as x:  # noqa: BLE001 - told to the caller
            failed[name] = f"{type(x).__name__}: {x}"[:500]

    threads = {name: InheritableThread(target=run, args=(name,), daemon=True) for name in names}
    until = None if seconds is None else time.monotonic() + seconds
    for t in threads.values():
        t.start()
    late = {}
    for name, t in threads.items():
        t.join(None if until is None else max(0.0, until - time.monotonic()))
        if t.is_alive():
            late[name] = f"TimeoutError: not through after {seconds} s"
            context.cancelJobGroup(f"{name}-{run_id}")
    # What ends after it was given up is as if it hadn't.
    return {name: out[name] for name in names if name in out and name not in late}, {**{n: e for n, e in failed.items() if n not in late}, **late}


def compare(hits: dict[str, DataFrame]) -> DataFrame:
    return union_hits(hits).select("query_id", "retriever", "rank", "chunk_id", "score")


def overlap_logit(question: Column, text: Column) -> Column:
    """A scorer without a model: 8 * share of the question's tokens in the text - 4."""
    own = F.array_distinct(T.bm25_tokens(question))
    share = F.size(F.array_intersect(own, T.bm25_tokens(text))) / F.greatest(F.size(own), F.lit(1))
    return 8 * share - 4


def rerank(fused: DataFrame, top_k: int = 5, min_score: float = 0.0, candidates: int = 30, max_chars: int = 2000, logit: Callable[[Column, Column], Column] = overlap_logit) -> DataFrame:
    """fused rows (query_id, fused_rank, chunk_id, question, text) with
    rerank_score (4 decimals) and rank: at most ``candidates`` reach the scorer,
    which sees ``max_chars`` characters; ties keep the fused order."""
    few = fused.where(F.col("fused_rank") <= candidates)
    scored = few.withColumn("rerank_score", F.round(T.sigmoid(logit(F.col("question"), F.substring("text", 1, max_chars))), 4)).where(F.col("rerank_score") >= min_score)
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "fused_rank")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def keep_order(fused: DataFrame, top_k: int) -> DataFrame:
    """The first ``top_k`` in the fused order, without a score."""
    return fused.where(F.col("fused_rank") <= top_k).withColumns({"rerank_score": F.lit(None).cast("double"), "rank": F.col("fused_rank")})


def rerank_or_keep(fused: DataFrame, top_k: int = 5, min_score: float = 0.0, candidates: int = 30, logit: Callable[[Column, Column], Column] = overlap_logit, failed: dict[str, str] | None = None) -> DataFrame:
    """``rerank``, written at once; if the scorer fails, the fused order stays and
    ``failed`` says why."""
    try:
        return stash(rerank(fused, top_k, min_score, candidates, logit=logit), "reranked")
    except Exception as x:  # noqa: BLE001 - told to the caller
        if failed is not None:
            failed["reranker"] = f"{type(x).__name__}: {x}"[:500]
        return keep_order(fused, top_k)


def predicted_logit(predict: Callable[[list[tuple[str, str]]], list[float]], batch: int = 16) -> Callable[[Column, Column], Column]:
    """A scorer around a model: ``predict`` gets (question, text) pairs, ``batch``
    at a time, and gives a logit for each."""

    @F.pandas_udf(DoubleType())
    def run(questions: pd.Series, texts: pd.Series) -> pd.Series:
        pairs = list(zip(questions.fillna(""), texts.fillna(""), strict=True))
        return pd.Series([float(x) for lo in range(0, len(pairs), batch) for x in predict(pairs[lo : lo + batch])], dtype="float64")

    return run
