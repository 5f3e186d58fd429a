"""Ranked chunks to a numbered, size-bounded evidence context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MAX_CHARS, MAX_SOURCES, MIN_WORDS = 6000, 8, 4


def label(name: Column, page: Column) -> Column:
    return F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(name, F.lit(", page "), page.cast("string"))).otherwise(name)


def sentences(hits: DataFrame) -> DataFrame:
    """query_id, hit_rank, chunk_id, pos, sentence, key, words of hits (query_id, hit_rank, chunk_id, text)."""
    parts = hits.select("query_id", "hit_rank", "chunk_id", F.posexplode(T.split_sentences(T.clean_evidence(F.col("text")))).alias("pos", "sentence"))
    key = T.sentence_key(F.col("sentence"))
    return parts.withColumn("key", key).withColumn("words", F.when(F.col("key") == "", 0).otherwise(F.size(F.split("key", " "))))


def distinct_sentences(hits: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Sentences of ``min_words`` or more; of those with one key in a query's
    hits only the first is marked ``fresh``."""
    order = Window.partitionBy("query_id", "key").orderBy("hit_rank", "pos")
    return sentences(hits).where(F.col("words") >= min_words).withColumn("fresh", F.row_number().over(order) == 1)


def build_context(hits: DataFrame, max_chars: int = MAX_CHARS, max_sources: int = MAX_SOURCES, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per query: sources (array of ref, chunk_id, text), dropped_chunks
    and removed_duplicate_sentences.

    Chunks are taken best first; one that doesn't fit the rest of the budget is
    skipped and later ones still tried; the first is cut at a word if it alone
    is too long.  A repeat of a chunk that was taken is passed over; a repeat of
    one that was dropped is looked at again, all its sentences being known by then.
    The fold runs over a query's ranked list, which the retrievers have bounded."""
    best = hits.select("query_id", "hit_rank", "chunk_id", "text")
    marked = distinct_sentences(best, min_words)
    kept = marked.groupBy("query_id", "hit_rank").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("fresh"), F.struct("pos", "sentence")))), lambda s: F.concat(F.lit("• "), s["sentence"])), "\n").alias("text"),
        F.count_if(~F.col("fresh")).alias("repeats"))
    chunks = best.drop("text").join(kept, ["query_id", "hit_rank"], "left").select("query_id", F.struct("hit_rank", "chunk_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("repeats", F.lit(0).cast("long")).alias("repeats")).alias("c"))
    source = "array<struct<ref:int,chunk_id:string,text:string>>"
    start = F.struct(F.array().cast(source).alias("sources"), F.lit(0).alias("used"), F.lit(0).alias("dropped"), F.lit(0).cast("long").alias("removed"))

    def step(s: Column, c: Column) -> Column:
        n = F.size(s["sources"])
        fits = s["used"] + F.length(c["text"]) <= max_chars
        cut = F.regexp_replace(F.substring(c["text"], 1, max_chars), r"(?s)^(.*) .*$", "$1")
        text = F.when(fits, c["text"]).otherwise(F.concat(cut, F.lit(" …")))
        add = F.concat(s["sources"], F.array(F.struct((n + 1).alias("ref"), c["chunk_id"].cast("string").alias("chunk_id"), text.alias("text"))))
        state = lambda sources, used, dropped, removed: F.struct(sources.alias("sources"), used.alias("used"), dropped.alias("dropped"), removed.alias("removed"))
        removed = s["removed"] + c["repeats"]
        taken = F.exists(s["sources"], lambda x: x["chunk_id"] == c["chunk_id"].cast("string"))
        return (
            F.when(taken, s)
            .when(n >= max_sources, state(s["sources"], s["used"], s["dropped"] + 1, s["removed"]))
            .when((c["text"] == "") | (~fits & (n > 0)), state(s["sources"], s["used"], s["dropped"] + 1, removed))
            .otherwise(state(add, s["used"] + F.length(text), s["dropped"], removed)))

    folded = chunks.groupBy("query_id").agg(F.array_sort(F.collect_list("c")).alias("ranked")).withColumn("s", F.aggregate("ranked", start, step))
    return folded.select("query_id", F.col("s.sources").alias("sources"), F.col("s.dropped").alias("dropped_chunks"), F.col("s.removed").alias("removed_duplicate_sentences"), (F.size("s.sources") == 0).alias("is_empty"), F.col("s.used").alias("used_chars"))


def attach_facts(sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, source_ref, fact, evidence for facts (query_id, chunk_id, source,
    type, target, evidence) of chunks that became sources (query_id, ref, chunk_id)."""
    fact = T.fact_text(F.col("source"), F.col("type"), F.col("target"))
    rows = evidence.join(sources.select("query_id", "chunk_id", F.col("ref").alias("source_ref")), ["query_id", "chunk_id"])
    return rows.groupBy("query_id", "source_ref", fact.alias("fact")).agg(F.min("evidence").alias("evidence"))


def render(sources: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """query_id, the evidence block of sources (query_id, ref, document_name,
    page_number, text) and its char_count."""
    page = F.when(F.coalesce(F.col("page_number"), F.lit(0)) != 0, F.concat(F.lit(' page="'), F.col("page_number").cast("string"), F.lit('"'))).otherwise("")
    block = F.concat(F.lit('<source id="'), F.col("ref").cast("string"), F.lit('" document="'), T.escape_tags(F.col("document_name")), F.lit('"'), page, F.lit(">\n"), T.escape_tags(F.col("text")), F.lit("\n</source>"))
    join = lambda order, c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, c.alias("x")))), lambda s: s["x"]), by)
    out = sources.groupBy("query_id").agg(join(["ref"], block, "\n\n").alias("context"))
    if facts is None:
        return out.withColumn("char_count", F.length("context"))
    line = F.concat(F.lit("- "), T.escape_tags(F.col("fact")), F.lit(" ["), F.col("source_ref").cast("string"), F.lit("]"))
    lines = facts.groupBy("query_id").agg(join(["source_ref", "fact"], line, "\n").alias("lines"))
    tail = F.concat(F.lit("\n\n<graph_facts>\n"), F.col("lines"), F.lit("\n</graph_facts>"))
    return out.join(lines, "query_id", "left").select("query_id", F.concat("context", F.coalesce(tail, F.lit(""))).alias("context")).withColumn("char_count", F.length("context"))
