"""Pages to overlapping chunks, and the quality filter behind them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T
from ..sources.tables import MAX_BROADCAST, stash

_PARAGRAPH, _SENTENCE = re.compile(r"(?s).*\n\s*\n"), re.compile(r"(?s).*[.!?]\s+")


def pieces_of(text: str | None, size: int, overlap: int) -> list[str] | None:
    """The pieces of one text; see ``split_text``."""
    if text is None or len(text) <= size:
        return [text] if text else None if text is None else []
    out, start, half = [], 0, size // 2
    while start + size < len(text):
        window = text[start : start + size]
        cut = size
        for pattern in (_PARAGRAPH, _SENTENCE):
            found = pattern.match(window)
            if found and found.end() > half:
                cut = found.end()
                break
        else:
            blank = window.rfind(" ", half)
            cut = blank if blank >= 0 else size
        if cut <= overlap:  # such a piece would begin again where it began
            cut = size
        out.append(text[start : start + cut])
        start += cut - overlap
    return [p for p in map(str.strip, [*out, text[start:]]) if p]


def split_text(c: Column, size: int = 800, overlap: int = 120) -> Column:
    """Pieces of at most ``size`` characters that end, in this order of
    preference, after a paragraph, after a sentence, before a blank (each in the
    second half of the window), or at the window's end; each piece begins
    ``overlap`` characters before the end of the one before.

    Where a piece ends depends on where it began, so texts are walked once, in
    Arrow batches."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")

    @F.pandas_udf(ArrayType(StringType()))
    def walk(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pieces_of(t, size, overlap))

    return walk(c)


def chunk_pages(pages: DataFrame, size: int = 800, overlap: int = 120, cleaned: bool = False, single: bool = False) -> DataFrame:
    """chunk_id, document_id, page_number, chunk_ord, text for pages
    (document_id, page_ord, page_number, text); blank pages have no chunks and
    numbering goes on over a document's pages.  ``single`` says that no document
    has two of them, so that nothing has to move."""
    text = F.col("text") if cleaned else T.clean_text(F.col("text"))
    # Blank pages have no pieces; a condition on the cleaned text would be computed a second time, before the pages are dealt out.
    rows = pages.select("document_id", "page_ord", "page_number", text.alias("__clean"))
    pieces = rows.select("document_id", "page_ord", "page_number", F.posexplode(split_text(F.col("__clean"), size, overlap)).alias("pos", "text"))
    if single:
        return _chunks(pieces.withColumn("chunk_ord", F.col("pos")))
    order = Window.partitionBy("document_id").orderBy("page_ord", "pos")
    return _chunks(pieces.withColumn("chunk_ord", F.row_number().over(order) - 1))


def _chunks(numbered: DataFrame) -> DataFrame:
    return numbered.select(F.concat(F.col("document_id").cast("string"), F.lit("_chunk_"), F.col("chunk_ord").cast("string")).alias("chunk_id"), "document_id", "page_number", "chunk_ord", "text")


def chunk_in_place(pages: DataFrame, size: int = 800, overlap: int = 120) -> DataFrame:
    """``chunk_pages`` of a table in which most documents are a single page: these
    are numbered where they are read, and only the pages of the others move.
    Which those are is asked at once, of the ids alone."""
    several = stash(pages.groupBy("document_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("document_id").alias("__several")), "several-pages")
    n = several.count()
    if n == 0:
        return chunk_pages(pages, size, overlap, single=True)
    own = F.col("document_id").eqNullSafe(F.col("__several"))
    some = F.broadcast(several) if n <= MAX_BROADCAST else several
    alone, others = pages.join(some, own, "left_anti"), pages.join(some, own, "left_semi")
    return chunk_pages(alone, size, overlap, single=True).unionByName(chunk_pages(others, size, overlap))


def with_quality(chunks: DataFrame) -> DataFrame:
    """Chunks with garbled, reason and bad_word_ratio."""
    return chunks.withColumn("__q", T.assess_text(F.col("text"))).select("*", "__q.*").drop("__q")


def split_by_quality(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good chunks, rejected ones with the reason)."""
    flagged = with_quality(chunks)
    return flagged.where("NOT garbled").drop("garbled", "reason", "bad_word_ratio"), flagged.where("garbled")
