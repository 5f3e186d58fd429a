"""Corpus preparation as a chain of stages.

Each stage takes every document that the one before kept, calls one operator,
and returns the documents that it keeps, with the columns of ``documents`` and any
others that the rows have; the last returns what encoding made of them.

For all stages: an empty table gives no rows, texts of any length are taken whole,
rows that repeat each other are decided alike, a row without a doc_id is dropped
as a copy of another text alone, and other columns pass through, whatever their
names.  A null text counts as empty: it has no language.  Rows that share a doc_id
but not the text are documents of their own: each is judged by its text, and what
drops one of them leaves the others.  Of such rows in one group of near
duplicates the one with the smallest SHA-256 counts as the smaller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bpe import bpe_round_trip
from lodestone.llm.decontamination import find_leaks
from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.langid import UNKNOWN, identify_language
from lodestone.llm.near_dedup import near_duplicates
from lodestone.llm.tables import stash, table

#: A text whose words' own likeliest languages have a smaller mean posterior is rejected.
LEAST_SCORE = 0.35
VOCABULARY = "word_bpe_49k.json"


KEY = "__key"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of id and text; null where there's no id."""
    text = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    return docs.withColumn(KEY, F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("id"), text.alias("sha256"))))


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of keyed docs whose key isn't a doc_id of ``found``; rows without one stay."""
    return docs.join(found.select(F.col("doc_id").alias(KEY)).distinct(), KEY, "left_anti").drop(KEY)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letters (a null or empty text has
    none), or nothing that resembles one; rows without a doc_id are all kept."""
    docs = _keyed(docs)
    found = identify_language(docs, certainty=True, key_col=KEY)
    return _without(docs, found.where((F.col("lang_pred") == UNKNOWN) | (F.col("certainty") < LEAST_SCORE)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps the document with the largest id; rows that repeat it
    stay together.  A row without one loses against any other."""
    plain = [f"c{k}" for k in range(len(docs.columns))]  # whatever the columns are called
    name = dict(zip(docs.columns, plain, strict=True))
    found = exact_dedup(docs.toDF(*plain), id_col=name["doc_id"], text_col=name["text"])
    return found.where("kept").select(*plain).toDF(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, keeps the document with the smallest
    id.  Texts without words are linked with nothing, and rows without a doc_id stay."""
    docs = _keyed(docs)
    return _without(docs, near_duplicates(docs, id_col=KEY).where("NOT kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of ``benchmark``; an empty benchmark drops
    none, and rows without a doc_id stay."""
    docs = _keyed(docs)
    return _without(docs, find_leaks(docs, table(spark, sf_dir, "benchmark"), id_col=KEY))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left, a row each."""
    import public_tokenizers

    return bpe_round_trip(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", encode),
]
#: Models, signatures and encodings can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
