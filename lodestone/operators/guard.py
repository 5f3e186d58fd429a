"""Screening of questions, by rules, in one ordered pass."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T

# ---- fixed values
HIDDEN = "[\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
INJECTIONS = (
    (r"\b(ignore|disregard|forget|override|bypass)\b.{0,40}\b(previous|prior|above|earlier|all|your|system|these|the)\b.{0,20}\b(instructions?|rules?|prompts?|guidelines?|directions?)", "asks to ignore instructions"),
    (r"\b(reveal|show|print|display|repeat|output|leak|tell me|what (is|are))\b.{0,30}\b(system|hidden|initial|original|developer)\s+(prompt|instructions?|message|rules)", "asks for the system prompt"),
    (r"\byou are (now|no longer)\b", "tries to change the assistant's role"),
    (r"\b(pretend|roleplay|role-play)\b.{0,30}\b(you|to be|as)\b", "tries to change the assistant's role"),
    (r"\bact as (?:an? )?(?:unrestricted|unfiltered|jailbroken|different|new|evil)\b", "tries to change the assistant's role"),
    (r"\b(jailbreak|DAN mode|developer mode|god mode|do anything now)\b", "jailbreak attempt"),
    (r"\bnew (instructions?|rules|system prompt)\s*:", "injects new instructions"),
    (r"(^|\n)\s*(system|assistant|developer)\s*:", "imitates a system message"),
    (r"</?\s*(sources?|system|instructions?)\s*>", "contains prompt markup"),
    (r"\b(answer|respond)\b.{0,30}\b(without|ignoring|regardless of)\b.{0,20}\b(sources?|documents?|evidence|context|rules?)", "asks to answer without the documents"),
    (r"\buse your (own )?(general |outside )?knowledge\b", "asks to answer without the documents"),
)
SECRETS = (
    r"\bsk-(?:proj-)?[A-Za-z0-9_\-]{20,}",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"(?i)\b(?:\d[ -]?){13,19}\b(?=.*\b(card|credit|debit|cvv)\b)",
    r"(?i)\bpassword\s*[:=]\s*\S+",
    r"(?i)neo4j\+s://\S+:\S+@",
)
OUT_OF_SCOPE = (
    r"(?i)^\s*(please\s+)?(write|compose|generate|create|draft)\s+(me\s+)?(an?\s+)?"
    r"(poem|song|story|joke|essay|code|program|script|python|sql|email|letter|tweet|rap)\b"
    r"|^\s*(tell|give)\s+me\s+a\s+joke\b|\b(what('s| is) the (weather|time|date)( today| now)?)\s*\??$"
)
CHIT_CHAT = (
    r"(?i)^\s*(hi+|hello+|hey+|hai|vanakkam|namaste|good (morning|afternoon|evening)|"
    r"thanks?( you)?|thank you( so much)?|ok(ay)?|bye|who are you\??|how are you\??)[\s!.?]*$"
)
MAX_CHARS, MIN_LETTERS = 1000, 2

#: What a reader is told of a question that isn't answered.
MESSAGES = {
    "invalid": "This isn't a question that can be looked up. Ask about your documents, in a sentence of up to 1,000 characters.",
    "prompt_injection": "Only questions about your documents are answered; instructions to the assistant are not followed.",
    "sensitive_data": "The question holds what looks like a secret or a card number. It was not processed; remove it and ask again.",
    "out_of_scope": "Only questions about your documents are answered; other tasks are not.",
    "chit_chat": "Hello! Ask a question about your documents, and the answer will name its sources.",
}


@F.pandas_udf(StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """Unicode's NFKC form, which Spark has no function for."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def sanitize(question: Column, normalized: Column | None = None) -> tuple[Column, Column]:
    """(cleaned text, array of the changes made)."""
    raw = T.text_of(question)
    one = T.text_of(normalized) if normalized is not None else compatible(raw)
    two = F.regexp_replace(one, HIDDEN, "")
    three = F.regexp_replace(two, CONTROL, " ")
    four = T.strip(F.regexp_replace(three, rf"{T.SPACE}+", " "))
    changes = F.array_compact(F.array(
        F.when(one != raw, "normalized Unicode characters"), F.when(two != one, "removed invisible characters"),
        F.when(three != two, "removed control characters"), F.when(four != T.strip(three), "collapsed extra whitespace")))
    return four, changes


def screen(questions: DataFrame, question_col: str = "question", max_chars: int = MAX_CHARS, min_letters: int = MIN_LETTERS, block_out_of_scope: bool = True) -> DataFrame:
    """The rows with cleaned, changes, category, reason, allowed and message (null
    where allowed).

    Category by precedence: invalid, then for the cleaned text and next for the
    raw one sensitive_data and prompt_injection, chit_chat, out_of_scope, ok."""
    raw = T.text_of(F.col(question_col))
    rows = questions.withColumn("__nfkc", F.when(raw.rlike(r"[^\x00-\x7f]"), compatible(raw)).otherwise(raw))
    cleaned, changes = sanitize(raw, F.col("__nfkc"))
    rows = rows.withColumns({"cleaned": cleaned, "changes": changes})
    verdict = F.when(F.col("cleaned") == "", F.struct(F.lit("invalid").alias("category"), F.lit("empty question").alias("reason")))
    say = lambda category, reason: F.struct(F.lit(category).alias("category"), F.lit(reason).alias("reason"))
    verdict = verdict.when(F.length("cleaned") > max_chars, say("invalid", "question too long"))
    verdict = verdict.when(F.regexp_count("cleaned", F.lit(r"[\p{L}]")) < min_letters, say("invalid", "no words in question"))
    for text in (F.col("cleaned"), raw):
        for pattern in SECRETS:
            verdict = verdict.when(text.rlike(pattern), say("sensitive_data", "question contains a secret"))
        for pattern, why in INJECTIONS:
            verdict = verdict.when(text.rlike("(?is)" + pattern), say("prompt_injection", why))
    verdict = verdict.when(F.col("cleaned").rlike(CHIT_CHAT), say("chit_chat", "greeting or small talk"))
    if block_out_of_scope:
        verdict = verdict.when(F.col("cleaned").rlike(OUT_OF_SCOPE), say("out_of_scope", "task is not a question about the documents"))
    messages = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])
    rows = rows.withColumn("__v", verdict.otherwise(say("ok", "")))
    return rows.select(*questions.columns, "cleaned", "changes", "__v.category", "__v.reason", (F.col("__v.category") == "ok").alias("allowed"), F.try_element_at(messages, F.col("__v.category")).alias("message"))
