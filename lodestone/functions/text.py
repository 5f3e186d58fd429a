"""Text functions as Spark columns: cleaning, tokens, keys, numbers, citations.

Python's Unicode classes are written out, as Java's differ: a word character is
a letter, a number or an underscore, and white space is Unicode's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BLANK = r"[ \t\x0b\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
BM25_TOKEN = r"[A-Za-z0-9\u0900-\u097f]+(?:[-/.][A-Za-z0-9]+)*"
BULLETS = "[\uf0a7\uf0b7\uf076\uf0d8\uf0fc\u25aa\u25cf]"
SENTENCE_END = "[.!?\u0964]"
ABBREVIATIONS = ("i.e", "e.g", "etc", "viz", "Rs", "No", "Nos", "Dr", "Mr", "Mrs", "Ms", "Smt", "Shri", "Govt", "Dept", "approx", "vs", "Sl", "St")
DOT = "\u2024"
NUMBER = r"\d[\d,]*(?:\.\d+)?"
PERIOD = r"per\s+month|per\s+annum|per\s+year|a\s+month|a\s+year|monthly|annually|yearly|per\s+day|daily|p\.?m\.?|p\.?a\.?"
PERIOD_NAMES = {"a month": "per month", "monthly": "per month", "pm": "per month", "a year": "per year", "per annum": "per year",
                "annually": "per year", "yearly": "per year", "pa": "per year", "daily": "per day"}
CITATION = r"\[(\d{1,2})\]"
GRAPH_STOP_WORDS = (
    "a", "an", "the", "and", "or", "of", "to", "in", "on", "for", "by", "with", "from", "at", "as", "is", "are",
    "was", "were", "be", "been", "does", "do", "did", "what", "which", "who", "whom", "whose", "when", "where", "why",
    "how", "this", "that", "these", "those", "it", "its", "their", "his", "her", "about", "tell", "me", "under",
    "can", "will", "should", "would", "much", "many", "any", "all", "there", "according", "document", "documents",
    "uploaded",
)
INDIC_WORD = r"[\u0900-\u097f\u0b80-\u0bff]+"
INDIC_SIGN = r"^[\u0900-\u0903\u093a-\u094f\u0951-\u0957\u0962\u0963\u0b82\u0bbe-\u0bcd\u0bd7]"


def _sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, pattern, to)


def strip(c: Column, chars: str = SPACE) -> Column:
    """Without ``chars`` (a class) at either end."""
    return _sub(c, rf"^{chars}+|{chars}+\z", "")


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


# ---- ingestion


def clean_text(c: Column) -> Column:
    """Extracted text without control characters, broken words, or surplus blanks and lines."""
    c = _sub(text_of(c), r"\r\n?", "\n")
    c = _sub(c, CONTROL, "")
    c = _sub(c, rf"({WORD})-{SPACE}*\n{SPACE}*({WORD})", "$1$2")
    c = _sub(c, r"[ \t]{2,}", " ")
    c = _sub(c, rf"(?dm)^{BLANK}+|{BLANK}+$", "")
    c = _sub(c, r"\n{3,}", "\n\n")
    return strip(c)


def fixed_chunks(c: Column, size: int = 2500) -> Column:
    """Pieces of ``size`` characters, without overlap."""
    c = text_of(c)
    n = F.ceil(F.length(c) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def assess_text(c: Column, indic_share: float = 0.05, indic_least: int = 5, unmapped_share: float = 0.01) -> Column:
    """struct(garbled, reason, bad_word_ratio) of a chunk's text."""
    c = text_of(c)
    visible = F.length(_sub(c, SPACE, ""))
    unmapped = (F.regexp_count(c, F.lit("�")) + 5 * F.regexp_count(c, F.lit(r"\(cid:\d+\)"))) / visible
    words = F.regexp_extract_all(c, F.lit(INDIC_WORD), F.lit(0))
    bad = F.size(F.filter(words, lambda w: w.rlike(INDIC_SIGN))) / F.size(words)
    result = lambda garbled, reason, ratio: F.struct(F.lit(garbled).alias("garbled"), F.lit(reason).alias("reason"), ratio.alias("bad_word_ratio"))
    zero = F.lit(0.0)
    return (
        F.when(visible == 0, result(True, "empty", zero))
        .when(unmapped > unmapped_share, result(True, "unmapped_characters", unmapped))
        .when(F.size(words) < indic_least, result(False, "", zero))
        .when(bad > indic_share, result(True, "broken_indic_font", F.round(bad, 3)))
        .otherwise(result(False, "", F.round(bad, 3)))
    )


# ---- tokens and keys


def bm25_tokens(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(text_of(c), F.lit(BM25_TOKEN), F.lit(0)), F.lower)


def fold(c: Column) -> Column:
    """Lower case for comparisons; the sharp s becomes ss."""
    return F.replace(F.lower(text_of(c)), F.lit("ß"), F.lit("ss"))


def graph_tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 that aren't stop words; repeats stay."""
    stop = F.array(*map(F.lit, GRAPH_STOP_WORDS))
    return F.filter(F.regexp_extract_all(fold(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~F.array_contains(stop, t))


def normalize_name(c: Column) -> Column:
    return strip(strip(_sub(text_of(c), rf"{SPACE}+", " ")), r"[\"'`.,;:]")


def canonical_key(c: Column) -> Column:
    return F.trim(_sub(fold(c), r"[^\p{L}\p{N}]+", " "))


def entity_id(kind: Column, name: Column) -> Column:
    return F.substring(F.sha1(F.concat(kind, F.lit("|"), canonical_key(name))), 1, 16)


def relationship_id(source: Column, kind: Column, target: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", source, kind, target)), 1, 16)


def relation_type(c: Column) -> Column:
    return strip(_sub(F.upper(strip(text_of(c))), "[^A-Z0-9]+", "_"), "_")


def name_match(name: Column, query_tokens: Column) -> Column:
    """The share of a name's distinct tokens that the question has."""
    own = F.array_distinct(graph_tokens(name))
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, query_tokens)) / F.size(own)).otherwise(0.0)


def verb_match(kind: Column, query_tokens: Column) -> Column:
    """Whether a question uses a relation's verb, by a stem of at most five letters."""
    words = F.filter(graph_tokens(F.replace(kind, F.lit("_"), F.lit(" "))), lambda w: F.length(w) >= 4)
    tokens = F.filter(query_tokens, lambda t: F.length(t) >= 4)
    return F.exists(words, lambda w: F.exists(tokens, lambda t: F.startswith(t, F.substring(w, 1, 5)) | F.startswith(w, F.substring(t, 1, 5))))


def fact_text(source: Column, kind: Column, target: Column) -> Column:
    return F.concat(source, F.lit(" -["), kind, F.lit("]-> "), target)


# ---- evidence


def clean_evidence(c: Column) -> Column:
    """A chunk's text with plain bullets and without hard line wraps."""
    c = _sub(text_of(c), BULLETS, "•")
    c = _sub(c, r"[ \t]+", " ")
    c = _sub(c, rf"(?<![.!?:।\n])\n(?!{SPACE}*•)(?!\n)", " ")
    c = _sub(c, rf"{SPACE}*•{SPACE}*", "\n• ")
    c = _sub(c, r"\n{3,}", "\n\n")
    return strip(c)


def split_sentences(c: Column) -> Column:
    """Sentences in order; a full stop of an abbreviation or initial ends none."""
    known = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    c = _sub(text_of(c), rf"(?iu)(?<!{WORD})({known})\.", f"$1{DOT}")
    c = _sub(c, rf"(?<=(?<!{WORD})[A-Za-z])\.(?=[A-Za-z]\.)", DOT)
    parts = F.split(c, rf"(?<={SENTENCE_END}){SPACE}+|\n{SPACE}*•{SPACE}*|\n{{2,}}")
    parts = F.transform(parts, lambda p: F.replace(strip(p, "[ •\n]"), F.lit(DOT), F.lit(".")))
    return F.filter(parts, lambda p: p != "")


def sentence_key(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(fold(c), F.lit(rf"{WORD}+"), F.lit(0)), " ")


def escape_tags(c: Column) -> Column:
    """Evidence can't open or close a source tag, in any case of letters."""
    return _sub(text_of(c), rf"(?i)(</?{SPACE}*source)", "$1​")


def sigmoid(c: Column) -> Column:
    return F.when(c >= 0, 1 / (1 + F.exp(-c))).otherwise(F.exp(c) / (1 + F.exp(c)))


# ---- numbers and citations


def normalize_number(c: Column) -> Column:
    c = _sub(F.replace(c, F.lit(","), F.lit("")), r"\.+$", "")
    c = F.when(F.contains(c, F.lit(".")), _sub(c, r"\.?0*$", "")).otherwise(c)
    c = _sub(c, "^0+", "")
    return F.when(c == "", "0").otherwise(c)


def without_citations(c: Column) -> Column:
    return _sub(text_of(c), CITATION, " ")


def numbers_in(c: Column) -> Column:
    """Distinct normalised numbers outside citations."""
    return F.array_distinct(F.transform(F.regexp_extract_all(without_citations(c), F.lit(NUMBER), F.lit(0)), normalize_number))


def number_periods(c: Column) -> Column:
    """Distinct ``number period`` pairs, with one name for each period."""
    pattern = rf"(?i)({NUMBER})\s*(?:/-|/|-)?\s*(?:rupees|rs\.?|inr)?\s*({PERIOD})"
    plain = without_citations(c)
    names = F.create_map(*[F.lit(x) for kv in PERIOD_NAMES.items() for x in kv])

    def one(number: Column, period: Column) -> Column:
        p = _sub(F.replace(F.lower(period), F.lit("."), F.lit("")), r"\s+", " ")
        return F.concat_ws(" ", normalize_number(number), F.coalesce(F.try_element_at(names, p), p))

    return F.array_distinct(F.zip_with(F.regexp_extract_all(plain, F.lit(pattern), F.lit(1)), F.regexp_extract_all(plain, F.lit(pattern), F.lit(2)), one))


def citations_in(c: Column) -> Column:
    """Distinct cited numbers, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text_of(c), F.lit(CITATION), F.lit(1)), lambda n: n.cast("int")))


def set_citations(c: Column, refs: Column) -> Column:
    """A sentence with these citations alone, before its final mark."""
    bare = _sub(_sub(text_of(c), CITATION, ""), rf"{SPACE}+\z", "")
    end = F.regexp_extract(bare, r"[.!?]\z", 0)
    bare = _sub(_sub(bare, r"[.!?]\z", ""), rf"{SPACE}+\z", "")
    return F.concat(bare, F.lit(" "), F.array_join(F.transform(F.array_sort(refs), lambda r: F.concat(F.lit("["), r.cast("string"), F.lit("]"))), ""), end)
