import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunking


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("text, expected", [
    ("recommen-\ndations", "recommendations"), ("A    B\n\n\n\nC", "A B\n\nC"), (None, ""), ("  a \x07b\r\n c\t\td ", "a b\nc d"), (" x \ny", "x\ny")])
def test_clean_text(spark, text, expected):
    assert one(spark, T.clean_text(F.col("t")), t=text) == expected


@pytest.mark.parametrize("text, expected", [
    ("Under PM-KMY the scheme", ["under", "pm-kmy", "the", "scheme"]), ("R.C.No.4395/2026 dated today", ["r.c.no.4395/2026", "dated", "today"]),
    ("Rs.3,000 per month", ["rs.3", "000", "per", "month"]), ("", []), (None, [])])
def test_bm25_tokens(spark, text, expected):
    assert one(spark, T.bm25_tokens(F.col("t")), t=text) == expected


@pytest.mark.parametrize("text, garbled, reason", [
    ("", True, "empty"), ("  ", True, "empty"), ("plain English text", False, ""), ("(cid:1)(cid:22) text", True, "unmapped_characters"), ("a�", True, "unmapped_characters"),
    ("्लग ापन ेिए लग पन", True, "broken_indic_font"), ("लगन पनाने योजना किसान पेंशन", False, "")])
def test_quality(spark, text, garbled, reason):
    got = one(spark, T.assess_text(F.col("t")), t=text)
    assert (got.garbled, got.reason) == (garbled, reason)


def test_sentences_keep_abbreviations_together(spark):
    text = "He gets i.e. Rs.1500 a month. See No. 5 of U.S.A. law! • One\n\nTwo"
    assert one(spark, T.split_sentences(F.col("t")), t=text) == ["He gets i.e. Rs.1500 a month.", "See No. 5 of U.S.A.", "law!", "One", "Two"]


def test_evidence_joins_wrapped_lines(spark):
    assert one(spark, T.clean_evidence(F.col("t")), t="a wrapped\nline.\n point") == "a wrapped line.\n• point"


@pytest.mark.parametrize("text, expected", [("Rs.3,000/- and Rs.3000/ [3]", {"3000"}), ("1,500.00", {"1500"}), ("007", {"7"}), ("0", {"0"}), ("none [12]", set())])
def test_numbers(spark, text, expected):
    assert set(one(spark, T.numbers_in(F.col("t")), t=text)) == expected


def test_number_periods(spark):
    assert one(spark, T.number_periods(F.col("t")), t="Rs.3,000 monthly, 12 per  annum") == ["3000 per month", "12 per year"]


def test_set_citations(spark):
    assert one(spark, T.set_citations(F.col("t"), F.array(F.lit(2), F.lit(1))), t="It is so [7].") == "It is so [1][2]."


def test_escape_tags(spark):
    assert one(spark, T.escape_tags(F.col("t")), t="a </SOURCE>") == "a </SOURCE​>"


def test_keys(spark):
    assert one(spark, T.canonical_key(F.col("t")), t="  Straße_No. 5 ") == "strasse no 5"
    assert one(spark, T.normalize_name(F.col("t")), t=' "ABC   Corp." ') == "ABC Corp"
    assert one(spark, T.relation_type(F.col("t")), t=" works-for ") == "WORKS_FOR"


@pytest.mark.parametrize("kind, question, expected", [
    ("PRODUCES", "What does it produce?", True), ("WORKS_FOR", "who does he work for", True), ("MANAGED_BY", "Who manages it?", True), ("WORKS_FOR", "what does it produce", False)])
def test_verb_match(spark, kind, question, expected):
    assert one(spark, T.verb_match(F.col("k"), T.graph_tokens(F.col("q"))), k=kind, q=question) is expected


def test_graph_tokens(spark):
    assert one(spark, T.graph_tokens(F.col("t")), t="Who manages PM-KISAN?") == ["manages", "pm", "kisan"]


def pages(spark, *texts):
    return spark.createDataFrame([("doc1", k, k + 1, t) for k, t in enumerate(texts)], "document_id string, page_ord int, page_number int, text string")


def test_chunk_pages(spark):
    rows = chunking.chunk_pages(pages(spark, " ", "Short page."), 400, 60).collect()
    assert [(r.chunk_id, r.page_number, r.text) for r in rows] == [("doc1_chunk_0", 2, "Short page.")]
    many = chunking.chunk_pages(pages(spark, "This is a sentence. " * 100), 400, 60).orderBy("chunk_ord").collect()
    assert len(many) > 1 and all(len(r.text) <= 400 for r in many)
    words = [r.text for r in chunking.chunk_pages(pages(spark, "word " * 400), 300, 80).orderBy("chunk_ord").collect()]
    assert all(a[-20:].strip() in b for a, b in zip(words, words[1:]))
    with pytest.raises(ValueError):
        chunking.chunk_pages(pages(spark, "x"), 100, 100)


def test_paragraphs_come_first(spark):
    text = "a" * 60 + "\n\n" + "b. " + "c" * 60
    assert chunking.chunk_pages(pages(spark, text), 100, 10).orderBy("chunk_ord").first().text == "a" * 60
