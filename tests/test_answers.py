import json
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestone.operators import evaluate, extract, graph
from lodestone.plans import answer

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import a test module
CHUNKS = [("c0", "The PM-KMY scheme pays a pension of Rs.3,000 per month to farmers. Farmers join at the age of eighteen."), ("c1", "Something else that is about cities and not about money.")]


class Scripted:
    """Answers by what the prompt holds."""

    def complete_json(self, system, user):
        if "broken" in user:
            return "no json"
        if "extract" in system:
            return json.dumps({"entities": [{"name": "PM-KMY", "type": "scheme"}, {"name": "Mars", "type": "Location"}, {"name": "Farmers", "type": "Concept", "description": "people"}],
                               "relationships": [{"source": "Farmers", "target": "PM-KMY", "type": "eligible for", "evidence": "The PM-KMY scheme pays a pension of Rs.3,000 per month to farmers", "confidence": "0.9"}, {"source": "Farmers", "target": "Mars", "type": "USES", "evidence": "x"}]})
        return json.dumps({"answer": "It pays Rs.3,000 per month [1]. It also pays 77 [1].", "coverage": "full"})


def test_answer(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, text string")
    asked = spark.createDataFrame([(0, "What pension does PM-KMY pay to farmers?"), (1, "hello"), (2, "zzzz qqqq xxxx"), (3, "broken PM-KMY scheme pension?")], "query_id long, question string")
    got = {r.query_id: r for r in answer.answer(chunks, asked, Scripted, "answer").collect()}
    assert got[0].answer == "It pays Rs.3,000 per month [1]." and got[0].grounded and got[0].supported == 1 and got[0].unsupported == 1
    assert got[0].refs == [1] and got[0].regenerated and got[0].counters["context_sources"] == 2 and any("removed" in n for n in got[0].notes)
    assert got[1].message.startswith("Hello") and got[2].insufficient_evidence and got[2].refs == [] and got[2].notes
    assert got[1].category == "chit_chat" and got[1].answer is None
    assert got[2].answer.startswith("I don't have enough") and got[3].answer.startswith("I don't have enough")


def test_extract_graph(spark):
    chunks = spark.createDataFrame([*CHUNKS[:1], ("c2", "broken text"), ("c3", " ")], "chunk_id string, text string")
    found = extract.extract_graph(chunks, Scripted, "extract", pause=0.0)
    assert {(r.name_key, r.entity_type) for r in found["entities"].collect()} == {("pm kmy", "Scheme"), ("farmers", "Concept")}
    assert [(r.type, r.confidence) for r in found["relationships"].collect()] == [("ELIGIBLE_FOR", 0.9)]
    assert {r.reason for r in found["rejected"].collect()} == {"name_not_found_in_chunk", "endpoint_not_a_valid_entity"}
    assert [r.chunk_id for r in found["errors"].collect()] == ["c2"]
    assert extract.stats(found, chunks).first().asDict() == {"chunks": 3, "failed_chunks": 1, "entities": 2, "relationships": 1, "rejected": 2}


def banners(spark, **given):
    base = dict(allowed=True, category="ok", insufficient=False, coverage="full", answer="x", question_subject=None, sources_subject=None, removed=0, corrected=0, regenerated=False, grounded=True, n_sources=2, verified=False)
    row = spark.range(1).select(evaluate.status_banners(**{k: F.lit(v) if v is not None else F.lit(None).cast("string") for k, v in {**base, **given}.items()})).first()[0]
    return [(b.kind, b.message) for b in row]


def test_banners(spark):
    assert banners(spark) == [("success", "Based on 2 source(s).")]
    assert [k for k, _ in banners(spark, corrected=1, verified=True)] == ["info", "success"]
    assert [k for k, _ in banners(spark, removed=1, regenerated=True)] == ["warning", "info"]
    assert banners(spark, insufficient=True) == [("warning", "The uploaded documents don't contain enough information to answer this.")]
    assert banners(spark, allowed=False, category="prompt_injection") == [("error", "Not processed: prompt injection.")] and banners(spark, allowed=False, category="chit_chat") == []
    assert [k for k, _ in banners(spark, coverage="mentioned_only", answer="Note: the uploaded documents are")] == ["success"]


def test_badges_status_and_backlog(spark):
    assert spark.range(1).select(evaluate.retriever_badges(F.array(F.lit("bm25"), F.lit("new")))).first()[0] == ":green-badge[Keyword] :gray-badge[new]"
    assert spark.range(1).select(evaluate.source_heading(F.lit(1), F.lit(""), F.lit("a.pdf"))).first()[0] == "[1] a.pdf"
    registry = spark.createDataFrame([("A",), ("B",), ("C",)], "document_id string")
    status = spark.createDataFrame([("A", "done"), ("B", "partial")], "document_id string, kg_status string")
    assert sorted(r.document_id for r in graph.backlog(registry, status).collect()) == ["B", "C"] and graph.backlog(registry, status, force=True).count() == 3
    got = spark.createDataFrame([(0, 0), (2, 2), (2, 1), (2, 0)], "c int, f int").select(graph.index_status(F.col("c"), F.col("f"))).collect()
    assert [r[0] for r in got] == ["skipped", "failed", "partial", "done"]
    m = spark.createDataFrame([("e1", "c1", "A"), ("e1", "c2", "A")], "entity_id string, chunk_id string, document_id string")
    e = spark.createDataFrame([("r1", "c1", "A")], "relationship_id string, chunk_id string, document_id string")
    assert {r.document_id: (r.entities, r.chunks, r.relationships) for r in graph.document_status(registry, m, e).collect()} == {"A": (1, 2, 1), "B": (0, 0, 0), "C": (0, 0, 0)}
