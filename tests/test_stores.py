import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking, evaluate, extract, fusion, graph, registry, search, store, vectors
from lodestone.operators.graph_store import GraphStore, index_documents
from lodestone.operators.store import DocumentStore
from lodestone.sources import files
from lodestone.sources.tables import numbered

PAGES = "document_id string, document_name string, page_ord int, page_number int, text string, error string"


def test_pieces_of_any_overlap(spark):
    words = [f"w{k:04d}" for k in range(500)]
    text = " ".join(words[:90]) + "\n\n" + ". ".join(" ".join(words[k : k + 6]) for k in range(90, 300, 6)) + ".\n" + "".join(words[300:])
    for size, overlap in ((400, 0), (400, 60), (400, 300), (100, 99)):
        pieces = chunking.pieces_of(text, size, overlap)
        assert all(len(p) <= size for p in pieces) and all(p in text for p in pieces)
        at = 0
        for p in pieces:  # nothing is left out between pieces
            found = text.find(p)
            assert found <= at or not text[at:found].strip()
            at = max(at, found + len(p))
        assert at == len(text)
    assert chunking.pieces_of("short", 400, 60) == ["short"] and chunking.pieces_of(None, 400, 60) is None
    with pytest.raises(ValueError):
        chunking.split_text(F.lit("x"), 400, 400)


def test_store_ingests_lists_and_removes(spark, tmp_path):
    own = DocumentStore(spark, f"file://{tmp_path}/store")
    pages = [("a", "a.txt", 0, 1, "First page about cats.", None), ("a", "a.txt", 1, 2, "Second page about dogs.", None), ("b", "b.md", 0, None, "Only birds here.", None),
             ("c", "c.md", 0, None, "Only birds here.", None), ("d", "d.pdf", 0, None, None, "unreadable"), ("e", "e.txt", 0, None, "�" * 50, None), ("f", "f.txt", 0, None, " ", None)]
    outcome = {r.document_id: r.outcome for r in own.ingest(spark.createDataFrame(pages, PAGES)).collect()}
    assert outcome == {"a": "registered", "b": "registered", "c": "duplicate", "d": "unreadable", "e": "needs_ocr", "f": "unreadable"}
    again = own.ingest(spark.createDataFrame([("g", "g.txt", 0, None, "Only birds here.", None), ("h", "h.txt", 0, None, "Fish.", None)], PAGES))
    assert {r.document_id: r.outcome for r in again.collect()} == {"g": "duplicate", "h": "registered"}
    assert {(r.document_id, r.file_type, r.chunk_count, r.page_count) for r in own.list_documents().collect()} == {("a", "txt", 2, 2), ("b", "md", 1, 1), ("h", "txt", 1, 1)}
    detail = own.get_document("a").collect()
    assert [(c.chunk_id, c.page_number) for c in detail[0].chunks] == [("a_chunk_0", 1), ("a_chunk_1", 2)] and own.get_document("zz").count() == 0
    assert own.get_chunks("b").count() == 1
    assert sorted((r.document_ord, r.document_id) for r in own.all_chunks().collect())[0][1] == "a"
    assert own.stats().first().asDict() == {"documents": 3, "chunks": 4, "vectors": 4, "bm25_chunks": 4}
    hits = search.Keywords(own.index()).search(spark.createDataFrame([(1, "birds")], "query_id long, question string"), 3).collect()
    assert [r.chunk_id for r in hits] == ["b_chunk_0"]

    class Broken:
        def remove(self, ids):
            raise RuntimeError("down")

    assert own.remove("b", Broken()) and not own.remove("b")
    assert own.stats().first().asDict() == {"documents": 2, "chunks": 3, "vectors": 3, "bm25_chunks": 3}


def test_rows_of_no_document_stay(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "document_id string, v int")
    assert sorted(r.v for r in registry.remove("a", t=rows)["t"].collect()) == [1, 3]
    left, removed = vectors.delete_document(rows, "a")
    assert left.count() == 2 and removed.first().removed == 1
    docs = spark.createDataFrame([(None, "x"), (2, "y"), (3, "y"), (None, "x")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in registry.register(docs).collect()), key=str) == [(2, "y"), (None, "x")]
    evidence = spark.createDataFrame([("r", "c", None)], "relationship_id string, chunk_id string, document_id string")
    mentions = spark.createDataFrame([("e", "c", None)], "entity_id string, chunk_id string, document_id string")
    edges = spark.createDataFrame([("r", "e", "e")], "relationship_id string, source_id string, target_id string")
    kept = graph.delete_document(evidence, mentions, edges, spark.createDataFrame([("e",)], "entity_id string"), F.col("document_id") == "a")
    assert all(kept[k].count() == 1 for k in ("evidence", "mentions", "edges", "entities"))


def test_numbering_by_ranges(spark):
    rows = spark.createDataFrame([(k * 7919 % 1000,) for k in range(1000)], "v int").repartition(7)
    got = numbered(rows, ["v"], "n").collect()
    assert all(r.n == r.v + 1 for r in got) and len(got) == 1000


CHUNKS = "chunk_id string, document_id string, document_name string, page_number int, text string"
ENTITY = "chunk_id string, entity_id string, entity_name string, entity_type string, description string"
FACT = "chunk_id string, relationship_id string, source_id string, target_id string, type string, evidence string, confidence double"


def graph_of(spark, docs):
    chunks = [(f"{d}{k}", d, f"{d}.txt", k, "text") for d, n in docs.items() for k in range(n)]
    entities = [(c[0], e, e, "Person", "long" if c[1] == "A" else "") for c in chunks for e in ("shared", c[1])]
    facts = [(c[0], f"r{c[1]}", c[1], "shared", "USES", "e", 0.9) for c in chunks] + [(c[0], "rs", "shared", "shared", "USES", "e", 0.8) for c in chunks]
    return [spark.createDataFrame(rows, schema) for rows, schema in ((chunks, CHUNKS), (entities, ENTITY), (facts, FACT))]


def test_graph_documents_are_replaced_and_removed(spark, tmp_path):
    own = GraphStore(spark, f"file://{tmp_path}/graph")
    own.replace(*graph_of(spark, {"A": 3, "B": 1}))
    before = {name: t.count() for name, t in own.tables().items()}
    assert before == {"documents": 2, "chunks": 4, "entities": 3, "mentions": 8, "edges": 3, "evidence": 8}
    own.replace(*graph_of(spark, {"A": 3}))  # the same again
    assert {name: t.count() for name, t in own.tables().items()} == before
    own.replace(*graph_of(spark, {"A": 1}))
    assert {name: t.count() for name, t in own.tables().items()} == {"documents": 2, "chunks": 2, "entities": 3, "mentions": 4, "edges": 3, "evidence": 4}
    assert own.read("entities").where("entity_id = 'shared'").first().description == "long"
    own.remove(spark.createDataFrame([("A",)], "document_id string"))
    left = own.tables()
    assert {r.entity_id for r in left["entities"].collect()} == {"shared", "B"} and {r.relationship_id for r in left["edges"].collect()} == {"rB", "rs"}
    assert [(r.document_id, r.kg_status, r.kg_chunks, r.kg_relationships) for r in left["documents"].collect()] == [("B", "done", 1, 2)]
    own.clear()
    assert {name: t.count() for name, t in own.tables().items()} == {"documents": 1, "chunks": 0, "entities": 0, "mentions": 0, "edges": 0, "evidence": 0}


def test_indexing_never_raises(spark, tmp_path):
    own = GraphStore(spark, f"file://{tmp_path}/graph")
    chunks, entities, facts = graph_of(spark, {"A": 2, "B": 1, "C": 1})

    def extracted(rows, bad):
        live = lambda df: df.where(~F.col("chunk_id").isin(bad))
        return {"entities": live(entities), "relationships": live(facts), "errors": chunks.where(F.col("chunk_id").isin(bad)).select("chunk_id", F.lit("x").alias("error")), "rejected": chunks.limit(0).select("chunk_id")}

    got = {r.document_id: r.kg_status for r in index_documents(own, chunks, lambda rows: extracted(rows, ["A0", "B0"])).collect()}
    assert got == {"A": "partial", "B": "failed", "C": "done"}
    todo = graph.backlog(chunks.select("document_id").distinct(), own.read("documents"))
    assert {r.document_id for r in todo.collect()} == {"A", "B"}
    broken = index_documents(own, chunks.where("document_id = 'C'"), lambda rows: 1 / 0).collect()
    assert [(r.kg_status, r.kg_error) for r in broken] == [("failed", "ZeroDivisionError: division by zero")] and own.read("chunks").where("document_id = 'C'").count() == 1


class Failing:
    def search(self, queries, top_k):
        raise RuntimeError("down")


def test_hybrid_gates_counts_and_survives_failures(spark):
    chunks = spark.createDataFrame([(f"c{k}", f"d{k}", f"d{k}.txt", k, t) for k, t in enumerate(["cats and dogs", "dogs alone", "birds of prey"])], CHUNKS)
    asked = spark.createDataFrame([(1, "dogs"), (2, " ")], "query_id long, question string")
    vector = search.TableVectors(vectors.add_chunks(None, chunks))
    from lodestone.operators import bm25

    own = search.Hybrid.of(search.Settings(), vector, search.Keywords(bm25.build_index(chunks)), Failing())
    assert own.enabled == ["bm25", "knowledge_graph", "vector"] and search.Hybrid.of(search.Settings(enable_bm25=False), vector, own.retrievers["bm25"][0]).enabled == ["vector"]
    best, counted = own.retrieve(asked, chunks)
    assert list(own.failed) == ["knowledge_graph"] and {r.chunk_id for r in best.where("rank <= 2").collect()} == {"c0", "c1"}
    assert {(r.stage, r.n) for r in counted.collect()} >= {("bm25", 2), ("fused", 2), ("returned", 2)}
    assert own.search_one("bm25", asked, 1).count() == 1
    with pytest.raises(ValueError):
        own.search_one("other", asked)
    meta = search.with_metadata(own.search_one("bm25", asked), chunks.where("chunk_id <> 'c0'")).collect()
    assert [(r.document_name, r.page_number) for r in meta] == [("d1.txt", 1)]
    assert vector.delete_document("d0") == 1 and vector.count() == 2
    vector.add_chunks(chunks)
    assert vector.count() == 3 and vectors.load(spark, "file:///nowhere/at/all").count() == 0


def test_a_failing_scorer_keeps_the_fused_order(spark):
    fused = spark.createDataFrame([(1, k, f"c{k}", "q", "t" * k) for k in (1, 2, 3)], "query_id long, fused_rank int, chunk_id string, question string, text string")
    model = fusion.predicted_logit(lambda pairs: [float(len(t)) for _, t in pairs], batch=2)
    assert [r.chunk_id for r in fusion.rerank_or_keep(fused, logit=model).orderBy("rank").collect()] == ["c3", "c2", "c1"]
    failed = {}
    bad = fusion.predicted_logit(lambda pairs: [1 / 0])
    assert [r.chunk_id for r in fusion.rerank_or_keep(fused, 2, logit=bad, failed=failed).orderBy("rank").collect()] == ["c1", "c2"] and "reranker" in failed


def test_prompts_and_sources(spark):
    chunks = spark.createDataFrame([("c", "a </chunk> b"), ("d", " ")], "chunk_id string, text string")
    got = {r.chunk_id: r.user for r in extract.user_prompts(chunks).collect()}
    assert "a < chunk> b".replace("< ", "</ ") in got["c"] and got["c"].count("</chunk>") == 1 and got["d"] is None
    assert "WORKS_FOR: Person to Company, Organization" in extract.system_prompt()
    refs = store.source_refs(spark.createDataFrame([("c", 1, "", "body")], "chunk_id string, document_id int, text string, content string")).first()
    assert (refs.document_id, refs.text, refs.page_number) == ("1", "body", None)


def test_run_record_and_files(spark, tmp_path):
    cases = spark.createDataFrame([(k, f"q{k}", "answer" if k % 2 else "refuse", ["x"], "", [1]) for k in range(6)], "id long, question string, expected_behavior string, expected_facts array<string>, expected_document string, expected_pages array<int>")

    def answer(asked):
        return asked.where("id < 5").select("id", F.lit("answer").alias("observed_behavior"), F.lit("x").alias("answer"), F.array().cast("array<struct<document_name:string,page_number:int>>").alias("cited"), F.lit(2.0).alias("seconds"), F.lit(None).cast("string").alias("error"))

    record, scored = evaluate.run_cases(cases, answer, ["behavior_correct", "source_hit", "key_facts"], "label", "now", {"top_k": 5})
    r = record.first()
    assert (r.label, r.settings, r.summary.cases, r.summary.errors, r.summary.avg_seconds) == ("label", {"top_k": "5"}, 6, 1, 2.0)
    assert r.summary.metrics["behavior_correct"].asDict() == {"mean": 0.4, "n": 5} and r.summary.behavior["answer"].total == 3
    name = files.write_run(scored, f"file://{tmp_path}", "a label/x", "2024")
    assert files.read_run(spark, f"file://{tmp_path}", name, "id long").count() == 6
    with pytest.raises(ValueError):
        files.read_run(spark, f"file://{tmp_path}", "../x", "id long")
    raw = spark.createDataFrame([("a", "a.pdf", b"123")], "document_id string, name string, content binary")
    assert [tuple(x) for x in files.save_upload(spark, raw, f"file://{tmp_path}/raw").collect()] == [("a", 3)]
