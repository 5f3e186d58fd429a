"""Graph store in buckets against the graph built anew."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.operators.graph_store import SCHEMAS, GraphStore, index_documents
from lodestone.plans import catalogue

CHUNKS = "chunk_id string, document_id string, document_name string, page_number int, text string"
ENTITY = "chunk_id string, entity_id string, entity_name string, entity_type string, description string"
FACT = "chunk_id string, relationship_id string, source_id string, target_id string, type string, evidence string, confidence double"


def frames(spark, docs):
    """docs: document to a list of chunks, each a (list of entities, list of facts)."""
    chunks, entities, facts = [], [], []
    for d, parts in docs.items():
        for k, (named, told) in enumerate(parts):
            c = f"{d}-{k}"
            chunks.append((c, d, f"{d}.txt", k, "text"))
            entities += [(c, e, e, "Person", "x" * n) for e, n in named]
            facts += [(c, f"{s}>{t}", s, t, "USES", c, 0.9) for s, t in told]
    return [spark.createDataFrame(rows, schema) for rows, schema in ((chunks, CHUNKS), (entities, ENTITY), (facts, FACT))]


def naive(steps):
    """(entities with descriptions, mentions, edges, evidence) after all steps, by sets."""
    entities, mentions, edges, evidence = {}, set(), set(), set()
    for docs, parts in steps:
        touched = {e for e, c, d in mentions if d in docs} | {x for r in edges if any(q == r and d in docs for q, c, d in evidence) for x in r.split(">")}
        mentions = {m for m in mentions if m[2] not in docs}
        evidence = {v for v in evidence if v[2] not in docs}
        edges = {r for r in edges if any(q == r for q, _, _ in evidence)}
        used = {m[0] for m in mentions} | {x for r in edges for x in r.split(">")}
        entities = {e: n for e, n in entities.items() if e in used or e not in touched}
        best = {}
        for d, chunks in parts.items():
            for k, (named, told) in enumerate(chunks):
                c = f"{d}-{k}"
                mentions |= {(e, c, d) for e, _ in named}
                for e, n in named:
                    best[e] = max(best.get(e, 0), n)
                evidence |= {(f"{s}>{t}", c, d) for s, t in told}
                edges |= {f"{s}>{t}" for s, t in told}
        for e, n in best.items():
            entities[e] = max(entities.get(e, 0), n)
    return entities, mentions, edges, evidence


def state(own):
    t = own.tables()
    return ({r.entity_id: len(r.description) for r in t["entities"].collect()}, {(r.entity_id, r.chunk_id, r.document_id) for r in t["mentions"].collect()},
            {r.relationship_id for r in t["edges"].collect()}, {(r.relationship_id, r.chunk_id, r.document_id) for r in t["evidence"].collect()})


def documents(rng, names, things):
    pick = lambda: rng.choice(things)
    return {d: [([(e, rng.randint(0, 9)) for e in rng.sample(things, rng.randint(0, 2))], [(pick(), pick()) for _ in range(rng.randint(0, 2))]) for _ in range(rng.randint(1, 2))] for d in names}


@pytest.mark.parametrize("buckets", [1, 5])
def test_writes_agree_with_a_graph_built_by_sets(spark, tmp_path, buckets):
    rng = random.Random(buckets)
    own, steps = GraphStore(spark, f"file://{tmp_path}/g", buckets), []
    things, names = [f"e{k}" for k in range(9)], [f"d{k}" for k in range(6)]
    for step in range(5):
        if step == 2:
            gone = rng.sample(names, 3)
            own.remove(spark.createDataFrame([(d,) for d in gone], "document_id string"))
            steps.append((gone, {}))
        else:
            docs = documents(rng, rng.sample(names, 3), things)
            own.replace(*frames(spark, docs))
            steps.append((list(docs), docs))
        assert state(own) == naive(steps), step
    assert own.read("edges").columns == ["relationship_id", "source_id", "target_id", "type"]


def test_buckets_without_the_document_keep_their_files(spark, tmp_path):
    own = GraphStore(spark, f"file://{tmp_path}/g", 32)
    docs = {f"d{k}": [([(f"e{k}", 1)], [(f"e{k}", f"e{k}")])] for k in range(60)}
    own.replace(*frames(spark, docs))
    before = own.snapshot()
    own.replace(*frames(spark, {"d7": [([("e7", 1), ("new", 2)], [])]}))
    own.remove(spark.createDataFrame([("d9",)], "document_id string"))
    after = own.snapshot()
    for name in SCHEMAS:
        kept = set(before.of(name)) & set(after.of(name))
        assert len(before.of(name)) > 20 and len(set(before.of(name)) - kept) <= 3, name
    entities, _, edges, _ = state(own)
    assert set(entities) == {f"e{k}" for k in range(60) if k != 9} | {"new"} and edges == {f"e{k}>e{k}" for k in range(60) if k not in (7, 9)}
    own.set_status(spark.createDataFrame([("d7", "d7.txt", "failed")], "document_id string, document_name string, kg_status string"))
    assert len(set(after.of("documents")) - set(own.snapshot().of("documents"))) == 1
    assert {r.document_id for r in own.read("documents").where(F.col("kg_status") == "failed").collect()} == {"d7"}


def test_a_table_that_was_never_written_is_known_to_be_empty(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/graph")
    for name, rows in store.tables().items():
        assert rows.count() == 0 and rows.columns == [c.split()[0] for c in SCHEMAS[name].split(", ")]
        joined = spark.range(3).withColumn(rows.columns[0], F.lit("x")).join(rows, rows.columns[0], "left_anti")
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and joined.count() == 3


def test_rows_that_have_their_document_need_no_look_at_its_chunks(spark, tmp_path):
    docs = documents(random.Random(7), [f"d{k}" for k in range(5)], [f"e{k}" for k in range(6)])
    chunks, entities, facts = frames(spark, docs)
    facts = facts.unionByName(facts.withColumn("evidence", F.lit("z")))
    owned = lambda df: df.withColumn("document_id", F.substring_index("chunk_id", "-", 1))
    failed = chunks.where("chunk_id LIKE 'd3-%' OR chunk_id = 'd1-0'").select("chunk_id", F.lit("x").alias("error"))
    left = lambda df: df.join(failed, "chunk_id", "left_anti")
    got = []
    for own in (lambda df: df, owned):
        store = GraphStore(spark, f"file://{tmp_path}/g{len(got)}", 4)
        told = {"entities": own(left(entities)), "relationships": own(left(facts)), "errors": own(failed), "rejected": own(failed.limit(1))}
        status = {r.document_id: r.asDict() for r in index_documents(store, chunks, lambda _, told=told: told).collect()}
        got.append((status, state(store), sorted(map(str, store.read("evidence").collect()))))
    assert got[0] == got[1] and got[0][0]["d3"]["kg_status"] == "failed" and got[0][0]["d0"]["kg_status"] == "done" and got[0][1][1]
    plan = lambda own: graph.relationship_rows(own(facts), chunks)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan(lambda df: df) and "Join Inner" not in plan(owned)


def test_what_is_said_of_an_order_grows_with_the_orders_of_customers_of_one_name(spark, tmp_path, monkeypatch):
    day = "TIMESTAMP '199{}-05-01'".format
    tables = {
        "region": spark.sql("SELECT 0 AS r_regionkey, 'ASIA' AS r_name"), "nation": spark.sql("SELECT 0 AS n_nationkey, 'N' AS n_name, 0 AS n_regionkey"),
        "customer": spark.range(12).selectExpr("id AS c_custkey", "'Same' AS c_name", "0 AS c_nationkey"),
        "orders": spark.range(60).selectExpr("id AS o_orderkey", "id % 12 AS o_custkey", f"CASE WHEN id % 3 = 0 THEN {day(4)} WHEN id % 3 = 1 THEN {day(5)} ELSE {day(6)} END AS o_orderdate", "'LOW' AS o_orderpriority")}
    for name, rows in tables.items():
        rows.write.parquet(f"file://{tmp_path}/{name}.parquet")
    said, index = {}, catalogue.index_documents

    def counted(store, chunks, extract):
        said.update({name: rows.count() for name, rows in extract(chunks).items()})
        return index(store, chunks, extract)

    monkeypatch.setattr(catalogue, "index_documents", counted)
    got = {tuple(r) for r in catalogue.graph_indexing(spark, f"file://{tmp_path}").collect()}
    assert got == {("1994", "partial", 20, 2, True), ("1995", "failed", None, None, True), ("1996", "done", 20, 0, False)}
    assert said == {"entities": 38, "relationships": 38, "errors": 22, "rejected": 0}


def test_documents_of_chunks_are_counted_without_a_sort_of_the_chunks(spark):
    rows = [("a", "x"), ("a", "y"), ("a", None), ("b", None), (None, "z"), ("a", "x")]
    chunks = spark.createDataFrame(rows, "document_id string, document_name string")
    got = graph.documents_of(chunks)
    assert {tuple(r) for r in got.collect()} == {("a", "y", 4), ("b", None, 1), (None, "z", 1)}
    plan = got._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert "HashAggregate" in plan[-2] and not any("Sort" in line for line in plan[-3:])
