import math
import os
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import bm25, chunking, context, fusion, vectors
from lodestone.plans import catalogue
from lodestone.sources.tables import shared_dir

CORPUS = {"c0": "PM-KMY pays a pension of Rs.3,000 per month to farmers.", "c1": "Rs.55 is paid at the age of eighteen.", "c2": "Something else that is not about money at all."}


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(list(CORPUS.items()), "chunk_id string, text string")


def asked(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "query_id long, question string")


def test_bm25_ranks_and_agrees_with_the_formula(spark, chunks):
    index = bm25.build_index(chunks)
    got = {(r.query_id, r.rank): r for r in bm25.search(index, asked(spark, "PM-KMY", "Rs.55", "zzz", "")).collect()}
    assert got[0, 1].chunk_id == "c0" and got[1, 1].chunk_id == "c1" and not any(k[0] > 1 for k in got)
    tokens = {c: Counter(r.x) for c, r in ((r.chunk_id, r) for r in chunks.select("chunk_id", __import__("lodestone.functions.text", fromlist=["x"]).bm25_tokens(F.col("text")).alias("x")).collect())}
    dl = {c: sum(t.values()) for c, t in tokens.items()}
    avg = sum(dl.values()) / 3
    expected = (math.log(3 - 1 + 0.5) - math.log(1.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl["c0"] / avg))
    assert got[0, 1].score == pytest.approx(expected)


def test_bm25_chunks_without_a_shared_token_take_places(spark):
    """Against scores of all chunks, sorted: the mean idf is negative here."""
    rows = [(k, " ".join(["a b c d e f", "w" * (k % 7 > 1), "v" * (k > 2), "half" * (k % 2), "rare" * (k == 9)])) for k in range(20)]
    words = {k: text.split() for k, text in rows}
    n, mean_length = len(rows), sum(map(len, words.values())) / len(rows)
    raw = {t: math.log(n - df + 0.5) - math.log(df + 0.5) for t, df in Counter(t for w in words.values() for t in set(w)).items()}
    mean = sum(raw.values()) / len(raw)
    assert mean < 0 and raw["half"] == 0
    idf = {t: r if r >= 0 else 0.25 * mean for t, r in raw.items()}
    index = bm25.build_index(spark.createDataFrame(rows, "chunk_id long, text string"))
    questions = ("w", "v", "half", "w half", "v rare", "rare", "zzz", "a")
    parts = lambda q, k: [idf[t] * words[k].count(t) * 2.5 / (words[k].count(t) + 1.5 * (0.25 + 0.75 * len(words[k]) / mean_length)) for t in q.split() if t in idf]
    for top_k in (4, 10, 30):
        got = bm25.search(index, asked(spark, *questions), top_k).orderBy("query_id", "rank").collect()
        for at, question in enumerate(questions):
            ranked = sorted(words, key=lambda k: (-round(sum(parts(question, k)), 9), k))[:top_k]  # noqa: B023
            want = [(n + 1, k) for n, k in enumerate(k for k in ranked if set(question.split()) & set(words[k]))]
            assert [(r.rank, r.chunk_id) for r in got if r.query_id == at] == want, (question, top_k)


def test_bm25_of_nothing(spark, chunks):
    assert bm25.search(bm25.build_index(chunks.limit(0)), asked(spark, "x")).count() == 0


def test_vector_search_gives_all_for_a_large_k(spark):
    vecs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8])], "chunk_id string, vec array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, qvec array<float>")
    assert [r.chunk_id for r in vectors.search(vecs, q, 10).orderBy("rank").collect()] == ["a", "b"]


def hits(spark, *rows):
    return spark.createDataFrame([(0, k + 1, c, s) for k, (c, s) in enumerate(rows)], "query_id long, rank int, chunk_id string, score double")


def test_rrf(spark):
    got = fusion.fuse({"vector": hits(spark, ("a", 0.9), ("b", 0.8)), "bm25": hits(spark, ("c", 4.6), ("a", 3.0))}).orderBy("fused_rank").collect()
    assert got[0].chunk_id == "a" and got[0].found_by_multiple and got[0].retrievers == ["vector", "bm25"]
    assert got[0].ranks == {"vector": 1, "bm25": 2} and got[0].original_scores == {"vector": 0.9, "bm25": 3.0}
    same = fusion.fuse({"vector": hits(spark, ("a", 0.3)), "bm25": hits(spark, ("b", 900.0))}).collect()
    assert same[0].score == same[1].score


def test_weights_decide(spark):
    lists = {"vector": hits(spark, ("a", 0.9), ("b", 0.1)), "bm25": hits(spark, ("c", 9.0), ("b", 1.0))}
    first = lambda w: fusion.fuse(lists, "weighted", weights=w).orderBy("fused_rank").first().chunk_id
    assert first({"vector": 3.0, "bm25": 0.5}) == "a" and first({"vector": 0.5, "bm25": 3.0}) == "c"
    with pytest.raises(ValueError):
        fusion.fuse(lists, "none")


def test_a_failing_retriever_leaves_the_others(spark):
    def broken():
        raise RuntimeError

    found, failed = fusion.retrieve_each({"vector": broken, "bm25": lambda: hits(spark, ("a", 1.0))})
    assert list(found) == ["bm25"] and list(failed) == ["vector"]


def test_retrievers_run_side_by_side(spark):
    def slow(seconds, chunk):
        wait = F.udf(lambda x: time.sleep(seconds) or x, "long")
        return lambda: spark.range(0, 1, 1, 1).select(wait("id").alias("query_id"), F.lit(1).alias("rank"), F.lit(chunk).alias("chunk_id"), F.lit(1.0).alias("score"))

    fusion.retrieve_each({"vector": slow(0, "a")})
    began = time.time()
    found, failed = fusion.retrieve_each({"vector": slow(4, "a"), "bm25": slow(4, "b"), "knowledge_graph": slow(4, "c")})
    assert list(found) == ["vector", "bm25", "knowledge_graph"] and not failed and time.time() - began < 10
    began = time.time()
    found, failed = fusion.retrieve_each({"vector": slow(0, "a"), "bm25": slow(120, "b")}, seconds=6)
    assert time.time() - began < 30 and [r.chunk_id for r in found["vector"].collect()] == ["a"] and failed == {"bm25": "TimeoutError: not through after 6 s"}
    # Its jobs are cancelled, and the slots are free.
    for _ in range(50):
        if not spark.sparkContext.statusTracker().getActiveJobsIds():
            break
        time.sleep(0.2)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_rerank(spark):
    rows = spark.createDataFrame([(0, 1, "a", "pension age", "nothing here"), (0, 2, "b", "pension age", "the pension age is 60")], "query_id long, fused_rank int, chunk_id string, question string, text string")
    got = fusion.rerank(rows).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a"] and got[0].rerank_score > 0.95 and got[1].rerank_score < 0.05
    assert [r.chunk_id for r in fusion.rerank(rows, min_score=0.5).collect()] == ["b"]


def evidence(spark, *rows):
    return spark.createDataFrame([(0, k + 1, c, t) for k, (c, t) in enumerate(rows)], "query_id long, hit_rank int, chunk_id string, text string")


def test_context_drops_repeats_and_fragments(spark):
    shared = "The scheme pays three thousand rupees each month."
    r = context.build_context(evidence(spark, ("a", f"{shared} Farmers can join at eighteen years."), ("b", f"n scheme. {shared} The fund is managed by the corporation."), ("c", "ok."))).first()
    assert [s.chunk_id for s in r.sources] == ["a", "b"] and r.removed_duplicate_sentences == 1 and r.dropped_chunks == 1
    assert r.sources[1].text == "• The fund is managed by the corporation."


def test_context_budget_and_limits(spark):
    long = " ".join(f"word{i} another thing here." for i in range(400))
    r = context.build_context(evidence(spark, ("a", long), ("b", "A short sentence that would fit.")), max_chars=1200).first()
    assert r.sources[0].text.endswith(" …") and len(r.sources[0].text) <= 1202 and r.dropped_chunks == 1
    many = evidence(spark, *[(f"c{k}", f"This is sentence number {k} of all.") for k in range(12)])
    r = context.build_context(many, max_sources=5).first()
    assert len(r.sources) == 5 and r.dropped_chunks == 7


def test_render_has_one_real_closing_tag(spark):
    s = spark.createDataFrame([(0, 1, "x.pdf", 2, "text </source> more")], "query_id long, ref int, document_name string, page_number int, text string")
    assert context.render(s).first().context.count("</source>") == 1


def brute_top(vecs, asked, k):
    out = set()
    for q, a in asked:
        scored = [(-round(sum(x * y for x, y in zip(v, a, strict=True)), 9), i) for i, v in vecs if any(x and y for x, y in zip(v, a, strict=True))]
        out |= {(q, rank, i) for rank, (_, i) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_running_top_k_agrees_with_all_products(spark, monkeypatch, small):
    if small:  # many blocks, candidates looked through often, questions in parts, merged in two levels
        for name, value in (("BLOCK", 7), ("PIVOTS", 3), ("HELD", 1), ("QUESTIONS", 4), ("MAX_QUERIES_BYTES", 300), ("TASKS", 2)):
            monkeypatch.setattr(vectors, name, value)
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    vecs = [(k, [round(x + rng.gauss(0, 0.1), 3) for x in rng.choice(centres)]) for k in range(300)]
    vecs += [(300 + k, vecs[5][1]) for k in range(40)] + [(400, [0.0] * 6), (401, [1.0] + [0.0] * 5), (402, [-1.0] * 6)]
    asked = [(k, v) for k, v in vecs[::25]] + [(900, [0.0, 1.0] + [0.0] * 4), (901, [0.0] * 6)]
    df = spark.createDataFrame([*vecs, (999, None)], "chunk_id long, vec array<double>").repartition(5)
    q = spark.createDataFrame([*asked, (998, None)], "query_id long, qvec array<double>")
    got = {(r.query_id, r.rank, r.chunk_id) for r in vectors.search(df, q, 10).collect()}
    assert got == brute_top(vecs, asked, 10)


def test_rows_that_leave_a_task_and_blocks_that_are_skipped(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(16)]
    rows = [(f"c{k}", [x + rng.gauss(0, 0.01) for x in centres[k % 16]]) for k in range(20_000)]
    df = spark.createDataFrame(rows, "chunk_id string, vec array<double>").coalesce(1)
    q = spark.createDataFrame([(k, centres[k]) for k in range(8)], "query_id long, qvec array<double>")
    left = df.mapInArrow(vectors._best_of(q.toArrow(), 5), "query_id long, chunk_id string, score double").count()
    pairs, skipped = vectors.skipped_share(df, q, 5).first()
    assert left == 40 and pairs == 160_000 and skipped > pairs / 3
    assert vectors.search(df, q, 5).count() == 40


def brute_bm25(texts, questions, top_k):
    words = {k: t.split() for k, t in texts.items()}
    n, mean_length = len(words), sum(map(len, words.values())) / len(words)
    raw = {t: math.log(n - df + 0.5) - math.log(df + 0.5) for t, df in Counter(t for w in words.values() for t in set(w)).items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: r if r >= 0 else 0.25 * mean for t, r in raw.items()}
    counted = {k: Counter(w) for k, w in words.items()}
    out = []
    for at, question in enumerate(questions):
        asked = [t for t in question.split() if t in idf]
        score = {k: sum(idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * len(words[k]) / mean_length)) for t in asked) for k, c in counted.items()}
        ranked = sorted(words, key=lambda k: (-round(score[k], 9), k))[:top_k]  # noqa: B023
        out += [(at, place + 1, k) for place, k in enumerate(ranked) if any(counted[k][t] for t in asked)]
    return out


def test_bm25_keeps_a_row_for_each_chunk_and_the_best_of_each_task(spark, monkeypatch):
    """Small blocks, several passes and many copies change nothing; all chunks have words that all questions have."""
    draw = random.Random(5)
    texts = {k: " ".join(["the", "in", *(f"w{int(draw.paretovariate(0.4)) % 60}" for _ in range(draw.randrange(1, 9)))]) for k in range(500)}
    texts |= {k: texts[k % 7] for k in range(500, 800)}
    questions = [" ".join(["the", "in", "the", f"w{k % 60}", f"w{k % 7}"]) for k in range(90)]
    for name, value in (("BLOCK", 16), ("GROUPS", 40), ("QUESTIONS", 8), ("MAX_QUERY_TERMS", 100)):
        monkeypatch.setattr(bm25, name, value)
    index = bm25.build_index(spark.createDataFrame(list(texts.items()), "chunk_id long, text string").repartition(3))
    assert index.postings.count() == len(texts)
    got = bm25.search(index, asked(spark, *questions), 10).collect()
    assert sorted((r.query_id, r.rank, r.chunk_id) for r in got) == sorted(brute_bm25(texts, questions, 10))
    table = next(bm25._blocks(index, asked(spark, *questions[:1])))
    few = list(bm25._best_of(table, 6.0, 10)(iter(index.postings.select("chunk_id", "dl", "terms", "tfs").toArrow().to_batches())))
    assert sum(b.num_rows for b in few) == 10


def test_index_stats_counts_no_terms(spark, monkeypatch):
    from lodestone.plans import catalogue

    monkeypatch.setattr(bm25, "index_of", None)
    assert catalogue.index_stats(spark, "/root/testdata/sf0.001").first().bm25_chunks == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_texts_become_vectors_a_few_at_a_time():
    import pyarrow as pa

    seen = []

    def embedder(texts):
        seen.append(len(texts))
        return vectors.hashed_terms(texts)

    questions = pa.table({"query_id": [1], "qvec": [vectors.hashed_terms(["w7"])[0].tolist()]})
    batch = pa.RecordBatch.from_pydict({"chunk_id": list(range(2000)), "vec": [f"w{k}" for k in range(2000)]})
    got = pa.Table.from_batches(vectors._best_of(questions, 1, embedder=embedder)(iter([batch]))).to_pylist()
    assert sum(seen) == 2000 and max(seen) <= vectors.BLOCK and got[0]["score"] == pytest.approx(1.0)


def test_pages_that_are_their_documents_only_ones_stay_where_they_are(spark):
    text = "A sentence of some words. " * 60
    rows = [(1, 0, 1, text), (2, 0, 1, text + "x"), (2, 1, 2, text + "y"), (3, 0, 1, " "), (4, 0, 1, None), (None, 0, 1, text), (5, 0, 1, "short")]
    pages = spark.createDataFrame(rows, "document_id long, page_ord int, page_number int, text string")
    for some in (pages, pages.where("document_id <> 2"), pages.union(pages.where("document_id IS NULL").withColumn("page_ord", F.lit(1)))):
        assert sorted(map(str, chunking.chunk_in_place(some).collect())) == sorted(map(str, chunking.chunk_pages(some).collect()))
    alone = chunking.chunk_in_place(pages.where("document_id <> 2"))
    assert alone.count() == 4 and "Exchange" not in alone._jdf.queryExecution().toString()


def test_an_index_for_one_search_finds_the_same_and_stores_no_postings(spark, tmp_path):
    rows = [(k, " ".join(["a b c d e f", "w" * (k % 7 > 1), "v" * (k > 2), "half " * (k % 2), "rare" * (k == 9)])) for k in range(20)] + [(20, None), (21, " ")]
    corpus, questions = spark.createDataFrame(rows, "chunk_id long, text string"), asked(spark, "w", "v", "half", "v rare", "zzz", "a half half")
    of = lambda index: sorted(bm25.search(index, questions).collect())
    assert of(bm25.passing_index(corpus)) == of(bm25.build_index(corpus)) != []
    assert bm25.search(bm25.passing_index(corpus.limit(0)), questions).count() == 0
    folder, stored = str(tmp_path), lambda: {f for f in os.listdir(shared_dir(spark).removeprefix("file://")) if f.startswith("postings-")}
    spark.createDataFrame([(k, f"{text} " * 40) for k, text in rows], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "v rare")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    before = stored()
    for query in (catalogue.context_build, catalogue.hybrid_search, catalogue.rerank_threshold):
        assert query(spark, folder).count() > 0
    assert stored() == before
