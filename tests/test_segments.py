"""The commit log, and the document store's segments on it."""

import threading

import pytest
from pyspark.sql import functions as F

from lodestone.operators import bm25, search
from lodestone.operators.store import SCHEMAS, DocumentStore
from lodestone.sources.versions import Change, Conflict, Versions, bucket

PAGES = "document_id string, document_name string, page_ord int, page_number int, text string"


class Pairs(Versions):
    schemas = {"a": "k long, v string", "b": "k long"}


def rows(spark, *ks):
    return spark.createDataFrame([(k, f"v{k}") for k in ks], "k long, v string")


def keys(df):
    return sorted(r.k for r in df.collect())


def test_commits_appear_whole_and_snapshots_stay(spark, tmp_path):
    own = Pairs(spark, f"file://{tmp_path}/t")
    assert own.snapshot().version == -1 and keys(own.read("a")) == []
    own.transact(lambda now: {"a": rows(spark, 1, 2), "b": rows(spark, 1).select("k")})
    first = own.snapshot()
    own.transact(lambda now: {"a": now.append("a", rows(spark, 3))})
    own.transact(lambda now: {"b": Change(None)})
    assert keys(own.read("a")) == [1, 2, 3] and keys(own.read("b")) == []
    assert keys(first.read("a")) == [1, 2] and keys(own.snapshot(0).read("b")) == [1] and own.snapshot().version == 2
    assert own.transact(lambda now: {}).version == 2
    with pytest.raises(ValueError):
        own.snapshot(9)


def test_a_writer_that_comes_second_begins_again(spark, tmp_path):
    own, other = (Pairs(spark, f"file://{tmp_path}/t") for _ in range(2))
    seen = []

    def add(now):
        seen.append(now.version)
        if len(seen) == 1:
            other.transact(lambda now: {"a": now.append("a", rows(spark, 1)), "b": rows(spark, 7).select("k")})
        return {"a": now.append("a", rows(spark, 2))}

    own.transact(add)
    assert seen == [-1, 0] and keys(own.read("a")) == [1, 2] and keys(own.read("b")) == [7]
    # The attempt that lost left no folder.
    assert sum(p.is_dir() for p in (tmp_path / "t" / "a").iterdir()) == 2


def test_a_writer_that_never_comes_first_ends_with_an_error(spark, tmp_path):
    own, other = (Pairs(spark, f"file://{tmp_path}/t") for _ in range(2))

    def add(now):
        other.transact(lambda now: {"b": rows(spark, 7).select("k")})
        return {"a": rows(spark, 2)}

    with pytest.raises(Conflict):
        own.transact(add, attempts=2)
    with pytest.raises(ZeroDivisionError):
        own.transact(lambda now: 1 / 0)
    assert keys(own.read("a")) == [] and keys(own.read("b")) == [7]


def test_threads_lose_nothing(spark, tmp_path):
    stores = [Pairs(spark, f"file://{tmp_path}/t") for _ in range(4)]
    threads = [threading.Thread(target=lambda k=k, s=s: s.transact(lambda now: {"a": now.append("a", rows(spark, k))}, attempts=20)) for k, s in enumerate(stores)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert keys(stores[0].read("a")) == [0, 1, 2, 3] and stores[0].snapshot().version == 3


def test_old_commits_expire(spark, tmp_path):
    own = Pairs(spark, f"file://{tmp_path}/t")
    own.transact(lambda now: {"a": rows(spark, 1)})
    own.transact(lambda now: {"a": rows(spark, 2), "b": rows(spark, 2).select("k")})
    own.transact(lambda now: {"a": now.append("a", rows(spark, 3))})
    rows(spark, 9).write.parquet(f"file://{tmp_path}/t/a/3-broken-off")
    assert own.expire(versions=1) == 0  # nothing is a day old
    assert own.expire(versions=1, seconds=0) == 2  # what only the first commit had, and what broke off
    assert keys(own.read("a")) == [2, 3] and keys(own.read("b")) == [2] and own.expire(versions=1, seconds=0) == 0
    with pytest.raises(ValueError):
        own.snapshot(0)
    own.transact(lambda now: {"a": now.append("a", rows(spark, 4))})
    assert keys(own.read("a")) == [2, 3, 4]


def test_merged_parts_are_few(spark, tmp_path):
    own = Pairs(spark, f"file://{tmp_path}/t")
    for k in range(7):
        own.transact(lambda now, k=k: {"a": now.append("a", rows(spark, k))})
        own.merge("a", lambda now, parts: now.read("a", lambda p: p in parts), fan=3)
    parts = own.snapshot().of("a")
    assert keys(own.read("a")) == list(range(7)) and len(parts) < 4 and min(p.low for p in parts) == 0


def test_buckets_that_no_row_touches_stay(spark, tmp_path):
    own = Pairs(spark, f"file://{tmp_path}/t")
    own.transact(lambda now: {"a": Change(rows(spark, *range(40)).withColumn("__bucket", bucket("k", 4)), buckets=True)})
    before = own.snapshot().of("a")
    assert {p.bucket for p in before} == {0, 1, 2, 3}
    new = rows(spark, 100).withColumn("__bucket", bucket("k", 4))
    hit = new.first()["__bucket"]
    own.transact(lambda now: {"a": Change(now.read("a", lambda p: p.bucket == hit).withColumn("__bucket", F.lit(hit)).unionByName(new), tuple(p for p in now.of("a") if p.bucket != hit), buckets=True)})
    after = own.snapshot().of("a")
    assert len(set(before) & set(after)) == 3 and keys(own.read("a")) == [*range(40), 100]
    own.expire(versions=1, seconds=0)
    assert keys(own.read("a")) == [*range(40), 100] and len(list((tmp_path / "t" / "a").glob("0-*/__bucket=*"))) == 3


# ---- the document store


def pages(spark, texts):
    return spark.createDataFrame([(i, f"{i}.txt", 0, 1, t) for i, t in texts.items()], PAGES)


def texts(lo, hi):
    return {f"d{k}": " ".join(f"w{k * j % 97} common" for j in range(1, 40)) + f" only{k}" for k in range(lo, hi)}


def hits(spark, index, *asked):
    got = bm25.search(index, spark.createDataFrame(list(enumerate(asked)), "query_id long, question string"), 5)
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in got.collect())


QUESTIONS = ("w6 w12", "only3", "only9 common", "w5 only14 zzz", "common")


def rebuilt(spark, store):
    return hits(spark, bm25.build_index(store.read("chunks")), *QUESTIONS)


def test_segments_score_as_an_index_built_anew(spark, tmp_path):
    own = DocumentStore(spark, f"file://{tmp_path}/s")
    for lo in (0, 6, 12):
        own.ingest(pages(spark, texts(lo, lo + 6)))
    assert len(own.snapshot().of("postings")) == 3
    assert hits(spark, own.index(), *QUESTIONS) == rebuilt(spark, own)
    assert own.remove("d3") and own.remove("d9") and not own.remove("d9") and not own.remove("none")
    found = hits(spark, own.index(), *QUESTIONS)
    assert found == rebuilt(spark, own) and not any(c.startswith(("d3_", "d9_")) for _, _, c, _ in found)
    assert {r.term for r in own.read("terms").where("term in ('only3', 'only4')").collect()} == {"only4"}
    assert own.stats().first().asDict() == {"documents": 16, "chunks": 16, "vectors": 16, "bm25_chunks": 16}
    # A removed id may come again, and content that was removed too.
    back = own.ingest(pages(spark, {"d3": "something new", "x": texts(9, 10)["d9"], "d4": "not d4"})).collect()
    assert {r.document_id: r.outcome for r in back} == {"d3": "registered", "x": "registered", "d4": "known_id"}
    assert hits(spark, own.index(), *QUESTIONS) == rebuilt(spark, own) and [r.text for r in own.get_chunks("d3").collect()] == ["something new"]


def test_merging_changes_no_result(spark, tmp_path):
    own = DocumentStore(spark, f"file://{tmp_path}/s")
    for lo in range(0, 16, 4):
        own.ingest(pages(spark, texts(lo, lo + 4)))
    own.remove("d1")
    own.remove_all(spark.createDataFrame([("d2",), ("d6",), ("none",)], "document_id string"))
    before, tables = hits(spark, own.index(), *QUESTIONS), {n: t.count() for n, t in own.tables().items()}
    own.merge_all(fan=3)
    now = own.snapshot()
    assert all(len(now.of(name)) == 1 for name in SCHEMAS) and now.read("removed").count() == 0
    assert now.read("chunks").count() == tables["chunks"] == 13 and now.read("corpus").count() == 1
    assert hits(spark, own.index(), *QUESTIONS) == before == rebuilt(spark, own) and {n: t.count() for n, t in own.tables().items()} == tables
    assert own.remove("d5") and hits(spark, own.index(), *QUESTIONS) == rebuilt(spark, own)


def test_a_batch_writes_as_much_as_it_has(spark, tmp_path):
    own, folder = DocumentStore(spark, f"file://{tmp_path}/s"), tmp_path / "s"
    files = lambda: {p: p.stat().st_size for p in folder.rglob("*.parquet")}
    own.ingest(pages(spark, texts(0, 400)))
    first = files()
    own.ingest(pages(spark, texts(400, 404)))
    second = files()
    new = {p: n for p, n in second.items() if p not in first}
    assert all(second[p] == n for p, n in first.items()) and sum(new.values()) < sum(first.values()) / 4
    own.remove("d7")
    third = files()
    new = {p: n for p, n in third.items() if p not in second}
    assert all(third[p] == n for p, n in second.items()) and sum(new.values()) < sum(first.values()) / 4
    assert {p.parent.parent.name for p in new} == {"removed", "terms", "corpus"}


def test_two_writers_at_once(spark, tmp_path):
    """Both read the store before either wrote; one content comes from both."""
    one, two = (DocumentStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    plain, done = one._judged, []

    def late(*args):
        if not done:
            done.append(two.ingest(pages(spark, {"x": "birds of prey", "y": "cats and dogs"})).collect())
        return plain(*args)

    one._judged = late
    got = {r.document_id: r.outcome for r in one.ingest(pages(spark, {"a": "cats and dogs", "b": "fish only"})).collect()}
    assert {r.document_id: r.outcome for r in done[0]} == {"x": "registered", "y": "registered"} and got == {"a": "duplicate", "b": "registered"}
    for name in ("registry", "chunks", "vectors", "lengths"):
        assert {r.document_id for r in one.read(name).collect()} == {"b", "x", "y"}
    found = search.Keywords(one.index()).search(spark.createDataFrame([(1, "fish"), (2, "birds"), (3, "dogs")], "query_id long, question string"), 3)
    assert {r.chunk_id for r in found.collect()} == {"b_chunk_0", "x_chunk_0", "y_chunk_0"}


def test_pages_of_no_document(spark, tmp_path):
    own = DocumentStore(spark, f"file://{tmp_path}/s")
    got = own.ingest(spark.createDataFrame([(None, "n", 0, 1, "a readable page"), ("a", "a", 0, 1, "a readable page"), ("b", None, 0, None, None)], PAGES))
    assert {r.document_id: r.outcome for r in got.collect()} == {None: "no_id", "a": "registered", "b": "unreadable"}
    assert own.ingest(own.read("chunks").limit(0).selectExpr("document_id", "document_name", "0 page_ord", "page_number", "text")).count() == 0
    empty = DocumentStore(spark, f"file://{tmp_path}/empty")
    assert hits(spark, empty.index(), "x") == [] and empty.stats().first().documents == 0 and not empty.remove("x")
    empty.merge_all()


def test_a_look_up_opens_few_files(spark, tmp_path):
    own = DocumentStore(spark, f"file://{tmp_path}/s")
    for lo in (0, 40, 80):
        own.ingest(pages(spark, {f"d{k:03d}": f"words of {k} . " * 20 for k in range(lo, lo + 40)}))
    stored = len(own.read("chunks").inputFiles())
    got = own.get_chunks("d057")
    assert 1 <= len(got.inputFiles()) <= 2 < stored and {r.document_id for r in got.collect()} == {"d057"}
    assert [c.page_number for c in own.get_document("d057").first().chunks] == [1] and own.get_chunks("d0571").count() == 0 and own.get_chunks("zzz").count() == 0
    own.merge_all(fan=3)
    assert len(own.snapshot().of("chunks")) == 1 and len(own.get_chunks("d099").inputFiles()) <= 2 and own.get_chunks("d099").count() == 1
    assert own.remove("d099") and own.get_chunks("d099").count() == 0 and own.get_document("d099").count() == 0
