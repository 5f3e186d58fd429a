import hashlib
import random

import corpus_pipeline
from test_text_operators import brute_components, leak_corpus, prose


def test_clean_texts_of_several_languages_stay(spark, tmp_path):
    rng = random.Random(12)
    kinds = {"xx": "a", "yy": "o", "zz": "i", "ww": "u"}
    docs = [(i, prose(rng, kinds[k], 40), k, "src", 1) for i, k in enumerate(list(kinds) * 40)]
    docs += [(900 + n, " ".join(prose(rng, kinds[k], 60) for k in list(kinds)[:n]), None, "src", 1) for n in (3, 4)]
    docs += [(910, None, None, "src", 1), (911, "12 !!", None, "src", 1)]
    kept = corpus_pipeline.language(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {d[0] for d in docs} - {910, 911}


def test_each_stage_on_its_input(spark, tmp_path):
    rng = random.Random(9)
    items, docs, leaks = leak_corpus(rng)
    docs = [(i, t, "en", "src", len(t)) for i, t, _ in docs]
    clean = [(1000 + i, prose(rng, "aeiou", 80), "fr", "src", 1) for i in range(60)]
    copies = [(2000 + i, clean[i][1], "fr", "src", 1) for i in range(5)]
    near = [(3000 + i, clean[i][1] + " once more", "fr", "src", 1) for i in range(5)]
    junk = [(4000, None, None, None, None), (4001, "", "en", "src", 0), (4002, "12 34 !!", "en", "src", 8)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = docs + clean + copies + near + junk
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, texts = spark.read.parquet(f"{tmp_path}/documents.parquet"), {r[0]: r[1] for r in rows}
    after = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert at.schema.names == schema.replace(" long", "").replace(" string", "").split(", ")
        after.append({r.doc_id for r in at.select("doc_id").collect()})
    assert after[0] == set(texts) - {4000, 4001, 4002}
    assert after[1] == after[0] - {1000 + i for i in range(5)}
    groups = brute_components([(i, texts[i], None) for i in after[1]])
    assert after[2] == {i for i, (_, _, kept) in groups.items() if kept}
    assert after[3] == after[2] - {i for i, _ in leaks}
    assert after[4] == after[3]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == after[4]


def test_each_stage_on_odd_rows(spark, tmp_path):
    rng = random.Random(13)
    names = "doc_id long, text string, lang string, source string, n_chars long, kept string, keep_id string, id string, node string, text_sha256 string, marks string"
    more = ["old"] * 6
    texts = [prose(rng, "ae", 60) for _ in range(40)]
    docs = [(i, t, "xx", "src", 1, *more) for i, t in enumerate(texts)] + [(3, texts[3], "xx", "src", 1, *more), (None, prose(rng, "ae", 60), None, None, None, *more), (50, None, None, None, None, *more)]
    spark.createDataFrame([(1, "ka be ga " * 9)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    full, empty = spark.createDataFrame(docs, names), spark.createDataFrame([], names)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, full, str(tmp_path)).collect()
        assert stage(spark, empty, str(tmp_path)).count() == 0
        ids = [r.doc_id for r in got]
        assert ids.count(3) == 2 and ids.count(None) == 1, name  # rows given twice stay together; one without an id is no copy
        if stage is not corpus_pipeline.encode:
            assert {(r.kept, r.keep_id, r.id, r.node, r.text_sha256, r.marks) for r in got} == {("old",) * 6}, name
        assert (50 in ids) == (name != "language ID"), name


def test_rows_of_one_id_are_judged_each_by_its_text(spark, tmp_path):
    rng = random.Random(14)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    a, b, c = (prose(rng, "ae", 60) for _ in range(3))
    item = "ka be ga du ro " * 8
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = lambda *rows: spark.createDataFrame([(i, t, "xx", "src", 1) for i, t in rows], schema)
    left = lambda stage, *rows: sorted((r.doc_id, r.text) for r in stage(spark, frame(*rows), str(tmp_path)).collect())
    assert left(corpus_pipeline.near, (4, b), (5, a), (5, b + " once more")) == sorted([(4, b), (5, a)])
    assert left(corpus_pipeline.language, (5, "12 34"), (5, a), (6, b), (5, None)) == sorted([(5, a), (6, b)])
    assert left(corpus_pipeline.decontaminate, (5, f"{a} {item} {b}"), (5, c), (6, a)) == sorted([(5, c), (6, a)])
    assert left(corpus_pipeline.exact, (5, a), (5, c), (6, a)) == sorted([(5, c), (6, a)])


def test_the_chain_with_shared_ids(spark, tmp_path):
    """Against each decision by brute force, over rows and not ids."""
    rng = random.Random(15)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = [prose(rng, "aeiou", 80) for _ in range(50)]
    rows = [(k % 30, t) for k, t in enumerate(texts)]  # ids 0 to 19 have two texts
    rows += [(k, texts[k + 1] + " once more") for k in range(0, 20, 4)] + [(100 + k, texts[k]) for k in range(5)] + [(7, "12 34"), (8, ""), (8, None)]
    item = "ka be ga du ro " * 8
    rows += [(9, f"{prose(rng, 'ae', 50)} {item}")]
    spark.createDataFrame([(i, t, "xx", "src", 1) for i, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = [r for r in rows if r[1] and any(x.isalpha() for x in r[1])]
    left = [r for r in left if r[0] == max(i for i, t in left if t == r[1])]
    key = {r: n for n, r in enumerate(sorted(left, key=lambda r: (r[0], hashlib.sha256(r[1].encode()).digest())))}
    groups = brute_components([(n, r[1], None) for r, n in key.items()])
    left = [r for r, n in key.items() if groups[n][2]]
    left = [r for r in left if item.strip() not in r[1]]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in at.collect()) == sorted(left)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(i for i, _ in left)
