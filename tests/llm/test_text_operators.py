import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontamination, langid, near_dedup, quality, substring_dedup
from lodestone.llm import secrets as secret_scan

DOCS = "doc_id long, text string, lang string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)


def brute_secrets(text):
    b = text.encode()
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(b) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), 1) for m in re.finditer(rb"AKIA[A-Z0-9]+", b) if len(m[0]) >= 18]
    found += [(m.start(), m.end(), 2) for m in re.finditer(rb"[0-9a-f]+", b) if len(m[0]) >= 16]
    at = lambda i: len(b[:i].decode())
    return sorted((at(i), at(j), k) for i, j, k in found)


def test_secrets_agree_with_regular_expressions(spark):
    rng = random.Random(3)
    parts = ["token", "Secret", "password", "api_key", "APIKEY", "AKIA", "=", ":", " ", '"', "'", "abcdef0123", "0123456789abcdef", "ABCDEFGH12", "é", "\n", "-", ".", ",", "日"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(1500)] + [None, "", "f" * 5000, "token=" * 300]
    got = secret_scan.find_secrets(spark.createDataFrame([(k, t, "spans") for k, t in enumerate(texts)], "doc_id long, text string, spans string")).collect()
    kinds = ["assign", "access", "hex"]
    for r in got:
        expected = brute_secrets(texts[r.doc_id] or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[2] == k for x in expected) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{kinds[k]}:{i}:{j}" for i, j, k in expected).encode()).hexdigest()
    assert len(got) == len(texts)


def test_further_kinds_add_spans(spark):
    text = "x ghp_" + "a1B2" * 9 + " and -----BEGIN RSA PRIVATE KEY----- end"
    r = secret_scan.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.spans == "forge:2:42,pem:47:78" and r.n_hex == 0


def test_automaton_reads_each_byte_once_and_is_minimal():
    a = secret_scan.compile_rules([("ab*c", False), ("abd", False)])
    rows = a.table.reshape(-1, a.n_classes)
    assert len({(tuple(r), x) for r, x in zip(rows.tolist(), a.accepts.tolist())}) == len(rows)


VOCABULARY = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_bpe_agrees_with_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    library.no_padding()
    library.no_truncation()
    rng = random.Random(2)
    parts = ["a", "b", "é", "é", "ΑΣ ", "ß", "İ", "'s", "'LL", "don't", "12", "\x1c", "\x85", "\xa0", " ", "\n", "!", "!!", "<|startoftext|>", "<|endoftext|>", "<|", "日本", "aaaa", "😀", "The", "\x00"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(2000)] + ["", "a" * 3000, "ab" * 2000]
    own = bpe.WordBpe(open(VOCABULARY, encoding="utf-8").read())
    assert own.together
    for again in (True, False):  # merges of a round together, and one at a time
        own.together = again
        own.memory.clear()
        for text, got, e in zip(texts, own.encode_decode(texts), library.encode_batch(texts, add_special_tokens=False)):
            assert got == (" ".join(map(str, e.ids)), len(e.ids), library.decode(e.ids, skip_special_tokens=False)), text
        texts = texts[:200]
    df = spark.createDataFrame([(1, None), (2, "Hello, WORLD"), (2, "Hello, WORLD"), (None, "")], "doc_id long, text string")
    rows = bpe.bpe_round_trip(df, VOCABULARY, texts=True).collect()
    assert len(rows) == 4 and {r.decoded for r in rows if r.doc_id == 2} == {"hello</w> ,</w> world</w>"} and {r.n_tokens for r in rows if r.doc_id != 2} == {0}
    assert bpe.bpe_round_trip(df.limit(0), VOCABULARY).count() == 0


def brute_components(docs):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t, _ in docs:
        w = WORD.findall((t or "").translate(fold))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_repeated_rows_and_null_ids_give_a_row_each(spark):
    docs = [(1, "token = abcdef0123456789", "xx"), (1, "token = abcdef0123456789", "xx"), (None, "token = abcdef0123456789", None), (2, None, "yy"), (3, "", None)]
    names = DOCS + ", __id string, __text string, __held string, id string, hashes string"
    df = spark.createDataFrame([(*d, *["old"] * 5) for d in docs], names)
    found = secret_scan.find_secrets(df).collect()
    assert sorted((r.doc_id or 0, r.n_assign) for r in found) == [(0, 1), (1, 1), (1, 1), (2, 0), (3, 0)]
    assert secret_scan.find_secrets(df.limit(0)).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert len(quality.score_quality(df, labels).collect()) == len(langid.identify_language(df).collect()) == len(bpe.bpe_round_trip(df, VOCABULARY).collect()) == 5
    bench = spark.createDataFrame([(1, "token = abcdef0123456789 and more of it than one line")], "item_id long, text string")
    leaks = decontamination.find_leaks(df.withColumn("text", F.concat("text", F.lit(" and more of it than one line"))), bench).collect()
    assert sorted(r.doc_id or 0 for r in leaks) == [0, 1, 1]


def test_letters_of_any_script():
    text = "aZ5—é日😀ß!１Ωَ𝒳"
    data = np.frombuffer(text.encode(), np.uint8)
    at, got = 0, langid.begins_letter(data)
    for c in text:
        assert got[at] == c.isalpha(), c
        at += len(c.encode())


def test_a_language_of_long_texts_alone_is_learned(spark):
    rng = random.Random(31)
    docs = [(i, prose(rng, "ae", 40), "xx") for i in range(40)] + [(100 + i, prose(rng, "ou", 16_000), "yy") for i in range(8)] + [(200, prose(rng, "ou", 30), None)]
    got = {r.doc_id: r.lang_pred for r in langid.identify_language(spark.createDataFrame(docs, DOCS)).collect()}
    assert got[200] == "yy"


def near_corpus(rng, n=240):
    words = [f"w{k}" for k in range(400)]
    base = [rng.choices(words, k=60) for _ in range(6)]
    docs = []
    for i in range(n):
        w = list(base[i % 6]) if i % 3 else rng.choices(words, k=50)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        docs.append((i, " ".join(w), "en"))
    return docs + [(n, None, None), (n + 1, "", None), (n + 2, "one two", None), (n + 3, "One TWO", None), (n + 4, " \t ", None), (n + 5, docs[1][1], None), (n + 6, "one", None)]


@pytest.mark.parametrize("rounds", [1, 2])
def test_near_duplicates_agree_with_all_pairs(spark, rounds, monkeypatch):
    monkeypatch.setattr(near_dedup, "ROUNDS", rounds)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)  # many blocks for each group
    docs = near_corpus(random.Random(rounds))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == brute_components(docs)


def test_rows_that_share_an_id(spark):
    """Each row is judged by its own text, and none is multiplied."""
    rng = random.Random(21)
    base = rng.choices([f"w{k}" for k in range(300)], k=60)
    other = rng.choices([f"v{k}" for k in range(300)], k=60)
    near = [*base[:30], "x", *base[31:]]
    docs = [(5, " ".join(base), None), (5, " ".join(other), None), (7, " ".join(near), None), (5, " ".join(base), None), (9, " ".join(other), None), (4, " ".join([*other, "y"]), None), (8, "", None)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(docs, DOCS)).collect())
    sizes = [len({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}) for _, t, _ in docs]
    assert got == sorted([(5, sizes[0], 5, True), (5, sizes[1], 4, False), (7, sizes[2], 5, False), (5, sizes[3], 5, True), (9, sizes[4], 4, False), (4, sizes[5], 4, True), (8, 0, 8, True)])


def test_columns_that_clash_are_not_read(spark):
    names = "doc_id long, text string, id string, n string, s1 string, key string, node string, slot string, marks string, stretches string"
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(k, text, *["x"] * 8) for k in range(3)], names)
    assert {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()} == {(0, 0, True), (1, 0, False), (2, 0, False)}
    assert {(r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(df).collect()} == {(0, 0), (1, 40), (2, 40)}


def test_signature_keys_meet_under_the_distance():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 1 << 16, (200, 70)).astype(np.uint16)
    most = near_dedup.CHUNKS * (near_dedup.ERRORS + 1) - 1
    for row in symbols:
        other = row.copy()
        other[rng.choice(70, most, replace=False)] ^= 1
        equal = (row == other)[None]
        slot = near_dedup._first_slot(equal)[0]
        chunk = slice(slot - slot % 5, slot - slot % 5 + 5)
        assert equal[0, chunk].sum() >= 4 and (equal[0, chunk].all() or not equal[0, slot])


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    got = near_dedup.near_duplicates(spark.createDataFrame([(None, "a b c d e f", None), (1, "a b c d e f", None)], DOCS)).collect()
    assert sorted((r.doc_id or -1, r.kept) for r in got) == [(-1, True), (1, True)]


def brute_repeats(docs):
    seen, out = set(), {}
    for i, t, _ in sorted(docs, key=lambda d: d[0]):
        w = WORD.findall(t or "")
        drop = [False] * len(w)
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                drop[k : k + 20] = [True] * 20
            seen.add(x)
        kept = [a for a, b in zip(w, drop) if not b]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("limit", [1 << 22, 4000, 300])
def test_repeats_agree_with_a_set_of_windows(spark, limit):
    rng = random.Random(limit)
    passages = [[f"p{p}w{k}" for k in range(rng.randint(20, 60))] for p in range(5)]
    docs = []
    for i in range(80):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [f"x{rng.randrange(10**6)}" for _ in range(rng.randint(0, 30))] + (passages[rng.randrange(5)][rng.randint(0, 9) :] if rng.random() < 0.6 else [])
        docs.append((i, " \n".join(w), "en"))
    docs += [(80, None, None), (81, "", None), (82, "a " * 100, None), (83, "a " * 19, None), (84, "A " * 100, None), (85, "日本 " * 50, None)]
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(df, group_bytes=limit).collect()}
    assert got == brute_repeats(docs)


def test_repeats_edges(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    text = " ".join(f"w{k}" for k in range(30))
    rows = substring_dedup.remove_repeats(spark.createDataFrame([(1, text, None), (1, text, None), (None, text, None)], DOCS), texts=True).collect()
    assert [(r.doc_id, r.n_removed, r.kept_text == text) for r in sorted(rows, key=str)] == [(r.doc_id, 0, True) for r in sorted(rows, key=str)]


def test_words_with_equal_hashes_are_told_apart():
    text = "a b a bb a b ba 日 b".encode()
    w = substring_dedup.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    for h in (w.hash, np.zeros_like(w.hash), w.hash % 2):
        w.hash = h
        ids = substring_dedup.exact_ids(w)
        words = text.split()
        assert all((ids[i] == ids[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))


def test_repeats_in_spite_of_colliding_prefixes():
    """All windows in one subtree, as if every hash were the same, in several batches."""
    import pyarrow as pa

    rng = random.Random(8)
    docs = [(i, " ".join(rng.choices("ab", k=24) if i % 2 else [f"p{k}" for k in range(i % 3, 25)]), "en") for i in range(200)]
    rows = [(0, 0, i, 0, t.encode()) for i, t, _ in docs]
    names = ["key", "level", "id", "at", "text"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 30]), types)], names) for lo in range(0, len(rows), 30)]
    for limit in (1 << 20, 3000):
        todo, got = batches, set()
        while todo:
            out = [b for b in substring_dedup._subtrees(limit)(iter(todo)) if b.num_rows]
            got |= {(r["id"], r["at"] // 2**20 + k) for b in out for r in b.to_pylist() if r["text"] is None for k in range(r["at"] % 2**20)}
            todo = [b.filter(b.column(4).is_valid()) for b in out]
            on = pa.Table.from_batches([b for b in todo if b.num_rows], batches[0].schema) if any(b.num_rows for b in todo) else None
            todo = on.sort_by([("key", "ascending"), ("id", "ascending"), ("at", "ascending")]).to_batches(30) if on is not None else []
        seen, expected = set(), set()
        for i, t, _ in docs:
            w = t.split()
            for k in range(len(w) - 19):
                if tuple(w[k : k + 20]) in seen:
                    expected.add((i, k))
                seen.add(tuple(w[k : k + 20]))
        assert got == expected and len(expected) > 50


def test_long_stretches_take_several_rows(monkeypatch):
    monkeypatch.setattr(substring_dedup, "_LEN", 8)
    stretches = [(1, 3, 1), (1, 10, 7), (2, 0, 8), (2, 20, 30), (4, 5, 14)]
    windows = [(d, s + k) for d, s, n in stretches for k in range(n)]
    random.Random(3).shuffle(windows)
    doc, rows = substring_dedup._repeat_rows(*np.array(windows).T)
    got = [(d, s // 8 + k) for d, s in zip(doc.tolist(), rows.tolist()) for k in range(s % 8)]
    assert got == sorted(windows)
    assert len(rows) == 1 + 1 + 2 + 5 + 2
    assert [len(x) for x in substring_dedup._repeat_rows(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


def test_repeats_of_more_than_a_row_of_windows(spark):
    n = (1 << 20) + 5_000
    docs = [(1, "again " * n, None), (2, "again " * n, None)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {1: (n, n - 1, hashlib.sha256(b"again").hexdigest()), 2: (n, n, hashlib.sha256(b"").hexdigest())}


def prose(rng, vowels, n):
    return " ".join("".join(rng.choice("bcdfgl") + rng.choice(vowels) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_language_of_held_out_texts_and_of_each_word(spark):
    rng = random.Random(1)
    kinds = {"xx": "ae", "yy": "ou", "zz": "éi"}
    docs = [(i, prose(rng, kinds[k], 40), k) for i, k in enumerate(list(kinds) * 60)] + [(900, None, "xx"), (901, "", "xx"), (902, "123 !!", "yy"), (903, "日本", None), (904, "x" * 20_000, None)]
    got = {r.doc_id: r for r in langid.identify_language(spark.createDataFrame(docs, DOCS)).collect()}
    held = [d for d in docs[:180] if got[d[0]].held_out]
    assert len(held) > 20 and all(got[i].lang_pred == k and got[i].score > 0.9 for i, _, k in held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[903].lang_pred in kinds and len(got) == len(docs)
    model = langid.fit([(t, k) for _, t, k in docs[:120]])
    mixed = (prose(rng, "ae", 30) + " " + prose(rng, "ou", 30)).encode()
    labels = model.label_words(langid.Words(np.frombuffer(mixed, np.uint8), np.array([0, len(mixed)]), lower=True)).argmax(axis=1)
    names = [model.languages[k] for k in labels]
    assert names.count("xx") >= 28 and set(names[:29]) == {"xx"} and set(names[31:]) == {"yy"}


def test_forward_backward_agrees_with_all_paths():
    import itertools

    rng = np.random.default_rng(4)
    scores, moves = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    weight = {p: np.exp(scores[range(4), p].sum() + sum(moves[a, b] for a, b in zip(p, p[1:]))) for p in itertools.product(range(3), repeat=4)}
    total = sum(weight.values())
    post, expected = langid.forward_backward(scores, moves, np.array([0, 4]), pairs=True)
    for t in range(4):
        assert post[t] == pytest.approx([sum(w for p, w in weight.items() if p[t] == k) / total for k in range(3)])
    assert expected.sum() == pytest.approx(3) and expected[1, 2] == pytest.approx(sum(w * sum((a, b) == (1, 2) for a, b in zip(p, p[1:])) for p, w in weight.items()) / total)


def test_nothing_learned_is_undetermined(spark):
    got = langid.identify_language(spark.createDataFrame([(1, "text", None)], DOCS)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert langid.identify_language(spark.createDataFrame([], DOCS)).count() == 0


def test_quality_on_held_out_rows(spark):
    rng = random.Random(5)
    docs = [(i, prose(rng, "aeo", 60) if i % 3 else " | ".join(prose(rng, "aeo", 60).split()), "en") for i in range(300)] + [(900, None, None), (901, "", None), (902, "#" * 9000, None)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(901, None), (902, 7)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score_quality(spark.createDataFrame(docs, DOCS), labels).collect()}
    held = [i for i in range(300) if got[i].held_out]
    assert len(held) > 40 and all(got[i].predicted == int(i % 3 > 0) for i in held) and all(0 <= r.score <= 1 for r in got.values())
    assert got[900].score == got[901].score and len(got) == len(docs)
    none = quality.score_quality(spark.createDataFrame(docs[:3], DOCS), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score_quality(spark.createDataFrame([], DOCS), labels).count() == 0


def leak_corpus(rng):
    words = [f"{a}{b}{c}{d}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst" for d in "aeiou"] + ["the", "of", "and", "to"] * 60
    items = [(k, " ".join(rng.choices(words, k=rng.randint(20, 70)))) for k in range(30)]
    docs, expected = [], set()
    for i in range(300):
        w = rng.choices(words, k=rng.randint(30, 300))
        if i % 6 == 0:
            k = rng.randrange(30)
            part = items[k][1].split()
            if i % 12 == 0:  # a paraphrase: some words changed, one in six dropped
                part = [x for n, x in enumerate(part) if n % 6 != 3]
                part[len(part) // 2] = "something"
            w[10:10] = part
            expected.add((i, k))
        docs.append((i, ", ".join(w).upper() if i % 4 == 0 else " ".join(w), "en"))
    return items, docs, expected


def test_leaks(spark):
    items, docs, expected = leak_corpus(random.Random(6))
    docs += [(900, None, None), (901, "", None), (902, "...", None)]
    bench = spark.createDataFrame(items + [(90, None), (91, ""), (92, "?!")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(spark.createDataFrame(docs, DOCS), bench).collect()}
    assert got == expected
    assert decontamination.find_leaks(spark.createDataFrame([], DOCS), bench).count() == 0
    assert decontamination.find_leaks(spark.createDataFrame(docs, DOCS), bench.limit(0)).count() == 0


def brute_leaks(items, docs):
    """(doc, item, lcs, answer) of the best span that passes, by every span of every document."""
    out = set()
    for i, text, _ in docs:
        w = re.findall("[a-z0-9]+", (text or "").lower())
        for k, item in items:
            q = item.split()
            n, tail, best = len(q), q[-max(2, len(q) // 4) :], None
            for lo in range(0, len(w), max(1, n // 4)):
                part = w[lo : lo + n + n // 2]
                if sum(map(set(part).__contains__, q)) * 2 >= n:  # a subsequence of 0.6 has more of its words
                    common = decontamination.longest_common(q, part)
                    lcs, answer = common / n, decontamination.longest_common(tail, part) / len(tail)
                    if common >= min(n, 8) and (lcs >= 0.8 or lcs >= 0.6 and answer >= 0.6):
                        best = max(best or (0, 0), (lcs, answer))
            if best:
                out.add((i, k, *best))
    return out


def crowded_corpus(rng):
    """More items than the space has dimensions, short ones among them."""
    common = ["the", "of", "and", "to", "in"]
    words = [f"{a}{b}{c}{d}" for a in "bcdfghklmn" for b in "aeiou" for c in "lmnrst" for d in "aeiou"]
    mixed = words + common * 200
    items = [(k, " ".join(dict.fromkeys(rng.choices(words, k=rng.randint(2, 7))) if k % 2 else rng.choices(mixed, k=rng.randint(12, 60)))) for k in range(300)]
    docs = []
    for i in range(150):
        w = rng.choices(mixed, k=rng.randint(60, 300))
        for k in rng.sample(range(300), 3):
            part = items[k][1].split()
            if i % 3 == 0:
                part = [x for n, x in enumerate(part) if n % 6 != 3]
            w[(at := rng.randrange(len(w))) : at] = part
        docs.append((i, " ".join(w), "en"))
    return items, docs


def test_leaks_of_more_items_than_dimensions(spark):
    items, docs = crowded_corpus(random.Random(16))
    found = decontamination.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = brute_leaks(items, docs)
    assert len({k for _, k, _, _ in expected if len(items[k][1].split()) < decontamination.EVIDENCE}) > 50
    assert {(r.doc_id, r.item_id, r.lcs, r.answer) for r in found} == expected
    # The latent search proposes nearly all; anchors stand in for items that the space has no room for.
    assert len(items) > 5 * decontamination.RANK and sum(r.found_by == "latent" for r in found) > 0.95 * len(found)


def test_leaks_by_the_latent_search_alone(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "_anchors", lambda df, items, faint: (np.zeros(len(df) + 1, np.int64), np.zeros(0, np.int64)))
    items, docs = crowded_corpus(random.Random(18))
    found = decontamination.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    expected, got = brute_leaks(items, docs), {(r.doc_id, r.item_id, r.lcs, r.answer) for r in found}
    assert got <= expected and len(got) > 0.9 * len(expected)


def test_a_benchmark_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "MAX_ITEMS", 40)
    items, docs = crowded_corpus(random.Random(17))
    items, docs = items[:100], docs[:60]
    found = decontamination.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.lcs, r.answer) for r in found} == brute_leaks(items, docs)


def test_a_longer_span_without_the_answer_hides_no_leak(spark):
    item = [f"w{k}" for k in range(40)]
    begun, ended, other = item[:28], item[14:], [f"x{k}" for k in range(150)]
    docs = [(k, " ".join(w), "en") for k, w in enumerate([begun + other + ended, ended + other + begun, begun + other, other + ended])]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    found = decontamination.find_leaks(spark.createDataFrame(docs, DOCS), bench).collect()
    assert sorted((r.doc_id, r.lcs, r.answer) for r in found) == [(0, 0.65, 1.0), (1, 0.65, 1.0), (3, 0.65, 1.0)]


def test_longest_common_subsequence():
    rng = random.Random(7)
    for _ in range(100):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 30))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert decontamination.longest_common(a, b) == row[-1]


def test_bounds_of_samples(spark, monkeypatch):
    from lodestone.llm import samples

    rng = random.Random(19)
    rows = [(k, prose(rng, "ae" if k % 3 else "io", 300), "xx" if k % 3 else "yy") for k in range(120)]
    docs = spark.createDataFrame(rows, DOCS)
    found = {r.lang_pred for r in langid.identify_language(docs, per_language=20, max_languages=1).collect()}
    assert found == {"xx"} and {r.lang_pred for r in langid.identify_language(docs, per_language=20).collect()} == {"xx", "yy"}
    monkeypatch.setattr(samples, "MAX_CHARS", 2000)
    got = samples.labelled_sample(docs, docs.select("doc_id", "lang"), "lang", 20, 1 << 16)
    assert len(got) == 40 and sum(len(t) for t, _ in got) <= 2000 and all(t in dict.fromkeys(x[1] for x in rows) or any(t in x[1] for x in rows) for t, _ in got)
