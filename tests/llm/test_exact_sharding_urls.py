import hashlib
from collections import defaultdict

import pytest

from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm import url_filters
from lodestone.llm.sharding import extendible_shards
from lodestone.llm.url_filters import PATTERN_RULES, SITE_RULES, Rule, filter_urls

DOCS = "doc_id long, text string, lang string"


def test_exact_dedup_keeps_the_largest_id(spark):
    rows = [(k, f"text {k % 7}", "en") for k in range(50)] + [(100, None, None), (101, "", "x"), (102, "Text 1", None)]
    got = {r.doc_id: r for r in exact_dedup(spark.createDataFrame(rows, DOCS), runs=16).collect()}
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    for i, t, _ in rows:
        own = groups[t or ""]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(own), len(own), i == max(own))
        assert got[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_dedup_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup(empty).count() == 0
    twice = exact_dedup(spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (None, "a", "y"), (None, "b", "z")], DOCS)).collect()
    assert sorted([(r.doc_id, r.text, r.keep_id, r.group_size, r.kept) for r in twice], key=str) == sorted(
        [(1, "a", 1, 3, True), (1, "a", 1, 3, True), (None, "a", 1, 3, False), (None, "b", None, 1, True)], key=str)
    names = "doc_id long, text string, kept string, row string, id string, n_bytes string, `check` string, best string, `group` string, run string, n string"
    clash = spark.createDataFrame([(1, "a", *["old"] * 9), (2, "a", *["old"] * 9)], names)
    got = exact_dedup(clash).collect()
    assert {r.doc_id: r.kept for r in got} == {1: False, 2: True} and all((r.row, r.id, r.n_bytes, r.check, r.best, r.group, r.run, r.n) == ("old",) * 8 for r in got)


def test_exact_dedup_plan_has_no_python_and_combines_before_each_exchange(spark):
    plan = exact_dedup(spark.createDataFrame([(1, "a", "x")], DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Window" not in plan


def test_shards_fit_and_only_large_buckets_split(spark):
    rows = [(k, "x" * (k % 90), "en") for k in range(400)]
    got = extendible_shards(spark.createDataFrame(rows, DOCS), 2000).collect()
    size, depth = defaultdict(int), {}
    for r in got:
        size[r.shard] += r.n_bytes
        depth[r.shard] = r.depth
    assert len(got) == 400 and all(v <= 2000 for v in size.values()) and all(len(s) == depth[s] for s in size)
    assert all(r.shard_bytes == size[r.shard] for r in got)
    shards = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(shards, shards[1:]))  # no bucket lies in another
    for s in shards:  # its parent was too large
        assert sum(v for t, v in size.items() if t.startswith(s[:-1])) > 2000


def test_shard_edges(spark):
    assert extendible_shards(spark.createDataFrame([], DOCS), 10).count() == 0
    big = extendible_shards(spark.createDataFrame([(1, "y" * 100, "a"), (2, "z", "b"), (None, None, None)], DOCS), 10).collect()
    assert len(big) == 3 and len({r.shard for r in big}) >= 2
    hot = spark.createDataFrame([(7, f"text number {k}", "a") for k in range(40)] + [(7, "same", "a")] * 5, DOCS)
    got = extendible_shards(hot, 64).collect()
    assert max(r.shard_bytes for r in got) <= 64 and max(r.depth for r in got) > 120


def test_shards_pass_clashing_columns(spark):
    names = "doc_id long, text string, cell_0_0 string, leaf_0_0 string, cells string, d string, depth string"
    got = extendible_shards(spark.createDataFrame([(k, "x" * k, *["old"] * 5) for k in range(40)], names), 200).collect()
    assert len(got) == 40 and all((r.cell_0_0, r.leaf_0_0, r.cells, r.d) == ("old",) * 4 and r.depth == len(r.shard) for r in got)


URLS = [
    ("http://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"), ("http://WWW.Example.com/en/1?x=1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"), ("http://x.net/es/#t", "x.net", "/es/", "net/es/", "block"), ("http://x.net/ES/", "x.net", "/ES/", None, "allow"),
    ("http://x.org/print/1", "x.org", "/print/1", None, "block"), ("http://m.x.org/1", "m.x.org", "/1", None, "block"), ("http://x.org/blueprint/1", "x.org", "/blueprint/1", None, "allow"),
    ("http://x.com", "x.com", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("http://example.com?u=http://b.net/es/", "example.com", "", None, "allow")]


def test_url_rules(spark):
    df = spark.createDataFrame([(k, u[0], "old") for k, u in enumerate(URLS)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, SITE_RULES + PATTERN_RULES).collect()}
    assert got == {k: u[1:] for k, u in enumerate(URLS)}
    assert filter_urls(df.limit(0), SITE_RULES).count() == 0
    assert {r.verdict for r in filter_urls(df, [], default="block").collect()} == {"block"}


@pytest.mark.parametrize("in_plan", [20_000, 10])
def test_url_rules_agree_with_trying_every_rule(spark, in_plan, monkeypatch):
    import re

    monkeypatch.setattr(url_filters, "IN_PLAN", in_plan)

    rules = [Rule("block", f"h{k}.com/p{k % 3}/", True) for k in range(60)] + [Rule("allow", f"*/q{k}/*", False) for k in range(20)] + [Rule("block", "*zz*")]
    urls = [f"http://s.h{k % 70}.com/p{k % 4}/q{k % 25}/{'zz' * (k % 2)}" for k in range(300)]
    got = filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    for r in got:
        at = r.host + r.path
        fit = [x for x in rules if re.search(x.regex(), at)]
        site = max((x for x in fit if x.site), key=lambda x: len(x.text), default=None)
        other = {x.action for x in fit if not x.site}
        assert (r.rule, r.verdict) == ((site.text, site.action) if site else (None, "allow" if "allow" in other else "block" if other else "allow"))


def test_rarest_tokens():
    assert Rule("block", "example.com/en/", True).tokens() == ["com", "en", "example"] and Rule("block", "*ads").tokens() == [] and Rule("block", "/print/").tokens() == ["print"]


def test_url_filter_passes_clashing_columns(spark):
    names = "page_id long, url string, row string, at string, tokens string, fits string, best string, host string"
    df = spark.createDataFrame([(1, "http://x.net/es/", *["old"] * 6)] * 2 + [(2, None, *["old"] * 6)], names)
    got = filter_urls(df, SITE_RULES).collect()
    assert sorted((r.page_id, r.host, r.verdict) for r in got) == [(1, "x.net", "block")] * 2 + [(2, "", "allow")]
    assert all((r.row, r.at, r.tokens, r.fits, r.best) == ("old",) * 5 for r in got)
