"""URL rules found by their rarest literal token.

Of each rule's literal tokens the one that the fewest URLs hold becomes its key
in an index.  A URL looks its own tokens up there; only the rules so found run
their regular expression.  The counts come from one aggregation over all URLs.

Up to IN_PLAN rules the index is a constant of the plan, an array of buckets by
the tokens' CRC: a look-up reads one bucket, however many rules there are, and
there's no join and no shuffle of URLs, so a hot host costs nothing extra.  More
rules are a table that the tokens of distinct URLs are joined to.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stash

IN_PLAN = 20_000
OUTPUT = ("host", "path", "rule", "verdict")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULE = "name string, regex string, action string, site boolean"
_INDEX = "array<array<struct<token:string,rules:array<struct<name:string,regex:string,action:string,site:boolean>>>>>"


@dataclass(frozen=True)
class Rule:
    """action: allow or block.  A site rule is ``host/path``: it fits the host
    and its subdomains where the path begins with the rule's.  Any other is a
    pattern over host and path: ``*`` is any run of characters, ``|`` at an end
    ties it to that end, and everything else stands for itself."""

    action: str
    text: str
    site: bool = False

    def regex(self) -> str:
        if self.site:
            return r"^(?:[^/]*\.)?" + re.escape(self.text)
        parts = [re.escape(x) for x in self.text.strip("|").split("*")]
        return "^" * self.text.startswith("|") + ".*".join(parts) + "$" * (self.text.endswith("|"))

    def tokens(self) -> list[str]:
        """Literals that are whole tokens of every URL that the rule fits."""
        text = f".{self.text}" if self.site else self.text
        if text.startswith("|"):
            text = "/" + text[1:]
        if text.endswith("|"):
            text = text[:-1] + "/"
        return sorted({t.lower() for t in re.findall(r"(?<=[^A-Za-z0-9*])[A-Za-z0-9]+(?=[^A-Za-z0-9*])", text)})


#: The contract's site rules.
SITE_RULES = [
    Rule("allow", "com/", True),
    Rule("block", "example.com/en/", True),
    Rule("allow", "www.example.com/en/", True),
    Rule("block", "net/es/", True),
    Rule("block", "net/fr/", True),
]
#: For URLs that no site rule fits: mobile mirrors and printable copies.
PATTERN_RULES = [Rule("block", "|m.*"), Rule("block", "/print/"), Rule("block", "/wp-admin/"), Rule("block", "*.html|"), Rule("block", "|blog.*/fr/"), Rule("block", ".org/es/")]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) by plain cuts: both empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def _rarest(rows: DataFrame, rules: list[Rule]) -> list[str]:
    """Each rule's token that the fewest URLs (tokens) hold; "" if it has none."""
    wanted = sorted({t for r in rules for t in r.tokens()})
    known = rows.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    # A row for each token of the rules at most comes back.
    held = rows.select(F.explode("tokens").alias("token")).groupBy("token").count().join(known, "token", "left_semi")
    counts = {x["token"]: x["count"] for x in held.collect()} if wanted else {}
    return [min(r.tokens(), key=lambda t: (counts.get(t, 0), t), default="") for r in rules]


def _candidates(keys: list[str], rules: list[Rule]) -> Column:
    """The rules under a URL's tokens, from an array of buckets in the plan."""
    by_token: dict[str, list[dict]] = {}
    for token, r in zip(keys, rules, strict=True):
        by_token.setdefault(token, []).append({"name": r.text, "regex": r.regex(), "action": r.action, "site": r.site})
    buckets: list[list[dict]] = [[] for _ in range(max(1, len(by_token)))]
    for token, found in sorted(by_token.items()):
        buckets[zlib.crc32(token.encode()) % len(buckets)].append({"token": token, "rules": found})
    index = F.from_json(F.lit(json.dumps(buckets)), _INDEX)
    bucket = lambda t: F.get(index, F.pmod(F.crc32(t.cast("binary")), F.lit(len(buckets))).cast("int"))
    # Rules without a whole literal token stand under "", which every URL looks up.
    lookups = F.array_union("tokens", F.array(F.lit("")))
    return F.flatten(F.flatten(F.transform(lookups, lambda t: F.transform(F.filter(bucket(t), lambda e: e["token"] == t), lambda e: e["rules"]))))


def _fitting(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """(row, host, path, at, tokens) with fits: the rules that fit."""
    keys = _rarest(rows, rules)
    if len(rules) <= IN_PLAN:
        return rows.withColumn("fits", F.filter(_candidates(keys, rules), lambda r: F.regexp_like(F.col("at"), r["regex"])))
    table = rows.sparkSession.createDataFrame([(t, r.text, r.regex(), r.action, r.site) for t, r in zip(keys, rules, strict=True)], f"token string, {_RULE}")
    distinct = rows.select("at", "tokens").distinct().select("at", F.explode(F.array_union("tokens", F.array(F.lit("")))).alias("token"))
    found = distinct.join(table, "token").where(F.regexp_like(F.col("at"), F.col("regex")))
    fits = stash(found.groupBy("at").agg(F.collect_list(F.struct("name", "regex", "action", "site")).alias("fits")), "fitting-rules")
    none = F.array().cast("array<struct<name:string,regex:string,action:string,site:boolean>>")
    return rows.join(fits, "at", "left").withColumn("fits", F.coalesce("fits", none))


def filter_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """The rows of ``pages`` with host, path, rule (the longest site rule that
    fits, else null) and verdict (that rule's; else block if a block pattern
    fits and no allow pattern does, allow if an allow pattern fits, and
    ``default`` if none fits).

    No row is dropped or multiplied: null URLs, very long ones, repeated rows and
    empty tables pass.  Columns with the names of the results are replaced; others
    pass through, whatever their names.
    """
    host, path = split_url(F.col(url_col))
    passed = [F.col(f"`{c}`") for c in pages.columns if c not in OUTPUT]
    rows = pages.select(F.struct(*passed).alias("row"), host.alias("host"), path.alias("path")).withColumn("at", F.concat("host", "path"))
    rows = _fitting(rows.withColumn("tokens", F.array_distinct(F.split(F.lower("at"), "[^a-z0-9]+"))), rules)
    best = F.array_max(F.transform(F.filter("fits", lambda r: r["site"]), lambda r: F.struct(F.length(r["name"]).alias("n"), r["name"].alias("name"), r["action"].alias("action"))))
    has = lambda action: F.exists("fits", lambda r: ~r["site"] & (r["action"] == action))
    by_pattern = F.when(has("allow"), "allow").when(has("block"), "block").otherwise(default)
    return rows.withColumn("best", best).select("row.*", "host", "path", F.col("best.name").alias("rule"), F.coalesce(F.col("best.action"), by_pattern).alias("verdict"))
