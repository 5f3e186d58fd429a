"""Sharding by extendible hashing.

A document's key hashes to a string of bits.  A bucket is a prefix of that
string; the directory starts with the empty prefix, and a bucket over its byte
limit splits on the next bit, while the others stay.  So a shard's depth is the
smallest one at which its prefix fits.

Sizes of all prefixes up to ``STEP`` more bits come from one aggregation; only
what is still too large after these goes on, ``STEP`` bits further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stash

DIGITS = 3  # hexadecimal digits, of 4 bits, for each round
STEP = 4 * DIGITS
KEY_ROUNDS = 32 // DIGITS  # of an MD5 hash; then come as many of the text's own
OUTPUT = ("shard", "depth", "n_bytes", "shard_bytes", "shard_docs")


def _digits(key: str, text: str, r: int) -> Column:
    source, at = (F.coalesce(F.col(key).cast("string"), F.lit("")), r) if r < KEY_ROUNDS else (F.coalesce(F.col(text), F.lit("")), r - KEY_ROUNDS)
    return F.substring(F.md5(source), at * DIGITS + 1, DIGITS)


def _prefix(key: str, text: str, rounds: int) -> Column:
    """The bits of the first ``rounds`` rounds, as a string of 0 and 1."""
    return F.concat(*[F.lpad(F.conv(_digits(key, text, r), 16, 2), STEP, "0") for r in range(rounds)]) if rounds else F.lit("")


def extendible_shards(docs: DataFrame, limit_bytes: int, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with shard (its bits), depth, n_bytes, shard_bytes and shard_docs.

    A null key counts as an empty one, a null text as empty.  Rows with one key
    share all of the key's bits; if they're too many for a shard, further bits
    come from the text.  A single text over the limit, or rows that agree in key
    and text, can't be split: they get a shard of their own at the first depth
    where nothing else is in it.  An empty table has no shards.  Columns with
    the names of the results are replaced; others pass through, whatever their names.
    """
    docs = docs.drop(*OUTPUT)
    cell, leaf_of = (next(x for k in range(len(docs.columns) + 1) if (x := f"{name}_{k}_") and not any(c.startswith(x) for c in docs.columns)) for name in ("cell", "leaf"))
    n_bytes = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    rows = docs.withColumn("n_bytes", n_bytes)
    whole = F.xxhash64(F.coalesce(F.col(key_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    left, depth, shard_bytes, shard_docs = rows, F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long")
    r = 0
    while r < 2 * KEY_ROUNDS:
        last = r == 2 * KEY_ROUNDS - 1
        cells = left.groupBy(_prefix(key_col, text_col, r + 1).alias("cell")).agg(
            F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"), F.min(whole).alias("lo"), F.max(whole).alias("hi"))
        depths = cells.select("*", F.explode(F.sequence(F.lit(r * STEP), F.lit((r + 1) * STEP))).alias("d"))
        buckets = depths.groupBy("d", F.substring("cell", F.lit(1), F.col("d")).alias("bits")).agg(
            F.sum("bytes").alias("b"), F.sum("docs").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_set("cell").alias("cells"))
        fits = (F.col("b") <= limit_bytes) | (F.col("lo") == F.col("hi"))
        if last:
            fits |= F.col("d") == (r + 1) * STEP
        leaf = buckets.where(fits).select(F.explode("cells").alias("cell"), F.struct("d", "b", "n").alias("leaf")).groupBy("cell").agg(F.min("leaf").alias("leaf"))
        found = stash(cells.select("cell").join(leaf, "cell", "left").select(F.col("cell").alias(f"{cell}{r}"), F.col("leaf").alias(f"{leaf_of}{r}")), "shard-directory")
        on = _prefix(key_col, text_col, r + 1) == F.col(f"{cell}{r}")
        rows = rows.join(found, on, "left").drop(f"{cell}{r}")
        open_cells = found.where(F.col(f"{leaf_of}{r}").isNull())
        depth = F.coalesce(depth, F.col(f"{leaf_of}{r}.d"))
        shard_bytes, shard_docs = F.coalesce(shard_bytes, F.col(f"{leaf_of}{r}.b")), F.coalesce(shard_docs, F.col(f"{leaf_of}{r}.n"))
        r += 1
        if open_cells.isEmpty():
            break
        left = left.join(open_cells, on, "left_semi")
    return rows.withColumns({"depth": depth, "shard_bytes": shard_bytes, "shard_docs": shard_docs}).withColumn(
        "shard", F.substring(_prefix(key_col, text_col, r), F.lit(1), F.col("depth"))).select(*docs.columns, *OUTPUT)


def write_shards(docs: DataFrame, path: str, limit_bytes: int, key_col: str = "doc_id", text_col: str = "text") -> None:
    """Write one folder of Parquet for each shard, each by one task."""
    shards = extendible_shards(docs, limit_bytes, key_col, text_col)
    shards.repartition("shard").write.partitionBy("shard").parquet(path)
