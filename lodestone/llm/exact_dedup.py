"""Exact duplicate removal: a tree merge of sorted digest runs.

Every input partition is one run of (digest, best id, count) rows.  In round r
run i meets run i + 2**r, for i a multiple of 2**(r + 1), as in a binomial tree:
rows are grouped by (run of the pair, digest), which Spark carries out as a sort
of each run, a merge on the map side, an exchange by that key and a multiway merge
of the fetched runs.  The rows of a run stay spread over all tasks by digest, so
no task ever holds a whole run, and a group of equal texts, however large, shrinks
to one row per run before the first exchange and to half as many in each round.
After the last round one run is left, with one row per text.

A merge is verified: rows meet only where the SHA-256, the length in bytes and
an independent 64-bit hash of the text all agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stash

OUTPUT = ("keep_id", "group_size", "kept", "text_sha256")
_KEY = ["text_sha256", "n_bytes", "check"]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 64) -> DataFrame:
    """The rows of ``docs`` with keep_id, group_size, kept and text_sha256.

    Of equal texts the row with the largest id stays.  A null text counts as
    empty, and all empty texts are one group.  Rows that repeat one id and text
    are one document written twice: each is returned, counted, and shares the
    decision.  A null id loses against any other; where a whole group has null
    ids, keep_id is null and all its rows are kept.  Texts of any length are taken
    whole; an empty table gives no rows.  Columns of ``docs`` with the names of the
    four results are replaced; others pass through, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    passed = [F.col(f"`{c}`") for c in docs.columns if c not in OUTPUT]
    rows = docs.select(F.struct(*passed).alias("row"), F.col(id_col).alias("id"), F.sha2(text, 256).alias("text_sha256"), F.octet_length(text).alias("n_bytes"), F.xxhash64(text).alias("check"))
    level = rows.select(*_KEY, F.struct("id").alias("best"), F.lit(1).cast("long").alias("n"), (F.spark_partition_id() % runs).alias("run"))
    left = runs
    while left > 1:
        left = -(-left // 2)
        pair = [F.shiftright("run", 1).alias("run")] if left > 1 else []
        level = level.groupBy(*pair, *_KEY).agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    # Only texts that occur again need a lookup; as a table of its own it lets Spark split a hot text's rows.
    repeated = stash(level.where("n > 1").select(*_KEY, F.col("best.id").alias("best"), F.col("n").alias("group")), "repeated-texts")
    keep = F.when(F.col("group").isNull(), F.col("id")).otherwise(F.col("best"))
    out = rows.join(repeated, _KEY, "left").select("row", "text_sha256", keep.alias("keep_id"), F.coalesce("group", F.lit(1).cast("long")).alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"))
    return out.select("row.*", *OUTPUT)
