"""Bounded samples of labelled documents for fitting a model on the driver.

Only fitting uses these; whatever is then predicted or counted covers all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_RANGE = 1 << 20
MAX_CHARS = 1 << 28  # of a sample, which the driver holds


def held_out(id_col: str = "doc_id") -> Column:
    """True for the quarter of ids that no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int, max_chars: int, id_col: str = "doc_id", text_col: str = "text", max_labels: int = 1000) -> list[tuple[str, object]]:
    """At most ``per_label`` (text, label) pairs of each label, from rows that
    aren't held out: the first in the order of a hash of the id.  A text of more
    than ``max_chars`` characters is one of the sample like any other, with that
    many characters from a place that the hash chooses.

    ``labels`` has the id and the label column; of more than ``max_labels`` labels
    the most frequent ones are learned.  All texts together have MAX_CHARS
    characters at most: with very many labels each text is cut to less.  The ids are chosen before any text moves,
    and by a share of the hash's range that each label's count gives, so that a
    label which nearly all rows have doesn't come together in one task."""
    pick = labels.where(F.col(label).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("__id"), F.col(label).alias("__label"))
    pick = pick.join(docs.select(F.col(id_col).alias("__id")), "__id", "left_semi")
    counts = pick.groupBy("__label").count().orderBy(F.desc("count"), "__label").limit(max_labels).collect()
    if not counts:
        return []
    max_chars = max(1, min(max_chars, MAX_CHARS // (per_label * len(counts))))
    hashed = F.pmod(F.xxhash64("__id"), F.lit(_RANGE))
    share = hashed / _RANGE
    most = F.create_map(*[F.lit(x) for r in counts for x in (r["__label"], (2 * per_label + 20) / r["count"])])
    by = Window.partitionBy("__label").orderBy(share, "__id")
    ids = pick.where(share <= F.try_element_at(most, F.col("__label"))).withColumn("__rank", F.row_number().over(by)).where(F.col("__rank") <= per_label).drop("__rank")
    text = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    size = F.length("__text")
    begin = F.when(size > max_chars, F.pmod(F.xxhash64("__id", F.lit(1)), size - max_chars)).otherwise(0).cast("int")
    rows = text.join(F.broadcast(ids), "__id").select(F.substring("__text", begin + 1, F.lit(max_chars)).alias("__text"), "__label", "__id").collect()
    return [(r[0], r[1]) for r in sorted(rows, key=lambda r: (r[2], r[0]))]
