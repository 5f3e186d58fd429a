"""Removal of repeated passages by prefix-partitioned suffix trees.

A suffix begins at each word of a document; of its tree only the nodes down to
WINDOW words matter, and a window repeats where two suffixes share a node at
that depth.  The tree is built in parts that fit a task's memory, each with the
suffixes that share a prefix:

1. Every window is assigned the smallest of its PREFIX-word runs by hash, its
   anchor.  Equal windows have equal anchors, and neighbouring windows mostly
   the same one, so anchors are few.  Anchors are counted over the whole corpus,
   with the bytes of the windows that they stand for; windows whose anchor occurs
   once can't repeat and go no further.
2. The others go to the subtree of their anchor, all windows of one occurrence as
   one row with their words.  Where these are more than a subtree may hold, the
   windows go to subtrees of longer prefixes, of LONGER words each: of those that
   repeat within a piece of text only the first is sent, as the others are known
   to be repeats.  A subtree that is still too large passes its windows on to the
   next longer prefix, in another round, until each fits; at WINDOW words all
   suffixes of a subtree are the same leaf, and its first one is all that is held.
3. A subtree sorts its suffixes by their words and takes the longest common prefix
   of neighbours; runs that agree to the full depth are its deep internal nodes,
   whose first suffix in document order is the one that stays.  Words are compared
   by their bytes: hashes only bring suffixes together.  Neighbouring repeats merge
   to maximal stretches.

Texts move once, by document id, for the second step and the last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import Words, exact_ids, pieces, utf8_buffers
from .tables import stash

WINDOW, PREFIX = 20, 8
LONGER = (14, WINDOW)
GROUP_BYTES = 4 << 20
_LEN = 1 << 20
_ROWS = "key long, level int, id long, at long, text binary"
_SLICE = 8 << 20


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, its anchor's first word, hash by word of the
    prefix that begins there)."""
    total = len(w.start)
    at, h = w.windows(PREFIX)
    gram = np.full(total, np.iinfo(np.uint64).max, np.uint64)
    gram[at] = h
    n = total - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), gram
    begin = np.flatnonzero(w.doc[:n] == w.doc[WINDOW - 1 :])
    steps = WINDOW - PREFIX + 1
    low = gram[:n].copy()
    where = np.zeros(n, np.int64)
    for k in range(1, steps):
        smaller = gram[k : n + k] < low
        low[smaller] = gram[k : n + k][smaller]
        where[smaller] = k
    return begin, begin + where[begin], gram


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the runs of equal values."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(x[1:] != x[:-1]) + 1
    return np.concatenate([[0], cut]), np.append(cut, len(x))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offs in pieces(batches, "text"):
        w = Words(data, offs)
        begin, anchor, gram = anchors(w)
        lo, hi = _runs(anchor)
        at = anchor[lo]
        size = w.end[begin[hi - 1] + WINDOW - 1] - w.start[begin[lo]]
        doc = w.doc[at]
        yield pa.RecordBatch.from_arrays([pa.array(gram[at].view(np.int64)), batch.column(0).take(pa.array(doc)), pa.array((at - w.of[doc]).astype(np.int32)), pa.array(size)], ["prefix", "id", "at", "size"])


def _stretches(order_doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows sorted by document and start: (first of each stretch, length)."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (order_doc[1:] != order_doc[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(fresh)
    return first, np.diff(np.append(first, len(start)))


def suffix_order(words: np.ndarray, begin: np.ndarray, group: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, depth): suffixes sorted by subtree, words, document and start, and
    for each the words, up to WINDOW, that it has in common with the one before."""
    bits = max(1, int(words.max(initial=0)).bit_length())
    columns = []
    for lo in range(0, WINDOW, 64 // bits):
        packed = np.zeros(len(begin), np.uint64)
        for k in range(lo, min(lo + 64 // bits, WINDOW)):
            packed = (packed << np.uint64(bits)) | words[begin + k].astype(np.uint64)
        columns.append(packed)
    order = np.lexsort((start, doc, *reversed(columns), group))
    depth = np.zeros(len(order), np.int64)
    at, group = begin[order], group[order]
    same = group[1:] == group[:-1]
    for k in range(WINDOW):
        same = same & (words[at[1:] + k] == words[at[:-1] + k])
        depth[1:] += same
    return order, depth


def _again(words: np.ndarray, begin: np.ndarray, group: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix: (whether it's the first of its deep node, whether it
    repeats another one).  A document given twice repeats nothing by itself."""
    order, depth = suffix_order(words, begin, group, doc, start)
    first = depth < WINDOW
    lead = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    doc, start = doc[order], start[order]
    own = (doc == doc[lead]) & (start == start[lead])
    out = np.zeros((2, len(order)), bool)
    out[0, order], out[1, order] = first, ~own
    return out[0], out[1]


def _repeat_rows(doc: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """(document, start and length in one) of each stretch; a row holds at most
    _LEN - 1 windows, a longer stretch has several."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    first, length = _stretches(doc, start)
    rows = -(-length // (_LEN - 1))
    done = (np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)) * (_LEN - 1)
    first, length = np.repeat(first, rows), np.repeat(length, rows)
    return [doc[first], (start[first] + done) * _LEN + np.minimum(length - done, _LEN - 1)]


def _cut(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """The bytes from each lo to hi."""
    offs = np.concatenate([[0], np.cumsum(hi - lo)])
    at = np.arange(offs[-1]) + np.repeat(lo - offs[:-1], hi - lo)
    return pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data[at])])


def _rows_of(key: np.ndarray, level: int, ids: np.ndarray, at: np.ndarray, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(hi - lo)
    a = 0
    while a < len(lo):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _SLICE, "right")))
        yield pa.RecordBatch.from_arrays([pa.array(key[a:b].view(np.int64)), pa.array(np.full(b - a, level, np.int32)), pa.array(ids[a:b]), pa.array(at[a:b]), _cut(data, lo[a:b], hi[a:b])], ["key", "level", "id", "at", "text"])
        a = b


def _repeats(doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Known repeats: rows without words, whose ``at`` is a stretch."""
    ids, stretch = _repeat_rows(doc, start)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.zeros(len(ids), np.int32)), pa.array(ids), pa.array(stretch), pa.nulls(len(ids), pa.binary())], ["key", "level", "id", "at", "text"])


def _by_prefix(w: Words, begin: np.ndarray, level: int, ids: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Single windows (first words ``begin``) as rows of the subtrees of a longer prefix."""
    at, h = w.windows(LONGER[level - 1])
    yield from _rows_of(h[np.searchsorted(at, begin)], level, ids, start, w.data, w.start[begin], w.end[begin + WINDOW - 1])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with common anchors to rows of subtrees."""
    for batch, data, offs in pieces(batches, "text"):
        w = Words(data, offs)
        begin, anchor, gram = anchors(w)
        state = np.zeros(len(w.start), np.int8)  # 1: a common prefix, 2: one with too many windows
        marks = batch.column(batch.schema.get_field_index("marks"))
        places, values = marks.offsets.to_numpy(), marks.values.to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(places))
        own = values[places[0] : places[-1]]
        state[w.of[doc] + own // 2] = 1 + own % 2
        kind = state[anchor]
        ids = batch.column(batch.schema.get_field_index("id")).to_numpy()
        lo, hi = _runs(anchor)
        use = kind[lo] == 1
        lo, hi = lo[use], hi[use] - 1
        first = begin[lo]
        of = w.doc[first]
        yield from _rows_of(gram[anchor[lo]], 0, ids[of], first - w.of[of], data, w.start[first], w.end[begin[hi] + WINDOW - 1])
        hot = begin[kind == 2]
        if len(hot):
            of = w.doc[hot]
            leads, again = _again(exact_ids(w), hot, np.zeros(len(hot), np.int8), ids[of], hot - w.of[of])
            yield _repeats(ids[of][again], (hot - w.of[of])[again])
            yield from _by_prefix(w, hot[leads], 1, ids[of][leads], (hot - w.of[of])[leads])


class _Subtrees:
    """Subtrees of rows that come sorted by key, document and place.  What is held
    is at most about ``limit`` bytes of words, whatever a subtree's size: of one
    that is larger only the first suffix of each deep node is kept, and if these
    are too many, they and all that follows go on to longer prefixes."""

    def __init__(self, limit: int):
        self.limit, self.held, self.size = limit, [], 0
        self.passed: tuple[int, int] | None = None  # key and level of the subtree that goes on

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.passed is not None:
            on = (batch.column(0).to_numpy() == self.passed[0]) & (batch.column(1).to_numpy() == self.passed[1])
            if on.any():
                yield from self._pass_on(batch.filter(pa.array(on)))
                batch = batch.filter(pa.array(~on))
            if batch.num_rows:
                self.passed = None
        if batch.num_rows:
            self.held.append(batch)
            self.size += batch.column(4).nbytes
        if self.size > self.limit:
            yield from self._build(False)

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self._build(True)

    def _expand(self, rows: pa.RecordBatch) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
        """(words, row of each suffix, its first word, its place in the document)."""
        w = Words(*utf8_buffers(rows.column(4)))
        n = np.diff(w.of) - WINDOW + 1
        row = np.repeat(np.arange(rows.num_rows), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return w, row, w.of[row] + k, rows.column(3).to_numpy()[row] + k

    def _pass_on(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        w, row, begin, start = self._expand(rows)
        yield from _by_prefix(w, begin, self.passed[1] + 1, rows.column(2).to_numpy()[row], start)

    def _build(self, last: bool) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        rows = pa.Table.from_batches(self.held).combine_chunks().to_batches()[0]
        key, level = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (level[1:] != level[:-1]))])
        w, row, begin, start = self._expand(rows)
        doc = rows.column(2).to_numpy()[row]
        leads, again = _again(exact_ids(w), begin, group[row], doc, start)
        yield _repeats(doc[again], start[again])
        self.held, self.size = [], 0
        if last:
            return
        # The last subtree may go on in the next batch.
        keep = (group == group[-1]) & (np.bincount(row, leads, rows.num_rows) > 0)
        rest = rows.filter(pa.array(keep))
        size = int((w.end[w.of[1:] - 1] - w.start[w.of[:-1]])[keep].sum())
        if size > self.limit and level[-1] < len(LONGER):
            self.passed = (key[-1], level[-1])
            yield from self._pass_on(rest)
        else:
            # A copy, so that the words of the other subtrees are released.
            self.held, self.size = [pa.concat_batches([rest])], size


def _subtrees(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _Subtrees(limit)
        for batch in batches:
            words = batch.column(4)
            yield batch.filter(words.is_null())
            yield from trees.add(batch.filter(words.is_valid()))
        yield from trees.end()

    return run


def _removal(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in pieces(batches, "text"):
            found = batch.column(batch.schema.get_field_index("stretches"))
            n_words, n_removed, sha, kept_texts = [], [], [], []
            raw = data.tobytes()
            for k, own in enumerate(found.to_pylist()):
                words = raw[offs[k] : offs[k + 1]].split()
                total = len(words)
                if own:
                    drop = np.zeros(total + 1, np.int64)
                    at = np.array(own, np.int64)
                    np.add.at(drop, np.minimum(at // _LEN, total), 1)
                    np.add.at(drop, np.minimum(at // _LEN + at % _LEN + WINDOW - 1, total), -1)
                    keep = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
                    words = [words[i] for i in keep.tolist()]
                joined = b" ".join(words)
                n_words.append(total)
                n_removed.append(total - len(words))
                sha.append(hashlib.sha256(joined).hexdigest())
                if texts:
                    kept_texts.append(joined.decode())
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if texts:
                columns.append(pa.array(kept_texts, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row; with ``texts``
    also kept_text, the words that stay, joined by one space.

    A word goes if a window of WINDOW words that covers it has begun earlier, in
    a document with a smaller id or before it in its own; windows are those of
    the input.  Ids are whole numbers and unique; a row given twice counts as
    one document, and each copy gets its result.  A null or empty text has no
    words; a row with a null id has no place in the order and keeps its words.
    Texts of any length are taken whole, and an empty table gives no rows.  Other
    columns aren't read, whatever their names.  ``group_bytes`` bounds the words
    that a subtree holds at once.
    """
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = every.where("id IS NOT NULL")
    prefixes = named.mapInArrow(_anchors, "prefix long, id long, at int, size long")
    common = prefixes.groupBy("prefix").agg(F.count("*").alias("n"), F.sum("size").alias("size")).where("n > 1")
    common = stash(common.select("prefix", (F.col("size") > group_bytes).cast("int").alias("hot")), "common-prefixes")
    marks = prefixes.drop("size").join(common, "prefix").select("id", (F.col("at").cast("long") * 2 + F.col("hot")).alias("mark"))
    marks = marks.groupBy("id").agg(F.collect_set("mark").alias("marks"))
    rows = named.join(marks, "id").select("id", "text", "marks").mapInArrow(_windows, _ROWS)
    found = None
    while True:  # at most once for each prefix length
        rows = stash(rows.repartition("key").sortWithinPartitions("key", "level", "id", "at").mapInArrow(_subtrees(group_bytes), _ROWS), "repeats")
        own = rows.where("text IS NULL").select("id", "at")
        found = own if found is None else found.unionByName(own)
        rows = rows.where("text IS NOT NULL")
        if rows.isEmpty():
            break
    repeats = found.groupBy("id").agg(F.collect_list("at").alias("stretches"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    out = named.join(repeats, "id", "left").select("id", "text", "stretches")
    nameless = every.where("id IS NULL").withColumn("stretches", F.lit(None).cast("array<long>"))
    return out.unionByName(nameless).mapInArrow(_removal(texts), schema)
