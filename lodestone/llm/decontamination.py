"""Benchmark decontamination by latent semantic retrieval.

1. The vocabulary is the benchmark's words; their document frequencies are
   counted over all passages of the corpus.
2. A is the matrix of TF-IDF passages of the corpus, with the benchmark's items
   as further rows that weigh as much as all the others together.  Its right
   singular vectors come from a randomised range finder: one pass over the
   corpus sums A'(A W) for a random W, by blocks of words; the small rest is
   solved on the driver (Nystrom form).
3. Passages and items are projected; an item is a candidate for a passage whose
   projection has at least SHARE of the item's own, at a cosine of COSINE.
   A small space has no room for every item: one whose projection keeps less
   than FAINT of its length, or of under EVIDENCE words, may escape it, and is also
   a candidate wherever one of its anchors occurs, so many of its rarest words
   that a span without any of them can't match it.  found_by says whether the
   space proposed a match, or an anchor alone.
4. A candidate counts if, in a span half as long again as the item, the longest
   common subsequence of words has most of the item's, or somewhat fewer but also
   the item's answer (its last words), which catches paraphrases; and EVIDENCE
   words at least, or all where the item has fewer.  Of the spans that count the
   one with the longest subsequence is reported.

A benchmark of more than MAX_ITEMS items or MAX_BYTES bytes is searched for in
several parts, one after another, as what describes a part is held by the driver
and each task; each part has a space of its own, so that cosine may differ.  For words w and segments s of a part that's about 1.2 kB * w +
0.3 kB * s besides its texts: 1 GB for 10**6 different words and 10**5 segments.

A passage is SPAN cells of CELL words; it begins at every cell of a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import PUNCTUATION, Words, pieces
from .tables import stash

CELL, SPAN, SEGMENT = 16, 4, 48
RANK, EXTRA = 48, 8
SHARE, COSINE = 0.4, 0.25
FAINT = 0.5  # of the length of any of its segments
COPY, PARAPHRASE, ANSWER = 0.8, 0.6, 0.6
EVIDENCE = 8  # words in common at least, or all of a shorter item's
COMMON = 0.01  # words in more of the cells carry no weight
MAX_ITEMS, MAX_BYTES = 50_000, 1 << 25
SCORES = 1 << 23  # products of passages and segments, or numbers of a sparse product, held at once
CANDIDATES, AROUND = 1 << 18, 1 << 21  # anchors, and words around them, looked at together
BLOCK = 64  # words whose sums travel in one row


@dataclass(frozen=True)
class Vocabulary:
    """hash: sorted hashes of the words; near: by the hash's upper 16 bits,
    whether any word begins with them."""

    hash: np.ndarray
    near: np.ndarray

    @staticmethod
    def of(hashes: np.ndarray) -> Vocabulary:
        own = np.unique(hashes)
        near = np.zeros(1 << 16, bool)
        near[(own >> np.uint64(48)).astype(np.int64)] = True
        return Vocabulary(own, near)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h, word numbers) of those that are in the vocabulary."""
        if not len(self.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.near[(h >> np.uint64(48)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        hit = self.hash[k] == h[at]
        return at[hit], k[hit]


class Passages:
    """Vocabulary words of a piece by cell: ``word`` and ``cell`` of each distinct
    pair, ``at`` and ``number`` of each occurrence."""

    def __init__(self, vocabulary: Vocabulary, data: np.ndarray, offs: np.ndarray):
        w = Words(data, offs, lower=True, separator=PUNCTUATION)
        self.words = w
        # SPAN - 1 empty cells behind each document keep passages from reaching the next.
        own = -(-np.diff(w.of) // CELL)
        per_doc = own + SPAN - 1
        self.first_cell = np.concatenate([[0], np.cumsum(per_doc)])
        self.n_cells, self.n_own = int(self.first_cell[-1]), int(own.sum())
        self.doc_of_cell = np.repeat(np.arange(len(per_doc)), per_doc)
        self.padding = np.arange(self.n_cells) - self.first_cell[self.doc_of_cell] >= own[self.doc_of_cell]
        self.at, self.number = vocabulary.find(w.hash)
        doc = w.doc[self.at]
        cell = self.first_cell[doc] + (self.at - w.of[doc]) // CELL
        size = max(1, len(vocabulary.hash))
        pair = np.unique(cell * size + self.number)
        self.cell, self.word = pair // size, pair % size

    def spans(self, by_cell: np.ndarray) -> np.ndarray:
        """Sums over the SPAN cells of a document from each one on."""
        out = by_cell.copy()
        for k in range(1, SPAN):
            out[:-k] += by_cell[k:]
        out[self.padding] = 0
        return out

    def spans_back(self, by_span: np.ndarray) -> np.ndarray:
        """For each cell the sum over the passages that it's in."""
        out = by_span.copy()
        for k in range(1, SPAN):
            out[k:] += by_span[:-k]
        return out


def _sums(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` summed by ``keys``, which are sorted, into n rows."""
    out = np.zeros((n, *values.shape[1:]), np.float32)
    if len(keys):
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        out[keys[first]] = np.add.reduceat(values, first, axis=0)
    return out


def longest_common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[int, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    row = 0
    for x in b:
        if x in where:
            both = row | where[x]
            row = both & ~(both - (row << 1 | 1))
    return row.bit_count()


@dataclass(frozen=True)
class Benchmark:
    ids: list
    words: list[np.ndarray]  # word numbers in order

    def segments(self) -> list[tuple[int, np.ndarray]]:
        """(item, word numbers) of parts that a passage can hold; the last one of
        several is as long as the others."""
        return [(k, w[max(0, min(lo, len(w) - SEGMENT)) : lo + SEGMENT]) for k, w in enumerate(self.words) for lo in range(0, len(w), SEGMENT)]


def _least(n: int, share: float) -> int:
    """The smallest count that is at least ``share`` of n."""
    return next(c for c in range(max(0, int(share * n) - 1), n + 1) if c / n >= share)


def _tail(w):
    """The last words of an item, its answer."""
    return w[-max(2, len(w) // 4) :]


def _rarest(w: np.ndarray, df: np.ndarray, need: int) -> np.ndarray:
    """Words of which any ``need`` places of ``w`` hold one."""
    return np.unique(w[np.argsort(df[w], kind="stable")[: len(w) - need + 1]])


def _need(n: int, share: float) -> int:
    """Words of an item of n that a common subsequence must have."""
    return max(_least(n, share), min(n, EVIDENCE))


def _needs(items: Benchmark) -> np.ndarray:
    """The shortest common subsequence that can count, by item."""
    return np.array([_need(len(w), min(PARAPHRASE, COPY)) for w in items.words])


def _anchors(df: np.ndarray, items: Benchmark, faint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds by word, items) of the anchors of the items in ``faint``: every span
    that matches an item holds one of its anchors."""
    words = []
    for w, need, wanted in zip(items.words, _needs(items).tolist(), faint.tolist(), strict=True):
        if not wanted:
            words.append(w[:0])
            continue
        # Any match has one of the first; a copy or the answer of a paraphrase has one of the others.
        any_match = _rarest(w, df, need)
        either = np.union1d(_rarest(w, df, _need(len(w), COPY)), _rarest(_tail(w), df, _least(len(_tail(w)), ANSWER)))
        words.append(min(any_match, either, key=lambda x: df[x].sum()))
    word, item = np.concatenate(words), np.repeat(np.arange(len(words)), [len(x) for x in words])
    return np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(df)))]), item[np.argsort(word, kind="stable")]


class Near:
    """Finds where an item may be, by anchors and by how many of its words are around."""

    def __init__(self, df: np.ndarray, items: Benchmark, faint: np.ndarray):
        self.bounds, self.items = _anchors(df, items, faint)
        self.needs, self.size = _needs(items), len(df)
        keys = [np.unique(w, return_counts=True) for w in items.words]
        self.keys = np.concatenate([k * self.size + w for k, (w, _) in enumerate(keys)])  # sorted
        self.times = np.concatenate([n for _, n in keys])
        self.widths = np.array([_width(len(w)) for w in items.words])

    def places(self, p: Passages) -> tuple[np.ndarray, np.ndarray]:
        """(items, word positions) of the anchors around which as many of the
        item's words are found as a match has."""
        n = (self.bounds[1:] - self.bounds[:-1])[p.number]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        ends = np.cumsum(n)
        lo = 0
        while lo < len(n):
            done = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + CANDIDATES, "right")))
            at = np.repeat(np.arange(lo, hi), n[lo:hi])
            item = self.items[self.bounds[p.number[at]] + np.arange(len(at)) - (ends[at] - n[at] - done)]
            found += self._kept(p, item, p.at[at])
            lo = hi
        items, places = zip(*found, strict=True)
        return np.concatenate(items), np.concatenate(places)

    def _kept(self, p: Passages, item: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        doc, width = p.words.doc[x], self.widths[item]
        first = np.searchsorted(p.at, np.maximum(x - width + 1, p.words.of[doc]))
        count = np.searchsorted(p.at, np.minimum(x + width, p.words.of[doc + 1])) - first
        enough = np.flatnonzero(count >= self.needs[item])
        ends = np.cumsum(count[enough])
        lo = 0
        while lo < len(enough):
            done = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + AROUND, "right")))
            own = enough[lo:hi]
            lo = hi
            which = np.repeat(np.arange(len(own)), count[own])
            around = np.arange(len(which)) + np.repeat(first[own] - np.cumsum(count[own]) + count[own], count[own])
            key = item[own][which] * self.size + p.number[around]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[k] == key
            which, k = which[hit], k[hit]
            fits = np.bincount(which, minlength=len(own)) >= self.needs[item[own]]
            use = fits[which]
            pair = np.unique(which[use] * len(self.keys) + k[use])
            places = np.bincount(pair // len(self.keys), self.times[pair % len(self.keys)], len(own))
            own = own[places >= self.needs[item[own]]]
            yield item[own], x[own]


def _width(n: int) -> int:
    """Spans a little longer than an item of n words: scattered words of a longer text are no copy."""
    return n + n // 2


def _step(n: int) -> int:
    """From the begin of one span to the next's."""
    return max(1, n // 4)


def _parts(benchmark: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    """The benchmark (id, text) in parts that the driver can hold."""
    known = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    count = max(-(-n // MAX_ITEMS), -(-size // MAX_BYTES))
    if count <= 1:
        return [known]
    # Half as many again, as they are dealt at random, once and for all.
    count += count // 2 + 1
    dealt = stash(known.withColumn("part", F.floor(F.rand(1) * count).cast("int")), "benchmark")
    return [dealt.where(F.col("part") == k).select("id", "text") for k in range(count)]


def _read_benchmark(part: DataFrame) -> tuple[Vocabulary, Benchmark]:
    rows = part.collect()
    hashes = []
    for r in rows:
        raw = np.frombuffer(r["text"].encode(), np.uint8)
        hashes.append(Words(raw, np.array([0, len(raw)]), lower=True, separator=PUNCTUATION).hash)
    vocabulary = Vocabulary.of(np.concatenate([np.zeros(0, np.uint64), *hashes]))
    keep = [k for k, h in enumerate(hashes) if len(h)]
    return vocabulary, Benchmark([rows[k]["id"] for k in keep], [vocabulary.find(hashes[k])[1] for k in keep])


class Segments:
    """Segments of items as rows of a sparse matrix: (segment, word, weight),
    multiplied by blocks of segments."""

    def __init__(self, items: Benchmark, idf: np.ndarray):
        parts = items.segments()
        self.owner = np.array([k for k, _ in parts])
        words = [np.unique(w) for _, w in parts]
        self.bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        self.word = np.concatenate(words)
        self.weight = idf[self.word]
        self.norms = np.sqrt(np.add.reduceat(self.weight.astype(np.float64) ** 2, self.bounds[:-1]))

    def _blocks(self, width: int) -> Iterator[tuple[int, int]]:
        lo, n = 0, len(self.owner)
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(self.bounds, self.bounds[lo] + SCORES // width, "right")) - 1)
            yield lo, hi
            lo = hi

    def times(self, right: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.owner), right.shape[1]), np.float32)
        for lo, hi in self._blocks(right.shape[1]):
            a, b = self.bounds[lo], self.bounds[hi]
            out[lo:hi] = np.add.reduceat(self.weight[a:b, None] * right[self.word[a:b]], self.bounds[lo:hi] - a, axis=0)
        return out

    def add_gram(self, sums: np.ndarray, right: np.ndarray, weight: float) -> None:
        """Adds weight * U'(U right) to ``sums``, U being the rows at unit length."""
        inverse = 1 / np.maximum(self.norms, 1e-6)
        y = self.times(right) * (inverse**2)[:, None]
        for lo, hi in self._blocks(right.shape[1]):
            a, b = self.bounds[lo], self.bounds[hi]
            row = np.repeat(np.arange(lo, hi), np.diff(self.bounds[lo : hi + 1]))
            np.add.at(sums, self.word[a:b], weight * self.weight[a:b, None] * y[row])


def _frequencies(texts: DataFrame, vocabulary) -> tuple[np.ndarray, int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cells = np.zeros(len(vocabulary.value.hash), np.int64), 0
        for _, data, offs in pieces(batches, "text"):
            p = Passages(vocabulary.value, data, offs)
            own += np.bincount(p.word, minlength=len(own))
            cells += p.n_own
        seen = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(own[seen], cells))], ["word", "n"])

    out, cells = np.zeros(len(vocabulary.value.hash), np.int64), 0
    # A row for each word of the benchmark comes back.
    for r in texts.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        if r["word"] < 0:
            cells = int(r["n"])
        else:
            out[r["word"]] = r["n"]
    return out, cells


def _weights(df: np.ndarray, cells: int, items: Benchmark) -> np.ndarray:
    """IDF; words in many cells get none, but for the rarest half of each item's."""
    idf = np.log1p(max(cells, 1) / np.maximum(df, 1)).astype(np.float32)
    content = df <= COMMON * cells
    for w in items.words:
        own = np.unique(w)
        content[own[np.argsort(df[own], kind="stable")[: max(8, len(own) // 2)]]] = True
    return np.where(content, idf, 0).astype(np.float32)


def _sketch(texts: DataFrame, vocabulary, weights, omega) -> tuple[np.ndarray, float]:
    """(A'(A W) by word, the squared Frobenius norm of A) over all passages."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, idf, w = vocabulary.value, weights.value, omega.value
        lift, square = w * idf[:, None], idf**2
        total, norm = np.zeros((len(idf), w.shape[1]), np.float32), 0.0
        for _, data, offs in pieces(batches, "text"):
            p = Passages(v, data, offs)
            use = idf[p.word] > 0
            word, cell = p.word[use], p.cell[use]
            if not len(word):
                continue
            size = p.spans(_sums(cell, square[word], p.n_cells))  # squared lengths
            norm += float((size > 0).sum())
            y = p.spans(_sums(cell, lift[word], p.n_cells))
            y /= np.maximum(size, 1e-12)[:, None]
            g = p.spans_back(y)
            order = np.argsort(word, kind="stable")
            total += _sums(word[order], g[cell[order]], len(idf))
        total *= idf[:, None]
        blocks = range(0, len(idf), BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK for b in blocks] + [-1], pa.int64()), pa.array([total[b : b + BLOCK].tobytes() for b in blocks] + [np.float32([norm]).tobytes()], pa.binary())], ["block", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(sums, np.float32).astype(np.float64)
                own[block] = own[block] + part if block in own else part
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([x.tobytes() for x in own.values()], pa.binary())], ["block", "sums"])

    schema = "block long, sums binary"
    rows = {r["block"]: np.frombuffer(r["sums"]) for r in texts.select("text").mapInArrow(add, schema).repartition("block").mapInArrow(merge, schema).collect()}
    width = omega.value.shape[1]
    out = [rows[b // BLOCK].reshape(-1, width) for b in range(0, len(weights.value), BLOCK) if b // BLOCK in rows]
    return (np.concatenate(out) if out else np.zeros((len(weights.value), width))), float(rows.get(-1, np.zeros(1))[0])


def _basis(sums: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Right singular vectors of a matrix A from A'A W and W."""
    core = omega.T @ sums
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-9
    half = sums @ (vectors[:, good] / np.sqrt(values[good]))
    return np.linalg.svd(half, full_matrices=False)[0][:, :RANK].astype(np.float32)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", seed: int = 5) -> DataFrame:
    """doc_id, item_id, cosine, lcs (share of the item's words), answer (share of
    its last ones) and found_by (latent or anchor), a row for each document and item
    that it leaks.

    Null, empty and wordless texts, of documents or items, match nothing; an
    empty benchmark or corpus gives no rows.  Repeated rows and rows with a null
    id each match; items with equal texts are both reported.  Texts of any length
    are searched whole, and other columns aren't read, whatever their names.
    """
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, cosine double, lcs double, answer double, found_by string"
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return reduce(DataFrame.unionByName, [_find_part(texts, part, schema, seed) for part in _parts(benchmark, item_col, item_text)])


def _find_part(texts: DataFrame, part: DataFrame, schema: str, seed: int) -> DataFrame:
    spark = texts.sparkSession
    words, items = _read_benchmark(part)
    if not items.ids:
        return spark.createDataFrame([], schema)
    vocabulary = spark.sparkContext.broadcast(words)
    df, cells = _frequencies(texts, vocabulary)
    idf = _weights(df, cells, items)
    weights = spark.sparkContext.broadcast(idf)
    omega = np.random.default_rng(seed).normal(size=(len(idf), RANK + EXTRA)).astype(np.float32)
    sums, norm = _sketch(texts, vocabulary, weights, spark.sparkContext.broadcast(omega))
    segments = Segments(items, idf)
    segments.add_gram(sums, omega, max(norm, 1.0) / len(segments.owner))
    basis = _basis(sums, omega)
    targets = segments.times(basis)
    faint = np.zeros(len(items.ids), bool)
    faint[segments.owner[np.linalg.norm(targets, axis=1) < FAINT * segments.norms]] = True
    faint |= np.array([len(w) < EVIDENCE for w in items.words])  # too few words for a direction of their own
    model = spark.sparkContext.broadcast((basis * idf[:, None], targets, segments.owner, items, idf > 0, Near(df, items, faint)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lift, targets, owner, known, content, near = model.value
        sizes = np.linalg.norm(targets, axis=1)
        sequences = [w.tolist() for w in known.words]
        item_type_pa = pa.array(known.ids).type
        for batch, data, offs in pieces(batches, "text"):
            p = Passages(vocabulary.value, data, offs)
            use = content[p.word]
            spans = p.spans(_sums(p.cell[use], lift[p.word[use]], p.n_cells))
            size = np.linalg.norm(spans, axis=1)
            # A projection shorter than that can't have the share of any item.
            far = np.flatnonzero(size >= SHARE * sizes.min())
            # Words of the document where spans that may match begin.
            candidates: dict[tuple[int, int], set[int]] = {}
            at_once = max(1, SCORES // len(targets))
            for lo in range(0, len(far), at_once):
                own = far[lo : lo + at_once]
                dots = spans[own] @ targets.T
                hit = (dots >= SHARE * sizes**2) & (dots >= COSINE * size[own][:, None] * sizes) & (sizes > 0)
                for r, s in zip(*(x.tolist() for x in np.nonzero(hit)), strict=True):
                    doc, item = int(p.doc_of_cell[own[r]]), int(owner[s])
                    begin, reach = (int(own[r]) - int(p.first_cell[doc])) * CELL, len(sequences[item])
                    step = _step(reach)
                    candidates.setdefault((doc, item), set()).update(range(max(0, (begin - reach) // step) * step, begin + SPAN * CELL + 1, step))
            latent = set(candidates)
            for item, x in zip(*(x.tolist() for x in near.places(p)), strict=True):
                doc, reach = int(p.words.doc[x]), len(sequences[item])
                x -= int(p.words.of[doc])
                step = _step(reach)
                candidates.setdefault((doc, item), set()).update(range(max(0, (x - _width(reach)) // step + 1) * step, x + 1, step))
            at, number = p.at, p.number
            out: list[tuple[int, int, float, float, float, str]] = []
            for (doc, item), begins in candidates.items():
                sequence = sequences[item]
                tail = _tail(sequence)
                reach = len(sequence)
                best = None
                width, of = _width(reach), int(p.words.of[doc])
                for begin in sorted(begins):
                    lo, hi = np.searchsorted(at, [of + begin, min(of + begin + width, p.words.of[doc + 1])])
                    if hi - lo < near.needs[item]:
                        continue
                    part = number[lo:hi].tolist()
                    lcs, answer = longest_common(sequence, part) / len(sequence), longest_common(tail, part) / len(tail)
                    if lcs * reach > near.needs[item] - 0.5 and (lcs >= COPY or lcs >= PARAPHRASE and answer >= ANSWER):
                        best = max(best or (0.0, 0.0, 0), (lcs, answer, -begin))
                    if lcs == 1:
                        break
                if best:
                    lcs, answer, begin = best
                    # The most alike of the passages that reach into the span.
                    cells = np.arange(max(0, -begin // CELL - SPAN + 1), (width - begin - 1) // CELL + 1) + p.first_cell[doc]
                    cells, own = cells[cells < p.first_cell[doc + 1]], np.flatnonzero(owner == item)
                    cosine = spans[cells] @ targets[own].T / np.maximum(size[cells][:, None] * sizes[own], 1e-12)
                    out.append((doc, item, float(cosine.max()), lcs, answer, "latent" if (doc, item) in latent else "anchor"))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array([known.ids[k] for k in columns[1]], item_type_pa), *(pa.array(c, pa.float64()) for c in columns[2:5]), pa.array(columns[5], pa.string())],
                ["doc_id", "item_id", "cosine", "lcs", "answer", "found_by"])

    return texts.mapInArrow(search, schema)
