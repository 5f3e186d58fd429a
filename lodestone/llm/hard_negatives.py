"""Hard negatives by rotated one-bit codes.

Vectors are whole numbers, and scores are their inner products.  Each vector y
is turned by a fixed random rotation (signs and Hadamard steps) and kept as the
signs s of its coordinates, with its length along s and its length off s: the
code's alignment.  An anchor z is turned likewise and cut into levels, whose bit
planes meet the codes as popcounts: these give z's length t along s up to what the
levels round away.  By Cauchy-Schwarz

    |<y, z> - along * t| <= off * sqrt(|z|**2 - t**2)

holds for certain, so every pair has an interval that its score lies in.  Only
pairs whose interval reaches what is asked for are scored, in integers.

Rows are packed into blocks, anchors too, and each block of anchors meets each
block of rows in one record of a join.  Blocks of rows are dealt out once, and each
task gets every block of anchors once, so many at a time that they are small.  A task
keeps the best of each anchor over all its blocks, so what it has found raises the
bar for what follows, and no more than those leave it.  A first pass finds each
anchor's positives, a second one the negatives of each positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import batch_bytes, stash
from .whole_vectors import longest, matrix, usable, whole

LEVELS = 8  # bits of an anchor's coordinate
ROWS, ANCHORS = 1024, 512  # vectors in a block, if they are short
BLOCK_BYTES = 1 << 20  # of a block of long vectors
GROUP, MOST = 4, 256  # blocks of rows in a task, from and to, or so
HELD = 64  # blocks of anchors that are handed over at once, and whose best a task holds
BATCH_BYTES = 8 << 20
TILE = 1 << 15  # pairs that are compared at once
PAIRS = 1 << 16  # scored at once, if they are few among others
DENSE = 1 / 32  # of pairs: where more are asked for, all of a tile are multiplied
_U = np.uint64
_Batches = Iterator[pa.RecordBatch]
_PACK = "ids binary, labels binary, x binary, codes binary, along binary, off binary"
_ASKS = "ids binary, labels binary, x binary, planes binary, scale binary, asks binary"


def rotation(dim: int) -> np.ndarray:
    """Signs of three steps of a rotation of ``dim`` coordinates, filled up to a power of two."""
    return np.random.default_rng(42).choice([-1.0, 1.0], (3, 1 << max(6, (dim - 1).bit_length())))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    width = signs.shape[1]
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    for s in signs:
        y *= s
        h = 1
        while h < width:
            v = y.reshape(len(y), width // (2 * h), 2, h)
            y = np.stack([v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]], axis=2).reshape(len(y), width)
            h *= 2
        y /= np.sqrt(width)
    return y


def _bits(x: np.ndarray) -> np.ndarray:
    return np.packbits(x, axis=1, bitorder="little").view(_U)


def encode(x: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, length along the code's vector, length off it) of each row."""
    y = rotate(x, signs)
    along = np.abs(y).sum(axis=1) / np.sqrt(y.shape[1])
    return _bits(y > 0), along, np.sqrt(np.maximum((y * y).sum(axis=1) - along * along, 0))


def levels(x: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bit planes of the levels (n, LEVELS, words), and for each row: least
    coordinate, step, sum of levels, what rounding changes at most, length)."""
    z = rotate(x, signs)
    least = z.min(axis=1, keepdims=True)
    step = np.maximum((z.max(axis=1, keepdims=True) - least) / ((1 << LEVELS) - 1), 1e-300)
    u = np.rint((z - least) / step)
    lost = np.abs(z - (least + step * u)).sum(axis=1)
    planes = np.stack([_bits((u.astype(np.int64) >> p & 1).astype(bool)) for p in range(LEVELS)], axis=1)
    return planes, np.column_stack([least[:, 0], step[:, 0], u.sum(axis=1), lost, np.sqrt((z * z).sum(axis=1))])


def intervals(planes: np.ndarray, scale: np.ndarray, codes: np.ndarray, along: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (anchors, rows) that the inner products lie between."""
    width = codes.shape[1] * 64
    signs = np.bitwise_count(codes).sum(axis=1, dtype=np.int32) * 2.0 - width
    shape = len(planes), len(codes)
    dots, both, count = np.zeros(shape, np.int32), np.empty(shape, _U), np.empty(shape, np.uint8)
    for p in reversed(range(LEVELS)):
        dots += dots
        for w in range(codes.shape[1]):
            dots += np.bitwise_count(np.bitwise_and(planes[:, p, w, None], codes[:, w], out=both), out=count)
    least, step, total, lost, size = (c[:, None] for c in scale.T)
    least, step, lost = least / np.sqrt(width), step / np.sqrt(width), lost / np.sqrt(width)
    slack = 1e-9 * size  # for what floats round away
    t, more = dots * (2 * step), least * signs
    more -= step * total
    t += more
    reach = np.abs(t)
    reach -= lost
    np.maximum(reach, 0, out=reach)
    reach *= reach
    np.subtract(size * size, reach, out=reach)
    np.maximum(reach, 0, out=reach)
    np.sqrt(reach, out=reach)
    reach += slack
    reach *= off
    reach += np.multiply(along, lost + slack, out=more)
    reach += 1e-6
    t *= along
    np.subtract(t, reach, out=more)
    t += reach
    return more, t


class Block:
    """Rows or anchors of one record."""

    def __init__(self, batch: pa.RecordBatch, row: int, names: list[str], dim: int):
        raw = dict(zip(names, (batch.column(batch.schema.get_field_index(c))[row].as_buffer() for c in names), strict=True))
        self.ids, self.labels = (np.frombuffer(raw[c], np.int64) for c in names[:2])
        self.x = np.frombuffer(raw[names[2]], np.int64).reshape(-1, dim) if dim else np.zeros((len(self.ids), 0), np.int64)
        self.raw = [np.frombuffer(raw[c], np.uint8) for c in names[3:]]
        n = len(self.ids)
        if names[3] == "codes":
            self.codes, self.along, self.off = self.raw[0].view(_U).reshape(n, -1), self.raw[1].view(np.float64), self.raw[2].view(np.float64)
        else:
            self.planes, self.scale = self.raw[0].view(_U).reshape(n, LEVELS, -1), self.raw[1].view(np.float64).reshape(n, -1)
            self.asks = self.raw[2].view(np.int64).reshape(-1, 3)  # row, positive, its score; by row

    @cached_property
    def floats(self) -> np.ndarray:
        return self.x.astype(np.float64)

    @cached_property
    def largest(self) -> float:
        return max(float(self.x.max()), -float(self.x.min())) if self.x.size else 0.0


def _scores(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    parts = [np.einsum("ij,ij->i", a[i[k : k + PAIRS]], b[j[k : k + PAIRS]]) for k in range(0, len(i), PAIRS)]
    return np.concatenate([*parts, np.zeros(0, np.int64)])


class Best:
    """For each of ``n`` askers, the best ``k`` (score, id), and the score that one
    more has to reach."""

    def __init__(self, n: int, k: int):
        self.k, self.bar, self.count = k, np.full(n, -np.inf), np.zeros(n, np.int64)
        self.score, self.id = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)

    def _held(self, askers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, place = np.nonzero(np.arange(self.k) < self.count[askers, None])
        who = askers[i]
        return who, self.score[who, place], self.id[who, place]

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(asker, score, id)"""
        return self._held(np.arange(len(self.count)))

    def add(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(who):
            return
        who, score, ids = (np.concatenate(c) for c in zip(self._held(np.unique(who)), (who, score, ids), strict=True))
        order = np.lexsort((ids, ~score, who))
        who, score, ids = who[order], score[order], ids[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        keep = place < self.k
        who, score, ids, place = who[keep], score[keep], ids[keep], place[keep]
        self.score[who, place], self.id[who, place] = score, ids
        np.maximum.at(self.count, who, place + 1)
        last = place == self.k - 1
        self.bar[who[last]] = score[last]


def _tiles(a: Block, r: Block) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Some of the anchors, and bounds of their scores with all rows."""
    n = max(1, TILE // len(r.ids))
    for k in range(0, len(a.ids), n):
        part = slice(k, k + n)
        yield part, *intervals(a.planes[part], a.scale[part], r.codes, r.along, r.off)


def _pairs(need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.flatnonzero(need), need.shape[1])


def _scored(a: Block, r: Block, part: slice, need: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs of a tile that are needed, if they score from ``least`` to ``most``."""
    if np.count_nonzero(need) > DENSE * need.size and a.largest * r.largest * a.x.shape[1] < 2**53:  # whole numbers, as floats too
        scores = a.floats[part] @ r.floats.T
        need &= scores >= least[part, None]
        need &= scores <= most[part, None]
        i, j = _pairs(need)
        return i + part.start, j, scores[i, j].astype(np.int64)
    i, j = _pairs(need)
    i += part.start
    s = _scores(a.x, r.x, i, j)
    keep = (s >= least[i]) & (s <= most[i])
    return i[keep], j[keep], s[keep]


def _positives(a: Block, r: Block, best: Best) -> int:
    """Rows of the anchors' labels that may be among their best; how many were scored."""
    scored, most = 0, np.full(len(a.ids), np.inf)
    for part, low, high in _tiles(a, r):
        need = (a.labels[part, None] == r.labels) & (a.ids[part, None] != r.ids)
        bar = best.bar.copy()
        if len(r.ids) >= best.k and np.isneginf(bar[part]).any():  # as many certainly reach the k-th largest lower bound
            low[~need] = -np.inf
            bar[part] = np.maximum(bar[part], -np.partition(-low, best.k - 1, axis=1)[:, best.k - 1])
        need &= high >= bar[part, None]
        scored += np.count_nonzero(need)
        i, j, s = _scored(a, r, part, need, bar, most)
        best.add(i, s, r.ids[j])
    return scored


def _negatives(a: Block, r: Block, best: Best, bounds: tuple[np.ndarray, np.ndarray]) -> int:
    """Rows of other labels that may be among the best between the asks' bounds."""
    scored, who, (least, most) = 0, a.asks[:, 0], bounds
    first = np.searchsorted(who, np.arange(len(a.ids) + 1))
    lowest, highest = np.full(len(a.ids), np.inf), np.full(len(a.ids), -np.inf)  # of an anchor's asks
    np.minimum.at(lowest, who, np.maximum(least, best.bar))
    np.maximum.at(highest, who, most)
    for part, low, high in _tiles(a, r):
        need = a.labels[part, None] != r.labels
        need &= high >= lowest[part, None]
        need &= low <= highest[part, None]
        scored += np.count_nonzero(need)
        i, j, s = _scored(a, r, part, need, lowest, highest)
        n = first[i + 1] - first[i]
        pair = np.repeat(np.arange(len(i)), n)
        ask = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + first[i[pair]]
        keep = (s[pair] >= least[ask]) & (s[pair] <= most[ask]) & (s[pair] >= best.bar[ask])
        best.add(ask[keep], s[pair[keep]], r.ids[j[pair[keep]]])
    return scored


def _search(dim: int, k: int, window: tuple[int, int] | None, counted: bool = False) -> Callable[[_Batches], _Batches]:
    """Records of a block of anchors (a, ...) and one of rows to (anchor, positive,
    positive_score, id, score), the best k by anchor, or by positive if there is a
    window of percents; or, if ``counted``, to the numbers of pairs and of scored ones."""
    anchor_names, row_names = [f"a_{c.split()[0]}" for c in _ASKS.split(", ")], [c.split()[0] for c in _PACK.split(", ")]

    def told(a: Block, best: Best) -> pa.RecordBatch:
        who, score, ids = best.all()
        if window is None:
            columns = [a.ids[who], a.ids[who], np.zeros(len(who), np.int64)]
        else:
            columns = [a.ids[a.asks[who, 0]], a.asks[who, 1], a.asks[who, 2]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, ids, score)], ["anchor", "positive", "positive_score", "id", "score"])

    def run(batches: _Batches) -> _Batches:
        held: dict[int, tuple] = {}
        pairs = scored = 0
        for batch in batches:
            numbers = batch.column(batch.schema.get_field_index("a")).to_pylist()
            for row, number in enumerate(numbers):
                if number not in held:
                    a = Block(batch, row, anchor_names[:3] + ["a_planes", "a_scale", "a_asks"], dim)
                    bounds = None
                    if window is not None:  # least * p <= 100 * s <= most * p, in integers
                        p = a.asks[:, 2].astype(object)
                        bounds = tuple(np.array(b, np.int64) for b in (-(-window[0] * p // 100), window[1] * p // 100))
                    held[number] = (a, Best(len(a.ids) if window is None else len(a.asks), k), bounds)
                a, best, bounds = held[number]
                r = Block(batch, row, row_names, dim)
                if len(r.ids):
                    scored += _positives(a, r, best) if window is None else _negatives(a, r, best, bounds)
                    pairs += len(a.ids) * len(r.ids)
        if counted:
            yield pa.RecordBatch.from_arrays([pa.array([pairs]), pa.array([scored])], ["pairs", "scored"])
            return
        for a, best, _ in held.values():
            yield told(a, best)

    return run


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _binary(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in arrays]


def _packs(dim: int, rows: int) -> Callable[[_Batches], _Batches]:
    """Rows (id, label, x) to blocks of ``rows``."""
    signs = rotation(dim)

    def packed(t: pa.Table) -> pa.RecordBatch:
        x = matrix(t["x"].combine_chunks(), dim)
        ids, labels = (t[c].combine_chunks().to_numpy() for c in ("id", "label"))
        return pa.RecordBatch.from_arrays(_binary(ids, labels, x, *encode(x, signs)), _names(_PACK))

    def run(batches: _Batches) -> _Batches:
        held, n = [], 0
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                part = batch.slice(lo, rows - n)
                held.append(part)
                n, lo = n + part.num_rows, lo + part.num_rows
                if n == rows:
                    yield packed(pa.Table.from_batches(held))
                    held, n = [], 0
        if held:
            yield packed(pa.Table.from_batches(held))

    return run


def _ask_pack(dim: int) -> Callable[[pa.Table], pa.Table]:
    """Anchors of a block, with their positives if they have any yet."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        x = matrix(t["x"].combine_chunks(), dim)
        asks = [(i, r["id"], r["score"]) for i, own in enumerate(t["asks"].to_pylist()) for r in own or [] if r["score"] >= 0]
        planes, scale = levels(x, rotation(dim))
        columns = _binary(t["id"].to_numpy(), t["label"].to_numpy(), x, planes, scale, np.array(asks, np.int64).reshape(-1, 3))
        return pa.Table.from_arrays([pa.array(t["a"].to_numpy()[:1]), *columns], ["a", *_names(_ASKS)])

    return run


class Miner:
    """Blocks of the rows, and searches of anchors among them."""

    def __init__(self, rows: DataFrame, dim: int):
        self.rows, self.dim = rows, dim
        self.per = lambda most: max(1, min(most, BLOCK_BYTES // (8 * max(dim, 1))))
        self.packs = stash(rows.select("id", "label", "x").mapInArrow(_packs(dim, self.per(ROWS)), _PACK), "vector-blocks")
        n, cores = self.packs.count(), rows.sparkSession.sparkContext.defaultParallelism
        self.tasks = max(1, min(n // GROUP, max(2 * cores, n // MOST)))

    def search(self, anchors: DataFrame, k: int, window: tuple[int, int] | None = None, counted: bool = False) -> DataFrame:
        """anchors (id, label, x, asks) to the best of each task."""
        n = anchors.count()
        schema = "pairs long, scored long" if counted else "anchor long, positive long, positive_score long, id long, score long"
        if not n:
            return anchors.sparkSession.createDataFrame([], schema)
        blocks = -(-n // self.per(ANCHORS))
        with batch_bytes(anchors.sparkSession, BATCH_BYTES):
            dealt = anchors.withColumn("a", F.pmod(F.xxhash64("id"), F.lit(blocks)))
            asked = stash(dealt.groupBy("a").applyInArrow(_ask_pack(self.dim), f"a long, {_ASKS}"), "anchor-blocks")
            asked = asked.select("a", *[F.col(c).alias(f"a_{c}") for c in _names(_ASKS)])
            found = []
            for lo in range(0, blocks, HELD):  # HELD blocks are small, however many anchors there are
                some = F.broadcast(asked.where(F.col("a").between(lo, lo + HELD - 1)))
                found.append(stash(self.packs.repartition(self.tasks).crossJoin(some).mapInArrow(_search(self.dim, k, window, counted), schema), "found"))
            return reduce(DataFrame.union, found)


def _first(found: DataFrame, k: int) -> DataFrame:
    """Of each positive, the best ``k``, with rank; Spark cuts each task's rows to as many before they move."""
    by = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _prepared(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, int]:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec"))).select("id", F.struct("label", whole(F.col("vec")).alias("x")).alias("own"))
    rows = stash(rows.groupBy("id").agg(F.min("own").alias("own")).select("id", "own.*"), "labelled-vectors")
    return rows, longest(rows)


def hard_negatives(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 10, percents: tuple[int, int] = (30, 90),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor is a row whose ``id`` meets the condition ``anchors``; its positives are the
    ``positives`` other rows of its label with the best scores.  For each of these,
    the ``negatives`` best rows of other labels follow, among those with
    percents[0] * positive_score <= 100 * score <= percents[1] * positive_score.
    Better scores come first, ties by the smaller id.

    Rows without an id, a label or a vector, or with a null or non-finite
    component, take no part.  Ids and labels are whole numbers.  Rows that share an
    id are one row: that with the smallest label and, of these, vector.  A shorter
    vector counts as ending in zeros.  Scores must fit a long.  A positive with a
    negative score has no negatives.  An empty table, or one without anchors,
    gives no rows; other columns aren't read."""
    rows, dim = _prepared(vectors, id_col, vec_col, label_col)
    miner = Miner(rows, dim)
    own = stash(rows.where(anchors), "anchors")
    found = _first(miner.search(own.withColumn("asks", F.lit(None).cast("array<struct<id:bigint,score:bigint>>")), positives), positives)
    asks = found.groupBy(F.col("anchor").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "score"))).alias("asks"))  # ``positives`` at most
    found = _first(miner.search(stash(own.join(asks, "id"), "positives"), negatives, percents), negatives)
    return found.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def scored_share(vectors: DataFrame, anchors: Column, positives: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row: pairs of an anchor and a row, and how many of these the search for positives scored."""
    rows, dim = _prepared(vectors, id_col, vec_col, label_col)
    own = rows.where(anchors).withColumn("asks", F.lit(None).cast("array<struct<id:bigint,score:bigint>>"))
    return Miner(rows, dim).search(own, positives, counted=True).agg(F.sum("pairs").alias("pairs"), F.sum("scored").alias("scored"))
