"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document's set is its distinct shingles of five words.  Its signature has
CHUNKS * WIDTH symbols, each b bits of a minimum under another hash function;
the distance of two signatures is the number of symbols that differ.  If it's
at most ``CHUNKS * (ERRORS + 1) - 1``, then by the pigeonhole principle some
chunk has at most ERRORS differing symbols.  So each chunk is looked up once for
every way to leave out ERRORS of its symbols, and every pair under that distance
shares a key.  (At a similarity of 0.75, a pair above that distance still shares
one but for a chance of about 1e-6.)

Documents with equal sets are one class from the start; classes, numbered when
they are written, and not ids are what is linked: sets are equal if 128 bits of
independent hashes and the size agree.  At first each class is paired with one other only, the smallest that it
shares a key with; then, in groups that the links so found haven't joined, with
the smallest and the largest of its key's members, ROUNDS times in all: a group of
copies costs pairs in proportion to its size.  Pairs whose signatures differ too much (LOOSE) end there; only the
others meet with their sets.  Where members are in different components after
that, blocks of at most BLOCK of them meet in one task with the lower half of
their shingles' bits: pairs of different components under LOOSE compare these
sets there, and only pairs that are similar up to SLACK shingles go on.

Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import Words, mix64, pieces
from .components import connected_components
from .tables import batch_bytes, discard, stash

SHINGLE = 5
CHUNKS, WIDTH, ERRORS, BITS = 14, 5, 1, 14
LOOSE = 40  # of 70 symbols; a similarity of 0.75 exceeds it with a chance of about 1e-8
PERCENT = 75
ROUNDS, BLOCK, SLACK = 2, 1024, 2
SET_BYTES = 8 << 20
GROUP = ["key", "i", "j"]
_PAIR, _SETS = "a long, b long", "node long, symbols binary, hashes binary"
_U = np.uint64
_FACTORS = mix64(np.arange(1, CHUNKS * WIDTH + 1, dtype=_U) * _U(0xA24BAED4963EE407)) | _U(1)


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted within each document; independent hashes
    of the same shingles; offsets).  Fewer words than a shingle has are one
    shingle; no words are none."""
    w = Words(data, offs, lower=True)
    other = w.second_hash(lower=True)
    words = np.diff(w.of)
    at, h = w.windows(SHINGLE)
    docs, hashes, others = [w.doc[at]], [h], [w.windows(SHINGLE, other)[1]]
    for n in range(1, SHINGLE):
        if not (words == n).any():
            continue
        at, h = w.windows(n)
        whole = words[w.doc[at]] == n
        docs.append(w.doc[at][whole])
        hashes.append(h[whole])
        others.append(w.windows(n, other)[1][whole])
    doc, h, h2 = np.concatenate(docs), np.concatenate(hashes), np.concatenate(others)
    order = np.lexsort((h, doc))
    doc, h, h2 = doc[order], h[order], h2[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], h2[new], np.searchsorted(doc[new], np.arange(len(offs)))


def signatures(h: np.ndarray, h2: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of documents with a set, 128 bits that identify each set, symbols)."""
    rows = np.flatnonzero(np.diff(of))
    first = of[:-1][rows]
    if not len(rows):
        return rows, np.zeros((0, 2), np.int64), np.zeros((0, CHUNKS * WIDTH), np.uint16)
    identity = np.column_stack([np.add.reduceat(mix64(x), first) for x in (h, h2)])
    symbols = np.empty((len(rows), CHUNKS * WIDTH), _U)
    for j, factor in enumerate(_FACTORS):
        symbols[:, j] = np.minimum.reduceat(h * factor, first)
    return rows, identity.view(np.int64), (mix64(symbols) & _U((1 << BITS) - 1)).astype(np.uint16)


def keys_of(symbols: np.ndarray) -> np.ndarray:
    """For each symbol, its place and its chunk without it, in one number."""
    keys = np.empty(symbols.shape, _U)
    for j in range(CHUNKS * WIDTH):
        chunk = j - j % WIDTH
        packed = np.full(len(symbols), j, _U)
        for k in range(chunk, chunk + WIDTH):
            if k != j:
                packed = (packed << _U(BITS)) | symbols[:, k].astype(_U)
        keys[:, j] = packed
    return keys.view(np.int64)


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), CHUNKS * WIDTH)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offs in pieces(batches, "text"):
        h, h2, of = shingle_sets(data, offs)
        rows, identity, symbols = signatures(h, h2, of)
        both = np.zeros((len(offs) - 1, 2), np.int64)
        both[rows] = identity
        signs: list[bytes | None] = [None] * len(both)
        for r, x in zip(rows.tolist(), symbols, strict=True):
            signs[r] = x.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(of).astype(np.int64)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(signs, pa.binary())], ["id", "n", "s1", "s2", "symbols"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = keys_of(_symbols(batch.column(1)))
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), listed], ["node", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Symbols and shingles, sorted, of (node, s1, s2, text) whose text has the node's set."""
    for batch, data, offs in pieces(batches, "text"):
        h, h2, of = shingle_sets(data, offs)
        rows, identity, symbols = signatures(h, h2, of)
        wanted = np.column_stack([batch.column(k).to_numpy()[rows] for k in (1, 2)])
        own = np.flatnonzero((identity == wanted).all(axis=1))
        raw = [h[of[k] : of[k + 1]].tobytes() for k in rows[own].tolist()]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[own])), pa.array([x.tobytes() for x in symbols[own]], pa.binary()), pa.array(raw, pa.binary())], ["node", "symbols", "hashes"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, symbols_a, symbols_b) to those whose signatures may be those of similar sets."""
    for batch in batches:
        differ = (_symbols(batch.column(2)) != _symbols(batch.column(3))).sum(axis=1)
        yield batch.select(["a", "b"]).filter(pa.array(differ <= LOOSE))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, hashes_a, hashes_b) to those whose sets are similar."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
            both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _first_slot(equal: np.ndarray) -> np.ndarray:
    """For pairs (rows) by equality of their symbols: the first key that they share."""
    by_chunk = equal.reshape(len(equal), CHUNKS, WIDTH)
    enough = by_chunk.sum(axis=2) >= WIDTH - ERRORS
    chunk = enough.argmax(axis=1)
    own = by_chunk[np.arange(len(equal)), chunk]
    return chunk * WIDTH + np.where(own.all(axis=1), 0, (~own).argmax(axis=1))


def _runs(x: np.ndarray) -> tuple[list[int], list[int]]:
    """(begin, end) of the runs of equal values in x."""
    cuts = np.flatnonzero(x[1:] != x[:-1]) + 1
    return ([0, *cuts.tolist()], [*cuts.tolist(), len(x)]) if len(x) else ([], [])


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets as the lower 32 bits of their shingles, sorted."""
    for batch in batches:
        low = [np.sort(np.frombuffer(x.as_buffer(), _U).astype(np.uint32)).tobytes() for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(low, pa.binary())], ["node", "symbols", "hashes"])


def _compare():
    """Blocks of key groups (sorted by group) to pairs of different components
    with near signatures.  A pair comes from the first key that it shares."""

    def alike(sets: list[np.ndarray], row: int, others: np.ndarray) -> np.ndarray:
        """Which of the others are similar to the row, up to SLACK."""
        own, sizes = sets[row], np.array([len(sets[k]) for k in others])
        merged = np.concatenate([sets[k] for k in others])
        hit = own[np.minimum(np.searchsorted(own, merged), len(own) - 1)] == merged
        both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64) + SLACK
        return 100 * both >= PERCENT * (len(own) + sizes - both)

    def group(part: pa.Table) -> tuple[list[int], list[int]]:
        c, side = part["c"].to_numpy(), part["side"].to_numpy()
        sets = [np.frombuffer(h, np.uint32) for h in part["hashes"].to_pylist()]
        slot = part["key"][0].as_py() >> BITS * (WIDTH - 1)
        symbols = np.frombuffer(b"".join(part["symbols"].to_pylist()), np.uint16).reshape(len(side), -1)
        diagonal = side[0] == 2
        left = np.flatnonzero(side != 1)
        right = left if diagonal else np.flatnonzero(side == 1)
        out_a, out_b = [], []
        # Members of the largest component only meet those of others.
        parts, sizes = np.unique(c, return_counts=True)
        largest = parts[sizes.argmax()]
        meetings = [(left[c[left] == largest], right[c[right] != largest]), (left[c[left] != largest], right)]
        if diagonal:
            meetings = meetings[1:]
        for rows, right in ((own[lo : lo + 256], others) for own, others in meetings for lo in range(0, len(own), 256)):
            same = np.zeros((len(rows), len(right)), np.uint8)
            for k in range(symbols.shape[1]):
                same += symbols[rows, k][:, None] == symbols[right, k][None]
            x, y = np.nonzero((same >= symbols.shape[1] - LOOSE) & (c[rows][:, None] != c[right][None]))
            if diagonal:  # each pair once: those with the largest component come from the other side alone
                up = (rows[x] < right[y]) | (c[right[y]] == largest)
                x, y = x[up], y[up]
            first = _first_slot(symbols[rows[x]] == symbols[right[y]]) == slot
            x, y = rows[x][first], right[y][first]
            for lo_x, hi_x in zip(*_runs(x), strict=True):
                others = y[lo_x:hi_x]
                others = others[alike(sets, int(x[lo_x]), others)]
                out_a += [int(x[lo_x])] * len(others)
                out_b += others.tolist()
        return out_a, out_b

    def starts(t: pa.Table | pa.RecordBatch) -> np.ndarray:
        """The first row of each group."""
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for name in GROUP:
            x = t.column(name).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(t: pa.Table) -> Iterator[pa.RecordBatch]:
            bounds = np.append(starts(t), t.num_rows)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                part = t.slice(lo, hi - lo)
                x, y = group(part)
                if x:
                    nodes = part["node"].combine_chunks()
                    yield pa.RecordBatch.from_arrays([nodes.take(pa.array(x)), nodes.take(pa.array(y))], ["x", "y"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last group of a batch may go on in the next.
            t = pa.Table.from_batches([*held, batch])
            last = int(starts(t)[-1])
            if last:
                yield from compared(t.slice(0, last))
            held = t.slice(last).to_batches()
        if held:
            yield from compared(pa.Table.from_batches(held))

    return run


def _joined(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """The pairs (a, b) with a column of ``table`` (node, column) for either end."""
    side = lambda end: table.select(F.col("node").alias(end), F.col(column).alias(f"{column}_{end}"))
    return pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", f"{column}_a", f"{column}_b")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    return _joined(pairs, sets, "hashes").mapInArrow(_confirm, _PAIR)


def _stash_pairs(df: DataFrame, name: str) -> DataFrame:
    """Stash rows that Python makes of whole texts or sets, few of which it gets at a time."""
    with batch_bytes(df.sparkSession, SET_BYTES):
        return stash(df, name)


def _rest_pairs(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components among each key's members (key, node, c)."""
    size = rest.groupBy("key").agg(F.count("*").alias("m"))
    blocks = stash(size.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "open-keys")
    dealt = rest.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # Blocks i and j meet once: rows of the lower one are side 0, of the higher one side 1; 2 is a block with itself.
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") > F.col("other"), 1).otherwise(0)
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "c", side.alias("side"))
    halves = sets.mapInArrow(_halves, _SETS)
    rows = dealt.join(halves, "node").select(*GROUP, "node", "c", "side", "symbols", "hashes")
    found = rows.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(_compare(), "x long, y long")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _with_sets(texts: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, symbols, hashes) of the wanted nodes.  A class's id may have several
    rows: those whose text has the class's set are told by it, and one is enough."""
    own = texts.join(classes.join(wanted, "node", "left_semi").select("node", "s1", "s2", "id"), "id").select("node", "s1", "s2", "text")
    return _stash_pairs(own.mapInArrow(_sets, _SETS).groupBy("node").agg(F.max("symbols").alias("symbols"), F.max("hashes").alias("hashes")), "open-sets")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs``.

    Words are runs other than white space, with A-Z in lower case.  Documents
    are linked where 100 * intersection >= PERCENT * union; component_id is the
    smallest id reachable, and only its document is kept.  A null, empty or
    blank text has no set and is linked with nothing.  Rows that share an id are
    judged each by its own text.  Rows with a null id are reported as themselves,
    with a null component, and kept.  Texts of any length are taken whole, an
    empty table gives no rows, and other columns aren't read, whatever their names.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    signed = _stash_pairs(texts.mapInArrow(_sign, f"id {id_type}, n long, s1 long, s2 long, symbols binary"), "signatures")
    named = signed.where("id IS NOT NULL AND n > 0")
    classes = named.groupBy("s1", "s2", "n").agg(F.min("id").alias("id"), F.max("symbols").alias("symbols"))
    # Numbered by id, as the smallest, which leads, is mostly what the others were copied from.  The numbers are
    # those of the written table; nothing computes them again.
    classes = stash(classes.orderBy("id").withColumn("node", F.monotonically_increasing_id()), "classes")
    keyed = classes.select("node", "symbols").mapInArrow(_keys, "node long, keys array<bigint>").select("node", F.explode("keys").alias("key"))
    shared = stash(keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi"), "shared-keys")
    rest = stash(keyed.join(shared, "key").select("key", "node", F.col("node").alias("c"), "lo", "hi"), "key-groups")
    links, components = None, None
    spent = [shared, rest]  # tables that the result doesn't read
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            if turn == 0:  # every member with one other: the smallest of all its groups
                pairs = rest.groupBy("node").agg(F.min("lo").alias("lead")).where("node <> lead")
            else:  # every member with the two that lead each group, if links haven't joined them
                pairs = rest.select("node", "c", F.explode(F.array("lo", "hi")).alias("lead")).where("c <> lead.c")
                pairs = pairs.select("node", F.col("lead.node").alias("lead"))
            pairs = pairs.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
            pairs = _joined(pairs, classes, "symbols").mapInArrow(_near, _PAIR)
        else:
            sets = _with_sets(texts, classes, rest.select("node").distinct())
            pairs = _rest_pairs(rest.select("key", "node", "c"), sets)
        pairs = _stash_pairs(pairs, "pairs")
        if turn < ROUNDS:
            sets = _with_sets(texts, classes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        found = _stash_pairs(_links(pairs, sets), "confirmed")
        spent += [pairs, sets, found]
        if turn and found.isEmpty():
            if turn == ROUNDS:
                break
        else:
            links = found if links is None else links.unionByName(found)
            components = stash(connected_components(links), "components")
            links = components.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
        if turn == ROUNDS:
            break
        # Members that all others have met are through; a group is, once the rest are in one component.
        left = (rest.where("node <> lo.node AND node <> hi.node") if turn else rest).select("key", "node").join(components.withColumnRenamed("id", "node"), "node", "left")
        left = stash(left.select("key", "node", F.coalesce("component", "node").alias("c")), "rest")
        leads = stash(left.groupBy("key").agg(F.min("c").alias("c_lo"), F.max("c").alias("c_hi"), F.min(F.struct("node", "c")).alias("lo"), F.max(F.struct("node", "c")).alias("hi")).where("c_lo <> c_hi").drop("c_lo", "c_hi"), "leads")
        rest = stash(left.join(leads, "key"), "open-groups")
        spent += [left, leads, rest]
        if rest.isEmpty():
            break
    discard(spent)
    # The smallest id of each component's classes; a class that is linked with none is its own.
    linked = components.join(classes.select(F.col("node").alias("id"), "s1", "s2", F.col("id").alias("least")), "id")
    least = stash(linked.groupBy("component").agg(F.min("least").alias("component_id")), "smallest-ids")
    linked = linked.join(least, "component").select("s1", "s2", "component_id")
    single = classes.join(components.select(F.col("id").alias("node")), "node", "left_anti").select("s1", "s2", F.col("id").alias("component_id"))
    columns = lambda rows, component: rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
    own = columns(named.drop("symbols").join(linked.unionByName(single), ["s1", "s2"], "left"), F.col("component_id"))
    return own.unionByName(columns(signed.where("id IS NULL OR n = 0"), F.col("id")))
