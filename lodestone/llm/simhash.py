"""SimHash near duplicates by bit-sliced comparison.

A fingerprint has 64 bits; a bit is 1 if it's set in over half the hashes of a
text's shingles.  Distinct fingerprints alone are compared, however many texts have
them.  A block of fingerprints is stored vertically: plane b holds bit b of 64
fingerprints in each word.  One fingerprint meets 64 others at a time: a plane's
XOR with its own bit adds one to the distances in carry-save counters, which are
words too, one for each binary digit.  Every few planes, words all of whose
distances exceed the radius are abandoned.

Which fingerprints share a block: cut into PARTS parts, two within the radius agree
in at least PARTS - radius of them; so each is listed once for every choice of so
many parts.  A group of over BLOCK members is listed again by the parts of its
remaining bits, after which a group has 2**16 members at most; these are dealt to
blocks, and each pair of blocks meets.  A block gives a chain of links for each
of its connected sets, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import Words, pieces
from .components import connected_components
from .tables import batch_bytes, discard, stash

SHINGLE, SEED, RADIUS = 3, 42, 2
PARTS = 4
BLOCK = 512
STEP = 8  # planes between looks at what can be abandoned
SPAN = 1 << 16  # shingles hashed at once
TEXT_BYTES = 16 << 20
_U = np.uint64
_ALL = _U(0xFFFFFFFFFFFFFFFF)
_GROUP = ["key", "sub", "i", "j"]
_Batches = Iterator[pa.RecordBatch]


def _shingle_bounds(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(begin, end, document) of every shingle in the words joined by single
    spaces, and these.  Fewer words than a shingle has are one shingle."""
    size = w.end - w.start
    begin = np.cumsum(size + 1) - size - 1
    text = np.full(int((size + 1).sum()), 0x20, np.uint8)
    word = np.zeros(len(w.data) + 1, np.int8)
    word[w.start] += 1
    word[w.end] -= 1
    inside = np.cumsum(word[:-1]).astype(bool)
    at = np.ones(len(text), bool)
    at[begin + size] = False
    text[at] = w.data[inside]
    upper = (text >= ord("A")) & (text <= ord("Z"))
    text[upper] += 32
    words = np.diff(w.of)
    n = np.where(words == 0, 0, np.maximum(words - SHINGLE + 1, 1))
    doc = np.repeat(np.arange(len(words)), n)
    first = w.of[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    last = np.minimum(first + SHINGLE, w.of[1:][doc]) - 1
    return begin[first], begin[last] + size[last], doc, text.tobytes()


def fingerprints(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The fingerprint of each text; zero for one without words."""
    from xxhash import xxh64_intdigest

    begin, end, doc, text = _shingle_bounds(Words(data, offs, hashed=False))
    ones, n = np.zeros((len(offs) - 1, 64), np.int64), np.bincount(doc, minlength=len(offs) - 1)
    raw = memoryview(text)
    for lo in range(0, len(doc), SPAN):
        own = doc[lo : lo + SPAN]
        ends = zip(begin[lo : lo + SPAN].tolist(), end[lo : lo + SPAN].tolist(), strict=True)
        h = np.array([xxh64_intdigest(raw[a:b], SEED) for a, b in ends], _U)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        docs, first = np.unique(own, return_index=True)
        ones[docs] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(_U)[:, 0]


def _fingerprint(batches: _Batches) -> _Batches:
    for batch, data, offs in pieces(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(data, offs).view(np.int64))], ["id", "fp"])


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit j of word w of plane b is bit b of fingerprint 64 * w + j."""
    padded = np.zeros(-(-len(fps) // 64) * 64, _U)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(_U)


def near_pairs(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of fingerprints that differ in ``radius`` bits at most."""
    m = len(fps)
    planes = planes_of(fps)
    i, w = (x.ravel() for x in np.indices((m, planes.shape[1])))
    ahead = w >= i // 64
    i, w = i[ahead], w[ahead]
    # Lanes before the fingerprint itself, its own, and those past the last count as too far.
    lane = np.clip(i + 1 - 64 * w, 0, 64)
    over = np.where(lane > 0, _ALL >> (64 - np.maximum(lane, 1)).astype(_U), _U(0))
    rest = m - 64 * w
    over |= np.where(rest < 64, _ALL << np.minimum(rest, 63).astype(_U), _U(0))
    counters = [np.zeros(len(i), _U) for _ in range(max(1, radius.bit_length()))]
    for step in range(64):
        b = step % STEP * (64 // STEP) + step // STEP  # neighbouring bits, which a group's key shares, far apart
        carry = planes[b][w] ^ (_U(0) - ((fps[i] >> _U(b)) & _U(1)))
        for k, c in enumerate(counters):
            counters[k], carry = c ^ carry, c & carry
        over |= carry
        if step % STEP == STEP - 1:
            far, equal = over.copy(), ~over
            for k in reversed(range(len(counters))):
                if radius >> k & 1:
                    equal &= counters[k]
                else:
                    far |= equal & counters[k]
                    equal &= ~counters[k]
            live = np.flatnonzero(far != _ALL)
            i, w, over = i[live], w[live], far[live]
            counters = [c[live] for c in counters]
            if not len(live):
                break
    pair, lane = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return i[pair], w[pair] * 64 + lane


def chains(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of m members, the first that it's linked with, over any number of links."""
    least = np.arange(m)
    while True:
        before = least.copy()
        low = np.minimum(least[i], least[j])
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
        least = least[least]
        if (least == before).all():
            return least


def _link(most: int, radius: int) -> Callable[[_Batches], _Batches]:
    """Rows sorted by group to links (a, b); groups share a block while there's room,
    and what they link across groups are links as well."""

    def linked(fps: np.ndarray) -> _Batches:
        fps = np.unique(fps)
        least = chains(len(fps), *near_pairs(fps, radius))
        own = np.flatnonzero(least != np.arange(len(fps)))
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(fps[own].view(np.int64)), pa.array(fps[least[own]].view(np.int64))], ["a", "b"])

    def run(batches: _Batches) -> _Batches:
        keys, fps = np.zeros((0, len(_GROUP)), np.int64), np.zeros(0, _U)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, np.column_stack([batch.column(k).to_numpy() for k in range(len(_GROUP))])])
            fps = np.concatenate([fps, batch.column(len(_GROUP)).to_numpy().view(_U)])
            starts = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1)
            lo, last = 0, int(starts[-1])  # the last group may go on in the next batch
            while lo < last:
                fit = int(starts[np.searchsorted(starts, lo + most, "right") - 1])
                hi = min(last, fit if fit > lo else int(starts[np.searchsorted(starts, lo, "right")]))
                yield from linked(fps[lo:hi])
                lo = hi
            keys, fps = keys[last:], fps[last:]
        if len(fps):
            yield from linked(fps)

    return run


def _listed(fp: Column, bits: list[tuple[int, int]], agree: int, tag: int) -> list[Column]:
    """A number for each choice of ``agree`` of the parts (begin, width) and their bits."""
    out = []
    for number, chosen in enumerate(combinations(bits, agree)):
        key = F.lit(tag + number).cast("long")
        for begin, width in chosen:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, begin).bitwiseAND(F.lit((1 << width) - 1)))
        out.append(key)
    return out


def _groups(keyed: DataFrame, by: list[str]) -> DataFrame:
    """``keyed`` with the size m of each row's group; single members are left out."""
    sizes = stash(keyed.groupBy(*by).agg(F.count("*").alias("m")).where("m > 1"), "group-sizes")
    return stash(keyed.join(sizes, by), "groups")


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all distinct ``fp`` within ``radius`` bits of each other."""
    agree = PARTS - radius
    if agree < 1:
        raise ValueError(f"the radius must be under {PARTS}")
    width = 64 // PARTS
    parts = [(k * width, width) for k in range(PARTS)]
    fp = F.col("fp")
    keyed = fps.select("fp", F.explode(F.array(*_listed(fp, parts, agree, 1))).alias("key"))
    groups = _groups(keyed, ["key"])
    small = groups.where(F.col("m") <= block).select("key", F.lit(0).cast("long").alias("sub"), F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    # What a large group's members don't share is cut again.
    again = []
    for number, chosen in enumerate(combinations(parts, agree)):
        left = [(b + h, width // 2) for b, _ in parts if (b, width) not in chosen for h in (0, width // 2)]
        again.append(F.when(F.shiftrightunsigned("key", agree * width) == 1 + number, F.array(*_listed(fp, left, max(1, len(left) - radius), 1))))
    large = groups.where(F.col("m") > block).select("fp", "key", F.explode(F.coalesce(*again)).alias("sub"))
    finer = _groups(large, ["key", "sub"])
    finer = finer.withColumn("n", F.ceil(F.col("m") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    finer = finer.select("key", "sub", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    finer = finer.select("key", "sub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    rows = small.unionByName(finer).repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    links = stash(rows.mapInArrow(_link(block, radius), "a long, b long"), "fingerprint-links")
    discard([groups])
    return links


def simhash_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint and component_id of each row of ``docs``.

    Words are runs other than white space, with A-Z in lower case; shingles of
    three, repeats included, are joined by a space and hashed by XXH64.  Fewer words
    are one shingle.  A null, empty or blank text has fingerprint zero and is
    linked like any other.  Texts are linked where their fingerprints differ in
    ``radius`` bits at most; component_id is the smallest id reachable.  Rows that
    share an id are judged each by its own text.  Rows with a null id have a
    fingerprint, link nothing, and have a null component.  Texts of any length are
    taken whole, an empty table gives no rows, and other columns aren't read."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    with batch_bytes(docs.sparkSession, TEXT_BYTES):
        signed = stash(texts.mapInArrow(_fingerprint, f"id {id_type}, fp long"), "fingerprints")
    classes = stash(signed.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-classes")
    links = fingerprint_links(classes.select("fp"), radius)
    components = connected_components(links)
    named = classes.join(components.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = stash(named, "named-classes")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    # A table of its own, so that Spark can split the rows of a text that very many have.
    found = stash(named.join(least, "component").select("fp", "component_id"), "fingerprint-components")
    component = F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id")
    return signed.join(found, "fp", "left").select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component)
