"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of all words still being merged lie in one flat array.  A round
finds every neighbouring pair's rank by binary search over the sorted pair
keys, takes each word's lowest rank, and merges that pair wherever it occurs in
the word (from the left, without overlap).  That equals merging one pair at a
time where a merge's product only takes part in later merges, which is checked
when a vocabulary is loaded; otherwise a round merges the leftmost pair alone.

Each distinct word of the vocabulary's own splitting is encoded once in a
worker's memory, which is emptied when it has grown to about _MEMORY bytes.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import pieces

#: What the engine of the vocabulary's patterns takes as white space.
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_MEMORY = 160_000_000  # bytes, about
_NONE = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """A printable character for each byte, as byte-level vocabularies have it:
    printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(0x100 + rest.index(b)) for b in range(256)]


class WordBpe:
    """A byte-level BPE vocabulary with an end-of-word suffix, from a tokenizer's JSON."""

    def __init__(self, spec: str):
        tokenizer = json.loads(spec)
        model = tokenizer["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in tokenizer["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        split = next(p for p in tokenizer["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.split = regex.compile(split.replace(r"\s", _SPACE))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int64)
        self.final = np.array([vocab[c + suffix] for c in symbols], np.int64)
        self.width = max(self.tokens) + 1
        left, right, made = [], [], []
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left.append(vocab[a])
            right.append(vocab[b])
            made.append(vocab[a + b])
        a, b, c = (np.array(x, np.int64) for x in (left, right, made))
        rank = np.arange(len(c))
        used = np.full(self.width, _NONE, np.int64)
        np.minimum.at(used, a, rank)
        np.minimum.at(used, b, rank)
        self.together = bool((used[c] > rank).all())
        keys = a * self.width + b
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], rank[order].astype(np.int32), c[order]
        self.memory: dict[str, tuple[str, int, str]] = {}
        self.size = 0

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, offsets by word)."""
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[data]
        ends = np.cumsum(lengths)
        full = lengths > 0
        ids[ends[full] - 1] = self.final[data[ends[full] - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_ids, done_words = [], []
        while len(ids):
            pair = word[:-1] == word[1:]
            key = np.where(pair, ids[:-1] * self.width + ids[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(ids), _NONE, np.int32)
            rank[:-1] = np.where(self.keys[at] == key, self.rank[at], _NONE)
            first = np.flatnonzero(np.concatenate([[True], ~pair]))
            low = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(ids)))
            best = np.repeat(low, count)
            over = best == _NONE
            chosen = (rank == best) & ~over
            if self.together:
                # In a run of overlapping equal pairs every second one merges.
                start = np.maximum.accumulate(np.where(chosen & ~np.concatenate([[False], chosen[:-1] & pair]), np.arange(len(ids)), 0))
                chosen &= (np.arange(len(ids)) - start) % 2 == 0
            else:
                place = np.where(chosen, np.arange(len(ids)), len(ids))
                chosen = np.arange(len(ids)) == np.repeat(np.minimum.reduceat(place, first), count)
            hit = np.flatnonzero(chosen)
            ids[hit] = self.made[at[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            if over.any():
                done_ids.append(ids[over])
                done_words.append(word[over])
                keep &= ~over
            ids, word = ids[keep], word[keep]
        ids = np.concatenate([np.zeros(0, np.int64), *done_ids])
        word = np.concatenate([np.zeros(0, np.int64), *done_words])
        return ids[np.argsort(word, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(word.astype(np.int64), minlength=len(words)))])

    def words_of(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens' strings."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        return self.split.findall(text)

    def _parts(self, text: str) -> list[str]:
        """Words of a text; a special token is itself behind a line break, which no word has."""
        if self.cut is None or "<" not in text:
            return self.words_of(text)
        return [w for x in self.cut.split(text) if x for w in (["\n" + x] if x in self.special else self.words_of(x))]

    def learn(self, parts: Iterable[str]) -> None:
        """Put what isn't there yet into the memory: (ids as text, count, decoded)."""
        words = []
        for p in parts:
            if p in self.memory:
                continue
            if p[0] == "\n":
                self.memory[p] = (str(self.special[p[1:]]), 1, p[1:])
            else:
                words.append(p)
        ids, offs = self.merge([w.encode() for w in words])
        flat, at, tokens = ids.tolist(), offs.tolist(), self.tokens
        for w, lo, hi in zip(words, at[:-1], at[1:], strict=True):
            own = flat[lo:hi]
            got = (" ".join(map(str, own)), hi - lo, " ".join([tokens[i] for i in own]))
            self.memory[w] = got
            self.size += len(w) + len(got[0]) + len(got[2]) + 300  # and what Python needs besides

    def encode_decode(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """(ids joined by a space, their number, decoded text) of each text."""
        if self.size > _MEMORY:
            self.memory.clear()
            self.size = 0
        parts = [self._parts(t) for t in texts]
        self.learn({p for own in parts for p in own})
        out = []
        for own in parts:
            got = [self.memory[p] for p in own]
            out.append((" ".join([x[0] for x in got]), sum([x[1] for x in got]), " ".join([x[2] for x in got])))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_decode([text])[0][0].split()]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by a space, as a tokenizer without a decoder gives them."""
        return " ".join([self.tokens[i] for i in ids])


_loaded: dict[int, WordBpe] = {}


def _vocabulary(spec: str) -> WordBpe:
    key = hash(spec)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(spec)
    return _loaded[key]


def bpe_round_trip(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; with
    ``texts`` also ids (array<int>) and decoded.

    The vocabulary is read once, by the driver, and broadcast (a file of a few
    MB).  A null text counts as empty and has no tokens.  Strings of special
    tokens become those tokens.  Repeated rows and null ids give a row each, an empty
    table none; texts of any length are encoded whole, and other columns aren't read,
    whatever their names.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _vocabulary(shipped.value)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch, _, _ in pieces(batches, "__text"):
            got = bpe.encode_decode([t or "" for t in batch.column(1).to_pylist()])
            columns = [batch.column(0), pa.array([n for _, n, _ in got], pa.int64()), pa.array([sha(i) for i, _, _ in got], pa.string()), pa.array([sha(d) for _, _, d in got], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if texts:
                columns += [pa.array([[int(x) for x in i.split()] for i, _, _ in got], pa.list_(pa.int32())), pa.array([d for _, _, d in got], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, schema)
