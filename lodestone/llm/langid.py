"""Language identification with a linear-chain conditional random field.

Every word of a text has a language as its hidden label.  A word's features are
itself (lexicon), its affixes and its character n-grams, hashed; each feature
has a learned weight for each language, and neighbouring labels have learned
transitions.  Forward-backward gives each word's posterior, also in text that
switches languages.  A document's language is the one with the largest mean
posterior over the words that have a letter; the score is that mean.

Words are labelled for training with their document's language; every fourth
sequence is two spans of different texts, so that switches are learned.  Sequences
run side by side: step t of forward-backward treats word t of all texts of a piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import Words, pieces
from .samples import held_out, labelled_sample
from .tables import batch_bytes, stash

BUCKET_BITS = 16
BATCH_BYTES = 4 << 20
AFFIXES = ((0, 2), (0, 3), (1, 2), (1, 3))  # (prefix or suffix, bytes)
UNKNOWN = "und"
_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


@lru_cache(1)
def _alphabetic() -> np.ndarray:
    """By code point, whether it's a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def begins_letter(data: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8, whether a letter begins there."""
    out = _LETTER[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int64)
        more = 1 + (first >= 0xE0) + (first >= 0xF0)
        code = first & (0x3F >> more)
        for k in (1, 2, 3):
            code = np.where(k <= more, code << 6 | data[np.minimum(lead + k, len(data) - 1)] & 0x3F, code)
        out[lead] = _alphabetic()[np.minimum(code, 0x10FFFF)]
    return out


def _hash32(code: np.ndarray, salt: int) -> np.ndarray:
    return ((code ^ np.uint32(salt * 0x01000193 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)


def word_features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one column of buckets for each single feature of a word, buckets of its
    n-grams, offsets of these by word)."""
    folded = np.concatenate([_FOLD[w.data], np.full(4, 32, np.uint8)]).astype(np.uint32)
    length = w.end - w.start
    single = [(w.hash >> _U(64 - BUCKET_BITS)).astype(np.int64)]
    for salt, (end, n) in enumerate(AFFIXES, 1):
        code = np.zeros(len(length), np.uint32)
        for k in range(n):
            at = w.start + k if end == 0 else w.end - 1 - k
            code = code * np.uint32(257) + np.where(k < length, folded[np.maximum(at, 0)], 0).astype(np.uint32)
        single.append(_hash32(code, salt).astype(np.int64))
    # Trigrams around every byte of a word; the neighbours of a word are blanks.
    total = int(length.sum())
    offs = np.concatenate([[0], np.cumsum(length)])
    at = np.arange(total) - np.repeat(offs[:-1] - w.start, length)
    left, right = folded[at - 1], folded[at + 1]
    left[offs[:-1]] = 32
    right[offs[1:] - 1] = 32
    grams = _hash32((left << np.uint32(16)) | (folded[at] << np.uint32(8)) | right, 9).astype(np.int64)
    return np.array(single), grams, offs


def emissions(weights: np.ndarray, w: Words) -> np.ndarray:
    """Log-potentials by word and language."""
    single, grams, offs = word_features(w)
    out = weights[single].sum(axis=0, dtype=np.float64) if len(w.start) else np.zeros((0, weights.shape[1]))
    for k in range(weights.shape[1]):
        sums = np.concatenate([[0], np.cumsum(weights[grams, k], dtype=np.float64)])
        out[:, k] += sums[offs[1:]] - sums[offs[:-1]]
    return out


def forward_backward(scores: np.ndarray, transitions: np.ndarray, of: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(posteriors by word, expected transitions if ``pairs``) of the sequences
    that ``of`` bounds."""
    n, k = scores.shape
    potential = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -60)) if n else scores
    move = np.exp(transitions - transitions.max())
    length = np.diff(of)
    order = np.argsort(-length, kind="stable")
    start, length = of[:-1][order], length[order]
    longest = int(length[0]) if len(length) else 0
    live = np.searchsorted(-length, -np.arange(longest), "left")  # sequences longer than t
    ahead, behind = np.empty((n, k)), np.ones((n, k))
    for t in range(longest):
        at = start[: live[t]] + t
        now = potential[at] if t == 0 else (ahead[at - 1] @ move) * potential[at]
        ahead[at] = now / now.sum(axis=1, keepdims=True)
    for t in range(longest - 1, 0, -1):
        at = start[: live[t]] + t
        then = (potential[at] * behind[at]) @ move.T
        behind[at - 1] = then / then.sum(axis=1, keepdims=True)
    post = ahead * behind
    post /= post.sum(axis=1, keepdims=True)
    expected = np.zeros((k, k))
    if pairs and n:
        second = np.ones(n, bool)
        second[of[:-1][np.diff(of) > 0]] = False
        at = np.flatnonzero(second)
        joint = ahead[at - 1][:, :, None] * move[None] * (potential[at] * behind[at])[:, None, :]
        expected = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return post, expected


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def label_words(self, w: Words) -> np.ndarray:
        return forward_backward(emissions(self.weights, w), self.transitions, w.of)[0]

    def documents(self, data: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(likeliest language, its share of the words, mean of each word's own
        largest posterior) by document."""
        w = Words(data, offs, lower=True)
        n = len(offs) - 1
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n)
        post = self.label_words(w)
        letters = np.concatenate([[0], np.cumsum(begins_letter(data))])
        lettered = letters[w.end] > letters[w.start]
        weight = post * lettered[:, None]
        sums = np.concatenate([np.zeros((1, post.shape[1])), np.cumsum(weight, axis=0)])
        total = sums[w.of[1:]] - sums[w.of[:-1]]
        share = total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
        best = share.argmax(axis=1)
        has = letters[offs[1:]] > letters[offs[:-1]]
        names = [self.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)]
        sure = np.concatenate([[0.0], np.cumsum(weight.max(axis=1))])
        sure = (sure[w.of[1:]] - sure[w.of[:-1]]) / np.maximum(total.sum(axis=1), 1e-12)
        return names, np.where(has, share[np.arange(n), best], 0.0), np.where(has, sure, 0.0)


def fit(sample: list[tuple[str, object]], epochs: int = 2, rate: float = 0.3, span: int = 64, batch: int = 64, decay: float = 1e-6, seed: int = 7) -> LanguageModel:
    """Train on (text, language) pairs, by adaptive stochastic gradient descent on
    the likelihood of spans of ``span`` words."""
    languages = sorted({str(y) for _, y in sample})
    k = len(languages)
    weights, grown = np.zeros((1 << BUCKET_BITS, max(k, 1))), np.full((1 << BUCKET_BITS, max(k, 1)), 1e-3)
    moves, moved = np.zeros((max(k, 1), max(k, 1))), np.full((max(k, 1), max(k, 1)), 1e-3)
    if not k:
        return LanguageModel([], weights, moves)
    raw = [t.encode() for t, _ in sample]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    w = Words(np.frombuffer(b"".join(raw), np.uint8), offs, lower=True)
    single, grams, gram_offs = word_features(w)
    truth = np.array([languages.index(str(y)) for _, y in sample])[w.doc]
    bounds = np.unique(np.concatenate([w.of, *[np.arange(a, b, span) for a, b in zip(w.of[:-1], w.of[1:], strict=True)]]))
    spans = np.column_stack([bounds[:-1], bounds[1:]])
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        order = rng.permutation(len(spans))
        step = rate * (1 - epoch / (epochs + 1))
        for lo in range(0, len(order), batch):
            own = spans[order[lo : lo + batch]]
            at = np.concatenate([np.arange(a, b) for a, b in own])
            of = np.concatenate([[0], np.cumsum(own[:, 1] - own[:, 0])])
            of = np.delete(of, np.arange(2, len(of) - 1, 4))
            gram_at = np.concatenate([np.arange(gram_offs[a], gram_offs[b]) for a, b in own])
            gram_of = np.repeat(np.arange(len(at)), (gram_offs[1:] - gram_offs[:-1])[at])
            scores = weights[single[:, at]].sum(axis=0)
            np.add.at(scores, gram_of, weights[grams[gram_at]])
            post, expected = forward_backward(scores, moves, of, pairs=True)
            post[np.arange(len(at)), truth[at]] -= 1
            inner = np.ones(len(at), bool)
            inner[of[:-1]] = False
            seen = np.flatnonzero(inner)
            np.subtract.at(expected, (truth[at][seen - 1], truth[at][seen]), 1)
            ids = np.concatenate([*single[:, at], grams[gram_at]])
            rows = np.concatenate([*[np.arange(len(at))] * len(single), gram_of])
            used, place = np.unique(ids, return_inverse=True)
            g = np.zeros((len(used), k))
            for c in range(k):
                g[:, c] = np.bincount(place.ravel(), post[rows, c], len(used))
            g += decay * weights[used]
            grown[used] += g * g
            weights[used] -= step * g / np.sqrt(grown[used])
            moved += expected * expected
            moves -= step * expected / np.sqrt(moved)
    return LanguageModel(languages, weights.astype(np.float32), moves)


def identify_language(docs: DataFrame, per_language: int = 150, max_chars: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", certainty: bool = False, key_col: str | None = None, max_languages: int = 1000) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of each row of ``docs``; with
    ``certainty`` also certainty, the mean of each word's own largest posterior:
    score is the language's share, which is small in a clean text of several.  With
    ``key_col`` the rows are named by that column instead, in doc_id.

    The field is fitted on at most ``per_language`` texts of each language in
    ``lang_col`` (nulls teach nothing; beyond ``max_languages`` the most frequent ones
    are learned, and no other is predicted), of texts of more than ``max_chars``
    characters on so many of them; every whole text is labelled.  A text that is
    null, empty or without a letter is ``und`` with score 0; so is every text where
    nothing could be learned.  Repeated rows and null ids give a row each, an empty
    table none; other columns aren't read, whatever their names.
    """
    model = fit(labelled_sample(docs, docs.select(id_col, lang_col), lang_col, per_language, max_chars, id_col, text_col, max_languages))
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[key_col or id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch, data, offs in pieces(batches, "__text", 1 << 21):
            names, score, sure = own.documents(data, offs)
            columns = [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns[: 4 + certainty], ["doc_id", "held_out", "lang_pred", "score", "certainty"][: 4 + certainty])

    rows = docs.select(F.col(key_col or id_col).alias("__id"), held_out(id_col).alias("__held"), F.col(text_col).alias("__text"))
    schema = f"doc_id {id_type}, held_out boolean, lang_pred string, score double" + ", certainty double" * certainty
    with batch_bytes(docs.sparkSession, BATCH_BYTES):  # a batch of ten thousand whole texts would take most of a task's memory
        return stash(rows.mapInArrow(run, schema), "languages")
