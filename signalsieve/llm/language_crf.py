"""Language identification with a linear-chain conditional random field over words.

Words get scores per language from hashed affixes, character n-grams and a lexicon; learned
transitions say how readily the language changes from one word to the next. Forward-backward gives each
word's probabilities, so code-switched texts are labelled word by word, and a text's language is the
one with the most expected words. Chains of any length are handled exactly: they are cut in lanes,
each lane's matrix product links what comes before and after, and all lanes run side by side.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalsieve.llm.common import importable, written
from signalsieve.llm.toxicity import remainder

#: Most documents per language that a model is fitted on, by the order of a hash.
DOCS_PER_LANGUAGE = 250
#: Hash buckets of affixes and n-grams.
BITS = 17
AFFIX = 4
#: Words of a language's lexicon: seen this often in the sample, so much of it in that language.
LEXICON_COUNT, LEXICON_SHARE = 3, 0.9
#: Words of a training sequence, and of a lane when labelling.
SEQUENCE = 64
LANE = 128
CACHE_WORDS = 150_000
UNDETERMINED = "und"

_WORDS = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")


def letters(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    found = _WORDS.findall(text.lower()) if text else []
    if not all(map(str.isalpha, found)):  # the quick pattern also takes numbers like ²
        found = _LETTERS.findall(text.lower())
    return found


class Model(NamedTuple):
    """languages, weights per hash bucket, transition scores, scores of the first word, and the
    language number of each lexicon word; the last rows of ``weights`` are the lexicon's."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    first: np.ndarray
    lexicon: dict[str, int]


def _mix(value: np.ndarray, salt: int) -> np.ndarray:
    value = (value ^ value >> np.uint32(15)) * np.uint32(0x2C1B3C6D) + np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)
    return ((value ^ value >> np.uint32(13)) * np.uint32(0x297A2D39) >> np.uint32(32 - BITS)).astype(np.int64)


def features(words: list[str], lexicon: dict[str, int], languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word number, feature): prefixes and suffixes of up to AFFIX characters, the word's
    ends included, inner two- and three-grams, and the lexicon of the word or that it has none."""
    framed = [f"^{w}$" for w in words]
    codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([*map(len, framed)])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    numbers = np.arange(len(words))
    rows, found = [], []
    for side, (at, step) in enumerate(((starts, 1), (ends - 1, -1))):
        rolling = codes[at].copy()
        for k in range(1, AFFIX + 1):
            there = k < sizes
            rolling = rolling * np.uint32(0x01000193) + np.where(there, codes[np.clip(at + k * step, 0, len(codes) - 1)], np.uint32(0))
            rows.append(numbers[there])
            found.append(_mix(rolling, 10 * side + k)[there])
    word = np.repeat(numbers, sizes)
    rolling = codes.copy()
    for n in (2, 3):
        rolling = rolling[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :]
        inside = word[: len(rolling)] == word[n - 1 :]
        rows.append(word[: len(rolling)][inside])
        found.append(_mix(rolling, 30 + n)[inside])
    rows.append(numbers)
    found.append((1 << BITS) + np.array([lexicon.get(w, languages) for w in words]))
    return np.concatenate(rows).astype(np.int32), np.concatenate(found).astype(np.int32)


def emissions(words: list[str], model: Model) -> np.ndarray:
    """Scores of each word for each language."""
    n = len(model.languages)
    if not words:
        return np.zeros((0, n))
    row, feature = features(words, model.lexicon, n)
    return np.stack([np.bincount(row, weights=model.weights[feature, y], minlength=len(words)) for y in range(n)], axis=1)


def _normal(values: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    return values / values.sum(axis=axes, keepdims=True)


def posteriors(scores: np.ndarray, sizes: np.ndarray, model: Model, lane: int = LANE) -> np.ndarray:
    """Probabilities of each word's language, for chains of ``sizes`` words one after the other.

    A lane of up to ``lane`` words is a product of matrices, transition times word. With the
    products of all its prefixes and suffixes, a word's probabilities follow from what reaches the
    lane from the left and from the right, and these pass from lane to lane.
    """
    n = scores.shape[1]
    emit = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    step = np.exp(model.transitions - model.transitions.max())
    lanes_of = -(-sizes // lane)
    chain = np.repeat(np.arange(len(sizes)), lanes_of)
    last = np.cumsum(lanes_of)
    ordinal = np.arange(len(chain)) - np.repeat(last - lanes_of, lanes_of)
    begin = np.repeat(np.cumsum(sizes) - sizes, lanes_of) + ordinal * lane
    length = np.minimum(lane, np.repeat(sizes, lanes_of) - ordinal * lane)
    order = np.argsort(-length, kind="stable")
    place, long = begin[order], length[order]
    count = len(order)
    ahead, behind = np.empty((len(scores), n, n)), np.empty((len(scores), n, n))
    held = np.broadcast_to(np.eye(n), (count, n, n))
    whole = np.empty((count, n, n))
    for t in range(int(long.max(initial=0))):
        live = int(np.searchsorted(-long, -t, side="left"))
        at = place[:live] + t
        held = _normal(held[:live] @ step * emit[at][:, None, :], (1, 2))
        ahead[at] = held
        whole[:live] = held
    held = np.broadcast_to(np.eye(n), (count, n, n)).copy()
    for t in range(int(long.max(initial=0)) - 1, -1, -1):
        live = int(np.searchsorted(-long, -t, side="left"))
        at = place[:live] + t
        behind[at] = held[:live]
        held[:live] = _normal((step * emit[at][:, None, :]) @ held[:live], (1, 2))
    product = np.empty((count, n, n))
    product[order] = whole
    # The first word has no transition into it: what reaches it gives ``first`` after one.
    left, right = np.empty((count, n)), np.empty((count, n))
    start = np.linalg.solve(step.T, np.exp(model.first - model.first.max()))
    firsts = last - lanes_of
    vector = np.broadcast_to(start, (len(sizes), n)).copy()
    for k in range(int(lanes_of.max(initial=0))):
        live = np.flatnonzero(lanes_of > k)
        at = firsts[live] + k
        left[at] = vector[live]
        moved = np.einsum("ci,cij->cj", vector[live], product[at])
        vector[live] = moved / np.abs(moved).sum(axis=1, keepdims=True)
    vector = np.ones((len(sizes), n))
    for k in range(int(lanes_of.max(initial=0)) - 1, -1, -1):
        live = np.flatnonzero(lanes_of > k)
        at = firsts[live] + k
        right[at] = vector[live]
        moved = np.einsum("cij,cj->ci", product[at], vector[live])
        vector[live] = moved / np.abs(moved).sum(axis=1, keepdims=True)
    lane_of = np.repeat(np.arange(count), length)
    forward = np.einsum("ti,tij->tj", left[lane_of], ahead)
    backward = np.einsum("tij,tj->ti", behind, right[lane_of])
    both = np.maximum(forward * backward, 0)
    return both / both.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], rounds: int = 40, penalty: float = 1e-3) -> Model:
    """A model of texts in known languages: all words of a text carry its language.

    Sequences of SEQUENCE words, every third spliced from the halves of two texts, so that changes
    of language are seen; gradients over all sequences with adaptive steps.
    """
    languages = sorted(set(labels))
    n = len(languages)
    split = [letters(t) for t in texts]
    counts: dict[str, np.ndarray] = {}
    for doc, label in zip(split, labels):
        y = languages.index(label)
        for w in doc:
            counts.setdefault(w, np.zeros(n))[y] += 1
    lexicon = {w: int(c.argmax()) for w, c in counts.items() if c.sum() >= LEXICON_COUNT and c.max() >= LEXICON_SHARE * c.sum()}
    vocabulary = {w: i for i, w in enumerate(counts)}
    model = Model(languages, np.zeros(((1 << BITS) + n + 1, n)), np.zeros((n, n)), np.zeros(n), lexicon)
    pieces = [
        (np.array([vocabulary[w] for w in doc[i : i + SEQUENCE]]), languages.index(label))
        for doc, label in zip(split, labels)
        for i in range(0, len(doc), SEQUENCE)
    ]
    if not pieces or n == 1:
        return model
    order = np.random.default_rng(1).permutation(len(pieces))
    word = np.zeros((len(pieces), SEQUENCE), np.int64)
    truth = np.zeros((len(pieces), SEQUENCE), np.int64)
    size = np.zeros(len(pieces), np.int64)
    for k, i in enumerate(order):
        ids, y = pieces[i]
        marks = np.full(len(ids), y)
        if k % 3 == 0:
            other, z = pieces[order[k - 1]]
            ids = np.concatenate([ids[: -(-len(ids) // 2)], other[: len(other) // 2]])
            marks = np.concatenate([marks[: -(-len(marks) // 2)], np.full(len(other) // 2, z)])
        word[k, : len(ids)], truth[k, : len(ids)], size[k] = ids, marks, len(ids)
    mask = np.arange(SEQUENCE) < size[:, None]
    row, feature = features(list(counts), lexicon, n)
    total = int(mask.sum())
    params = [model.weights, model.transitions, model.first]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    hot = np.eye(n)
    pairs = mask[:, 1:]
    for turn in range(1, rounds + 1):
        scores = np.stack([np.bincount(row, weights=model.weights[feature, y], minlength=len(counts)) for y in range(n)], axis=1)
        emit = np.exp(scores - scores.max(axis=1, keepdims=True))[word]
        step = np.exp(model.transitions - model.transitions.max())
        alpha, beta = np.empty_like(emit), np.ones_like(emit)
        alpha[:, 0] = _normal(emit[:, 0] * np.exp(model.first), (1,))
        for t in range(1, SEQUENCE):
            alpha[:, t] = _normal(alpha[:, t - 1] @ step * emit[:, t], (1,))
        for t in range(SEQUENCE - 2, -1, -1):
            back = (emit[:, t + 1] * beta[:, t + 1]) @ step.T
            beta[:, t] = np.where(mask[:, t + 1, None], _normal(back, (1,)), 1.0)
        belief = _normal(alpha * beta, (2,))
        error = (belief - hot[truth]) * mask[:, :, None]
        per_word = np.stack([np.bincount(word.ravel(), weights=error[:, :, y].ravel(), minlength=len(counts)) for y in range(n)], axis=1)
        by_feature = np.stack([np.bincount(feature, weights=per_word[row, y], minlength=len(model.weights)) for y in range(n)], axis=1)
        joint = np.zeros((n, n))
        for t in range(1, SEQUENCE):
            there = pairs[:, t - 1]
            both = alpha[there, t - 1, :, None] * step * (emit[there, t] * beta[there, t])[:, None, :]
            joint += _normal(both, (1, 2)).sum(axis=0)
        seen = np.zeros((n, n))
        np.add.at(seen, (truth[:, :-1][pairs], truth[:, 1:][pairs]), 1)
        gradients = [by_feature, joint - seen, (belief[:, 0] - hot[truth[:, 0]])[size > 0].sum(axis=0)]
        for p, g, (m, v) in zip(params, gradients, moments):
            g = g / total + penalty / total * p
            m += 0.1 * (g - m)
            v += 0.05 * (g * g - v)
            p -= 0.1 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.95**turn)) + 1e-12)
    return model


class _Labeller:
    """A model with the scores of words seen lately."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.table = np.zeros((0, len(model.languages)))

    def label(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        languages = self.model.languages
        split = [letters(t) for t in texts]
        sizes = np.array([*map(len, split)])
        if len(self.known) > CACHE_WORDS:
            self.known, self.table = {}, self.table[:0]
        new = list({w for doc in split for w in doc if w not in self.known})
        self.known.update(zip(new, range(len(self.table), len(self.table) + len(new))))
        self.table = np.concatenate([self.table, emissions(new, self.model)])
        known = self.known
        which = np.array([known[w] for doc in split for w in doc], np.int64)
        full = np.flatnonzero(sizes)
        share = np.zeros((len(texts), len(languages)))
        if len(full):
            belief = posteriors(self.table[which], sizes[full], self.model)
            share[full] = np.add.reduceat(belief, np.cumsum(sizes[full]) - sizes[full], axis=0) / sizes[full][:, None]
        best = share.argmax(axis=1)
        names = [languages[b] if s else UNDETERMINED for b, s in zip(best, sizes)]
        return names, np.where(sizes > 0, np.clip(share[np.arange(len(texts)), best], 0, 1), 0.0)


def _predict(model, slice_chars: int = 1 << 18, slice_rows: int = 256) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _Labeller(model.value)
        for rows in (b.slice(i, slice_rows) for b in batches for i in range(0, b.num_rows, slice_rows)):
            texts = rows.column("text").to_pylist()
            names: list[str] = []
            scores: list[np.ndarray] = []
            start, held = 0, 0
            for i, text in enumerate(texts, 1):
                held += len(text or "") + 1
                if held >= slice_chars or i == len(texts):
                    found, score = labeller.label(texts[start:i])
                    names += found
                    scores.append(score)
                    start, held = i, 0
            kept = [(rows.column(k), c) for k, c in enumerate(rows.schema.names) if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(c for c, _ in kept), pa.array(names, pa.string()), pa.array(np.concatenate(scores))],
                names=[*(c for _, c in kept), "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``lang_pred`` and ``score``, the expected share of
    words in that language. A text that is null or without letters is ``und`` with score 0, as is
    every text if the model has no language. Columns named lang_pred or score are replaced."""
    docs = docs.select(*(c for c in docs.columns if c.lower() not in ("lang_pred", "score")))
    if not model.languages:
        return docs.drop("text").withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    importable(docs.sparkSession)
    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.drop("text").dtypes), "lang_pred string", "score double"])
    return docs.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), schema)


def fit(docs: DataFrame, holdout: tuple[int, int] = (4, 2), docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """A model of ``docs`` (doc_id, text, lang) with a language and words, leaving out ids whose
    crc32 as text leaves the held-out remainder. At most ``docs_per_language`` texts of each
    language, whole, are brought together to learn from."""
    of, out = holdout
    known = docs.filter(F.col("lang").isNotNull() & (remainder("doc_id", of) != out) & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang").distinct()
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = written(known.withColumn("_n", F.row_number().over(by_hash)).filter(F.col("_n") <= docs_per_language).select("doc_id", "lang", "_n").coalesce(1), "lang-sample")
    texts = docs.select("doc_id", "text", "lang").join(sample, ["doc_id", "lang"]).dropDuplicates(["doc_id", "lang", "text"]).orderBy("lang", "doc_id").select("text", "lang").toArrow()
    return train(texts.column("text").to_pylist(), texts.column("lang").to_pylist())


def language_ids(docs: DataFrame, holdout: tuple[int, int] = (4, 2), docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang).

    Learns from texts and non-null languages of rows that are not held out; languages and ids are no
    input of a prediction. A null doc_id is not held out and not learned from.

    A text that is null or has no letter is ``und``. Repeated rows and equal texts get one prediction, a row each;
    of languages that are as likely the first by name is given. Texts of any length are read whole. Without
    a row to learn from every text is ``und``; a table without rows gives none. Other columns, whatever
    their names, are not read.
    """
    of, out = holdout
    model = fit(docs, holdout, docs_per_language)
    held = F.coalesce(remainder("doc_id", of) == out, F.lit(False))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
