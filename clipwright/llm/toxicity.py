"""Toxicity by subword-bag embeddings and a linear softmax.

A word is the mean of the vectors of its character n-grams and of itself, all
hashed into one table; a window of words is the mean of its words; a linear
softmax of two classes over the window says toxic or not.  Vectors and softmax
are learned together in numpy from a bounded sample.  A misspelt word shares
most n-grams with the word it stands for, so it lies near it though it was
never seen.

Toxic words are few in a long text and its mean would drown them, so a text is
judged by its windows: learning takes windows at random at first, then the most
toxic window of each text.  A text shorter than a window is filled up with the
mean word of clean texts, so that few words are little evidence either way and
none are none.  A last, small logistic fit on texts kept out of the gradients,
and on short cuts of them, turns the highest window, the mean and the length
into a probability at the corpus's own rate of toxic texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import sample, scored

#: Labelled texts of either class that are learned from.
SAMPLE_EACH = 3000
BUCKETS, DIM, GRAMS = 1 << 17, 12, (3, 4, 5)
WINDOW, BATCH, RATE = 20, 64, 0.18
#: Epochs at least, steps at least, and the share of epochs with windows at random.
EPOCHS, STEPS, WARM = 12, 1200, 0.3
#: How much odds grow with a window's vector, and what short cuts count beside whole texts in the last fit.
SHARP, SHORT_SHARE = 20, 0.25
THRESHOLD = 0.5
CACHED_WORDS, CACHED_CHARS = 400_000, 64
#: Words cut into n-grams at once.
TOGETHER = 20_000
_WORD = re.compile(r"[^\s.,;:!?|\"()]+")
_U = np.uint64
_STEP = np.random.default_rng(11).integers(1, 2**62, 8, dtype=np.int64).astype(_U) | _U(1)


def words_of(text: str) -> list[str]:
    """The words, without those said among the ``WINDOW`` before them: what is repeated is not more toxic for that."""
    last: dict[str, int] = {}
    out = []
    for i, w in enumerate(_WORD.findall(text.lower())):
        if i - last.get(w, i - WINDOW - 1) > WINDOW:
            out.append(w)
        last[w] = i
    return out


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word's place, bucket) of every n-gram of the words, marked at both ends, and of the words themselves."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lens)
    starts = ends - lens
    owner = np.repeat(np.arange(len(words)), lens)
    left = np.repeat(ends, lens) - np.arange(len(codes))
    power = np.concatenate((np.ones(1, _U), np.cumprod(np.full(int(lens.max()), _STEP[7]), dtype=_U)))
    whole = np.add.reduceat(codes * power[np.arange(len(codes)) - starts[owner]], starts)
    who, what = [np.arange(len(words))], [whole]
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), _U(n))
        for k in range(n):
            h = (h ^ codes[at + k]) * _STEP[k]
            h ^= h >> _U(29)
        who.append(owner[at])
        what.append(h)
    h = np.concatenate(what) * _U(0x9E3779B97F4A7C15)
    return np.concatenate(who), ((h >> _U(40)) % _U(BUCKETS)).astype(np.int64)


def _chunks(words: list[str]) -> Iterator[list[str]]:
    """Words to be cut into n-grams together."""
    for i in range(0, len(words), TOGETHER):
        yield words[i : i + TOGETHER]


def _gram_lists(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(where each word's buckets begin, with an end; all buckets, word by word)."""
    counts, buckets = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)]
    for part in _chunks(words):
        who, what = _grams(part)
        buckets.append(what[np.argsort(who, kind="stable")].astype(np.int32))
        counts.append(np.bincount(who, minlength=len(part)))
    return np.cumsum(np.concatenate(counts)), np.concatenate(buckets)


def _means(weight: np.ndarray, first: np.ndarray, what: np.ndarray) -> np.ndarray:
    """Each word's mean weight over its buckets, which are one at least."""
    parts = [np.zeros(0)]
    for lo in range(0, len(first) - 1, TOGETHER):
        at = first[lo : lo + TOGETHER + 1]
        parts.append(np.add.reduceat(weight[what[at[0] : at[-1]]], at[:-1] - at[0]) / np.diff(at))
    return np.concatenate(parts)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _window_means(u: np.ndarray, clean: float = 0.0) -> np.ndarray:
    if len(u) <= WINDOW:
        return np.array([(u.sum() + (WINDOW - len(u)) * clean) / WINDOW])
    c = np.concatenate(([0.0], np.cumsum(u)))
    return (c[WINDOW:] - c[:-WINDOW]) / WINDOW


class Scorer:
    """What a bucket adds to the log odds, the mean word of clean texts, and how windows become a probability."""

    def __init__(self, weight: np.ndarray, fit: np.ndarray, clean: float = 0.0):
        self.weight, self.fit, self.clean = weight, fit, clean
        self._known: dict[str, float] = {}

    def __getstate__(self):
        return {"weight": self.weight, "fit": self.fit, "clean": self.clean, "_known": {}}

    def word_values(self, words: list[str]) -> np.ndarray:
        parts = [np.zeros(0)]
        for part in _chunks(words):
            who, what = _grams(part)
            parts.append(np.bincount(who, self.weight[what], len(part)) / np.maximum(np.bincount(who, minlength=len(part)), 1))
        return np.concatenate(parts)

    def features(self, texts: list[str]) -> np.ndarray:
        known, out = self._known, []
        for i in range(0, len(texts), 256):
            split = [words_of(t) for t in texts[i : i + 256]]
            new = [w for w in set().union(*split) if w not in known]
            got = dict(zip(new, self.word_values(new).tolist(), strict=True))
            room = CACHED_WORDS - len(known)
            known.update((w, got[w]) for w in new[: max(room, 0)] if len(w) <= CACHED_CHARS)
            for ws in split:
                u = np.array([known[w] if w in known else got[w] for w in ws])
                m = _window_means(u, self.clean)
                out.append((m.max(), u.mean() if len(u) > WINDOW else m[0], np.log1p(max(len(u), WINDOW))))
        return np.array(out).reshape(-1, 3)

    def scores(self, texts: list[str]) -> np.ndarray:
        return _probability(self.features(texts), self.fit)


def _probability(x: np.ndarray, fit: np.ndarray) -> np.ndarray:
    return _sigmoid(np.c_[(x - fit[0]) / fit[1], np.ones(len(x))] @ np.append(fit[2], fit[3, 0]))


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic fit by Newton steps: rows of means, scales, slopes, and the intercept."""
    mean, scale = np.average(x, axis=0, weights=weight), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    b = np.zeros(z.shape[1])
    ridge = np.diag([1.0] * x.shape[1] + [1e-3])
    for _ in range(30):
        p = _sigmoid(z @ b)
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge
        b += np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge @ b)
    return np.array([mean, scale, b[:-1], [b[-1]] * x.shape[1]])


def train(texts: list[str], y: np.ndarray, rate_of_toxic: float, seed: int = 3) -> Scorer:
    """Learn from texts and 0/1 labels; with one class alone every text scores that class's rate."""
    rng = np.random.default_rng(seed)
    y = np.asarray(y, np.float64)
    if len(set(y.tolist())) < 2:
        flat = np.array([[0.0] * 3, [1.0] * 3, [0.0] * 3, [np.log((rate_of_toxic + 1e-6) / (1 - rate_of_toxic + 1e-6))] * 3])
        return Scorer(np.zeros(BUCKETS), flat)
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int64) for t in texts]
    words = list(number)
    first, what = _gram_lists(words)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    soft, bias = rng.normal(0, 0.2, (DIM, 2)), np.zeros(2)
    seen_table, seen_soft, seen_bias = np.full(BUCKETS, 1e-4), np.full((DIM, 2), 1e-4), np.full(2, 1e-4)
    kept_out = rng.random(len(docs)) < 0.25
    learn = np.array([i for i in range(len(docs)) if len(docs[i]) and not kept_out[i]], np.int64)
    share = y[learn].mean() if len(learn) else 0.5
    balance = np.where(y > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
    epochs = max(EPOCHS, -(-STEPS * BATCH // max(len(learn), 1)) if len(learn) else 0)
    epochs = min(epochs, 8 * EPOCHS)
    for epoch in range(epochs):
        late = epoch >= WARM * epochs
        if late:
            value = _means(table @ (soft[:, 1] - soft[:, 0]), first, what)
        rng.shuffle(learn)
        for at in range(0, len(learn), BATCH):
            batch = learn[at : at + BATCH]
            takes = []
            for i in batch:
                last = max(len(docs[i]) - WINDOW, 0)
                begin = int(np.argmax(_window_means(value[docs[i]]))) if late else int(rng.integers(0, last + 1))
                takes.append(docs[i][begin : begin + WINDOW])
            n_words = np.full(len(takes), WINDOW)
            word = np.concatenate(takes)
            text = np.repeat(np.arange(len(takes)), [len(t) for t in takes])
            n = first[word + 1] - first[word]
            gram = what[np.repeat(first[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            share_of = np.repeat(1 / (n * n_words[text]), n)
            of = np.repeat(text, n)
            hidden = np.stack([np.bincount(of, table[gram, d] * share_of, len(takes)) for d in range(DIM)], axis=1)
            odds = hidden @ soft * SHARP + bias
            p = np.exp(odds - odds.max(axis=1, keepdims=True))
            error = (p / p.sum(axis=1, keepdims=True) - np.stack((1 - y[batch], y[batch]), axis=1)) * balance[batch][:, None]
            # the errors of two classes are opposite, so a gram moves along the difference of their vectors
            lean = soft[:, 1] - soft[:, 0]
            g = np.bincount(gram, error[of, 1] * share_of * SHARP, BUCKETS)
            hit = np.flatnonzero(g)
            seen_table[hit] += g[hit] ** 2 * (lean @ lean) / DIM
            d_soft, d_bias = hidden.T @ error * SHARP, error.sum(axis=0)
            table[hit] -= RATE * (g[hit] / np.sqrt(seen_table[hit]))[:, None] * lean / np.sqrt(DIM) * 0.2
            seen_soft += d_soft**2
            seen_bias += d_bias**2
            soft -= 0.5 * RATE * d_soft / np.sqrt(seen_soft)
            bias -= 0.5 * RATE * d_bias / np.sqrt(seen_bias)
    scorer = Scorer(table @ (soft[:, 1] - soft[:, 0]) * SHARP, None)
    value = _means(scorer.weight, first, what)
    plain = [docs[i] for i in learn if y[i] == 0]
    scorer.clean = float(value[np.concatenate(plain)].mean()) if plain else 0.0
    fit_on = np.flatnonzero(kept_out) if len(set(y[kept_out].tolist())) == 2 else np.arange(len(docs))
    cuts = [_cut(rng, docs[i], value, y[i] > 0) for i in fit_on]
    names = np.array(words, dtype=object)
    x = scorer.features([texts[i] for i in fit_on] + [" ".join(names[c]) for c in cuts])
    t = y[fit_on]
    weight = np.where(t > 0, rate_of_toxic / t.mean(), (1 - rate_of_toxic) / (1 - t.mean()))
    scorer.fit = _calibrate(x, np.concatenate((t, t)), np.concatenate((weight, weight * SHORT_SHARE)))
    return scorer


def _cut(rng, words: np.ndarray, value: np.ndarray, toxic: bool) -> np.ndarray:
    """Some words in a row: any of a clean text, those around its most toxic one of a toxic text."""
    n = int(rng.integers(0, WINDOW + 1))
    at = int(rng.integers(0, max(len(words) - n, 0) + 1))
    if toxic and len(words):
        n, at = max(n, 3), max(int(np.argmax(value[words])) - int(rng.integers(0, max(n, 3))), 0)
    return words[at : at + n]


def toxicity_scorer(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH) -> Scorer:
    got, counts = sample(docs, labels, "toxic", each)
    rate = counts[1] / max(sum(counts.values()), 1)
    return train(got["text"].tolist(), got["y"].to_numpy(), min(max(rate, 1e-3), 1 - 1e-3))


def toxicity_scores(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Null, empty and wordless texts are scored like a window of mean clean words.
    Without labels of both classes every text has the rate of the one seen.
    Null ids stay null and are not held out; rows that repeat an id are scored
    by themselves; equal texts have equal scores.  Other columns are ignored.
    """
    return scored(docs, toxicity_scorer(docs, labels, each), THRESHOLD)


def without_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", each: int = SAMPLE_EACH) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic; columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(toxicity_scorer(docs, labels, each))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.scores([t if isinstance(t, str) else "" for t in texts]))

    return docs.filter(score(F.col(text)) < THRESHOLD)
