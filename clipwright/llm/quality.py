"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is linear in a fixed set of features of its whole text.
Every pair of a good and a bad document that is learned from says which is to
be the stronger; the mean logistic loss on the difference of their features is
minimised by Newton steps in numpy, from sums over all pairs.  The cut is a quantile of strengths: the share of bad documents among
all learnable labels.  A logistic curve through that cut, at which the score is
0.3, turns strengths into scores.
"""

from __future__ import annotations

import zlib
from operator import eq

import numpy as np
from pyspark.sql import DataFrame

from .labelled import sample, scored

#: Labelled texts of either class that are learned from, and how much their pairs together count beside the ridge.
SAMPLE_EACH, PAIRS = 3000, 30_000
#: Good texts whose pairs with all bad ones are held at once.
BLOCK = 256
THRESHOLD = 0.3
RIDGE, STEPS = 1.0, 25

FEATURES = (
    "log_words", "mean_word", "log_chars_per_line", "upper", "digit", "space", "stops", "shouts", "bars", "signs", "other_marks",
    "high_bytes", "distinct_words", "repeats", "distinct_pairs", "packed", "marked_words", "capital_words", "one_char_words", "distinct_lines",
)
_UPPER, _DIGIT, _STOPS, _SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"#$%&*@^~=<>/\\_+"


def _codes(raw: bytes) -> list[int]:
    return list(raw)


def features(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    w = max(len(words), 1)
    lines = text.split("\n")
    marks = seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum()
    signs, stops = seen[_codes(_SIGNS)].sum(), seen[_codes(_STOPS)].sum()
    pairs = len(set(zip(words, words[1:], strict=False))) / max(w - 1, 1) if len(words) > 1 else 1.0
    return [
        np.log1p(len(words)), len(raw) / w, np.log1p(n / len(lines)),
        seen[_codes(_UPPER)].sum() / n, seen[_codes(_DIGIT)].sum() / n, (seen[32] + seen[9:14].sum()) / n, stops / n,
        seen[33] / n, seen[124] / n, signs / n, (marks - signs - stops - seen[33] - seen[124]) / n, seen[128:].sum() / n,
        len(set(words)) / w, sum(map(eq, words, words[1:])) / w, pairs, np.log(len(zlib.compress(raw, 1)) / n + 1e-3),
        sum(not x[-1].isalnum() for x in words) / w, sum(x.isupper() for x in words) / w, sum(len(x) == 1 for x in words) / w,
        len(set(lines)) / len(lines),
    ]


class Scorer:
    def __init__(self, mean, scale, weight, cut: float, slope: float):
        self.mean, self.scale, self.weight, self.cut, self.slope = mean, scale, weight, cut, slope

    def strengths(self, texts: list[str]) -> np.ndarray:
        x = np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        out = np.zeros(len(z))
        for i, w in enumerate(self.weight):  # in one order for every text: a matrix product's depends on the text's place
            out += z[:, i] * w
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        at = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.strengths(texts) - self.cut) + at, -40, 40)))


def _quantile(values: np.ndarray, weight: np.ndarray, q: float) -> float:
    order = np.argsort(values, kind="stable")
    total = np.cumsum(weight[order])
    i = min(int(np.searchsorted(total, q * total[-1])), len(values) - 1)
    lo, hi = values[order[max(i - 1, 0)]], values[order[i]]
    return float(lo + hi) / 2


def _sums(good: np.ndarray, bad: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the log likelihood at weights ``b``, means over all pairs of a good and a bad row."""
    n = len(b)
    s, t, slope, curve = good @ b, bad @ b, np.zeros(n), np.zeros((n, n))
    lost, weighed = np.zeros(len(bad)), np.zeros(len(bad))
    for i in range(0, len(good), BLOCK):
        z = good[i : i + BLOCK]
        miss = 1 / (1 + np.exp(np.clip(s[i : i + BLOCK, None] - t, -40, 40)))
        w = miss * (1 - miss)
        slope += z.T @ miss.sum(axis=1)
        lost += miss.sum(axis=0)
        weighed += w.sum(axis=0)
        cross = z.T @ (w @ bad)
        curve += (z * w.sum(axis=1)[:, None]).T @ z - cross - cross.T
    pairs = len(good) * len(bad)
    return (slope - bad.T @ lost) / pairs, (curve + (bad * weighed[:, None]).T @ bad) / pairs


def train(texts: list[str], y, rate_of_good: float, seed: int = 5) -> Scorer:
    """Learn from texts and 0/1 labels; with one class alone all texts get the same score.  No pair is drawn, so ``seed`` decides nothing."""
    y = np.asarray(y)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        flat = np.zeros(len(FEATURES))
        return Scorer(flat, flat + 1, flat, 0.0 if not len(bad) else 1.0, 1.0)
    x = np.array([features(t) for t in texts])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.clip((x - mean) / scale, -8, 8)
    b = np.zeros(z.shape[1])
    for _ in range(STEPS):
        slope, curve = _sums(z[good], z[bad], b)
        step = np.linalg.solve(PAIRS * curve + RIDGE * np.eye(len(b)), PAIRS * slope - RIDGE * b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ b
    weight = np.where(y == 1, rate_of_good / max(len(good), 1), (1 - rate_of_good) / max(len(bad), 1))
    cut = _quantile(s, weight, 1 - rate_of_good)
    return Scorer(mean, scale, b, cut, 4 / max(np.median(np.abs(s - cut)), 1e-6))


def quality_scorer(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH) -> Scorer:
    got, counts = sample(docs, labels, "quality", each)
    total = sum(counts.values())
    return train(got["text"].tolist(), got["y"].to_numpy(), counts[1] / total if total else 0.5)


def quality_scores(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Null and empty texts get the score of the features of an empty text.
    Without labels of both classes all texts share one score: 0.3 or more where
    only good ones are known.  Null ids stay null and are not held out; rows
    that repeat an id are scored by themselves; equal texts have equal scores.
    Other columns are ignored.
    """
    return scored(docs, quality_scorer(docs, labels, each), THRESHOLD)
