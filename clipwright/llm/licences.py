"""Licence families of paragraphs by a trained classifier, confirmed against templates.

A paragraph is a run of lines that are not blank; punctuation counts as space,
so wrapped notices and those behind comment marks are paragraphs, too.  Its
words, pairs and triples of words are hashed, and every window of ``WINDOWS``
words of it is scored by a sparse logistic regression, which says whether it
names a licence at all, and by a softmax over families, which says which.

Both are trained in numpy on the wordings and declarations of
``licence_texts``, varied by dropped words, cut ends and neighbouring prose, on
windows of the corpus that hold such a wording, against windows of the corpus
that hold none and sentences that only sound like licences.  The first is
calibrated on examples kept out, so that "unknown" is a class with a probability
of its own; ``Scorer.calibration`` says how far that probability is off there.

The most probable window of a paragraph is taken first, then the next that does
not overlap with it.  A prediction stands only if some wording of its family is
found around its window by most of its pairs of words; failing that the next
family is asked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import mapped, texts_of
from .licence_texts import FRAMES, NAMES, NO_LICENCE, TEMPLATES
from .shingles import _combine, word_chunks

#: Documents whose paragraphs are learned from, windows of each, and words of a window.
SAMPLE_DOCS, SAMPLE_EACH = 2000, 6
WINDOWS = (10, 40)
VARIANTS, BUCKETS, GRAMS = 16, 1 << 18, (1, 2, 3)
EPOCHS, RATE, L2 = 8, 0.4, 1e-5
KNOWN = 0.5
#: Share of a wording's pairs of words that must be found within so many words around a window.
CONFIRM, AROUND = 0.75, 40
#: Families of a window, most probable first, of which the first confirmed one stands.
GUESSES = 2
_MARKS = bytes(range(33, 46)) + b"/" + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_BARE = bytes.maketrans(_MARKS, b" " * len(_MARKS))
_DOT = re.compile(rb"\.(?![0-9])")
_BLANK = re.compile(rb"\n[\x20\x09-\x0d]*\n[\x20\x09-\x0d]*")


def bare(text: str | None) -> bytes:
    """ASCII punctuation taken for spaces, but for the dots and hyphens of numbers and names."""
    return _DOT.sub(b" ", (text or "").encode("utf-8", "surrogatepass").translate(_BARE))


def paragraphs(text: str | None) -> list[bytes]:
    """The runs of lines that are not blank."""
    return [p for p in _BLANK.split(bare(text)) if p.strip()]


def _grams(words: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each width the bucket of the n-gram that begins at a word, -1 where it would leave the paragraph."""
    ends = at[1:][np.repeat(np.arange(len(at) - 1), np.diff(at))]
    out = []
    for n in GRAMS:
        h = np.full(len(words), -1, np.int64)
        got = (_combine(words, n) % np.uint64(BUCKETS)).astype(np.int64)
        h[: len(got)] = got
        h[np.arange(len(words)) + n > ends] = -1
        out.append(h)
    return out


def _bag(words: np.ndarray) -> np.ndarray:
    """The buckets of all n-grams of one window."""
    return np.concatenate([g[g >= 0] for g in _grams(words, np.array([0, len(words)]))])


def _pairs(words: np.ndarray) -> np.ndarray:
    return np.unique(_combine(words, 2)) if len(words) > 1 else np.unique(words)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _words(lines: list[bytes]) -> list[np.ndarray]:
    return [words[s:e] for _, words, at in word_chunks(lines) for s, e in zip(at[:-1], at[1:], strict=True)]


def wordings() -> list[tuple[str, bytes]]:
    """(family, wording) of all fixed texts and of the declarations made of the families' names."""
    full = [(f, bare(line)) for f in sorted(TEMPLATES) for line in TEMPLATES[f].split("\n") if line.strip()]
    return full + [(f, bare(frame.format(name))) for f in sorted(NAMES) for name in NAMES[f] for frame in FRAMES]


class Scorer:
    def __init__(self, families: list[str], known: np.ndarray, bias: float, curve: tuple[float, float], weight: np.ndarray, offsets: np.ndarray, templates: list[list[np.ndarray]], calibration: dict[str, float]):
        self.families, self.known, self.bias, self.curve = families, known, bias, curve
        self.weight, self.offsets, self.templates, self.calibration = weight, offsets, templates, calibration
        self.every = np.unique(np.concatenate([t for own in templates for t in own]))

    def share(self, family: int, words: np.ndarray) -> float:
        """The largest share of the pairs of one of the family's wordings that ``words`` hold."""
        pairs = _pairs(words)
        return max(float(np.isin(t, pairs).mean()) for t in self.templates[family])

    def windows(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, probability of a licence) of every window that reaches ``KNOWN``."""
        ends = at[1:][np.repeat(np.arange(len(at) - 1), np.diff(at))]
        sums = [np.concatenate(([0.0], np.cumsum(np.where(g >= 0, self.known[g], 0.0)))) for g in _grams(words, at)]
        begin = np.arange(len(words))
        first = at[:-1][np.repeat(np.arange(len(at) - 1), np.diff(at))]
        found = []
        for size in WINDOWS:
            b = begin[(begin + size <= ends) | (begin == first)]
            e = np.minimum(b + size, ends[b])
            total = sum(s[np.maximum(e - n + 1, b)] - s[b] for n, s in zip(GRAMS, sums, strict=True))
            p = _sigmoid(self.curve[0] * (total + self.bias) + self.curve[1])
            hit = p >= KNOWN
            found.append(np.stack((b[hit], e[hit], p[hit])))
        b, e, p = np.concatenate(found, axis=1)
        b, e = b.astype(np.int64), e.astype(np.int64)
        # without any pair of a wording around it a window cannot be confirmed
        near = np.concatenate(([0], np.cumsum(np.isin(_combine(words, 2), self.every)))) if len(words) > 1 else np.zeros(1, np.int64)
        last = len(near) - 1
        some = near[np.minimum(e + AROUND, last)] > near[np.minimum(np.maximum(b - AROUND, 0), last)]
        return b[some], e[some], p[some]

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, float]]:
        """(text, paragraph, family, probability of a licence) of each confirmed window."""
        lines, owner, place = [], [], []
        for i, t in enumerate(texts):
            own = paragraphs(t)
            lines += own
            owner += [i] * len(own)
            place += range(len(own))
        for first, words, at in word_chunks(lines):
            begin, end, p = self.windows(words, at)
            taken = np.zeros(len(words), bool)
            for k in np.lexsort((begin, -p)):
                b, e = begin[k], end[k]
                if taken[b:e].any():
                    continue
                taken[b:e] = True
                odds = self.offsets + self.weight[_bag(words[b:e])].sum(axis=0)
                para = int(np.searchsorted(at, b, side="right")) - 1
                lo, hi = max(b - AROUND, at[para]), min(e + AROUND, at[para + 1])
                for family in np.argsort(-odds, kind="stable")[:GUESSES].tolist():
                    if self.share(family, words[lo:hi]) >= CONFIRM:
                        yield owner[first + para], place[first + para], family, float(p[k])
                        break


def _varied(rng, words: list[bytes], prose: list[list[bytes]]) -> bytes:
    if len(words) > 5 and rng.random() < 0.4:
        words = [w for w in words if rng.random() > 0.08] or words
    if rng.random() < 0.3 and len(words) > 8:
        size = int(len(words) * rng.uniform(0.75, 1))
        begin = int(rng.integers(0, len(words) - size + 1))
        words = words[begin : begin + size]
    if prose and rng.random() < 0.7:
        other = prose[int(rng.integers(len(prose)))]
        cut = int(rng.integers(0, len(other) + 1))
        words = other[:cut] + words + other[cut:]
    return b" ".join(words)


def train(corpus: list[bytes], seed: int = 17) -> Scorer:
    """Learn from the fixed wordings and from windows of corpus paragraphs, which may be none."""
    rng = np.random.default_rng(seed)
    families = sorted(TEMPLATES)
    fixed = [(families.index(f), w) for f, w in wordings()]
    templates: list[list[np.ndarray]] = [[] for _ in families]
    for (f, _), words in zip(fixed, _words([w for _, w in fixed]), strict=True):
        templates[f].append(_pairs(words))
    every = np.unique(np.concatenate([t for own in templates for t in own]))
    lines, kind, unlike = [], [], []
    for line, words in zip(corpus, _words(corpus), strict=True):
        own = _pairs(words)
        shares = [max(np.isin(t, own).mean() for t in ts) for ts in templates] if np.isin(own, every).any() else [0.0]
        if max(shares) >= CONFIRM:  # the corpus's own examples of a licence
            lines.append(line)
            kind.append(int(np.argmax(shares)))
        elif max(shares) < 0.5:  # what holds half of a wording is no example of either
            unlike.append(line)
    prose = [line.split()[:30] for line in unlike[:500]]
    for f, wording in fixed:
        for _ in range(VARIANTS if len(wording.split()) > 8 else VARIANTS // 3):
            lines.append(_varied(rng, wording.split(), prose))
            kind.append(f)
    for line in NO_LICENCE.split("\n"):
        for _ in range(VARIANTS if line.strip() else 0):
            lines.append(_varied(rng, bare(line).split(), prose))
            kind.append(-1)
    lines += unlike
    kind = np.array(kind + [-1] * len(unlike))
    rows = [_bag(w) if len(w) else np.zeros(0, np.int64) for w in _words(lines)]
    out = rng.random(len(lines)) < 0.2
    known, bias, seen = np.zeros(BUCKETS), -1.0, np.full(BUCKETS, 1e-3)
    weight, offsets, seen_w = np.zeros((BUCKETS, len(families))), np.zeros(len(families)), np.full(BUCKETS, 1e-3)
    for _ in range(EPOCHS):
        for i in rng.permutation(np.flatnonzero(~out)):
            g = rows[i]
            if not len(g):
                continue
            error = _sigmoid(known[g].sum() + bias) - (kind[i] >= 0)
            if abs(error) > 1e-3:
                seen[g] += error * error
                known[g] -= RATE * (error / np.sqrt(seen[g]) + L2 * known[g]) / np.sqrt(len(g))
                bias -= 0.02 * error
            if kind[i] >= 0:
                odds = weight[g].sum(axis=0) + offsets
                p = np.exp(odds - odds.max())
                p /= p.sum()
                p[kind[i]] -= 1
                if np.abs(p).max() > 1e-3:
                    seen_w[g] += (p * p).sum()
                    weight[g] -= RATE * p / np.sqrt(seen_w[g] * len(g))[:, None]
    held = rng.permutation(np.flatnonzero(out))
    raw = np.array([known[rows[i]].sum() + bias for i in held])
    true = (kind[held] >= 0).astype(float)
    half = len(held) // 2  # one half fits the curve, the other says how good it is
    curve = _curve(raw[:half], true[:half])
    return Scorer(families, known.astype(np.float32).astype(np.float64), float(bias), curve, weight, offsets, templates, _calibration(_sigmoid(curve[0] * raw[half:] + curve[1]), true[half:]))


def _calibration(p: np.ndarray, y: np.ndarray, bins: int = 10) -> dict[str, float]:
    """Examples, mean square error of the probability, its mean distance from the true share by bins, and the share judged right."""
    if not len(p):
        return {"n": 0, "brier": 0.0, "error": 0.0, "right": 1.0}
    own = np.minimum((p * bins).astype(int), bins - 1)
    gap = sum(abs(p[own == b].sum() - y[own == b].sum()) for b in range(bins)) / len(p)
    return {"n": len(p), "brier": float(((p - y) ** 2).mean()), "error": float(gap), "right": float(((p >= KNOWN) == (y > 0)).mean())}


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's two parameters by Newton steps, with his smoothed targets."""
    if not len(x) or y.min() == y.max():
        return 1.0, 0.0
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z, b = np.c_[x, np.ones(len(x))], np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(z @ b)
        b += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (t - p) - 1e-3 * (b - [1.0, 0.0]))
    return float(b[0]), float(b[1])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """At most ``SAMPLE_EACH`` windows of a text's paragraphs, evenly placed."""
    size = WINDOWS[-1]
    for batch in batches:
        ids, out = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
            starts = [(p, i) for p in (p.split() for p in paragraphs(text)) for i in range(0, len(p), size)]
            for p, i in starts[:: max(1, -(-len(starts) // SAMPLE_EACH))]:
                ids.append(doc)
                out.append(b" ".join(p[i : i + size]))
        yield {"doc_id": ids, "window": out}


def licence_scorer(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Scorer:
    """A classifier that learns of the corpus from ``SAMPLE_DOCS`` texts, chosen by a hash of their ids; of these only windows come to the driver."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    ids = plain.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    texts = plain.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    got = mapped(texts, _sampled, "doc_id long, window binary").toPandas().sort_values(["doc_id", "window"])
    return train([bytes(w) for w in got["window"]])


def licence_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scorer: Scorer | None = None) -> DataFrame:
    """(doc_id, n_paragraphs, n_licence, families, licence_paragraphs, score) for each row of ``docs``.

    ``families`` are the distinct families found, sorted and joined by commas;
    ``licence_paragraphs`` the numbers of their paragraphs from 0, ascending;
    ``n_licence`` how many these are; ``score`` the highest probability of a
    licence among them, 0 if none.  A null, empty or blank text has no
    paragraph.  Null ids stay null; rows that repeat an id are scanned by
    themselves.  Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(scorer or licence_scorer(docs, doc_id, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        model = sent.value
        for batch in batches:
            texts = texts_of(batch)
            hits: list[list] = [[] for _ in texts]
            for i, place, family, p in model.find(texts):
                hits[i].append((place, model.families[family], p))
            places = [sorted({k for k, _, _ in h}) for h in hits]
            yield {
                "doc_id": batch.column("doc_id"), "n_paragraphs": [len(paragraphs(t)) for t in texts], "n_licence": list(map(len, places)),
                "families": [",".join(sorted({f for _, f, _ in h})) for h in hits], "licence_paragraphs": places,
                "score": [max((p for _, _, p in h), default=0.0) for h in hits],
            }

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return mapped(plain, run, "doc_id long, n_paragraphs long, n_licence long, families string, licence_paragraphs array<long>, score double")
