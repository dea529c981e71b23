"""Quality rules as a short-circuit cascade.

A text is kept if no rule rejects it, so the rules may be asked in any order and
the rest need not be asked after a rejection.  The order comes from a sample:
what each rule costs and which texts it rejects.  First stands the rule with the
most rejections for its cost, next the one with the most among the texts that
the first lets pass, and so on; what rejects nothing stands last, cheapest
first.  The order changes the work and never the verdict.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``; a word is known by its
64-bit hash.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import mapped, texts_of
from .shingles import _SPACE, _combine, _words

#: The sample: so many texts at most from each of so many partitions, spread evenly over the table.
SAMPLE_TEXTS, SAMPLE_PARTITIONS = 64, 32
WINDOW = 3

_BYTES = np.arange(256)
_FIRST = (_BYTES & 0xC0) != 0x80
_SYMBOL = np.isin(_BYTES, list(b"#*$%&|<>"))
_CAPITAL = (_BYTES >= ord("A")) & (_BYTES <= ord("Z"))
_SMALL = (_BYTES >= ord("a")) & (_BYTES <= ord("z"))
_LETTER = _CAPITAL | _SMALL | (_BYTES >= 0x80)


class Text:
    """What rules ask of one text, each worked out when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def bytes(self) -> np.ndarray:
        return np.frombuffer(self.raw, np.uint8)

    @cached_property
    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        inside = np.concatenate(([False], ~_SPACE[self.bytes], [False]))
        at = np.flatnonzero(inside[1:] != inside[:-1])
        return at[0::2], at[1::2]

    @cached_property
    def words(self) -> np.ndarray:
        """The hash of each word."""
        return _words([self.raw], lower=False)[0]

    def in_words(self, kind: np.ndarray) -> np.ndarray:
        """How many bytes of a kind each word has."""
        upto = np.concatenate(([0], np.cumsum(kind[self.bytes])))
        return upto[self.edges[1]] - upto[self.edges[0]]

    @cached_property
    def n_words(self) -> int:
        return len(self.edges[0])

    @cached_property
    def word_chars(self) -> int:
        return int(self.in_words(_FIRST).sum())

    @cached_property
    def n_symbols(self) -> int:
        return int(_SYMBOL[self.bytes].sum())

    @cached_property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return [line for line in self.text.split("\n") if line.strip(" \t\n\v\f\r")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words within windows that the text has twice or more."""
        if self.n_words < WINDOW:
            return 0
        _, same, times = np.unique(_combine(self.words, WINDOW), return_inverse=True, return_counts=True)
        change = np.zeros(self.n_words + 1, np.int64)
        at = np.flatnonzero(times[same] > 1)
        np.add.at(change, at, 1)
        np.add.at(change, at + WINDOW, -1)
        return int((np.cumsum(change) > 0).sum())

    @cached_property
    def n_letterless(self) -> int:
        """Words without a letter; every character beyond ASCII counts as one."""
        return int((self.in_words(_LETTER) == 0).sum())

    @cached_property
    def n_shouted(self) -> int:
        """Words with two capitals of A-Z and no small letter of a-z."""
        return int(((self.in_words(_CAPITAL) > 1) & (self.in_words(_SMALL) == 0)).sum())

    @cached_property
    def n_commonest(self) -> int:
        return int(np.unique(self.words, return_counts=True)[1].max()) if self.n_words else 0


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Text], bool]


#: The first two are the base; the others follow published heuristics for web text.
BASE = (
    Rule("few words", lambda t: t.n_words < 50),
    Rule("repeated windows", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
RULES = (
    *BASE,
    Rule("word length", lambda t: not 3 * t.n_words <= t.word_chars <= 10 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("duplicate lines", lambda t: 100 * t.n_dup_lines > 50 * len(t.lines)),
    Rule("letterless words", lambda t: 100 * t.n_letterless > 30 * t.n_words),
    Rule("shouted words", lambda t: 100 * t.n_shouted > 50 * t.n_words),
    Rule("one word", lambda t: 100 * t.n_commonest > 30 * t.n_words),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Asked(NamedTuple):
    """A rule's place in the cascade: seconds a text and the share it rejects of the sampled texts that reach it."""

    rule: Rule
    cost: float
    rejects: float


def _tried(rules: tuple[Rule, ...], step: int):
    """For the first texts of each ``step``-th partition: the rejecting rules as bits, and each rule's seconds.

    The bounds of the words, which nearly all rules need, are there before the
    clock starts; whatever else a rule needs counts for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        if TaskContext.get().partitionId() % step:
            return
        left = SAMPLE_TEXTS
        for batch in batches:
            bits, costs = [], []
            for text in texts_of(batch.slice(0, left)):
                found, took = 0, []
                for i, rule in enumerate(rules):
                    t = Text(text)
                    _ = t.edges
                    began = time.thread_time()
                    found |= rule.rejects(t) << i
                    took.append(time.thread_time() - began)
                bits.append(found)
                costs.append(took)
            yield {"bits": bits, "costs": costs}
            left -= len(bits)
            if left <= 0:
                return

    return run


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> list[Asked]:
    """The rules by rejections for their cost, estimated on a bounded sample of ``docs``; an empty table leaves them as they are."""
    plain = docs.select(F.col(text).alias("text"))
    step = max(1, plain.rdd.getNumPartitions() // SAMPLE_PARTITIONS)
    seen = mapped(plain, _tried(rules, step), "bits long, costs array<double>").collect()  # at most SAMPLE_TEXTS * 2 * SAMPLE_PARTITIONS rows
    bits = np.array([r["bits"] for r in seen], np.int64)
    costs = [max(float(np.mean([r["costs"][i] for r in seen])), 1e-9) if seen else 0.0 for i in range(len(rules))]
    return ordered(rules, bits, costs)


def ordered(rules: tuple[Rule, ...], bits: np.ndarray, costs: list[float]) -> list[Asked]:
    """Greedy order over sampled verdicts: a rule's rejections count where no rule before it rejects."""
    out, left, alive = [], list(range(len(rules))), np.ones(len(bits), bool)
    while left:
        share = {i: float((bits[alive] >> i & 1).mean()) if alive.any() else 0.0 for i in left}
        best = max(left, key=lambda i: (share[i] / costs[i] if costs[i] else 0.0, -costs[i], -i))
        out.append(Asked(rules[best], costs[best], share[best]))
        alive &= (bits >> best & 1) == 0
        left.remove(best)
    return out


def verdict(text: Text, order: tuple[Rule, ...]) -> tuple[Rule | None, int]:
    """The first rule that rejects, if any, and how many were asked."""
    for n, rule in enumerate(order, 1):
        if rule.rejects(text):
            return rule, n
    return None, len(order)


def _judged(order: tuple[Rule, ...], measures: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            rows = []
            for text in texts_of(batch):
                t = Text(text)
                rule, n = verdict(t, order)
                rows.append((rule.name if rule else None, n, *(getattr(t, m) for m in measures)))
            columns = map(list, zip(*rows, strict=True)) if rows else ([] for _ in range(2 + len(measures)))
            yield {"doc_id": batch.column("doc_id")} | dict(zip(("rule", "n_asked", *measures), columns, strict=True))

    return run


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, measures: tuple[str, ...] = MEASURES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kept, rule, n_asked, and the ``measures``) for each row.

    ``rule`` is the one that rejected and ``n_asked`` how many were asked; both
    depend on the order found, ``kept`` does not.  ``measures`` are worked out
    for every text whether or not a rule asks for them; give none to let the
    cascade skip them.  A null text has no words; null ids stay null and rows
    that repeat an id are judged by themselves.  Other columns are ignored.
    """
    order = tuple(a.rule for a in rule_order(docs, rules, text))
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = mapped(plain, _judged(order, measures), "doc_id long, rule string, n_asked int" + "".join(f", {m} long" for m in measures))
    return found.select("doc_id", F.col("rule").isNull().alias("kept"), "rule", "n_asked", *measures)


def without_rejected(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, that no rule rejects."""
    order = tuple(a.rule for a in rule_order(docs, rules, text))

    @F.pandas_udf("boolean")
    def passes(texts):
        import pandas as pd

        return pd.Series([verdict(Text(t if isinstance(t, str) else ""), order)[0] is None for t in texts], dtype=bool)

    return docs.filter(passes(F.col(text)))


def contract_rows(docs: DataFrame) -> DataFrame:
    """The digest of the registered query: the base measures, whether a base rule fails and the verdict."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return quality_rules(docs).select("doc_id", *MEASURES, failed.alias("base_failed"), "kept")
