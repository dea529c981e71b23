"""Greedy longest-match piece counts by a linear automaton.

The pieces of a vocabulary form a trie.  As published for linear-time
word-piece tokenisation (Song, Salcianu, Song, Dopson, Zhou, 2021), each node
has a failure link: the node reached by the rest of its string once the longest
pieces have been taken off its front, and beside it the number of pieces so
taken.  A word is read once, character by character; a failing step adds the
node's count and follows its link, so lengths come without building pieces.

A word is a run of characters outside ``[\\x20\\x09-\\x0D]``.  Its first piece is
one that begins with the word mark, the others are pieces without it.  A
character that no piece covers counts as its UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import mapped, texts_of

MARK = "▁"
CACHED_WORDS = 400_000
CACHED_CHARS = 64
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Automaton:
    def __init__(self, first: Iterable[str], rest: Iterable[str]):
        """``first``: what may begin a word (its mark taken off); ``rest``: what may follow."""
        # Node 0 begins words, node 1 continues them.
        self.step: list[dict[str, int]] = [{}, {}]
        self.ends = [False, False]
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                node = root
                for c in piece:
                    node = self.step[node].setdefault(c, len(self.step))
                    if node == len(self.ends):
                        self.step.append({})
                        self.ends.append(False)
                if piece:
                    self.ends[node] = True
        self.link = [-1] * len(self.step)
        self.taken = [0] * len(self.step)
        self._connect()

    def _connect(self) -> None:
        """Failure links and counts, breadth first; a word that no marked piece begins has the mark for itself."""
        self.link[0], self.taken[0] = 1, 1
        level = [0, 1]
        while level:
            below = []
            for node in level:
                for c, child in self.step[node].items():
                    below.append(child)
                    if self.ends[child]:
                        self.link[child], self.taken[child] = 1, 1
                        continue
                    at, n = self.link[node], self.taken[node]
                    while at >= 0 and c not in self.step[at]:
                        n += self.taken[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[child], self.taken[child] = self.step[at][c], n
            level = below

    def count(self, word: str) -> int:
        """Pieces that greedy longest match cuts ``word`` into."""
        step, link, taken = self.step, self.link, self.taken
        node, n, i, size = 0, 0, 0, len(word)
        while i < size:
            c = word[i]
            while node >= 0 and c not in step[node]:
                n += taken[node]
                node = link[node]
            if node >= 0:
                node = step[node][c]
                i += 1
                continue
            return self._fallback(word, 0)
        while node > 1:
            if link[node] < 0:
                return self._fallback(word, 0)
            n += taken[node]
            node = link[node]
        return n

    def _fallback(self, word: str, at: int) -> int:
        """Longest match piece by piece, for words that the vocabulary does not cover."""
        n, root = 0, 0
        while at < len(word):
            node, end, i = root, 0, at
            while i < len(word) and (node := self.step[node].get(word[i], -1)) >= 0:
                i += 1
                if self.ends[node]:
                    end = i
            if not end and root == 0:
                n += 1  # the mark alone
            elif not end:
                n += len(word[at].encode("utf-8", "surrogatepass"))
                at += 1
            else:
                n += 1
                at = end
            root = 1
        return n


def of_pieces(pieces: Iterable[str]) -> Automaton:
    pieces = list(pieces)
    return Automaton([p[len(MARK):] for p in pieces if p.startswith(MARK)], [p for p in pieces if not p.startswith(MARK)])


@lru_cache(maxsize=2)
def of_model(path: str) -> Automaton:
    """The ordinary pieces of a sentencepiece model."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    return of_pieces(p.piece for p in spec.pieces if p.type == p.NORMAL)


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        count, known = of_model(path).count, {}
        for batch in batches:
            words, tokens = [], []
            for text in texts_of(batch):
                found = _WORD.findall(text or "")
                n = 0
                for w in found:
                    k = known.get(w)
                    if k is None:
                        k = count(w)
                        if len(known) < CACHED_WORDS and len(w) <= CACHED_CHARS:
                            known[w] = k
                    n += k
                words.append(len(found))
                tokens.append(n)
            yield {"doc_id": batch.column("doc_id"), "n_words": words, "n_tokens": tokens}

    return run


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row; null, empty and wordless texts have 0 of both; null ids stay null and rows that repeat an id are counted by themselves.  Other columns are ignored."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return mapped(plain, _counts(path), "doc_id long, n_words long, n_tokens long")
