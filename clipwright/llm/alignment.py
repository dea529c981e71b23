"""Two tokenizers over one text: which of their tokens cover the same bytes.

Tokenizer A is a byte-level BPE of the tokenizers library and reads a space and
the text; tokenizer B is a sentencepiece model, which writes that space itself.
The ends of A's tokens come from the library's character offsets, those of B's
from the spans of sentencepiece's immutable proto.  Both are coarse cuts: tokens
that share a character (parts of a multibyte one, pieces of the byte fallback)
all end where it ends.  Between two cuts that hold, the lengths of the decoded
bytes say where each token ends.

Text is encoded in chunks.  A chunk begins at a single space between two visible
characters, where neither tokenizer can have a token across: A's pattern begins
a new word there, and no piece of B holds a space after anything else.  Both are
read off the given files; where one does not hold, a text is one chunk.  Tokens,
groups and links of a chunk are the same wherever it stands, so short chunks are
encoded once in a task, up to a bound.

Pairs are counted by documents.  The counts of the commonest pairs, a bounded
number of them, go to every task; the others meet their counts by a join, so no
key of that join is in many documents.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import mapped, texts_of
from .pieces import SPACE
from .store import keep

#: Chunks up to so many characters are remembered, so many of them in a task.
SHORT, REMEMBERED = 64, 600_000
#: Pairs whose counts every task holds: at most 4 MB.
COMMON = 1 << 18
#: Pairs that a task gathers before it counts them.
TOGETHER = 1 << 21
#: Texts of a batch that are cut together until their characters pass this.
CHARACTERS = 1 << 20
_SEEN = "!-~À-က、-퟿\U00010000-\U0010ffff"
_CUT = re.compile(f"(?<=[{_SEEN}]) (?=[{_SEEN}])")
#: A chunk that may stand beside others, and the characters of such a row.
_WHOLE = re.compile(f"[{_SEEN}](?:.*[{_SEEN}])?", re.S)
JOINED = 1 << 13


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is visible, else the next from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(visible))
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers, the bytes of their tokens and the chunks met so far."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        letters = byte_alphabet()
        vocab = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        spec = pb.ModelProto()
        with open(path_b, "rb") as f:
            spec.ParseFromString(f.read())
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [bytes([int(p.piece[1:-1], 16)]) if p.type == p.BYTE else p.piece.replace(SPACE, " ").encode() for p in spec.pieces]
        self.size_a, self.size_b = (np.array([len(x) for x in each], np.int64) for each in (self.bytes_a, self.bytes_b))
        self.width = len(self.bytes_b)
        with open(path_a, encoding="utf-8") as f:
            rules = json.load(f)
        norm = spec.normalizer_spec
        plain_a = rules["normalizer"] is None and rules["pre_tokenizer"] == rules["pre_tokenizer"] | {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}
        plain_b = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and not any(SPACE in p.piece.lstrip(SPACE) for p in spec.pieces)
        self.cuts = plain_a and plain_b
        # an id with what follows it in a digest: another of its group's side, the other side, the next group
        self.names = [[f"{i}{mark}" for i in range(max(len(self.bytes_a), self.width))] for mark in ",|;"]
        self.newer: dict[str, Chunk] = {}
        self.older: dict[str, Chunk] = {}
        self.broken: set[str] = set()

    def chunks(self, text: str) -> list[str]:
        return _CUT.split(text) if self.cuts else [text]

    def chunked(self, texts: list[str]) -> Iterator[list[Chunk] | None]:
        """The chunks of each text; None where it has no tokens.

        What is remembered is in two halves: a chunk asked for is in the newer
        one or moves there, and when that is full the older one goes.
        """
        cut = [self.chunks(t) if t else [] for t in texts]
        missing = set().union(*cut).difference(self.newer)
        again = missing.intersection(self.older)
        self.newer.update((c, self.older[c]) for c in again)
        new = self._encoded(list(missing - again)) if missing - again else {}
        self.newer |= new
        self.broken.update(c for c, x in new.items() if x is BROKEN)
        for chunks in cut:
            yield None if not chunks or (self.broken and not self.broken.isdisjoint(chunks)) else list(map(self.newer.__getitem__, chunks))
        for c in new:
            if len(c) > SHORT:
                del self.newer[c]
                self.broken.discard(c)
        if len(self.newer) > REMEMBERED // 2:
            self.older, self.newer = self.newer, {}
            self.broken.intersection_update(self.older)

    def _encoded(self, chunks: list[str]) -> dict[str, Chunk]:
        """Chunks that may stand side by side are encoded as one text."""
        runs, size = [[]], 0
        for c in chunks:
            if self.cuts and _WHOLE.fullmatch(c):
                if size + len(c) > JOINED:
                    runs.append([])
                    size = 0
                runs[-1].append(c)
                size += len(c) + 1
        runs = [r for r in runs if r] + [[c] for c in chunks if not (self.cuts and _WHOLE.fullmatch(c))]
        return dict(zip(chain.from_iterable(runs), self._encoded_runs(runs), strict=True))

    def _encoded_runs(self, runs: list[list[str]]) -> list[Chunk]:
        texts = [" ".join(r) for r in runs]
        spaced = [" " + t for t in texts]
        encoded = self.a.encode_batch(spaced, add_special_tokens=False)
        pieces = [m.pieces for m in self.b.encode(texts, return_type="proto", num_threads=1)]
        n_a, n_b = np.array([len(e.ids) for e in encoded]), np.array([len(p) for p in pieces])
        a = np.fromiter(chain.from_iterable(e.ids for e in encoded), np.int64, n_a.sum())
        b, ends_b = np.fromiter(chain.from_iterable((p.id, p.end) for m in pieces for p in m), np.int64, 2 * n_b.sum()).reshape(-1, 2).T
        raws = [t.encode() for t in spaced]
        raw, sizes = b"".join(raws), np.array([len(r) for r in raws])
        good = (_sums(self.size_a[a], n_a) == sizes) & (_sums(self.size_b[b], n_b) == sizes)
        if not good.all() or self._spelt(a, b) != (raw, raw):
            split = [zip(np.split(x, np.cumsum(n)[:-1]), strict=True) for x, n in ((a, n_a), (b, n_b))]
            good = [self._spelt(x, y) == (r, r) for r, (x,), (y,) in zip(raws, *split, strict=True)]
            again = [[c] for r, g in zip(runs, good, strict=True) for c in r if not g and len(r) > 1]
            kept = iter(self._encoded_runs(some) if (some := [r for r, g in zip(runs, good, strict=True) if g]) else [])
            alone = iter(self._encoded_runs(again) if again else [])
            return [next(kept) if g else next(alone) if len(r) > 1 else BROKEN for r, g in zip(runs, good, strict=True) for _ in r]
        begins = np.cumsum(sizes) - sizes
        # A's offsets are characters of its run, the proto's are bytes of the text without the space before it
        first = np.cumsum([len(t) for t in spaced]) - [len(t) for t in spaced]
        chars = np.fromiter((end for e in encoded for _, end in e.offsets), np.int64, len(a)) + np.repeat(first, n_a)
        ends_b = ends_b + 1 + np.repeat(begins, n_b)
        each = np.array([len(c.encode()) + 1 for r in runs for c in r])
        stops = np.cumsum(each)
        return list(self._aligned(a, b, refined(in_bytes(raw, chars), self.size_a[a]), refined(ends_b, self.size_b[b]), stops))

    def _spelt(self, a: np.ndarray, b: np.ndarray) -> tuple[bytes, bytes]:
        return b"".join(map(self.bytes_a.__getitem__, a.tolist())), b"".join(map(self.bytes_b.__getitem__, b.tolist()))

    def _aligned(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, stops: np.ndarray) -> Iterator[Chunk]:
        """Groups and links of chunks that end at ``stops``; all ends ascend over all chunks."""
        cuts = ends_a[np.isin(ends_a, ends_b, assume_unique=True)]
        edges = np.union1d(ends_a, ends_b)  # two tokens overlap between two edges and in no other place
        links = a[np.searchsorted(ends_a, edges)] * self.width + b[np.searchsorted(ends_b, edges)]
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        side = np.concatenate((group_a * 2, group_b * 2 + 1))
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.concatenate((a, b))[order]
        turn = np.concatenate((side[1:] != side[:-1], [True]))
        mark = np.where(turn, 1 + side % 2, 0)
        names = self.names
        text = [names[m][i] for m, i in zip(mark.tolist(), ids.tolist(), strict=True)]
        upto = np.stack([np.searchsorted(x, stops, "right") for x in (ends_a, ends_b, cuts, edges)])
        n_a, n_b, n_groups, n_links = np.diff(upto, axis=1, prepend=0)
        packed = links.astype(np.int32).tobytes()
        last_text, last_link = 0, 0
        for na, nb, ng, nl in zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), strict=True):
            digest = "".join(text[last_text : last_text + na + nb])[:-1]
            yield Chunk(na, nb, ng, digest, packed[last_link : last_link + 4 * nl])
            last_text, last_link = last_text + na + nb, last_link + 4 * nl


class Chunk(NamedTuple):
    """Tokens of either side, groups, and links as A id times B's vocabulary plus B id, in 32-bit integers; ``digest`` is None where the bytes differ."""

    n_a: int
    n_b: int
    n_groups: int
    digest: str | None
    links: bytes


_NONE = np.zeros(0, np.int32)
BROKEN = Chunk(0, 0, 0, None, b"")


def in_bytes(raw: bytes, chars: np.ndarray) -> np.ndarray:
    """Character offsets as byte offsets."""
    if raw.isascii():
        return chars
    whole = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    return np.concatenate((np.flatnonzero(whole), [len(raw)]))[chars]


def refined(coarse: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ends of tokens of these decoded sizes: the coarse end where the next token's lies beyond it, else on from the last such end by decoded bytes.

    A coarse end inside a character, or before a space that the offsets trim,
    is none.
    """
    by_size = np.cumsum(sizes)
    holds = (coarse == by_size) & np.concatenate((coarse[1:] > coarse[:-1], [True]))
    last = np.maximum.accumulate(np.where(holds, np.arange(len(coarse)), -1))
    return np.where(last >= 0, coarse[last] + by_size - by_size[last], by_size)


def _sums(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    upto = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))]
    return upto[1:] - upto[:-1]


@lru_cache(maxsize=1)
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _aligned_texts(both: Pair, texts: list[str]) -> Iterator[list[Chunk] | None]:
    """The chunks of each text, as many texts at a time as ``CHARACTERS`` allows."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHARACTERS):
            size += len(texts[end])
            end += 1
        yield from both.chunked(texts[at:end])
        at = end


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, _NONE]).astype(np.int32)))


_FIELDS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def _documents(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        both = pair(path_a, path_b)
        for batch in batches:
            rows, keys, times = [], [], []
            for got in _aligned_texts(both, [t or "" for t in texts_of(batch)]):
                n_a, n_b, n_groups, digests, packed = zip(*got, strict=True) if got else ((),) * 5
                links, n = np.unique(np.frombuffer(b"".join(packed), np.int32), return_counts=True)
                keys.append(links)
                times.append(n)
                rows.append((sum(n_a), sum(n_b), sum(n_groups), int(n.sum()), hashlib.sha256(";".join(digests).encode()).hexdigest() if got else ""))
            columns = list(map(list, zip(*rows, strict=True))) if rows else [[]] * 5
            yield {"row": batch.column("row"), "doc_id": batch.column("doc_id"), "pairs": _lists(keys), "times": _lists(times)} | dict(zip(_FIELDS[1:], columns, strict=True))

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """In how many of a task's documents each pair is, in parts."""
    held, size = [], 0

    def out():
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        return {"pair": pairs, "n": n}

    for batch in batches:
        pairs = batch.column("pairs").flatten().to_numpy()
        held.append(pairs)
        size += len(pairs)
        if size >= TOGETHER:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _common(sent):
    """The sums over the common pairs, and what is left of each document's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known, docs, top = sent.value
        for batch in batches:
            lists = batch.column("pairs")
            pairs, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            sums, best = np.zeros(len(lists), np.int64), np.zeros(len(lists), np.int64)
            np.add.at(sums, owner[hit], times[hit] * docs[at[hit]])
            np.add.at(best, owner[hit], times[hit] * top[at[hit]])
            left = np.bincount(owner[~hit], minlength=len(lists))
            ends = pa.array(np.concatenate(([0], np.cumsum(left))).astype(np.int32))
            yield {f: batch.column(f) for f in ("row", *_FIELDS)} | {"sums": sums, "best": best, "pairs": pa.ListArray.from_arrays(ends, pa.array(pairs[~hit])), "times": pa.ListArray.from_arrays(ends, pa.array(times[~hit].astype(np.int32)))}

    return run


_ROW = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def aligned_tokens(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row.

    ``n_best`` counts the links whose pair is in as many documents as any pair
    of its A id, ``count_sum`` sums those numbers over the links.  A null or
    empty text, and one whose tokens do not spell it (a U+2581 in it), has no
    tokens: zeros and an empty digest.  Every row counts as a document, also
    where ids repeat; null ids stay null.  Other columns are ignored.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id())
    held = keep(mapped(plain, _documents(path_a, path_b), f"{_ROW}, pairs array<int>, times array<int>"))
    width = pair(path_a, path_b).width
    counts = keep(mapped(held.df.select("pairs"), _counted, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    by_a = counts.df.withColumn("a", F.expr(f"pair div {width}"))
    highest = by_a.groupBy("a").agg(F.max("n").alias("highest"))  # a row for each id of A's vocabulary at most
    size = F.floor(F.log2("n") * 16).cast("int")
    marked = keep(by_a.join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("top"), size.alias("size")))
    counts.drop()
    least, room = 1 << 30, COMMON
    for r in sorted(marked.df.groupBy("size").count().collect(), reverse=True):  # a row for each sixteenth of a power of two
        room -= r["count"]
        if room < 0:
            break
        least = r["size"]
    common = marked.df.filter(F.col("size") >= least).select("pair", "n", "top").toPandas().sort_values("pair")
    sent = docs.sparkSession.sparkContext.broadcast((common["pair"].to_numpy(), common["n"].to_numpy(), common["top"].to_numpy().astype(np.int64)))
    rest = keep(mapped(held.df, _common(sent), f"{_ROW}, sums long, best long, pairs array<int>, times array<int>"))
    held.drop()
    others = rest.df.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("k"))
    seen = others.join(marked.df.filter(F.col("size") < least).hint("merge"), "pair")
    more = seen.groupBy("row").agg(F.sum(F.col("k") * F.col("n")).alias("more_sums"), F.sum(F.when(F.col("top"), F.col("k")).otherwise(0)).alias("more_best"))
    joined = rest.df.drop("pairs", "times").join(more.hint("merge"), "row", "left")
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("sums") + F.coalesce("more_sums", F.lit(0))).alias("count_sum"), "groups_sha256")


def token_groups(docs: DataFrame, path_a: str, path_b: str, text: str = "text", into: str = "groups") -> DataFrame:
    """``docs`` with ``into``: an array of (begin, end, a, b), the bytes of a space and the text that A's and B's ids both cover.

    Null where the text has no tokens.  Raises ValueError if ``docs`` has a
    column of that name already.
    """
    if into.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {into}; choose another name")

    @F.pandas_udf("array<struct<begin: long, end: long, a: array<int>, b: array<int>>>")
    def groups(texts):
        import pandas as pd

        both, out = pair(path_a, path_b), []
        for got in _aligned_texts(both, [t if isinstance(t, str) else "" for t in texts]):
            row, end = [], 0
            for c in got or ():
                for group in c.digest.split(";"):
                    a, b = ([int(i) for i in side.split(",")] for side in group.split("|"))
                    begin, end = end, end + int(both.size_a[a].sum())
                    row.append({"begin": begin, "end": end, "a": a, "b": b})
            out.append(row if got else None)
        return pd.Series(out)

    return docs.withColumn(into, groups(F.col(text)))
