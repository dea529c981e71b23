"""Short benchmark items inside long documents, by size-partitioned MinHash containment.

Items are partitioned by the power of two that holds their number of shingles.
In a partition an item is known by its k least shingle hashes, k being one more
than the shingles that an item of the partition may lack at the threshold.  A
document holding the item to that degree then holds one of the k for sure, so a
lookup of the document's shingles among these minima misses nothing, however
long the document is.  Each hit is verified by the exact share of the item's
shingles found in the whole document.

Items come in blocks of bounded size; each block is sent to the executors and
meets every document in one scan without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import mapped, texts_of
from .shingles import WIDTH, _combine, gram_sets, word_chunks
from .store import keep

#: An item is in a document if 100 * shared >= PERCENT * the item's shingles.
PERCENT = 80
#: Shingles of one block of items (8 bytes each).
BLOCK_SHINGLES = 2_000_000
#: Texts that a task holds as Python strings at a time.
SLICE = 256


def _item_sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(item_id, width, n, shingles): items of fewer than five words are one run of as many words."""
    for frame in frames:
        rows = []
        texts = [t if isinstance(t, str) else None for t in frame["text"]]
        counts = [n for _, words, at in word_chunks(texts) for n in np.diff(at).tolist()]
        for item, n, sets in zip(frame["item_id"].tolist(), counts, gram_sets(texts, list(range(1, WIDTH + 1))), strict=True):
            if n:
                s = sets[min(n, WIDTH)]
                rows.append((item, min(n, WIDTH), len(s), s.tobytes()))
        yield pd.DataFrame(rows, columns=["item_id", "width", "n", "shingles"])


def _signature(s: np.ndarray) -> np.ndarray:
    top = (1 << len(s).bit_length()) - 1  # the largest size of the item's partition
    return s[: top * (100 - PERCENT) // 100 + 1]


class Items:
    """One block of items, by width: their minima for lookup, and their sets."""

    def __init__(self, rows: list):
        self.ids = [r["item_id"] for r in rows]
        self.sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        self.by_width = {}
        for width in sorted({r["width"] for r in rows}):
            which = [i for i, r in enumerate(rows) if r["width"] == width]
            sigs = [_signature(self.sets[i]) for i in which]
            value, owner = np.concatenate(sigs), np.repeat(which, [len(s) for s in sigs])
            order = np.argsort(value, kind="stable")
            value, owner = value[order], owner[order]
            bits = max(16, int(len(value) * 16).bit_length())
            seen = np.zeros(1 << bits, bool)
            seen[value & np.uint64((1 << bits) - 1)] = True
            self.by_width[width] = value, owner, seen, np.uint64((1 << bits) - 1)

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
        """(text's place, item's place, shared shingles) of all that reach the threshold."""
        for first, words, at in word_chunks(texts):
            for width, (value, owner, seen, mask) in self.by_width.items():
                grams = _combine(words, width)
                if not len(grams):
                    continue
                doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(grams)]
                hit = np.flatnonzero(seen[grams & mask])
                hit = hit[doc[hit] == np.searchsorted(at, hit + width - 1, side="right") - 1]  # not over a text's end
                lo, hi = np.searchsorted(value, grams[hit], "left"), np.searchsorted(value, grams[hit], "right")
                n = hi - lo
                pairs = np.unique(np.stack((np.repeat(doc[hit], n), owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]), axis=1), axis=0) if n.sum() else np.zeros((0, 2), np.int64)
                last, own = -1, None
                for d, i in pairs.tolist():
                    if d != last:
                        last, own = d, np.unique(grams[at[d] : max(at[d], at[d + 1] - width + 1)])
                    need = self.sets[i]
                    spot = np.minimum(np.searchsorted(own, need), len(own) - 1)
                    shared = int((own[spot] == need).sum())
                    if 100 * shared >= PERCENT * len(need):
                        yield first + d, i, shared


def _search(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        items = sent.value
        for batch in batches:
            # a few texts at a time are Python strings, not a whole batch
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = part.column("doc_id").to_pylist()
                rows = [(items.ids[i], ids[d], shared, len(items.sets[i])) for d, i, shared in items.find(texts_of(part))]
                if rows:
                    yield dict(zip(("item_id", "doc_id", "n_shared", "n_item"), zip(*rows, strict=True), strict=True))

    return run


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, doc_id, n_shared, n_item): each document with each item it contains.

    Items without words are in no document; an item of fewer than five words is
    its whole run of words.  Null ids and null texts on either side match
    nothing; rows that repeat count once for each pair of ids.
    """
    spark = docs.sparkSession
    kept = keep(items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("item_id is not null")
                .mapInPandas(_item_sets, "item_id long, width int, n int, shingles binary"))
    total = kept.df.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_SHINGLES))
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    schema = "item_id long, doc_id long, n_shared long, n_item long"
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        rows = kept.df.filter(F.expr(f"pmod(xxhash64(item_id), {blocks}) = {b}")).distinct().collect()
        if rows:
            out = out.union(mapped(plain, _search(spark.sparkContext.broadcast(Items(rows))), schema))
    kept.drop()
    return out.groupBy("item_id", "doc_id", "n_item").agg(F.max("n_shared").alias("n_shared")).select("item_id", "doc_id", "n_shared", "n_item")


def without_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item; columns as they were."""
    found = contained_items(docs, items, doc_id, text).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(found, docs[doc_id].cast("long") == found["_leak"], "left_anti")
