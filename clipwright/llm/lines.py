"""Incremental, reversible line deduplication.

State lies in the shared folder, in tables that an insertion only adds to:

* ``postings``: (k1, k2, doc_id), one row for each document that holds a key;
* ``counts``: (k1, k2, n_docs, max_doc, seen, ins): how many documents of one
  insertion hold a key, the largest of them, and the insertion's number;
* ``filters``: for each shard of the keys its cuckoo filters;
* ``places``: (ins, was, gen): to which filter of a shard, as they were cut
  then, an insertion's new keys went.

An insertion asks the filters of its keys' shards first.  A key that they have
never seen cannot be counted yet, so its row is final until some later row says
``seen``; only possible members meet the exact table (up to ``BROADCAST_KEYS``
of them are sent to it, and it is not shuffled), and only keys with such a row
are ever summed.  Then the new keys go into the shard's last filter, or
into a new one of twice its room when that is full.
Shards double as keys grow; both halves start with copies of the filters, which
may answer "seen" too often and never too seldom.

A deletion takes documents' postings out, recounts the keys they held, writes
both tables anew and removes the fingerprints of keys whose last reference
went, each from the filter that its first insertion put it in: a fingerprint in
another filter may be another key's, and taking that would let the key be
forgotten.  Filters only ever screen: every answer is from exact counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Kept, keep

STRIP = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5
SLOTS = 4
#: A filter is built for at least so many keys and with this share of its slots used.
LEAST_KEYS, FILL = 64, 0.85
KEYS_PER_SHARD = 100_000
#: Parts that a whole table is inserted in, each screened by the filters of those before it.
INSERTIONS = 2
#: Repeated keys (24 bytes each) up to this number are broadcast to the postings; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
_KICKS = 500
_LOWER = {c: c + 32 for c in range(65, 91)}


def line_key(line: str) -> str:
    return line.strip(STRIP).translate(_LOWER)


def _digest(key: str) -> tuple[int, int]:
    raw = hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def long_keys(text: str | None, least: int) -> list[str]:
    """The key of each line, '' for those too short to count."""
    out = []
    for line in (text or "").split("\n"):
        if len(line) < least:
            out.append("")
            continue
        bare = line.strip(STRIP)
        out.append(bare.translate(_LOWER) if len(bare) >= least else "")
    return out


class CuckooFilter:
    """Cuckoo filter of 16-bit fingerprints with partial-key relocation, over arrays of 64-bit hashes."""

    def __init__(self, keys: int, table: np.ndarray | None = None):
        if table is None:
            need = max(keys, LEAST_KEYS) / (SLOTS * FILL)
            table = np.zeros((1 << max(1, int(np.ceil(np.log2(need)))), SLOTS), np.uint16)
        self.table = table

    @classmethod
    def of_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = hashes.astype(np.int64).view(np.uint64)
        prints = ((h >> np.uint64(48)).astype(np.uint16)) | np.uint16(1)
        mask = np.uint64(len(self.table) - 1)
        first = (h & mask).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, place, prints):
        jump = (prints.astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(7)
        return ((place.astype(np.uint64) ^ jump) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, one, two = self._places(hashes)
        return ((self.table[one] == prints[:, None]) | (self.table[two] == prints[:, None])).any(axis=1)

    def _fill(self, prints: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Put fingerprints in free slots of their places; which found one."""
        done = np.zeros(len(prints), bool)
        for slot in range(SLOTS):
            open_ = np.flatnonzero(~done)
            open_ = open_[self.table[place[open_], slot] == 0]
            _, first = np.unique(place[open_], return_index=True)
            take = open_[first]
            self.table[place[take], slot] = prints[take]
            done[take] = True
        return done

    def insert(self, hashes: np.ndarray) -> bool:
        """Add distinct keys; False if the filter is too full and must be rebuilt larger."""
        prints, one, two = self._places(hashes)
        done = self._fill(prints, one)
        prints, two = prints[~done], two[~done]
        done = self._fill(prints, two)
        prints, place = prints[~done], two[~done]
        rng = np.random.default_rng(len(hashes))
        for _ in range(_KICKS):
            if not len(prints):
                return True
            _, first = np.unique(place, return_index=True)
            waits = np.ones(len(prints), bool)
            waits[first] = False
            slot = rng.integers(0, SLOTS, len(first))
            out = self.table[place[first], slot].copy()
            self.table[place[first], slot] = prints[first]
            moved = self._other(place[first], out)
            prints, place = np.concatenate((prints[waits], out)), np.concatenate((place[waits], moved))
            live = prints != 0
            prints, place = prints[live], place[live]
            done = self._fill(prints, place)
            prints, place = prints[~done], place[~done]
        return not len(prints)

    def remove(self, hashes: np.ndarray) -> np.ndarray:
        """Take out keys that were inserted, one fingerprint each; which were found."""
        found = np.zeros(len(hashes), bool)
        for i, (fp, one, two) in enumerate(zip(*self._places(hashes), strict=True)):
            for place in (one, two):
                at = np.flatnonzero(self.table[place] == fp)
                if len(at):
                    self.table[place, at[0]] = 0
                    found[i] = True
                    break
        return found

    def room(self) -> int:
        """Keys that it can take before it holds the share ``FILL`` of its slots."""
        return int(self.table.size * FILL) - int(np.count_nonzero(self.table))

    def copy(self) -> CuckooFilter:
        return CuckooFilter(0, self.table.copy())


def filter_of(hashes: np.ndarray, room: int = 0) -> CuckooFilter:
    size = max(len(hashes), room)
    while True:
        made = CuckooFilter(size)
        if made.insert(hashes):
            return made
        size = 2 * max(size, LEAST_KEYS)


def _postings(least: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            docs, ones, twos = [], [], []
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                keys = {k for k in long_keys(text, least) if k}
                for one, two in map(_digest, keys):
                    docs.append(doc)
                    ones.append(one)
                    twos.append(two)
            yield pd.DataFrame({"doc_id": np.array(docs, np.int64), "k1": np.array(ones, np.int64), "k2": np.array(twos, np.int64)})

    return run


class LineIndex:
    """Exact line references of a set of documents, kept up under insertions and deletions.

    Documents are known by their integer id; a row with a null id is passed
    over, and rows of one insertion that repeat an id count as one document
    holding the lines of all.  A document that is held must be deleted before
    it is inserted again.  Null and empty texts hold no key.
    """

    def __init__(self, spark: SparkSession, min_chars: int = MIN_CHARS):
        self.spark, self.min_chars, self.shards, self.keys = spark, min_chars, 1, 0
        self.postings: list[Kept] = []
        self.counts: list[Kept] = []
        self.filters: Kept | None = None
        self.places: list[Kept] = []
        #: Shards at each insertion.
        self.cut: list[int] = []

    def insert(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> None:
        plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
        new = keep(plain.mapInPandas(_postings(self.min_chars), "doc_id long, k1 long, k2 long").select("k1", "k2", "doc_id").distinct())
        counted = keep(_counted(new.df).withColumn("seen", F.lit(False)).withColumn("ins", F.lit(len(self.cut))))
        total = counted.df.count()
        self._spread(total)
        fresh = counted.df
        if self.filters:
            asked = keep(self._sharded(counted.df).groupBy("shard").cogroup(self.filters.df.groupBy("shard")).applyInPandas(_ask, _COUNTS))
            counted.drop()
            counted = asked
            # of possible members those that the exact table lacks are new after all
            maybe, exact = asked.df.filter("seen"), _union(self.counts).select("k1", "k2")
            if maybe.count() <= BROADCAST_KEYS:
                exact = F.broadcast(exact.join(F.broadcast(maybe.select("k1", "k2")), ["k1", "k2"], "left_semi").distinct())
            fresh = asked.df.filter("not seen").union(maybe.join(exact, ["k1", "k2"], "left_anti"))
        self._learn(fresh)
        self.keys += total
        self.postings.append(new)
        self.counts.append(counted)

    def delete(self, ids: DataFrame, doc_id: str = "doc_id") -> None:
        """Take whole documents out; ids that are not held change nothing."""
        if not self.postings:
            return
        out, held = ids.select(F.col(doc_id).cast("long").alias("doc_id")).distinct(), _union(self.postings)
        lost = keep(held.join(out, "doc_id", "left_semi").select("k1", "k2").distinct())
        postings = keep(held.join(out, "doc_id", "left_anti").select("k1", "k2", "doc_id"))
        recount = _counted(postings.df.join(lost.df, ["k1", "k2"], "left_semi"))
        first = keep(_union(self.counts).join(lost.df, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min("ins").alias("ins")))
        recount = recount.join(first.df, ["k1", "k2"])
        counts = keep(self.totals().join(lost.df, ["k1", "k2"], "left_anti").unionByName(recount).select("k1", "k2", "n_docs", "max_doc", F.lit(False).alias("seen"), "ins"))
        shards = F.element_at(F.array(*map(F.lit, self.cut)), F.col("ins") + 1)
        gone = first.df.join(counts.df, ["k1", "k2"], "left_anti").withColumn("was", F.pmod("k2", shards).cast("int")).join(_union(self.places), ["ins", "was"])
        filters = keep(self.filters.df.groupBy("shard").cogroup(self._sharded(gone.select("k1", "k2", "gen")).groupBy("shard")).applyInPandas(_forget, _FILTERS))
        for t in (*self.postings, *self.counts, self.filters, lost, first):
            t.drop()
        self.postings, self.counts, self.filters = [postings], [counts], filters

    def _sharded(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("shard", F.expr(f"cast(pmod(k2, {self.shards}) as int)"))

    def _spread(self, more: int) -> None:
        """Double the shards until each is to hold ``KEYS_PER_SHARD`` keys at most; key k2 of shard s goes to s or to s and the old number of shards."""
        old = self.shards
        while self.shards * KEYS_PER_SHARD < self.keys + more:
            self.shards *= 2
        if self.filters and old < self.shards:
            grown = keep(self.filters.df.withColumn("shard", F.explode(F.expr(f"transform(sequence(0, {self.shards // old - 1}), i -> shard + i * {old})"))))
            self.filters.drop()
            self.filters = grown

    def _learn(self, keys: DataFrame) -> None:
        new = self._sharded(keys.select("k1", "k2")).groupBy("shard")
        if self.filters:
            made = keep(self.filters.df.groupBy("shard").cogroup(new).applyInPandas(_extend, _FILTERS))
            self.filters.drop()
        else:
            made = keep(new.applyInPandas(lambda rows: _extend(rows.iloc[:0], rows), _FILTERS))
        self.filters = made
        self.places.append(keep(made.df.groupBy(F.lit(len(self.cut)).alias("ins"), F.col("shard").alias("was")).agg(F.max("gen").alias("gen"))))
        self.cut.append(self.shards)

    def totals(self) -> DataFrame:
        """(k1, k2, n_docs, max_doc, ins): the exact count of each key and its first insertion; only keys that some insertion met again are summed."""
        rows = _union(self.counts)
        if len(self.counts) < 2:
            return rows.drop("seen")
        again = rows.filter("seen").select("k1", "k2").distinct()
        summed = rows.join(again, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"), F.min("ins").alias("ins"))
        return rows.join(again, ["k1", "k2"], "left_anti").drop("seen").union(summed)

    def repeated(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """(k1, k2, max_doc) of keys that at least so many documents hold."""
        return self.totals().filter(F.col("n_docs") >= min_docs).select("k1", "k2", "max_doc")

    def drops(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """(doc_id, drop): for each document the keys whose lines it loses."""
        many = keep(self.repeated(min_docs))
        keys = F.broadcast(many.df) if many.df.count() <= BROADCAST_KEYS else many.df
        hits = _union(self.postings).join(keys, ["k1", "k2"]).filter("doc_id <> max_doc")
        lost = keep(hits.groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("drop")))
        many.drop()
        return lost.df

    def close(self) -> None:
        for t in (*self.postings, *self.counts, *self.places, self.filters):
            if t:
                t.drop()
        self.postings, self.counts, self.places, self.filters = [], [], [], None


_COUNTS = "k1 long, k2 long, n_docs long, max_doc long, seen boolean, ins int"
_FILTERS = "shard int, gen int, cuckoo binary"


def _union(tables: list[Kept]) -> DataFrame:
    out = tables[0].df
    for t in tables[1:]:
        out = out.union(t.df)
    return out


def _counted(rows: DataFrame) -> DataFrame:
    """Of distinct (k1, k2, doc_id)."""
    return rows.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))


def _loaded(filters: pd.DataFrame) -> list[CuckooFilter]:
    return [CuckooFilter.of_bytes(raw) for raw in filters.sort_values("gen")["cuckoo"]] if len(filters) else []


def _ask(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    keys = rows["k1"].to_numpy(np.int64)
    seen = np.zeros(len(rows), bool)
    for held in _loaded(filters):
        seen |= held.contains(keys)
    return rows.assign(seen=seen)[["k1", "k2", "n_docs", "max_doc", "seen", "ins"]]


def _extend(filters: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """The shard's filters with new keys in the last of them, or in one more of twice its room."""
    if not len(rows):
        return filters[["shard", "gen", "cuckoo"]]  # a shard without new keys
    keys, made = rows["k1"].to_numpy(np.int64), _loaded(filters)
    last = made[-1].copy() if made else None
    if last and last.room() >= len(keys) and last.insert(keys):
        made[-1] = last
    else:
        made.append(filter_of(keys, int(2 * last.table.size * FILL) if last else 0))
    return pd.DataFrame({"shard": int(rows["shard"].iloc[0]), "gen": np.arange(len(made)), "cuckoo": [m.to_bytes() for m in made]})


def _forget(filters: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
    """A key's fingerprint goes from the filter ``gen`` that it was put in."""
    made = _loaded(filters)
    for gen, rows in gone.groupby("gen"):
        if not made[gen].remove(rows["k1"].to_numpy(np.int64)).all():
            raise RuntimeError("a held key has no fingerprint")
    return filters.sort_values("gen").assign(cuckoo=[m.to_bytes() for m in made])[["shard", "gen", "cuckoo"]]


_CUT = "n_lines long, n_dropped long, kept_sha256 string, kept_text string"


def _cut(least: int):
    @F.pandas_udf(_CUT)
    def cut(texts: pd.Series, ones: pd.Series, twos: pd.Series) -> pd.DataFrame:
        out = []
        for text, k1, k2 in zip(texts, ones, twos, strict=True):
            rows = (text or "").split("\n")
            stay = rows
            if k1 is not None and len(k1):
                gone = set(zip(map(int, k1), map(int, k2), strict=True))
                stay = [r for r, k in zip(rows, long_keys(text, least), strict=True) if not k or _digest(k) not in gone]
            left = "\n".join(stay)
            out.append((len(rows), len(rows) - len(stay), hashlib.sha256(left.encode("utf-8", "surrogatepass")).hexdigest(), left))
        return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept_sha256", "kept_text"])

    return cut


def _deduped(docs: DataFrame, doc_id: str, text: str, min_chars: int, min_docs: int) -> DataFrame:
    """(k, row, cut): each row of ``docs`` whole, with what its lines come to."""
    index = LineIndex(docs.sparkSession, min_chars)
    for i in range(INSERTIONS):
        index.insert(docs.filter(F.expr(f"pmod(xxhash64(cast(`{doc_id}` as long)), {INSERTIONS}) = {i}")), doc_id, text)
    drops = index.drops(min_docs)
    index.close()
    packed = docs.select(F.col(doc_id).cast("long").alias("k"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # one plan at every size: a small side would be broadcast below some size and the texts shuffled above it
    joined = packed.join(drops.withColumnRenamed("doc_id", "k").hint("merge"), "k", "left")
    return joined.select("k", "row", _cut(min_chars)(F.col("row")[text], F.col("drop.k1"), F.col("drop.k2")).alias("cut"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, kept_text) for each row of ``docs``.

    A key held by ``min_docs`` documents loses its lines everywhere but in the
    largest id that holds it.  A null or empty text is one empty line; a row
    with a null id keeps all its lines.  Rows that repeat an id count as one
    document that holds the lines of all, and each loses the lines it loses.
    Other columns are ignored.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _deduped(plain, "doc_id", "text", min_chars, min_docs).select(F.col("k").alias("doc_id"), "cut.*")


def with_kept_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with repeated lines gone from ``text`` and ``n_chars`` counted anew; columns as they were."""
    done = _deduped(docs, doc_id, text, MIN_CHARS, MIN_DOCS)
    new = {text: F.when(F.col("row")[text].isNotNull(), F.col("cut.kept_text")).alias(text)}
    if n_chars in docs.columns:
        kind = docs.schema[n_chars].dataType
        new[n_chars] = F.when(F.col("cut.n_dropped") > 0, F.length("cut.kept_text").cast(kind)).otherwise(F.col("row")[n_chars]).alias(n_chars)
    return done.select(*[new.get(c, F.col("row")[c].alias(c)) for c in docs.columns])
