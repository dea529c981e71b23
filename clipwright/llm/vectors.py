"""Near-duplicate vectors by random-hyperplane sign hashing.

Vectors with the same label meet in a bucket if their signs against the
hyperplanes of one table agree.  Every meeting is verified by exact cosine in
double precision.  Bits and tables follow from the number of vectors and the
wanted recall at the threshold, by the same formula at every size: a pair at
the threshold angle agrees in one bit with p = 1 - angle/pi, so T tables of k
bits miss it with (1 - p^k)^T.

Equal vectors are one class and hashed once.  Vectors travel in the precision
they come in.  A bucket of up to ``BLOCK`` classes is compared at once by a
matrix product; a larger one is cut into blocks of half that size, and each two
of its blocks meet in one task, so of m classes each travels 2 m / ``BLOCK``
times.  A task gives out counts of links and a star of edges, never the pairs.
A pair that meets in several tables counts in the first of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import keep

COSINE = 0.93
RECALL = 0.9999
#: Vectors of a label that a bucket is to hold on average, were they unrelated.
BUCKET = 48
#: Buckets above this number of classes are cut into blocks, compared block by block.
BLOCK = 2048
SEED = 7


def bits_and_tables(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    bits = max(6, math.ceil(math.log2(max(n, 1) / BUCKET)) if n > BUCKET else 6)
    p = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, bits * tables))


def _signs(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(vectors, tables) bucket codes."""
    on = (unit @ _planes(unit.shape[1], bits, tables) > 0).reshape(len(unit), tables, bits)
    return on @ (1 << np.arange(bits, dtype=np.int64))


def _unit(raw, dims: int) -> np.ndarray:
    """Unit vectors in double precision; scaled by their largest component first, so that no square overflows or vanishes."""
    joined = b"".join(raw)
    x = np.frombuffer(joined, f"<f{len(joined) // (len(raw) * dims)}").reshape(len(raw), dims).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(bits: int, tables: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, part in frame.groupby("dims"):
                for i in range(0, len(part), 2000):
                    p = part.iloc[i : i + 2000]
                    codes = _signs(_unit(p["raw"], int(p["dims"].iloc[0])), bits, tables)
                    row = np.repeat(np.arange(len(p)), tables)
                    yield pd.DataFrame({"label": p["label"].to_numpy()[row], "dims": p["dims"].to_numpy()[row], "tab": np.tile(np.arange(tables), len(p)),
                                        "code": codes.ravel(), "rep": p["rep"].to_numpy()[row], "n": p["n"].to_numpy()[row], "raw": p["raw"].to_numpy()[row]})

    return run


def _compared(bits: int, tables: int, cosine: float):
    """Link counts and star edges of each run of equal keys; rows come sorted by key, the frame may end inside a run."""
    keys = ["label", "dims", "tab", "code", "x", "y"]

    def one(part: pd.DataFrame) -> pd.DataFrame | None:
        part = part.drop_duplicates("rep")
        if len(part) < 2:
            return None
        unit, rep, n = _unit(part["raw"], int(part["dims"].iloc[0])), part["rep"].to_numpy(), part["n"].to_numpy()
        own, x, y = part["own"].to_numpy(), int(part["x"].iloc[0]), int(part["y"].iloc[0])
        a, b = np.nonzero(np.triu(unit @ unit.T >= cosine, 1))
        if x != y:  # two blocks: only across
            across = own[a] != own[b]
            a, b = a[across], b[across]
        if not len(a):
            return None
        tab = int(part["tab"].iloc[0])
        if tab:
            used = np.unique(np.concatenate((a, b)))
            codes = np.zeros((len(unit), tab), np.int64)
            codes[used] = _signs(unit[used], bits, tables)[:, :tab]
            earlier = np.zeros(len(a), bool)
            for t in range(tab):
                earlier |= codes[a, t] == codes[b, t]
            a, b = a[~earlier], b[~earlier]
            if not len(a):
                return None
        links = np.bincount(a, n[b], len(unit)) + np.bincount(b, n[a], len(unit))
        low = np.arange(len(unit))
        order = np.argsort(rep, kind="stable")
        rank = np.empty(len(unit), np.int64)
        rank[order] = np.arange(len(unit))
        low = rank.copy()
        while True:  # least rank within the component
            new = low.copy()
            np.minimum.at(new, a, low[b])
            np.minimum.at(new, b, low[a])
            new = new[order[new]] if len(new) else new
            if (new == low).all():
                break
            low = new
        hit = np.flatnonzero(links > 0)
        return pd.DataFrame({"rep": rep[hit], "links": links[hit].astype(np.int64), "low": rep[order[low[hit]]]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in frames:
            if held is not None:
                frame = pd.concat((held, frame), ignore_index=True)
            if not len(frame):
                continue
            k = frame[keys].to_numpy(np.int64)
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            ends = [0, *cuts.tolist()]
            found = [one(frame.iloc[s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True) if e - s > 1]
            if found := [f for f in found if f is not None]:
                yield pd.concat(found, ignore_index=True)
            held = frame.iloc[ends[-1] :]
        if held is not None and (f := one(held)) is not None:
            yield f

    return run


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Only rows of one and the same label are compared; a label that is no integer
    is known by its 64-bit hash.  A null id or label, a null or empty vector, a
    null or non-finite component or a zero vector links with nothing and is
    counted by none; vectors of different length never link.  Rows that repeat
    an id are vectors of their own.  Other columns are ignored.
    """
    whole = vectors.schema[label].dataType.typeName() in ("byte", "short", "integer", "long")
    kind = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    plain = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), (F.col(label).cast("long") if whole else F.when(F.col(label).isNotNull(), F.xxhash64(label))).alias("label"), F.col(embedding).cast(kind).alias("e"))
    finite = "vec_id is not null and e is not null and size(e) > 0 and label is not null and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(e, x -> x <> 0)"
    good = plain.withColumn("ok", F.coalesce(F.expr(finite), F.lit(False)))
    # -0.0 and 0.0 are one value
    good = good.withColumn("key", F.when(F.col("ok"), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.expr("transform(e, x -> cast(if(x = 0, abs(x), x) as string))")), 256)))
    classes = keep(good.filter("ok").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("e").alias("e")))
    most = classes.df.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = bits_and_tables(most, cosine)
    packed = classes.df.mapInPandas(_pack(np.float32 if kind == "array<float>" else np.float64), "rep long, n long, label long, dims int, raw binary")
    rows = packed.mapInPandas(_hashed(bits, tables), "label long, dims int, tab int, code long, rep long, n long, raw binary")
    bucket = ["label", "dims", "tab", "code"]
    codes = rows.select(*bucket, "rep")
    large = keep(codes.groupBy(*bucket).agg(F.count("*").alias("m")).filter(F.col("m") > BLOCK).withColumn("blocks", F.ceil(F.col("m") / (BLOCK // 2)).cast("int")))
    dealt = rows.join(large.df.drop("m"), bucket, "left").withColumn("own", F.expr("cast(if(blocks is null, 0, pmod(xxhash64(rep), blocks)) as int)"))
    others = "transform(sequence(0, coalesce(blocks, 1) - 1), j -> struct(least(own, j) as x, greatest(own, j) as y))"
    dealt = dealt.withColumn("p", F.explode(F.expr(others))).select(*bucket, F.col("p.x").alias("x"), F.col("p.y").alias("y"), "own", "rep", "n", "raw")
    keys = [*bucket, "x", "y"]
    found = keep(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_compared(bits, tables, cosine), "rep long, links long, low long"))
    group = components(found.df, "rep", "low")
    counted = found.df.groupBy("rep").agg(F.sum("links").alias("links"))
    answer = keep(classes.df.select("key", "rep", "n").join(counted, "rep", "left").join(group.df, F.col("rep") == F.col("node"), "left")
                  .select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    for t in (classes, large, found, group):
        t.drop()
    linked = good.filter("ok").select("vec_id", "key").join(answer.df, "key").select("vec_id", "n_links", "component_id")
    alone = good.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _pack(kind):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"rep": f["rep"], "n": f["n"], "label": f["label"], "dims": [len(e) for e in f["e"]], "raw": [np.asarray(e, kind).tobytes() for e in f["e"]]})

    return run
