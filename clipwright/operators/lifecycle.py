"""The life of an event within a recording: first seen, repeated, followed up, assisted.

Events are rows (source_idx, target, ms, ord, action, subject, key, …) with
``name``, the key's third part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import FEW, Names, alike_pairs, followup_subject, noisy_names, noisy_without_ratio, stable_subject
from ..functions.text import is_assist_only
from ..sources.tables import written

CLOSE_MS = 5000
#: Rows of a source and target that one task may fold.
TOGETHER = 200_000
ASSIST_MS, ASSIST_STEP_MS = 1200, 500
SELF_FOLLOWUP = "paddle-followup-self-elimination-skipped-after-knock"
FOLLOWUP = "paddle-followup-elimination-skipped"
ASSISTED = "paddle-own-kill-assist-skipped"
NONE_FOUND = "paddle-no-target-text-found"


def with_names(events: DataFrame) -> DataFrame:
    """``name`` (the key's third part, else the subject) and ``actor``, what a follow-up compares."""
    part = F.split("key", ":", 3)
    rows = events.withColumn("name", F.coalesce(F.get(part, F.lit(2)), F.col("subject")))
    return rows.withColumn("actor", followup_subject(F.col("target"), F.col("name"), F.col("subject"), F.col("language")))


def same_pairs(events: DataFrame) -> DataFrame:
    """(source_idx, target, action, a, b, how): distinct keys of a source that name one player.

    'stable' names are alike at any distance; 'noisy' ones were also seen
    within five seconds of each other.  Equal keys are one row beforehand, so
    a pair stands for all pairs of their sightings; stable pairs come from what
    alike names cannot lack, not from all pairs of a recording's players.
    """
    by = ["source_idx", "target", "action"]
    # tables, or each of some thirty uses would carry the plan of the events
    sightings = written(events.select(*by, "key", "name", "ms").distinct())
    held = written(sightings.select(*by, "key", "name").distinct())
    pairs = written(_alike_by_target(held, by).select(*by, F.col("a").alias("na"), F.col("b").alias("nb"), "stable"))
    x, y = held.withColumnsRenamed({"key": "a", "name": "na"}), held.withColumnsRenamed({"key": "b", "name": "nb"})
    named = pairs.filter("stable").drop("stable").unionByName(held.filter("name <> ''").select(*by, F.col("name").alias("na"), F.col("name").alias("nb")).distinct())
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    stable = named.join(x.hint("merge"), [*by, "na"]).join(y.hint("merge"), [*by, "nb"]).filter("a <> b").select(*by, *ends, F.lit("stable").alias("how"))
    seen = sightings.withColumn("slot", F.expr(f"ms div {CLOSE_MS}"))
    x = seen.withColumnsRenamed({"key": "a", "name": "na", "ms": "ma"}).withColumn("slot", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)))
    y = seen.withColumnsRenamed({"key": "b", "name": "nb", "ms": "mb"})
    near = pairs.filter("not stable").join(x.hint("merge"), [*by, "na"]).join(y.hint("merge"), [*by, "nb", "slot"]).filter((F.col("a") != F.col("b")) & (F.abs(F.col("ma") - F.col("mb")) <= CLOSE_MS))
    noisy = near.select(*by, *ends, F.lit("noisy").alias("how"))
    return stable.unionByName(noisy).groupBy(*by, "a", "b").agg(F.max("how").alias("how"))


def _alike_by_target(names: DataFrame, by: list[str]) -> DataFrame:
    """``alike_pairs`` under the rules of each row's own target."""
    deaths = alike_pairs(names.filter("target = 'self-death'"), by, "self-death")
    return deaths.unionByName(alike_pairs(names.filter("target <> 'self-death'"), by, "own-kill"))


def name_groups(events: DataFrame) -> DataFrame:
    """(source_idx, target, name, part): which names of a source can have a say in each other's decisions, by the least of them.

    Names and actors are linked if the rules hold them for one player at any
    distance, and so are the name and the actor of an event and the names of
    one key.  Sources with few names compare them all at once; of the others
    what meets in a task is the pairs of linked names, found by what alike
    names cannot lack, and not the events.  Names without a link may be absent.
    """
    by, kind = ["source_idx", "target"], events.schema["source_idx"].dataType.simpleString()
    shape = f"source_idx {kind}, target string, name string, part string"
    shown = events.select(*by, "key", "name", "actor").distinct()
    sizes = shown.groupBy(*by).agg(F.count("*").alias("n"))
    few = shown.join(sizes.filter(F.col("n").between(2, FEW)).drop("n"), by).groupBy(*by).agg(F.collect_list(F.struct("key", "name", "actor")).alias("shown"))
    groups = few.union(shown.join(sizes.filter("n = 1").drop("n"), by).filter("name <> actor").select(*by, F.array(F.struct("key", "name", "actor")).alias("shown"))).mapInPandas(_compared, shape)
    many = sizes.filter(F.col("n") > FEW).select(*by)
    if many.isEmpty():
        return groups
    rest = shown.join(many, by, "left_semi")
    every = rest.select(*by, F.explode(F.array("name", "actor")).alias("name")).distinct()
    alike = _alike_by_target(every, by).select(*by, "a", "b")
    own = rest.filter("name <> actor").select(*by, F.col("name").alias("a"), F.col("actor").alias("b"))
    first = rest.groupBy(*by, "key").agg(F.min("name").alias("a"), F.max("name").alias("most")).filter("a <> most").drop("most")
    links = alike.union(own).union(first.join(rest, [*by, "key"]).filter("a <> name").select(*by, "a", F.col("name").alias("b"))).distinct()
    return groups.union(links.groupBy(*by).applyInPandas(_joined_names, shape))


class _Joined:
    """Names that are one by a chain of links, known by the least of them."""

    def __init__(self):
        self.above: dict[str, str] = {}

    def root(self, x: str) -> str:
        while (up := self.above.setdefault(x, x)) != x:
            self.above[x] = self.above.setdefault(up, up)
            x = up
        return x

    def link(self, a: str, b: str) -> None:
        x, y = self.root(a), self.root(b)
        self.above[max(x, y)] = min(x, y)


def _joined_names(links: pd.DataFrame) -> pd.DataFrame:
    made = _Joined()
    for a, b in zip(links["a"], links["b"], strict=True):
        made.link(a, b)
    names = sorted(made.above)
    return pd.DataFrame({"source_idx": links["source_idx"].iloc[0], "target": links["target"].iloc[0], "name": names, "part": [made.root(n) for n in names]})


def _compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The groups of up to ``FEW`` (key, name, actor) of a source, each two names compared."""
    for frame in frames:
        out = []
        for source, target, shown in zip(frame["source_idx"], frame["target"], frame["shown"], strict=True):
            made, of_key = _Joined(), {}
            for s in shown:
                made.link(s["name"], s["actor"])
                made.link(s["name"], of_key.setdefault(s["key"], s["name"]))
            names = sorted(made.above)
            for i, a in enumerate(names):
                for b in names[:i]:
                    if made.root(a) != made.root(b) and noisy_names(a, b, target):
                        made.link(a, b)
            out += [(source, target, n, made.root(n)) for n in names]
        yield pd.DataFrame(out, columns=["source_idx", "target", "name", "part"])


def _assist_grid(at: Column, event: Column) -> Column:
    return (at >= event) & (at <= event + ASSIST_MS) & ((at - event) % ASSIST_STEP_MS == 0)


def with_assists(events: DataFrame, assist_frames: DataFrame) -> DataFrame:
    """``assisted``: an own kill that an assist-only frame shows on the half-second grid up to 1.2 s later.

    ``assist_frames`` (source_idx, ms, text, language, and the events read with
    assists allowed as rows action, key, name).  Equal keys decide first;
    likeness of names is asked only for the rest.
    """
    kills = events.filter("target = 'own-kill'").select("source_idx", "ms", "ord", "action", "key", "name")
    shown = assist_frames.filter(is_assist_only(F.col("text"), F.col("language"))).select("source_idx", F.col("ms").alias("at"), "action", F.col("key").alias("akey"), F.col("name").alias("aname"))
    slot = F.expr(f"ms div {ASSIST_MS}")
    near = (kills.withColumn("slot", F.explode(F.array(slot, slot + 1))).join(shown.withColumn("slot", F.expr(f"at div {ASSIST_MS}")), ["source_idx", "action", "slot"])
            .filter(_assist_grid(F.col("at"), F.col("ms"))))
    other = F.col("key") != F.col("akey")
    alike = (F.col("key") == F.col("akey")) | stable_subject(F.when(other, F.col("aname")), F.when(other, F.col("name")))
    hit = near.filter(alike).select("source_idx", "ms", "ord").distinct().withColumn("assisted", F.lit(True))
    return events.join(hit, ["source_idx", "ms", "ord"], "left").withColumn("assisted", F.coalesce("assisted", F.lit(False)) & (F.col("target") == "own-kill"))


def followups(events: DataFrame) -> DataFrame:
    """Eliminations that follow a knock: ``method`` says by which rule.

    A death after any earlier knock of the player; a kill after a knock of the
    same player within five seconds.  Over already distinct events.
    """
    earlier = Window.partitionBy("source_idx", "target").orderBy("ms").rangeBetween(Window.unboundedPreceding, 0)
    # a table, as deaths, kills and knocks each read it
    rows = written(events.withColumn("_knock", F.min(F.when(F.col("action") == "knock", F.col("ms"))).over(earlier)))
    deaths = rows.filter((F.col("target") == "self-death") & (F.col("action") == "eliminate") & F.col("_knock").isNotNull()).withColumn("method", F.lit(SELF_FOLLOWUP))
    slot = F.expr(f"ms div {CLOSE_MS}")
    kills = rows.filter("target = 'own-kill' and action = 'eliminate'").withColumn("slot", slot)
    knocks = (rows.filter("target = 'own-kill' and action = 'knock'").select("source_idx", F.col("ms").alias("kms"), F.col("actor").alias("kactor"), F.explode(F.array(slot, slot + 1)).alias("slot")))
    near = kills.join(knocks, ["source_idx", "slot"]).filter((F.col("kms") <= F.col("ms")) & (F.col("ms") - F.col("kms") <= CLOSE_MS))
    same = F.coalesce(noisy_without_ratio(F.col("actor"), F.col("kactor"), F.col("target")) | (F.col("actor") == F.col("kactor")), F.lit(False))
    alike = same | stable_subject(F.when(~same, F.col("actor")), F.when(~same, F.col("kactor")))
    hit = near.filter(alike).select(*rows.columns).dropDuplicates(["source_idx", "target", "ms", "ord"])
    return deaths.unionByName(hit.withColumn("method", F.lit(FOLLOWUP))).drop("_knock")


class _Seen:
    """What one (source, target) has shown so far."""

    def __init__(self, target: str):
        self.target = target
        self.keys: set[tuple[str, str]] = set()
        self.by_action: dict[str, Names] = {}
        self.knocks = Names()

    def repeats(self, action: str, key: str, name: str, ms: int) -> bool:
        if (action, key) in self.keys:
            return True
        shown = self.by_action.get(action)
        return shown is not None and (shown.any_stable(name) or shown.any_ruled(name, self.target, shown.near(ms, CLOSE_MS, CLOSE_MS)))

    def follows(self, action: str, actor: str, ms: int) -> str | None:
        if action != "eliminate":
            return None
        if self.target == "self-death" and self.knocks.names:
            return SELF_FOLLOWUP
        near = self.knocks.near(ms, CLOSE_MS) if self.target == "own-kill" else self.knocks.near(ms)
        return FOLLOWUP if self.knocks.any_stable(actor, near) or self.knocks.any_ruled(actor, self.target, near) else None

    def add(self, action: str, key: str, name: str, actor: str, ms: int) -> None:
        self.keys.add((action, key))
        self.by_action.setdefault(action, Names()).add(name, ms)
        if action == "knock":
            self.knocks.add(actor, ms)


_DECISION = "decision string"


def _decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by source, target, part and time; a part may span frames, its memory is the players it has shown."""
    at, seen = None, None
    for frame in frames:
        out = []
        for source, target, part, ms, action, key, name, actor, assisted, knocked in zip(*(frame[c] for c in ("source_idx", "target", "_part", "ms", "action", "key", "name", "actor", "assisted", "_knocked")), strict=True):
            if (source, target, part) != at:
                at, seen = (source, target, part), _Seen(target)
            if seen.repeats(action, key, name, ms):
                out.append("repeat")
                continue
            method = SELF_FOLLOWUP if knocked and action == "eliminate" else seen.follows(action, actor, ms)
            out.append(method or (ASSISTED if assisted else "kept"))
            seen.add(action, key, name, actor, ms)
        yield frame.drop(columns=["_part", "_knocked"]).assign(decision=out)


def decided(events: DataFrame) -> DataFrame:
    """Each event with its ``decision``: kept, repeat, or why it is suppressed; suppressed ones count as seen.

    A fold in time order.  All rules compare equal targets only, and names that
    no chain of likeness connects have no say in each other's decisions, so
    each group of linked names of a source and target is folded alone.  What
    reaches over groups is that a death follows any earlier knock: a source's
    first knock is never a repeat, so its time beside the rows says that.  The
    rows are written once, as several steps read them.  Where no source and
    target has more than ``TOGETHER`` rows each is folded whole, to the same
    decisions.
    """
    cols = ["source_idx", "target", "ms", "ord", "action", "subject", "key", "weapon", "method", "event_text", "name", "actor", "assisted"]
    rows = written(events.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if events.schema[c].dataType.typeName() == "string" else F.col(c) for c in cols]))
    by, order = ["source_idx", "target"], F.struct("ms", "ord")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, {_DECISION}"
    if (rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= TOGETHER:
        whole = rows.repartition(*by).sortWithinPartitions(*by, "ms", "ord").select(*cols, F.lit("").alias("_part"), F.lit(False).alias("_knocked"))
        return whole.mapInPandas(_decide, schema)
    knock = rows.filter("target = 'self-death' and action = 'knock'").groupBy(*by).agg(F.min(order).alias("_knock"))
    wide = rows.join(name_groups(rows), [*by, "name"], "left").join(knock, by, "left").withColumn("_part", F.coalesce("part", "name")).withColumn("_knocked", F.coalesce(F.col("_knock") < order, F.lit(False)))
    dealt = wide.select(*cols, "_part", "_knocked").repartition(*by, "_part").sortWithinPartitions(*by, "_part", "ms", "ord")
    return dealt.mapInPandas(_decide, schema)


def first_by_key(events: DataFrame) -> DataFrame:
    """The exact-key form: the first sighting of each key of a source, without Python."""
    order = Window.partitionBy("source_idx", "target", "action", "key").orderBy("ms", "ord")
    return events.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def with_empty_sources(detections: DataFrame, sources: DataFrame, frames: DataFrame) -> DataFrame:
    """Also one row for each source without a detection: no time, and the last label that held text."""
    shown = frames.filter(F.coalesce("text", F.lit("")) != "").groupBy("source_idx").agg(F.max_by(F.struct("method", "text"), F.struct("ms", "text")).alias("l"))
    bare = sources.join(detections.select("source_idx").distinct(), "source_idx", "left_anti").join(shown, "source_idx", "left")
    made = {"method": F.coalesce("l.method", F.lit(NONE_FOUND)), "text": F.coalesce("l.text", F.lit(""))}
    empty = bare.select(*[made.get(c, F.col(c) if c in sources.columns else F.lit(None).cast(detections.schema[c].dataType)).alias(c) for c in detections.columns])
    return detections.unionByName(empty)
