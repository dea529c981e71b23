"""Events in on-screen text: arrays of structs (target, method, action, subject, key, text, weapon)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _action, _assist_only, _like, _self_class, _subject, _subject_key, _weapon, by_language, has_assist, has_own_candidate, is_assist_only, is_delayed, let, normalize_text, text_rows
from .vocabulary import OWN_METHOD, STRICT_METHOD, Vocabulary

_FIELDS = "target string, method string, action string, subject string, key string, text string, weapon string"
#: Signs around a match and between its groups; both are white space, which normalised texts are without.
_MATCH, _GROUP = "\x1d", "\x1e"
EVENTS = f"array<struct<{_FIELDS.replace(' string', ':string')}>>"


def _event(target: str, method: Column, action: Column, subject: Column, key: Column, text: Column, weapon: Column) -> Column:
    return F.struct(F.lit(target).alias("target"), method.alias("method"), action.alias("action"), subject.alias("subject"), key.alias("key"), text.alias("text"), weapon.alias("weapon"))


def _weapon_after(prefix: Column, v: Vocabulary) -> Column:
    return _weapon(F.regexp_extract(prefix, v.flags + v.weapon, 1), v)


def _own(t: Column, v: Vocabulary, allow_assist: bool) -> Column:
    pattern = F.lit(v.flags + v.own)
    names = ("raw", "prefix", "verb", "victim", "arm", "probe")

    def matches(s: Column) -> Column:
        # one pass of the pattern: each match is replaced by its groups between signs that a normalised text cannot hold
        marked = F.regexp_replace(s, pattern, F.lit(_MATCH + _GROUP.join(f"${i}" for i in range(len(names))) + _MATCH))
        found = F.filter(F.split(marked, _MATCH), lambda _, i: i % 2 == 1)
        return F.transform(F.transform(found, lambda m: F.split(m, _GROUP)), lambda g: F.struct(*[g[i].alias(n) for i, n in enumerate(names)]))

    def named(m: Column) -> Column:
        return F.struct(*[m[n].alias(n) for n in names if n != "victim"], _subject(m["victim"], v).alias("victim"))

    def keyed(m: Column) -> Column:
        return F.struct(*[m[n].alias(n) for n in names], _subject_key(m["victim"], v).alias("key"), _action(m["verb"], v).alias("action"), _weapon_after(m["prefix"], v).alias("before"))

    def wanted(m: Column) -> Column:
        keep = (m["key"] != "") & ~m["key"].isin(*v.own_self) & ~_like(m["raw"], v, v.delayed)
        if not allow_assist:
            keep = keep & ~_assist_only(m["raw"], v) & ~_assist_only(F.concat(m["raw"], m["probe"]), v)
        return keep

    def event(m: Column) -> Column:
        weapon = F.when(m["before"] != "", m["before"]).otherwise(_weapon(m["arm"], v))
        return _event("own-kill", F.lit(OWN_METHOD), m["action"], m["victim"], F.concat(F.lit("own-kill:"), m["action"], F.lit(":"), m["key"]), m["raw"], weapon)

    found = let(normalize_text(t), matches)
    return F.transform(F.filter(F.transform(F.transform(found, named), keyed), wanted), event)


def own_kill_events(t: Column, language: Column, allow_assist: bool = False) -> Column:
    """All non-overlapping kills by the player; delayed, assisted and nameless ones and the player's own name are passed over."""
    return F.coalesce(by_language(language, lambda v: _own(t, v, allow_assist)), F.array().cast(EVENTS))


def _self_row(s: Column, v: Vocabulary) -> Column:
    lead = f"{v.flags}(?s)^(.*?)(?:{{}})"
    strict_at, fuzzy_at = lead.format(v.self_strict), lead.format(v.self_fuzzy)
    downed = _event("self-death", F.lit(""), F.lit("zone-downed"), F.lit("zone"), F.lit("self-death:zone"), s, F.lit(""))

    def parts(c: Column) -> Column:
        strict = c["method"] == STRICT_METHOD
        arm = F.when(strict, F.regexp_extract(s, strict_at, 3)).otherwise(F.lit("")) if "(.+?)" in v.self_strict else F.lit("")
        actor = F.when(strict, F.regexp_extract(s, strict_at, 1)).otherwise(F.regexp_extract(s, fuzzy_at, 1))
        verb = F.when(strict, F.regexp_extract(s, strict_at, 2)).otherwise(F.regexp_extract(s, fuzzy_at, 2))
        return F.struct(c["method"].alias("method"), actor.alias("actor"), _action(verb, v).alias("action"), arm.alias("arm"))

    def named(p: Column) -> Column:
        return F.struct(p["method"].alias("method"), p["actor"].alias("actor"), p["action"].alias("action"), p["arm"].alias("arm"), _subject_key(F.right(p["actor"], F.lit(32)), v).alias("key"), _weapon_after(p["actor"], v).alias("before"))

    def death(p: Column) -> Column:
        key = F.concat(F.lit("self-death:"), p["action"], F.lit(":"), F.when(p["key"] != "", p["key"]).otherwise(F.lit("unknown")))
        weapon = F.when(p["before"] != "", p["before"]).otherwise(_weapon(p["arm"], v))
        return _event("self-death", p["method"], p["action"], p["actor"], key, s, weapon)

    def event(c: Column) -> Column:
        zone = F.struct(F.lit("self-death").alias("target"), c["method"].alias("method"), *[downed[n].alias(n) for n in ("action", "subject", "key", "text", "weapon")])
        return F.when(c["zone"], zone).when(c["method"].isNotNull(), let(let(parts(c), named), death))

    return let(F.struct(_self_class(s, v).alias("method"), _like(s, v, v.self_zone).alias("zone")), event)


def self_events(t: Column, language: Column) -> Column:
    """At most one death of the player for each row of the text."""
    made = by_language(language, lambda v: F.filter(F.transform(text_rows(t), lambda s: _self_row(s, v)), lambda e: e.isNotNull()))
    return F.coalesce(made, F.array().cast(EVENTS))


def text_events(t: Column, target: Column, language: Column) -> Column:
    """Events of a target ('self-death', 'own-kill' or 'both'), the player's deaths first."""
    none = F.array().cast(EVENTS)
    deaths = F.when(target.isin("self-death", "both"), self_events(t, language)).otherwise(none)
    kills = F.when(target.isin("own-kill", "both"), own_kill_events(t, language)).otherwise(none)
    return F.concat(deaths, kills)


def first_method(events: Column) -> Column:
    return F.get(events, F.lit(0))["method"]


def classification(t: Column, target: Column, language: Column, is_assist_roi: Column) -> Column:
    """Method label of one observation."""
    own = target.isin("own-kill", "both")
    deaths = F.when(target.isin("self-death", "both"), self_events(t, language))
    skipped, none = F.lit("paddle-own-kill-assist-skipped"), F.lit("paddle-not-target-text")

    def label(kills: Column) -> Column:
        bare = own & (F.size(kills) == 0) & has_own_candidate(t, language)
        return (F.when(bare & is_delayed(t, language), F.lit("paddle-own-kill-delayed-elim-skipped")).when(bare & is_assist_only(t, language), skipped)
                .otherwise(F.coalesce(first_method(deaths), first_method(kills), none)))

    # the kills are looked for once, and not where the region or an empty text decides
    kills = F.when(own, own_kill_events(t, language)).otherwise(F.array().cast(EVENTS))
    return F.when(is_assist_roi, F.when(has_assist(t, language), skipped).otherwise(F.lit("paddle-not-assist-text"))).when(F.coalesce(t, F.lit("")) == "", none).otherwise(let(kills, label))


def key_parts(key: Column, target: Column, action: Column, subject: Column) -> Column:
    """The three parts of an event key, missing ones from the event's own fields."""
    part = F.split(key, ":", 3)
    return F.struct(F.get(part, F.lit(0)).alias("target"), F.coalesce(F.get(part, F.lit(1)), action).alias("action"), F.coalesce(F.get(part, F.lit(2)), subject).alias("subject"))


def exploded_events(frames: DataFrame, target: str = "both") -> DataFrame:
    """One row for each event of each frame (text, language and what else the frames hold), with its place ``ord`` from 0."""
    rows = frames.withColumn("events", text_events(F.col("text"), F.lit(target), F.col("language"))).drop("text")
    # outer, and then without the rows that it adds: of a plain one Spark infers a filter on the array's size before it, for which the text is parsed again
    return rows.select(*[c for c in rows.columns if c != "events"], F.posexplode_outer("events").alias("ord", "e")).filter("ord is not null").select("*", "e.*").drop("e")
