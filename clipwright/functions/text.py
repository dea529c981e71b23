"""Text functions of on-screen event lines; every function returns a Column and takes the language as a Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import DEFAULT, FUZZY_METHOD, LANGUAGES, STRICT_METHOD, TRIM, ZONE_METHOD, Vocabulary

_SPACE = r"(?U)[\s\x1c-\x1f]+"


def by_language(language: Column, make: Callable[[Vocabulary], Column]) -> Column:
    """``make`` of the row's language; a null language is the default one, an unknown one gives null."""
    at = F.coalesce(language, F.lit(DEFAULT))
    out = None
    for name, vocabulary in LANGUAGES.items():
        out = F.when(at == name, make(vocabulary)) if out is None else out.when(at == name, make(vocabulary))
    return out


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _like(s: Column, v: Vocabulary, pattern: str) -> Column:
    return F.regexp_like(s, F.lit(f"{v.flags}(?:{pattern})"))


def _at(s: Column, v: Vocabulary, pattern: str) -> Column:
    """Place of the first match from 1, 0 if none."""
    return F.regexp_instr(s, F.lit(f"{v.flags}(?:{pattern})"))


def normalize_text(t: Column) -> Column:
    """Without any white space, U+001C to U+001F included."""
    return F.regexp_replace(t, _SPACE, "")


def text_rows(t: Column) -> Column:
    """The rows of a text, each without white space, empty ones gone."""
    return F.filter(F.transform(F.split(t, "\r?\n"), normalize_text), lambda x: x != "")


def normalize_rows(t: Column) -> Column:
    return F.array_join(text_rows(t), "\n")


def trim_punct(t: Column) -> Column:
    return F.btrim(t, F.lit(TRIM))


def _weapon(t: Column, v: Vocabulary) -> Column:
    return F.left(trim_punct(F.regexp_replace(normalize_text(t), v.flags + v.weapon_suffix, "")), F.lit(32))


def clean_weapon(t: Column, language: Column) -> Column:
    return by_language(language, lambda v: _weapon(t, v))


def _subject(t: Column, v: Vocabulary) -> Column:
    stop = v.subject_stop + (f"|{v.count}" if v.stop_at_count else "")
    out = trim_punct(F.regexp_replace(normalize_text(t), f"{v.flags}(?:{stop}).*$", ""))
    if v.subject_tail:
        out = trim_punct(F.regexp_replace(out, v.flags + v.subject_tail, ""))
    return F.left(out, F.lit(48))


def clean_subject(t: Column, language: Column) -> Column:
    return by_language(language, lambda v: _subject(t, v))


def _subject_key(t: Column, v: Vocabulary) -> Column:
    return let(_subject(t, v), _key_of)


def _key_of(subject: Column) -> Column:
    key = F.lower(F.regexp_replace(subject, r"[^\p{L}\p{N}_\-\[\]]", ""))
    return F.when(key != "", key).otherwise(F.lower(subject))


def subject_key(t: Column, language: Column) -> Column:
    return by_language(language, lambda v: _subject_key(t, v))


def _action(raw: Column, v: Vocabulary) -> Column:
    return F.when(_like(raw, v, v.knock), F.lit("knock")).otherwise(F.lit("eliminate"))


def canonical_action(raw: Column, language: Column) -> Column:
    return by_language(language, lambda v: _action(raw, v))


def is_incendiary(weapon: Column, language: Column) -> Column:
    """The parser's rule."""
    return by_language(language, lambda v: _like(normalize_text(weapon), v, v.incendiary))


def is_incendiary_for_planning(weapon: Column, language: Column) -> Column:
    """The planner's rule: plain terms, letters folded only where the language folds them."""

    def make(v: Vocabulary) -> Column:
        w = normalize_text(weapon)
        if v.fold_weapon:
            w = F.lower(F.translate(w, "İıſK", "iisk"))
        out = F.lit(False)
        for term in v.planner_incendiary:
            out = out | F.contains(w, F.lit(term))
        return out

    return by_language(language, make)


def has_assist(t: Column, language: Column) -> Column:
    return by_language(language, lambda v: _like(normalize_text(t), v, v.assist))


def is_delayed(t: Column, language: Column) -> Column:
    return by_language(language, lambda v: _like(normalize_text(t), v, v.delayed))


def _assist_only(s: Column, v: Vocabulary) -> Column:
    assist, count = _at(s, v, v.assist), _at(s, v, v.count)
    return (assist > 0) & ~_like(s, v, v.scoreboard_assist) & ((count == 0) | (assist < count))


def is_assist_only(t: Column, language: Column) -> Column:
    """An assist that no kill count precedes and that is no scoreboard figure."""
    return by_language(language, lambda v: _assist_only(normalize_text(t), v))


def _self_class(s: Column, v: Vocabulary) -> Column:
    return (F.when(_like(s, v, v.self_strict), F.lit(STRICT_METHOD)).when(_like(s, v, v.self_zone), F.lit(ZONE_METHOD))
            .when(_like(s, v, v.self_fuzzy), F.lit(FUZZY_METHOD)))


def self_class(t: Column, language: Column) -> Column:
    """Method of a text on the player's own death: strict before zone before fuzzy, else null."""
    return by_language(language, lambda v: _self_class(normalize_text(t), v))


def _candidate(s: Column, v: Vocabulary) -> Column:
    start = v.own.split("(.+?)", 1)[0]
    after = {"你": "你", "您": "您"}.get(v.own_self[0], "YOU")
    return _like(s, v, f"{start}(?!{after})")


def has_own_candidate(t: Column, language: Column) -> Column:
    """An own kill begins here and is not followed by the player."""
    return by_language(language, lambda v: _candidate(normalize_text(t), v))


def guess_language(t: Column) -> Column:
    """By script: ASCII letters without a Han sign are English, any of four signs makes it traditional, else simplified."""
    latin = F.regexp_like(t, F.lit("[A-Za-z]")) & ~F.regexp_like(t, F.lit("[\u4e00-\u9fff]"))
    return F.when(latin, F.lit("en")).when(F.regexp_like(t, F.lit("[擊您淘汰]")), F.lit("zh-Hant")).otherwise(F.lit("zh-Hans"))


#: Terms that tell the action or kind of an annotated text, upper case.
_ELIMINATE = "擊殺|击杀|淘汰|KILLED|ELIMINATED"
_KNOCK = "擊倒|击倒|KNOCKED"
_ELIMINATE_KEYS = "ELIMINATE|淘汰|擊殺|击杀"
_ASSIST_KIND = "助攻|助殺|ASSIST"
_DELAYED_KIND = "終於|终于|FINALLY"


def annotation_action(t: Column, keys: Column) -> Column:
    text, key = F.upper(F.coalesce(t, F.lit(""))), F.upper(F.coalesce(keys, F.lit("")))
    return (F.when(F.regexp_like(text, F.lit(_ELIMINATE)), F.lit("eliminate")).when(F.regexp_like(text, F.lit(_KNOCK)), F.lit("knock"))
            .when(F.regexp_like(key, F.lit(_ELIMINATE_KEYS)), F.lit("eliminate")).otherwise(F.lit("unknown")))


def annotation_kind(t: Column, keys: Column) -> Column:
    """assist before delayed elimination before the action itself."""
    text = F.upper(F.coalesce(t, F.lit("")))
    return (F.when(F.regexp_like(text, F.lit(_ASSIST_KIND)), F.lit("assist")).when(F.regexp_like(text, F.lit(_DELAYED_KIND)), F.lit("delayed-elimination"))
            .otherwise(annotation_action(t, keys)))


def text_digest(t: Column) -> Column:
    """SHA-256 of the normalised rows, for comparing texts without sharing them."""
    return F.sha2(normalize_rows(t), 256)


def first_score(scores: Column) -> Column:
    return F.trim(F.element_at(F.split(F.coalesce(scores, F.lit("")), ";"), 1))
