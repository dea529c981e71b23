"""The on-screen vocabulary of each language, as Java patterns over whitespace-free text.

A further language is one more entry of ``LANGUAGES``; no code names a language.
"""

from __future__ import annotations

from dataclasses import dataclass

TRIM = "，。,.、:：;；|/\\()（）[]【】 "


@dataclass(frozen=True)
class Vocabulary:
    """Patterns of one language; ``flags`` go before each of them."""

    flags: str
    own: str  # groups: prefix, action, victim, weapon, the next 24 characters
    own_self: tuple[str, ...]
    knock: str
    self_strict: str
    self_fuzzy: str
    self_zone: str
    assist: str
    count: str
    delayed: str
    scoreboard_assist: str
    weapon: str
    weapon_suffix: str
    subject_stop: str
    subject_tail: str | None
    stop_at_count: bool
    incendiary: str
    planner_incendiary: tuple[str, ...]
    fold_weapon: bool


_OWN_H = "你.{0,24}?(?:击倒|淘汰)了"
_OWN_T = "您.{0,24}?(?:擊倒|击倒|擊殺|撃殺|擎殺|淘汰)"
_OWN_E = "YOU(?:FINALLY)?(?:KNOCKEDOUT|KILLED|ELIMINATED)"
_ASSIST_E = r"(?:\d+)?ASSISTS?"
_COUNT_E = r"(?:\d+)?KILLS?(?![\p{L}\p{N}_])"

LANGUAGES: dict[str, Vocabulary] = {
    "zh-Hans": Vocabulary(
        flags="(?U)",
        own=rf"你(.{{0,24}}?)(击倒|淘汰)了(.+?)()(?={_OWN_H}|$)(?=(.{{0,24}}))",
        own_self=("你", "ni"),
        knock="击倒|倒了你",
        self_strict="(击倒了你|淘汰了你)",
        self_fuzzy="(击倒.{0,2}你|倒了你|淘.{0,2}了?你)",
        self_zone="你在安全区外倒地了|安全区外倒地了|安全区外倒地|你因.{0,8}(?:坠落|跌落|摔落).{0,4}(?:击倒|倒地)",
        assist="协助次数|协助|助.{0,2}攻",
        count="淘汰数",
        delayed="你终于淘汰了",
        scoreboard_assist=r"(?:淘汰数?\d*|淘汰\d+)(?:协助|助.{0,2}攻)",
        weapon=r"(?:使用|用)(.+)$",
        weapon_suffix=r"(?:淘汰数?\d*|淘汰\d+|协助次数|协助|助.{0,2}攻)+$",
        subject_stop=r"\(\d+\s*[mM]\)|（\d+\s*[mM]）|(?:\d+\s*)?(?:淘汰数?\d*|淘汰\d+)|协助次数|协助|助.{0,2}攻|使用|用|你(?:使用|用)|你.{0,24}?(?:击倒|淘汰)了|击倒了你|淘汰了你",
        subject_tail=None,
        stop_at_count=False,
        incendiary="燃烧弹|燃燒彈|燃烧瓶|燃燒瓶|molotov",
        planner_incendiary=("燃烧弹", "燃燒彈", "燃烧瓶", "燃燒瓶", "molotov"),
        fold_weapon=False,
    ),
    "zh-Hant": Vocabulary(
        flags="(?U)",
        own=rf"您(.{{0,24}}?)(擊倒|击倒|擊殺|撃殺|擎殺|淘汰)(.+?)()(?={_OWN_T}|$)(?=(.{{0,24}}))",
        own_self=("您", "你", "ni"),
        knock="擊倒|击倒|倒了你",
        self_strict="(擊倒您|击倒了你|擊殺您|撃殺您|擎殺您|淘汰您|淘汰了你)",
        self_fuzzy="(擊倒.{0,2}您|击倒.{0,2}你|倒了你|[擊撃擎]?殺.{0,2}您|淘.{0,2}您)",
        self_zone="您.{0,4}(?:安全區|遊戲區域)外(?:倒地|死亡)|您在安全区外倒地了|您因.{0,8}(?:墜落|跌落|摔落).{0,4}擊倒",
        assist="協助次數|協助|助.{0,2}[攻殺]",
        count="擊殺[數数]|撃殺[數数]|击杀数",
        delayed="您終於.{0,4}(?:擊殺|撃殺|擎殺|淘汰)",
        scoreboard_assist=r"(?:擊殺[數数]\d*|撃殺[數数]\d*|擊殺\d+|撃殺\d+)(?:協助|助.{0,2}[攻殺])",
        weapon=r"(?:以|使用|用)(.+)$",
        weapon_suffix=r"(?:(?:\d+\s*)?擊殺[數数]\d*|(?:\d+\s*)?撃殺[數数]\d*|協助次數|協助|助.{0,2}[攻殺])+$",
        subject_stop=r"\(\d+\s*[mM]\)|（\d+\s*[mM]）|(?:\d+\s*)?(?:擊殺[數数]\d*|撃殺[數数]\d*|擊殺\d+|撃殺\d+)|击杀数|協助次數|協助|助.{0,2}[攻殺]|以|使用|用|您(?:以|使用|用)|您.{0,24}?(?:擊倒|击倒|擊殺|撃殺|擎殺|淘汰)|擊倒您|击倒了你|擊殺您|撃殺您|擎殺您|淘汰您|淘汰了你",
        subject_tail=None,
        stop_at_count=False,
        incendiary="燃燒彈|汽油彈|molotov",
        planner_incendiary=("燃燒彈", "汽油彈", "molotov"),
        fold_weapon=False,
    ),
    "en": Vocabulary(
        flags="(?iuU)",
        own=rf"()YOU(?:FINALLY)?(KNOCKEDOUT|KILLED|ELIMINATED)(.+?)(?:(?:WITH|USING)(.+?))?(?={_OWN_E}|{_ASSIST_E}|$)(?=(.{{0,24}}))",
        own_self=("you",),
        knock="KNOCK",
        self_strict=rf"(KNOCKEDYOU(?:OUT)?|KILLEDYOU|KILLSYOU|ELIMINATEDYOU)(?:(?:WITH|USING)(.+?))?(?={_OWN_E}|{_ASSIST_E}|{_COUNT_E}|$)",
        self_fuzzy="(KNOCKED.{0,8}YOU|KILL(?:ED|S).{0,4}YOU|ELIMINAT(?:ED)?.{0,4}YOU)",
        self_zone="OUTSIDETHEPLAYZONE|OUTSIDETHEBLUEZONE|YOU(?:WERE)?(?:KNOCKEDOUT|KILLED|DIED).{0,18}(?:PLAYZONE|BLUEZONE|ZONE)|YOUWEREKNOCKEDOUTBY(?:FALLING|FALLDAMAGE)|YOUWEREKNOCKEDOUTFROMFALLING|YOUDIEDFROMFALLING",
        assist=_ASSIST_E,
        count=_COUNT_E,
        delayed="YOUFINALLY(?:KILLED|ELIMINATED)",
        scoreboard_assist=r"\d+KILLS?(?:\d+)?ASSISTS?",
        weapon=r"(?:WITH|USING)(.+)$",
        weapon_suffix=r"(?:\d(?:KILLS?|ASSISTS?)|ASSISTS?)+$",
        subject_stop=r"\(\d+\s*[mM]\)|（\d+\s*[mM]）|(?:\d+\s*)?(?:\d+KILLS?)|\d+KILLS?|(?:\d+)?ASSISTS?|WITH|USING|YOU(?:FINALLY)?(?:WITH|USING)|YOU(?:FINALLY)?(?:KNOCKEDOUT|KILLED|ELIMINATED)|KNOCKEDYOU(?:OUT)?|KILLEDYOU|KILLSYOU|ELIMINATEDYOU",
        subject_tail=r"(?:BYHEADSHOT)+$",
        stop_at_count=True,
        incendiary="MOLOTOV|FIRE-?BOMB|GASCAN|C4",
        planner_incendiary=("molotov", "firebomb", "fire-bomb", "gascan", "c4"),
        fold_weapon=True,
    ),
}
DEFAULT = "zh-Hans"

OWN_METHOD = "paddle-own-kill-text"
STRICT_METHOD = "paddle-strict-self-text"
ZONE_METHOD = "paddle-zone-self-downed-text"
FUZZY_METHOD = "paddle-fuzzy-self-text"
