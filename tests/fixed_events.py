"""On-screen texts with the events that they must give, and pairs of events with whether they are one."""

#: (language, target, text, events), an event being (target, method, action, subject, key, weapon).
EVENTS = [
    ("zh-Hans", "own-kill", "你用M416击倒了EnemyA", [("own-kill", "paddle-own-kill-text", "knock", "EnemyA", "own-kill:knock:enemya", "M416")]),
    ("zh-Hans", "own-kill", "你用燃烧弹淘汰了EnemyA淘汰数", [("own-kill", "paddle-own-kill-text", "eliminate", "EnemyA", "own-kill:eliminate:enemya", "燃烧弹")]),
    ("zh-Hans", "self-death", "EnemyA用燃烧瓶击倒了你", [("self-death", "paddle-strict-self-text", "knock", "EnemyA用燃烧瓶", "self-death:knock:enemya", "燃烧瓶")]),
    ("zh-Hans", "self-death", "你因坠落遭击倒", [("self-death", "paddle-zone-self-downed-text", "zone-downed", "zone", "self-death:zone", "")]),
    ("zh-Hans", "self-death", "击倒了你", [("self-death", "paddle-strict-self-text", "knock", "", "self-death:knock:unknown", "")]),
    ("zh-Hant", "own-kill", "您以SLR爆頭擊倒OpponentAlpha", [("own-kill", "paddle-own-kill-text", "knock", "OpponentAlpha", "own-kill:knock:opponentalpha", "SLR爆頭")]),
    ("zh-Hant", "own-kill", "您以BerylM762擊殺OpponentBravo2擊殺數", [("own-kill", "paddle-own-kill-text", "eliminate", "OpponentBravo", "own-kill:eliminate:opponentbravo", "BerylM762")]),
    ("zh-Hant", "self-death", "您因墜落遭擊倒", [("self-death", "paddle-zone-self-downed-text", "zone-downed", "zone", "self-death:zone", "")]),
    ("en", "own-kill", "YOU KNOCKED OUT OpponentAlpha with Beryl M762", [("own-kill", "paddle-own-kill-text", "knock", "OpponentAlpha", "own-kill:knock:opponentalpha", "BerylM762")]),
    ("en", "own-kill", "YOU KILLED OpponentBravo with Beryl M762 2 KILLS", [("own-kill", "paddle-own-kill-text", "eliminate", "OpponentBravo", "own-kill:eliminate:opponentbravo", "BerylM762")]),
    ("en", "self-death", "OpponentCharlie KNOCKED YOU out with ACE32", [("self-death", "paddle-strict-self-text", "knock", "OpponentCharlie", "self-death:knock:opponentcharlie", "ACE32")]),
    ("en", "self-death", "OpponentDelta KILLS YOU with MP5K", [("self-death", "paddle-strict-self-text", "eliminate", "OpponentDelta", "self-death:eliminate:opponentdelta", "MP5K")]),
    ("en", "self-death", "YOU WERE KNOCKED OUT FROM FALLING", [("self-death", "paddle-zone-self-downed-text", "zone-downed", "zone", "self-death:zone", "")]),
    ("zh-Hans", "own-kill", "你用BerylM762击倒了EnemyA你用BerylM762击倒了EnemyB", [("own-kill", "paddle-own-kill-text", "knock", "EnemyA", "own-kill:knock:enemya", "BerylM762"), ("own-kill", "paddle-own-kill-text", "knock", "EnemyB", "own-kill:knock:enemyb", "BerylM762")]),
    ("en", "both", "YOU KNOCKED OUT EnemyA with M416 YOU finally KILLED EnemyA 1 KILL", [("own-kill", "paddle-own-kill-text", "knock", "EnemyA", "own-kill:knock:enemya", "M416")]),
    ("zh-Hans", "both", "你用M416淘汰了EnemyA助攻", []),
    ("zh-Hans", "both", "你用M416淘汰了EnemyA淘汰数2协助次数", [("own-kill", "paddle-own-kill-text", "eliminate", "EnemyA", "own-kill:eliminate:enemya", "M416")]),
    ("en", "both", "Winner Winner Chicken Dinner", []),
]

#: The same for texts whose white space is taken out before.
SQUEEZED = [
    ("zh-Hans", "both", "你用 M416 击倒了 Enemy (123m) 淘汰数 2", [("own-kill", "paddle-own-kill-text", "knock", "Enemy", "own-kill:knock:enemy", "M416")]),
    ("zh-Hans", "both", "Enemy 使用 AKM 淘汰了你", [("self-death", "paddle-strict-self-text", "eliminate", "Enemy使用AKM", "self-death:eliminate:enemy", "AKM")]),
    ("zh-Hant", "both", "您以 M416 擊殺 Enemy 擊殺數 2", [("own-kill", "paddle-own-kill-text", "eliminate", "Enemy", "own-kill:eliminate:enemy", "M416")]),
    ("zh-Hant", "both", "Enemy以M416擊倒您", [("self-death", "paddle-strict-self-text", "knock", "Enemy以M416", "self-death:knock:enemy", "M416")]),
    ("en", "both", "Enemy KILLS YOU with M416", [("self-death", "paddle-strict-self-text", "eliminate", "Enemy", "self-death:eliminate:enemy", "M416")]),
    ("en", "both", "You killed Enemy by headshot with AKM 2 KILLS", [("own-kill", "paddle-own-kill-text", "eliminate", "Enemy", "own-kill:eliminate:enemy", "AKM")]),
    ("en", "both", "YOU knocked out Enemy using M416", [("own-kill", "paddle-own-kill-text", "knock", "Enemy", "own-kill:knock:enemy", "M416")]),
    ("en", "both", "YOU killed Alpha with M416 YOU knocked out Bravo using AKM", [("own-kill", "paddle-own-kill-text", "eliminate", "Alpha", "own-kill:eliminate:alpha", "M416"), ("own-kill", "paddle-own-kill-text", "knock", "Bravo", "own-kill:knock:bravo", "AKM")]),
    ("zh-Hans", "both", "你用M416击倒了Alpha你使用AKM淘汰了Bravo", [("own-kill", "paddle-own-kill-text", "knock", "Alpha", "own-kill:knock:alpha", "M416"), ("own-kill", "paddle-own-kill-text", "eliminate", "Bravo", "own-kill:eliminate:bravo", "AKM")]),
    ("en", "both", "YOU killed Enemy with AKM ASSIST", []),
    ("zh-Hans", "both", "你淘汰了Enemy协助", []),
    ("zh-Hant", "both", "您擊殺Enemy助殺", []),
    ("en", "both", "YOU killed Enemy with AKM 2 KILLS 1 ASSIST", [("own-kill", "paddle-own-kill-text", "eliminate", "Enemy", "own-kill:eliminate:enemy", "AKM")]),
    ("en", "both", "YOU FINALLY eliminated Enemy", []),
    ("zh-Hans", "both", "你终于淘汰了Enemy", []),
    ("zh-Hant", "both", "您終於擊殺Enemy", []),
    ("en", "both", "YOU killed Alpha ASSIST YOU killed Bravo", [("own-kill", "paddle-own-kill-text", "eliminate", "Bravo", "own-kill:eliminate:bravo", "")]),
    ("zh-Hans", "both", "你终于淘汰了Alpha你用AKM击倒了Bravo", [("own-kill", "paddle-own-kill-text", "knock", "Bravo", "own-kill:knock:bravo", "AKM")]),
    ("en", "both", "YOU WERE KNOCKED OUT BY FALLING", [("self-death", "paddle-zone-self-downed-text", "zone-downed", "zone", "self-death:zone", "")]),
    ("zh-Hans", "both", "你因坠落遭击倒", [("self-death", "paddle-zone-self-downed-text", "zone-downed", "zone", "self-death:zone", "")]),
    ("zh-Hant", "both", "您因墜落遭擊倒", [("self-death", "paddle-zone-self-downed-text", "zone-downed", "zone", "self-death:zone", "")]),
    ("en", "both", "YOU killed YOU", [("self-death", "paddle-strict-self-text", "eliminate", "YOU", "self-death:eliminate:you", "")]),
    ("en", "both", "Winner Winner Chicken Dinner", []),
    ("zh-Hant", "both", "您以AKM擊倒Alpha\nEnemy KILLED YOU with M416\n你淘汰了Bravo", [("own-kill", "paddle-own-kill-text", "knock", "AlphaEnemyKILLEDYOUwithM416你淘汰了Bravo", "own-kill:knock:alphaenemykilledyouwithm416你淘汰了bravo", "AKM")]),
    ("zh-Hans", "both", "你淘汰了Enemy淘汰数2协助1", [("own-kill", "paddle-own-kill-text", "eliminate", "Enemy", "own-kill:eliminate:enemy", "")]),
    ("zh-Hant", "both", "您擊殺Enemy擊殺數2助殺1", [("own-kill", "paddle-own-kill-text", "eliminate", "Enemy", "own-kill:eliminate:enemy", "")]),
    ("zh-Hant", "both", "你淘汰了你\nYOU killed YOU", [("self-death", "paddle-strict-self-text", "eliminate", "你", "self-death:eliminate:你", "")]),
]

#: (left, right, same, same when close in time, same for a follow-up), an event being (target, action, subject, key).
PAIRS = [
    (("own-kill", "knock", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab", "own-kill:knock:aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab"), ("own-kill", "knock", "baaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "own-kill:knock:baaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), False, False, False),
    (("self-death", "knock", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab", "self-death:knock:aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab"), ("self-death", "knock", "baaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "self-death:knock:baaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), False, False, True),
    (("own-kill", "knock", "[clan]abc中文def", "own-kill:knock:[clan]abc中文def"), ("own-kill", "knock", "[clan]abcdef", "own-kill:knock:[clan]abcdef"), True, True, True),
    (("self-death", "knock", "[clan]abc中文def", "self-death:knock:[clan]abc中文def"), ("self-death", "knock", "[clan]abcdef", "self-death:knock:[clan]abcdef"), True, True, True),
    (("own-kill", "knock", "123٤abcXYZ", "own-kill:knock:123٤abcXYZ"), ("own-kill", "knock", "123٤abcXYQ", "own-kill:knock:123٤abcXYQ"), True, True, True),
    (("self-death", "knock", "123٤abcXYZ", "self-death:knock:123٤abcXYZ"), ("self-death", "knock", "123٤abcXYQ", "self-death:knock:123٤abcXYQ"), True, True, True),
    (("own-kill", "knock", "tide", "own-kill:knock:tide"), ("own-kill", "knock", "diet", "own-kill:knock:diet"), False, False, False),
    (("self-death", "knock", "tide", "self-death:knock:tide"), ("self-death", "knock", "diet", "self-death:knock:diet"), False, False, False),
    (("own-kill", "knock", "ASKKZM", "own-kill:knock:ASKKZM"), ("own-kill", "knock", "ASKKZMPNC2020", "own-kill:knock:ASKKZMPNC2020"), False, True, True),
    (("self-death", "knock", "ASKKZM", "self-death:knock:ASKKZM"), ("self-death", "knock", "ASKKZMPNC2020", "self-death:knock:ASKKZMPNC2020"), False, True, True),
    (("own-kill", "knock", "敌人²A", "own-kill:knock:敌人²A"), ("own-kill", "knock", "敌人²B", "own-kill:knock:敌人²B"), False, False, False),
    (("self-death", "knock", "敌人²A", "self-death:knock:敌人²A"), ("self-death", "knock", "敌人²B", "self-death:knock:敌人²B"), False, False, False),
]
