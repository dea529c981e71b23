"""The operators against brute force, exact round trips or held-out accuracy, with awkward rows."""

import hashlib
import random
import re
import textwrap
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipwright.llm import html_text, jaccard, labelled, leaks, licences, lines, pieces, quality, shingles, token_counts, toxicity, vectors
from clipwright.llm.components import components
from clipwright.llm.licence_texts import TEMPLATES
from clipwright.llm.queries import piece_model

DOCS = "doc_id long, text string, _gone string, key int"


def docs_of(spark, texts, first=0):
    """With extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(first + i, t, "x", 1) for i, t in enumerate(texts)], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_copies(seed, groups=6, each=9, n=60):
    rng = random.Random(seed)
    out = [None, "", "  \n ", "a b", "A  b", "one two three four five"]
    for g in range(groups):
        base = [f"w{g}x{rng.randrange(10**6)}" for _ in range(n + 7 * g)]
        if g % 2:
            base[:12] = [f"shared{i}" for i in range(12)]
        for _ in range(each):
            copy = base[:]
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = rng.choice(["edit", f"e{rng.randrange(9)}", f"u{rng.randrange(10**6)}"])
            if rng.random() < 0.2:
                copy = copy[: int(len(copy) * 0.85)]
            out.append(" ".join(copy))
    out += out[8:11]
    rng.shuffle(out)
    return out


def closure(ids, links):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_jaccard_counts_over_tasks(spark, monkeypatch):
    """A passage that one set in each task has is frequent, so sets that share no more are not met; result as ever."""
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(40))
    texts = [passage + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(160)) for _ in range(24)]
    texts.append(texts[3] + " more")
    met, pairs = [], jaccard._short_pairs

    def counted(rows, *rest):
        met.append(rows.count())
        return pairs(rows, *rest)

    monkeypatch.setattr(jaccard, "_short_pairs", counted)
    docs = docs_of(spark, texts).repartitionByRange(len(texts), "doc_id")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_groups(docs).collect()}
    assert got == {i: 3 if i == 24 else i for i in range(25)}
    assert sum(met) == 0


def test_jaccard_merges_lists_of_the_same_sets(spark):
    """Two sets that meet in fifty lists make one pair that counts fifty."""
    # (list, key, prime, pos, comp): lists 0 to 49 of sets 1 and 2, one of 1, 2 and 3, one where the block begins with neither's size class
    rows = [(i, k, 1, i, k) for i in range(50) for k in (1, 2)] + [(90, k, 1, 50, k) for k in (1, 2, 3)] + [(91, k, 0, 51, k) for k in (1, 2)]
    table = spark.createDataFrame([(a, 0, 0, k, 100, p, pr, 2, c, 0, 79) for a, k, pr, p, c in rows], "list long, root long, root_n int, key long, n int, pos int, prime int, m int, comp long, w long, rest int")
    merged = jaccard._merged(table)
    assert sorted((r["key"], r["prime"], r["times"]) for r in merged.collect()) == sorted([(1, 1, 50), (2, 1, 50), (1, 1, 1), (2, 1, 1), (3, 1, 1), (1, 0, 1), (2, 0, 1)])
    for need, left in ((51, {(1, 2)}), (52, set())):
        share = F.expr(f"c >= {need}")
        assert {tuple(r) for r in jaccard._short_pairs(table, jaccard.SHORT, share).collect()} == left


@pytest.mark.parametrize("short,hot", [(24, 8), (2, 2)])
def test_jaccard_like_brute_force(spark, monkeypatch, short, hot):
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "HOT_COUNT", hot)
    texts = near_copies(short)
    sets = [shingle_set(t) for t in texts]
    ids = range(len(texts))
    links = [(a, b) for a in ids for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    low = closure(ids, links)
    got = {r["doc_id"]: r for r in jaccard.jaccard_groups(docs_of(spark, texts)).collect()}
    assert {i: got[i]["component_id"] for i in ids} == low
    assert {i: got[i]["n_shingles"] for i in ids} == {i: len(sets[i]) for i in ids}
    kept = jaccard.keep_one_of_each(docs_of(spark, texts))
    assert kept.columns == ["doc_id", "text", "_gone", "key"]
    assert {r["doc_id"] for r in kept.collect()} == {i for i in ids if low[i] == i}


def test_empty_tables(spark):
    none = docs_of(spark, []).select("doc_id", "text")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert jaccard.jaccard_groups(none).count() == 0
    assert lines.dedup_lines(none).count() == 0
    assert leaks.contained_items(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert toxicity.toxicity_scores(none, labels).count() == 0
    assert quality.quality_scores(none, labels).count() == 0
    assert licences.licence_scan(none).count() == 0
    assert pieces.piece_digests(none, piece_model()).count() == 0
    assert token_counts.token_counts(none, piece_model()).count() == 0
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"), "a", "b").df.collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


def test_shingles_like_words():
    texts = ["", None, "A b\tC d e f", "x " * 50, "é ü ñ a b c", "\x85 a b c d e f"]
    for t, s in zip(texts, shingles.shingle_sets(texts), strict=True):
        assert len(s) == len(shingle_set(t))


def lines_like_brute_force(texts):
    by = defaultdict(set)
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            if len(k := lines.line_key(line)) >= 40:
                by[k].add(i)
    out = {}
    for i, t in texts.items():
        rows = (t or "").split("\n")
        stay = [r for r in rows if not (len(k := lines.line_key(r)) >= 40 and len(by[k]) >= 5 and max(by[k]) != i)]
        out[i] = (len(rows), len(rows) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    return out


def line_texts(seed):
    rng = random.Random(seed)
    common = [f"A common line number {i} that is long enough to count" for i in range(12)]
    out = {}
    for i in range(60):
        rows = [rng.choice(common).swapcase() if rng.random() < 0.4 else f"own line {i} {j} of this text which is long enough" for j in range(6)]
        out[i] = "\n".join(f"  {r}\t" if rng.random() < 0.3 else r for r in rows)
    return out | {100: None, 101: "", 102: "\n\n", 103: "short"}


def got_lines(df):
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in df.collect()}


def test_lines_like_brute_force(spark):
    texts = line_texts(1)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], DOCS)
    assert got_lines(lines.dedup_lines(df)) == lines_like_brute_force(texts)
    kept = lines.with_kept_lines(df)
    assert kept.columns == df.columns and kept.filter("doc_id = 100").first()["text"] is None


def held_keys(index):
    return {(r["k1"], r["k2"]): (r["n_docs"], r["max_doc"]) for r in index.totals().collect()}


def filters_hold(index):
    rows = [(r["k1"], r["k2"] % index.shards) for r in index.totals().collect()]
    found = defaultdict(list)
    for r in index.filters.df.collect():
        found[r["shard"]].append(lines.CuckooFilter.of_bytes(r["cuckoo"]))
    return all(any(f.contains(np.array([k], np.int64))[0] for f in found[s]) for k, s in rows)


def test_line_index_is_reversible(spark, monkeypatch):
    monkeypatch.setattr(lines, "KEYS_PER_SHARD", 40)  # shards double on the way
    texts = line_texts(2)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    index, whole = lines.LineIndex(spark), lines.LineIndex(spark)
    index.insert(rows.filter("doc_id % 3 = 0"))
    first = held_keys(index)
    index.insert(rows.filter("doc_id % 3 = 1"))
    before = held_keys(index)
    assert not any(r["seen"] for r in index.counts[0].df.collect()) and any(r["seen"] for r in index.counts[1].df.collect())
    index.insert(rows.filter("doc_id % 3 = 2"))
    whole.insert(rows)
    assert held_keys(index) == held_keys(whole) and index.shards > 2 and filters_hold(index)
    index.delete(rows.filter("doc_id % 3 = 2").select("doc_id"))
    assert held_keys(index) == before and filters_hold(index)
    index.insert(rows.filter("doc_id % 3 = 2"))
    assert held_keys(index) == held_keys(whole) and filters_hold(index)
    index.delete(rows.filter("doc_id % 3 > 0").select("doc_id"))
    assert held_keys(index) == first and filters_hold(index)


def test_cuckoo_filter():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 5000)
    made = lines.filter_of(keys)
    assert made.contains(keys).all()
    other = np.random.default_rng(2).integers(-(2**63), 2**63, 20000)
    assert made.contains(other).mean() < 0.01
    assert made.remove(keys[:2500]).all()
    assert made.contains(keys[2500:]).all() and made.contains(keys[:2500]).mean() < 0.01


@pytest.mark.parametrize("block", [512, 8])
def test_vectors_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows, vec = [], 0
    for label in (1, 2, None):
        for _ in range(8):
            base = rng.standard_normal(16)
            for _ in range(10):
                rows.append((vec, (base + rng.standard_normal(16) * rng.choice([0, 0.15, 0.3])).tolist(), label))
                vec += 1
    rows += [(vec, None, 1), (vec + 1, [0.0] * 16, 1), (vec + 2, [float("nan")] * 16, 1), (vec + 3, [None] * 16, 1), (vec + 4, [], 1), (vec + 5, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("links", F.lit(1))
    n = vec
    x = np.array([r[1] for r in rows[:n]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = [r[2] for r in rows[:n]]
    links = [(a, b) for a in range(n) for b in range(a) if lab[a] == lab[b] is not None and x[a] @ x[b] >= 0.93]
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    low = closure([r[0] for r in rows], links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect()}
    assert got == {r[0]: (count[r[0]], low[r[0]]) for r in rows}


def test_leaks_like_brute_force(spark):
    rng = random.Random(4)
    items = [" ".join(f"q{rng.randrange(500)}" for _ in range(n)) for n in (0, 1, 3, 4, 5, 9, 30, 33, 90)] + [None]
    texts = [None, "", "q1 q2"]
    for _ in range(80):
        body = [f"z{rng.randrange(900)}" for _ in range(rng.randrange(200))]
        item = (rng.choice(items) or "").split()
        if rng.random() < 0.5 and len(item) > 10:
            item[rng.randrange(len(item))] = "changed"
        at = rng.randrange(len(body) + 1)
        texts.append(" ".join(body[:at] + item + body[at:]))
    want = set()
    for i, t in enumerate(items):
        w = words(t)
        width = min(len(w), 5)
        own = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if w else set()
        for d, text in enumerate(texts):
            x = words(text)
            there = {tuple(x[k : k + width]) for k in range(len(x) - width + 1)} if w else set()
            if own and 100 * len(own & there) >= 80 * len(own):
                want.add((i, d))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = leaks.contained_items(docs_of(spark, texts), table)
    assert {(r["item_id"], r["doc_id"]) for r in got.collect()} == want
    leaky = {d for _, d in want}
    assert {r["doc_id"] for r in leaks.without_leaks(docs_of(spark, texts), table).collect()} == set(range(len(texts))) - leaky


TEXTS = ["", " ", "  a", "a  ", "Hello world", "\n b ▁c  d\x00e \U0001F600", "▁ ▁", "x" * 3000, "日本語 テキスト", "tab\there"]


def test_pieces_round_trip(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    got = {r["doc_id"]: r for r in pieces.piece_digests(docs_of(spark, [*TEXTS, None]), piece_model()).collect()}
    for i, t in enumerate([*TEXTS, ""]):
        ids = lib.encode(t)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    for r in pieces.encode_spans(docs_of(spark, TEXTS), piece_model()).collect():
        raw = r["text"].encode()
        assert b"".join(raw[p["begin"] : p["end"]] for p in r["pieces"]) == raw


def compiled(rules):
    """A small double-array trie as ``pieces.CharacterMap`` reads it, by first fit."""
    strings, at = b"", {}
    for new in rules.values():
        at[new] = len(strings)
        strings += new + b"\0"
    units, used = [0] * 4096, {0}

    def place(node, prefix):
        below = sorted({k[len(prefix)] for k in rules if k.startswith(prefix) and len(k) > len(prefix)})
        labels = ([0] if prefix in rules else []) + below
        if not labels:
            return
        base = next(b for b in range(256, 2000, 256) for b in range(b, b + 256) if all((b ^ c) not in used for c in labels))
        units[node] |= (node ^ base) << 10
        for c in labels:
            used.add(base ^ c)
        if prefix in rules:
            units[node] |= 0x100
            units[base] = at[rules[prefix]] | 0x80000000
        for c in below:
            units[base ^ c] |= c
            place(base ^ c, prefix + bytes([c]))

    place(0, b"")
    raw = np.array(units, "<u4").tobytes()
    return len(raw).to_bytes(4, "little") + raw + strings


def test_normaliser_records_source_bytes():
    rules = {b"ab": b"X", b"abc": b"YZ", "é".encode(): b"e", b"q": b""}
    norm = pieces.Normaliser(pieces.CharacterMap(compiled(rules)), dummy_prefix=False, escape=False)
    out, src = norm("zabcéqab")
    assert out == b"zYZeX" and src.tolist() == [0, 1, 1, 4, 7, 9]
    squeezed = pieces.Normaliser(None, dummy_prefix=True, squeeze=True)
    out, src = squeezed("  a  b ")
    assert out.decode() == "▁a▁b" and src[3] == 2 and src[7] == 5


def test_automaton_is_greedy(spark):
    rng = random.Random(5)
    for _ in range(300):
        rest = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 8))}
        first = {"".join(rng.choices("abc", k=rng.randint(0, 3))) for _ in range(4)}
        made = token_counts.Automaton(first, rest)
        for _ in range(5):
            w = "".join(rng.choices("abcd", k=rng.randint(1, 9)))
            n, at, here = 0, 0, first
            while at < len(w):
                fit = max((len(p) for p in here if p and w.startswith(p, at)), default=0)
                n += 1
                at += fit or (1 if here is rest else 0)
                here = rest
            assert made.count(w) == n
    rows = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(docs_of(spark, [None, "", " \n", "a a"]), piece_model()).collect()}
    assert rows == {0: (0, 0), 1: (0, 0), 2: (0, 0), 3: (2, 2)}


def test_pages(spark):
    nav = "<nav><ul><li>Home</li><li>About</li></ul></nav>"
    boiler = "<div>This site is run by a very small group of people</div>"
    pages = [
        (1, "http://h/1", f"<html>{nav}<div class='ad'>buy</div><article><h1>T &amp; U</h1><p>one\n two<p>th<b>re</b>e</article><footer>f</footer>"),
        (2, "http://h/2", f"{nav}{boiler}<div>unique text of page two</div><script>var t='</p>';</script>"),
        (3, "http://h/3", f"{nav}{boiler}<p>another page says this</p><section id=comments><p>nice</p></section>"),
        (4, "http://other/4", f"{boiler}"),
        (5, None, None), (6, "http://h/6", ""), (7, "http://h/7", "<main><p>x<aside>no</aside>y</main>"),
    ]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("starts", F.lit(1))).collect()}
    want = {1: "T & U one two three", 2: "unique text of page two", 3: "another page says this", 4: "This site is run by a very small group of people", 5: "", 6: "", 7: "x y"}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def test_page_markup_keeps_articles():
    def text(html):
        main, tokens, open_ = html_text.settled(html)
        return main if main is not None else " ".join(w for w, o in zip(tokens, open_, strict=True) if o)

    art = "<article><header class='entry-header'><h1 class='post-header'>Title</h1></header><p>the text</article>"
    for head in ("<head><title>t</title>", "<head><title>t</title><meta charset=x><script>var a</script>", "<title>t</title>"):
        assert text(f"<html>{head}<body>{art}</body></html>") == "Title the text"
        assert text(f"<html>{head}{art}") == "Title the text"
        assert text(f"<html>{head}<p>no article</p><div class=ad>buy</div>") == "no article"
    assert text("<head><title>t</title> plain words <p>more") == "plain words more"
    for name in ("content-sidebar-wrap", "has-notice", "sidebar", "no-ads with-footer", "promo"):
        assert text(f"<body><div class='{name}'>{art}</div>") == "Title the text"
        assert text(f"<body><div id='{name}'><main><p>the main text</main></div>") == "the main text"
    assert text(f"<body class='has-sidebar ad'>{art}") == "Title the text"
    for name in ("site-header", "ad-slot", "post-comments", "footer__links", "main-nav", "related-posts", "cookie-banner", "comment-12"):
        assert text(f"<p>open</p><div class='x {name}'>out</div>") == "open"
    assert text(f"<body>{art}<div class='related'><article>other</article></div><div class='comments'><article>c</article></div>") == "Title the text"
    assert text("<article>a b c<div class='related'><article>d e f g h</article></div></article>") == "a b c"


def test_pages_keep_copies_and_phrases(spark):
    body = [f"word{i}" for i in range(300)]
    near = [*body[:150], "changed", *body[151:]]
    boiler, phrase = "this site is run by a group of people", "at the end of the day we"
    pages = [(1, "http://h/a?ref=x", " ".join(body)), (2, "http://h/a?page=2", " ".join(body)), (3, "http://h/b", " ".join(near)),
             (4, "http://one/a?x=1", "the same text under two addresses"), (5, "http://one/a?x=2", "the same text under two addresses")]
    own = {i: " ".join(f"own{i}x{j}" for j in range(20)) for i in range(10, 30)}
    pages += [(i, f"http://h/{i}", f"{t} {phrase if i < 12 else f'and{i}'}</p><p>{boiler if i > 14 else ''}") for i, t in own.items()]
    df = spark.createDataFrame([(i, u, f"<p>{t}</p>") for i, u, t in pages], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    want = {i: t for i, _, t in pages[:5]} | {i: f"{t} {phrase if i < 12 else f'and{i}'}" for i, t in own.items()}
    assert got == want


def labelled_texts(seed, bad):
    rng = random.Random(seed)
    texts, y = [], []
    for i in range(600):
        body = ["".join(rng.choices(["ta", "ri", "mo", "le"], k=rng.randint(1, 4))) for _ in range(rng.randint(20, 80))]
        y.append(int(i % 4 == 0))
        if y[-1]:
            body = bad(rng, body)
        texts.append(" ".join(body))
    return texts, y


def test_toxicity_held_out_and_misspelt():
    def insult(rng, body):
        for _ in range(3):
            body.insert(rng.randrange(len(body)), rng.choice(["horrible", "dreadful", "obnoxious"]))
        return body

    texts, y = labelled_texts(6, insult)
    model = toxicity.train(texts[:450], np.array(y[:450]), 0.25)
    hit = (model.scores(texts[450:]) >= 0.5).astype(int)
    assert (hit == np.array(y[450:])).mean() > 0.95
    assert model.scores(["ta ri mo le obnoxxious tari mole"])[0] > model.scores(["ta ri mo le tamo tari mole"])[0]
    assert np.isfinite(model.scores(["", " ", "x" * 10000])).all()
    clean = [" ".join(t.split()[:n]) for t, bad in zip(texts[450:], y[450:], strict=True) if not bad for n in (0, 1, 3, 8)]
    assert (model.scores(clean) >= 0.5).mean() < 0.02
    for t in texts[:20]:  # a score is the softmax's: the same by plain sums over n-grams
        said = toxicity.words_of(t)
        u = [np.mean([model.weight[g] for w, g in zip(*toxicity._grams([s]), strict=True)]) for s in said]
        w = [np.mean(u[i : i + 20]) for i in range(len(u) - 19)] if len(u) >= 20 else [(sum(u) + (20 - len(u)) * model.clean) / 20]
        assert np.allclose(model.features([t])[0], [max(w), np.mean(u) if len(u) > 20 else w[0], np.log1p(max(len(u), 20))])


def test_quality_held_out():
    texts, y = labelled_texts(7, lambda rng, body: [w + "###" for w in body] if rng.random() < 0.5 else [body[0]] * len(body))
    model = quality.train(texts[:450], 1 - np.array(y[:450]), 0.75)
    good = (model.scores(texts[450:]) >= 0.3).astype(int)
    assert (good == 1 - np.array(y[450:])).mean() > 0.95
    assert 0 <= model.scores([""])[0] <= 1


def test_learning_leaves_held_out_rows_alone(spark):
    docs = docs_of(spark, [f"text {i}" for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got, counts = labelled.sample(docs, labels, "toxic", 30)
    assert len(got) == 60 and not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"])
    rows = toxicity.toxicity_scores(docs, labels.filter("toxic = 1")).collect()
    assert len(rows) == 200 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_licences(spark):
    prose = ["word " * 9 + f"{i}" for i in range(60)]
    texts = [*prose, "words\n\nReleased under the MIT License.\n \nmore", "Licensed under CC BY-NC 4.0.", "He lost his driving license.", None, ""]
    got = {r["doc_id"]: (r["n_paragraphs"], r["n_licence"], r["families"], r["licence_paragraphs"]) for r in licences.licence_scan(docs_of(spark, texts)).collect()}
    assert got[60] == (3, 1, "mit", [1]) and got[61] == (1, 1, "cc-by-nc", [0])
    assert all(v[1:] == (0, "", []) for k, v in got.items() if k not in (60, 61)) and got[63][0] == got[64][0] == 0


def wrapped(text, width, mark=""):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_licence_windows_and_wraps():
    rng = random.Random(9)
    prose = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 90))) for _ in range(300)]
    model = licences.train([licences.bare(p) for p in prose])
    assert model.calibration["n"] > 100 and model.calibration["error"] < 0.05 and model.calibration["right"] > 0.97
    found = {}
    for i, (family, text) in enumerate((f, line) for f, t in TEMPLATES.items() for line in t.strip().split("\n") if len(line) > 60):
        long = prose[i].split() * 40
        cases = [wrapped(text, 75), wrapped(text, 60, " * "), " ".join([*long, text, *long])]
        found[text] = {family} == {model.families[f] for _, _, f, _ in model.find(cases)} and {0, 1, 2} == {k for k, _, _, _ in model.find(cases)}
    assert sum(found.values()) >= 0.95 * len(found), [k for k, v in found.items() if not v]
    short = {"License: BSD": "bsd", "Distributed under the MIT licence, see LICENSE.": "mit", "available under Apache-2.0": "apache-2.0", "# SPDX-License-Identifier: GPL-3.0-or-later": "gpl"}
    assert {t: {model.families[f] for _, _, f, _ in model.find([t])} for t in short} == {t: {f} for t, f in short.items()}
    assert not list(model.find([*prose, "She studied at MIT before she joined.", "The bsd was released.", "License fees are due under the terms of the contract."]))


def test_licence_confirmation_like_brute_force():
    model = licences.train([])
    rng = random.Random(10)
    for family, lines_ in TEMPLATES.items():
        f = model.families.index(family)
        for line in lines_.strip().split("\n"):
            own = licences.bare(line).split()
            words_ = [w for w in own if rng.random() > 0.2] or own
            have = set(zip(words_, words_[1:], strict=False))
            best = 0.0
            for other, wording in licences.wordings():
                w = [x.lower() for x in wording.split()]
                need = set(zip(w, w[1:], strict=False))
                if other == family and need:
                    best = max(best, len({(a.lower(), b.lower()) for a, b in have} & need) / len(need))
            got = model.share(f, licences._words([b" ".join(words_)])[0])
            assert abs(got - best) < 1e-9 or len(words_) < 2


BIG = 2**60 + 1


def test_ids_repeats_and_giant_texts(spark):
    """A null id beside one that no float holds, repeated ids, a text of 5 MB, one giant word, clashing names."""
    rng = random.Random(12)
    giant = " ".join(f"g{rng.randrange(10**6)}" for _ in range(700_000))
    rows = [(None, "a text without an id that is long enough to count as a line", "x", 1), (BIG, "one two three four five six", "x", 1), (BIG, "one two three four five six", "x", 1), (BIG, "another text", "x", 1),
            (7, giant, "x", 1), (8, "w" * 1_000_000, "x", 1), (9, None, "x", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(BIG, 1, 1), (7, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    ids = sorted((r[0] for r in rows), key=str)
    per_row = {
        "jaccard": jaccard.jaccard_groups(docs), "lines": lines.dedup_lines(docs), "toxicity": toxicity.toxicity_scores(docs, labels), "quality": quality.quality_scores(docs, labels),
        "licences": licences.licence_scan(docs), "pieces": pieces.piece_digests(docs, piece_model()), "tokens": token_counts.token_counts(docs, piece_model()),
        "pages": html_text.main_text(docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), F.col("_gone").alias("tokens"))).withColumnRenamed("page_id", "doc_id"),
    }
    for name, df in per_row.items():
        assert sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str) == ids, name
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in per_row["jaccard"].collect()}
    assert got[None, 10] == (None, True) and got[BIG, 2] == got[BIG, 1] == (BIG, True)
    assert per_row["pages"].filter("doc_id = 8").first()["n_chars"] == 1_000_000
    assert jaccard.keep_one_of_each(docs).count() == len(rows)
    assert leaks.contained_items(docs, spark.createDataFrame([(BIG, "one two three four five six"), (None, "another text")], "item_id long, text string")).collect()[0][:2] == (BIG, BIG)
    vec = [(None, [1.0, 0.0], "a"), (BIG, [1e200, 1e200], "a"), (BIG + 2, [1e-200, 1e-200], "a"), (3, [1.0, 1.0], "b"), (3, [1.0, 1.0], "b")]
    df = spark.createDataFrame(vec, "vec_id long, embedding array<double>, label string")
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect()) == sorted([("None", 0, None), (str(BIG), 1, BIG), (str(BIG + 2), 1, BIG), ("3", 1, 3), ("3", 1, 3)])


def test_vector_recall_on_dense_clusters(spark):
    """Clusters that fill a bucket beyond a block; every link found, in all tables together."""
    rng = np.random.default_rng(13)
    base = rng.standard_normal((5, 24))
    x = np.concatenate([b + rng.standard_normal((n, 24)) * 0.26 for b, n in zip(base, (2600, 300, 200, 100, 50), strict=True)]).astype(np.float32)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = np.array([r["n_links"] for r in vectors.near_vectors(df).orderBy("vec_id").collect()])
    assert (got <= true).all() and got.sum() >= 0.999 * true.sum() > 10_000


def test_many_unlinked_copies(spark):
    """Copies of a text that is not there itself, no two of them alike enough: all proven apart through leaders' differences, none linked but two."""
    rng = random.Random(14)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for _ in range(120):
        copy = base[:]
        for k in rng.sample(range(0, 200, 8), 5):
            copy[k] = f"n{rng.randrange(10**9)}"
        texts.append(" ".join(copy))
    texts.append(texts[3] + " more")
    sets = [shingle_set(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert 0 < len(links) < 40
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_groups(docs_of(spark, texts)).collect()}
    assert got == closure(range(len(texts)), links)


def test_pages_by_the_array_alone(spark):
    """Without any mark on them, menus and footers go as repeats of the host, and the articles stay."""
    rng = random.Random(15)
    menu = " ".join(f"menu{i}" for i in range(9))
    foot = " ".join(f"foot{i}" for i in range(30))
    art = {i: " ".join(f"a{rng.randrange(10**6)}" for _ in range(60)) for i in range(40)}
    rows = [(i, f"http://h/{i}", f"<div>{menu}</div><div>{t}</div>" + (f"<div>{foot}</div>" if i in (4, 9) else "")) for i, t in art.items()]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == art  # the long footer of two pages is a repeat, too
    quote = " ".join(f"q{i}" for i in range(11))
    rows = [(i, f"http://h/{i}", f"<div>{t} {quote if i in (4, 9) else ''}</div>") for i, t in art.items()]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[4] == f"{art[4]} {quote}"  # a short one of two pages is not


def test_suffix_ranks_like_brute_force():
    texts = ["a b c d e f g h i j k l m n", "x a b c d e f g h i j k l z", "a b c", "", "p q r s t u " * 20]
    for first, hashed, at in shingles.word_chunks(texts):
        where, ranks = html_text._ranks(hashed, at)
        flat = [w for t in texts for w in t.split()]
        ends = [int(at[k + 1]) for k in range(len(texts)) for _ in range(int(at[k + 1] - at[k]))]
        assert where.tolist() == [i for i in range(len(flat)) if ends[i] - i >= html_text.RUN]
        for length, rank in zip(html_text.LENGTHS, ranks, strict=True):
            by = defaultdict(set)
            for i, r in zip(where.tolist(), rank.tolist(), strict=True):
                by[tuple(flat[i : i + length]) if ends[i] - i >= length else None].add(r)
            assert all(len(v) == 1 for v in by.values()) and len(set().union(*by.values())) == len(by) and by.get(None, {0}) == {0}


def test_parser_is_linear_and_heads_go():
    def text(html):
        return html_text.settled(html)[0]

    assert text("<article><header>Menu head <nav>x</nav></header><p>x</article>") == "x"
    assert text("<article><header>by me <h1>The <b>title</b></h1> on Monday</header><p>x</article>") == "The title x"
    for piece in ("<b></i>", "<div><b>", "<p>x</b>", "<body><td>"):
        begun = time.process_time()
        html_text.blocks(piece * 40_000)
        assert time.process_time() - begun < 8, piece
