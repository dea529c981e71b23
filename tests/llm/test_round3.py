"""Quality rules, centroid clusters and token alignment against brute force, with awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from clipwright.llm import alignment, centroids, html_text, lines, quality, quality_rules
from clipwright.llm.queries import byte_model, piece_model

DOCS = "doc_id long, text string, row int, pairs string, rule string, q int"


def docs_of(spark, texts):
    """With extra columns whose names clash with those used inside; ids repeat and are null now and then."""
    ids = [None if i == 3 else i // 2 * 2 if i < 8 else i for i in range(len(texts))]
    return spark.createDataFrame([(i, t, 1, "p", "r", 2) for i, t in zip(ids, texts, strict=True)], DOCS), ids


def awkward():
    rng = random.Random(5)
    prose = [" ".join(rng.choice(["lorem", "ipsum", "dolor", f"w{rng.randrange(400)}", "Émile", "don't", "x.", "12"]) for _ in range(rng.randrange(1, 160))) for _ in range(25)]
    long_text = "\n".join(" ".join(f"t{rng.randrange(5000)}" for _ in range(40)) for _ in range(400))
    return [None, "", " \t\n ", "one", "one two", "a b c a b c", "A\nA\n\n A\nA", *prose, *prose[:2], "##$ *% " * 30, "SHOUT LOUD NOW " * 20 + "\n", "| a | b " * 40, "x " * 60, long_text, "é" * 300, "a\x85b c　d \x0b e"]


def measures_of(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    rows = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(rows) - len(set(rows)), len(covered), w, rows


def kept_of(text):
    n, chars, symbols, dup, rep, w, rows = measures_of(text)
    letterless = sum(not re.search(r"[A-Za-z]|[^\x00-\x7f]", x) for x in w)
    shouted = sum(len(re.findall("[A-Z]", x)) > 1 and not re.search("[a-z]", x) for x in w)
    base = n < 50 or 100 * rep > 50 * n
    return base, not base and 3 * n <= chars <= 10 * n and 10 * symbols <= n and 100 * dup <= 50 * len(rows) and 100 * letterless <= 30 * n and 100 * shouted <= 50 * n and 100 * Counter(w).most_common(1)[0][1] <= 30 * n


def test_rules_like_brute_force(spark):
    texts = awkward()
    docs, ids = docs_of(spark, texts)
    got = sorted(map(str, quality_rules.contract_rows(docs).collect()))
    want = []
    for i, t in zip(ids, texts, strict=True):
        n, chars, symbols, dup, rep, _, _ = measures_of(t)
        base, kept = kept_of(t)
        want.append(f"Row(doc_id={i}, n_words={n}, word_chars={chars}, n_symbols={symbols}, n_dup_lines={dup}, n_repeat_words={rep}, base_failed={base}, kept={kept})")
    assert got == sorted(want)
    kept = quality_rules.without_rejected(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r["text"] for r in kept.collect()))) == sorted(str(t) for t in texts if kept_of(t)[1])


def test_rules_in_any_order(spark):
    docs, _ = docs_of(spark, awkward())
    one = {(str(r["doc_id"]), r["n_words"], r["kept"]) for r in quality_rules.quality_rules(docs).collect()}
    assert one == {(str(r["doc_id"]), r["n_words"], r["kept"]) for r in quality_rules.quality_rules(docs, tuple(reversed(quality_rules.RULES)), ("n_words",)).collect()}


def test_rule_order_is_greedy_by_rejections_for_cost():
    rules = tuple(quality_rules.Rule(n, lambda t: False) for n in "abcd")
    # a rejects rows 0-5 at cost 6, b rows 0-3 at 1, c row 9 at 1, d nothing at 0.5
    bits = np.array([3, 3, 3, 3, 1, 1, 0, 0, 0, 4])
    order = quality_rules.ordered(rules, bits, [6.0, 1.0, 1.0, 0.5])
    assert [a.rule.name for a in order] == ["b", "c", "a", "d"]
    assert [round(a.rejects, 3) for a in order] == [0.4, round(1 / 6, 3), 0.4, 0.0]
    assert [a.rule.name for a in quality_rules.ordered(rules, np.zeros(0, np.int64), [0.0] * 4)] == list("abcd")


def test_cascade_asks_no_more_after_a_rejection():
    asked = []
    rules = tuple(quality_rules.Rule(str(i), lambda t, i=i: asked.append(i) or i == 1) for i in range(4))
    rule, n = quality_rules.verdict(quality_rules.Text("some text"), rules)
    assert (rule.name, n, asked) == ("1", 2, [0, 1])
    t = quality_rules.Text("x")
    quality_rules.verdict(t, quality_rules.RULES)  # too few words: nothing dearer is worked out
    assert "n_repeat_words" not in t.__dict__ and "lines" not in t.__dict__


def test_rule_order_from_a_table(spark):
    docs, _ = docs_of(spark, ["# # # " * 40] * 30 + ["plain words of a text " * 2] * 30 + [" ".join(f"word{i}x{j}" for i in range(60)) for j in range(30)])
    found = quality_rules.rule_order(docs)
    assert {a.rule.name for a in found} == {r.name for r in quality_rules.RULES}
    assert found[0].rejects >= 1 / 3 and found[-1].rejects == 0


def clusters_of(rows, k=16, rounds=3):
    good = [(i, [math.floor(64 * float(x)) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    cents = [q for _, q in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in good if i is not None)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(cents)) for _, q in good]

    for _ in range(rounds):
        members = defaultdict(list)
        for (_, n), (_, q) in zip(assign(), good, strict=True):
            members[n].append(q)
        for n, qs in members.items():
            cents[n] = [sum(x) // len(qs) for x in zip(*qs, strict=True)]
    found = assign()
    per = Counter()
    for d, n in found:
        per[n] += d
    return sorted(str((i, n, d, per[n], sum(per.values()), hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest())) for (i, _), (d, n) in zip(good, found, strict=True))


@pytest.mark.parametrize("n,groups", [(300, 9), (5, 2), (40, 1)])
def test_clusters_like_brute_force(spark, n, groups):
    rng = np.random.default_rng(n)
    centres = rng.standard_normal((groups, 64))
    rows = [(int(i), (centres[i % groups] + 0.2 * rng.standard_normal(64)).astype(np.float32).tolist()) for i in range(n)]
    if n == 40:
        rows = [(i, [0.0 if i % 2 else -0.01] * 64) for i in range(n)]  # ties, and clusters that stay empty
    rows += [(1000, None), (1001, []), (1002, [0.5] * 63), (1003, [0.5] * 63 + [None]), (1004, [float("nan")] + [0.1] * 63), (1005, [float("inf")] + [0.1] * 63), (None, [0.25] * 64), (rows[0][0], rows[0][1]), (2, [-0.0] * 64)]
    table = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], "vec_id long, embedding array<float>, label int, cluster string")
    got = sorted(str(tuple(r)) for r in centroids.centroid_clusters(table).collect())
    assert got == clusters_of(rows)


def test_clusters_of_nothing_and_of_too_much(spark):
    kind = "vec_id long, embedding array<double>, label int"
    assert centroids.centroid_clusters(spark.createDataFrame([], kind)).collect() == []
    assert centroids.centroid_clusters(spark.createDataFrame([(1, [1.0] * 3, 1)], kind)).collect() == []
    with pytest.raises(Exception, match="beyond"):
        centroids.centroid_clusters(spark.createDataFrame([(1, [1e9] * 64, 1)], kind)).collect()


def test_pivots_rule_out_centroids_and_change_nothing():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 64)) / 8
    q = np.floor(64 * (centres[rng.integers(40, size=3000)] + 0.02 * rng.standard_normal((3000, 64)))).astype(np.int64)
    first = q[:16]
    pivots = np.concatenate((first, centroids.far_apart(q[100:600], 8)))
    stored = centroids.to_each(q, pivots)
    for cents in (first, np.stack([q[i::16].sum(axis=0) // len(q[i::16]) for i in range(16)]), q[16:32]):
        full = centroids.to_each(q, cents)
        cluster, distance, exact = centroids.nearest(q, stored, pivots, cents)
        assert (cluster == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
        assert exact <= 16 * len(q)
    assert centroids.nearest(q, stored, pivots, first)[2] < 1.01 * len(q)  # a centroid that is a pivot is known at once, but for ties
    assert centroids.nearest(q, stored, pivots, q[16:32])[2] < 10 * len(q)


def aligned_of(texts):
    """Whole texts through both libraries, with ends from decoded bytes alone."""
    both = alignment.Pair(byte_model(), piece_model())
    out, counts = [], Counter()
    for t in texts:
        a = both.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = both.b.encode(t) if t else []
        raw = (" " + t).encode() if t else b""
        if not t or b"".join(both.bytes_a[i] for i in a) != raw or b"".join(both.bytes_b[i] for i in b) != raw:
            out.append(None)
            continue
        i = j = at_a = at_b = 0
        left, right, groups, links = [], [], [], Counter()
        while i < len(a):
            end_a, end_b = at_a + len(both.bytes_a[a[i]]), at_b + len(both.bytes_b[b[j]])
            links[a[i], b[j]] += 1
            if end_a <= end_b:
                left.append(a[i])
            if end_b <= end_a:
                right.append(b[j])
            if end_a <= end_b:
                i, at_a = i + 1, end_a
            if end_b <= end_a:
                j, at_b = j + 1, end_b
            if at_a == at_b:
                groups.append((at_a, left, right))
                left, right = [], []
        counts.update(links.keys())
        out.append((len(a), len(b), groups, links))
    top = Counter()
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    rows = []
    for got in out:
        if not got:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        na, nb, groups, links = got
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for _, x, y in groups)
        rows.append((na, nb, len(groups), sum(links.values()), sum(k for p, k in links.items() if counts[p] == top[p[0]]), sum(k * counts[p] for p, k in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return rows, out


ODD = ["hi é😀  x\n​", "ĀĀ <|endoftext|> é́ \xa0 x y", "▁ab", "   ", "\n\n a  b ", "日本語テキスト 😀😀 text 　 x", "a'll b's 're", "\x00 a \x01", "<s> a </s> <unk> <0x0A>", "tab\tand\x0bmore \x85", "x" * 400, "😀" * 50, "fin .", " lead", "a ́b ᠎c"]


@pytest.mark.parametrize("common", [0, 40, 1 << 18])
def test_alignment_like_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(alignment, "COMMON", common)
    texts = awkward() + ODD
    docs, ids = docs_of(spark, texts)
    got = sorted(map(str, (tuple(r) for r in alignment.aligned_tokens(docs, byte_model(), piece_model()).collect())))
    assert got == sorted(str((i, *row)) for i, row in zip(ids, aligned_of([t or "" for t in texts])[0], strict=True))


def test_token_groups_cover_the_bytes(spark):
    texts = awkward() + ODD
    docs, _ = docs_of(spark, texts)
    want = {t or "": got for t, got in zip(texts, aligned_of([t or "" for t in texts])[1], strict=True)}
    rows = alignment.token_groups(docs.select("doc_id", "text"), byte_model(), piece_model()).collect()
    assert len(rows) == len(texts)
    for r in rows:
        expected = want[r["text"] or ""]
        if expected is None:
            assert r["groups"] is None
            continue
        assert [(g["end"], g["a"], g["b"]) for g in r["groups"]] == expected[2]
        assert [g["begin"] for g in r["groups"]] == [0, *[g["end"] for g in r["groups"]][:-1]]
    with pytest.raises(ValueError):
        alignment.token_groups(docs.withColumnRenamed("row", "Groups"), byte_model(), piece_model())


def test_chunks_never_change_tokens(monkeypatch):
    whole, cut = alignment.Pair(byte_model(), piece_model()), alignment.Pair(byte_model(), piece_model())
    whole.cuts = False
    assert cut.cuts
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    texts = [t for t in awkward() + ODD if t]
    for t, one, many in zip(texts, alignment._aligned_texts(whole, texts), alignment._aligned_texts(cut, texts), strict=True):
        assert (one is None) == (many is None), t
        if one:
            assert one[0].digest == ";".join(c.digest for c in many)
            assert one[0].links == b"".join(c.links for c in many)


def test_ends_inside_characters_come_from_bytes():
    # two tokens share the character of bytes 1-4: both offsets say 4, the first ends at 3
    assert alignment.refined(np.array([1, 4, 4, 5]), np.array([1, 2, 1, 1])).tolist() == [1, 3, 4, 5]
    # an offset that leaves out a trailing space is no cut
    assert alignment.refined(np.array([2, 3, 6]), np.array([2, 2, 2])).tolist() == [2, 4, 6]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules.contract_rows(none).collect() == []
    assert alignment.aligned_tokens(none, byte_model(), piece_model()).collect() == []


def own_text(html):
    main, tokens, open_ = html_text.settled(html)
    return main if main is not None else " ".join(w for w, o in zip(tokens, open_, strict=True) if o)


def test_main_or_article_by_weight():
    body = " ".join(f"w{i}" for i in range(60))
    teaser = "<article><h2>Teaser {0}</h2></article>"
    assert own_text(f"<main><p>{body}</p></main>{teaser.format('one')}{teaser.format('two')}") == body
    assert own_text(f"{teaser.format('one')}<main><p>{body}</p></main>") == body
    assert own_text(f"<main><p>{body}</p>{teaser.format('one')}</main>") == body
    assert own_text(f"<main><p>by me</p><article>{body}</article></main>{teaser.format('x')}") == body
    assert own_text(f"<main>short</main><article>{body}</article>") == body


def test_adverts_notices_and_hidden_parts_go():
    for name in ("advertisement-wrapper", "sponsored-content", "alert", "popup-overlay", "ads-container", "user-comments"):
        assert own_text(f"<div>open</div><div class='{name}'>out</div>") == "open", name
        assert own_text(f"<article>in<div class='{name}'>out</div></article>") == "in", name
    for style in ("display:none", "color:red; DISPLAY : none", "visibility:hidden"):
        assert own_text(f"<article>in<p style='{style}'>out</p></article>") == "in"
    for name in ("header-content", "content-wrapper", "alerting", "main-container", "user-profile", "display-none"):
        assert own_text(f"<article>in<div class='{name}' style='display:block'>in</div></article>") == "in in", name


def cover_of(pages):
    """Open tokens left of pages (host, tokens) with nothing marked, none a copy of another."""
    hosts = defaultdict(list)
    for i, (host, _) in enumerate(pages):
        hosts[host].append(i)
    left = {}
    for own in hosts.values():
        need = max(2, math.ceil(math.log2(len(own)))) if own else 2
        seen = defaultdict(set)
        for i in own:
            w = pages[i][1]
            for n in html_text.LENGTHS:
                for p in range(len(w) - n + 1):
                    seen[tuple(w[p : p + n])].add(i)
        for i in own:
            w, stay = pages[i][1], [True] * len(pages[i][1])
            for n in html_text.LENGTHS:
                for p in range(len(w) - n + 1):
                    if len(seen[tuple(w[p : p + n])]) >= max(2, math.ceil(need * html_text.LENGTHS[0] / n)):
                        stay[p : p + n] = [False] * n
            left[i] = " ".join(x for x, s in zip(w, stay, strict=True) if s)
    return left


def test_cover_like_brute_force(spark):
    """Texts of open pages and main elements against counts of every run of the given lengths."""
    rng = random.Random(11)
    parts = [[f"p{k}x{i}" for i in range(n)] for k, n in enumerate((5, 6, 7, 11, 12, 13, 25, 30, 49, 60))]
    pages = []
    for i in range(60):
        words = [f"own{i}x{j}" for j in range(80)]
        for part in rng.sample(parts, rng.randrange(4)):
            at = rng.randrange(len(words))
            words[at:at] = part[rng.randrange(2) :]
        pages.append((f"h{i % 3}", words))
    rows = [(i, f"http://{h}/{i}", f"<main>{' '.join(w)}</main>" if i % 2 else f"<div>{' '.join(w)}</div>") for i, (h, w) in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = cover_of(pages)
    assert got == want and any(len(want[i].split()) < len(pages[i][1]) for i in want)


def twin_prints(n):
    """Pairs of lines whose keys have one fingerprint and one place in a filter of the least size."""
    made, by = lines.filter_of(np.zeros(0, np.int64)), {}
    pairs, i = [], 0
    while len(pairs) < n:
        line = f"a line that is planted under number {i} and is long enough"
        h = np.array([lines._digest(lines.line_key(line))[0]], np.int64)
        mark = tuple(int(x[0]) for x in made._places(h)[:2])
        if mark in by:
            pairs.append((by.pop(mark), line))
        else:
            by[mark] = line
        i += 1
    return pairs


def test_deletion_takes_the_fingerprint_of_its_own_filter(spark):
    """Twins of one fingerprint in two filters: the later one's deletion must not forget the earlier one."""
    pairs = twin_prints(6)
    fill = [f"filler line number {i} which is long enough to be counted as well" for i in range(60)]
    index = lines.LineIndex(spark)
    index.insert(spark.createDataFrame([(1, "\n".join([a for a, _ in pairs] + fill))], "doc_id long, text string"))
    second = [f"another filler {i} that makes the filter grow to one more generation" for i in range(60)]
    index.insert(spark.createDataFrame([(2, "\n".join([b for _, b in pairs] + second))], "doc_id long, text string"))
    assert index.filters.df.count() > 1
    index.delete(spark.createDataFrame([(2,)], "doc_id long"))
    held = np.array([lines._digest(lines.line_key(a))[0] for a, _ in pairs] + [lines._digest(lines.line_key(x))[0] for x in fill], np.int64)
    filters = [lines.CuckooFilter.of_bytes(bytes(r["cuckoo"])) for r in index.filters.df.collect()]
    assert np.any([f.contains(held) for f in filters], axis=0).all()
    for i in range(10, 14):  # one more document each, up to five
        index.insert(spark.createDataFrame([(i, "\n".join(a for a, _ in pairs))], "doc_id long, text string"))
    assert index.repeated().count() == len(pairs)
    index.delete(spark.createDataFrame([(i,) for i in (1, *range(10, 14))], "doc_id long"))
    assert index.totals().count() == 0
    assert not any(np.frombuffer(bytes(r["cuckoo"]), np.uint16).any() for r in index.filters.df.collect())
    index.insert(spark.createDataFrame([(i, pairs[0][0]) for i in range(5)], "doc_id long, text string"))
    assert [r["max_doc"] for r in index.repeated().collect()] == [4]
    index.close()


def test_quality_is_the_bradley_terry_optimum():
    """The gradient of the pairs' logistic loss, summed by plain loops, is zero at the learned weights, and the cut is a quantile of the scores."""
    rng = random.Random(13)
    texts = [" ".join(f"{rng.choice(['lorem', 'ipsum', 'dolor'])}{rng.choice(['', '', '###' if i % 3 == 0 else '.'])}" for _ in range(rng.randrange(5, 60))) for i in range(120)]
    y = np.array([int(i % 3 > 0) for i in range(120)])
    model = quality.train(texts, y, 2 / 3, seed=5)
    z = np.clip((np.array([quality.features(t) for t in texts]) - model.mean) / model.scale, -8, 8)
    draw = np.random.default_rng(5)
    pairs = list(zip(draw.choice(np.flatnonzero(y == 1), quality.PAIRS), draw.choice(np.flatnonzero(y == 0), quality.PAIRS), strict=True))
    gradient = [-quality.RIDGE * w for w in model.weight]
    for a, b in pairs:
        d = [p - q for p, q in zip(z[a], z[b], strict=True)]
        p = 1 / (1 + math.exp(-min(max(sum(w * x for w, x in zip(model.weight, d, strict=True)), -40), 40)))
        gradient = [g + (1 - p) * x for g, x in zip(gradient, d, strict=True)]
    assert max(map(abs, gradient)) < 1e-3 * len(pairs)
    scores = model.scores(texts)
    order = np.argsort(model.strengths(texts), kind="stable")
    assert (np.diff(scores[order]) >= 0).all()
    assert abs((scores < quality.THRESHOLD).mean() - 1 / 3) < 0.06
    assert len(set(model.scores([texts[0]] * 3 + [""] + [""]).tolist())) == 2


def test_contained_items_take_few_texts_at_a_time(monkeypatch):
    """A task holds a slice of a batch as Python strings, and a hit keeps its own id."""
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from clipwright.llm import leaks
    from clipwright.llm.shingles import shingle_sets

    held, texts_of = [], leaks.texts_of
    monkeypatch.setattr(leaks, "texts_of", lambda batch, *a: held.append(batch.num_rows) or texts_of(batch, *a))
    item = "one two three four five six seven"
    sets = next(shingle_sets([item])).astype(np.uint64)
    items = leaks.Items([{"item_id": 5, "width": 5, "n": len(sets), "shingles": sets.tobytes()}])
    texts = [f"x {item} y" if i % 300 == 7 else f"plain words of row {i} and no more of them" for i in range(1000)]
    found = list(leaks._search(SimpleNamespace(value=items))(iter([pa.RecordBatch.from_pydict({"doc_id": pa.array(range(10, 1010), pa.int64()), "text": texts})])))
    assert [(i, d) for f in found for i, d in zip(f["item_id"], f["doc_id"])] == [(5, 10 + i) for i in range(1000) if i % 300 == 7]
    assert sum(held) == 1000 and max(held) <= leaks.SLICE


def test_quality_learns_from_all_pairs():
    """The gradient over every pair of a good and a bad text, by plain loops, is zero; a few texts are not left to chance."""
    rng = random.Random(17)
    texts = [" ".join(f"{rng.choice(['lorem', 'ipsum', 'dolor', 'sit'])}{rng.choice(['', '.', '##' if i % 4 == 0 else ','])}" for _ in range(rng.randrange(3, 40))) for i in range(90)]
    y = np.array([int(i % 4 > 0) ^ (i % 11 == 0) for i in range(90)])  # not separable
    model = quality.train(texts, y, 0.7)
    z = np.clip((np.array([quality.features(t) for t in texts]) - model.mean) / model.scale, -8, 8).tolist()
    good, bad = [x for x, of in zip(z, y, strict=True) if of == 1], [x for x, of in zip(z, y, strict=True) if of == 0]
    gradient = [0.0] * len(model.weight)
    for g in good:
        for h in bad:
            d = [p - q for p, q in zip(g, h, strict=True)]
            miss = 1 / (1 + math.exp(sum(w * x for w, x in zip(model.weight, d, strict=True))))
            gradient = [s + miss * x for s, x in zip(gradient, d, strict=True)]
    scale = quality.PAIRS / (len(good) * len(bad))
    assert max(abs(scale * g - quality.RIDGE * w) for g, w in zip(gradient, model.weight, strict=True)) < 1e-3


def test_equal_texts_have_equal_scores_at_any_place():
    rng = random.Random(19)
    texts = [" ".join(rng.choice(["lorem", "ipsum.", "Dolor", "s1t"]) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    model = quality.train(texts, np.arange(40) % 2, 0.5)
    alone = [model.scores([t])[0] for t in texts]
    for n in (2, 3, 7, 16, 40):
        assert [s for i in range(0, 40, n) for s in model.scores(texts[i : i + n]).tolist()] == alone
