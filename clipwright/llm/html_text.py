"""Main text of web pages by host suffix arrays.

Each page is read once into blocks, and every block gets a role from its
markup: part of a marked article, boilerplate by its element or its class
(menus, headers, footers, sidebars, notices, adverts, forms, comments), or open.
What a main element holds is open, too, where no article outweighs it.
The tokens outside the marked article of all pages of a host form one stream
with breaks between pages.  Its suffixes are not sorted letter by letter: they
are grouped by equal prefixes of ``LENGTHS`` tokens, each known by a 64-bit hash
that is made from the hashes of its halves, as prefix doubling makes ranks.  A
group is a stretch of the host's suffix array with a common prefix so long; no
host needs to be in one place.

Suffixes of several distinct pages with a common prefix are a repeated
substring.  The longer it is, the fewer pages it needs to be boilerplate: a run
of ``RUN`` tokens two on a host of up to four distinct pages and one more with
each doubling of the host, a run of twice the length half as many and so on,
two at least.  Each suffix is covered as far as its longest such prefix; longer
repeats are covered by the suffixes within them.  Covered open tokens are
removed and unique runs kept.  Exact and near copies of a page (its article, or
else its open tokens) count as one page, found by banded least hashes of their
runs and closed to components, so that a page under two addresses does not lose
its text to itself.

The cover does not reach into a marked article: articles quote and repeat each
other, and what they share is still their text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import mapped, texts_of
from .components import components
from .shingles import _combine, mix, word_chunks
from .store import keep

#: Tokens that pages must share in a row, and the lengths at which suffixes are ranked.
RUN = 6
LENGTHS = (6, 12, 24, 48)
#: Pages with one of so many bands of least hashes in common are copies: nine tenths of runs in common are found but for 1e-4, a half in 6 of 100 cases.
#: The hashes come from one permutation cut into as many bins, an empty bin borrowing from the next filled one.
BANDS, BAND_ROWS = 16, 8
#: ``pos`` of a row that holds a page's host, and below it its bands.
AT_HOST = -1

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("article aside body div footer form header main nav section table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
OUT = frozenset("script style noscript template svg math head title iframe object canvas select option button textarea form nav aside footer dialog menu".split())
OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising alert alerts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice notices pagination pager popup promo promoted related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: What may stand before or after such a name in a compound: "site-header", "ad-slot", "comment-12".
NAME_PREFIXES = frozenset("site global top bottom left right primary secondary mobile user".split())
#: The same before any of these but the header or banner of an article, which hold its title.
ENTRY_PREFIXES = frozenset("article entry post main page".split())
TITLE_NAMES = frozenset("header banner masthead".split())
NAME_SUFFIXES = frozenset("area bar block box buttons container form holder icons item items links list menu overlay panel posts section slot unit wrap wrapper".split())
COMMENT_SUFFIXES = NAME_SUFFIXES | frozenset("author body content meta text thread".split())
#: Names whose content is theirs, too: "sponsored-content", but not "header-content".
AD_NAMES = frozenset("ad ads advert adverts advertisement advertising popup promo promoted sponsor sponsored".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
COMMENT_NAMES = frozenset("comment comments disqus replies reply respond".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: What a head may hold; anything else ends one that is left open.
HEAD_CONTENT = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
_PARTS = re.compile("[-_]+")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def named(value: str) -> str:
    """'c' if a class or id value names comments, 'n' if other boilerplate, else ''.

    A whole name counts, or a compound of names with the known prefixes and
    suffixes; a name inside another compound ("content-sidebar-wrap",
    "has-notice", "entry-header") says nothing of the element.
    """
    found = ""
    for name in value.lower().split():
        parts = [p for p in _PARTS.split(name) if p]
        while len(parts) > 1 and (parts[0] in NAME_PREFIXES or (parts[0] in ENTRY_PREFIXES and not TITLE_NAMES & set(parts))):
            parts = parts[1:]
        if parts and parts[0] in COMMENT_NAMES and all(p in COMMENT_SUFFIXES or p in OUT_NAMES or p.isdigit() for p in parts[1:]):
            return "c"
        more = COMMENT_SUFFIXES if parts and parts[0] in AD_NAMES else NAME_SUFFIXES
        if parts and parts[0] in OUT_NAMES and all(p in more or p in OUT_NAMES or p.isdigit() for p in parts[1:]):
            found = "n"
    return found


class _Reader(HTMLParser):
    """Blocks of one page: (role, tokens) with role 'a' in an article of a main element, 'e' in another, 'm' else in a main element, 'o' open, 'x' boilerplate.

    Inside, boilerplate that only a class or id names is 'c' (comments) or 'n',
    which a body or main element reopens; an article reopens 'n' and is 'b',
    as it may be the page's text or one of a list of others.  Of a header
    element within an article only its headings are the article's.

    Beside the open elements it keeps the places of each tag, of containers
    and the number of each role, so that no tag needs a walk over them.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []
        self.roles: Counter[str] = Counter()
        self.blocks: list[tuple[str, list[str]]] = []
        self.held: list[str] = []

    def _role(self) -> str:
        return self.stack[-1][1] if self.stack else "o"

    def _flush(self) -> None:
        if self.held:
            tokens = "".join(self.held).split()
            if tokens:
                role = self._role()
                self.blocks.append(("x" if role in "cnh" else role, tokens))
            self.held = []

    def _push(self, tag: str, role: str) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in CONTAINERS:
            self.walls.append(len(self.stack))
        self.roles[role] += 1
        self.stack.append((tag, role))

    def _cut(self, size: int) -> None:
        """Close all elements but the first ``size``."""
        while len(self.stack) > size:
            tag, role = self.stack.pop()
            self.places[tag].pop()
            self.roles[role] -= 1
            if tag in CONTAINERS:
                self.walls.pop()

    def _open(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def _end_head(self) -> None:
        if self.stack and self.stack[-1][0] == "head":
            self._cut(len(self.stack) - 1)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._flush()
        if tag == "body":
            if self._open("head"):
                self._cut(self.places["head"][0])
        elif tag not in HEAD_CONTENT:
            self._end_head()
        if tag in VOID:
            return
        if tag in ("p", "li", "dt", "dd", "td", "th", "tr", "option"):  # ended by the next of their kind
            self._end(tag, implied=True)
        role = now = self._role()
        if now != "x":
            a = {k: v or "" for k, v in attrs}
            name = named(f"{a.get('class', '')} {a.get('id', '')}")
            aria = a.get("role", "").lower()
            inside = self.roles["a"] + self.roles["e"] + self.roles["b"] > 0
            if tag == "article":
                role = "x" if inside or name == "c" else {"n": "b", "c": "c"}.get(now, "a" if self.roles["m"] else "e")
            elif tag in OUT or (tag == "header" and now == "o") or aria in OUT_ROLES or "hidden" in a or a.get("aria-hidden") == "true" or ("style" in a and _HIDDEN.search(a["style"])):
                role = "x"
            elif tag == "header" and now in "aebm":
                role = "h"
            elif now == "h":
                role = next(r for _, r in reversed(self.stack) if r != "h") if tag in HEADINGS else "h"
            elif tag == "body":
                role = "o" if now in "cn" else now
            elif tag == "html":
                role = now
            elif tag == "main" or aria == "main" or a.get("itemprop") == "articleBody":
                role = now if inside else "m"
            elif name and now != "c":
                role = name
            if role != now:
                self._flush()
        self._push(tag, role)

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self._flush()

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._flush()
        self._end(tag)

    def _end(self, tag: str, implied: bool = False) -> None:
        """Close the last such element, unless a container stands open within it that its end cannot close."""
        if not self._open(tag):
            return
        at = self.places[tag][-1]
        if (implied or tag not in CONTAINERS) and self.walls and self.walls[-1] > at:
            return
        if self._role() != (self.stack[at - 1][1] if at else "o"):
            self._flush()
        self._cut(at)

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self._end_head()
        self.held.append(data)

    def done(self) -> list[tuple[str, list[str]]]:
        self.close()
        self._flush()
        return self.blocks


def blocks(html: str | None) -> list[tuple[str, list[str]]]:
    if not html:
        return []
    reader = _Reader()
    reader.feed(html)
    return reader.done()


def settled(html: str | None) -> tuple[str | None, list[str], list[bool]]:
    """(text of the marked article or None, tokens outside it, which of these are open).

    An article within a main element goes before the rest of that element
    unless it is less than half of it; of that and the articles elsewhere the
    heavier is the page's text.  Where it is the main element's own text, its
    tokens are open and all else is outside.
    """
    found = blocks(html)
    size = {mark: sum(len(t) for r, t in found if r == mark) for mark in "aebm"}
    mark = "a" if size["a"] and 2 * size["a"] >= size["m"] else "m"
    mark = "e" if size["e"] > size[mark] else mark
    # an article under a boilerplate name is the page's text only where it outweighs what is marked without doubt
    mark = "b" if size["b"] > size[mark] else mark
    if size[mark] and mark != "m":
        return " ".join(w for r, t in found if r == mark for w in t), [w for r, t in found if r != mark for w in t], []
    if size["m"]:
        return None, [w for _, t in found for w in t], [r == "m" for r, t in found for _ in t]
    return None, [w for _, t in found for w in t], [r != "x" for r, t in found for _ in t]


_BINS = BANDS * BAND_ROWS
_BORROWED = mix(np.arange(1, _BINS + 1, dtype=np.uint64))


def _least(runs: np.ndarray) -> np.ndarray:
    """The least hash of each bin; an empty one has that of the next filled bin, marked by how far it is."""
    order = np.sort(mix(runs))
    at = (order >> np.uint64(64 - _BINS.bit_length() + 1)).astype(np.int64)
    filled, first = np.unique(at, return_index=True)
    ahead = np.searchsorted(filled, np.arange(_BINS)) % len(filled)
    gap = (filled[ahead] - np.arange(_BINS)) % _BINS
    return np.where(gap > 0, mix(order[first][ahead] ^ _BORROWED[gap]), order[first][ahead])


def _bands(runs: np.ndarray, host: np.uint64) -> np.ndarray:
    """A key for each band of a page's least hashes."""
    least = _least(runs).reshape(BAND_ROWS, BANDS).T  # bins far apart, which seldom borrow from one
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND_ROWS):
        key = mix(key + least[:, k])
    return mix(key ^ host)


def _ranks(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(places of suffixes of at least ``RUN`` tokens, their ranks at each length; 0 where the text ends before)."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    left = at[1:][owner] - np.arange(len(words))
    where = np.flatnonzero(left >= RUN)
    rank, ranks = _combine(words, RUN), []
    for length in LENGTHS:
        if ranks:  # of twice the length: this rank and that of the second half
            half = length // 2
            rank = mix(rank[: max(len(rank) - half, 0)] * np.uint64(3) + rank[half:])
        ranks.append(np.where(left[where] >= length, rank[np.minimum(where, max(len(rank) - 1, 0))] if len(rank) else np.uint64(0), np.uint64(0)))
    return where, ranks


_PARSED = "page long, page_id long, url string, host long, main string, outside string, open binary"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Each page with its article or, where it has none, which of its tokens are open."""
    for batch in batches:
        found = [settled(h) for h in texts_of(batch, "html")]
        yield {"page": batch.column("page"), "page_id": batch.column("page_id"), "url": batch.column("url"), "host": batch.column("host"), "main": [f[0] for f in found],
               "outside": [" ".join(f[1]) for f in found], "open": [None if f[0] is not None else np.packbits(np.array(f[2], bool)).tobytes() for f in found]}


def _open(outside: str, marks: bytes) -> tuple[list[str], np.ndarray]:
    words = outside.split(" ") if outside else []
    return words, np.unpackbits(np.frombuffer(marks, np.uint8), count=len(words)).astype(bool)


def _own_text(main: str | None, outside: str, marks: bytes | None) -> str:
    return main if main is not None else " ".join(w for w, o in zip(*_open(outside, marks), strict=True) if o)


_SUFFIX = "key long, page long, pos int, r12 int, r24 int, r48 int, loose boolean"


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Each suffix outside the articles with its host's key at the first length and its ranks at the others; each page's host and bands at places below 0."""
    for batch in batches:
        streams, marks = texts_of(batch, "outside"), texts_of(batch, "open")
        loose = np.array([m is not None for m in marks], bool)
        hosts = batch.column("host").to_numpy().view(np.uint64)
        pages = batch.column("page").to_numpy()
        for first, words, at in word_chunks(streams):
            where, ranks = _ranks(words, at)
            own = np.searchsorted(at, where, side="right") - 1
            r12, r24, r48 = ((r >> np.uint64(32)).astype(np.uint32).view(np.int32) for r in ranks[1:])
            yield {"key": mix(ranks[0] ^ hosts[first + own]).view(np.int64), "page": pages[first + own], "pos": (where - at[own]).astype(np.int32), "r12": r12, "r24": r24, "r48": r48, "loose": loose[first + own]}
        bodies = [_own_text(*row) for row in zip(texts_of(batch, "main"), streams, marks, strict=True)]
        places = np.arange(AT_HOST, AT_HOST - BANDS - 1, -1, dtype=np.int32)
        none = np.zeros(BANDS + 1, np.int32)
        for first, words, at in word_chunks(bodies):
            for k in range(len(at) - 1):
                own, host = words[at[k] : at[k + 1]], hosts[first + k]
                if not len(own):  # a page without text of its own is no evidence of repeats
                    continue
                runs = np.unique(_combine(own, min(RUN, len(own))))
                keys = np.concatenate((np.array([host], np.uint64), _bands(runs, host)))
                yield {"key": keys.view(np.int64), "page": np.full(len(keys), pages[first + k]), "pos": places, "r12": none, "r24": none, "r48": none, "loose": none.astype(bool)}


def _distinct_pages(rows: DataFrame) -> DataFrame:
    """(page, copy_of, need): the page that stands for its copies, and on how many distinct pages of its host a run is a repeat."""
    bands = rows.filter(F.col("pos") < AT_HOST).select("key", "page")
    shared = bands.groupBy("key").agg(F.min("page").alias("lo"), F.max("page").alias("hi")).filter("lo <> hi").select("key", "lo")
    same = components(bands.join(shared, "key").filter("page <> lo").select("page", "lo").distinct(), "page", "lo").df
    at = rows.filter(F.col("pos") == AT_HOST).select(F.col("key").alias("host"), "page").distinct()
    pages = at.join(same.withColumnsRenamed({"node": "page", "component": "copy_of"}), "page", "left").withColumn("copy_of", F.coalesce("copy_of", "page"))
    need = pages.select("host", "copy_of").distinct().groupBy("host").agg(F.greatest(F.lit(2), F.ceil(F.log2(F.count("*")))).alias("need"))
    return pages.join(need, "host").select("page", "copy_of", "need")


def _unique_runs(outside: pd.Series, marks: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.Series:
    """The open tokens that no repeated run covers."""
    out = []
    for text, open_, begins, sizes in zip(outside, marks, starts, lengths, strict=True):
        words, stay = _open(text, open_)
        for p, n in zip(begins, sizes, strict=True) if begins is not None else ():
            stay[p : p + n] = False
        out.append(" ".join(w for w, s in zip(words, stay, strict=True) if s))
    return pd.Series(out, dtype=object)


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_repeated) for each row of ``pages``.

    ``n_repeated`` counts the suffixes of a page without an article that begin
    with a repeated run.  Null or empty html gives an empty text.  Pages without a
    usable host share the empty one.  Every row is a page of its own, also
    where ids are null or repeat.  Other columns are ignored.
    """
    host = F.xxhash64(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1)))
    plain = pages.select(F.monotonically_increasing_id().alias("page"), F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    parsed = keep(mapped(plain.withColumn("host", host), _parsed, _PARSED))
    suffixes = keep(mapped(parsed.df.select("page", "host", "main", "outside", "open"), _suffixes, _SUFFIX))
    runs = suffixes.df.filter("pos >= 0")
    several = runs.groupBy("key").agg(F.min("page").alias("lo"), F.max("page").alias("hi")).filter("lo <> hi").select("key")
    found = keep(runs.join(several, "key"))
    pages_of = keep(_distinct_pages(suffixes.df))
    suffixes.drop()
    # a suffix has a prefix of each length that it reaches; a prefix is known by its host, its length and its rank
    ranks = "filter(array(struct(6 as length, key as prefix), struct(12 as length, xxhash64(key, r12) as prefix), struct(24 as length, xxhash64(key, r12, r24) as prefix), struct(48 as length, xxhash64(key, r12, r24, r48) as prefix)), x -> x.length = 6 or (x.length = 12 and r12 <> 0) or (x.length = 24 and r24 <> 0) or (x.length = 48 and r48 <> 0))"
    each = F.explode(F.expr(ranks)).alias("p")
    # pages take the place of their copies while a suffix is still one row
    seen = found.df.join(pages_of.df.hint("merge"), "page").select("copy_of", "need", each).select("p.length", "p.prefix", "copy_of", "need").distinct()
    enough = F.greatest(F.lit(2), F.ceil(F.col("need") * LENGTHS[0] / F.col("length")))
    repeated = keep(seen.groupBy("length", "prefix").agg(F.count("copy_of").alias("n"), F.min("need").alias("need")).filter(F.col("n") >= enough).select("length", "prefix"))
    prefixes = found.df.filter("loose").select("page", "pos", each).select("page", "pos", "p.*")
    longest = prefixes.join(repeated.df, ["length", "prefix"]).groupBy("page", "pos").agg(F.max("length").alias("length"))
    cover = keep(longest.groupBy("page").agg(F.collect_list("pos").alias("starts"), F.collect_list("length").alias("lengths")))
    found.drop()
    pages_of.drop()
    repeated.drop()
    # pages with an article stay where they are: repeats leave it alone
    whole = parsed.df.filter("main is not null").select("page_id", "url", F.col("main").alias("text"), F.lit(0).cast("long").alias("n_repeated"))
    # one plan at every size: a small side would be broadcast below some size and the texts shuffled above it
    joined = parsed.df.filter("main is null").select("page", "page_id", "url", "outside", "open").join(cover.df.hint("merge"), "page", "left")
    text = F.coalesce(F.pandas_udf(_unique_runs, "string")("outside", "open", "starts", "lengths"), F.lit(""))
    rest = joined.select("page_id", "url", text.alias("text"), F.coalesce(F.size("starts"), F.lit(0)).cast("long").alias("n_repeated"))
    return whole.unionByName(rest).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")
