"""Main text of web pages, with boilerplate found by what a host repeats.

1. Each page becomes blocks of text. Markup that can hold nothing else (menus,
   footers, sidebars, forms, scripts) drops a block at once, and so does a place
   outside the article where a page has one. All other blocks are candidates. An
   element around the article, or around most of a page that has none, is a wrapper
   and drops nothing, whatever its name; words of buttons and labels in a sentence stay.
2. Host suffix array: the candidates of a host are one stream of tokens, and each
   token starts a suffix. A task sorts the suffixes of its pages by host and first
   LONG tokens; neighbours that agree in these are an interval, with the pages it
   comes from. Intervals of all tasks are merged. A stretch longer than LONG is a row of
   such intervals, each a token on from the one before, so cover by them is cover by it. A
   stretch is repeated if distinct pages, PAGES or more, hold it, and common if HALF
   of its host's pages do. A whole block is a stretch of its own; a page counts once, whatever blocks hold the stretch, and so
   do rows of one host with equal html. Blocks under LONG tokens are suffixes as a whole.
   Within an article's own paragraphs only common stretches count, so only suffixes that
   may be common are in the array: each page marks the buckets (SPOTS a host) that its suffixes
   fall in, buckets are counted by pages, and a suffix whose bucket fewer pages mark than make a
   stretch common can't be common itself. No suffix that is common is left out.
3. A block of which repeated stretches cover MOST of the tokens is boilerplate. In
   an article's own paragraphs, which may quote each other, only common stretches
   count. If that leaves under LEFT of the candidates' tokens, the page is a copy of
   others rather than a frame around a text of its own, and only common stretches
   count anywhere; if still nothing is left, all candidates stay.

Markup thus settles ties: it drops what is boilerplate by definition, and sets how
much repetition a block may have. Class names drop a block inside an article only if
a whole name says comments, adverts, sharing or the like; otherwise they only lower
the bar to that of open text.

Edge cases: null or empty html gives an empty text; a null url is a host of its
own; repeated rows, and pages of a host with equal html, count as one page, and each keeps its text; very long pages
are parsed once each, in time linear in their length; an empty table stays empty;
input columns beyond page_id, url and html are not carried; stretches that tie are
one stretch, whichever page has them first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlore.llm.common import marked, read, stash

#: Production parameters: tokens that must agree, pages that must share them, the window of `sampled`.
LONG, PAGES, WINDOW = 8, 3, 24
#: Buckets of a host that suffixes of its articles' paragraphs are counted in before they are listed.
SPOTS = 4096
#: Shares: of a host's pages for common stretches, of a block's tokens, of a page's tokens.
HALF, MOST, LEFT = 0.5, 0.5, 0.2
#: Elements without visible text of the page.
SILENT = frozenset("head script style noscript template iframe svg object embed canvas audio video map datalist select textarea".split())
#: Elements that are not the article's, in themselves or where they don't hold it; and words of forms, which are text where they stand in a sentence.
FRAMES, WRAPPERS, FORM_WORDS = frozenset("nav footer aside menu".split()), frozenset("form fieldset dialog".split()), frozenset("button label".split())
BOILERPLATE = FRAMES | WRAPPERS
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figcaption".split())
BLOCKS = CONTENT | BOILERPLATE | frozenset("html body article main section div header ul ol dl table thead tbody tfoot tr figure hr address details summary center".split())
CLOSED_BY_BLOCK = BLOCKS - frozenset("html body".split())
#: Whole names (class, id, role) of what is never an article's text.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle ad-slot ad-container ad-banner sponsored sponsor promo comment comments comment-list comments-area comments-section comment-section disqus disqus_thread respond replies"
    " cookie-banner cookie-notice cookie-consent cookies consent gdpr newsletter newsletter-signup subscribe share sharing share-buttons share-bar social social-share sidebar nav navbar navigation breadcrumb breadcrumbs"
    " pagination pager footer site-footer site-header masthead toolbar contentinfo complementary".split()
)
#: Parts of names that hint at it.
WEAK = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices banner popup modal overlay newsletter subscribe subscription"
    " share sharing social sidebar related recommended recommendations comment comments disqus respond replies breadcrumb breadcrumbs menu nav navbar navigation footer contentinfo complementary masthead toolbar"
    " pagination pager login signin signup search dialog alert widget skip paywall".split()
)
_SPLIT = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: What markup says of a block.
DROP, OWN, OPEN = 0, 1, 2


class Held:
    """An open or closed element that markup says something of: what that is, its text, and the articles in it."""

    __slots__ = ("frame", "says", "chars", "articles")

    def __init__(self, frame: bool, says: tuple[bool, bool, bool]):
        self.frame, self.says, self.chars, self.articles = frame, says, 0, []


class Blocks(HTMLParser):
    """blocks: (text, in an article, in a content element, boilerplate, strong name, weak name) of each block, in order.

    An element that holds the page's article, or most of the text of a page that has no article elsewhere, is a wrapper, and
    nothing is held against it; menus, footers and asides must hold both.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.found_blocks: list[tuple[str, bool, bool, tuple[Held, ...]]] = []
        self.stack: list[tuple[str, bool, bool, Held | None, bool]] = []  # tag, article, content, what is said, silent
        self.silent = 0
        self.within = [0, 0]  # article, content
        self.held: list[Held] = []
        self.open_articles: list[list] = []
        self.articles: list[list] = []  # [text length, how many elements are held around it]
        self.found: list[str] = []
        self.feed(html)
        self.close()
        self._end()
        self.blocks = self._judged()

    def _end(self) -> None:
        if self.found:
            if text := " ".join("".join(self.found).split()):
                self.found_blocks.append((text, self.within[0] > 0, self.within[1] > 0, tuple(self.held)))
                for x in self.held:
                    x.chars += len(text)
                for x in self.open_articles:
                    x[0] += len(text)
            self.found = []

    def _judged(self) -> list[tuple[str, bool, bool, bool, bool, bool]]:
        total = sum(len(t) for t, *_ in self.found_blocks)
        some = [x for x in self.articles if x[0]]
        free = any(x[1] == 0 for x in some)
        best = max(some, key=lambda x: x[0], default=None)
        wraps: dict[int, bool] = {}

        def wrapper(x: Held) -> bool:
            if id(x) not in wraps:
                most, holds = 2 * x.chars > total, best is not None and any(a is best for a in x.articles) and not free
                alone = all(any(a is y for y in x.articles) for a in some)
                wraps[id(x)] = (holds and most) if x.frame else (holds or (most and alone))
            return wraps[id(x)]

        out = []
        for text, article, content, held in self.found_blocks:
            said = [x.says for x in held if not wrapper(x)]
            out.append((text, article, content, *[any(y[i] for y in said) for i in range(3)]))
        return out

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.found.append(" ")
            return
        if tag in BLOCKS:
            self._end()
            while tag in CLOSED_BY_BLOCK and self.stack and self.stack[-1][0] not in BLOCKS | SILENT and any(x[0] == "p" for x in self.stack[-8:]):
                self._pop()  # inline elements that a new block finds open in a paragraph
            if self.stack and self.stack[-1][0] == "p":
                self._pop()
            if tag in ("li", "dt", "dd", "tr", "td", "th") and self.stack and self.stack[-1][0] == tag:
                self._pop()
        if tag in VOID:
            return
        had = {k: v or "" for k, v in attrs}
        article = tag in ("article", "main") or had.get("role") == "main" or had.get("itemprop") == "articleBody"
        boiler = tag in BOILERPLATE or (tag == "header" and not self.within[0])
        strong = weak = False
        if had and tag not in ("html", "body"):
            boiler = boiler or "hidden" in had or had.get("aria-hidden") == "true" or bool(_HIDDEN.search(had.get("style", "")))
            named = f"{had.get('class', '')} {had.get('id', '')} {had.get('role', '')}".lower()
            strong, weak = not STRONG.isdisjoint(named.split()), not WEAK.isdisjoint(_SPLIT.split(named))
        if article:
            self.open_articles.append([0, len(self.held)])
            self.articles.append(self.open_articles[-1])
            for x in self.held:
                x.articles.append(self.articles[-1])
        mark = Held(tag in FRAMES, (boiler, strong, weak)) if boiler or strong or weak else None
        if mark is not None:
            self.held.append(mark)
        silent = tag in SILENT or (tag in FORM_WORDS and not self.within[1])
        self.stack.append((tag, article, tag in CONTENT, mark, silent))
        self.silent += silent
        self.within[0] += article
        self.within[1] += tag in CONTENT

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end()
        if tag not in VOID and any(x[0] == tag for x in self.stack):
            while self._pop() != tag:
                pass

    def _pop(self) -> str:
        tag, article, content, mark, silent = self.stack.pop()
        self.silent -= silent
        self.within[0] -= article
        self.within[1] -= content
        if article:
            self.open_articles.pop()
        if mark is not None:
            self.held.remove(mark)
        return tag

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.found.append(data)


def parsed(html: str | None) -> list[tuple[str, int]]:
    """(text, DROP, OWN or OPEN) of each block: boilerplate for sure, an article's own paragraphs, or open to repetition alone."""
    blocks = Blocks(html or "").blocks
    has_article = any(article and not boiler and not strong for _, article, _, boiler, strong, _ in blocks)

    def says(article: bool, content: bool, boiler: bool, strong: bool, weak: bool) -> int:
        if boiler or strong or (article < has_article) or (weak and not article):
            return DROP
        return OWN if article and content and not weak else OPEN

    return [(text, says(*flags)) for text, *flags in blocks]


class _Hashes(dict):
    """Token -> hash, forgotten when there are too many."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[token] = x = _long(token.encode("utf-8", "surrogatepass"))
        return x


_TOKENS = _Hashes()


def _long(x: bytes) -> int:
    return xxhash.xxh3_64_intdigest(x)


def token_hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(_TOKENS.__getitem__, tokens), np.uint64, len(tokens))


def suffixes(host, h: np.ndarray, span: int) -> np.ndarray:
    """Of each token, the first `span` tokens on from it as a number whose order is by host and first token.

    24 bits are of host and first token, 40 of host and all tokens. host: a number, or one for each result.
    """
    with np.errstate(over="ignore"):
        seed = np.uint64(host) if isinstance(host, int) else host
        seed = seed * np.uint64(0x9E3779B97F4A7C15) + np.uint64(span)
        every = np.zeros(len(h) - span + 1, np.uint64) + seed
        for k in range(span):
            every = (every ^ h[k : len(h) - span + 1 + k]) * np.uint64(0xBF58476D1CE4E5B9)
            every ^= every >> np.uint64(29)
        first = (h[: len(every)] ^ seed) * np.uint64(0x94D049BB133111EB)
    return ((first >> np.uint64(40)) << np.uint64(40)) | (every >> np.uint64(24))


def of_block(host: int, text: str) -> tuple[np.ndarray, int]:
    """The suffixes of a block and how many tokens they are of; one of all tokens if the block is short."""
    h = token_hashes(text.split())
    span = min(LONG, len(h))
    return suffixes(host, h, span), span


def block_hash(host: int, text: str) -> np.uint64:
    return np.uint64(_long(b"%d\n" % host + text.encode("utf-8", "surrogatepass")))


def _mixed(heads: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return heads * np.uint64(0xD6E8FEB86659FD93)


def sampled(heads: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least of each `window` suffixes, of all if there are fewer."""
    mixed = _mixed(heads)
    if len(mixed) <= window:
        return np.array([int(np.argmin(mixed))])
    view = np.lib.stride_tricks.sliding_window_view(mixed, window)
    return np.unique(view.argmin(1) + np.arange(len(view)))


class Stream:
    """The tokens of blocks (host, page, OWN or OPEN, text), and of each the suffix that it starts (heads), the block (of) and whether it ends within that."""

    def __init__(self, blocks: list[tuple[int, int, int, str]]):
        split = [text.split() for *_, text in blocks]
        self.lengths = np.array([len(t) for t in split], np.int64)
        self.hosts, self.pages, self.says = (np.array([b[i] for b in blocks], kind) for i, kind in ((0, np.uint64), (1, np.int64), (2, np.int8)))
        self.h = token_hashes([t for tokens in split for t in tokens])
        self.ends = np.cumsum(self.lengths)
        block = np.repeat(np.arange(len(blocks)), self.lengths)
        self.of = block[: max(0, len(self.h) - LONG + 1)]
        self.heads = suffixes(self.hosts[self.of], self.h, LONG) if len(self.of) else np.zeros(0, np.uint64)
        self.inside = np.arange(len(self.heads)) + LONG <= self.ends[self.of]


def spots(heads: np.ndarray) -> np.ndarray:
    return (heads % np.uint64(SPOTS)).astype(np.int64)


def array_of(blocks: list[tuple[int, int, int, str]], hot: dict[int, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, page, undecided) of all blocks (host, page, OWN or OPEN, text): what of_block and block_hash give of each, at once.

    hot: of each host, which of the SPOTS may hold a common suffix; suffixes of OWN blocks elsewhere are left out, as are those of hosts without. Without hot OWN blocks are sampled.
    """
    x = Stream(blocks)
    out_s, out_b = [], []
    if len(x.heads):
        heads, of = x.heads, x.of
        taken = x.inside & (x.says[of] == OPEN)
        own = np.flatnonzero(x.inside & (x.says[of] == OWN))
        if hot is not None:
            names = {name: i + 1 for i, name in enumerate(hot)}
            table = np.stack([np.zeros(SPOTS, bool), *hot.values()])
            row = np.array([names.get(int(b[0]), 0) for b in blocks], np.int64)
            taken[own] = table[row[of[own]], spots(heads[own])]
        elif len(own):
            mixed, at = _mixed(heads[own]), of[own]
            firsts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            counts = np.diff(np.r_[firsts, len(at)])
            if len(own) >= WINDOW:
                view = np.lib.stride_tricks.sliding_window_view(mixed, WINDOW)
                whole = np.flatnonzero(at[: len(view)] == at[WINDOW - 1 :])
                for part in np.array_split(whole, len(whole) // 100_000 + 1):
                    taken[own[part + view[part].argmin(1)]] = True
            for i in np.flatnonzero(counts < WINDOW).tolist():  # a block of fewer suffixes gives the least
                taken[own[firsts[i] + int(mixed[firsts[i] : firsts[i] + counts[i]].argmin())]] = True
        out_s.append(heads[taken])
        out_b.append(of[taken])
    small = [i for i, n in enumerate(x.lengths.tolist()) if n < LONG]
    out_s.append(np.array([suffixes(int(x.hosts[i]), x.h[x.ends[i] - x.lengths[i] : x.ends[i]], int(x.lengths[i]))[0] for i in small], np.uint64))
    out_b.append(np.array(small, np.int64))
    out_s.append(np.array([block_hash(int(b[0]), b[3]) for b in blocks], np.uint64))
    out_b.append(np.arange(len(blocks)))
    of = np.concatenate(out_b)
    return np.concatenate(out_s), x.pages[of], x.says[of] == OPEN


def covered(host: int, text: str, known: np.ndarray) -> float:
    """The share of the block's tokens in stretches of `known`, a sorted array."""
    if not len(known):
        return 0.0
    if _among(np.array([block_hash(host, text)]), known)[0]:
        return 1.0
    heads, span = of_block(host, text)
    marks = np.zeros(len(heads) + span, np.int64)
    hit = np.flatnonzero(_among(heads, known))
    marks[hit] += 1
    marks[hit + span] -= 1
    return float((np.cumsum(marks[:-1]) > 0).mean())


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x


def kept_blocks(host: int, blocks: list[tuple[str, int]], repeated: np.ndarray, common: np.ndarray) -> list[str]:
    """The texts that stay. repeated and common: sorted suffixes of this page's host."""
    candidates = [(text, says) for text, says in blocks if says != DROP]
    by_repeats = [text for text, says in candidates if covered(host, text, common if says == OWN else repeated) < MOST]
    size = lambda texts: sum(len(t.split()) for t in texts)
    if size(by_repeats) >= LEFT * size(t for t, _ in candidates):
        return by_repeats
    return [text for text, says in candidates if covered(host, text, common) < MOST] or [text for text, _ in candidates]


def host(url) -> object:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


ARRAY = "host long, suffix long, pages array<long>, undecided array<long>"


def _lists(pages: np.ndarray, cuts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(pages))


def _intervals(hosts: list[int], keys: list[int], blocks: list[tuple[int, int, int, str]], hot: dict[int, np.ndarray]) -> pa.RecordBatch:
    """A row for each suffix of a host: its pages, each once whatever blocks it stands in, and those where it stands in an open block."""
    s, p, u = array_of(blocks, hot)
    order = np.lexsort((~u, p, s))
    s, p, u = s[order], p[order], u[order]
    first = np.r_[True, (s[1:] != s[:-1]) | (p[1:] != p[:-1])]  # of a suffix and page, with the open block first
    s, p, u = s[first], p[first], u[first]
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    named = np.array(keys, np.int64)[p]
    opens = np.r_[0, np.cumsum(u)]
    arrays = [pa.array(np.array(hosts, np.int64)[p[starts]]), pa.array(s[starts].view(np.int64)), _lists(named, np.append(starts, len(s))), _lists(named[u], opens[np.append(starts, len(s))])]
    return pa.RecordBatch.from_arrays(arrays, names=["host", "suffix", "pages", "undecided"])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with the candidates among their blocks, and what markup says of each, in place of html."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            found = [[b for b in parsed(html) if b[1] != DROP] for html in part.column(4).to_pylist()]
            arrays = [*part.columns[:4], pa.array([[t for t, _ in x] for x in found], pa.list_(pa.string())), pa.array([[s for _, s in x] for x in found], pa.list_(pa.int8()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "page", "host", "texts", "says"])


def _chunks(rows: Iterator[tuple[int, list[str], list[int]]]) -> Iterator[tuple[list[tuple[int, int, int, str]], int]]:
    """(blocks, pages so far) of some 8 MB of text at a time. rows: host, texts, says of each page."""
    blocks, size, i = [], 0, -1
    for i, (name, texts, says) in enumerate(rows):
        blocks += [(name & 0xFFFFFFFFFFFFFFFF, i, s, t) for t, s in zip(texts, says, strict=True)]
        size += sum(map(len, texts))
        if size > 8_000_000:
            yield blocks, i + 1
            blocks, size = [], 0
    yield blocks, i + 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each host of some pages, how many there are, and how many of them have a suffix of an article's paragraph in each spot."""
    for batch in batches:
        hosts, texts, says = [c.to_pylist() for c in batch.columns]
        done = 0
        for blocks, upto in _chunks(zip(hosts, texts, says, strict=True)):
            names = sorted(set(hosts[done:upto]))
            number = {name: i for i, name in enumerate(names)}
            of = np.array([number[name] for name in hosts[done:upto]], np.int64)
            x = Stream(blocks)
            own = np.flatnonzero(x.inside & (x.says[x.of] == OWN))
            marks = np.unique((x.pages[x.of[own]] - done) * SPOTS + spots(x.heads[own]))  # a page marks a spot once
            sums = np.bincount(of[marks // SPOTS] * SPOTS + marks % SPOTS, minlength=len(names) * SPOTS).astype("<u4").reshape(-1, SPOTS)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.bincount(of, minlength=len(names)), pa.int64()), pa.array([s.tobytes() for s in sums], pa.binary())], names=["host", "n", "marks"])
            done = upto


def _hot(shared: int, half: float):
    def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a host, the spots that so many pages mark as hold a common stretch, as bits."""
        name, n, sums = None, 0, np.zeros(SPOTS, np.int64)
        for batch in batches:
            for name, k, marks in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                n += k
                sums += np.frombuffer(marks, "<u4")
        bits = np.packbits((sums >= shared) & (sums >= half * n)).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([bits], pa.binary())], names=["host", "hot"])

    return hot


def _sorted_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffix arrays of the hosts of some pages, as intervals; and a row without a suffix that names each host's pages. No page is given twice."""
    for batch in batches:
        keys, hosts, texts, says, bits = [c.to_pylist() for c in batch.columns]
        hot = {name & 0xFFFFFFFFFFFFFFFF: np.unpackbits(np.frombuffer(b, np.uint8)).astype(bool) for name, b in zip(hosts, bits, strict=True) if b is not None}
        for blocks, _ in _chunks(zip(hosts, texts, says, strict=True)):
            if blocks:
                yield _intervals(hosts, keys, blocks, hot)
        by_host: dict[int, list[int]] = {}
        for key, name in zip(keys, hosts, strict=True):
            by_host.setdefault(name, []).append(key)
        rows = [list(by_host), [None] * len(by_host), [sorted(x) for x in by_host.values()], [[] for _ in by_host]]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(rows, kinds, strict=True)], names=["host", "suffix", "pages", "undecided"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for name, texts, says, repeated, common in zip(*[batch.column(i).to_pylist() for i in range(2, 7)], strict=True):
            known = [np.sort(np.array(x or [], np.int64).view(np.uint64)) for x in (repeated, common)]
            out.append("\n".join(kept_blocks(name & 0xFFFFFFFFFFFFFFFF, list(zip(texts, says, strict=True)), *known)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def _once(keyed: DataFrame) -> DataFrame:
    """A row for each page (host and html). Only rows that may be given again are compared; the others stay where they are."""
    again = stash(keyed.groupBy("page").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("page"), "pages-again")
    split = marked(keyed, again, "page")
    return split.filter("not maybe").drop("maybe").unionByName(split.filter("maybe").drop("maybe").dropDuplicates(["page"]))


def repeats(blocks: DataFrame, shared: int = PAGES, half: float = HALF) -> DataFrame:
    """(page, repeated, common): the suffixes of each page that bear on a block of it. blocks: page, host, texts, says."""
    once = _once(blocks)
    counted = once.select("host", "texts", "says").mapInArrow(_counted, "host long, n long, marks binary")
    hot = stash(counted.groupBy("host").applyInArrow(_hot(shared, half), "host long, hot binary").filter(F.expr("hot <> repeat(X'00', length(hot))")), "hot-spots")
    listed = once.join(hot, "host", "left").select("page", "host", "texts", "says", "hot")
    rows = stash(listed.mapInArrow(_sorted_suffixes, ARRAY), "suffix-arrays")
    merged = rows.filter("suffix is not null").select("host", "suffix", F.size("pages").alias("n")).groupBy("suffix", "host").agg(F.sum("n").alias("n"))
    sizes = rows.filter("suffix is null").groupBy("host").agg(F.sum(F.size("pages")).alias("of"))
    known = merged.filter(F.col("n") >= shared).join(sizes, "host").select("host", "suffix", (F.col("n") >= half * F.col("of")).alias("is_common"))
    known = stash(known, "repeated-suffixes")
    met = marked(rows.filter("suffix is not null"), known.select("suffix"), "suffix").filter("maybe").join(known.hint("merge"), ["suffix", "host"])
    # what all of a host's pages share bears on every block, other repeats on open ones
    each = met.select("suffix", "is_common", F.explode(F.when(F.col("is_common"), F.col("pages")).otherwise(F.col("undecided"))).alias("page"))
    out = each.groupBy("page").agg(F.collect_list("suffix").alias("repeated"), F.collect_list(F.when(F.col("is_common"), F.col("suffix"))).alias("common"))
    return out


def extract(pages: DataFrame, shared: int = PAGES) -> DataFrame:
    """(page_id, url, text), a row for each row of pages, parsed once. Pages without a repeated stretch that could matter stay where they are."""
    named = host(F.col("url"))
    keyed = pages.select(F.col("page_id").cast("long"), "url", F.xxhash64(named, "html").alias("page"), F.xxhash64(named).alias("host"), "html")
    blocks = stash(keyed.mapInArrow(_parsed, "page_id long, url string, page long, host long, texts array<string>, says array<tinyint>"), "page-blocks")
    bearing = stash(repeats(blocks.select("page", "host", "texts", "says"), shared), "page-repeats")
    split = marked(blocks, bearing.select("page"), "page")
    none = F.lit(None).cast("array<bigint>")
    columns = ["page_id", "url", "host", "texts", "says"]
    alone = split.filter("not maybe").select(*columns, none.alias("repeated"), none.alias("common"))
    rest = split.filter("maybe").join(bearing, "page", "left").select(*columns, "repeated", "common")
    return alone.unionByName(rest).mapInArrow(_texts, "page_id long, url string, text string")


def op7_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
