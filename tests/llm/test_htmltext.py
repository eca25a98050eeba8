"""What op7 keeps and drops: wrappers, words of forms, how pages are counted, and a brute-force version for pages with articles and open blocks."""

import random

import numpy as np
import pytest

from playlore.llm import htmltext as ht

PAGE = "page_id long, url string, html string"
P = "The first paragraph of the story has many words in it so that it is long."
NONE = np.zeros(0, np.uint64)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f'<form id="aspnetForm"><nav>Home</nav><div>{P}</div><p>Second {P}</p></form>', [P, f"Second {P}"]),
        (f'<form id="aspnetForm"><nav>Home</nav><article><p>{P}</p></article><div>Beside</div></form>', [P]),
        (f'<div class="overlay"><article><p>{P}</p></article></div>', [P]),
        (f'<div hidden class="modal popup"><main><p>{P}</p></main></div><footer>End</footer>', [P]),
        (f'<article><p>{P}</p><div class="related"><p>Related {P}</p></div></article>', [P, f"Related {P}"]),
        ("<article><p>Press <button>Save</button> or <label>tick</label> it, then x = <math><mi>y</mi></math> follows.</p></article>", ["Press Save or tick it, then x = y follows."]),
        (f"<article><p>{P}</p><form><label>Mail</label><input value=x><select><option>Ms</option></select><button>Subscribe</button></form></article>", [P]),
        (f'<article><p>{P}</p></article><div class="comments"><p>{P} {P} {P}</p></div>', [P]),
        (f"<article><p>{P}</p></article><aside><article><p>{P} {P} {P} Teaser</p></article></aside>", [P]),
        (f"<div>{P} {P}</div><aside><article><p>Teaser</p></article></aside>", [f"{P} {P}"]),
        (f"<nav>{'<a>Menu entry</a> ' * 50}</nav><div>{P}</div>", [P]),
        (f"<article><p>{P}</p><button>Share</button></article>", [P]),
    ],
)
def test_wrappers_and_words_of_forms(html, want):
    assert ht.kept_blocks(1, ht.parsed(f"<html><body>{html}</body></html>"), NONE, NONE) == want


def texts(spark, rows, parts=None):
    df = spark.createDataFrame(rows, PAGE)
    return {r.page_id: r.text for r in ht.extract(df.repartition(parts) if parts else df).collect()}


def test_a_page_counts_once_for_a_stretch_in_two_kinds_of_block(spark):
    """Two pages hold the notice in a paragraph and in an open block; that makes two pages, not four."""
    notice = "we have moved to a new house and you may visit us there today"
    page = lambda i, twice: f"<article><div>{notice}</div><p>Page {i} has a text of its own that no other page has {i}.</p>{f'<p>{notice}</p>' if twice else ''}</article>"
    other = [(10 + i, "http://a.org/x", f"<article><p>Filler {i} with words {i} that stand alone {i} on page {i} here</p></article>") for i in range(6)]
    for twice in (False, True):
        out = texts(spark, [(i, f"http://a.org/{i}", page(i, twice)) for i in range(2)] + other)
        assert all(notice in out[i] for i in range(2))


def test_repeated_rows_and_equal_pages_count_once(spark):
    notice = "we have moved to a new house and you may visit us there today"
    page = lambda i: f"<div>{notice}</div><div>{' '.join(f'own{i}x{k}' for k in range(30))}</div>"
    rows = [(1, "http://a.org/1", page(1))] * 3 + [(2, "http://a.org/2", page(2)), (3, "http://a.org/other", page(2))]
    for parts in (1, 7):
        assert all(notice in t for t in texts(spark, rows, parts).values())
    assert all(notice not in t for t in texts(spark, [*rows, (4, "http://a.org/4", page(4))], 7).values())


def plain(pages):
    """page -> text, from all windows of LONG tokens. pages: page -> (host, [(text, own)])."""
    spans = lambda t: [tuple(t[i : i + min(ht.LONG, len(t))]) for i in range(len(t) - min(ht.LONG, len(t)) + 1)]
    holders = {}
    for p, (h, blocks) in pages.items():
        for b, _ in blocks:
            for w in spans(b.split()):
                holders.setdefault((h, w), set()).add(p)

    def share(h, block, least):
        t = block.split()
        return len({i + k for i, w in enumerate(spans(t)) if len(holders[h, w]) >= least for k in range(len(w))}) / len(t)

    out = {}
    for p, (h, blocks) in pages.items():
        common = max(ht.PAGES, ht.HALF * sum(x == h for x, _ in pages.values()))
        stays = [b for b, own in blocks if share(h, b, common if own else ht.PAGES) < ht.MOST]
        if sum(len(b.split()) for b in stays) < ht.LEFT * sum(len(b.split()) for b, _ in blocks):
            stays = [b for b, own in blocks if share(h, b, common) < ht.MOST] or [b for b, _ in blocks]
        out[p] = "\n".join(stays)
    return out


def test_articles_and_open_blocks_mixed_equal_all_windows(spark):
    """Furniture on most pages and quotations on few, in paragraphs and in open blocks of articles; the same however rows are dealt."""
    rng = random.Random(8)
    words = lambda k: " ".join(f"w{rng.randrange(5000)}" for _ in range(k))
    furniture, quoted = [words(60), words(45)], [words(50), words(70), words(12)]
    pages = {}
    for p in range(80):
        blocks = [(words(rng.choice([30, 60])), rng.random() < 0.5) for _ in range(2)]
        blocks += [(f, rng.random() < 0.5) for f in furniture if p % 4]
        blocks += [(q, rng.random() < 0.5) for k, q in enumerate(quoted) if (p + k) % 16 < 2]
        rng.shuffle(blocks)
        pages[p] = (("a.org", "b.org")[p % 2], blocks)
    rows = [(p, f"http://{h}/{p}", "<article>" + "".join(f"<p>{b}</p>" if own else f"<div>{b}</div>" for b, own in blocks) + "</article>") for p, (h, blocks) in pages.items()]
    want = plain(pages)
    assert texts(spark, rows, 1) == texts(spark, rows, 7) == want
    assert sum(f in t for t in want.values() for f in furniture) < 10 and sum(q in t for t in want.values() for q in quoted) > 10


def test_short_repeats_in_paragraphs_of_articles_are_all_seen(spark):
    """stretches of 8 to 20 tokens that most pages have inside long paragraphs, where one suffix of 24 was looked at."""
    rng = random.Random(12)
    words = lambda k: " ".join(f"w{rng.randrange(5000)}" for _ in range(k))
    shorts, pages = [words(k) for k in (8, 9, 12, 20, 10, 11)], {}
    for p in range(40):
        blocks = [(words(60), True)]
        for k in range(3):
            inside = rng.sample(shorts, 4) if p % 5 else shorts[:1]
            blocks.append((" ".join(x for s in inside for x in (s, words(rng.randrange(6 + 4 * k)))), True))
        pages[p] = (("a.org", "b.org")[p % 2], blocks)
    rows = [(p, f"http://{h}/{p}", "<article>" + "".join(f"<p>{b}</p>" for b, _ in blocks) + "</article>") for p, (h, blocks) in pages.items()]
    want = plain(pages)
    assert 0 < sum(len(bs) - len(want[p].split("\n")) for p, (_, bs) in pages.items()) < 3 * len(pages)
    assert texts(spark, rows, 1) == texts(spark, rows, 7) == want
