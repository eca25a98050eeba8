"""Edge cases of the corpus operators, and brute-force versions of what SQL can't say."""

import hashlib
import os
import random
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from playlore.llm import fingerprints, htmltext, langid, licenses, linededup, mixing, neardup, quality, sharding
from playlore.llm.components import components
from playlore.llm.shingles import shingle_set

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=None):
    """rows: (doc_id, text); lang and source alternate."""
    data = [(i, t, "en" if k % 2 else "de", f"s{k % 3}" if k % 5 else None, len(t or "")) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(data, SCHEMA)
    return df.withColumn(extra, F.lit("clash")) if extra else df


ODD = [(1, "a b c d e f g h i j k."), (2, None), (3, ""), (None, "x y"), (1, "a b c d e f g h i j k."), (4, " \n\n "), (5, "word " * 30_000), (6, None)]


# ---- line dedup ----

L = [f"line {i} has more than ten words so that it counts as a long one" for i in range(40)]


def test_line_dedup_keeps_first_occurrences_and_finds_runs(spark):
    rows = [(1, "\n".join(L[:6])), (2, "\n".join(["own " + L[20], *L[2:5], "own " + L[21]])), (3, "\n".join(L[10:14])), (4, "\n".join([L[11], L[12]] * 2))]
    out = {r.doc_id: r for r in linededup.dedup_lines(docs(spark, rows)).collect()}
    assert out[1].n_removed == out[3].n_removed == 0
    assert out[2].clean_text == "\n".join(["own " + L[20], "own " + L[21]])
    assert out[4].n_removed == 4 and out[4].clean_text == ""


def test_line_dedup_of_two_copies_of_very_many_lines_is_linear(spark):
    """Lines of two words, so that windows take several, repeat in the text itself, and the copy loses all of them."""
    text = "\n".join(f"line{i} of{i % 1000}" for i in range(32_000))
    began = time.perf_counter()
    out = {r.doc_id: (r.n_removed, r.clean_text) for r in linededup.dedup_lines(docs(spark, [(1, text), (2, text + "\nown end")])).collect()}
    assert out == {1: (0, text), 2: (32_000, "own end")} and time.perf_counter() - began < 30


def test_selected_positions_are_few_and_shared_by_equal_windows(spark):
    made = linededup.sketch(docs(spark, [(1, "\n".join(f"w{i * 7919 % 1000} x" for i in range(400)))])).first().windows
    assert len({(w.print, w.at) for w in made}) < len(made) / 2 and all(w.start <= w.at <= w.stop for w in made)


def test_line_dedup_extends_over_short_lines(spark):
    rows = [(1, "\n".join([L[0], "short", L[1], "end"])), (2, "\n".join(["new", L[0], "short", L[1], "other end"]))]
    out = {r.doc_id: r.clean_text for r in linededup.dedup_lines(docs(spark, rows)).collect()}
    assert out[2] == "new\nother end"


def earlier_runs(rows, least):
    """id -> positions of the lines in a run of `least` words that occurs earlier, from all runs of each text."""
    lines = {i: (t or "").split("\n") for i, t in rows}
    seen, gone = set(), {i: set() for i in lines}
    for i in sorted(lines):
        runs = [(a, b) for a in range(len(lines[i])) for b in range(a, len(lines[i]))]
        for a, b in sorted(runs):
            part = tuple(lines[i][a : b + 1])
            if part[0].split() and part[-1].split() and sum(len(x.split()) for x in part) >= least:
                gone[i] |= set(range(a, b + 1)) if part in seen else set()
                seen.add(part)
    return gone


def test_line_dedup_is_all_later_runs_of_ten_words(spark):
    """Against plain Python: one line, runs of short lines, lines with lesser neighbours, and runs whose lines have other first holders."""
    rng = random.Random(7)
    line = lambda k: " ".join(f"x{rng.randrange(10**6)}" for _ in range(k))
    shared = [[line(60)], [line(9) for _ in range(9)], [line(3), "", *[line(2) for _ in range(6)]], [line(30), line(3)], [line(11)], [line(4), line(5)]]
    rows = []
    for i in range(60):
        body = [line(rng.choice([4, 12, 70])) for _ in range(3)]
        for part in rng.sample(shared, 3):
            body += [*part[rng.randrange(2) * (len(part) // 2) :], *[line(rng.choice([12, 12, 4])) for _ in range(2)]]
        rows.append((i, "\n".join(body)))
    long, short, three = "this one line has ten words at the very least", "and a short one", "\n".join(["one two three", "four five six", "one two four", "six seven eight"])
    rows += [(100, long), (101, f"{long}\n{short}"), (102, f"{long}\n{short}"), (103, three), (104, three), (105, "one two three\nfour five six")]
    want = earlier_runs(rows, linededup.MIN_WORDS)
    got = {int(r.row_key.split(":")[0]): set(r.removed) for r in linededup.repeated_lines(docs(spark, rows)).collect()}
    assert {i: x for i, x in want.items() if x} == got
    assert got[101] == {0} and got[102] == {0, 1} and got[104] == {0, 1, 2, 3} and 105 not in got


def test_line_dedup_edge_cases(spark):
    out = linededup.dedup_lines(docs(spark, ODD, "n_lines"))
    assert out.count() == len(ODD)
    assert out.agg(F.sum("n_removed")).first()[0] == 0  # equal rows count as one document
    assert linededup.dedup_lines(docs(spark, ODD).limit(0)).count() == 0


# ---- fingerprints ----


def test_fingerprints(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=120))) for i in range(40)] + [(99, None), (100, ""), (101, "w1 w2 w3"), (102, "w1 w2 w3")]
    d = docs(spark, rows)
    buckets = fingerprints.lookup(fingerprints.lexicon(d, least=0.01, most=0.9))
    keyed = d.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("string").alias("row_key"))
    got = {r.doc_id: r for r in fingerprints.edited_next(keyed, F.array_join(fingerprints.fingerprint(F.col("text"), buckets), "")).collect()}
    texts = {i: t or "" for i, t in rows}
    order = sorted(texts, reverse=True)
    for i, j in zip(order, order[1:] + order[:1]):
        k = len(texts[i]) // 3
        assert got[i].edited == texts[i][: len(texts[i]) - k] + texts[j][:k]
        assert got[i].next_own == got[j].own
    assert got[101].own == got[102].own and got[99].own == got[100].own


def test_a_lone_document_follows_itself(spark):
    keyed = spark.createDataFrame([(7, "abcdef", "k")], "doc_id long, text string, row_key string")
    r = fingerprints.edited_next(keyed, F.lit("p")).first()
    assert r.edited == "abcdab" and r.next_own == "p"
    assert fingerprints.edited_next(keyed.limit(0), F.lit("p")).count() == 0


def test_a_lexicon_of_any_size_gives_the_same_fingerprints(spark, tmp_path, monkeypatch):
    """As a look-up table or joined: nulls, repeated rows, one id with two texts, no terms at all, a text of 30,000 words."""
    rows = [(i, " ".join(f"w{(i * k) % 37}" for k in range(i % 50))) for i in range(200)]
    rows += [(7, None), (None, "w1 w2 other"), (None, None), (3, rows[3][1]), (3, rows[3][1]), (300, "..."), (301, "lonely words only"), (302, " ".join(f"w{k % 30} u{k}" for k in range(15_000)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    result = lambda: sorted((tuple(r) for r in fingerprints.op2_fingerprints(spark, str(tmp_path)).collect()), key=repr)
    table = result()
    monkeypatch.setattr(fingerprints, "MOST_TERMS", 0)
    assert result() == table and len(table) == len(rows)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    monkeypatch.setattr(fingerprints, "MOST_TERMS", -1)
    assert fingerprints.op2_fingerprints(spark, str(tmp_path / "none")).count() == 0


def test_fingerprint_edge_cases(spark):
    """Null ids, repeated rows, a text of 300,000 words, a clashing column, more buckets than documents, and the order of buckets."""
    words = " ".join(f"t{i}" for i in range(3000))
    rows = [(None, f"null id {i} with some words") for i in range(9)] + [(4, "same same twice"), (4, "same same twice"), (5, words * 100), (6, None), (None, None)]
    d = docs(spark, rows, "own")
    buckets = fingerprints.lookup(fingerprints.lexicon(d, least=0.01, most=0.9))
    keyed = d.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), fingerprints.row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "own")
    out = fingerprints.edited_next(keyed, F.array_join(fingerprints.fingerprint(F.col("text"), buckets), "")).collect()
    assert len(out) == len(rows) and all(len(r.own) >= 8 and r.next_own for r in out)
    by = {r.row_key: r for r in out}
    order = sorted((r for r in by.values() if r.doc_id is None), key=lambda r: hashlib.md5(r.row_key.encode()).hexdigest())
    assert [r.next_own for r in order[:-1]] == [r.own for r in order[1:]]
    first = max((r for r in by.values() if r.doc_id is not None), key=lambda r: r.doc_id)
    assert order[-1].next_own == first.own
    at = spark.range(-3, 12).select(fingerprints.above(F.col("id"), [0, 2, 5, 9]).alias("n"), "id").collect()
    assert all(r.n == sum(b > r.id for b in (0, 2, 5, 9)) for r in at)
    many = list(range(0, 3000, 3))
    assert all(r.n == sum(b > r.id for b in many) for r in spark.range(0, 3100, 7).select(fingerprints.above(F.col("id"), many).alias("n"), "id").collect())


# ---- licences ----


def test_licences(spark):
    rows = [
        (1, "Released under the MIT License."), (2, "mit-license MIT\nlicense; general public license"), (3, None), (4, "summit licenses omit license"),
        (5, "Licensed under the Apache License, Version 2.0"), (6, "This work is licensed under CC BY-NC 4.0."), (7, "Ünder MİT license"), (8, "x " * 50_000 + "apache license"),
    ]
    out = {r.doc_id: r for r in licenses.scan(docs(spark, rows, "labels")).collect()}
    assert (out[1].n_base, out[1].first_word, out[1].base_labels, out[1].labels) == (1, 3, "mit", "mit")
    assert (out[2].n_base, out[2].first_word, out[2].last_word, out[2].base_labels) == (3, 0, 4, "gpl,mit")
    assert (out[3].n_words, out[3].n_base, out[3].first_word, out[3].labels, out[3].score) == (0, 0, None, "", 0.0)
    assert out[4].n_base == 0 and out[7].n_base == 0
    assert out[5].labels == "apache,apache-2.0" and len(out[5].detections) == 1  # the longer rule contains the others
    assert out[6].labels == "cc-by-nc-4.0"
    assert (out[8].first_word, out[8].n_words) == (50_000, 50_002)


def test_licence_edge_cases(spark):
    rows = [*ODD, (9, "MIT License " * 20_000), (9, "MIT License " * 20_000), (10, "Redistribution and use in source and binary forms, with or without modification, are permitted")]
    d = docs(spark, rows, "labels")
    out = licenses.scan(d).collect()
    assert len(out) == len(rows) and {r.n_base for r in out if r.doc_id == 9} == {20_000}
    assert [r.labels for r in out if r.doc_id == 10] == ["bsd"] and all(r.labels == "" and r.first_word is None for r in out if r.text in (None, ""))
    assert licenses.scan(d.limit(0)).count() == 0


@pytest.mark.parametrize("text, label", [("in no event; neither the name of The Old University nor the names of its contributors may be used to endorse or promote products derived", "bsd-3-clause"), ("This is free and unencumbered software released into the public domain.", "unlicense"), ("To the extent possible under law, Jo Doe has waived all copyright and related or neighboring rights", "cc0"), ("either version 3 of the License, or (at your option) any later version", "gpl-3-or-later")])
def test_signatures_of_licence_bodies(spark, text, label):
    assert label in licenses.scan(docs(spark, [(1, text)])).first().labels.split(",")


# ---- sharding ----


def test_the_table_is_full_even_and_stable():
    names = sharding.shard_names(16)
    table = sharding.fill_table(names, 1009)
    held = Counter(table)
    assert set(held) == set(range(16)) and max(held.values()) - min(held.values()) <= 1
    fewer = sharding.fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 15)
    assert moved < 0.35 * 1009
    with pytest.raises(ValueError):
        sharding.fill_table(names, 1000)


def test_sharding_edge_cases(spark):
    out = sharding.assign(docs(spark, ODD, "slot"), "doc_id", sharding.shard_names(8), 101).collect()
    assert len(out) == len(ODD) and all(r.shard for r in out)
    assert sharding.assign(docs(spark, ODD).limit(0), "doc_id", ["a"], 101).count() == 0


# ---- quality ----


def brute_quality(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["a ", "b ", "c ", "d\n", "#", "é\t", " ", ". "]) for _ in range(rng.randrange(200)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a b c d e " * 400)]
    out = {r.doc_id: r for r in quality.judge(docs(spark, rows, "kept")).collect()}
    for i, t in rows:
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(t), t
    assert not out[100].kept and out[100].base_failed


def test_quality_removes_lines_and_rejects_what_loses_much(spark):
    good = "This is a sentence of a dozen words, and it ends as it should."
    rows = [(1, f"{good}\n{good[::-1]}.\nHome | News | About | Contact\nAccept all cookies to go on."), (2, f"Short one here.\n" + "Home | News | About | Contact | More | Even more\n" * 3), (3, f"{good}\nIt goes on and on, and nothing is wrong with it.")]
    out = {r.doc_id: r for r in quality.judge(docs(spark, rows), max_lost=0.5).collect()}
    assert out[1].clean_text == f"{good}\n{good[::-1]}." and out[1].kept
    assert not out[2].kept
    assert out[3].kept and out[3].clean_text == rows[2][1]


def test_quality_keeps_prose_with_a_phrase_or_a_separator(spark):
    prose = lambda k, at, mark: " ".join(mark if i == at else f"word{i}" for i in range(k)) + "."
    kept = [prose(900, 400, mark) for mark in ("the privacy policy of", "read more", "Sign in to", "a > b")] + [prose(40, 9, "Read More"), "Here aoneshare onealy and spread more go in one line of clean text, all with care."]
    gone = ["Read more of this in the paper of today, if you like.", " | ".join(f"Part {i} of it" for i in range(30)), "Privacy Policy, Terms of Use, Cookie Settings and all the other notices of ours that you may read here at any time. All rights reserved."]
    texts = dict(enumerate(kept + [f"{kept[0]}\n{x}" for x in gone]))
    out = {r.doc_id: r for r in quality.judge(docs(spark, list(texts.items()))).collect()}
    for i, text in texts.items():
        assert out[i].kept and out[i].clean_text == (text if i < len(kept) else kept[0]), text


def test_quality_edge_cases(spark):
    d = docs(spark, [*ODD, ODD[0], ODD[0]], "clean_text")
    out = quality.judge(d).collect()
    assert len(out) == len(ODD) + 2 and all(not r.kept and r.n_words == 0 for r in out if not (r.text or "").strip())
    assert len({(r.n_words, r.kept) for r in out if r.doc_id == 1}) == 1
    assert quality.judge(d.limit(0)).count() == 0


# ---- HTML ----

PAGE = "page_id long, url string, html string"


def test_html(spark):
    nav = "<nav><a href=/>Home</a></nav>"
    page = lambda body: f"<html><head><title>t</title><script>var a='</p>';</script></head><body>{nav}{body}<footer>f</footer></body></html>"
    notice = "<div>We have moved to a new house and you may visit us there today</div>"
    rows = [
        (1, "http://h.org/1", page("<article><h1>A &amp; B</h1><p>x<b>y</b>\n z<p>q&#233;</article>")),
        (2, "http://h.org/2", page(f"{notice}<div>Only here is a text that no other page has got in it</div>")),
        (3, "http://h.org/3", page(f"{notice}<div>Another text that is found on this page and nowhere else</div>")),
        (4, "http://H.org:80/4", page(f"{notice}<p>Third</p>")), (5, "http://i.org/4", page(f"{notice}")), (6, None, None), (7, "u", ""), (7, "u", ""),
        (8, "v", "<article><div class='comments'><p>no</p></div><form>no</form><p>" + "long " * 30_000 + "</p></article>"),
        (9, "http://j.org/1", "<main><div class='post-notice-free search-results'><p>Found by its words</p></div><section id='menu'><p>Soup and bread</p></section></main>"),
    ]
    out = {(r.page_id): r.text for r in htmltext.extract(spark.createDataFrame([(*r, "clash") for r in rows], f"{PAGE}, text string")).collect()}
    assert out[1] == "A & B\nxy z\nqé"
    assert out[2] == "Only here is a text that no other page has got in it"
    assert out[3].startswith("Another text") and out[4] == "Third"
    assert out[5] == "We have moved to a new house and you may visit us there today"
    assert out[6] == out[7] == "" and out[8] == " ".join(["long"] * 30_000)
    assert out[9] == "Found by its words\nSoup and bread"
    assert htmltext.extract(spark.createDataFrame([], PAGE)).count() == 0


def test_suffixes_of_many_blocks_at_once():
    rng = random.Random(4)
    blocks = [(rng.randrange(2**63), k // 3, rng.choice([htmltext.OWN, htmltext.OPEN]), " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 3, 7, 8, 20, 31, 32, 90])))) for k in range(200)]
    got = set(zip(*[x.tolist() for x in htmltext.array_of(blocks)]))
    want = set()
    for host, page, says, text in blocks:
        heads, _ = htmltext.of_block(host, text)
        mine = [*(heads if says == htmltext.OPEN else heads[htmltext.sampled(heads)]), htmltext.block_hash(host, text)]
        want |= {(int(x), page, says == htmltext.OPEN) for x in mine}
    assert got == want


def by_all_windows(pages):
    """page -> blocks that stay, by listing every window of LONG tokens of every page. pages: page -> (host, open blocks)."""
    long = htmltext.LONG
    spans = lambda t: [tuple(t[i : i + min(long, len(t))]) for i in range(len(t) - min(long, len(t)) + 1)]
    holders = {}
    for p, (h, blocks) in pages.items():
        for b in blocks:
            for w in spans(b.split()):
                holders.setdefault((h, w), set()).add(p)

    def share(h, block, least):
        t = block.split()
        over = {i + k for i, w in enumerate(spans(t)) if len(holders[h, w]) >= least for k in range(len(w))}
        return len(over) / len(t)

    out = {}
    for p, (h, blocks) in pages.items():
        half = max(htmltext.PAGES, htmltext.HALF * sum(x == h for x, _ in pages.values()))
        stays = [b for b in blocks if share(h, b, htmltext.PAGES) < htmltext.MOST]
        if sum(len(b.split()) for b in stays) < htmltext.LEFT * sum(len(b.split()) for b in blocks):
            stays = [b for b in blocks if share(h, b, half) < htmltext.MOST] or blocks
        out[p] = stays
    return out


def test_html_without_markup_is_decided_by_repeats_alone(spark):
    """Pages of divs: frames with a date in them, copies of a page, and quotations, on two hosts with equal texts."""
    rng = random.Random(5)
    words = lambda k: " ".join(f"w{rng.randrange(4000)}" for _ in range(k))
    frame, quote, body = [words(12), words(4), words(20)], words(9), [words(30), words(40)]
    pages = {}
    for p in range(60):
        h = ("a.org", "b.org")[p % 2]
        dated = [f"{frame[0]} {words(2)}", frame[1], frame[2]] if p % 5 else []
        own = body if p in (3, 7, 11, 15) else [words(25), f"{words(12)} {quote} {words(12)}", words(rng.choice([3, 60]))]
        pages[p] = (h, [*dated[:2], *own, *dated[2:]])
    rows = [(p, f"http://{h}/{p}", "".join(f"<div>{b}</div>" for b in blocks)) for p, (h, blocks) in pages.items()]
    want = by_all_windows(pages)
    out = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert out == {p: "\n".join(x) for p, x in want.items()}
    assert sum(len(pages[p][1]) - len(x) for p, x in want.items()) > 100 and all(quote in out[p] for p in pages if p not in (3, 7, 11, 15))
    assert out[3] == "\n".join(body)


def test_html_furniture_inside_articles_goes_and_shared_paragraphs_stay(spark):
    rng = random.Random(6)
    words = lambda k: " ".join(f"w{rng.randrange(4000)}" for _ in range(k))
    furniture, shared = words(15), words(40)
    rows = [(p, f"http://a.org/{p}", f"<article><p>{words(30)} {p}</p>" + (f"<p>{shared}</p>" if p < 8 else "") + (f"<p>{furniture}</p>" if p % 3 else "") + "</article>") for p in range(30)]
    out = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert all(furniture not in t for t in out.values()) and all((shared in out[p]) == (p < 8) for p in out)


# ---- language identification ----


def test_language_identification(spark):
    rng = random.Random(1)
    vocabulary = {"en": "the and of to in is it you that he was for on are with".split(), "de": "der die und in den von zu das mit sich des auf für ist im".split()}
    rows = []
    for i in range(240):
        g = "en" if i % 2 else "de"
        rows.append((i, " ".join(rng.choices(vocabulary[g], k=30)), g, "s", 0))
    rows += [(1000, None, None, "s", 0), (1001, "123 !?", "en", "s", 0), (1002, "the and of", None, "s", 0), (1003, "ж" * 60, None, "s", 0)]
    d = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(d.filter(langid.fold(F.col("doc_id")) != 1))
    out = {r.doc_id: r for r in langid.predict(d, model).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 50 and all(out[i].lang_pred == rows[i][2] for i in held)
    assert out[1000].lang_pred == out[1001].lang_pred == "und" and out[1002].lang_pred == "en"
    assert out[1003].lang_pred in ("en", "de") and out[1003].rejected
    assert {r.lang_pred for r in langid.predict(d, langid.train(d.limit(0))).collect()} == {"und"}
    assert langid.predict(d.limit(0), model).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_accuracy_and_calibrated_rejection(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    out = [r for r in langid.op8_langid(spark, "/root/testdata/sf0.01").collect() if r.held_out and truth[r.doc_id] is not None and r.lang_pred != "und"]
    assert len(out) > 250
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.98
    assert 0.001 <= sum(r.rejected for r in out) / len(out) <= 0.08


def test_language_edge_cases(spark):
    """Repeated rows, a text of 300,000 words, null ids, a language with one row, and columns with clashing names."""
    rows = [(i, f"the cat sat on the mat {i}", "en", "s", 0) for i in range(90)] + [(None, "the dog", "en", "s", 0), (7, "the cat", "en", "s", 0), (7, "the cat", "en", "s", 0), (500, "the cat " * 150_000, None, "s", 0), (501, "ζω και γράφω", "el", "s", 0)]
    d = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("rejected", F.lit("clash"))
    model = langid.train(d)
    assert model.langs == ["el", "en"]
    out = langid.predict(d, model).collect()
    assert len(out) == len(rows) and {r.lang_pred for r in out if r.doc_id != 501} == {"en"}
    assert [r.lang_pred for r in out if r.doc_id == 501] == ["el"]
    few = langid.sample_of(d, 20).filter("lang = 'en'").count()
    assert 5 <= few <= 45


def test_probabilities_sum_to_one():
    import numpy as np

    rows = np.array([[97, 98, 99], [97, 98, 97], [98, 99, 97], [99, 97, 98]], np.uint32)
    m = langid.fit(["x"], {"x": (rows, np.array([3, 1, 2, 2]))}, order=3)
    for context in ([97, 98], [98, 99], [99, 99]):
        total = sum(np.exp(m._logs(np.array([*context, c], np.uint32))[-1, 0]) for c in (97, 98, 99, 7))
        assert total == pytest.approx(1, abs=1e-9)


# ---- mixing ----


def test_mixing(spark):
    rows = [(i, f"t{i}", "en", "hot" if i % 3 else "rare", 0) for i in range(3000)] + [(5000, "t", "en", None, 0), (None, "t", "en", "hot", 0)]
    d = spark.createDataFrame(rows, SCHEMA).withColumn("copy", F.lit("clash"))
    out = mixing.mix(d, weights={"hot": 1.0, "rare": 1.0}, total=3000).collect()
    n = Counter(r.source for r in out)
    assert abs(n["hot"] - 1500) < 150 and abs(n["rare"] - 1500) < 150 and None not in n
    keys = [r.shuffle_key for r in out]
    assert keys == sorted(keys)
    by_doc = Counter(r.doc_id for r in out if r.source == "rare" and r.doc_id is not None)
    assert all(by_doc[r.doc_id] == r.repeats for r in out if r.source == "rare")
    rates = {r.source_key: r.rate for r in mixing.source_rates(d).collect()}
    salted = mixing.BROADCAST
    try:
        mixing.BROADCAST = 0
        other = mixing.mix(d, weights={"hot": 1.0, "rare": 1.0}, total=3000).collect()
    finally:
        mixing.BROADCAST = salted
    assert sorted(map(repr, other)) == sorted(map(repr, [type(other[0])(**{c: r[c] for c in other[0].__fields__}) for r in out]))
    assert rates["s:rare"] > 1 > rates["s:hot"]
    assert mixing.mix(d.limit(0)).count() == 0


def test_mixing_repeated_rows_null_texts_and_long_texts(spark):
    rows = [(1, "a", "en", "s", 1)] * 4 + [(2, None, None, None, None), (None, "", "en", "s", 0), (3, "x " * 100_000, "en", "t", 5)]
    d = spark.createDataFrame(rows, SCHEMA).withColumns({"copy": F.lit("clash"), "rate": F.lit("clash")})
    out = mixing.mix(d, weights={"s": 1.0, "t": 1.0}, total=1000).collect()
    assert len({sum(1 for r in out if r.doc_id == 1) % 4}) == 1 and sum(r.doc_id == 3 for r in out) > 300
    assert all(r.text == "x " * 100_000 for r in out if r.doc_id == 3)


def test_mixing_moves_whole_documents(spark, tmp_path):
    rows = [(i % 50, f"text {i}", "en", "s", 0) for i in range(400)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(d, total=800).collect()
    assert got == mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA), total=800).collect()  # the order is that of whole rows
    d.write.parquet(str(tmp_path / "documents.parquet"))
    plan = mixing.op9_mixing(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Sort":
        plan = plan.children().head()
    assert all(f"{c}#" in plan.children().head().output().mkString(",") for c in d.columns)


# ---- near duplicates ----


def brute_components(rows, percent=80):
    sets = [(i, set(shingle_set((t or "").encode()).tolist())) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_brute_force(spark, seed):
    """Families with more members than a small tile holds, some only linked by way of others, and a passage in all texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    passage = rng.choices(words, k=30)
    rows = []
    for _ in range(6):
        base = rng.choices(words, k=rng.choice([8, 60, 150])) + passage
        for _ in range(rng.choice([3, 60])):
            text = list(base)
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append(" ".join(text))
    rows += [rows[0]] * 5 + ["", "a b", "A B", "a b c"] + [" ".join(rng.choices(words, k=40) + passage) for _ in range(60)]
    rng.shuffle(rows)
    rows = [(3 * i, t) for i, t in enumerate(rows)]
    small = neardup.near_duplicates(docs(spark, rows, "n_shingles"), small=8)
    out = {r.doc_id: r.component_id for r in small.collect()}
    assert out == brute_components(rows)


def test_near_duplicates_in_small_blocks_and_size_bands(spark, monkeypatch):
    """One template in texts of many lengths, so that a large tile has several components, bands and blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 5)
    rng = random.Random(23)
    words = [f"w{i}" for i in range(900)]
    template = rng.choices(words, k=160)
    rows = []
    for k in range(150):
        text = template[: rng.choice([60, 75, 95, 120, 160])]
        rows.append((k, " ".join(text[: rng.choice([len(text), len(text) - rng.randrange(9)])] + rng.choices(words, k=rng.randrange(0, 14)))))
    out = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, rows), small=4).collect()}
    want = brute_components(rows)
    assert out == want and 3 < len(set(want.values())) < 140


def test_near_duplicate_edge_cases(spark):
    out = neardup.near_duplicates(docs(spark, ODD, "component_id")).collect()
    assert len(out) == len(ODD)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in out} == {(1, 7, 1), (2, 0, 2), (3, 0, 3), (None, 1, None), (4, 0, 4), (5, 1, 5), (6, 0, 6)}
    assert neardup.near_duplicates(docs(spark, ODD).limit(0)).count() == 0


def test_bitmaps_never_rule_out_a_link():
    rng = random.Random(9)
    for _ in range(200):
        base = [str(rng.random()) for _ in range(rng.choice([5, 9, 40, 300]))]
        other = [w if rng.random() > 0.02 else "x" + w for w in base] + ["tail"] * rng.randrange(2)
        a, b = shingle_set(" ".join(base).encode()), shingle_set(" ".join(other).encode())
        if neardup.reaches(a, b):
            assert neardup.may_reach(len(a), neardup._bitmap(a), len(b), neardup._bitmap(b))


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (None, 3)] + [(100 + i, 101 + i) for i in range(40)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: v for k, v in out.items() if k < 100} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert {v for k, v in out.items() if k >= 100} == {100}


def test_shingle_sets():
    assert len(shingle_set(b"")) == len(shingle_set(None)) == 0
    assert len(shingle_set(b"a b c d e f")) == 2 and len(shingle_set(b"a b")) == 1
    assert (shingle_set(b"A b\x0bC") == shingle_set(b" a  B\nc ")).all()
    assert hashlib.md5(shingle_set(b"a b").tobytes()).digest() != hashlib.md5(shingle_set(b"ab").tobytes()).digest()
