"""The whole pipeline against plain Python over the smallest table of documents, with near copies added whose lines are wrapped differently."""

import hashlib
import math
import os
import re
import struct
import zlib
from collections import Counter, defaultdict

import corpus_pipeline as cp
import pytest

from playlore.llm import linededup, mixing, packing, quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def clean(text):
    """What the quality rules leave of a text; None if they reject it."""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    if len(words) < quality.MIN_WORDS or 100 * len(again) > quality.MAX_REPEAT_PERCENT * len(words):
        return None

    def marked(line, n):
        if not (re.search(quality.NAVIGATION, line) or re.search(quality.BOILERPLATE, line)):
            return False
        phrases = [m for m in re.finditer(quality.BOILERPLATE + "s?", line) if not (line[: m.start()][-1:].isalnum() or line[m.end() :][:1].isalnum())]
        marks = len(re.findall(quality.NAVIGATION, line)) + sum(len(m[0].split()) for m in phrases)
        return marks > 0 and (n < quality.LONG_LINE or 100 * marks >= quality.MARKS_PERCENT * n)

    def fails(line):
        n = len(WORD.findall(line))
        upper, lower = len(re.findall(quality.UPPER, line)), len(re.findall(quality.LOWER, line))
        symbols = sum(c in "#*$%&|<>" for c in line)
        bad = marked(line, n) or 10 * symbols > len(line) or (upper >= 12 and upper > 2 * lower)
        return n > 0 and bool(bad or (n < 5 and not re.search(quality.TERMINAL, line)))

    lines = text.split("\n")
    lost = sum(len(x) for x in lines if fails(x))
    return None if lost / len(text) > quality.MAX_LOST else "\n".join(x for x in lines if not fails(x))


def without_repeats(texts):
    """texts (id -> text) without lines of runs of MIN_WORDS words that occur earlier."""
    lines = {i: t.split("\n") for i, t in texts.items()}
    seen, gone = set(), defaultdict(set)
    for i in sorted(lines):
        words = [len(WORD.findall(x)) for x in lines[i]]
        for a in range(len(words)):
            b, total = a, words[a]
            while words[a] and b + 1 < len(words) and total < linededup.MIN_WORDS:
                b, total = b + 1, total + words[b + 1]
            while words[a] and total >= linededup.MIN_WORDS and b < len(words) and b - a < 60:  # and some longer runs
                part = tuple(lines[i][a : b + 1])
                gone[i] |= set(range(a, b + 1)) if part in seen else set()
                seen.add(part)
                b += 1
                while b < len(words) and not words[b]:
                    b += 1
    left = {i: "\n".join(x for p, x in enumerate(lines[i]) if p not in gone[i]) if gone[i] else t for i, t in texts.items()}
    return {i: t for i, t in left.items() if WORD.search(t) or not gone[i]}


def one_of_each(texts):
    """texts without all but the first of each group of near-duplicates."""
    sets = {}
    for i, t in texts.items():
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t)]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    least = {i: i for i in texts}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            m = min(least[i], least[j])
            changed |= least[i] != m or least[j] != m
            least[i] = least[j] = m
    return {i: t for i, t in texts.items() if least[i] == i}


def copies(sources):
    """How often each document (id -> source) is repeated."""
    n = Counter(sources.values())
    share = {s: c**mixing.TEMPERATURE for s, c in n.items()}
    out = {}
    for i, s in sources.items():
        rate = share[s] / sum(share.values()) * len(sources) / n[s]
        u = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, total = 0, math.exp(-rate)
        while total <= u:
            k += 1
            total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        out[i] = k
    return out


def test_the_pipeline_gives_what_plain_python_gives(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS)
    long = [(r.doc_id, c) for r in docs.collect() if len(c := clean(r.text or "") or "") > 600]
    near = [(10_000 + i, c.replace("\n", " ") + " One more end.", "en", "near", 0) for i, c in long]
    docs.unionByName(spark.createDataFrame(near, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", "text", "source").collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    texts = {r.doc_id: c for r in rows if (c := clean(r.text or "")) is not None}
    assert 0 < len(texts) < len(rows)
    left = without_repeats(texts)
    assert left != texts
    single = one_of_each(left)
    assert len(single) < len(left)
    repeats = copies({r.doc_id: r.source for r in rows if r.doc_id in single})
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)), []
    for i, t in single.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        pieces = [(at, ids[at : at + 2048]) for at in range(0, len(ids), 2048)]
        want += [(i, k, at, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for k, (at, x) in enumerate(pieces)] * repeats[i]

    out = cp.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    ends = defaultdict(int)
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048
