"""Language identification by interpolated Kneser-Ney character models.

For each language, character n-grams of orders 1 to ORDER are counted over the
training documents, in Spark: tasks add up their own counts, a shuffle adds up
theirs. Probabilities are interpolated with Kneser-Ney discounts: the highest
order from counts, lower orders from how many different characters an n-gram
was seen after. A model is a sorted array of n-gram hashes with a column of
log-probabilities for each language; texts are scored by look-ups in it.

A text gets the language of the lowest cross-entropy a character, and a score:
the probability of that language against the others. Rejection is calibrated by
the cross-entropies of sampled texts outside the counts: `rejected` says that the
text's is above all but REJECT of theirs.

Bounds: the model is fitted on a sample of the labelled documents, each taken with
the probability that makes SAMPLE of its language on average, by a hash of its id;
all n-grams of the sample count. Labels are few: over MOST_LANGS is an error. Whole
texts are scored, and all of them.

Edge cases: a null text, or one without letters, is "und" with score 0; a document
without an id is not held out and teaches nothing, nor do rows without a language;
repeated rows count as often as they occur; a language of under APART_FROM labelled
rows is never rejected; without any training document all is "und"; an empty table
stays empty; other columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playlore.llm.common import read, stash

#: Production parameters.
ORDER, SAMPLE, DISCOUNT, REJECT, FOLDS, MOST_LANGS = 4, 4000, 0.75, 0.02, 3, 5000
#: One sampled document in so many is kept from the counts, to calibrate rejection with, if its language has APART_FROM.
CALIBRATE, APART_FROM = 5, 50
#: A text's characters are scored in pieces of this many, to bound memory.
PIECE = 1_000_000
#: No character.
GAP = 0x1FFFFF
#: Highest bits of a hash that index the sorted arrays.
INDEX_BITS = 17


def codes(text: str) -> np.ndarray:
    """Lower-cased letters as code points, each run of anything else as one space, with a space at both ends. Empty without letters."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _is_letter(points)
    if not letters.any():
        return np.zeros(0, np.uint32)
    kept = letters.copy()
    kept[1:] |= letters[:-1]  # the first of each run of others
    kept[0] = True
    return np.where(letters, points, np.uint32(32))[kept]


_LETTERS = np.zeros(0x110000, np.int8)  # 0: not looked up yet, 1: letter, 2: other


def _is_letter(points: np.ndarray) -> np.ndarray:
    known = _LETTERS[points]
    if (new := known == 0).any():
        for p in np.unique(points[new]).tolist():
            _LETTERS[p] = 1 if chr(p).isalpha() else 2
        known = _LETTERS[points]
    return known == 1


def grams(c: np.ndarray, order: int) -> np.ndarray:
    """The n-grams that end at each character from the second on, shorter ones not at all."""
    out = np.zeros(max(len(c) - order + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(order):
            out = out * np.uint64(0x100000001B3) + c[k : len(c) - order + 1 + k]
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return _spread(out)


def _spread(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


COUNTED = "lang string, gram binary, n long"


def _counted(order: int):
    """Counts of the n-grams of the highest order, as the characters themselves, added up within a task's batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(c := codes(text)) >= order:
                    by.setdefault(lang, []).append(np.lib.stride_tricks.sliding_window_view(c, order))
            for lang, parts in by.items():
                both = np.ascontiguousarray(np.concatenate(parts))
                values, n = np.unique(both.view(f"V{4 * order}").ravel(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array([v.tobytes() for v in values], pa.binary()), pa.array(n)], names=["lang", "gram", "n"])

    return run


@dataclass
class Model:
    """Log-probabilities by order: hashes sorted, and a row of `langs` columns for each. Where a language lacks an n-gram, the value is its back-off already filled in."""

    langs: list[str]
    hashes: list[np.ndarray]
    logs: list[np.ndarray]
    backs: list[np.ndarray]  # of the contexts of each order, by the same hashes
    starts: list[np.ndarray]  # of each order: where the hashes with the same INDEX_BITS highest bits begin
    unseen: np.ndarray  # of a character that no training text has
    highest: np.ndarray  # by language, the cross-entropy that all but REJECT of its texts outside the counts have at most

    def find(self, order: int, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of g in the hashes of an order, and whether they are there. Hashes are even, so a few steps from the start of their bucket reach them."""
        hashes, starts = self.hashes[order - 1], self.starts[order - 1]
        bucket = (g >> np.uint64(64 - INDEX_BITS)).astype(np.int64)
        at, left = starts[bucket], np.flatnonzero(starts[bucket + 1] - starts[bucket] > 1)
        while len(left):
            left = left[hashes[at[left]] < g[left]]
            at[left] += 1
            left = left[at[left] < starts[bucket[left] + 1] - 1]
        at = np.minimum(at, len(hashes) - 1)
        return at, hashes[at] == g

    def entropy(self, c: np.ndarray) -> np.ndarray:
        """Cross-entropy a character, for each language."""
        order, total, seen = len(self.hashes), np.zeros(len(self.langs)), 0
        for at in range(0, max(len(c) - 1, 1), PIECE):
            part = c[max(at - order + 2, 0) : at + 1 + PIECE]
            lead = min(at, order - 2) if at else 0
            total += self._logs(part)[lead:].sum(axis=0)
            seen += len(part) - 1 - lead
        return -total / max(seen, 1)

    def entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """entropy() of each text of two characters or more. Short texts are scored together, apart by characters that no n-gram has."""
        out, order = np.zeros((len(texts), len(self.langs))), len(self.hashes)
        gap, group, size = np.full(order - 1, GAP, np.uint32), [], 0
        for i, c in enumerate(texts):
            if len(c) > PIECE // 8:
                out[i] = self.entropy(c)
                continue
            group.append(i)
            size += len(c)
            if size > PIECE // 8:
                self._together(texts, group, gap, out)
                group, size = [], 0
        self._together(texts, group, gap, out)
        return out

    def _together(self, texts: list[np.ndarray], group: list[int], gap: np.ndarray, out: np.ndarray) -> None:
        if group:
            lengths = np.array([len(texts[i]) for i in group])
            ends = np.cumsum(lengths + len(gap))
            logs = np.vstack([np.zeros((1, len(self.langs))), np.cumsum(self._logs(np.concatenate([x for i in group for x in (texts[i], gap)])), axis=0)])
            first = ends - len(gap) - lengths
            out[group] = -(logs[first + lengths - 1] - logs[first]) / (lengths - 1)[:, None]

    def _logs(self, c: np.ndarray) -> np.ndarray:
        """A row for each character from the second on, given up to order - 1 before it."""
        n = len(c) - 1
        out, open_ = np.zeros((n, len(self.langs))), np.ones(n, bool)
        for order in range(len(self.hashes), 0, -1):
            ends = np.arange(max(order - 1, 1), n + 1) - 1  # rows whose n-gram of this order exists
            todo = ends[open_[ends]]
            if not len(todo):
                continue
            g = grams(c, order)[todo + 2 - order]
            at, hit = self.find(order, g)
            out[todo[hit]] += self.logs[order - 1][at[hit]]
            open_[todo[hit]] = False
            if order > 1:  # go on with the next lower order, at the price of this context
                miss = todo[~hit]
                h = grams(c, order - 1)[miss + 2 - order]
                at, known = self.find(order - 1, h)
                out[miss[known]] += self.backs[order - 2][at[known]]
        out[open_] += self.unseen
        return out


def fit(langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER, discount: float = DISCOUNT) -> Model:
    """counts: for each language the n-grams of the highest order, as rows of characters, and how often each occurs."""
    hashes: list[np.ndarray] = [None] * order
    probs: list[np.ndarray] = [None] * order
    backs: list[np.ndarray] = [None] * order
    alphabet = len(np.unique(np.concatenate([g.ravel() for g, _ in counts.values()])))
    by_order: list[dict] = [{} for _ in range(order)]
    for lang, (rows, n) in counts.items():
        by_order[order - 1][lang] = (rows, n.astype(float))
        for k in range(order - 1, 0, -1):  # an n-gram counts once for each character it was seen after
            longer = by_order[k][lang][0]
            shorter, seen = np.unique(np.ascontiguousarray(longer[:, 1:]).view(f"V{4 * k}").ravel(), return_counts=True)
            by_order[k - 1][lang] = (np.frombuffer(shorter.tobytes(), np.uint32).reshape(-1, k), seen.astype(float))
    hashed = lambda rows: grams_of_rows(rows)
    for k in range(order):
        hashes[k] = np.unique(np.concatenate([hashed(rows) for rows, _ in by_order[k].values()]))
        probs[k], backs[k] = np.zeros((len(hashes[k]), len(langs))), np.zeros((len(hashes[k]), len(langs)))
    for j, lang in enumerate(langs):
        for k in range(order):
            rows, n = by_order[k][lang]
            if k == 0:
                base = 1 / (alphabet + 1)
                mass = n.sum()
                p = np.full(len(hashes[0]), discount * len(n) / mass * base)
                p[np.searchsorted(hashes[0], hashed(rows))] += np.maximum(n - discount, 0) / mass
                probs[0][:, j] = p
                continue
            own = hashed(rows)
            context = hashed(np.ascontiguousarray(rows[:, :-1]))
            names, inverse = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(inverse, n), np.bincount(inverse)
            weight = discount * kinds / total
            back = np.ones(len(hashes[k - 1]))
            at = np.minimum(np.searchsorted(hashes[k - 1], names), len(hashes[k - 1]) - 1)
            good = hashes[k - 1][at] == names
            back[at[good]] = weight[good]
            backs[k - 1][:, j] = np.log(back)
            # every n-gram that any language has: this one's interpolated probability, back-off filled in
            every = _rows_of(hashes[k], by_order[k])
            ctx = np.minimum(np.searchsorted(hashes[k - 1], hashed(np.ascontiguousarray(every[:, :-1]))), len(hashes[k - 1]) - 1)
            same = hashes[k - 1][ctx] == hashed(np.ascontiguousarray(every[:, :-1]))
            low = np.minimum(np.searchsorted(hashes[k - 1], hashed(np.ascontiguousarray(every[:, 1:]))), len(hashes[k - 1]) - 1)
            p = np.where(same, back[ctx], 1.0) * probs[k - 1][low, j]
            p[np.searchsorted(hashes[k], own)] += np.maximum(n - discount, 0) / total[inverse]
            probs[k][:, j] = p
    unseen = np.log([discount * len(by_order[0][g][1]) / by_order[0][g][1].sum() / (alphabet + 1) for g in langs])
    edges = np.arange(2**INDEX_BITS, dtype=np.uint64) << np.uint64(64 - INDEX_BITS)
    starts = [np.append(np.searchsorted(h, edges), len(h)) for h in hashes]
    return Model(langs, hashes, [np.log(p) for p in probs], backs, starts, unseen, np.full(len(langs), np.inf))


def grams_of_rows(rows: np.ndarray) -> np.ndarray:
    k = rows.shape[1]
    out = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(0x100000001B3) + rows[:, i]
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return _spread(out)


def _rows_of(hashes: np.ndarray, by_lang: dict) -> np.ndarray:
    k = next(iter(by_lang.values()))[0].shape[1]
    out = np.zeros((len(hashes), k), np.uint32)
    for rows, _ in by_lang.values():
        out[np.searchsorted(hashes, grams_of_rows(rows))] = rows
    return out


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % folds).cast("int")


def sample_of(labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, text, apart): the documents that the model is fitted on. No row moves: a broadcast row a language says how likely one is taken."""
    usable = labelled.filter("lang is not null and text is not null and doc_id is not null")
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGS + 1).collect()
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"over {MOST_LANGS} labels: that is no column of languages")
    rates = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, sample / r["n"]), r["n"] >= APART_FROM) for r in sizes], "lang string, rate double, enough boolean")
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / float(1 << 31) < F.col("rate")
    apart = F.col("enough") & (F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(CALIBRATE)) == 0)
    return usable.join(F.broadcast(rates), "lang").filter(drawn).select("lang", "text", apart.alias("apart"))


def train(labelled: DataFrame, order: int = ORDER, sample: int = SAMPLE) -> Model | None:
    """labelled: doc_id, text, lang. What comes to the driver is the distinct n-grams of the bounded sample."""
    chosen = stash(sample_of(labelled, sample), "language-sample")
    counts = chosen.filter("not apart").mapInArrow(_counted(order), COUNTED).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    kept = counts.select("lang", "gram", "n").toArrow()
    if not kept.num_rows:
        return None
    lang = np.array(kept["lang"].to_pylist(), object)
    rows = np.frombuffer(b"".join(kept["gram"].to_pylist()), np.uint32).reshape(-1, order)
    n = kept["n"].to_numpy()
    langs = sorted(set(lang.tolist()))
    model = fit(langs, {g: (np.ascontiguousarray(rows[lang == g]), n[lang == g]) for g in langs}, order)
    held = chosen.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [(g, c) for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if g in held.value.langs and len(c := codes(t)) > 1]
            h = held.value.entropies([c for _, c in some])
            found = [(g, float(x[held.value.langs.index(g)])) for (g, _), x in zip(some, h, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["lang", "h"])

    marks = chosen.filter("apart").mapInArrow(measured, "lang string, h double").groupBy("lang").agg(F.percentile("h", F.lit(1 - REJECT)).alias("q")).collect()
    by = {r["lang"]: r["q"] for r in marks}
    model.highest = np.array([by.get(g, np.inf) for g in langs])
    return model


PREDICTED = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"


def decide(model: Model, h: np.ndarray, length: int) -> tuple[str, float, float, bool]:
    """h: the cross-entropies of a text of so many characters."""
    best = int(np.argmin(h))
    # log-likelihood ratios grow with length; the cap keeps scores of long texts apart
    odds = np.exp(-(h - h[best]) * min(length - 1, 50))
    return model.langs[best], float(odds[best] / odds.sum()), float(h[best]), bool(h[best] > model.highest[best])


def decisions(model: Model | None, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
    out: list[tuple[str, float, float | None, bool]] = [("und", 0.0, None, True)] * len(texts)
    if model is None:
        return out
    some = [(i, c) for i, t in enumerate(texts) if len(c := codes(t or "")) > 1]
    for (i, c), h in zip(some, model.entropies([c for _, c in some]), strict=True):
        out[i] = decide(model, h, len(c))
    return out


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = decisions(held.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))],
                names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PREDICTED)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(fold(F.col("doc_id")) != 1))
    made = predict(docs, model)
    return made.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
