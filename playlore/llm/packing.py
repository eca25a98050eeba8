"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Packing needs only how many pieces there are of each length, and lengths go up to
the capacity, so the plan is made from a histogram of at most `capacity` rows,
however many documents there are. Pieces above a third of the capacity are matched
greedily, largest first, each with the largest that still fits: no three of them
fit together, so at most two share a bin. Smaller pieces, largest first, go where
they leave the least room. Then each piece finds its place in the plan by its rank
among the pieces of its length, which is counted in two steps so that a length
that a third of all documents share is still spread over many tasks.

Edge cases: a null or empty text is its end token alone; repeated rows are packed
as often as they occur; a null doc_id is carried along; an empty table gives an
empty result with the same columns; input columns beyond doc_id and text are not
carried, so none can clash.
"""

from __future__ import annotations

import array
import bisect
import os
import re
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playlore.llm.common import read, row_key, stash

#: Production parameters. The tokenizer is a file, or the name of one of the installed public ones.
CAPACITY, END_TOKEN, TOKENIZER = 2048, 0, "word_bpe_49k.json"
#: Tasks' shares of one length, and words that a worker remembers (twice at most).
BUCKETS, REMEMBERED = 256, 250_000

PIECES = "row_key string, doc_id long, piece int, start long, length long, ids_crc32 long"


#: A word of lower-case letters that every step before the model leaves as they are, and the signs that may follow them: no
#: letter, number or part of a special token.
_PLAIN = re.compile("([a-zß-öø-ÿ]+)([!-/:;=?@\\[-`{}~]*)")
#: The letters of a byte-level model: a byte that prints is itself, the n-th other is U+0100 + n.
_PRINT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {x: chr(x) for x in _PRINT} | {x: chr(256 + n) for n, x in enumerate(x for x in range(256) if x not in _PRINT)}


def _plain_splits(tokenizer) -> bool:
    """Whether a run of plain letters is one input of the model, spelt by its bytes: asked of the tokenizer's own steps."""
    if tokenizer.pre_tokenizer is None or tokenizer.truncation or tokenizer.padding:
        return False
    for word in ("menteiega", "ßüß", "éöaÿ"):
        for signs in ("", ".", "$$$", "'", "!?"):
            text = word + signs if tokenizer.normalizer is None else tokenizer.normalizer.normalize_str(word + signs)
            spelt = ["".join(_LETTERS[x] for x in part.encode()) for part in (word, signs) if part]
            if text != word + signs or [t for t, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)] != spelt:
                return False
            if tokenizer.encode(text, add_special_tokens=False).ids != [t.id for part in spelt for t in tokenizer.model.tokenize(part)]:
                return False
    return True


class WordIds:
    """Token ids of white-space-separated words, as little-endian 32-bit numbers.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words
    in turn. Words are remembered in two generations of bounded size. A word of plain letters is given to the
    tokenizer's model at once, a fifth of the work, if the steps before it would hand it over as it is.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if os.sep not in name:
            import public_tokenizers

            name = public_tokenizers.path(name)
        self.tokenizer, self.young, self.old = Tokenizer.from_file(name), {}, {}
        self.model = self.tokenizer.model if _plain_splits(self.tokenizer) else None

    def _encode(self, word: bytes) -> bytes:
        text = word.decode()
        plain = _PLAIN.fullmatch(text) if self.model is not None else None
        if plain is not None and plain[2]:  # signs after letters are a part of their own, so such words share the letters' ids
            return self[plain[1].encode()] + self[plain[2].encode()]
        if plain is not None:
            ids = [t.id for t in self.model.tokenize(text if text.isascii() else "".join(map(_LETTERS.__getitem__, word)))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return _little(ids)

    def __getitem__(self, word: bytes) -> bytes:
        found = self.young.get(word)
        if found is None:
            found = self.old.get(word)
            if found is None:
                found = self._encode(word)
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[word] = found
        return found

    def of(self, text: bytes) -> bytes:
        low = text.lower()  # of ASCII letters only; the tokenizer lowers all, but its special tokens are matched before
        words, get, out = (text if b"<|" in low else low).split(), self.young.get, []
        for w in words:
            ids = get(w)
            if ids is None:
                ids = self[w]
                get = self.young.get
            out.append(ids)
        return b"".join(out)


def _little(ids: list[int]) -> bytes:
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


_LOADED: dict[str, WordIds] = {}


def _loaded(name: str) -> WordIds:
    if name not in _LOADED:
        _LOADED[name] = WordIds(name)
    return _LOADED[name]


def tokenised(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END_TOKEN) -> DataFrame:
    """A row for each piece. Documents longer than capacity are cut; all others stay whole."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, size = _loaded(tokenizer), end.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, doc, text in zip(keys, ids, batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                data = words.of(text) + last
                for piece, at in enumerate(range(0, len(data), size)):
                    part = data[at : at + size]
                    rows.append((key, doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("row_key", "doc_id", "piece", "start", "length", "ids_crc32")
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(row_key(F.col("doc_id"), F.col("text")), F.col("doc_id").cast("long"), body).mapInArrow(cut, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, count, base, offset, each): the pieces of that length ranked first to first + count - 1 go `each` to a sequence, in sequences from base on, at offset and on.

    histogram: how many pieces have each length. All work is on counts.
    """
    left = {n: c for n, c in histogram.items() if c}
    used: dict[int, int] = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int, int]] = []
    bins, gaps, keys = 0, {}, []  # gap -> [(base, count)]; keys: the gaps, sorted

    def place(length: int, count: int, base: int, offset: int, each: int = 1) -> None:
        out.append((length, used[length], count, base, offset, each))
        used[length] += count
        left[length] -= count

    def free(gap: int, base: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(keys, gap)
            gaps[gap].append((base, count))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - n) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        if at < 0:
            count = left[n]
            place(n, count, bins, 0)
            free(capacity - n, bins, count)
        else:
            m = large[at]
            count = left[n] // 2 if m == n else min(left[n], left[m])
            if not count:  # one of this length is left, and it can go with no other of its own
                large_below = [x for x in large[:at] if left[x]]
                m = large_below[-1] if large_below else 0
                count = 1
            place(n, count, bins, 0)
            if m:
                place(m, count, bins, n)
            free(capacity - n - m, bins, count)
        bins += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(keys, n)
            if at == len(keys):
                each = min(capacity // n, left[n])
                count = left[n] // each
                place(n, count * each, bins, 0, each)
                free(capacity - each * n, bins, count)
                bins += count
                continue
            gap = keys[at]
            base, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                keys.pop(at)
            each = min(gap // n, left[n])
            taken = min(count, left[n] // each)
            place(n, taken * each, base, capacity - gap, each)
            free(gap - each * n, base, taken)
            free(gap, base + taken, count - taken)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. pieces is read more than once, so it should be a written table."""
    spark = pieces.sparkSession
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("row_key", "piece"), F.lit(BUCKETS)).cast("int"))
    counts = stash(dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row_key", "piece")) - 1)
    ranked = ranked.join(firsts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    schema = "length long, first long, count long, base long, offset0 long, each long"
    steps = spark.createDataFrame(plan(histogram, capacity), schema)
    by_length = steps.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "count", "base", "offset0", "each"))).alias("steps"))
    # the plan has a bounded number of rows: at most `capacity` lengths
    placed = ranked.join(F.broadcast(by_length), "length").withColumn("step", F.element_at(F.filter("steps", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["first"] + s["count"])), 1))
    at = F.col("rank") - F.col("step.first")
    each = F.col("step.each")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("step.base") + F.floor(at / each)).cast("long").alias("sequence_id"),
        (F.col("step.offset0") + (at % each) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END_TOKEN) -> DataFrame:
    return pack(stash(tokenised(docs, tokenizer, capacity, end), "pieces"), capacity)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
