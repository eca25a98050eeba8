"""Exact n-gram Jaccard join: documents whose shingle sets reach a similarity, and their components.

1. Each text becomes a sorted array of shingle hashes, and a bitmap of them whose
   width depends on the size band of the set. Equal sets are linked by their digest.
2. Two sets that reach the similarity share one of the first shingles of each, in any
   order that is the same for all ("prefix"). The order here is by hash, with a
   bounded list of frequent shingles last; the list changes the work, never the result.
3. Tiles are the documents of one prefix shingle. A small tile gives its pairs of
   similar size. A large one gives a star around the document most of whose prefix
   lies in large tiles; once the links are known, only pairs of different components
   are left. For these a tile beyond one block is cut into size bands: only a band with itself and its
   neighbours can link, and of these only those that hold two components. Blocks of
   two bands are compared by bitmaps, without listing pairs.
4. A pair's bitmaps bound its overlap from above; pairs that pass are intersected exactly.
5. Components come from the links by a distributed algorithm.

Result for each row: n_shingles, and component_id, the smallest doc_id reachable.
Edge cases: a text of fewer words than a shingle is one shingle; a null or empty
text has none and links with nothing; repeated rows link as equal sets; rows of
one doc_id are one node; a null doc_id links with nothing and has a null
component; an empty table stays empty; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playlore.llm.common import WORD, forget, marked, read, stash
from playlore.llm.components import components
from playlore.llm.shingles import shingle_set

#: Production parameters: the similarity in percent; tiles up to SMALL give all their pairs, larger ones are dealt in blocks of about BLOCK.
PERCENT, SMALL, BLOCK = 80, 32, 2048
#: Bits for each shingle in the bitmaps of large tiles, whose many pairs want a closer bound.
WIDE = 4
#: A shingle is frequent if chunks of rows that have it OFTEN times each count it COMMON times; at most LISTED are listed.
COMMON, OFTEN, LISTED, CHUNK = 32, 3, 500_000, 4000


def _bitmap(s: np.ndarray, times: int = 2) -> bytes:
    """Bits of the hashes' low ends; the width is a power of two, so many times the set's size at least."""
    width = max(64, 1 << int(times * len(s) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(a: int, size: int, to: int) -> int:
    """A bitmap of `size` bytes folded to `to` bytes: the bitmap that the same set has at that width."""
    while size > to:
        size //= 2
        a = (a >> (8 * size)) | (a & ((1 << (8 * size)) - 1))
    return a


def may_reach(na: int, bits_a: bytes, nb: int, bits_b: bytes, percent: int = PERCENT) -> bool:
    """False if the bitmaps prove that the overlap is too small: each bit that only one set has is an element the other lacks."""
    to = min(len(bits_a), len(bits_b))
    a = _folded(int.from_bytes(bits_a, "little"), len(bits_a), to)
    b = _folded(int.from_bytes(bits_b, "little"), len(bits_b), to)
    most = min(na - (a & ~b).bit_count(), nb - (b & ~a).bit_count())
    return (100 + percent) * most >= percent * (na + nb)


def reaches(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    named = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, named, strict=True)], names=[n for n, _ in named])


SKETCH = "doc_id long, n long, h1 long, h2 long, bits binary, frequent long"


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text, and one (n = -count) for each shingle that a chunk of rows has often."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            ids, sets = part.column(0).to_pylist(), [shingle_set(t) for t in part.column(1).cast(pa.binary()).to_pylist()]
            with np.errstate(over="ignore"):
                h1 = [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
                h2 = [int((s * (s | np.uint64(1))).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            yield _batch(SKETCH, ids, [len(s) for s in sets], h1, h2, [_bitmap(s) if len(s) else b"" for s in sets], [None] * len(ids))
            values, counts = np.unique(np.concatenate(sets), return_counts=True)
            often = counts >= OFTEN
            if often.any():
                none = [None] * int(often.sum())
                yield _batch(SKETCH, none, -counts[often], none, none, none, values[often].view(np.int64))


def _prefixes(frequent, percent: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = frequent.value, set()
        for batch in batches:
            shingles, docs, sizes = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                s = shingle_set(text)
                n = len(s)
                if not n or (digest := xxhash.xxh3_128_digest(s.tobytes())) in seen:
                    continue
                seen.add(digest)
                common = np.isin(s, last, assume_unique=True) if len(last) else np.zeros(n, bool)
                kept = n - (percent * n + 99) // 100 + 1
                s = np.concatenate([s[~common], s[common]])[:kept]
                shingles.append(s)
                docs.append(np.full(kept, doc))
                sizes.append(np.full(kept, n))
            if len(seen) > 200_000:
                seen.clear()
            if shingles:
                yield _batch(TILE, np.concatenate(shingles).view(np.int64), np.concatenate(docs), np.concatenate(sizes))

    return emit


TILE = "shingle long, doc_id long, n long"
PAIR = "shingle long, a long, b long, n long"


def _similar_size(x, y, percent: int):
    return (100 * x >= percent * y) & (100 * y >= percent * x)


def _tiles(percent: int, small: int):
    """Rows sorted by shingle -> pairs of small tiles (shingle null), and the rows of large ones (b null)."""

    def pairs(shingle: np.ndarray, doc: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
        held = np.diff(np.r_[first, len(shingle)])
        found = []
        for m in range(2, small + 1):
            if len(at := first[held == m]):
                i, j = np.triu_indices(m, 1)
                x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                ok = _similar_size(n[x], n[y], percent) & (doc[x] != doc[y])
                found.append(np.stack([np.minimum(doc[x], doc[y])[ok], np.maximum(doc[x], doc[y])[ok]], 1))
        if found and len(both := np.ascontiguousarray(np.concatenate(found))):
            one = np.unique(both.view([("a", "i8"), ("b", "i8")]).ravel())
            none = [None] * len(one)
            yield _batch(PAIR, none, one["a"], one["b"], none)
        big = np.repeat(held > small, held)
        if big.any():
            yield _batch(PAIR, shingle[big], doc[big], [None] * int(big.sum()), n[big])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, open_big = [np.zeros(0, np.int64)] * 3, None
        for batch in batches:
            cols = [np.concatenate([k, c.to_numpy(zero_copy_only=False)]) for k, c in zip(kept, batch.columns, strict=True)]
            if open_big is not None and len(cols[0]):
                going = cols[0] == open_big  # more rows of a tile that is known to be large
                if going.any():
                    yield _batch(PAIR, cols[0][going], cols[1][going], [None] * int(going.sum()), cols[2][going])
                    cols = [c[~going] for c in cols]
            if not len(cols[0]):
                kept = cols
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            yield from pairs(*[c[:cut] for c in cols]) if cut else ()
            kept, open_big = [c[cut:] for c in cols], None
            if len(kept[0]) > small:
                open_big = kept[0][0]
                yield _batch(PAIR, kept[0], kept[1], [None] * len(kept[0]), kept[2])
                kept = [c[:0] for c in kept]
        if len(kept[0]):
            yield from pairs(*kept)

    return run


def _bounded(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, ba, nb, bb = [c.to_pylist() for c in batch.columns]
            ok = [may_reach(*x, percent) for x in zip(na, ba, nb, bb, strict=True)]
            yield _batch("a long, b long", [x for x, y in zip(a, ok, strict=True) if y], [x for x, y in zip(b, ok, strict=True) if y])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def of(doc: int, text: bytes) -> np.ndarray:
            if doc not in held:
                if len(held) >= 64:
                    held.clear()
                held[doc] = shingle_set(text)
            return held[doc]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist()
            ok = [reaches(of(x, tx), shingle_set(ty), percent) for x, tx, ty in zip(a, ta, tb, strict=True)]
            del b[len(ok) :]
            yield _batch("a long, b long", [x for x, y in zip(a, ok, strict=True) if y], [x for x, y in zip(b, ok, strict=True) if y])

    return run


def _blocks(percent: int):
    """Rows (centre, low, high, i, j, doc_id, n, band, component, bits) sorted by the first five -> pairs of different components that the bitmaps don't rule out.

    low and high are the bands that meet: one band with itself, or two neighbours, of which only pairs across count.
    """

    def survivors(across: bool, doc: np.ndarray, n: np.ndarray, band: np.ndarray, component: np.ndarray, bits: list[bytes]) -> np.ndarray:
        order = np.argsort(n, kind="stable")
        doc, n, band, component, bits = doc[order], n[order], band[order], component[order], [bits[i] for i in order]
        widths, found, folded = np.array([len(b) for b in bits]), [], {}
        for w in np.unique(widths).tolist():  # a partner is at most as much larger as to be one width up
            first, last = np.searchsorted(widths, [w, 2 * w], side="left")[0], np.searchsorted(widths, 2 * w, side="right")
            rows = b"".join(_folded(int.from_bytes(b, "little"), len(b), w).to_bytes(w, "little") for b in bits[first:last])
            folded[w] = first, np.frombuffer(rows, np.uint64).reshape(-1, w // 8)
        ends = np.searchsorted(n, 100 * n // percent, side="right")
        for i in range(len(doc)):
            first, rows = folded[int(widths[i])]
            at = np.arange(i + 1, min(ends[i], first + len(rows)))
            at = at[(component[at] != component[i]) & (doc[at] != doc[i]) & ((band[at] != band[i]) | (not across))]
            if len(at):
                mine, other = rows[i - first], rows[at - first]
                most = np.minimum(n[i] - np.bitwise_count(mine & ~other).sum(1, dtype=np.int64), n[at] - np.bitwise_count(other & ~mine).sum(1, dtype=np.int64))
                at = at[(100 + percent) * most >= percent * (n[i] + n[at])]
                found.append(np.stack([np.minimum(doc[i], doc[at]), np.maximum(doc[i], doc[at])], 1))
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, ([], [], [], [], [])

        def out() -> Iterator[pa.RecordBatch]:
            if len(rows[0]) > 1:
                found = survivors(held[1] != held[2], *[np.array(r) for r in rows[:4]], rows[4])
                if len(found):
                    yield _batch("a long, b long", found[:, 0], found[:, 1])

        for batch in batches:
            for key, *row in zip(zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True), *[batch.column(k).to_pylist() for k in range(5, 10)], strict=True):
                if key != held:
                    yield from out()
                    held, rows = key, ([], [], [], [], [])
                for r, x in zip(rows, row, strict=True):
                    r.append(x)
        yield from out()

    return run


def _widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield _batch("doc_id long, bits binary", batch.column(0).to_pylist(), [_bitmap(s, WIDE) for s in sets])


def size_band(n, percent: int):
    """Sets that reach the similarity are in one band of sizes or in neighbouring ones."""
    return F.floor(F.log(n) / F.log(F.lit(100.0 / percent + 1e-6))).cast("int")


def _across(left: DataFrame, held: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs of different components within the tiles of left (centre, doc_id, n, component), by size bands and blocks of about `block` documents: a task holds two blocks at most."""
    bits = marked(held, left.select("doc_id")).filter("maybe").select("doc_id", "text").mapInArrow(_widened, "doc_id long, bits binary")
    sizes = left.groupBy("centre").agg(F.count(F.lit(1)).alias("held"))
    # a tile of one block is compared at once, in the order of sizes; only larger ones are cut
    banded = left.join(sizes, "centre").withColumn("band", F.when(F.col("held") <= block, F.lit(0)).otherwise(size_band(F.col("n"), percent))).drop("held")
    counts = banded.groupBy("centre", "band").agg(F.count(F.lit(1)).alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    w = Window.partitionBy("centre").orderBy("band")  # a row for each band: a few dozen
    near = lambda step, c: F.when(F.abs(step("band").over(w) - F.col("band")) == 1, step(c).over(w))
    met = counts.select("centre", "band", "lo", "hi", _dealt(F.col("c"), block).alias("blocks"), *[near(s, c).alias(f"{c}_{k}") for k, s in (("down", F.lag), ("up", F.lead)) for c in ("c", "lo", "hi")])
    # a band of one component has nothing to compare within itself, nor two bands of the same one
    one = lambda k: (F.col("lo") == F.col("hi")) & (F.col(f"lo_{k}") == F.col(f"hi_{k}")) & (F.col("lo") == F.col(f"lo_{k}"))
    other = lambda k: F.when(F.col(f"c_{k}").isNotNull() & ~one(k), _dealt(F.col(f"c_{k}"), block)).otherwise(0)
    met = met.select("centre", "band", "blocks", F.when(F.col("lo") < F.col("hi"), F.col("blocks")).otherwise(0).alias("own_blocks"), other("down").alias("down"), other("up").alias("up"))
    placed = banded.join(met, ["centre", "band"]).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    b, own = F.col("band"), F.col("own")
    key = lambda low, high, i, j: F.struct(low.alias("low"), high.alias("high"), i.alias("i"), j.alias("j"))
    each = lambda count, made: F.transform(F.filter(F.sequence(F.lit(-1), F.col(count) - 1), lambda x: x >= 0), made)
    meets = F.concat(
        each("own_blocks", lambda x: key(b, b, F.least(own, x), F.greatest(own, x))),
        each("up", lambda x: key(b, b + 1, own, x)),
        each("down", lambda x: key(b - 1, b, x, own)),
    )
    dealt = placed.withColumn("meets", meets).filter(F.size("meets") > 0).join(bits, "doc_id").withColumn("m", F.explode("meets")).select("centre", "m.low", "m.high", "m.i", "m.j", "doc_id", "n", "band", "component", "bits")
    keys = ["centre", "low", "high", "i", "j"]
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_blocks(percent), "a long, b long").distinct()


def _dealt(count, block: int):
    return F.ceil(count / block).cast("int")


def _passing(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs whose bitmaps don't rule them out."""
    side = lambda x: sketches.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "bitsa", "nb", "bitsb")
    return joined.mapInArrow(_bounded(percent), "a long, b long").distinct()


def _links(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs that reach the similarity, from their whole texts."""
    texts = marked(texts, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))).filter("maybe")
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text{x}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "texta", "textb")
    return joined.mapInArrow(_verified(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, small: int = SMALL) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    made = stash(texts.mapInArrow(_sketched, SKETCH), "sketches")
    every = made.filter("frequent is null").drop("frequent")
    nodes = every.filter("doc_id is not null and n > 0")
    equal = nodes.select("doc_id", "n", "h1", "h2").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    equal = stash(nodes.join(stash(equal, "equal-sets"), ["n", "h1", "h2"]).select(F.col("doc_id").alias("a"), "b").filter("a != b"), "equal-links")

    counted = made.filter("frequent is not null").groupBy("frequent").agg(F.sum(-F.col("n")).alias("c")).filter(F.col("c") >= COMMON)
    listed = counted.orderBy(F.desc("c"), "frequent").limit(LISTED).select("frequent").toPandas()["frequent"]  # at most LISTED numbers
    frequent = spark.sparkContext.broadcast(np.sort(listed.to_numpy(np.int64).view(np.uint64)))
    # one document of each equal set goes on; few are marked, and only those move to be looked up
    again = nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("doc_id")
    spare = stash(equal.select(F.col("a").alias("doc_id")).distinct().join(again, "doc_id", "left_anti"), "spare")
    split = marked(texts.filter("doc_id is not null"), spare)
    single = split.filter("not maybe").drop("maybe").unionByName(split.filter("maybe").drop("maybe").join(spare, "doc_id", "left_anti"))
    rows = single.mapInArrow(_prefixes(frequent, percent), TILE)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles = stash(rows.repartition(parts, "shingle").sortWithinPartitions("shingle", "doc_id").mapInArrow(_tiles(percent, small), PAIR), "tiles")

    large = tiles.filter("shingle is not null").select("shingle", F.col("a").alias("doc_id"), "n")
    score = large.groupBy("doc_id").agg((F.count(F.lit(1)) / F.first("n")).alias("score"))
    large = stash(large.join(score, "doc_id"), "large-tiles")
    centre = large.groupBy("shingle").agg(F.max(F.struct("score", -F.col("doc_id"))).alias("m"), F.max_by(F.struct("doc_id", "n"), F.struct("score", -F.col("doc_id"))).alias("c"))
    # large tiles around one document are one: whoever shares a shingle is still together, and each document is in it once
    large = large.join(centre.select("shingle", F.col("c.doc_id").alias("centre"), F.col("c.n").alias("centre_n")), "shingle").select("centre", "centre_n", "doc_id", "n").distinct()
    large = stash(large, "merged-tiles")
    star = large.filter((F.col("doc_id") != F.col("centre")) & _similar_size(F.col("n"), F.col("centre_n"), percent))
    star = star.select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b"))
    pairs = tiles.filter("shingle is null").select("a", "b").unionByName(star).distinct()
    sketches = nodes.select("doc_id", "n", "bits")
    passing = stash(_passing(pairs, sketches, percent), "passing")
    wanted = passing.select(F.col("a").alias("doc_id")).union(passing.select("b")).union(large.select("doc_id")).distinct()
    held = stash(marked(texts, wanted).filter("maybe").drop("maybe"), "held-texts")
    links = stash(_links(passing, held, percent).unionByName(equal), "links")

    if not large.isEmpty():
        known = components(links).withColumnRenamed("node", "doc_id")
        placed = stash(large.join(known, "doc_id", "left").select("centre", "doc_id", "n", F.coalesce("component", "doc_id").alias("component")), "placed")
        mixed = placed.groupBy("centre").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("centre")
        more = stash(_across(stash(placed.join(mixed, "centre"), "mixed-tiles"), held, percent, BLOCK), "across")
        links = stash(links.unionByName(_links(more, held, percent)), "links")
    of = components(links)
    for spent in (tiles, passing, held, links):  # what is left reads the sketches and the components
        forget(spent)
    return every.join(of.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM documents),
shingled AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM worded, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0),
sized AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT a, b FROM ways UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.r)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sized USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS m FROM reach GROUP BY 1) USING (doc_id)"""
