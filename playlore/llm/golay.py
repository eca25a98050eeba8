"""Near-duplicates by SimHash fingerprints, met through the perfect Golay code.

Fingerprints: each bit says whether most 64-bit hashes of a text's 3-word shingles have
it. Two documents link if their fingerprints differ in 3 bits at most. Documents of one
fingerprint are one node, so a group of exact copies is worked on once.

Keys: the 64 bits are three segments of 23, 23 and 18 bits. The binary Golay code (23,
12) has a codeword within 3 bits of any 23-bit word. A segment is decoded to the index
of its nearest codeword and, where that is 3 bits away, to those of the five codewords
4 bits away as well: 1 or 6 nearby indices. Segments that differ in one bit have the
nearest codeword of either among the nearby ones of the other, and as their parities
differ, it is enough that the even one takes its nearest and the odd one all nearby.

Pigeonhole: 3 errors in three segments leave (a) two segments without error, or (b) one
without and another with one error, or (c) one in each. So fingerprints that link share
one key of (a) two segments, 3 keys, (b) a segment and an index of another, about 19, or
(c) an index of each, about 31. Keys hold 35 bits or more, so few unlike documents meet.

Join: fingerprints with a common key are compared by the bits that differ. A key that over
CROWD fingerprints share is not compared pair by pair: each of its fingerprints lists the
words within 1 bit and within 2 bits of itself, and every word ties those that list it to
the least fingerprint within 1 bit of it. Fingerprints 3 bits apart have such a word between
them, so no link is lost, and the work is some 2,100 rows a fingerprint, however many meet.

Result for each row: fingerprint (16 hex digits), component_id (the smallest doc_id reachable).
Edge cases: a text of fewer words than a shingle is one shingle; null and empty texts have
the fingerprint zero, which links like any other; repeated rows link as equal texts; rows
with a null doc_id link others, and have the component of their fingerprint, null if no
document of it has an id; an empty table stays empty; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlore.llm.common import forget, read, stash
from playlore.llm.components import components

#: Production parameters: words of a shingle, seed of its hash, bits that may differ, and the most fingerprints of one key that are compared pair by pair.
SHINGLE, SEED, BITS, CROWD = 3, 42, 3, 512
#: First bit and length of each segment.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: The generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1; an index is the 12 bits above its 11 check bits.
GENERATOR, LENGTH, CHECK = 0b110001110101, 23, 11
#: Hashes that are counted at once.
BLOCK = 1 << 16


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The hashes of all shingles of a UTF-8 text, repeats included: A-Z lowered, words parted by ASCII white space and joined by one space."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, size = b" ".join(words), min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - size + 1)


def fingerprint(text: bytes | None) -> int:
    """The bits set in over half of the shingle hashes."""
    hashes = shingle_hashes(text or b"")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _syndromes(words: np.ndarray) -> np.ndarray:
    """The remainders of 23-bit words by the generator."""
    rest = words.astype(np.int64).copy()
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        rest ^= np.where((rest >> bit) & 1, GENERATOR << (bit - CHECK), 0)
    return rest


@cache
def errors() -> np.ndarray:
    """For each syndrome the differences to the nearby codewords: the nearest first, then the five at 4 bits where that is 3 bits away, else -1."""
    table = np.full((1 << CHECK, 6), -1, np.int64)
    for weight in range(5):
        words = np.array([sum(1 << b for b in bits) for bits in combinations(range(LENGTH), weight)], np.int64)
        for s, e in zip(_syndromes(words).tolist(), words.tolist(), strict=True):
            if weight < 4 or table[s, 0].item().bit_count() == 3:
                table[s, np.flatnonzero(table[s] < 0)[0]] = e
    return table


def nearby(words: np.ndarray) -> np.ndarray:
    """The indices of the codewords near each 23-bit word, six columns, the nearest first, -1 where there are no more."""
    found = errors()[_syndromes(words)]
    return np.where(found < 0, -1, (words[:, None] ^ found) >> CHECK)


def _parity(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words) & 1


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of 64-bit fingerprints."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    odd = [_parity(p) for p in parts]
    near = [nearby(p) for p in parts]
    near = [np.where((np.arange(6) == 0) | (o[:, None] == 1), x, -1) for x, o in zip(near, odd, strict=True)]  # the even take the nearest only
    rows, out, all_rows, kind = [], [], np.arange(len(prints)), 0

    def add(key: np.ndarray, row: np.ndarray) -> None:
        nonlocal kind
        rows.append(row)
        out.append((np.int64(kind) << np.int64(56)) | key)
        kind += 1

    for i, j in combinations(range(3), 2):
        add((parts[i] << 23) | parts[j], all_rows)
    for i in range(3):
        for j in range(3):
            if i != j:
                row, slot = np.nonzero(near[j] >= 0)
                add((parts[i][row] << 12) | near[j][row, slot], row)
    each = (near[0][:, :, None, None] >= 0) & (near[1][:, None, :, None] >= 0) & (near[2][:, None, None, :] >= 0)
    row, a, b, c = np.nonzero(each)
    # all three parities differ in a pair of this kind, so both have the same pattern up to complement
    pattern = odd[0] * 4 + odd[1] * 2 + odd[2]
    pattern = np.minimum(pattern, 7 - pattern).astype(np.int64)
    add((pattern[row] << 36) | (near[0][row, a] << 24) | (near[1][row, b] << 12) | near[2][row, c], row)
    return np.concatenate(rows), np.concatenate(out)


def around(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, word) of every 64-bit word that differs from a fingerprint in so many bits at most."""
    masks = np.array([sum(1 << b for b in chosen) for k in range(bits + 1) for chosen in combinations(range(64), k)], np.uint64)
    return np.repeat(np.arange(len(prints)), len(masks)), (prints[:, None] ^ masks).ravel()


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        found = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "print"])


def _listed(name: str, listing, rows_at_once: int):
    """Tasks that list (print, name) for each print."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy()
            for at in range(0, len(prints), rows_at_once):
                part = prints[at : at + rows_at_once]
                row, out = listing(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(part[row]), pa.array(out.view(np.int64))], names=["print", name])

    return emit


def _crowded(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect whatever prints differ in 3 bits at most, without a pair being formed."""
    ball = lambda bits, n: prints.mapInArrow(_listed("word", lambda p: around(p, bits), n), "print long, word long")
    hubs = ball(1, 10_000).groupBy("word").agg(F.min("print").alias("a"))
    return ball(2, 500).join(hubs.hint("merge"), "word").select("a", F.col("print").alias("b")).filter("a <> b").distinct()


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): pairs of distinct fingerprints that differ in 3 bits at most; of crowded keys only as many as connect the same."""
    keyed = prints.mapInArrow(_listed("key", keys, 5_000), "print long, key long")
    full = stash(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("key"), "crowded-keys")
    crowded = not full.isEmpty()
    rest = keyed.join(full.hint("merge"), "key", "left_anti") if crowded else keyed
    left, right = rest.withColumnRenamed("print", "a"), rest.withColumnRenamed("print", "b")
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = left.join(right.hint("merge"), "key").filter((F.col("a") < F.col("b")) & (differ <= BITS)).select("a", "b").distinct()
    if crowded:
        pairs = pairs.unionByName(_crowded(stash(keyed.join(full.hint("merge"), "key", "left_semi").select("print").distinct(), "crowded-prints")))
    return pairs


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    made = stash(texts.mapInArrow(_printed, "doc_id long, print long"), "fingerprints")
    prints = stash(made.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct-prints")
    found = stash(links(prints.select("print"), crowd), "print-links")
    of = stash(components(found), "print-components")
    forget(found)
    placed = prints.join(of.withColumnRenamed("node", "print").hint("merge"), "print", "left")  # nothing that grows passes through the driver
    placed = stash(placed.select("print", "least", F.coalesce("component", "print").alias("component")), "placed-prints")
    linked = placed.join(of.select("component").distinct().hint("merge"), "component", "left_semi")
    first = linked.groupBy("component").agg(F.min("least").alias("first"))
    ids = placed.join(first.hint("merge"), "component", "left").select("print", F.coalesce("first", "least").alias("component_id"))
    return made.join(ids.hint("merge"), "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
