"""SimHash near-duplicates, centroid clustering and the Merkle manifest: brute-force versions and edge cases."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from playlore.llm import centroids, golay, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---- SimHash through the Golay code ----


def plain_print(text):
    """The contract's fingerprint, bit by bit."""
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """(doc_id, fingerprint, component) by comparing all pairs."""
    prints = [plain_print(t) for _, t in rows]
    of = list(range(len(rows)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                of[root(i)] = root(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[root(i)].append(k)
    return sorted(((k, f"{prints[i]:016x}", min((x for x in least[root(i)] if x is not None), default=None)) for i, (k, _) in enumerate(rows)), key=repr)


def collected(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=repr)


def test_hash_of_a_shingle_is_sparks_own(spark):
    assert [spark.sql("select xxhash64('über den fluß')").first()[0] % 2**64] == golay.shingle_hashes("Über  DEN\tfluß".replace("Ü", "ü").encode()).tolist()


def test_every_word_is_within_three_bits_of_one_codeword():
    table = golay.errors()
    assert (table[:, 0] >= 0).all() and set((table >= 0).sum(axis=1)) == {1, 6}
    assert {int(e).bit_count() for e in table[:, 0]} == {0, 1, 2, 3} and {int(e).bit_count() for e in table[:, 1:].ravel() if e >= 0} == {4}
    assert all((golay._syndromes(np.array([e for e in row if e >= 0])) == s).all() for s, row in enumerate(table))


@pytest.mark.parametrize("apart", [0, 1, 2, 3])
def test_prints_within_three_bits_share_a_key(apart):
    rng = np.random.default_rng(apart)
    a = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    flips = np.array([np.bitwise_xor.reduce([np.uint64(1) << np.uint64(b) for b in rng.choice(64, apart, replace=False)] or [np.uint64(0)]) for _ in a], np.uint64)
    rows = [set(zip(*(x.tolist() for x in golay.keys(p)), strict=True)) for p in (a, a ^ flips)]
    assert {i for i, _ in rows[0] & rows[1]} == set(range(len(a)))


def similar_texts(rng, n):
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([2, 40, 300]))]
        for k in range(rng.choice([1, 1, 5])):
            rows.append((1000 - 10 * i - k, " ".join(words)))
            words = list(words)
            words[rng.randrange(len(words))] = f"v{rng.randrange(4000)}"
    return rows


@pytest.mark.parametrize("crowd", [512, 1])
def test_simhash_equals_all_pairs(spark, crowd):
    """crowd 1: every shared key is crowded, so the links come by way of the words between."""
    rows = similar_texts(random.Random(3), 40)
    assert collected(golay.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), crowd)) == plain_components(rows)


def test_links_find_every_pair_of_prints(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    prints = {int(b) ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(8)}
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "print long")
    got = {(r.a % 2**64, r.b % 2**64) for r in golay.links(df).collect()}
    want = {(a, b) for a in prints for b in prints if (a - 2**64 if a >= 2**63 else a) < (b - 2**64 if b >= 2**63 else b) and (a ^ b).bit_count() <= 3}
    assert got == want and len(want) > 100


def test_simhash_edge_cases(spark):
    rows = [(7, None), (3, ""), (5, " \n "), (None, "a b c d"), (9, "A b  C d"), (9, "a b c d"), (None, "alone here now"), (4, "x " * 70_000), (2, "one"), (8, "two words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"print": F.lit("clash"), "component": F.lit(1), "fingerprint": F.lit(2)})
    got = collected(golay.near_duplicates(df))
    assert got == plain_components(rows)
    assert (7, "0" * 16, 3) in got and (None, f"{plain_print('alone here now'):016x}", None) in got
    empty = golay.near_duplicates(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "fingerprint", "component_id"]


# ---- centroid clustering ----


def plain_clusters(rows):
    def whole(v):
        return v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)

    points = [(k, tuple(math.floor(1024 * x) for x in v)) for k, v in rows if whole(v)]
    order = sorted(points, key=lambda p: (p[0] is None, hashlib.sha256(f"3:{p[0]}".encode()).hexdigest(), p[1]))
    cs = [v for _, v in order[:8]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), i) for i, c in enumerate(cs))
    for _ in range(10):
        own = defaultdict(list)
        for _, v in points:
            own[near(v)[1]].append(v)
        cs = [tuple(sum(d) // len(own[i]) for d in zip(*own[i], strict=True)) if own[i] else c for i, c in enumerate(cs)]
    placed = [(k, *near(v)[::-1]) for k, v in points]
    total = lambda c: sum(d for _, i, d in placed if c in (i, None))
    return sorted(((k, i, d, total(i), total(None), hashlib.sha256(",".join(map(str, cs[i])).encode()).hexdigest()) for k, i, d in placed), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("clash"), "vector": F.lit(0), "n": F.lit(1)})


def test_clusters_equal_plain_lloyd(spark):
    rng = random.Random(2)
    some = [[rng.gauss(g, 1) for _ in range(64)] for g in (-2, 0, 0.5, 3) for _ in range(20)]
    rows = [(i, some[i % 80]) for i in range(160)] + [(200 + i, some[0]) for i in range(100)]
    rows += [(500, None), (501, some[0][:63]), (502, [*some[0][:63], None]), (503, [*some[0][:63], math.nan]), (504, [*some[0][:63], -math.inf]), (None, some[1]), (7, some[2]), (7, some[3]), (7, some[3]), (600, [])]
    got = centroids.cluster(vectors(spark, rows).repartition(5))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_clusters(rows)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_clusters_of_few_equal_or_no_vectors(spark):
    one, two = [0.1] * 64, [-0.1] * 64
    for rows in ([(i, one) for i in range(12)], [(1, one), (2, two), (3, one)], [(None, one), (None, two)]):
        assert sorted((tuple(r) for r in centroids.cluster(vectors(spark, rows)).collect()), key=repr) == plain_clusters(rows)
    assert centroids.cluster(vectors(spark, [(1, None)])).count() == 0


def test_components_that_leave_64_bits_are_an_error(spark):
    with pytest.raises(Exception, match="not below"):
        centroids.cluster(vectors(spark, [(1, [1e9] * 64)])).collect()


# ---- Merkle manifest ----


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t: sha("".join(said(v) for v in (d[0], d[3], d[2], d[4], t)))
    low = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def tree(nodes):
        """The last node, and for each node its siblings on the way, as (before, behind)."""
        ways, of = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            runs = [range(a, min(a + 8, len(nodes))) for a in range(0, len(nodes), 8)]
            for run in runs:
                for j in run:
                    for i in of[j]:
                        ways[i].append(([nodes[x] for x in run if x < j], [nodes[x] for x in run if x > j]))
            nodes, of = [sha("".join(nodes[j] for j in run)) for run in runs], [[i for j in run for i in of[j]] for run in runs]
        return nodes[0], ways

    groups = defaultdict(list)
    for d in rows:
        groups[d[2]].append(d)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[1])))
    trees = {g: tree([leaf(d, d[1]) for d in groups[g]]) for g in names}
    root, above = tree([trees[g][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for d, own in zip(groups[g], trees[g][1], strict=True):
            way = own + above[at]
            now = leaf(d, low(d[1])) if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0 else leaf(d, d[1])
            for before, behind in way:
                now = sha("".join([*before, now, *behind]))
            out.append((d[0], leaf(d, d[1]), trees[g][0], root, sha("".join("".join(a + b) for a, b in way)), now, now == root))
    return sorted(out, key=repr)


def proved(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 9, 700])
def test_manifest_equals_plain_trees(spark, n):
    rng = random.Random(n)
    rows = [(i * 7 % 1001, rng.choice(["Some Text", "lower only", "Ünï A", "", None, "T" * 5000]), rng.choice(["en", "de", "de", "de", "é", "", None]) if n > 2 else "en", rng.choice(["a", None]), rng.choice([3, None])) for i in range(n)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"tree": F.lit("clash"), "no": F.lit(1), "size": F.lit(2), "leaf": F.lit("x"), "p": F.lit(0)})
    got = proved(merkle.prove_documents(df.repartition(6)))
    assert got == plain_manifest(rows)
    assert n < 700 or {v[-1] for v in got} == {True, False}


def test_manifest_of_repeated_rows_null_ids_and_many_groups(spark):
    rows = [(5, "Same", "en", "s", 4)] * 20 + [(None, "A b", "en", None, None)] * 3 + [(5, "Other", "en", "s", 5)] + [(i, f"T{i}", f"l{i:03d}", "s", 2) for i in range(70)]
    assert proved(merkle.prove_documents(spark.createDataFrame(rows, DOCS).repartition(5))) == plain_manifest(rows)
    empty = merkle.prove_documents(spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("broadcast", [0, 10, 10_000])
def test_proofs_don_t_depend_on_how_nodes_are_looked_up(spark, broadcast):
    rows = [(i, f"Text {i}", "en" if i % 3 else "de", "s", i) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    leaves = docs.select("doc_id", "lang", merkle.leaf_hash(*[F.col(c) for c in merkle.FIELDS]).alias("leaf"))
    out = merkle.verified(merkle.manifest(leaves, "lang", "doc_id"), broadcast=broadcast).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    want = {w[0]: w for w in plain_manifest(rows)}
    assert all(r.verified and r.folded_root == r.root and (r.leaf, r.subroot, r.root, r.proof_sha256) == want[r.doc_id][1:5] for r in out) and len(out) == 300
