"""Merkle manifest of a dataset, with a proof for each row.

Each row is a leaf: the hash of its fields, each with its length before it. The leaves
of a group ascend by id and are folded in runs of FAN, level by level, into the
group's subroot; the subroots, in the order of groups, are folded alike into the root.

Numbering: leaves are sorted by ranges of (group, id), numbered within their task, and
the counts of earlier tasks are added, so a group that holds a third of all rows is
numbered by many tasks. Levels: a node's run is its index divided by FAN, so a level is one
aggregation over groups of FAN rows at most, and its rows are an eighth of those below;
all nodes are one table, named by coordinates (tree, level, index).

Proofs: from its index and the size of its group alone, a leaf explodes the coordinates
of the siblings on its way to the root. They are looked up in the node table: where the
levels above hold BROADCAST nodes at most, those are broadcast; the lower levels, whose
nodes few leaves ask for, are joined. The digests found are put in order and
concatenated, and folded with the leaf by the same coordinates.

Result: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
Edge cases: null fields are hashed as "-"; a null group comes first, and so do null ids in
their group; a null id is never tampered with; rows of one id stand in the order of their
leaves, and equal rows have equal leaves but proofs of their own; one leaf alone is its
group's subroot, and one group's subroot is the root, with a proof of nothing; an empty table
gives no rows; other columns are neither hashed nor carried.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playlore.llm.common import let, read, stash

#: Production parameters: nodes of a run; the fields of a leaf; nodes of the upper levels that are broadcast, some 100 bytes each.
FAN, FIELDS, BROADCAST = 8, ("doc_id", "source", "lang", "n_chars", "text"), 5_000
#: The tree above the groups; the trees of groups are named "" (null) or ":" and the group.
TOP = "top"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(*fields: Column) -> Column:
    """The digest of a row: every field as its bytes with their number before, or "-"."""
    said = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[said(c.cast("string")) for c in fields]), 256)


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """rows with no (unique), index (from 0, within the tree) and size (of the tree).

    No task sees a whole tree: rows are dealt by ranges of tree and order, and only counts, one for each tree
    and task, are summed over tasks.
    """
    placed = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    placed = stash(placed.withColumns({"_task": F.spark_partition_id(), "no": F.monotonically_increasing_id()}), "sorted-leaves")
    spans = placed.groupBy(tree, "_task").agg(F.count(F.lit(1)).alias("n"), F.min("no").alias("_first"))
    w = Window.partitionBy(tree)
    before = F.coalesce(F.sum("n").over(w.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(tree, "_task", "_first", before.alias("_before"), F.sum("n").over(w).alias("size"))
    return placed.join(spans, [tree, "_task"]).withColumn("index", F.col("no") - F.col("_first") + F.col("_before")).drop("_task", "_first", "_before")


def levels(leaves: DataFrame) -> list[DataFrame]:
    """leaves: tree, index, size, digest (binary). They and each level above, up to one node for each tree, every level a table."""
    out = [leaves]
    most = leaves.agg(F.max("size")).first()[0] or 0
    while most > FAN ** (len(out) - 1):
        below = out[-1].filter(F.col("size") > FAN ** (len(out) - 1))  # trees that still have several nodes
        runs = below.groupBy("tree", "size", F.call_function("div", F.col("index"), F.lit(FAN)).alias("run")).agg(F.array_sort(F.collect_list(F.struct("index", "digest"))).alias("nodes"))
        text = F.array_join(F.transform("nodes", lambda x: F.lower(F.hex(x["digest"]))), "")
        out.append(stash(runs.select("tree", F.col("run").alias("index"), "size", F.unhex(F.sha2(text, 256)).alias("digest")), "tree-level"))
    return out


def finished(tree_levels: list[DataFrame]) -> DataFrame:
    """(tree, digest): the last node of each tree."""
    return reduce(DataFrame.unionByName, [x.filter(F.col("size") <= FAN**k).select("tree", "digest") for k, x in enumerate(tree_levels)])


class Manifest(NamedTuple):
    """leaves: the rows with no, tree, index, size, group_index, group_count, subroot. groups: the levels of the trees of groups; top: those above. root is a digest in hex."""

    leaves: DataFrame
    groups: list[DataFrame]
    top: list[DataFrame]
    root: str


def manifest(rows: DataFrame, group: str, *order: str) -> Manifest | None:
    """The trees over rows, which have a leaf (hex text); None if there are none."""
    tree = F.coalesce(F.concat(F.lit(":"), F.col(group).cast("string")), F.lit("")).alias("tree")
    placed = stash(numbered(rows.select("*", tree), "tree", *order, "leaf"), "leaves")
    groups = levels(placed.select("tree", "index", "size", F.unhex("leaf").alias("digest")))
    subroots = numbered(finished(groups).select("tree", "digest", F.lit(TOP).alias("above")), "above", "tree")
    subroots = stash(subroots.select("tree", "digest", F.col("index").alias("group_index"), F.col("size").alias("group_count")), "subroots")
    top = levels(subroots.select(F.lit(TOP).alias("tree"), F.col("group_index").alias("index"), F.col("group_count").alias("size"), "digest"))
    root = finished(top).first()
    if root is None:
        return None
    known = subroots.select("tree", "group_index", "group_count", F.lower(F.hex("digest")).alias("subroot"))
    return Manifest(placed.join(known, "tree"), groups, top, bytes(root.digest).hex())


def way(index: Column, size: Column, above: int) -> Column:
    """The way up from a leaf, from its index and its tree's size: for each level the run's first index, the place in it, and its nodes.

    above: the levels that the tallest tree has over its leaves.
    """

    def step(k: Column) -> Column:
        span = F.element_at(F.array(*[F.lit(FAN**i).cast("long") for i in range(above + 1)]), k + 1)
        here, nodes = F.call_function("div", index, span), F.call_function("div", size + span - 1, span)
        first = here - here % FAN
        return F.struct(k.alias("level"), first.alias("first"), (here - first).cast("int").alias("place"), F.least(F.lit(FAN).cast("long"), nodes - first).cast("int").alias("nodes"))

    steps = F.transform(F.sequence(F.lit(0), F.lit(above)), step)
    return F.filter(steps, lambda s: size > F.element_at(F.array(*[F.lit(FAN**i).cast("long") for i in range(above + 1)]), s["level"] + 1))


def coordinates(steps: Column, tree: Column, rank: int) -> Column:
    """The siblings on a way: (rank, level, index, tree). Rank parts the group's tree from the one above."""
    beside = lambda s: F.filter(F.sequence(F.lit(0), s["nodes"] - 1), lambda j: j != s["place"])
    return F.flatten(F.transform(steps, lambda s: F.transform(beside(s), lambda j: F.struct(F.lit(rank).alias("rank"), s["level"].alias("level"), (s["first"] + j).alias("index"), tree.alias("tree")))))


def proofs(m: Manifest, broadcast: int = BROADCAST) -> DataFrame:
    """(no, proof): the digests of a leaf's siblings as one hex text, level by level up to the root; leaves without siblings have no row."""
    table = [x.select(F.lit(r).alias("rank"), F.lit(k).alias("level"), "index", "tree", "digest") for r, ls in ((0, m.groups), (1, m.top)) for k, x in enumerate(ls)]
    counts = [x.count() for x in table]
    low = next((k for k in range(len(table)) if sum(counts[k:]) <= broadcast), len(table))  # so many tables are joined, the others are broadcast
    at = F.when(F.col("s.rank") == 0, F.col("s.level")).otherwise(F.col("s.level") + len(m.groups))
    both = F.concat(
        coordinates(way(F.col("index"), F.col("size"), len(m.groups) - 1), F.col("tree"), 0),
        coordinates(way(F.col("group_index"), F.col("group_count"), len(m.top) - 1), F.lit(TOP), 1),
    )
    asked = m.leaves.select("no", F.explode(both).alias("s")).select("no", at.alias("at"), "s.*")
    keys, found = ["rank", "level", "index", "tree"], []
    if low:
        found.append(asked.filter(F.col("at") < low).join(reduce(DataFrame.unionByName, table[:low]), keys))
    if low < len(table):
        found.append(asked.filter(F.col("at") >= low).join(F.broadcast(reduce(DataFrame.unionByName, table[low:])), keys))
    parts = reduce(DataFrame.unionByName, [x.select("no", F.struct(*keys[:3], "digest").alias("p")) for x in found])
    return parts.groupBy("no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: F.lower(F.hex(p["digest"]))), "").alias("proof"))


def folded(leaf: Column, proof: Column, steps: Column) -> Column:
    """The root that a leaf and the digests of its siblings make. proof: hex text as binary."""
    state = F.struct(leaf.alias("now"), F.lit(0).alias("used"))

    def step(a: Column, s: Column) -> Column:
        part = lambda at, n: F.substring(proof, (a["used"] + at) * 64 + 1, n * 64)
        run = F.concat(part(F.lit(0), s["place"]), a["now"].cast("binary"), part(s["place"], s["nodes"] - 1 - s["place"]))
        return F.struct(F.sha2(run, 256).alias("now"), (a["used"] + s["nodes"] - 1).alias("used"))

    return F.aggregate(steps, state, step, lambda a: a["now"])


def verified(m: Manifest, leaf: str = "leaf", broadcast: int = BROADCAST) -> DataFrame:
    """m.leaves with root, proof_sha256, folded_root (of the column `leaf`, which may differ from the leaves in the tree) and verified."""
    proof = F.coalesce("proof", F.lit(""))
    steps = F.concat(way(F.col("index"), F.col("size"), len(m.groups) - 1), way(F.col("group_index"), F.col("group_count"), len(m.top) - 1))
    out = m.leaves.join(proofs(m, broadcast), "no", "left").withColumns({"root": F.lit(m.root), "proof_sha256": F.sha2(proof, 256)})
    out = out.withColumn("folded_root", let(proof.cast("binary"), lambda p: folded(F.col(leaf), p, steps)))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove_documents(docs: DataFrame) -> DataFrame:
    """A manifest by lang, and each row's proof, tried on the row after tampering: of every third id by hash the text's capitals are lowered."""
    fields = [F.col(c) for c in FIELDS]
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    changed = leaf_hash(*fields[:-1], F.translate(F.col("text"), UPPER, LOWER))
    rows = docs.select("doc_id", "lang", leaf_hash(*fields).alias("leaf"), F.when(touched, changed).alias("changed"))
    m = manifest(stash(rows, "leaf-hashes"), "lang", "doc_id")
    if m is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    seen = m._replace(leaves=m.leaves.withColumn("seen", F.coalesce("changed", "leaf")))
    return verified(seen, "seen").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prove_documents(read(spark, sf_dir, "documents").select(*FIELDS))


_CRC = "xor(list_reduce(flatten([[4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))]), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"
_SAID = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
_LEAF = lambda text: f"sha256({' || '.join(_SAID(c) for c in FIELDS[:-1])} || {_SAID(text)})"
#: From (tree, n, level 0, i, h) to every level: t_.
_TREE = lambda name, base: f"""{name}(tree, n, level, i, h, width) AS (SELECT tree, n, 0, i, h, n FROM {base}
  UNION ALL SELECT tree, n, max(level) + 1, i // {FAN}, sha256(string_agg(h, '' ORDER BY i)), max(width + {FAN - 1}) // {FAN} FROM {name} WHERE width > 1 GROUP BY tree, n, i // {FAN})"""  # noqa: E731
ORACLE = f"""WITH RECURSIVE lv0 AS MATERIALIZED (SELECT *, coalesce(':' || lang, '') AS tree, {_LEAF("text")} AS h, CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents),
leaves AS MATERIALIZED (SELECT row_number() OVER () AS no, doc_id, tree, h, coalesce(changed, h) AS seen, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM lv0),
{_TREE("nodes", "leaves")},
subs AS MATERIALIZED (SELECT 'top' AS tree, tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE width = 1),
{_TREE("tops", "subs")},
every AS MATERIALIZED (SELECT 0 AS r, * FROM nodes UNION ALL SELECT 1, * FROM tops),
root AS (SELECT h AS root FROM tops WHERE width = 1),
ways AS (SELECT no, 0 AS r, tree, i FROM leaves UNION ALL SELECT no, 1, 'top', subs.i FROM leaves JOIN subs ON name = leaves.tree),
levels AS (SELECT DISTINCT r, tree, level, width FROM every WHERE width > 1),
steps AS MATERIALIZED (SELECT no, w.r, w.tree, l.level, w.i // ({FAN} ** l.level)::BIGINT AS at, row_number() OVER (PARTITION BY no ORDER BY w.r, l.level) AS step FROM ways w JOIN levels l ON l.r = w.r AND l.tree = w.tree),
sides AS MATERIALIZED (SELECT s.no, s.step, coalesce(string_agg(e.h, '' ORDER BY e.i) FILTER (e.i < s.at), '') AS before, coalesce(string_agg(e.h, '' ORDER BY e.i) FILTER (e.i > s.at), '') AS behind
  FROM steps s JOIN every e ON e.r = s.r AND e.tree = s.tree AND e.level = s.level AND e.i // {FAN} = s.at // {FAN} GROUP BY s.no, s.step),
fold(no, step, now) AS (SELECT no, 0::BIGINT, seen FROM leaves UNION ALL SELECT f.no, s.step, sha256(before || now || behind) FROM fold f JOIN sides s ON s.no = f.no AND s.step = f.step + 1),
ends AS (SELECT no, arg_max(now, step) AS folded_root FROM fold GROUP BY no), proofs AS (SELECT no, sha256(string_agg(before || behind, '' ORDER BY step)) AS proof_sha256 FROM sides GROUP BY no)
SELECT doc_id, l.h AS leaf, s.h AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subs s ON s.name = l.tree JOIN ends USING (no) LEFT JOIN proofs USING (no), root"""
