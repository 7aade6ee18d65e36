"""Merkle manifest of a dataset that stores only every few levels.

Each row is a leaf: the sha256 of its fields, each written as ``-`` if null,
else as UTF-8 byte count, ``:`` and value.  The leaves of a group (a source)
ascend by id; while several nodes remain, every ``arity`` consecutive ones (the
last run has fewer, maybe one) become the sha256 of their hex digests.  What
remains is the group's subroot; the subroots, in the order of their groups
(null first, UTF-8 bytewise), make the root the same way.

Stored are the leaves and every ``every``-th level above them.  A block is the
``arity ** every`` nodes below one stored node: it is gathered (a bounded
group), hashed up to the next stored level, and its interior nodes are dropped.
Proofs are drawn top-down from the stored levels: each block's interior nodes
are hashed again from its stored nodes, every node takes its siblings of these
levels followed by the proof of the block's own node, and the interior is
dropped.  So storage above the leaves is a 1 / (arity ** every - 1) share of
them, and no task holds more than a block.

A proof is an array with an entry (left, right) per level: the digests of the
run's nodes before and after the own one, concatenated (empty if none).

Positions come from one range sort over (group, id, leaf), numbered across its
partitions; a group with a third of all rows is spread like the others, since
blocks, not groups, are the keys.  All hashing is done by Spark's own functions.

Edge cases.  Null ids stand first in their group; a null group is a group of its
own.  Rows with one id are ordered by leaf; repeated rows are leaves of their
own with equal hashes.  Empty text is ``0:``, not ``-``.  A group of one row has
its leaf as subroot, a single group its subroot as root.  An empty table gives
an empty result.  Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import stored
from shoplens.operators.sequence import with_global_sequence

PROOF = "array<struct<left:string,right:string>>"


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf_hash(*fields: Column) -> Column:
    """sha256 of the fields, each ``-`` if null, else byte count, ``:``, value."""
    written = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.when(f.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(f).cast("string"), F.lit(":"), f)) for f in written]))


def depth_of(n: Column, arity: int) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves."""
    powers = [arity**i for i in range(64) if arity**i < 2**62]
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p: p < n))


@dataclass
class Forest:
    """Stored levels of many trees and the subroots.

    ``levels[k]`` (tree, idx, node, depth, keep) is level ``k * every``; the
    last level's nodes and those of shallower trees are their subroots.
    """

    levels: list[DataFrame]
    arity: int
    every: int

    def subroots(self) -> DataFrame:
        """(tree, top, depth, subroot): ``top`` is the stored level whose blocks reach the subroot."""
        return stored_union([t.filter(F.col("depth") <= (k + 1) * self.every)
                             .select("tree", F.lit(k).alias("top"), "depth", F.col("node").alias("subroot"))
                             for k, t in enumerate(self.levels[1:])])


def stored_union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def blocks(level: DataFrame, k: int, arity: int, every: int) -> DataFrame:
    """Blocks of a stored level: (tree, block, depth, steps, items, l0 .. l<every>).

    ``l0`` are the block's nodes by position, ``l<t>`` the nodes ``t`` levels
    up; ``steps`` levels are hashed, fewer than ``every`` at a tree's top.
    """
    width = arity**every
    b = level.groupBy("tree", F.expr(f"idx div {width}").alias("block")).agg(
        F.first("depth").alias("depth"), F.sort_array(F.collect_list(F.struct("idx", "node", "keep"))).alias("items"))
    b = b.withColumn("steps", F.least(F.lit(every), F.col("depth") - k * every)).withColumn("l0", F.col("items.node"))
    for t in range(every):
        b = b.withColumn(f"l{t + 1}", F.when(F.col("steps") > t, parents(F.col(f"l{t}"), arity)).otherwise(F.col(f"l{t}")))
    return b


def parents(nodes: Column, arity: int) -> Column:
    """Digests of every ``arity`` consecutive nodes of an array."""
    starts = F.sequence(F.lit(1), F.size(nodes), F.lit(arity))
    return F.transform(starts, lambda i: digest(F.array_join(F.slice(nodes, i, arity), "")))


def build_forest(leaves: DataFrame, arity: int = 3, every: int = 3) -> Forest:
    """Trees over ``leaves`` (tree, idx from 0, node, depth, keep), stored level by level."""
    levels = [stored(leaves, "merkle-leaves")]
    deepest = levels[0].agg(F.max("depth")).first()[0] or 0
    for k in range(max(1, -(-deepest // every))):
        open_ = levels[-1] if k == 0 else levels[-1].filter(F.col("depth") > k * every)
        up = blocks(open_, k, arity, every).select(
            "tree", F.col("block").alias("idx"), F.get(f"l{every}", F.lit(0)).alias("node"), "depth",
            F.lit(None).cast(leaves.schema["keep"].dataType).alias("keep"))
        levels.append(stored(up, f"merkle-level-{(k + 1) * every}"))
    return Forest(levels, arity, every)


def proofs(forest: Forest, above: DataFrame) -> DataFrame:
    """(tree, idx, node, keep, proof, subroot) of every leaf.

    ``above`` (tree, top, subroot, proof) continues each tree's proofs beyond
    its subroot; its ``proof`` may be empty.
    """
    arity, every = forest.arity, forest.every
    upper = None
    for k in reversed(range(len(forest.levels) - 1)):
        level = forest.levels[k] if k == 0 else forest.levels[k].filter(F.col("depth") > k * every)
        seeds = above.filter(F.col("top") == k).select("tree", F.lit(0).cast("long").alias("block"), "subroot",
                                                       F.col("proof").alias("upper"))
        ends = seeds if upper is None else upper.unionByName(seeds)
        b = blocks(level, k, arity, every).join(ends, ["tree", "block"])
        each = b.withColumn("j", F.explode(F.sequence(F.lit(0), F.size("items") - 1)))
        entries = []
        for t in range(every):
            at = F.expr(f"cast(j div {arity**t} as int)")
            before = at % arity
            entries.append(F.struct(
                F.array_join(F.slice(f"l{t}", at - before + 1, before), "").alias("left"),
                F.array_join(F.slice(f"l{t}", at + 2, arity - 1 - before), "").alias("right")))
        item = F.get("items", F.col("j"))
        each = each.select("tree", item["idx"].alias("idx"), item["node"].alias("node"), item["keep"].alias("keep"),
                           F.concat(F.slice(F.array(*entries), F.lit(1), F.col("steps")), "upper").alias("proof"), "subroot")
        if k == 0:
            return each
        upper = stored(each.select("tree", F.col("idx").alias("block"), "subroot", F.col("proof").alias("upper")),
                       f"merkle-proofs-{k * every}")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def proof_digest(proof: Column) -> Column:
    """sha256 of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""))


def manifest(leaves: DataFrame, group: str, order: str, leaf: str, keep: list[str], arity: int = 3, every: int = 3) -> DataFrame:
    """Every leaf with its proof: ``group``, ``order``, ``leaf``, the ``keep`` columns, subroot, root, proof."""
    if arity < 2 or every < 1:
        raise ValueError("arity must be 2 or more, every 1 or more")
    rows = stored(leaves.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(leaf).alias("node"),
                                F.struct(*[F.col(c) for c in [group, order, *keep]]).alias("keep")), "merkle-rows")
    seen = with_global_sequence(rows, [F.asc_nulls_first("g"), F.asc_nulls_first("o"), F.asc("node")], "seq")
    trees = seen.groupBy("g").agg(F.min("seq").alias("tree"), F.count("*").alias("n"))
    placed = seen.join(trees.withColumnRenamed("g", "tg"), F.col("g").eqNullSafe(F.col("tg")))
    forest = build_forest(placed.select("tree", (F.col("seq") - F.col("tree")).alias("idx"), "node",
                                        depth_of(F.col("n"), arity).alias("depth"), "keep"), arity, every)

    # a tree is known by the position of its first leaf, so trees ascend as their groups do
    subroots = stored(forest.subroots(), "merkle-subroots")
    ranked = with_global_sequence(subroots, ["tree"], "seq")
    n_trees = subroots.count()
    crown = build_forest(ranked.select(F.lit(0).cast("long").alias("tree"), (F.col("seq") - 1).alias("idx"),
                                       F.col("subroot").alias("node"), depth_of(F.lit(n_trees), arity).alias("depth"),
                                       F.struct("tree", "top").alias("keep")), arity, every)
    tops = crown.subroots()
    root = tops.first()
    above = proofs(crown, tops.select("tree", "top", "subroot", F.array().cast(PROOF).alias("proof"))).select(
        F.col("keep.tree").alias("tree"), F.col("keep.top").alias("top"), F.col("node").alias("subroot"), "proof")
    out = proofs(forest, stored(above, "merkle-above"))
    return out.select(*[F.col("keep")[c].alias(c) for c in [group, order]], F.col("node").alias(leaf),
                      *[F.col("keep")[c].alias(c) for c in keep], "subroot",
                      F.lit(root["subroot"] if root else None).cast("string").alias("root"), "proof")


def without_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(""))


def verified_manifest(docs: DataFrame, arity: int = 3, every: int = 3) -> DataFrame:
    """Manifest of ``documents`` and the check of a tampered copy: where 2 divides
    crc32(doc_id) the text's line feeds are deleted before the leaf is hashed
    again (never for a null id) and folded up the original proof."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    leaves = docs.select("doc_id", "source", leaf_hash(*fields, F.col("text")).alias("leaf"),
                         F.when(tampered, leaf_hash(*fields, without_newlines(F.col("text")))).alias("seen"))
    m = manifest(leaves, "source", "doc_id", "leaf", ["seen"], arity, every)
    folded = m.withColumn("folded_root", fold(F.coalesce("seen", "leaf"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


# DuckDB: levels by recursion, proofs by walking each leaf up; crc32 by its table
SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(range(8),
  lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), b) AS v FROM range(256) r(b))),
fields AS (SELECT doc_id, source, text, concat(
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
  CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)),
    lambda c, i: xor(c >> 8, t[xor(c & 255, i) + 1]), 4294967295), 4294967295) END AS h FROM documents, crc),
hashed AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  CASE WHEN h % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS kept, head FROM fields),
leaves AS MATERIALIZED (SELECT doc_id, leaf, sha256(head || coalesce(strlen(kept) || ':' || kept, '-')) AS seen,
  dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM hashed),
up AS (SELECT tree, 0 AS lvl, idx, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL SELECT tree, lvl + 1, idx // 3, sha256(string_agg(node, '' ORDER BY idx)), (any_value(n) + 2) // 3
  FROM up WHERE n > 1 GROUP BY tree, lvl, idx // 3),
nodes AS MATERIALIZED (SELECT * FROM up),
subroots AS MATERIALIZED (SELECT tree, lvl AS depth, node FROM nodes WHERE n = 1),
crown AS (SELECT 0 AS lvl, tree AS idx, node, count(*) OVER () AS n FROM subroots
  UNION ALL SELECT lvl + 1, idx // 3, sha256(string_agg(node, '' ORDER BY idx)), (any_value(n) + 2) // 3
  FROM crown WHERE n > 1 GROUP BY lvl, idx // 3),
tops AS MATERIALIZED (SELECT * FROM crown),
every AS MATERIALIZED (SELECT tree, lvl, idx, node, n FROM nodes WHERE n > 1
  UNION ALL SELECT s.tree, s.depth + t.lvl, t.idx, t.node, t.n FROM subroots s, tops t WHERE t.n > 1),
runs AS MATERIALIZED (SELECT tree, lvl, idx // 3 AS run, list(node ORDER BY idx) AS members FROM every GROUP BY ALL),
walk AS (SELECT l.tree, l.idx AS leaf_idx, 0 AS lvl, l.idx AS pos, l.seen AS node, '' AS proof, s.depth FROM leaves l JOIN subroots s USING (tree)
  UNION ALL SELECT w.tree, leaf_idx, w.lvl + 1, w.here // 3, sha256(array_to_string(members[:w.here % 3], '') || w.node || array_to_string(members[w.here % 3 + 2:], '')),
    proof || array_to_string(members[:w.here % 3], '') || array_to_string(members[w.here % 3 + 2:], ''), depth
  FROM (SELECT *, CASE WHEN lvl = depth THEN tree ELSE pos END AS here FROM walk) w JOIN runs r ON r.tree = w.tree AND r.lvl = w.lvl AND r.run = w.here // 3
  WHERE w.lvl < depth + (SELECT max(lvl) FROM tops)),
ended AS (SELECT tree, leaf_idx, arg_max(node, lvl) AS folded_root, arg_max(proof, lvl) AS proof FROM walk GROUP BY ALL)
SELECT doc_id, leaf, s.node AS subroot, r.node AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = r.node AS verified
FROM leaves l JOIN ended e ON e.tree = l.tree AND e.leaf_idx = l.idx JOIN subroots s ON s.tree = l.tree JOIN tops r ON r.n = 1
"""
