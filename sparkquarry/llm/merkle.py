"""Merkle manifest of a table: a digest of every row, of every group and of the whole, with proofs.

Rows are leaves of a tree for each group (language), in order of an id; the groups' roots are
the leaves of one more tree. A tree is traversed in aligned blocks of `8 ** DEPTH` nodes: a task
walks a block in postorder, returns the digest of each subtree and, while it unwinds, appends
the siblings to the leaves that the subtree holds. The roots of the blocks are the nodes of the
next traversal, which is as distributed as the first, so no task ever sees more than a block.

A traversal upwards keeps digests only. Once the root is known, the blocks are traversed again
from the top down, each with the siblings of its own root, so that every leaf gets its whole
proof. Places of rows come from a sort by ranges and the counts of its parts, not from a window
over a group, which might hold a third of all rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.llm.shared import ascii_lower, cut, free, table

ARITY = 8
DEPTH = 3  # levels that one traversal goes up: blocks of 512 nodes
NODES = "tree string, pos long, nodes long, digest string"
PATH = "path array<struct<left: string, right: string>>"


def h(*parts: str) -> str:
    """Lowercase hex sha256 of the parts, concatenated."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes: int, depth: int = DEPTH) -> int:
    """How many levels one traversal goes up in a tree that has so many nodes: until one is left, `depth` at most."""
    up = 0
    while nodes > 1 and up < depth:
        nodes, up = -(-nodes // ARITY), up + 1
    return up


def traverse(digests: list[str], level: int, paths: list[list[tuple[str, str]]] | None = None) -> str:
    """The digest of the subtree of height `level` over these leaves, in postorder.

    With `paths`, what stands left and right of a leaf's own subtree among its siblings is
    appended for every leaf, from the lowest level up.
    """
    if level == 0:
        return digests[0]
    width = ARITY ** (level - 1)
    starts = range(0, len(digests), width)
    own = [traverse(digests[i : i + width], level - 1, paths and paths[i : i + width]) for i in starts]
    if paths:
        for k, i in enumerate(starts):
            pair = ("".join(own[:k]), "".join(own[k + 1 :]))
            for path in paths[i : i + width]:
                path.append(pair)
    return h(*own)


def fold(digest: str, path) -> str:
    """The root that a leaf and its siblings make."""
    for left, right in path:
        digest = h(left, digest, right)
    return digest


def field(value: Column) -> Column:
    """`-` if null, else the count of UTF-8 bytes, a colon, the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def placed(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """`rows`, written out, plus pos (their place within their tree, from 0) and nodes (rows of the tree).

    A sort by ranges deals rows by tree and order, so a large tree lies in many parts; a part's
    first place is the count of what lies before it. Ties stand in any order.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(parts, tree, *order, "_tie").sortWithinPartitions(tree, *order, "_tie").drop("_tie")
    stored = cut(dealt.withColumn("_at", F.monotonically_increasing_id()), "merkle-sorted")
    part = F.shiftright("_at", 33)
    counts = stored.groupBy(tree, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_least"))
    before, of_tree = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(tree)
    first = counts.select(
        F.col(tree).alias("_tree"), "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least")).alias("_shift"), F.sum("_n").over(of_tree).alias("nodes")
    )
    out = stored.join(first, (F.col(tree) == F.col("_tree")) & (part == F.col("_part"))).withColumn("pos", F.col("_at") + F.col("_shift"))
    out = cut(out.drop("_tree", "_part", "_shift", "_at"), "merkle-placed")
    free(stored)
    return out


def _block(depth: int) -> Column:
    return F.shiftright("pos", 3 * depth).alias("block")


def _up(nodes: DataFrame, depth: int) -> DataFrame:
    """The nodes of the next traversal: a digest for each block of these (tree, pos, nodes, digest)."""

    def walk(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        total, up = int(block["nodes"].iloc[0]), levels(int(block["nodes"].iloc[0]), depth)
        above = -(-total // ARITY**up)
        at = int(block["pos"].iloc[0]) // ARITY**depth
        return pd.DataFrame([(block["tree"].iloc[0], at, above, traverse(list(block["digest"]), up))], columns=["tree", "pos", "nodes", "digest"])

    return nodes.select("tree", "pos", "nodes", "digest").groupBy("tree", _block(depth)).applyInPandas(walk, NODES)


def _down(nodes: DataFrame, paths: DataFrame, depth: int, extra: dict[str, str], finish: Callable[[pd.DataFrame, list], pd.DataFrame]) -> DataFrame:
    """For every block of `nodes` what `finish` makes of it and the whole paths of its nodes; `paths` has
    (tree, pos, path) of the blocks' roots, of none where the block's root is the root of all."""

    def walk(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos").reset_index(drop=True)
        own: list[list[tuple[str, str]]] = [[] for _ in range(len(block))]
        if len(block):
            traverse(list(block["digest"]), levels(int(block["nodes"].iloc[0]), depth), own)
        rest = [(p["left"], p["right"]) for p in above["path"].iloc[0]] if len(above) else []
        return finish(block, [path + rest for path in own])

    schema = ", ".join(f"{c} {kind}" for c, kind in extra.items())
    left = nodes.groupBy("tree", _block(depth))
    return left.cogroup(paths.select("tree", F.col("pos").alias("block"), "path").groupBy("tree", "block")).applyInPandas(walk, schema)


def _path_rows(block: pd.DataFrame, paths: list) -> pd.DataFrame:
    return pd.DataFrame({"tree": block["tree"], "pos": block["pos"], "path": [[{"left": a, "right": b} for a, b in p] for p in paths]})


def _climb(nodes: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """Every round's nodes, the given ones first, and the last round's: one root a tree."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("nodes")).first()[0] or 0) > 1:
        rounds.append(cut(_up(rounds[-1], depth), "merkle-nodes"))
    return rounds, rounds[-1]


def _paths(rounds: list[DataFrame], top: DataFrame, depth: int) -> DataFrame:
    """The paths of the roots of the lowest blocks, handed down from those of the trees' roots (`top`)."""
    paths = top
    for nodes in reversed(rounds[1:-1]):
        lower = cut(_down(nodes, paths, depth, {"tree": "string", "pos": "long", "path": PATH.split(" ", 1)[1]}, _path_rows), "merkle-paths")
        if paths is not top:
            free(paths)
        paths = lower
    return paths


def merkle_manifest(rows: DataFrame, group: str, id_: str, leaf: str, tampered: str | None = None, depth: int = DEPTH) -> DataFrame:
    """A manifest of `rows`: (id_, group, pos, leaf, subroot, root, path, folded_root) for each row.

    `leaf` names a column with a row's digest (hex), `tampered` one with the digest as found now
    (null: unchanged). Leaves of a group ascend by `id_` (null first; equal ids by digest), and of
    every 8 consecutive nodes the concatenated digests are hashed, until one is left: the group's
    subroot. Subroots, ordered by group (null first, then bytewise), make the root likewise. `path`
    holds what stands left and right of the row's branch at each level, from its leaf to the root;
    folded_root is what the tampered leaf (else the leaf) and these make of it.

    Defined cases: a null group is a group; repeated rows are leaves of their own; rows without id
    come first in their group; no rows, no manifest. A lone leaf is its group's subroot and a lone
    subroot the root, with nothing on that way of the path.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree")
    own = rows.select(tree, F.col(id_).alias("id"), F.col(leaf).alias("digest"), (F.col(tampered) if tampered else F.lit(None).cast("string")).alias("forged"))
    own = cut(own, "merkle-leaves")  # the sort reads its input twice
    stored = placed(own, "tree", "id", "digest")
    free(own)
    leaves = stored.withColumn("id", F.col("id").cast("string"))  # pandas would make floats of whole numbers with nulls
    rounds, subroots = _climb(leaves, depth)
    # The groups' roots are leaves again, of one tree.
    groups = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), "tree", "of")
    upper, root = _climb(groups, depth)
    at_top = root.select("tree", "pos", F.lit(None).cast(PATH.split(" ", 1)[1]).alias("path")).where("false")
    kinds = {"of": "string", "path": PATH.split(" ", 1)[1], "subroot": "string", "root": "string"}

    def of_groups(block: pd.DataFrame, paths: list) -> pd.DataFrame:
        found = _path_rows(block, paths)
        return pd.DataFrame({"of": block["of"], "path": found["path"], "subroot": block["digest"], "root": [fold(d, p) for d, p in zip(block["digest"], paths)]})

    ways = cut(_down(groups, _paths(upper, at_top, depth), depth, kinds, of_groups), "merkle-groups")
    of_tree = ways.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("pos"), "path")
    below = _paths(rounds, of_tree, depth)
    free(groups, *rounds[1:], *upper[1:])
    out = {"tree": "string", "id": "string", "pos": "long", "leaf": "string", "path": PATH.split(" ", 1)[1], "folded_root": "string"}

    def of_leaves(block: pd.DataFrame, paths: list) -> pd.DataFrame:
        start = [d if pd.isna(f) else f for d, f in zip(block["digest"], block["forged"])]
        return pd.DataFrame({
            "tree": block["tree"], "id": block["id"], "pos": block["pos"], "leaf": block["digest"], "path": _path_rows(block, paths)["path"],
            "folded_root": [fold(d, p) for d, p in zip(start, paths)],
        })

    proven = _down(leaves, below, depth, out, of_leaves)
    # A row a group: Spark broadcasts it if it is small and sorts it otherwise.
    met = proven.join(ways.select(F.col("of").alias("_of"), "subroot", "root"), F.col("tree") == F.col("_of"))
    name = F.when(F.col("tree") != "", F.substring(F.col("tree"), F.lit(2), F.length("tree"))).cast(rows.schema[group].dataType)
    return met.select(F.col("id").cast(rows.schema[id_].dataType).alias(id_), name.alias(group), "pos", "leaf", "subroot", "root", "path", "folded_root")


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether it still proves after a third of them are tampered with."""
    docs = table(spark, sf_dir, "documents")
    of = lambda text: F.sha2(F.concat(*[field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)]), 256)
    forged = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, of(ascii_lower(F.col("text"))))
    manifest = merkle_manifest(docs.select("doc_id", "lang", of(F.col("text")).alias("leaf"), forged.alias("forged")), "lang", "doc_id", "leaf", "forged")
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), ""), 256)
    return manifest.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: crc32 of a decimal number, byte by byte over a table that its own rule makes.
CRC = r"""
WITH RECURSIVE bits AS (
  SELECT i, i::UBIGINT AS v, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
crcs AS (
  SELECT d.doc_id, xor(4294967295::UBIGINT, list_reduce(
           list_prepend(4294967295::UBIGINT, list_transform(string_split(d.doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
           lambda a, b: xor(t[((xor(a, b) & 255) + 1)::BIGINT], a >> 8))) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d, crc_table)
"""

SQL = (
    CRC
    + r""",
fields AS (
  SELECT d.*, c.crc % 3 = 0 AS changed,
         concat(coalesce(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head
  FROM documents d LEFT JOIN crcs c ON d.doc_id = c.doc_id),
digests AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN changed THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS forged
  FROM fields),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM digests),
up AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, level, pos // 8, n),
subs AS (
  SELECT tree, digest, level AS height, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, n, digest FROM subs
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 8, n),
nodes AS (
  SELECT tree, level, pos, digest FROM up WHERE n > 1
  UNION ALL
  SELECT s.tree, s.height + t.level, t.pos, t.digest FROM subs s, top t WHERE t.n > 1),
ways AS (
  SELECT DISTINCT l.tree, l.pos, k.level,
         CASE WHEN k.level < s.height THEN l.pos // (8 ** k.level)::BIGINT ELSE s.pos // (8 ** (k.level - s.height))::BIGINT END AS at
  FROM leaves l JOIN subs s ON l.tree = s.tree JOIN (SELECT DISTINCT tree, level FROM nodes) k ON k.tree = l.tree),
siblings AS (
  SELECT w.tree, w.pos, w.level, coalesce(string_agg(o.digest, '' ORDER BY o.pos) FILTER (WHERE o.pos < w.at), '') AS l,
         coalesce(string_agg(o.digest, '' ORDER BY o.pos) FILTER (WHERE o.pos > w.at), '') AS r
  FROM ways w JOIN nodes o ON o.tree = w.tree AND o.level = w.level AND o.pos // 8 = w.at // 8
  GROUP BY w.tree, w.pos, w.level),
proofs AS (SELECT tree, pos, sha256(string_agg(l || r, '' ORDER BY level)) AS proof FROM siblings GROUP BY tree, pos),
folds AS (
  SELECT tree, pos, 0 AS level, coalesce(forged, leaf) AS digest FROM leaves
  UNION ALL
  SELECT f.tree, f.pos, f.level + 1, sha256(s.l || f.digest || s.r) FROM folds f JOIN siblings s ON s.tree = f.tree AND s.pos = f.pos AND s.level = f.level),
folded AS (SELECT tree, pos, arg_max(digest, level) AS digest FROM folds GROUP BY tree, pos)
SELECT l.doc_id, l.leaf, s.digest AS subroot, t.digest AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.digest AS folded_root,
       f.digest = t.digest AS verified
FROM leaves l JOIN subs s ON l.tree = s.tree JOIN (SELECT digest FROM top WHERE n = 1) t ON true
JOIN folded f ON f.tree = l.tree AND f.pos = l.pos LEFT JOIN proofs p ON p.tree = l.tree AND p.pos = l.pos
"""
)
