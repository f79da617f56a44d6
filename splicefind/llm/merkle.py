"""Merkle manifest of a dataset: one tree per group of rows, one tree over the groups' roots.

A leaf is the hash of a row's fields.  The leaves of a group ascend by key; while several nodes remain, every two
consecutive ones become their hash (a last one alone, too, by itself).  Hashes are SHA-256, as lower-case hex text,
of the hex texts of their inputs.

Leaves are numbered by ranges (`ranks.numbered`), so a group may hold any share of the rows.  The tree is climbed in aligned
blocks of 2^``height`` nodes, one level table per climb, until every group has one node; the roots go through the same climb.
Coming down, a block is met by the path of its own root (the upper proof), and a fractal traversal emits the
paths of its nodes in order: each stack level keeps an existing subtree, from which siblings are read, and a desired one, which
treehash grows by two nodes a step, so that it is whole when the existing one is spent.  A task
holds the hashes of one block and about 4 x 2^SPAN nodes for every SPAN levels of it.

Defined cases: a null field counts as ``-``; rows of one key go by their leaf's hash, null keys first; a null group is a group of its
own, the first one; a group of one row has its leaf as root; an empty table gives no rows.  Other columns come along where ``carry`` names them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batches, stored
from .ranks import numbered

HEIGHT = 12  # levels of a block: 4,096 nodes
SPAN = 4  # levels of a subtree of the stack
PATH = "array<struct<left:string,right:string>>"


def leaf_hash(*fields: Column) -> Column:
    """Hash of a row: each field is ``-`` if null, else its UTF-8 byte count, ``:`` and the value as text."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text)).cast("binary"), 256)


def siblings_hash(path: Column | str) -> Column:
    """Hash of a path's siblings, from the leaf up."""
    path = F.col(path) if isinstance(path, str) else path
    return F.sha2(F.array_join(F.transform(path, lambda p: F.coalesce(p["left"], p["right"], F.lit(""))), "").cast("binary"), 256)


def folded(leaf: Column | str, path: Column | str) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(path, F.col(leaf) if isinstance(leaf, str) else leaf, lambda h, p: F.sha2(F.concat(F.coalesce(p["left"], F.lit("")), h, F.coalesce(p["right"], F.lit(""))).cast("binary"), 256))


def above(left: str | None, right: str | None) -> str | None:
    """The node over two neighbours; the right one, or both, may lie beyond the last node."""
    return None if left is None else sha256((left + (right or "")).encode()).hexdigest()


class Subtree:
    """Levels ``base`` .. ``top`` - 1 under node ``index`` of level ``top``, grown by treehash node after node."""

    def __init__(self, nodes: list[str], base: int, top: int, index: int):
        self.base, self.top, self.index = base, top, index
        self.level: list[list[str | None]] = [[] for _ in range(base, top)]
        self._growing = self._treehash(nodes)

    def _treehash(self, nodes: list[str]) -> Iterator[None]:
        waiting: list[tuple[int, str | None]] = []
        for i in range(self.index << self.top, self.index + 1 << self.top):
            depth, node = 0, nodes[i] if i < len(nodes) else None
            while True:
                if depth >= self.base:
                    self.level[depth - self.base].append(node)
                yield
                if not waiting or waiting[-1][0] != depth or depth + 1 == self.top:
                    break
                node = above(waiting.pop()[1], node)
                depth += 1
            waiting.append((depth, node))

    def grow(self, steps: int | None = None) -> Subtree:
        """Make so many more nodes, or all."""
        if steps is None:
            for _ in self._growing:
                pass
        else:
            for _ in range(steps):
                next(self._growing, None)
        return self

    def node(self, depth: int, place: int) -> str | None:
        return self.level[depth - self.base][place - (self.index << self.top - depth)]


def traverse(nodes: list[str], height: int, span: int = SPAN) -> Iterator[list[str | None]]:
    """The siblings of each node's path up to level ``height``, bottom first, node after node."""
    steps = [(base, min(base + span, height)) for base in range(0, height, span)]
    existing = [Subtree(nodes, base, top, 0).grow() for base, top in steps]
    desired = [Subtree(nodes, base, top, 1) for base, top in steps[:-1]]
    for i in range(len(nodes)):
        yield [tree.node(d, (i >> d) ^ 1) for tree in existing for d in range(tree.base, tree.top)]
        for k, tree in enumerate(desired):
            tree.grow(2)
            if i + 1 & (1 << tree.top) - 1 == 0:
                existing[k] = tree.grow()
                desired[k] = Subtree(nodes, tree.base, tree.top, tree.index + 1)


def _levels(n: int, height: int) -> int:
    """Levels that a block of a tree over ``n`` nodes has."""
    return min(height, max(0, int(n) - 1).bit_length())


def _block_roots(nodes: DataFrame, height: int) -> DataFrame:
    """(k, pos, n, h) of the next level table: one node per block."""

    @by_batches
    def task(key, batches):
        rows = pa.Table.from_batches([b.select(["pos", "n", "h"]) for b in batches]).sort_by("pos")
        n, level = rows["n"][0].as_py(), rows["h"].to_pylist()
        for _ in range(_levels(n, height)):
            level = [above(level[i], level[i + 1] if i + 1 < len(level) else None) for i in range(0, len(level), 2)]
        yield pa.record_batch([pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int64()), pa.array([-(-n >> height)], pa.int64()), pa.array(level, pa.string())], ["k", "pos", "n", "h"])

    return nodes.select("k", "pos", "n", "h", F.shiftright("pos", height).alias("block")).groupBy("k", "block").applyInArrow(task, "k string, pos long, n long, h string")


def climb(nodes: DataFrame, height: int) -> list[DataFrame]:
    """Level tables from ``nodes`` (k, pos, n, h and more) up to one with a single node per k."""
    levels = [nodes]
    while (levels[-1].agg(F.max("n").alias("n")).first().n or 0) > 1:
        levels.append(stored(_block_roots(levels[-1], height), free=False))
    return levels


def _paths(nodes: DataFrame, upper: DataFrame, height: int) -> DataFrame:
    """``nodes`` with the path up to the top of ``upper`` (k, pos of the block, path, more columns, which come along)."""
    more = [f for f in upper.schema.fields if f.name not in ("k", "pos", "n", "h", "path")]
    schema = nodes.schema.names + [f.name for f in more]

    def task(key, rows, proof):
        rows = rows.drop_columns(["block"]).sort_by("pos")
        own = _levels(rows["n"][0].as_py(), height)
        tail = proof["path"][0].as_py()
        left, right = [], []
        up = [p["left"] for p in tail], [p["right"] for p in tail]
        for i, path in enumerate(traverse(rows["h"].to_pylist(), own)):
            left += [s if i >> d & 1 else None for d, s in enumerate(path)] + up[0]
            right += [None if i >> d & 1 else s for d, s in enumerate(path)] + up[1]
        ends = np.arange(len(rows) + 1, dtype=np.int32) * (own + len(tail))
        path = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"]))
        for f in more:
            rows = rows.append_column(f.name, pa.repeat(proof[f.name][0], len(rows)))
        return rows.append_column("path", path).select([*schema, "path"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*nodes.schema.fields, *more]) + f", path {PATH}"
    return nodes.withColumn("block", F.shiftright("pos", height)).groupBy("k", "block").cogroup(upper.groupBy("k", "pos")).applyInArrow(task, out)


def descend(levels: list[DataFrame], upper: DataFrame, height: int) -> DataFrame:
    """The rows of the lowest level table, each with its path; ``upper`` has the paths of the highest one's nodes."""
    for nodes in reversed(levels[:-1]):
        upper = _paths(nodes, upper, height)
    if len(levels) == 1:  # every group is one node: its path is the upper one
        more = [c for c in upper.columns if c not in ("k", "pos")]
        upper = levels[0].join(upper.select("k", *more), "k")
    return upper


def merkle_manifest(docs: DataFrame, fields: list[str], group: str = "lang", key: str = "doc_id", carry: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """Per row: ``key``, leaf, subroot (of its group), root (of all), path (siblings up to the root), and ``carry``.

    ``fields`` are the columns that a leaf covers, in order.  A path holds one struct (left, right) per level; both
    are null where a node has no neighbour.
    """
    carry = carry or {}
    name = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))  # null first, then bytewise
    rows = docs.select(name.alias("k"), F.col(key).alias("id"), leaf_hash(*(F.col(f) for f in fields)).alias("h"), F.struct(F.lit(0).alias("_"), *(c.alias(n) for n, c in carry.items())).alias("more"))
    levels = climb(numbered(stored(rows, free=False), ["k"], ["id", "h"]), height)
    tops = levels[-1].select("k", F.col("h").alias("subroot"))
    roots = climb(numbered(stored(tops.select(F.lit("").alias("k"), F.col("k").alias("name"), F.col("subroot").alias("h")), free=False), ["k"], ["name"]), height)
    root = roots[-1].select("k", "pos", F.col("h").alias("root"), F.array().cast(PATH).alias("path"))
    top = descend(roots, root, height).select(F.col("name").alias("k"), F.lit(0).cast("long").alias("pos"), "path", F.col("h").alias("subroot"), "root")
    return descend(levels, top, height).select(F.col("id").alias(key), F.col("h").alias("leaf"), "subroot", "root", "path", *(F.col("more")[n].alias(n) for n in carry))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(range(8 * strlen(CAST(doc_id AS VARCHAR))), lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr(CAST(doc_id AS VARCHAR), i // 8 + 1, 1)) ELSE 0 END)),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS crc FROM documents),
f AS (
  SELECT doc_id, lang, coalesce(crc % 7 = 0, false) AS tampered, n_chars,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(text) || ':' || text, '-') AS b FROM d),
l AS (
  SELECT doc_id, lang, sha256(a || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') || b) AS leaf,
    CASE WHEN tampered THEN sha256(a || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || CAST(n_chars + 1 AS VARCHAR), '-') || b) END AS other FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
t AS (
  SELECT lang, 0 AS level, pos, n, leaf AS h FROM p
  UNION ALL
  SELECT lang, level + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lang, level, pos // 2),
s AS (SELECT lang, h AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, place AS pos, n, subroot AS h FROM s
  UNION ALL
  SELECT level + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 2),
r AS (SELECT h AS root, level AS top FROM u WHERE n = 1),
steps AS (
  SELECT p.lang, p.pos, t.level AS rung, t.pos % 2 AS side, t.h AS sibling FROM p JOIN t ON t.lang IS NOT DISTINCT FROM p.lang AND t.n > 1 AND t.pos = xor(p.pos >> t.level, 1)
  UNION ALL
  SELECT p.lang, p.pos, s.height + u.level, u.pos % 2, u.h FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang JOIN u ON u.n > 1 AND u.pos = xor(s.place >> u.level, 1)),
proof AS (SELECT lang, pos, sha256(string_agg(sibling, '' ORDER BY rung)) AS proof_sha256 FROM steps GROUP BY lang, pos),
fold AS (
  SELECT p.lang, p.pos, 0 AS rung, s.height + r.top AS total, coalesce(other, leaf) AS h FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang, r
  UNION ALL
  SELECT f.lang, f.pos, f.rung + 1, total, sha256(CASE side WHEN 0 THEN sibling || h WHEN 1 THEN h || sibling ELSE h END)
  FROM fold f LEFT JOIN steps ON steps.lang IS NOT DISTINCT FROM f.lang AND steps.pos = f.pos AND steps.rung = f.rung WHERE f.rung < total)
SELECT p.doc_id, p.leaf, s.subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, fold.h AS folded_root, fold.h = root AS verified
FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang JOIN fold ON fold.lang IS NOT DISTINCT FROM p.lang AND fold.pos = p.pos AND fold.rung = fold.total
LEFT JOIN proof ON proof.lang IS NOT DISTINCT FROM p.lang AND proof.pos = p.pos, r
"""
