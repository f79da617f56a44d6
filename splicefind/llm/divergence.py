"""How far the word use of each source lies from the other sources of its language, and by which terms.

A term is a run of ASCII letters and characters beyond ASCII, with A-Z lowered.  Each language keeps the terms
that at least ``least`` of its documents hold; a group (language, source) gives each kept term
p = 1 + floor(10^9 (count + 5) / (N + 5 V)), exactly.  Two groups of a language lie sum |p - p'| apart.

Each input task counts its own documents first, so a frequent term or a hot source sends one row a flush.  The groups and
the terms of a language are numbered and cut into blocks of ``wide`` groups and chunks of ``long`` terms; the counts of a
block in a chunk are packed into one row of narrow integers.  A packed row is sent to the tiles of its block (block by block,
each pair of blocks once); a tile reads its two blocks' vectors chunk after chunk and adds up its submatrix of
distances, so a task holds two blocks of one chunk.  The number of copies is the number of the language's blocks.

Defined cases: null text, language and source count as ''; a group without a kept term has N = 0; terms are compared bytewise;
pairs and terms of one value rank by their item, bytewise; without kept terms all distances are 0; an
empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_batches, stored
from .ranks import numbered

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCALE = 10**9
PRIOR = 5
GROUPS = 32
TERMS = 2048
FLUSH = 300_000  # distinct terms that a task holds before it sends its counts


def term_counts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, source, term, n, df), several rows for one term; a row without a term for each group."""

    def sent(held):
        for (g, s), (n, df) in held.items():
            terms = list(n)
            many = len(terms) + 1
            yield pa.record_batch(
                [pa.array([g] * many, pa.string()), pa.array([s] * many, pa.string()), pa.array([*terms, None], pa.binary()),
                 pa.array([*n.values(), 0], pa.int64()), pa.array([*map(df.__getitem__, terms), 0], pa.int64())], ["lang", "source", "term", "n", "df"],
            )

    def task(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for g, s, t in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"].to_pylist()):
                n, df = held.setdefault((g, s), (Counter(), Counter()))
                size -= len(df)
                own = Counter(TERM.findall(t.lower()))
                n.update(own)
                df.update(own.keys())
                size += len(df)
                if size > FLUSH:
                    yield from sent(held)
                    held, size = {}, 0
        yield from sent(held)

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    out = rows.mapInArrow(task, "lang string, source string, term binary, n long, df long")
    return out.withColumn("term", F.col("term").cast("string"))


def kept_terms(counts: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, n, total) of the kept terms, ``total`` over the language; and n = 0 without a term for each group."""
    counts = counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    own = W.partitionBy("lang", "term")
    counts = counts.select("lang", "source", "term", "n", F.sum("n").over(own).alias("total"), F.sum("df").over(own).alias("_df"))
    return counts.where(F.col("term").isNull() | (F.col("_df") >= least)).drop("_df")


def probability(n: Column, of: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + PRIOR) / (of + PRIOR terms)), in decimals of 38 digits."""
    whole = lambda c: c.cast("decimal(20,0)")
    part, over = whole(n + PRIOR) * F.lit(SCALE).cast("decimal(10,0)"), whole(of + PRIOR * terms)
    return F.call_function("div", part, over) + 1


def _share(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE n / of) by long division, exact in 64 bits for sums below 9 x 10^15."""
    out, rest = np.zeros_like(n), n
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // of
        rest = rest % of
    return out + 1


def _narrow(x: np.ndarray) -> bytes:
    """Unsigned integers, one byte for their width, then as many bytes each."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(x) or x.max() < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def packed(rows: DataFrame, wide: int = GROUPS, long: int = TERMS) -> DataFrame:
    """(lang, block, chunk, groups, terms, counts) of rows (lang, g, t, n): the places and counts of a block in a chunk."""

    @by_batches
    def task(key, batches):
        g, t, n = (np.concatenate(x) for x in zip(*((b["g"].to_numpy(), b["t"].to_numpy(), b["n"].to_numpy()) for b in batches)))
        order = np.lexsort((t, g))
        yield pa.record_batch([pa.array([k.as_py()]) for k in key] + [pa.array([_narrow(x[order])]) for x in (g % wide, t % long, n)], ["lang", "block", "chunk", "groups", "terms", "counts"])

    rows = rows.select("lang", "g", "t", "n", F.floor(F.col("g") / wide).alias("block"), F.floor(F.col("t") / long).alias("chunk"))
    return rows.groupBy("lang", "block", "chunk").applyInArrow(task, "lang string, block long, chunk long, groups binary, terms binary, counts binary")


class _Tile:
    """One block by block task: sums of |p - p'| while chunks pass."""

    def __init__(self, v: int, long: int):
        self.v, self.long, self.seen, self.names, self.of = v, long, 0, {}, {}
        self.chunk, self.rows, self.total = -1, {}, None

    def head(self, block: int, names: list[str], sums: list[int]) -> None:
        self.names[block], self.of[block] = names, np.array(sums, dtype=np.int64) + PRIOR * self.v

    def blocks(self) -> tuple[int, int]:
        return min(self.names), max(self.names)

    def bare(self, block: int) -> np.ndarray:
        """p of an absent term, per group."""
        return _share(np.full(len(self.of[block]), PRIOR), self.of[block])

    def matrix(self, block: int, width: int) -> np.ndarray:
        out = np.repeat(self.bare(block)[:, None], width, axis=1)
        if block in self.rows:
            g, t, n = self.rows[block]
            out[g, t] = _share(n + PRIOR, self.of[block][g])
        return out

    def close_chunk(self) -> None:
        a, b = self.blocks()
        if self.total is None:
            self.total = np.zeros((len(self.names[a]), len(self.names[b])), dtype=np.int64)
        if self.rows:
            width = min(self.long, self.v - self.chunk * self.long)
            left, right = self.matrix(a, width), self.matrix(b, width)
            for i in range(len(left)):
                self.total[i] += np.abs(right - left[i]).sum(axis=1)
            self.seen += width
            self.rows = {}

    def add(self, block: int, chunk: int, row: list[np.ndarray]) -> None:
        if chunk != self.chunk:
            self.close_chunk()
            self.chunk = chunk
        self.rows[block] = row

    def done(self, lang: str) -> pa.RecordBatch:
        """Both directions of every pair of different groups."""
        self.close_chunk()
        a, b = self.blocks()
        if self.v > self.seen:  # chunks that neither block has a count in
            self.total += (self.v - self.seen) * np.abs(self.bare(a)[:, None] - self.bare(b))
        i, j = np.indices(self.total.shape).reshape(2, -1)
        if a == b:
            i, j = i[i != j], j[i != j]
        left, right, value = np.array(self.names[a], object)[i], np.array(self.names[b], object)[j], self.total[i, j]
        if a != b:
            left, right, value = np.concatenate([left, right]), np.concatenate([right, left]), np.concatenate([value, value])
        return pa.record_batch([pa.array([lang] * len(value), pa.string()), pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "item", "value"])


def tiled(vectors: DataFrame, groups: DataFrame, wide: int = GROUPS, long: int = TERMS) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of groups of a language, from packed ``vectors``."""
    block = F.floor(F.col("g") / wide).alias("block")
    heads = groups.groupBy("lang", block).agg(F.array_sort(F.collect_list(F.struct("g", "source", "of"))).alias("head"), F.max("n_groups").alias("n_groups"), F.max("v").alias("v"))
    sizes = groups.groupBy("lang").agg(F.max("n_groups").alias("n_groups"))
    none = F.lit(None).cast("binary")
    rows = heads.select("lang", "block", F.lit(-1).cast("long").alias("chunk"), none.alias("groups"), none.alias("terms"), none.alias("counts"), "head", "v", "n_groups").unionByName(
        vectors.join(sizes, "lang"), allowMissingColumns=True
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_groups") - 1) / wide))).alias("other")
    rows = rows.select("*", other).select("lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "chunk", "block", "groups", "terms", "counts", "head.source", "head.of", "v")

    def task(batches):
        at, tile = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if (r["lang"], r["a"], r["b"]) != at:
                    if tile:
                        yield tile.done(at[0])
                    at, tile = (r["lang"], r["a"], r["b"]), _Tile(r["v"], long)
                if r["chunk"] < 0:
                    tile.head(r["block"], r["source"], r["of"])
                else:
                    tile.add(r["block"], r["chunk"], [_wide(r[n]) for n in ("groups", "terms", "counts")])
        if tile:
            yield tile.done(at[0])

    tiles = rows.repartition("lang", "a", "b").sortWithinPartitions("lang", "a", "b", "chunk", "block")
    return tiles.mapInArrow(task, "lang string, source string, item string, value long")


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = 30, top: int = 50, wide: int = GROUPS, long: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to all other sources, and the ``top`` terms used more than the language does."""
    kept = stored(kept_terms(term_counts(docs, lang, source, text), least))
    counts = kept.where(F.col("term").isNotNull())
    terms = numbered(stored(counts.select("lang", "term", "total").distinct(), free=False), ["lang"], ["term"]).withColumnsRenamed({"pos": "t", "n": "v"})
    langs = terms.groupBy("lang").agg(F.max("v").alias("v"), F.sum("total").alias("lang_of"))
    groups = stored(kept.groupBy("lang", "source").agg(F.sum("n").alias("of")), free=False)
    groups = numbered(groups, ["lang"], ["source"]).withColumnsRenamed({"pos": "g", "n": "n_groups"})
    groups = stored(groups.join(langs, "lang", "left").fillna(0, ["v", "lang_of"]), free=False)

    placed = counts.join(groups, ["lang", "source"])
    vectors = packed(placed.join(terms.select("lang", "term", "t"), ["lang", "term"]), wide, long)
    pairs = numbered(stored(tiled(vectors, groups, wide, long), free=False), ["lang", "source"], [F.col("value").desc(), "item"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", (F.col("pos") + 1).cast("int").alias("rank"))

    over = probability(F.col("n"), F.col("of"), F.col("v")) - probability(F.col("total"), F.col("lang_of"), F.col("v"))
    found = placed.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), over.alias("value")).where("value > 0")
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))).where(F.col("rank") <= top)
    return pairs.unionByName(found)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*) AS v, sum(total) AS lang_of FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS of, coalesce(any_value(v), 0) AS v, coalesce(any_value(lang_of), 0) AS lang_of
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) LEFT JOIN l USING (lang) GROUP BY lang, source),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (of + 5 * v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (total + 5)) // (lang_of + 5 * v)::HUGEINT AS q
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
o AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50
"""
