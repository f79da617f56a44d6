"""Benchmark decontamination with a distributed positional inverted index.

Index: the texts are cut into segments of a few MB; a segment holds, for each of its
terms (64-bit word hashes), the ascending token positions.  It is a table, one row per
segment, written to the shared folder, so lost executors cost no rebuild.

Search: the windows of the benchmark items are phrases.  In each segment a phrase is
dropped when a term has no postings; else the postings of its rarest term, less the
term's offset, are the candidate starts, which are intersected with the offset-adjusted
lists of the other terms, rarest first.  ``proximity`` finds the terms of an item near
each other in any order instead.  The benchmark is sent in slices of bounded size.

Defined cases: null or wordless texts have no words and no hits; wordless items have no
window and never occur; repeated items each count; items shorter than a window are one
window; repeated documents are judged one by one; keys may be of any type, null ones stay null.  Only the key and
the result columns are returned, so extra columns never clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import parts_for, stored, text_bytes

WINDOW = 10
SLICE_BYTES = 8 << 20
INDEX_SCHEMA = "segment string, keys array<{}>, word_of binary, terms binary, term_of binary, positions binary"


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term of each word of a block, and where each text's words start."""
    w = tv.Words(tv.LOWER[buf], offs, tv.ALNUM_BYTES)
    return w.hashes(), w.of


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per segment; ``keys`` are the keys of its documents in order."""

    def task(batches):
        import uuid

        for batch in batches:
            for lo, hi, buf, offs in tv.blocks(batch, "text"):
                words, of = tokens(buf, offs)
                order = np.argsort(words, kind="stable")
                ranked = words[order]
                first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, dtype=np.int64)
                keys = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(0).slice(lo, hi - lo))
                parts = (of.astype(np.int32), ranked[first], np.append(first, len(ranked)).astype(np.int32), order.astype(np.int32))
                yield pa.record_batch([pa.array([uuid.uuid4().hex]), keys, *(tv.blob_list([x]) for x in parts)], ["segment", "keys", "word_of", "terms", "term_of", "positions"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(task, INDEX_SCHEMA.format(rows.schema["key"].dataType.simpleString()))


class Segment:
    """One row of the index, opened."""

    def __init__(self, row: dict):
        get = lambda name, kind: np.frombuffer(row[name], dtype=kind)
        self.word_of, self.terms, self.term_of, self.positions = get("word_of", np.int32), get("terms", tv.U64), get("term_of", np.int32), get("positions", np.int32)
        self.n = len(self.positions)
        self._at = None

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Number of each term in this segment, or -1."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        i = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[i] == terms, i, -1)

    def df(self, term: np.ndarray) -> np.ndarray:
        return self.term_of[term + 1] - self.term_of[term]

    @property
    def at(self) -> np.ndarray:
        """Term number at each position: membership in an offset-adjusted list in one look."""
        if self._at is None:
            self._at = np.empty(self.n, dtype=np.int32)
            self._at[self.positions] = np.repeat(np.arange(len(self.terms), dtype=np.int32), np.diff(self.term_of))
        return self._at

    def postings(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions of the given terms, and for each the index into ``term``."""
        count = self.df(term)
        which = np.repeat(np.arange(len(term)), count)
        first = np.cumsum(count) - count
        return self.positions[np.arange(int(count.sum())) - first[which] + self.term_of[term][which]], which

    def doc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.word_of, position, side="right") - 1

    def phrases(self, phrase: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact matches of the phrases (terms laid end to end): (phrase number, start position)."""
        none = np.zeros(0, dtype=np.int64)
        if not self.n or not len(phrase):
            return none, none
        term, length = self.find(phrase), np.diff(of)
        whole = np.minimum.reduceat(term, of[:-1]) >= 0
        live = np.flatnonzero(whole)
        if not len(live):
            return none, none
        most = int(length[live].max())
        back = np.minimum(np.arange(most), length[live][:, None] - 1)  # short phrases repeat their last term
        grid = term[of[:-1][live][:, None] + back]
        ranked = np.argsort(self.df(grid), axis=1, kind="stable")
        rows = np.arange(len(live))
        rarest = back[rows, ranked[:, 0]]
        position, which = self.postings(grid[rows, ranked[:, 0]])
        start = position.astype(np.int64) - rarest[which]
        ok = (start >= 0) & (start + length[live][which] <= self.n)
        start, which = start[ok], which[ok]
        for k in range(1, most):
            column = ranked[which, k]
            ok = self.at[start + back[which, column]] == grid[which, column]
            start, which = start[ok], which[ok]
            if not len(start):
                return none, none
        ok = self.doc(start) == self.doc(start + length[live][which] - 1)
        return live[which[ok]], start[ok]

    def near(self, phrase: np.ndarray, of: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of each phrase's rarest term with all its other terms at most ``within`` words away."""
        none = np.zeros(0, dtype=np.int64)
        if not self.n or not len(phrase):
            return none, none
        term = self.find(phrase)
        live = np.flatnonzero(np.minimum.reduceat(term, of[:-1]) >= 0)
        sorted_key = np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.term_of)) * (self.n + 1) + self.positions
        out: list[np.ndarray] = [none]
        names: list[np.ndarray] = [none]
        for p in live:
            ts = np.unique(term[of[p] : of[p + 1]])
            ts = ts[np.argsort(self.df(ts), kind="stable")]
            position = self.postings(ts[:1])[0].astype(np.int64)
            doc = self.doc(position)
            lo, hi = np.maximum(position - within, self.word_of[doc]), np.minimum(position + within, self.word_of[doc + 1] - 1)
            for t in ts[1:]:
                i = np.searchsorted(sorted_key, t * (self.n + 1) + lo)
                ok = (i < len(sorted_key)) & (sorted_key[np.minimum(i, len(sorted_key) - 1)] <= t * (self.n + 1) + hi)
                position, lo, hi = position[ok], lo[ok], hi[ok]
            out.append(position)
            names.append(np.full(len(position), p))
        return np.concatenate(names), np.concatenate(out)


def slices(benchmark: DataFrame, item: str, text: str, window: int | None):
    """The benchmark in parts of bounded size: (item ids, item of each phrase, terms, where phrases start)."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    parts = parts_for(text_bytes(rows), SLICE_BYTES)
    for part in range(parts):
        got = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).toArrow().combine_chunks().to_batches()
        ids, item_of, phrases, lens = [], [], [], []
        for batch in got:
            names = batch.column(0).to_pylist()
            for lo, hi, buf, offs in tv.blocks(batch, "text"):
                words, of = tokens(buf, offs)
                for i in range(hi - lo):
                    terms = words[of[i] : of[i + 1]]
                    size = min(window or len(terms), len(terms))
                    for s in range(len(terms) - size + 1) if size else ():
                        item_of.append(len(ids))
                        phrases.append(terms[s : s + size])
                        lens.append(size)
                    ids.append(names[lo + i])
        yield ids, np.array(item_of, dtype=np.int64), np.concatenate(phrases) if phrases else np.zeros(0, tv.U64), np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)


HITS = "segment string, row int, key {}, n_words long, items array<string>, starts array<int>, ends array<int>"


def search(index: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int | None = WINDOW, within: int | None = None) -> DataFrame:
    """Per document and benchmark slice: the items that occur and the word ranges hit.

    ``within`` asks for proximity matches of whole items instead of exact windows.
    """
    out = None
    for part in slices(benchmark, item, text, window if within is None else None):
        sent = index.sparkSession.sparkContext.broadcast(part)

        def task(batches, sent=sent):
            ids, item_of, phrase, of = sent.value
            names = np.array([*ids, ""], dtype=object)
            for batch in batches:
                for row, keys in zip(batch.drop_columns(["keys"]).to_pylist(), batch.column("keys")):
                    seg = Segment(row)
                    if within is None:
                        which, start = seg.phrases(phrase, of)
                        end = start + np.diff(of)[which]
                    else:
                        which, start = seg.near(phrase, of, within)
                        end = start + 1
                    doc = seg.doc(start)
                    pairs = np.unique(np.stack([doc, item_of[which]], axis=1), axis=0) if len(doc) else np.zeros((0, 2), dtype=np.int64)
                    n = len(keys.values)
                    cut = np.searchsorted(pairs[:, 0], np.arange(n + 1)).astype(np.int32)
                    # overlapping hits of a document become one range
                    hit = tv.covered(seg.n, start, end - start) if len(start) else np.zeros(seg.n, dtype=bool)
                    edge = np.zeros(seg.n + 1, dtype=bool)
                    edge[seg.word_of] = True
                    begins = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]])))
                    stops = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]]))) + 1
                    per = np.searchsorted(begins, seg.word_of).astype(np.int32)
                    base = np.repeat(seg.word_of[:-1], np.diff(per))
                    yield pa.record_batch(
                        [
                            pa.array([row["segment"]] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), keys.values, pa.array(np.diff(seg.word_of).astype(np.int64)),
                            pa.ListArray.from_arrays(pa.array(cut), pa.array(names[pairs[:, 1]].tolist(), pa.string())),
                            pa.ListArray.from_arrays(pa.array(per), pa.array((begins - base).astype(np.int32))), pa.ListArray.from_arrays(pa.array(per), pa.array((stops - base).astype(np.int32))),
                        ],
                        ["segment", "row", "key", "n_words", "items", "starts", "ends"],
                    )

        rows = index.mapInArrow(task, HITS.format(index.schema["keys"].dataType.elementType.simpleString()))
        out = rows if out is None else out.unionByName(rows)
    return out


def union_length(ranges: Column) -> Column:
    """Words inside sorted (s, e) ranges that may overlap."""
    start = F.struct(F.lit(0).alias("last"), F.lit(0).alias("sum"))
    step = lambda acc, r: F.struct(F.greatest(acc["last"], r["e"]).alias("last"), (acc["sum"] + F.greatest(F.lit(0), r["e"] - F.greatest(acc["last"], r["s"]))).alias("sum"))
    return F.aggregate(ranges, start, step, lambda acc: acc["sum"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: key, n_words, n_hit, items (sorted as strings) and the hit ranges."""
    index = stored(build_index(docs, key, text))
    hits = search(index, benchmark, item, item_text, window)
    ranges = F.arrays_zip(F.col("starts").alias("s"), F.col("ends").alias("e"))
    if parts_for(text_bytes(benchmark, item_text), SLICE_BYTES) > 1:  # the slices of a document meet
        hits = hits.groupBy("segment", "row", "key", "n_words").agg(F.flatten(F.collect_list("items")).alias("items"), F.array_sort(F.flatten(F.collect_list(ranges))).alias("ranges"))
    else:
        hits = hits.withColumn("ranges", ranges)
    return hits.select(F.col("key").alias(key), "n_words", union_length(F.col("ranges")).cast("long").alias("n_hit"), F.array_sort("items").alias("items"), "ranges")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
n AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, k, list_slice(ws, i, i + k - 1) AS s FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM n)),
pos AS (SELECT doc_id, k, i, list_slice(ws, i, i + k - 1) AS s FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM n) WHERE len(ws) >= k)),
hit AS (SELECT doc_id, item_id, pos.k, i FROM pos JOIN win ON pos.k = win.k AND pos.s = win.s),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
