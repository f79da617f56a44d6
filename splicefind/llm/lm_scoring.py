"""LM scoring by prediction by partial matching over bytes, against a unigram base.

Model.  A trie of byte contexts up to ``ORDER`` bytes (symbols 0-255 and an end mark 256,
which also pads the start of a text), with escape method D, full symbol exclusion and update
exclusion: a symbol seen n times in a context has (n - 1/2)/T, one not seen escapes with
D/(2T) (D distinct symbols, T their count) to the next shorter context, where all symbols
seen in the longer one are left out of the counts, and where a symbol counts once for
each longer context it follows; below the empty context comes the uniform distribution
over the symbols not seen at all.  As a longer context's symbols also follow the shorter one, the
exclusions of a static trie depend on the context alone, so the trie compiles to arrays:
a text costs one hash lookup a byte where its full context is known, a few elsewhere.
``adaptive`` gives the textbook code length of one text that starts with an empty trie.

Gathering.  Each task counts the (ORDER + 1)-grams of its training texts; the counts are
dealt by the last two symbols of their context, so a bucket has all n-grams of 3 and more
symbols whose context ends in these, with exact sums.  All counts cover the whole corpus.
Shorter n-grams (of 1 and 2 symbols, at most 257 * 257) go to every bucket, which then has
the whole part of the trie that its contexts need.  Nothing is dropped, and nothing that
grows with the corpus is broadcast: each chunk of texts sends its distinct (ORDER + 1)-grams
by bucket and gets their log probabilities back.

Base.  Vocabularies are unbounded, so nothing of them is broadcast: each chunk of
texts sends its distinct word hashes by hash range, gets their training counts back, and
scores its texts with them.

Defined cases: null and empty texts are the end mark alone; without training texts the
model is uniform and the base has N = V = 0; repeated rows count and score each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import by_batches, parts_for, stored, text_bytes
from .substring_dedup import chunked, cut

ORDER = 5
END = 256
SYMBOLS = 257
BITS = 9
BUCKET_BYTES = 48 << 20
DISCOUNT = 0.5
END_WORD = np.array([0x5EED_E0D0_0000_0001], dtype=tv.U64)


def low(bits: int) -> np.uint64:
    return tv.U64((1 << bits) - 1)


def symbols(buf: np.ndarray, offs: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased symbols of a block, ``order`` pads before each text and one at the end; event places; events' ranges."""
    n = len(offs) - 1
    out = np.full(len(buf) + order * n + 1, END, dtype=np.uint64)
    place = np.arange(len(buf)) + np.repeat((np.arange(n) + 1) * order, np.diff(offs))
    out[place] = tv.LOWER[buf]
    of = offs + np.arange(n + 1)
    event = np.empty(len(buf) + n, dtype=np.int64)
    ends = of[1:] - 1
    event[ends] = offs[1:] + (np.arange(n) + 1) * order
    inner = np.ones(len(event), dtype=bool)
    inner[ends] = False
    event[inner] = place
    return out, event, of


def grams(sym: np.ndarray, event: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The (order + 1)-gram that ends at each event, first symbol in the highest bits."""
    key = sym.copy()
    for k in range(1, order + 1):
        key[k:] |= sym[:-k] << tv.U64(BITS * k)
    return key[event]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


def dealt(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the (order + 1)-grams ``keys`` by bucket, and where each bucket starts in it."""
    bucket = (tv.mix((keys >> tv.U64(BITS)) & low(2 * BITS)) & tv.U64(n_buckets - 1)).astype(np.int32)
    by = np.argsort(bucket, kind="stable")
    return by, np.searchsorted(bucket[by], np.arange(n_buckets + 1))


GRAMS = "bucket int, keys binary, counts binary"
NODES = "size int, bucket int, keys binary, counts binary"
SCORES = "bucket int, chunk int, totals binary"


def gram_counts(docs: DataFrame, text: str, n_buckets: int, order: int = ORDER) -> DataFrame:
    """Counts of every n-gram of 2 to order + 1 symbols; those of 2 in several partial sums."""

    def task(batches):
        parts = []

        def fold():
            both = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            parts[:] = [both]

        for batch in batches:
            for _, _, buf, offs in tv.blocks(batch, text):
                sym, event, _ = symbols(buf, offs, order)
                key = np.sort(grams(sym, event, order))
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                parts.append((key[first], np.diff(np.append(first, len(key))).astype(np.int64)))
                if len(parts) > 8:
                    fold()
        if not parts:
            return
        fold()
        keys, counts = parts[0]
        by, at = dealt(keys, n_buckets)
        for b in np.flatnonzero(np.diff(at)):
            rows = by[at[b] : at[b + 1]]
            yield pa.record_batch([pa.array([b], pa.int32()), tv.blob_list([keys[rows]]), tv.blob_list([counts[rows].astype("<u4")])], ["bucket", "keys", "counts"])

    @by_batches
    def merge(key, batches):
        keys, counts = np.zeros(0, tv.U64), np.zeros(0, np.int64)
        for batch in batches:  # memory: the distinct n-grams of the bucket and one batch
            more = [np.frombuffer(x, tv.U64) for x in batch.column("keys").to_pylist()]
            n = [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column("counts").to_pylist()]
            keys, counts = summed(np.concatenate([keys, *more]), np.concatenate([counts, *n]))
        kinds = counts
        for size in range(order + 1, 1, -1):
            if size <= order:  # a symbol counts once for each longer context
                shorter = keys & low(size * BITS)
                kinds = summed(shorter, np.ones(len(keys), np.int64))[1]
                keys, counts = summed(shorter, counts)
            yield pa.record_batch([pa.array([size], pa.int32()), pa.array([key[0].as_py()], pa.int32()), tv.blob_list([keys]), tv.blob_list([kinds])], ["size", "bucket", "keys", "counts"])

    return docs.select(text).mapInArrow(task, GRAMS).groupBy("bucket").applyInArrow(merge, NODES)


def pairs_of(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of 2 symbols with their counts, summed by Spark: at most 257 * 257 rows reach the driver."""

    def task(batches):
        for batch in batches:
            for k, n in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                yield pa.record_batch([pa.array(np.frombuffer(k, np.int64)), pa.array(np.frombuffer(n, np.int64))], ["key", "n"])

    rows = nodes.where("size = 2").select("keys", "counts").mapInArrow(task, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    got = rows.toArrow()
    return summed(got["key"].to_numpy().view(tv.U64), got["n"].to_numpy().astype(np.int64))


def gram_scores(chunks: DataFrame, nodes: DataFrame, text: str, n_buckets: int, order: int = ORDER) -> DataFrame:
    """Log probabilities of each chunk's distinct (order + 1)-grams, one row per bucket."""
    sent = chunks.sparkSession.sparkContext.broadcast(pairs_of(nodes))

    @by_batches
    def ask(key, batches):
        names = np.zeros(0, tv.U64)
        for batch in batches:
            names = np.union1d(names, chunk_grams([b[2:] for b in tv.blocks(batch, text)], order))
        by, at = dealt(names, n_buckets)
        used = np.flatnonzero(np.diff(at))
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array([key[0].as_py()] * len(used), pa.int32()), tv.blob_list([names[by[at[b] : at[b + 1]]] for b in used])], ["bucket", "chunk", "keys"])

    def answer(key, left, right):
        known = {2: sent.value}
        for size, k, n in zip(*(left[c].to_pylist() for c in ("size", "keys", "counts"))):
            known[size] = np.frombuffer(k, tv.U64), np.frombuffer(n, np.int64)
        model = Trie(known, order)
        got = [model.score(np.frombuffer(k, tv.U64)) for k in right["keys"].to_pylist()]
        return pa.table({"bucket": right["bucket"], "chunk": right["chunk"], "totals": tv.blob_list(got)})

    asked = chunks.groupBy("chunk").applyInArrow(ask, "bucket int, chunk int, keys binary")
    return nodes.where("size > 2").groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(answer, SCORES)


def chunk_grams(blocks, order: int) -> np.ndarray:
    """Distinct (order + 1)-grams, ascending, of blocks (buf, offs)."""
    found = [np.unique(grams(*symbols(buf, offs, order)[:2], order)) for buf, offs in blocks]
    return np.unique(np.concatenate([np.zeros(0, tv.U64), *found]))


class Table:
    """An open-addressing table of 64-bit keys, filled and read in numpy."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 2.5).bit_length())
        self.shift, self.mask = tv.U64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, ~tv.U64(0), dtype=tv.U64)
        self.values = np.zeros(1 << bits, dtype=values.dtype)
        left, slot = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = left[self.keys[slot[left]] == ~tv.U64(0)]
            self.keys[slot[free]] = keys[free]  # of rivals for a slot, the last stays
            won = self.keys[slot[left]] == keys[left]
            self.values[slot[left[won]]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * tv.U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found)."""
        slot = self.slot(keys)
        there = self.keys[slot]
        found = there == keys
        out = self.values[slot]
        left = np.flatnonzero(~found & (there != ~tv.U64(0)))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            found[left[hit]] = True
            left = left[~hit & (there != ~tv.U64(0))]
        return out, found


class Trie:
    """The compiled model: ``score`` gives log10 probabilities of events."""

    def __init__(self, nodes: dict[int, tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.order = order
        two = nodes.get(2, (np.zeros(0, tv.U64), np.zeros(0, np.int64)))
        nodes = {**nodes, 1: summed(two[0] & low(BITS), np.ones(len(two[0]), np.int64))}
        self.event: list[tuple[np.ndarray, np.ndarray]] = []  # by context length: n-grams, log10 count
        self.context: list[dict[str, np.ndarray]] = []
        for k in range(order + 1):
            keys, counts = nodes.get(k + 1, (np.zeros(0, tv.U64), np.zeros(0, np.int64)))
            names, first = np.unique(keys >> tv.U64(BITS), return_index=True)
            total = np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
            kinds = np.diff(np.append(first, len(keys)))
            c = {"keys": names, "full": np.log10(total), "escape": np.log10(DISCOUNT * kinds / total), "total": total, "kinds": kinds}
            if k:  # what is left of the next shorter context once this one's symbols are excluded
                shorter, n = nodes.get(k, (np.zeros(0, tv.U64), np.zeros(0, np.int64)))
                seen = np.add.reduceat(n[np.searchsorted(shorter, keys & low(k * BITS))], first) if len(first) else total
                up = self.context[k - 1]
                i = np.searchsorted(up["keys"], names & low((k - 1) * BITS))
                rest, more = up["total"][i] - seen, up["kinds"][i] - kinds
                c["below"] = np.log10(np.maximum(rest, 1))
                c["chain"] = np.where(more > 0, np.log10(DISCOUNT * np.maximum(more, 1)) - c["below"], 0.0) + up["chain"][i]
            else:
                rest = SYMBOLS - len(keys)
                c["below"] = np.full(len(names), np.log10(max(rest, 1)))
                c["chain"] = np.zeros(len(names))
            self.event.append((keys, np.log10(counts - DISCOUNT)))
            self.context.append(c)
        keys, counts = self.event[order]
        top = self.context[order]
        self.top = Table(keys, (counts - top["full"][np.searchsorted(top["keys"], keys >> tv.U64(BITS))]).astype(np.float64) if len(keys) else np.zeros(0))

    def score(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of each event, given as its (order + 1)-gram."""
        out, found = self.top.find(key)
        miss = np.flatnonzero(~found)
        if len(miss):
            names, inverse = np.unique(key[miss], return_inverse=True)
            out[miss] = self.slow(names)[inverse]
        return out

    def slow(self, key: np.ndarray) -> np.ndarray:
        n = len(key)
        if not len(self.context[0]["keys"]):
            return np.full(n, -np.log10(SYMBOLS))
        state = np.zeros(n, dtype=np.int8)  # 0: context unknown so far, 1: escaped, 2: done
        # chain: escapes from the longest known context down; last: those below the context just left
        out, chain, last, below = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        for k in range(self.order, -1, -1):
            live = np.flatnonzero(state < 2)
            if not len(live):
                break
            c, (events, logs) = self.context[k], self.event[k]
            if not len(events):
                continue
            name = (key[live] >> tv.U64(BITS)) & low(k * BITS) if k else np.zeros(len(live), tv.U64)
            i = np.minimum(np.searchsorted(c["keys"], name), len(c["keys"]) - 1)
            known = c["keys"][i] == name
            live, i = live[known], i[known]
            gram = key[live] & low((k + 1) * BITS)
            j = np.minimum(np.searchsorted(events, gram), len(events) - 1)
            seen = events[j] == gram
            fresh = state[live] == 0
            full = seen & fresh
            out[live[full]] = logs[j[full]] - c["full"][i[full]]
            after = seen & ~fresh
            out[live[after]] += logs[j[after]] - below[live[after]] + chain[live[after]] - last[live[after]]
            state[live[seen]] = 2
            gone, gi = live[~seen], i[~seen]
            first = state[gone] == 0
            out[gone[first]] = c["escape"][gi[first]]
            chain[gone[first]] = c["chain"][gi[first]]
            state[gone[first]] = 1
            below[gone], last[gone] = c["below"][gi], c["chain"][gi]
        left = state == 1  # never seen in any context
        out[left] += chain[left] - last[left] - below[left]
        return out


def adaptive(text: bytes, order: int = ORDER) -> float:
    """log10 probability of one text under a trie that starts empty and learns byte by byte."""
    counts: dict[bytes, dict[int, int]] = {}
    total, seq = 0.0, [*text, END]
    for t, s in enumerate(seq):
        past = text[max(0, t - order) : t]
        out: set[int] = set()
        for k in range(len(past), -1, -1):
            here = counts.get(past[len(past) - k :], {})
            rest = {x: n for x, n in here.items() if x not in out}
            whole = sum(rest.values())
            if s in rest:
                total += np.log10((rest[s] - DISCOUNT) / whole)
                break
            if rest:
                total += np.log10(DISCOUNT * len(rest) / whole)
            out |= rest.keys()
        else:
            total -= np.log10(SYMBOLS - len(out))
        for k in range(len(past), -1, -1):
            here = counts.setdefault(past[len(past) - k :], {})
            here[s] = here.get(s, 0) + 1
            if here[s] > 1:  # update exclusion
                break
    return total


VOCABULARY = "bucket int, chunk int, keys binary, counts binary"


def chunk_words(batches, text: str):
    """(word hashes, word ranges per text, end ranges) of a chunk's blocks."""
    for batch in batches:
        for lo, hi, buf, offs in tv.blocks(batch, text):
            w = tv.Words(tv.LOWER[buf], offs, tv.WORD_BYTES)
            yield batch, lo, hi, buf, offs, w.hashes(), w.of


def vocabularies(chunks: DataFrame, text: str, n_buckets: int) -> DataFrame:
    """Distinct words of each chunk with their training counts, one row per hash range."""

    @by_batches
    def task(key, batches):
        keys, counts = [END_WORD], [np.zeros(1, np.int64)]
        for batch, lo, hi, _, _, h, of in chunk_words(batches, text):
            train = ~np.asarray(batch.column("held_out").slice(lo, hi - lo).to_numpy(zero_copy_only=False), dtype=bool)
            names, at, inverse = np.unique(h, return_index=True, return_inverse=True)
            keys.append(names)
            counts.append(np.bincount(inverse, weights=np.repeat(train, np.diff(of)), minlength=len(names)).astype(np.int64))
            counts[0] = counts[0] + int(train.sum())
        names, n = summed(np.concatenate(keys), np.concatenate(counts))
        at = cut(names, n_buckets)
        used = np.flatnonzero(np.diff(at))
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array([key[0].as_py()] * len(used), pa.int32()), tv.blob_list([names[at[b] : at[b + 1]] for b in used]), tv.blob_list([n[at[b] : at[b + 1]].astype("<u4") for b in used])], ["bucket", "chunk", "keys", "counts"])

    return chunks.groupBy("chunk").applyInArrow(task, VOCABULARY)


def corpus_counts(words: DataFrame) -> DataFrame:
    """Per bucket: each chunk's words with their counts over the corpus; chunk -1 holds (N, V) of the bucket."""

    def task(key, rows):
        parts = [np.frombuffer(x, tv.U64) for x in rows["keys"].to_pylist()]
        n = [np.frombuffer(x, "<u4") for x in rows["counts"].to_pylist()]
        names, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(n), minlength=len(names)).astype(np.int64)
        at = np.cumsum([0, *map(len, parts)])
        out = [total[inverse[a:b]] for a, b in zip(at, at[1:])]
        size = len(parts) + 1
        return pa.table({"bucket": pa.array([key[0].as_py()] * size, pa.int32()), "chunk": pa.array([*rows["chunk"].to_pylist(), -1], pa.int32()), "totals": tv.blob_list([*out, np.array([total.sum(), (total > 0).sum()])]), "n": pa.array([0] * len(parts) + [int(total.sum())], pa.int64()), "v": pa.array([0] * len(parts) + [int((total > 0).sum())], pa.int64())})

    return words.groupBy("bucket").applyInArrow(task, "bucket int, chunk int, totals binary, n long, v long")


def lm_scoring(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """Per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    total = text_bytes(rows)
    n_buckets = min(1 << 20, 1 << (parts_for(total, BUCKET_BYTES) - 1).bit_length())
    chunks, n_chunks = chunked(rows, "key", "text", total)
    chunks = chunks.repartition(n_chunks, "chunk")
    counted = corpus_counts(vocabularies(chunks, "text", n_buckets))
    nodes = stored(gram_counts(rows.where(~F.col("held_out")), "text", n_buckets, order))
    logs_of = gram_scores(chunks, nodes, "text", n_buckets, order)
    hints = counted.where("chunk >= 0").select("bucket", "chunk", "totals", F.lit(True).alias("word")).unionByName(logs_of.withColumn("word", F.lit(False)))
    kind = docs.schema[key].dataType.simpleString()

    def task(key_, left, right):
        got = sorted(zip(right["bucket"].to_pylist(), right["word"].to_pylist(), right["totals"].to_pylist()))
        totals = np.concatenate([np.frombuffer(x, np.int64) for _, word, x in got if word])
        blocks = list(chunk_words(left.to_batches(), "text"))
        names = np.unique(np.concatenate([END_WORD, *(b[5] for b in blocks)]))
        end = int(totals[np.searchsorted(names, END_WORD[0])])
        logs = np.log10(totals + 0.5)
        known = chunk_grams([(b[3], b[4]) for b in blocks], order)
        chances = Table(known[dealt(known, n_buckets)[0]], np.concatenate([np.frombuffer(x, np.float64) for _, word, x in got if not word]))
        out = []
        for batch, lo, hi, buf, offs, h, of in blocks:
            i = np.searchsorted(names, h)
            sym, event, at = symbols(buf, offs, order)
            score = chances.find(grams(sym, event, order))[0]
            out.append(
                pa.record_batch(
                    [
                        batch.column("key").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo), pa.array(np.diff(of).astype(np.int64) + 1),
                        pa.array((tv.sum_by(of, totals[i] > 0) + (end > 0)).astype(np.int64)), pa.array(tv.sum_by(of, logs[i]) + np.log10(end + 0.5)), pa.array(tv.sum_by(at, score)),
                    ],
                    ["key", "held_out", "n_tokens", "n_known", "logs", "score"],
                )
            )
        return pa.Table.from_batches(out)

    schema = f"key {kind}, held_out boolean, n_tokens long, n_known long, logs double, score double"
    scored = chunks.groupBy("chunk").cogroup(hints.groupBy("chunk")).applyInArrow(task, schema)
    whole = counted.where("chunk < 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"))
    n, v = whole.select("n").scalar(), whole.select("v").scalar()
    base = F.col("logs") - F.col("n_tokens") * F.log10(n + 0.5 * (v + 1))
    return scored.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", n.alias("train_tokens"), base.alias("base_score"), "score")
