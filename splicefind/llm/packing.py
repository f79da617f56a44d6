"""Best-fit packing by minimum bin slack.

The texts are tokenised once and become pieces of at most ``capacity`` tokens.  What the
packer needs of them is their length histogram, at most ``capacity`` numbers, so packing
costs the driver the same for a thousand or a trillion pieces: for each bin a bitset
subset-sum DP over the available lengths finds the fullest feasible combination that
holds the longest piece left; that combination repeats while its lengths last.  The plan is
a list of slots (length, range of ranks -> sequences, offset); a piece takes the slot of
its rank among the pieces of its length, which two small aggregations give.

Defined cases: null and empty texts are one piece of the end id alone; repeated rows
are packed each; null keys stay null; no rows give no sequences.  Keys must be integers (others fail in the cast).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from . import textvec as tv
from .common import parts_for, stored

CAPACITY = 2048
GROUP_ROWS = 200_000
PIECES = "key long, piece int, start long, length long, ids_crc32 long"


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a text of n tokens; only the first may be short."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenised(docs: DataFrame, path: str, end: int, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every text with the crc32 of their ids."""

    def task(batches):
        enc = bpe.encoder(path, True)
        for batch in batches:
            keys = batch.column(0)
            for lo, hi, buf, offs in tv.blocks(batch, "text"):
                ids, of = bpe.with_end(*enc.encode(buf, offs), end)
                raw = memoryview(ids.astype("<u4").tobytes())
                rows = [(i, p, s, n, zlib.crc32(raw[4 * (of[i] + s) : 4 * (of[i] + s + n)])) for i in range(hi - lo) for p, (s, n) in enumerate(pieces_of(int(of[i + 1] - of[i]), capacity))]
                cols = list(zip(*rows))
                yield pa.record_batch([keys.slice(lo, hi - lo).take(pa.array(cols[0])), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["key", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(task, PIECES)


def fullest(counts: dict[int, int], longest: int, capacity: int) -> dict[int, int]:
    """The fullest combination that holds one piece of the longest length: {length: copies}."""
    room = capacity - longest
    reach, trail = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        most = min(counts[length] - (length == longest), room // length)
        if most <= 0:
            continue
        trail.append((length, most, reach))
        k = 1
        while most > 0:  # powers of two bound the copies
            k = min(k, most)
            reach |= (reach << (length * k)) & mask
            most -= k
            k *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used = {longest: 1}
    for length, most, before in reversed(trail):
        k = 0
        while not before >> total & 1:
            total -= length
            k += 1
        if k:
            used[length] = used.get(length, 0) + k
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Slots as rows (length, first rank, end rank, copies a bin, first sequence, offset), and the number of bins."""
    left = {k: v for k, v in histogram.items() if v}
    taken = dict.fromkeys(left, 0)
    slots, bins = [], 0
    while left:
        used = fullest(left, max(left), capacity)
        times = min(left[k] // c for k, c in used.items())
        offset = 0
        for length in sorted(used, reverse=True):
            c = used[length]
            slots.append((length, taken[length], taken[length] + c * times, c, bins, offset))
            taken[length] += c * times
            offset += c * length
            left[length] -= c * times
            if not left[length]:
                del left[length]
        bins += times
    return np.array(sorted(slots), dtype=np.int64).reshape(-1, 6), bins


def assign(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pieces`` (stored) with sequence_id and offset."""
    groups = parts_for(pieces.count(), group_rows)
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("key", "piece", "length", "ids_crc32"), F.lit(groups)).cast("int"))
    per = dealt.groupBy("group", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = plan(histogram, capacity)
    sent = pieces.sparkSession.sparkContext.broadcast(slots)
    from pyspark.sql import Window as W

    before = W.partitionBy("length").orderBy("group").rowsBetween(W.unboundedPreceding, -1)
    firsts = per.select("group", F.col("length").alias("of_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def task(key, left, right):
        key_, piece, length = (left[c].fill_null(0).to_numpy() for c in ("key", "piece", "length"))
        order = np.lexsort((left["ids_crc32"].to_numpy(), piece, key_, length))
        ranked = length[order]
        begin = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
        local = np.empty(len(order), np.int64)
        local[order] = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
        names, first = right["of_length"].to_numpy(), right["first"].to_numpy()
        by = np.argsort(names)
        rank = local + first[by][np.searchsorted(names[by], length)]
        s = sent.value
        span = np.int64(1) << np.int64(48)
        i = np.searchsorted(s[:, 0] * span + s[:, 1], length * span + rank, side="right") - 1
        place = rank - s[i, 1]
        return left.drop_columns(["group"]).append_column("sequence_id", pa.array(s[i, 4] + place // s[i, 3])).append_column("offset", pa.array(s[i, 5] + place % s[i, 3] * length))

    return dealt.groupBy("group").cogroup(firsts.groupBy("group")).applyInArrow(task, PIECES + ", sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, path: str, end: int = 0, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(tokenised(docs, path, end, key, text, capacity))
    return assign(pieces, capacity).withColumnRenamed("key", key)
