"""Substring dedup with a log-structured fingerprint index.

A *run* is an immutable, sorted set of window fingerprints of one chunk of documents,
cut by fingerprint range into buckets.  ``FingerprintIndex`` keeps runs as Parquet, tier by tier: each
batch appends its runs, and ``fan_in`` + 1 runs of one tier are compacted into one of the next.
Per bucket all runs are merge-joined; fingerprints that meet are candidates.  Candidates are
verified by a second, unrelated 64-bit hash of the same words (over 80 bits with the
first), again per bucket, and then the words they cover are removed.

A whole corpus goes through the index in ``BATCHES`` batches, and one removal pass follows against the final
index, as a window of the first batch may recur in the last.  Its runs name their chunk, and verification reads
the texts again.  With an index of the caller's, only the new batch is cleaned: its runs meet those of past batches,
which keep the second hashes, as their texts are gone.

Scale: the texts are dealt by a hash of their id and text to chunks of about ``CHUNK_BYTES``;
a fingerprint takes 4 bytes before compression (its bucket holds the bits above; buckets are of like size at any scale,
so the share of false candidates is, too), and 10 with the 48 bits of the second hash; a window that occurs thousands of
times is in each chunk's run at most twice, so no bucket grows with a group of copies.

Defined cases: null and empty texts have no words and stay; texts shorter than a window
lose nothing (a null text stays null only as an empty one); repeated rows are copies of each other, and ids may be null or repeat;
kept words are joined by one space.  Other columns pass through; n_words and n_removed of the
caller's are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import by_batches, delete, free_shuffles, parts_for, shared_dir, stored, text_bytes

WINDOW = 35
CHUNK_BYTES = 8 << 20
BUCKET_ROWS = 2_000_000
BATCHES = 3
SECOND = ~tv.U64(0xFFFF)  # the 48 bits of the second hash that are kept
RUN = "bucket int, chunk int, bits binary"
PAIRS = "bucket int, chunk int, bits binary, second binary"
RUN_COLUMNS = ["bucket", "chunk", "bits"]
PAIR_NAMES = ["bucket", "chunk", "bits", "second"]


def chunked(docs: DataFrame, key: str, text: str, total: int, each: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """``docs`` with column chunk, by a hash of key and text (rows of one key are spread); and how many chunks."""
    n = parts_for(total, each)
    return docs.withColumn("chunk", F.pmod(F.xxhash64(key, text), F.lit(n)).cast("int")), n


def windows_of(buf, offs, window):
    """(words, starts of the windows, their first hashes) of a block."""
    w = tv.Words(buf, offs, tv.WORD_BYTES)
    starts, _ = tv.starts_within(w.of, window)
    hashes = tv.window_hashes(w.hashes(), window)
    return w, starts, hashes[starts] if len(starts) else np.zeros(0, tv.U64)


def at_most_twice(x: np.ndarray) -> np.ndarray:
    """Sorted values, each once, or twice if it occurs more often."""
    x = np.sort(x)
    if len(x) < 3:
        return x
    return x[np.concatenate([[True, True], x[2:] != x[:-2]])]


def cut(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each bucket's range starts in sorted hashes (n_buckets is a power of two)."""
    shift = 64 - (n_buckets.bit_length() - 1)
    edges = (np.arange(n_buckets, dtype=np.uint64) << tv.U64(shift)) if shift < 64 else np.zeros(1, np.uint64)
    return np.append(np.searchsorted(hashes, edges), len(hashes))


def squeeze(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """The 32 bits below the bucket's bits."""
    b = n_buckets.bit_length() - 1
    return (hashes << tv.U64(b)) >> tv.U64(32)


def pack(bits: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as steps, byte plane by byte plane: the upper planes are mostly zero and compress."""
    steps = np.diff(bits.astype(np.int64), prepend=0).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64).astype(tv.U64)


def pack48(x: np.ndarray) -> bytes:
    """The upper 48 bits of each number."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpack48(x: bytes) -> np.ndarray:
    raw = np.frombuffer(x, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 2:] = raw
    return out.ravel().view("<u8").astype(tv.U64)


def runs(chunks: DataFrame, text: str, window: int, n_buckets: int) -> DataFrame:
    """The sorted run of each chunk, one row per bucket."""

    @by_batches
    def task(key, batches):
        chunk = key[0].as_py()
        got = [windows_of(buf, offs, window)[2] for batch in batches for _, _, buf, offs in tv.blocks(batch, text)]
        hashes = at_most_twice(np.concatenate(got)) if got else np.zeros(0, tv.U64)
        at = cut(hashes, n_buckets)
        used = np.flatnonzero(np.diff(at))
        packed = [pack(squeeze(hashes[at[b] : at[b + 1]], n_buckets)) for b in used]
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(np.full(len(used), chunk, np.int32)), pa.array(packed, pa.binary())], ["bucket", "chunk", "bits"])

    return chunks.groupBy("chunk").applyInArrow(task, RUN)


def meet(values: list[np.ndarray]) -> np.ndarray:
    """Values that occur twice or more over all runs, sorted."""
    x = np.sort(np.concatenate(values)) if values else np.zeros(0, tv.U64)
    return np.unique(x[1:][x[1:] == x[:-1]])


def merge_join(run_rows: DataFrame) -> DataFrame:
    """Per bucket, of each run the fingerprints that meet another (or themselves twice)."""

    @by_batches
    def task(key, batches):
        chunk, values = [], []
        for batch in batches:
            for c, bits in zip(batch.column("chunk").to_pylist(), batch.column("bits").to_pylist()):
                chunk.append(c)
                values.append(unpack(bits))
        both = meet(values)
        if not len(both):
            return
        out: dict[int, list] = {}
        for c, v in zip(chunk, values):
            i = np.minimum(np.searchsorted(both, v), len(both) - 1)
            if c >= 0 and (hit := both[i] == v).any():
                out.setdefault(c, []).append(np.unique(v[hit]))
        packed = {c: pack(np.unique(np.concatenate(v))) for c, v in out.items()}
        b = key[0].as_py()
        yield pa.record_batch([pa.array([b] * len(packed), pa.int32()), pa.array(list(packed), pa.int32()), pa.array(list(packed.values()), pa.binary())], ["bucket", "chunk", "bits"])

    return run_rows.groupBy("bucket").applyInArrow(task, RUN)


def candidate_pairs(chunks: DataFrame, candidates: DataFrame, text: str, window: int, n_buckets: int) -> DataFrame:
    """Both hashes of each chunk's candidate windows, per bucket, each pair at most twice."""

    def task(key, left, right):
        wanted = wanted_keys(right, n_buckets)
        firsts, seconds = [], []
        for batch in left.to_batches():
            for _, _, buf, offs in tv.blocks(batch, text):
                w, starts, hashes = windows_of(buf, offs, window)
                hit = among(widened(hashes, n_buckets), wanted)
                if hit.any():
                    firsts.append(hashes[hit])
                    seconds.append(tv.window_hashes(w.hashes(True), window, True)[starts[hit]])
        if not firsts:
            return pair_rows([], [], [], [])
        first, second = np.concatenate(firsts), np.concatenate(seconds)
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        keep = np.ones(len(first), dtype=bool)
        keep[2:] = (first[2:] != first[:-2]) | (second[2:] != second[:-2])
        first, second = first[keep], second[keep]
        at = cut(first, n_buckets)
        used = np.flatnonzero(np.diff(at))
        chunk = key[0].as_py()
        return pair_rows(used, [chunk] * len(used), [squeeze(first[at[b] : at[b + 1]], n_buckets) for b in used], [second[at[b] : at[b + 1]] for b in used])

    return chunks.groupBy("chunk").cogroup(candidates.groupBy("chunk")).applyInArrow(task, PAIRS)


def pair_rows(bucket, chunk, bits: list[np.ndarray], second: list[np.ndarray]) -> pa.Table:
    """Rows of PAIRS: per bucket and chunk the fingerprints and the second hashes."""
    return pa.table([pa.array(bucket, pa.int32()), pa.array(chunk, pa.int32()), pa.array([pack(x) for x in bits], pa.binary()), pa.array([pack48(x) for x in second], pa.binary())], PAIR_NAMES)


def widened(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket and fingerprint in one number: the upper 32 + log2(n_buckets) bits."""
    return hashes >> tv.U64(32 - (n_buckets.bit_length() - 1))


def wanted_keys(rows: pa.Table, n_buckets: int) -> np.ndarray:
    parts = [(tv.U64(b) << tv.U64(32)) | unpack(x) for b, x in zip(rows["bucket"].to_pylist(), rows["bits"].to_pylist())]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, tv.U64)


def among(x: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of x are in sorted ``wanted``."""
    if not len(wanted):
        return np.zeros(len(x), dtype=bool)
    return wanted[np.minimum(np.searchsorted(wanted, x), len(wanted) - 1)] == x


def verify(pairs: DataFrame) -> DataFrame:
    """Of each chunk the pairs that meet another equal pair: windows of equal words."""

    @by_batches
    def task(key, batches):
        chunk, first, second = [], [], []
        for batch in batches:
            for c, bits, x in zip(*(batch.column(n).to_pylist() for n in PAIR_NAMES[1:])):
                first.append(unpack(bits))
                second.append(unpack48(x))
                chunk.append(np.full(len(first[-1]), c, np.int32))
        if not first:
            return
        c, a, b = np.concatenate(chunk), np.concatenate(first), np.concatenate(second)
        order = np.lexsort((b, a))
        c, a, b = c[order], a[order], b[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        hit = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        hit &= c >= 0
        c, a, b = c[hit], a[hit], b[hit]
        order = np.argsort(c, kind="stable")
        c, a, b = c[order], a[order], b[order]
        new = np.ones(len(c), dtype=bool)  # each pair once for each chunk
        new[1:] = (c[1:] != c[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        c, a, b = c[new], a[new], b[new]
        ids, at = np.unique(c, return_index=True)
        at = np.append(at, len(c))
        yield from pair_rows([key[0].as_py()] * len(ids), ids.astype(np.int32), [a[i:j] for i, j in zip(at, at[1:])], [b[i:j] for i, j in zip(at, at[1:])]).to_batches()

    return pairs.groupBy("bucket").applyInArrow(task, PAIRS)


def kept_text(w: tv.Words, gone: np.ndarray, offs: np.ndarray, verbatim: bool) -> pa.Array:
    """Texts of the words that stay, joined by one space; ``verbatim`` leaves texts alone that lose nothing."""
    n = len(offs) - 1
    whole = np.flatnonzero(tv.sum_by(w.of, gone) == 0) if verbatim else np.zeros(0, np.int64)
    word_of = np.repeat(np.arange(n), np.diff(w.of))
    stay = ~gone
    if len(whole):
        is_whole = np.zeros(n, dtype=bool)
        is_whole[whole] = True
        stay &= ~is_whole[word_of]
    # segments: kept words, or a whole text; each is followed by one space
    doc = np.concatenate([word_of[stay], whole])
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    begin = np.concatenate([w.starts[stay], offs[:-1][whole]])[order]
    size = np.concatenate([w.ends[stay], offs[1:][whole]])[order] - begin + 1
    first = np.cumsum(size) - size
    total = int(size.sum())
    at = np.arange(total) - np.repeat(first, size) + np.repeat(begin, size)
    out = np.append(w.buf, np.uint8(32))[np.minimum(at, len(w.buf))] if total else np.zeros(0, np.uint8)
    out[first + size - 1] = 32
    of = np.bincount(doc, weights=size, minlength=n).astype(np.int64)
    ends = np.cumsum(of)
    keep = np.ones(total, dtype=bool)
    keep[ends[of > 0] - 1] = False  # no space after a text's last segment
    out = out[keep]
    at = np.concatenate([[0], np.cumsum(of - (of > 0))])
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def remove(chunks: DataFrame, repeats: DataFrame, text: str, window: int, n_buckets: int, verbatim: bool) -> DataFrame:
    """All columns of ``chunks`` with the kept text, and n_words and n_removed."""
    schema = chunks.drop("chunk").schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", n_words long, n_removed long"
    names = [f.name for f in schema]

    def task(key, left, right):
        pairs = [((tv.U64(b) << tv.U64(32)) | unpack(bits), unpack48(x)) for b, bits, x in zip(*(right[n].to_pylist() for n in ("bucket", "bits", "second")))]
        first = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, tv.U64)
        second = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, tv.U64)
        wanted, both = np.unique(first), np.unique(tv.mix(first) ^ second)
        texts, n_words, n_removed = [], [], []
        for batch in left.to_batches():
            for lo, hi, buf, offs in tv.blocks(batch, text):
                w, starts, hashes = windows_of(buf, offs, window)
                gone = np.zeros(len(w), dtype=bool)
                bits = widened(hashes, n_buckets)
                hit = among(bits, wanted)
                if hit.any():
                    s, h = starts[hit], bits[hit]
                    again = tv.window_hashes(w.hashes(True), window, True)[s] & SECOND
                    gone = tv.covered(len(w), s[among(tv.mix(h) ^ again, both)], window)
                texts.append(kept_text(w, gone, offs, verbatim))
                n_words.append(np.diff(w.of))
                n_removed.append(tv.sum_by(w.of, gone))
        flat = lambda xs: pa.array(np.concatenate(xs).astype(np.int64)) if xs else pa.array([], pa.int64())
        new = pa.chunked_array(texts, pa.string())
        out = {n: (new if n == text else left[n]) for n in names}
        return pa.table({**out, "n_words": flat(n_words), "n_removed": flat(n_removed)})

    return chunks.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(task, ddl)


class FingerprintIndex:
    """Runs under ``path``: one Parquet folder a run, named by its tier; more than ``fan_in`` of a tier become one of the next.

    The folder is the whole state, so an index is reopened by its path.  ``n_buckets`` (a power of two) is
    chosen once, for the size that the corpus is expected to reach, and kept with the runs.
    """

    def __init__(self, spark, path: str | None = None, n_buckets: int = 64, fan_in: int = 4):
        self.spark, self.path, self.fan_in = spark, path or shared_dir(spark), fan_in
        kept = [n for n in self.folders() if n.startswith("buckets-")]
        self.n_buckets = int(kept[0].rpartition("-")[2]) if kept else n_buckets
        if not kept:
            spark.range(1).write.parquet(f"{self.path}/buckets-{n_buckets}")

    def folders(self) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in system.listStatus(where)) if system.exists(where) else []

    @property
    def levels(self) -> list[str]:
        """Names of the finished runs: run-<tier>-<number>."""
        return [n for n in self.folders() if n.startswith("run-") and self._exists(f"{self.path}/{n}/_SUCCESS")]

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def rows(self, names: list[str] | None = None) -> DataFrame | None:
        """The rows of all runs; chunk -1 is history, from which nothing is removed."""
        names = self.levels if names is None else names
        return self.spark.read.schema(PAIRS).parquet(*(f"{self.path}/{n}" for n in names)) if names else None

    def _next(self, tier: int) -> str:
        number = max([int(n.rpartition("-")[2]) for n in self.folders() if n.startswith("run-")], default=-1) + 1
        return f"{self.path}/run-{tier:03d}-{number:06d}"

    def append(self, rows: DataFrame) -> None:
        """Add the rows of a batch (RUN or PAIRS) as one immutable run, then compact full tiers."""
        if "second" not in rows.columns:
            rows = rows.withColumn("second", F.lit(None).cast("binary"))
        rows.select(PAIR_NAMES).write.option("compression", "zstd").parquet(self._next(0))
        tier = 0
        while len(full := [n for n in self.levels if int(n.split("-")[1]) == tier]) > self.fan_in:
            self.compact(full, tier + 1)
            tier += 1

    def compact(self, names: list[str] | None = None, tier: int | None = None) -> None:
        """Merge runs into one: per bucket sorted, each pair of history once, runs of chunks as they are."""
        names = self.levels if names is None else names
        tier = max(int(n.split("-")[1]) for n in names) + 1 if tier is None else tier

        @by_batches
        def task(key, batches):
            first, second = [], []
            for batch in batches:
                past = np.asarray(batch.column("chunk").to_numpy() < 0)
                own = batch.filter(pa.array(~past))
                if own.num_rows:
                    yield own
                old = batch.filter(pa.array(past))
                first += [unpack(x) for x in old.column("bits").to_pylist()]
                second += [unpack48(x) for x in old.column("second").to_pylist()]
            if first:
                a, b = np.concatenate(first), np.concatenate(second)
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                yield from pair_rows([key[0].as_py()], [-1], [a[new]], [b[new]]).to_batches()

        self.rows(names).groupBy("bucket").applyInArrow(task, PAIRS).write.option("compression", "zstd").parquet(self._next(tier))
        for n in names:
            delete(self.spark, f"{self.path}/{n}")


def every_pair(chunks: DataFrame, text: str, window: int, n_buckets: int) -> DataFrame:
    """The full run of a batch with both hashes, for the index."""

    @by_batches
    def task(key, batches):
        got = [(h, tv.window_hashes(w.hashes(True), window, True)[s]) for batch in batches for _, _, buf, offs in tv.blocks(batch, text) for w, s, h in [windows_of(buf, offs, window)] if len(s)]
        first = np.concatenate([x[0] for x in got]) if got else np.zeros(0, tv.U64)
        second = np.concatenate([x[1] for x in got]) if got else np.zeros(0, tv.U64)
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        at = cut(first, n_buckets)
        used = np.flatnonzero(np.diff(at))
        yield from pair_rows(used, [key[0].as_py()] * len(used), [squeeze(first[at[b] : at[b + 1]], n_buckets) for b in used], [second[at[b] : at[b + 1]] for b in used]).to_batches()

    return chunks.groupBy("chunk").applyInArrow(task, PAIRS)


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, index: FingerprintIndex | None = None, verbatim: bool = False) -> DataFrame:
    """``docs`` with repeated windows removed from ``text``, and n_words and n_removed.

    ``verbatim`` leaves a text as it was when nothing is removed from it.  With an ``index``, windows that past batches hold are removed too, and this batch's run
    is appended to it.
    """
    own = "chunk" in docs.columns  # a column of the caller's that bears an inner name
    docs = docs.drop("n_words", "n_removed").withColumnsRenamed({"chunk": "_own_chunk"} if own else {})
    spark, total = docs.sparkSession, text_bytes(docs, text)
    rows, n_chunks = chunked(docs, key, text, total)
    chunks = rows.repartition(n_chunks, "chunk")
    if index is None:
        # a word takes two bytes at least; the usual one about six
        n_buckets = min(1 << max(0, (parts_for(total // 6, BUCKET_ROWS) - 1).bit_length()), 1 << 24)
        whole = FingerprintIndex(spark, n_buckets=n_buckets, fan_in=BATCHES - 1)
        for k in range(BATCHES):
            batch = rows.select(text, "chunk").where(F.col("chunk") % BATCHES == k).repartition(parts_for(n_chunks, BATCHES), "chunk")
            whole.append(runs(batch, text, window, n_buckets))
            del batch
            free_shuffles(spark)
        met = stored(merge_join(whole.rows().select(RUN_COLUMNS)))  # the runs have done their work before the texts move again
        delete(spark, whole.path)
        pairs = candidate_pairs(chunks, met, text, window, n_buckets)
        out = remove(chunks, verify(pairs), text, window, n_buckets, verbatim)
    else:
        n_buckets, past = index.n_buckets, index.rows()
        batch = runs(chunks, text, window, n_buckets)
        pairs = candidate_pairs(chunks, merge_join(batch.unionByName(past.select(RUN_COLUMNS)) if past else batch), text, window, n_buckets)
        out = remove(chunks, verify(pairs.unionByName(past) if past else pairs), text, window, n_buckets, verbatim)
        path = shared_dir(spark)
        out.write.parquet(path)
        index.append(every_pair(chunks, text, window, n_buckets).withColumn("chunk", F.lit(-1)))
        out = spark.read.schema(out.schema).parquet(path)
    return out.withColumnsRenamed({"_own_chunk": "chunk"} if own else {})


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
r AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1), g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM p SEMI JOIN r USING (h)),
gone AS (SELECT doc_id, list(k) AS ks, count(*) AS n FROM g GROUP BY doc_id),
u AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS k FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS t FROM u ANTI JOIN g USING (doc_id, k) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
