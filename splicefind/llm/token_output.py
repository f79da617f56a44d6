"""Token ids in patched frame-of-reference files.

A shard file holds the documents of one id range in ascending order, those without an id first.  Layout, little
endian: magic ``PFR2``, then int64 counts (documents, documents without an id, ids, blocks, bytes of blocks,
exceptions), then the document table (int64 id, int64 number of ids), the start of each
block in the block area (int64), and per block its minimum (uint32), width (uint8) and
number of exceptions (uint8), then the block area and the exception lists (position
uint8, value uint32).  A block is 128 ids less their minimum, packed at the width that
its 90th percentile needs; the ids that need more are exceptions, stored whole.

The rows are dealt to shards by ranges of (id, hash of the text), so neither a list of cuts nor a
manifest passes the driver, and rows of one id may fill several shards.  Writers write to a temporary name in the shared
folder and rename, so a task that runs again replaces its own shard; how many ids each shard holds is a
small table.  Files are read back by Spark's binary reader.

Defined cases: null and empty texts are the end id alone; rows of one id go by a hash of their text, then by
their ids; a null id stays null and comes first; an empty table writes no shard.  Ids must be integers.  Other columns are not carried.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import bpe
from . import textvec as tv
from .common import Scratch, parts_for, shared_dir, text_bytes

BLOCK = 128
PERCENTILE = 90
SHARD_BYTES = 8 << 20
MAGIC = b"PFR2"


def widths(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.uint8)


def encode(ids: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(block area, starts, minima, widths, exception counts, exceptions) of an id stream."""
    blocks = -(-len(ids) // BLOCK)
    grid = np.full(blocks * BLOCK, ids[-1] if len(ids) else 0, dtype=np.uint32)
    grid[: len(ids)] = ids
    grid = grid.reshape(blocks, BLOCK)
    least = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = grid - least[:, None]
    width = widths(np.sort(rest, axis=1)[:, BLOCK * PERCENTILE // 100]) if blocks else np.zeros(0, np.uint8)
    over = rest >> width[:, None].astype(np.uint32) != 0
    count = over.sum(axis=1).astype(np.uint8)
    exceptions = np.zeros(int(over.sum()), dtype=[("at", "u1"), ("value", "<u4")])
    exceptions["at"], exceptions["value"] = np.nonzero(over)[1], rest[over]
    rest = np.where(over, 0, rest)
    starts = np.concatenate([[0], np.cumsum(width.astype(np.int64) * (BLOCK // 8))])
    area = np.zeros(int(starts[-1]), dtype=np.uint8)
    for w in np.unique(width):
        if w:
            at = np.flatnonzero(width == w)
            bits = (rest[at][:, :, None] >> np.arange(w, dtype=np.uint32)).astype(np.uint8) & 1
            area[(starts[at][:, None] + np.arange(int(w) * BLOCK // 8)).ravel()] = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little").ravel()
    return area.tobytes(), starts[:-1], least, width, count, exceptions.tobytes()


def decode(area: np.ndarray, starts: np.ndarray, least: np.ndarray, width: np.ndarray, count: np.ndarray, exceptions: np.ndarray, n: int) -> np.ndarray:
    rest = np.zeros((len(least), BLOCK), dtype=np.uint32)
    for w in np.unique(width):
        if w:
            at = np.flatnonzero(width == w)
            raw = area[starts[at][:, None] + np.arange(int(w) * BLOCK // 8)]
            bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(at), BLOCK, int(w))
            total = np.zeros((len(at), BLOCK), dtype=np.uint32)
            for k in range(int(w)):
                total |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
            rest[at] = total
    rest[np.repeat(np.arange(len(count)), count), exceptions["at"]] = exceptions["value"]
    return (rest + least[:, None]).ravel()[:n]


def shard_bytes(keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray, unnamed: int = 0) -> bytes:
    area, starts, least, width, count, exceptions = encode(ids)
    head = MAGIC + struct.pack("<6q", len(keys), unnamed, len(ids), len(least), len(area), len(exceptions) // 5)
    return b"".join([head, keys.astype("<i8").tobytes(), sizes.astype("<i8").tobytes(), starts.astype("<i8").tobytes(), least.astype("<u4").tobytes(), width.tobytes(), count.tobytes(), area, exceptions])


class Shard:
    """An opened shard file: keys (the first ``unnamed`` mean nothing), sizes, and ``ids(block from, block to)`` or all."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token shard")
        docs, self.unnamed, self.n, blocks, area, exceptions = struct.unpack("<6q", data[4:52])
        at = 52

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.keys, self.sizes, self.starts = take("<i8", docs), take("<i8", docs), take("<i8", blocks)
        self.least, self.width, self.count = take("<u4", blocks), take("u1", blocks), take("u1", blocks)
        self.area, self.exceptions = take("u1", area), take([("at", "u1"), ("value", "<u4")], exceptions)
        self._first = np.concatenate([[0], np.cumsum(self.count, dtype=np.int64)])

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The ids of blocks lo..hi, found through the index of block starts."""
        hi = len(self.least) if hi is None else hi
        n = min(self.n, hi * BLOCK) - lo * BLOCK
        return decode(self.area, self.starts[lo:hi], self.least[lo:hi], self.width[lo:hi], self.count[lo:hi], self.exceptions[self._first[lo] : self._first[hi]], max(n, 0))


def write_tokens(docs: DataFrame, out: str, path: str, end: int, spaced: bool = False, key: str = "doc_id", text: str = "text", each: int = SHARD_BYTES) -> DataFrame:
    """Write the shard files of ``docs`` under ``out``; returns the stored table (shard, n_docs, n_ids)."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"the shard files hold integer ids, {key} is {docs.schema[key].dataType.simpleString()}")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("by"))
    parts = parts_for(text_bytes(rows), each)
    width = max(8, len(str(parts)))

    def task(batches):
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        enc = bpe.encoder(path, spaced)
        null, keys, by, sizes, ids = [], [], [], [], []
        for batch in batches:
            for lo, hi, buf, offs in tv.blocks(batch, "text"):
                got, of = bpe.with_end(*enc.encode(buf, offs), end)
                name = batch.column("key").slice(lo, hi - lo)
                null.append(name.is_null().to_numpy(zero_copy_only=False))
                keys.append(name.fill_null(0).to_numpy())
                by.append(batch.column("by").slice(lo, hi - lo).to_numpy())
                sizes.append(np.diff(of))
                ids.append(got)
        if not keys:
            return
        null, keys, by, sizes, ids = (np.concatenate(x) for x in (null, keys, by, sizes, ids))
        start = np.cumsum(sizes) - sizes
        order = np.lexsort((by, keys, ~null))
        same = np.flatnonzero((np.diff(by[order]) == 0) & (np.diff(keys[order]) == 0))
        if len(same):  # texts of one id and hash go by their ids, so that a rerun gives the same file
            order = np.array(sorted(range(len(keys)), key=lambda i: (not null[i], keys[i], by[i], ids[start[i] : start[i] + sizes[i]].tobytes())))
        keys, sizes, start = keys[order], sizes[order], start[order]
        begin = np.cumsum(sizes) - sizes
        ids = ids[np.arange(int(sizes.sum())) + np.repeat(start - begin, sizes)]
        system, base = fs.FileSystem.from_uri(out)
        system.create_dir(base, recursive=True)
        name = f"{base}/shard-{number:0{width}d}.pfr"
        half = f"{base}/.{uuid.uuid4().hex}"
        with system.open_output_stream(half) as f:
            f.write(shard_bytes(keys, sizes, ids, int(null.sum())))
        system.move(half, name)
        yield pa.record_batch([pa.array([number], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([len(ids)], pa.int64())], ["shard", "n_docs", "n_ids"])

    done = rows.repartitionByRange(max(1, parts), "key", "by").mapInArrow(task, "shard int, n_docs long, n_ids long")
    return Scratch(docs.sparkSession).put("manifest", done, free=True)


def before(rows: DataFrame, order: str, value: str, group: int = 4096) -> DataFrame:
    """(order, first): the sum of ``value`` over all smaller ``order`` (an int), by groups of ``group`` and within each."""
    rows = rows.withColumn("_g", F.floor(F.col(order) / group))
    sums = rows.groupBy("_g").agg(F.sum(value).alias("_s"))
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_g", F.coalesce(F.sum("_s").over(upto(W.orderBy("_g"))), F.lit(0)).alias("_before"))
    inner = F.coalesce(F.sum(value).over(upto(W.partitionBy("_g").orderBy(order))), F.lit(0))
    return rows.withColumn("_inner", inner).join(sums, "_g").select(order, (F.col("_before") + F.col("_inner")).alias("first"))


def read_tokens(spark, out: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: key, start, n_tokens, ids_crc32, ascending by key over all shards."""
    rows = "shard int, key long, local long, n_tokens long, ids_crc32 long"
    if manifest.isEmpty():
        return spark.createDataFrame([], rows).select("key", F.col("local").alias("start"), "n_tokens", "ids_crc32")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.pfr").load(out)
    files = files.select(F.regexp_extract("path", r"shard-(\d+)\.pfr$", 1).cast("int").alias("shard"), "content")

    def task(batches):
        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("content")):
                s = Shard(data.as_buffer().to_pybytes())
                raw = memoryview(s.ids().astype("<u4").tobytes())
                ends = np.cumsum(s.sizes)
                begin = ends - s.sizes
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist())]
                keys = pa.array(s.keys, mask=np.arange(len(s.keys)) < s.unnamed)
                yield pa.record_batch([pa.array([shard] * len(crc), pa.int32()), keys, pa.array(begin.astype(np.int64)), pa.array(s.sizes), pa.array(crc, pa.int64())], ["shard", "key", "local", "n_tokens", "ids_crc32"])

    return files.mapInArrow(task, rows).join(before(manifest, "shard", "n_ids"), "shard").select("key", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, path: str, end: int = 2, out: str | None = None, spaced: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all texts and return what the files hold, per document.

    A folder without a scheme lies in the session's default file system.
    """
    spark = docs.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(out or shared_dir(spark))
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    manifest = write_tokens(docs, out, path, end, spaced, key, text)
    return read_tokens(spark, out, manifest).withColumnRenamed("key", key)
