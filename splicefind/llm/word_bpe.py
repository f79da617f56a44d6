"""Byte-level BPE encoding by a shuffle of distinct words, and decoding by the table of token bytes.

1. Explode: each input task cuts its texts into pre-tokens, chunk by chunk of about CHUNK_BYTES.  A chunk's distinct words are
   dealt to buckets by a hash of the word, and each bucket of a chunk is one stored row: its words, and all positions that each has in
   the chunk (packed).  Another row per document says how many pre-tokens it has.  So " the" is one entry a chunk, however often it occurs.
2. Encode: the words of all chunks meet by bucket, without positions, and each distinct word is encoded once.
3. Join back: the ids of a bucket's words go back to the chunks that hold them.
4. Reassemble: a chunk's positions (stored by chunk, so they are not moved again) and ids meet in one task, which lays the ids out by position and cuts them into documents.

The number of buckets comes from the bytes of all texts, so a bucket's words fit a task (BUCKET_BYTES, about); a word
of every chunk adds one entry a chunk to its bucket.

Decoding looks the ids up in the table of token bytes, which has one row per vocabulary entry and is held by every worker:
its size is a bound by the vocabulary (checked against MOST_TOKENS), not by the data.

Defined cases: a null or empty text has no ids and decodes to no bytes, a list of ids that is null to null; rows
of one key or one text each get their own result; bytes that are no UTF-8 count as U+FFFD; a text is never split between chunks, and one
longer than a chunk is a chunk of its own; an empty table gives no rows; an id without an entry ends the
run with an error.  The key may be of any type; other columns are not read.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, parts_for, shared_dir, text_bytes

CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
BUCKETS = 32  # at least, so that small tables use all cores
PIECE_CHARS = 1 << 20
RUN = 1 << 18  # pre-tokens or ids that are laid out at once
MOST_TOKENS = 1 << 22

_loaded: dict[tuple[str, str], object] = {}
_tables: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a vocabulary file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoding(path: str, pattern: str):
    """The worker's encoder of a vocabulary file."""
    if (path, pattern) not in _loaded:
        import tiktoken

        _loaded[path, pattern] = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})
    return _loaded[path, pattern]


def token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, start, bytes end to end) by token id; a length of -1 where no token has the id."""
    if path not in _tables:
        by_id = {i: b for b, i in ranks(path).items()}
        most = max(by_id, default=-1) + 1
        if most > MOST_TOKENS:
            raise ValueError(f"ids up to {most} are more than a worker holds ({MOST_TOKENS})")
        size = np.array([len(by_id[i]) if i in by_id else -1 for i in range(most)], dtype=np.int64)
        at = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
        _tables[path] = size, at, np.frombuffer(b"".join(by_id.get(i, b"") for i in range(most)), np.uint8)
    return _tables[path]


def pieces(text: str, pattern) -> Iterator[list[str]]:
    """The pre-tokens of a text, a list for each stretch of it.

    A stretch ends before a space between two ASCII letters or digits, where every pre-token ends.
    """
    start = 0
    while len(text) - start > PIECE_CHARS:
        cut = start + PIECE_CHARS
        while (cut := text.find(" ", cut)) >= 0:
            if text[cut - 1].isascii() and text[cut - 1].isalnum() and text[cut + 1 : cut + 2].isascii() and text[cut + 1 : cut + 2].isalnum():
                break
            cut += 1
        if cut < 0:
            break
        yield pattern.findall(text[start:cut])
        start = cut
    yield pattern.findall(text[start:] if start else text)


def pack(values: np.ndarray) -> bytes:
    """Seven bits a byte, the high bit where more follow; all first bytes come first, then all second ones, and so on."""
    out, rest = [], values.astype(np.uint64)
    while len(rest):
        more = rest > 127
        out.append((rest & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7))
        rest = rest[more] >> np.uint64(7)
    return b"".join(x.tobytes() for x in out)


def unpack(data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of packed ``data``."""
    data, out = np.frombuffer(data, np.uint8), np.zeros(n, dtype=np.int64)
    at, start, shift = np.arange(n), 0, 0
    while len(at):
        byte = data[start : start + len(at)]
        out[at] |= (byte & 127).astype(np.int64) << shift
        start, shift = start + len(at), shift + 7
        at = at[byte > 127]
    return out


def _blob(n: int, *parts: bytes) -> bytes:
    """A number and byte strings as one compressed one."""
    import zstandard

    return zstandard.compress(struct.pack(f"<{len(parts) + 2}q", n, len(parts), *map(len, parts)) + b"".join(parts))


def _parts(blob: bytes) -> tuple[int, list[bytes]]:
    import zstandard

    raw = zstandard.decompress(blob)
    n, many = struct.unpack_from("<2q", raw)
    ends = np.cumsum(struct.unpack_from(f"<{many}q", raw, 16)) + 16 + 8 * many
    return n, [raw[a:b] for a, b in zip([16 + 8 * many, *ends], ends)]


def _word_list(blob: bytes) -> list[bytes]:
    n, (sizes, raw) = _parts(blob)
    ends = np.cumsum(unpack(sizes, n))
    return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def bucketed(words: list[bytes], stream: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, words, positions) of a chunk whose pre-tokens are ``words[stream]``.

    In a bucket the more frequent words come first, those of one number in order of appearance: then
    differences of neighbours are small.  A word's first position is told from the one of the word before it.
    """
    times = np.bincount(stream, minlength=len(words))
    bucket = np.fromiter((zlib.crc32(w) % n_buckets for w in words), np.int64, len(words))
    order = np.lexsort((-times, bucket))
    number = np.empty(len(words), dtype=np.int32)
    number[order] = np.arange(len(words), dtype=np.int32)
    place = np.argsort(number[stream], kind="stable").astype(np.int32)
    times, bucket = times[order], bucket[order]
    ends = np.cumsum(times)
    for a in np.flatnonzero(np.diff(bucket, prepend=-1)):
        b = int(np.searchsorted(bucket, bucket[a], side="right"))
        lo, hi = int(ends[a] - times[a]), int(ends[b - 1])
        step = np.diff(place[lo:hi].astype(np.int64), prepend=0)
        at = ends[a:b] - times[a:b] - lo
        jump = np.diff(place[at + lo].astype(np.int64), prepend=0)
        step[at] = np.where(jump < 0, -2 * jump - 1, 2 * jump)
        own = [words[i] for i in order[a:b]]
        yield int(bucket[a]), _blob(b - a, pack(np.array([len(w) for w in own])), b"".join(own)), _blob(b - a, pack(times[a:b]), pack(step))


def positions(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(times of each word, positions word after word)."""
    n, (times, step) = _parts(blob)
    times = unpack(times, n)
    step = unpack(step, int(times.sum()))
    at = np.cumsum(times) - times
    first = np.cumsum(np.where(step[at] % 2, -(step[at] + 1) // 2, step[at] // 2))
    step[at] = 0
    inner = np.cumsum(step)
    return times, inner - np.repeat(inner[at] - first, times)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte strings that lie end to end in ``data``."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _row_runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` in sum, or of one row."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each stretch, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def exploded(docs: DataFrame, pattern: str, key: str, text: str, n_buckets: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of documents (chunk, place, key, pieces) and rows of words (chunk, bucket, words, positions)."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["chunk", "place", "key", "pieces", "bucket", "words", "positions"]

    def sent(chunk, keys, sizes, words, stream):
        many = len(sizes)
        yield pa.record_batch([pa.array([chunk] * many, pa.int64()), pa.array(range(many), pa.int32()), pa.concat_arrays(keys), pa.array(sizes, pa.int64()), pa.nulls(many, pa.int32()), pa.nulls(many, pa.binary()), pa.nulls(many, pa.binary())], names)
        if words:
            for bucket, own, places in bucketed([w.encode() for w in words], np.concatenate(stream), n_buckets):
                yield pa.record_batch([pa.array([chunk], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, keys[0].type), pa.nulls(1, pa.int64()), pa.array([bucket], pa.int32()), pa.array([own], pa.binary()), pa.array([places], pa.binary())], names)

    def task(batches):
        import regex
        from pyspark import TaskContext

        cut = regex.compile(pattern)
        chunk = TaskContext.get().partitionId() << 32
        keys, sizes, words, stream, held = [], [], defaultdict(count().__next__), [], 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for i in range(batch.num_rows):
                raw = texts[i].as_py() or b""
                if held and held + len(raw) > chunk_bytes:
                    yield from sent(chunk, keys, sizes, words, stream)
                    keys, sizes, words, stream, held = [], [], defaultdict(count().__next__), [], 0
                    chunk += 1
                many = 0
                for found in pieces(raw.decode("utf-8", "replace"), cut):
                    stream.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                    many += len(found)
                keys.append(batch.column("key").slice(i, 1))
                sizes.append(many)
                held += len(raw)
        if sizes:
            yield from sent(chunk, keys, sizes, words, stream)

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(task, f"chunk long, place int, key {kind}, pieces long, bucket int, words binary, positions binary")


def stored_by(df: DataFrame, column: str, files: int) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder that is dealt by ``column``, so that grouping by it moves no row.

    A task writes a file for each bucket it has rows of; ``column`` has few values a task.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(min(files, 100_000), column).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: the table lies at a path of its own
    return out


def encoded_words(words: DataFrame, path: str, pattern: str) -> DataFrame:
    """(chunk, bucket, ids) of ``words`` (chunk, bucket, words): each distinct word of a bucket is encoded once."""

    @by_batches
    def task(key, batches):
        one, known = encoding(path, pattern)._encode_single_piece, {}
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk"), batch.column("words")):
                ids = []
                for w in _word_list(blob.as_py()):
                    if w not in known:
                        known[w] = one(w)
                    ids.append(known[w])
                flat = np.fromiter((i for x in ids for i in x), np.int64)
                sent = _blob(len(ids), pack(np.array([len(x) for x in ids])), pack(flat))
                yield pa.record_batch([pa.array([chunk.as_py()], pa.int64()), pa.array([key[0].as_py()], pa.int32()), pa.array([sent], pa.binary())], ["chunk", "bucket", "ids"])

    return words.groupBy("bucket").applyInArrow(task, "chunk long, bucket int, ids binary")


def reassembled(rows: DataFrame, ids: DataFrame, packed: bool = False) -> DataFrame:
    """(key, ids) of each document, ids as an array or ``packed``: ``rows`` as `exploded` gives them, ``ids`` (chunk, bucket, ids)."""
    kind = rows.schema["key"].dataType.simpleString()

    def task(name, rows, ids):
        """Lay out the ids of one chunk by position and cut them into its documents."""
        docs = rows.filter(pc.is_valid(rows["place"])).sort_by("place")
        places = dict(zip(rows["bucket"].to_pylist(), rows["positions"]))
        stream = np.zeros(pc.sum(docs["pieces"]).as_py() or 0, dtype=np.int32)
        size, flat, upto = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for bucket, blob in zip(ids["bucket"].to_pylist(), ids["ids"]):
            n, (sizes, own) = _parts(blob.as_py())
            size.append(unpack(sizes, n))
            flat.append(unpack(own, int(size[-1].sum())))
            times, at = positions(places[bucket].as_py())
            stream[at] = upto + np.repeat(np.arange(n), times)
            upto += n
        size, flat = np.concatenate(size), np.concatenate(flat).astype(np.int32)
        start, many = np.cumsum(size) - size, np.asarray(docs["pieces"], dtype=np.int64)
        lists, at = [], 0
        for a, b in _row_runs(many, RUN):
            own = stream[at : at + int(many[a:b].sum())]
            at += len(own)
            out, cuts = flat[_spread(start[own], size[own])], np.concatenate([[0], np.cumsum(size[own])])[np.concatenate([[0], np.cumsum(many[a:b])])]
            lists.append(_binary(out.astype("<u4").view(np.uint8), 4 * cuts[1:]) if packed else pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(out, pa.int32())))
        return pa.table([docs["key"], pa.chunked_array(lists, pa.binary() if packed else pa.list_(pa.int32()))], ["key", "ids"])

    return rows.drop("words").groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(task, f"key {kind}, ids {'binary' if packed else 'array<int>'}")


def bpe_encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, packed: bool = False) -> DataFrame:
    """(``key``, ids) of every whole text; ``packed`` ids are one binary of little-endian unsigned 32-bit integers."""
    total = text_bytes(docs, text)
    n_buckets = parts_for(total // 6, BUCKET_BYTES, BUCKETS)  # a chunk's words are about a sixth of its text at most
    rows = stored_by(exploded(docs, pattern, key, text, n_buckets, chunk_bytes), "chunk", parts_for(total, max(chunk_bytes, 1 << 20)))
    words = rows.where(F.col("bucket").isNotNull()).select(*(F.col(n).alias(n) for n in ("chunk", "bucket", "words")))  # names of their own
    return reassembled(rows, encoded_words(words, path, pattern), packed).withColumnRenamed("key", key)


def bpe_decode(tokens: DataFrame, path: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``tokens`` with the bytes that the ids (an array, or packed) stand for."""
    at = [c for c in tokens.columns if c != out]
    packed = tokens.schema[ids].dataType.simpleString() == "binary"

    def task(batches):
        size, start, data = token_table(path)
        for batch in batches:
            lists = batch.column(ids)
            if packed:
                flat = np.frombuffer(b"".join(x for x in lists.to_pylist() if x), "<u4").astype(np.int64)
            else:
                flat = np.asarray(lists.flatten().fill_null(-1), dtype=np.int32)
            if len(flat) and (flat.min() < 0 or flat.max() >= len(size) or size[flat].min() < 0):
                raise ValueError("an id has no entry in the vocabulary")
            many, done = np.asarray((pc.binary_length(lists) if packed else lists.value_lengths()).fill_null(0), dtype=np.int64) // (4 if packed else 1), 0
            for a, b in _row_runs(many, RUN):
                own = flat[done : done + int(many[a:b].sum())]
                done += len(own)
                ends = np.concatenate([[0], np.cumsum(size[own])])[np.cumsum(many[a:b])]
                whole = _binary(data[_spread(start[own], size[own])], ends)
                if lists.null_count:
                    whole = pc.if_else(lists.slice(a, b - a).is_valid(), whole, pa.scalar(None, pa.binary()))
                yield pa.record_batch([*(batch.column(n).slice(a, b - a) for n in at), whole], [*at, out])

    kinds = ", ".join(f"`{n}` {tokens.schema[n].dataType.simpleString()}" for n in at)
    return tokens.select(*at).mapInArrow(task, f"{kinds}, `{out}` binary")
