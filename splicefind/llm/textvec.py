"""Vectorised text primitives on Arrow buffers (numpy only, no per-row Python).

A *block* is a run of whole rows of one Arrow batch: ``buf`` holds the UTF-8 bytes
of its texts back to back and ``offs`` (n + 1) where each text starts.  Null texts
are empty texts.  Hashes are 64 bit with wrap-around arithmetic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK_BYTES = 4 << 20

_STEP = U64(0x9E3779B97F4A7C15)
_STEP2 = U64(0xD1B54A32D192ED03)
#: The bytes of a lane that belong to a word with so many bytes left.
_INSIDE = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)

#: The word class [^\x20\x09-\x0D]: every byte but the six blanks.
WORD_BYTES = np.ones(256, dtype=bool)
WORD_BYTES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: After A-Z are lowered, [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z, all beyond ASCII.
ALNUM_BYTES = np.zeros(256, dtype=bool)
ALNUM_BYTES[0x30:0x3A] = True
ALNUM_BYTES[0x61:0x7B] = True
ALNUM_BYTES[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix finaliser: a bijection that spreads every input bit over the 64 output bits."""
    y = x >> U64(30)
    y ^= x
    y *= U64(0xBF58476D1CE4E5B9)
    y ^= y >> U64(27)
    y *= U64(0x94D049BB133111EB)
    y ^= y >> U64(31)
    return y


def mix2(x: np.ndarray) -> np.ndarray:
    """The Murmur3 finaliser, another such bijection."""
    y = x >> U64(33)
    y ^= x
    y *= U64(0xFF51AFD7ED558CCD)
    y ^= y >> U64(33)
    y *= U64(0xC4CEB9FE1A85EC53)
    y ^= y >> U64(33)
    return y


def lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``buf`` on as one number; zeros follow the end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    if column.null_count:
        column = pc.fill_null(column, b"" if kind == pa.large_binary() else "")
    column = column.cast(kind)
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offs


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES):
    """Yield (first row, end row, buf, offs) over row runs of about ``limit`` bytes, one row at least."""
    if not batch.num_rows:
        return
    buf, offs = raw(batch.column(batch.schema.get_field_index(column)))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def inside(left: np.ndarray) -> np.ndarray:
    """Masks of the bytes of a lane that belong to a word with ``left`` bytes left."""
    return _INSIDE[np.minimum(left, 8)]


class Words:
    """The words of a block: byte ranges, and ``of`` (n + 1) = where each text's words start."""

    __slots__ = ("buf", "ends", "of", "starts")

    def __init__(self, buf: np.ndarray, offs: np.ndarray, kept: np.ndarray):
        self.buf = buf
        inside = kept[buf]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        edge = offs[:-1][offs[:-1] < len(buf)]
        before[edge] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        after[edge[edge > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.of = np.searchsorted(self.starts, offs)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, second: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes; ``second`` gives an independent one."""
        if not len(self.starts):
            return np.zeros(0, dtype=U64)
        spread, step = (mix2, _STEP2) if second else (mix, _STEP)
        lens, view = self.ends - self.starts, lanes(self.buf)
        out = spread((view[self.starts] & inside(lens)) + step)
        big = np.flatnonzero(lens > 8)
        if len(big):  # further lanes, each mixed with its number before they are added
            more = (lens[big] - 1) // 8
            begin = np.cumsum(more) - more
            i = np.arange(int(more.sum())) - np.repeat(begin, more) + 1
            lane = view[np.repeat(self.starts[big], more) + 8 * i] & inside(np.repeat(lens[big], more) - 8 * i)
            out[big] += np.add.reduceat(spread(lane ^ spread((i + 1).astype(U64) * step)), begin)
        return spread(out ^ (lens.astype(U64) * step))


def window_hashes(words: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """Hash of each n consecutive words, by doubling; length len(words) - n + 1, across texts too."""
    if len(words) < n:
        return np.zeros(0, dtype=U64)
    mult, shift = (_STEP2, U64(29)) if second else (_STEP, U64(32))

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        y = a >> shift
        y ^= a
        y *= mult
        y ^= y >> U64(31)
        y += b
        return y

    out, have = None, 0
    part, size, left = words, 1, n
    while True:
        if left & 1:
            if out is None:
                out, have = part, size
            else:  # out covers ``have`` words; put this part before it
                m = min(len(part), len(out) - size)
                out, have = join(part[:m], out[size : size + m]), have + size
        left >>= 1
        if not left:
            break
        part = join(part[: len(part) - size], part[size:])
        size *= 2
    return (mix2 if second else mix)(out[: len(words) - n + 1])


def starts_within(of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts with word ranges ``of``: starts of all n-word windows, and of each its text."""
    count = np.maximum(np.diff(of) - n + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    return np.arange(int(count.sum())) - np.repeat(first, count) + of[:-1][text], text


def covered(total: int, starts: np.ndarray, length) -> np.ndarray:
    """Boolean mask of the ``total`` positions inside any [start, start + length)."""
    delta = np.zeros(total + 1, dtype=np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + length, total), -1)
    return np.cumsum(delta[:-1]) > 0


def sum_by(of: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the ranges ``of`` (empty ranges give 0)."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[of[1:]] - total[of[:-1]]


def blob_list(items) -> pa.Array:
    """A binary column of the bytes of each numpy array."""
    return pa.array([np.ascontiguousarray(x).tobytes() for x in items], type=pa.binary())
