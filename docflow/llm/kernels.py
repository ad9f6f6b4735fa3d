"""Vectorised text kernels over Arrow buffers.

A batch of texts is one byte buffer with offsets. Word boundaries, word hashes and
rolling (Rabin-Karp) window hashes are computed for many documents at once with numpy,
in pieces of about PIECE bytes so that memory stays bounded whatever the batch holds.

Hash of a word: its eight-byte chunks, each mixed with its place, are summed and mixed with
the length, modulo 2**64. (A polynomial of the bytes modulo 2**64, which features of a model
may use, is the same for a Thue-Morse word of 1024 letters or more and its complement.)
Results depend on the bytes alone, so every executor and every run gives the same hashes.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

PIECE = 1 << 20

# In Python workers, which stay alive between tasks, arrays of 512 KB or more go back to the
# system when they are freed (-3: glibc's M_MMAP_THRESHOLD). The driver's process is left as it is.
_libc = None
if TaskContext.get() is not None:
    with contextlib.suppress(OSError, AttributeError):
        _libc = ctypes.CDLL("libc.so.6")
        _libc.mallopt(-3, 512 << 10)


def trim() -> None:
    """Give back what a worker's freed buffers still hold."""
    pa.default_memory_pool().release_unused()
    if _libc is not None and hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


_BASE = 0x9E3779B97F4A7C15 | 5  # odd, 5 modulo 8: the longest period modulo a power of two
_MASK = (1 << 64) - 1

#: Bytes that separate words unless a caller gives others: space and U+0009..U+000D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_powers: dict[str, np.ndarray] = {}


def _power(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done, step = 1, base
    while done < n:  # doubling: out[done:2*done] = out[:done] * base**done
        m = min(done, n - done)
        out[done : done + m] = out[:m] * np.uint64(step)
        done += m
        step = step * step & _MASK
    return out


def _both_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = _powers.get("up")
    if held is None or len(held) < n:
        size = max(n, PIECE + 4096)
        up, down = _power(size, _BASE), _power(size, pow(_BASE, -1, 1 << 64))
        if size <= 8 * PIECE:
            _powers["up"], _powers["down"] = up, down
        return up, down
    return held, _powers["down"]


def binary_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()).cast(pa.large_binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _words_of(raw: np.ndarray, cuts: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in raw; a word also ends at each of cuts."""
    solid = ~space[raw]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(len(raw) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = ~solid[:-1]
    edge[cuts] = True
    starts = np.flatnonzero(solid & edge[:-1])
    edge[:-1] = ~solid
    edge[-1] = True
    edge[cuts] = True
    ends = np.flatnonzero(solid & edge[1:]) + 1
    return starts, ends


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    up, down = _both_powers(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(table[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_CHUNK_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each word raw[start:end], none of them empty."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place
    n = ends - starts
    out = mix((eight[starts] & _CHUNK_MASKS[np.minimum(n, 8)]) ^ n.astype(np.uint64) * np.uint64(_BASE))
    long = np.flatnonzero(n > 8)
    if len(long):
        more = (n[long] - 1) >> 3  # chunks after the first
        begin = np.cumsum(more) - more
        place = np.arange(int(more.sum())) - np.repeat(begin, more) + 1
        left = np.repeat(n[long], more) - 8 * place
        chunk = eight[np.repeat(starts[long], more) + 8 * place] & _CHUNK_MASKS[np.minimum(left, 8)]
        chunk = mix(mix(chunk) ^ place.astype(np.uint64) * np.uint64(_BASE))
        out[long] = mix(out[long] + np.add.reduceat(chunk, begin))
    return out


def pieces(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Byte ranges of about size that cut no word; a word longer than that makes a longer range."""
    at, end = 0, int(offsets[-1])
    while at < end:
        stop = min(end, at + size)
        if stop < end:
            k = int(np.searchsorted(offsets, stop, "right")) - 1
            if offsets[k] > at:  # at the start of a document
                stop = int(offsets[k])
            else:  # inside a document larger than a piece: at white space
                limit = int(offsets[k + 1])
                while stop < limit:
                    found = np.flatnonzero(space[raw[stop : stop + size]])
                    if len(found):
                        stop = min(limit, stop + int(found[0]))
                        break
                    stop = min(limit, stop + size)
        yield at, stop
        at = stop


def words(column, lower: bool = False, space: np.ndarray = SPACE, spans: bool = False):
    """(hash of each word, first word index of each document with an end mark, starts, ends).

    starts and ends are byte positions in the batch's buffer, or None without spans.
    """
    raw, offsets = binary_buffers(column)
    hashes, at0, at1 = [], [], []
    for lo, hi in pieces(raw, offsets, space):
        part = raw[lo:hi]
        inner = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi, "left")] - lo
        starts, ends = _words_of(part, inner, space)
        hashes.append(word_hashes(LOWER[part] if lower else part, starts, ends))
        at0.append(starts + lo)
        if spans:
            at1.append(ends + lo)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    starts = np.concatenate(at0) if at0 else np.zeros(0, np.int64)
    first = np.searchsorted(starts, offsets, "left")
    if not spans:
        return h, first, None, None
    return h, first, starts, np.concatenate(at1) if at1 else np.zeros(0, np.int64)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hashes of all k consecutive words: entry i covers words i to i + k - 1, documents not regarded."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    if k <= 8:
        out = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            out = out * np.uint64(_BASE) + h[j : len(h) - k + 1 + j]
        return mix(out)
    out = np.empty(len(h) - k + 1, np.uint64)
    for lo in range(0, len(out), PIECE):  # the rolling sum, in pieces that keep the power table small
        part = h[lo : lo + PIECE + k - 1]
        up, down = _both_powers(len(part) + 1)
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part * up[: len(part)], out=sums[1:])
        out[lo : lo + PIECE] = (sums[k:] - sums[:-k]) * down[: len(part) - k + 1]
    return mix(out)


def inside(first: np.ndarray, total: int, k: int) -> np.ndarray:
    """Which of the total - k + 1 windows lie within one document."""
    ok = np.ones(max(0, total - k + 1), bool)
    if len(ok):
        ends = first[1:]
        for j in range(1, k):  # windows that start j words before a document's end
            at = ends - j
            at = at[(at >= 0) & (at < len(ok))]
            ok[at] = False
    return ok


def owner(first: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ids_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
