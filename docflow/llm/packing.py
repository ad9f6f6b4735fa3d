"""Bounded-space online packing of token sequences into windows of a fixed size.

Each partition keeps at most `open_windows` windows open. A text goes where it fits best
(the open window with the least room that holds it). Where none fits and no more may be
opened, the fullest is filled up with the head of the text and emitted, and the rest is
placed. Texts longer than a window give whole windows first. At its end a partition fills
its fullest windows from its emptiest, so that less than one window is left; those
leftovers of `merge` partitions at a time are laid end to end. What remains of a merge is
cut into sequences at powers of two, which take no padding.

Memory in a task is the open windows and one batch of texts, whatever the input.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import cut, small_batches

SIZE, OPEN, MERGE, END_ID = 4096, 48, 128, 2
CACHE, PIECE = 1_200_000, 2 << 20  # words that a worker remembers; bytes of text looked up together

#: Words of one pre-token: letters with one lower-case form, and composed already.
_PLAIN = re.compile(r"[a-zÀ-ÖØ-öø-ÿ]+").fullmatch


class WordEncoder:
    """Ids of whole texts by the tokenizers library, for a lower-casing tokenizer that drops white space.

    Such a tokenizer treats words between white space apart, and a stop or comma after a
    letter or digit too. So a text's ids are those of its words in turn. Words are found and
    hashed in numpy; the library encodes each distinct word once while the worker knows it,
    and ids are gathered by word. What the worker knows is four flat arrays.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = [str(x) for x in (self.tokenizer.pre_tokenizer, self.tokenizer.normalizer)]
        if "Removed" not in spec[0] or "Lowercase" not in spec[1]:
            raise ValueError("only lower-casing tokenizers that drop white space are supported")
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a pre-token
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.stops = np.zeros(256, np.uint32)
        for mark in ".,":
            (self.stops[ord(mark)],) = self.tokenizer.encode(mark, add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.keys, self.start = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.count, self.flat, self.misses = np.zeros(0, np.int64), np.zeros(0, np.uint32), 0

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, how many each word has)."""
        plain = [i for i, w in enumerate(words) if _PLAIN(w)]
        other = [i for i, w in enumerate(words) if not _PLAIN(w)]
        ids: list = [None] * len(words)
        lines = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        for lo in range(0, len(lines), 16):
            some = lines[lo : lo + 16]
            for line, e in zip(some, self.tokenizer.encode_batch_fast([" ".join([words[i] for i in x]) for x in some], add_special_tokens=False), strict=True):
                found = np.array(e.ids, np.uint32)
                edge = np.flatnonzero(self.last[found]) + 1
                if len(edge) != len(line):
                    raise ValueError("a plain word made more than one pre-token")
                for i, part in zip(line, np.split(found, edge[:-1]), strict=True):
                    ids[i] = part
        for lo in range(0, len(other), 1000):
            some = other[lo : lo + 1000]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([words[i] for i in some], add_special_tokens=False), strict=True):
                ids[i] = np.array(e.ids, np.uint32)
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64)

    def _look_up(self, keys: np.ndarray, where: np.ndarray, ends: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, count, flat ids) of distinct words; those not known are encoded, and remembered while there is room."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        start, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        start[known], count[known] = self.start[at[known]], self.count[at[known]]
        new = np.flatnonzero(~known)
        if not len(new):
            return start, count, self.flat
        words = [data[a:b].decode() for a, b in zip(where[new].tolist(), ends[new].tolist(), strict=True)]
        ids, n = self._encode(words)
        flat = np.concatenate([self.flat, ids])
        count[new] = n
        start[new] = np.cumsum(n) - n + len(self.flat)
        self.misses += len(new)
        if self.misses > 4 * CACHE:  # the words that come now are others than those known
            self._forget()
        elif len(self.keys) < CACHE and len(ids) < CACHE:
            put = np.searchsorted(self.keys, keys[new])
            self.start, self.count = np.insert(self.start, put, start[new]), np.insert(self.count, put, n)
            self.keys, self.flat = np.insert(self.keys, put, keys[new]), flat
        return start, count, flat

    def encode(self, column: pa.Array) -> tuple[bytes, np.ndarray]:
        """(ids of all texts in turn as little-endian unsigned 32-bit integers, index of each text's first id and an end mark)."""
        raw, offsets = K.binary_buffers(column)
        out, made = [], [np.zeros(0, np.int64)]
        firsts = [np.zeros(0, np.int64)]
        for lo, hi in K.pieces(raw, offsets, K.SPACE, PIECE):
            part = raw[lo:hi]
            inner = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi, "left")] - lo
            starts, ends = K._words_of(part, inner, K.SPACE)
            if not len(starts):
                continue
            lower = K.LOWER[part]
            for i in np.unique(np.searchsorted(starts, np.flatnonzero((part[:-1] == 60) & (part[1:] == 124)), "right") - 1).tolist():
                lower[starts[i] : ends[i]] = part[starts[i] : ends[i]]  # special strings are found before letters are lowered
            tail, before, lead = lower[ends - 1], lower[np.maximum(ends - 2, 0)], lower[np.maximum(ends - 3, 0)]
            size = ends - starts
            letter = _ALNUM[before] | ((lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (size > 2))
            stop = ((tail == 46) | (tail == 44)) & (size > 1) & letter
            ends = ends - stop
            h = K.word_hashes(lower, starts, ends)
            keys, where, inverse = np.unique(h, return_index=True, return_inverse=True)
            first, count, flat = self._look_up(keys, starts[where], ends[where], lower.tobytes())
            n = count[inverse] + stop
            end = np.cumsum(n)
            at = np.arange(end[-1]) + np.repeat(first[inverse] - (end - n), n)
            ids = flat[np.minimum(at, len(flat) - 1)]
            ids[end[stop] - 1] = self.stops[tail[stop]]
            out.append(ids)
            made.append(n)
            firsts.append(starts + lo)
        n, starts = np.concatenate(made), np.concatenate(firsts)
        total = np.concatenate([[0], np.cumsum(n)])
        return b"".join(x.astype("<u4").tobytes() for x in out), total[np.searchsorted(starts, offsets, "left")]


_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = True
_held: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder, made once."""
    if path not in _held:
        _held[path] = WordEncoder(path)
    return _held[path]


Piece = tuple  # (row of the text, start, length)


class Packer:
    """Open windows of one partition; emit(pieces) is called with each finished window."""

    def __init__(self, size: int, limit: int, emit):
        self.size, self.limit, self.emit = size, limit, emit
        self.used: list[int] = []
        self.held: list[list[Piece]] = []

    def _take(self, row, start: int, length: int) -> None:
        """Best fit, a new window, or the head into the fullest and the rest again."""
        while length:
            best, room = -1, self.size + 1
            for i, u in enumerate(self.used):
                if length <= self.size - u < room:
                    best, room = i, self.size - u
            if best < 0 and len(self.used) < self.limit:
                self.used.append(0)
                self.held.append([])
                best, room = len(self.used) - 1, self.size
            if best < 0:
                best = max(range(len(self.used)), key=self.used.__getitem__)
                room = self.size - self.used[best]
            n = min(length, room)
            self.held[best].append((row, start, n))
            self.used[best] += n
            if self.used[best] == self.size:
                self.emit(self.held.pop(best))
                self.used.pop(best)
            start, length = start + n, length - n

    def add(self, row, length: int) -> None:
        start = 0
        while length - start >= self.size:
            self.emit([(row, start, self.size)])
            start += self.size
        self._take(row, start, length - start)

    def finish(self) -> list[Piece]:
        """Fill the fullest windows from the emptiest; the pieces of the one that is left."""
        order = sorted(range(len(self.used)), key=lambda i: -self.used[i])
        windows = [self.held[i] for i in order]
        room = [self.size - self.used[i] for i in order]
        self.used, self.held = [], []
        while len(windows) > 1:
            source = windows[-1]
            while source and room[0]:
                row, start, n = source.pop()
                if n > room[0]:
                    keep = n - room[0]
                    source.append((row, start, keep))
                    row, start, n = row, start + keep, room[0]
                windows[0].append((row, start, n))
                room[0] -= n
            if not room[0]:
                self.emit(windows.pop(0))
                room.pop(0)
            if not source and len(windows) > 1 or not windows[-1]:
                windows.pop()
                room.pop()
        return windows[0] if windows else []


def lay(lengths: list[int], sizes: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """Lay pieces of these lengths end to end over sequences of these sizes.

    Yields (piece, start in the piece, length, sequence, offset in the sequence).
    """
    seq, at = 0, 0
    for i, n in enumerate(lengths):
        start = 0
        while start < n:
            take = min(n - start, sizes[seq] - at)
            yield i, start, take, seq, at
            start, at = start + take, at + take
            if at == sizes[seq]:
                seq, at = seq + 1, 0


def tail_sizes(total: int, size: int) -> list[int]:
    """Whole sequences, then what is left in powers of two."""
    left = total % size
    return [size] * (total // size) + [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


_NAMES = ("id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def _pack(path: str, size: int, limit: int, end_id: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        out: list[list] = [[] for _ in range(9)]
        count = 0
        tail = struct.pack("<I", end_id)

        def add(pieces: list[Piece], number, at: int = 0) -> None:
            for (ident, ids), start, n in pieces:
                for x, v in zip(out, (ident, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, number, at, part, number is not None), strict=True):
                    x.append(v)
                at += n

        def emit(pieces: list[Piece]) -> None:
            nonlocal count
            add(pieces, (part << 32) + count)
            count += 1

        def rows() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)
            for x in out:
                x.clear()
            return done

        packer = Packer(size, limit, emit)
        for batch in batches:
            for lo in range(0, batch.num_rows, 800):
                part_of = batch.slice(lo, 800)
                ids, first = encoder(path).encode(K.ids_of(part_of, "text"))
                edge = (4 * first).tolist()
                for ident, a, b in zip(K.ids_of(part_of, "id").to_pylist(), edge[:-1], edge[1:], strict=True):
                    packer.add((ident, ids[a:b] + tail), (b - a) // 4 + 1)
                if out[0]:
                    yield rows()
        add(packer.finish(), None)
        if out[0]:
            yield rows()

    return run


def _merge(size: int, kind: pa.DataType):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("offset", "ascending")])
        rows = table.select(["id", "start", "length", "ids", "doc_tokens"]).to_pylist()
        lengths = [r["length"] for r in rows]
        base = (1 << 62) + (key[0].as_py() << 32)
        out: list[list] = [[] for _ in range(7)]
        for i, start, n, seq, at in lay(lengths, tail_sizes(sum(lengths), size)):
            r = rows[i]
            for x, v in zip(out, (r["id"], r["start"] + start, n, r["ids"][4 * start : 4 * (start + n)], r["doc_tokens"], base + seq, at), strict=True):
                x.append(v)
        kinds = (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=list(_NAMES))

    return run


def pack_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, open_windows: int = OPEN, merge: int = MERGE, end_id: int = END_ID) -> DataFrame:
    """Tokenise every whole text and pack the ids, each text's followed by end_id, into sequences of at most `size`.

    Returns a row per piece: id_col, start (the text's ids before it), length, ids
    (little-endian unsigned 32-bit integers), doc_tokens (end id included), sequence_id and
    offset (in the sequence, gapless from 0). A sequence is `size` long or a power of two.
    Null and empty texts are their end id only. Equal and null ids are texts of their own.
    Other columns play no part. Rows are packed in the order a partition gives them, so docs
    should come from a table, not from a shuffle whose order may change when a task is run again.
    """
    if size & size - 1 or size < 2:
        raise ValueError("size must be a power of two")
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType
    spark_schema = T.StructType([T.StructField("id", kind)])
    for name, t in zip((*_NAMES[1:], "part", "closed"), ("long", "long", "binary", "long", "long", "long", "long", "boolean"), strict=True):
        spark_schema = spark_schema.add(name, t)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in spark_schema])
    packed = cut(source.mapInArrow(_pack(path, size, open_windows, end_id, arrow), spark_schema), "pieces")
    loose = packed.filter("not closed").withColumn("grp", (F.col("part") / merge).cast("long"))
    merged = loose.groupBy("grp").applyInArrow(_merge(size, arrow.field("id").type), T.StructType(spark_schema.fields[:7]))
    out = packed.filter("closed").select(*_NAMES).unionByName(merged)
    return out.withColumnRenamed("id", id_col)
