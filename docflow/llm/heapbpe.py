"""Token counts of a sentencepiece BPE model, by heap and linked list, without making ids.

Symbols of a segment form a doubly linked list; adjacent pairs that spell a piece lie in a
heap, best score first and leftmost first among equals. Each pop merges one pair. The count
is the initial symbols minus the merges, where a character that is no piece counts as its
UTF-8 bytes (the model's byte fallback).

Text is cut into segments that no merge can cross: before a run of the white-space mark
that follows other characters (no piece holds the mark after another character), and around
characters that occur in no piece of two or more. This is checked when the model is read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

MARK = "▁"
LIMIT = 4096
CACHE = 700_000  # segments whose counts a worker remembers
SHORT = 48  # longer segments are counted anew each time


class PieceCounter:
    """Counts tokens as the model in `path` gives them, without begin and end tokens."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models with the identity normaliser are supported")
        if not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with byte fallback and white space as prefix are supported")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.score = {p.piece: p.score for p in model.pieces if p.type == p.NORMAL}
        if len(self.score) + 259 < len(model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        wide = [p for p in self.score if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in wide):
            raise ValueError("a piece holds the white-space mark after another character")
        joined = {c for p in wide for c in p}
        alone = "".join(c for c in map(chr, range(128)) if c not in joined)
        single = re.escape(alone)
        self.segments = re.compile(f"[{single}]|{MARK}*[^{MARK}{single}]+|{MARK}+").findall if single else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.known: dict[str, int] = {}
        self.misses = 0

    def _segment(self, text: str) -> int:
        """Initial symbols minus merges of one segment."""
        n, score = len(text), self.score
        start, end = list(range(n)), list(range(1, n + 1))  # a symbol is text[start:end]; end 0: merged away
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(-s, i, i + 2) for i in range(n - 1) if (s := score.get(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        bytes_of = lambda c: 1 if c in score else len(c.encode("utf-8", "surrogatepass"))
        count = sum(map(bytes_of, text))
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not end[i]:
                continue
            j = right[i]
            if j >= n or end[j] != stop:
                continue  # one of its symbols has been merged since
            # A merge takes one token off; symbols that were no pieces count as one from here on.
            count -= 1 if end[i] - start[i] > 1 and stop - j > 1 else (1 if end[i] - start[i] > 1 else bytes_of(text[i])) + (1 if stop - j > 1 else bytes_of(text[j])) - 1
            end[i], end[j] = stop, 0
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (s := score.get(text[i : end[k]])) is not None:
                    heapq.heappush(heap, (-s, i, end[k]))
            if (h := left[i]) >= 0 and (s := score.get(text[h:stop])) is not None:
                heapq.heappush(heap, (-s, h, stop))
        return count

    def _remember(self, seg: str, n: int) -> None:
        """The first CACHE segments stay, frequent ones among them, until mostly others come."""
        self.misses += 1
        if self.misses > 4 * CACHE:
            self.known.clear()
            self.misses = 0
        if len(self.known) < CACHE:
            self.known[seg] = n

    def count(self, text: str) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        found = self.segments(self.prefix + text.replace(" ", MARK))
        for seg in found:
            n = known.get(seg)
            if n is None:
                n = self._segment(seg)
                if len(seg) <= SHORT:
                    self._remember(seg, n)
            total += n
        return total


_held: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    """The worker's counter of the model, made once."""
    if path not in _held:
        _held[path] = PieceCounter(path)
    return _held[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Tokens of every whole text under the sentencepiece BPE model at `path`.

    Returns id_col, n_bytes (UTF-8), n_tokens, over_limit (more than `limit`). Null and
    empty texts have none. Every row gives a row, equal or null ids too. There is no
    shuffle: each text is counted where it is read. Other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            n = [count(t) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([K.ids_of(batch, "id"), K.ids_of(batch, "n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=["id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    column = K.ids_of(batch, "text")
    for lo in range(0, len(column), 200):
        yield from column.slice(lo, 200).to_pylist()
