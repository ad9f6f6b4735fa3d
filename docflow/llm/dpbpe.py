"""Exact byte-level BPE by dynamic programming over prefixes, and its inverse.

For byte-pair encodings built from merges, the last token of a prefix's encoding is unique,
and encodings of prefixes chain: if t is the last token of text[:i], the tokens before it
encode text[:i - len(t)]. So for each prefix, a suffix-matching automaton lists the tokens
that end there, longest first. The first that is compatible with the last token stored for
the prefix before it is the one. Two tokens are compatible if encoding their joined text
gives them back, which their merge trees decide without encoding. Following the stored
tokens back from the end gives the ids.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: The pre-tokenisation of byte-level BPE, and Unicode white space.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = r"\t-\r \x85\xa0  -     　"
UNITS, WORDS, SHORT = 250_000, 350_000, 48  # entries of a worker's caches, and characters in one


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte: itself where Latin-1 prints it, else U+0100 onwards in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """The byte-level BPE vocabulary of a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or spec["normalizer"] or model.get("dropout") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are supported")
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"]}
        ids = model["vocab"]
        self.bytes_of: list[bytes] = [b""] * (max([*ids.values(), *(a["id"] for a in spec["added_tokens"])]) + 1)
        for t, i in ids.items():
            self.bytes_of[i] = raw[t]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        # Ranks: 0 to 255 single bytes, then merges in order. Only what merges make is a token.
        single = {raw[t]: i for t, i in ids.items() if len(raw[t]) == 1}
        order = sorted(single)
        self.id_of = [single[b] for b in order]
        rank = {b: r for r, b in enumerate(order)}
        self.parts: list[tuple[int, int]] = [(r, r) for r in range(len(order))]
        self.merged: dict[tuple[int, int], int] = {}
        for pair in model["merges"]:
            a, b = (bytes(letters[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            r = len(self.parts)
            if a + b in rank:
                raise ValueError("two merges make one token")
            rank[a + b], self.merged[rank[a], rank[b]] = r, r
            self.parts.append((rank[a], rank[b]))
            self.id_of.append(ids["".join(self._letters(letters, a + b))])
        self.length = [0] * len(self.parts)
        self.matches = ahocorasick.Automaton()
        for b, r in rank.items():
            self.length[r] = len(b)
            self.matches.add_word(b.decode("latin-1"), r)
        self.matches.make_automaton()
        self.whole: list[bool | None] = [None] * len(self.parts)
        self.packs = [struct.Struct(f"<{n}I").pack for n in range(SHORT + 1)]
        self.fits: dict[int, bool] = {}
        white = f"[{WHITE}]"
        self.units = regex.compile(f"{white}*[^{WHITE}]+|{white}+").findall
        self.pretokens = regex.compile(PRETOKENS.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", white).replace(r"\S", f"[^{WHITE}]")).findall
        self.splits = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else lambda t: [t]
        self.known_units: dict[str, bytes] = {}
        self.known_words: dict[str, bytes] = {}
        self.misses = 0

    @staticmethod
    def _letters(letters: dict[str, int], b: bytes) -> list[str]:
        back = ByteBPE._back = getattr(ByteBPE, "_back", None) or {v: k for k, v in letters.items()}
        return [back[x] for x in b]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the joined text of tokens a and b (ranks) encodes as a, b.

        Undo the later of the two facing merges again and again. If a merge across the border
        ranks before the one undone last, it would have come first.
        """
        key = a * len(self.parts) + b
        if (known := self.fits.get(key)) is not None:
            return known
        merged, parts = self.merged, self.parts
        limit, ok = len(parts) + 1, None
        while ok is None:
            across = merged.get((a, b))
            if across is not None and across < limit:
                ok = False
                break
            inner_a, inner_b = parts[a][0] != parts[a][1] or self.length[a] > 1, parts[b][0] != parts[b][1] or self.length[b] > 1
            if inner_a and (a > b or not inner_b):
                limit, a = a, parts[a][1]
            elif inner_b:
                limit, b = b + 1, parts[b][0]  # at equal rank the left one merges first
            else:
                ok = True
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def last_tokens(self, text: str) -> list[int]:
        """Of each prefix of a pre-token (bytes as Latin-1), the rank of its encoding's last token."""
        last, length, known, size, whole = [-1] * (len(text) + 1), self.length, self.fits, len(self.parts), self.whole
        done = 0
        for end, rank in self.matches.iter(text):  # by end, longest first
            end += 1
            if end == done:
                continue
            start = end - length[rank]
            if start:
                before = last[start]
                if before < 0:
                    continue
                fits = known.get(before * size + rank)
                if not (self.compatible(before, rank) if fits is None else fits):
                    continue
            else:
                if whole[rank] is None:
                    whole[rank] = self._whole(rank)
                if not whole[rank]:
                    continue
            last[end] = rank
            done = end
        return last

    def _whole(self, rank: int) -> bool:
        """Whether the token's own text encodes as the token."""
        a, b = self.parts[rank]
        return self.length[rank] == 1 or (self.fits_inside(a, b, rank))

    def fits_inside(self, a: int, b: int, rank: int) -> bool:
        key = -1 - rank
        if (known := self.fits.get(key)) is None:
            # a and b must be what their texts encode to, and no merge may cross their border earlier
            merged = self.merged.pop((a, b))
            joined = self.compatible(a, b)
            self.fits.pop(a * len(self.parts) + b, None)
            self.merged[a, b] = merged
            known = self.fits[key] = joined and self._whole(a) and self._whole(b)
        return known

    def encode_word(self, text: str) -> list[int]:
        """Ids of one pre-token."""
        raw = text if text.isascii() else text.encode("utf-8").decode("latin-1")
        last, end, out = self.last_tokens(raw), len(raw), []
        while end > 0:
            rank = last[end]
            out.append(self.id_of[rank])
            end -= self.length[rank]
        return out[::-1]

    def _remember(self, known: dict[str, bytes], room: int, text: str, ids: bytes) -> None:
        """The first entries stay, frequent ones among them, until mostly others come."""
        self.misses += 1
        if self.misses > 4 * (UNITS + WORDS):
            self.known_units.clear()
            self.known_words.clear()
            self.misses = 0
        if len(known) < room:
            known[text] = ids

    def _unit(self, unit: str) -> bytes:
        out = []
        letters = unit[1:] if unit[0] == " " else unit
        if letters.isalpha():  # the common cases of pretokens(unit), spelt out
            words = (unit,)
        elif letters[:-1].isalpha() and letters[-1] in ".,":
            words = (unit[:-1], unit[-1])
        else:
            words = self.pretokens(unit)
        for word in words:
            ids = self.known_words.get(word)
            if ids is None:
                x = self.encode_word(word)
                ids = self.packs[len(x)](*x) if len(x) <= SHORT else struct.pack(f"<{len(x)}I", *x)
                if len(word) <= SHORT:
                    self._remember(self.known_words, WORDS, word, ids)
            out.append(ids)
        found = b"".join(out)
        if len(unit) <= SHORT:
            self._remember(self.known_units, UNITS, unit, found)
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; special strings become their ids."""
        out = []
        for piece in self.splits(text) if any(s in text for s in self.special) else [text]:
            if piece in self.special:
                out.append(struct.pack("<I", self.special[piece]))
                continue
            known = self.known_units
            for unit in self.units(piece):
                ids = known.get(unit)
                out.append(self._unit(unit) if ids is None else ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_held: dict[str, ByteBPE] = {}


def vocabulary(path: str) -> ByteBPE:
    """The worker's copy of the vocabulary, made once."""
    if path not in _held:
        _held[path] = ByteBPE(path)
    return _held[path]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text: id_col, n_tokens, ids (little-endian unsigned 32-bit integers).

    Null and empty texts have no ids. Every row gives a row, equal or null ids too. There
    is no shuffle. Other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary(path).encode
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = [encode(t) if t else b"" for t in K.ids_of(part, "text").to_pylist()]
                yield pa.RecordBatch.from_arrays([K.ids_of(part, "id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["id", "n_tokens", "ids"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Adds decoded, the text of ids, to what encode_texts returns; null ids are the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = vocabulary(path).decode
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                text = pa.array([decode(x) if x else "" for x in K.ids_of(part, "ids").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(K.ids_of(part, c) for c in ("id", "n_tokens", "ids")), text], names=["id", "n_tokens", "ids", "decoded"])

    source = encoded.select(F.col(id_col).alias("id"), "n_tokens", "ids")
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_tokens long, ids binary, decoded string").withColumnRenamed("id", id_col)
