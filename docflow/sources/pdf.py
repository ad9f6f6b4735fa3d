"""A PDF reader in plain Python: characters, ruled lines, images and tables of each page (SRC6, SRC10, SRC11, P4, SNK4).

read_pages and read_images give rows; operators/layout.py makes Markdown of them. Objects
are found by reading the file from front to back, so a damaged cross-reference table does
no harm. Encrypted files are an error. Positions are from a page's top left corner.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice
from operator import attrgetter, itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docflow.functions.shared import small_batches

# Fixed values of the table search, in points.
SNAP, JOIN, LEAST_EDGE, MEET = 4.0, 4.0, 12.0, 5.0
SPACE_GAP, LINE_GAP = 2.0, 3.0  # characters further apart are words, and lines
LARGEST = 1 << 28  # bytes that one stream may unpack to
DEPTH = 12  # forms within forms

_WHITE = b"\x00\t\n\x0c\r "
_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_REF = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![A-Za-z0-9])")
_WORD = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_OBJECT = re.compile(rb"(?<!\d)(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj|(?<![a-z])trailer")
#: What content streams mostly hold, in one match: a real or whole number, a hexadecimal string, a plain name, an operator.
_TOKEN = re.compile(
    rb"[\x00\t\n\x0c\r ]*(?:([+-]?(?:\d+\.\d*|\.\d+))|([+-]?\d+)(?![\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+R(?![A-Za-z0-9]))|<([0-9A-Fa-f]*)>|/([^\x00\t\n\x0c\r ()<>\[\]{}/%#]+)|([A-Za-z'\"*][A-Za-z0-9'\"*]*))"
    rb"(?:(?<=>)|(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|\Z))"
)
_STREAM = re.compile(rb"[\x00\t\n\x0c\r ]*stream(?:\r\n|\n|\r)")
_ESCAPES = {110: 10, 114: 13, 116: 9, 98: 8, 102: 12}


class Name(str):
    """A name, without its slash."""


class Op(bytes):
    """A bare word: an operator of a content stream, or true, false, null."""


@dataclass(frozen=True)
class Ref:
    num: int


@dataclass
class Stream:
    info: dict
    raw: bytes


class Damaged(ValueError):
    """The bytes are no PDF, or one that cannot be read."""


def parse(b: bytes, at: int):
    """(object, place after it); IndexError at the end of the bytes."""
    at = _SKIP.match(b, at).end()
    c = b[at]
    if c == 47:  # /
        m = _WORD.match(b, at + 1)
        raw, at = (m[0], m.end()) if m else (b"", at + 1)
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), raw).decode("latin-1")), at
    if c == 60 and b[at + 1 : at + 2] == b"<":
        items, at = _until(b, at + 2, b">>")
        return {k: v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, Name)}, at
    if c == 60:
        end = b.index(b">", at)
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", b[at + 1 : end])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1
    if c == 40:
        return _literal(b, at + 1)
    if c == 91:
        return _until(b, at + 1, b"]")
    if c in b"+-.0123456789":
        m = _REF.match(b, at)
        if m:
            return Ref(int(m[1])), m.end()
        m = _NUMBER.match(b, at)
        if m:
            return (float(m[0]) if b"." in m[0] else int(m[0])), m.end()
    m = _WORD.match(b, at)
    return (Op(m[0]), m.end()) if m else (Op(b[at : at + 1]), at + 1)


def _until(b: bytes, at: int, end: bytes):
    out = []
    while True:
        at = _SKIP.match(b, at).end()
        if at >= len(b) or b.startswith(end, at):
            return out, at + len(end)
        x, at = parse(b, at)
        out.append({b"true": True, b"false": False, b"null": None}.get(x, x) if isinstance(x, Op) else x)


def _literal(b: bytes, at: int):
    out, depth = bytearray(), 1
    while at < len(b):
        c = b[at]
        at += 1
        if c == 92 and at < len(b):
            c, at = b[at], at + 1
            if c in b"01234567":
                m = re.compile(rb"[0-7]{1,3}").match(b, at - 1)
                out.append(int(m[0], 8) & 255)
                at = m.end()
            elif c in b"\r\n":
                at += c == 13 and b[at : at + 1] == b"\n"
            else:
                out.append(_ESCAPES.get(c, c))
            continue
        depth += (c == 40) - (c == 41)
        if not depth:
            break
        out.append(c)
    return bytes(out), at


# --- filters --------------------------------------------------------------------------


def _inflate(data: bytes) -> bytes:
    d = zlib.decompressobj()
    try:
        out = d.decompress(data, LARGEST)
    except zlib.error:
        d, out = zlib.decompressobj(), b""
        for i in range(0, len(data), 256):  # what can be had of a damaged stream
            try:
                out += d.decompress(data[i : i + 256], LARGEST)
            except zlib.error:
                break
    if d.unconsumed_tail:
        raise Damaged("a stream unpacks to too many bytes")
    return out


def _lzw(data: bytes, early: int) -> bytes:
    bits, n, width, out, last = 0, 0, 9, bytearray(), b""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    for byte in data:
        bits, n = bits << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code, bits = bits >> n, bits & (1 << n) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code > len(table) or (code == len(table) and not last):
            break
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (len(table) + early).bit_length()))
        if len(out) > LARGEST:
            raise Damaged("a stream unpacks to too many bytes")
    return bytes(out)


def _run_lengths(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        out += data[at + 1 : at + 2 + n] if n < 128 else data[at + 1 : at + 2] * (257 - n)
        at += n + 2 if n < 128 else 2
    return bytes(out)


def _ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data.partition(b"~")[0]:
        if c == 122 and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (sum(x * 85 ** (4 - i) for i, x in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = len(group)
        group += [84] * (5 - n)
        out += (sum(x * 85 ** (4 - i) for i, x in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")[: n - 1]
    return bytes(out)


def _unpredict(data: bytes, parms: dict) -> bytes:
    kind, colors, depth, columns = (parms.get(k, d) for k, d in (("Predictor", 1), ("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    if kind < 2:
        return data
    pixel, width = max(1, colors * depth // 8), (colors * depth * columns + 7) // 8
    if kind == 2:
        if depth != 8:
            return data
        rows = np.frombuffer(data[: len(data) // width * width], np.uint8).reshape(-1, columns, colors)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes()
    out, above = bytearray(), np.zeros(width, np.uint8)
    for lo in range(0, len(data) - width, width + 1):
        how, row = data[lo], np.frombuffer(data, np.uint8, width, lo + 1)
        if how == 1:
            done = np.zeros(width, np.uint8)
            for k in range(pixel):
                done[k::pixel] = np.cumsum(row[k::pixel], dtype=np.uint8)
        elif how == 2:
            done = row + above
        elif how in (3, 4):
            done = np.zeros(width, np.uint8)
            for i in range(width):
                up, left, corner = int(above[i]), int(done[i - pixel]) if i >= pixel else 0, int(above[i - pixel]) if i >= pixel else 0
                if how == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                done[i] = (int(row[i]) + guess) & 255
        else:
            done = row
        out += done.tobytes()
        above = done
    return bytes(out)


#: Short and long names of the filters that are undone here; pictures in other codings stay as they are.
_FILTERS = {"Fl": "FlateDecode", "LZW": "LZWDecode", "A85": "ASCII85Decode", "AHx": "ASCIIHexDecode", "RL": "RunLengthDecode", "DCT": "DCTDecode"}


# --- documents ------------------------------------------------------------------------


class Pdf:
    """The objects of a file and its pages in order."""

    def __init__(self, data: bytes):
        self.objects: dict[int, object] = {}
        root, encrypted, packed = None, False, []
        at = 0
        while m := _OBJECT.search(data, at):
            try:
                value, at = parse(data, m.end())
            except (IndexError, ValueError, RecursionError):
                at = m.end()
                continue
            info = value if isinstance(value, dict) else {}
            if isinstance(value, dict) and (s := _STREAM.match(data, at)):
                n = value.get("Length")
                end = s.end() + n if isinstance(n, int) and data[s.end() + n : s.end() + n + 20].lstrip(_WHITE).startswith(b"endstream") else data.find(b"endstream", s.end())
                end = end if end >= 0 else len(data)
                value, at = Stream(info, data[s.end() : end]), end
                if info.get("Type") == "ObjStm":
                    packed.append(value)
            if m[1]:
                self.objects[int(m[1])] = value
            if not m[1] or info.get("Type") == "XRef":
                root, encrypted = info.get("Root", root), encrypted or "Encrypt" in info
        if encrypted:
            raise Damaged("the file is encrypted")
        for s in packed:
            self._unpack(s)
        catalog = self.get(root) if root is not None else next((o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"), None)
        if not isinstance(catalog, dict):
            raise Damaged("no document catalog")
        self.pages = list(self._walk(catalog.get("Pages"), {}, set()))

    def _unpack(self, s: Stream) -> None:
        try:
            data, first = self.decode(s)[0], int(self.get(s.info["First"]))
            heads = [int(x) for x in data[:first].split()]
            for num, offset in zip(heads[::2], heads[1::2], strict=False):
                self.objects.setdefault(num, parse(data, first + offset)[0])
        except (IndexError, ValueError, KeyError, TypeError):
            return

    def get(self, x):
        for _ in range(20):
            if not isinstance(x, Ref):
                return x
            x = self.objects.get(x.num)
        return None

    def dict(self, x) -> dict:
        x = self.get(x)
        return x.info if isinstance(x, Stream) else x if isinstance(x, dict) else {}

    def decode(self, s: Stream) -> tuple[bytes, str | None]:
        """(bytes, the coding that is left, if any)."""
        names, parms = self.get(s.info.get("Filter", s.info.get("F"))), self.get(s.info.get("DecodeParms", s.info.get("DP")))
        names = names if isinstance(names, list) else [names] if names else []
        parms = parms if isinstance(parms, list) else [parms]
        data = s.raw
        for i, name in enumerate(names):
            name = self.get(name)
            name = _FILTERS.get(name, name)
            p = {k: self.get(v) for k, v in self.dict(parms[i] if i < len(parms) else None).items()}
            if name == "FlateDecode":
                data = _unpredict(_inflate(data), p)
            elif name == "LZWDecode":
                data = _unpredict(_lzw(data, p.get("EarlyChange", 1)), p)
            elif name == "ASCII85Decode":
                data = _ascii85(data.removeprefix(b"<~"))
            elif name == "ASCIIHexDecode":
                data = parse(b"<" + data.partition(b">")[0] + b">", 0)[0]
            elif name == "RunLengthDecode":
                data = _run_lengths(data)
            else:
                return data, name
        return data, None

    def _walk(self, node, inherited: dict, seen: set) -> Iterator[dict]:
        if isinstance(node, Ref):
            if node.num in seen:
                return
            seen.add(node.num)
        node = self.get(node)
        if not isinstance(node, dict):
            return
        inherited = inherited | {k: node[k] for k in ("Resources", "MediaBox", "CropBox") if k in node}
        if "Kids" in node:
            for kid in self.get(node["Kids"]) or []:
                yield from self._walk(kid, inherited, seen)
        else:
            yield inherited | node

    def content(self, page: dict) -> bytes:
        parts = self.get(page.get("Contents"))
        parts = parts if isinstance(parts, list) else [parts]
        return b"\n".join(self.decode(s)[0] for s in map(self.get, parts) if isinstance(s, Stream))


# --- fonts ----------------------------------------------------------------------------

#: Names of characters that are not letters with marks (those follow a rule).
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")",
    "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[",
    "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "exclamdown": "¡", "cent": "¢", "sterling": "£", "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§", "copyright": "©", "ordfeminine": "ª", "guillemotleft": "«",
    "logicalnot": "¬", "registered": "®", "degree": "°", "plusminus": "±", "mu": "µ", "paragraph": "¶", "periodcentered": "·", "ordmasculine": "º", "guillemotright": "»",
    "questiondown": "¿", "multiply": "×", "divide": "÷", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "dotlessi": "ı",
    "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "quotesinglbase": "‚",
    "quotedblbase": "„", "dagger": "†", "daggerdbl": "‡", "perthousand": "‰", "guilsinglleft": "‹", "guilsinglright": "›", "trademark": "™", "Euro": "€", "minus": "−",
    "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl",
}
#: The marks in names such as adieresis.
MARKS = {"acute": "ACUTE", "grave": "GRAVE", "circumflex": "CIRCUMFLEX", "dieresis": "DIAERESIS", "tilde": "TILDE", "ring": "RING ABOVE", "cedilla": "CEDILLA", "caron": "CARON", "ogonek": "OGONEK", "macron": "MACRON", "breve": "BREVE", "dotaccent": "DOT ABOVE"}


def glyph(name: str) -> str:
    """The text of a character's name, the empty string for one that is not known."""
    name = name.partition(".")[0]
    if name in GLYPHS or len(name) == 1:
        return GLYPHS.get(name, name)
    if m := re.fullmatch(r"uni([0-9A-F]{4})+|u([0-9A-F]{4,6})", name):
        digits = name[3:] if name.startswith("uni") else None
        points = [int(digits[i : i + 4], 16) for i in range(0, len(digits), 4)] if digits else [int(m[2], 16)]
        return "".join(chr(p) for p in points if p < 0x110000 and not 0xD800 <= p < 0xE000)
    letter, mark = name[:1], MARKS.get(name[1:])
    if mark and letter.isalpha():
        try:
            return unicodedata.lookup(f"LATIN {'CAPITAL' if letter.isupper() else 'SMALL'} LETTER {letter} WITH {mark}")
        except KeyError:
            pass
    return ""


def _utf16(b: bytes) -> str:
    return b.decode("utf-16-be", "ignore")


def to_unicode(cmap: bytes) -> dict[int, str]:
    """Code -> text of a ToUnicode map."""
    out: dict[int, str] = {}
    for kind, body in re.findall(rb"begin(bfchar|bfrange)(.*?)endbf(?:char|range)", cmap, re.S):
        items, _ = _until(body + b"]", 0, b"]")
        number = lambda x: int.from_bytes(x, "big")
        if kind == b"bfchar":
            out |= {number(a): _utf16(t) for a, t in zip(items[::2], items[1::2], strict=False) if isinstance(a, bytes) and isinstance(t, bytes)}
            continue
        for lo, hi, to in zip(items[::3], items[1::3], items[2::3], strict=False):
            if not (isinstance(lo, bytes) and isinstance(hi, bytes)):
                continue
            for i, code in enumerate(range(number(lo), min(number(hi), number(lo) + 0xFFFF) + 1)):
                if isinstance(to, list):
                    if i < len(to) and isinstance(to[i], bytes):
                        out[code] = _utf16(to[i])
                elif isinstance(to, bytes) and to:
                    out[code] = _utf16((number(to) + i).to_bytes(len(to), "big")) if number(to) + i < 1 << 8 * len(to) else ""
    return out


class Font:
    """Codes of a string, with the text and width of each."""

    def __init__(self, pdf: Pdf, info: dict):
        self.wide = info.get("Subtype") == "Type0"
        below = pdf.dict((pdf.get(info.get("DescendantFonts")) or [None])[0]) if self.wide else info
        about = pdf.dict(below.get("FontDescriptor"))
        descent = pdf.get(about.get("Descent"))
        self.descent = descent / 1000 if isinstance(descent, (int, float)) and -1000 < descent < 0 else -0.21
        self.text: dict[int, str] = {}
        self.widths: dict[int, float] = {}
        if self.wide:
            self.default = pdf.get(below.get("DW", 1000))
            run = [pdf.get(x) for x in pdf.get(below.get("W")) or []]
            while len(run) > 1:
                if isinstance(run[1], list):
                    self.widths |= {run[0] + i: pdf.get(w) for i, w in enumerate(run[1])}
                    run = run[2:]
                elif len(run) > 2:
                    self.widths |= dict.fromkeys(range(run[0], min(run[1], run[0] + 0xFFFF) + 1), run[2])
                    run = run[3:]
                else:
                    break
        else:
            missing = pdf.get(about.get("MissingWidth"))
            self.default = missing or 500
            first = pdf.get(info.get("FirstChar", 0)) or 0
            self.widths = {first + i: w for i, x in enumerate(pdf.get(info.get("Widths")) or []) if isinstance(w := pdf.get(x), (int, float))}
            encoding = pdf.get(info.get("Encoding"))
            base = encoding if isinstance(encoding, Name) else pdf.dict(encoding).get("BaseEncoding")
            codec = "mac_roman" if base == "MacRomanEncoding" else "cp1252"
            self.text = {c: bytes([c]).decode(codec, "ignore") for c in range(32, 256)}
            at = 0
            for x in pdf.get(pdf.dict(encoding).get("Differences")) or []:
                x = pdf.get(x)
                if isinstance(x, int):
                    at = x
                elif isinstance(x, Name):
                    self.text[at] = glyph(x)
                    at += 1
        cmap = pdf.get(info.get("ToUnicode"))
        if isinstance(cmap, Stream):
            self.text |= to_unicode(pdf.decode(cmap)[0])

    def codes(self, s: bytes) -> Iterator[tuple[int, str, float]]:
        found = struct.unpack(f">{len(s) // 2}H", s[: len(s) // 2 * 2]) if self.wide else s
        for c in found:
            yield c, self.text.get(c, ""), self.widths.get(c, self.default) / 1000


# --- page contents --------------------------------------------------------------------

Matrix = tuple[float, float, float, float, float, float]


def _times(m: Matrix, n: Matrix) -> Matrix:
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def _at(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


@dataclass(slots=True)
class Char:
    text: str
    x0: float
    x1: float
    top: float
    bottom: float
    size: float


@dataclass
class Page:
    """What a page holds: characters, straight edges (vertical, place, from, to) and image placements (xref, top, width, height)."""

    width: float
    height: float
    chars: list[Char] = field(default_factory=list)
    edges: list[tuple[bool, float, float, float]] = field(default_factory=list)
    images: list[tuple[int, float, int, int]] = field(default_factory=list)


@dataclass
class _State:
    ctm: Matrix
    font: Font | None = None
    size: float = 0.0
    char_gap: float = 0.0
    word_gap: float = 0.0
    stretch: float = 1.0
    leading: float = 0.0
    rise: float = 0.0


class _Painter:
    """Runs content streams and notes what they put on the page."""

    def __init__(self, pdf: Pdf, page: dict):
        self.pdf, self.fonts = pdf, {}
        box = [pdf.get(x) for x in pdf.get(page.get("CropBox")) or pdf.get(page.get("MediaBox")) or [0, 0, 612, 792]]
        box = box if len(box) == 4 and all(isinstance(x, (int, float)) for x in box) else [0, 0, 612, 792]
        x0, x1, y0, y1 = min(box[0], box[2]), max(box[0], box[2]), min(box[1], box[3]), max(box[1], box[3])
        self.page = Page(float(x1 - x0), float(y1 - y0))
        self.run(pdf.content(page), pdf.dict(page.get("Resources")), _State((1, 0, 0, 1, -x0, -y0)), 0)

    def run(self, data: bytes, resources: dict, state: _State, depth: int) -> None:
        args: list = []
        self.state, stack, at = state, [], 0
        self.tm = self.line = (1, 0, 0, 1, 0, 0)
        self.path: list[tuple[float, float, float, float]] = []
        self.here = self.begun = (0.0, 0.0)
        while True:
            if m := _TOKEN.match(data, at):
                at, kind = m.end(), m.lastindex
                x = m[kind]
                if kind < 5:
                    args.append(int(x) if kind == 2 else float(x) if kind == 1 else bytes.fromhex((x + b"0" * (len(x) % 2)).decode()) if kind == 3 else Name(x.decode("latin-1")))
                    continue
            else:
                try:
                    x, at = parse(data, at)
                except (IndexError, ValueError):
                    return
                if not isinstance(x, Op):
                    args.append(x)
                    continue
            try:
                if x == b"q":
                    stack.append(_State(**vars(self.state)))
                elif x == b"Q":
                    self.state = stack.pop() if stack else self.state
                elif x == b"Do":
                    self.draw(args, resources, depth)
                elif x == b"Tf":
                    self.state.font, self.state.size = self.font(resources, args[0]), float(args[1])
                elif x == b"BI":
                    end = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|\Z)").search(data, data.find(b"ID", at))
                    at = end.end() if end else len(data)
                else:
                    self.step(bytes(x), args)
            except (IndexError, ValueError, TypeError, AttributeError):
                pass  # an operator with wrong operands does nothing
            args = []

    def font(self, resources: dict, name) -> Font:
        ref = self.pdf.dict(resources.get("Font")).get(name)
        key = ref if isinstance(ref, Ref) else id(ref)
        if key not in self.fonts:
            self.fonts[key] = Font(self.pdf, self.pdf.dict(ref))
        return self.fonts[key]

    def draw(self, args: list, resources: dict, depth: int) -> None:
        ref = self.pdf.dict(resources.get("XObject")).get(args[0])
        x, ctm = self.pdf.get(ref), self.state.ctm
        if not isinstance(x, Stream):
            return
        if x.info.get("Subtype") == "Image":
            top = self.page.height - max(_at(ctm, a, b)[1] for a in (0, 1) for b in (0, 1))
            size = [self.pdf.get(x.info.get(k, 0)) for k in ("Width", "Height")]
            self.page.images.append((ref.num if isinstance(ref, Ref) else 0, top, *(int(n) for n in size)))
        elif x.info.get("Subtype") == "Form" and depth < DEPTH:
            matrix = tuple(float(self.pdf.get(n)) for n in self.pdf.get(x.info.get("Matrix")) or (1, 0, 0, 1, 0, 0))
            kept = (self.state, self.tm, self.line, self.path, self.here, self.begun)
            inner = _State(**vars(self.state) | {"ctm": _times(matrix, ctm)})
            self.run(self.pdf.decode(x)[0], self.pdf.dict(x.info.get("Resources")) or resources, inner, depth + 1)
            self.state, self.tm, self.line, self.path, self.here, self.begun = kept

    def move(self, x: float, y: float) -> None:
        self.tm = self.line = _times((1, 0, 0, 1, x, y), self.line)

    def show(self, s: bytes) -> None:
        t = self.state
        if t.font is None:
            return
        turned = _times(self.tm, t.ctm)
        a, b, c, d, e, f = _times((t.size * t.stretch, 0, 0, t.size, 0, t.rise), turned)
        size, high, put = (c**2 + d**2) ** 0.5, self.page.height, self.page.chars.append
        low, up, spaces, moved = t.font.descent, t.font.descent + 1, not t.font.wide, 0.0
        for code, text, width in t.font.codes(s):
            if text:
                xa, ya, xb, yb = low * c + e, low * d + f, width * a + up * c + e, width * b + up * d + f
                x0, x1 = (xa, xb) if xa < xb else (xb, xa)
                bottom, top = (ya, yb) if ya < yb else (yb, ya)
                put(Char(text, x0, x1, high - top, high - bottom, size))
            step = (width * t.size + t.char_gap + (t.word_gap if spaces and code == 32 else 0)) * t.stretch
            moved += step
            e += step * turned[0]
            f += step * turned[1]
        self.tm = _times((1, 0, 0, 1, moved, 0), self.tm)

    def segment(self, x0: float, y0: float, x1: float, y1: float) -> None:
        self.path.append((*_at(self.state.ctm, x0, y0), *_at(self.state.ctm, x1, y1)))

    def paint(self) -> None:
        high = self.page.height
        for x0, y0, x1, y1 in self.path:
            if abs(x0 - x1) < 0.5 < abs(y0 - y1):
                self.page.edges.append((True, (x0 + x1) / 2, high - max(y0, y1), high - min(y0, y1)))
            elif abs(y0 - y1) < 0.5 < abs(x0 - x1):
                self.page.edges.append((False, high - (y0 + y1) / 2, min(x0, x1), max(x0, x1)))
        self.path = []

    def step(self, op: bytes, a: list) -> None:
        t = self.state
        if op == b"cm":
            t.ctm = _times(tuple(map(float, a[:6])), t.ctm)
        elif op == b"BT":
            self.tm = self.line = (1, 0, 0, 1, 0, 0)
        elif op == b"Tm":
            self.tm = self.line = tuple(map(float, a[:6]))
        elif op in (b"Td", b"TD"):
            if op == b"TD":
                t.leading = -a[1]
            self.move(a[0], a[1])
        elif op == b"T*":
            self.move(0, -t.leading)
        elif op == b"Tj":
            self.show(a[0])
        elif op == b"'":
            self.move(0, -t.leading)
            self.show(a[0])
        elif op == b'"':
            t.word_gap, t.char_gap = a[0], a[1]
            self.move(0, -t.leading)
            self.show(a[2])
        elif op == b"TJ":
            for x in a[0]:
                if isinstance(x, bytes):
                    self.show(x)
                elif isinstance(x, (int, float)):
                    self.tm = _times((1, 0, 0, 1, -x / 1000 * t.size * t.stretch, 0), self.tm)
        elif op in (b"Tc", b"Tw", b"TL", b"Ts"):
            setattr(t, {b"Tc": "char_gap", b"Tw": "word_gap", b"TL": "leading", b"Ts": "rise"}[op], float(a[0]))
        elif op == b"Tz":
            t.stretch = a[0] / 100
        elif op == b"m":
            self.here = self.begun = (a[0], a[1])
        elif op == b"l":
            self.segment(*self.here, a[0], a[1])
            self.here = (a[0], a[1])
        elif op in (b"c", b"v", b"y"):
            self.here = (a[-2], a[-1])
        elif op == b"re":
            x, y, w, h = a[:4]
            for side in ((x, y, x + w, y), (x, y + h, x + w, y + h), (x, y, x, y + h), (x + w, y, x + w, y + h)):
                self.segment(*side)
            self.here = self.begun = (x, y)
        elif op == b"h":
            self.segment(*self.here, *self.begun)
            self.here = self.begun
        elif op in (b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*"):
            if op in (b"s", b"b", b"b*"):
                self.segment(*self.here, *self.begun)
            self.paint()
        elif op == b"n":
            self.path = []


# --- lines and tables -----------------------------------------------------------------


def _clusters(values: list, key, gap: float) -> Iterator[list]:
    """Runs of values, in order of key, whose neighbours lie at most gap apart."""
    run, last = [], 0.0
    for v in sorted(values, key=key):
        at = key(v)
        if run and at - last > gap:
            yield run
            run = []
        run.append(v)
        last = at
    if run:
        yield run


def text_lines(chars: list[Char]) -> list[dict]:
    """text, top, bottom and sizes of each line; words that lie more than SPACE_GAP apart, or have a space between, get one space."""
    out = []
    for run in _clusters(chars, attrgetter("top"), LINE_GAP):
        words, last = [""], None
        real = []
        for c in sorted(run, key=attrgetter("x0")):
            if c.text.isspace():
                words.append("")
                last = None
                continue
            if last is not None and c.x0 - last > SPACE_GAP:
                words.append("")
            words[-1] += c.text
            last = c.x1
            real.append(c)
        if real:
            out.append({"text": " ".join(w for w in words if w), "top": min(c.top for c in real), "bottom": max(c.bottom for c in real), "sizes": [float(c.size) for c in real]})
    return out


def _rules(page: Page, vertical: bool) -> list[tuple[float, float, float]]:
    """(place, from, to) of straight rules: near ones moved together, touching ones joined, short ones left out."""
    out = []
    for run in _clusters([e[1:] for e in page.edges if e[0] == vertical], lambda e: e[0], SNAP):
        place = sum(e[0] for e in run) / len(run)
        lo, hi = None, None
        for _, a, b in sorted(run, key=lambda e: e[1]):
            if lo is not None and a <= hi + JOIN:
                hi = max(hi, b)
                continue
            if lo is not None:
                out.append((place, lo, hi))
            lo, hi = a, b
        out.append((place, lo, hi))
    return [r for r in out if r[2] - r[1] >= LEAST_EDGE]


def find_tables(page: Page) -> list[dict]:
    """x0, top, x1, bottom and rows (cells' texts) of each grid of ruled cells, two cells or more."""
    upright, level = _rules(page, True), _rules(page, False)
    points: dict[tuple[float, float], tuple[set, set]] = defaultdict(lambda: (set(), set()))
    for i, (x, a, b) in enumerate(upright):
        for j, (y, c, d) in enumerate(level):
            if a - MEET <= y <= b + MEET and c - MEET <= x <= d + MEET:
                points[x, y][0].add(i)
                points[x, y][1].add(j)
    columns, lines = defaultdict(list), defaultdict(list)
    for x, y in sorted(points):
        columns[x].append(y)
        lines[y].append(x)
    for xs in lines.values():
        xs.sort()

    def cell(x: float, y: float) -> tuple[float, float, float, float] | None:
        for down in islice(columns[x], bisect_right(columns[x], y), None):
            if not points[x, y][0] & points[x, down][0]:
                continue
            for right in islice(lines[y], bisect_right(lines[y], x), None):
                corner = points.get((right, down))
                if corner and points[x, y][1] & points[right, y][1] and points[right, y][0] & corner[0] and points[x, down][1] & corner[1]:
                    return x, y, right, down
        return None

    cells = [c for p in sorted(points, key=lambda p: (p[1], p[0])) if (c := cell(*p))]
    group = list(range(len(cells)))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    at: dict[tuple[float, float], int] = {}
    for i, (x0, y0, x1, y1) in enumerate(cells):
        for p in ((x0, y0), (x1, y0), (x0, y1), (x1, y1)):
            if p in at:
                a, b = sorted((root(at[p]), root(i)))
                group[b] = a
            at[p] = i
    tables = defaultdict(list)
    for i, c in enumerate(cells):
        tables[root(i)].append(c)
    out, inside = [], _Inside(page.chars if cells else [])
    for mine in tables.values():
        if len(mine) < 2:
            continue
        box = (min(c[0] for c in mine), min(c[1] for c in mine), max(c[2] for c in mine), max(c[3] for c in mine))
        xs = sorted({c[0] for c in mine})
        rows = []
        for top in sorted({c[1] for c in mine}):
            by_x = {c[0]: c for c in mine if c[1] == top}
            rows.append([inside.text(by_x[x]) if x in by_x else None for x in xs])
        out.append({"x0": box[0], "top": box[1], "x1": box[2], "bottom": box[3], "rows": rows})
    return out


class _Inside:
    """The characters of a page by the height of their middle."""

    def __init__(self, chars: list[Char]):
        placed = sorted([((c.top + c.bottom) / 2, i, (c.x0 + c.x1) / 2, c) for i, c in enumerate(chars)], key=itemgetter(0))
        self.heights, self.placed = [p[0] for p in placed], placed

    def text(self, box: tuple[float, float, float, float]) -> str:
        """The text lines of a cell."""
        x0, top, x1, bottom = box
        mine = [p for p in self.placed[bisect_left(self.heights, top) : bisect_left(self.heights, bottom)] if x0 <= p[2] < x1]
        return "\n".join(x["text"] for x in text_lines([p[3] for p in sorted(mine, key=itemgetter(1))]))


# --- pictures -------------------------------------------------------------------------


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of an array of bytes: height x width (grey) or height x width x 3."""
    high, wide = pixels.shape[:2]
    rows = np.zeros((high, 1 + pixels.reshape(high, -1).shape[1]), np.uint8)
    rows[:, 1:] = pixels.reshape(high, -1)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", wide, high, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def _samples(data: bytes, width: int, height: int, n: int, depth: int) -> np.ndarray:
    """height x width x n whole numbers of depth bits; rows begin at whole bytes."""
    step = (width * n * depth + 7) // 8
    raw = np.frombuffer(data.ljust(step * height, b"\x00")[: step * height], np.uint8).reshape(height, step)
    if depth == 16:
        raw = raw[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(raw, axis=1)[:, : width * n * depth].reshape(height, width * n, depth)
        raw = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)
    return raw[:, : width * n].reshape(height, width, n)


def _grey_or_rgb(pdf: Pdf, x: np.ndarray, space) -> np.ndarray:
    """Colours of 0..255 from samples of 0..255 of a colour space."""
    n = x.shape[2]
    if n == 1:
        return x[:, :, 0]
    if n == 4:
        light = 255 - x[:, :, 3:].astype(np.int32)
        return ((255 - x[:, :, :3].astype(np.int32)) * light // 255).astype(np.uint8)
    return x[:, :, :3]


def picture(pdf: Pdf, s: Stream) -> tuple[bytes, str] | None:
    """(file, its suffix): a PNG, or the JPEG as it lies in the file where that is its coding; None for other codings."""
    data, left = pdf.decode(s)
    if left in ("DCTDecode", "JPXDecode"):
        return data, ".jpg" if left == "DCTDecode" else ".jp2"
    if left:
        return None
    width, height = (int(pdf.get(s.info.get(k, 0)) or 0) for k in ("Width", "Height"))
    if width < 1 or height < 1 or width * height * 4 > LARGEST:
        return None
    mask = pdf.get(s.info.get("ImageMask")) is True
    depth = 1 if mask else int(pdf.get(s.info.get("BitsPerComponent", 8)) or 8)
    space = pdf.get(s.info.get("ColorSpace", "DeviceGray"))
    kind = pdf.get(space[0]) if isinstance(space, list) and space else space
    table = None
    if kind in ("Indexed", "I") and len(space) > 3:
        table = pdf.get(space[3])
        table = pdf.decode(table)[0] if isinstance(table, Stream) else table
        base = _components(pdf, space[1])
        table = np.frombuffer(table[: len(table) // base * base], np.uint8).reshape(1, -1, base)
    n = 1 if table is not None or mask else _components(pdf, space)
    x = _samples(data, width, height, n, depth)
    if table is not None:
        colours = _grey_or_rgb(pdf, table, None)[0]
        return png(colours[np.minimum(x[:, :, 0], len(colours) - 1)]), ".png"
    if depth < 8:
        x = (x.astype(np.int32) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    decode = [pdf.get(v) for v in pdf.get(s.info.get("Decode")) or []]
    if decode[:2] == [1, 0]:
        x = 255 - x
    return png(_grey_or_rgb(pdf, x, space)), ".png"


def _components(pdf: Pdf, space) -> int:
    space = pdf.get(space)
    kind = pdf.get(space[0]) if isinstance(space, list) and space else space
    if kind == "ICCBased":
        return int(pdf.get(pdf.dict(space[1]).get("N", 3)) or 3)
    if kind == "DeviceN":
        return len(pdf.get(space[1]))
    return {"DeviceRGB": 3, "RGB": 3, "CalRGB": 3, "Lab": 3, "DeviceCMYK": 4, "CMYK": 4}.get(kind, 1)


# --- rows -----------------------------------------------------------------------------

PAGES = (
    "path string, page_index int, width double, height double, char_sizes array<double>, text string, n_images int, "
    "text_lines array<struct<text: string, top: double, bottom: double, sizes: array<double>>>, "
    "tables array<struct<x0: double, top: double, x1: double, bottom: double, rows: array<array<string>>>>, "
    "images array<struct<xref: int, y: double, width: int, height: int>>, error string"
)
IMAGES = "path string, page_index int, pos int, xref int, width int, height int, content binary, ext string"


def pages(content: bytes) -> Iterator[dict]:
    """The page rows of a file. A page that cannot be laid out has the text of its strings (SRC8)."""
    pdf = Pdf(content)
    for i, page in enumerate(pdf.pages):
        row = {"page_index": i, "width": 612.0, "height": 792.0, "char_sizes": [], "text": "", "n_images": 0, "text_lines": [], "tables": [], "images": [], "error": None}
        try:
            seen = _Painter(pdf, page).page
            lines = text_lines(seen.chars)
            row |= {"width": seen.width, "height": seen.height, "char_sizes": [float(c.size) for c in seen.chars], "text": "\n".join(x["text"] for x in lines), "text_lines": lines}
            row |= {"n_images": len(seen.images), "images": [{"xref": x, "y": y, "width": w, "height": h} for x, y, w, h in seen.images]}
            row["tables"] = find_tables(seen)
        except Exception as e:
            row |= {"error": f"{type(e).__name__}: {e}", "text": row["text"] or strings(pdf, page), "text_lines": [], "tables": []}
        yield row


def plain_text(content: bytes) -> str:
    """The text of a file without headings and tables, pages apart by blank lines."""
    return "\n\n".join(t for t in (row["text"] for row in pages(bytes(content or b""))) if t)


def strings(pdf: Pdf, page: dict) -> str:
    """The strings of a page's content as they come, without fonts or places: the last resort."""
    out, at = [], 0
    try:
        data = pdf.content(page)
        while True:
            x, at = parse(data, at)
            for s in x if isinstance(x, list) else [x]:
                if isinstance(s, bytes) and not isinstance(s, Op):
                    out.append(s.decode("cp1252", "replace"))
            if isinstance(x, Op) and x in (b"ET", b"T*", b"Td", b"TD", b"'"):
                out.append("\n")
    except (IndexError, ValueError):
        pass
    return re.sub(r"\n+", "\n", "".join(out)).strip()


def images(content: bytes) -> Iterator[dict]:
    """SRC10: each image once, on the first page that shows it, as a file."""
    pdf, done = Pdf(content), set()
    for i, page in enumerate(pdf.pages):
        try:
            placed = _Painter(pdf, page).page.images
        except Exception:  # a page that cannot be read shows no images
            continue
        for pos, (xref, _, width, height) in enumerate(placed):
            if xref in done or not xref:
                continue
            done.add(xref)
            try:
                made = picture(pdf, pdf.get(Ref(xref)))
            except Exception:  # nor does an image that cannot be read
                made = None
            if made:
                yield {"page_index": i, "pos": pos, "xref": xref, "width": width, "height": height, "content": made[0], "ext": made[1]}


def _rows(files: DataFrame, schema: str, read: Callable[[bytes], Iterator[dict]], failed: Callable[[Exception], dict] | None) -> DataFrame:
    """The rows that read makes of each file's content, in batches of at most 32."""
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held: list[dict] = []
                try:
                    for row in read(content.as_py() or b""):
                        held.append({"path": path} | row)
                        if len(held) == 32:
                            yield pa.RecordBatch.from_pylist(held, kinds)
                            held = []
                except Exception as e:  # a file that cannot be read is a row at most, never a failed job
                    if failed:
                        held.append({"path": path} | failed(e))
                if held:
                    yield pa.RecordBatch.from_pylist(held, kinds)

    small_batches(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, schema)


def read_pages(files: DataFrame) -> DataFrame:
    """SRC6: a row per page of binaryFile rows; a file that cannot be read has one row with its error and page_index -1."""
    return _rows(files, PAGES, pages, lambda e: {"page_index": -1, "error": f"{type(e).__name__}: {e}"})


def read_images(files: DataFrame) -> DataFrame:
    """SRC10, SNK4: the images of binaryFile rows as files; none where a file cannot be read."""
    return _rows(files, IMAGES, images, None)
