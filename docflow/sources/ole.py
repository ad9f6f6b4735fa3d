"""Texts of the older binary office formats (.doc, .xls, .ppt) in plain Python: compound files and what lies in them."""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator

# Fixed values of the compound file format.
MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
LAST = 0xFFFFFFFA  # sector numbers from here on are marks


def streams(raw: bytes) -> dict[str, bytes]:
    """Name -> bytes of a compound file's streams; of equal names the last."""
    if raw[:8] != MAGIC:
        raise ValueError("not a compound file")
    shift, mini_shift = struct.unpack_from("<HH", raw, 30)
    directory, _, cutoff, mini_fat = struct.unpack_from("<4I", raw, 48)
    difat, n_difat = struct.unpack_from("<2I", raw, 68)
    size = 1 << shift
    sector = lambda i: raw[(i + 1) * size : (i + 2) * size]
    tables = list(struct.unpack_from("<109I", raw, 76))
    for _ in range(n_difat):
        if difat >= LAST:
            break
        *more, difat = struct.unpack(f"<{size // 4}I", sector(difat).ljust(size, b"\xff"))
        tables += more
    fat: list[int] = []
    for t in tables:
        if t < LAST:
            fat += struct.unpack(f"<{size // 4}I", sector(t).ljust(size, b"\xff"))

    def chain(at: int, links: list[int]) -> Iterator[int]:
        for _ in range(len(links)):
            if at >= len(links):
                return
            yield at
            at = links[at]

    whole = lambda at: b"".join(map(sector, chain(at, fat)))
    mini = list(struct.unpack(f"<{len(whole(mini_fat)) // 4}I", whole(mini_fat)))
    entries = whole(directory)
    out, small = {}, b""
    for at in range(0, len(entries) - 127, 128):
        n, kind = struct.unpack_from("<HB", entries, at + 64)
        start, length = struct.unpack_from("<IQ", entries, at + 116)
        length &= 0xFFFFFFFF
        name = entries[at : at + max(0, n - 2)].decode("utf-16-le", "replace")
        if kind == 5:
            small = whole(start)
        elif kind == 2 and length >= cutoff:
            out[name] = whole(start)[:length]
        elif kind == 2:
            step = 1 << mini_shift
            out[name] = b"".join(small[i * step : (i + 1) * step] for i in chain(start, mini))[:length]
    return out


def doc(raw: bytes) -> str:
    """The text of a Word document, paragraphs apart by blank lines."""
    found = streams(raw)
    main = found["WordDocument"]
    table = found["1Table" if struct.unpack_from("<H", main, 10)[0] & 0x200 else "0Table"]
    at, length = struct.unpack_from("<2I", main, 0x01A2)
    clx, pieces = table[at : at + length], b""
    i = 0
    while i < len(clx):
        if clx[i] == 1:
            i += 3 + struct.unpack_from("<H", clx, i + 1)[0]
        else:
            pieces = clx[i + 5 : i + 5 + struct.unpack_from("<I", clx, i + 1)[0]]
            break
    n = (len(pieces) - 4) // 12
    places = struct.unpack_from(f"<{n + 1}I", pieces)
    out = []
    for k in range(n):
        where, chars = struct.unpack_from("<I", pieces, 4 * (n + 1) + 8 * k + 2)[0], places[k + 1] - places[k]
        if where & 0x40000000:
            start = (where & 0x3FFFFFFF) // 2
            out.append(main[start : start + chars].decode("cp1252", "replace"))
        else:
            out.append(main[where : where + 2 * chars].decode("utf-16-le", "replace"))
    text, depth = [], 0
    for c in "".join(out):  # a field's code lies between 13 and 14, its result between 14 and 15
        depth += (c == "\x13") - (c == "\x14" and depth > 0)
        if c >= " " and not depth:
            text.append(c)
        elif c in "\r\x0b\x0c":
            text.append("\n")
        elif c in "\x07\t" and not depth:
            text.append("\t")
    return "\n\n".join(p.strip() for p in "".join(text).split("\n") if p.strip())


def _records(raw: bytes, at: int = 0) -> Iterator[tuple[int, bytes, int]]:
    while at + 4 <= len(raw):
        kind, n = struct.unpack_from("<HH", raw, at)
        yield kind, raw[at + 4 : at + 4 + n], at
        at += 4 + n


def _short(b: bytes, at: int, wide: bool) -> str:
    """A string with its length (one byte, or two) and flags before it."""
    n = struct.unpack_from("<H", b, at)[0] if wide else b[at]
    at += 2 if wide else 1
    return b[at + 1 : at + 1 + 2 * n].decode("utf-16-le", "replace") if b[at] & 1 else b[at + 1 : at + 1 + n].decode("latin-1")


def _shared(parts: list[bytes]) -> list[str]:
    """The shared strings of a workbook; a string may go on in the next part, whose first byte then tells its width."""
    out: list[str] = []
    part, at = 0, 8
    count = struct.unpack_from("<I", parts[0], 4)[0]

    def here() -> bool:
        nonlocal part, at
        while part < len(parts) and at >= len(parts[part]):
            part, at = part + 1, 0
        return part < len(parts)

    while len(out) < count and here():
        n, flags = struct.unpack_from("<HB", parts[part], at)
        at += 3
        runs, extra = 0, 0
        if flags & 8:
            runs = struct.unpack_from("<H", parts[part], at)[0]
            at += 2
        if flags & 4:
            extra = struct.unpack_from("<I", parts[part], at)[0]
            at += 4
        text, wide = "", flags & 1
        while n and part < len(parts):
            step = 2 if wide else 1
            take = min(n, (len(parts[part]) - at) // step)
            text += parts[part][at : at + take * step].decode("utf-16-le" if wide else "latin-1", "replace")
            at, n = at + take * step, n - take
            if n:
                part, at = part + 1, 1
                wide = parts[part][0] & 1 if part < len(parts) and parts[part] else 0
        out.append(text)
        rest = 4 * runs + extra
        while rest and here():
            take = min(rest, len(parts[part]) - at)
            at, rest = at + take, rest - take
    return out


def _rk(v: int) -> float:
    x = float(v >> 2 if v < 1 << 31 else (v >> 2) - (1 << 30)) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & 0xFFFFFFFC) << 32))[0]
    return x / 100 if v & 1 else x


def number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def xls(raw: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(name, rows of cells) of each sheet of a workbook."""
    found = streams(raw)
    book = found.get("Workbook") or found["Book"]
    sheets, shared, last = [], [], None
    for kind, data, _ in _records(book):
        if kind == 0x85:
            sheets.append((struct.unpack_from("<I", data)[0], _short(data, 6, False)))
        elif kind == 0xFC:
            shared.append(data)
        elif kind == 0x3C and last in (0xFC, 0x3C) and shared:
            shared.append(data)
        elif kind == 0x0A:
            break
        last = kind
    strings = _shared(shared) if shared else []
    for start, name in sheets:
        cells: dict[int, dict[int, str]] = defaultdict(dict)
        waiting = None
        for kind, data, at in _records(book, start):
            if kind == 0x0A and at > start:
                break
            if kind in (0xFD, 0x203, 0x27E, 0x204, 0x06, 0xBD):
                row, col = struct.unpack_from("<HH", data)
            if kind == 0xFD:
                i = struct.unpack_from("<I", data, 6)[0]
                cells[row][col] = strings[i] if i < len(strings) else ""
            elif kind == 0x203:
                cells[row][col] = number(struct.unpack_from("<d", data, 6)[0])
            elif kind == 0x27E:
                cells[row][col] = number(_rk(struct.unpack_from("<I", data, 6)[0]))
            elif kind == 0xBD:
                for k in range((len(data) - 6) // 6):
                    cells[row][col + k] = number(_rk(struct.unpack_from("<I", data, 6 + 6 * k)[0]))
            elif kind == 0x204:
                cells[row][col] = _short(data, 6, True)
            elif kind == 0x06:
                if data[12:14] == b"\xff\xff":
                    waiting = (row, col) if data[6] == 0 else None  # the string comes in a record of its own
                else:
                    cells[row][col] = number(struct.unpack_from("<d", data, 6)[0])
            elif kind == 0x207 and waiting:
                cells[waiting[0]][waiting[1]] = _short(data, 0, True)
                waiting = None
        width = max((max(r) for r in cells.values()), default=-1) + 1
        yield name, [[cells[r].get(c, "") for c in range(width)] for r in sorted(cells)]


def ppt(raw: bytes) -> str:
    """The texts of a presentation, as they come; masters and notes are left out."""
    out: list[str] = []

    def walk(b: bytes) -> None:
        at = 0
        while at + 8 <= len(b):
            head, kind, n = struct.unpack_from("<HHI", b, at)
            body = b[at + 8 : at + 8 + n]
            if kind == 0x0FA0:
                out.append(body.decode("utf-16-le", "replace"))
            elif kind == 0x0FA8:
                out.append(body.decode("latin-1"))
            elif head & 15 == 15 and kind not in (0x03F8, 0x03F0):
                walk(body)
            at += 8 + n

    walk(streams(raw)["PowerPoint Document"])
    texts = (t.replace("\r", "\n").replace("\x0b", "\n").strip() for t in out)
    return "\n\n".join(t for t in texts if t)
