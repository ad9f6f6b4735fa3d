"""Small files of several formats made from rows, so that sources and converters can be queried and tested without any."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Sequence
from xml.sax.saxutils import escape

MAIN = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def pdf(pages: Sequence[dict], pack: bool = True, object_streams: bool = False) -> bytes:
    """A PDF of pages, each with lines (text, x, top, size), rules (x0, y0, x1, y1, from the top) and images (x, top, width, height, number).

    Images are 2 x 2 times 4 pixels of one colour, told by their number; a page may use one
    that another page has. The one font has a code for every character that occurs.
    """
    high = 800
    chars = sorted({c for p in pages for line in p.get("lines", ()) for c in line[0]})
    code = {c: i + 1 for i, c in enumerate(chars)}
    objects: dict[int, bytes] = {}

    def stream(data: bytes, info: str = "") -> bytes:
        if pack:
            data, info = zlib.compress(data), info + " /Filter /FlateDecode"
        return f"<< /Length {len(data)}{info} >>\nstream\n".encode() + data + b"\nendstream"

    numbers = sorted({i[4] for p in pages for i in p.get("images", ())})
    image_at = {n: 10 + k for k, n in enumerate(numbers)}
    first = 10 + len(numbers)
    objects[1] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[2] = f"<< /Type /Pages /Kids [{' '.join(f'{first + 2 * i} 0 R' for i in range(len(pages)))}] /Count {len(pages)} /MediaBox [0 0 600 {high}] >>".encode()
    objects[3] = b"<< /Type /Font /Subtype /Type0 /BaseFont /Own /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>"
    objects[4] = b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Own /DW 500 /FontDescriptor << /Type /FontDescriptor /Descent -200 >> >>"
    pairs = [f"<{code[c]:04x}> <{c.encode('utf-16-be').hex()}>" for c in chars]
    blocks = "\n".join(f"{len(pairs[i : i + 100])} beginbfchar\n" + "\n".join(pairs[i : i + 100]) + "\nendbfchar" for i in range(0, len(pairs), 100))
    objects[5] = stream(f"begincmap\n1 begincodespacerange <0000> <ffff> endcodespacerange\n{blocks}\nendcmap".encode())
    for n, at in image_at.items():
        objects[at] = stream(bytes([n % 256, n * 7 % 256, n * 31 % 256]) * 64, " /Type /XObject /Subtype /Image /Width 8 /Height 8 /BitsPerComponent 8 /ColorSpace /DeviceRGB")
    for i, page in enumerate(pages):
        out = []
        for text, x, top, size in page.get("lines", ()):
            shown = "".join(f"{code[c]:04x}" for c in text)
            out.append(f"BT /F1 {size} Tf 1 0 0 1 {x} {high - top - 0.8 * size:.2f} Tm <{shown}> Tj ET")
        out += [f"{x0} {high - y0} m {x1} {high - y1} l S" for x0, y0, x1, y1 in page.get("rules", ())]
        out += [f"q {w} 0 0 {h} {x} {high - top - h} cm /I{n} Do Q" for x, top, w, h, n in page.get("images", ())]
        used = " ".join(f"/I{n} {image_at[n]} 0 R" for n in sorted({x[4] for x in page.get("images", ())}))
        objects[first + 2 * i] = f"<< /Type /Page /Parent 2 0 R /Contents {first + 2 * i + 1} 0 R /Resources << /Font << /F1 3 0 R >> /XObject << {used} >> >> >>".encode()
        objects[first + 2 * i + 1] = stream("\n".join(out).encode())
    body, offsets = b"%PDF-1.5\n", {}
    if object_streams:
        plain = [n for n, b in objects.items() if b"stream" not in b]
        heads, texts = "", b""
        for n in plain:
            heads += f"{n} {len(texts)} "
            texts += objects.pop(n) + b" "
        last = max(*objects, *plain) + 1
        objects[last] = stream(heads.encode() + texts, f" /Type /ObjStm /N {len(plain)} /First {len(heads)}")
        objects[last + 1] = stream(b"", " /Type /XRef /Root 1 0 R /Size 1")
    for n, b in objects.items():
        offsets[n] = len(body)
        body += f"{n} 0 obj\n".encode() + b + b"\nendobj\n"
    if object_streams:
        return body + f"startxref\n{offsets[last + 1]}\n%%EOF".encode()
    size = max(objects) + 1
    table = "".join(f"{offsets.get(n, 0):010d} {0 if n in offsets else 65535:05d} {'n' if n in offsets else 'f'} \n" for n in range(size))
    return body + f"xref\n0 {size}\n{table}trailer << /Size {size} /Root 1 0 R >>\nstartxref\n{len(body)}\n%%EOF".encode()


def text_pdf(text: str, per_page: int = 40, size: float = 10) -> bytes:
    """A PDF of a text's lines, per_page of them on a page."""
    lines = text.split("\n")
    return pdf([{"lines": [(x, 20, 20 + 18 * k, size) for k, x in enumerate(lines[i : i + per_page]) if x]} for i in range(0, len(lines), per_page)])


def archive_of(entries: dict[str, str | bytes]) -> bytes:
    """A ZIP archive of entries."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def docx(paragraphs: Sequence[str], media: Sequence[tuple[str, bytes]] = ()) -> bytes:
    """A document of paragraphs (# marks a heading, {image} stands for a picture) and media (entry, bytes)."""
    body = ""
    for p in paragraphs:
        bare = p.lstrip("#")
        level = len(p) - len(bare) if bare.startswith(" ") else 0
        style = f'<w:pPr><w:pStyle w:val="Heading{level}"/></w:pPr>' if 0 < level < 7 else ""
        runs = "<w:r><w:drawing><a:blip/></w:drawing></w:r>".join(f"<w:r><w:t>{escape(x)}</w:t></w:r>" for x in (bare[1:] if style else p).split("{image}"))
        body += f"<w:p>{style}{runs}</w:p>"
    return archive_of({"word/document.xml": f"<w:document {MAIN}><w:body>{body}</w:body></w:document>", **dict(media)})


def xlsx(rows: Sequence[Sequence[str]], name: str = "S") -> bytes:
    cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{escape(c)}</t></is></c>' for c in r) + "</row>" for r in rows)
    return archive_of({"xl/workbook.xml": f'<workbook><sheets><sheet name="{escape(name)}"/></sheets></workbook>', "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{cells}</sheetData></worksheet>"})


def pptx(slides: Sequence[Sequence[str]]) -> bytes:
    made = {f"ppt/slides/slide{i}.xml": "<p:sld xmlns:p='p' xmlns:a='a'>" + "".join(f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>" for t in texts) + "</p:sld>" for i, texts in enumerate(slides, 1)}
    return archive_of(made)


def epub(chapters: Sequence[str]) -> bytes:
    return archive_of({f"c{i:04d}.xhtml": f"<html><body><p>{escape(t)}</p></body></html>" for i, t in enumerate(chapters)})


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of streams, the short ones in the small-sector chain as the format has it."""
    end, free = 0xFFFFFFFE, 0xFFFFFFFF
    sectors: list[bytes] = []
    links: list[int] = []

    def put(data: bytes) -> int:
        parts = [data[i : i + 512].ljust(512, b"\0") for i in range(0, len(data), 512)]
        at = len(sectors)
        sectors.extend(parts)
        links.extend([*range(at + 1, at + len(parts)), end] if parts else [])
        return at if parts else end

    small, mini, entries = b"", [], []
    for name, data in streams.items():
        if len(data) < 4096:
            at, n = len(mini), -(-len(data) // 64)
            mini.extend([*range(at + 1, at + n), end] if n else [])
            small += data.ljust(64 * n, b"\0")
            entries.append((name, 2, at if n else end, len(data)))
        else:
            entries.append((name, 2, put(data), len(data)))
    root = ("Root Entry", 5, put(small), len(small))
    row = lambda e: e[0].encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB3I", 2 * len(e[0]) + 2, e[1], 1, free, free, free) + bytes(36) + struct.pack("<IQ", e[2], e[3])
    directory = put(b"".join(map(row, [root, *entries])))
    mini_fat = put(struct.pack(f"<{len(mini)}I", *mini) if mini else b"")
    fat_at = len(sectors)
    n_fat = -(-(len(links) + 1) // 128)
    while -(-(len(links) + n_fat) // 128) > n_fat:
        n_fat += 1
    links += [0xFFFFFFFD] * n_fat
    table = struct.pack(f"<{len(links)}I", *links).ljust(512 * n_fat, b"\xff")
    sectors += [table[512 * i : 512 * i + 512] for i in range(n_fat)]
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<5H", 62, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<10I", 0, n_fat, directory, 0, 4096, mini_fat, 1 if mini else 0, end, 0, fat_at)
    head = head[:76] + struct.pack("<109I", *([fat_at + i for i in range(n_fat)] + [free] * (109 - n_fat)))
    return head + b"".join(sectors)


def doc(text: str) -> bytes:
    """A Word document whose text is one piece of two-byte characters."""
    body = text.replace("\n", "\r").encode("utf-16-le")
    n = len(body) // 2
    clx = b"\x02" + struct.pack("<I", 16) + struct.pack("<2I", 0, n) + struct.pack("<HIH", 0, 1024, 0)
    head = bytearray(1024)
    struct.pack_into("<H", head, 10, 0x200)
    struct.pack_into("<2I", head, 0x01A2, 0, len(clx))
    return compound({"WordDocument": bytes(head) + body, "1Table": clx})


def xls(rows: Sequence[Sequence[str | float]], name: str = "S") -> bytes:
    """A workbook of one sheet; texts are shared strings, cut over records of 8000 bytes."""
    record = lambda kind, data: struct.pack("<HH", kind, len(data)) + data
    texts = list(dict.fromkeys(c for r in rows for c in r if isinstance(c, str)))
    parts, here = [], bytearray(struct.pack("<2I", len(texts), len(texts)))
    for t in texts:
        if len(here) > 7900:
            parts.append(bytes(here))
            here = bytearray()
        here += struct.pack("<HB", len(t), 1)
        for c in t:
            if len(here) > 8000:
                parts.append(bytes(here))
                here = bytearray(b"\x01")
            here += c.encode("utf-16-le")[:2]
    parts.append(bytes(here))
    sst = b"".join(record(0xFC if i == 0 else 0x3C, p) for i, p in enumerate(parts))
    bof, eof = record(0x809, struct.pack("<2H", 0x600, 5) + bytes(12)), record(0x0A, b"")
    sheet = lambda at: record(0x85, struct.pack("<I2B", at, 0, 0) + bytes([len(name), 0]) + name.encode("latin-1"))
    start = len(bof) + len(sheet(0)) + len(sst) + len(eof)
    cells = b""
    for i, r in enumerate(rows):
        for j, c in enumerate(r):
            cells += record(0xFD, struct.pack("<3HI", i, j, 0, texts.index(c))) if isinstance(c, str) else record(0x203, struct.pack("<3Hd", i, j, 0, c))
    return compound({"Workbook": bof + sheet(start) + sst + eof + bof + cells + eof})


def ppt(texts: Sequence[str]) -> bytes:
    atom = lambda kind, data, head=0: struct.pack("<HHI", head, kind, len(data)) + data
    slides = b"".join(atom(0x03EE, atom(0x0FA0, t.replace("\n", "\r").encode("utf-16-le")), 15) for t in texts)
    return compound({"PowerPoint Document": atom(0x03E8, slides, 15)})


def bitmap(width: int, height: int) -> bytes:
    return b"BM" + struct.pack("<IHHI", 54, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, 0, 0, 0, 0, 0)
