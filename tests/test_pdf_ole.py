"""The PDF reader and the older office formats, on files built here."""

import struct
import zlib

import numpy as np
import pytest

from docflow.operators import layout
from docflow.plans import samples
from docflow.sources import files, ole, pdf

GRID = [(20, y, 320, y) for y in (100, 120, 140, 160)] + [(x, 100, x, 160) for x in (20, 120, 220, 320)]
TABLE = [(t, 25 + 100 * c, 103 + 20 * r, 10) for r, row in enumerate([("key", "a|b", "last"), ("1", "two words", ""), ("Ä", "x", "y")]) for c, t in enumerate(row) if t]
PAGE = {"lines": [("Big title here", 20, 20, 20), ("plain  text of the page", 20, 60, 10), *TABLE, ("after the table", 20, 200, 10)], "rules": GRID, "images": [(20, 230, 50, 40, 3)]}


def rows(content):
    return list(pdf.pages(content))


@pytest.mark.parametrize("kw", [{}, {"pack": False}, {"object_streams": True}])
def test_pages(kw):
    (page,) = rows(samples.pdf([PAGE], **kw))
    assert page["error"] is None and (page["width"], page["height"]) == (600, 800)
    texts = [x["text"] for x in page["text_lines"]]
    assert texts[:2] == ["Big title here", "plain text of the page"] and texts[-1] == "after the table"
    assert abs(page["text_lines"][0]["top"] - 20) < 0.5 and set(page["text_lines"][0]["sizes"]) == {20.0}
    (table,) = page["tables"]
    assert (table["x0"], table["top"], table["x1"], table["bottom"]) == (20, 100, 320, 160)
    assert table["rows"] == [["key", "a|b", "last"], ["1", "two words", ""], ["Ä", "x", "y"]]
    assert page["images"] == [{"xref": 10, "y": 230.0, "width": 8, "height": 8}]


def test_tables_need_ruled_cells():
    seen = pdf.Page(600, 800, edges=[(False, 10.0, 0.0, 100.0), (False, 50.0, 0.0, 100.0), (True, 0.0, 10.0, 50.0), (True, 100.0, 10.0, 50.0)])
    assert pdf.find_tables(seen) == []  # one box is no table
    seen.edges += [(True, 52.0, 9.0, 28.0), (True, 50.0, 30.0, 51.0)]  # nearly in line, nearly touching: one rule
    (table,) = pdf.find_tables(seen)
    assert len(table["rows"]) == 1 and len(table["rows"][0]) == 2
    seen.edges.append((False, 30.0, 40.0, 48.0))  # too short
    assert len(pdf.find_tables(seen)[0]["rows"]) == 1


def test_merged_cells_are_null():
    lines = [(False, y, 0.0, 100.0) for y in (0.0, 20.0, 40.0)] + [(True, 0.0, 0.0, 40.0), (True, 100.0, 0.0, 40.0), (True, 50.0, 20.0, 40.0)]
    (table,) = pdf.find_tables(pdf.Page(600, 800, edges=lines))
    assert table["rows"] == [["", None], ["", ""]]


def test_markdown_of_a_file(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(samples.pdf([PAGE, {"lines": []}, {"lines": [("second page", 20, 20, 10)] * 1}]))
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.4 nothing")
    found = files.scan_folder(spark, f"file:{tmp_path}")
    pages = pdf.read_pages(found)
    got = {(r.path.rpartition("/")[2], r.page_index): r for r in pages.collect()}
    assert set(got) == {("a.pdf", 0), ("a.pdf", 1), ("a.pdf", 2), ("bad.pdf", -1)} and "Damaged" in got["bad.pdf", -1].error
    md = layout.document_markdown(layout.page_markdown(pages.filter("page_index >= 0").withColumnRenamed("path", "doc_id"), markers=True)).first().markdown
    want = "# Big title here\n\nplain text of the page\n\n| key | a\\|b      | last |\n|-----|-----------|------|\n| 1   | two words |      |\n| Ä   | x         | y    |\n\nafter the table\n\n<!--image:x10:w8:h8-->\n\nsecond page"
    assert md == want


def test_images_once_each_as_png():
    content = samples.pdf([{"images": [(0, 0, 9, 9, 5)]}, {"images": [(0, 0, 9, 9, 5), (9, 9, 9, 9, 6)]}])
    got = list(pdf.images(content))
    assert [(x["page_index"], x["xref"], x["ext"]) for x in got] == [(0, 10, ".png"), (1, 11, ".png")]
    data = got[0]["content"]
    assert files.image_size(data) == (8, 8)
    body = zlib.decompress(data[data.index(b"IDAT") + 4 :])
    assert body[:4] == bytes([0, 5, 35, 155])


def one_image(info: bytes, data: bytes):
    raw = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Kids [] >> endobj\n7 0 obj << /Width 2 /Height 1 " + info + b" /Length %d >>\nstream\n" % len(data) + data + b"\nendstream endobj"
    doc = pdf.Pdf(raw)
    made = pdf.picture(doc, doc.get(pdf.Ref(7)))
    if made[1] != ".png":
        return made
    body = zlib.decompress(made[0][made[0].index(b"IDAT") + 4 :])
    return list(body[1:])


def test_colour_spaces_and_depths():
    assert one_image(b"/BitsPerComponent 8 /ColorSpace /DeviceGray", b"\x01\xff") == [1, 255]
    assert one_image(b"/BitsPerComponent 1 /ColorSpace /DeviceGray", b"\x40") == [0, 255]
    assert one_image(b"/ImageMask true /Decode [1 0]", b"\x40") == [255, 0]
    assert one_image(b"/BitsPerComponent 4 /ColorSpace /DeviceGray", b"\x0f") == [0, 255]
    assert one_image(b"/BitsPerComponent 8 /ColorSpace /DeviceCMYK", b"\x00\x00\x00\x00\xff\x00\x00\x00") == [255, 255, 255, 0, 255, 255]
    assert one_image(b"/BitsPerComponent 8 /ColorSpace [/Indexed /DeviceRGB 1 <010203 0a0b0c>]", b"\x01\x00") == [10, 11, 12, 1, 2, 3]
    assert one_image(b"/Filter /DCTDecode", b"\xff\xd8jpeg") == (b"\xff\xd8jpeg", ".jpg")


def test_filters():
    data = bytes(range(256)) * 3
    doc = pdf.Pdf(b"1 0 obj << /Type /Catalog >> endobj")
    decode = lambda raw, **info: doc.decode(pdf.Stream({k: pdf.Name(v) if isinstance(v, str) else v for k, v in info.items()}, raw))[0]
    assert decode(zlib.compress(data), Filter="FlateDecode") == data
    assert decode(data.hex().encode() + b">", Filter="ASCIIHexDecode") == data
    import base64

    assert decode(base64.a85encode(data) + b"~>", Filter="ASCII85Decode") == data
    assert decode(bytes([2, 65, 66, 67, 254, 90, 128]), Filter="RunLengthDecode") == b"ABCZZZ"
    assert decode(bytes.fromhex("800B6050220C0C8501"), Filter="LZWDecode") == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    grid = np.arange(60, dtype=np.uint8).reshape(5, 12) * 3
    packed = bytearray()
    above = np.zeros(12, np.uint8)
    for how, row in enumerate(grid):
        left = np.concatenate([np.zeros(3, np.uint8), row[:-3]])
        corner = np.concatenate([np.zeros(3, np.uint8), above[:-3]])
        if how == 4:
            p = left.astype(int) + above - corner
            best = np.stack([abs(p - left), abs(p - above), abs(p - corner)]).argmin(0)
            guess = np.choose(best, [left, above, corner])
        else:
            guess = [0, left, above, (left.astype(int) + above) // 2][how]
        packed += bytes([how]) + (row - np.asarray(guess)).astype(np.uint8).tobytes()
        above = row
    parms = {"Predictor": 15, "Colors": 3, "Columns": 4}
    assert decode(zlib.compress(bytes(packed)), Filter="FlateDecode", DecodeParms=parms) == grid.tobytes()


def test_strings_fonts_and_operators():
    assert pdf.parse(rb"(a\(b\)\101\n(c)\
d)", 0)[0] == b"a(b)A\n(c)d"
    assert pdf.parse(b"<< /A#42 [1 -2.5 (x) <4> 3 0 R true null] >>", 0)[0] == {"AB": [1, -2.5, b"x", b"@", pdf.Ref(3), True, None]}
    assert [pdf.glyph(n) for n in ("A", "adieresis", "Ccedilla", "uni00E9", "germandbls", "emdash", "g12")] == ["A", "ä", "Ç", "é", "ß", "—", ""]
    assert pdf.to_unicode(b"1 beginbfrange <01> <03> <0041> <05> <06> [<0078> <00660069>] endbfrange") == {1: "A", 2: "B", 3: "C", 5: "x", 6: "fi"}
    content = b"BT /F 10 Tf 14 TL 50 700 Td (One) Tj 40 0 Td [(t) -20 (wo)] TJ T* (next) Tj ET q 2 0 0 2 0 0 cm BT /F 5 Tf 20 200 Td (Scaled) Tj ET Q BI /W 1 /H 1 ID \x00 EI BT /F 8 Tf 1 0 0 1 9 50 Tm (\xe4) ' ET"
    raw = b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Kids [3 0 R 3 0 R] >> endobj 3 0 obj << /Type /Page /Contents 4 0 R /Resources << /Font << /F << /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >> >> >> >> endobj 4 0 obj << /Length 9999 >> stream\n" + content + b"\nendstream endobj"
    (page,) = rows(raw)  # a page that is listed twice is one page
    assert [x["text"] for x in page["text_lines"]] == ["One two", "next", "Scaled", "ä"]
    assert [round(x["sizes"][0]) for x in page["text_lines"]] == [10, 10, 10, 8]


def test_damaged_and_odd_files():
    for raw in (b"", b"%PDF-1.4", b"1 0 obj << /Type /Catalog /Pages 1 0 R >> endobj trailer << /Encrypt 2 0 R /Root 1 0 R >>"):
        with pytest.raises(pdf.Damaged):
            rows(raw)
    assert rows(b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Kids [2 0 R 9 0 R] >> endobj") == []
    whole = samples.pdf([PAGE])
    assert rows(whole[: len(whole) - 200])[0]["text"].startswith("Big title")  # the end is not needed


def test_a_page_that_fails_has_its_strings(monkeypatch):
    monkeypatch.setattr(pdf, "find_tables", lambda page: 1 / 0)
    (page,) = rows(samples.pdf([PAGE]))
    assert "ZeroDivisionError" in page["error"] and page["text"].startswith("Big title here\nplain") and page["text_lines"] == []


def test_older_office_formats():
    long = "Första stycket\nzweiter Absatz " + "x" * 5000
    assert ole.doc(samples.doc(long)) == long.replace("\n", "\n\n")
    assert ole.doc(samples.doc("see \x13 HYPERLINK u \x14here\x15 now\x07")) == "see here now"
    table = [["name", "n"], ["ä" * 5000, 1.0], ["b", -2.5], *([f"row {i}", float(i)] for i in range(900))]
    ((name, got),) = ole.xls(samples.xls(table, "Sheet A"))
    assert name == "Sheet A" and got == [[c if isinstance(c, str) else ole.number(c) for c in r] for r in table]
    assert ole.ppt(samples.ppt(["Title\nline", "zwei"])) == "Title\nline\n\nzwei"
    assert ole._rk(struct.unpack("<I", struct.pack("<i", -7 << 2 | 3))[0]) == -0.07
    for read in (ole.doc, ole.ppt, lambda b: list(ole.xls(b))):
        with pytest.raises(ValueError):
            read(b"no compound file at all")


def test_converters_of_other_kinds():
    known = files.Registry()
    run = lambda name, data: known.pick(name).convert(data)
    assert run("a.bmp", samples.bitmap(7, 9)) == "ImageSize: 7x9"
    assert run("a.png", pdf.png(np.zeros((3, 5), np.uint8))) == "ImageSize: 5x3"
    assert run("a.gif", b"GIF89a" + struct.pack("<HH", 4, 6)) == "ImageSize: 4x6"
    assert run("a.jpg", b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x05\x00\x08xxxx") == "ImageSize: 8x5"
    assert run("a.tiff", b"II*\0\x08\0\0\0\x02\0" + struct.pack("<HHII", 256, 3, 1, 12) + struct.pack("<HHII", 257, 4, 1, 13)) == "ImageSize: 12x13"
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((2, 2, 8000, 0, "NONE", ""))
        w.writeframes(bytes(4 * 4000))
    assert run("a.wav", out.getvalue()) == "NumChannels: 2\nSampleRate: 8000\nDuration: 0.50 s"
    assert run("a.mp3", b"ID3\x04") == "Format: MPEG audio"
    inner = samples.archive_of({"deep.txt": b"deep"})
    packed = samples.archive_of({"x.txt": b"text", "skip.bin": b"?", "bad.docx": b"no", "p.pdf": samples.pdf([PAGE]), "in.zip": inner})
    text = run("a.zip", packed)
    assert text.startswith("## File: x.txt\n\ntext\n\n## File: bad.docx\n\n*[failed: BadZipFile") and "## File: p.pdf\n\nBig title here" in text and text.endswith("## File: in.zip\n\n## File: deep.txt\n\ndeep")
    for name in ("a.bmp", "a.wav"):
        with pytest.raises(ValueError):
            run(name, b"neither of these")
    from docflow.operators.queue import SUPPORTED

    assert all(known.pick("x" + e) or e == ".pdf" for e in SUPPORTED)
