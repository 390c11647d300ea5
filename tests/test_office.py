"""Texts of docx and pdf files that are made here, whole, compressed, broken and scanned."""

import io
import zipfile
import zlib

import pytest

from quern.sources import office

BODY = """<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>
<w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>line</w:t><w:tab/><w:t>&amp; é日</w:t><w:br/><w:t>next</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/></w:body></w:document>"""


def docx(body):
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("word/document.xml", body)
    return made.getvalue()


def pdf(contents, compressed=True, font=b"<< /Type /Font >>", more=b"", packed=False):
    """A file of one page a content, objects out of order; packed: dictionaries inside an object stream."""
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(contents)))
    plain = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, len(contents)), 3: font}
    streams = {}
    for i, content in enumerate(contents):
        plain[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (11 + 2 * i)
        streams[11 + 2 * i] = content
    out = b"%PDF-1.7\n"
    for number, content in streams.items():
        data = zlib.compress(content) if compressed else content
        out += b"%d 0 obj << /Length %d %s >> stream\r\n%s\nendstream endobj\n" % (number, len(data), b"/Filter /FlateDecode" if compressed else b"", data)
    if packed:
        head, body = b"", b""
        for number, value in plain.items():
            head += b"%d %d " % (number, len(body))
            body += value + b"\n"
        data = zlib.compress(head + body)
        out += b"90 0 obj << /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj\n" % (len(plain), len(head), len(data), data)
    else:
        out += b"".join(b"%d 0 obj %s endobj\n" % x for x in reversed(plain.items()))
    return out + more + b"trailer << /Root 1 0 R >>\n%%EOF"


PAGES = [
    b"BT /F1 12 Tf 72 700 Td (Hello \\(big\\) (inner) w\\157rld) Tj 0 -14 Td [(Sp) -10 (lit) -300 (words)] TJ ET",
    b"BT /F1 12 Tf 1 0 0 1 72 700 Tm (one) Tj 1 0 0 1 90 700 Tm (same line) Tj 1 0 0 1 72 680 Tm <6C617374> Tj (it\\'s caf\\351) ' ET",
]
TEXT = "Hello (big) (inner) world\nSplit words\none same line\nlast\nit's café"


def test_docx():
    assert office.docx_text(docx(BODY)).strip() == "One line\t& é日\nnext\n\ncell"
    for text in ("a", "x < y & z\n\n\tq \x0b\x00w", "é\r日 😀"):
        clean = text.replace("\x0b", "").replace("\x00", "")
        assert office.docx_text(office.docx_of(text)) == "\n\n".join(clean.split("\n")) + "\n\n"


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("packed", [True, False])
def test_pdf(compressed, packed):
    assert office.pdf_text(pdf(PAGES, compressed, packed=packed)) == TEXT


def test_pdf_with_a_character_map():
    cmap = b"begincmap 1 beginbfchar <0003> <65E5> endbfchar 1 beginbfrange <0041> <0043> <00660061> endbfrange"
    more = b"7 0 obj << /Length 1 >> stream\n" + cmap + b"\nendstream endobj\n"
    content = b"BT /F1 9 Tf <000300410043> Tj ET"
    assert office.pdf_text(pdf([content], font=b"<< /Type /Font /ToUnicode 7 0 R >>", more=more)) == "日fafc"


def test_replaced_objects_and_page_order():
    later = b"11 0 obj << /Length 9 >> stream\nBT (newer) Tj ET\nendstream endobj\n"
    assert office.pdf_text(pdf([b"BT (older) Tj ET", b"BT (second) Tj ET"], more=later)) == "newer\nsecond"


def test_files_as_rows(spark, tmp_path):
    whole = {
        "a.docx": docx(BODY), "b.PDF": pdf(PAGES), "c.txt": " plain é \n".encode(), "d.md": b"# head", "scan.pdf": pdf([b"q 1 0 0 1 0 0 cm /Im1 Do Q"]),
        "broken.docx": docx(BODY)[:-40], "bad.docx": docx("<w:document"), "other.docx": b"PK", "cut.pdf": pdf(PAGES)[:150], "none.pdf": b"nothing", "empty.txt": b"  ",
        "noend": b"x", "image.png": b"\x89PNG", "locked.pdf": pdf(PAGES, more=b"5 0 obj << >> endobj trailer << /Encrypt 9 0 R >>"),
    }
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for i, (name, data) in enumerate(whole.items()):
        (tmp_path / "in" / ("deep" if i % 2 else ".") / name).write_bytes(data)
    got = {r["file_name"]: r for r in office.load_files(spark, str(tmp_path / "in")).collect()}
    assert got.keys() == whole.keys()
    assert {n: r["text"] for n, r in got.items() if r["error"] is None} == {"a.docx": "One line\t& é日\nnext\n\ncell", "b.PDF": TEXT, "c.txt": "plain é", "d.md": "# head"}
    assert "scanned" in got["scan.pdf"]["error"] and "encrypted" in got["locked.pdf"]["error"] and "unsupported" in got["image.png"]["error"]
    assert all((r["text"] is None) == (r["error"] is not None) == (r["content_hash"] is None) for r in got.values())
    odd = spark.createDataFrame([("x.txt", None), (None, bytearray(b"y"))], "file_name string, content binary")
    assert office.texts_of_files(odd).where("error is null").count() == 0 and office.texts_of_files(odd.limit(0)).count() == 0
