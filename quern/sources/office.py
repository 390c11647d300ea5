"""Text of docx and pdf files, and files that cannot be read as rows with an error.

Files are rows (file_name, content), as Spark's binaryFile source gives them; a task reads its own, batch by batch.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: A larger document part is not unpacked: a file of a few bytes could ask for any amount of memory.
MOST_BYTES = 1 << 28
#: In a TJ array, a step of so many thousandths of the font's size stands for a space between words.
GAP = 200

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")
_REF = rb"(\d+)\s+\d+\s+R\b"
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()]+|[-+]?\d*\.?\d+|\[|\]|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


def docx_text(content: bytes) -> str:
    """Paragraphs of the document part, parted by empty lines; tabs and breaks as such."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if z.getinfo("word/document.xml").file_size > MOST_BYTES:
            raise ValueError("the document part is too large")
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for paragraph in root.iter(WORD + "p"):
        for x in paragraph.iter():
            out.append({WORD + "t": x.text or "", WORD + "tab": "\t", WORD + "br": "\n"}.get(x.tag, ""))
        out.append("\n\n")
    return "".join(out)


def docx_of(text: str) -> bytes:
    """A docx file of a text, a paragraph a line; characters that XML does not allow are left out."""
    lines = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", text).split("\n")
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines).replace("\r", "&#13;")
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{WORD[1:-1]}"><w:body>{body}</w:body></w:document>')
    return made.getvalue()


class Pdf:
    """Objects of a pdf file by number, as (dictionary, stream); later ones replace earlier ones of their number."""

    def __init__(self, content: bytes):
        if not content.lstrip()[:5] == b"%PDF-":
            raise ValueError("not a pdf file")
        if re.search(rb"/Encrypt\s+\d", content):
            raise ValueError("the file is encrypted")
        self.objects: dict[int, tuple[bytes, bytes]] = {}
        starts = list(_OBJECT.finditer(content))
        for m, after in zip(starts, [*(x.start() for x in starts[1:]), len(content)]):
            body = content[m.end() : after]
            head, found, rest = body.partition(b"stream")
            data = rest.removeprefix(b"\r").removeprefix(b"\n").rpartition(b"endstream")[0] if found and b"endstream" in rest else b""
            self.objects[int(m[1])] = (head, data)
        for head, _ in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm", head):
                self._unpack(head)

    def _unpack(self, head: bytes) -> None:
        """Objects inside an object stream."""
        data = next(self.stream(n) for n, o in self.objects.items() if o[0] is head)
        first, count = (int(re.search(rb"/%s\s+(\d+)" % k, head)[1]) for k in (b"First", b"N"))
        places = [int(x) for x in data[:first].split()[: 2 * count]]
        ends = [*places[3::2], len(data) - first]
        for number, at, end in zip(places[::2], places[1::2], ends):
            self.objects.setdefault(number, (data[first + at : first + end], b""))

    def stream(self, number: int) -> bytes:
        head, data = self.objects.get(number, (b"", b""))
        if b"/FlateDecode" in head:
            made = zlib.decompressobj()
            data = made.decompress(data, MOST_BYTES)
            if made.unconsumed_tail:
                raise ValueError("a stream is too large")
        return data

    def refs(self, head: bytes, name: bytes) -> list[int]:
        """Numbers of the objects that an entry names: one, or those of an array."""
        m = re.search(rb"/" + name + rb"\s*(?:" + _REF + rb"|\[([^\]]*)\])", head)
        return [] if not m else [int(m[1])] if m[1] else [int(x) for x in re.findall(_REF, m[2])]

    def pages(self) -> Iterator[bytes]:
        """Dictionaries of pages in the order of the page tree; in that of the file if there is none."""
        roots = [n for n, (h, _) in self.objects.items() if re.search(rb"/Type\s*/Pages\b", h) and b"/Parent" not in h]
        seen, todo = set(), roots[::-1]
        while todo:
            number = todo.pop()
            head = self.objects.get(number, (b"", b""))[0]
            if number in seen:
                continue
            seen.add(number)
            if re.search(rb"/Type\s*/Page\b", head):
                yield head
            todo += self.refs(head, b"Kids")[::-1]
        if not roots:
            yield from (h for h, _ in self.objects.values() if re.search(rb"/Type\s*/Page\b", h))

    def fonts(self, page: bytes) -> dict[bytes, dict[bytes, str]]:
        """Font name -> map of its codes to characters, of the page's fonts that have one."""
        resources = b" ".join([page, *(self.objects.get(n, (b"", b""))[0] for n in self.refs(page, b"Resources"))])
        resources = b" ".join([resources, *(self.objects.get(n, (b"", b""))[0] for n in self.refs(resources, b"Font"))])
        found = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+" + _REF, resources):
            head = self.objects.get(int(number), (b"", b""))[0]
            for ref in self.refs(head, b"ToUnicode"):
                found[b"/" + name] = to_unicode(self.stream(ref))
        return found


def to_unicode(cmap: bytes) -> dict[bytes, str]:
    """Codes of a font's character map with the text each stands for."""
    found: dict[bytes, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        found |= {bytes.fromhex(a.decode()): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            first, base = int(a, 16), text(c)
            for i in range(min(int(b, 16) - first + 1, 1 << 16)):
                found[(first + i).to_bytes(len(a) // 2, "big")] = base[:-1] + chr(ord(base[-1]) + i)
    return found


def _string(token: bytes, codes: dict[bytes, str] | None) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        data = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPED.get(m[1], m[1]), token[1:-1])
    if codes:
        width = len(next(iter(codes)))
        return "".join(codes.get(data[i : i + width], "") for i in range(0, len(data), width))
    return data.decode("cp1252", "replace")


def shown_text(content: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    """What a content stream shows, in its order: moves to another line begin a line, moves within one a space."""
    out: list[str] = []
    stack: list[bytes] = []
    codes, line = None, None
    for token in _TOKEN.findall(content):
        if token[:1] in b"(</[]" or re.fullmatch(rb"[-+]?\d*\.?\d+", token):
            stack.append(token)
            continue
        if token == b"Tf":
            codes = fonts.get(next((x for x in stack if x[:1] == b"/"), b""))
        elif token in (b"Tj", b"'", b'"') and stack:
            out += ["\n"] * (token != b"Tj") + [_string(stack[-1], codes)]
        elif token == b"TJ":
            for x in stack:
                if x[:1] in b"(<":
                    out.append(_string(x, codes))
                elif x[:1] not in b"[]/" and float(x) < -GAP:
                    out.append(" ")
        elif token in (b"Td", b"TD", b"Tm") and len(stack) >= 2:
            at = float(stack[-1]) if stack[-1] not in (b"[", b"]") else 0.0
            moved = at != 0 if token != b"Tm" else at != line
            line = at if token == b"Tm" else line
            out.append("\n" if moved else " ")
        elif token in (b"T*", b"BT"):
            out.append("\n")
        stack = []
    return "".join(out)


def pdf_text(content: bytes) -> str:
    """Text of all pages, one after another. A file of pages that show no text is an error: it is a scan."""
    pdf, pages = Pdf(content), []
    for page in pdf.pages():
        data = b"\n".join(pdf.stream(n) for n in pdf.refs(page, b"Contents"))
        lines = (re.sub(r"[ \t]+", " ", x).strip() for x in shown_text(data, pdf.fonts(page)).split("\n"))
        pages.append("\n".join(x for x in lines if x))
    text = "\n".join(x for x in pages if x)
    if not text.strip():
        raise ValueError("no text: the file looks scanned or holds images alone")
    return text


def plain_text(content: bytes) -> str:
    return content.decode("utf-8", "replace")


#: What reads a file, by its extension.
READERS = {"txt": plain_text, "md": plain_text, "docx": docx_text, "pdf": pdf_text}


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        texts: list[str | None] = []
        errors: list[str | None] = []
        for name, content in zip(f["file_name"], f["content"]):
            text, error = None, None
            try:
                read = READERS.get(name.rpartition(".")[2].lower() if "." in name else "")
                text = read(content or b"").strip() if read else None
                error = "unsupported kind of file" if read is None else None if text else "no text"
            except (ValueError, KeyError, zipfile.BadZipFile, zlib.error, ElementTree.ParseError, IndexError, TypeError) as e:
                error = f"{type(e).__name__}: {e}"
            texts.append(text or None)
            errors.append(error)
        yield pd.DataFrame({"file_name": f["file_name"], "text": texts, "error": errors})


def texts_of_files(contents: DataFrame) -> DataFrame:
    """file_name, content_hash, text, error of rows (file_name, content). Of text and error one is null; a broken file, a scan
    and a kind that cannot be read are rows like any other, so one of them does not end a batch."""
    rows = contents.select(F.coalesce("file_name", F.lit("")).alias("file_name"), "content")
    made = rows.mapInPandas(_read, "file_name string, text string, error string")
    return made.select("file_name", F.sha2("text", 256).alias("content_hash"), "text", "error")


def load_files(spark: SparkSession, path: str) -> DataFrame:
    """texts_of_files of all files under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return texts_of_files(files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("file_name"), "content"))
