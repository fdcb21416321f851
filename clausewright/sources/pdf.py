"""PDF files as pages: decoding, checks, and the route of pages without text to a vision model.

Decoding and recognition are functions that a caller may replace. The built-in decoder
reads the text of plain files (literal and hexadecimal strings in uncompressed or
deflated content streams, Latin text); pages that it finds no text on go to the
recogniser, one call a page, as scanned pages do.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.operators import segment

#: Pages of a file's bytes, as texts.
Decoder = Callable[[bytes], list[str]]
#: Text of a page, from the file's bytes and the page's number from one.
Recogniser = Callable[[bytes, int], str]
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"\((?:[^()\\]|\\.|\([^()]*\))*\)|<[0-9A-Fa-f\s]+>|\[|\]|T\*|Tj|TJ|Td|TD|ET|'|\"|-?\d+(?:\.\d+)?", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A kern of at least so many thousandths of an em between strings is a space.
KERN = 200


def _string(token: bytes) -> str:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1] < b"8" else b"" if m[1] in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    return raw.decode("utf-16") if raw.startswith((b"\xfe\xff", b"\xff\xfe")) else raw.decode("cp1252", "replace")


def _drawn(content: bytes) -> str:
    """Strings that a content stream shows; moves to another line are line breaks."""
    out: list[str] = []
    held: list[str] = []
    inside = False
    for m in _SHOWN.finditer(content):
        t = m[0]
        if t[:1] in (b"(", b"<"):
            held.append(_string(t))
        elif t in (b"[", b"]"):
            inside = t == b"["
        elif t in (b"Tj", b"TJ"):
            out += held
            held = []
        elif t in (b"'", b'"'):
            out += ["\n", *held]
            held = []
        elif t in (b"T*", b"Td", b"TD", b"ET"):
            out.append("\n")
        elif inside and held and t[:1] == b"-" and float(t) <= -KERN:
            held.append(" ")
    lines = [line.strip() for line in "".join(out).split("\n")]
    return "\n".join(line for line in lines if line)


def _content(body: bytes) -> bytes:
    m = _STREAM.search(body)
    if not m:
        return b""
    if b"FlateDecode" not in body[: m.start()]:
        return m[1]
    try:
        return zlib.decompressobj().decompress(m[1])
    except zlib.error:
        return b""


def page_texts(data: bytes) -> list[str]:
    """Texts of the pages in order; a file that is no PDF or holds no pages gives none."""
    objects = {int(n): body for n, body in _OBJECT.findall(data)}

    def kids(n: int, seen: frozenset[int]) -> Iterator[int]:
        body = objects.get(n, b"")
        listed = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        if listed is None or n in seen:
            if re.search(rb"/Type\s*/Page\b", body):
                yield n
            return
        for k in re.findall(rb"(\d+)\s+\d+\s+R", listed[1]):
            yield from kids(int(k), seen | {n})

    roots = [n for n, body in objects.items() if re.search(rb"/Type\s*/Pages\b", body) and b"/Parent" not in body]
    pages = [p for r in roots for p in kids(r, frozenset())] or [n for n, body in objects.items() if re.search(rb"/Type\s*/Page\b", body)]
    out = []
    for p in pages:
        m = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", objects[p], re.S)
        refs = re.findall(rb"(\d+)\s+\d+\s+R", m[1]) if m else []
        out.append("\n".join(t for r in refs if (t := _drawn(_content(objects.get(int(r), b""))))))
    return out


def checked(files: DataFrame, first: int = 3) -> DataFrame:
    """``(path, is_pdf, page_count, encrypted, has_text_layer, error)`` of a frame of (path, content).

    ``has_text_layer`` looks at the first pages only, as a sample. A file that does not
    start as a PDF, or has no pages, is an error; an encrypted one is told as such.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = content or b""
                is_pdf, encrypted = data[:4] == b"%PDF", b"/Encrypt" in data
                texts = page_texts(data) if is_pdf and not encrypted else []
                error = "not a PDF" if not is_pdf else "encrypted" if encrypted else None if texts else "no pages"
                rows.append((path, is_pdf, len(texts), encrypted, any(t.strip() for t in texts[:first]), error))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = (pa.string(), pa.bool_(), pa.int32(), pa.bool_(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["path", "is_pdf", "page_count", "encrypted", "has_text_layer", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, is_pdf boolean, page_count int, encrypted boolean, has_text_layer boolean, error string")


def _recognised(recognisers: tuple[Recogniser, ...], content: bytes, page: int) -> str | None:
    for read in recognisers:
        try:
            text = read(content, page)
        except Exception:  # the next one may do better, and the page stays as it is if none does
            continue
        if text and text.strip():
            return text
    return None


def pages(files: DataFrame, tender_id: str, *, decode: Decoder = page_texts, recognisers: tuple[Recogniser, ...] = (), strip_lines: bool = True) -> DataFrame:
    """Pages of a frame of (path, content): ``(doc_id, tender_id, page_number, text, char_count, has_text_layer, ocr_was_used)``.

    A page with too little text of its own goes to the recognisers in turn, until one finds any; one
    whose recognition fails or finds too little keeps what it had. A file that cannot be decoded has no pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    texts = decode(content or b"")
                except Exception:
                    texts = []
                for n, text in enumerate(texts, 1):
                    read = _recognised(recognisers, content, n) if len(text.strip()) < segment.MIN_CHARS else None
                    rows.append((path.rsplit("/", 1)[-1], n, text, read))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            types = (pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "page_number", "own", "read"])

    found = files.select("path", "content").mapInArrow(run, "doc_id string, page_number int, own string, read string")
    chosen = segment.choose_text(F.col("own"), F.col("read"), F.lit(None).cast("string"))
    text = segment.strip_page_lines(chosen["text"]) if strip_lines else chosen["text"]
    rows = found.select("doc_id", F.lit(tender_id).alias("tender_id"), "page_number", text.alias("text"), segment.has_text_layer(F.col("own")).alias("has_text_layer"), chosen["ocr_was_used"].alias("ocr_was_used"))
    return rows.withColumn("char_count", F.length("text"))
