"""CSV, XML, notebook, office and EPUB files to blocks, and what type a file has."""

from __future__ import annotations

import csv
import io
import json
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvial.sources.pages import items
from fluvial.sources.parsed import Rejected, block, parsed

# Bounds on XML depth and elements, on archives, and on all the outputs of a notebook.
XML_DEPTH, XML_ELEMENTS = 64, 100_000
MEMBERS, MEMBER_BYTES, ALL_BYTES, RATIO = 2_048, 20 << 20, 64 << 20, 100
OUTPUT_CHARS = 100_000
# Bytes of a file, bytes of a text file, and bytes at its start that tell its type.
FILE_BYTES, TEXT_BYTES, PREFIX_BYTES = 10 << 20, 5 << 20, 64 << 10
# The text type of each extension.
TEXT_TYPES = {
    "txt": "text", "log": "text", "md": "markdown", "markdown": "markdown", "rst": "rst", "org": "org", "tex": "latex", "latex": "latex", "yaml": "yaml", "yml": "yaml",
    "csv": "csv", "tsv": "tsv", "jsonl": "jsonl", "srt": "srt", "vtt": "vtt", "html": "html", "htm": "html", "xml": "xml", "py": "python", "js": "javascript", "ts": "typescript",
    "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "rs": "rust", "go": "go", "sql": "sql", "sh": "shell", "ps1": "powershell",
}
PACKED = {"docx": "word/document.xml", "pptx": "ppt/presentation.xml", "xlsx": "xl/workbook.xml", "epub": "META-INF/container.xml"}


def detect(files: DataFrame) -> DataFrame:
    """Add file_type and error to (path, length, content) of `binaryFile`, in the JVM.

    In turn: no or too many bytes, archive, PDF, a byte-order mark, control bytes, JSON, XML and HTML, then the
    extension. A type that an extension denies is an error.
    """
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    magic = F.hex(F.substring("content", 1, 4))
    start = F.expr(f"substring(content, 1, {PREFIX_BYTES})")
    latin = F.decode(start, "ISO-8859-1")
    bom = F.when(magic == "FFFE0000", "UTF-32LE").when(magic == "0000FEFF", "UTF-32BE").when(magic.startswith("EFBBBF"), "UTF-8").when(magic.startswith("FFFE"), "UTF-16LE").when(magic.startswith("FEFF"), "UTF-16BE")
    controls = F.regexp_count(latin, F.lit(r"[\x00-\x07\x0b\x0e-\x1f]"))
    binary = bom.isNull() & (latin.contains("\x00") | (controls > F.length(latin) * 0.05))
    text = F.ltrim(F.regexp_replace(F.when(bom == "UTF-16LE", F.decode(start, "UTF-16LE")).when(bom == "UTF-16BE", F.decode(start, "UTF-16BE")).otherwise(latin), "^(?:﻿|ï»¿)|(?<=^)[\\s]+", ""))
    whole = F.decode("content", "ISO-8859-1")
    texts = F.create_map(*(F.lit(x) for kv in TEXT_TYPES.items() for x in kv))
    packed = F.lit(None).cast("string")
    for kind, member in reversed(PACKED.items()):
        packed = F.when(whole.contains(member), kind).otherwise(packed)
    is_zip, is_pdf = magic.isin("504B0304", "504B0506", "504B0708"), latin.startswith("%PDF-")
    wanted = F.element_at(texts, ext)
    says_text = wanted.isNotNull() | ext.isin("json", "ipynb")
    json_like = text.rlike(r"\A\s*[\[{]") & ext.isin("json", "ipynb")
    notebook = json_like & text.contains('"cells"')
    root = F.lower(F.regexp_extract(text, r"\A\s*(?:<\?xml[^>]*\?>\s*)?(?:<!(?i:doctype)[^>]*>\s*)?<([A-Za-z_][A-Za-z0-9_.:-]*)", 1))
    needs_markup = ext.isin("json", "ipynb", "xml", "html", "htm", "xhtml")
    markup = (root != "") & (needs_markup | wanted.isNull())
    error = (
        F.when(F.col("length") == 0, "empty_file")
        .when(F.col("length") > FILE_BYTES, "file_too_large")
        .when((is_zip | is_pdf) & says_text, "risky_extension_mismatch")
        .when(is_zip & packed.isNull() & (ext != "zip"), "malformed_file")
        .when(is_zip & packed.isNotNull() & ext.isin(*PACKED) & (packed != ext), "risky_extension_mismatch")
        .when(~is_zip & ~is_pdf & ext.isin(*PACKED, "zip", "pdf"), "malformed_file")
        .when(~is_zip & ~is_pdf & binary, F.when(says_text, "binary_extension_mismatch").otherwise("unsupported_binary"))
        .when(~is_zip & ~is_pdf & needs_markup & ~json_like & ~markup, "malformed_file")
        .when(~is_zip & ~is_pdf & (F.col("length") > TEXT_BYTES), "file_too_large")
    )
    kind = (
        F.when(is_zip, F.coalesce(packed, F.lit("zip"))).when(is_pdf, "pdf").when(notebook & (ext == "ipynb"), "ipynb").when(json_like, "json")
        .when(markup & (root == "html"), "html").when(markup, F.when(ext.isin("html", "htm"), "html").otherwise("xml")).otherwise(F.coalesce(wanted, F.lit("text")))
    )
    return files.withColumn("error", error).withColumn("file_type", F.when(F.col("error").isNull(), kind)).withColumn("encoding", F.when(F.col("error").isNull() & ~is_zip & ~is_pdf, F.coalesce(bom, F.lit("UTF-8"))))


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _xml(data: str | bytes) -> ElementTree.Element:
    """The root of bounded XML without a document type or entities."""
    head = data if isinstance(data, str) else data.replace(b"\x00", b"").decode("latin-1")
    flat = "".join(head.split()).upper()
    if "<!DOCTYPE" in flat or "<!ENTITY" in flat:
        raise Rejected("xml_not_safe")
    depth = count = 0
    root = None
    try:
        for event, element in ElementTree.iterparse(io.BytesIO(data.encode() if isinstance(data, str) else data), ("start", "end")):
            root = element if root is None else root
            depth, count = (depth + 1, count + 1) if event == "start" else (depth - 1, count)
            if depth > XML_DEPTH or count > XML_ELEMENTS:
                raise Rejected("document_too_complex")
    except (ElementTree.ParseError, LookupError, UnicodeError):
        raise Rejected("malformed_file") from None
    return root


def xml_of(text: str) -> Iterator[dict]:
    """`path/@name = value` of attributes and `path = text` of elements, in document order; tails don't count."""

    def walk(element: ElementTree.Element, path: str) -> Iterator[tuple[str, str]]:
        for k, v in element.attrib.items():
            yield f"{path}/@{_name(k)} = {v}", path
        if (element.text or "").strip():
            yield f"{path} = {element.text.strip()}", path
        for child in element:
            yield from walk(child, f"{path}/{_name(child.tag)}")

    root = _xml(text)
    name = _name(root.tag)
    for at, (value, path) in enumerate(walk(root, "/" + name)):
        yield block(0, [name], at, "metadata", value, place=path[1:])


def _table(delimiter: str, text: str) -> Iterator[dict]:
    try:
        rows = list(csv.reader(text.splitlines(), delimiter=delimiter))
    except csv.Error:
        raise Rejected("malformed_file") from None
    if not any(v.strip() for row in rows for v in row):
        raise Rejected("empty_file")
    if len(rows) > 1:
        lines = ["\t".join(row) for row in rows]
        yield block(0, [lines[0]], 0, "table", "\n".join(lines), 1, len(rows))


def csv_of(text: str) -> Iterator[dict]:
    """One table, tab-joined; its first row is also the heading. A file of a header alone has no block."""
    return _table(",", text)


def tsv_of(text: str) -> Iterator[dict]:
    return _table("\t", text)


def notebook_of(text: str) -> Iterator[dict]:
    """A section per cell: code, paragraphs of other cells, streams as transcripts while all of them stay within OUTPUT_CHARS."""
    flat = lambda v: ("".join(map(str, v)) if isinstance(v, list) else v if isinstance(v, str) else "").strip()
    try:
        cells = json.loads(text)["cells"]
        kinds = [c.get("cell_type") for c in cells]
    except (ValueError, TypeError, KeyError, AttributeError):
        raise Rejected("malformed_file") from None
    at, left = 0, OUTPUT_CHARS
    for n, (cell, kind) in enumerate(zip(cells, kinds, strict=True)):
        found = [("code" if kind == "code" else "paragraph", flat(cell.get("source")))] if kind in ("markdown", "raw", "code") else []
        for out in cell.get("outputs", ()) if kind == "code" else ():
            stream = flat(out.get("text")) if isinstance(out, dict) and out.get("output_type") == "stream" else ""
            if len(stream) <= left:
                left -= len(stream)
                found.append(("transcript", stream))
        for block_kind, value in found:
            if value:
                yield block(n, [f"Cell {n + 1}"], at, block_kind, value, place=f"cell {n + 1}")
                at += 1


def _archive(content: bytes) -> zipfile.ZipFile:
    """An archive within all bounds, without encryption, links, unsafe or repeated names, or macros."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        raise Rejected("malformed_file") from None
    members = z.infolist()
    names = [m.filename.replace("\\", "/") for m in members]
    unsafe = any(n.startswith("/") or ".." in n.split("/") or n[1:2] == ":" for n in names) or len({n.casefold() for n in names}) < len(names)
    if unsafe or any(m.flag_bits & 1 or m.external_attr >> 28 == 0xA for m in members) or any("vbaproject" in n.casefold() for n in names):
        raise Rejected("archive_not_safe")
    large = any(m.file_size > MEMBER_BYTES or m.file_size > RATIO * max(m.compress_size, 1) for m in members)
    if large or len(members) > MEMBERS or sum(m.file_size for m in members) > ALL_BYTES:
        raise Rejected("archive_too_large")
    return z


def _member(z: zipfile.ZipFile, name: str) -> bytes:
    try:
        return z.read(name)
    except (KeyError, zipfile.BadZipFile, RuntimeError):
        raise Rejected("malformed_file") from None


_MARKS = {"tab": "\t", "br": "\n", "cr": "\n"}


def _text(element: ElementTree.Element) -> str:
    """All runs of an element, with its tabs and breaks."""
    return "".join(e.text or "" if _name(e.tag) == "t" else _MARKS.get(_name(e.tag), "") for e in element.iter()).strip()


def _children(element: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [e for e in element if _name(e.tag) == name]


def _find(element: ElementTree.Element, name: str) -> ElementTree.Element | None:
    return next((e for e in element.iter() if _name(e.tag) == name), None)


def _get(element: ElementTree.Element | None, name: str) -> str:
    return next((v for k, v in (element.attrib if element is not None else {}).items() if _name(k) == name), "")


def _rows(table: ElementTree.Element) -> str:
    rows = ([_text(c) for c in _children(r, "tc")] for r in _children(table, "tr"))
    return "\n".join("\t".join(r) for r in rows if r)


def docx_of(content: bytes) -> Iterator[dict]:
    """One section, named by its last heading: headings, numbered paragraphs as lists, paragraphs, tables."""
    body = _find(_xml(_member(_archive(content), PACKED["docx"])), "body")
    if body is None:
        raise Rejected("malformed_file")
    found = []
    for e in body:
        if _name(e.tag) == "tbl":
            found.append(("table", _rows(e)))
        elif _name(e.tag) == "p":
            heading = _get(_find(e, "pStyle"), "val").casefold().startswith("heading")
            found.append(("heading" if heading else "list" if _find(e, "numPr") is not None else "paragraph", _text(e)))
    path = [t for k, t in found if k == "heading" and t][-1:]
    for at, (kind, value) in enumerate(x for x in found if x[1]):
        yield block(0, path, at, kind, value, place=PACKED["docx"])


def _linked(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """The members that a part names, by relationship."""
    folder, name = posixpath.split(part)
    root = _xml(_member(z, f"{folder}/_rels/{name}.rels"))
    return {_get(e, "Id"): _get(e, "Target").lstrip("/") if _get(e, "Target").startswith("/") else posixpath.normpath(posixpath.join(folder, _get(e, "Target"))) for e in _children(root, "Relationship")}


def _id_of(element: ElementTree.Element) -> str:
    return next((v for k, v in element.attrib.items() if k.endswith("}id")), "")


def pptx_of(content: bytes) -> Iterator[dict]:
    """A section per slide: the first paragraph as its heading, the others as lists, tables last."""
    z, at = _archive(content), 0
    links = _linked(z, PACKED["pptx"])
    slides = [e for e in _xml(_member(z, PACKED["pptx"])).iter() if _name(e.tag) == "sldId"]
    for n, slide in enumerate(slides):
        root = _xml(_member(z, links.get(_id_of(slide), "")))
        tables = [e for e in root.iter() if _name(e.tag) == "tbl"]
        inside = {id(p) for t in tables for p in t.iter()}
        texts = [t for t in (_text(p) for p in root.iter() if _name(p.tag) == "p" and id(p) not in inside) if t]
        path = texts[:1] or [f"Slide {n + 1}"]
        for kind, value in [("list" if i else "heading", t) for i, t in enumerate(texts)] + [("table", v) for v in map(_rows, tables) if v]:
            yield block(n, path, at, kind, value, place=f"slide {n + 1}")
            at += 1


def xlsx_of(content: bytes) -> Iterator[dict]:
    """A section per visible sheet: its cells as a table, then each formula with its cached value; hidden sheets go."""
    z, at = _archive(content), 0
    links = _linked(z, PACKED["xlsx"])
    shared = [_text(e) for e in _children(_xml(_member(z, "xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in z.namelist() else []
    sheets = [e for e in _xml(_member(z, PACKED["xlsx"])).iter() if _name(e.tag) == "sheet" and _get(e, "state") not in ("hidden", "veryHidden")]
    for n, sheet in enumerate(sheets):
        rows, formulas, name = [], [], _get(sheet, "name")
        for row in (e for e in _xml(_member(z, links.get(_id_of(sheet), ""))).iter() if _name(e.tag) == "row"):
            values = []
            for cell in _children(row, "c"):
                raw = next((e.text or "" for e in _children(cell, "v")), "")
                try:
                    value = shared[int(raw)] if _get(cell, "t") == "s" else _text(cell) if _get(cell, "t") == "inlineStr" else raw
                except (ValueError, IndexError):
                    raise Rejected("malformed_file") from None
                values.append(value)
                formulas += [(_get(cell, "r"), f.text or "", value) for f in _children(cell, "f")]
            if any(values):
                rows.append("\t".join(values))
        cached = [("formula", f"={f} (cached: {v})" if v else f"={f}", r) for r, f, v in formulas]
        for kind, value, place in ([("table", "\n".join(rows), name)] if rows else []) + cached:
            yield block(n, [name], at, kind, value, place=place)
            at += 1


def epub_of(content: bytes) -> Iterator[dict]:
    """A section per chapter in reading order, named by its first heading; blocks as of pages."""
    z, at = _archive(content), 0
    if _member(z, "mimetype").strip() != b"application/epub+zip":
        raise Rejected("malformed_file")
    package = _get(_find(_xml(_member(z, PACKED["epub"])), "rootfile"), "full-path")
    book = _xml(_member(z, package))
    parts = {_get(e, "id"): posixpath.normpath(posixpath.join(posixpath.dirname(package), _get(e, "href"))) for e in book.iter() if _name(e.tag) == "item"}
    for n, ref in enumerate(e for e in book.iter() if _name(e.tag) == "itemref"):
        member = parts.get(_get(ref, "idref"), "")
        found = items(_member(z, member).decode("utf-8-sig", "replace"))
        path = [next((t for k, t, _, _ in found if k == "heading"), f"Chapter {n + 1}")]
        for kind, value, start, end in found:
            yield block(n, path, at, kind, value, start, end, place=member)
            at += 1


#: The parser of each type whose content is text, or bytes.
TEXTS = {"xml": xml_of, "csv": csv_of, "tsv": tsv_of, "ipynb": notebook_of}
BYTES = {"docx": docx_of, "pptx": pptx_of, "xlsx": xlsx_of, "epub": epub_of}


def blocks(rows: DataFrame, file_type: str, column: str, key: str = "doc_id") -> DataFrame:
    """Blocks of texts (xml, csv, tsv, ipynb) or of binary contents (docx, pptx, xlsx, epub)."""
    return parsed(rows, (TEXTS | BYTES)[file_type], column, key)
