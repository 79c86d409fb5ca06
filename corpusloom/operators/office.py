"""Office formats by the standard library: Word, PowerPoint and Excel files are zipped XML. PDF is left out (no reader here)."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

from corpusloom.operators.blocks import HEADING, PARAGRAPH, TABLE, Parsed, block, register

#: Rows of a table that are kept, and bytes that a file may unpack to.
TABLE_ROWS, UNPACKED = 2000, 200 << 20
TYPES = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}


class _Package:
    """The XML parts of a file; a part with a document type is refused, so no entity expands."""

    def __init__(self, data: bytes) -> None:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise ValueError(str(e)) from e
        if sum(i.file_size for i in self.zip.infolist()) > UNPACKED:
            raise ValueError("the file unpacks to too much")
        self.names = set(self.zip.namelist())

    def part(self, name: str) -> ET.Element | None:
        if name not in self.names:
            return None
        data = self.zip.read(name)
        if b"<!DOCTYPE" in data[:4096]:
            raise ValueError("a part must not declare a document type")
        try:
            return ET.fromstring(data)
        except ET.ParseError as e:
            raise ValueError(f"{name}: {e}") from e

    def numbered(self, pattern: str) -> list[str]:
        """Parts of a name with a number, by it."""
        found = [(int(m[1]), n) for n in self.names if (m := re.fullmatch(pattern, n))]
        return [n for _, n in sorted(found)]

    def title(self) -> str:
        core = self.part("docProps/core.xml")
        return next(((e.text or "").strip() for e in core or () if _name(e) == "title"), "") if core is not None else ""


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attribute(e: ET.Element, name: str) -> str:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), "")


def _each(e: ET.Element, name: str) -> Iterator[ET.Element]:
    return (c for c in e.iter() if _name(c) == name)


def _child(e: ET.Element, name: str) -> ET.Element | None:
    return next((c for c in e if _name(c) == name), None)


def _text(e: ET.Element) -> str:
    marks = {"tab": "\t", "br": "\n", "cr": "\n"}
    return "".join((c.text or "") if _name(c) == "t" else marks.get(_name(c), "") for c in e.iter()).strip()


def _table(rows: list[list[str]]) -> Iterator[dict]:
    rows = [r for r in rows if any(r)][: TABLE_ROWS + 1]
    if rows:
        yield block(TABLE, rows=rows)


def _first_heading(blocks: list[dict]) -> str:
    return next((b["text"] for b in blocks if b["type"] == HEADING), "")


def parse_docx(data: bytes) -> Parsed:
    """Paragraphs by their styles, and tables, in the order of the body."""
    package = _Package(data)
    document = package.part("word/document.xml")
    if document is None:
        raise ValueError("there is no document part")
    styles = {}
    if (part := package.part("word/styles.xml")) is not None:
        for s in _each(part, "style"):
            if (named := _child(s, "name")) is not None:
                styles[_attribute(s, "styleId")] = _attribute(named, "val").lower()
    title, out = package.title(), []
    body = next(_each(document, "body"), document)
    for e in body:
        if _name(e) == "tbl":
            out += _table([[_text(c) for c in row if _name(c) == "tc"] for row in e if _name(row) == "tr"])
        elif _name(e) == "p" and (text := _text(e)):
            style = next((_attribute(s, "val") for s in _each(e, "pStyle")), "")
            name = styles.get(style, style.lower())
            m = re.fullmatch(r"heading ?(\d+)", name)
            level = 1 if name == "title" else min(6, max(1, int(m[1]))) if m else 0
            out.append(block(HEADING, text, level) if level else block(PARAGRAPH, text))
            title = title or (text if level == 1 else "")
    return title or _first_heading(out), out


def parse_pptx(data: bytes) -> Parsed:
    """Each slide's title, then its texts and tables."""
    package = _Package(data)
    title, out = "", []
    for name in package.numbered(r"ppt/slides/slide(\d+)\.xml"):
        slide = package.part(name)
        shapes = [s for s in slide.iter() if _name(s) in ("sp", "graphicFrame")]
        heads = [s for s in shapes if any(_attribute(p, "type") in ("title", "ctrTitle") for p in _each(s, "ph"))][:1]
        for s in heads:
            if text := " ".join(filter(None, map(_text, _each(s, "p")))):
                out.append(block(HEADING, text, 1))
                title = title or text
        for s in shapes:
            if s in heads:
                continue
            if (table := next(_each(s, "tbl"), None)) is not None:
                out += _table([[_text(c) for c in row if _name(c) == "tc"] for row in table if _name(row) == "tr"])
            else:
                out += [block(PARAGRAPH, t) for t in map(_text, _each(s, "p")) if t]
    return title, out


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def parse_xlsx(data: bytes) -> Parsed:
    """Each sheet with cells as a heading and a table, stored values."""
    package = _Package(data)
    book = package.part("xl/workbook.xml")
    if book is None:
        raise ValueError("there is no workbook part")
    shared_part = package.part("xl/sharedStrings.xml")
    shared = [_text(s) for s in shared_part if _name(s) == "si"] if shared_part is not None else []
    links = package.part("xl/_rels/workbook.xml.rels")
    targets = {_attribute(r, "Id"): _attribute(r, "Target") for r in links} if links is not None else {}
    out = []
    for sheet in _each(book, "sheet"):
        target = targets.get(next((v for k, v in sheet.attrib.items() if k.endswith("}id")), ""), "")
        part = package.part(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
        rows = []
        for row in _each(part, "row") if part is not None else ():
            cells: list[str] = []
            for c in (c for c in row if _name(c) == "c"):
                at = _column(_attribute(c, "r")) if _attribute(c, "r") else len(cells)
                value = next(((v.text or "").strip() for v in c if _name(v) == "v"), "")
                kind = _attribute(c, "t")
                if kind == "s" and value.isdigit() and int(value) < len(shared):
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = _text(c)
                elif kind == "b":
                    value = {"1": "True", "0": "False"}.get(value, value)
                cells += [""] * (at + 1 - len(cells))
                cells[at] = value
            rows.append(cells)
        if found := list(_table(rows)):
            out += [block(HEADING, _attribute(sheet, "name"), 2), *found]
    return "", out


def register_all() -> None:
    """Make the formats known to ``blocks.parse``."""
    for kind, parser in (("docx", parse_docx), ("pptx", parse_pptx), ("xlsx", parse_xlsx)):
        register(TYPES[kind], parser)
