"""Word, spreadsheet and slide scans: the packages are read as zipped XML, without further libraries."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

BLOCKS = "path string, page int, order int, block_type string, title string, text string"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(node: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == "t").strip()


def _grid(table: ElementTree.Element) -> str:
    rows = []
    for row in (x for x in table if _local(x.tag) == "tr"):
        cells = [" ".join(filter(None, (_texts(p) for p in cell.iter() if _local(p.tag) == "p"))) for cell in row if _local(cell.tag) == "tc"]
        if any(cells):
            rows.append(" | ".join(cells))
    return "\n".join(rows)


def word_blocks(content: bytes) -> list[tuple]:
    """Paragraphs, headings and tables in layout order; a table takes the latest heading as title."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = next(x for x in ElementTree.fromstring(archive.read("word/document.xml")) if _local(x.tag) == "body")
    out, heading = [], "DOCX Content"
    for node in body:
        if _local(node.tag) == "tbl":
            if text := _grid(node):
                out.append((1, len(out), "table", heading, text))
        elif _local(node.tag) == "p" and (text := _texts(node)):
            style = next((v for x in node.iter() if _local(x.tag) == "pStyle" for k, v in x.attrib.items() if _local(k) == "val"), "")
            if style.lower().startswith("heading"):
                heading = text
                out.append((1, len(out), "heading", heading, text))
            else:
                out.append((1, len(out), "paragraph", heading, text))
    return out


def slide_blocks(content: bytes) -> list[tuple]:
    """Titles, texts, tables and speaker notes per slide."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = sorted((int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for page, name in names:
            root = ElementTree.fromstring(archive.read(name))
            shapes = [(any(_local(x.tag) == "ph" and x.attrib.get("type") in ("title", "ctrTitle") for x in s.iter()), _texts(s)) for s in root.iter() if _local(s.tag) == "sp"]
            lines = [t for _, t in shapes if t]
            title = next((t for is_title, t in shapes if is_title and t), lines[0] if lines else f"Slide {page}")
            out.append((page, len(out), "heading", title, title))
            out += [(page, len(out) + i, "paragraph", title, t) for i, t in enumerate(t for t in lines if t != title)]
            for table in (x for x in root.iter() if _local(x.tag) == "tbl"):
                if text := _grid(table):
                    out.append((page, len(out), "table", title, text))
            notes = f"ppt/notesSlides/notesSlide{page}.xml"
            if notes in archive.namelist() and (text := _texts(ElementTree.fromstring(archive.read(notes)))):
                out.append((page, len(out), "paragraph", title, f"Speaker Notes: {text}"))
    return out


def sheet_blocks(content: bytes) -> list[tuple]:
    """Runs of rows between blank rows per sheet; small blocks without numbers are headings."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared = [_texts(x) for x in ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in archive.namelist() else []
        book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        links = {x.attrib["Id"]: x.attrib["Target"] for x in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        sheets = [x for x in book.iter() if _local(x.tag) == "sheet"]
        for page, sheet in enumerate(sheets, 1):
            target = links[next(v for k, v in sheet.attrib.items() if _local(k) == "id" and v in links)]
            path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
            block: list[list[str]] = []
            heading = sheet.attrib.get("name", f"Sheet {page}")

            def flush() -> None:
                nonlocal block, heading
                cells = [c for row in block for c in row if c]
                if cells:
                    numeric = sum(re.fullmatch(r"-?[\d,]+(\.\d+)?%?", c) is not None for c in cells)
                    text = "\n".join(" | ".join(row) for row in block)
                    if len(block) <= 2 and len(cells) <= 3 and len(text) <= 120 and numeric < 2:
                        heading = " ".join(cells)
                        out.append((page, len(out), "heading", heading, heading))
                    else:
                        out.append((page, len(out), "table", heading, text))
                block = []

            last = 0
            for row in (x for x in ElementTree.fromstring(archive.read(path)).iter() if _local(x.tag) == "row"):
                number = int(row.attrib.get("r", last + 1))
                values = []
                for cell in row:
                    at = sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(re.sub(r"\d", "", cell.attrib.get("r", ""))))) or len(values) + 1
                    raw = next((x.text or "" for x in cell if _local(x.tag) == "v"), _texts(cell))
                    text = shared[int(raw)] if cell.attrib.get("t") == "s" and raw else raw
                    values += [""] * (at - 1 - len(values)) + [re.sub(r"^(-?\d+)\.0+$", r"\1", text.strip())]
                while values and not values[-1]:
                    values.pop()
                if number > last + 1 or not values:
                    flush()
                if values:
                    block.append(values)
                last = number
            flush()
    return out


PARSERS: dict[str, Callable[[bytes], list[tuple]]] = {"docx": word_blocks, "pptx": slide_blocks, "xlsx": sheet_blocks, "xlsm": sheet_blocks}


def office_blocks(files: DataFrame) -> DataFrame:
    """Blocks of ``binaryFile`` rows ``(path, content)``; a broken package gives one ``error`` block."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                parser = PARSERS.get(path.rsplit(".", 1)[-1].lower())
                if parser is None:
                    continue
                try:
                    out += [(path, *block) for block in parser(content)]
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError) as error:
                    out.append((path, 0, 0, "error", None, type(error).__name__))
            yield pd.DataFrame(out, columns=["path", "page", "order", "block_type", "title", "text"])

    return files.select("path", "content").mapInPandas(scan, BLOCKS)
