"""Markdown from .docx, .xlsx and .pdf bytes, by the standard library; PDF needs an optional library."""

from __future__ import annotations

import io
import re
import zipfile
from collections import Counter
from collections.abc import Iterable
from xml.etree import ElementTree

from graphloom.functions.text import HEADING_RULES, SCRIPT_CASE, SCRIPT_CHAPTER, SCRIPT_ITEM

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def clean(text: str) -> str:
    text = text.translate({0x08: None, 0xFFFD: None, 0x3000: " "})
    for pattern, to in ((r"\.{4,}", "..."), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        text = re.sub(pattern, to, text)
    return text.strip()


def pipe_table(rows: Iterable[Iterable[object]]) -> str:
    """Ragged rows are padded, rows without content dropped."""
    kept = [r for r in ([clean("" if c is None else str(c)).replace("|", "\\|").replace("\n", "<br>") for c in row] for row in rows) if any(r)]
    if not kept:
        return ""
    width = max(map(len, kept))
    head, *body = [r + [""] * (width - len(r)) for r in kept]
    show = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([show(head), show(["---"] * width), *map(show, body or [[""] * width])])


def docx_markdown(data: bytes) -> str:
    """Paragraphs and tables in body order; heading styles 1 to 6 as marks."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{WORD}style"):
                name = s.find(f"{WORD}name")
                names[s.get(f"{WORD}styleId")] = name.get(f"{WORD}val") if name is not None else ""
    said = lambda e: "".join(t.text or "" if t.tag == f"{WORD}t" else "\t" if t.tag == f"{WORD}tab" else "\n" for t in e.iter() if t.tag in (f"{WORD}t", f"{WORD}tab", f"{WORD}br"))
    out = []
    for e in body if body is not None else ():
        if e.tag == f"{WORD}p":
            text = clean(said(e))
            style = e.find(f"{WORD}pPr/{WORD}pStyle")
            style = style.get(f"{WORD}val") if style is not None else ""
            level = re.search(r"(?:heading|标题)\s*([1-6])", names.get(style, style) or style, re.IGNORECASE)
            if text:
                out.append("#" * int(level[1]) + " " + text if level else text)
        elif e.tag == f"{WORD}tbl":
            table = pipe_table([[said(c) for c in row.iter(f"{WORD}tc")] for row in e.iter(f"{WORD}tr")])
            if table:
                out.append(table)
    return "\n\n".join(out)


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def xlsx_markdown(data: bytes) -> str:
    """A headed pipe table per sheet, with computed values; empty sheets are skipped."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")]
        links = {r.get("Id"): r.get("Target").removeprefix("/xl/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{SHEET}sheet"):
            rows = []
            for row in ElementTree.fromstring(z.read("xl/" + links[sheet.get(RELATION)])).iter(f"{SHEET}row"):
                cells: list[str] = []
                for c in row.iter(f"{SHEET}c"):
                    v = c.find(f"{SHEET}v")
                    value = v.text if v is not None else "".join(t.text or "" for t in c.iter(f"{SHEET}t"))
                    if c.get("t") == "s" and value:
                        value = shared[int(value)]
                    at = _column(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    cells[at] = value or ""
                rows.append(cells)
            table = pipe_table(rows)
            if table:
                out.append(f"## {sheet.get('name')}\n\n{table}")
    return "\n\n".join(out)


def _level(text: str, size: float, common: float, largest: float | None, bold: bool) -> int:
    for pattern, level in HEADING_RULES:
        if re.match(pattern, text):
            return level
    if len(text) > 60 or common <= 0:
        return 0
    if size >= common + 2.5:
        return 1 if largest is None or size >= largest - 0.2 else 2
    return 3 if size >= common + 1.2 or bold and size >= common + 0.5 else 0


def pdf_pages(data: bytes) -> list[dict]:
    """Height and text blocks (box, spans of text, size, font, flags) of each page."""
    try:
        import fitz
    except ImportError as e:
        raise ImportError("reading PDF needs the optional library PyMuPDF") from e
    spans = lambda b: [s for line in b.get("lines", ()) for s in line["spans"] if s["text"].strip()]
    return [{"height": page.rect.height, "blocks": [{"bbox": tuple(b["bbox"]), "spans": spans(b)} for b in page.get_text("dict")["blocks"] if b.get("type", 0) == 0]} for page in fitz.open(stream=data, filetype="pdf")]


def pdf_markdown(data: bytes) -> str:
    return layout(pdf_pages(data))


def _sizes(pages: list[dict], sample: int) -> list[float]:
    return sorted(round(s["size"], 1) for p in pages[:sample] for b in p["blocks"] for s in b["spans"])


def layout(pages: list[dict], margin: float = 45, sample: int = 40) -> str:
    """Page marker and blocks in reading order; headings by numbering and by fonts against the body's."""
    sizes = _sizes(pages, sample)
    common = sizes[(len(sizes) - 1) // 2] if sizes else 0.0
    heads = [s for s in sizes if s >= common + 1.0]
    out = []
    for number, page in enumerate(pages, 1):
        out.append(f"<!-- page: {number} -->")
        found = False
        for b in sorted(page["blocks"], key=lambda b: (round(b["bbox"][1], 1), round(b["bbox"][0], 1))):
            part = b["spans"]
            text = clean(" ".join(s["text"] for s in part))
            edge = b["bbox"][1] < margin or b["bbox"][3] > page["height"] - margin
            if not text or edge and len(text) < 24:
                continue
            level = _level(text, max(s["size"] for s in part), common, max(heads, default=None), any("bold" in s["font"].lower() or s["flags"] & 16 for s in part))
            out.append("#" * level + " " + text if level else text)
            found = True
        if not found:
            out.append("> no extractable text on this page")
    return "\n\n".join(out)


def layout_script(pages: list[dict], margin: float = 50, sample: int = 20) -> str:
    """The batch script's variant: the commonest size is the body's, case studies are marked, no page markers."""
    sizes = _sizes(pages, sample)
    if not sizes:
        return ""
    common = Counter(sizes).most_common(1)[0][0]
    above = sorted({s for s in sizes if s > common}, reverse=True)
    out = []
    for page in pages:
        for b in sorted(page["blocks"], key=lambda b: (b["bbox"][1], b["bbox"][0])):
            text = re.sub(r"\.{4,}", "...", " ".join(s["text"].strip() for s in b["spans"]).replace("\x08", "").replace("�", "")).strip()
            if not text:
                continue
            size = round(b["spans"][-1]["size"], 1)
            font = 0 if size <= common + 1 else 1 if size >= above[0] else 2 if size >= (above[1] if len(above) > 1 else size) else 3
            numbered = 1 if re.match(SCRIPT_CHAPTER, text) else 3 if re.match(SCRIPT_ITEM, text) else None
            if numbered or SCRIPT_CASE not in text and font:
                out.append(f"\n{'#' * (numbered or font)} {text}\n")
            elif SCRIPT_CASE in text:
                out.append(f"\n### 💡 {text}\n")
            elif not ((b["bbox"][1] < margin or b["bbox"][3] > page["height"] - margin) and len(text) < 20):
                out.append(text)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out))
