"""Text of archive members and office documents, read inside Spark tasks."""

from __future__ import annotations

import io
import sys
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# Executors get these functions with the task, whether or not the package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A row of text cannot outgrow what one Spark value holds; what does is reported as an error row.
MAX_MEMBER_BYTES = 1 << 30
MAX_DEPTH = 100
#: Parts are handed back to Spark in batches of about this size.
BATCH_ROWS = 1000
BATCH_CHARS = 8 << 20

EXTRACT_SCHEMA = "path string, member_path string, text string, error string"

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

# File endings per kind, compared without regard to case, first kind wins.
KINDS: dict[str, tuple[str, ...]] = {
    "image": (".png", ".jpg", ".jpeg", ".gif", ".bmp"),
    "pdf": (".pdf",),
    "office": (".docx", ".xlsx", ".pptx"),
    "video": (".mp4", ".avi", ".mov", ".mkv"),
    "archive": (".zip", ".rar", ".tar", ".tar.gz"),
}
_UNREAD = (*KINDS["image"], *KINDS["pdf"], *KINDS["video"], ".rar", ".pptx")


def extract(files: DataFrame) -> DataFrame:
    """``(path, content)`` to one row per readable part: ``path, member_path, text, error``.

    A part that cannot be read gives an error row and the scan goes on. Members are read one at a time.
    """
    return files.select("path", "content").mapInPandas(_extract_batches, EXTRACT_SCHEMA)


def _extract_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "member_path", "text", "error"]
    rows, chars = [], 0
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            for member, text, error in _parts(path, bytes(content), None, 0):
                rows.append((path, member, text, error))
                chars += len(text or "")
                if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, chars = [], 0
    yield pd.DataFrame(rows, columns=columns)


def _parts(name: str, content: bytes, member: str | None, depth: int) -> Iterator[tuple]:
    low = name.lower()
    try:
        if low.endswith(_UNREAD):
            yield member, None, "no text reader for this kind of file"
        elif low.endswith((".zip", ".tar", ".tar.gz")):
            if depth >= MAX_DEPTH:
                yield member, None, f"nested deeper than {MAX_DEPTH} archives"
                return
            for inner, size, read in _members(low, content):
                inner_path = inner if member is None else f"{member}/{inner}"
                if size > MAX_MEMBER_BYTES:
                    yield inner_path, None, f"member larger than {MAX_MEMBER_BYTES} bytes"
                    continue
                try:
                    data = read()
                except Exception as e:
                    yield inner_path, None, str(e) or type(e).__name__
                    continue
                yield from _parts(inner, data, inner_path, depth + 1)
        elif low.endswith(".docx"):
            yield member, _docx(content), None
        elif low.endswith(".xlsx"):
            yield member, _xlsx(content), None
        else:
            yield member, content.decode("utf-8", errors="replace"), None
    except Exception as e:  # an unreadable file is a row, not a failed job
        yield member, None, str(e) or type(e).__name__


def _members(low: str, content: bytes) -> Iterator[tuple]:
    if low.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield info.filename, info.file_size, lambda info=info: z.read(info)
    else:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz" if low.endswith(".gz") else "r:") as t:
            for info in t:
                if info.isfile():
                    yield info.name, info.size, lambda info=info: t.extractfile(info).read()


def _docx(content: bytes) -> str:
    """Body paragraphs, one per line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    marks = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}
    lines = []
    for p in body.findall(f"{_WORD}p"):
        lines.append("".join(e.text or "" if e.tag == f"{_WORD}t" else marks.get(e.tag, "") for e in p.iter()))
    return "".join(line + "\n" for line in lines)


def _xlsx(content: bytes) -> str:
    """Every filled cell of every sheet, one per line, in sheet and row order."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_SHEET}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_SHEET}t")))
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
            target = targets[sheet.get(_LINK)]
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            for c in ET.fromstring(z.read(part)).iter(f"{_SHEET}c"):
                value = _cell(c, shared)
                if value:
                    out.append(value + "\n")
    return "".join(out)


def _cell(c: ET.Element, shared: list[str]) -> str:
    kind, formula, v = c.get("t"), c.find(f"{_SHEET}f"), c.find(f"{_SHEET}v")
    if formula is not None and formula.text:
        return "=" + formula.text
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
    if v is None or v.text is None:
        return ""
    if kind == "s":
        return shared[int(v.text)]
    return {"1": "True", "0": "False"}.get(v.text, v.text) if kind == "b" else v.text
