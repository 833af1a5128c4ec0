"""Minimal .xlsx cell reader (stdlib zip + XML), run inside tasks by ``mapInPandas``.

Each workbook is parsed where its bytes are; a directory of many workbooks spreads over
many tasks. Output is long: (_file, _sheet, row_no, col_no, value) with 1-based rows and
columns and every value as text.
"""

from __future__ import annotations

import io
import re
import zipfile
from typing import Iterator
from xml.etree import ElementTree as ET

import pandas as pd

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "rel": "http://schemas.openxmlformats.org/package/2006/relationships"}
_REF = re.compile(r"([A-Z]+)(\d+)")


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n


def sheet_names(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as zf:
        book = ET.fromstring(zf.read("xl/workbook.xml"))
    return [s.get("name") for s in book.find("m:sheets", _NS)]


def _cells(content: bytes, wanted: str | None):
    with zipfile.ZipFile(io.BytesIO(content)) as zf:
        names = set(zf.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for si in ET.fromstring(zf.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(zf.read("xl/_rels/workbook.xml.rels"))}
        book = ET.fromstring(zf.read("xl/workbook.xml"))
        sheets = [(s.get("name"), s.get(f"{{{_NS['r']}}}id")) for s in book.find("m:sheets", _NS)]
        if wanted is None:
            sheets = sheets[:1]
        else:
            sheets = [s for s in sheets if s[0] == wanted]
        for name, rid in sheets:
            target = rels[rid].lstrip("/")
            target = target if target.startswith("xl/") else f"xl/{target}"
            root = ET.fromstring(zf.read(target))
            for c in root.iter(f"{{{_NS['m']}}}c"):
                m = _REF.fullmatch(c.get("r", ""))
                if not m:
                    continue
                kind = c.get("t")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                else:
                    v = c.find("m:v", _NS)
                    value = None if v is None else v.text
                    if kind == "s" and value is not None:
                        value = shared[int(value)]
                yield name, int(m.group(2)), _col_index(m.group(1)), value


def parse_workbooks(batches: Iterator[pd.DataFrame], sheet: str | None) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            for name, row, col, value in _cells(bytes(content), sheet):
                out.append((path, name, row, col, value))
        yield pd.DataFrame(out, columns=["_file", "_sheet", "row_no", "col_no", "value"])
