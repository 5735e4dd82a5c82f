"""Minimal .xlsx sheet decoder and writer (standard library only), used inside tasks.

The decoder yields (row_num, cells) for the non-empty rows of one worksheet, one
row at a time; cells are strings (numbers as Python prints them, date-formatted
numbers as 'YYYY-MM-DD HH:MM:SS').
"""

from __future__ import annotations

import datetime as _dt
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice
from xml.sax.saxutils import escape, unescape

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_P = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_BUILTIN_DATE_FORMATS = set(range(14, 23)) | {45, 46, 47}
# Day 0 of the two date systems a workbook may use.
_EPOCHS = {False: _dt.datetime(1899, 12, 30), True: _dt.datetime(1904, 1, 1)}


def _col_index(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group(0):
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _text(element) -> str:
    """Text of a string item; phonetic guides (rPh) are not part of it."""
    return "".join(t.text or "" for child in element if child.tag != f"{_M}rPh" for t in child.iter(f"{_M}t"))


def _elements(z: zipfile.ZipFile, name: str, tag: str) -> Iterator[ET.Element]:
    """Completed elements of a part in order; each is released after use."""
    with z.open(name) as part:
        root = None
        for event, element in ET.iterparse(part, events=("start", "end")):
            if root is None:
                root = element
            if event == "end" and element.tag == tag:
                yield element
                element.clear()
                if tag != f"{_M}row":
                    root.clear()


def _shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return [_text(item) for item in _elements(z, "xl/sharedStrings.xml", f"{_M}si")]


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    custom = {}
    for f in root.iterfind(f"{_M}numFmts/{_M}numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower()
        custom[int(f.get("numFmtId"))] = bool(re.search(r"[ymdhs]", code))
    formats = [int(xf.get("numFmtId", "0")) for xf in root.iterfind(f"{_M}cellXfs/{_M}xf")]
    return {i for i, f in enumerate(formats) if f in _BUILTIN_DATE_FORMATS or custom.get(f)}


def _workbook(z: zipfile.ZipFile, sheet: int | str) -> tuple[str, _dt.datetime]:
    """(part of the sheet, given by position or name; day 0 of the workbook's dates)."""
    book = ET.fromstring(z.read("xl/workbook.xml"))
    sheets = book.findall(f"{_M}sheets/{_M}sheet")
    names = [s.get("name") for s in sheets]
    if isinstance(sheet, str):
        if sheet not in names:
            raise ValueError(f"sheet {sheet!r} not found; the workbook has: {', '.join(names)}")
        sheet = names.index(sheet)
    elif not 0 <= sheet < len(names):
        raise ValueError(f"sheet {sheet} not found; the workbook has: {', '.join(names)}")
    properties = book.find(f"{_M}workbookPr")
    since_1904 = properties is not None and properties.get("date1904") in ("1", "true")
    rid = sheets[sheet].get(f"{_R}id")
    for rel in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).iterfind(f"{_P}Relationship"):
        if rel.get("Id") == rid:
            target = rel.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}", _EPOCHS[since_1904]
    raise ValueError(f"the workbook does not say where sheet {names[sheet]!r} is")


def _number_text(v: str) -> str:
    f = float(v)
    return str(int(f)) if f.is_integer() and "." not in v and "E" not in v.upper() else repr(f)


def _cell_text(c: ET.Element, strings: list[str], dates: set[int], epoch: _dt.datetime) -> str | None:
    if c.get("t") == "inlineStr":
        item = c.find(f"{_M}is")
        return "" if item is None else _text(item)
    v = c.find(f"{_M}v")
    return None if v is None or v.text is None else _value_text(c, v.text, strings, dates, epoch)


def _value_text(attrs, v: str, strings: list[str], dates: set[int], epoch: _dt.datetime) -> str:
    """Text of a cell that holds a value, from its attributes."""
    kind = attrs.get("t", "n")
    if kind == "s":
        return strings[int(v)]
    if kind == "b":
        return "True" if v == "1" else "False"
    if kind == "n" and int(attrs.get("s", "0")) in dates:
        return (epoch + _dt.timedelta(days=float(v))).replace(microsecond=0).strftime("%Y-%m-%d %H:%M:%S")
    return _number_text(v) if kind == "n" else v


def _col_name(index: int) -> str:
    name, index = "", index + 1
    while index:
        index, letter = divmod(index - 1, 26)
        name = chr(65 + letter) + name
    return name


_ESCAPED = re.compile("[&<>]")


def sheet_bytes(rows: Iterable[tuple[int, Sequence[str | None]]], name: str = "Sheet1") -> bytes:
    """A workbook of one sheet with the given (row_num, cells) as inline strings; null cells are left out."""
    main, rel, pkg = (x.strip("{}") for x in (_M, _R, _P))
    types = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    out, starts = io.BytesIO(), []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        z.writestr("[Content_Types].xml",
                   '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
                   '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                   f'<Override PartName="/xl/workbook.xml" ContentType="{types}.sheet.main+xml"/>'
                   f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{types}.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{pkg}"><Relationship Id="rId1" Type="{rel}/officeDocument" '
                                  'Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>'
                                      f'<sheet name="{escape(name)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pkg}"><Relationship Id="rId1" '
                                                 f'Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as part:
            part.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
            held = []
            for row_num, cells in rows:
                starts.extend(f'<c r="{_col_name(i)}' for i in range(len(starts), len(cells)))
                middle = f'{row_num}" t="inlineStr"><is><t xml:space="preserve">'
                held.append(f'<row r="{row_num}">')
                held.extend([f"{start}{middle}{escape(v) if _ESCAPED.search(v) else v}</t></is></c>"
                             for start, v in zip(starts, cells) if v is not None])
                held.append("</row>")
                if len(held) > 2000:
                    part.write("".join(held).encode())
                    held.clear()
            part.write("".join(held).encode())
            part.write(b"</sheetData></worksheet>")
    return out.getvalue()


# Sheets as most programs write them: UTF-8 without prefixes, document types or comments, and in a row only cells of
# one text or one value.  All else is left to the XML parser.
_PLAIN_HEAD = re.compile(r"\ufeff?(?:<\?xml version=[\"']1\.0[\"'](?: encoding=[\"'](?i:utf-8)[\"'])?(?: standalone=[\"']\w+[\"'])?\s*\?>\s*)?"
                         rf"<worksheet(?:\s[^<>]*)?\sxmlns=[\"']{re.escape(_M[1:-1])}[\"'][^<>]*>(?:(?!<!|<row\b|<sheetData\b).)*<sheetData>", re.S)
_PLAIN_ROW = re.compile(r'\s*<row((?: (?!xmlns)[\w:.]+="[^"<>&]*")*)>')
_PLAIN_CELL = re.compile(r'(<c(?: r="([A-Z]+)[0-9]+")?([^<>/]*)(?:>(?:<is><t(?: xml:space="preserve")?>([^<]*)</t></is></c>|<v>([^<]*)</v></c>'
                         r'|<f(?: [^<>]*)?(?:/>|>[^<]*</f>)<v>([^<]*)</v></c>|</c>)|/>))')
_PLAIN_ATTRIBUTES = re.compile(r'(?: (?:s|t|cm|vm|ph)="\w*")*')
_PLAIN_REFERENCES = re.compile(r"[^&]*(?:&(?:amp|lt|gt|quot|apos);[^&]*)*")
_ATTRIBUTE = re.compile(r' ([\w:.]+)="([^"]*)"')
_QUOTES = {"&quot;": '"', "&apos;": "'"}
# Characters of a sheet's XML that are looked at together.
_XML_CHARS = 1 << 18


def _plain_rows(z: zipfile.ZipFile, part: str, strings: list[str], dates: set[int], epoch: _dt.datetime):
    """Non-empty rows up to the first that is not plain; returns how many were given and whether these are all."""
    given, at, columns, kinds = 0, 0, {}, {}
    # Line ends become line feeds, as XML has them.
    with z.open(part) as raw, io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline=None) as xml:
        text = xml.read(_XML_CHARS)
        head = _PLAIN_HEAD.match(text)
        text = text[head.end():] if head else ""
        while head:
            *bodies, text = text.split("</row>")
            for body in bodies:
                row = _PLAIN_ROW.match(body)
                found = _PLAIN_CELL.findall(body, row.end()) if row else []
                if not row or row.end() + sum([len(c[0]) for c in found]) != len(body) or "\ufffd" in body:
                    return given, False
                at = int(dict(_ATTRIBUTE.findall(row[1])).get("r", at + 1))
                cells, idx = [], -1
                for _, name, attrs, item, v, computed in found:
                    if name:
                        idx = columns[name] if name in columns else columns.setdefault(name, _col_index(name))
                    else:
                        idx += 1
                    kind = kinds.get(attrs)
                    if kind is None:
                        if not _PLAIN_ATTRIBUTES.fullmatch(attrs):
                            return given, False
                        kind = kinds[attrs] = dict(_ATTRIBUTE.findall(attrs))
                    inline = kind.get("t") == "inlineStr"
                    value = item if inline else v or computed
                    if "&" in value:
                        if not _PLAIN_REFERENCES.fullmatch(value):
                            return given, False
                        value = unescape(value, _QUOTES)
                    if not inline:
                        if not value:
                            continue
                        value = _value_text(kind, value, strings, dates, epoch)
                    if idx >= len(cells):
                        cells.extend([None] * (idx - len(cells) + 1))
                    cells[idx] = value
                if cells:
                    given += 1
                    yield at, cells
            if text.lstrip().startswith("</sheetData>"):
                return given, True
            more = xml.read(_XML_CHARS)
            if not more:
                break
            text += more
    return given, False


def read_sheet_rows(content: bytes, sheet: int | str = 0) -> Iterator[tuple[int, list[str | None]]]:
    """Non-empty rows of a sheet given by position or name.

    Row and cell references are optional in the format: a row or cell without
    one follows its predecessor.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        part, epoch = _workbook(z, sheet)
        strings, dates = _shared_strings(z), _date_styles(z)
        given, all_plain = yield from _plain_rows(z, part, strings, dates, epoch)
        if not all_plain:
            yield from islice(_parsed_rows(z, part, strings, dates, epoch), given, None)


def _parsed_rows(z: zipfile.ZipFile, part: str, strings: list[str], dates: set[int], epoch: _dt.datetime) -> Iterator[tuple[int, list[str | None]]]:
    at = 0
    for row in _elements(z, part, f"{_M}row"):
        at = int(row.get("r", at + 1))
        cells, idx = {}, -1
        for c in row.iterfind(f"{_M}c"):
            idx = _col_index(c.get("r")) if c.get("r") else idx + 1
            value = _cell_text(c, strings, dates, epoch)
            if value is not None:
                cells[idx] = value
        if cells:
            yield at, [cells.get(i) for i in range(max(cells) + 1)]
