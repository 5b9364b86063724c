"""Workbooks: cells of xlsx files as rows, and sheets of rows as xlsx files. A task reads or writes whole files, one at a time."""

from __future__ import annotations

import datetime
import functools
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "path string, sheet string, row int, col int, number double, text string, truth boolean, error string, formula string"
#: Namespaces of the file format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
ROW, CELL, VALUE, FORMULA = (f"{MAIN}{tag}" for tag in ("row", "c", "v", "f"))
#: A string literal, which stays, or the prefix of newer functions, which goes.
PREFIX = re.compile(r'("(?:[^"]|"")*")|_xlfn\.')
PACKAGE = "http://schemas.openxmlformats.org/package/2006"


@functools.cache
def _letters(col: int) -> str:
    out = ""
    while col:
        col, r = divmod(col - 1, 26)
        out = chr(65 + r) + out
    return out


@functools.lru_cache(maxsize=20_000)
def _column(letters: str) -> int:
    col = 0
    for c in letters.upper():
        col = col * 26 + ord(c) - 64
    return col


def place(address: str) -> tuple[int, int]:
    """(row, column) from 1 of an address such as B7."""
    letters = address.rstrip("0123456789")
    return int(address[len(letters) :]), _column(letters.replace("$", ""))


def address(row: int, col: int) -> str:
    return f"{_letters(col)}{row}"


#: The least and the greatest row and column of a sheet.
ROWS, COLUMNS = 1_048_576, 16_384
#: In a formula: a text or quoted sheet name, which stays; a reference to cells, columns or rows; other names and numbers, which stay.
REFERENCE = re.compile(
    r"""("(?:[^"]|"")*"|'(?:[^']|'')*'!?)|(?<![A-Za-z0-9_.$])(?:(\$?)([A-Za-z]{1,3})(\$?)(\d{1,7})(?![A-Za-z0-9_.(!])|(\$?)([A-Za-z]{1,3}):(\$?)([A-Za-z]{1,3})(?![A-Za-z0-9_.(!:])|(\$?)(\d{1,7}):(\$?)(\d{1,7})(?![A-Za-z0-9_.]))|[A-Za-z_\\][\w.\\]*[(!]?|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"""
)


@functools.lru_cache(maxsize=1000)
def _pieces(formula: str) -> list[tuple[str, list[tuple[str, int, bool]]]]:
    """A formula's stretches of text, each with the ends (a $ or nothing, number, is a row) of the reference in it that may move; none in those that stay."""
    out: list[tuple[str, list[tuple[str, int, bool]]]] = []
    at = 0
    for m in REFERENCE.finditer(formula):
        if m[3]:
            if _column(m[3]) > COLUMNS or not 1 <= int(m[5]) <= ROWS:
                continue
            ends = [(m[2], _column(m[3]), False), (m[4], int(m[5]), True)]
        elif m[7]:
            ends = [(m[6], _column(m[7]), False), (m[8], _column(m[9]), False)]
        elif m[11]:
            ends = [(m[10], int(m[11]), True), (m[12], int(m[13]), True)]
        else:
            continue
        out += [(formula[at : m.start()], []), ("" if m[3] else ":", ends)]
        at = m.end()
    return [*out, (formula[at:], [])]


def translated(formula: str, down: int, right: int) -> str:
    """The formula as it reads so many rows further down and columns to the right: references without a $ move, and those that leave the sheet are #REF!."""
    out = []
    for text, ends in _pieces(formula):
        moved = []
        for fixed, at, is_row in ends:
            to = at if fixed else at + (down if is_row else right)
            if not 1 <= to <= (ROWS if is_row else COLUMNS):
                moved = ["#REF!"]
                break
            moved.append(f"{fixed}{to if is_row else _letters(to)}")
        out.append(text.join(moved) if len(moved) == 2 else moved[0] if moved else text)
    return "".join(out)


#: Number formats of dates and times by number; in others, what is neither quoted nor in brackets tells.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
LITERAL = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.')


def date_styles(styles: bytes) -> list[bool]:
    """For each style of cells, whether its numbers are dates."""
    root = ElementTree.fromstring(styles)
    own = {int(f.get("numFmtId")): bool(re.search("[dmyhs]", LITERAL.sub("", f.get("formatCode") or "").lower())) for f in root.iter(f"{MAIN}numFmt")}
    cells = root.find(f"{MAIN}cellXfs")
    return [own.get(k := int(x.get("numFmtId", "0")), k in DATE_FORMATS) for x in (cells if cells is not None else [])]


def date_of(serial: float, late: bool = False) -> datetime.datetime | None:
    """The moment of a date serial; late: counted from 1904. Serials before March 1900 count from a day later, for the format has a 29 February 1900."""
    if not 0 <= serial < 2_958_466:
        return None
    first = datetime.datetime(1904, 1, 1) if late else datetime.datetime(1899, 12, 31) if serial < 60 else datetime.datetime(1899, 12, 30)
    return first + datetime.timedelta(days=int(serial), milliseconds=round((serial % 1) * 86_400_000))


def serial_of(moment: datetime.datetime) -> float:
    gap = moment - datetime.datetime(1899, 12, 30)
    out = gap.days + (gap.seconds + gap.microseconds / 1e6) / 86_400
    return out - 1 if out < 61 else out


def sheets_of(z: zipfile.ZipFile) -> list[tuple[str, str, bool]]:
    """(name, part of the file, hidden) of each sheet, in order."""
    targets = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    part = lambda t: t if t.startswith("xl/") else f"xl/{t}"
    return [(s.get("name"), part(targets[s.get(f"{REL}id")]), s.get("state", "visible") != "visible") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]


def names_of(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, range) of the defined names that stand for one range."""
    found = [(d.get("name"), (d.text or "").strip()) for d in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}definedName")]
    one = re.compile(r"(?:'(?:[^']|'')*'|[\w.]+)!\$?[A-Z]+\$?\d+(?::\$?[A-Z]+\$?\d+)?", re.I)
    return [(n, t) for n, t in found if not n.startswith("_xlnm") and one.fullmatch(t)]


def cells_of(content: bytes) -> Iterator[tuple]:
    """sheet, row, col, number, text, truth, error, formula of each cell that holds something."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book = book_of(z)
        for name, part, _ in sheets_of(z):
            for c in sheet_cells(z, part, book):
                yield (name, *c[:7])


def book_of(z: zipfile.ZipFile) -> tuple[list[str], list[bool], bool]:
    """What all sheets of a file share: its texts, for each style whether it is of dates, and whether these count from 1904."""
    names = set(z.namelist())
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
    dated = date_styles(z.read("xl/styles.xml")) if "xl/styles.xml" in names else []
    late = any(p.get("date1904") in ("1", "true") for p in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}workbookPr"))
    return shared, dated, late


def sheet_cells(z: zipfile.ZipFile, part: str, book: tuple[list[str], list[bool], bool] | None = None) -> Iterator[tuple]:
    """row, col, number, text, truth, error, formula, date of each cell of a sheet that holds something. Shared formulas are written out for every cell."""
    shared, dated, late = book or book_of(z)
    masters: dict[str, tuple[int, int, str]] = {}
    for _, c in ElementTree.iterparse(z.open(part)):
        if c.tag == ROW:
            c.clear()
        if c.tag != CELL:
            continue
        value = f = None
        for x in c:
            if x.tag == VALUE and value is None:
                value = x.text or ""
            elif x.tag == FORMULA and f is None:
                f = x
        kind, (row, col) = c.get("t", "n"), place(c.get("r"))
        formula = None if f is None else f.text or ""
        if f is not None and f.get("t") == "shared":
            if formula:
                masters[f.get("si")] = (row, col, formula)
            elif f.get("si") in masters:
                r0, c0, first = masters[f.get("si")]
                formula = translated(first, row - r0, col - c0)
        text = "".join(t.text or "" for t in c.iter(f"{MAIN}t")) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value else value if kind == "str" else None
        number = float(value) if kind == "n" and value else None
        if value is not None or text or formula:
            style = int(c.get("s", "0"))
            date = date_of(number, late) if number is not None and style < len(dated) and dated[style] else None
            formula = PREFIX.sub(r"\1", formula) if formula and "_xlfn." in formula else formula
            yield (row, col, number, text, value == "1" if kind == "b" else None, value if kind == "e" else None, formula, date)
        c.clear()


def cells_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cell rows of files given by path and content."""
    columns = [c.split()[0] for c in CELLS.split(", ")]
    for b in batches:
        for name, content in zip(b.path, b.content, strict=True):
            rows = [(name, *c) for c in cells_of(content)]
            for at in range(0, len(rows), 50_000):
                yield pd.DataFrame(rows[at : at + 50_000], columns=columns).astype({"number": "float64", "truth": "object"})


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """A row for each cell of each xlsx file at the path."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cells_in, CELLS)


STYLES = f'<styleSheet xmlns="{MAIN[1:-1]}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>'


def workbook(sheets: dict[str, list[tuple[int, int, object, str | None]]], names: dict[str, str] | None = None, share: bool = False) -> bytes:
    """An xlsx file of sheets of (row, col, value, formula); a datetime becomes a date serial. share: formulas that a column repeats row by row are written once. names: ranges by defined name."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda name, body: z.writestr(name, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{body}')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        put("[Content_Types].xml", f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{parts}</Types>')
        put("_rels/.rels", f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{REL[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{REL[1:-1]}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + f'<Relationship Id="rId{len(sheets) + 1}" Type="{REL[1:-1]}/styles" Target="styles.xml"/></Relationships>')
        put("xl/styles.xml", STYLES)
        put("xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{REL[1:-1]}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets>" + (f"<definedNames>{''.join(f'<definedName name={chr(34)}{escape(n)}{chr(34)}>{escape(t)}</definedName>' for n, t in names.items())}</definedNames>" if names else "") + "</workbook>")
        for i, cells in enumerate(sheets.values(), 1):
            rows: dict[int, list[str]] = {}
            runs = _shared_runs(cells) if share else {}
            for row, col, value, formula in sorted(cells, key=lambda c: c[:2]):
                at = address(row, col)
                f = runs.get((row, col)) or (f"<f>{escape(formula)}</f>" if formula else "")
                if isinstance(value, datetime.datetime):
                    cell = f'<c r="{at}" s="1">{f}<v>{serial_of(value)!r}</v></c>'
                elif isinstance(value, bool):
                    cell = f'<c r="{at}" t="b">{f}<v>{int(value)}</v></c>'
                elif isinstance(value, int | float):
                    cell = f'<c r="{at}">{f}<v>{value!r}</v></c>'
                elif value is None:
                    cell = f'<c r="{at}">{f}</c>'
                else:
                    cell = f'<c r="{at}" t="inlineStr">{f}<is><t xml:space="preserve">{escape(str(value))}</t></is></c>'
                rows.setdefault(row, []).append(cell)
            put(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>' + "".join(f'<row r="{r}">{"".join(c)}</row>' for r, c in rows.items()) + "</sheetData></worksheet>")
    return out.getvalue()


def _shared_runs(cells: list[tuple[int, int, object, str | None]]) -> dict[tuple[int, int], str]:
    """How formulas are written that a column repeats from row to row, translated: the first with its range, the others by number."""
    out: dict[tuple[int, int], str] = {}
    found = sorted((col, row, f) for row, col, _, f in cells if f)
    at = count = 0
    while at < len(found):
        col, row, first = found[at]
        end = at + 1
        while end < len(found) and found[end][0] == col and found[end][1] == row + end - at and found[end][2] == translated(first, end - at, 0):
            end += 1
        if end - at > 1:
            out[row, col] = f'<f t="shared" ref="{address(row, col)}:{address(row + end - at - 1, col)}" si="{count}">{escape(first)}</f>'
            out |= {(row + k, col): f'<f t="shared" si="{count}"/>' for k in range(1, end - at)}
            count += 1
        at = end
    return out


def to_workbooks(cells: DataFrame) -> DataFrame:
    """path, content: an xlsx file for each path of cell rows. A file is a group; the format bounds a sheet to 1,048,576 rows."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sheets: dict[str, list] = {}
        for c in group.sort_values(["sheet", "row", "col"]).itertuples():
            known = [v for v in (c.number, c.text, c.truth, c.error) if v is not None and v == v]
            sheets.setdefault(c.sheet, []).append((c.row, c.col, known[0] if known else None, c.formula))
        return pd.DataFrame({"path": [group.path.iloc[0]], "content": [workbook(sheets)]})

    return cells.groupBy("path").applyInPandas(run, "path string, content binary")


#: Distribution functions of a sheet and their parameters.
CALLS = {"NORMAL": "mean,sd", "TRIANGULAR": "min,mode,max", "UNIFORM": "min,max", "PERT": "min,mode,max", "LOGNORMAL": "mean,sd"}


def assumptions_of(cells: DataFrame) -> DataFrame:
    """path, sheet, row, col, family, parameters of the cells whose whole formula is one distribution call on literals."""
    number = r"\s*-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?\s*"
    pattern = rf"(?i)^=?[A-Z]+\.({'|'.join(CALLS)})\(({number}(?:,{number})*)\)$"
    found = cells.select("path", "sheet", "row", "col", F.upper(F.regexp_extract("formula", pattern, 1)).alias("family"), F.split(F.regexp_extract("formula", pattern, 2), ",").alias("p")).filter("family <> ''")
    found = found.withColumn("parameters", F.transform("p", lambda x: F.trim(x).cast("double")))
    arity = F.create_map(*[F.lit(v) for k, p in CALLS.items() for v in (k, len(p.split(",")))])
    return found.filter(F.size("parameters") == arity[F.col("family")]).drop("p")
