"""The format xlsx: shared formulas, dates, names, hidden sheets, and a round trip through Spark."""

from __future__ import annotations

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quantrail.sources import workbooks as w
from quantrail.sources import xlsx


@pytest.mark.parametrize(
    ("formula", "down", "right", "want"),
    [
        ("A1+$A$1+A$1+$A1", 2, 1, "B3+$A$1+B$1+$A3"),
        ('SUM(A1:B2)&"A1"&LOG10(5)', 1, 0, 'SUM(A2:B3)&"A1"&LOG10(5)'),
        ("'My A1''s'!A1+Sheet2!B2+A1B+LOG10+x.A1", 1, 1, "'My A1''s'!B2+Sheet2!C3+A1B+LOH11+x.A1"),
        ("SUM(A:C)+SUM($A:C)+SUM(2:$3)", 1, 2, "SUM(C:E)+SUM($A:E)+SUM(3:$3)"),
        ("A1*1E5+1.5", -1, 0, "#REF!*1E5+1.5"),
        ("XFD1+A1048576+ZZZ9", 1, 1, "#REF!+#REF!+ZZZ9"),
        ("IF(a1>0,B$2,0)", 3, 0, "IF(A4>0,B$2,0)"),
    ],
)
def test_formulas_move(formula, down, right, want):
    assert w.translated(formula, down, right) == want


def test_dates():
    for moment in (datetime.datetime(1900, 1, 1), datetime.datetime(1900, 2, 28), datetime.datetime(1900, 3, 1), datetime.datetime(2024, 2, 29, 13, 45, 30, 250_000)):
        assert w.date_of(w.serial_of(moment)) == moment
    assert w.date_of(45351.5) == datetime.datetime(2024, 2, 29, 12) and w.date_of(0.25, True) == datetime.datetime(1904, 1, 1, 6) and w.date_of(-1) is None and w.date_of(1e9) is None
    styles = f'<styleSheet xmlns="{w.MAIN[1:-1]}"><numFmts><numFmt numFmtId="164" formatCode="[Red]0.00&quot;days&quot;"/><numFmt numFmtId="165" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>'
    assert w.date_styles(styles.encode()) == [False, True, False, True]


def test_shared_formulas_are_written_once_and_read_everywhere():
    cells = [(r, 2, float(r), f"A{r}*$C$1") for r in range(1, 6)] + [(7, 2, None, "A7*2"), (9, 2, None, "A9*3"), (1, 1, datetime.datetime(2024, 5, 1), None)]
    content = w.workbook({"S": cells}, {"rates": "S!$A$1:$A$5", "one": "'S'!B2", "sum": "1+2"}, share=True)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = z.read("xl/worksheets/sheet1.xml").decode()
        assert body.count("$C$1") == 1 and 'ref="B1:B5"' in body
        assert w.names_of(z) == [("rates", "S!$A$1:$A$5"), ("one", "'S'!B2")]
        found = [*w.sheet_cells(z, w.sheets_of(z)[0][1])]
    assert [(r, f) for r, c, *_, f, _d in found if c == 2] == [(r, f"A{r}*$C$1") for r in range(1, 6)] + [(7, "A7*2"), (9, "A9*3")]
    assert [d for *_, d in found if d] == [datetime.datetime(2024, 5, 1)]
    plain = w.workbook({"S": cells})
    assert [*w.cells_of(plain)] == [*w.cells_of(content)]


CELL = "path string, sheet string, row int, col int, number double, text string, truth boolean, error string, formula string, date timestamp_ntz"


def test_round_trip(spark, tmp_path):
    xlsx.register(spark)
    moment = datetime.datetime(2024, 1, 2, 3, 4, 5)
    rows = [(f"b{p}", s, r, c, *v) for p in range(3) for s in ("one", "Two & 3") for r in range(1, 4) for c, v in enumerate([(1.5, None, None, None, f"C{r}+1", None), (None, "x < é", None, None, None, None), (None, None, True, None, None, None), (None, None, None, None, None, moment)], 1)]
    df = spark.createDataFrame(rows, CELL)
    path = f"file://{tmp_path}/books"
    df.repartition("path").sortWithinPartitions("path", "sheet", "row", "col").write.format("xlsx").mode("append").save(path)
    read = spark.read.format("xlsx").load(path)
    assert read.rdd.getNumPartitions() == 6
    got = [(r.path.rsplit("/", 1)[1][:-5], r.sheet, r.row, r.col, r.formula, r.text, r.truth, r.date) for r in read.collect()]
    assert sorted(got, key=str) == sorted(((p, s, r, c, f, t, b, d) for p, s, r, c, _, t, b, _, f, d in rows), key=str)
    df.filter("path = 'b1'").repartition(1).sortWithinPartitions("path", "sheet", "row", "col").write.format("xlsx").mode("overwrite").save(path)
    assert {r.path.rsplit("/", 1)[1] for r in spark.read.format("xlsx").load(path).select("path").collect()} == {"b1.xlsx"}
    assert [p.name for p in (tmp_path / "books").iterdir()] == ["b1.xlsx"]
    with pytest.raises(Exception, match="one partition"):
        df.repartition(3).sortWithinPartitions("path", "sheet", "row", "col").write.format("xlsx").mode("append").save(path)
    with pytest.raises(Exception, match="lack"):
        df.drop("date").write.format("xlsx").mode("append").save(path)
    assert [p.name for p in (tmp_path / "books").iterdir()] == ["b1.xlsx"]


def test_hidden_sheets_and_names(spark, tmp_path):
    content = w.workbook({"A": [(1, 1, None, "'H 1'!A1+B!A1")], "H 1": [(1, 1, 5.0, None)], "H2": [(1, 1, 6.0, "H3!A1")], "H3": [(1, 1, 7.0, None)]}, {"n": "A!$A$1"})
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w") as to:
        for name in z.namelist():
            body = z.read(name).decode()
            if name == "xl/workbook.xml":
                for s in ("H 1", "H2", "H3"):
                    body = body.replace(f'name="{s}"', f'name="{s}" state="hidden"')
            to.writestr(name, body)
    (tmp_path / "h.xlsx").write_bytes(out.getvalue())
    xlsx.register(spark)
    cells = spark.read.format("xlsx").load(str(tmp_path))
    assert {r.sheet for r in cells.filter(F.col("hidden")).collect()} == {"H 1", "H2", "H3"}
    assert {r.sheet for r in xlsx.shown(cells).collect()} == {"A", "H 1"}
    assert [(r.name, r.range) for r in xlsx.defined_names(spark, str(tmp_path)).collect()] == [("n", "A!$A$1")]


def test_small_files_are_read_together(spark, tmp_path):
    """Partitions grow with bytes, not with sheets; only a file over the share of a partition is parted by sheet."""
    for i in range(200):
        (tmp_path / f"b{i:03}.xlsx").write_bytes(w.workbook({"one": [(1, 1, float(i), None)], "two": [(1, 1, f"t{i}", None), (2, 1, None, "A1&1")]}))
    big = {s: [(r, 1, r * 1.1 + k, None) for r in range(1, 3001)] for k, s in enumerate("xyz")}
    (tmp_path / "c.xlsx").write_bytes(w.workbook(big))
    xlsx.register(spark)
    read = spark.read.format("xlsx").load(str(tmp_path))
    assert read.rdd.getNumPartitions() <= 128  # of 403 sheets
    rows = [(r.path.rsplit("/", 1)[1][:-5], r.sheet, r.row, r.number, r.text, r.formula) for r in read.collect()]
    want = [x for i in range(200) for x in ((f"b{i:03}", "one", 1, float(i), None, None), (f"b{i:03}", "two", 1, None, f"t{i}", None), (f"b{i:03}", "two", 2, None, None, "A1&1"))]
    want += [("c", s, r, v, None, None) for s, cells in big.items() for r, _, v, _ in cells]
    assert sorted(rows, key=str) == sorted(want, key=str)
    parts = xlsx.Reader(str(tmp_path)).partitions()
    assert sum(len(s) for p in parts for f, s in p.files if f.endswith("/c.xlsx")) == 3
    assert [s for p in parts for f, s in p.files if not f.endswith("/c.xlsx")] == [None] * 200
