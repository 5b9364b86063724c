"""The format "xlsx" of spark.read and df.write: partitions of a sheet or of many small ones, and a file for each path of cell rows.

    register(spark)
    spark.read.format("xlsx").load(folder)
    cells.repartition("path").sortWithinPartitions("path", "sheet", "row", "col").write.format("xlsx").mode("append").save(folder)

Files are found through pyarrow's file systems, so a path may be local or a URI that these know. A sheet's shared formulas are written out,
date serials become moments, and a hidden sheet is marked. Cells pass to and from the workers in Arrow batches. A writing task holds one file; it is put in
place under its own name when the job commits.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .workbooks import book_of, names_of, sheet_cells, sheets_of, workbook

SCHEMA = "path string, sheet string, hidden boolean, row int, col int, number double, text string, truth boolean, error string, formula string, date timestamp_ntz"
TYPES = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64(), "timestamp_ntz": pa.timestamp("us")}
ARROW = pa.schema([(c.split()[0], TYPES[c.split()[1]]) for c in SCHEMA.split(", ")])
#: Small sheets are read together up to so many bytes of their files, or this part of all bytes if that is less.
MOST, LEAST = 4_000_000, 64
#: Cells of a batch; the format bounds a cell's text to 32,767 characters.
BATCH = 2000
WRITTEN = {"path", "sheet", "row", "col", "number", "text", "truth", "error", "formula", "date"}


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """Path and bytes of each file."""
    system, at = _system(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.path.lower().endswith(".xlsx")]
    return sorted((f.path, f.size or 0) for f in found)


@dataclass
class Sheets(InputPartition):
    """Files to read, each with its sheets (name, part of the file, hidden), or None for all of them."""

    files: list[tuple[str, list[tuple[str, str, bool]] | None]]


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Sheets]:
        """Lists the files. Small ones are read whole, many in a partition; only of a file over the share of a partition is the table of contents read here, to part its sheets."""
        system, _ = _system(self.path)
        files = _files(self.path)
        share = min(MOST, sum(size for _, size in files) / LEAST)
        out: list[Sheets] = []
        together: list[tuple[str, None]] = []
        held = 0
        for file, size in files:
            if size > share:
                with system.open_input_file(file) as f, zipfile.ZipFile(f) as z:
                    out += [Sheets([(file, part)]) for part in _parted([(s, z.getinfo(s[1]).compress_size) for s in sheets_of(z)], share)]
                continue
            if together and held + size > share:
                out.append(Sheets(together))
                together, held = [], 0
            together.append((file, None))
            held += size
        return [*out, Sheets(together)] if together else out

    def read(self, partition: Sheets) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.path)
        rows: list[tuple] = []
        for file, sheets in partition.files:
            with system.open_input_file(file) as f, zipfile.ZipFile(f) as z:
                book = book_of(z)
                for name, part, hidden in sheets_of(z) if sheets is None else sheets:
                    for cell in sheet_cells(z, part, book):
                        rows.append((file, name, hidden, *cell))
                        if len(rows) == BATCH:
                            yield _batch(rows)
                            rows = []
        if rows:
            yield _batch(rows)


def _parted(sheets: list[tuple[tuple[str, str, bool], int]], share: float) -> Iterator[list[tuple[str, str, bool]]]:
    """Neighbouring sheets together, up to the share in bytes; a larger one alone."""
    held, size = [], 0
    for sheet, n in sheets:
        if held and size + n > share:
            yield held
            held, size = [], 0
        held.append(sheet)
        size += n
    if held:
        yield held


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def _values(b: pa.RecordBatch) -> list:
    """What each cell holds: its date, or else its number, text, truth or error."""
    out = np.full(b.num_rows, None, dtype=object)
    for name in ("error", "truth", "text", "number", "date"):
        column = b.column(name)
        if column.null_count < len(column):
            out[column.is_valid().to_numpy(zero_copy_only=False)] = column.drop_null().to_numpy(zero_copy_only=False).astype(object)
    return out.tolist()


@dataclass
class Done(WriterCommitMessage):
    moves: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Done:
        """Files are written aside; rows of a path come together."""
        system, at = _system(self.path)
        system.create_dir(at, recursive=True)
        moves: list[tuple[str, str]] = []
        sheets: dict[str, list] = {}

        def put(name: str) -> None:
            aside = f"{at}/_{uuid.uuid4().hex}.part"
            with system.open_output_stream(aside) as f:
                f.write(workbook(sheets, share=True))
            moves.append((aside, f"{at}/{name.rsplit('/', 1)[-1].removesuffix('.xlsx')}.xlsx"))

        before = None
        for b in batches:
            path, sheet, formula = (b.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("path", "sheet", "formula"))
            for name, title, *cell in zip(path, sheet, b.column("row").to_numpy().tolist(), b.column("col").to_numpy().tolist(), _values(b), formula, strict=True):
                if name != before:
                    if before is not None:
                        put(before)
                    before, sheets = name, {}
                sheets.setdefault(title, []).append(cell)
        if before is not None:
            put(before)
        if len({m[1] for m in moves}) < len(moves):
            raise ValueError("rows of a path must come together: sort by it within partitions")
        return Done(moves)

    def commit(self, messages: list[Done | None]) -> None:
        system, at = _system(self.path)
        moves = [m for x in messages if x for m in x.moves]
        if len({m[1] for m in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("rows of a path must be in one partition: repartition by it")
        if self.overwrite:
            for old, _ in _files(self.path):
                system.delete_file(old)
        for aside, name in moves:
            system.move(aside, name)

    def abort(self, messages: list[Done | None]) -> None:
        system, _ = _system(self.path)
        for aside, _name in (m for x in messages if x for m in x.moves):
            system.delete_file(aside)


class Xlsx(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema: object, overwrite: bool) -> Writer:
        if lacking := WRITTEN - {f.name for f in schema.fields}:
            raise ValueError(f"cells lack {sorted(lacking)}")
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Xlsx)


def defined_names(spark: SparkSession, path: str) -> DataFrame:
    """path, name, range of the defined names that stand for one range."""

    def found(batches):
        for b in batches:
            rows = []
            for file, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(file, *n) for n in names_of(z)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["path", "name", "range"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content").mapInArrow(found, "path string, name string, range string")


def shown(cells: DataFrame) -> DataFrame:
    """The cells of visible sheets, and of hidden ones that a visible sheet's formula names."""
    formulas = cells.filter("NOT hidden AND instr(formula, '!') > 0").select("path", F.explode(F.regexp_extract_all("formula", F.lit(r"('(?:[^']|'')+'|[\\w.]+)!"), 1)).alias("s"))
    named = formulas.select("path", F.regexp_replace(F.regexp_replace("s", "^'|'$", ""), "''", "'").alias("sheet")).distinct()
    return cells.filter("NOT hidden").unionByName(cells.filter("hidden").join(named, ["path", "sheet"], "left_semi"))
