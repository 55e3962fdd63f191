"""Word documents as a table of runs."""

from __future__ import annotations

import fnmatch
import io
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spanveil.schema import RUNS_TABLE

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
RELS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
# Stories of a section in reading order: (reference element, type).
STORY_ORDER = [(kind, variant) for kind in ("headerReference", "footerReference")
               for variant in ("default", "first", "even")]
STORIES = ("body", "table", "nested table", "header", "footer")


def _run_text(run: ET.Element) -> str:
    out = []
    for node in run:
        if node.tag == W + "t":
            out.append(node.text or "")
        elif node.tag in (W + "tab", W + "ptab"):
            out.append("\t")
        elif node.tag in (W + "br", W + "cr"):
            # Page and column breaks carry no text.
            if node.get(W + "type") in (None, "textWrapping"):
                out.append("\n")
        elif node.tag == W + "noBreakHyphen":
            out.append("-")
    return "".join(out)


def _runs(paragraph: ET.Element) -> Iterator[str]:
    for node in paragraph:
        if node.tag == W + "r":
            yield _run_text(node)
        elif node.tag == W + "hyperlink":
            yield from (_run_text(r) for r in node.findall(W + "r"))


def _cells(container: ET.Element, nested: bool = False) -> Iterator[tuple[ET.Element, bool]]:
    """Cells of the tables in a story, each followed by the cells of the tables inside it."""
    for table in container.findall(W + "tbl"):
        for row in table.findall(W + "tr"):
            for cell in row.findall(W + "tc"):
                merge = cell.find(f"{W}tcPr/{W}vMerge")
                if merge is not None and merge.get(W + "val") != "restart":
                    continue  # continues the cell above
                yield cell, nested
                yield from _cells(cell, True)


def _paragraphs(root: ET.Element, story: str) -> Iterator[tuple[str, ET.Element]]:
    for p in root.findall(W + "p"):
        yield story, p
    for cell, nested in _cells(root):
        kind = ("nested table" if nested else "table") if story == "body" else story
        for p in cell.findall(W + "p"):
            yield kind, p


def document_runs(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(story, para_no, run_no, run_text): body, its tables, then headers and footers once each."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ET.fromstring(archive.read("word/document.xml")).find(W + "body")
        targets = {}
        if "word/_rels/document.xml.rels" in archive.namelist():
            rels = ET.fromstring(archive.read("word/_rels/document.xml.rels"))
            targets = {r.get("Id"): r.get("Target") for r in rels.findall(RELS + "Relationship")}
        parts: dict[str, str] = {}
        for section in body.iter(W + "sectPr"):
            for kind, variant in STORY_ORDER:
                for ref in section.findall(W + kind):
                    if ref.get(W + "type", "default") == variant:
                        target = targets.get(ref.get(R + "id"))
                        if target:
                            parts.setdefault(target, kind.removesuffix("Reference"))
        found = list(_paragraphs(body, "body"))
        for target, story in parts.items():
            path = target.lstrip("/") if target.startswith("/") else "word/" + target
            found += _paragraphs(ET.fromstring(archive.read(path)), story)
    for para_no, (story, paragraph) in enumerate(found):
        for run_no, text in enumerate(_runs(paragraph)):
            yield story, para_no, run_no, text


def count_tables(content: bytes) -> int:
    """Tables with at least one cell: body, nested, headers and footers."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = [n for n in archive.namelist() if n == "word/document.xml"
                 or n.startswith(("word/header", "word/footer"))]
        return sum(t.find(f".//{W}tc") is not None for n in names
                   for t in ET.fromstring(archive.read(n)).iter(W + "tbl"))


class DocxRuns:
    """Table function: the runs of one document."""

    def eval(self, content: bytes):
        yield from document_runs(content)


def register_docx(spark: SparkSession) -> None:
    """Make the table function ``docx_runs(content)`` known to SQL."""
    spark.udtf.register("docx_runs", F.udtf(DocxRuns, returnType=RUNS_TABLE))


FILE_BYTES = 32 << 20  # files that a partition reads
MOST_FILES = 1024  # and their number: a small file costs its opening and parsing
BATCH_CHARS = 1 << 20  # text in a batch
_COLUMNS = pa.schema([("path", pa.string()), ("story", pa.string()), ("para_no", pa.int32()), ("run_no", pa.int32()),
                      ("run_text", pa.string())])


@dataclass
class DocxFiles(InputPartition):
    """The files of a task; compressed, since the driver holds those of all tasks."""

    packed: bytes

    @classmethod
    def of(cls, paths: list[str]) -> DocxFiles:
        return cls(zlib.compress("\0".join(paths).encode("utf-8", "surrogateescape")))

    @property
    def paths(self) -> list[str]:
        joined = zlib.decompress(self.packed).decode("utf-8", "surrogateescape")
        return joined.split("\0") if joined else []


class DocxSource(DataSource):
    """Data source ``docx``: path, story, para_no, run_no, run_text of all documents under a folder.

    Options: ``glob`` (*.docx), ``partitionBytes`` (the size of files that one task reads) and
    ``mode``: FAILFAST, or PERMISSIVE to leave out files that are no documents. The path is a
    local one or a URI of a file system that driver and executors share.
    """

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return f"path string, {RUNS_TABLE}"

    def reader(self, schema) -> DataSourceReader:
        return DocxReader(self.options)


class DocxReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.glob = options["path"], options.get("glob", "*.docx")
        self.most, self.mode = int(options.get("partitionBytes", FILE_BYTES)), options.get("mode", "FAILFAST").upper()

    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)

    def _listed(self) -> Iterator[fs.FileInfo]:
        """The files, folder by folder: the listing of one folder is held at a time."""
        system, root = self._files()
        folders = [root]
        while folders:
            found = sorted(system.get_file_info(fs.FileSelector(folders.pop())), key=lambda i: i.path)
            folders += [i.path for i in reversed(found) if i.type == fs.FileType.Directory]
            yield from (i for i in found if i.is_file and fnmatch.fnmatch(i.base_name, self.glob))

    def partitions(self) -> list[InputPartition]:
        """Files of the folder, packed in order of their folders until a partition is full, by bytes or by number."""
        parts, paths, size = [], [], 0
        for info in self._listed():
            if paths and (size + info.size > self.most or len(paths) == MOST_FILES):
                parts.append(DocxFiles.of(paths))
                paths, size = [], 0
            paths.append(info.path)
            size += info.size
        return [*parts, DocxFiles.of(paths)]

    def read(self, partition: DocxFiles) -> Iterator[pa.RecordBatch]:
        system, rows, chars = self._files()[0], [], 0
        for path in partition.paths:
            with system.open_input_stream(path) as stream:
                content = stream.read()
            try:
                found = list(document_runs(content))
            except (zipfile.BadZipFile, KeyError, ET.ParseError) as error:
                if self.mode == "PERMISSIVE":
                    continue
                raise ValueError(f"{path} is no document: {error}") from error
            for run in found:
                rows.append((path, *run))
                chars += len(run[3])
                if chars > BATCH_CHARS:
                    yield _batch(rows)
                    rows, chars = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _COLUMNS)], schema=_COLUMNS)


def read_docx(spark: SparkSession, path: str, glob: str = "*.docx", **options: str) -> DataFrame:
    """Runs of all documents under a folder: path, story, para_no, run_no, run_text."""
    spark.dataSource.register(DocxSource)
    return spark.read.format("docx").options(path=path, glob=glob, **options).load()


def paragraph_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per paragraph with its runs in order: keys, story, para_no, runs, text."""
    grouped = runs.groupBy(*keys, "story", "para_no").agg(
        F.sort_array(F.collect_list(F.struct("run_no", "run_text"))).alias("runs"))
    return grouped.withColumn("text", F.array_join(F.transform(
        "runs", lambda r: F.coalesce(r["run_text"], F.lit(""))), ""))
