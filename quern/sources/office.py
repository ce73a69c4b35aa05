"""Word documents as a source and sink: whole files, told by their first bytes, paragraphs streamed from the packed XML."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ship import ship

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_TYPES = (
    _HEAD + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
_RELS = (
    _HEAD + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
)
#: Signs that XML can't hold.
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
#: Bytes of files, as packed, that one task reads at about.
READ = 16 << 20
#: First bytes of each kind of file; text is what begins otherwise.
KINDS = {b"PK\x03\x04": "docx", b"%PDF": "pdf", b"\xd0\xcf\x11\xe0": "doc"}


def package(paragraphs: list[str]) -> bytes:
    """A document of these paragraphs."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("_rels/.rels", _RELS)
        z.writestr("word/document.xml", f'{_HEAD}<w:document xmlns:w="{_W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def paragraphs(data: bytes) -> Iterator[str]:
    """The paragraphs of a document in order, parsed as they are unpacked; tabs and line breaks within one are blanks."""
    with zipfile.ZipFile(io.BytesIO(data)) as z, z.open("word/document.xml") as part:
        text: list[str] = []
        for _, e in ElementTree.iterparse(part):
            if e.tag == f"{{{_W}}}t":
                text.append(e.text or "")
            elif e.tag in (f"{{{_W}}}tab", f"{{{_W}}}br"):
                text.append(" ")
            elif e.tag == f"{{{_W}}}p":
                yield "".join(text)
                text = []
                e.clear()


def kind_of(data: bytes) -> str:
    return next((k for head, k in KINDS.items() if data.startswith(head)), "text")


def write_documents(rows: DataFrame, folder: str, broken: str = "false", folders: int = 1) -> DataFrame:
    """rows (name, paragraphs) -> a file each below the folder (a URI that driver and executors share), and their names and sizes. A repeated task replaces a file by the same one.
    Rows for which `broken` holds are written without their second half. With more than one folder, files are dealt to as many subfolders by their names, which then begin with the subfolder's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        local, made = isinstance(system, fs.LocalFileSystem), set()
        for batch in batches:
            names, sizes = [], []
            for name, own, cut in zip(*(c.to_pylist() for c in batch.columns)):
                data = package(own or [])
                data = data[: len(data) // 2] if cut else data
                name = f"{zlib.crc32(name.encode()) % folders:05d}/{name}" if folders > 1 else name
                top = f"{path}/{name}".rpartition("/")[0]
                if local and top not in made:
                    system.create_dir(top, recursive=True)
                    made.add(top)
                with system.open_output_stream(f"{path}/{name}") as out:
                    out.write(data)
                names.append(name)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "size"])

    ship(rows.sparkSession)
    return rows.select("name", "paragraphs", F.expr(broken).alias("cut")).mapInArrow(run, "name string, size long")


def read_documents(spark: SparkSession, folder: str, files: DataFrame | None = None) -> DataFrame:
    """Files below a folder -> name, kind, ordinal, text, error: a row for each paragraph (of Word documents) or line (of texts). A file that can't be
    read, or is of a kind without a reader here, is one row with its error. Spark lists the folder in the driver's memory; with files
    (name, size), as `write_documents` gives them, nothing is listed, and tasks open the files by name, each once."""

    def rows(name: str, data: bytes) -> list[tuple]:
        kind = kind_of(data)
        try:
            if kind == "docx":
                own = list(paragraphs(data))
            elif kind == "text":
                own = data.decode("utf-8").splitlines()
            else:
                return [(name, kind, None, None, f"no reader for {kind}")]
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, UnicodeDecodeError, EOFError, OSError) as e:
            return [(name, kind, None, None, type(e).__name__)]
        return [(name, kind, k, text, None) for k, text in enumerate(own)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            for k in range(batch.num_rows):  # one file's rows at a time
                own = rows(batch.column(0)[k].as_py().rpartition("/")[2], batch.column(1)[k].as_py())
                cols = list(zip(*own)) if own else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["name", "kind", "ordinal", "text", "error"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(f"{path}/{name}") as f:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([f.read()], pa.binary())], ["path", "content"])

    ship(spark)
    out = "name string, kind string, ordinal int, text string, error string"
    if files is None:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content").mapInArrow(run, out)
    total = files.agg(F.sum("size")).first()[0] or 0
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-total // READ))
    return files.select("name").repartition(parts, "name").dropDuplicates().mapInArrow(lambda batches: run(opened(batches)), out)
