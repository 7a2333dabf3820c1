"""Files as a source: listed, read and parsed by executors, one row a file, failures as rows.

Text formats need no library; PDF takes whichever backend is installed, and e-book formats take an
external converter. A file that can't be parsed has an ``error`` and no text; it never ends a job.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from importlib.util import find_spec

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.errors import LecternError, MissingDependency, ParseFailure, UnsupportedFormat
from lectern.functions.text import file_format
from lectern.operators.lines import running_total
from lectern.session import bounded
from lectern.sources.markup import docx_to_text, epub_to_text, html_to_text, rtf_to_text

_FAMILIES = {"text": "txt md markdown rst adoc", "html": "html htm", "docx": "docx", "epub": "epub", "rtf": "rtf", "pdf": "pdf", "ebook": "mobi azw azw3"}
FORMATS = {f".{x}": family for family, names in _FAMILIES.items() for x in names.split()}
MODES = ("text", "technical")
ENCODINGS = "utf-8-sig gb18030 big5hkscs shift_jis cp1252 latin-1".split()
PDF_BACKENDS, LEAST_PER_PAGE = ("fitz", "pdfplumber", "pypdf"), 24
CONVERTER, CONVERTER_SECONDS = "ebook-convert", 300
PARSED = "path string, text string, pages int, error string"


def decode(data: bytes) -> str:
    """By the first encoding that fits; the last one always does."""
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


@F.arrow_udf(StringType())
def decoded(data: pa.Array) -> pa.Array:
    """Text of raw bytes; null stays null."""
    return pa.array([None if x is None else decode(x) for x in data.to_pylist()], pa.string())


def _surrogates(text: str) -> str:
    """Pairs of surrogates as one character; lone ones as U+FFFD, since no UTF-8 can hold them."""
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def pdf_backend(mode: str = "text") -> str | None:
    """The first installed backend; the first two keep the layout, so either mode takes them in this order."""
    return next((x for x in PDF_BACKENDS if find_spec(x)), None)


def _pdf_pages(data: bytes, backend: str) -> list[str]:
    import importlib
    import io

    lib = importlib.import_module(backend)
    if backend == "fitz":
        return [page.get_text("text") for page in lib.open(stream=data, filetype="pdf")]
    pages = lib.open(io.BytesIO(data)).pages if backend == "pdfplumber" else lib.PdfReader(io.BytesIO(data)).pages
    return [page.extract_text() or "" for page in pages]


def pdf_to_text(data: bytes, mode: str = "text") -> tuple[str, int]:
    backend = pdf_backend(mode)
    if not backend:
        raise MissingDependency(f"no PDF backend is installed ({', '.join(PDF_BACKENDS)})")
    pages = _pdf_pages(data, backend)
    text = "\n\n".join(filter(None, (p.strip() for p in pages)))
    if pages and len(text) / len(pages) < LEAST_PER_PAGE:
        raise ParseFailure(f"{len(text)} characters on {len(pages)} pages: a scan without a text layer")
    return text, len(pages)


def ebook_to_text(data: bytes, extension: str) -> str:
    """Through the external converter; its files live in the task's own scratch folder and only while it runs."""
    if not shutil.which(CONVERTER):
        raise MissingDependency(f"{CONVERTER} is not on PATH", remedy=f"install {CONVERTER}")
    with tempfile.TemporaryDirectory() as folder:
        source, target = os.path.join(folder, "book" + extension), os.path.join(folder, "book.txt")
        with open(source, "wb") as f:
            f.write(data)
        done = subprocess.run([CONVERTER, source, target], capture_output=True, text=True, timeout=CONVERTER_SECONDS, check=False)
        if done.returncode or not os.path.exists(target):
            raise ParseFailure(f"{CONVERTER} failed: {(done.stderr or done.stdout).strip()[-200:]}")
        with open(target, "rb") as f:
            return decode(f.read())


def parse(path: str, data: bytes, mode: str = "text") -> tuple[str, int | None]:
    """(text, pages) of one file; pages is None where the format has none."""
    extension = os.path.splitext(path)[1].lower()
    family = FORMATS.get(extension)
    if family is None:
        raise UnsupportedFormat(f"unsupported extension '{extension}'")
    if family == "pdf":
        return pdf_to_text(data, mode)
    if family == "docx":
        return docx_to_text(data), None
    if family == "epub":
        return epub_to_text(data, decode), None
    if family == "ebook":
        return ebook_to_text(data, extension), None
    text = decode(data)
    return {"html": html_to_text, "rtf": rtf_to_text}.get(family, str)(text), None


def parse_files(files: DataFrame, mode: str = "text", lossy: bool = False) -> DataFrame:
    """(path, text, pages, error) of (path, content) rows; whatever goes wrong with a file becomes its error, or with ``lossy`` its bytes are decoded as they are."""
    if mode not in MODES:
        raise LecternError(f"unknown mode '{mode}': one of {MODES}")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                text, pages, error = None, None, None
                try:
                    text, pages = parse(path, content.as_py() or b"", mode)
                    text = _surrogates(text)
                except Exception as e:  # noqa: BLE001 - any fault of a file is that file's row
                    if lossy:
                        text, pages = (content.as_py() or b"").decode("utf-8", "replace"), None
                    else:
                        text, pages, error = None, None, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text], pa.string()), pa.array([pages], pa.int32()), pa.array([error], pa.string())], ["path", "text", "pages", "error"])

    return files.select("path", "content").mapInArrow(go, PARSED)


def read_parts(files: DataFrame, mode: str = "text") -> DataFrame:
    """(path, text) of (path, content) rows: parsed where a parser can, else decoded as UTF-8, what isn't replaced."""
    return parse_files(files, mode, lossy=True).select("path", "text")


def _is_folder(spark: SparkSession, path: str) -> bool | None:
    """What the file system says of ``path``; None where nothing has that name, so that it is a glob."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.getFileStatus(where).isDirectory() if system.exists(where) else None


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(seq, path, content) of files, folders (whole trees) and globs.

    Supported formats only, except that a file named outright is always taken; each file once, in the order of its
    first argument and then of its path's components. Numbers are prefix sums, so no task sees all names.
    """
    found = None
    for arg, path in enumerate(paths):
        folder = _is_folder(spark, path)
        reader = spark.read.format("binaryFile")
        rows = (reader.option("recursiveFileLookup", "true") if folder else reader).load(path).select("path", "content")
        if folder is not False:
            rows = rows.where(F.concat(F.lit("."), file_format(F.col("path"))).isin(*FORMATS))
        rows = rows.withColumn("arg", F.lit(arg))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise LecternError("no paths")
    rank = found.drop("content").groupBy("path").agg(F.min("arg").alias("arg"))
    seq = running_total(rank.select("arg", F.split("path", "/").alias("parts"), F.lit(1).alias("one")), ["arg", "parts"], "one", "before")
    seq = seq.select("arg", F.array_join("parts", "/").alias("path"), (F.col("before") + 1).cast("int").alias("seq")).checkpoint()
    return found.join(bounded(seq), ["path", "arg"]).select("seq", "path", "content")


def capabilities() -> list[dict]:
    """What each family of formats needs, and whether it is here."""
    pdf = pdf_backend()
    return [
        {"formats": " ".join(k for k, v in FORMATS.items() if v not in ("pdf", "ebook")), "requirement": "none", "available": True},
        {"formats": ".pdf", "requirement": pdf or " or ".join(PDF_BACKENDS), "available": pdf is not None},
        {"formats": " ".join(k for k, v in FORMATS.items() if v == "ebook"), "requirement": CONVERTER, "available": shutil.which(CONVERTER) is not None},
    ]


def missing_for(wanted: set[str]) -> list[dict]:
    """Capabilities that these extensions need and that are not here."""
    return [c for c in capabilities() if not c["available"] and wanted & set(c["formats"].split())]


def read_tree(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, text, error) of a folder's files, paths relative to it; files that aren't UTF-8 have an error."""
    from lectern.functions.text import relative_path

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    good = F.is_valid_utf8(F.col("content").cast("string"))
    path = relative_path(F.regexp_replace("path", r"\Afile:/+", "/"), os.path.abspath(root))
    return rows.select(path.alias("path"), F.when(good, F.col("content").cast("string")).alias("text"), F.when(~good, F.lit("not UTF-8")).alias("error"))
