"""File sources: scans of directory trees as DataFrames, and readers from bytes to text."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.pdf import read_pdf

EXTENSIONS = ("docx", "pdf", "doc", "txt")
# Directories that a scan of whole volumes leaves out, and suffixes of files being written.
SYSTEM_ROOTS = "applications bin boot cores dev etc library network opt private proc run sbin system tmp usr var volumes".split()
SYSTEM_ON_DRIVES = ("$recycle.bin", "program files", "program files (x86)", "system volume information", "windows")
DEPENDENCIES = "__pycache__ build cache caches dist env node_modules target temp tmp vendor venv".split()
IGNORED_SUFFIXES = ("tmp", "temp", "swp", "swo", "part", "crdownload")
TEXT_BYTES, ZIP_ENTRIES, XML_BYTES, DOCX_CHARS = 16 << 20, 256, 2 << 20, 1_000_000


def scan(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """path, modificationTime, length and, if asked for, content of all files below ``root``. Bytes are read lazily:
    without content the files are never opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files if content else files.select("path", "modificationTime", "length")


def scan_with_errors(spark: SparkSession, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """Files of all readable roots, and (root, operation, message) of those that cannot be listed; one bad root stops none."""
    found, errors = None, []
    for root in roots:
        try:
            one = scan(spark, root, False)
            found = one if found is None else found.unionByName(one)
        except Exception as error:  # any listing error of a file system is a row, not a failure of the scan
            errors.append((root, "list", type(error).__name__))
    empty = spark.createDataFrame([], "path string, modificationTime timestamp, length long")
    return found if found is not None else empty, spark.createDataFrame(errors, "root string, operation string, message string")


def within_budget(files: DataFrame, most: int) -> DataFrame:
    """The first ``most`` files by path; each row says how many were observed and whether the limit was reached."""
    observed = files.agg(F.count(F.lit(1)).alias("observed"))
    return files.orderBy("path").limit(most).crossJoin(F.broadcast(observed)).withColumn("limited", F.col("observed") > most)


def local_path(path: Column) -> Column:
    """The path of a URI; a drive letter is no scheme."""
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]+:(?://[^/]*)?(?=/)", "")


def wanted_directory(path: Column, profile: str = "discovery") -> Column:
    """Every directory for an explicit scan; not those of systems and dependencies for discovery."""
    if profile == "explicit":
        return F.lit(True)
    any_of = lambda names: "(?:" + "|".join(map(re.escape, names)) + ")"
    low = F.lower(local_path(path))
    system = low.rlike(f"^/{any_of(SYSTEM_ROOTS)}/") | low.rlike("^/users/[^/]+/library/") | low.rlike(f"^[a-z]:/{any_of(SYSTEM_ON_DRIVES)}/")
    return ~system & ~local_path(path).rlike(f"(?:^|/){any_of(DEPENDENCIES)}/")


def wanted_name(path: Column) -> Column:
    """Without hidden, temporary and lock files, and what lies in such directories."""
    noise = local_path(path).rlike(r"(?:^|/)(?:\.[^/]*|~\$[^/]*|[^/]*~)(?:/|$)")
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    return ~(noise | (name == "thumbs.db") | name.rlike(r"\.(?:" + "|".join(IGNORED_SUFFIXES) + ")$"))


def wanted_extension(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def normalized_path(path: Column) -> Column:
    """Forward slashes, lower-case drive letter, ``.`` and ``..`` folded; a share's ``//server`` stays.

    Folding is an aggregate over the components inside the row.
    """
    slashed = F.regexp_replace(path, r"\\", "/")
    prefix = F.when(slashed.startswith("//"), "//").when(slashed.startswith("/"), "/").otherwise("")
    parts = F.filter(F.split(slashed, "/+"), lambda p: (p != "") & (p != "."))
    rooted = prefix != ""

    def step(held: Column, part: Column) -> Column:
        last = F.try_element_at(held, F.lit(-1))
        can = F.coalesce((last != "..") & ~last.rlike("^[A-Za-z]:$"), F.lit(False))
        up = F.when(can, F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).when(rooted | F.coalesce(last.rlike("^[A-Za-z]:$"), F.lit(False)), held).otherwise(F.concat(held, F.array(part)))
        return F.when(part == "..", up).otherwise(F.concat(held, F.array(part)))

    joined = F.concat(prefix, F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    return F.when(joined.rlike("^[A-Z]:"), F.concat(F.lower(F.substring(joined, 1, 1)), F.substring(joined, F.lit(2), F.length(joined)))).otherwise(joined)


def read_text(data: bytes) -> str:
    """Strict UTF-8, or UTF-16 by its mark; line ends become LF."""
    if len(data) > TEXT_BYTES:
        raise ValueError("file is too large")
    kinds = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
    mark, encoding = next(((m, e) for m, e in kinds if data.startswith(m)), (b"", "utf-8"))
    return data[len(mark) :].decode(encoding).replace("\r\n", "\n").replace("\r", "\n")


def read_docx(data: bytes) -> str:
    """Paragraphs of the main document part, blank ones left out; sizes are checked before anything is unpacked."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        if len(archive.infolist()) > ZIP_ENTRIES or archive.getinfo("word/document.xml").file_size > XML_BYTES:
            raise ValueError("archive is too large")
        source = archive.read("word/document.xml")
    if b"<!DOCTYPE" in source or b"<!ENTITY" in source:
        raise ValueError("document declares entities")
    marks = {f"{space}tab": "\t", f"{space}br": "\n", f"{space}cr": "\n"}
    paragraphs = ("".join(node.text or "" if node.tag == f"{space}t" else marks.get(node.tag, "") for node in p.iter()) for p in ET.fromstring(source).iter(f"{space}p"))
    text = "\n".join(p for p in paragraphs if p.strip())
    if len(text) > DOCX_CHARS:
        raise ValueError("document has too much text")
    return text


Reader = Callable[[bytes], str]
#: Readers by extension. DOC needs a converter, which a caller registers: READERS | {"doc": ...}.
READERS: dict[str, Reader] = {"txt": read_text, "docx": read_docx, "pdf": read_pdf}


def parse(files: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """path, text, outcome (text_extracted, ocr_required, failed) from path and content.

    An empty text fails for TXT and needs character recognition otherwise. A file that cannot be read fails alone.
    """
    known = dict(READERS if readers is None else readers)

    def one(path: str, content: bytes) -> tuple[str | None, str]:
        kind = path.rpartition(".")[2].lower()
        if kind not in known:
            return None, "ocr_required" if kind == "pdf" else "failed"
        try:
            text = known[kind](content)
        except Exception:  # whatever a damaged file does to a reader is that file's outcome
            return None, "failed"
        return (text, "text_extracted") if text.strip() else (None, "failed" if kind == "txt" else "ocr_required")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, *one(p, c)) for p, c in zip(part["path"], part["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "text", "outcome"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, outcome string")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line, blank lines skipped; the schema is given, never inferred. A malformed line is an error."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> ''")
    return lines.select(F.from_json("v", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def report_json(report: DataFrame) -> DataFrame:
    """Rows as JSON objects with keys in order of name."""
    return report.select(F.to_json(F.struct(*sorted(report.columns)), {"ignoreNullFields": "false"}).alias("json"))
