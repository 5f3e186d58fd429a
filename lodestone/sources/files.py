"""Files to pages, registries, golden sets and run records."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 25 << 20
_DOCX = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _plain(content: bytes) -> list[tuple[int | None, str]]:
    return [(None, content.decode("utf-8", "replace"))]


def _docx(content: bytes) -> list[tuple[int | None, str]]:
    """Paragraphs of the body, then table rows with their cells between bars."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_DOCX}body")
    words = lambda node: "".join(t.text or "" for t in node.iter(f"{_DOCX}t"))
    lines = [words(p) for p in body.findall(f"{_DOCX}p")]
    lines += [" | ".join(words(c).strip() for c in row.findall(f"{_DOCX}tc")) for table in body.findall(f"{_DOCX}tbl") for row in table.findall(f"{_DOCX}tr")]
    return [(None, "\n".join(x for x in lines if x.strip()))]


#: By suffix; a parser for PDF can be added where a library for it is installed.
LOADERS: dict[str, Callable[[bytes], list[tuple[int | None, str]]]] = {".txt": _plain, ".md": _plain, ".docx": _docx}


Loaders = dict[str, Callable[[bytes], list[tuple[int | None, str]]]]
_FILES = "path string, modificationTime timestamp, length long, content binary"
_PARSED = "document_id string, document_name string, pages array<struct<page_number:int,text:string>>, error string"


def read_pages(spark: SparkSession, path: str, loaders: Loaders | None = None) -> DataFrame:
    """Pages of all files under ``path``, one task batch at a time; a file that
    can't be read has one row with an error and no text.  Of files with the same
    content, which is what a document's id is made of, the one whose name is first
    counts.  Spark's file source passes over files of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parsed = _parsed(files, loaders)
    first = parsed.groupBy("document_id").agg(F.min_by(F.struct("document_name", "pages", "error"), "document_name").alias("f"))
    return _as_pages(first.select("document_id", "f.*"))


def stream_pages(spark: SparkSession, path: str, loaders: Loaders | None = None, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the pages of files that come to be under ``path``.  A file whose
    content the stream has brought before, in any batch or run, has no pages: the
    stream's state keeps the ids of all documents, a few bytes for each.  One that was
    removed from a store comes back by an ingest of its own, not by another copy."""
    source = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
    return _as_pages(_parsed(source.load(path), loaders).dropDuplicates(["document_id"]))


def _as_pages(parsed: DataFrame) -> DataFrame:
    pages = parsed.select("document_id", "document_name", "error", F.posexplode_outer("pages").alias("page_ord", "page"))
    return pages.select("document_id", "document_name", F.coalesce("page_ord", F.lit(0)).alias("page_ord"), "page.page_number", "page.text", "error")


def _parsed(files: DataFrame, loaders: Loaders | None) -> DataFrame:
    by_suffix = loaders or LOADERS

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, size, content, digest in zip(batch["path"], batch["length"], batch["content"], batch["digest"], strict=True):
                name = file.rsplit("/", 1)[-1]
                suffix = name[name.rfind(".") :].lower() if "." in name else ""
                pages, error = None, None
                if suffix not in by_suffix:
                    error = f"unsupported file type {suffix}"
                elif size > MAX_BYTES:
                    error = f"larger than {MAX_BYTES} bytes"
                else:
                    try:
                        pages = [{"page_number": number, "text": t} for number, t in by_suffix[suffix](bytes(content))]
                        if not any(p["text"].strip() for p in pages):
                            pages, error = None, "no text found"
                    except Exception as x:  # noqa: BLE001 - one damaged file must not stop the others
                        pages, error = None, f"unreadable: {type(x).__name__}"
                rows.append((digest[:12], name, pages, error))
            yield pd.DataFrame(rows, columns=["document_id", "document_name", "pages", "error"])

    return files.select("path", "length", "content", F.sha2("content", 256).alias("digest")).mapInPandas(parse, _PARSED)


GOLDEN = "id string, question string, expected_behavior string, expected_answer string, expected_facts array<string>, expected_document string, expected_pages array<int>"


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases from JSON lines, without blank lines and comments; a bad line is an error."""
    lines = spark.read.text(path).where(r"trim(value) <> '' AND NOT value RLIKE '^\\s*#'")
    return lines.select(F.from_json("value", GOLDEN, {"mode": "FAILFAST"}).alias("c")).select("c.*")


def write_run(cases: DataFrame, folder: str, label: str, stamp: str) -> str:
    """Writes the scored cases as JSON and, flat, as CSV; returns the run's name."""
    name = f"{stamp}_{re.sub(r'[^A-Za-z0-9_-]+', '_', label)[:40]}"
    cases.write.json(f"{folder}/{name}/json")
    flat = [c for c, t in cases.dtypes if not t.startswith(("array", "map", "struct"))]
    cases.select(*flat).write.option("header", True).csv(f"{folder}/{name}/csv")
    return name


def list_runs(spark: SparkSession, folder: str, schema: str, limit: int = 20) -> DataFrame:
    """run and its cases' number, newest first; lines that can't be read are skipped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{folder}/*/json")
    name = F.regexp_extract(F.input_file_name(), r"/([^/]+)/json/", 1)
    return rows.groupBy(name.alias("run")).agg(F.count("*").alias("n")).orderBy(F.desc("run")).limit(max(1, min(100, limit)))


def read_run(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """The scored cases of one run; its name can't lead out of the folder."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise ValueError(f"not the name of a run: {name!r}")
    return spark.read.schema(schema).json(f"{folder}/{name}/json")


def save_upload(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """Keeps raw files (document_id, name, content) as rows of ``folder``, under their
    document's id, and returns document_id and n_bytes."""
    kept = files.select("document_id", "name", "content", F.octet_length("content").alias("n_bytes"))
    kept.write.mode("append").parquet(folder)
    return spark.read.parquet(folder).select("document_id", "n_bytes")
