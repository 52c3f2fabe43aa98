"""Corpus files, typed JSON lines, and catalog cards."""

from __future__ import annotations

import io
import subprocess
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lodestone import session
from lodestone.functions import text
from lodestone.functions.chunking import without_boilerplate

# Schemas of the tables, extensions and namespaces.
CONSTRAINT = "struct<param:string,op:string,value:double,value_max:double,unit:string,norm_value:double,norm_unit:string,source_text:string>"
SCHEMAS = {
    "documents": "doc_id string, path string, title string, authors array<string>, year int, lang string, geography string, source_folder string, is_core boolean",
    "texts": "doc_id string, text string, n_chars int",
    "chunks": "chunk_id string, doc_id string, text string, start int, end int, lang string, embedding array<float>",
    "catalog": "catalog_id string, path string, title string, kind string, year_from int, year_to int, n_files int, description string, embedding array<float>",
    "extractions": f"doc_id string, chunk_id string, entities array<struct<name:string,type:string,synonyms:array<string>,attrs:map<string,string>>>, relations array<struct<source:string,target:string,type:string,constraints:array<{CONSTRAINT}>,confidence:double>>, constraints array<{CONSTRAINT}>, model string, prompt_hash string",
    "targets": "doc_id string, topic string, matched_keywords array<string>, n_hits int",
    "doc_geography": "doc_id string, path string, geography string, method string, ru_hits int, foreign_hits int, evidence array<string>, snippet string",
}
SUPPORTED = (".pdf", ".docx", ".docm", ".doc", ".pptx")
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
CORE = {"title": "{http://purl.org/dc/elements/1.1/}title", "author": "{http://purl.org/dc/elements/1.1/}creator", "created": "{http://purl.org/dc/terms/}created"}


def read_jsonl(spark: SparkSession, path: str, kind: str, strict: bool = True, limit: int | None = None) -> DataFrame:
    """One typed record a line; a damaged one fails the read, or is left out. A limit is by the order of lines in the file."""
    rows = spark.read.schema(T._parse_datatype_string(SCHEMAS[kind])).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    if limit is None:
        return rows
    return with_order(rows).orderBy("row_ord").limit(limit).drop("row_ord")


def with_order(rows: DataFrame) -> DataFrame:
    """``row_ord`` of rows just read from files: file, where its part of the file begins, and place in it.

    It rises with the place of a row in its input, however files are dealt to tasks.
    """
    return rows.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("line")).alias("row_ord"))


def invalid(rows: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows with a value that isn't among the allowed ones (the reader doesn't check enumerations)."""
    return rows.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))


def files(spark: SparkSession, folder: str, core: tuple[str, ...]) -> DataFrame:
    """Files right in the core folders, without hidden ones: (path, rel_path, source_folder, ext, doc_id, supported, content)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", ""), rf"^.*?\Q{folder.rstrip('/').split(':')[-1].lstrip('/')}\E/", "")
    rows = raw.withColumn("rel_path", rel).withColumn("source_folder", F.regexp_extract("rel_path", r"^([^/]+)/[^/]+$", 1)).withColumn("name", F.regexp_extract("rel_path", r"([^/]+)$", 1))
    rows = rows.filter(F.col("source_folder").isin(*core) & ~F.col("name").startswith("."))
    ext = F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))
    return rows.select("path", "rel_path", "source_folder", ext.alias("ext"), text.short_sha1(F.col("rel_path")).alias("doc_id"), ext.isin(*SUPPORTED).alias("supported"), "content")


def _core(archive: zipfile.ZipFile) -> tuple[str, str, str]:
    if "docProps/core.xml" not in archive.namelist():
        return "", "", ""
    root = ElementTree.fromstring(archive.read("docProps/core.xml"))
    return tuple((root.findtext(tag) or "").strip() for tag in CORE.values())


def _word(archive: zipfile.ZipFile) -> list[str]:
    root = ElementTree.fromstring(archive.read("word/document.xml"))
    return ["".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in root.iter(f"{WORD}p")]


def _slides(archive: zipfile.ZipFile) -> list[str]:
    names = sorted((n for n in archive.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml")), key=lambda n: int("".join(filter(str.isdigit, n)) or 0))
    return ["".join(t.text or "" for t in p.iter(f"{DRAWING}t")) for n in names for p in ElementTree.fromstring(archive.read(n)).iter(f"{DRAWING}p")]


READERS = {".docx": _word, ".docm": _word, ".pptx": _slides}


#: (pages or paragraphs, title, author, created) of a file's bytes.
Backend = Callable[[bytes], tuple[list[str], str, str, str]]


def legacy_word(program: str = "soffice", seconds: int = 120) -> Backend:
    """A backend for old Word files by an office program on the executors: converted to a new one, then read as such."""

    def read(content: bytes) -> tuple[list[str], str, str, str]:
        with tempfile.TemporaryDirectory() as folder:
            with open(f"{folder}/in.doc", "wb") as f:
                f.write(content)
            subprocess.run([program, "--headless", "--convert-to", "docx", "--outdir", folder, f"{folder}/in.doc"], check=True, timeout=seconds, capture_output=True)
            with zipfile.ZipFile(f"{folder}/in.docx") as archive:
                return _word(archive), *_core(archive)

    return read


def pdf_pages(content: bytes) -> tuple[list[str], str, str, str]:
    """A backend for PDF by the ``pypdf`` library, where it is installed; a page each."""
    import pypdf

    reader = pypdf.PdfReader(io.BytesIO(content))
    if reader.is_encrypted:
        raise ValueError("encrypted")
    meta = reader.metadata or {}
    return [p.extract_text() or "" for p in reader.pages], *(str(meta.get(k) or "").strip() for k in ("/Title", "/Author", "/CreationDate"))


def convert(content: bytes, ext: str, backends: dict[str, Backend] | None = None) -> tuple[list[str] | None, str, str, str, str | None]:
    """(pages, title, author, created, error) of a file; formats without a reader of ours need a backend, which may fail in any way."""
    if backend := (backends or {}).get(ext):
        try:
            return *backend(content), None
        except Exception as error:
            return None, "", "", "", f"INGEST-001: {type(error).__name__}: {error}"[:300]
    if ext not in READERS:
        return None, "", "", "", f"INGEST-001: no reader for {ext or 'files without extension'}"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            lines = [x for x in READERS[ext](archive) if x.strip()]
            return ["\n".join(lines)], *_core(archive), None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as error:
        return None, "", "", "", f"INGEST-001: {error}"


#: Formats whose texts are pages with running headers.
PAGED = (".pdf",)


def documents(found: DataFrame, this_year: int, least_chars: int = 200, backends: dict[str, Backend] | None = None) -> DataFrame:
    """Converted, cleaned documents with metadata, and ``error`` (code, reason) on those that failed or are too short.

    Running headers and footers go from paged formats. ``backends`` by extension read what this module can't.
    """
    session.prepare(found.sparkSession)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [convert(bytes(c), e, backends) for c, e in zip(frame["content"], frame["ext"])]
            yield frame.drop(columns="content").assign(**{k: [o[i] for o in out] for i, k in enumerate(("pages", "meta_title", "author", "created", "failure"))})

    columns = "path string, rel_path string, source_folder string, ext string, doc_id string, supported boolean"
    rows = found.mapInPandas(read, f"{columns}, pages array<string>, meta_title string, author string, created string, failure string")
    if any(ext in (backends or {}) for ext in PAGED):
        rows = session.stored(rows, "converted")  # read twice, converted once
        pages = rows.filter(F.col("ext").isin(*PAGED) & F.col("pages").isNotNull()).select("doc_id", F.posexplode("pages").alias("page", "text"))
        rows = rows.join(without_boilerplate(pages).withColumnRenamed("text", "body"), "doc_id", "left")
    else:
        rows = rows.withColumn("body", F.lit(None).cast("string"))
    rows = rows.withColumn("raw", F.coalesce("body", F.array_join("pages", "\n")))
    clean = F.coalesce(text.clean_whitespace(F.col("raw")), F.lit(""))
    rows = rows.withColumn("text", clean).withColumn("stem", F.regexp_extract("rel_path", r"([^/]+?)(\.[^./]*)?$", 1))
    failed = F.when(F.col("failure").isNotNull(), F.struct(F.lit("INGEST-001").alias("code"), F.col("failure").alias("reason")))
    short = F.when(F.length("text") < least_chars, F.struct(F.lit("INGEST-002").alias("code"), F.concat(F.length("text").cast("string"), F.lit(" characters")).alias("reason")))
    made = text.year_of_pdf_date(F.col("created"))
    return rows.select("doc_id", F.col("rel_path").alias("path"), text.title(F.col("meta_title"), F.col("stem")).alias("title"), text.split_authors(F.col("author")).alias("authors"), text.year(F.col("stem"), made, F.col("text"), this_year).alias("year"), text.detect_lang(F.col("text")).alias("lang"), F.lit("unknown").alias("geography"), "source_folder", F.lit(True).alias("is_core"), "text", F.coalesce(failed, short).alias("error"))


def cards(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """(card, n_files): each file counts for the deepest card folder above it. Folders of a path are exploded and equi-joined, not compared with all cards."""
    parts = F.split("path", "/")
    above = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("card"))
    best = above.join(folders.select("card").distinct(), "card").groupBy("path").agg(F.max_by("card", F.length("card")).alias("card"))
    return folders.select("card").distinct().join(best.groupBy("card").agg(F.count(F.lit(1)).alias("n")), "card", "left").select("card", F.coalesce("n", F.lit(0)).alias("n_files"))
