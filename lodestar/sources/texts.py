"""Text, subtitle, URL-list and delimited sources."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from .records import file_path

# How sources are read, by extension.
KINDS = {"txt": "text", "md": "text", "vtt": "transcript", "srt": "transcript", "pdf": "pdf", "docx": "docx", "urls": "url"}
# Hours may have any number of digits; they begin where the digits do.
CUE = r"((?:(?<!\d)\d++:)?\d{2}:\d{2})[.,]\d{3}\s*-->\s*((?:(?<!\d)\d++:)?\d{2}:\d{2})[.,]\d{3}"
# White space as in the SQL of these sources: without the vertical tab, which Java counts among it.
SPACE = r"[ \t\n\f\r]+"


def walk(spark: SparkSession, folder: str) -> DataFrame:
    """(source_id, path, kind) of every visible file, numbered by path, those of unknown kind too."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(file_path().alias("path"))
    files = files.where(~F.regexp_extract("path", r"([^/]+)$", 1).startswith("."))
    kinds = F.create_map(*(F.lit(x) for p in KINDS.items() for x in p))
    extension = F.when(F.col("path").endswith("urls.txt"), "urls").otherwise(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    files = numbered(files, [], [F.col("path")])
    return files.select(F.concat(F.lit("S"), F.lpad(F.col("__n").cast("string"), F.greatest(F.lit(3), F.length(F.col("__n").cast("string"))), F.lit("0"))).alias("source_id"), "path", F.try_element_at(kinds, extension).alias("kind"))


def split_paragraphs(text: Column, edge: str = r"\n\s*\n") -> Column:
    """Trimmed pieces between edges (blank lines), those with a character."""
    return F.filter(F.transform(F.split(text, edge), lambda p: F.trim(p, F.lit(" \n\t"))), lambda p: p != "")


def paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, position, text): paragraphs between blank lines; the title is a first line of under 120 characters."""
    raw = spark.read.text(path, wholetext=True).select(file_path().alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    first = F.trim(F.split("value", "\n")[0])
    pieces = split_paragraphs(F.col("value"))
    return raw.select("path", F.when((F.length(first) > 0) & (F.length(first) < 120), F.regexp_replace(first, "^#+\\s*", "")).alias("title"), F.posexplode(pieces).alias("position", "text"))


def cues(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, timecode, text) of subtitle files; milliseconds, cue numbers and headers are dropped."""
    raw = spark.read.text(path, wholetext=True).select(file_path().alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    blocks = F.filter(F.split("value", r"\n\s*\n"), lambda b: b.rlike(CUE))
    each = raw.select("path", F.posexplode(blocks).alias("position", "b"))
    body = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("b", r"(?s)^.*?" + CUE + r"[^\n]*\n?", ""), "<[^>]+>", ""), SPACE, " "))
    return each.select("path", "position", F.regexp_extract("b", CUE, 1).alias("timecode"), body.alias("text")).where("text <> ''")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a list, one a line; lines that begin with # are comments."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> '' AND NOT url LIKE '#%'")


def docx_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, created, position, text) of DOCX files: paragraphs of the body with a character, numbered with the empty ones from 1 on.

    A DOCX file is a zip of XML parts; files that aren't are left out.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select(file_path().alias("path"), "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, dc, terms = ("{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://purl.org/dc/elements/1.1/}", "{http://purl.org/dc/terms/}")
        mark = {f"{w}t": lambda e: e.text or "", f"{w}tab": lambda e: "\t", f"{w}br": lambda e: "\n", f"{w}cr": lambda e: "\n"}
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
                        core = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else None
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                about = lambda tag: None if core is None else core.findtext(tag)  # noqa: B023, E731
                title = about(f"{dc}title") or name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                for i, p in enumerate(body.findall(f"{w}p") if body is not None else [], 1):
                    text = "".join(mark[e.tag](e) for e in p.iter() if e.tag in mark).strip()
                    if text:
                        rows.append((name, title, about(f"{terms}created"), i, text))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)], ["path", "title", "created", "position", "text"])

    return raw.mapInArrow(read, "path string, title string, created string, position int, text string")


def clean_pdf_date(column: str):
    """D:YYYYMMDD... as an ISO date."""
    return F.when(F.col(column).rlike(r"^(D:)?\d{8}"), F.regexp_replace(F.regexp_extract(column, r"^(?:D:)?(\d{8})", 1), r"(\d{4})(\d{2})(\d{2})", "$1-$2-$3"))


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file with a header as strings: UTF-8 with or without a byte-order mark if all of it is that, else Latin-1.

    The delimiter is guessed from the first lines. Columns without a name and without values are dropped.
    """
    head = [r["value"] for r in spark.read.text(path).limit(20).collect()]
    try:
        sep = csv.Sniffer().sniff("\n".join(head), ",\t;|").delimiter
    except csv.Error:
        sep = "\t" if path.endswith(".tsv") else ","
    # Every line is looked at: one that isn't UTF-8 decides for the file.
    bad = spark.read.text(path).agg(F.bool_or(~F.is_valid_utf8("value")).alias("bad")).first()["bad"]
    encoding = "ISO-8859-1" if bad else "UTF-8"
    df = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", True).csv(path)
    df = df.toDF(*(c.lstrip("\ufeff") for c in df.columns))
    unnamed = [c for c in df.columns if c.startswith(("_c", "Unnamed:"))]
    if unnamed:
        filled = df.agg(*(F.count(f"`{c}`").alias(c) for c in unnamed)).first()
        df = df.drop(*(c for c in unnamed if not filled[c]))
    return df
