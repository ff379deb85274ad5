"""Documents from files, pages and JSON. A bad file becomes a row with an error, never a failed job."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

TEXT, PAGES = ("txt", "md"), ("html", "htm")
SUPPORTED = (*TEXT, *PAGES, "docx", "pdf")


def scan(spark: SparkSession, path: str, recursive: bool = True, extensions: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """(source, filename, extension, size_bytes, content): files below a path; the extension filter prunes before content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return files.select(F.col("path").alias("source"), name.alias("filename"), ext.alias("extension"), F.col("length").alias("size_bytes"), "content").where(F.col("extension").isin(*extensions))


def docx_text(raw: bytes) -> str:
    """Non-empty paragraphs, joined by a blank line."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    parts = ("".join(t.text or "" for t in p.iter(f"{ns}t")) for p in root.iter(f"{ns}p"))
    return "\n\n".join(p for p in parts if p.strip())


def pdf_text(raw: bytes) -> str:
    """Non-empty pages, joined by a blank line; needs an optional parser."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("no PDF parser is installed") from e
    pages = (p.extract_text() or "" for p in PdfReader(io.BytesIO(raw)).pages)
    return "\n\n".join(p.strip() for p in pages if p.strip())


def load(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(source, filename, extension, size_bytes, text, error) of every supported file below a path."""
    files = scan(spark, path, recursive)
    keep = ["source", "filename", "extension", "size_bytes"]
    valid = F.try_validate_utf8(F.col("content").cast("string"))
    files = files.withColumn("valid", F.when(F.col("extension").isin(*TEXT, *PAGES), valid))
    error = F.when(F.col("valid").isNull(), "not UTF-8").alias("error")
    plain = files.where(F.col("extension").isin(*TEXT)).select(*keep, F.col("valid").alias("text"), error)
    pages = files.where(F.col("extension").isin(*PAGES)).select(*keep, tx.strip_html(F.col("valid")).alias("text"), error)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                try:
                    out.append((docx_text(r.content) if r.extension == "docx" else pdf_text(r.content), None))
                except Exception as e:  # the row carries it
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield frame[keep].assign(text=[x[0] for x in out], error=[x[1] for x in out])

    other = files.where(F.col("extension").isin("docx", "pdf")).select(*keep, "content").mapInPandas(run, "source string, filename string, extension string, size_bytes long, text string, error string")
    return plain.unionByName(pages).unionByName(other)


def pages(df: DataFrame, html: str = "html") -> DataFrame:
    """Fetched pages: title and the text of their main part, without navigation."""
    part = tx.main_part(F.col(html))
    return df.withColumn("title", tx.html_title(F.col(html))).withColumn("text", tx.strip_html(part, ("script", "style", "nav", "footer", "header")))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents (id, content, metadata); a missing id becomes doc_ and a hash of the content."""
    df = spark.read.schema("id string, content string, metadata map<string,string>").json(path)
    return df.withColumn("id", F.coalesce("id", F.concat(F.lit("doc_"), F.substring(F.md5("content"), 1, 8))))


def new_only(docs: DataFrame, known: DataFrame, name: str = "filename", content: str = "text") -> DataFrame:
    """Rows whose upload key (name and the first 8 digits of the content's md5) no known row has in source_file."""
    keyed = docs.withColumn("source_file", F.concat_ws("_", F.col(name), F.substring(F.md5(content), 1, 8)))
    return keyed.join(known.select("source_file"), "source_file", "left_anti")
