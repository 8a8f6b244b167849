"""Reading documents: files, pages, validation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.text import content_id, is_pdf, strip, title_of


def form_feed_pages(content: bytes) -> list[str]:
    """Pages of a plain text file, one after each form feed."""
    return content.decode("utf-8", "replace").split("\f")


def pdf_pages(content: bytes) -> list[str]:
    """Pages of a PDF, where a PDF library is installed."""
    try:
        import pymupdf
    except ImportError as e:
        raise RuntimeError("reading PDF files needs PyMuPDF on the executors; pass another parser") from e
    with pymupdf.open(stream=content, filetype="pdf") as pdf:
        return [page.get_text() or "" for page in pdf]


def read_files(spark: SparkSession, path: str, parser: Callable[[bytes], list[str]] = form_feed_pages, glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``documents`` and ``pages`` of the files under a path. The parser runs on the executors, a file at a time."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    named = files.select(content_id(F.col("content")).alias("doc_id"), F.col("path").alias("filename"), F.col("modificationTime").alias("at"), "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, texts = [], [], []
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, page in enumerate(parser(content), 1):
                    ids.append(doc_id)
                    numbers.append(i)
                    texts.append(page)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], ["doc_id", "page_no", "content"])

    pages = named.dropDuplicates(["doc_id"]).select("doc_id", "content").mapInArrow(parse, "doc_id string, page_no int, content string")
    counts = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"))
    docs = named.groupBy("doc_id").agg(F.min("filename").alias("filename"), F.min("at").alias("uploaded_at")).join(counts, "doc_id", "left")
    return docs.select(F.col("doc_id").alias("id"), title_of(F.col("filename")).alias("title"), "filename", F.coalesce("page_count", F.lit(0)).alias("page_count"), "uploaded_at"), pages


def accepted(docs: DataFrame, pages: DataFrame, only_pdf: bool = False) -> DataFrame:
    """Documents with a page that is not blank, and of the right kind of file."""
    written = pages.where(strip(F.coalesce("content", F.lit(""))) != "").select(F.col("doc_id").alias("id")).distinct()
    out = docs.join(written, "id", "left_semi")
    return out.where(is_pdf(F.col("filename"))) if only_pdf else out


def pages_of(pages: DataFrame, doc_id: str) -> DataFrame:
    return pages.where(F.col("doc_id") == doc_id).orderBy("page_no")
