"""Documents from folders of files, and results to files.

Every reader takes the bytes of files through Spark, so any store that Spark reads will do. Formats that need a model or
a library that isn't part of Spark (PDF, images) go through a backend that the caller registers, page by page in pages.py.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The extensions that count as documents.
EXTENSIONS = ("pdf", "docx", "txt", "html", "htm", "json", "csv", "png", "jpg", "jpeg", "tif", "tiff", "bmp")
SHORT, FEW = 200, 15


def read_txt(data: bytes) -> str:
    return data.decode("utf-8", "ignore")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style", "template")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style", "template") and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def html_text(html: str | None) -> str:
    """The text nodes, one per line."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return "\n".join(parser.parts)


def read_html(data: bytes) -> str:
    return html_text(read_txt(data))


def string_leaves(value: object) -> list[str]:
    """The strings of a JSON value, depth first; keys, numbers and booleans are no text."""
    if isinstance(value, str):
        return [value]
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [s for x in inner for s in string_leaves(x)]


def read_json(data: bytes) -> str:
    return "\n".join(string_leaves(json.loads(read_txt(data))))


def read_csv(data: bytes) -> str:
    """Rows without the header, cells joined by spaces."""
    rows = list(csv.reader(io.StringIO(read_txt(data))))
    return "\n".join(" ".join(row) for row in rows[1:])


def read_docx(data: bytes) -> str:
    """The paragraphs of the body; tables and headers aren't text."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{space}body")
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in body.findall(f"{space}p"))


def _no_backend(data: bytes) -> str:
    raise NotImplementedError("register a backend for this format: READERS[extension] = function of bytes")


#: Readers by extension, bytes in, text out; backends replace or add entries before reading.
READERS: dict[str, Callable[[bytes], str]] = {
    "txt": read_txt, "html": read_html, "htm": read_html, "json": read_json, "csv": read_csv, "docx": read_docx,
    **dict.fromkeys(("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp"), _no_backend),
}

def numbered(files: DataFrame) -> DataFrame:
    """(doc_ord, doc_id, path, file, format, content) of (path, content): the documents among them, numbered in order of path."""
    known = files.withColumn("format", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))).where(F.col("format").isin(*EXTENSIONS))
    names = known.select("path").withColumn("doc_ord", F.row_number().over(W.orderBy("path")))  # paths only; contents stay where they are
    out = known.join(names, "path").withColumn("doc_id", F.format_string("D%02d", "doc_ord")).withColumn("file", F.regexp_extract("path", r"([^/]+)$", 1))
    return out.select("doc_ord", "doc_id", "path", "file", "format", "content")


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """numbered() of the files in a folder; a folder without documents is an error."""
    out = numbered(spark.read.format("binaryFile").load(path).select("path", "content"))
    if out.select("path").isEmpty():
        raise FileNotFoundError(f"no documents in {path}")
    return out


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_ord, doc_id, file, format, text, error, is_short): a file that can't be read has an error and no text."""
    readers = dict(READERS)

    def run(parts):
        for part in parts:
            rows = []
            for kind, data in zip(part["format"], part["content"], strict=True):
                try:
                    rows.append((readers[kind](bytes(data)), None))
                except Exception as e:  # one bad file must not end the job; it is reported in its row
                    rows.append((None, f"{type(e).__name__}: {e}"))
            out = part[["doc_ord", "doc_id", "file", "format"]].copy()
            out["text"], out["error"] = [r[0] for r in rows], [r[1] for r in rows]
            yield out

    found = files.select("doc_ord", "doc_id", "file", "format", "content").mapInPandas(run, "doc_ord int, doc_id string, file string, format string, text string, error string")
    return found.withColumn("is_short", F.length(F.trim("text")) < SHORT)


def document_map(pages: DataFrame) -> DataFrame:
    """(doc_id, text, pages, ocr_pages, unread_scanned_pages, ocr_mean_conf, ocr_repairs, ocr_unresolved_amounts) from page rows."""
    own = F.col("is_ocr")
    return pages.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n").alias("text"),
        F.count("*").alias("pages"), F.count_if(own).alias("ocr_pages"), F.count_if("unread").alias("unread_scanned_pages"), F.avg(F.when(own, F.col("confidence"))).alias("ocr_mean_conf"),
        F.coalesce(F.sum("repairs"), F.lit(0)).alias("ocr_repairs"), F.coalesce(F.sum("unresolved"), F.lit(0)).alias("ocr_unresolved_amounts"),
    )


def ocr_report(mapped: DataFrame, warn_below: float = 85.0) -> DataFrame:
    """Documents with recognised pages; low_confidence marks those to look at."""
    return mapped.where("ocr_pages > 0").withColumn("low_confidence", F.col("ocr_mean_conf") < warn_below)


def few_documents(docs: DataFrame, least: int = FEW) -> bool:
    """Whether a corpus is too small to say much."""
    return docs.limit(least).count() < least


def write_csv(df: DataFrame, path: str) -> DataFrame:
    """One CSV file with a header, for reports; returns df."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return df


def relevance_template(queries: DataFrame, path: str) -> DataFrame:
    """Judgements (query_id, query, relevant_docs) from CSV; an empty template is written where there is none."""
    spark = queries.sparkSession
    schema = "query_id string, query string, relevant_docs string"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        write_csv(queries.select("query_id", "query", F.lit("").alias("relevant_docs")), path)
    return spark.read.schema(schema).option("header", True).csv(path)


def judgements(template: DataFrame) -> DataFrame:
    """(query_id, doc_id) of the filled rows."""
    return template.select("query_id", F.explode(F.filter(F.split(F.coalesce("relevant_docs", F.lit("")), r"\s+"), lambda x: x != "")).alias("doc_id"))
