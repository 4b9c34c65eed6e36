"""Scans of files: plain text, Markdown, HTML and line-delimited JSON, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Extensions the router knows and the scan each belongs to.
ROUTES = {"txt": "text", "text": "text", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "json": "json", "jsonl": "jsonl", "docx": "office", "pptx": "office", "xlsx": "office", "xlsm": "office"}


def route(path: str) -> str:
    """Scan for a path by its extension; an unknown one raises ``ValueError``."""
    extension = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if extension not in ROUTES:
        raise ValueError(f"no scan for extension {extension!r}")
    return ROUTES[extension]


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``(path, content)``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def markdown_sections(documents: DataFrame) -> DataFrame:
    """Sections of Markdown documents ``(doc_id, content)``: a header opens one, fences hide headers.

    Text before the first header is section 0 without a title.
    """
    lines = documents.select("doc_id", F.posexplode(F.split("content", "\r?\n")).alias("line_no", "line"))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    fenced = lines.withColumn("inside", F.sum(fence.cast("int")).over(order) % 2)
    header = (F.col("inside") == 0) & ~fence & F.col("line").rlike(r"^#{1,6}\s+\S")
    numbered = fenced.withColumn("is_header", header).withColumn("section_no", F.sum(header.cast("int")).over(order))
    grouped = numbered.groupBy("doc_id", "section_no").agg(F.sort_array(F.collect_list(F.struct("line_no", "line", "is_header"))).alias("rows"))
    title = F.regexp_extract(F.get(F.filter("rows", lambda r: r["is_header"]), F.lit(0))["line"], r"^#{1,6}\s+(.*?)\s*#*\s*$", 1)
    body = F.trim(F.array_join(F.transform(F.filter("rows", lambda r: ~r["is_header"]), lambda r: r["line"]), "\n"))
    return grouped.select("doc_id", "section_no", F.nullif(title, F.lit("")).alias("title"), body.alias("content")).where((F.col("section_no") > 0) | (F.col("content") != ""))


class _Blocks(HTMLParser):
    """Headings, paragraphs, list items and tables of a page; scripts and styles are skipped."""

    SKIP = frozenset({"script", "style", "noscript"})
    TEXT = frozenset({"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "caption", "blockquote", "pre", "div"})

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.kind, self.parts, self.skipped, self.table = "p", [], 0, None

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((self.kind, text))
        self.parts = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skipped += 1
        elif tag == "table":
            self.flush()
            self.table = []
        elif self.table is not None:
            if tag == "tr":
                self.table.append([])
            elif tag in ("td", "th"):
                self.parts = []
        elif tag in self.TEXT:
            self.flush()
            self.kind = "heading" if tag[0] == "h" and tag[1:].isdigit() else "caption" if tag == "caption" else "list_item" if tag == "li" else "paragraph"

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif self.table is not None:
            if tag in ("td", "th"):
                cell = " ".join("".join(self.parts).split())
                self.parts = []
                if self.table:
                    self.table[-1].append(cell)
            elif tag == "table":
                rows = [" | ".join(r) for r in self.table if any(r)]
                self.table = None
                if rows:
                    self.blocks.append(("table", "\n".join(rows)))
        elif tag in self.TEXT:
            self.flush()
            self.kind = "paragraph"

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.parts.append(data)


def html_blocks(documents: DataFrame) -> DataFrame:
    """Blocks of HTML documents ``(doc_id string, content)`` in reading order."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, content in zip(batch["doc_id"], batch["content"]):
                parser = _Blocks()
                parser.feed(content or "")
                parser.close()
                parser.flush()
                out += [(doc_id, i, kind, text) for i, (kind, text) in enumerate(parser.blocks)]
            yield pd.DataFrame(out, columns=["doc_id", "order", "block_type", "text"])

    return documents.select("doc_id", "content").mapInPandas(scan, "doc_id string, order int, block_type string, text string")


def read_jsonl(spark: SparkSession, path: str, schema: str, session_id: str | None = None) -> DataFrame:
    """Line-delimited JSON; bad lines are dropped, both spellings of the session field are read."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.where("_bad IS NULL").drop("_bad")
    return rows if session_id is None else rows.where(F.coalesce(*(F.col(c) for c in ("sessionId", "session_id") if c in rows.columns)) == session_id)


def newest_first(rows: DataFrame, time: str, key: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of rows, the newest first (ties: the larger key); rows without a time come last."""
    return rows.orderBy(F.col(time).desc_nulls_last(), F.col(key).desc()).offset(offset).limit(limit)


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON reports ``(path, modified, report)`` below a folder; files that are no JSON object are left out.

    Reports are small; each is read whole by the task that lists it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    text = F.decode("content", "UTF-8")
    rows = files.select("path", F.col("modificationTime").alias("modified"), text.alias("text")).where(F.ltrim("text").startswith("{"))
    parsed = rows.select("path", "modified", F.from_json("text", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("report"))
    return parsed.where("report IS NOT NULL AND report._bad IS NULL").select("path", "modified", F.col("report").dropFields("_bad").alias("report"))


def latest_report(reports: DataFrame, key: Column) -> DataFrame:
    """The newest report of each key (ties: the larger path)."""
    best = F.max(F.struct("modified", "path", "report")).alias("b")
    return reports.groupBy(key.alias("key")).agg(best).select("key", "b.path", "b.modified", "b.report")
