"""Scans of uploaded files, knowledge bases, reports, artifacts and state tables, and their sinks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as tx
from sparkloom.operators import relational as rel
from sparkloom.operators.views import LEAST_RATIO, PAGE_CHARS

HEAD_BYTES = 8192
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
WORD_PART = "word/document.xml"


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, size, content, content_hash of each file under a folder (SRC1, SNK15). Empty files give no row, which rejects them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), "content", F.sha2("content", 256).alias("content_hash"))


def with_format(files: DataFrame) -> DataFrame:
    """Adds format: PDF, DOCX, TXT or null (SRC1). Only zip files are opened, in Python."""

    def has_part(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"path": part["path"], "word": [_lists_part(x) for x in part["content"]]})

    zips = files.filter(F.substring("content", 1, 4) == F.lit(b"PK\x03\x04")).select("path", "content").mapInPandas(has_part, "path string, word boolean")
    head = F.substring("content", 1, HEAD_BYTES)
    return files.join(zips, "path", "left").withColumn("format", tx.format_name(head, F.coalesce("word", F.lit(False)))).drop("word")


def _lists_part(content: bytes) -> bool:
    try:
        return WORD_PART in zipfile.ZipFile(io.BytesIO(content)).namelist()
    except zipfile.BadZipFile:
        return False


def validated(files: DataFrame, max_bytes: int = 50 << 20) -> DataFrame:
    """Adds verdict (FLT10)."""
    return files.withColumn("verdict", tx.file_verdict(F.col("format"), F.col("size"), max_bytes))


def txt_paragraphs(files: DataFrame) -> DataFrame:
    """path, pos, text: parts between blank lines; bytes that are no UTF-8 become replacement characters (SRC6)."""
    body = F.decode("content", "utf-8")
    return files.select("path", F.posexplode(tx.paragraphs(body)).alias("pos", "text"))


def docx_items(content: bytes) -> list[tuple[str, str, str, list[tuple[str, str]]]]:
    """(kind, section, text, cells) in document order: heading-style paragraphs set the section; the first row of a table is its header (SRC5).

    Blank headers become col_i, empty cells are dropped, tables with fewer than two rows are skipped.
    """
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read(WORD_PART))
    body = root.find(f"{WORD}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{WORD}t")).strip()
    out, section = [], ""
    for node in body if body is not None else ():
        if node.tag == f"{WORD}p":
            style = node.find(f"{WORD}pPr/{WORD}pStyle")
            text = said(node)
            if style is not None and (style.get(f"{WORD}val") or "").lower().startswith("heading"):
                section = text or section
            elif text:
                out.append(("prose", section, text, []))
        elif node.tag == f"{WORD}tbl":
            rows = [[said(c) for c in r.findall(f"{WORD}tc")] for r in node.findall(f"{WORD}tr")]
            if len(rows) >= 2:
                heads = [h or f"col_{i}" for i, h in enumerate(rows[0])]
                for r in rows[1:]:
                    cells = [(h, c) for h, c in zip(heads, r) if c]
                    if cells:
                        out.append(("row", section, " | ".join(f"{h}: {c}" for h, c in cells), cells))
    return out


def parsed(files: DataFrame, pdf: Callable[[bytes], list[tuple[str, str, str, list[tuple[str, str]]]]] | None = None) -> DataFrame:
    """path, pos, kind (prose, row or error), section, text, cells of accepted files (SRC2).

    PDF goes through `pdf`, a function from bytes to items as `docx_items` gives them, with tables, prose and read page images (SRC3, SRC4); where
    none is given, and for files that can't be read, there is one row of kind error that says so.
    """

    def items(fmt: str, content: bytes) -> list[tuple]:
        if fmt == "PDF" and pdf is None:
            return [("error", "", "no reader for PDF", [])]
        try:
            return docx_items(content) if fmt == "DOCX" else pdf(content)
        except Exception as e:  # a file that can't be read is reported, the others go on
            return [("error", "", f"{type(e).__name__}: {e}"[:200], [])]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(path, i, *x[:3], dict(x[3])) for path, fmt, content in zip(part["path"], part["format"], part["content"]) for i, x in enumerate(items(fmt, content))]
            yield pd.DataFrame(rows, columns=["path", "pos", "kind", "section", "text", "cells"])

    read = files.filter("format IN ('DOCX', 'PDF')").select("path", "format", "content").mapInPandas(run, "path string, pos int, kind string, section string, text string, cells map<string,string>")
    txt = txt_paragraphs(files.filter("format = 'TXT'")).select("path", "pos", F.lit("prose").alias("kind"), F.lit("").alias("section"), "text", F.lit(None).cast("map<string,string>").alias("cells"))
    return read.unionByName(txt)


def with_ocr(pages: DataFrame, read: Callable[[pd.Series], pd.Series] | None, least: int = 20) -> DataFrame:
    """pages (text, image) with the text that `read` finds in the image where there are fewer than `least` characters; a failure gives '' (SRC3, SRC4)."""
    if read is None:
        return pages

    @F.pandas_udf("string")
    def seen(images: pd.Series) -> pd.Series:
        try:
            return read(images)
        except Exception:  # one unreadable page costs its text, not the job
            return pd.Series([""] * len(images))

    return pages.withColumn("text", F.when(F.char_length(F.trim(tx.text_or_empty(F.col("text")))) < least, F.coalesce(seen("image"), F.lit(""))).otherwise(F.col("text")))


def converted(files: DataFrame, first: Callable[[bytes], list[str]], second: Callable[[bytes], list[str]], least: float = LEAST_RATIO) -> DataFrame:
    """path, pages (array of texts), way (first, second or failed) and error of each file (SRC7).

    The second reader takes over where the first fails or finds less than `least` of the text that so many pages hold.
    """

    def read(reader: Callable[[bytes], list[str]], content: bytes) -> tuple[list[str] | None, str]:
        try:
            return list(reader(content)), ""
        except Exception as e:  # a reader that fails on a file leaves it to the other one
            return None, f"{type(e).__name__}: {e}"[:200]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"]):
                pages, error = read(first, content)
                way = "first"
                if pages is None or sum(map(len, pages)) < least * PAGE_CHARS * max(1, len(pages)):
                    more, error = read(second, content)
                    pages, way = (more, "second") if more is not None else (pages, "first" if pages is not None else "failed")
                rows.append((path, pages, way, error if way == "failed" else None))
            yield pd.DataFrame(rows, columns=["path", "pages", "way", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, pages array<string>, way string, error string")


def requirement_texts(items: DataFrame) -> DataFrame:
    """Rows of 10 characters or more; prose of 30 or more only where a file has no rows; excerpt of 500 characters (PRJ2, TXT19)."""
    rows = items.filter((F.col("kind") == "row") & (F.char_length("text") >= 10))
    prose = items.filter((F.col("kind") == "prose") & (F.char_length("text") >= 30)).join(rows.select("path").distinct(), "path", "left_anti")
    return rows.unionByName(prose).withColumn("excerpt", F.substring("text", 1, 500))


def knowledge_base(spark: SparkSession, entries: list[dict], columns: str = "id string, module string, feature string, description string") -> DataFrame:
    """Configuration rows as a table; an empty mandatory list is an error (SRC10)."""
    if not entries:
        raise ValueError("the knowledge base has no entries")
    names = [c.split()[0] for c in columns.split(", ")]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in entries], columns)


def yaml_entries(spark: SparkSession, path: str, required: bool = True) -> list:
    """The content of a YAML file in any store: hand-written configuration, read to the driver. A missing optional file is empty (SRC10, SRC12)."""
    import yaml

    try:
        text = spark.read.text(path, wholetext=True).first()
    except AnalysisException:
        if required:
            raise
        text = None
    return (yaml.safe_load(text[0]) if text else None) or []


def header_synonyms(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """The synonym table of a YAML file (canonical: [terms]), and the inverse map, where the first of equal terms wins (SRC12)."""
    from sparkloom.functions.headers import load_synonyms

    table = load_synonyms(spark, dict(yaml_entries(spark, path)))
    return table, {r.term: r.canonical for r in table.orderBy("ord").collect()}  # a hand-written file


def collections(spark: SparkSession, path: str) -> DataFrame:
    """collection, required: what the manifest.yaml files under a folder ask for; those that can't be read or name no product ask for nothing (SRC18)."""
    import yaml

    found = []
    for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.yaml").load(path).select("content").collect():  # one small file a module
        try:
            product = (yaml.safe_load(bytes(r.content).decode("utf-8")) or {}).get("product_id")
        except (yaml.YAMLError, UnicodeDecodeError, AttributeError):
            continue
        if product:
            found += [(f"{product}_capabilities", True), (f"{product}_docs", False)]
    return spark.createDataFrame(found, "collection string, required boolean").distinct()


def seed(rows: DataFrame, path: str, text: str | None = None, encode=None) -> int:
    """Write a collection, latest row per id, and return its size, which must not be 0 (SNK9, SNK11). With `text`, each row gets the vector of that column."""
    from sparkloom.operators import models

    if text:
        rows = rows.withColumn("vec", models.embedding(F.col(text), encode or models.hashed_words))
    rel.latest_by(rows, ["id"], [F.col(c) for c in rows.columns if c not in ("id", "vec")][:1] or [F.col("id")]).write.mode("overwrite").parquet(path)
    n = rows.sparkSession.read.parquet(path).count()
    if not n:
        raise ValueError("nothing was written")
    return n


def store_artifacts(rows: DataFrame, path: str, content: Column, kind: Column) -> None:
    """Content-addressed: artifact_id is the content's hash, files are split by artifact_type (SNK12)."""
    named = rows.withColumn("artifact_id", F.left(F.sha2(content.cast("binary"), 256), F.lit(16))).withColumn("artifact_type", kind)
    named.dropDuplicates(["artifact_type", "artifact_id"]).write.mode("append").option("compression", "snappy").partitionBy("artifact_type").parquet(path)


def list_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """artifact_type, file, size of stored files (SRC16)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return f.select(F.regexp_extract("path", r"artifact_type=([^/]+)/", 1).alias("artifact_type"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("size"))


def fetch_artifact(spark: SparkSession, path: str, artifact_id: str) -> DataFrame:
    """The artifact with an id, of whichever type; no row where there is none (SRC16)."""
    return spark.read.parquet(path).filter(F.col("artifact_id") == artifact_id)


def list_reports(spark: SparkSession, path: str) -> DataFrame:
    """file, size of the CSV files under a folder, by name (SRC17)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path)
    return f.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("size")).orderBy("path")


def read_reports(spark: SparkSession, path: str, report: str | None = None) -> DataFrame:
    """All reports, or one of them (SRC17)."""
    rows = spark.read.option("header", True).csv(path)
    return rows if report is None else rows.filter(F.col("report") == report)


def put_state(rows: DataFrame, path: str) -> None:
    """Append batch states (batch_id, field, value, at) (SNK13)."""
    rows.write.mode("append").parquet(path)


def put_gate_rows(rows: DataFrame, path: str, gate: int, at: Column) -> None:
    """Append the rows of a gate, one JSON text per atom, under the batch's field of that gate (SNK13). rows: batch_id, atom_id, ..."""
    body = F.to_json(F.struct(*(c for c in rows.columns if c != "batch_id")))
    put_state(rows.select("batch_id", F.concat(F.lit(f"gate_{gate}:"), F.col("atom_id").cast("string")).alias("field"), body.alias("value"), at.alias("at")), path)


def batch_index(spark: SparkSession, path: str, now: Column, ttl_s: int = 86_400) -> DataFrame:
    """batch_id, at: the batches with state that is still alive, newest first (SNK13)."""
    return get_state(spark, path, now, ttl_s).groupBy("batch_id").agg(F.max("at").alias("at")).orderBy(F.desc("at"), "batch_id")


def get_state(spark: SparkSession, path: str, now: Column, ttl_s: int = 86_400) -> DataFrame:
    """The last value of each field of each batch that is younger than the time to live (SRC14, STR8)."""
    rows = spark.read.parquet(path).filter(F.unix_timestamp(now) - F.unix_timestamp("at") < ttl_s)
    return rel.latest_by(rows, ["batch_id", "field"], [F.col("at")])


def ensure_table(spark: SparkSession, name: str, schema: str) -> None:
    """(SNK14)"""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")


def bootstrap(spark: SparkSession, tables: dict[str, str]) -> list[str]:
    """Create the tables (name -> schema) that aren't there yet, and say which these were (SNK14)."""
    new = [name for name in tables if not spark.catalog.tableExists(name)]
    for name in new:
        ensure_table(spark, name, tables[name])
    return new
