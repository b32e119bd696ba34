"""Corpus readers: files and tables to elements and documents."""

from __future__ import annotations

import html.parser
import io
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import lookup, nfkc, strip
from ..session import settled

# ---- fixed values -------------------------------------------------------------
MIME = {"txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "json": "application/json", "jsonl": "application/x-ndjson", "html": "text/html", "xml": "application/xml", "pdf": "application/pdf", "parquet": "application/vnd.apache.parquet"}
BLOCK_TAGS = frozenset(("p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "header", "footer", "blockquote", "pre"))
DELIMITERS = (",", ";", "\t", "|")
# -------------------------------------------------------------------------------


def text_elements(rows: DataFrame, key: str, text: str) -> DataFrame:
    """SRC1: blocks between blank lines, stripped, empty ones left out: key, element_index, text."""
    plain = F.regexp_replace(F.regexp_replace(F.col(text), "^﻿", ""), "\r\n|\r", "\n")
    blocks = F.filter(F.transform(F.split(plain, "\n\n+"), strip), lambda b: b != "")
    return rows.select(key, F.posexplode(blocks).alias("element_index", "text"))


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """SRC2: the known delimiter that comes as often in most of the first lines (8,192 characters at most) as in the header, and most often there."""
    lines, size = [], 0
    for (line,) in spark.read.text(path).limit(200).collect():
        size += len(line) + 1
        if size > 8192 and lines:
            break
        lines.append(line)
    if not lines or not lines[0].strip():
        raise ValueError("a CSV file needs a header")
    return max(DELIMITERS, key=lambda d: (lines[0].count(d) > 0, sum(x.count(d) == lines[0].count(d) for x in lines), lines[0].count(d)))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: all columns as text; a header and a row are required. The files under one path have one delimiter."""
    rows = spark.read.csv(path, header=True, sep=sniff_delimiter(spark, path), encoding="UTF-8")
    if rows.isEmpty():
        raise ValueError("a CSV file needs data rows")
    return rows


def read_json_records(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """SRC3: each record as a map in key order; undecodable input is an error."""
    kind = "map<string,string>"
    if lines:
        raw = spark.read.text(path).where(F.trim("value") != "")
        return raw.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("record"))
    raw = spark.read.text(path, wholetext=True)
    many = F.col("value").rlike(r"^\s*\[")
    parsed = F.when(many, F.from_json("value", f"array<{kind}>", {"mode": "FAILFAST"})).otherwise(F.array(F.from_json("value", kind, {"mode": "FAILFAST"})))
    return raw.select(F.explode(parsed).alias("record"))


def record_line(record: Column) -> Column:
    """SRC4: ``k: v`` joined by `` | ``; a null value is empty."""
    return F.array_join(F.transform(F.map_entries(record), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), " | ")


def read_topics(spark: SparkSession, path: str, languages: list[str], row_tag: str = "health-topic") -> DataFrame:
    """SRC5: a topic XML feed: id, title, url, language, content of the wanted languages; rows lacking one are left out."""
    raw = spark.read.format("xml").option("rowTag", row_tag).load(path)
    many = lambda c: F.array_distinct(F.from_json(F.to_json(F.col(f"`{c}`")), "array<string>")) if c in raw.columns else F.array().cast("array<string>")
    summary = html_text(F.col("`full-summary`"))
    content = F.concat_ws("\n\n", F.col("_title"), summary, F.array_join(many("also-called"), ", "))
    return raw.where(F.col("_language").isin(languages)).select(F.col("_id").cast("string").alias("id"), F.substring(F.col("_title"), 1, 200).alias("title"), F.substring(F.col("_url"), 1, 300).alias("url"), F.col("_language").alias("language"), F.substring(content, 1, 200_000).alias("content")).where("id is not null and title <> '' and url <> '' and content <> ''")


class _Text(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.shown, self.hidden = [], [], 0  # all text, and that outside of scripts and styles

    def cut(self, tag):
        if tag in BLOCK_TAGS:
            self.out.append("\n")
            self.shown.append("\n")

    def handle_starttag(self, tag, attrs):
        self.cut(tag)
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.cut(tag)
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        self.out.append(data)
        if not self.hidden:
            self.shown.append(data)


def html_to_texts(value: str) -> tuple[str, str]:
    """The lines of text with and without those of scripts and styles, in one reading."""
    parser = _Text()
    parser.feed(value)
    parser.close()

    def lines(parts):
        cut = (" ".join(line.split()) for line in "".join(parts).split("\n"))
        return "\n".join(line for line in cut if line)

    return lines(parser.out), lines(parser.shown)


def html_to_text(value: str, drop_script: bool = False) -> str:
    return html_to_texts(value)[drop_script]


PAGES = 64  # pages that a task holds as Python strings
PAGE_CHARS = 1 << 20  # and characters of them


def html_texts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """SRC6, UDF4 over a table: key, text, plain (without scripts and styles). A task holds a few pages at once, not those of a whole Arrow batch."""
    given = pages.select(key, F.col(html).alias("_html"))
    schema = StructType([given.schema[key], StructField("text", StringType()), StructField("plain", StringType())])

    def run(batches):
        for batch in batches:
            first, texts, chars = 0, [], 0
            for k, value in enumerate(batch.column(1)):
                value = value.as_py()
                texts.append((None, None) if value is None else html_to_texts(value))
                chars += len(value or "")
                if len(texts) >= PAGES or chars >= PAGE_CHARS or k + 1 == len(batch):
                    both = [pa.array(c, pa.string()) for c in zip(*texts, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *both], names=[key, "text", "plain"])
                    first, texts, chars = k + 1, [], 0

    return given.mapInArrow(run, schema)


@F.pandas_udf(StringType())
def html_text(value: pd.Series) -> pd.Series:
    """SRC6, UDF4: lines of text; script and style text stays."""
    return value.map(lambda v: None if v is None else html_to_text(v))


@F.pandas_udf(StringType())
def html_text_plain(value: pd.Series) -> pd.Series:
    """SRC6 without the text of scripts and styles."""
    return value.map(lambda v: None if v is None else html_to_text(v, True))


def read_qa(spark: SparkSession, path: str, limit: int | None = None, max_bytes: int = 1_000_000) -> DataFrame:
    """SRC7: QA JSON lines: row_index (the line's number, files in the order of their paths), question, answer: all strings, nested or not, different ones in order, joined."""
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    # a part of a file is read by one task, in order: what stands before it is a sum over parts, of which there are as many as tasks
    parts = read.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = settled(parts.select(F.xxhash64("file").alias("f"), "block", (before - F.col("first")).alias("shift")))
    shifts = F.broadcast(shifts) if shifts.count() <= 1_000_000 else shifts
    numbered = read.withColumn("f", F.xxhash64("file")).join(shifts, ["f", "block"])
    raw = numbered.select("value", (F.col("at") + F.col("shift")).alias("row_index")).where(F.octet_length("value") <= max_bytes)

    def strings(field: str) -> Column:
        text = F.get_json_object("value", f"$.{field}")
        found = F.transform(F.regexp_extract_all(text, F.lit(r'"((?:[^"\\]|\\.)*)"'), 1), lambda s: F.get_json_object(F.concat(F.lit('{"s":"'), s, F.lit('"}')), "$.s"))
        return F.array_join(F.array_distinct(F.filter(F.transform(found, strip), lambda s: s != "")), "；")

    rows = raw.select("row_index", F.substring(strings("questions"), 1, 2000).alias("question"), F.substring(strings("answers"), 1, 50_000).alias("answer")).where("question <> '' and answer <> ''")
    return rows if limit is None else rows.orderBy("row_index").limit(limit)


def qa_documents(rows: DataFrame, base: str) -> DataFrame:
    """SRC8: title, source, content from row_index, question, answer."""
    title = F.substring(F.regexp_replace("question", "[?？]+$", ""), 1, 200)
    return rows.select(title.alias("title"), F.format_string(base + "#row=%d", "row_index").alias("source"), F.concat_ws("\n\n", F.concat(F.lit("# "), title), F.concat(F.lit("## 问题\n"), "question"), F.concat(F.lit("## 数据集答案\n"), "answer")).alias("content"))


def catalog_errors(sources: DataFrame, hosts: list[str], tiers: list[str]) -> DataFrame:
    """SRC9: key and the rules that a catalog entry breaks: host, sha256, tier, or a repeated key, title, filename or url."""
    host = F.regexp_extract("url", "^https://([^/]+)", 1)
    out = sources.select("key", F.array_compact(F.array(F.when(~host.isin(hosts), "host"), F.when(~F.col("sha256").rlike("^[0-9a-f]{64}$"), "sha256"), F.when(~F.col("trust_tier").isin(tiers), "tier"))).alias("broken"))
    for c in ("key", "title", "filename", "url"):
        again = sources.groupBy(c).agg(F.count("*").alias("n"), F.collect_list("key").alias("keys")).where("n > 1").select(F.explode("keys").alias("key")).distinct().withColumn("again", F.lit(True))
        out = out.join(again, "key", "left").withColumn("broken", F.when(F.col("again"), F.array_append("broken", F.lit(f"repeated {c}"))).otherwise(F.col("broken"))).drop("again")
    return out


def reconcile(sources: DataFrame, stored: DataFrame) -> DataFrame:
    """SRC9: each entry as skip (its hash is stored), conflict (its url or title is, with another hash) or create."""
    by_hash = stored.select("sha256", F.lit(True).alias("same")).distinct()
    by_url, by_title = stored.select("url", F.lit(True).alias("u")).distinct(), stored.select("title", F.lit(True).alias("t")).distinct()
    joined = sources.join(by_hash, "sha256", "left").join(by_url, "url", "left").join(by_title, "title", "left")
    return joined.select("key", F.when(F.col("same"), "skip").when(F.col("u") | F.col("t"), "conflict").otherwise("create").alias("action"))


def normalised_elements(elements: DataFrame, key: str, provenance: Column) -> DataFrame:
    """SRC10: NFKC and single blanks; a provenance element first."""
    clean = elements.select(key, (F.col("element_index") + 1).alias("element_index"), F.trim(F.regexp_replace(nfkc("text"), r"(?U)\s+", " ")).alias("text")).where("text <> ''")
    return elements.select(key).distinct().select(key, F.lit(0).alias("element_index"), provenance.alias("text")).unionByName(clean)


def read_new_files(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """SRC11: source and content of the files whose name is not known yet."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("content"))
    return files.join(known.select("source"), "source", "left_anti")


def register(files: DataFrame, declared: str = "declared") -> DataFrame:
    """SRC12: path, content in; sha256, mime by suffix and a warning if another was declared; empty and unknown ones left out."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    mime = lookup(MIME, suffix, "unsupported")
    out = files.where(F.length("content") > 0).withColumn("mime", mime).where("mime <> 'unsupported'").withColumn("sha256", F.sha2("content", 256))
    return out.withColumn("warning", F.when(F.col(declared).isNotNull() & (F.col(declared) != F.col("mime")), "declared type differs"))


def archive_entries(files: DataFrame) -> DataFrame:
    """SRC13: the entries of ZIP files: path, name, size, packed, encrypted."""

    def run(frames):
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(path, i.filename, i.file_size, i.compress_size, bool(i.flag_bits & 1)) for i in z.infolist()]
            yield pd.DataFrame(rows, columns=["path", "name", "size", "packed", "encrypted"])

    return files.select("path", "content").mapInPandas(run, "path string, name string, size long, packed long, encrypted boolean")


def archive_audit(entries: DataFrame, max_entries: int = 10_000, max_entry: int = 100_000_000, max_total: int = 500_000_000, max_ratio: float = 100.0) -> DataFrame:
    """SRC13: the verdict on each archive."""
    unsafe = F.col("name").rlike(r"^/|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)")
    ratio = F.when(F.col("size") >= 1_000_000, F.col("size") / F.greatest(F.col("packed"), F.lit(1)))
    a = entries.groupBy("path").agg(F.count("*").alias("n"), F.max("size").alias("largest"), F.sum("size").alias("total"), F.max(ratio).alias("ratio"), F.bool_or(unsafe).alias("unsafe"), F.bool_or("encrypted").alias("locked"), F.bool_or(F.col("name").rlike("(?i)vbaProject\\.bin$")).alias("macro"))
    verdict = F.when(F.col("n") > max_entries, "too many entries").when(F.col("unsafe"), "unsafe path").when(F.col("locked"), "encrypted").when(F.col("macro"), "macro").when(F.col("largest") > max_entry, "entry too large").when(F.col("total") > max_total, "too large").when(F.col("ratio") > max_ratio, "ratio").otherwise("ok")
    return a.select("path", "n", "total", verdict.alias("verdict"))
