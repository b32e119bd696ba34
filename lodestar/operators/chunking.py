"""Texts to chunks, and elements to parents and children."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.text import ends_sentence

MARKS = re.compile(r"[\n。！？；]|[.!?;] ")  # fixed values: where a chunk may end


def cut(text: str, size: int, overlap: int) -> list[str]:
    """Windows of ``size`` that end after the last mark in their second half, if there is one; the next starts
    ``overlap`` before, or after the last mark in the ``overlap`` before that."""
    text = re.sub("[ \t]+", " ", text.replace("\r\n", "\n").replace("\r", "\n")).strip()
    starts = [m.start() for m in MARKS.finditer(text)]
    ends = [m.end() for m in MARKS.finditer(text)]

    def after(low: int, high: int) -> int:
        """The end of the last mark that lies whole within [low, high), or -1."""
        k = bisect_right(ends, high) - 1
        return ends[k] if k >= 0 and starts[k] >= low else -1

    out, at = [], 0
    while at < len(text):
        stop = min(at + size, len(text))
        if stop < len(text):
            stop = max(after(at + size // 2, stop), 0) or stop
        if piece := text[at:stop].strip():
            out.append(piece)
        if stop >= len(text):
            break
        want = max(stop - overlap, at + 1)
        snapped = after(max(at, want - overlap), want + 1)
        at = snapped if snapped > at else want
    return out


def _checked(size: int, overlap: int) -> None:
    if size < 100 or not 0 <= overlap < size:
        raise ValueError("size must be 100 or more, overlap from 0 to below size")


def split_udf(size: int = 600, overlap: int = 80):
    """UDF1: the chunks of a text. The cursor depends on each cut, so no built-in expresses it."""
    _checked(size, overlap)

    @F.pandas_udf("array<string>")
    def split(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [] if t is None else cut(t, size, overlap))

    return split


@F.udtf(returnType=StructType([StructField("chunk_index", IntegerType()), StructField("chunk", StringType())]))
class Chunks:
    """UDTF1: chunks(text, size, overlap) for SQL, with LATERAL."""

    def eval(self, text: str, size: int, overlap: int):
        yield from enumerate(cut(text or "", size, overlap))


OUT = 1 << 20  # characters that a task hands on at once


def _cut_rows(rows: DataFrame, names: list[str], text: str, size: int, overlap: int, index: str, out: str) -> DataFrame:
    """names, index, out: the chunks of each row. A task holds a few texts' chunks at once, not those of a whole Arrow batch."""
    _checked(size, overlap)
    given = rows.select(*names, F.col(text).alias("_text"))
    schema = StructType([*given.drop("_text").schema, StructField(index, IntegerType()), StructField(out, StringType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(len(names))

            def sent(source, at, pieces):
                kept = pa.Table.from_batches([batch]).select(names).take(pa.array(source, pa.int64()))
                for part in kept.append_column(index, pa.array(at, pa.int32())).append_column(out, pa.array(pieces, pa.string())).combine_chunks().to_batches():
                    yield part

            source, at, pieces, chars = [], [], [], 0
            for k in range(len(batch)):
                found = cut(texts[k].as_py() or "", size, overlap)
                source += [k] * len(found)
                at += range(len(found))
                pieces += found
                chars += sum(map(len, found))
                if chars >= OUT:
                    yield from sent(source, at, pieces)
                    source, at, pieces, chars = [], [], [], 0
            if pieces:
                yield from sent(source, at, pieces)

    return given.mapInArrow(run, schema)


def boundary_chunks(rows: DataFrame, key: str, text: str, size: int = 600, overlap: int = 80) -> DataFrame:
    """CHK1: key, chunk_index, chunk."""
    return _cut_rows(rows, [key], text, size, overlap, "chunk_index", "chunk")


def fixed_chunks(rows: DataFrame, key: str, text: str, size: int = 500, overlap: int = 50, more: list[str] = ()) -> DataFrame:
    """CHK2: windows of ``size`` every size - overlap characters; the last one reaches the end of the text. more: columns that come too."""
    step, n = size - overlap, F.length(text)
    count = F.greatest(F.lit(0), F.ceil((n - overlap) / step)).cast("int")
    count = F.when(n > 0, F.greatest(F.lit(1), count)).otherwise(0)
    starts = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step)).otherwise(F.array().cast("array<int>"))
    return rows.select(key, text, *more, F.posexplode(starts).alias("chunk_index", "start")).select(key, *more, "chunk_index", F.substring(F.col(text), F.col("start") + 1, F.lit(size)).alias("chunk"))


class _Parents:
    """The fold of CHK3 over elements in order, documents one after another; what is done is in ``rows``."""

    def __init__(self, parent_size: int):
        self.most, self.rows, self.chars = parent_size, [], 0
        self.document, self.index, self.begun = None, 0, False
        self.held, self.size, self.heading = [], 0, None

    def flush(self):
        if self.held:
            pages = [h[2] for h in self.held if h[2] is not None]
            text = "\n\n".join(h[1] for h in self.held)
            self.rows.append((self.document, self.index, text, self.held[0][0], self.held[-1][0], min(pages, default=None), max(pages, default=None), self.heading))
            self.index, self.chars = self.index + 1, self.chars + len(text)
            self.held, self.size, self.heading = [], 0, None

    def hold(self, element: int, text: str, page: int | None, heading: str | None):
        self.held.append((element, text, page))
        self.size, self.heading = self.size + len(text) + 2, self.heading or heading or None

    def add(self, document: int, element: int, text: str | None, page: int | None, heading: str | None):
        if not self.begun or document != self.document:
            self.flush()
            self.document, self.index, self.begun = document, 0, True
        text = re.sub("[ \t]+", " ", (text or "").replace("\r\n", "\n").replace("\r", "\n")).strip()
        if not text:
            return
        if self.held and (heading and heading != self.heading or self.size + len(text) > self.most):
            self.flush()
        if len(text) <= self.most:
            self.hold(element, text, page, heading)
            return
        for piece in cut(text, self.most, 0):
            self.hold(element, piece, page, heading)
            self.flush()

    def take(self) -> list[tuple]:
        rows, self.rows, self.chars = self.rows, [], 0
        return rows


def pack_parents(elements: DataFrame, parent_size: int = 1600) -> DataFrame:
    """CHK3: parents of each document: adjacent elements until the size or another heading; document_id, parent_index, text, element_start, element_end, page_start, page_end, heading.

    A task reads its documents' elements in order, one after another, and holds one parent.
    """
    names = ["document_id", "element_index", "text", "page_number", "heading"]
    kinds = ["long", "int", "string", "int", "string"]
    ordered = elements.select(*[F.col(n).cast(k).alias(n) for n, k in zip(names, kinds, strict=True)]).repartition("document_id").sortWithinPartitions("document_id", F.asc_nulls_last("element_index"))
    schema = pa.schema([("document_id", pa.int64()), ("parent_index", pa.int32()), ("text", pa.string()), ("element_start", pa.int32()), ("element_end", pa.int32()), ("page_start", pa.int32()), ("page_end", pa.int32()), ("heading", pa.string())])

    def run(batches):
        fold = _Parents(parent_size)

        def done():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*fold.take(), strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for at in range(0, len(batch), 1024):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True):
                    fold.add(*row)
                if fold.chars >= OUT:
                    yield done()
        fold.flush()
        if fold.rows:
            yield done()

    return ordered.mapInArrow(run, "document_id long, parent_index int, text string, element_start int, element_end int, page_start int, page_end int, heading string")


def children_of(parents: DataFrame, size: int = 350, overlap: int = 50) -> DataFrame:
    """CHK4: document_id, parent_id, child_index, text; parent_id is a hash of (document_id, parent_index)."""
    keyed = parents.withColumn("parent_id", F.xxhash64("document_id", "parent_index"))
    return _cut_rows(keyed, ["document_id", "parent_id"], "text", size, overlap, "child_index", "text")


def body(content: Column, names: Column) -> Column:
    """CHK5: the text, or a placeholder that names the images of a document without any."""
    return F.coalesce(F.nullif(content, F.lit("")), F.concat(F.lit("[visual artifact: "), names, F.lit("]")))


def profile(chunks: DataFrame, by: list[str], document: str, index: str, chunk: str, document_chars: str, documents: DataFrame | None = None) -> DataFrame:
    """AG13, CHK6: chunks, mean characters, duplicated share, and how many non-final chunks end mid-sentence.

    ``document_chars`` is a column of ``chunks``, or of ``documents`` (a row a document). Chunks are counted where they are; no text is shuffled.
    """
    own = [] if documents is not None else [document_chars]
    marked = chunks.select(*by, document, index, *own, F.length(chunk).alias("_n"), ends_sentence(F.col(chunk)).alias("_ends"))
    docs = marked.groupBy(*by, document).agg(F.sum("_n").alias("chars"), *[F.first(c).alias("whole") for c in own], F.count("*").alias("n"), F.count_if(~F.col("_ends")).alias("all_mid"), F.max_by("_ends", index).alias("final"))
    if documents is not None:
        docs = docs.join(documents.select(document, F.col(document_chars).alias("whole")), document)
    mid = F.col("all_mid") - F.when(F.col("final"), 0).otherwise(1)
    out = docs.groupBy(*by).agg(F.sum("n").alias("chunks"), F.sum("chars").alias("chars"), F.sum("whole").alias("whole"), F.sum(F.col("n") - 1).alias("open"), F.sum(mid).alias("mid"))
    return out.select(*by, "chunks", F.round(F.col("chars") / F.col("chunks"), 4).alias("mean_chars"), F.round(F.greatest(F.lit(0.0), (F.col("chars") - F.col("whole")) / F.col("whole")), 4).alias("duplicated"), F.round(F.coalesce(F.col("mid") / F.nullif(F.col("open"), F.lit(0)), F.lit(0.0)), 4).alias("mid_sentence"))


def rebuild(current: DataFrame, changed: DataFrame, rebuilt: DataFrame, key: str) -> DataFrame:
    """CHK7: the chunk table after an edit: changed documents' chunks replaced."""
    return current.join(changed.select(key), key, "left_anti").unionByName(rebuilt)
