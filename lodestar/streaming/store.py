"""STR1: postings and corpus statistics that grow by batches, so that BM25 over all that was ingested reads no text again.

Under ``base``: ``postings/batch=n`` (doc, chunk_index, token, tf, len) and ``stats/batch=n`` (token, df, total; the row without
a token has the batch's rows and all their tokens). Both only ever add up, so statistics of the corpus are a sum over
batches. ``compact`` writes a snapshot of all batches up to one, and its log entry last; what is
read is the last snapshot in the log and the batches after it. A batch or a snapshot that is written again overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lexical import bm25_part, list_postings, query_terms, token_lists, weights_of
from ..session import settled

SCHEMAS = {"postings": "doc long, chunk_index long, token string, tf long, len int, batch int", "stats": "token string, df long, total long, batch int", "snapshots": "upto int"}


class PostingStore:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def _read(self, name: str, under: str) -> DataFrame:
        """Nothing if nothing has been written."""
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.base}/{under}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMAS[name])

    def add(self, chunks: DataFrame, batch: int, doc: str = "doc_id", text: str = "chunk") -> None:
        """chunks: doc, chunk_index, text; what is in one batch is in no other."""
        lists = settled(token_lists(chunks.select(F.col(doc).cast("long").alias("doc"), F.col("chunk_index").cast("long"), text), "chunk_index", text, ["doc"]))
        list_postings(lists, "chunk_index", ["doc"]).select("doc", "chunk_index", "token", "tf", "len").write.mode("overwrite").parquet(f"{self.base}/postings/batch={batch}")
        each = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("token"), F.size("t").alias("len"))), F.transform(F.array_distinct("t"), lambda x: F.struct(x.alias("token"), F.lit(0).alias("len"))))
        stats = lists.select(F.explode(each).alias("x")).groupBy("x.token").agg(F.count("*").alias("df"), F.sum("x.len").alias("total"))
        stats.write.mode("overwrite").parquet(f"{self.base}/stats/batch={batch}")

    def _upto(self) -> int:
        return self._read("snapshots", "snapshots").agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]

    def _all(self, name: str) -> DataFrame:
        upto = self._upto()
        later = self._read(name, name).where(F.col("batch") > upto)
        return later.drop("batch") if upto < 0 else later.drop("batch").unionByName(self._read(name, f"compacted/upto={upto}/{name}").drop("batch"))

    def postings(self) -> DataFrame:
        """doc, chunk_index, token, tf, len."""
        return self._all("postings")

    def weights(self) -> DataFrame:
        """AG12 of all that was ingested: token, idf, n, avgdl."""
        return weights_of(self._all("stats").groupBy("token").agg(F.sum("df").alias("df"), F.sum("total").alias("total")))

    def compact(self, upto: int) -> None:
        """One snapshot of the batches up to ``upto``, postings by ranges of tokens, so that few files hold a token."""
        if upto <= self._upto():
            return
        old = self._upto()
        for name in ("postings", "stats"):
            rows = self._read(name, name).where(F.col("batch").between(old + 1, upto)).drop("batch")
            if old >= 0:
                rows = rows.unionByName(self._read(name, f"compacted/upto={old}/{name}").drop("batch"))
            if name == "stats":
                rows = rows.groupBy("token").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
            rows.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{self.base}/compacted/upto={upto}/{name}")
        self.spark.createDataFrame([(upto,)], SCHEMAS["snapshots"]).write.mode("append").parquet(f"{self.base}/snapshots")

    def bm25(self, queries: DataFrame, query: str, text: str = "text") -> DataFrame:
        """RET2 over the store: query, doc, chunk_index, bm25 of all pairs that share a token."""
        terms = query_terms(queries, query, text).join(self.weights(), "token")
        return self.postings().join(terms, "token").groupBy(query, "doc", "chunk_index").agg(F.sum(bm25_part()).alias("bm25"))
