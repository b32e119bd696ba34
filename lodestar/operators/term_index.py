"""RET8: a stored index of lookup terms, and its own BM25 for the order of candidates.

A term lies within one run of word characters of a row, so three tables answer a question without its rows' texts:
``words`` (scope, key, word, tf, the latter two lists; in buckets by word), ``vocabulary`` (gram, word) and ``rows`` (scope, key, size, live).
Each is written by batches: a batch holds what came with it, a key that comes again or is removed
outdates its earlier batches, and a batch that runs again overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import lookup_terms
from ..session import settled
from .term_hits import COUNTS, WHOLE, Terms, bucketed_words, whole_hits, word_hits

#: fixed values of the index's ranking
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
ASKED = 200_000  # pairs of a scope and a term, or of a term and a word, that may be broadcast


def runs(text: Column) -> Column:
    """All that a term can lie in: runs of word characters, and each three CJK characters in a row; repeats stay."""
    low = F.lower(F.coalesce(text, F.lit("")))
    cjk = F.regexp_extract_all(low, F.lit("[一-鿿]{3,}"), 0)
    threes = F.flatten(F.transform(cjk, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 2), lambda i: F.substring(r, i, F.lit(3)))))
    return F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9_+\\-]{3,}"), 0), threes)


def bucket(n: int) -> Column:
    """As ``bucketed_words`` has it."""
    return F.pmod(F.crc32("word"), F.lit(n)).cast("int")


def words_of(rows: DataFrame, key: str, text: str, scope: list[str], buckets: int) -> DataFrame:
    """scope, key, bucket, word, tf: the different words of each row and how often they come, as lists, a row for each bucket; they are counted where the row is."""
    return bucketed_words(rows.select(*scope, key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low")), [*scope, key], buckets)


def sizes_of(rows: DataFrame, key: str, text: str, scope: list[str]) -> DataFrame:
    """scope, key, size: threes of characters in each text."""
    return rows.select(*scope, key, F.greatest(F.length(F.coalesce(F.col(text), F.lit(""))) - 2, F.lit(0)).alias("size"))


def grams_of(words: DataFrame) -> DataFrame:
    """gram, word: each three characters in a row of the different words."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 2), lambda i: F.substring("word", i, F.lit(3))))
    return words.select("word").distinct().select("word", F.explode(grams).alias("gram"))


def asked_terms(terms: DataFrame, scope: list[str]) -> list[tuple] | None:
    """(scope values, term) of all questions, or None if they are too many to go to all tasks."""
    found = terms.select(*scope, "term").distinct().limit(ASKED + 1).collect()
    return [(tuple(r[:-1]), r[-1]) for r in found] if len(found) <= ASKED else None


def ranked_hits(terms: DataFrame, hits: DataFrame, asked: list[tuple], sizes: DataFrame, query: str, key: str, scope: list[str], limit: int | None, version: tuple[str, ...] = ()) -> DataFrame:
    """``ranked_candidates`` from what ``term_hits`` has found."""
    names = terms.sparkSession.createDataFrame([*enumerate(Terms(asked).names)], "number int, term string")
    keys = [*scope, key, *version]
    each = lambda kind: hits.where(F.col("kind") == kind).select(*keys, F.explode(F.arrays_zip("term", "f")).alias("x")).select(*keys, F.col("x.term").alias("number"), "x.f").join(F.broadcast(names), "number").drop("number")
    df = each(COUNTS).groupBy("term").agg(F.sum("f").alias("df"))
    return _ranked(terms, each(WHOLE), df, sizes, query, key, scope, limit, version)


def ranked_candidates(terms: DataFrame, words: DataFrame, vocabulary: DataFrame, sizes: DataFrame, query: str, key: str, scope: list[str], limit: int | None, version: tuple[str, ...] = (), buckets: int = 0) -> DataFrame:
    """scope, query, key, score, place: rows with a term of the query, by the index's BM25, then by key.

    terms: scope, query, term; the rest as above. A term's weight counts rows of all scopes, as one index has them.
    limit: the best stay, 10 at least and 5000 at most. version: columns by which words and sizes belong together besides the key.
    """
    found = matching_words(terms, vocabulary, buckets)
    found = F.broadcast(found) if found.limit(ASKED + 1).count() <= ASKED else found
    every = found.join(words, ["bucket", "word"] if buckets else ["word"]).groupBy("term", *scope, key, *version).agg(F.sum(F.col("tf") * F.col("times")).alias("f"))
    if version:  # what is outdated does not count
        every = every.join(sizes.select(*scope, key, *version), [*scope, key, *version], "left_semi")
    else:
        every = every.dropna("any", subset=[*scope, key])
    every = settled(every)
    return _ranked(terms, every.join(terms.select(*scope, "term").distinct(), [*scope, "term"], "left_semi"), every.groupBy("term").agg(F.count("*").alias("df")), sizes, query, key, scope, limit, version)


def matching_words(terms: DataFrame, vocabulary: DataFrame, buckets: int) -> DataFrame:
    """term, word, times (and bucket): the words that hold an asked term."""
    at = F.sequence(F.lit(1), F.length("word") - F.length("term") + 1)
    times = F.size(F.filter(at, lambda i: F.substring(F.col("word"), i, F.length("term")) == F.col("term")))
    found = terms.select("term").distinct().withColumn("gram", F.substring("term", 1, 3)).join(vocabulary, "gram").where(F.col("word").contains(F.col("term"))).select("term", "word", times.alias("times"))
    return settled(found.withColumn("bucket", bucket(buckets)) if buckets else found)  # only folders with a word that is asked for are opened


def _ranked(terms: DataFrame, held: DataFrame, df: DataFrame, sizes: DataFrame, query: str, key: str, scope: list[str], limit: int | None, version: tuple[str, ...]) -> DataFrame:
    """held: term, scope, key, f of rows in scopes that ask for the term; df: term, df over all scopes."""
    held = held.join(sizes, [*scope, key, *version])  # other scopes' rows count for the weights alone
    total = sizes.agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    df = df.crossJoin(F.broadcast(total))  # one row of statistics
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = df.select("term", F.when(idf > 0, idf).otherwise(LEAST_IDF).alias("idf"), "mean")
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    scored = terms.join(weight, "term").join(held, [*scope, "term"]).groupBy(*scope, query, key).agg(F.sum(part).alias("score"))
    w = Window.partitionBy(*scope, query).orderBy(F.desc(F.round("score", 9)), key)
    out = scored.withColumn("place", F.row_number().over(w))
    return out if limit is None else out.where(F.col("place") <= max(10, min(limit, 5000)))


def with_fallback(found: DataFrame, queries: DataFrame, rows: DataFrame, query: str, key: str, scope: list[str]) -> DataFrame:
    """A query without any candidate gets all rows of its scope; without a scope it gets none."""
    if not scope:
        return found
    without = queries.select(*scope, query).join(found.select(*scope, query).distinct(), [*scope, query], "left_anti")
    every = without.join(rows.select(*scope, key), list(scope)).select(*scope, query, key, F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("place"))
    return found.select(*scope, query, key, "score", "place").unionByName(every)


def query_lookup(queries: DataFrame, query: str, text: str, scope: list[str]) -> DataFrame:
    return queries.select(*scope, query, F.explode(lookup_terms(F.col(text))).alias("term"))


class TermIndex:
    """The index under ``path``, a folder that all executors share. Words are kept in ``buckets`` folders, of which a question opens those of its words."""

    def __init__(self, spark: SparkSession, path: str, key: str, scope: list[str] = (), buckets: int = 16):
        self.spark, self.path, self.key, self.scope, self.buckets = spark, path, key, list(scope), buckets

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except Exception as e:  # nothing has been added
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return None

    def add(self, rows: DataFrame, batch: int, text: str = "text") -> None:
        """Rows of new keys, or of keys whose text has changed; a key comes once in a batch, and batches rise."""
        words = words_of(rows, self.key, text, self.scope, self.buckets)
        words.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/words/batch={batch}")
        own = self.spark.read.parquet(f"{self.path}/words/batch={batch}").select(F.explode("word").alias("word"))
        known = self._read("vocabulary")
        new = grams_of(own if known is None else own.join(known.where(F.col("batch") != batch).select("word").distinct(), "word", "left_anti"))
        new.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{self.path}/vocabulary/batch={batch}")
        sizes_of(rows, self.key, text, self.scope).withColumn("live", F.lit(True)).write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")

    def remove(self, keys: DataFrame, batch: int) -> None:
        """keys: scope and key of rows that are gone."""
        keys.select(*self.scope, self.key, F.lit(0).alias("size"), F.lit(False).alias("live")).write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")

    def rows(self) -> DataFrame:
        """scope, key, size, batch of the rows that are there now."""
        last = self._read("rows").groupBy(*self.scope, self.key).agg(F.max(F.struct("batch", "size", "live")).alias("x"))
        return last.where("x.live").select(*self.scope, self.key, "x.size", "x.batch")

    def candidates(self, queries: DataFrame, query: str, query_text: str = "text", limit: int | None = None) -> DataFrame:
        """RET8: scope, query, key, score, place. A query without a hit gets its whole scope."""
        terms = query_lookup(queries, query, query_text, self.scope)
        live, vocabulary = self.rows(), self._read("vocabulary").select("gram", "word")
        asked, words, keys = asked_terms(terms, self.scope), self._read("words"), [*self.scope, self.key, "batch"]
        if asked is None:
            each = words.select(*keys, "bucket", F.explode(F.arrays_zip("word", "tf")).alias("x")).select(*keys, "bucket", "x.word", "x.tf")
            found = ranked_candidates(terms, each, vocabulary, live, query, self.key, self.scope, limit, ("batch",), self.buckets)
        else:
            opened = [r["bucket"] for r in matching_words(terms, vocabulary, self.buckets).select("bucket").distinct().collect()]
            parts = word_hits(words.where(F.col("bucket").isin(opened)), keys, asked)
            whole = whole_hits(parts.join(live.select(*keys), keys, "left_semi"), keys, self.scope, asked)  # what is outdated does not count
            found = ranked_hits(terms, settled(whole), asked, live, query, self.key, self.scope, limit, ("batch",))
        return with_fallback(found, queries, live, query, self.key, self.scope)
