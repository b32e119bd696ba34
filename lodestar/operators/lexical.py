"""Postings and lexical scores of many queries over many documents at once.

Scores are computed within a scope (a list of columns such as tenant and
knowledge base): N, df and the average length count the scope's rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import settled
from .term_hits import PART, text_hits, whole_hits
from .term_index import asked_terms, grams_of, query_lookup, ranked_candidates, ranked_hits, runs, sizes_of, with_fallback

K1, B, FLOOR = 1.5, 0.75, 0.25


def postings(rows: DataFrame, key: str, text: str, scope: list[str] = ()) -> DataFrame:
    """scope, key, token, tf, len."""
    return list_postings(token_lists(rows, key, text, scope), key, scope)


def token_lists(rows: DataFrame, key: str, text: str, scope: list[str] = ()) -> DataFrame:
    """scope, key, t: the tokens of each row, found once for all that is made of them."""
    return rows.select(*scope, key, tokens(F.col(text)).alias("t"))


def list_postings(lists: DataFrame, key: str, scope: list[str] = ()) -> DataFrame:
    """scope, key, token, tf, len of ``token_lists``."""
    return lists.select(*scope, key, F.size("t").alias("len"), F.explode("t").alias("token")).groupBy(*scope, key, "len", "token").agg(F.count("*").alias("tf"))


def corpus_stats(rows: DataFrame, text: str, scope: list[str] = ()) -> DataFrame:
    """AG12: n and avgdl of each scope; rows without tokens count."""
    return rows.select(*scope, F.size(tokens(F.col(text))).alias("len")).groupBy(*scope).agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))


def weights(rows: DataFrame, text: str, scope: list[str] = ()) -> DataFrame:
    """AG12: scope, token, idf, n, avgdl; a negative idf becomes 0.25 times the scope's mean raw idf."""
    return list_weights(rows.select(*scope, tokens(F.col(text)).alias("t")), scope)


def list_weights(lists: DataFrame, scope: list[str] = ()) -> DataFrame:
    """``weights`` of ``token_lists``.

    One aggregation, summed before it is shuffled: each
    row counts once for each of its different tokens, and once with its length under none.
    """
    each = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("token"), F.size("t").alias("len"))), F.transform(F.array_distinct("t"), lambda x: F.struct(x.alias("token"), F.lit(0).alias("len"))))
    return weights_of(lists.select(*scope, F.explode(each).alias("x")).groupBy(*scope, "x.token").agg(F.count("*").alias("df"), F.sum("x.len").alias("total")), scope)


def weights_of(df: DataFrame, scope: list[str] = ()) -> DataFrame:
    """``weights`` from counts: scope, token, df (rows with it), total; the row without a token has all rows and all their tokens."""
    if scope:
        stats = df.where("token is null").select(*scope, F.col("df").alias("n"), (F.col("total") / F.col("df")).alias("avgdl"))
        joined = df.where("token is not null").join(stats, list(scope))
    else:
        stats = df.where("token is null").select(F.col("df").alias("n"), (F.col("total") / F.col("df")).alias("avgdl"))
        joined = df.where("token is not null").crossJoin(F.broadcast(stats))  # one row of statistics
    raw = joined.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy(*scope).agg(F.avg("raw").alias("mean"))
    with_mean = raw.join(mean, list(scope)) if scope else raw.crossJoin(F.broadcast(mean))
    return with_mean.select(*scope, "token", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"), "n", "avgdl")


def query_terms(queries: DataFrame, query: str, text: str, scope: list[str] = ()) -> DataFrame:
    """scope, query, token, qtf, qlen."""
    return postings(queries, query, text, scope).withColumnsRenamed({"tf": "qtf", "len": "qlen"})


def matches(terms: DataFrame, post: DataFrame, scope: list[str] = ()) -> DataFrame:
    """JN10: query terms joined with the postings of their scope."""
    return terms.join(post, [*scope, "token"])


ASKED = 200_000  # different tokens of queries, or keys of candidates, that may be broadcast


def asked_postings(terms: DataFrame, rows: DataFrame, key: str, text: str, scope: list[str] = ()) -> DataFrame:
    """The postings of the tokens that some query of the scope has. Up to ``ASKED`` of them are broadcast, so that no others are shuffled."""
    return asked_list_postings(terms, token_lists(rows, key, text, scope), key, scope)


def asked_list_postings(terms: DataFrame, lists: DataFrame, key: str, scope: list[str] = ()) -> DataFrame:
    asked = terms.select(*scope, "token").distinct()
    few = asked.limit(ASKED + 1).count() <= ASKED
    found = lists.select(*scope, key, F.size("t").alias("len"), F.explode("t").alias("token")).join(F.broadcast(asked) if few else asked, [*scope, "token"], "left_semi")
    return found.groupBy(*scope, key, "len", "token").agg(F.count("*").alias("tf"))


def bm25_and_keyword(queries: DataFrame, rows: DataFrame, query: str, key: str, text: str = "text", query_text: str = "text", scope: list[str] = ()) -> DataFrame:
    """RET1, RET2: scope, query, key, bm25, keyword of all pairs that share a token."""
    return bm25_of_lists(token_lists(queries, query, query_text, scope), settled(token_lists(rows, key, text, scope)), query, key, scope)


def bm25_of_lists(asked: DataFrame, lists: DataFrame, query: str, key: str, scope: list[str] = ()) -> DataFrame:
    """``bm25_and_keyword`` of the ``token_lists`` of queries and rows."""
    terms = list_postings(asked, query, scope).withColumnsRenamed({"tf": "qtf", "len": "qlen"})
    post = asked_list_postings(terms, lists, key, scope)
    joined = post.join(terms.join(list_weights(lists, scope), [*scope, "token"]), [*scope, "token"])
    return joined.groupBy(*scope, query, key).agg(F.sum(bm25_part()).alias("bm25"), (F.sum(F.least("qtf", "tf")) / F.first("qlen")).alias("keyword"))


def bm25(queries: DataFrame, rows: DataFrame, query: str, key: str, text: str = "text", query_text: str = "text", scope: list[str] = ()) -> DataFrame:
    """RET2: scope, query, key, bm25 of all pairs that share a token."""
    return bm25_and_keyword(queries, rows, query, key, text, query_text, scope).drop("keyword")


def bm25_part() -> Column:
    """What a token of a query adds; columns qtf, idf, tf, len, avgdl."""
    return F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))


def keyword(queries: DataFrame, rows: DataFrame, query: str, key: str, text: str = "text", query_text: str = "text", scope: list[str] = ()) -> DataFrame:
    """RET1: multiset overlap divided by the number of query tokens."""
    terms = query_terms(queries, query, query_text, scope)
    joined = matches(terms, asked_postings(terms, rows, key, text, scope), scope)
    return joined.groupBy(*scope, query, key).agg((F.sum(F.least("qtf", "tf")) / F.first("qlen")).alias("keyword"))


def max_normalised(score: Column, query: list[str]) -> Column:
    """WN7: negative scores to 0, divided by the query's largest; all 0 if that is not positive."""
    top = F.max(score).over(Window.partitionBy(*query))
    return F.when(top > 0, F.greatest(F.lit(0.0), score) / top).otherwise(0.0)


def min_max(score: Column, query: list[str]) -> Column:
    """WN8: scaled to 0..1 within the query; non-finite counts as 0; flat gives 0."""
    s = F.when(F.isnan(score) | score.isNull() | (F.abs(score) == float("inf")), 0.0).otherwise(score)
    w = Window.partitionBy(*query)
    low, high = F.min(s).over(w), F.max(s).over(w)
    return F.when(high > low, (s - low) / (high - low)).otherwise(0.0)


def bm25_or_keyword(scored: DataFrame, query: list[str]) -> DataFrame:
    """RET3: normalised BM25, or the keyword score where a query's BM25 scores are all 0 or less. Columns bm25, keyword in; lexical added."""
    norm = max_normalised(F.col("bm25"), query)
    top = F.max("bm25").over(Window.partitionBy(*query))
    return scored.withColumn("lexical", F.when(top > 0, norm).otherwise(F.col("keyword")))


def top_k(scored: DataFrame, query: list[str], score: str, key: str, k: int, places: int = 6) -> DataFrame:
    """TK1, WN1: the k best of each query by the rounded score, then by key; ``rank`` from 1."""
    w = Window.partitionBy(*query).orderBy(F.desc(F.round(F.col(score), places)), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def candidates(queries: DataFrame, rows: DataFrame, query: str, key: str, text: str = "text", query_text: str = "text", scope: list[str] = (), limit: int | None = None) -> DataFrame:
    """RET8 over rows that no index holds: scope, query, key, score, place, as ``TermIndex`` would answer."""
    terms, sizes = query_lookup(queries, query, query_text, scope), sizes_of(rows, key, text, scope)
    asked, keys = asked_terms(terms, scope), [*scope, key]
    if asked is None:
        lists = settled(rows.select(*keys, runs(F.col(text)).alias("w")))
        words = lists.select(*keys, F.explode("w").alias("word"), F.lit(1).alias("tf"))  # each use; only those that are asked for are counted
        found = ranked_candidates(terms, words, grams_of(words), sizes, query, key, scope, limit)
    else:
        again = rows.groupBy(*keys).count().where("count > 1").select(*keys).limit(ASKED + 1).collect()
        hits = settled(text_hits(rows, key, text, scope, asked, {tuple(r) for r in again} if len(again) <= ASKED else None))
        if again:
            hits = settled(hits.where(F.col("kind") != PART).unionByName(whole_hits(hits.where(F.col("kind") == PART), keys, scope, asked)))
        found = ranked_hits(terms, hits, asked, sizes, query, key, scope, limit)
    return with_fallback(found, queries, rows, query, key, scope)


def bm25_among(pairs: DataFrame, queries: DataFrame, rows: DataFrame, query: str, key: str, text: str = "text", query_text: str = "text", scope: list[str] = ()) -> DataFrame:
    """RET2 after RET8: bm25 of each of ``pairs`` (scope, query, key), with the statistics of the query's own candidates; keyword and lexical (RET3) beside it.

    Candidates meet the postings of their rows by key, not their texts. Pairs
    without a shared token have 0.
    """
    on = [*scope, query]
    pairs = settled(pairs)
    wanted = pairs.select(*scope, key).distinct()
    wanted = F.broadcast(wanted) if wanted.limit(ASKED + 1).count() <= ASKED else wanted
    held = settled(token_lists(rows.join(wanted, [*scope, key], "left_semi"), key, text, scope))  # no other row's text is read on
    size = held.select(*scope, key, F.size("t").alias("len"))
    terms = query_terms(queries, query, query_text, scope)
    stats = pairs.join(size, [*scope, key]).groupBy(*on).agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    df = pairs.join(held.select(*scope, key, F.explode(F.array_distinct("t")).alias("token")), [*scope, key]).groupBy(*on, "token").agg(F.count("*").alias("df"))
    raw = settled(df.join(stats, on).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    mean = raw.groupBy(*on).agg(F.avg("raw").alias("mean"))
    weight = raw.join(terms, [*on, "token"]).join(mean, on).select(*on, "token", "qtf", "qlen", "avgdl", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    post = asked_list_postings(terms, held, key, scope)
    scored = pairs.join(post, [*scope, key]).join(weight, [*on, "token"]).groupBy(*on, key).agg(F.sum(bm25_part()).alias("bm25"), (F.sum(F.least("qtf", "tf")) / F.first("qlen")).alias("keyword"))
    return bm25_or_keyword(pairs.join(scored, [*on, key], "left").fillna(0.0, ["bm25", "keyword"]), on)
