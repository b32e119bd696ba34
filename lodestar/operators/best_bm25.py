"""RET2 where only the best rows are wanted: scores are added up where the rows are, and no pair is shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import tokens
from ..session import settled
from .lexical import ASKED, K1, B, bm25_of_lists, list_postings, list_weights, token_lists

CELLS = 2_000_000  # scores that a task holds at once
ROWS = 1_000  # rows whose tokens a task looks up at once


class _Asked:
    """Tokens of all queries, and for each the queries that have it with their weights."""

    def __init__(self, rows: list):
        """rows: query number, token, weight (qtf * idf)."""
        rows = sorted(rows, key=lambda r: r[1])
        tokens = [r[1] for r in rows]
        self.query, self.weight = np.array([r[0] for r in rows]), np.array([r[2] for r in rows], float)
        different = sorted(set(tokens))
        self.number = {t: i for i, t in enumerate(different)}
        self.begin = np.searchsorted(np.array([self.number[t] for t in tokens]), np.arange(len(different) + 1))
        self.size = int(self.query.max()) + 1
        most = np.bincount(self.query, np.maximum(self.weight, 0), self.size) * (K1 + 1)  # no row scores more
        self.margin = 1e-6 * most

    def scores(self, doc: np.ndarray, token: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
        """Rows x queries, -inf where no token is shared; doc, token: one entry a token of each row, repeats included."""
        pair, tf = np.unique(doc * len(self.number) + token, return_counts=True)
        doc, token = pair // len(self.number), pair % len(self.number)
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean))
        times = self.begin[token + 1] - self.begin[token]
        at = np.repeat(self.begin[token] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        cell = np.repeat(doc, times) * self.size + self.query[at]
        n = len(length) * self.size
        out = np.bincount(cell, np.repeat(part, times) * self.weight[at], n).astype(float)
        out[np.bincount(cell, minlength=n) == 0] = -np.inf
        return out.reshape(len(length), self.size)


def best_bm25(queries: DataFrame, rows: DataFrame, query: str, key: str, k: int, text: str = "text", query_text: str = "text", group: str | None = None) -> DataFrame:
    """query, key, bm25 of the pairs that share a token and can be among the query's k best: by score over the query's highest, rounded to 6 places, then by key.

    Each task adds up its rows' scores and keeps, of each query, all from its own k-th best less what rounding can hide. Up to ``ASKED``
    tokens of queries go to all tasks; with more of them pairs are joined as ``bm25`` does.

    group: a column that comes too. The k best are then groups, each by its best row (RET9): of each query all rows stay that can be the best
    of their group, of groups that can be among the k best.
    """
    more = [group] if group else []
    lists = settled(rows.select(key, tokens(F.col(text)).alias("t"), *more))
    terms = list_postings(token_lists(queries, query, query_text), query).withColumnRenamed("tf", "qtf").select(query, "token", "qtf")
    weights = terms.join(list_weights(lists), "token").select(query, "token", (F.col("qtf") * F.col("idf")).alias("weight"), "avgdl")
    asked = weights.limit(ASKED + 1).collect()
    if len(asked) > ASKED:
        scored = bm25_of_lists(token_lists(queries, query, query_text), lists, query, key).drop("keyword")
        return scored.join(lists.select(key, group), key).select(query, key, "bm25", group) if group else scored
    if not asked:
        return queries.select(query).limit(0).crossJoin(rows.select(key, *more).limit(0)).select(query, key, F.lit(0.0).alias("bm25"), *more)
    names = sorted({r[query] for r in asked}, key=lambda x: (x is None, x))
    number = {x: i for i, x in enumerate(names)}
    shared = rows.sparkSession.sparkContext.broadcast((_Asked([(number[r[query]], r["token"], r["weight"]) for r in asked]), names, asked[0]["avgdl"]))
    kinds = {f.name: f.dataType for f in [*queries.select(query).schema, *rows.select(key, *more).schema]}

    def best(score, ids, groups, margin):
        """What can be among the k best, by a margin, and the score under which nothing is."""
        score0, least = np.maximum(score, 0), -np.inf
        if group is None:
            if len(score) >= k:
                least = np.partition(score0, -k)[-k] - margin
            keep = score0 >= least
        else:
            at = {g: i for i, g in enumerate(dict.fromkeys(groups))}
            own = np.array([at[g] for g in groups])
            top = np.full(len(at), -np.inf)
            np.maximum.at(top, own, score0)
            if len(top) >= k:
                least = np.partition(top, -k)[-k] - margin
            keep = score0 >= np.maximum(top[own] - margin, least)
        where = np.flatnonzero(keep)
        return score[where], [ids[i] for i in where], [groups[i] for i in where], least

    def run(batches):
        asked, names, mean = shared.value
        words = pa.array(list(asked.number))
        kept = [(np.zeros(0), [], [], -np.inf) for _ in names]  # of each query scores, keys, groups and the least score that counts
        for whole in batches:
            for first in range(0, len(whole), ROWS):
                batch = whole.slice(first, ROWS)
                found = batch.column(1)
                offsets = found.offsets.to_numpy() - found.offsets[0].as_py()
                number = pc.index_in(found.flatten(), value_set=words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(len(batch)), np.diff(offsets))
                keys, step = batch.column(0), max(1, CELLS // asked.size)
                for a in range(0, len(batch), step):
                    b = min(a + step, len(batch))
                    here = slice(offsets[a], offsets[b])
                    own = number[here] >= 0
                    s = asked.scores((doc[here] - a)[own], number[here][own], np.diff(offsets[a : b + 1]), mean)
                    for j in range(asked.size):
                        some = np.flatnonzero((s[:, j] > -np.inf) & (np.maximum(s[:, j], 0) >= kept[j][3]))
                        if not len(some):
                            continue
                        at = pa.array(some + a)
                        mine = batch.column(2).take(at).to_pylist() if group else [None] * len(some)
                        mine = [tuple(g.items()) if isinstance(g, dict) else g for g in mine]
                        kept[j] = best(np.concatenate([kept[j][0], s[some, j]]), kept[j][1] + keys.take(at).to_pylist(), kept[j][2] + mine, asked.margin[j])
        columns = [pa.array([names[j] for j, (s, *_) in enumerate(kept) for _ in s], out[0].type), pa.array([x for _, ids, *_ in kept for x in ids], out[1].type), pa.array(np.concatenate([s for s, *_ in kept]))]
        if group:
            groups = [dict(g) if isinstance(g, tuple) else g for _, _, found, _ in kept for g in found]
            columns.append(pa.array(groups, out[3].type))
        yield pa.RecordBatch.from_arrays(columns, schema=out)

    from pyspark.sql.pandas.types import to_arrow_schema

    plan = StructType([StructField(query, kinds[query]), StructField(key, kinds[key]), StructField("bm25", DoubleType()), *[StructField(g, kinds[g]) for g in more]])
    out = to_arrow_schema(plan)
    return lists.select(key, "t", *more).mapInArrow(run, plan)
