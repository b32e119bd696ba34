"""Operator 13 against plain scores and its SQL, and its edge cases."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lodestar.llm import best_position as B

DOCS = "doc_id long, text string, score string, digest int"  # the last two clash with names used within
ITEMS = "item_id long, text string, rank string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain(docs, items, k=20):
    known = [(i, Counter(terms(t))) for i, t in docs]
    known = [(i, c, sum(c.values())) for i, c in known if c]
    n, total = len(known), sum(x[2] for x in known)
    df = Counter(t for _, c, _ in known for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in known:
            m = 75 + 25 * size * n // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in Counter(terms(text)).items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if nul else i, -s) for r, (s, nul, i) in enumerate(sorted(scores)[:k])]
    return sorted(map(str, out))


def corpus(seed, n):
    r = random.Random(seed)
    words = ["a", "B", "b", "é", "中文", "x1", "Ünï", "same", "the"] + [f"w{i}" for i in range(60)]
    text = lambda size: "".join(r.choice(words[: r.choice([9, 30, 69])]) + r.choice([" ", " ", ", ", "\n", "\x00", "_"]) for _ in range(size))
    docs = [(i, text(r.choice([1, 3, 20, 200]))) for i in range(n)]
    docs += docs[:20] + [(500 + i, docs[0][1]) for i in range(30)] + [(None, text(9)), (None, text(9)), (900, None), (901, ""), (902, "--- _ ")]
    items = [(i, text(r.choice([1, 5, 30]))) for i in range(12)] + [(3, "the"), (3, "the"), (None, "a b"), (20, None), (21, ""), (22, "nowhere"), (23, "the the THE same")]
    return docs, items


@pytest.mark.parametrize(("shard", "block"), [(B.SHARD, 8 << 20), (300, 8 << 20), (300, 60)])
def test_search_against_plain_scores(spark, shard, block):
    docs, items = corpus(shard % 7, 150)
    d = spark.createDataFrame([(*x, "x", 1) for x in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(*x, "x") for x in items], ITEMS)
    found = B.best_position_search(d, q, shard=shard, block_bytes=block).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(str(tuple(x)) for x in found) == plain(docs, items)


def test_sql_equals_plain_scores(spark, tmp_path):
    docs, items = corpus(11, 150)
    spark.createDataFrame([(*x, "x", 1) for x in docs], DOCS).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([(*x, "x") for x in items], ITEMS).write.parquet(f"{tmp_path}/q")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/d/*.parquet'")
    con.sql(f"CREATE VIEW benchmark AS FROM '{tmp_path}/q/*.parquet'")
    assert sorted(map(str, con.sql(B.SQL).fetchall())) == plain(docs, items)


def test_search_stops_early_and_keeps_ties():
    """20,000 documents of one term; 30 of them hold it thrice, among them the last ones."""
    n = 20_000
    tf = np.ones(n, np.int64)
    tf[[5, *range(n - 29, n)]] = 3
    lists = B.ImpactLists(np.arange(n), np.full(n, 10), np.arange(n), np.zeros(n, np.int64), tf, 1, n, 10 * n)
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    score, ids = lists.search(np.array([0]), np.array([7]), 20, none)
    assert ids.tolist() == [5, *range(n - 29, n - 10)] and len(set(score.tolist())) == 1
    assert lists.reads < 100  # goes on over all 30 equal ones, and no further than a step beyond
    again = lists.search(np.array([0]), np.array([7]), 20, none)
    assert again[1].tolist() == ids.tolist() and not lists.seen.any() and not lists.met.any()


def test_best_positions_stop_before_last_read_positions():
    """Where direct accesses have seen a list further than it was read, its best position is the later one."""
    r = np.random.default_rng(3)
    n = 3000
    base = r.integers(1, 60, n)  # two lists in almost the same order
    doc = np.repeat(np.arange(n), 2)
    tf = np.stack([base, np.maximum(1, base + r.integers(-1, 2, n))], 1).reshape(-1)
    lists = B.ImpactLists(np.arange(n), np.full(n, 100), doc, np.tile([0, 1], n), tf, 2, n, 100 * n)
    score, ids = lists.search(np.array([0, 1]), np.array([3, 4]), 5, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    whole = (lists.impact.reshape(n, 2) * np.array([3, 4])).sum(1)
    order = np.lexsort((np.arange(n), -whole))[:5]
    assert ids.tolist() == order.tolist() and score.tolist() == whole[order].tolist() and lists.reads < n / 4


def test_search_of_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a", "", 0)], DOCS), spark.createDataFrame([(1, "a", "")], ITEMS)
    for docs, items in ((d.limit(0), q), (d, q.limit(0)), (d.limit(0), q.limit(0)), (d.where("doc_id = 1").selectExpr("doc_id", "'' AS text"), q)):
        assert B.best_position_search(docs, items).count() == 0
    assert [tuple(x) for x in B.best_position_search(d, q).collect()] == [(1, 1, 1, 287 * (1_000_000_000 // (1000 + 1200)))]
