"""Ranks by counting, the stored index, the inverted file and near texts, each against a plain version."""

import difflib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestar.operators import counted_ranks, evaluate, inverted_file, lexical, near_text, ranks, search, term_hits, term_index
from lodestar.operators.term_index import TermIndex
from lodestar.plans.retrieval_queries import scoped_chunks

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_counted_ranks_equal_ranks_over_all_rows(spark, monkeypatch, few):
    monkeypatch.setattr(counted_ranks, "FEW", few)
    r = random.Random(few)
    keys = {s: sorted(r.sample(range(100), n)) for s, n in (("a", 30), ("b", 1), ("c", 12))}
    scores = {}
    for q in range(12):
        s = "abc"[q % 3]
        for k in keys[s]:
            if q >= 3 and r.random() < 0.3:
                scores[s, q, k] = r.choice([0.0, 0.5, 0.25, 1.0])
    rows = spark.createDataFrame([(s, k) for s in keys for k in keys[s]], "s string, k long")
    asked = spark.createDataFrame([("abc"[q % 3], q, q // 6 * 3 + q % 3) for q in range(12)], "s string, q long, o long")
    scored = spark.createDataFrame([(*x, v) for x, v in scores.items()], "s string, q long, k long, v double")
    order = counted_ranks.id_order(rows, ["s"], "k")
    for limit, owner in ((None, None), (2, None), (3, "o"), (None, "o")):
        got = counted_ranks.with_unscored(scored, order, asked, ["s"], "q", "k", ["v"], limit, owner).withColumn("rank", counted_ranks.counted_rank("v", ["s", "q"])).collect()
        seen = Counter(x.q for x in got)
        for q in range(12):
            s = "abc"[q % 3]
            full = sorted(keys[s], key=lambda k: (-scores.get((s, q, k), 0.0), k))
            mine = {x.k: x["rank"] for x in got if x.q == q}
            assert mine == {k: full.index(k) + 1 for k in mine}
            group = [p for p in range(12) if owner and p // 6 * 3 + p % 3 == q // 6 * 3 + q % 3] or [q]
            having = {k for k in keys[s] if any((s, p, k) in scores for p in group)}
            missing = [k for k in keys[s] if k not in having][:limit]
            assert set(mine) == having | set(missing) and seen[q] == len(mine)


def test_row_numbers_of_a_hot_group(spark):
    r = random.Random(3)
    rows = [("hot" if r.random() < 0.7 else f"g{r.randint(0, 5)}", r.randint(0, 500), i) for i in range(3000)]
    got = ranks.row_numbers(spark.createDataFrame(rows, "g string, a long, i long").repartition(5), ["g"], [F.desc("a"), "i"], "n").collect()
    for g in {x[0] for x in rows}:
        want = sorted(((-a, i) for h, a, i in rows if h == g))
        assert [(-x.a, x.i) for x in sorted((x for x in got if x.g == g), key=lambda x: x.n)] == want
        assert sorted(x.n for x in got if x.g == g) == list(range(1, len(want) + 1))


def plain_candidates(docs, question):
    """The index's order for one question, from texts alone."""
    terms = list(dict.fromkeys([r[i : i + 3] for r in re.findall("[一-鿿]+", question) for i in range(len(r) - 2)] + re.findall(r"[a-z0-9_+\-]{3,}", question.lower())))[:48]
    count = lambda text, t: sum(text.lower().startswith(t, i) for i in range(len(text)))
    sizes = {k: max(len(t) - 2, 0) for k, (_, t) in docs.items()}
    mean, n, score = sum(sizes.values()) / len(docs), len(docs), Counter()
    for t in terms:
        hits = {k: c for k, (_, text) in docs.items() if (c := count(text, t))}
        x = math.log((n - len(hits) + 0.5) / (len(hits) + 0.5))
        for k, f in hits.items():
            score[k] += (x if x > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sizes[k] / mean))
    return score


def test_index_by_batches_against_plain_order(spark, tmp_path):
    r = random.Random(8)
    words = ["pump", "pumps", "alarm", "ana", "banana", "泵压力", "压力过高", "x-1", "ab", "Valve", "valves", "é", "a+b_c"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", "", ", "]) for _ in range(n))
    docs = {k: (f"t{k % 3}", text(r.choice([0, 3, 20]))) for k in range(60)}
    frame = lambda some: spark.createDataFrame([(t, k, x) for k, (t, x) in some.items()], "tenant string, key long, text string")
    index = TermIndex(spark, f"{tmp_path}/i", "key", ["tenant"], buckets=4)
    index.add(frame({k: (v[0], text(8) if k % 4 == 0 else v[1]) for k, v in docs.items() if k < 45} | {99: ("t0", "pump")}), 0)
    for _ in range(2):  # a batch that runs again repeats nothing
        index.add(frame({k: v for k, v in docs.items() if k >= 45 or k % 4 == 0}), 1)
    index.remove(frame({99: ("t0", "")}), 2)
    asked = [("t0", 1, "Pump ana alarm?"), ("t1", 2, "泵压力过高 valve"), ("t2", 3, "nothing"), ("t2", 4, "no"), ("t1", 5, "banana banana pumps x-1 a+b_c")]
    got = index.candidates(spark.createDataFrame(asked, "tenant string, query_id long, text string"), "query_id").collect()
    for tenant, q, question in asked:
        score = {k: s for k, s in plain_candidates(docs, question).items() if docs[k][0] == tenant}
        mine = sorted((x for x in got if x.query_id == q), key=lambda x: (x.place or 0, x.key))
        if score:
            assert [x.key for x in mine] == sorted(score, key=lambda k: (-round(score[k], 9), k))
            assert all(x.score == pytest.approx(score[x.key]) for x in mine)
        else:
            assert [x.key for x in mine] == [k for k in docs if docs[k][0] == tenant]


def test_candidates_are_counted_where_the_rows_are(spark, monkeypatch):
    """Rows of scopes that ask for a term go on with its count, all others as numbers; repeated keys and nulls as when all pairs are grouped."""
    r = random.Random(3)
    words = ["pump", "pumps", "Alarm", "ana", "bananas", "泵压力过", "x-1", "ab", "é", "a+b_c", "İana", "the", "then", "other"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", "", ", "]) for _ in range(n))
    rows = [(r.choice(["t0", "t1", "t2", None]), r.choice([*range(60), None]), r.choice([None, "", text(5), text(30)])) for _ in range(150)]
    asked = [("t0", 1, "pump ana alarm the"), ("t1", 2, "泵压力过 other a+b_c"), ("t1", 3, "nothing"), (None, 4, "pump"), ("t9", 5, "pump")]
    d, q = spark.createDataFrame(rows, "tenant string, key long, text string").repartition(3), spark.createDataFrame(asked, "tenant string, query_id long, text string")
    got = lambda d: sorted(((x.tenant, x.query_id, x.key, x.place, x.score and round(x.score, 9)) for x in lexical.candidates(q, d, "query_id", "key", scope=["tenant"]).collect()), key=str)
    whole = got(d)
    hits = term_hits.text_hits(d, "key", "text", ["tenant"], [(("t0",), "pump"), (("t1",), "the")], set()).collect()
    assert {x.tenant for x in hits} == {"t0", "t1", None} and sum(x.kind == term_hits.COUNTS for x in hits) == 3
    assert all(x.term == ([0] if x.tenant == "t0" else [1]) for x in hits if x.kind == term_hits.WHOLE)
    few = sorted({(t, k): x for t, k, x in rows if k is not None}.items(), key=str)
    some = spark.createDataFrame([(t, k, x) for (t, k), x in few], "tenant string, key long, text string")
    new = got(some)
    monkeypatch.setattr(term_index, "ASKED", -1)  # all pairs are grouped
    assert whole == got(d) and len(whole) > 40 and new == got(some)


def test_index_opens_only_asked_buckets(spark, tmp_path):
    index = TermIndex(spark, f"{tmp_path}/i", "key", ["tenant"], buckets=8)
    rows = spark.createDataFrame([("t", i, f"word{i} common") for i in range(50)], "tenant string, key long, text string")
    index.add(rows, 0)
    q = spark.createDataFrame([("t", 1, "word17")], "tenant string, query_id long, text string")
    assert [x.key for x in index.candidates(q, "query_id").collect()] == [17]


def test_approximate_neighbours_of_the_given_vectors(spark):
    """Recall of EV7 on ``embeddings``: 0.9 and more where a fifth of the rows is scored exactly, and every row is in the index."""
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.lit(0).alias("label"), "embedding")
    n, q = e.count(), e.where("vec_id % 50 = 0")
    true = search.exact_knn(q, e, 10)
    model = inverted_file.fit(e)
    stored = inverted_file.index(e, model)
    assert stored.select("id").distinct().count() == n
    pairs = inverted_file.candidates(q, stored, model, 200, 48)
    most = pairs.groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert most <= 0.2 * n and pairs.count() == pairs.distinct().count()
    recall = evaluate.list_recall(inverted_file.approximate_knn(q, e, 10), true, "query_id", "vec_id").collect()
    assert sum(t.recall for t in recall) / len(recall) >= 0.9


def test_inverted_file_edges(spark):
    rows = [(1, [1.0, 0.0, 2.0]), (2, [1.0, 0.0, 2.0]), (3, None), (4, [float("nan"), 1.0, 1.0]), (5, [1.0, None, 1.0]), (None, [1.0, 1.0, 1.0]), (6, [0.0, 3.0, 0.0]), (6, [0.0, 3.0, 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(x) for x in inverted_file.approximate_knn(e, e, 2, probes=64).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2, 5.0), (1, 2, 6, 0.0), (2, 1, 1, 5.0), (2, 2, 6, 0.0), (6, 1, 1, 0.0), (6, 2, 2, 0.0)]
    assert inverted_file.approximate_knn(e.limit(0), e, 2).count() == 0 and inverted_file.approximate_knn(e, e.limit(0), 2).count() == 0


def questions(seed, n):
    r = random.Random(seed)
    base = ["".join(r.choice("abcde fgh") for _ in range(r.choice([1, 2, 3, 4, 5, 6, 8, 12, 30, 60, 90]))) for _ in range(n // 3)]
    out = set(base)
    while len(out) < n:
        x = list(r.choice(base))
        for _ in range(r.randint(1, max(1, len(x) // 6))):
            at = r.randrange(len(x) + 1)
            x[at : at + r.choice([0, 1, 1])] = r.choice(["", "z", "a", "b"])
        out.add("".join(x))
    return sorted(x for x in out if x)


@pytest.mark.parametrize("least", [0.85, 0.95, 0.7])
def test_near_pairs_equal_all_pairs(spark, least):
    """500 questions against 500, with many near copies and very short ones."""
    a, b = questions(1, 500)[:250] + questions(2, 250), questions(1, 500)[250:] + questions(3, 250)
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    upper = lambda x, y: 2 * sum((Counter(x) & Counter(y)).values()) / (len(x) + len(y)) >= least
    want = {(i, 1000 + j): ratio(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if upper(x, y) and ratio(x, y) >= least}
    frame = lambda t, first: spark.createDataFrame([(first + i, x) for i, x in enumerate(t)] + [(9000 + first, None), (9001 + first, "")], "id long, q string")
    found = {(x.a_id, x.b_id): x.ratio for x in near_text.near_pairs(frame(a, 0), frame(b, 1000), "id", "q", least).collect()}
    assert found == want and len(want) > 20


def test_nearest_pair_and_classes(spark):
    a, b = questions(5, 60), ["completely different", "qqqq 77 8", "zzzzz"]
    frame = lambda t, first: spark.createDataFrame([(first + i, x) for i, x in enumerate(t)], "id long, q string")
    best = max((difflib.SequenceMatcher(None, x, y).ratio(), -i, -1000 - j) for i, x in enumerate(a) for j, y in enumerate(b))
    x = near_text.nearest_pair(frame(a, 0), frame(b, 1000), "id", "q").first()
    assert (x.ratio, -x.a_id, -x.b_id) == best
    assert near_text.nearest_pair(frame(["ab"], 0), frame(["xy"], 9), "id", "q").count() == 0
    c = spark.createDataFrame([(3, "x"), (1, "y"), (2, "x"), (5, None), (4, "")], "id long, q string")
    assert sorted(map(tuple, near_text.text_classes(c, "id", "q").collect())) == [(1, 1), (2, 2), (3, 2), (4, 4), (5, 4)]


def test_each_strategy_can_be_asked_for(spark):
    rows = [("t", i, t, "m") for i, t in enumerate(["alpha beta", "alpha alpha gamma", "delta", "beta gamma alpha", "nothing of it"])]
    d = spark.createDataFrame(rows, "tenant string, key long, text string, embedding_model string")
    c = d.select("tenant", (F.col("key") * 10).alias("key"), F.col("key").alias("parent_id"), "text")
    ask = lambda strategies, transform="none": spark.createDataFrame([("t", i, "please alpha gamma", transform, s) for i, s in enumerate(strategies)], "tenant string, query_id long, question string, query_transform string, strategy string")
    names = ["keyword", "vector", "weighted", "bm25", "rrf", "parent_child", "auto", None]
    for transform in ("none", "multi_query"):
        got = {}
        for x in search.routed_search(ask(names, transform), d, c, ["tenant"], 3, "m").collect():
            got.setdefault(x.query_id, []).append((x["rank"], x.key, x.strategy, x.score))
        assert {q: {s for _, _, s, _ in v} for q, v in got.items()} == {i: {n if n not in ("auto", None) else "bm25"} for i, n in enumerate(names)}
        assert all(sorted(r for r, *_ in v) == [1, 2, 3] for v in got.values())
        assert min(got[0])[1] in (1, 3) and min(got[5])[1] in (10, 30)
    assert sorted(got[0])[0][3] == 1.0  # fused
    alone = {x.key: x.score for x in search.routed_search(ask(["keyword"]), d, c, ["tenant"], 3, "m").collect()}
    assert alone == {0: pytest.approx(1 / 3, abs=1e-6), 1: pytest.approx(2 / 3, abs=1e-6), 3: pytest.approx(2 / 3, abs=1e-6)}
    with pytest.raises(PySparkException, match="unknown retrieval strategy"):
        search.routed_search(ask(["best"]), d, c, ["tenant"], 3, "m").collect()


@pytest.mark.parametrize("cells", [5, 2_000_000])
def test_best_rows_equal_all_pairs(spark, monkeypatch, cells):
    """With many ties, queries that have fewer hits than wanted, tokens that most rows have, repeated keys and nulls."""
    from lodestar.operators import best_bm25, lexical

    monkeypatch.setattr(best_bm25, "CELLS", cells)
    r = random.Random(cells)
    words = ["the", "pump", "alarm", "泵压", "x", "y"] + [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(r.choice(words[: r.choice([3, 6, 36])]) for _ in range(n))
    rows = [(i, text(r.choice([0, 2, 5, 20]))) for i in range(120)] + [(i, "the pump pump") for i in range(200, 230)] + [(300, None), (5, "pump w1")]
    asked = [(i, text(r.choice([1, 3, 8]))) for i in range(10)] + [(20, None), (21, "nowhere"), (22, "w7"), (23, "the the")]
    d, q = spark.createDataFrame(rows, "key long, text string").repartition(3), spark.createDataFrame(asked, "query long, text string")

    def best(scored):
        score = F.round(lexical.max_normalised(F.col("bm25"), ["query"]), 6)
        return sorted((x.query, x["rank"], x.score) if x.key == 5 else (x.query, x["rank"], x.key, x.score) for x in lexical.top_k(scored.withColumn("score", score), ["query"], "score", "key", 5).collect())

    want = best(lexical.bm25(q, d.where("key <> 5"), "query", "key"))
    assert best(best_bm25.best_bm25(q, d.where("key <> 5"), "query", "key", 5)) == want and len(want) > 40
    assert len(best(best_bm25.best_bm25(q, d, "query", "key", 5))) >= len(want)
    assert best_bm25.best_bm25(q.limit(0), d, "query", "key", 5).count() == best_bm25.best_bm25(q, d.limit(0), "query", "key", 5).count() == 0
    monkeypatch.setattr(best_bm25, "ASKED", 3)  # the other way
    assert best(best_bm25.best_bm25(q, d.where("key <> 5"), "query", "key", 5)) == want


def test_routes_equal_their_sql(spark, tmp_path):
    """Capitals that look like identifiers: the SQL of RET13 and what is built on it have none."""
    import duckdb

    from lodestar.queries import ORACLES, QUERIES

    texts = ["SS pumpe", "SS Erener ist", "AB-12 chever", "GB 2021 SSö der", "SS und die", "plain words", "12 words SS " * 8]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    for name in ("ret13_route", "ev12_route_distribution"):
        assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(c.execute(ORACLES[name]).fetchall())
    counted = spark.read.parquet(f"{tmp_path}/benchmark.parquet").select(F.col("text").alias("question"))
    assert search.chosen_strategy(counted).agg(F.sum("identifiers")).first()[0] > 0 == search.chosen_strategy(counted, identifiers=False).agg(F.sum("identifiers")).first()[0]


def test_near_pairs_of_long_texts_in_blocks(spark, monkeypatch):
    """Texts of 150 to 700 characters, where very common characters are left out from 200 on; several blocks, and syllables that most texts share."""
    monkeypatch.setattr(near_text, "BLOCK", 40)
    r = random.Random(15)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", " ", " ", ". "]
    base = ["".join(r.choice(parts) for _ in range(r.choice([75, 110, 300]))) for _ in range(100)]

    def edited(x):
        x = list(x)
        for _ in range(r.randint(0, len(x) // 8)):
            at = r.randrange(len(x))
            x[at : at + 1] = r.choice(["", "Z", "qé"])
        return "".join(x)

    a, b = base, [edited(x) for x in base[:60]] + base[60:70] + ["".join(r.choice(parts) for _ in range(80)) for _ in range(30)]
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    every = {(i, 1000 + j): ratio(x, y) for i, x in enumerate(a) for j, y in enumerate(b)}
    frame = lambda t, first: spark.createDataFrame([(first + i, x) for i, x in enumerate(t)], "id long, q string")
    found = {(x.a_id, x.b_id): x.ratio for x in near_text.near_pairs(frame(a, 0), frame(b, 1000), "id", "q", 0.85).collect()}
    assert found == {k: v for k, v in every.items() if v >= 0.85} and len(found) > 20
    other = {k: v for k, v in every.items() if k[1] >= 1070}
    x = near_text.nearest_pair(frame(a, 0), frame(b, 1000).where("id >= 1070"), "id", "q").first()
    assert (x.a_id, x.b_id, x.ratio) == min(((*k, v) for k, v in other.items()), key=lambda t: (-t[2], t[:2]))


def test_few_ratios_are_computed(spark):
    """2,000 texts of the same syllables: the bounds leave few pairs, where rare runs had left most."""
    r = random.Random(16)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", " ", " ", ". "]
    side = lambda: near_text._Side(list(range(1000)), ["".join(r.choice(parts) for _ in range(r.randint(30, 150))) for _ in range(1000)])
    a, b = side(), side()
    assert sum(len(i) for i, *_ in near_text._possible(a, b, [0.85])) < 1000


def test_inverted_file_tasks_do_not_grow(spark):
    """RET18: blocks of rows and groups of queries of any size give the same candidates, each pair of them by a task of its own."""
    import numpy as np

    r = np.random.default_rng(19)
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(600, 8)))], "vec_id long, embedding array<double>")
    model = inverted_file.fit(e, lists=8, parts=8)
    stored = inverted_file.index(e, model)
    found = lambda **sizes: inverted_file.candidates(e.where("vec_id % 10 = 0"), stored, model, 20, 6, **sizes)
    whole = sorted(map(tuple, found().collect()))
    small = found(block=100, group=12)
    assert sorted(map(tuple, small.collect())) == whole and len(whole) == 60 * 20
    assert "REPARTITION_BY_NUM" in small._jdf.queryExecution().executedPlan().toString()


def test_near_text_sends_each_text_a_bounded_number_of_times(spark, monkeypatch):
    monkeypatch.setattr(near_text, "BLOCK", 4)
    monkeypatch.setattr(near_text, "PARTS", 3)
    frame = lambda first, n, size=9: spark.createDataFrame([(first + i, "x" * size) for i in range(n)], "id long, q string")
    assert near_text._dealt(frame(0, 100), frame(1000, 60), "id", "q").count() == 160 * 3
    monkeypatch.setattr(near_text, "CHARS", 90)  # ten texts
    assert near_text._dealt(frame(0, 100), frame(1000, 6), "id", "q").count() == 100 * 2 + 6 * 10


def test_chunks_of_a_scope_are_not_joined_unless_documents_come_again(spark):
    rows = [("a", "en", 1, "x" * 1200), ("b", "de", 2, "y"), ("b", "de", 3, ""), ("c", None, None, "z")]
    frame = lambda r: spark.createDataFrame(r, "tenant string, kb string, doc_id long, text string")
    got = lambda r: sorted((x.doc_id, x.tenant, x.kb, x.chunk_index, len(x.chunk)) for x in scoped_chunks(frame(r)).collect())
    once = [(1, "a", "en", 0, 500), (1, "a", "en", 1, 500), (1, "a", "en", 2, 300), (2, "b", "de", 0, 1)]
    assert got(rows) == once
    assert "Join" not in scoped_chunks(frame(rows))._jdf.queryExecution().optimizedPlan().toString()
    again = got([*rows, ("d", "en", 2, "y")])
    assert again == sorted(once[:3] + 2 * [(2, "b", "de", 0, 1), (2, "d", "en", 0, 1)])
