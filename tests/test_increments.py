"""What grows by batches or comes late, and audits that must notice a change."""

import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestar.functions import plugins
from lodestar.operators import evaluate, jobs, lexical, relations, search
from lodestar.sources import readers
from lodestar.streaming import streams
from lodestar.streaming.store import PostingStore

DOCS = "doc_id long, text string"


def texts(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["泵压力", "the", "a"]
    return [" ".join(r.choice(words) for _ in range(r.choice([0, 3, 30, 200]))) + "." for _ in range(n)]


def test_postings_of_micro_batches_equal_the_batch(spark, tmp_path):
    """BM25 after k micro-batches, before and after compaction, is that of all chunks at once."""
    for k in range(4):
        rows = [(10 * k + i, t) for i, t in enumerate(texts(k, 8))] + [(10 * k + 8, texts(0, 8)[3]), (10 * k + 9, None)]
        spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    live = streams.file_stream(spark, f"{tmp_path}/in/*", DOCS, files_per_batch=1)
    base = f"{tmp_path}/out"
    streams.ingest(live, base, f"{tmp_path}/cp").awaitTermination()
    store = PostingStore(spark, base)
    chunks = spark.read.parquet(f"{base}/chunks").select(F.struct("doc_id", F.col("chunk_index").cast("long").alias("chunk_index")).alias("key"), F.col("chunk").alias("text"))
    asked = spark.createDataFrame([(1, "w1 the w2 w2"), (2, "泵压力 a"), (3, "none")], "query_id long, text string")
    want = {(x.query_id, x.key.doc_id, x.key.chunk_index): x.bm25 for x in lexical.bm25(asked, chunks, "query_id", "key").collect()}
    batches = len({x.batch for x in spark.read.parquet(f"{base}/postings").select("batch").distinct().collect()})
    assert batches == 4 and len(want) > 20

    def same():
        got = {(x.query_id, x.doc, x.chunk_index): x.bm25 for x in store.bm25(asked, "query_id").collect()}
        return got == {k: pytest.approx(v) for k, v in want.items()}

    assert same()
    store.compact(1)
    assert same()
    store.compact(3)
    store.compact(2)  # behind the snapshot: nothing to do
    assert same()
    store.add(spark.read.parquet(f"{base}/chunks/batch=3"), 3)  # a batch that runs again
    assert same()


def test_store_without_a_batch(spark, tmp_path):
    asked = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert PostingStore(spark, f"{tmp_path}/none").bm25(asked, "query_id").count() == 0


def test_latest_states_with_restarts_late_and_repeated_rows(spark, tmp_path):
    streams.use_rocksdb(spark)
    schema, path = "id long, seq long, state string", f"{tmp_path}/out"
    parts = [[(1, 1, "queued"), (1, 3, "done"), (2, 2, "running"), (4, None, "?")], [(1, 2, "late"), (1, 3, "done"), (3, 1, "queued")], [(2, 5, "done"), (3, 1, "queued")]]
    written = []
    for k, rows in enumerate(parts):  # each time the query starts again from its checkpoint
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        streams.latest_states(streams.file_stream(spark, f"{tmp_path}/in/*", schema), ["id"], "seq", path, f"{tmp_path}/cp").awaitTermination()
        written.append(spark.read.parquet(path).count())
    got = {(x.id, x.seq, x.state) for x in streams.current_states(spark, ["id"], "seq", path).collect()}
    assert got == {(1, 3, "done"), (2, 5, "done"), (3, 1, "queued")}
    assert written == [2, 3, 4]  # only what rises is written: no copy of the state a batch


def test_dropped_late_rows_are_counted(spark, tmp_path):
    late = streams.LateRows()
    spark.streams.addListener(late)
    try:
        schema = "tenant string, key string, ts timestamp"
        day = lambda d, k: ("t", k, f"2024-01-{d:02d} 00:00:00")
        frame = lambda rows: spark.createDataFrame(rows, "tenant string, key string, ts string").withColumn("ts", F.to_timestamp("ts"))
        for k, rows in enumerate([[day(1, "a"), day(10, "b")], [day(11, "c"), day(10, "b")], [day(2, "d"), day(3, "e"), day(11, "f")], [day(1, "g"), day(12, "h")]]):
            frame(rows).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        live = streams.intake(streams.file_stream(spark, f"{tmp_path}/in/*", schema, 1), ["tenant", "key"], "ts", "24 hours")
        taken = streams.run_once(live, f"{tmp_path}/cp", "counted").collect()
        assert sorted(x.key for x in taken) == ["a", "b", "c", "f", "h"]
        for _ in range(100):
            if late.dropped["counted"]:
                break
            __import__("time").sleep(0.1)
        assert late.dropped["counted"] == 3
    finally:
        spark.streams.removeListener(late)


@pytest.mark.parametrize("seed", [1, 2])
def test_first_match_against_all_pairs(spark, seed):
    r = random.Random(seed)
    urls = ["".join(r.choice("ab/x") for _ in range(r.randint(0, 12))) for _ in range(80)]
    fragments = ["".join(r.choice("ab/xz") for _ in range(r.randint(0, 5))) for _ in range(40)]
    cases = spark.createDataFrame([(i, f) for i, f in enumerate(fragments)] + [(99, None)], "c long, f string")
    catalog = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(500, None)], "o long, u string")
    want = {i: next((k for k, u in enumerate(urls) if f in u), None) for i, f in enumerate(fragments)} | {99: None}
    found = relations.first_match(cases, catalog, "f", "u", "c", "o", strict=False)
    assert {x.c: x.o for x in found.collect()} == want
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    with pytest.raises(PySparkException, match="no catalog row matches case"):
        relations.first_match(cases, catalog, "f", "u", "c", "o").collect()
    pairs = {(x.f, x.o) for x in relations.containing(cases, catalog, "f", "u", "o").collect()}
    assert pairs == {(f, k) for f in fragments if f for k, u in enumerate(urls) if f in u}


def test_claim_order_without_a_window_over_a_tenant(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["hot", "hot", "hot", "b", None]), r.choice(["queued", "running", "done", None]), r.randint(0, 9), r.randint(0, 3), 3, r.randint(0, 50)) for i in range(600)]
    j = spark.createDataFrame(rows, "id long, tenant_id string, state string, lease_expires_at long, attempt int, max_attempts int, created_at long")
    got = {x.id: (x.lease, x.claim_order) for x in jobs.lease_audit(j, F.lit(5)).collect()}
    assert len(got) == 600
    for tenant in ("hot", "b", None):
        mine = sorted((created, i) for i, t, *_, created in rows if t == tenant and got[i][0] in ("reclaimable", "claimable"))
        assert [got[i][1] for _, i in mine] == list(range(1, len(mine) + 1))
    assert all(n is None for lease, n in got.values() if lease not in ("reclaimable", "claimable"))


def test_line_numbers_over_file_parts(spark, tmp_path):
    """Files in several parts, read by several tasks: numbers as of one reader, without a range exchange of the texts."""
    lines = [json.dumps({"questions": [f"q{i}"], "answers": ["a" * (i % 50)]}) if i % 7 else "" for i in range(3000)]
    for name, part in (("b", lines[:1700]), ("a", lines[1700:])):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(part) + "\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = readers.read_qa(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 3
        order = lines[1700:] + lines[:1700]
        want = {(i, json.loads(x)["questions"][0]) for i, x in enumerate(order) if x and json.loads(x)["answers"][0]}
        assert {(x.row_index, x.question) for x in found.collect()} == want
        assert "rangepartitioning" not in found._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_tree_digest_sees_swaps_moves_and_changes(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "FAN", 4)
    rows = [("f", i, f"text {i}") for i in range(70)] + [("g", i, f"text {i}") for i in range(5)] + [("h", 0, "x")]

    def roots(some):
        d = spark.createDataFrame(some, "name string, i long, t string").repartition(3)
        return {x.name: (x.rows, x.sha256) for x in evaluate.tree_digest(d, ["name"], ["i"], F.concat_ws(":", "i", "t")).collect()}

    def plain(some):
        level = [hashlib.sha256(f"{i}:{t}".encode()).hexdigest() for _, i, t in sorted(some)]
        first = True
        while first or len(level) > 1:
            parts = [level[a : a + 4] for a in range(0, len(level), 4)]
            level = [hashlib.sha256("".join(p).encode()).hexdigest() for p in parts] if first or len(parts) < len(level) else level
            first = False
        return level[0]

    base = roots(rows)
    assert {n: c for n, (c, _) in base.items()} == {"f": 70, "g": 5, "h": 1}
    assert base["h"][1] == plain([rows[-1]]) and base["g"][1] != plain(rows[70:74])
    swapped = roots([("f", i, f"text {({3: 40, 40: 3}).get(i, i)}") for i in range(70)] + rows[70:])
    assert swapped["f"] != base["f"] and swapped["g"] == base["g"]
    assert roots(rows[1:])["f"] != base["f"] and roots([*rows, ("g", 9, "")])["g"] != base["g"]


def test_files_are_frozen_by_their_bytes(spark, tmp_path):
    a, b = '{"x": 1}', '{"x": 2}'
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.jsonl").write_text(f"{a}\n{b}\n\n")
    (tmp_path / "d" / "two.jsonl").write_text(f"{a}\n")
    manifest = [(n, hashlib.sha256((tmp_path / "d" / n).read_bytes()).hexdigest(), c) for n, c in (("one.jsonl", 2), ("two.jsonl", 1))]
    m = spark.createDataFrame([*manifest, ("gone.jsonl", "00", 1)], "name string, sha256 string, rows long")
    check = lambda: {x.name: x.frozen for x in evaluate.freeze_check(evaluate.file_digests(spark, f"{tmp_path}/d"), m).collect()}
    assert check() == {"one.jsonl": True, "two.jsonl": True, "gone.jsonl": False}
    (tmp_path / "d" / "one.jsonl").write_text(f"{b}\n{a}\n\n")  # the same rows in another order
    assert check() == {"one.jsonl": False, "two.jsonl": True, "gone.jsonl": False}


def test_probe_counts_a_planted_leak(spark):
    owners = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "k long, owner string")
    targets = spark.createDataFrame([(10, 2), (11, 3)], "q long, k long")
    seen = lambda rows: tuple(evaluate.leak_probe(spark.createDataFrame(rows, "q long, tenant string, k long"), targets, owners, "q", "k").first())
    assert seen([(10, "a", 1), (11, "a", 1)]) == (2, 0, 0, 2)
    assert seen([(10, "a", 1), (10, "a", 2), (11, "a", 2)]) == (3, 2, 1, 2)  # one is what was asked for
    assert evaluate.leak_probe(owners.selectExpr("k AS q", "'a' AS tenant", "k"), targets.limit(0), owners, "q", "k").first().targets == 0


def test_a_short_context_is_not_complete(spark):
    rows = [(1, 1, True, "alarm: close the valve, then restart", "close the valve"), (1, 2, True, "other", "close the valve"), (2, 1, False, "press the button", "press the button"), (2, 2, True, "press the button", "press the button")]
    frame = lambda some: spark.createDataFrame(some, "q long, rank int, gold boolean, text string, asked string")
    score = lambda d: tuple(evaluate.context_completeness(d, "q", F.col("gold"), "text", F.col("asked")).first())
    assert score(frame(rows)) == (0.5, 1.0, round(((36 + 5) / 2 + 16) / 2, 4))
    assert score(frame(rows).withColumn("text", F.left("text", F.lit(12))))[:2] == (0.0, 0.0)


def test_plugins_load_once_normalise_and_check_their_tag(spark, tmp_path):
    log = f"{tmp_path}/log"

    def load():
        class Model:
            name = "letters-3"

            def embed(self, texts):
                assert len(texts) <= 7
                return [[t.count(c) for c in "abc"] for t in texts]

        with open(log, "a") as f:
            f.write("x")
        return Model()

    d = spark.createDataFrame([(i, t) for i, t in enumerate(["aab", "", None, "cccc"] * 10)], "k long, text string").coalesce(1)
    got = plugins.with_embedding(d, "text", load, "letters-3", 3, 7).orderBy("k").collect()
    assert got[0].embedding == pytest.approx(list(np.array([2, 1, 0]) / 5**0.5)) and got[1].embedding == got[2].embedding == [0, 0, 0] and got[3].embedding == [0, 0, 1]
    assert {x.embedding_model for x in got} == {"letters-3"} and len(open(log).read()) == 1
    tagged = plugins.with_embedding(d, "text", load, "letters-3", 3, 7)
    assert tagged.where(plugins.of_model(tagged, "other")).count() == 0 and tagged.where(plugins.of_model(tagged, "letters-3")).count() == 40
    with pytest.raises(PySparkException, match="not 'other'"):
        plugins.with_embedding(d, "text", load, "other", 3, 7).collect()
    with pytest.raises(PySparkException, match="not of 4 numbers"):
        plugins.with_embedding(d, "text", load, "letters-3", 4, 7).collect()


def test_rerank_by_a_plugin(spark):
    d = spark.createDataFrame([(1, 10, 1, "a b c", "x a"), (1, 11, 2, "a b c", "C b, a"), (1, 12, 3, "a b c", None)], "q long, k long, rank int, question string, text string")
    got = search.rerank(d, ["q"], "k", plugins.scorer(plugins.TokenOverlap, plugins.TokenOverlap.name)("question", "text")).orderBy("new_rank").collect()
    assert [(x.k, x.rerank_score) for x in got] == [(11, 1.0), (10, 0.25), (12, 0.0)]
    assert re.fullmatch(r"token-overlap-v\d", plugins.TokenOverlap.name)
