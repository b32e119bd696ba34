"""Operators whose queries have no SQL, against plain versions of them."""

import hashlib
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions import vectors as V
from lodestar.operators import chunking, lexical, search
from lodestar.sources import readers


def prose(r, n):
    return "".join(r.choice(["pump ", "Alarm ", "é", "泵压力", "x-1 ", "straße ", "ﬁne ", "\t", "\n", "  "]) + r.choice(["", "", ". ", "! ", "。", "\n"]) for _ in range(n))


def corpus(seed=3, n=40):
    r = random.Random(seed)
    return [(i, prose(r, r.choice([0, 1, 5, 60, 400]))) for i in range(n)] + [(n, None)]


def test_normalised_elements(spark):
    rows = [(i, k, t) for i, t in corpus() for k in range(2)]
    e = spark.createDataFrame(rows, "doc_id long, element_index int, text string")
    got = {(x.doc_id, x.element_index): x.text for x in readers.normalised_elements(e, "doc_id", F.concat(F.lit("from "), F.col("doc_id"))).collect()}
    clean = lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t)).strip(" ")
    want = {(i, 0): f"from {i}" for i, *_ in rows} | {(i, k + 1): clean(t) for i, k, t in rows if t is not None and clean(t)}
    assert got == want


def test_question_keys(spark):
    rows = corpus(4)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.k for x in d.select("doc_id", T.question_key(F.col("text")).alias("k")).collect()}
    want = {i: None if t is None else re.sub(r"[^A-Za-z0-9_一-鿿]+", "", unicodedata.normalize("NFKC", t).casefold()) for i, t in rows}
    assert got == want


def plain_tokens(text):
    low = (text or "").lower()
    out = re.findall(r"[a-z0-9_+\-]+", low)
    for run in re.findall("[一-鿿]+", low):
        out += list(run) + [run[i : i + 2] for i in range(len(run) - 1)]
    return out


def test_hashed_embeddings(spark):
    rows = corpus(5)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.bucket): x.weight for x in V.hashed_embedding(d, "doc_id", "text").collect()}
    want = {}
    for i, t in rows:
        sums = Counter()
        for token in plain_tokens(t):
            h = hashlib.blake2b(token.encode(), digest_size=8).digest()
            sums[int.from_bytes(h[:4], "big") % 256] += 1 if h[4] & 1 else -1
        norm = sum(x * x for x in sums.values()) ** 0.5
        want |= {(i, b): x / norm for b, x in sums.items() if norm}
    assert {k: v for k, v in got.items() if v} == {k: pytest.approx(v) for k, v in want.items() if v}


def test_children_and_profiles(spark):
    """Children are the cuts of their parent; a profile is counted from the pieces themselves."""
    r = random.Random(6)
    parents = [(i, k, prose(r, 200)) for i in range(6) for k in range(2)]
    p = spark.createDataFrame(parents, "document_id long, parent_index int, text string")
    got = {}
    for x in chunking.children_of(p, 350, 50).collect():
        got.setdefault((x.document_id, x.parent_id), {})[x.child_index] = x.text
    ids = {(x.document_id, x.parent_index): x.h for x in p.select("document_id", "parent_index", F.xxhash64("document_id", "parent_index").alias("h")).collect()}
    assert got == {(i, ids[i, k]): dict(enumerate(chunking.cut(t, 350, 50))) for i, k, t in parents if chunking.cut(t, 350, 50)}

    whole = {i: sum(len(t) for j, _, t in parents if j == i) for i in range(6)}
    pieces = [("p", i, 100 * k + c, t, whole[i]) for i, k, text in parents for c, t in enumerate(chunking.cut(text, 350, 50))]
    c = spark.createDataFrame(pieces, "name string, doc long, at int, chunk string, whole long")
    x = chunking.profile(c, ["name"], "doc", "at", "chunk", "whole").first()
    final = {i: max(at for _, j, at, *_ in pieces if j == i) for i in range(6)}
    inner = [t for _, i, at, t, _ in pieces if at != final[i]]
    chars = sum(len(t) for *_, t, _ in pieces)
    middle = sum(not re.search(r"[。！？；.!?;]\Z", re.sub(r"[ \t\n\x0b\f\r]+\Z", "", t)) for t in inner)
    assert x.chunks == len(pieces) and x.mean_chars == pytest.approx(chars / len(pieces), abs=1e-4)
    assert x.duplicated == pytest.approx(max(0, chars - sum(whole.values())) / sum(whole.values()), abs=1e-4)
    assert x.mid_sentence == pytest.approx(middle / len(inner), abs=1e-4)


def test_parent_child_search(spark):
    """The best child of each parent, the three best parents, with their texts."""
    r = random.Random(7)
    words = ["pump", "alarm", "valve", "fan", "x"]
    children = [(c, c // 3, " ".join(r.choice(words) for _ in range(r.randint(1, 6)))) for c in range(30)]
    d = spark.createDataFrame(children, "chunk_id long, parent_id long, text string")
    parents = spark.createDataFrame([(p, f"parent {p}") for p in range(10)], "parent_id long, parent_text string")
    q = spark.createDataFrame([(1, "pump alarm"), (2, "fan fan x"), (3, "none")], "query_id long, text string")
    scored = lexical.bm25(q, d, "query_id", "chunk_id").withColumn("score", F.round(lexical.max_normalised(F.col("bm25"), ["query_id"]), 6))
    all_scores = {(x.query_id, x.chunk_id): x.score for x in scored.collect()}
    got = {(x.query_id, x["rank"]): (x.parent_id, x.chunk_id, x.parent_text) for x in search.parent_child(scored, d, parents, ["query_id"], 3).collect()}
    want = {}
    for query in (1, 2, 3):
        best = {}
        for (a, c), s in all_scores.items():
            if a == query:
                best[c // 3] = min(best.get(c // 3, (9, 0)), (-s, c))
        for k, (p, (_, c)) in enumerate(sorted(best.items(), key=lambda e: e[1])[:3]):
            want[query, k + 1] = (p, c, f"parent {p}")
    assert got == want and len(got) == 6


def test_html_text_of_given_pages(spark):
    """Without scripts and styles, the text of a page holds no tags, and all that is between tags in order."""
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html", readers.html_text_plain("html").alias("t")).collect()
    for x in pages:
        plain = unescape(re.sub(r"<[^>]*>", " ", re.sub(r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style)\b.*?</\1>", " ", x.html)))
        assert "".join(plain.split()) == "".join(x.t.split())


def plain_parents(elements, most):
    """CHK3 of one document's elements in order, held whole."""
    out, held, heading = [], [], None
    size = lambda: sum(len(t) + 2 for _, t, _ in held)

    def flush():
        nonlocal held, heading
        if held:
            pages = [p for *_, p in held if p is not None]
            out.append((len(out), "\n\n".join(t for _, t, _ in held), held[0][0], held[-1][0], min(pages, default=None), max(pages, default=None), heading))
        held, heading = [], None

    for at, text, page, title in sorted(elements):
        text = re.sub("[ \t]+", " ", (text or "").replace("\r\n", "\n").replace("\r", "\n")).strip()
        if not text:
            continue
        if held and (title and title != heading or size() + len(text) > most):
            flush()
        for piece in [text] if len(text) <= most else chunking.cut(text, most, 0):
            held.append((at, piece, page))
            heading = heading or title or None
            if len(text) > most:
                flush()
    flush()
    return out


def test_parents_equal_plain_ones_without_a_worker_call_a_document(spark):
    """Long elements, null pages and headings, elements out of order, documents without text; one pass over a partition, not a group a document."""
    r = random.Random(8)
    rows = [(d, k, r.choice([None, "", prose(r, r.choice([1, 9, 80]))]), r.choice([None, 1, 2, 7]), r.choice([None, "", "A", "B"])) for d in range(60) for k in range(r.choice([0, 1, 12]))]
    r.shuffle(rows)
    e = spark.createDataFrame(rows, "document_id long, element_index int, text string, page_number int, heading string").repartition(5)
    p = chunking.pack_parents(e, 300)
    want = {(d, *x) for d in {x[0] for x in rows} for x in plain_parents([x[1:] for x in rows if x[0] == d], 300)} if rows else set()
    assert {tuple(x) for x in p.collect()} == want and len(want) > 50
    assert "FlatMapGroups" not in p._jdf.queryExecution().executedPlan().toString()


def test_chunks_leave_a_task_in_small_parts(spark):
    """CHK1 hands on a few texts' chunks at once; texts are null, empty and long."""
    rows = [(i, t) for i, t in corpus(9, 60)] + [(1000 + i, "word. " * 40_000) for i in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {}
    for x in chunking.boundary_chunks(d, "doc_id", "text").collect():
        got.setdefault(x.doc_id, {})[x.chunk_index] = x.chunk
    assert got == {i: dict(enumerate(chunking.cut(t, 600, 80))) for i, t in rows if t and chunking.cut(t, 600, 80)}
    assert "ArrowEvalPython" not in chunking.boundary_chunks(d, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()


def test_best_rows_of_the_best_groups(spark):
    """RET9 from each task's best rows: the five best parents by their best child equal those of all pairs, ties included."""
    from lodestar.operators import best_bm25
    from lodestar.operators.fusion import first_by

    r = random.Random(12)
    words = ["pump", "alarm", "valve", "fan", "x", "y", "z"]
    rows = [(c, " ".join(r.choice(words[: r.choice([2, 7])]) for _ in range(r.randint(1, 6))), (c * 7) % 40) for c in range(400)]
    d = spark.createDataFrame(rows, "chunk_id long, text string, parent_id long").repartition(4)
    q = spark.createDataFrame([(1, "pump alarm"), (2, "fan fan x"), (3, "none"), (4, "z")], "query_id long, text string")
    score = F.round(lexical.max_normalised(F.col("bm25"), ["query_id"]), 6)
    ranked = lambda s: sorted((x.query_id, x["rank"], x.parent_id, x.chunk_id, x.score) for x in first_by(s.withColumn("score", score), ["query_id"], "parent_id", "score", "chunk_id", 5).collect())
    want = ranked(lexical.bm25(q, d, "query_id", "chunk_id").join(d.select("chunk_id", "parent_id"), "chunk_id"))
    kept = best_bm25.best_bm25(q, d, "query_id", "chunk_id", 5, group="parent_id")
    assert ranked(kept) == want and len(want) == 15
    assert kept.count() < lexical.bm25(q, d, "query_id", "chunk_id").count() / 2


def test_pages_are_read_once_and_in_small_parts(spark):
    """SRC6 of a table: both texts from one reading, without a UDF over a whole batch of pages."""
    r = random.Random(13)
    page = lambda: "".join(r.choice(["<p>a  b</p>", "<script>x&amp;1", "</script>", "<style>s</style>", "é &lt; ", "<br>", "\n", "泵", "<b>q</b>"]) for _ in range(r.choice([0, 3, 40])))
    rows = [(i, page()) for i in range(200)] + [(500, None), (501, "<p>long</p> " * 50_000)]
    got = readers.html_texts(spark.createDataFrame(rows, "page_id long, html string").coalesce(2), "page_id", "html")
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    assert {x.page_id: (x.text, x.plain) for x in got.collect()} == {i: (None, None) if h is None else (readers.html_to_text(h), readers.html_to_text(h, True)) for i, h in rows}


def test_summaries_are_gathered_without_a_join(spark):
    """SUM2 equals the whole join of all lines, cut; short and long summaries, empty ones, a job with thousands of rows."""
    from lodestar.operators import answers

    r = random.Random(14)
    rows = [(i, r.choice("ab"), r.choice(["x", "", "word " * 20, "y" * 1200])) for i in range(3000)] + [(10_000 + i, "c", "z") for i in range(900)] + [(20_000, "d", "")]
    m = spark.createDataFrame(rows, "doc_id long, source string, summary string").repartition(4)
    got = answers.reduce_summaries(m, "source")
    want = {j: "\n".join(f"- {s} [document:{i}]" for i, k, s in sorted(rows) if k == j and s)[:8000] for j in "abc"}
    assert {x.source: x.summary for x in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("again", [0, 5])
def test_hashed_embeddings_without_a_shuffle(spark, again):
    """EMB1 by tasks equals plain sums, and so do keys that come twice, which are summed over all their rows."""
    rows = corpus(17, 30) + (corpus(18, again) if again else [])
    got = V.hashed_embedding(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text")
    want = {}
    for i in {i for i, _ in rows}:
        sums = Counter()
        for t in (t for j, t in rows if j == i):
            for token in plain_tokens(t):
                h = hashlib.blake2b(token.encode(), digest_size=8).digest()
                sums[int.from_bytes(h[:4], "big") % 256] += 1 if h[4] & 1 else -1
        norm = sum(x * x for x in sums.values()) ** 0.5
        want |= {(i, b): x / norm for b, x in sums.items() if norm}
    assert {(x.doc_id, x.bucket): x.weight for x in got.collect()} == {k: pytest.approx(v) for k, v in want.items()}
    if not again:
        assert "SinglePartition" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning" not in plan


def test_backfill_sorts_no_chunk(spark):
    """JN7 with many chunks a document: the different keys of documents that have a parent are held, the chunks pass by."""
    from lodestar.operators import relations

    rows = [(d, k) for d in range(200) for k in range(d % 7)]
    c = spark.createDataFrame(rows, "document_id long, chunk_index int")
    parents, children = relations.backfill(c, c.where("document_id % 3 = 0"), c.where("document_id % 5 = 0 and chunk_index = 0"))
    assert sorted(map(tuple, parents.collect())) == rows
    assert sorted(map(tuple, children.collect())) == [x for x in rows if x[0] % 5 or not x[1]]
    plan = parents._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_best_rows_in_small_parts(spark, monkeypatch):
    """Tokens are looked up a few rows at a time, with the same result."""
    from lodestar.operators import best_bm25

    r = random.Random(20)
    d = spark.createDataFrame([(i, " ".join(r.choice(["pump", "fan", "x", "alarm", "w1", "w2"]) for _ in range(r.randint(0, 9)))) for i in range(150)], "doc_id long, text string").coalesce(1)
    q = spark.createDataFrame([(1, "pump w1"), (2, "fan alarm")], "query_id long, text string")
    best = lambda: sorted(map(tuple, lexical.top_k(best_bm25.best_bm25(q, d, "query_id", "doc_id", 5), ["query_id"], "bm25", "doc_id", 5).collect()))
    whole = best()
    monkeypatch.setattr(best_bm25, "ROWS", 7)
    assert [x[:2] + x[3:] for x in best()] == [x[:2] + x[3:] for x in whole] and len(whole) == 10
