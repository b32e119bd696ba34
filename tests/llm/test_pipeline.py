import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_pack_what_is_left(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert kept.columns == columns and 0 < kept.count() <= docs.count()
        docs = kept
    pieces = P.packing(spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_against_brute_force(spark):
    """Each stage on its own small input: what goes and what stays, with nulls, empty texts, repeats and extra columns."""
    import random

    from test_operators import jaccard_components, plain_base, prose

    schema = "doc_id long, text string, lang string, source string, n_chars int"
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null").collect()}
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]

    # near_dedup: one of each component of 5-word shingles stays
    base = prose(3, 80).split()
    near = [(100 + i, prose(i, 40)) for i in range(8)] + [(i, " ".join(w if k % 80 != i * 7 % 80 else f"new{i}" for k, w in enumerate(base))) for i in range(12)] + [(50, None), (51, ""), (None, None), (None, base[0])]
    want = sorted(i for i, (_, c) in jaccard_components([r for r in near if r[0] is not None], 5, 80).items() if i == c)
    kept = P.near_dedup(spark, frame(near), SF)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want and kept.where("doc_id is null").count() == 2

    # decontaminate: what holds a benchmark text goes, with a doc_id or without
    rows = [(1, prose(1, 60)), (2, prose(2, 30) + " " + item + " " + prose(3, 30)), (None, item), (None, prose(4, 30)), (3, None), (4, "")]
    assert sorted((r.doc_id or 0, r.text or "") for r in P.decontaminate(spark, frame(rows), SF).collect()) == sorted([(1, rows[0][1]), (0, rows[3][1]), (3, ""), (4, "")])

    # secrets: every match of the patterns is masked, and n_chars is counted anew
    r = random.Random(4)
    rows = [(i, prose(i, 20) + " token = " + "".join(r.choices("0123456789abcdef", k=40)) + " " + prose(i + 50, 20)) for i in range(40)] + [(None, "AKIA" + "A1" * 8), (90, None), (91, ""), (92, prose(5, 40))]
    for x in P.secrets(spark, frame(rows), SF).collect():
        before = dict(rows).get(x.doc_id)
        assert plain_base(x.text or "") == "" and x.n_chars == len(x.text or "") and ((x.text == before) == (plain_base(before or "") == ""))

    # toxicity: of the labelled documents nearly all are judged as labelled
    kept = {x.doc_id for x in P.toxicity(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    right = [(i in kept) == (not labels[i]) for i, _ in given if i in labels]
    assert sum(right) >= 0.9 * len(right)

    for name, stage in P.STAGES[:-1]:
        if name != "toxicity":
            assert stage(spark, frame([]), SF).count() == 0
    assert P.toxicity(spark, frame([]), SF).count() == 0 and P.packing(spark, frame([]), SF).count() == 0
