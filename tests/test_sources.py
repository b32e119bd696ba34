import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestar.operators import chunking, relations
from lodestar.sources import readers, sinks
from lodestar.streaming import streams


def test_csv_is_sniffed_and_read_as_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("asset_id;status\nA-1;on\nA-2;\n")
    assert readers.sniff_delimiter(spark, str(tmp_path / "a.csv")) == ";"
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("A-1", "on"), ("A-2", None)]


def test_json_records_keep_key_order_and_fail_on_errors(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"z":"1","a":null}\n\n{"z":"2","a":"x"}\n')
    lines = readers.read_json_records(spark, str(tmp_path / "a.jsonl"), lines=True).select(readers.record_line(F.col("record")).alias("t"))
    assert [r.t for r in lines.collect()] == ["z: 1 | a: ", "z: 2 | a: x"]
    (tmp_path / "b.json").write_text('[{"k":"1"},{"k":"2"}]')
    assert readers.read_json_records(spark, str(tmp_path / "b.json"), lines=False).count() == 2
    (tmp_path / "c.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        readers.read_json_records(spark, str(tmp_path / "c.jsonl"), lines=True).collect()


def test_topics_filter_languages_and_incomplete_rows(spark, tmp_path):
    (tmp_path / "t.xml").write_text('<health-topics><health-topic id="1" title="A" url="u1" language="English"><full-summary>&lt;p&gt;One&lt;/p&gt;</full-summary></health-topic><health-topic id="2" title="B" url="u2" language="Spanish"><full-summary>x</full-summary></health-topic></health-topics>')
    got = readers.read_topics(spark, str(tmp_path / "t.xml"), ["English"]).collect()
    assert [(r.id, r.title, "One" in r.content) for r in got] == [("1", "A", True)]


def test_html_lines():
    assert readers.html_to_text("<p>a &amp; b</p><div> c <script>x</script></div>") == "a & b\nc x"
    assert readers.html_to_text("<p>a</p><script>x</script>", drop_script=True) == "a"


def test_qa_lines_are_flattened(spark, tmp_path):
    rows = [{"questions": [["q1", ["q2"]], "q1"], "answers": ["a \"x\""]}, {"questions": [], "answers": ["a"]}]
    (tmp_path / "qa.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = readers.read_qa(spark, str(tmp_path / "qa.jsonl"), limit=5).collect()
    assert [(r.question, r.answer) for r in got] == [("q1；q2", 'a "x"')]


def test_known_files_are_skipped(spark, tmp_path):
    for n in ("a.md", "b.md"):
        (tmp_path / n).write_text(n)
    known = spark.createDataFrame([("a.md",)], "source string")
    assert [r.source for r in readers.read_new_files(spark, str(tmp_path), known).collect()] == ["b.md"]


def test_archives_are_audited(spark):
    def packed(name, data):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(name, data)
        return bytearray(out.getvalue())

    files = spark.createDataFrame([("ok", packed("a.xml", b"x")), ("up", packed("../a", b"x")), ("bomb", packed("a", b"0" * 2_000_000)), ("macro", packed("word/vbaProject.bin", b"x"))], "path string, content binary")
    got = {r.path: r.verdict for r in readers.archive_audit(readers.archive_entries(files)).collect()}
    assert got == {"ok": "ok", "up": "unsafe path", "bomb": "ratio", "macro": "macro"}


def test_catalog_rules(spark):
    rows = [("a", "t1", "f1", "https://x.org/1", "0" * 64, "gold"), ("b", "t1", "f2", "https://bad.org/2", "zz", "gold")]
    c = spark.createDataFrame(rows, "key string, title string, filename string, url string, sha256 string, trust_tier string")
    got = {r.key: r.broken for r in readers.catalog_errors(c, ["x.org"], ["gold"]).collect()}
    assert got == {"a": ["repeated title"], "b": ["host", "sha256", "repeated title"]}


def test_export_has_sorted_keys(spark):
    d = spark.createDataFrame([(1, None, bytearray(b"ab"))], "b int, a string, c binary")
    assert sinks.export_lines(d, ["c", "b", "a"]).first().value == '{"a":null,"b":1,"c":{"base64":"YWI="}}'


def test_chunks_in_sql(spark):
    spark.udtf.register("chunks", chunking.Chunks)
    assert spark.sql("SELECT chunk FROM VALUES ('" + "word. " * 40 + "') AS d(t), LATERAL chunks(t, 100, 10)").count() >= 3


def test_intake_drops_repeats_within_the_watermark(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES ('t', 'k1', TIMESTAMP '2024-01-01 00:00:00'), ('t', 'k1', TIMESTAMP '2024-01-01 00:01:00'), ('t', 'k2', TIMESTAMP '2024-01-01 00:02:00') AS v(tenant, key, ts)")
    rows.write.parquet(f"{tmp_path}/in")
    live = streams.intake(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), ["tenant", "key"], "ts")
    assert sorted(r.key for r in streams.run_once(live, f"{tmp_path}/cp", "taken").collect()) == ["k1", "k2"]


def test_page_and_validation(spark):
    d = spark.range(10).withColumnRenamed("id", "k")
    got = relations.page(d, "k", 2, 3).collect()
    assert [r.k for r in got] == [7, 6, 5] and got[0].total == 10 and got[0].has_more
