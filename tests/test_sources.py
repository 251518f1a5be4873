import json

import pytest
from pyspark.sql import functions as F

from kinsieve.plans import audits
from kinsieve.sources import readers, writers
from kinsieve.streaming.filters import ngram_stream


def test_mapping_listing_and_lookup(spark, tmp_path):
    (tmp_path / "m.csv").write_text("old,new\n10,1000\n11,1001\n11,1002\nx,3\n")
    assert {(r.old_id, r.new_id) for r in readers.id_mapping(spark, str(tmp_path / "m.csv")).collect()} == {(10, 1000), (11, 1002)}
    (tmp_path / "t.json").write_text(json.dumps({"truncated": False, "tree": [{"path": "a/12.json"}, {"path": "b/x12.json"}, {"path": "none"}]}))
    assert [r.num for r in readers.listing_pool(spark, str(tmp_path / "t.json")).collect()] == [12]
    (tmp_path / "p.jsonl").write_text('{"localId": "5", "project": "x"}\n\n{"localId": "y", "project": "z"}\n')
    assert [tuple(r) for r in readers.project_lookup(spark, str(tmp_path / "p.jsonl")).collect()] == [(5, "x")]


def test_json_and_csv_items(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text(json.dumps({"org": "O", "repo": "r", "number": 3, "base": {"sha": "AB"}, "resolved_issues": [{"title": "t", "body": None}], "fix_patch": None}) + "\n")
    row = readers.multi_language_items(spark, [str(tmp_path / "m.jsonl")]).head()
    assert (row.id, row.repo, row.pr, row.base, row.text, row.patch) == ("O__r-3", "O/r", 3, "ab", "t ", "")
    assert readers.multi_language_items(spark, [str(tmp_path / "m.jsonl")], exclude="m.jsonl").count() == 0
    (tmp_path / "c.csv").write_text('instance_id,repo,pull_number,base_commit,problem_statement,patch\na-1,o/r,12.0,C,"two\nlines ""q""",p\n')
    row = readers.csv_items(spark, str(tmp_path / "c.csv")).head()
    assert row.pull_number == 12 and row.problem_statement == 'two\nlines "q"'
    (tmp_path / "oss.jsonl").write_text('{"instance_id": "p.ossfuzz-7", "patch": "x"}\n')
    (tmp_path / "cve.jsonl").write_text('{"instance_id": "q.cve-2020-9", "patch": null}\n')
    rows = readers.security_json(spark, {"oss": str(tmp_path / "oss.jsonl"), "cve": str(tmp_path / "cve.jsonl")}).collect()
    assert {(r.split, r.project, r.tracker_id) for r in rows} == {("oss", "p", 7), ("cve", "q", None)}


def test_files_and_records(spark, tmp_path):
    (tmp_path / "f/t1").mkdir(parents=True)
    (tmp_path / "f/t1/error.txt").write_bytes(b"a\n\xc3\xa9\xff")
    assert [tuple(r) for r in readers.text_files(spark, str(tmp_path / "f"), "error.txt").collect()] == [("t1", "a\né\ufffd")]
    (tmp_path / "r").mkdir()
    sha = "b" * 40
    (tmp_path / "r/9.json").write_text(json.dumps({"fix": [sha], "project": "p", "crash_type": "t", "report": {"comments": [{"content": "Crash State:\n  f\n"}]}}))
    row = readers.bug_records(spark, str(tmp_path / "r")).head()
    assert row.id == "9" and row.commits == [sha] and row.signature.frames == ["f"]


def test_united_first_part_wins(spark):
    a = spark.createDataFrame([("k", "a", 2)], "id string, v string, pos int")
    b = spark.createDataFrame([("k", "b", 1), ("l", "b", 2)], "id string, v string, pos int")
    assert {(r.id, r.v) for r in readers.united([a, b], "id", "pos").collect()} == {("k", "a"), ("l", "b")}


def test_writers_keep_headers(spark, tmp_path):
    df = spark.createDataFrame([("x", ["a", "b"], True), ("y", [], None)], "id string, l array<string>, f boolean")
    writers.csv_report(df, str(tmp_path / "a"), order=["id"])
    text = next((tmp_path / "a").glob("part*")).read_text()
    assert text == "id,l,f\nx,a;b,True\ny,,\n"
    writers.csv_report(df.limit(0), str(tmp_path / "b"))
    assert next((tmp_path / "b").glob("part*")).read_text() == "id,l,f\n"
    writers.id_list(df, "id", str(tmp_path / "c"), order="id")
    assert next((tmp_path / "c").glob("part*")).read_text() == "x\ny\n"
    out = writers.summary_json({"a": df.groupBy().count(), "n": {"k": 1}}, str(tmp_path / "s.json"))
    assert out == {"a": {"count": 2}, "n": {"k": 1}} and json.loads((tmp_path / "s.json").read_text()) == out
    assert writers.digest(out, ["n"]) == 'n: {"k": 1}'


def test_audits_run(spark, sf_dir):
    from kinsieve.queries import Tables

    t = Tables(spark, sf_dir)
    train, bench = readers.cyber_tasks(t("mimo_cyber")), readers.bench_tasks(t("cybergym"))
    found = audits.bug_audit(train, bench, t.mapping(), texts=False)
    assert found["text"] is None and all(d is None or d.count() >= 0 for d in found.values())
    assert all(d.count() >= 0 for d in audits.repository_audit(t.swe(), t.swe_bench()).values())


def test_stream_matches_batch(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/eval_items.parquet").select("item_id", "text").withColumnRenamed("text", "t")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    run = ngram_stream(stream, "doc_id", "text", items, "item_id", "t", 8).writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    batch = ngram_stream(docs, "doc_id", "text", items, "item_id", "t", 8)
    assert sorted(map(tuple, spark.table("hits").collect())) == sorted(map(tuple, batch.collect()))


def test_late_texts_and_optional_rows(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (2, "b", "y"), (3, "c", "z")], "id long, text string, key string")
    found = spark.createDataFrame([(2,), (2,), (None,), (9,)], "id long")
    assert sorted((r.id, r.text or "") for r in readers.late(found, rows, "id", ["text"]).collect()) == [(2, ""), (2, "b")]
    got = readers.with_optional(spark.createDataFrame([("x",), ("q",)], "key string"), rows.where("id = 1").select("key", "text"), "key")
    assert sorted((r.key, r.text, r.there) for r in got.collect()) == [("q", None, False), ("x", "a", True)]


def test_summaries_are_never_cut(spark):
    assert len(writers.summary_json({"a": spark.range(50)}, most=50)["a"]) == 50
    with pytest.raises(ValueError):
        writers.summary_json({"a": {"b": spark.range(51)}}, most=50)


def test_written_tables_can_be_cleared(spark):
    from kinsieve.plans import lineage

    lineage.cleared(spark)
    kept = lineage.written(spark.range(10))
    assert kept.count() == 10 and lineage.cleared(spark) == 1 and lineage.cleared(spark) == 0


def test_measured_cut(spark):
    from kinsieve.plans import lineage

    df, sums = lineage.measured(spark.range(10), n=F.count(F.lit(1)), top=F.max("id"))
    assert df.count() == 10 and sums == {"n": 10, "top": 9}
    none, sums = lineage.measured(spark.range(10).where("id > 99"), n=F.count(F.lit(1)), top=F.max("id"))
    assert none.count() == 0 and sums == {"n": 0, "top": None}
