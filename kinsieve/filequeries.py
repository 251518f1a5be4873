"""Queries that write files of every form that an audit reads or reports, read them again, and compare; with their SQL over the tables.

Files go to the shared folder, whole tables each, in a folder of its own per run, since several runs may share a session.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsieve.functions import ids
from kinsieve.operators import splits
from kinsieve.plans.lineage import shared_folder
from kinsieve.sources import readers, writers

_ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    _ALL[f.__name__] = f
    return f


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}/{name}"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return readers.table(spark, folder, name)


@query
def read_security_json(spark, folder):
    """JSON lines, one folder a split."""
    sec, files = _table(spark, folder, "sec_bench"), {}
    for split in ("oss", "cve"):
        files[split] = _folder(spark, split)
        sec.where(F.col("split") == split).select("instance_id", "patch", "bug_description", "sanitizer_report", "bug_report").write.json(files[split])
    rows = readers.security_json(spark, files)
    return rows.select("instance_id", "split", "project", "tracker_id", F.length("patch").alias("patch_chars"), F.length("sanitizer_report").alias("report_chars"))


@query
def read_csv_items(spark, folder):
    """CSV with quoted fields over several lines, numbers as floats (S14); base columns through the row normaliser."""
    path = _folder(spark, "items")
    swe = _table(spark, folder, "swe_rebench_v2").withColumn("pull_number", F.concat(ids.pr_number(F.col("instance_id")).cast("string"), F.lit(".0")))
    swe.select("instance_id", "repo", "base_commit", "problem_statement", "pull_number", "row_id").write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)
    rows = readers.csv_items(spark, path).withColumn("row_id", F.col("row_id").cast("bigint"))
    items = readers.swe_items(rows, F.lit("csv"), F.col("pull_number"))
    return items.select("pos", "id", "repo", "base", "pr", F.size(F.split(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), " ")).alias("words"))


@query
def read_multi_language(spark, folder):
    """Nested JSON lines in a folder for each language; one that is left out by its path."""
    root = _folder(spark, "languages")
    swe = _table(spark, folder, "swe_rebench_v2").where("repo like '%/%' and language is not null")
    issues = F.array(F.struct(F.lit("A title").alias("title"), F.col("problem_statement").alias("body")), F.struct(F.lit(None).cast("string").alias("title"), F.lit("x").alias("body")))
    nested = swe.select(
        F.split_part("repo", F.lit("/"), F.lit(1)).alias("org"), F.split_part("repo", F.lit("/"), F.lit(2)).alias("repo"), F.col("row_id").alias("number"), F.struct(F.col("base_commit").alias("sha")).alias("base"),
        issues.alias("resolved_issues"), F.col("patch").alias("fix_patch"), F.lower("language").alias("lang"),
    )
    nested.write.partitionBy("lang").json(root)
    rows = readers.multi_language_items(spark, [f"{root}/*"], exclude="lang=python")
    return rows.select("id", "repo", "pr", "base", F.length("text").alias("text_chars"), F.length("patch").alias("patch_chars"))


@query
def read_discarded_pulls(spark, folder):
    """Pull requests that a pipeline dropped, from JSON lines."""
    path = _folder(spark, "discarded")
    pulls = _table(spark, folder, "overlap_v2_prs").where("benchmark_repo like '%/%'")
    pulls.select(F.split_part("benchmark_repo", F.lit("/"), F.lit(1)).alias("org"), F.split_part("benchmark_repo", F.lit("/"), F.lit(2)).alias("repo"), F.col("pr").alias("number")).write.json(path)
    return readers.discarded_pulls(spark, path)


@query
def read_id_mapping(spark, folder):
    """A CSV of old and new ids with a header, blanks around ids and lines that are no ids (S4); every old number once."""
    path = _folder(spark, "mapping")
    numbers = readers.bench_tasks(_table(spark, folder, "cybergym")).select("num").where("num is not null").distinct()
    lines = numbers.select(F.concat(F.lit(" "), F.col("num").cast("string")).alias("a"), F.when(~ids.is_old_scheme(F.col("num")), "pending").otherwise((F.col("num") + 7).cast("string")).alias("b"))
    header = spark.createDataFrame([("localId", "issueId")], "a string, b string")
    header.unionByName(lines).coalesce(1).write.option("ignoreLeadingWhiteSpace", False).csv(path)
    return readers.id_mapping(spark, path)


@query
def read_listing_pool(spark, folder):
    """The numbers of a tree listing, one JSON document."""
    path = _folder(spark, "listing")
    names = readers.cyber_tasks(_table(spark, folder, "mimo_cyber")).where("num is not null").select(F.concat(F.lit("meta/"), F.col("num"), F.lit(".json")).alias("path"))
    tree = names.unionByName(spark.createDataFrame([("README.md",), ("meta/v2.d",)], "path string"))
    tree.select(F.to_json(F.struct("path")).alias("j")).agg(F.concat(F.lit('{"truncated": false, "tree": ['), F.array_join(F.collect_list("j"), ","), F.lit("]}"))).coalesce(1).write.text(path)  # a listing is one document
    return readers.listing_pool(spark, path)


@query
def read_project_lookup(spark, folder):
    """JSON lines of numbers as texts and projects."""
    path = _folder(spark, "projects")
    tasks = readers.bench_tasks(_table(spark, folder, "cybergym"))
    tasks.select(F.col("num").cast("string").alias("localId"), "project").write.json(path)
    return readers.project_lookup(spark, path)


@query
def read_json_array(spark, folder):
    """One JSON array document."""
    path = _folder(spark, "array")
    targets = _table(spark, folder, "mix_targets")
    targets.select(F.to_json(F.struct("source", "target_share", "max_repeats")).alias("j")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ",\n"), F.lit("]"))).coalesce(1).write.text(path)
    return readers.json_array(spark, path, "source string, target_share double, max_repeats int")


@query
def read_bug_records(spark, folder):
    """Records by bug as JSON texts (S7): fixes of any form, states of frames. Bugs without a record, here those without a project, give nulls."""
    tasks = readers.bench_tasks(_table(spark, folder, "cybergym")).where("num is not null").groupBy("num").agg(F.min_by("project", "pos").alias("project"))
    commit = F.sha1(F.col("num").cast("string"))
    fix = F.when(F.length("project") > 6, F.array(commit, F.upper(commit))).otherwise(F.array(commit))
    content = F.concat(F.lit("Crash State:\n  fn_"), F.col("num"), F.lit("\n  caller\n"))
    record = F.struct("project", F.lit("uaf").alias("crash_type"), fix.alias("fix_commit"), F.struct(F.array(F.struct(content.alias("content"))).alias("comments")).alias("report"))
    path = _folder(spark, "records")
    tasks.where("project is not null").select(F.concat_ws("\t", F.col("num").cast("string"), F.to_json(record)).alias("value")).write.text(path)
    found = spark.read.text(path).select(F.split_part("value", F.lit("\t"), F.lit(1)).alias("id"), F.split_part("value", F.lit("\t"), F.lit(2)).alias("value"))
    out = readers.with_optional(tasks.select(F.col("num").cast("string").alias("id")), readers.parsed_records(found), "id")
    return out.select("id", F.array_join("commits", ";").alias("commits"), F.array_join("signature.frames", ";").alias("frames"), "there")


@query
def read_several_parquet(spark, folder):
    """Two columns of several Parquet files, each row with its file's name."""
    root = _folder(spark, "shards")
    swe = _table(spark, folder, "swe_rebench_v2")
    paths = []
    for k in range(3):
        paths.append(f"{root}/part{k}")
        swe.where(F.pmod("row_id", F.lit(3)) == k).write.parquet(paths[-1])
    rows = readers.located_columns(spark, paths, ["row_id", "instance_id"])
    return rows.select("row_id", "instance_id", F.regexp_extract("__file", "/(part\\d)/", 1).alias("shard"))


@query
def late_texts(spark, folder):
    """Wide texts only of the rows that a join on keys has found (S12): how long the patches of paired training rows are."""
    t = lambda name: _table(spark, folder, name)
    swe, pairs = t("swe_rebench_v2"), t("overlap_v2_prs")
    named = pairs.select(F.lower(F.trim("training_instance_id")).alias("k")).where("k <> ''").distinct()
    found = swe.select("row_id", F.lower("instance_id").alias("k")).join(named, "k").select("row_id")
    return readers.late(found, swe, "row_id", ["patch", "problem_statement"]).select("row_id", F.length("patch").alias("patch_chars"), F.length("problem_statement").alias("text_chars"))


@query
def united_configs(spark, folder):
    """Two configurations of a source, the first one's rows before the second one's."""
    mimo = _table(spark, folder, "mimo_cyber").select(F.col("extra_info.instance_id").alias("id"), "row_id", F.try_element_at("prompt", F.lit(1))["content"].alias("spec"))
    return readers.united([mimo.where("row_id % 2 = 1"), mimo.where("row_id % 2 = 0")], "id", "row_id")


@query
def write_csv_report(spark, folder):
    """A report as CSV, lists joined and booleans spelled out, read as text (K1, K2, O1)."""
    path = _folder(spark, "report")
    rows = _table(spark, folder, "sec_bench").select("sec_id", F.array_sort(F.array(F.col("split"), ids.project_of(F.col("instance_id")))).alias("parts"), F.col("patch").isNull().alias("no_patch"), F.nullif("split", F.lit("cve")).alias("oss"))
    writers.csv_report(rows, path, order=["sec_id"])
    return spark.read.option("header", True).csv(path).select("sec_id", "parts", "no_patch", "oss")


@query
def write_id_list(spark, folder):
    """One id a line (K3)."""
    path = _folder(spark, "ids")
    writers.id_list(_table(spark, folder, "cybergym").where("task_id is not null").select("task_id").distinct(), "task_id", path, order="task_id")
    return spark.read.text(path).select(F.col("value").alias("id"))


@query
def write_summary(spark, folder):
    """A nested summary (K4) and its digest (K5), of counts by split and by source."""
    sec, docs = _table(spark, folder, "sec_bench"), _table(spark, folder, "documents")
    parts = {"sec": {"rows": sec.agg(F.count(F.lit(1)).alias("n")), "splits": sec.groupBy("split").agg(F.count(F.lit(1)).alias("n"))}, "languages": docs.groupBy(F.lower("lang").alias("lang")).agg(F.count(F.lit(1)).alias("n"))}
    out = writers.summary_json(parts)
    flat = [("sec.rows", "", out["sec"]["rows"]["n"]), *(("sec.splits", r["split"], r["n"]) for r in out["sec"]["splits"]), *(("languages", r["lang"], r["n"]) for r in out["languages"])]
    assert json.loads(writers.digest(out, ["sec"], 10_000).removeprefix("sec: ")) == out["sec"]
    return spark.createDataFrame(flat, "part string, name string, n bigint")


@query
def write_table(spark, folder):
    """A table of any size as CSV in as many files as it has parts (K1), read again."""
    path = _folder(spark, "table")
    kept = splits.outside(_table(spark, folder, "swe_rebench_v2"), _table(spark, folder, "overlap_v2_prs").select(F.col("training_instance_id").alias("instance_id")), "instance_id")
    writers.csv_table(kept, path)
    return spark.read.option("header", True).csv(path).select("instance_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_ALL)


def oracle_sql() -> dict[str, str]:
    tail = r"TRY_CAST(nullif(regexp_extract({}, '(\d+)$', 1), '') AS BIGINT)"
    task, mimo = tail.format("task_id"), tail.format("extra_info.instance_id")
    pr = "TRY_CAST(nullif(split_part(instance_id, '-', -1), '') AS BIGINT)"
    squeezed = r"trim(regexp_replace(coalesce(problem_statement, ''), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' ')"
    return {
        "read_security_json": f"SELECT instance_id, split, split_part(instance_id, '.', 1) AS project, CASE WHEN split = 'oss' THEN {tail.format('instance_id')} END AS tracker_id, length(patch) AS patch_chars, length(sanitizer_report) AS report_chars FROM sec_bench WHERE split IN ('oss', 'cve')",
        "read_csv_items": f"SELECT row_id AS pos, instance_id AS id, coalesce(repo, '') AS repo, lower(coalesce(base_commit, '')) AS base, {pr} AS pr, len(string_split({squeezed}, ' ')) AS words FROM swe_rebench_v2",
        "read_multi_language": """SELECT split_part(repo, '/', 1) || '__' || split_part(repo, '/', 2) || '-' || row_id AS id, split_part(repo, '/', 1) || '/' || split_part(repo, '/', 2) AS repo, row_id AS pr, lower(coalesce(base_commit, '')) AS base,
length('A title ' || coalesce(problem_statement, '') || '  x') AS text_chars, length(coalesce(patch, '')) AS patch_chars FROM swe_rebench_v2 WHERE repo LIKE '%/%' AND language IS NOT NULL AND lower(language) <> 'python'""",
        "read_discarded_pulls": "SELECT DISTINCT lower(split_part(benchmark_repo, '/', 1) || '/' || split_part(benchmark_repo, '/', 2)) AS repo, pr FROM overlap_v2_prs WHERE benchmark_repo LIKE '%/%'",
        "read_id_mapping": f"WITH n AS (SELECT DISTINCT {task} AS num FROM cybergym) SELECT num AS old_id, num + 7 AS new_id FROM n WHERE num < 1000000",
        "read_listing_pool": f"SELECT DISTINCT {mimo} AS num FROM mimo_cyber WHERE {mimo} IS NOT NULL UNION SELECT 2",
        "read_project_lookup": f"SELECT {task} AS num, nullif(lower(trim(project_name, ' ')), '') AS project FROM cybergym WHERE {task} IS NOT NULL",
        "read_json_array": "SELECT source, target_share, max_repeats FROM mix_targets",
        "read_bug_records": f"""WITH t AS (SELECT {task} AS num, row_id, nullif(lower(trim(project_name, ' ')), '') AS project FROM cybergym),
n AS (SELECT num, arg_min_null(project, row_id) AS project FROM t WHERE num IS NOT NULL GROUP BY 1)
SELECT num::VARCHAR AS id, CASE WHEN project IS NOT NULL THEN sha1(num::VARCHAR) END AS commits, CASE WHEN project IS NOT NULL THEN 'fn_' || num || ';caller' END AS frames, project IS NOT NULL AS there FROM n""",
        "read_several_parquet": "SELECT row_id, instance_id, 'part' || (row_id % 3) AS shard FROM swe_rebench_v2",
        "late_texts": "SELECT row_id, length(patch) AS patch_chars, length(problem_statement) AS text_chars FROM swe_rebench_v2 WHERE lower(instance_id) IN (SELECT lower(trim(training_instance_id, ' ')) FROM overlap_v2_prs WHERE trim(training_instance_id, ' ') <> '')",
        "united_configs": "WITH m AS (SELECT extra_info.instance_id AS id, row_id, prompt[1].content AS spec, row_number() OVER (PARTITION BY extra_info.instance_id ORDER BY row_id % 2 DESC, row_id) AS nth FROM mimo_cyber) SELECT id, row_id, spec FROM m WHERE nth = 1",
        "write_csv_report": "SELECT sec_id::VARCHAR AS sec_id, array_to_string(list_sort([split, split_part(instance_id, '.', 1)]), ';') AS parts, CASE WHEN patch IS NULL THEN 'True' ELSE 'False' END AS no_patch, nullif(split, 'cve') AS oss FROM sec_bench",
        "write_id_list": "SELECT DISTINCT task_id AS id FROM cybergym WHERE task_id IS NOT NULL",
        "write_summary": "SELECT 'sec.rows' AS part, '' AS name, count(*) AS n FROM sec_bench UNION ALL SELECT 'sec.splits', split, count(*) FROM sec_bench GROUP BY 2 UNION ALL SELECT 'languages', lower(lang), count(*) FROM documents GROUP BY 2",
        "write_table": "SELECT DISTINCT instance_id FROM swe_rebench_v2 WHERE instance_id IS NOT NULL AND instance_id NOT IN (SELECT training_instance_id FROM overlap_v2_prs WHERE training_instance_id IS NOT NULL)",
    }
