"""Readers with explicit schemas for the inputs of the audits. Network steps are out of scope: files are fetched beforehand.

Every reader that the order of rows matters for takes or makes an ordinal; nothing relies on the order of a DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsieve.functions import crash, ids
from kinsieve.operators.keys import first_by, translation

_SECURITY = "instance_id string, patch string, bug_description string, sanitizer_report string, bug_report string"
_MULTI = "org string, repo string, number bigint, base struct<sha:string>, resolved_issues array<struct<title:string,body:string>>, fix_patch string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parquet_columns(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Some columns of several Parquet files; only these are read."""
    return spark.read.parquet(*sorted(paths)).select(*columns)


def located_columns(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Key columns of several Parquet files with ``__file``, where each row lies: for a first pass that leaves wide texts unread."""
    return spark.read.parquet(*sorted(paths)).select(*columns, F.col("_metadata.file_path").alias("__file"))


def late(found: DataFrame, rows: DataFrame, key: str, wide: Sequence[str]) -> DataFrame:
    """(key, wide...) of the rows whose key is in ``found``: the second pass, which makes wide texts of matched rows alone.

    The keys are shuffled or broadcast as their size says; a repeated key in ``found`` gives its rows once, a null one none.
    """
    return rows.select(key, *wide).join(found.select(key).distinct(), key, "left_semi")


def with_optional(wanted: DataFrame, read: DataFrame, key: str) -> DataFrame:
    """``wanted`` keys with what was read of them, and ``there``; a key without a file has nulls."""
    return wanted.join(read.withColumn("there", F.lit(True)), key, "left").withColumn("there", F.coalesce("there", F.lit(False)))


def cyber_tasks(rows: DataFrame, order: str = "row_id") -> DataFrame:
    """(id, num, spec, type, function, file, text, pos) of training tasks: nested columns, and JSON in a string.

    An empty or null prompt gives a null spec; the text is the JSON's problem statement, or the spec where that is null or empty.
    """
    spec = F.try_element_at("prompt", F.lit(1))["content"]
    stated = F.get_json_object("extra_info.instance_json", "$.problem_statement")
    found = rows.select(F.col("extra_info.instance_id").alias("id"), spec.alias("spec"), F.coalesce(F.nullif(stated, F.lit("")), spec).alias("text"), F.col(order).alias("pos"))
    parts = crash.spec_parts(F.col("spec"))
    return found.select("id", ids.trailing_int(F.col("id")).alias("num"), "spec", parts["type"].alias("type"), parts["function"].alias("function"), parts["file"].alias("file"), "text", "pos")


def bench_tasks(rows: DataFrame, order: str = "row_id") -> DataFrame:
    """(id, kind, num, project, description, report, pos) of benchmark tasks named ``kind:number``."""
    return rows.select(
        F.col("task_id").alias("id"), ids.id_kind(F.col("task_id")).alias("kind"), ids.trailing_int(F.col("task_id")).alias("num"),
        F.nullif(F.lower(F.trim("project_name")), F.lit("")).alias("project"), F.col("vulnerability_description").alias("description"), F.col("error_txt").alias("report"), F.col(order).alias("pos"),
    )


def security_items(rows: DataFrame) -> DataFrame:
    """Rows of a security benchmark with their project and, for the split whose numbers are ids of the tracker, that number."""
    return rows.withColumn("project", ids.project_of(F.col("instance_id"))).withColumn("tracker_id", ids.split_int(F.col("split"), F.col("instance_id")))


def security_json(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """The same from one JSON-lines file per split."""
    parts = [spark.read.schema(_SECURITY).json(path).withColumn("split", F.lit(split)) for split, path in sorted(files.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return security_items(out)


def swe_items(rows: DataFrame, bench: Column, pr: Column | None = None, order: str = "row_id") -> DataFrame:
    """(bench, id, repo, pr, base, text, patch, language, pos): nulls as '', base commits in lower case, pr null where unknown."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
    return rows.select(
        bench.alias("bench"), F.col("instance_id").alias("id"), text("repo").alias("repo"), (ids.pr_number(F.col("instance_id")) if pr is None else pr).alias("pr"),
        F.lower(text("base_commit")).alias("base"), text("problem_statement").alias("text"), text("patch").alias("patch"), text("language").alias("language"), F.col(order).alias("pos"),
    )


def csv_items(spark: SparkSession, path: str) -> DataFrame:
    """A benchmark in CSV with quoted fields over several lines; pull numbers may be written as floats."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1)
    return rows.withColumn("pull_number", ids.float_text_int(F.col("pull_number")))


def multi_language_items(spark: SparkSession, paths: Sequence[str], exclude: str | None = None) -> DataFrame:
    """(id, repo, pr, base, text, patch) from JSON lines per repository; files whose path holds ``exclude`` are left out.

    The text joins title and body of all issues; a null one keeps its blank.
    """
    rows = spark.read.schema(_MULTI).json(list(paths)).withColumn("__path", F.col("_metadata.file_path"))
    if exclude:
        rows = rows.where(~F.col("__path").contains(exclude))
    issue = lambda i: F.concat_ws(" ", F.coalesce(i["title"], F.lit("")), F.coalesce(i["body"], F.lit("")))
    name = F.concat_ws("/", "org", "repo")
    return rows.select(F.concat(F.col("org"), F.lit("__"), F.col("repo"), F.lit("-"), F.col("number")).alias("id"), name.alias("repo"), F.col("number").alias("pr"), F.lower(F.coalesce("base.sha", F.lit(""))).alias("base"), F.array_join(F.transform("resolved_issues", issue), " ").alias("text"), F.coalesce("fix_patch", F.lit("")).alias("patch"))


def discarded_pulls(spark: SparkSession, path: str) -> DataFrame:
    """(repo, pr), distinct, of pull requests that a pipeline collected and dropped."""
    return spark.read.schema("org string, repo string, number bigint").json(path).select(F.lower(F.concat_ws("/", "org", "repo")).alias("repo"), F.col("number").alias("pr")).distinct()


def id_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(old_id, new_id) from a CSV whose header, if any, isn't digits; the last line of an old id counts.

    The ordinal is the place in the file, which holds as one file of an id mapping is read by one task.
    """
    rows = spark.read.schema("a string, b string").csv(path).withColumn("pos", F.monotonically_increasing_id())
    return translation(rows, "a", "b", "pos")


def listing_pool(spark: SparkSession, path: str) -> DataFrame:
    """(num): the distinct trailing numbers of the file names in a JSON tree listing. A truncated listing fails."""
    rows = spark.read.schema("truncated boolean, tree array<struct<path:string>>").json(path, multiLine=True)
    checked = rows.where(F.when(F.col("truncated"), F.raise_error(F.lit("the listing is truncated"))).otherwise(F.lit(True)))
    stem = F.regexp_replace(F.substring_index(F.col("p.path"), "/", -1), r"\.[^.]*$", "")
    return checked.select(F.explode("tree").alias("p")).where(F.col("p.path").rlike(r"\d")).select(ids.trailing_int(stem).alias("num")).where("num is not null").distinct()


def project_lookup(spark: SparkSession, path: str) -> DataFrame:
    """(num, project) from JSON lines; blank lines are skipped."""
    return spark.read.schema("localId string, project string").json(path).select(F.col("localId").try_cast("bigint").alias("num"), "project").where("num is not null")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of one JSON array document."""
    return spark.read.schema(schema).json(path, multiLine=True)


def text_files(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(id, text) of files ``folder/<id>/<name>``: whole texts, undecodable bytes replaced; a missing file has no row."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(folder)
    return rows.select(F.regexp_extract(F.col("path"), "([^/]+)/[^/]+$", 1).alias("id"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def bug_records(spark: SparkSession, folder: str) -> DataFrame:
    """(id, commits, signature) of per-bug JSON files ``folder/<id>.json``; fix entries of any form are read as raw text."""
    return parsed_records(spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("id"), "value"))


def parsed_records(rows: DataFrame) -> DataFrame:
    """(id, commits, signature) of per-bug JSON texts (id, value)."""
    get = lambda p: F.get_json_object("value", p)
    return rows.select("id", crash.fix_commits(F.coalesce(F.nullif(get("$.fix_commit"), F.lit("")), get("$.fix"))).alias("commits"), crash.crash_signature(get("$.project"), get("$.crash_type"), get("$.report.comments[0].content")).alias("signature"))


def distinct_repos(rows: Sequence[DataFrame], repo: str = "repo") -> DataFrame:
    out = rows[0].select(F.lower(repo).alias("repo"))
    for r in rows[1:]:
        out = out.unionByName(r.select(F.lower(repo).alias("repo")))
    return out.where("repo is not null").distinct()


def united(parts: Sequence[DataFrame], key: str, order: str) -> DataFrame:
    """Several configurations of one source, by key: the earlier part and then the lower ordinal counts."""
    tagged = [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p)
    return first_by(out.withColumn("__order", F.struct("__part", order)), key, "__order").drop("__part", "__order")


def manifest(spark: SparkSession, revisions: dict[str, str | None]) -> DataFrame:
    """(source, revision): what an audit has read; a source without a pinned revision has null."""
    return spark.createDataFrame(sorted(revisions.items()), "source string, revision string")
