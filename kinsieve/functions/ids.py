"""Keys from messy ids. A text without the wanted part gives null instead of an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("bigint")


def trailing_int(text: Column) -> Column:
    """The digits at the very end of an id."""
    return _number(F.regexp_extract(text, r"(?d)(\d+)\z", 1))


def pr_number(instance_id: Column) -> Column:
    """The number after the last hyphen."""
    return _number(F.substring_index(instance_id, "-", -1))


def float_text_int(text: Column) -> Column:
    """A whole number that a CSV holds as text like ``123.0``."""
    return F.nullif(text, F.lit("")).try_cast("double").cast("bigint")


def id_kind(task_id: Column) -> Column:
    return F.split_part(task_id, F.lit(":"), F.lit(1))


def project_of(instance_id: Column) -> Column:
    return F.split_part(instance_id, F.lit("."), F.lit(1))


def split_int(split: Column, instance_id: Column, wanted: str = "oss") -> Column:
    """The trailing number, for rows of the split whose numbers are ids of the tracker."""
    return F.when(split == wanted, trailing_int(instance_id))


def repo_from_id(instance_id: Column) -> Column:
    """``Owner__repo.rest`` as ``owner/repo``: only the first double underscore stands for a slash."""
    return F.lower(F.regexp_replace(project_of(instance_id), "(?s)^(.*?)__", "$1/"))


def short_repo(repo: Column) -> Column:
    return F.substring_index(repo, "/", -1)


def is_pr_mirror(instance_id: Column) -> Column:
    return instance_id.rlike(r"\.pr_\d+$")


def is_old_scheme(number: Column) -> Column:
    """Ids below a million are of the older numbering."""
    return number < 1_000_000


def source_path(path: Column) -> Column:
    """The part of a path below ``src-fix/<project>/``."""
    return F.regexp_replace(path, "^.*?/src-fix/[^/]+/", "")


def build_category(number: Column, bench_kind: Column, in_bench: Column) -> Column:
    """Why a task's image is what it is; ``bench_kind`` is the kind of the benchmark task of the same number, or null."""
    return (
        F.when(bench_kind.isNotNull(), F.concat(F.lit("same ID as a benchmark "), bench_kind, F.lit(": task")))
        .when(in_bench, "same bug under the other ID")
        .when(is_old_scheme(number), "not in benchmark, old ID")
        .otherwise("not in benchmark, new ID")
    )


def is_poc_path(path: Column) -> Column:
    """A base name that speaks of a proof of concept."""
    return path.rlike("(?i)(^|/)[^/]*(poc|crash|testcase|repro|exploit)[^/]*$")


def data_context(paths: Column) -> Column:
    """The distinct first two parts of the paths below data/, sorted."""
    inside = F.filter(paths, lambda p: p.startswith("data/"))
    return F.array_sort(F.array_distinct(F.transform(inside, lambda p: F.substring_index(p, "/", 2))))


def root_paths(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"/root/[\w.-]+"), F.lit(0))))


def any_step(steps: Column, wanted: str) -> Column:
    """Whether a build step mentions a text; false for null steps."""
    return F.coalesce(F.exists(steps, lambda s: s.contains(wanted)), F.lit(False))
