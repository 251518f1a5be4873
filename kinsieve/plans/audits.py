"""Whole audits: named sections, each a lazy DataFrame built from operators. Sections that aren't wanted are None."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsieve.functions.crash import grade_rank, names_entry_point, spec_grade, with_report
from kinsieve.operators import keys, overlap, patches, presence, splits, stats
from kinsieve.plans.lineage import cut, written


def sections(wanted: dict[str, bool], builders: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame | None]:
    return {name: build() if wanted.get(name, True) else None for name, build in builders.items()}


def bug_audit(train: DataFrame, bench: DataFrame, mapping: DataFrame, texts: bool = True, crashes: bool = True) -> dict[str, DataFrame | None]:
    """Training tasks against benchmark tasks that record the same bugs: overlap, baselines, crash check, text check, split.

    ``train`` and ``bench`` come from the readers; ``mapping`` (old_id, new_id) translates numbers.
    """
    train = written(keys.translate(train, "num", mapping))
    bench = written(keys.translate(bench, "num", mapping))
    shared = cut(keys.bug_overlap(train, bench))

    def crash():
        reports = bench.where("bug is not null").groupBy("bug").agg(F.min_by("report", "pos").alias("report"))
        parsed = with_report(reports, "report").select("bug", F.col("stack").alias("frames"), F.col("crash_type").alias("report_type"))
        graded = train.join(parsed, "bug").withColumn("grade", spec_grade(F.col("function"), F.col("type"), F.col("file"), F.col("frames"), F.col("report_type")))
        return graded.groupBy("bug").agg(F.min_by("grade", grade_rank(F.col("grade"))).alias("grade")).groupBy("grade").count()

    return sections(
        {"crash": crashes, "text": texts},
        {
            "overlap": lambda: shared,
            "duplicates": lambda: overlap.duplicate_groups(train, "bug", "id", "spec"),
            "strata": lambda: stats.strata(_pool(train, bench), "project", F.col("in_bench"), F.col("in_train")),
            "crash": crash,
            "text": lambda: overlap.ngram_matches(train, "id", "text", bench.select(F.col("id").alias("bench_id"), "description"), "bench_id", "description", 8),
            "split": lambda: splits.filtered_split(train.withColumn("suspect", names_entry_point(F.col("function"))), "bug", "pos", "suspect", shared),
        },
    )


def _pool(train: DataFrame, bench: DataFrame) -> DataFrame:
    """(bug, project, in_bench, in_train) over all bugs that either side has."""
    b = bench.where("bug is not null").groupBy("bug").agg(F.min("project").alias("project")).withColumn("in_bench", F.lit(True))
    t = train.where("bug is not null").select("bug").distinct().withColumn("in_train", F.lit(True))
    return b.join(t, "bug", "full").select("bug", F.coalesce("project", F.lit("unknown")).alias("project"), F.coalesce("in_bench", F.lit(False)).alias("in_bench"), F.coalesce("in_train", F.lit(False)).alias("in_train"))


def repository_audit(train: DataFrame, bench: DataFrame, require_base: bool = True) -> dict[str, DataFrame | None]:
    """Training items against benchmark items of pull requests, both from ``swe_items``: pairs, fixes, text filter, presence."""
    pairs = cut(keys.multi_key_join(bench, train, keys.swe_keys(require_base)))
    blobs = lambda rows: patches.patch_blobs(keys.first_by(rows, "id", "pos"), "id", "patch")
    return {
        "pairs": pairs,
        "fixes": patches.fix_relation(pairs, "a_id", "b_id", blobs(bench), blobs(train), "id", "id"),
        "text": overlap.ngram_matches(train.select(F.col("id").alias("b_id"), "text"), "b_id", "text", bench.select(F.col("id").alias("a_id"), F.col("text").alias("bench_text")), "a_id", "bench_text", 13),
        "presence": presence.presence(bench, "bench", "repo", train, "repo"),
    }
