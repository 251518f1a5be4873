"""Queries over the test tables, one or more for each operator; ``oracle.py`` has their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsieve.functions import crash, ids, text
from kinsieve.operators import keys, overlap, patches, presence, splits, stats
from kinsieve.plans.lineage import cut
from kinsieve.sources import readers

#: The test tables' new numbering: an old number behind this one.
NEW_IDS = 424_000_000
_ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    _ALL[f.__name__] = f
    return f


class Tables:
    """The test tables in the forms that the operators take."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return readers.table(self.spark, self.folder, name)

    def train(self) -> DataFrame:
        return keys.translate(readers.cyber_tasks(self("mimo_cyber")), "num", self.mapping())

    def bench(self) -> DataFrame:
        return keys.translate(readers.bench_tasks(self("cybergym")), "num", self.mapping())

    def mapping(self) -> DataFrame:
        """Old numbers of either table and their new ones, through the reader's rule for dirty rows."""
        numbers = readers.cyber_tasks(self("mimo_cyber")).select("num").unionByName(readers.bench_tasks(self("cybergym")).select("num"))
        old = numbers.where(ids.is_old_scheme(F.col("num"))).distinct()
        rows = old.select(F.concat(F.lit(" "), F.col("num")).alias("a"), (F.col("num") + NEW_IDS).cast("string").alias("b"), F.col("num").alias("pos"))
        return keys.translation(rows, "a", "b", "pos")

    def swe(self) -> DataFrame:
        return readers.swe_items(self("swe_rebench_v2"), F.lit("train"))

    def swe_bench(self) -> DataFrame:
        """The rows of the training table that are held out as evaluation items, as a benchmark."""
        held = self("eval_items").where("dataset = 'swe_rebench_v2'").select(F.col("source_key").alias("instance_id")).distinct()
        return readers.swe_items(self("swe_rebench_v2").join(held, "instance_id", "left_semi"), F.lit("bench"))

    def swe_pairs(self) -> DataFrame:
        """(a_id, b_id, joins) by row ids, as instance ids repeat."""
        side = lambda rows: rows.withColumn("id", F.col("pos"))
        return keys.multi_key_join(side(self.swe_bench()), side(self.swe()), keys.swe_keys()).where("a_id <> b_id")

    def named_items(self) -> DataFrame:
        """(bench, id, repo, pr, base) of the benchmark items that the pair table names."""
        named = self("overlap_v2_prs").where("benchmark_instance_id is not null")
        return named.select(F.col("benchmark").alias("bench"), F.col("benchmark_instance_id").alias("id"), F.col("benchmark_repo").alias("repo"), "pr", F.lit("").alias("base")).distinct()

    def fixes(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(pairs, blobs of sec_bench, blobs of swe_rebench_v2): rows of the security benchmark and of the training set that change the
        same file of a project, and (key, path, pre, post) of either side, for which each table is read and parsed once."""
        def blobs(table, key, project):
            rows = self(table).select(F.struct(F.col(key), F.lower(project).alias("project")).alias("k"), "patch")
            return cut(patches.patch_blobs(rows, "k", "patch").select("k.*", "path", "pre", "post"))

        a = blobs("sec_bench", "sec_id", ids.project_of(F.col("instance_id")))
        b = blobs("swe_rebench_v2", "row_id", ids.short_repo(F.col("repo")))
        pairs = cut(a.select("sec_id", "project", "path").join(b.select("row_id", "project", "path"), ["project", "path"]).select("sec_id", "row_id").distinct())
        return pairs, a.drop("project"), b.drop("project")


def _gram_query(n: int):
    def run(spark, folder):
        t = Tables(spark, folder)
        return overlap.ngram_matches(t("documents"), "doc_id", "text", t("eval_items").select("item_id", F.col("text").alias("t")), "item_id", "t", n)

    run.__name__ = f"ngram{n}_filter"
    return query(run)


ngram13_filter, ngram8_filter = _gram_query(13), _gram_query(8)


@query
def ngram_flag_by_lang(spark, folder):
    t = Tables(spark, folder)
    flagged = ngram13_filter(spark, folder).select("doc_id").distinct().withColumn("hit", F.lit(True))
    lang = F.coalesce(F.lower("lang"), F.lit("unknown")).alias("lang")
    rows = t("documents").select("doc_id", lang).join(flagged, "doc_id", "left").fillna(False)
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.count_if("hit").alias("flagged"), F.round(F.count_if("hit") / F.count(F.lit(1)), 4).alias("share"))


@query
def ngram_filter_summary(spark, folder):
    t = Tables(spark, folder)
    items = t("eval_items").where("dataset = 'swe_rebench_v2'").select("item_id", "source_key", F.col("text").alias("t"))
    swe = t("swe_rebench_v2").select("row_id", "instance_id", "problem_statement")
    pairs = swe.join(items, swe.instance_id == items.source_key).select("row_id", "item_id")
    found = overlap.ngram_matches(swe, "row_id", "problem_statement", items, "item_id", "t", 13)
    return overlap.filter_summary(found, swe, "row_id", "item_id", pairs)


@query
def report_boilerplate(spark, folder):
    reports = Tables(spark, folder)("cybergym")
    return overlap.boilerplate(reports, "row_id", "error_txt", 13, 3)


@query
def ngram_df_boilerplate(spark, folder):
    t = Tables(spark, folder)
    bench = t("cybergym").select("row_id", "error_txt")
    return overlap.flagged_by_threshold(t("sec_bench"), "sec_id", "sanitizer_report", bench, "row_id", "error_txt", 13, [0, 2, 3, 5])


@query
def ngram_without_boilerplate(spark, folder):
    t = Tables(spark, folder)
    bench = t("cybergym").select("row_id", "error_txt")
    common = overlap.boilerplate(bench, "row_id", "error_txt", 13, 3)
    return overlap.ngram_matches(t("sec_bench"), "sec_id", "sanitizer_report", bench, "row_id", "error_txt", 13, common)


@query
def longest_run_pairs(spark, folder):
    t = Tables(spark, folder)
    items = t("eval_items").select("item_id", F.col("text").alias("t"))
    return overlap.longest_runs(ngram8_filter(spark, folder), t("documents"), items, "doc_id", "item_id", "text", "t")


@query
def run_stats(spark, folder):
    return overlap.run_stats(longest_run_pairs(spark, folder))


@query
def exact_text_duplicates(spark, folder):
    t = Tables(spark, folder)
    items = t("eval_items").select("item_id", "source_key", F.col("text").alias("t"))
    swe = t("swe_rebench_v2").select("row_id", "instance_id", "problem_statement")
    known = swe.join(items, swe.instance_id == items.source_key).select("row_id", "item_id")
    return overlap.equal_texts(swe, items, "row_id", "item_id", "problem_statement", "t", 13, known)


@query
def duplicate_texts(spark, folder):
    docs = Tables(spark, folder)("documents").withColumn("h", F.sha2("text", 256))
    return overlap.duplicate_groups(docs, "h", "doc_id", "source", listed=False).select("first_id", "copies", "identical")


@query
def word_and_run_counts(spark, folder):
    docs = Tables(spark, folder)("documents").select("doc_id", text.words(F.col("text")).alias("w"), text.collapsed(F.col("text")).alias("c"))
    return docs.select("doc_id", F.size("w").alias("words"), F.size(text.ngrams(F.col("w"), 13)).alias("runs13"), F.length("c").alias("collapsed_chars"))


@query
def text_views(spark, folder):
    sec = Tables(spark, folder)("sec_bench")
    return sec.select("sec_id", F.length(text.joined_fields("bug_description", "sanitizer_report")).alias("view_chars"), F.size(text.words(text.joined_fields("bug_description", "bug_report"))).alias("view_words"))


@query
def id_parts(spark, folder):
    swe = Tables(spark, folder)("swe_rebench_v2")
    i = F.col("instance_id")
    return swe.select("row_id", ids.trailing_int(i).alias("trailing"), ids.pr_number(i).alias("pr"), ids.repo_from_id(i).alias("repo_name"), ids.short_repo(F.col("repo")).alias("short"), ids.is_pr_mirror(i).alias("mirror"))


@query
def root_paths(spark, folder):
    """Paths below /root that documents name, and whether they speak of a build step."""
    docs = Tables(spark, folder)("documents")
    return docs.select("doc_id", F.array_join(ids.root_paths(F.coalesce("text", F.lit(""))), ";").alias("paths"), ids.any_step(text.lines(F.col("text")), "diff --git").alias("has_diff"))


@query
def sec_ids(spark, folder):
    rows = readers.security_items(Tables(spark, folder)("sec_bench"))
    return rows.select("sec_id", "project", "tracker_id", (F.size(patches.blob_list(F.col("patch"))) == 0).alias("no_blobs"), (~F.coalesce(F.col("patch").contains("diff --git"), F.lit(False))).alias("no_diff"))


@query
def cyber_tasks(spark, folder):
    rows = Tables(spark, folder).train()
    return rows.select("pos", "id", "num", "bug", "type", "function", "file", F.length("text").alias("text_chars"))


@query
def id_plain_overlap(spark, folder):
    t = Tables(spark, folder)
    return keys.plain_overlap(t.train(), t.bench(), "num")


@query
def id_plain_overlap_arvo(spark, folder):
    t = Tables(spark, folder)
    return t.train().select("num").distinct().join(t.bench().where("kind = 'arvo'").select("num"), "num", "left_semi")


@query
def id_translated_overlap(spark, folder):
    t = Tables(spark, folder)
    found = keys.bug_overlap(t.train(), t.bench())
    return found.select("bug", F.array_join("train_ids", ";").alias("train_ids"), F.array_join("bench_ids", ";").alias("bench_ids"), "match_type")


@query
def mapping_check(spark, folder):
    return splits.is_injective(Tables(spark, folder).mapping())


@query
def outside_pool(spark, folder):
    t = Tables(spark, folder)
    return splits.outside(t.train(), t.bench(), "bug")


@query
def reversed_ids(spark, folder):
    t = Tables(spark, folder)
    back = keys.reversed_translation(t.mapping())
    return keys.translate(t.train().select("pos", "bug"), "bug", back, "old")


@query
def bug_duplicates(spark, folder):
    found = overlap.duplicate_groups(Tables(spark, folder).train(), "bug", "id", "spec")
    return found.select("bug", F.array_join("ids", ";").alias("ids"), "copies", "identical")


@query
def project_strata(spark, folder):
    return _strata(spark, folder)


def _strata(spark, folder) -> DataFrame:
    from kinsieve.plans.audits import _pool

    t = Tables(spark, folder)
    return stats.strata(_pool(t.train(), t.bench()), "project", F.col("in_bench"), F.col("in_train"))


@query
def hypergeom_uniform(spark, folder):
    return stats.uniform_test(_strata(spark, folder)).select("observed", "expected", "sd", "z", "p_at_least")


@query
def hypergeom_stratified(spark, folder):
    return stats.stratified_test(_strata(spark, folder))


def _inclusion_items(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Pull requests of repositories in the training set: those of a benchmark, and those of others as discarded ones."""
    t = Tables(spark, folder)
    have = t.swe().where("repo <> '' and pr is not null").select(F.lower("repo").alias("repo"), "pr").distinct()
    named = t("overlap_v2_prs").where("benchmark_repo is not null and pr is not null").select(F.lower("benchmark_repo").alias("repo"), "pr", (F.col("benchmark") == "SWE-PolyBench").alias("b"))
    pool = named.groupBy("repo", "pr").agg(F.bool_or(F.coalesce("b", F.lit(False))).alias("in_bench"))
    return pool.join(have.select("repo").distinct(), "repo", "left_semi"), have


@query
def inclusion_strata(spark, folder):
    pool, have = _inclusion_items(spark, folder)
    known = keys.in_subset(pool.withColumn("k", F.struct("repo", "pr")), "k", have.withColumn("k", F.struct("repo", "pr")), "there")
    return stats.strata(known, "repo", F.col("there"), F.col("in_bench"))


@query
def inclusion_strata_in_range(spark, folder):
    pool, have = _inclusion_items(spark, folder)
    near = stats.within_range(pool, "repo", "pr", have)
    known = keys.in_subset(near.withColumn("k", F.struct("repo", "pr")), "k", have.withColumn("k", F.struct("repo", "pr")), "there")
    return stats.strata(known, "repo", F.col("there"), F.col("in_bench"))


@query
def inclusion_test(spark, folder):
    return stats.stratified_test(inclusion_strata_in_range(spark, folder))


def _judged(spark, folder) -> DataFrame:
    t = Tables(spark, folder)
    tasks = t.train().withColumn("suspect", crash.names_entry_point(F.col("function")))
    return splits.judged(tasks, "bug", "pos", "suspect", t.bench().where("bug is not null"))


@query
def filtered_split(spark, folder):
    t = Tables(spark, folder)
    tasks = t.train().withColumn("suspect", crash.names_entry_point(F.col("function")))
    return splits.filtered_split(tasks, "bug", "pos", "suspect", t.bench().where("bug is not null")).select("id", "pos", "group_order")


@query
def split_accounting(spark, folder):
    return splits.accounting(_judged(spark, folder))


@query
def split_residual(spark, folder):
    t = Tables(spark, folder)
    return splits.residual_members(filtered_split(spark, folder), "id", t("cyber_overlap"), "mimo_instance_ids")


@query
def multi_key_join(spark, folder):
    return Tables(spark, folder).swe_pairs().select("a_id", "b_id", F.array_join("joins", ";").alias("joins"))


@query
def multi_key_join_benchmarks(spark, folder):
    """All benchmark items that the pair table names against all training rows."""
    t = Tables(spark, folder)
    named = t.named_items()
    keys_ = {k: v for k, v in keys.swe_keys().items() if k != "base_commit_and_pr"}  # the pair table has no base commits
    return keys.multi_key_join(named, t.swe(), keys_, "id", "pos").select("a_id", "b_id", F.array_join("joins", ";").alias("joins"))


@query
def multi_key_counts_by_repo(spark, folder):
    """Pairs of those by join and repository, and how many repositories and items a join has."""
    t = Tables(spark, folder)
    keys_ = {k: v for k, v in keys.swe_keys().items() if k != "base_commit_and_pr"}
    found = keys.multi_key_join(t.named_items(), t.swe(), keys_, "id", "pos").select(F.col("b_id").alias("pos"), "a_id", F.explode("joins").alias("join_name"))
    return found.join(t.swe().select("pos", F.lower("repo").alias("repo")), "pos").groupBy("join_name", "repo").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("a_id").alias("items"))


@query
def multi_key_counts(spark, folder):
    found = Tables(spark, folder).swe_pairs().select("a_id", F.explode("joins").alias("join_name"))
    return found.groupBy("join_name").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("a_id").alias("items"))


def _kinds(spark, folder) -> DataFrame:
    t = Tables(spark, folder)
    rows = t.swe().select(F.col("pos").alias("id"), "pr", "base", "patch")
    pairs = t.swe_pairs()
    blobs = patches.patch_blobs(rows, "id", "patch")
    fixed = patches.fix_relation(pairs, "a_id", "b_id", blobs, blobs, "id", "id")
    side = lambda s: rows.select(F.col("id").alias(f"{s}_id"), F.col("pr").alias(f"{s}_pr"), F.col("base").alias(f"{s}_base"))
    both = fixed.join(side("a"), "a_id").join(side("b"), "b_id")
    return both.withColumn("kind", keys.pair_kind(F.col("joins"), F.col("a_pr"), F.col("b_pr"), F.col("fix"))).withColumn("same_base", keys.same_base(F.col("a_base"), F.col("b_base")))


@query
def pair_kinds(spark, folder):
    found = _kinds(spark, folder)
    return found.groupBy("kind", "fix", "same_base").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(keys.is_overlap(F.col("kind"))).alias("overlaps"))


def _items(spark, folder) -> DataFrame:
    """The benchmarks that the pair table names and the training set as one table of sources."""
    t = Tables(spark, folder)
    return t.named_items().unionByName(t.swe().select("bench", "id", F.nullif("repo", F.lit("")).alias("repo"), "pr", "base")).distinct()


def _source_pairs(spark, folder) -> DataFrame:
    return keys.pairwise_sources(_items(spark, folder), [("Multi-SWE-bench", "SWE-PolyBench")])


@query
def pairwise_source_pairs(spark, folder):
    found = _source_pairs(spark, folder)
    return found.select("a_bench", "a_id", "b_bench", "b_id", F.array_join("joins", ";").alias("joins"))


@query
def items_in_other_sources(spark, folder):
    return presence.in_others(_source_pairs(spark, folder))


@query
def repo_presence(spark, folder):
    t = Tables(spark, folder)
    return presence.presence(t("overlap_v2_prs"), "benchmark", "benchmark_repo", t("swe_rebench_v2"), "repo")


@query
def presence_matrix(spark, folder):
    return presence.matrix(Tables(spark, folder)("overlap_v2_prs"), "benchmark", "benchmark_repo")


@query
def shared_repo_detail(spark, folder):
    items = _items(spark, folder).select("bench", "id", "repo")
    return presence.repo_detail(items, "bench", "repo")


@query
def shared_repo_pulls(spark, folder):
    """The same with the pairs of the same pull request in each repository."""
    items = _items(spark, folder)
    repos = items.select(F.col("bench").alias("a_bench"), F.col("id").alias("a_id"), F.col("repo")).where("repo is not null").distinct()
    pairs = _source_pairs(spark, folder).where(F.array_contains("joins", "case_insensitive_repo_pr")).join(repos, ["a_bench", "a_id"])
    named = pairs.select("a_bench", "a_id", "b_bench", "b_id", F.lower("repo").alias("repo")).distinct()
    return presence.repo_detail_with_pairs(items.select("bench", "id", "repo"), "bench", "repo", named)


@query
def control_pulls(spark, folder):
    """A control set's pull requests in the benchmarks: the training table against all named items but one benchmark's."""
    t = Tables(spark, folder)
    control = t.swe().select(F.col("pos").alias("id"), "repo", "pr", "base")
    return presence.control_pulls(control, t.named_items(), without="Multi-SWE-bench")


@query
def base_presence(spark, folder):
    """Rows of each language that start from a base commit which the held-out rows have."""
    t = Tables(spark, folder)
    rows = t.swe().select(F.lower("language").alias("bench"), "base")
    return presence.base_presence(t.swe_bench(), rows)


@query
def sanitizer_pairs(spark, folder):
    """Reports of one project in two benchmarks, by the sanitizers that they name."""
    t = Tables(spark, folder)
    sec = t("sec_bench").select(F.lower(ids.project_of(F.col("instance_id"))).alias("project"), crash.sanitizer(F.coalesce("sanitizer_report", F.lit(""))).alias("s"))
    cyber = t("cybergym").select(F.lower(F.trim("project_name")).alias("project"), crash.sanitizer(F.coalesce("error_txt", F.lit(""))).alias("s"))
    return presence.versus_counts(sec, cyber, "project", "s", ("sec_bench", "cybergym"))


@query
def instance_id_lists(spark, folder):
    """For each instance of the security benchmark the benchmark tasks of its own number and of its bug."""
    t = Tables(spark, folder)
    sec = readers.security_items(t("sec_bench")).select("sec_id", "tracker_id")
    found = keys.id_lists(sec, "sec_id", "tracker_id", t.bench(), t.mapping())
    return found.select("sec_id", F.array_join("plain_ids", ";").alias("plain_ids"), F.array_join("translated_ids", ";").alias("translated_ids"))


@query
def longest_run_by_bug(spark, folder):
    """The longest run that a benchmark task's description shares with any training task of the same bug."""
    t = Tables(spark, folder)
    train = t.train().where("bug is not null").select(F.col("pos").alias("train_pos"), "bug", "text")
    bench = t.bench().where("bug is not null").select(F.col("pos").alias("bench_pos"), "bug", "description")
    pairs = train.select("train_pos", "bug").join(bench.select("bench_pos", "bug"), "bug")
    runs = overlap.longest_runs(pairs, train, bench, "train_pos", "bench_pos", "text", "description")
    return overlap.longest_in_group(runs, "bench_pos")


def _aliases(spark, folder) -> DataFrame:
    sure = Tables(spark, folder)("overlap_v2_prs").where("joins like '%base_commit_and_pr%'")
    return keys.renames(sure, "training_repo", "benchmark_repo", "pair_id")


@query
def repo_renames(spark, folder):
    return _aliases(spark, folder)


@query
def renamed_presence(spark, folder):
    t = Tables(spark, folder)
    names = keys.renamed(t("swe_rebench_v2").where("repo is not null"), "repo", _aliases(spark, folder))
    return presence.presence(t("overlap_v2_prs"), "benchmark", "benchmark_repo", names, "known_name")


@query
def mirror_counts(spark, folder):
    t = Tables(spark, folder)
    shared = t("overlap_v2_prs").select(F.lower("benchmark_repo").alias("repo"))
    return presence.mirrors(t("swe_rebench_v2"), "instance_id", shared)


@query
def distinct_repos(spark, folder):
    t = Tables(spark, folder)
    return readers.distinct_repos([t("swe_rebench_v2"), t("overlap_v2_prs").select(F.col("benchmark_repo").alias("repo"))])


@query
def first_rows(spark, folder):
    return keys.first_by(Tables(spark, folder)("swe_rebench_v2"), "instance_id", "row_id").select("instance_id", "row_id", "repo")


@query
def project_lookup(spark, folder):
    t = Tables(spark, folder)
    rows = t("cyber_overlap").select("pair_id", F.col("cybergym_task_id").alias("id"))
    first = t("cybergym").groupBy(F.col("task_id").alias("id")).agg(F.min_by("project_name", "row_id").alias("project"))
    second = t("cyber_overlap").groupBy(F.col("cybergym_task_id").alias("id")).agg(F.min_by("cybergym_project", "pair_id").alias("project"))
    return keys.known_project(rows, "id", first.where("id is not null"), second.where("id is not null")).select("pair_id", "project")


@query
def patch_blobs(spark, folder):
    return patches.patch_blobs(Tables(spark, folder)("sec_bench"), "sec_id", "patch")


@query
def changed_lines(spark, folder):
    found = patches.changed_lines(Tables(spark, folder)("sec_bench"), "sec_id", "patch")
    return found.select("sec_id", "path", F.array_join("removed", "\n").alias("removed"), F.array_join("added", "\n").alias("added"))


@query
def same_fix(spark, folder):
    t = Tables(spark, folder)
    a = cut(patches.patch_blobs(t("sec_bench"), "sec_id", "patch"))
    b = cut(patches.patch_blobs(t("swe_rebench_v2"), "row_id", "patch"))
    return patches.same_fix_pairs(a, b, "sec_id", "row_id").select(F.col("a_id").alias("sec_id"), F.col("b_id").alias("row_id"))


@query
def same_fix_in_project(spark, folder):
    """The same among patches of one project."""
    t = Tables(spark, folder)

    def scoped(table, key, project):
        rows = t(table).select(F.struct(F.col(key), F.lower(project).alias("project")).alias("k"), "patch")
        return cut(patches.patch_blobs(rows, "k", "patch").select("k.*", "path", "pre", "post"))

    a, b = scoped("sec_bench", "sec_id", ids.project_of(F.col("instance_id"))), scoped("swe_rebench_v2", "row_id", ids.short_repo(F.col("repo")))
    return patches.same_fix_pairs(a, b, "sec_id", "row_id", scope="project").select(F.col("a_id").alias("sec_id"), F.col("b_id").alias("row_id"))


@query
def fix_relations(spark, folder):
    t = Tables(spark, folder)
    pairs, ba, bb = t.fixes()
    # lines are made of the paired patches alone
    lines = lambda table, key: cut(patches.changed_line_rows(t(table).select(key, "patch").join(pairs.select(key).distinct(), key, "left_semi"), key, "patch"))
    ra, rb = lines("sec_bench", "sec_id"), lines("swe_rebench_v2", "row_id")
    la, lb = patches.sorted_lines(ra, "sec_id"), patches.sorted_lines(rb, "row_id")
    out = patches.fix_relation(pairs, "sec_id", "row_id", ba, bb, "sec_id", "row_id")
    out = patches.strict_blob_test(out, "sec_id", "row_id", ba, bb, "sec_id", "row_id")
    out = patches.lines_relation(out, "sec_id", "row_id", la, lb, "sec_id", "row_id")
    out = patches.lines_contained(out, "sec_id", "row_id", ra, rb, "sec_id", "row_id")
    return patches.same_files(out, "sec_id", "row_id", ra, rb, "sec_id", "row_id")


@query
def no_fix_reasons(spark, folder):
    pairs, ba, bb = Tables(spark, folder).fixes()
    counted = patches.shared_blobs(pairs, "sec_id", "row_id", ba, bb, "sec_id", "row_id")
    fixed = patches.same_fix_pairs(ba, bb, "sec_id", "row_id").select(F.col("a_id").alias("sec_id"), F.col("b_id").alias("row_id"))
    size = lambda rows, k: rows.groupBy(k).agg(F.count(F.lit(1)).alias(f"n_{k}"))
    open_ = counted.join(fixed, ["sec_id", "row_id"], "left_anti").join(size(ba, "sec_id"), "sec_id", "left").join(size(bb, "row_id"), "row_id", "left").fillna(0)
    reason = keys.no_fix_reason(F.lit(True), F.col("n_row_id"), F.col("n_sec_id"), F.col("shared"))
    return presence.category_counts(open_, reason, "reason")


def _parsed_reports(rows: DataFrame, key: str, report: str) -> DataFrame:
    return crash.with_report(rows.select(key, report), report).select(key, "crash_type", "sanitizer", F.size("stack").alias("frames"), "top_frame")


@query
def crash_reports(spark, folder):
    return _parsed_reports(Tables(spark, folder)("cybergym"), "row_id", "error_txt")


@query
def crash_reports_sec(spark, folder):
    return _parsed_reports(Tables(spark, folder)("sec_bench"), "sec_id", "sanitizer_report")


def _reports_by_project(spark, folder) -> tuple[DataFrame, DataFrame]:
    t = Tables(spark, folder)
    sec = t("sec_bench").select("sec_id", F.lower(ids.project_of(F.col("instance_id"))).alias("project"), "sanitizer_report")
    a = crash.with_report(sec, "sanitizer_report").select("sec_id", "project", F.lower("crash_type").alias("a_type"), F.col("top_frame").alias("a_frame"))
    cyber = t("cybergym").select("row_id", F.lower(F.trim("project_name")).alias("project"), "error_txt")
    b = crash.with_report(cyber, "error_txt").select("row_id", "project", F.lower("crash_type").alias("b_type"), F.col("top_frame").alias("b_frame"))
    return a, b


@query
def crash_grades(spark, folder):
    """Grades of all pairs of reports of one project in two benchmarks."""
    a, b = _reports_by_project(spark, folder)
    kinds = lambda rows, s: rows.select("project", F.col(f"{s}_type").alias("t"), F.col(f"{s}_frame").alias("f"))
    return presence.graded_counts(kinds(a, "a"), kinds(b, "b"), "project", "t", "f")


@query
def control_cross_pairs(spark, folder):
    """Negative control: grades of different reports of one project."""
    _, b = _reports_by_project(spark, folder)
    return presence.graded_counts(b.select("project", F.col("b_type").alias("t"), F.col("b_frame").alias("f")), None, "project", "t", "f")


@query
def control_rates(spark, folder):
    counts = control_cross_pairs(spark, folder)
    hit = F.sum(F.when(F.col("grade") == "type_and_frame", F.col("pairs")).otherwise(0))
    return counts.agg(hit.alias("hits"), F.sum("pairs").alias("pairs")).select("hits", "pairs", stats.control_rate(F.col("hits"), F.col("pairs")).alias("rate"), text.ratio_label(F.col("hits"), F.col("pairs")).alias("label"))


@query
def control_cross_matched(spark, folder):
    t = Tables(spark, folder)
    sec = t("sec_bench").select("sec_id", F.lower(ids.project_of(F.col("instance_id"))).alias("project"))
    return presence.cross_matched(same_fix(spark, folder).join(sec, "sec_id"), "project", "sec_id", "row_id").select("sec_id", "row_id")


@query
def spec_grades(spark, folder):
    t = Tables(spark, folder)
    reports = t.bench().where("bug is not null").groupBy("bug").agg(F.min_by("report", "pos").alias("report"))
    reports = crash.with_report(reports, "report").select("bug", F.col("stack").alias("frames"), F.col("crash_type").alias("report_type"))
    graded = t.train().join(reports, "bug").withColumn("grade", crash.spec_grade(F.col("function"), F.col("type"), F.col("file"), F.col("frames"), F.col("report_type")))
    return graded.groupBy("bug").agg(F.min_by("grade", crash.grade_rank(F.col("grade"))).alias("best_grade"))


@query
def description_names_function(spark, folder):
    t = Tables(spark, folder)
    bare = F.nullif(crash.bare_function_name(F.col("function")), F.lit(""))
    names = t.train().where("bug is not null").groupBy("bug").agg(F.collect_set(bare).alias("names"))
    found = t.bench().join(names, "bug").select("pos", overlap.names_any(F.coalesce("description", F.lit("")), F.col("names")).alias("named"))
    return found


def _related_sides(spark, folder) -> tuple[DataFrame, DataFrame]:
    """(id, commits, signature) of the reports of both benchmarks."""
    t = Tables(spark, folder)
    x, y = _reports_by_project(spark, folder)

    def sign(kind: str, frame: str) -> Column:
        return F.when(F.col(frame) != "", F.struct("project", F.col(kind).alias("type"), F.array(frame).alias("frames"))).alias("signature")

    sec = t("sec_bench").select("sec_id", crash.fix_commits(F.concat_ws(" ", "patch", "bug_report")).alias("commits"))
    cyber = t("cybergym").select("row_id", crash.fix_commits(F.col("vulnerability_description")).alias("commits"))
    a = x.join(sec, "sec_id").select(F.col("sec_id").alias("id"), "commits", sign("a_type", "a_frame"))
    b = y.join(cyber, "row_id").select(F.col("row_id").alias("id"), "commits", sign("b_type", "b_frame"))
    return a, b


@query
def related_bugs(spark, folder):
    return keys.related(*_related_sides(spark, folder))


@query
def signature_frequencies(spark, folder):
    """How many records of either benchmark carry each crash signature."""
    found = keys.signature_counts(*_related_sides(spark, folder))
    return found.select("signature.project", "signature.type", F.array_join("signature.frames", ";").alias("frames"), "records")


@query
def related_by_evidence(spark, folder):
    a, b = (cut(x) for x in _related_sides(spark, folder))
    return keys.related_evidence(keys.with_records(keys.related(a, b), a, keys.signature_counts(a, b)), "train_id")


@query
def build_categories(spark, folder):
    t = Tables(spark, folder)
    kinds = t.bench().where("num is not null").groupBy("num").agg(F.min("kind").alias("bench_kind"))
    bugs = t.bench().where("bug is not null").select("bug").distinct().withColumn("in_bench", F.lit(True))
    rows = t.train().join(kinds, "num", "left").join(bugs, "bug", "left").withColumn("in_bench", F.coalesce("in_bench", F.lit(False)))
    category = ids.build_category(F.col("num"), F.col("bench_kind"), F.col("in_bench"))
    return presence.pivot_flags(rows.withColumn("category", category), "category", crash.names_entry_point(F.col("function")))


@query
def id_match_counts(spark, folder):
    t = Tables(spark, folder)
    plain = keys.plain_overlap(t.train(), t.bench(), "num").withColumn("plain", F.lit(True))
    bugs = keys.bug_overlap(t.train(), t.bench()).select("bug").withColumn("by_bug", F.lit(True))
    rows = t.train().join(plain, "num", "left").join(bugs, "bug", "left").fillna(False, ["plain", "by_bug"])
    return presence.category_counts(rows, keys.id_match(F.col("plain"), F.col("by_bug")), "id_match")


@query
def patch_paths(spark, folder):
    """Paths of patches: those below a project's source folder, and those that look like a proof of concept."""
    rows = patches.changed_line_rows(Tables(spark, folder)("sec_bench"), "sec_id", "patch").select("sec_id", "path").distinct()
    return rows.select("sec_id", "path", ids.source_path(F.col("path")).alias("source_path"), ids.is_poc_path(F.col("path")).alias("poc"))


@query
def data_contexts(spark, folder):
    rows = patches.changed_line_rows(Tables(spark, folder)("sec_bench"), "sec_id", "patch").groupBy("sec_id").agg(F.collect_set(F.concat(F.lit("data/"), F.col("path"))).alias("paths"))
    return rows.select("sec_id", F.array_join(ids.data_context(F.col("paths")), ";").alias("context"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from kinsieve import filequeries, rulequeries

    return {**_ALL, **rulequeries.queries(), **filequeries.queries()}


def oracle_sql() -> dict[str, str]:
    from kinsieve import filequeries, rulequeries
    from kinsieve.oracle import SQL

    tests = {"hypergeom_stratified": rulequeries.stratified_sql(SQL["project_strata"]), "inclusion_test": rulequeries.stratified_sql(SQL["inclusion_strata_in_range"])}
    return {**SQL, **tests, **rulequeries.oracle_sql(), **filequeries.oracle_sql()}
