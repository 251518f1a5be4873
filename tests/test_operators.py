from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinsieve.operators import keys, overlap, patches, presence, splits, stats

P1 = """diff --git a/x.c b/x.c
index 1111111..2222222 100644
--- a/x.c
+++ b/x.c
@@ -1 +1 @@
-old
+new

diff --git a/r.c b/r2.c
similarity index 100%
rename from r.c
diff --git a/q.sql b/q.sql
index 3333333..4444444
--- a comment
-drop
+keep
"""
P2 = "diff --git a/m.c b/m.c\nold mode 100644\ndiff --git a/a b.c b/a b.c\nindex 5555555..6666666\n"


def test_translation_last_row_wins(spark):
    rows = spark.createDataFrame([("old", "new", 0), (" 10", "1000 ", 1), ("11", "1001", 2), ("11", "1002", 3), ("x", "5", 4), (None, "1", 5)], "a string, b string, pos int")
    mapping = keys.translation(rows, "a", "b", "pos")
    numbers = spark.createDataFrame([(10,), (11,), (1000,), (7,), (None,)], "num long")
    got = {r.num: r.bug for r in keys.translate(numbers, "num", mapping).collect()}
    assert got == {10: 1000, 11: 1002, 1000: 1000, 7: 7, None: None}


def test_multi_key_join_provenance_and_nulls(spark):
    items = "id string, repo string, pr long, base string"
    a = spark.createDataFrame([("a1", "X/y", 1, "c1"), ("a2", "x/y", None, ""), ("a3", "p/q", 2, "")], items)
    b = spark.createDataFrame([("b1", "x/y", 1, "c1"), ("b2", "x/y", None, ""), ("b3", "other", 2, "")], items)
    got = {(r.a_id, r.b_id): r.joins for r in keys.multi_key_join(a, b, keys.swe_keys()).collect()}
    assert got == {("a1", "b1"): ["base_commit_and_pr", "case_insensitive_repo"]}
    loose = {(r.a_id, r.b_id) for r in keys.multi_key_join(a, b, keys.swe_keys(require_base=False)).collect()}
    assert loose == {("a1", "b1"), ("a3", "b3")}
    assert keys.multi_key_join(a.limit(0), b, keys.swe_keys()).count() == 0


def test_pair_kinds(spark):
    want = [
        (["base_commit_and_pr"], 1, 1, "different", "same PR, same base commit"), (["case_insensitive_repo_pr"], 1, 1, "identical", "same PR, different base commit, identical fix"),
        (["case_insensitive_repo_pr"], 1, 1, "different", "same PR, different base commit, fix different"), (["base_commit"], None, 1, "identical", "same base commit and identical fix (no PR number)"),
        (["base_commit"], None, 1, "different", "same base commit, fix not identical (no PR number)"), (["base_commit"], 1, 2, "identical", "same base commit, different PR"),
    ]
    df = spark.createDataFrame(want, "j array<string>, a int, b int, fix string, want string")
    rows = df.withColumn("got", keys.pair_kind(F.col("j"), F.col("a"), F.col("b"), F.col("fix"))).withColumn("o", keys.is_overlap(F.col("got"))).collect()
    assert all(r.got == r.want for r in rows) and [r.o for r in rows] == [True, True, True, True, False, False]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, patch string")


def test_patch_blobs(spark):
    rows = patches.patch_blobs(frame(spark, [("1", P1), ("2", P2), ("3", None), ("4", "")]), "id", "patch").collect()
    assert {(r.id, r.path, r.pre, r.post) for r in rows} == {("1", "x.c", "1111111", "2222222"), ("1", "q.sql", "3333333", "4444444"), ("2", "m.c", "5555555", "6666666")}


def test_changed_lines(spark):
    rows = patches.changed_lines(frame(spark, [("1", P1), ("2", None)]), "id", "patch").collect()
    assert {r.path: (r.removed, r.added) for r in rows} == {"x.c": (["old"], ["new"]), "r2.c": ([], []), "q.sql": (["drop"], ["keep"])}


def diff(*files):
    return "".join(f"diff --git a/{p} b/{p}\n" + (f"index {i}\n" if i else "") + "".join(f"{x}\n" for x in body) for p, i, body in files)


def test_fix_relations(spark):
    base = diff(("x.c", "1111111..2222222", []))
    b = {
        "equal": base, "longer": diff(("x.c", "11111119..22222229", [])), "short": diff(("x.c", "111111..222222", [])), "other": diff(("y.c", "1111111..2222222", [])), "none": diff(("x.c", None, [])),
    }
    pairs = spark.createDataFrame([("a", k) for k in b], "p string, q string")
    left = patches.patch_blobs(frame(spark, [("a", base)]), "id", "patch")
    right = patches.patch_blobs(frame(spark, list(b.items())), "id", "patch")
    got = {r.q: r.fix for r in patches.fix_relation(pairs, "p", "q", left, right, "id", "id").collect()}
    assert got == {"equal": "identical", "longer": "identical", "short": "different", "other": "not_comparable", "none": "not_comparable"}
    strict = {r.q: r.blob_test for r in patches.strict_blob_test(pairs, "p", "q", left, right, "id", "id").collect()}
    assert strict == {"equal": "same_blob_pairs", "longer": "same_blob_pairs", "short": "different_blob_pairs", "other": "different_blob_pairs", "none": "not_comparable"}
    assert {(r.a_id, r.b_id) for r in patches.same_fix_pairs(left, right, "id", "id").collect()} == {("a", "equal"), ("a", "longer")}


def test_lines_contained_is_a_multiset_test(spark):
    a = frame(spark, [("a", diff(("x.c", None, ["-p", "-p"])))])
    b = frame(spark, [("few", diff(("x.c", None, ["-p"]))), ("many", diff(("x.c", None, ["-p", "-p", "-q"]))), ("apart", diff(("y.c", None, ["-p", "-p"])))])
    pairs = spark.createDataFrame([("a", "few"), ("a", "many"), ("a", "apart")], "p string, q string")
    rows = patches.lines_contained(pairs, "p", "q", patches.changed_line_rows(a, "id", "patch"), patches.changed_line_rows(b, "id", "patch"), "id", "id").collect()
    assert {r.q: r.lines_contained for r in rows} == {"few": "not_contained", "many": "contained", "apart": "not_comparable"}


words_strategy = st.lists(st.sampled_from("abc"), max_size=8)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(words_strategy, words_strategy), min_size=1, max_size=12))
def test_longest_runs(spark, texts):
    def want(a, b):
        grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        n = 0
        while grams(a, n + 1) & grams(b, n + 1):
            n += 1
        return n

    a = spark.createDataFrame([(i, " ".join(x)) for i, (x, _) in enumerate(texts)], "a int, ta string")
    b = spark.createDataFrame([(i, " ".join(y)) for i, (_, y) in enumerate(texts)], "b int, tb string")
    pairs = spark.createDataFrame([(i, i) for i in range(len(texts))], "a int, b int")
    got = {r.a: r.run for r in overlap.longest_runs(pairs, a, b, "a", "b", "ta", "tb").collect()}
    assert got == {i: want(x, y) for i, (x, y) in enumerate(texts)}


def test_two_medians(spark):
    row = overlap.run_stats(spark.createDataFrame([(1,), (2,), (3,), (10,)], "run int")).head()
    assert (row.upper_median, row["median"], row.longest, row.pairs) == (3, 2.5, 10, 4)
    empty = overlap.run_stats(spark.createDataFrame([], "run int")).head()
    assert (empty.pairs, empty.longest, empty.upper_median, empty["median"]) == (0, None, None, None)


def test_equal_texts_and_boilerplate(spark):
    long = " ".join(f"w{i}" for i in range(13))
    a = spark.createDataFrame([(1, long.upper()), (2, "short"), (3, None)], "a int, t string")
    b = spark.createDataFrame([(7, long + "!"), (8, "short")], "b int, u string")
    assert [tuple(r) for r in overlap.equal_texts(a, b, "a", "b", "t", "u").collect()] == [(1, 7)]
    known = spark.createDataFrame([(1, 7)], "a int, b int")
    assert overlap.equal_texts(a, b, "a", "b", "t", "u", 13, known).count() == 0
    assert overlap.boilerplate(b, "b", "u", 1, 2).count() == 0 and overlap.boilerplate(b, "b", "u", 1, 0).count() == 0


def test_hypergeom_goldens():
    for pool, bench, sample, seen, mean, sd, z, p in [(4993, 1368, 445, 135, 121.9, 9.0, 1.46, 0.0816), (4993, 1368, 710, 219, 194.5, 11.0, 2.22, 0.0154), (4993, 1368, 79, 30, 21.6, 3.9, 2.12, 0.0254), (4993, 79, 710, 10, 11.2, 3.1, -0.40, 0.7041)]:
        got = stats.hypergeom(pool, bench, sample, seen)
        assert (round(got["expected"], 1), round(got["sd"], 1), round(got["z"], 2), round(got["p_at_least"], 4)) == (mean, sd, z, p)
    assert stats.hypergeom(1, 1, 1, 1)["z"] is None and stats.hypergeom(10, 3, 2, 5)["p_at_least"] == 0 and stats.hypergeom(10, 0, 2, 0)["p_at_least"] == 1


def test_stratified_agrees_with_uniform_and_ends():
    one = stats.stratified([(50, 20, 10)], 6)
    assert one["p_at_least"] == pytest.approx(stats.hypergeom(50, 20, 10, 6)["p_at_least"])
    two = stats.stratified([(5, 2, 2), (4, 1, 3), (3, 3, 0)], 0)
    assert two["p_at_least"] == pytest.approx(1) and stats.stratified([(5, 2, 2), (4, 1, 3)], 3)["p_at_most"] == pytest.approx(1)
    assert stats.stratified([], 0)["z"] is None


def test_stat_tests_in_spark(spark):
    pool = spark.createDataFrame([("a", True, True), ("a", True, False), ("a", False, True), ("b", False, False)], "g string, k boolean, n boolean")
    counts = stats.strata(pool, "g", F.col("k"), F.col("n"))
    assert stats.uniform_test(counts).head().observed == 1
    row = stats.stratified_test(counts).head()
    assert (row.observed, row.expected) == (1, pytest.approx(1.3333)) and stats.uniform_test(counts.limit(0)).count() == 0


def test_filtered_split_and_accounting(spark):
    rows = [("a1", "A", 1, False), ("a2", "A", 2, False), ("b1", "B", 3, True), ("b2", "B", 4, False), ("c1", "C", 5, True), ("d1", "D", 6, False), ("d2", "D", 7, False)]
    tasks = spark.createDataFrame(rows, "id string, bug string, pos int, suspect boolean")
    bench = spark.createDataFrame([("A",), ("A",)], "bug string")
    assert [r.id for r in splits.filtered_split(tasks, "bug", "pos", "suspect", bench).orderBy("group_order").collect()] == ["b2", "d1"]
    got = splits.accounting(splits.judged(tasks, "bug", "pos", "suspect", bench)).head().asDict()
    assert got == {"kept": 2, "removed_benchmark": 2, "removed_suspect": 1, "removed_duplicates": 2, "total": 7}
    assert splits.accounting(splits.judged(tasks.limit(0), "bug", "pos", "suspect", bench)).head().total == 0


def test_cross_counts_equal_all_ordered_pairs(spark):
    rows = [("p", "x"), ("p", "x"), ("p", "y"), ("q", "x"), (None, "x"), (None, "y")]
    got = {(r.g, r.a_v, r.b_v): r.pairs for r in presence.cross_counts(spark.createDataFrame(rows, "g string, v string"), "g", ["v"]).collect()}
    want = Counter((a[0], a[1], b[1]) for i, a in enumerate(rows) for j, b in enumerate(rows) if i != j and a[0] == b[0] and a[0])
    assert got == dict(want)


def test_shuffled_ids_do_not_overlap(spark):
    a = spark.createDataFrame([(i,) for i in range(100)], "num long")
    b = spark.createDataFrame([(i + 1000,) for i in range(100)], "num long")
    assert keys.plain_overlap(a, b, "num").count() == 0


def test_names_any_whole_words(spark):
    df = spark.createDataFrame([("call foo_bar now", ["foo"]), ("call foo.", ["foo"]), ("x", []), ("a+b c", ["a+b"])], "t string, n array<string>")
    assert [r.k for r in df.select(overlap.names_any(F.col("t"), F.col("n")).alias("k")).collect()] == [False, True, None, True]


def test_graded_counts_equal_brute_force(spark):
    """Counts of grades from counts of values, against all pairs made; nulls are empty values and a null group takes no part."""
    import random

    rng = random.Random(4)
    rows = [(rng.choice(["p", "q", None]), rng.choice(["uaf", "leak", "", None]), rng.choice(["f", "g", "", None])) for _ in range(60)]
    a, b = rows[:40], rows[40:]

    def grade(x, y):
        (s, f), (t, g) = ((v[1] or "", v[2] or "") for v in (x, y))
        kind, frame = s != "" and s == t, f == g
        if not f or not g:
            return "type_only_no_frame" if kind else "no_match_no_frame"
        return "type_and_frame" if kind and frame else "frame_only" if frame else "type_only" if kind else "no_match"

    df = lambda r: spark.createDataFrame(r, "project string, t string, f string")
    got = lambda d: {r.grade: r.pairs for r in d.collect()}
    across = Counter(grade(x, y) for x in a for y in b if x[0] and x[0] == y[0])
    assert got(presence.graded_counts(df(a), df(b), "project", "t", "f")) == across
    within = Counter(grade(x, y) for i, x in enumerate(a) for j, y in enumerate(a) if i != j and x[0] and x[0] == y[0])
    assert got(presence.graded_counts(df(a), None, "project", "t", "f")) == within
    assert got(presence.graded_counts(df(a).limit(0), df(b), "project", "t", "f")) == {}


def test_longest_runs_of_odd_texts(spark):
    texts = {1: "a b c d e f", 2: "x c d e y a b", 3: "f", 4: None, 5: "", 6: "the the the the", 7: "z"}
    df = spark.createDataFrame(list(texts.items()), "id long, body string")
    other = df.select(F.col("id").alias("other"), F.col("body").alias("words"))
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 5), (6, 6), (1, 7), (1, 1), (1, 2), (99, 1)], "id long, other long")
    got = {(r.id, r.other): r.run for r in overlap.longest_runs(pairs, df, other, "id", "other", "body", "words").collect()}
    assert got == {(1, 2): 3, (1, 3): 1, (1, 4): 0, (1, 5): 0, (6, 6): 4, (1, 7): 0, (1, 1): 6, (99, 1): 0}


def test_long_patches_are_parsed_in_proportion(spark):
    """Tens of thousands of changed lines in one patch: parsing doesn't copy what it has."""
    big = "diff --git a/x.c b/x.c\nindex 1111111..2222222\n" + "".join(f"+line {i}\n" for i in range(60_000)) + "diff --git a/y.c b/y.c\n-gone\n"
    df = spark.createDataFrame([(1, big)], "id long, patch string")
    rows = patches.changed_line_rows(df, "id", "patch")
    assert rows.groupBy("path").count().orderBy("path").collect() == [("x.c", 60_001), ("y.c", 2)]
    assert [tuple(r) for r in patches.patch_blobs(df, "id", "patch").collect()] == [(1, "x.c", "1111111", "2222222")]
