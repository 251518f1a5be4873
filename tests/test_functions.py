from pyspark.sql import functions as F

from kinsieve.functions import crash, ids, text


def values(spark, rows, column, make):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.select("i", make(F.col("x")).alias(column)).orderBy("i").select(column).collect()]


def test_words_are_unicode_runs(spark):
    assert values(spark, ["Café x² naïve_1 ½, foo-bar", "", None], "w", text.words) == [["café", "x²", "naïve_1", "½", "foo", "bar"], [], []]


def test_ngrams_need_enough_words(spark):
    rows = [" ".join(f"w{i}" for i in range(n)) for n in (12, 13, 14)] + ["", None]
    assert values(spark, rows, "n", lambda c: F.size(text.ngrams(text.words(c), 13))) == [0, 1, 2, 0, 0]
    assert values(spark, ["a a a a"], "g", lambda c: text.ngrams(text.words(c), 2)) == [["a a"]]


def test_lines_and_blanks(spark):
    assert values(spark, ["a\r\nb\x0bc\n", "", None, "x"], "l", text.lines) == [["a", "b", "c"], [], [], ["x"]]
    assert values(spark, ["  \t a ", None], "s", text.stripped) == ["a", None]
    assert values(spark, ["a \n\t b"], "s", text.collapsed) == ["a b"]


def test_id_parts(spark):
    assert values(spark, ["arvo_42479930", "oss-fuzz:12", "abc", "", None, "12\r"], "n", ids.trailing_int) == [42479930, 12, None, None, None, None]
    assert values(spark, ["a-b__c-d-123", "none", None], "n", ids.pr_number) == [123, None, None]
    assert values(spark, ["Own__re__po.abc123.pr_9", None], "n", ids.repo_from_id) == ["own/re__po", None]
    assert values(spark, ["Own__re.abc123.pr_9", "x.pr_a"], "n", ids.is_pr_mirror) == [True, False]
    assert values(spark, ["123.0", "", "x", None], "n", ids.float_text_int) == [123, None, None, None]
    assert values(spark, ["a/b/c.h", "Repo"], "n", ids.short_repo) == ["c.h", "Repo"]
    assert values(spark, ["tmp/x/src-fix/proj/a/b.c", "a/b.c"], "n", ids.source_path) == ["a/b.c", "a/b.c"]
    assert values(spark, ["x/POC.bin", "poc/x.bin", "a-crash-1"], "n", ids.is_poc_path) == [True, False, True]


def test_bare_function_name(spark):
    rows = {
        "void ns::Cls::method<ns::T>(int) const": "method", "main": "main", "rawspeed::L::decodeN<4>()::'lambda'(int)::operator()(int) const": "decodeN",
        "a::operator<(b)": "a", "f)x": "f)x", "g(unclosed": "g", "std::vector<std::pair<int,int>>::at(unsigned long)": "at", "": "",
    }
    assert values(spark, list(rows), "n", crash.bare_function_name) == list(rows.values())
    assert values(spark, [None], "n", crash.bare_function_name) == [""]


STACK = "x\n    #0 0x1a in __asan_memcpy /src/llvm-project/compiler-rt/a.cpp:1:2\n  #1 0x2b in ns::f(int) /src/p/a.c:3:4\n\n#0 0x3c in g /src/p/b.c:1:1\n"


def test_reports(spark):
    reports = [
        "ERROR: AddressSanitizer: heap-use-after-free on\nSUMMARY: AddressSanitizer: heap-buffer-overflow /a", "ERROR: AddressSanitizer: attempting double-free on", "x runtime error: y", "", None, STACK,
        "WARNING: MemorySanitizer: use-of-uninitialized-value\n#0 0x1 in f (/bin/x+0x1)",
    ]
    df = spark.createDataFrame([(i, r, "clash") for i, r in enumerate(reports)], "i int, report string, crash_kind string")
    rows = crash.with_report(df, "report").orderBy("i").collect()
    assert [r.crash_type for r in rows] == ["heap-buffer-overflow", "double-free", "", "", "", "", "use-of-uninitialized-value"]
    assert [r.sanitizer for r in rows] == ["AddressSanitizer", "AddressSanitizer", "UndefinedBehaviorSanitizer", "", "", "", "MemorySanitizer"]
    assert rows[5].stack == ["#0 0x1a in __asan_memcpy /src/llvm-project/compiler-rt/a.cpp:1:2", "#1 0x2b in ns::f(int) /src/p/a.c:3:4"]
    assert [r.top_frame for r in rows] == ["", "", "", "", "", "f", ""]
    assert [len(r.stack) for r in rows] == [0, 0, 0, 0, 0, 2, 1]


def test_crash_grades(spark):
    cases = [("a", "a", "f", "f", "type_and_frame"), ("a", "b", "f", "f", "frame_only"), ("a", "a", "f", "g", "type_only"), ("a", "b", "f", "g", "no_match"), ("a", "a", "", "f", "type_only_no_frame"), ("", "", "", "", "no_match_no_frame")]
    df = spark.createDataFrame(cases, "ta string, tb string, fa string, fb string, want string")
    rows = df.withColumn("got", crash.grade_of(F.col("ta"), F.col("tb"), F.col("fa"), F.col("fb"))).collect()
    assert all(r.got == r.want for r in rows)


def test_spec_grades(spark):
    frames = ["#0 0x1 in f /src/p/dir/a.c:1"]
    cases = [("LLVMFuzzerTestOneInput", "T", "x", "names_fuzzer_entry_point"), ("f", "t", "x", "function_and_type"), ("f", "u", "x", "function_only"), ("h", "t", "p/dir/a.c", "file_only"), ("", "", "", "no_match")]
    df = spark.createDataFrame([(*c, frames) for c in cases], "fn string, kind string, file string, want string, frames array<string>")
    rows = df.withColumn("got", crash.spec_grade(F.col("fn"), F.col("kind"), F.col("file"), F.col("frames"), F.lit("T"))).collect()
    assert all(r.got == r.want for r in rows)


def test_signature_and_commits(spark):
    content = "x\nCrash State:\n  f\n  g\n  \nend\n"
    df = spark.createDataFrame([(content,), ("none",), (None,)], "c string")
    rows = df.select(crash.crash_signature(F.lit("p"), F.lit("t"), F.col("c")).alias("s")).collect()
    assert rows[0].s.frames == ["f", "g"] and rows[1].s is None and rows[2].s is None
    sha = "a" * 40
    assert values(spark, [f'["{sha}", "{sha.upper()}"]', None], "c", crash.fix_commits) == [[sha], []]


def test_spec_parts(spark):
    spec = "AddressSanitizer: heap-use-after-free READ of size 1 in function `a::b` in file `p/x.c`"
    df = spark.createDataFrame([(spec,), (None,)], "s string").select(crash.spec_parts(F.col("s")).alias("p"))
    assert [tuple(r.p) for r in df.collect()] == [("heap-use-after-free READ of size 1", "a::b", "p/x.c"), ("", "", "")]
