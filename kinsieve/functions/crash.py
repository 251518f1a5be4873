"""Sanitizer reports: crash type, first stack, top frame of the project, and graded comparisons. Null reports read as empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsieve.functions.text import let, lines, stripped

# Entry points of fuzzers, prefixes of the sanitizers' runtime, and where system code lies.
ENTRY_POINTS = ("LLVMFuzzerInitialize", "LLVMFuzzerTestOneInput")
RUNTIME_PREFIXES = ("__asan", "__interceptor", "__sanitizer", "__msan", "__ubsan", "__lsan", "__hwasan", "__libc")
SYSTEM_PLACES = ("compiler-rt", "llvm-project", "glibc", "/lib/x86_64-linux-gnu/")
SANITIZERS = ("AddressSanitizer", "MemorySanitizer", "UndefinedBehaviorSanitizer", "LeakSanitizer")
GRADES = ("function_and_type", "function_only", "file_only", "names_fuzzer_entry_point", "no_match")


def spec_parts(spec: Column) -> Column:
    """struct(type, function, file) that a task's specification names; '' for what it lacks."""
    where = "in function `([^`]*)` in file `([^`]*)`"
    part = lambda pattern, k: F.coalesce(F.regexp_extract(spec, pattern, k), F.lit(""))
    return F.struct(part("(?d)Sanitizer: (.+?) in function", 1).alias("type"), part(where, 1).alias("function"), part(where, 2).alias("file"))


def names_entry_point(function: Column) -> Column:
    return function.isin(*ENTRY_POINTS)


def _without_brackets(text: Column, opening: str, closing: str) -> Column:
    """Drops bracketed parts by depth: a closing sign at depth 0 stays, an opening one never closed drops the rest."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"))

    def step(acc, ch):
        opens, closes = ch == opening, (ch == closing) & (acc["depth"] > 0)
        depth = F.when(opens, acc["depth"] + 1).when(closes, acc["depth"] - 1).otherwise(acc["depth"])
        out = F.when(~opens & ~closes & (acc["depth"] == 0), F.concat(acc["out"], ch)).otherwise(acc["out"])
        return F.struct(out.alias("out"), depth.alias("depth"))

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    whole = F.aggregate(chars, start, step)["out"]
    return F.when(text.contains(opening), whole).otherwise(text)


def bare_function_name(name: Column) -> Column:
    """The last plain part of a qualified name without template arguments, parameters and qualifiers."""
    def last_part(plain):
        token = F.regexp_extract(stripped(F.regexp_replace(plain, " const", "")), r"(?U)(\S*)$", 1)
        parts = F.filter(F.split(token, "::"), lambda p: (p != "") & ~p.contains("lambda") & ~p.rlike("^(operator|'|\\{)"))
        return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))

    return let(F.coalesce(name, F.lit("")), lambda n: let(_without_brackets(n, "<", ">"), lambda m: let(_without_brackets(m, "(", ")"), last_part)))


def crash_type(report: Column) -> Column:
    """The kind of bug that the summary names, else the headline, else ''."""
    summary = F.regexp_extract(report, r"SUMMARY: \w+Sanitizer: ([\w-]+)", 1)
    headline = F.regexp_extract(report, r"(?:ERROR|WARNING): \w+Sanitizer: (?:attempting )?([\w-]+)", 1)
    return F.coalesce(F.nullif(summary, F.lit("")), headline, F.lit(""))


_FRAME = r"^\s*#\d+ 0x[0-9a-f]+ in "
_FRAME_PARTS = r"^#\d+ 0x[0-9a-f]+ in (.+?) (\S+)\s*$"
_RUNTIME = "^(" + "|".join(RUNTIME_PREFIXES) + ")"


def _is_own(frame: Column) -> Column:
    """Symbolised, and neither of the runtime nor of the system's libraries."""
    place = F.regexp_extract(frame, _FRAME_PARTS, 2)
    system = place.startswith("(")
    for s in SYSTEM_PLACES:
        system = system | place.contains(s)
    return frame.rlike(_FRAME_PARTS) & ~F.regexp_extract(frame, _FRAME_PARTS, 1).rlike(_RUNTIME) & ~system


def with_report(rows: DataFrame, report: str, prefix: str = "") -> DataFrame:
    """``rows`` with what a report says: crash_type, sanitizer, stack and top_frame, each name after ``prefix``.

    stack holds the trimmed frame lines of the first stack: the first run of lines of the form ``#n 0xaddress in ...``. top_frame
    is the bare name of the first symbolised frame outside the runtime and the system's libraries, else ''. The parts are made
    in steps, so that no step is worked out twice.
    """
    text = F.coalesce(F.col(f"`{report}`"), F.lit(""))
    step = rows.withColumn("__lines", lines(text))
    step = step.withColumn("__marks", F.transform("__lines", lambda line: line.rlike(_FRAME)))
    step = step.withColumn("__start", F.array_position("__marks", True).cast("int"))
    step = step.withColumn("__tail", F.slice("__marks", F.greatest("__start", F.lit(1)), F.size("__marks")))
    step = step.withColumn("__stop", F.array_position("__tail", False).cast("int"))
    length = F.when(F.col("__start") == 0, 0).when(F.col("__stop") > 0, F.col("__stop") - 1).otherwise(F.size("__tail"))
    stack = F.transform(F.slice("__lines", F.greatest("__start", F.lit(1)), length), stripped)
    step = step.withColumn(f"{prefix}stack", stack)
    step = step.withColumn("__own", F.try_element_at(F.filter(f"{prefix}stack", _is_own), F.lit(1)))
    step = step.withColumn("__name", F.regexp_extract("__own", _FRAME_PARTS, 1))
    step = step.withColumn(f"{prefix}top_frame", bare_function_name(F.col("__name")))
    step = step.withColumn(f"{prefix}crash_type", crash_type(text)).withColumn(f"{prefix}sanitizer", sanitizer(text))
    return step.drop("__lines", "__marks", "__start", "__tail", "__stop", "__own", "__name")


def sanitizer(report: Column) -> Column:
    """The first of the known sanitizers that the report names, in fixed order; a bare runtime error is undefined behaviour."""
    found = F.when(report.contains(SANITIZERS[0]), SANITIZERS[0])
    for name in SANITIZERS[1:]:
        found = found.when(report.contains(name), name)
    return found.when(report.contains("runtime error:"), SANITIZERS[2]).otherwise("")


def crash_signature(project: Column, crash: Column, content: Column) -> Column:
    """struct(project, type, frames) by which a tracker groups reports; null without frames."""
    state = F.regexp_extract(F.coalesce(content, F.lit("")), "Crash State:\n((?:  .*\n)+)", 1)
    frames = F.filter(F.transform(F.split(state, "\n"), stripped), lambda x: x != "")
    return F.when(F.size(frames) > 0, F.struct(project.alias("project"), crash.alias("type"), frames.alias("frames")))


def fix_commits(raw_json: Column) -> Column:
    """All full commit hashes in a JSON text, whatever its form; distinct."""
    return F.array_distinct(F.coalesce(F.regexp_extract_all(F.lower(raw_json), F.lit("[0-9a-f]{40}"), F.lit(0)), F.array().cast("array<string>")))


def spec_grade(function: Column, kind: Column, file: Column, frames: Column, report_type: Column) -> Column:
    """How far a specification names what a report shows; one of ``GRADES``."""
    in_frames = (function != "") & F.exists(frames, lambda f: f.contains(F.concat(F.lit(" in "), function, F.lit(" "))))
    same_type = (kind != "") & (report_type != "") & (F.lower(kind) == F.lower(report_type))
    below = F.when(file.contains("/"), F.regexp_replace(file, "^[^/]*/", "")).otherwise(file)
    in_file = (file != "") & F.exists(frames, lambda f: f.contains(below))
    return (
        F.when(names_entry_point(function), GRADES[3]).when(in_frames & same_type, GRADES[0])
        .when(in_frames, GRADES[1]).when(in_file, GRADES[2]).otherwise(GRADES[4])
    )


def grade_rank(grade: Column) -> Column:
    return F.array_position(F.array(*[F.lit(g) for g in GRADES]), grade)


def grade_of(type_a: Column, type_b: Column, frame_a: Column, frame_b: Column) -> Column:
    """Two reports compared by lower-case crash type and top frame of the project: six grades.

    It takes parsed values, so that every report is parsed once, whatever the number of pairs.
    """
    same_type = (type_a != "") & (type_a == type_b)
    both, same_frame = (frame_a != "") & (frame_b != ""), frame_a == frame_b
    return (
        F.when(~both, F.when(same_type, "type_only_no_frame").otherwise("no_match_no_frame"))
        .when(same_type & same_frame, "type_and_frame").when(same_frame, "frame_only").when(same_type, "type_only").otherwise("no_match")
    )
