"""Queries over literal rows, one for each branch of a rule that the test tables show in one form only, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsieve.functions import crash
from kinsieve.operators import keys, overlap, stats

_ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    _ALL[f.__name__] = f
    return f


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def _values(rows: list[tuple], names: str) -> str:
    """The rows as SQL that DuckDB reads."""
    listed = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"(VALUES {listed}) v({names})"


# (id, joins, a_pr, b_pr, fix): a pair for every branch of ``pair_kind``
_KINDS = [
    (1, "base_commit_and_pr;exact_repo", 1, 1, "identical"), (2, "case_insensitive_repo_pr", 1, 1, "identical"), (3, "case_insensitive_repo_pr;exact_repo_pr", 1, 1, "partly_identical"),
    (4, "case_insensitive_repo_pr", 2, 2, "different"), (5, "case_insensitive_repo_pr", 2, 2, "not_comparable"), (6, "base_commit", None, 3, "identical"), (7, "base_commit", 3, None, "different"),
    (8, "base_commit", None, None, "not_comparable"), (9, "base_commit", 4, 5, "identical"), (10, "base_commit;base_commit_and_pr", None, None, "different"),
]


@query
def pair_kind_rules(spark, folder):
    rows = spark.createDataFrame(_KINDS, "id int, joins string, a_pr long, b_pr long, fix string")
    kind = keys.pair_kind(F.split("joins", ";"), F.col("a_pr"), F.col("b_pr"), F.col("fix"))
    return rows.select("id", kind.alias("kind"), keys.is_overlap(kind).alias("overlap"))


# (id, in_release, train_blobs, bench_blobs, shared)
_REASONS = [(1, 0, 0, 0, 0), (2, 1, 0, 3, 0), (3, 1, 2, 0, 0), (4, 1, 2, 3, 0), (5, 1, 2, 3, 1), (6, 0, 2, 3, 1)]


@query
def no_fix_rules(spark, folder):
    rows = spark.createDataFrame(_REASONS, "id int, in_release int, train_blobs int, bench_blobs int, shared int")
    return rows.select("id", keys.no_fix_reason(F.col("in_release") == 1, F.col("train_blobs"), F.col("bench_blobs"), F.col("shared")).alias("reason"))


# (train_id, bench_id, same_fix, records): the order of training ids decides among signatures, a fix commit over all
_EVIDENCE = [(1, 10, 0, 2), (2, 10, 0, 5), (1, 11, 0, 5), (2, 11, 0, 2), (1, 12, 1, None), (2, 12, 0, 2), (1, 13, 0, 3), (2, 13, 1, 2), (3, 13, 0, 4), (7, 14, 0, 2)]


@query
def evidence_rules(spark, folder):
    rows = spark.createDataFrame(_EVIDENCE, "train_id int, bench_id int, f int, records long").withColumn("same_fix_commit", F.col("f") == 1)
    return keys.related_evidence(rows, "train_id")


_LONG = " ".join(f"word{i}" for i in range(13))
# (id, text) of either side: equal words of thirteen, in other case and layout, in other order, one fewer
_LEFT = [(1, _LONG), (2, _LONG.upper().replace(" ", " - ")), (3, " ".join(reversed(_LONG.split()))), (4, _LONG.rsplit(" ", 1)[0]), (5, None), (6, _LONG + " more")]
_RIGHT = [(1, _LONG), (4, _LONG.rsplit(" ", 1)[0]), (5, ""), (7, _LONG + "\nmore"), (2, _LONG.replace(" ", "\t"))]


@query
def equal_text_rules(spark, folder):
    a, b = spark.createDataFrame(_LEFT, "a_id int, a_text string"), spark.createDataFrame(_RIGHT, "b_id int, b_text string")
    known = spark.createDataFrame([(1, 1)], "a_id int, b_id int")
    return overlap.equal_texts(a, b, "a_id", "b_id", "a_text", "b_text", 13, known)


# (id, project, kind, content): a state of two frames, of one, none, one without its indent, and no content
_STATES = [
    (1, "p", "UAF", "Crash State:\n  f_one\n  g two \n\nmore"), (2, "p", None, "x\nCrash State:\n  only\nrest"), (3, "q", "UAF", "Crash State:\nnone"), (4, None, "leak", "Crash State:\n  f\n  \n"), (5, "q", "leak", None),
]


@query
def signature_rules(spark, folder):
    rows = spark.createDataFrame(_STATES, "id int, project string, kind string, content string").withColumn("s", crash.crash_signature(F.col("project"), F.col("kind"), F.col("content")))
    return rows.select("id", "s.project", F.col("s.type").alias("kind"), F.array_join("s.frames", "|").alias("frames"))


# (stratum, pool_n, bench_k, sample_n, shared): one without a sample, one wholly drawn, one of one item
_STRATA = [("a", 40, 12, 9, 5), ("b", 7, 3, 0, 0), ("c", 6, 4, 6, 4), ("d", 1, 1, 1, 1), ("e", 25, 10, 5, 1), ("f", 25, 10, 5, 2), ("g", 300, 40, 31, 7)]


@query
def stratified_rules(spark, folder):
    return stats.stratified_test(spark.createDataFrame(_STRATA, "stratum string, pool_n long, bench_k long, sample_n long, shared long"))


@query
def uniform_rules(spark, folder):
    rows = spark.createDataFrame(_STRATA, "stratum string, pool_n long, bench_k long, sample_n long, shared long")
    return stats.uniform_test(rows).select("observed", "expected", "sd", "z", "p_at_least")


# ways to draw x of k marked ones among m of n, as a logarithm
_LOG_WAYS = "lgamma(k + 1) - lgamma(x + 1) - lgamma(k - x + 1) + lgamma(n - k + 1) - lgamma(m - x + 1) - lgamma(n - k - m + x + 1) - lgamma(n + 1) + lgamma(m + 1) + lgamma(n - m + 1)"


def stratified_sql(strata: str) -> str:
    """The stratified test of a query for (pool_n, bench_k, sample_n, shared), by adding one stratum's distribution at a time."""
    return f"""WITH RECURSIVE strata AS ({strata}),
s AS (SELECT row_number() OVER () AS i, pool_n::BIGINT AS n, bench_k::BIGINT AS k, sample_n::BIGINT AS m FROM strata WHERE sample_n > 0 AND pool_n > 0),
pm AS (SELECT i, x, exp({_LOG_WAYS}) AS p FROM (SELECT *, unnest(range(greatest(0, m + k - n), least(k, m) + 1)) AS x FROM s)),
conv(i, x, p) AS (SELECT 0::BIGINT, 0::BIGINT, 1.0::DOUBLE UNION ALL SELECT c.i + 1, c.x + pm.x, sum(c.p * pm.p)::DOUBLE FROM conv c JOIN pm ON pm.i = c.i + 1 GROUP BY c.i + 1, c.x + pm.x),
d AS (SELECT x, p FROM conv WHERE i = (SELECT count(*) FROM s)),
t AS (SELECT (SELECT sum(shared)::BIGINT FROM strata) AS o, coalesce(sum(m * k / n), 0) AS mean, coalesce(sqrt(sum(m * (k / n) * (1 - k / n) * (n - m) / greatest(n - 1, 1))), 0) AS sd FROM s)
SELECT o AS observed, round(mean, 4) AS expected, round(sd, 4) AS sd, CASE WHEN sd > 0 THEN round((o - mean) / sd, 4) END AS z,
round((SELECT coalesce(sum(p), 0) FROM d WHERE x >= o), 6) AS p_at_least, round((SELECT coalesce(sum(p), 0) FROM d WHERE x <= o), 6) AS p_at_most FROM t"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_ALL)


def oracle_sql() -> dict[str, str]:
    strata = f"SELECT * FROM {_values(_STRATA, 'stratum, pool_n, bench_k, sample_n, shared')}"
    words = lambda c: rf"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_]+')"
    state = r"regexp_extract(coalesce(content, ''), 'Crash State:\n((?:  .*\n)+)', 1)"
    return {
        "pair_kind_rules": f"""WITH r AS (SELECT id, CASE WHEN list_contains(string_split(joins, ';'), 'base_commit_and_pr') THEN 'same PR, same base commit'
    WHEN list_contains(string_split(joins, ';'), 'case_insensitive_repo_pr') THEN 'same PR, different base commit, ' || CASE WHEN fix = 'identical' THEN 'identical fix' ELSE 'fix ' || fix END
    WHEN a_pr IS NULL OR b_pr IS NULL THEN CASE WHEN fix = 'identical' THEN 'same base commit and identical fix (no PR number)' ELSE 'same base commit, fix not identical (no PR number)' END
    ELSE 'same base commit, different PR' END AS kind FROM {_values(_KINDS, 'id, joins, a_pr, b_pr, fix')})
SELECT id, kind, starts_with(kind, 'same PR') OR kind = 'same base commit and identical fix (no PR number)' AS overlap FROM r""",
        "no_fix_rules": f"""SELECT id, CASE WHEN in_release = 0 THEN 'bug outside the first release' WHEN train_blobs = 0 THEN 'no fix patch, or one without blob IDs' WHEN bench_blobs = 0 THEN 'benchmark patch without blob IDs'
    WHEN shared = 0 THEN 'no file in common' ELSE 'same files, different blobs' END AS reason FROM {_values(_REASONS, 'id, in_release, train_blobs, bench_blobs, shared')}""",
        "evidence_rules": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY bench_id ORDER BY f DESC, train_id DESC) AS nth FROM {_values(_EVIDENCE, 'train_id, bench_id, f, records')})
SELECT bench_id, CASE WHEN f = 1 THEN 'same fix commit' WHEN records = 2 THEN 'signature carried by 2 records' ELSE 'signature carried by 3 or more records' END AS evidence FROM r WHERE nth = 1""",
        "equal_text_rules": f"""SELECT a_id, b_id FROM {_values(_LEFT, 'a_id, a_text')} JOIN {_values(_RIGHT, 'b_id, b_text').replace(') v(', ') u(')} ON {words('a_text')} = {words('b_text')}
WHERE len({words('a_text')}) >= 13 AND NOT (a_id = 1 AND b_id = 1)""",
        "signature_rules": rf"""WITH f AS (SELECT id, project, kind, list_filter(list_transform(string_split({state}, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM {_values(_STATES, 'id, project, kind, content')})
SELECT id, CASE WHEN len(l) > 0 THEN project END AS project, CASE WHEN len(l) > 0 THEN kind END AS kind, CASE WHEN len(l) > 0 THEN array_to_string(l, '|') END AS frames FROM f""",
        "stratified_rules": stratified_sql(strata),
        "uniform_rules": f"""WITH t AS (SELECT sum(pool_n)::BIGINT AS n, sum(bench_k)::BIGINT AS k, sum(sample_n)::BIGINT AS m, sum(shared)::BIGINT AS o FROM ({strata})),
terms AS (SELECT sum(exp({_LOG_WAYS})) AS p FROM t, (SELECT unnest(range(0, 1 + (SELECT least(k, m) FROM t))) AS x) WHERE x >= o AND n - k - m + x >= 0)
SELECT o AS observed, round(m * k / n, 4) AS expected, round(sqrt(m * (k / n) * (1 - k / n) * (n - m) / (n - 1)), 4) AS sd, round((o - m * k / n) / sqrt(m * (k / n) * (1 - k / n) * (n - m) / (n - 1)), 4) AS z, round(p, 6) AS p_at_least FROM t, terms""",
    }
