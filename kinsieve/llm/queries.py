"""The queries pN_... of the training-data problems, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsieve.llm import abuse, frequencies, groups, leaks, matching, mixing, neardup, packing

#: Tokens that a container holds.
CAPACITY = 4096


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    cyber = _table(spark, sf_dir, "cybergym").select(F.col("error_txt").alias("report"))
    return cyber.unionByName(_table(spark, sf_dir, "sec_bench").select(F.col("sanitizer_report").alias("report")))


def _problem_and_patch():
    return F.concat_ws(" ", F.coalesce("problem_statement", F.lit("")), F.coalesce("patch", F.lit("")))


def p1_found(spark, sf_dir):
    return matching.same_fix(_table(spark, sf_dir, "sec_bench"), _table(spark, sf_dir, "swe_rebench_v2")).select("sec_id", "row_id")


def p1_confidence(spark, sf_dir):
    found = matching.same_fix(_table(spark, sf_dir, "sec_bench"), _table(spark, sf_dir, "swe_rebench_v2"), threshold=0.05)
    return found.select("sec_id", "row_id", F.round("confidence", 6).alias("confidence"))


def p2_found(spark, sf_dir):
    return leaks.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p2_leaked_words(spark, sf_dir):
    return leaks.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p3_found(spark, sf_dir):
    pairs = (_table(spark, sf_dir, "overlap_v2_prs"), ["benchmark_instance_id", "training_instance_id"])
    bugs = (_table(spark, sf_dir, "cyber_overlap"), ["cybergym_task_id", "mimo_instance_ids"])
    return groups.linked_groups([pairs, bugs])


def p4_found(spark, sf_dir):
    pairs = neardup.similar_pairs(_table(spark, sf_dir, "swe_rebench_v2"), "row_id", _problem_and_patch(), n=3, t=0.6)
    return pairs.select("row_id_a", "row_id_b")


def p4_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(_table(spark, sf_dir, "swe_rebench_v2"), "row_id", _problem_and_patch(), n=5, t=0.8)


def p5_found(spark, sf_dir):
    return frequencies.marked_terms(_reports(spark, sf_dir), "report").where("mark is not null").select("term", "mark")


def p5_term_frequencies(spark, sf_dir):
    return frequencies.marked_terms(_reports(spark, sf_dir), "report")


def p6_containers(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"), CAPACITY)


def p7_mix(spark, sf_dir):
    return mixing.mix_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark, sf_dir):
    return mixing.mix_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))[1]


def _scored(spark, sf_dir):
    return abuse.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "review_labels"), keep=("source",))


def p8_found(spark, sf_dir):
    return _scored(spark, sf_dir).where("score >= 0.5").select("doc_id")


def p8_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"), "offending", "worst")


def p8_rates(spark, sf_dir):
    return abuse.rates(_scored(spark, sf_dir), mixing.clean_source(F.col("source")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_confidence, p2_found, p2_leaked_words, p3_found, p4_found, p4_near_duplicates, p5_found, p5_term_frequencies, p6_containers, p7_mix, p7_shares, p8_found, p8_scores, p8_rates)
    return {f.__name__: f for f in found}


_P3 = r"""
WITH RECURSIVE side AS (
    SELECT 'p' AS kind, pair_id, unnest(string_split(concat_ws(';', benchmark_instance_id, training_instance_id), ';')) AS x FROM overlap_v2_prs
    UNION ALL
    SELECT 'c', pair_id, unnest(string_split(concat_ws(';', cybergym_task_id, mimo_instance_ids), ';')) FROM cyber_overlap
), ids AS (
    SELECT DISTINCT kind, pair_id, lower(regexp_replace(x, '^\s+|\s+$', '', 'g')) AS id FROM side
), held AS (SELECT * FROM ids WHERE id <> ''),
firsts AS (SELECT kind, pair_id, min(id) AS f FROM held GROUP BY kind, pair_id),
edges AS (
    SELECT DISTINCT f AS a, id AS b FROM held JOIN firsts USING (kind, pair_id)
    UNION SELECT DISTINCT id, f FROM held JOIN firsts USING (kind, pair_id)
), reach(a, b) AS (
    SELECT id, id FROM held
    UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
)
SELECT a AS record_id, min(b) AS group_id FROM reach GROUP BY a
"""

def _shared_runs(n: int) -> str:
    """Tables sizes (row_id, n) and shared (x, y, k): distinct runs of ``n`` words of each row, and those that two rows have in common."""
    run = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return rf"""
words AS (
    SELECT row_id, regexp_extract_all(lower(coalesce(problem_statement, '') || ' ' || coalesce(patch, '')), '[\p{{L}}\p{{N}}_]+') AS w FROM swe_rebench_v2
), runs AS (
    SELECT DISTINCT row_id, {run} AS g
    FROM (SELECT row_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM words WHERE len(w) >= {n})
), sizes AS (SELECT row_id, count(*) AS n FROM runs GROUP BY row_id),
shared AS (
    SELECT a.row_id AS x, b.row_id AS y, count(*) AS k FROM runs a JOIN runs b ON a.g = b.g AND a.row_id < b.row_id GROUP BY 1, 2
)"""


_P4 = f"""
WITH {_shared_runs(3)}
SELECT x AS row_id_a, y AS row_id_b FROM shared JOIN sizes p ON p.row_id = x JOIN sizes q ON q.row_id = y
WHERE 10 * k >= 6 * (p.n + q.n - k)
"""

_P4_CLASSES = f"""
WITH RECURSIVE {_shared_runs(5)},
linked AS (SELECT x, y FROM shared JOIN sizes p ON p.row_id = x JOIN sizes q ON q.row_id = y WHERE 10 * k >= 8 * (p.n + q.n - k)),
edges AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reach(a, b) AS (
    SELECT row_id, row_id FROM sizes
    UNION SELECT reach.a, edges.y FROM reach JOIN edges ON reach.b = edges.x
)
SELECT a AS row_id, min(b) AS class_id, (SELECT count(*) FROM edges WHERE x = a) AS links FROM reach GROUP BY a
"""

_TERMS = r"""
WITH reports AS (
    SELECT error_txt AS r FROM cybergym WHERE error_txt IS NOT NULL
    UNION ALL SELECT sanitizer_report FROM sec_bench WHERE sanitizer_report IS NOT NULL
), numbered AS (SELECT row_number() OVER () AS i, r FROM reports),
words AS (SELECT i, unnest(regexp_extract_all(lower(r), '[\p{L}\p{N}_]+')) AS term FROM numbered),
counts AS (SELECT term, count(*) AS occurrences, count(DISTINCT i) AS reports FROM words GROUP BY term)
SELECT term, occurrences, reports, CASE WHEN reports < 3 THEN 'rare' WHEN reports > 0.5 * (SELECT count(*) FROM numbered) THEN 'common' END AS mark FROM counts
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": _P3, "p4_found": _P4, "p4_near_duplicates": _P4_CLASSES, "p5_found": f"SELECT term, mark FROM ({_TERMS}) WHERE mark IS NOT NULL", "p5_term_frequencies": _TERMS}
