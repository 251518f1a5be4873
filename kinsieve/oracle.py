"""SQL with the same results as the queries, for an engine with lists, lambdas and RE2 patterns."""

from __future__ import annotations

_W = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+')"


def _grams(name: str, table: str, key: str, text: str, n: int) -> str:
    run = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"{name} AS (SELECT DISTINCT {key}, {run} AS gram FROM (SELECT {key}, w, unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT {key}, {_W.format(text)} AS w FROM {table}) WHERE len(w) >= {n}))"


def _filter(n: int) -> str:
    return f"WITH {_grams('d', 'documents', 'doc_id', 'text', n)}, {_grams('e', 'eval_items', 'item_id', 'text', n)} SELECT doc_id, item_id, count(*) AS shared FROM d JOIN e USING (gram) GROUP BY ALL"


_TRAIN = r"""numbered AS (
    SELECT extra_info.instance_id AS id, TRY_CAST(nullif(regexp_extract(extra_info.instance_id, '(\d+)$', 1), '') AS BIGINT) AS num, prompt[1].content AS spec,
           json_extract_string(CASE WHEN json_valid(extra_info.instance_json) THEN extra_info.instance_json END, '$.problem_statement') AS stated, row_id AS pos
    FROM mimo_cyber
), train AS (
    SELECT id, num, spec, pos, coalesce(nullif(stated, ''), spec) AS text, CASE WHEN num < 1000000 THEN num + 424000000 ELSE num END AS bug,
           coalesce(regexp_extract(spec, 'Sanitizer: (.+?) in function', 1), '') AS type,
           coalesce(regexp_extract(spec, 'in function `([^`]*)` in file `([^`]*)`', 1), '') AS function,
           coalesce(regexp_extract(spec, 'in function `([^`]*)` in file `([^`]*)`', 2), '') AS file
    FROM numbered
), bench_numbered AS (
    SELECT task_id AS id, split_part(task_id, ':', 1) AS kind, TRY_CAST(nullif(regexp_extract(task_id, '(\d+)$', 1), '') AS BIGINT) AS num,
           nullif(lower(trim(project_name, ' ')), '') AS project, vulnerability_description AS description, error_txt AS report, row_id AS pos
    FROM cybergym
), bench AS (SELECT *, CASE WHEN num < 1000000 THEN num + 424000000 ELSE num END AS bug FROM bench_numbered)"""

_SWE = r"""swe AS (
    SELECT instance_id AS id, coalesce(repo, '') AS repo, TRY_CAST(nullif(split_part(instance_id, '-', -1), '') AS BIGINT) AS pr, lower(coalesce(base_commit, '')) AS base,
           coalesce(problem_statement, '') AS text, coalesce(patch, '') AS patch, row_id AS pos
    FROM swe_rebench_v2
), held AS (SELECT * FROM swe WHERE id IN (SELECT source_key FROM eval_items WHERE dataset = 'swe_rebench_v2')),
hits AS (
    SELECT a.pos AS a_id, b.pos AS b_id, 'exact_repo' AS j FROM held a JOIN swe b ON a.repo = b.repo AND a.pr = b.pr
    UNION SELECT a.pos, b.pos, 'case_insensitive_repo' FROM held a JOIN swe b ON lower(a.repo) = lower(b.repo) AND a.pr = b.pr
    UNION SELECT a.pos, b.pos, 'base_commit_and_pr' FROM held a JOIN swe b ON a.base = b.base AND a.base <> '' AND a.pr = b.pr
), pairs AS (SELECT a_id, b_id, list_sort(list(DISTINCT j)) AS joins FROM hits WHERE a_id <> b_id GROUP BY ALL)"""


def _lines(name: str, table: str, key: str, patch: str) -> str:
    """(key, n, line) of a patch, numbered."""
    return rf"{name} AS (SELECT {key}, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS line FROM (SELECT {key}, regexp_split_to_array({patch}, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS l FROM {table} WHERE {patch} IS NOT NULL))"


def _blobs(name: str, table: str, key: str) -> str:
    """name(key, path, pre, post) from a patch column."""
    header, index = r"^diff --git a/\S+ b/(\S+)", r"^index ([0-9a-f]+)\.\.([0-9a-f]+)"
    return f"""{_lines(name + '_l', table, key, 'patch')},
{name}_m AS (SELECT *, count(*) FILTER (WHERE regexp_matches(line, '{header}')) OVER (PARTITION BY {key} ORDER BY n) AS h FROM {name}_l),
{name}_h AS (SELECT {key}, h, regexp_extract(line, '{header}', 1) AS path FROM {name}_m WHERE regexp_matches(line, '{header}')),
{name}_i AS (SELECT {key}, h, n, line, row_number() OVER (PARTITION BY {key}, h ORDER BY n) AS r FROM {name}_m WHERE h > 0 AND regexp_matches(line, '{index}')),
{name} AS (SELECT {key}, path, arg_max(regexp_extract(line, '{index}', 1), n) AS pre, arg_max(regexp_extract(line, '{index}', 2), n) AS post FROM {name}_i JOIN {name}_h USING ({key}, h) WHERE r = 1 GROUP BY ALL)"""


def _changed(name: str, table: str, key: str) -> str:
    """name(key, path, sign, line): changed lines one by one, and a row with null sign per header."""
    return rf"""{_lines(name + '_l', table, key, 'patch')},
{name}_m AS (SELECT *, count(*) FILTER (WHERE starts_with(line, 'diff --git ')) OVER (PARTITION BY {key} ORDER BY n) AS h FROM {name}_l),
{name}_h AS (SELECT {key}, h, CASE WHEN contains(line, ' b/') THEN regexp_replace(line, '^.*? b/', '') ELSE line END AS path FROM {name}_m WHERE starts_with(line, 'diff --git ')),
{name} AS (
    SELECT {key}, path, left(line, 1) AS sign, regexp_replace(substring(line, 2), '^\s+|\s+$', '', 'g') AS line FROM {name}_m JOIN {name}_h USING ({key}, h)
    WHERE regexp_matches(line, '^[-+]') AND NOT regexp_matches(line, '^(---|\+\+\+)')
    UNION ALL SELECT {key}, path, NULL, NULL FROM {name}_h
)"""


_EQ = "(least(length(x.pre), length(y.pre)) >= 7 AND left(x.pre, least(length(x.pre), length(y.pre))) = left(y.pre, least(length(x.pre), length(y.pre))) AND least(length(x.post), length(y.post)) >= 7 AND left(x.post, least(length(x.post), length(y.post))) = left(y.post, least(length(x.post), length(y.post))))"


def _parsed(name: str, table: str, key: str, report: str) -> str:
    """name(key, crash_type, sanitizer, stack, frames, top_frame)."""
    frame = r"^\s*#\d+ 0x[0-9a-f]+ in "
    form = r"^#\d+ 0x[0-9a-f]+ in (.+?) (\S+)\s*$"
    system = " OR ".join(f"contains(regexp_extract(f, '{form}', 2), '{s}')" for s in ("compiler-rt", "llvm-project", "glibc", "/lib/x86_64-linux-gnu/"))
    bare = "regexp_replace(regexp_replace(regexp_replace(v, '<[^<>]*>', '', 'g'), '\\([^()]*\\)', '', 'g'), ' const', '', 'g')"
    return rf"""{_lines(name + '_l', table, key, report)},
{name}_m AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n) AS r FROM {name}_l WHERE regexp_matches(line, '{frame}')),
{name}_s AS (SELECT {key}, list(regexp_replace(line, '^\s+|\s+$', '', 'g') ORDER BY n) AS stack FROM (SELECT *, n - r AS g, min(n - r) OVER (PARTITION BY {key}) AS first_g FROM {name}_m) WHERE g = first_g GROUP BY {key}),
{name}_t AS (SELECT {key}, stack, list_filter(stack, lambda f: regexp_matches(f, '{form}') AND NOT regexp_matches(regexp_extract(f, '{form}', 1), '^(__asan|__interceptor|__sanitizer|__msan|__ubsan|__lsan|__hwasan|__libc)')
    AND NOT (starts_with(regexp_extract(f, '{form}', 2), '(') OR {system}))[1] AS top FROM {name}_s),
{name}_v AS (SELECT {key}, stack, regexp_extract(top, '{form}', 1) AS v FROM {name}_t),
{name}_b AS (SELECT {key}, stack, list_filter(string_split(regexp_extract(regexp_replace({bare}, '\s+$', ''), '(\S*)$', 1), '::'), lambda p: p <> '' AND NOT contains(p, 'lambda') AND NOT regexp_matches(p, '^(operator|''|\{{)'))[-1] AS top_frame FROM {name}_v),
{name} AS (SELECT t.{key},
    coalesce(nullif(regexp_extract({report}, 'SUMMARY: \w+Sanitizer: ([\w-]+)', 1), ''), regexp_extract({report}, '(?:ERROR|WARNING): \w+Sanitizer: (?:attempting )?([\w-]+)', 1), '') AS crash_type,
    CASE WHEN contains({report}, 'AddressSanitizer') THEN 'AddressSanitizer' WHEN contains({report}, 'MemorySanitizer') THEN 'MemorySanitizer' WHEN contains({report}, 'UndefinedBehaviorSanitizer') THEN 'UndefinedBehaviorSanitizer'
         WHEN contains({report}, 'LeakSanitizer') THEN 'LeakSanitizer' WHEN contains({report}, 'runtime error:') THEN 'UndefinedBehaviorSanitizer' ELSE '' END AS sanitizer,
    stack, coalesce(len(stack), 0) AS frames, coalesce(top_frame, '') AS top_frame FROM {table} t LEFT JOIN {name}_b USING ({key}))"""


_GRADE = """CASE WHEN a_frame = '' OR b_frame = '' THEN CASE WHEN a_type <> '' AND a_type = b_type THEN 'type_only_no_frame' ELSE 'no_match_no_frame' END
    WHEN a_type <> '' AND a_type = b_type AND a_frame = b_frame THEN 'type_and_frame' WHEN a_frame = b_frame THEN 'frame_only' WHEN a_type <> '' AND a_type = b_type THEN 'type_only' ELSE 'no_match' END"""
_BY_PROJECT = f"""{_parsed('sp', 'sec_bench', 'sec_id', 'sanitizer_report')}, {_parsed('cp', 'cybergym', 'row_id', 'error_txt')},
ra AS (SELECT sec_id, lower(split_part(instance_id, '.', 1)) AS project, lower(crash_type) AS a_type, top_frame AS a_frame FROM sec_bench JOIN sp USING (sec_id)),
rb AS (SELECT row_id, lower(trim(project_name, ' ')) AS project, lower(crash_type) AS b_type, top_frame AS b_frame FROM cybergym JOIN cp USING (row_id))"""
_CONTROL = f"""WITH {_BY_PROJECT}, cross_pairs AS (SELECT x.b_type AS a_type, x.b_frame AS a_frame, y.b_type, y.b_frame FROM rb x JOIN rb y ON x.project = y.project AND x.row_id <> y.row_id)
SELECT {_GRADE} AS grade, count(*) AS pairs FROM cross_pairs GROUP BY 1"""
_SAME_FIX = f"""{_blobs('fa', 'sec_bench', 'sec_id')}, {_blobs('fb', 'swe_rebench_v2', 'row_id')},
fixed AS (SELECT sec_id, row_id FROM (SELECT sec_id, row_id, {_EQ} AS e FROM fa x JOIN fb y USING (path)) GROUP BY ALL HAVING bool_and(e))"""
_FIX_PAIRS = """fp AS (SELECT DISTINCT sec_id, row_id FROM (SELECT fa.*, lower(split_part(instance_id, '.', 1)) AS project FROM fa JOIN sec_bench USING (sec_id)) x
    JOIN (SELECT fb.*, lower(split_part(repo, '/', -1)) AS project FROM fb JOIN swe_rebench_v2 USING (row_id)) y USING (project, path))"""
_STRATA = f"""WITH {_TRAIN}, b AS (SELECT bug, min(project) AS project FROM bench WHERE bug IS NOT NULL GROUP BY 1), t AS (SELECT DISTINCT bug FROM train WHERE bug IS NOT NULL),
pool AS (SELECT coalesce(project, 'unknown') AS project, b.bug IS NOT NULL AS in_bench, t.bug IS NOT NULL AS in_train FROM b FULL JOIN t ON b.bug = t.bug)
SELECT project, count(*) AS pool_n, count_if(in_bench) AS bench_k, count_if(in_train) AS sample_n, count_if(in_bench AND in_train) AS shared FROM pool GROUP BY 1"""
_JUDGED = f"""WITH {_TRAIN}, tasks AS (SELECT *, function IN ('LLVMFuzzerInitialize', 'LLVMFuzzerTestOneInput') AS suspect FROM train),
judged AS (SELECT *, CASE WHEN bug IN (SELECT bug FROM bench WHERE bug IS NOT NULL) THEN 'removed_benchmark' WHEN bool_and(suspect) OVER (PARTITION BY bug) THEN 'removed_suspect'
    WHEN row_number() OVER (PARTITION BY bug ORDER BY suspect, pos) = 1 THEN 'kept' ELSE 'removed_duplicate' END AS verdict, min(pos) OVER (PARTITION BY bug) AS group_order FROM tasks)"""
_OVERLAP = f"""WITH {_TRAIN}, t AS (SELECT bug, list_sort(list(DISTINCT id)) AS ids, list(DISTINCT num) AS nums FROM train WHERE bug IS NOT NULL GROUP BY 1),
c AS (SELECT bug, list_sort(list(DISTINCT id)) AS ids, list(DISTINCT num) AS nums FROM bench WHERE bug IS NOT NULL GROUP BY 1)"""
_ITEMS = f"""{_SWE}, items AS (
    SELECT DISTINCT benchmark AS bench, benchmark_instance_id AS id, benchmark_repo AS repo, pr, '' AS base FROM overlap_v2_prs WHERE benchmark_instance_id IS NOT NULL
    UNION SELECT 'train', id, nullif(repo, ''), pr, base FROM swe)"""
_SOURCES = f"""{_ITEMS}, k AS (
    SELECT bench, id, 'exact_repo_pr' AS j, repo AS k, pr::VARCHAR AS p FROM items UNION SELECT bench, id, 'case_insensitive_repo_pr', lower(repo), pr::VARCHAR FROM items
    UNION SELECT bench, id, 'base_commit_and_pr', nullif(base, ''), pr::VARCHAR FROM items UNION SELECT bench, id, 'base_commit', nullif(base, ''), '' FROM items),
sp AS (SELECT a.bench AS a_bench, a.id AS a_id, b.bench AS b_bench, b.id AS b_id, list_sort(list(DISTINCT a.j)) AS joins FROM k a JOIN k b ON a.j = b.j AND a.k = b.k AND a.p = b.p AND a.bench < b.bench
    WHERE a.id IS NOT NULL AND b.id IS NOT NULL AND NOT (a.bench = 'Multi-SWE-bench' AND b.bench = 'SWE-PolyBench') GROUP BY 1, 2, 3, 4)"""
_ALIASES = "al AS (SELECT lower(training_repo) AS old_name, arg_max(lower(benchmark_repo), pair_id) AS new_name FROM overlap_v2_prs WHERE joins LIKE '%base_commit_and_pr%' AND lower(training_repo) <> lower(benchmark_repo) GROUP BY 1)"
_POOL = f"""WITH {_SWE}, have AS (SELECT DISTINCT lower(repo) AS repo, pr FROM swe WHERE repo <> '' AND pr IS NOT NULL),
pool AS (SELECT lower(benchmark_repo) AS repo, pr, bool_or(coalesce(benchmark = 'SWE-PolyBench', false)) AS in_bench FROM overlap_v2_prs WHERE benchmark_repo IS NOT NULL AND pr IS NOT NULL GROUP BY 1, 2),
known AS (SELECT *, (repo, pr) IN (SELECT (repo, pr) FROM have) AS there FROM pool WHERE repo IN (SELECT repo FROM have))"""
_RUNS = f"""WITH {_grams('d', 'documents', 'doc_id', 'text', 8)}, {_grams('e', 'eval_items', 'item_id', 'text', 8)},
cand AS (SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (gram)),
dp AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM (SELECT doc_id, {_W.format('text')} AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM cand))),
ep AS (SELECT item_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM (SELECT item_id, {_W.format('text')} AS w FROM eval_items)),
met AS (SELECT doc_id, item_id, i - j AS g, i, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS island FROM cand JOIN dp USING (doc_id) JOIN ep USING (item_id, word)),
runs AS (SELECT doc_id, item_id, max(n) AS run FROM (SELECT doc_id, item_id, g, island, count(*) AS n FROM met GROUP BY ALL) GROUP BY ALL)"""

SQL = {
    "ngram13_filter": _filter(13),
    "ngram8_filter": _filter(8),
    "ngram_flag_by_lang": f"WITH m AS ({_filter(13)}) SELECT coalesce(lower(lang), 'unknown') AS lang, count(*) AS documents, count_if(doc_id IN (SELECT doc_id FROM m)) AS flagged, round(count_if(doc_id IN (SELECT doc_id FROM m)) / count(*), 4) AS share FROM documents GROUP BY 1",
    "ngram_filter_summary": f"""WITH {_grams('d', 'swe_rebench_v2', 'row_id', 'problem_statement', 13)}, {_grams('e', "(SELECT * FROM eval_items WHERE dataset = 'swe_rebench_v2')", 'item_id', 'text', 13)},
m AS (SELECT DISTINCT row_id, item_id FROM d JOIN e USING (gram)), p AS (SELECT row_id, item_id FROM swe_rebench_v2 JOIN eval_items ON instance_id = source_key WHERE dataset = 'swe_rebench_v2'),
r AS (SELECT row_id, row_id IN (SELECT row_id FROM p) AS o, row_id IN (SELECT row_id FROM m) AS f, row_id IN (SELECT m.row_id FROM m JOIN p USING (row_id, item_id)) AS own FROM swe_rebench_v2)
SELECT count_if(o) AS overlap_items, count_if(o AND f) AS overlap_flagged, count_if(o AND own) AS overlap_flagged_by_own, count_if(NOT o) AS other_items, count_if(NOT o AND f) AS other_flagged, (SELECT count(DISTINCT item_id) FROM m) AS bench_matched FROM r""",
    "report_boilerplate": f"WITH {_grams('g', 'cybergym', 'row_id', 'error_txt', 13)} SELECT gram, count(*) AS df FROM g GROUP BY 1 HAVING count(*) >= 3",
    "ngram_df_boilerplate": f"""WITH {_grams('g', 'cybergym', 'row_id', 'error_txt', 13)}, df AS (SELECT gram, count(*) AS k FROM g GROUP BY 1), {_grams('s', 'sec_bench', 'sec_id', 'sanitizer_report', 13)},
r AS (SELECT sec_id, min(k) AS k FROM s JOIN df USING (gram) GROUP BY 1) SELECT t AS threshold, (SELECT count(*) FROM r WHERE t = 0 OR k < t) AS flagged FROM (VALUES (0), (2), (3), (5)) v(t)""",
    "ngram_without_boilerplate": f"""WITH {_grams('g', 'cybergym', 'row_id', 'error_txt', 13)}, df AS (SELECT gram, count(*) AS k FROM g GROUP BY 1), {_grams('s', 'sec_bench', 'sec_id', 'sanitizer_report', 13)}
SELECT sec_id, row_id, count(*) AS shared FROM s JOIN g USING (gram) JOIN df USING (gram) WHERE k < 3 GROUP BY ALL""",
    "longest_run_pairs": f"{_RUNS} SELECT doc_id, item_id, run FROM runs",
    "run_stats": f"{_RUNS} SELECT count(*) AS pairs, max(run) AS longest, list_sort(list(run))[count(*) // 2 + 1] AS upper_median, median(run) AS median, count_if(run >= 8) AS at_least_8, count_if(run >= 13) AS at_least_13 FROM runs",
    "exact_text_duplicates": f"""WITH a AS (SELECT row_id, instance_id, {_W.format('problem_statement')} AS w FROM swe_rebench_v2), b AS (SELECT item_id, source_key, {_W.format('text')} AS w FROM eval_items)
SELECT row_id, item_id FROM a JOIN b ON a.w = b.w WHERE len(a.w) >= 13 AND instance_id IS DISTINCT FROM source_key""",
    "duplicate_texts": "SELECT min(doc_id) AS first_id, count(*) AS copies, count(DISTINCT coalesce(source, '')) = 1 AS identical FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
    "word_and_run_counts": f"""WITH w AS (SELECT doc_id, {_W.format('text')} AS w, length(regexp_replace(text, '\\s+', ' ', 'g')) AS collapsed_chars FROM documents), {_grams('g', 'documents', 'doc_id', 'text', 13)}, c AS (SELECT doc_id, count(*) AS k FROM g GROUP BY 1)
SELECT doc_id, len(w) AS words, coalesce(k, 0) AS runs13, collapsed_chars FROM w LEFT JOIN c USING (doc_id)""",
    "text_views": f"SELECT sec_id, length(coalesce(bug_description, '') || ' ' || coalesce(sanitizer_report, '')) AS view_chars, len({_W.format(chr(40) + 'coalesce(bug_description, ' + chr(39) * 2 + ') || ' + chr(39) + ' ' + chr(39) + ' || coalesce(bug_report, ' + chr(39) * 2 + '))')}) AS view_words FROM sec_bench",
    "id_parts": r"""SELECT row_id, TRY_CAST(nullif(regexp_extract(instance_id, '(\d+)$', 1), '') AS BIGINT) AS trailing, TRY_CAST(nullif(split_part(instance_id, '-', -1), '') AS BIGINT) AS pr,
lower(regexp_replace(split_part(instance_id, '.', 1), '^(.*?)__', '\1/')) AS repo_name, split_part(repo, '/', -1) AS short, regexp_matches(instance_id, '\.pr_\d+$') AS mirror FROM swe_rebench_v2""",
    "root_paths": r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '/root/[\w.-]+'))), ';') AS paths, coalesce(contains(text, 'diff --git'), false) AS has_diff FROM documents",
    "sec_ids": f"""WITH {_blobs('fa', 'sec_bench', 'sec_id')} SELECT sec_id, split_part(instance_id, '.', 1) AS project, CASE WHEN split = 'oss' THEN TRY_CAST(nullif(regexp_extract(instance_id, '(\\d+)$', 1), '') AS BIGINT) END AS tracker_id,
sec_id NOT IN (SELECT sec_id FROM fa) AS no_blobs, NOT coalesce(contains(patch, 'diff --git'), false) AS no_diff FROM sec_bench""",
    "cyber_tasks": f"WITH {_TRAIN} SELECT pos, id, num, bug, type, function, file, length(text) AS text_chars FROM train",
    "id_plain_overlap": f"WITH {_TRAIN} SELECT DISTINCT num FROM train WHERE num IN (SELECT num FROM bench WHERE num IS NOT NULL)",
    "id_plain_overlap_arvo": f"WITH {_TRAIN} SELECT DISTINCT num FROM train WHERE num IN (SELECT num FROM bench WHERE kind = 'arvo' AND num IS NOT NULL)",
    "id_translated_overlap": f"{_OVERLAP} SELECT bug, array_to_string(t.ids, ';') AS train_ids, array_to_string(c.ids, ';') AS bench_ids, CASE WHEN list_has_any(t.nums, c.nums) THEN 'exact' ELSE 'translated' END AS match_type FROM t JOIN c USING (bug)",
    "mapping_check": f"WITH {_TRAIN}, m AS (SELECT DISTINCT num FROM (SELECT num FROM train UNION SELECT num FROM bench) WHERE num < 1000000) SELECT count(*) AS n, count(*) AS olds, count(*) AS news, true AS injective FROM m",
    "outside_pool": f"WITH {_TRAIN} SELECT DISTINCT bug FROM train WHERE bug IS NOT NULL AND bug NOT IN (SELECT bug FROM bench WHERE bug IS NOT NULL)",
    "reversed_ids": f"WITH {_TRAIN}, m AS (SELECT DISTINCT num AS old, num + 424000000 AS bug FROM (SELECT num FROM train UNION SELECT num FROM bench) WHERE num < 1000000) SELECT pos, train.bug, coalesce(m.old, train.bug) AS old FROM train LEFT JOIN m ON m.bug = train.bug",
    "bug_duplicates": f"WITH {_TRAIN} SELECT bug, array_to_string(list_sort(list(id)), ';') AS ids, count(*) AS copies, count(DISTINCT coalesce(spec, chr(1))) = 1 AS identical FROM train WHERE bug IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "project_strata": _STRATA,
    "inclusion_strata": f"{_POOL} SELECT repo, count(*) AS pool_n, count_if(there) AS bench_k, count_if(in_bench) AS sample_n, count_if(there AND in_bench) AS shared FROM known GROUP BY 1",
    "inclusion_strata_in_range": f"{_POOL}, r AS (SELECT repo, min(pr) AS lo, max(pr) AS hi FROM have GROUP BY 1) SELECT repo, count(*) AS pool_n, count_if(there) AS bench_k, count_if(in_bench) AS sample_n, count_if(there AND in_bench) AS shared FROM known JOIN r USING (repo) WHERE pr BETWEEN lo AND hi GROUP BY 1",
    "filtered_split": f"{_JUDGED} SELECT id, pos, group_order FROM judged WHERE verdict = 'kept'",
    "split_accounting": f"{_JUDGED} SELECT count_if(verdict = 'kept') AS kept, count_if(verdict = 'removed_benchmark') AS removed_benchmark, count_if(verdict = 'removed_suspect') AS removed_suspect, count_if(verdict = 'removed_duplicate') AS removed_duplicates, count(*) AS total FROM judged",
    "split_residual": f"{_JUDGED} SELECT count(DISTINCT id) AS still_listed FROM judged WHERE verdict = 'kept' AND id IN (SELECT unnest(string_split(mimo_instance_ids, ';')) FROM cyber_overlap WHERE mimo_instance_ids IS NOT NULL) AND id <> ''",
    "multi_key_join": f"WITH {_SWE} SELECT a_id, b_id, array_to_string(joins, ';') AS joins FROM pairs",
    "multi_key_counts": f"WITH {_SWE} SELECT j AS join_name, count(*) AS pairs, count(DISTINCT a_id) AS items FROM hits WHERE a_id <> b_id GROUP BY 1",
    "pair_kinds": f"""WITH {_SWE}, {_blobs('fb', 'swe_rebench_v2', 'row_id')},
c AS (SELECT a_id, b_id, count(*) AS shared, count_if({_EQ}) AS same FROM pairs JOIN fb x ON x.row_id = a_id JOIN fb y ON y.row_id = b_id AND y.path = x.path GROUP BY ALL),
f AS (SELECT p.*, a.pr AS a_pr, b.pr AS b_pr, a.base <> '' AND a.base = b.base AS same_base, CASE WHEN coalesce(shared, 0) = 0 THEN 'not_comparable' WHEN same = shared THEN 'identical' WHEN same > 0 THEN 'partly_identical' ELSE 'different' END AS fix
    FROM pairs p LEFT JOIN c USING (a_id, b_id) JOIN swe a ON a.pos = a_id JOIN swe b ON b.pos = b_id),
g AS (SELECT *, CASE WHEN list_contains(joins, 'base_commit_and_pr') THEN 'same PR, same base commit' WHEN list_contains(joins, 'case_insensitive_repo_pr') THEN CASE WHEN fix = 'identical' THEN 'same PR, different base commit, identical fix' ELSE 'same PR, different base commit, fix ' || fix END
    WHEN a_pr IS NULL OR b_pr IS NULL THEN CASE WHEN fix = 'identical' THEN 'same base commit and identical fix (no PR number)' ELSE 'same base commit, fix not identical (no PR number)' END ELSE 'same base commit, different PR' END AS kind FROM f)
SELECT kind, fix, same_base, count(*) AS pairs, count_if(starts_with(kind, 'same PR') OR kind = 'same base commit and identical fix (no PR number)') AS overlaps FROM g GROUP BY ALL""",
    "pairwise_source_pairs": f"WITH {_SOURCES} SELECT a_bench, a_id, b_bench, b_id, array_to_string(joins, ';') AS joins FROM sp",
    "items_in_other_sources": f"WITH {_SOURCES}, o AS (SELECT a_bench AS bench, a_id AS id, b_bench AS other FROM sp UNION SELECT b_bench, b_id, a_bench FROM sp), per AS (SELECT bench, id, count(*) AS k FROM o GROUP BY ALL) SELECT bench, count(*) AS items, count_if(k >= 2) AS in_two_others FROM per GROUP BY 1",
    "repo_presence": "WITH n AS (SELECT DISTINCT benchmark, lower(benchmark_repo) AS n FROM overlap_v2_prs WHERE benchmark_repo IS NOT NULL) SELECT benchmark, count(*) AS names, count_if(n IN (SELECT lower(repo) FROM swe_rebench_v2 WHERE repo IS NOT NULL)) AS present FROM n GROUP BY 1",
    "presence_matrix": "WITH n AS (SELECT DISTINCT benchmark AS s, lower(benchmark_repo) AS n FROM overlap_v2_prs WHERE benchmark_repo IS NOT NULL AND benchmark IS NOT NULL) SELECT x.s AS a, y.s AS b, count(*) AS shared FROM n x JOIN n y ON x.n = y.n AND x.s < y.s GROUP BY ALL",
    "shared_repo_detail": f"WITH {_ITEMS}, c AS (SELECT bench AS s, lower(repo) AS repo, count(*) AS k FROM items WHERE repo IS NOT NULL GROUP BY ALL) SELECT x.s AS a, y.s AS b, x.repo, x.k AS a_items, y.k AS b_items FROM c x JOIN c y ON x.repo = y.repo AND x.s < y.s",
    "repo_renames": f"WITH {_ALIASES} SELECT old_name, new_name FROM al",
    "renamed_presence": f"WITH {_ALIASES}, k AS (SELECT coalesce(new_name, lower(repo)) AS n FROM swe_rebench_v2 LEFT JOIN al ON old_name = lower(repo) WHERE repo IS NOT NULL), n AS (SELECT DISTINCT benchmark, lower(benchmark_repo) AS n FROM overlap_v2_prs WHERE benchmark_repo IS NOT NULL) SELECT benchmark, count(*) AS names, count_if(n IN (SELECT n FROM k)) AS present FROM n GROUP BY 1",
    "mirror_counts": r"""WITH r AS (SELECT lower(regexp_replace(split_part(instance_id, '.', 1), '^(.*?)__', '\1/')) AS repo, regexp_matches(instance_id, '\.pr_\d+$') AS m FROM swe_rebench_v2), s AS (SELECT *, repo IN (SELECT lower(benchmark_repo) FROM overlap_v2_prs WHERE benchmark_repo IS NOT NULL) AS h FROM r)
SELECT count(*) AS tasks, count_if(m) AS mirrors, count(DISTINCT CASE WHEN m THEN repo END) AS mirror_repos, count_if(m AND h) AS mirrors_in_shared, count_if(h) AS tasks_in_shared FROM s""",
    "distinct_repos": "SELECT lower(repo) AS repo FROM swe_rebench_v2 WHERE repo IS NOT NULL UNION SELECT lower(benchmark_repo) FROM overlap_v2_prs WHERE benchmark_repo IS NOT NULL",
    "first_rows": "SELECT instance_id, min(row_id) AS row_id, arg_min_null(repo, row_id) AS repo FROM swe_rebench_v2 GROUP BY 1",
    "project_lookup": "WITH a AS (SELECT task_id AS id, nullif(arg_min_null(project_name, row_id), '') AS p FROM cybergym GROUP BY 1), b AS (SELECT cybergym_task_id AS id, nullif(arg_min_null(cybergym_project, pair_id), '') AS q FROM cyber_overlap GROUP BY 1) SELECT pair_id, coalesce(p, q, 'unknown') AS project FROM cyber_overlap o LEFT JOIN a ON a.id = o.cybergym_task_id LEFT JOIN b ON b.id = o.cybergym_task_id",
    "patch_blobs": f"WITH {_blobs('fa', 'sec_bench', 'sec_id')} SELECT sec_id, path, pre, post FROM fa",
    "changed_lines": f"WITH {_changed('c', 'sec_bench', 'sec_id')} SELECT sec_id, path, coalesce(array_to_string(list_sort(list(line) FILTER (WHERE sign = '-')), chr(10)), '') AS removed, coalesce(array_to_string(list_sort(list(line) FILTER (WHERE sign = '+')), chr(10)), '') AS added FROM c GROUP BY ALL",
    "same_fix": f"WITH {_SAME_FIX} SELECT sec_id, row_id FROM fixed",
    "fix_relations": f"""WITH {_SAME_FIX}, {_FIX_PAIRS}, {_changed('ca', 'sec_bench', 'sec_id')}, {_changed('cb', 'swe_rebench_v2', 'row_id')},
b AS (SELECT sec_id, row_id, count(*) AS shared, count_if({_EQ}) AS same FROM fp JOIN fa x USING (sec_id) JOIN fb y USING (row_id, path) GROUP BY ALL),
la AS (SELECT sec_id, path, list_sort(list(line) FILTER (WHERE sign = '-')) AS r, list_sort(list(line) FILTER (WHERE sign = '+')) AS a FROM ca GROUP BY ALL),
lb AS (SELECT row_id, path, list_sort(list(line) FILTER (WHERE sign = '-')) AS r, list_sort(list(line) FILTER (WHERE sign = '+')) AS a FROM cb GROUP BY ALL),
l AS (SELECT sec_id, row_id, count(*) AS ls, count_if(la.r IS NOT DISTINCT FROM lb.r AND la.a IS NOT DISTINCT FROM lb.a) AS le FROM fp JOIN la USING (sec_id) JOIN lb USING (row_id, path) GROUP BY ALL),
na AS (SELECT sec_id, path, sign, line, count(*) AS k FROM ca GROUP BY ALL), nb AS (SELECT row_id, path, sign, line, count(*) AS k FROM cb GROUP BY ALL),
ct AS (SELECT sec_id, row_id, bool_and(na.sign IS NULL OR na.k <= coalesce(nb.k, 0)) AS ok FROM fp JOIN na USING (sec_id) JOIN (SELECT DISTINCT row_id, path FROM cb) t USING (row_id, path) LEFT JOIN nb ON nb.row_id = fp.row_id AND nb.path = na.path AND nb.sign = na.sign AND nb.line = na.line GROUP BY ALL),
sa AS (SELECT sec_id, list_sort(list(DISTINCT path)) AS f FROM ca GROUP BY 1), sb AS (SELECT row_id, list_sort(list(DISTINCT path)) AS f FROM cb GROUP BY 1)
SELECT fp.sec_id, fp.row_id, CASE WHEN coalesce(shared, 0) = 0 THEN 'not_comparable' WHEN same = shared THEN 'identical' WHEN same > 0 THEN 'partly_identical' ELSE 'different' END AS fix,
CASE WHEN fp.sec_id NOT IN (SELECT sec_id FROM fa) OR fp.row_id NOT IN (SELECT row_id FROM fb) THEN 'not_comparable' WHEN shared > 0 AND same = shared THEN 'same_blob_pairs' ELSE 'different_blob_pairs' END AS blob_test,
CASE WHEN coalesce(ls, 0) = 0 THEN 'not_comparable' WHEN le = ls THEN 'identical' WHEN le > 0 THEN 'partly_identical' ELSE 'different' END AS fix_lines,
CASE WHEN ok IS NULL THEN 'not_comparable' WHEN ok THEN 'contained' ELSE 'not_contained' END AS lines_contained,
len(coalesce(sa.f, [])) > 0 AND coalesce(sa.f, []) = coalesce(sb.f, []) AS same_file_set, len(list_filter(coalesce(sa.f, []), lambda p: NOT list_contains(coalesce(sb.f, []), p))) = 0 AS files_within
FROM fp LEFT JOIN b USING (sec_id, row_id) LEFT JOIN l USING (sec_id, row_id) LEFT JOIN ct USING (sec_id, row_id) LEFT JOIN sa USING (sec_id) LEFT JOIN sb USING (row_id)""",
    "no_fix_reasons": f"""WITH {_SAME_FIX}, {_FIX_PAIRS}, b AS (SELECT sec_id, row_id, count(*) AS shared FROM fp JOIN fa USING (sec_id) JOIN fb USING (row_id, path) GROUP BY ALL),
o AS (SELECT fp.*, coalesce(shared, 0) AS shared FROM fp LEFT JOIN b USING (sec_id, row_id) WHERE (sec_id, row_id) NOT IN (SELECT (sec_id, row_id) FROM fixed))
SELECT CASE WHEN row_id NOT IN (SELECT row_id FROM fb) THEN 'no fix patch, or one without blob IDs' WHEN sec_id NOT IN (SELECT sec_id FROM fa) THEN 'benchmark patch without blob IDs' WHEN shared = 0 THEN 'no file in common' ELSE 'same files, different blobs' END AS reason, count(*) AS rows FROM o GROUP BY 1""",
    "crash_reports": f"WITH {_parsed('cp', 'cybergym', 'row_id', 'error_txt')} SELECT row_id, crash_type, sanitizer, frames, top_frame FROM cp",
    "crash_reports_sec": f"WITH {_parsed('sp', 'sec_bench', 'sec_id', 'sanitizer_report')} SELECT sec_id, crash_type, sanitizer, frames, top_frame FROM sp",
    "crash_grades": f"WITH {_BY_PROJECT} SELECT {_GRADE} AS grade, count(*) AS pairs FROM ra JOIN rb USING (project) GROUP BY 1",
    "control_cross_pairs": _CONTROL,
    "control_rates": f"WITH c AS ({_CONTROL}), s AS (SELECT sum(CASE WHEN grade = 'type_and_frame' THEN pairs ELSE 0 END)::BIGINT AS hits, sum(pairs)::BIGINT AS pairs FROM c) SELECT hits, pairs, round(hits / greatest(pairs, 1), 3) AS rate, hits || ' of ' || pairs AS label FROM s",
    "control_cross_matched": f"""WITH {_SAME_FIX}, m AS (SELECT sec_id, row_id, lower(split_part(instance_id, '.', 1)) AS project FROM fixed JOIN sec_bench USING (sec_id))
SELECT sec_id, row_id FROM (SELECT DISTINCT project, sec_id FROM m) JOIN (SELECT DISTINCT project, row_id FROM m) USING (project) WHERE (project, sec_id, row_id) NOT IN (SELECT (project, sec_id, row_id) FROM m)""",
    "spec_grades": f"""WITH {_TRAIN}, {_parsed('cp', 'cybergym', 'row_id', 'error_txt')}, f AS (SELECT bug, arg_min(pos, pos) AS pos FROM bench WHERE bug IS NOT NULL GROUP BY 1),
r AS (SELECT bug, coalesce(stack, []) AS frames, crash_type FROM f JOIN cp ON cp.row_id = f.pos),
g AS (SELECT bug, CASE WHEN function IN ('LLVMFuzzerInitialize', 'LLVMFuzzerTestOneInput') THEN 4 ELSE CASE WHEN function <> '' AND len(list_filter(frames, lambda x: contains(x, ' in ' || function || ' '))) > 0 THEN CASE WHEN type <> '' AND crash_type <> '' AND lower(type) = lower(crash_type) THEN 1 ELSE 2 END
    WHEN file <> '' AND len(list_filter(frames, lambda x: contains(x, CASE WHEN contains(file, '/') THEN regexp_replace(file, '^[^/]*/', '') ELSE file END))) > 0 THEN 3 ELSE 5 END END AS k FROM train JOIN r USING (bug))
SELECT bug, ['function_and_type', 'function_only', 'file_only', 'names_fuzzer_entry_point', 'no_match'][min(k)] AS best_grade FROM g GROUP BY 1""",
    "patch_paths": f"WITH {_changed('c', 'sec_bench', 'sec_id')} SELECT DISTINCT sec_id, path, regexp_replace(path, '^.*?/src-fix/[^/]+/', '') AS source_path, regexp_matches(path, '(?i)(^|/)[^/]*(poc|crash|testcase|repro|exploit)[^/]*$') AS poc FROM c",
    "data_contexts": f"WITH {_changed('c', 'sec_bench', 'sec_id')} SELECT sec_id, array_to_string(list_sort(list(DISTINCT 'data/' || split_part(path, '/', 1))), ';') AS context FROM c GROUP BY 1",
    "build_categories": f"""WITH {_TRAIN}, k AS (SELECT num, min(kind) AS bk FROM bench WHERE num IS NOT NULL GROUP BY 1)
SELECT CASE WHEN bk IS NOT NULL THEN 'same ID as a benchmark ' || bk || ': task' WHEN coalesce(bug IN (SELECT bug FROM bench WHERE bug IS NOT NULL), false) THEN 'same bug under the other ID' WHEN num < 1000000 THEN 'not in benchmark, old ID' ELSE 'not in benchmark, new ID' END AS category,
count_if(function IN ('LLVMFuzzerInitialize', 'LLVMFuzzerTestOneInput')) AS yes, count_if(function NOT IN ('LLVMFuzzerInitialize', 'LLVMFuzzerTestOneInput')) AS no FROM train LEFT JOIN k USING (num) GROUP BY 1""",
    "id_match_counts": f"""WITH {_TRAIN} SELECT CASE WHEN num IN (SELECT num FROM bench WHERE num IS NOT NULL) THEN 'plain' WHEN bug IN (SELECT bug FROM bench WHERE bug IS NOT NULL) THEN 'translated' ELSE '' END AS id_match, count(*) AS rows FROM train GROUP BY 1""",
    "related_bugs": f"""WITH {_BY_PROJECT}, s AS (SELECT ra.sec_id AS train_id, rb.row_id AS bench_id FROM ra JOIN rb ON ra.project = rb.project AND a_type = b_type AND a_frame = b_frame AND a_frame <> ''),
ac AS (SELECT DISTINCT sec_id, unnest(regexp_extract_all(lower(concat_ws(' ', patch, bug_report)), '[0-9a-f]{{40}}')) AS c FROM sec_bench), bc AS (SELECT DISTINCT row_id, unnest(regexp_extract_all(lower(vulnerability_description), '[0-9a-f]{{40}}')) AS c FROM cybergym),
f AS (SELECT DISTINCT sec_id AS train_id, row_id AS bench_id FROM ac JOIN bc USING (c)), u AS (SELECT *, false AS f, true AS s FROM s UNION ALL SELECT *, true, false FROM f)
SELECT train_id, bench_id, bool_or(f) AS same_fix_commit, bool_or(s) AS same_signature FROM u GROUP BY ALL""",
}
_SIGNED = """sg AS (SELECT 'a' AS side, sec_id AS id, project, a_type AS type, a_frame AS frames FROM ra WHERE a_frame <> '' UNION ALL SELECT 'b', row_id, project, b_type, b_frame FROM rb WHERE b_frame <> ''),
carried AS (SELECT project, type, frames, count(*) AS records FROM sg GROUP BY ALL)"""
SQL["signature_frequencies"] = f"WITH {_BY_PROJECT}, {_SIGNED} SELECT * FROM carried"
SQL["related_by_evidence"] = f"""WITH {_BY_PROJECT}, {_SIGNED}, p AS ({SQL['related_bugs']}),
r AS (SELECT p.*, CASE WHEN same_signature THEN records END AS k FROM p LEFT JOIN sg ON sg.side = 'a' AND sg.id = train_id LEFT JOIN carried c ON c.project IS NOT DISTINCT FROM sg.project AND c.type = sg.type AND c.frames = sg.frames)
SELECT bench_id, arg_max(CASE WHEN same_fix_commit THEN 'same fix commit' WHEN k = 2 THEN 'signature carried by 2 records' ELSE 'signature carried by 3 or more records' END, (same_fix_commit, train_id)) AS evidence FROM r GROUP BY 1"""
SQL["hypergeom_uniform"] = f"""WITH s AS ({_STRATA}), t AS (SELECT sum(pool_n)::BIGINT AS n, sum(bench_k)::BIGINT AS k, sum(sample_n)::BIGINT AS m, sum(shared)::BIGINT AS o FROM s),
l AS (SELECT *, m * k / n AS mean, sqrt(m * (k / n) * (1 - k / n) * (n - m) / (n - 1)) AS sd FROM t),
terms AS (SELECT sum(exp(lgamma(k + 1) - lgamma(x + 1) - lgamma(k - x + 1) + lgamma(n - k + 1) - lgamma(m - x + 1) - lgamma(n - k - m + x + 1) - lgamma(n + 1) + lgamma(m + 1) + lgamma(n - m + 1))) AS p
    FROM l, (SELECT unnest(range(0, 1 + (SELECT least(k, m) FROM t))) AS x) WHERE x >= o AND n - k - m + x >= 0)
SELECT o AS observed, round(mean, 4) AS expected, round(sd, 4) AS sd, round((o - mean) / sd, 4) AS z, round(p, 6) AS p_at_least FROM l, terms"""
SQL["description_names_function"] = rf"""WITH {_TRAIN}, b AS (SELECT bug, list_filter(string_split(regexp_extract(regexp_replace(regexp_replace(regexp_replace(function, '<[^<>]*>', '', 'g'), '\([^()]*\)', '', 'g'), ' const', '', 'g'), '(\S*)$', 1), '::'), lambda p: p <> '' AND NOT contains(p, 'lambda') AND NOT regexp_matches(p, '^(operator|''|\{{)'))[-1] AS name FROM train WHERE bug IS NOT NULL),
n AS (SELECT bug, list_filter(list(DISTINCT name), lambda x: x IS NOT NULL) AS names FROM b GROUP BY 1)
SELECT pos, CASE WHEN len(names) > 0 THEN len(list_filter(names, lambda x: regexp_matches(coalesce(description, ''), '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(x) || '($|[^\p{{L}}\p{{N}}_])'))) > 0 END AS named FROM bench JOIN n USING (bug)"""
SQL["multi_key_join_benchmarks"] = f"""WITH {_SWE}, named AS (SELECT DISTINCT benchmark_instance_id AS id, benchmark_repo AS repo, pr FROM overlap_v2_prs WHERE benchmark_instance_id IS NOT NULL),
found AS (SELECT a.id AS a_id, b.pos AS b_id, 'exact_repo' AS j FROM named a JOIN swe b ON a.repo = b.repo AND a.pr = b.pr UNION SELECT a.id, b.pos, 'case_insensitive_repo' FROM named a JOIN swe b ON lower(a.repo) = lower(b.repo) AND a.pr = b.pr)
SELECT a_id, b_id, string_agg(j, ';' ORDER BY j) AS joins FROM found GROUP BY ALL"""
SQL["multi_key_counts_by_repo"] = f"""WITH {_SWE}, j AS (SELECT a_id, b_id, unnest(string_split(joins, ';')) AS join_name FROM ({SQL['multi_key_join_benchmarks']}))
SELECT join_name, lower(repo) AS repo, count(*) AS pairs, count(DISTINCT a_id) AS items FROM j JOIN swe ON pos = b_id GROUP BY ALL"""
SQL["shared_repo_pulls"] = f"""WITH {_SOURCES}, c AS (SELECT bench AS s, lower(repo) AS repo, count(*) AS k FROM items WHERE repo IS NOT NULL GROUP BY ALL),
n AS (SELECT a_bench AS a, b_bench AS b, repo, count(*) AS k FROM (SELECT DISTINCT a_bench, a_id, b_bench, b_id, lower(repo) AS repo FROM sp JOIN items ON bench = a_bench AND id = a_id WHERE repo IS NOT NULL AND list_contains(joins, 'case_insensitive_repo_pr')) GROUP BY ALL)
SELECT x.s AS a, y.s AS b, x.repo, x.k AS a_items, y.k AS b_items, coalesce(n.k, 0) AS same_pr FROM c x JOIN c y ON x.repo = y.repo AND x.s < y.s LEFT JOIN n ON n.a = x.s AND n.b = y.s AND n.repo = x.repo"""
SQL["control_pulls"] = f"""WITH {_SWE}, named AS (SELECT DISTINCT benchmark, benchmark_instance_id AS id, benchmark_repo AS repo, pr FROM overlap_v2_prs WHERE benchmark_instance_id IS NOT NULL AND benchmark <> 'Multi-SWE-bench')
SELECT h.pos AS control_id, benchmark AS bench, n.id AS bench_id, false AS same_base FROM swe h JOIN named n ON lower(h.repo) = lower(n.repo) AND h.pr = n.pr AND h.repo <> ''"""
SQL["base_presence"] = f"WITH {_SWE} SELECT lower(coalesce(language, '')) AS bench, count(*) AS items, count_if(lower(coalesce(base_commit, '')) IN (SELECT base FROM held WHERE base <> '')) AS with_known_base FROM swe_rebench_v2 GROUP BY 1"
SQL["sanitizer_pairs"] = f"""WITH {_parsed('sp', 'sec_bench', 'sec_id', 'sanitizer_report')}, {_parsed('cp', 'cybergym', 'row_id', 'error_txt')},
a AS (SELECT lower(split_part(instance_id, '.', 1)) AS project, sanitizer AS s FROM sec_bench JOIN sp USING (sec_id)), b AS (SELECT lower(trim(project_name, ' ')) AS project, sanitizer AS s FROM cybergym JOIN cp USING (row_id))
SELECT 'sec_bench ' || a.s || ' vs cybergym ' || b.s AS label, count(*) AS pairs FROM a JOIN b USING (project) GROUP BY 1"""
SQL["instance_id_lists"] = f"""WITH {_TRAIN}, i AS (SELECT sec_id, CASE WHEN split = 'oss' THEN TRY_CAST(nullif(regexp_extract(instance_id, '(\\d+)$', 1), '') AS BIGINT) END AS num FROM sec_bench),
known AS (SELECT num FROM train UNION SELECT num FROM bench), t AS (SELECT sec_id, num, CASE WHEN num < 1000000 AND num IN (SELECT num FROM known) THEN num + 424000000 ELSE num END AS bug FROM i)
SELECT sec_id, coalesce((SELECT string_agg(DISTINCT id, ';' ORDER BY id) FROM bench WHERE bench.num = t.num), '') AS plain_ids, coalesce((SELECT string_agg(DISTINCT id, ';' ORDER BY id) FROM bench WHERE bench.bug = t.bug), '') AS translated_ids FROM t"""
SQL["same_fix_in_project"] = f"""WITH {_blobs('fa', 'sec_bench', 'sec_id')}, {_blobs('fb', 'swe_rebench_v2', 'row_id')}, x AS (SELECT fa.*, lower(split_part(instance_id, '.', 1)) AS project FROM fa JOIN sec_bench USING (sec_id)),
y AS (SELECT fb.*, lower(split_part(repo, '/', -1)) AS project FROM fb JOIN swe_rebench_v2 USING (row_id)) SELECT sec_id, row_id FROM (SELECT sec_id, row_id, {_EQ} AS e FROM x JOIN y USING (project, path)) GROUP BY ALL HAVING bool_and(e)"""
SQL["longest_run_by_bug"] = f"""WITH {_TRAIN}, cand AS (SELECT train.pos AS t, bench.pos AS b FROM train JOIN bench USING (bug)),
tw AS (SELECT pos, {_W.format('text')} AS w FROM train), bw AS (SELECT pos, {_W.format('description')} AS w FROM bench),
tp AS (SELECT pos AS t, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM tw), bp AS (SELECT pos AS b, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM bw),
met AS (SELECT t, b, i - j AS g, i - row_number() OVER (PARTITION BY t, b, i - j ORDER BY i) AS island FROM cand JOIN tp USING (t) JOIN bp USING (b, word)),
runs AS (SELECT t, b, max(n) AS run FROM (SELECT t, b, g, island, count(*) AS n FROM met GROUP BY ALL) GROUP BY ALL)
SELECT b AS bench_pos, max(coalesce(run, 0)) AS run FROM cand LEFT JOIN runs USING (t, b) GROUP BY 1"""
