"""Joins on alternative keys: translated ids, several keys with their provenance, and all pairs of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(rows: DataFrame, key: str | list[str], order: str, last: bool = False) -> DataFrame:
    """One row per key: the first (or last) in the order of a column that is carried in the data and unique within a key.

    An aggregate, which combines before the shuffle, so that a hot key isn't sorted in one task.
    """
    by = [key] if isinstance(key, str) else list(key)
    rest = [c for c in rows.columns if c not in by]
    pick = F.max_by if last else F.min_by
    return rows.groupBy(*by).agg(pick(F.struct(*rest), F.col(order)).alias("__row")).select(*by, "__row.*").select(*rows.columns)


def translation(rows: DataFrame, old: str, new: str, order: str) -> DataFrame:
    """(old_id, new_id): rows whose stripped cells are both digits; the last new id of an old one counts."""
    clean = lambda c: F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", "")
    digits = rows.where(clean(old).rlike("^[0-9]+$") & clean(new).rlike("^[0-9]+$"))
    cast = digits.select(clean(old).try_cast("bigint").alias("old_id"), clean(new).try_cast("bigint").alias("new_id"), order)
    return cast.where("old_id is not null").groupBy("old_id").agg(F.max_by("new_id", order).alias("new_id"))


def translate(rows: DataFrame, number: str, mapping: DataFrame, to: str = "bug") -> DataFrame:
    """``rows`` with ``to``: the new id of ``number``, or ``number`` itself where the mapping has none."""
    return rows.join(mapping.withColumnRenamed("old_id", number), number, "left").withColumn(to, F.coalesce("new_id", number)).drop("new_id")


def reversed_translation(mapping: DataFrame) -> DataFrame:
    """The mapping from new to old ids; the largest old id where several share a new one."""
    return mapping.groupBy("new_id").agg(F.max("old_id").alias("old")).select(F.col("new_id").alias("old_id"), F.col("old").alias("new_id"))


def plain_overlap(a: DataFrame, b: DataFrame, number: str) -> DataFrame:
    """The numbers that both sides have, whatever the kind of id; null is none."""
    return a.select(number).where(F.col(number).isNotNull()).intersect(b.select(number))


def bug_overlap(train: DataFrame, bench: DataFrame, bug: str = "bug", number: str = "num") -> DataFrame:
    """One row per shared bug: (bug, train_ids, bench_ids, match_type).

    match_type is ``exact`` where some training and benchmark task of the bug have the same number, else ``translated``.
    Both sides have (id, number, bug); lists are sorted.
    """
    side = lambda rows, name: rows.where(F.col(bug).isNotNull()).groupBy(bug).agg(F.array_sort(F.collect_set("id")).alias(f"{name}_ids"), F.collect_set(number).alias(f"{name}_nums"))
    both = side(train, "train").join(side(bench, "bench"), bug)
    kind = F.when(F.arrays_overlap("train_nums", "bench_nums"), "exact").otherwise("translated")
    return both.select(bug, "train_ids", "bench_ids", kind.alias("match_type"))


def id_lists(instances: DataFrame, key: str, number: str, bench: DataFrame, mapping: DataFrame) -> DataFrame:
    """(key, plain_ids, translated_ids): for each instance the benchmark's ids of its own number, and of the bug that the number stands for.

    ``bench`` has (id, num, bug); lists are sorted and empty without a match. An instance whose number is null has none.
    """
    wanted = translate(instances.select(F.col(key), F.col(number).alias("num")), "num", mapping)
    ids = lambda k, to: bench.where(F.col(k).isNotNull()).groupBy(k).agg(F.array_sort(F.collect_set("id")).alias(to))
    none = F.array().cast("array<string>")
    both = wanted.join(ids("num", "plain"), "num", "left").join(ids("bug", "translated"), "bug", "left")
    return both.select(key, F.coalesce("plain", none).alias("plain_ids"), F.coalesce("translated", none).alias("translated_ids"))


def multi_key_join(a: DataFrame, b: DataFrame, keys: dict[str, tuple[list[Column], list[Column]]], a_id: str = "id", b_id: str = "id") -> DataFrame:
    """(a_id, b_id, joins): the pairs that any of the keys finds, with the sorted names of all that do.

    ``keys`` has the name of a join and the columns that must agree on each side; a null in any of them matches nothing.
    Each key is an equi-join of its own, so that no join condition with OR falls back to comparing all pairs.
    """
    parts = []
    for name, (left, right) in keys.items():
        on = [f"k{i}" for i in range(len(left))]
        x = a.select(F.col(a_id).alias("a_id"), *[c.alias(k) for c, k in zip(left, on)]).dropna(subset=on).distinct()
        y = b.select(F.col(b_id).alias("b_id"), *[c.alias(k) for c, k in zip(right, on)]).dropna(subset=on).distinct()
        parts.append(x.join(y, on).select("a_id", "b_id", F.lit(name).alias("j")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.groupBy("a_id", "b_id").agg(F.array_sort(F.collect_set("j")).alias("joins"))


def swe_keys(require_base: bool = True) -> dict[str, tuple[list[Column], list[Column]]]:
    """The keys of pull requests over (repo, pr, base): by name, by name without case, by base commit and number.

    Without ``require_base`` two empty base commits agree, as one of the audits has it.
    """
    base = F.nullif(F.col("base"), F.lit("")) if require_base else F.col("base")
    both = lambda *c: (list(c), list(c))
    return {
        "exact_repo": both(F.col("repo"), F.col("pr")),
        "case_insensitive_repo": both(F.lower("repo"), F.col("pr")),
        "base_commit_and_pr": both(base, F.col("pr")),
    }


def pairwise_sources(items: DataFrame, excluded: list[tuple[str, str]] = ()) -> DataFrame:
    """(a_bench, a_id, b_bench, b_id, joins) over all pairs of sources with a_bench < b_bench, by four keys.

    ``items`` has (bench, id, repo, pr, base); a null key or an empty base commit matches nothing. ``excluded`` pairs of
    sources aren't compared. Rows of one key are joined by an equi-join; only the order of the sources is a residual.
    """
    base = F.nullif(F.col("base"), F.lit(""))
    pr = F.col("pr").cast("string")
    keys = F.array(
        F.struct(F.lit("exact_repo_pr").alias("j"), F.col("repo").alias("k"), pr.alias("p")),
        F.struct(F.lit("case_insensitive_repo_pr").alias("j"), F.lower("repo").alias("k"), pr.alias("p")),
        F.struct(F.lit("base_commit_and_pr").alias("j"), base.alias("k"), pr.alias("p")),
        F.struct(F.lit("base_commit").alias("j"), base.alias("k"), F.lit("").alias("p")),
    )
    keyed = items.select("bench", "id", F.explode(keys).alias("x")).select("bench", "id", "x.*").dropna().distinct()
    side = lambda s: keyed.select(F.col("bench").alias(f"{s}_bench"), F.col("id").alias(f"{s}_id"), "j", "k", "p")
    found = side("a").join(side("b"), ["j", "k", "p"]).where("a_bench < b_bench")
    for x, y in excluded:
        found = found.where(~((F.col("a_bench") == min(x, y)) & (F.col("b_bench") == max(x, y))))
    return found.groupBy("a_bench", "a_id", "b_bench", "b_id").agg(F.array_sort(F.collect_set("j")).alias("joins"))


def pair_kind(joins: Column, pr_a: Column, pr_b: Column, fix: Column) -> Column:
    """How a matched pair is related: the same pull request comes before the same base commit."""
    other = F.concat(F.lit("same PR, different base commit, "), F.when(fix == "identical", "identical fix").otherwise(F.concat(F.lit("fix "), fix)))
    no_number = F.when(fix == "identical", "same base commit and identical fix (no PR number)").otherwise("same base commit, fix not identical (no PR number)")
    return (
        F.when(F.array_contains(joins, "base_commit_and_pr"), "same PR, same base commit")
        .when(F.array_contains(joins, "case_insensitive_repo_pr"), other)
        .when(pr_a.isNull() | pr_b.isNull(), no_number)
        .otherwise("same base commit, different PR")
    )


def is_overlap(kind: Column) -> Column:
    return kind.startswith("same PR") | (kind == "same base commit and identical fix (no PR number)")


def same_base(base_a: Column, base_b: Column) -> Column:
    """Equal base commits of which neither is empty or null."""
    return F.coalesce((base_a != "") & (base_a == base_b), F.lit(False))


def renames(pairs: DataFrame, old: str, new: str, order: str) -> DataFrame:
    """(old_name, new_name): names that matched pairs show to be of one repository; the last of an old name counts."""
    a, b = F.lower(old), F.lower(new)
    return pairs.where(a != b).groupBy(a.alias("old_name")).agg(F.max_by(b, order).alias("new_name"))


def renamed(rows: DataFrame, name: str, aliases: DataFrame, to: str = "known_name") -> DataFrame:
    """``rows`` with the lower-cased name that aliases put in its place."""
    return rows.withColumn("old_name", F.lower(name)).join(aliases, "old_name", "left").withColumn(to, F.coalesce("new_name", "old_name")).drop("old_name", "new_name")


def in_subset(rows: DataFrame, key: str, subset: DataFrame, flag: str) -> DataFrame:
    """``rows`` with a flag for keys that the subset has."""
    marked = subset.select(key).distinct().withColumn(flag, F.lit(True))
    return rows.join(marked, key, "left").fillna(False, [flag])


def known_project(rows: DataFrame, key: str, first: DataFrame, second: DataFrame, project: str = "project") -> DataFrame:
    """``rows`` with a project from the first table that has one which isn't empty, else ``unknown``. Keys are unique there."""
    a = first.select(key, F.nullif(F.col(project), F.lit("")).alias("__a"))
    b = second.select(key, F.nullif(F.col(project), F.lit("")).alias("__b"))
    return rows.join(a, key, "left").join(b, key, "left").withColumn(project, F.coalesce("__a", "__b", F.lit("unknown"))).drop("__a", "__b")


def related(train: DataFrame, bench: DataFrame) -> DataFrame:
    """(train_id, bench_id, same_fix_commit, same_signature): pairs that share a fix commit or a crash signature.

    Both sides have (id, commits array, signature struct or null).
    """
    commits = lambda d, k: d.select(F.col("id").alias(k), F.explode("commits").alias("c")).distinct()
    by_commit = commits(train, "train_id").join(commits(bench, "bench_id"), "c").select("train_id", "bench_id", F.lit(True).alias("f"), F.lit(False).alias("s"))
    signs = lambda d, k: d.where("signature is not null").select(F.col("id").alias(k), F.to_json("signature").alias("g")).distinct()
    by_sign = signs(train, "train_id").join(signs(bench, "bench_id"), "g").select("train_id", "bench_id", F.lit(False).alias("f"), F.lit(True).alias("s"))
    return by_commit.unionByName(by_sign).groupBy("train_id", "bench_id").agg(F.bool_or("f").alias("same_fix_commit"), F.bool_or("s").alias("same_signature"))


def signature_counts(train: DataFrame, bench: DataFrame) -> DataFrame:
    """(signature, records): how many records of both sides carry a crash signature; both have (id, signature struct or null)."""
    both = train.select("signature").unionByName(bench.select("signature")).where("signature is not null")
    return both.groupBy("signature").agg(F.count(F.lit(1)).alias("records"))


def with_records(pairs: DataFrame, train: DataFrame, counts: DataFrame) -> DataFrame:
    """``related`` pairs with ``records``: how many records carry the signature that a pair shares; null where it shares none."""
    signs = train.where("signature is not null").select(F.col("id").alias("train_id"), F.to_json("signature").alias("g")).distinct()
    known = counts.select(F.to_json("signature").alias("g"), "records")
    carried = signs.join(known, "g").groupBy("train_id").agg(F.max("records").alias("carried"))
    return pairs.join(carried, "train_id", "left").withColumn("records", F.when(F.col("same_signature"), F.col("carried"))).drop("carried")


def related_evidence(pairs: DataFrame, order: str) -> DataFrame:
    """(bench_id, evidence): a shared fix commit decides; else the pair that comes last, by how many records carry its signature.

    ``pairs`` has (bench_id, same_fix_commit, records, order).
    """
    kind = F.when(F.col("same_fix_commit"), "same fix commit").when(F.col("records") == 2, "signature carried by 2 records").otherwise("signature carried by 3 or more records")
    return pairs.groupBy("bench_id").agg(F.max_by(kind, F.struct(F.col("same_fix_commit"), F.col(order))).alias("evidence"))


def no_fix_reason(in_release: Column, train_blobs: Column, bench_blobs: Column, shared_files: Column) -> Column:
    """Why a pair of the same issue has no confirmed same fix."""
    return (
        F.when(~in_release, "bug outside the first release")
        .when(train_blobs == 0, "no fix patch, or one without blob IDs")
        .when(bench_blobs == 0, "benchmark patch without blob IDs")
        .when(shared_files == 0, "no file in common")
        .otherwise("same files, different blobs")
    )


def id_match(plain: Column, by_translation: Column) -> Column:
    return F.when(plain, "plain").when(by_translation, "translated").otherwise("")
