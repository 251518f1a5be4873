"""Which names, items and repositories sources share; and control pairs that shouldn't match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def presence(sources: DataFrame, source: str, name: str, reference: DataFrame, reference_name: str) -> DataFrame:
    """(source, names, present): the distinct lower-cased names of each source, and how many the reference has."""
    have = reference.select(F.lower(reference_name).alias("n")).where("n is not null").distinct().withColumn("there", F.lit(True))
    names = sources.select(source, F.lower(name).alias("n")).where("n is not null").distinct().join(have, "n", "left")
    return names.groupBy(source).agg(F.count(F.lit(1)).alias("names"), F.count_if("there").alias("present"))


def matrix(sources: DataFrame, source: str, name: str) -> DataFrame:
    """(a, b, shared): the number of distinct lower-cased names for each two sources that share any; a < b."""
    names = sources.select(F.col(source).alias("s"), F.lower(name).alias("n")).dropna().distinct()
    both = names.withColumnRenamed("s", "a").join(names.withColumnRenamed("s", "b"), "n").where("a < b")
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def in_others(pairs: DataFrame) -> DataFrame:
    """(bench, items, in_two_others): items of a source that pairs (a_bench, a_id, b_bench, b_id) link to other sources."""
    one = pairs.select(F.col("a_bench").alias("bench"), F.col("a_id").alias("id"), F.col("b_bench").alias("other"))
    two = pairs.select(F.col("b_bench").alias("bench"), F.col("b_id").alias("id"), F.col("a_bench").alias("other"))
    per = one.unionByName(two).groupBy("bench", "id").agg(F.count_distinct("other").alias("others"))
    return per.groupBy("bench").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("others") >= 2).alias("in_two_others"))


def repo_detail(items: DataFrame, bench: str, repo: str) -> DataFrame:
    """(a, b, repo, a_items, b_items): the items that two sources have in each repository that they share; a < b."""
    counts = items.select(F.col(bench).alias("s"), F.lower(repo).alias("repo")).dropna().groupBy("s", "repo").agg(F.count(F.lit(1)).alias("k"))
    a = counts.select(F.col("s").alias("a"), "repo", F.col("k").alias("a_items"))
    b = counts.select(F.col("s").alias("b"), "repo", F.col("k").alias("b_items"))
    return a.join(b, "repo").where("a < b").select("a", "b", "repo", "a_items", "b_items")


def repo_detail_with_pairs(items: DataFrame, bench: str, repo: str, pairs: DataFrame) -> DataFrame:
    """``repo_detail`` with ``same_pr``: how many of the pairs (a_bench, b_bench, repo), a_bench < b_bench, lie in the repository."""
    known = pairs.select(F.col("a_bench").alias("a"), F.col("b_bench").alias("b"), F.lower(repo).alias("repo")).groupBy("a", "b", "repo").agg(F.count(F.lit(1)).alias("same_pr"))
    return repo_detail(items, bench, repo).join(known, ["a", "b", "repo"], "left").fillna(0, ["same_pr"])


def control_pulls(control: DataFrame, benches: DataFrame, without: str | None = None) -> DataFrame:
    """(control_id, bench, bench_id, same_base): items of a control set that are pull requests of a benchmark too, by lower-cased repository and number.

    Both sides have (id, repo, pr, base), ``benches`` also bench; ``without`` names a benchmark that has no numbers. Nulls match nothing.
    """
    on = lambda rows: rows.where(F.col("pr").isNotNull() & (F.col("repo") != "")).withColumn("k", F.lower("repo"))
    x = on(control).select("k", "pr", F.col("id").alias("control_id"), F.col("base").alias("control_base"))
    y = on(benches if without is None else benches.where(F.col("bench") != without)).select("k", "pr", "bench", F.col("id").alias("bench_id"), "base")
    same = F.coalesce((F.col("control_base") != "") & (F.col("control_base") == F.col("base")), F.lit(False))
    return x.join(y, ["k", "pr"]).select("control_id", "bench", "bench_id", same.alias("same_base"))


def base_presence(control: DataFrame, benches: DataFrame) -> DataFrame:
    """(bench, items, with_known_base): how many items of each benchmark start from a base commit that a control set has, whatever the pull request."""
    have = control.where(F.col("base") != "").select("base").distinct().withColumn("there", F.lit(True))
    return benches.join(have, "base", "left").groupBy("bench").agg(F.count(F.lit(1)).alias("items"), F.count_if("there").alias("with_known_base"))


def versus_counts(a: DataFrame, b: DataFrame, group: str, value: str, names: tuple[str, str]) -> DataFrame:
    """(label, pairs): pairs of rows of a group by their values, as "name x vs name y". Values are counted by group first, of which there are few."""
    side = lambda rows, to: rows.where(F.col(group).isNotNull()).groupBy(group, F.col(value).alias(to)).agg(F.count(F.lit(1)).alias(f"n_{to}"))
    label = F.concat(F.lit(f"{names[0]} "), "x", F.lit(f" vs {names[1]} "), "y").alias("label")
    return side(a, "x").join(side(b, "y"), group).groupBy(label).agg(F.sum(F.col("n_x") * F.col("n_y")).alias("pairs"))


def mirrors(ids: DataFrame, instance_id: str, shared_repos: DataFrame) -> DataFrame:
    """One row: tasks, those that mirror a pull request, their repositories, and how many are of shared repositories.

    ``shared_repos`` has ``repo``.
    """
    from kinsieve.functions.ids import is_pr_mirror, repo_from_id

    marked = shared_repos.select("repo").distinct().withColumn("shared", F.lit(True))
    rows = ids.select(repo_from_id(F.col(instance_id)).alias("repo"), is_pr_mirror(F.col(instance_id)).alias("mirror")).join(marked, "repo", "left").fillna(False)
    return rows.agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if("mirror").alias("mirrors"), F.count_distinct(F.when(F.col("mirror"), F.col("repo"))).alias("mirror_repos"),
        F.count_if(F.col("mirror") & F.col("shared")).alias("mirrors_in_shared"), F.count_if("shared").alias("tasks_in_shared"),
    )


def cross_counts(rows: DataFrame, group: str, values: list[str], item: str | None = None) -> DataFrame:
    """Control pairs, counted without making them: (group, value columns a_* and b_*, pairs) over ordered pairs of different
    rows of a group (or of rows with different ``item``).

    Pairs of n rows are the product of their counts, less the pairs within a row (or item); so a large group costs
    the square of its distinct values and not of its rows. For values of a bounded number; grades have ``graded_counts``, which is linear.
    Rows with a null group take no part.
    """
    keyed = rows.where(F.col(group).isNotNull())
    counts = keyed.groupBy(group, *values).agg(F.count(F.lit(1)).alias("n"))
    a = counts.select(group, *[F.col(v).alias(f"a_{v}") for v in values], F.col("n").alias("na"))
    b = counts.select(group, *[F.col(v).alias(f"b_{v}") for v in values], F.col("n").alias("nb"))
    every = a.join(b, group).select(group, *[f"a_{v}" for v in values], *[f"b_{v}" for v in values], (F.col("na") * F.col("nb")).alias("pairs"))
    if item is None:
        same = counts.select(group, *[F.col(v).alias(f"a_{v}") for v in values], *[F.col(v).alias(f"b_{v}") for v in values], (-F.col("n")).alias("pairs"))
    else:
        per = keyed.groupBy(group, item, *values).agg(F.count(F.lit(1)).alias("n"))
        x = per.select(group, item, *[F.col(v).alias(f"a_{v}") for v in values], F.col("n").alias("na"))
        y = per.select(group, item, *[F.col(v).alias(f"b_{v}") for v in values], F.col("n").alias("nb"))
        same = x.join(y, [group, item]).select(group, *[f"a_{v}" for v in values], *[f"b_{v}" for v in values], (-F.col("na") * F.col("nb")).alias("pairs"))
    keys = [group, *[f"a_{v}" for v in values], *[f"b_{v}" for v in values]]
    return every.unionByName(same).groupBy(*keys).agg(F.sum("pairs").alias("pairs")).where("pairs > 0")


def graded_counts(a: DataFrame, b: DataFrame | None, group: str, kind: str, frame: str) -> DataFrame:
    """(grade, pairs): the grades of ``crash.grade_of`` over all pairs of rows of a group in ``a`` and ``b``, counted and not made.

    Without ``b``, over ordered pairs of different rows of ``a``. Grades depend on equality alone, so counts by kind, by frame and by both
    say it all: each is one aggregation, and a hot group costs no more than its rows. Both sides have (group, kind, frame); a null
    kind or frame is an empty one, rows with a null group take no part.
    """
    empty, every = F.lit(""), F.lit(1)
    known = lambda rows: rows.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.coalesce(kind, empty).alias("k"), F.coalesce(frame, empty).alias("f"))

    def counted(rows: DataFrame, name: str) -> DataFrame:
        """Rows by (kind), (frame), (kind, frame) and in all, each also of those with a frame."""
        per = rows.groupBy("g", "k", "f").agg(F.count(every).alias("n"))
        sets = F.array(F.struct(F.lit("kf").alias("by"), "k", "f"), F.struct(F.lit("k").alias("by"), F.col("k"), empty.alias("f")), F.struct(F.lit("f").alias("by"), empty.alias("k"), F.col("f")), F.struct(F.lit("").alias("by"), empty.alias("k"), empty.alias("f")))
        flat = per.select("g", "n", F.when(F.col("f") != "", F.col("n")).otherwise(0).alias("m"), F.explode(sets).alias("s")).select("g", "s.*", "n", "m")
        return flat.groupBy("g", "by", "k", "f").agg(F.sum("n").alias(f"{name}_all"), F.sum("m").alias(f"{name}_framed"))

    x = known(a)
    y = x if b is None else known(b)
    both = counted(x, "x").join(counted(y, "y"), ["g", "by", "k", "f"])
    pairs, framed = F.col("x_all") * F.col("y_all"), F.col("x_framed") * F.col("y_framed")
    over = lambda by, what, said: F.coalesce(F.sum(F.when((F.col("by") == by) & said, what)), F.lit(0))
    kinds, frames, always = F.col("k") != "", F.col("f") != "", F.lit(True)
    sums = both.agg(
        over("kf", pairs, kinds & frames).alias("tf"), over("f", pairs, frames).alias("f"), over("k", framed, kinds).alias("t"), over("", framed, always).alias("framed"),
        over("k", pairs, kinds).alias("kind"), over("", pairs, always).alias("every"),
    )
    if b is None:  # less the pairs of a row with itself
        own = {"tf": kinds & frames, "f": frames, "t": kinds & frames, "framed": frames, "kind": kinds, "every": always}
        sums = sums.unionByName(x.agg(*[(-F.count_if(said)).alias(name) for name, said in own.items()])).agg(*[F.sum(name).alias(name) for name in own])
    c = F.col
    grades = {"type_and_frame": c("tf"), "frame_only": c("f") - c("tf"), "type_only": c("t") - c("tf"), "no_match": c("framed") - c("f") - c("t") + c("tf"), "type_only_no_frame": c("kind") - c("t"), "no_match_no_frame": c("every") - c("framed") - c("kind") + c("t")}
    rows = F.array(*[F.struct(F.lit(g).alias("grade"), n.alias("pairs")) for g, n in grades.items()])
    return sums.select(F.explode(rows).alias("r")).select("r.*").where("pairs > 0")


def cross_matched(pairs: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(group, a, b): pairs of matched ids of one group that aren't matched with each other. For matched sets, which are small."""
    x, y = pairs.select(group, a).distinct(), pairs.select(group, b).distinct()
    return x.join(y, group).join(pairs.select(group, a, b), [group, a, b], "left_anti")


def pivot_flags(rows: DataFrame, category: str, flag: Column) -> DataFrame:
    """(category, yes, no): counts of a category by a flag."""
    return rows.groupBy(category).agg(F.count_if(flag).alias("yes"), F.count_if(~flag).alias("no"))


def category_counts(rows: DataFrame, category: Column, name: str = "category") -> DataFrame:
    return rows.groupBy(category.alias(name)).agg(F.count(F.lit(1)).alias("rows"))
