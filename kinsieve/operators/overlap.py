"""Text overlap: n-gram filters, boilerplate, longest shared runs, equal texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinsieve.functions.text import ngrams, words
from kinsieve.plans.lineage import cut, spread

#: A table of n-grams is broadcast up to this many rows; beyond, the join shuffles.
BROADCAST_GRAMS = 200_000


def gram_rows(rows: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, gram): the distinct n-grams of each key's text."""
    return spread(rows.select(key, text)).select(key, words(F.col(text)).alias("w")).select(key, F.explode(ngrams(F.col("w"), n)).alias("gram"))


def ngram_matches(train: DataFrame, train_id: str, train_text: str, bench: DataFrame, bench_id: str, bench_text: str, n: int, boilerplate: DataFrame | None = None) -> DataFrame:
    """(train_id, bench_id, shared): pairs of texts with the number of distinct n-grams that they share.

    ``boilerplate`` n-grams don't count. The benchmark's n-grams are counted first, and broadcast only if they are few; then
    the training texts' n-grams are dropped where they are made, and never shuffled.
    """
    grams = gram_rows(bench, bench_id, bench_text, n)
    if boilerplate is not None:
        grams = grams.join(boilerplate.select("gram"), "gram", "left_anti")
    grams = cut(grams.distinct())
    small = grams.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS
    found = gram_rows(train, train_id, train_text, n).join(F.broadcast(grams) if small else grams, "gram")
    return found.groupBy(train_id, bench_id).agg(F.count_distinct("gram").alias("shared"))


def filter_summary(matches: DataFrame, train: DataFrame, train_id: str, bench_id: str, pairs: DataFrame) -> DataFrame:
    """One row: what a filter flags among the training items that overlap (``pairs``) and among the others.

    (overlap_items, overlap_flagged, overlap_flagged_by_own, other_items, other_flagged, bench_matched)
    """
    no, none = F.lit(False), F.lit(None)
    found = cut(matches.select(train_id, bench_id).distinct())
    row = lambda df, hit, mine, there: df.select(F.col(train_id).alias("t"), F.col(bench_id).alias("b") if bench_id in df.columns else none.cast(found.schema[bench_id].dataType).alias("b"), F.lit(hit).alias("hit"), F.lit(mine).alias("mine"), F.lit(there).alias("there"))
    # one shuffle by item: what each pair of it is, and then what each item is
    tagged = row(train, False, False, True).unionByName(row(found, True, False, False)).unionByName(row(pairs, False, True, False))
    per_pair = tagged.groupBy("t", "b").agg(*[F.max(c).alias(c) for c in ("hit", "mine", "there")])
    own = F.col("hit") & F.col("mine")
    items = per_pair.groupBy("t").agg(F.max("hit").alias("flagged"), F.max("mine").alias("overlap"), F.max(F.coalesce(own, no)).alias("own"), F.max("there").alias("there")).where("there")
    no_hit, no_flag = F.lit(None).cast("string").alias("hit"), F.lit(None).cast("boolean")
    hits = found.select(*[no_flag.alias(c) for c in ("overlap", "flagged", "own")], F.col(bench_id).cast("string").alias("hit")).distinct()
    return items.select("overlap", "flagged", "own", no_hit).unionByName(hits).agg(
        F.count_if("overlap").alias("overlap_items"), F.count_if(F.col("overlap") & F.col("flagged")).alias("overlap_flagged"), F.count_if(F.col("overlap") & F.col("own")).alias("overlap_flagged_by_own"),
        F.count_if(~F.col("overlap")).alias("other_items"), F.count_if(~F.col("overlap") & F.col("flagged")).alias("other_flagged"), F.count_distinct("hit").alias("bench_matched"),
    )


def document_frequency(rows: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(gram, df): in how many keys an n-gram occurs; each key counts once."""
    return gram_rows(rows, key, text, n).distinct().groupBy("gram").agg(F.count(F.lit(1)).alias("df"))


def boilerplate(rows: DataFrame, key: str, text: str, n: int, least: int) -> DataFrame:
    """The n-grams in at least ``least`` keys; none for 0, which turns the rule off."""
    counted = document_frequency(rows, key, text, n)
    return counted.where(F.col("df") >= least if least else F.lit(False))


def flagged_by_threshold(train: DataFrame, train_id: str, train_text: str, bench: DataFrame, bench_id: str, bench_text: str, n: int, thresholds: list[int]) -> DataFrame:
    """(threshold, flagged): training texts that share an n-gram with the benchmark which is in fewer benchmark texts than
    the threshold; 0 counts every n-gram. All thresholds come from one join: a text is kept with its rarest shared n-gram."""
    counted = cut(document_frequency(bench, bench_id, bench_text, n))
    small = counted.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS
    found = gram_rows(train, train_id, train_text, n).join(F.broadcast(counted) if small else counted, "gram")
    rarest = found.groupBy(train_id).agg(F.min("df").alias("df"))
    counts = rarest.agg(*[F.count_if(F.col("df") < k if k else F.lit(True)).alias(f"t{k}") for k in thresholds])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("threshold"), F.col(f"t{k}").alias("flagged")) for k in thresholds])).alias("r")).select("r.*")


def longest_runs(pairs: DataFrame, a: DataFrame, b: DataFrame, a_id: str, b_id: str, a_text: str, b_text: str) -> DataFrame:
    """``pairs`` (a_id, b_id) with ``run``: the length of the longest run of words that both texts hold; 0 without any.

    Positions of equal pairs of words lie on diagonals, and runs are islands of consecutive positions on one; single words are only
    looked at where no two in a row are shared. Meant for candidate pairs: a pair costs the product of a word pair's repetitions
    on both sides. Texts are cut to those of the pairs before their words are made, which are shuffled and never broadcast.
    """
    keep = cut(pairs.select(a_id, b_id).distinct())
    split = lambda rows, key, text: rows.join(keep.select(key).distinct(), key, "left_semi").select(key, words(F.col(text)).alias("w"))
    x, y = split(a, a_id, a_text), split(b, b_id, b_text)
    two = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
    placed = lambda rows, key, at: rows.select(key, F.posexplode(F.when(F.size("w") > 1, two(F.col("w")))).alias(at, "two")).hint("merge")
    met = keep.join(placed(x, a_id, "i"), a_id).hint("merge").join(placed(y, b_id, "j"), [b_id, "two"]).withColumn("diagonal", F.col("i") - F.col("j"))
    order = Window.partitionBy(a_id, b_id, "diagonal").orderBy("i")
    islands = met.withColumn("island", F.col("i") - F.row_number().over(order))
    runs = cut(islands.groupBy(a_id, b_id, "diagonal", "island").agg(F.count(F.lit(1)).alias("n")).groupBy(a_id, b_id).agg((F.max("n") + 1).alias("run")))
    rest = keep.join(runs, [a_id, b_id], "left_anti")
    single = rest.join(x.hint("merge"), a_id).join(y.withColumnRenamed("w", "v").hint("merge"), b_id).select(a_id, b_id, F.arrays_overlap("w", "v").cast("bigint").alias("run"))
    return runs.unionByName(single.unionByName(rest.join(single.select(a_id, b_id), [a_id, b_id], "left_anti").withColumn("run", F.lit(0).cast("bigint"))))


def longest_in_group(runs: DataFrame, group: str | list[str]) -> DataFrame:
    """(group, run): the longest run of any pair of a group, as of all training tasks of a bug."""
    return runs.groupBy(*([group] if isinstance(group, str) else group)).agg(F.max("run").alias("run"))


def run_stats(runs: DataFrame) -> DataFrame:
    """(pairs, longest, upper_median, median, at_least_8, at_least_13): the upper median is a run of the table, the other is
    interpolated. Pairs are first counted by length, so that only one row per length is ordered."""
    lengths = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("run"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    placed = lengths.select("run", "n", upto.alias("upto"), total.alias("total"))
    upper = F.min(F.when(F.col("upto") >= F.floor(F.col("total") / 2) + 1, F.col("run")))
    lower = F.min(F.when(F.col("upto") >= F.floor((F.col("total") - 1) / 2) + 1, F.col("run")))
    at = lambda k: F.coalesce(F.sum(F.when(F.col("run") >= k, F.col("n"))), F.lit(0))
    return placed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.max("run").alias("longest"), upper.alias("upper_median"), ((lower + upper) / 2).alias("median"), at(8).alias("at_least_8"), at(13).alias("at_least_13"))


def equal_texts(a: DataFrame, b: DataFrame, a_id: str, b_id: str, a_text: str, b_text: str, least: int = 13, apart_from: DataFrame | None = None) -> DataFrame:
    """(a_id, b_id): texts of the same words in the same order, of at least ``least`` words; known pairs are left out.

    The join key is a hash of the words, and the words themselves are compared after it.
    """
    def keyed(rows, key, text, to):
        w = rows.select(F.col(key), words(F.col(text)).alias("w")).where(F.size("w") >= least)
        return w.select(key, F.array_join("w", " ").alias(to)).withColumn("h", F.xxhash64(to))

    found = keyed(a, a_id, a_text, "x").join(keyed(b, b_id, b_text, "y"), "h").where("x = y").select(a_id, b_id)
    return found if apart_from is None else found.join(apart_from, [a_id, b_id], "left_anti")


def names_any(text: Column, names: Column) -> Column:
    """Whether a text holds one of the names as a whole word; null where there are no names."""
    edge = lambda n: F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), n, F.lit(r"\E(?![\p{L}\p{N}_])"))
    return F.when(F.size(names) > 0, F.exists(names, lambda n: F.coalesce(F.regexp_like(text, edge(n)), F.lit(False))))


def duplicate_groups(rows: DataFrame, group: str, key: str, content: str, listed: bool = True) -> DataFrame:
    """(group, first_id, copies, identical): groups of more than one key, and whether their contents are all equal (null is one).

    ``listed`` adds ``ids``, all keys sorted: for groups of a bounded size, such as the tasks of a bug.
    """
    aggregates = [F.min(key).alias("first_id"), F.count(F.lit(1)).alias("copies"), F.count_distinct(F.coalesce(F.sha2(content, 256), F.lit(""))).alias("k")]
    if listed:
        aggregates.append(F.array_sort(F.collect_list(key)).alias("ids"))
    found = rows.where(F.col(group).isNotNull()).groupBy(group).agg(*aggregates).where("copies > 1")
    return found.withColumn("identical", F.col("k") == 1).drop("k")
