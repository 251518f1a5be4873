"""Problem 7: a selection of records whose sources contribute target shares of all tokens.

Method: Efraimidis-Spirakis sampling. Every document gets an exponential key divided by its quality weight; in the order of the
keys a source's tokens are prefix-summed up to its budget. Where the budget exceeds the source, complete epochs come
first and only the last, fractional one is sampled; no document is used more often than its source's cap.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinsieve.plans.lineage import cut, written

#: Bins of the logarithm of the keys per unit. Its distribution has the same shape for every weight, so that a bin holds about 1 % of
#: a source's documents at most. Tokens are summed by bin, and the bin on the budget's edge is divided again (into SPLITS) until it
#: holds at most EDGE_ROWS documents, which are sorted.
BINS, SPLITS, EDGE_ROWS = 32, 1024, 50_000
#: Targets that may be given (an error beyond): one row each is broadcast.
MOST_TARGETS = 10_000


def clean_source(source: Column) -> Column:
    """The clean spelling: trimmed, lower case, ``_`` for ``-`` and blanks; null stays null."""
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", "")), r"[-\s]+", "_")


def quality_weight(chars: Column, tokens: Column) -> Column:
    """Characters per token over 4, between 0.1 and 1.5: natural text packs well, dumps and noise don't."""
    return F.greatest(F.lit(0.1), F.least(F.lit(1.5), chars / (4.0 * tokens)))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) fixed by id and seed, so that a task that runs again draws the same."""
    return (F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(2**52)) + 0.5) / float(2**52)


def budgets(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, tight: bool = False) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, source_tokens, budget, epochs, rest) for every target.

    Without ``total_tokens`` the total is all tokens of the target sources; with ``tight`` it is instead the largest at which
    every target source that has any text reaches its share within its repeats. A source that can't fill its
    share of the total gives all its repeats, one without text gives nothing, and the shares of the others stay in proportion.
    Repeated targets count once (the largest share); null or non-positive shares and repeats give nothing.
    """
    want = targets.select(clean_source(F.col("source")).alias("source"), F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target_share"), F.coalesce(F.col("max_repeats").cast("bigint"), F.lit(0)).alias("max_repeats"))
    want = want.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")
    if want.limit(MOST_TARGETS + 1).count() > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    have = sizes.join(F.broadcast(want.select("source")), "source").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tokens").alias("source_tokens"))
    table = want.join(F.broadcast(have), "source", "left").fillna(0, ["n_docs", "source_tokens"])  # one row a target
    share = F.greatest(F.col("target_share"), F.lit(0.0))
    most = F.greatest(F.col("max_repeats"), F.lit(0)) * F.col("source_tokens")
    if tight:
        whole = F.min(F.when((share > 0) & (most > 0), most / share)).over(Window.partitionBy(F.lit(1)))
    elif total_tokens is None:
        whole = F.sum(F.col("source_tokens").cast("double")).over(Window.partitionBy(F.lit(1)))
    else:
        whole = F.lit(float(total_tokens))
    budget = F.coalesce(F.least(most, F.floor(share * whole + 1e-6)), F.lit(0)).cast("bigint")
    table = table.withColumn("budget", budget)
    epochs = F.when(F.col("source_tokens") > 0, F.floor(F.col("budget") / F.col("source_tokens"))).otherwise(0).cast("bigint")
    return table.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_tokens"))


def _edges(keyed: DataFrame, rest: dict[str, int]) -> list[tuple[str, float, float, int]]:
    """(source, above, upto, before): the keys above ``above`` and up to ``upto`` of a source straddle its budget, and ``before`` tokens
    have lower keys. A source whose documents all fit has no such keys.

    The driver gets at most sources x SPLITS sums a pass (more in the first one, which covers all keys).
    """
    spark = keyed.sparkSession
    open_ = {s: (-math.inf, math.inf, 0) for s, k in rest.items() if k > 0}
    done = {s: (-math.inf, -math.inf, 0) for s, k in rest.items() if k <= 0}
    bin_of = F.floor(F.col("key") * BINS)
    rows = keyed.where(F.col("rest") > 0)
    while open_:
        sums: dict[str, list] = {s: [] for s in open_}
        for r in rows.groupBy("source", bin_of.alias("bin")).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect():
            sums[r.source].append((r.bin, r.t, r.n, r.lo, r.hi))
        for s, bins in sums.items():
            above, upto, before = open_.pop(s)
            for _, t, n, lo, hi in sorted(bins):
                if before + t > rest[s]:
                    (done if n <= EDGE_ROWS or lo == hi else open_)[s] = (math.nextafter(lo, -math.inf), hi, before)
                    break
                above, before = hi, before + t
            else:
                done[s] = (above, above, before)
        if open_:
            table = spark.createDataFrame([(s, *v[:2]) for s, v in open_.items()], "source string, above double, upto double")
            rows = keyed.join(F.broadcast(table), "source").where("key > above and key <= upto")
            bin_of = F.floor((F.col("key") - F.col("above")) / (F.col("upto") - F.col("above")) * SPLITS)
    return [(s, *v) for s, v in done.items()]


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, tight: bool = False, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(selection, shares) for ``sizes`` (doc_id, source, chars, tokens) and ``targets`` (source, target_share, max_repeats).

    The selection has (doc_id, source, tokens, uses), uses >= 1. A document on the budget's edge is taken if more
    than half of it fits. The shares have one row per target with the tokens and the share that it really got. Sources without
    a target give nothing; ties of keys fall to the smaller id; rows of the same id and source count each.
    """
    plan = cut(budgets(sizes, targets, total_tokens, tight))  # one row a target
    key = F.log(-F.log(uniform(F.col("doc_id"), seed))) - F.log(quality_weight(F.col("chars"), F.col("tokens")))
    keyed = sizes.where(F.col("tokens") > 0).join(F.broadcast(plan.where("budget > 0").select("source", "epochs", "rest")), "source").withColumn("key", key)
    edges = _edges(keyed, {r.source: r.rest for r in plan.where("budget > 0").collect()})
    placed = keyed.join(F.broadcast(sizes.sparkSession.createDataFrame(edges, "source string, above double, upto double, before bigint")), "source")
    apart = placed.where((F.col("key") <= F.col("above")) | (F.col("key") > F.col("upto"))).withColumn("sampled", (F.col("key") <= F.col("above")).cast("int"))
    # at most EDGE_ROWS rows a source, or one key; copies of a row are one, of which as many are taken as fit
    edge = placed.where((F.col("key") > F.col("above")) & (F.col("key") <= F.col("upto"))).groupBy("source", "key", "doc_id", "tokens", "epochs", "rest", "before").agg(F.count(F.lit(1)).alias("n"))
    upto = F.coalesce(F.sum(F.col("tokens") * F.col("n")).over(Window.partitionBy("source").orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fit = F.ceil((F.col("rest") - F.col("before") - upto) / F.col("tokens") + 0.5) - 1
    edge = edge.withColumn("fit", fit).select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("copy")).withColumn("sampled", (F.col("copy") <= F.col("fit")).cast("int"))
    columns = ["doc_id", "source", "tokens", (F.col("epochs") + F.col("sampled")).cast("int").alias("uses")]
    chosen = apart.select(*columns).unionByName(edge.select(*columns)).where(F.col("uses") > 0)
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.max("uses").alias("most_uses"), F.count(F.lit(1)).alias("used_docs"))
    shares = plan.join(used, "source", "left").fillna(0, ["used_tokens", "most_uses", "used_docs"])
    total = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))
    shares = shares.withColumn("actual_share", F.when(total > 0, F.col("used_tokens") / total).otherwise(F.lit(0.0)))
    return chosen, shares.select("source", "target_share", "actual_share", "max_repeats", "most_uses", "n_docs", "source_tokens", "budget", "used_docs", "used_tokens")


def mix_documents(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, tight: bool = False, seed: int = 7, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``mix`` of a table (doc_id, text, source); null and empty texts are left out, source spellings are cleaned."""
    from kinsieve.llm.tokens import token_sizes

    named = docs.select("doc_id", "text", clean_source(F.col("source")).alias("source"))
    return mix(written(token_sizes(named, keep=("source",), tokenizer=tokenizer)), targets, total_tokens, tight, seed)
