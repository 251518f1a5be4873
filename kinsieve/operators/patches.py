"""Git diffs: blob pairs and changed lines per file, and how two fixes relate.

Patches are parsed where they lie, by expressions over their lines, into one map per row. Two fixes are compared by joining
on the path first: abbreviated hashes can't be join keys, as equality of prefixes isn't transitive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsieve.functions.text import let, lines, stripped

_HEADER = r"^diff --git a/\S+ b/(\S+)"
_INDEX = r"^index ([0-9a-f]+)\.\.([0-9a-f]+)"


def blob_list(patch: Column) -> Column:
    """array<struct(path, pre, post)>: the first index line after each header that names a path without blanks.

    A later header without an index line gives nothing; a header whose path has blanks is passed over.
    """
    kept = F.filter(lines(patch), lambda x: (x.startswith("diff --git ") & x.rlike(_HEADER)) | (x.startswith("index ") & x.rlike(_INDEX)))
    # each kept line next to the one before it: an index line right behind a header is the first one of that file
    following = let(kept, lambda k: F.arrays_zip(k.alias("h"), F.slice(k, F.lit(2), F.size(k)).alias("i")))
    firsts = F.filter(following, lambda z: z["h"].startswith("diff") & z["i"].startswith("index"))
    return F.transform(firsts, lambda z: F.struct(F.regexp_extract(z["h"], _HEADER, 1).alias("path"), F.regexp_extract(z["i"], _INDEX, 1).alias("pre"), F.regexp_extract(z["i"], _INDEX, 2).alias("post")))


def patch_blobs(patches: DataFrame, key: str, patch: str) -> DataFrame:
    """(key, path, pre, post): one row for each file of a patch; the last pair of a path counts."""
    found = patches.select(F.col(key), F.posexplode(blob_list(F.col(patch))).alias("at", "b")).select(key, "at", "b.*")
    return found.groupBy(key, "path").agg(F.max_by("pre", "at").alias("pre"), F.max_by("post", "at").alias("post"))


def blob_equal(a: Column, b: Column) -> Column:
    """Abbreviated hashes agree if they share a prefix of at least seven digits, the shorter one's length."""
    n = F.least(F.length(a), F.length(b))
    return (n >= 7) & (F.left(a, n) == F.left(b, n))


def changed_line_rows(patches: DataFrame, key: str, patch: str) -> DataFrame:
    """(key, path, sign, line, copies): the multiset of trimmed removed and added lines of each file.

    The path is what follows the first `` b/`` of a header; a header alone gives a row with null sign, so that files
    without lines still count as touched. Lines that begin with --- or +++ are headers and never count; nor do empty ones.
    """
    rows = lines(F.col(patch))
    header = lambda x: x.startswith("diff --git ")
    signed = lambda x: (x.startswith("-") & ~x.startswith("---")) | (x.startswith("+") & ~x.startswith("+++"))
    kept = F.filter(rows, lambda x: header(x) | signed(x))
    # divided at the headers, so that a section's lines share its path; lines hold no breaks of their own
    sections = F.filter(F.split(F.array_join(kept, "\n"), "\n(?=diff --git )"), header)
    path = lambda h: F.when(h.contains(" b/"), F.regexp_replace(h, "^.*? b/", "")).otherwise(h)
    none = F.lit(None).cast("string")
    row = lambda p, sign, line: F.struct(p.alias("path"), sign.alias("sign"), line.alias("line"))

    def rows_of(section):
        inside = lambda p, parts: F.concat(F.array(row(p, none, none)), F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: row(p, F.left(x, F.lit(1)), stripped(F.substring(x, 2, 2147483647)))))
        return let(F.split(section, "\n"), lambda parts: let(path(parts[0]), lambda p: inside(p, parts)))

    found = patches.select(F.col(key), F.explode(F.flatten(F.transform(sections, rows_of))).alias("r")).select(key, "r.*")
    return found.groupBy(key, "path", "sign", "line").agg(F.count(F.lit(1)).alias("copies"))


def sorted_lines(rows: DataFrame, key: str) -> DataFrame:
    """(key, path, removed, added): sorted arrays with repeats, of ``changed_line_rows``."""
    many = lambda sign: F.sort_array(F.flatten(F.collect_list(F.when(F.col("sign") == sign, F.array_repeat("line", F.col("copies").cast("int"))))))
    return rows.groupBy(key, "path").agg(many("-").alias("removed"), many("+").alias("added"))


def changed_lines(patches: DataFrame, key: str, patch: str) -> DataFrame:
    """``sorted_lines`` of patches."""
    return sorted_lines(changed_line_rows(patches, key, patch), key)


def _relation(shared: Column, same: Column) -> Column:
    return F.when(F.coalesce(shared, F.lit(0)) == 0, "not_comparable").when(same == shared, "identical").when(same > 0, "partly_identical").otherwise("different")


def shared_blobs(pairs: DataFrame, a: str, b: str, blobs_a: DataFrame, blobs_b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """``pairs`` with ``shared`` (files in both patches) and ``same`` (those with equal blobs before and after)."""
    left = pairs.select(a, b).distinct().join(blobs_a.select(F.col(key_a).alias(a), "path", F.col("pre").alias("pa"), F.col("post").alias("qa")), a)
    both = left.join(blobs_b.select(F.col(key_b).alias(b), "path", F.col("pre").alias("pb"), F.col("post").alias("qb")), [b, "path"])
    equal = blob_equal(F.col("pa"), F.col("pb")) & blob_equal(F.col("qa"), F.col("qb"))
    counts = both.groupBy(a, b).agg(F.count(F.lit(1)).alias("shared"), F.count_if(equal).alias("same"))
    return pairs.join(counts, [a, b], "left").fillna(0, ["shared", "same"])


def fix_relation(pairs: DataFrame, a: str, b: str, blobs_a: DataFrame, blobs_b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """``pairs`` with ``fix``: identical, partly_identical, different or not_comparable by the blobs of shared files."""
    return shared_blobs(pairs, a, b, blobs_a, blobs_b, key_a, key_b).withColumn("fix", _relation(F.col("shared"), F.col("same"))).drop("shared", "same")


def same_fix_pairs(blobs_a: DataFrame, blobs_b: DataFrame, key_a: str, key_b: str, scope: str | None = None) -> DataFrame:
    """Pairs of patches that share a file and agree in the blobs of every shared file; within equal ``scope`` if given."""
    on = ["path"] + ([scope] if scope else [])
    x = blobs_a.select(F.col(key_a).alias("a_id"), *on, F.col("pre").alias("pa"), F.col("post").alias("qa"))
    y = blobs_b.select(F.col(key_b).alias("b_id"), *on, F.col("pre").alias("pb"), F.col("post").alias("qb"))
    # a shared prefix of seven digits is necessary, so it narrows the join without deciding it
    near = x.withColumn("p7", F.left("pa", F.lit(7))).join(y.withColumn("p7", F.left("pb", F.lit(7))), [*on, "p7"]).where("length(pa) >= 7 and length(pb) >= 7")
    equal = blob_equal(F.col("pa"), F.col("pb")) & blob_equal(F.col("qa"), F.col("qb"))
    some = near.where(equal).select("a_id", "b_id").distinct()
    every = some.join(x, "a_id").join(y, ["b_id", *on]).groupBy("a_id", "b_id").agg(F.bool_and(equal).alias("all_equal"))
    return every.where("all_equal").select("a_id", "b_id")


def lines_relation(pairs: DataFrame, a: str, b: str, lines_a: DataFrame, lines_b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """``pairs`` with ``fix_lines``: the relation by sorted changed lines of shared files, for patches without index lines."""
    left = pairs.select(a, b).distinct().join(lines_a.select(F.col(key_a).alias(a), "path", F.struct("removed", "added").alias("x")), a)
    both = left.join(lines_b.select(F.col(key_b).alias(b), "path", F.struct("removed", "added").alias("y")), [b, "path"])
    counts = both.groupBy(a, b).agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("x") == F.col("y")).alias("same"))
    return pairs.join(counts, [a, b], "left").withColumn("fix_lines", _relation(F.col("shared"), F.col("same"))).drop("shared", "same")


def strict_blob_test(pairs: DataFrame, a: str, b: str, blobs_a: DataFrame, blobs_b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """``pairs`` with ``blob_test``: not_comparable only where a side has no blobs; patches without a common file differ."""
    counted = shared_blobs(pairs, a, b, blobs_a, blobs_b, key_a, key_b)
    has_a = blobs_a.select(F.col(key_a).alias(a)).distinct().withColumn("has_a", F.lit(True))
    has_b = blobs_b.select(F.col(key_b).alias(b)).distinct().withColumn("has_b", F.lit(True))
    known = counted.join(has_a, a, "left").join(has_b, b, "left")
    kind = F.when(F.col("has_a").isNull() | F.col("has_b").isNull(), "not_comparable").when((F.col("shared") > 0) & (F.col("same") == F.col("shared")), "same_blob_pairs").otherwise("different_blob_pairs")
    return known.withColumn("blob_test", kind).drop("shared", "same", "has_a", "has_b")


def lines_contained(pairs: DataFrame, a: str, b: str, rows_a: DataFrame, rows_b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """``pairs`` with ``lines_contained``: whether every changed line of a's shared files is in b's as often (multisets)."""
    left = pairs.select(a, b).distinct().join(rows_a.select(F.col(key_a).alias(a), "path", "sign", "line", F.col("copies").alias("ca")), a)
    touched = rows_b.select(F.col(key_b).alias(b), "path").distinct()
    shared = left.join(touched, [b, "path"])
    right = rows_b.select(F.col(key_b).alias(b), "path", "sign", "line", F.col("copies").alias("cb")).where("sign is not null")
    held = shared.join(right, [b, "path", "sign", "line"], "left")
    ok = F.col("sign").isNull() | (F.col("ca") <= F.coalesce("cb", F.lit(0)))
    kinds = held.groupBy(a, b).agg(F.when(F.bool_and(ok), "contained").otherwise("not_contained").alias("lines_contained"))
    return pairs.join(kinds, [a, b], "left").fillna("not_comparable", ["lines_contained"])


def same_files(pairs: DataFrame, a: str, b: str, rows_a: DataFrame, rows_b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """``pairs`` with ``same_file_set`` (equal and not empty) and ``files_within`` (a's files are all in b's)."""
    files = lambda rows, key, to: rows.groupBy(F.col(key).alias(to)).agg(F.sort_array(F.collect_set("path")).alias(f"files_{to}"))
    both = pairs.join(files(rows_a, key_a, a), a, "left").join(files(rows_b, key_b, b), b, "left")
    fa, fb = (F.coalesce(F.col(f"files_{k}"), F.array().cast("array<string>")) for k in (a, b))
    return both.withColumn("same_file_set", (F.size(fa) > 0) & (fa == fb)).withColumn("files_within", F.size(F.array_except(fa, fb)) == 0).drop(f"files_{a}", f"files_{b}")
