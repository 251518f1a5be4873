"""Problem 3: one group id for all records linked directly or through others.

Method: randomised graph contraction. In every round each vertex hooks to the member of its closed neighbourhood
that comes first in a fresh hash order; edges are relabelled and deduplicated, and the maps of all rounds are expanded
backwards. A round removes a constant share of the vertices in expectation, so that the number of rounds grows with the
logarithm of the longest chain, not with its length. Once the edges that are left fit one task, that task joins them all
by union-find: of the rounds, those over small tables cost the driver as much as the others and do next to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinsieve.plans.lineage import lookup, measured

#: Keys with more rows than this are hot if they have more than a quarter of a partition's fair share; with few partitions, if they have
#: more than this part of all rows. So a hot key never fills a task, and there are at most four of them for each partition.
HOT_ROWS, HOT_SHARE = 20_000, 200
#: Edges that one task joins at once, whatever the size of the input: some 100 MB with ids of 50 characters.
REST_EDGES = 250_000
#: Types whose equality is the same in Arrow as in Spark; vertices of others are contracted until no edge is left.
_PLAIN = (T.StringType(), T.BinaryType(), T.LongType(), T.IntegerType(), T.ShortType(), T.ByteType())


def _hot_above(rows: int, partitions: int = 1) -> int:
    return max(HOT_ROWS, rows // max(HOT_SHARE, 4 * partitions))


def row_ids(*columns: Column | str, separator: str = ";") -> Column:
    """The distinct ids that a row holds: trimmed, lower-cased, without blanks.

    Null columns hold none; lists are divided at ``separator``; blanks of any Unicode kind are trimmed.
    """
    text = F.concat_ws(separator, *columns)
    ids = F.transform(F.split(text, separator), lambda x: F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    return F.array_distinct(F.filter(ids, lambda x: x != ""))


def edges_of(rows: DataFrame, ids: str) -> tuple[DataFrame, DataFrame]:
    """(records, edges) of rows with an array of ids: a star from the first id of a row to each other one."""
    records = rows.select(F.explode(ids).alias("record_id")).distinct()
    pairs = rows.where(F.size(ids) > 1).select(F.element_at(ids, 1).alias("a"), F.explode(F.slice(F.col(ids), 2, F.size(ids))).alias("b"))
    return records, pairs


def _undirected(pairs: DataFrame) -> DataFrame:
    kept = pairs.where(F.col("a") != F.col("b"))
    return kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (a, b) of a table -> (vertex, root) of every vertex, by union-find."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    coded = pa.concat_arrays([batch.column(end) for end in (0, 1) for batch in held]).dictionary_encode()
    ends, parent = coded.indices.to_pylist(), list(range(len(coded.dictionary)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(ends[: len(ends) // 2], ends[len(ends) // 2 :]):
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    roots = coded.dictionary.take(pa.array(map(find, range(len(parent))), pa.int32()))
    yield from pa.table({"vertex": coded.dictionary, "root": roots}).to_batches(max_chunksize=10_000)


def contract(edges: DataFrame, seed: int = 0, max_rounds: int = 200) -> DataFrame:
    """(vertex, root) for every vertex of ``edges`` (a, b): equal roots mean the same component.

    Null ends and self-loops carry no link and are left out; an empty table gives no rows. Vertices may have any
    hashable type. Hub vertices are pre-aggregated map-side and their relabelling is a bounded broadcast (``lookup``).
    """
    rows, hottest = F.count(F.lit(1)), F.max("weight")
    live, size = measured(_undirected(edges.select("a", "b")), n=rows)
    partitions = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    maps: list[tuple[DataFrame, int]] = []
    kind = live.schema["a"].dataType
    rest = REST_EDGES if kind in _PLAIN and live.schema["b"].dataType == kind else 0
    while size["n"] > rest:
        if len(maps) >= max_rounds:
            raise RuntimeError("contraction did not end")
        order = lambda c: F.struct(F.xxhash64(c, F.lit(seed + len(maps))).alias("h"), c.alias("v"))
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min(order(F.col("b"))).alias("m"), F.count(F.lit(1)).alias("weight"))
        hooks, held = measured(hooks.select(F.col("a").alias("vertex"), F.least(F.col("m"), order(F.col("a")))["v"].alias("to"), "weight"), n=rows, w=hottest)
        maps.append((hooks, held["n"]))
        above = _hot_above(size["n"], partitions)
        step = lookup(live.withColumnRenamed("a", "vertex"), hooks, "vertex", above, held["w"]).select(F.col("to").alias("a"), F.col("b").alias("vertex"))
        step = lookup(step, hooks, "vertex", above, held["w"]).select("a", F.col("to").alias("b"))
        live, size = measured(_undirected(step), n=rows)
    if size["n"]:
        roots = live.select("a", "b").coalesce(1).mapInArrow(_joined, T.StructType([T.StructField("vertex", kind), T.StructField("root", kind)]))
    elif maps:
        roots = maps.pop()[0].select("vertex", F.col("to").alias("root"))
    else:
        roots = live.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    for earlier, vertices in reversed(maps):
        # a vertex that later rounds don't know was alone after its round: its hook is its root
        weights = earlier.groupBy("to").agg(F.count(F.lit(1)).alias("weight"))
        known = roots.select(F.col("vertex").alias("to"), "root")
        sized, held = measured(weights.join(known, "to", "left").select("to", F.coalesce("root", "to").alias("root"), "weight"), w=hottest)
        roots = lookup(earlier.select("vertex", "to"), sized, "to", _hot_above(vertices, partitions), held["w"] or 0).select("vertex", "root")
    return roots


def groups(records: DataFrame, edges: DataFrame, seed: int = 0) -> DataFrame:
    """(record_id, group_id): group_id is the smallest record_id of everything linked to the record.

    ``records`` (record_id) may repeat; records without edges stand alone. Rows whose id is null are no records.
    """
    rows = F.count(F.lit(1))
    partitions = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    roots, size = measured(contract(edges, seed), n=rows)
    smallest, held = measured(roots.groupBy("root").agg(F.min("vertex").alias("group_id"), rows.alias("weight")), w=F.max("weight"))
    linked = lookup(roots, smallest, "root", _hot_above(size["n"], partitions), held["w"] or 0).select(F.col("vertex").alias("record_id"), "group_id")
    alone = records.where(F.col("record_id").isNotNull()).select("record_id").distinct().join(linked.select("record_id"), "record_id", "left_anti")
    return linked.unionByName(alone.select("record_id", F.col("record_id").alias("group_id")))


def linked_groups(tables: list[tuple[DataFrame, list[str]]], seed: int = 0) -> DataFrame:
    """Groups over several tables; each names the columns whose ids (or id lists) a row links.

    Extra columns of the tables are ignored, whatever their names; null and blank sides link nothing.
    """
    rows = reduce(DataFrame.unionByName, [t.select(row_ids(*[F.col(f"`{c}`").cast("string") for c in cols]).alias("ids")) for t, cols in tables])
    records, edges = edges_of(rows, "ids")
    return groups(records, edges, seed)
