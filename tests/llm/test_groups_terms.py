from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinsieve.llm import frequencies, groups
from kinsieve.plans import lineage


def union_find(records, edges):
    parent = {r: r for r in records}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent.setdefault(a, a), parent.setdefault(b, b)
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {r: find(r) for r in parent}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_random_graphs(spark, pairs):
    edges = [(f"v{a:02}", f"v{b:02}") for a, b in pairs]
    df = spark.createDataFrame(edges, "a string, b string")
    records = spark.createDataFrame([(x,) for e in edges for x in e] + [("alone",), ("alone",), (None,)], "record_id string")
    rows = groups.groups(records, df).collect()
    got = {r.record_id: r.group_id for r in rows}
    assert len(rows) == len(got) and got == union_find(["alone", *(x for e in edges for x in e)], edges)


def test_long_chain_and_hub(spark, monkeypatch):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)]
    hub = [("hub", f"h{i:03}") for i in range(150)]
    monkeypatch.setattr(groups, "HOT_ROWS", 10)  # hubs take the broadcast way
    df = spark.createDataFrame(chain + hub, "a string, b string")
    got = {r.record_id: r.group_id for r in groups.groups(df.select(F.col("a").alias("record_id")), df).collect()}
    assert set(got.values()) == {"c000", "h000"} and len(got) == 121 + 151


@pytest.mark.parametrize(("rest", "kind"), [(0, "string"), (12, "string"), (1000, "long"), (1000, "struct<s:string>")])
def test_rounds_and_rest_agree(spark, monkeypatch, rest, kind):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101 + i) for i in range(15)] + [(300, 301), (301, 300), (302, 302), (303, None)]
    monkeypatch.setattr(groups, "HOT_ROWS", 10)
    monkeypatch.setattr(groups, "REST_EDGES", rest)
    name = {"long": lambda v: v, "string": lambda v: None if v is None else f"v{v:03}"}.get(kind, lambda v: None if v is None else (f"v{v:03}",))
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"a {kind}, b {kind}")
    records = df.select(F.col("a").alias("record_id")).unionByName(df.select(F.col("b").alias("record_id")))
    rows = groups.groups(records, df).collect()
    want = union_find([302, 303], [e for e in edges if None not in e])
    assert len(rows) == len(want) and {r.record_id: r.group_id for r in rows} == {name(a): name(b) for a, b in want.items()}


def test_jobs_do_not_grow_with_chains_that_fit_a_task(spark, monkeypatch):
    cuts, measured = [], groups.measured
    monkeypatch.setattr(groups, "measured", lambda df, **sums: cuts.append(df) or measured(df, **sums))
    df = spark.createDataFrame([(f"c{i:03}", f"c{i + 1:03}") for i in range(500)], "a string, b string")
    assert {r.group_id for r in groups.groups(df.select(F.col("a").alias("record_id")), df).collect()} == {"c000"}
    assert len(cuts) == 3


def test_ids_of_rows(spark):
    rows = [("A;b ; ;", "\tC "), (None, None), ("", " ; "), ("x", None), ("b", "B")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "l string, r string, ids string")
    got = {r.record_id: r.group_id for r in groups.linked_groups([(df, ["l", "r"])]).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x"}
    assert groups.linked_groups([(df.limit(0), ["l", "r"])]).count() == 0


def test_lookup_hot_and_cold(spark):
    left = spark.createDataFrame([("h", i) for i in range(50)] + [("c", 1), ("none", 2)], "k string, i int")
    mapping = spark.createDataFrame([("h", 1, 50), ("c", 2, 1)], "k string, v int, weight long")
    want = sorted([("h", i, 1) for i in range(50)] + [("c", 1, 2)])
    assert sorted(map(tuple, lineage.lookup(left, mapping, "k", 10).select("k", "i", "v").collect())) == want
    assert sorted(map(tuple, lineage.lookup(left, mapping, "k", 10, 5).select("k", "i", "v").collect())) == want


@pytest.mark.parametrize("held", [1, 3, 1000])
def test_last_seen_counters(held):
    texts = ["a b a", None, "", "B c", "a", "x " * 50]
    occurrences, records = Counter(), Counter()
    for seen in frequencies.count_terms(iter(texts), held):
        for term, (n, r, _) in seen.items():
            occurrences[term] += n
            records[term] += r
    assert occurrences == Counter({"a": 3, "b": 2, "c": 1, "x": 50}) and records == Counter({"a": 2, "b": 2, "c": 1, "x": 1})


def test_marks(spark):
    texts = ["Common one", "common two", "common two", "common two é_1", "", None]
    df = spark.createDataFrame([(t, "clash") for t in texts], "report string, term string")
    got = {r.term: (r.occurrences, r.reports, r.mark) for r in frequencies.marked_terms(df, "report").collect()}
    assert got == {"common": (4, 4, "common"), "one": (1, 1, "rare"), "two": (3, 3, "common"), "é_1": (1, 1, "rare")}
    assert frequencies.marked_terms(df.limit(0), "report").count() == 0


def test_many_partitions_agree(spark):
    rows = [(" ".join(f"w{j}" for j in range(i % 7)),) for i in range(200)]
    df = spark.createDataFrame(rows, "t string").repartition(7)
    want = defaultdict(int)
    for (t,) in rows:
        for w in set(t.split()):
            want[w] += 1
    assert {r.term: r.reports for r in frequencies.term_counts(df, "t").collect()} == dict(want)
