import random
import re

import numpy as np
from pyspark.sql import functions as F

from kinsieve.llm import neardup


def sets(rows, n):
    out = {}
    for i, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    return out


def brute(rows, n, t):
    s = sets(rows, n)
    ids = sorted(s)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if s[a] and s[b] and len(s[a] & s[b]) >= t * len(s[a] | s[b]) - 1e-12}


def corpus(seed, size=60):
    rng = random.Random(seed)
    rows, base = [], [[f"w{rng.randrange(30)}" for _ in range(rng.randrange(4, 60))] for _ in range(8)]
    for i in range(size):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    return rows + [(900, None), (901, ""), (902, "one two"), (903, rows[0][1]), (904, rows[0][1].upper())]


def test_equals_brute_force(spark):
    for seed, n, t in ((1, 3, 0.6), (2, 5, 0.8), (3, 1, 0.5)):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, x, 0, 0) for i, x in rows], "row_id long, body string, size int, name int")
        got = [(r.row_id_a, r.row_id_b) for r in neardup.similar_pairs(df, "row_id", F.col("body"), n, t, sketch_bits=17).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, n, t)


def test_hot_grams_lose_nothing(spark):
    rows = [(i, f"the same phrase stands in every one of these texts {i} {i + 1} end") for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, body string")
    got = {(r.row_id_a, r.row_id_b) for r in neardup.similar_pairs(df, "row_id", F.col("body"), 2, 0.5, sketch_bits=17, hot=5).collect()}
    assert got == brute(rows, 2, 0.5)


def test_classes_and_links(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "a b c d e f g h i"), (4, "z y x w v u t s"), (5, None)]
    df = spark.createDataFrame(rows, "row_id long, body string")
    got = {r.row_id: (r.class_id, r.links) for r in neardup.near_duplicates(df, "row_id", F.col("body"), 5, 0.8, sketch_bits=17).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 0)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "row_id long, body string")
    assert neardup.similar_pairs(df, "row_id", F.col("body"), sketch_bits=17).count() == 0
    assert neardup.near_duplicates(df, "row_id", F.col("body"), sketch_bits=17).count() == 0


def test_suffix_bound_never_too_low():
    rng = np.random.default_rng(0)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(2))
        assert neardup.suffix_bound(x, y) >= len(np.intersect1d(x, y))
        s = neardup.similarity(x, y, 0.4)
        exact = len(np.intersect1d(x, y)) / max(1, len(np.union1d(x, y)))
        assert abs(s - exact) < 1e-12 or (s == 0 and exact < 0.4)


def test_long_text_and_packing():
    grams = neardup.Grams(3, held=100)
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    assert len(grams(long)) == 5000
    columns = (np.array([3, 1, 2], np.uint64), np.array([7, 8, 7]), np.array([4, 5, 4], np.int32), np.arange(3, dtype=np.int32), np.zeros(3, np.int32))
    back = neardup._unpack(neardup._pack(*columns))
    assert all((a == b).all() for a, b in zip(columns, back))


def test_grams_that_turn_out_hot_are_divided():
    """A sketch too coarse to see a hot n-gram: its holders are counted where they meet, and every two meet once."""
    rng = np.random.default_rng(3)
    n = 90
    entries = (np.repeat(np.array([5, 9], np.uint64), [n, 6]), np.append(rng.permutation(n), np.arange(6)).astype(np.int64), np.full(n + 6, 20, np.int32), np.zeros(n + 6, np.int32), np.zeros(n + 6, np.int32))
    kept, cells = neardup.divided(*neardup.holders(*entries), hot=10)
    assert set(kept[0].tolist()) == {9} and len(kept[0]) == 6
    met = [(a, b) for cell, part in cells if len(part[0]) for x, _, y, _, _ in neardup.pairs_of_bucket(*neardup.holders(np.full(len(part[0]), cell, np.uint64), *part[1:]), 0.5) for a, b in zip(x.tolist(), y.tolist())]
    assert len(met) == n * (n - 1) // 2 and {(min(p), max(p)) for p in met} == {(a, b) for a in range(n) for b in range(a + 1, n)}


def test_hot_grams_that_the_sketch_misses(spark, monkeypatch):
    rows = [(i, f"the same phrase stands in every one of these texts {i} {i + 1} end") for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, body string")
    monkeypatch.setattr(neardup, "_order", lambda counted, bits: np.zeros(1 << bits, np.uint8))
    got = [(r.row_id_a, r.row_id_b) for r in neardup.similar_pairs(df, "row_id", F.col("body"), 2, 0.5, sketch_bits=17, hot=5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 2, 0.5)


def test_one_record_sends_for_a_class_of_many(spark, monkeypatch):
    monkeypatch.setattr(neardup, "COPIES", 5)
    rows = [(i, "a b c d e f g h") for i in range(30)] + [(100, "a b c d e f g h i"), (101, "q r s t u v w x")]
    df = spark.createDataFrame(rows, "row_id long, body string").repartition(6)
    monkeypatch.setattr(neardup, "COPIES_SHARE", 1000)
    got = {r.row_id: (r.class_id, r.links) for r in neardup.near_duplicates(df, "row_id", F.col("body"), 5, 0.8, sketch_bits=17).collect()}
    assert got == {i: (0, 30) for i in (*range(30), 100)} | {101: (101, 0)}
