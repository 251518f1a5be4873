import numpy as np
import pytest
from pyspark.sql import functions as F

from kinsieve.llm import mixing, packing, tokens


def test_best_fit_and_crossover_keep_items_and_capacity():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 60, 300)
    a, b = (packing.best_fit(sizes, rng.permutation(300), np.full(300, -1), 100) for _ in range(2))
    for child in (packing.crossover(rng, sizes, a, b, 100), packing.mutate(rng, sizes, a, 100)):
        assert len(child) == 300 and (child >= 0).all() and np.bincount(child, weights=sizes).max() <= 100
    best = packing.evolve(sizes, 100, 1, [], generations=20)
    assert best.max() + 1 <= a.max() + 1 and best.max() + 1 <= -(-sizes.sum() // 100) + 1
    assert (packing.evolve(sizes, 100, 1, [], generations=5) == packing.evolve(sizes, 100, 1, [], generations=5)).all()


def test_evolution_beats_best_fit_where_that_fails():
    """Triples that fill a container exactly, of which best fit makes pairs: the evolved packings need clearly fewer containers."""
    for seed in range(3):
        rng = np.random.default_rng(seed)
        a = rng.integers(380, 491, 40)
        b = rng.integers(250, (1000 - a) // 2 + 1)
        sizes = rng.permutation(np.concatenate([a, b, 1000 - a - b]))
        fit = packing.best_fit(sizes, np.argsort(-sizes, kind="stable"), np.full(120, -1), 1000)
        evolved = packing.evolve(sizes, 1000, seed, [], generations=300, population=12)
        assert np.bincount(evolved, weights=sizes).max() <= 1000 and 40 <= evolved.max() + 1 <= fit.max() + 1 - 4


def test_pack_places_everything(spark):
    rows = [(i, int(x)) for i, x in enumerate(np.random.default_rng(2).integers(1, 400, 700))] + [(9000, 2500), (9001, 2000), (9001, 2000), (None, 30), (9002, 0), (9003, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, tokens long, bin string")
    out = packing.pack(df, 1000, block_items=200).toPandas()
    assert out.tokens.sum() == sum(n or 0 for _, n in rows)
    loads = out.groupby("container").tokens.sum()
    assert loads.max() <= 1000 and len(loads) <= -(-out.tokens.sum() // 1000) + 2
    assert sorted(out[out.doc_id == 9000].tokens) == [500, 1000, 1000] and len(out[out.doc_id == 9001]) == 4
    assert set(out.part[out.tokens < 1000][out.doc_id < 700]) == {0}
    assert packing.pack(df.limit(0), 1000).count() == 0


def test_token_pieces_agree(monkeypatch):
    text = "The  quick brown fox\n\n jumps, 12 times over_the lazy dög; " * 40
    path = f"{tokens.TOKENIZER_FOLDER}/{tokens.TOKENIZER_FILE}"
    whole = len(tokens.encoding(path).encode_ordinary(text))
    assert "".join(tokens.pieces(text, 100)) == text
    assert sum(len(tokens.encoding(path).encode_ordinary(p)) for p in tokens.pieces(text, 100)) == whole


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "hello world", "s"), (2, "", "s"), (3, None, "s"), (1, "hello world", None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.chars, r.tokens) for r in tokens.token_sizes(df, keep=("source",)).collect()) == [(1, 11, 2), (1, 11, 2)]


@pytest.fixture(scope="module")
def sizes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, s, int(n) * 4, int(n)) for i, (s, n) in enumerate((s, n) for s, k in (("big", 3000), ("mid", 600), ("tiny", 20)) for n in rng.integers(1, 200, k))]
    return spark.createDataFrame(rows, "doc_id long, source string, chars long, tokens long")


def test_mix_reaches_shares_within_caps(spark, sizes):
    targets = spark.createDataFrame([("Big ", 0.5, 1), ("mid", 0.3, 4), ("tiny", 0.1, 3), ("none", 0.1, 3), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(sizes, targets)
    got = {r.source: r for r in shares.collect()}
    used = {r.source: r for r in chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("n"), F.max("uses").alias("m"), F.min("uses").alias("k")).collect()}
    assert set(got) == {"big", "mid", "tiny", "none"} and got["none"].used_tokens == 0
    for s in ("big", "mid"):
        assert abs(got[s].used_tokens - got[s].budget) <= 200 and used[s].n == got[s].used_tokens
    assert used["tiny"].m == used["tiny"].k == 3 and used["big"].m == 1 and used["mid"].m <= 4 and used["mid"].m - used["mid"].k <= 1
    assert abs(sum(r.actual_share for r in got.values()) - 1) < 1e-9


def test_mix_tight_given_total_and_empty(spark, sizes):
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.4, 2), ("tiny", 0.1, 3)], "source string, target_share double, max_repeats int")
    shares = {r.source: r.actual_share for r in mixing.mix(sizes, targets, tight=True)[1].collect()}
    assert shares == {"big": pytest.approx(0.5, abs=0.02), "mid": pytest.approx(0.4, abs=0.02), "tiny": pytest.approx(0.1, abs=0.02)}
    assert mixing.mix(sizes, targets, total_tokens=0)[0].count() == 0
    none, report = mixing.mix(sizes.limit(0), targets)
    assert none.count() == 0 and report.count() == 3


def test_quality_weight_matters(spark):
    rows = [(i, "s", 600 if i % 2 else 40, 100) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, chars long, tokens long")
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    chosen = [r.doc_id % 2 for r in mixing.mix(df, targets, total_tokens=100_000)[0].collect()]
    assert len(chosen) == 1000 and sum(chosen) > 800


def test_clean_source(spark):
    df = spark.createDataFrame([(" Mailing-List ",), ("A_b",), (None,)], "s string")
    assert [r.x for r in df.select(mixing.clean_source(F.col("s")).alias("x")).collect()] == ["mailing_list", "a_b", None]


@pytest.mark.parametrize("edge_rows", [50_000, 100, 1])
def test_edge_of_light_documents_is_divided(spark, monkeypatch, edge_rows):
    """Documents of the least weight have the greatest keys; their edge is refined until few are left, and the budget is met as ever."""
    monkeypatch.setattr(mixing, "EDGE_ROWS", edge_rows)
    df = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 20 > 0, 4).otherwise(400).alias("chars"), (F.pmod(F.xxhash64("id"), F.lit(90)) + 10).alias("tokens"))
    df = df.unionByName(spark.range(300).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit(4).alias("chars"), F.lit(10).cast("long").alias("tokens")))
    targets = spark.createDataFrame([("s", 1.0, 2)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(df, targets, total_tokens=7_000_000)
    got, used = shares.head(), chosen.agg(F.sum("tokens"), F.count_distinct("doc_id")).head()
    assert abs(got.used_tokens - 7_000_000) <= 50 and used[0] == got.used_tokens
    key = F.log(-F.log(mixing.uniform(F.col("doc_id"), 7))) - F.log(mixing.quality_weight(F.col("chars"), F.col("tokens")))
    last = chosen.select("doc_id").distinct().join(df, "doc_id").agg(F.max(key)).head()[0]
    assert df.where(key < last).select("doc_id").distinct().count() <= used[1]  # the least keys are taken, and no others


def test_copies_on_the_edge(spark):
    """Of equal rows as many are taken as fit, without an order among them."""
    df = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit(40).alias("chars"), F.lit(10).cast("long").alias("tokens"))
    targets = spark.createDataFrame([("s", 1.0, 2)], "source string, target_share double, max_repeats int")
    assert [mixing.mix(df, targets, total_tokens=n)[0].agg(F.sum("uses")).head()[0] for n in (20_000, 50_000, 65_000, 4)] == [2000, 5000, 6500, None]
