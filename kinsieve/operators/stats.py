"""Chance baselines: how large an overlap would be if benchmark and training items were drawn independently.

The counts come from Spark; the tails are computed in Python on one row per kind of stratum: with whole numbers of any size up to pools
of ``EXACT_POOL`` items, and beyond in floating point, from the window of a distribution that isn't negligible. There a
stratum's probabilities have a relative error below 1e-9, and the tails of any number of strata an absolute one below 1e-9.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items of all strata up to which tails are exact.
EXACT_POOL = 20_000
#: Logarithm of the share of a distribution's peak below which values are left out, and the length from which on two distributions are
#: convolved by Fourier transforms.
NEGLIGIBLE, LONG = -60.0, 512


def moments(pool_n: int, bench_k: int, sample_n: int) -> tuple[float, float]:
    """(mean, variance) of the overlap of a sample with a benchmark."""
    share = bench_k / pool_n if pool_n else 0.0
    return sample_n * share, sample_n * share * (1 - share) * (pool_n - sample_n) / max(pool_n - 1, 1)


def _ways(pool_n: int, bench_k: int, sample_n: int) -> list[int]:
    """In how many ways a sample can hold 0, 1, ... benchmark items: whole numbers."""
    return [math.comb(bench_k, k) * math.comb(pool_n - bench_k, sample_n - k) for k in range(min(bench_k, sample_n) + 1)]


def distribution(pool_n: int, bench_k: int, sample_n: int) -> tuple[int, np.ndarray]:
    """(first value, probabilities) of the overlap, without values that are negligible beside the most likely one.

    Neighbours' ratios are summed as logarithms from the mode on, so that the cost grows with the deviation and not with the pool.
    """
    lo, hi = max(0, sample_n + bench_k - pool_n), min(bench_k, sample_n)
    mode = min(hi, max(lo, (sample_n + 1) * (bench_k + 1) // (pool_n + 2)))
    reach = int(12 * math.sqrt(moments(pool_n, bench_k, sample_n)[1])) + 200
    k = np.arange(max(lo, mode - reach), min(hi, mode + reach), dtype=np.float64)
    step = np.log((bench_k - k) * (sample_n - k)) - np.log((k + 1) * (pool_n - bench_k - sample_n + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(step)])
    logs -= logs.max()
    kept = np.flatnonzero(logs > NEGLIGIBLE)
    p = np.exp(logs[kept[0] : kept[-1] + 1])
    return max(lo, mode - reach) + int(kept[0]), p / p.sum()


def convolved(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
    """The distribution of a sum of two independent numbers."""
    (x, p), (y, q) = a, b
    size = len(p) + len(q) - 1
    if min(len(p), len(q)) < LONG:
        out = np.convolve(p, q)
    else:
        n = 1 << (size - 1).bit_length()
        out = np.maximum(np.fft.irfft(np.fft.rfft(p, n) * np.fft.rfft(q, n), n)[:size], 0.0)
    kept = np.flatnonzero(out > out.max() * math.exp(NEGLIGIBLE))
    out = out[kept[0] : kept[-1] + 1]
    return x + y + int(kept[0]), out / out.sum()


def hypergeom(pool_n: int, bench_k: int, sample_n: int, observed: int) -> dict:
    """Mean, deviation, z and upper tail of the overlap of a sample with a benchmark; z is None without variance."""
    out = stratified([(pool_n, bench_k, sample_n, 1)], observed)
    return {k: v for k, v in out.items() if k != "p_at_most"}


def stratified(strata: list[tuple[int, ...]], observed: int) -> dict:
    """The same within strata (pool_n, bench_k, sample_n) or (pool_n, bench_k, sample_n, times), by convolving their distributions; both tails."""
    counted = [(*s[:3], s[3] if len(s) > 3 else 1) for s in strata if s[0] and s[2]]
    mean = sum(t * moments(n, k, m)[0] for n, k, m, t in counted)
    var = sum(t * moments(n, k, m)[1] for n, k, m, t in counted)
    if sum(n * t for n, _, _, t in counted) <= EXACT_POOL:
        at_least, at_most = _exact_tails(counted, observed)
    else:
        at_least, at_most = _tails(counted, observed)
    return {"expected": mean, "sd": math.sqrt(var), "z": (observed - mean) / math.sqrt(var) if var > 0 else None, "p_at_least": at_least, "p_at_most": at_most}


def _exact_tails(counted: list[tuple[int, int, int, int]], observed: int) -> tuple[float, float]:
    ways, total = [1], 1
    for pool_n, bench_k, sample_n, times in counted:
        own = _ways(pool_n, bench_k, sample_n)
        for _ in range(times):
            mixed = [0] * (len(ways) + len(own) - 1)
            for i, a in enumerate(ways):
                if a:
                    for j, b in enumerate(own):
                        mixed[i + j] += a * b
            ways, total = mixed, total * math.comb(pool_n, sample_n)
    return sum(ways[max(0, observed):]) / total, sum(ways[: max(0, observed + 1)]) / total


def _tails(counted: list[tuple[int, int, int, int]], observed: int) -> tuple[float, float]:
    parts = []
    for pool_n, bench_k, sample_n, times in counted:
        one, power = distribution(pool_n, bench_k, sample_n), None
        while times:  # repeated squaring
            if times & 1:
                power = one if power is None else convolved(power, one)
            times >>= 1
            one = convolved(one, one) if times else one
        parts.append(power)
    parts.sort(key=lambda x: len(x[1]))
    while len(parts) > 1:  # pairs of about equal length, so that long ones are few
        parts = [convolved(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    first, p = parts[0] if parts else (0, np.ones(1))
    at = observed - first
    return float(p[max(0, at):].sum()), float(p[: max(0, at + 1)].sum())


_SCHEMA = "observed bigint, expected double, sd double, z double, p_at_least double, p_at_most double"


def _rounded(out: dict, observed: int) -> pd.DataFrame:
    z = out["z"]
    row = {"observed": observed, "expected": round(out["expected"], 4), "sd": round(out["sd"], 4), "z": None if z is None else round(z, 4), "p_at_least": round(out["p_at_least"], 6), "p_at_most": round(out.get("p_at_most", math.nan), 6) if "p_at_most" in out else None}
    return pd.DataFrame([row], columns=list(row)).astype({"z": "float64", "p_at_most": "float64"})


def strata(pool: DataFrame, group: str, in_bench: Column, in_sample: Column) -> DataFrame:
    """(group, pool_n, bench_k, sample_n, shared) for each group of the pool; one aggregation."""
    return pool.groupBy(group).agg(
        F.count(F.lit(1)).alias("pool_n"), F.count_if(in_bench).alias("bench_k"), F.count_if(in_sample).alias("sample_n"), F.count_if(in_bench & in_sample).alias("shared")
    )


def uniform_test(counts: DataFrame) -> DataFrame:
    """The test over all strata taken as one pool; one row. No rows in: no row out."""
    one = counts.agg(*[F.sum(c).alias(c) for c in ("pool_n", "bench_k", "sample_n", "shared")]).where("pool_n > 0").withColumn("k", F.lit(1))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        r = frame.iloc[0]
        return _rounded(hypergeom(int(r.pool_n), int(r.bench_k), int(r.sample_n), int(r.shared)), int(r.shared))

    return one.groupBy("k").applyInPandas(run, _SCHEMA)


def stratified_test(counts: DataFrame) -> DataFrame:
    """The test within strata; one row. ``counts`` has one row per stratum: projects, languages, repositories."""
    one = counts.groupBy("pool_n", "bench_k", "sample_n").agg(F.count(F.lit(1)).alias("times"), F.sum("shared").alias("shared")).withColumn("k", F.lit(1))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(r.pool_n), int(r.bench_k), int(r.sample_n), int(r.times)) for r in frame.sort_values(["pool_n", "bench_k", "sample_n"]).itertuples()]
        observed = int(frame["shared"].sum())
        return _rounded(stratified(rows, observed), observed)

    return one.groupBy("k").applyInPandas(run, _SCHEMA)


def within_range(items: DataFrame, group: str, number: str, known: DataFrame) -> DataFrame:
    """``items`` whose number lies between the least and greatest of ``known`` in the same group."""
    bounds = known.groupBy(group).agg(F.min(number).alias("lo"), F.max(number).alias("hi"))
    return items.join(bounds, group).where(F.col(number).between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def control_rate(successes: Column, pairs: Column) -> Column:
    """Share of control pairs that succeed, to three places; 0 without any."""
    return F.round(successes / F.greatest(pairs, F.lit(1)), 3)
