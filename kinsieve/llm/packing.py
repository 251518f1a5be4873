"""Problem 6: items of varying size in containers of fixed capacity with little unused space.

Method: a grouping genetic algorithm on islands. Items are spread by hash over blocks of bounded size; each block is evolved by
several islands. Crossover injects whole well-filled bins of one parent into the other, removes the bins that hold duplicates and
places the displaced items by best fit. Between epochs every island receives its neighbour's elite. Items of bins
that stay under-filled in their block meet those of other blocks in a further level.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsieve.plans.lineage import cut, written

BLOCK_ITEMS, ISLANDS, EPOCHS, GENERATIONS, POPULATION, LEVELS = 4096, 3, 2, 16, 6, 3
WELL_FILLED = 0.999
#: States of blocks, of about 64 KB each, in a task.
LANE_STATES = 64


def best_fit(sizes: np.ndarray, order: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Places the items of ``order`` (bin -1 so far) each where the least space stays free; opens bins where none fits."""
    held = bins >= 0
    count = int(bins.max()) + 1 if held.any() else 0
    loads = np.bincount(bins[held], weights=sizes[held], minlength=count).astype(np.int64)
    used = np.bincount(bins[held], minlength=count) > 0
    free = sorted((capacity - int(loads[b])) << 24 | b for b in range(count) if used[b])
    for i in order.tolist():
        size = int(sizes[i])
        at = bisect_left(free, size << 24)
        if at < len(free):
            entry = free.pop(at)
            b, left = entry & 0xFFFFFF, (entry >> 24) - size
        else:
            b, left = count, capacity - size
            count += 1
        bins[i] = b
        insort(free, left << 24 | b)
    return np.unique(bins, return_inverse=True)[1].reshape(-1)


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> float:
    """Mean squared fill: fewer bins and fuller ones are fitter."""
    return float(np.mean((np.bincount(bins, weights=sizes) / capacity) ** 2))


def crossover(rng: np.random.Generator, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int) -> np.ndarray:
    """Whole well-filled bins of ``b`` go into ``a``; ``a``'s bins that share an item with them are dissolved."""
    fill = np.bincount(b, weights=sizes) / capacity
    well = np.flatnonzero(fill >= np.median(fill))
    chosen = rng.choice(well, size=max(1, int(len(well) * rng.uniform(0.1, 0.5))), replace=False)
    injected = np.isin(b, chosen)
    broken = np.isin(a, np.unique(a[injected]))
    child = np.where(injected, b + int(a.max()) + 1, np.where(broken, -1, a))
    displaced = np.flatnonzero(child < 0)
    return best_fit(sizes, displaced[np.argsort(-sizes[displaced], kind="stable")], child, capacity)


def mutate(rng: np.random.Generator, sizes: np.ndarray, a: np.ndarray, capacity: int) -> np.ndarray:
    """Dissolves the emptiest bin and some others, and places their items anew in random order."""
    loads = np.bincount(a, weights=sizes)
    out = np.append(rng.choice(len(loads), size=min(len(loads), 4), replace=False), loads.argmin())
    child = np.where(np.isin(a, out), -1, a)
    return best_fit(sizes, rng.permutation(np.flatnonzero(child < 0)), child, capacity)


def evolve(sizes: np.ndarray, capacity: int, seed: int, elites: list[np.ndarray], generations: int = GENERATIONS, population: int = POPULATION) -> np.ndarray:
    """The fittest assignment of items to bins after ``generations``; ``elites`` join the first population."""
    rng = np.random.default_rng(seed)
    empty = np.full(len(sizes), -1)
    pool = [*elites, best_fit(sizes, np.argsort(-sizes, kind="stable"), empty.copy(), capacity)]
    while len(pool) < population:
        pool.append(best_fit(sizes, np.argsort(-sizes * rng.uniform(0.7, 1.3, len(sizes)), kind="stable"), empty.copy(), capacity))
    scored = sorted(((fitness(sizes, x, capacity), i, x) for i, x in enumerate(pool)), reverse=True, key=lambda s: s[:2])
    need = -(-int(sizes.sum()) // capacity)
    for g in range(generations):
        if int(scored[0][2].max()) + 1 <= need and scored[0][0] > 0.9999:
            break
        i, j = sorted(rng.integers(0, len(scored), 2).tolist())
        j = j if j != i else (i + 1) % len(scored)
        child = crossover(rng, sizes, scored[i][2], scored[j][2], capacity)
        if rng.random() < 0.5:
            child = mutate(rng, sizes, child, capacity)
        scored = sorted([*scored, (fitness(sizes, child, capacity), len(pool) + g, child)], reverse=True, key=lambda s: s[:2])[:population]
    return scored[0][2].astype(np.int64)


_STATE = "block bigint, island int, items array<bigint>, sizes array<int>, bins array<int>, fit double"


def _epoch(capacity: int, epoch: int, generations: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                sizes = np.asarray(row.sizes, dtype=np.int64)
                elites = [np.asarray(x, dtype=np.int64) for x in (row.bins, row.guest) if x is not None]
                seed = (int(row.block) * 1_000_003 + int(row.island) * 1009 + epoch) % 2**63
                bins = evolve(sizes, capacity, seed, elites, generations)
                yield pd.DataFrame({"block": [row.block], "island": [row.island], "items": [row.items], "sizes": [row.sizes], "bins": [bins.astype("int32")], "fit": [fitness(sizes, bins, capacity)]})

    return run


def _level(rest: DataFrame, count: int, level: int, capacity: int, block_items: int, islands: int, epochs: int, generations: int) -> DataFrame:
    """(item, block, bin, load) of ``rest`` (item, tokens) packed within blocks of about ``block_items``."""
    blocks = max(1, -(-count // block_items))
    block = F.pmod(F.xxhash64("item", F.lit(level)), F.lit(blocks))
    grouped = rest.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("tokens", "item")), asc=False).alias("x"))  # a block is bounded
    state = grouped.select("block", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), F.col("x.item").alias("items"), F.col("x.tokens").alias("sizes"), F.lit(None).cast("array<int>").alias("bins"), F.lit(None).cast("array<int>").alias("guest"))
    states = blocks * islands
    lanes = max(rest.sparkSession.sparkContext.defaultParallelism, min(states, 4096), -(-states // LANE_STATES))
    for epoch in range(epochs):
        state = state.repartition(lanes, "block", "island")
        state = cut(state.mapInPandas(_epoch(capacity, epoch, generations), _STATE))
        if epoch + 1 < epochs:
            guests = state.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("bins").alias("guest"))
            state = state.join(guests, ["block", "island"])
    best = state.groupBy("block").agg(F.max_by(F.struct("items", "sizes", "bins"), F.struct("fit", -F.col("island"))).alias("s"))
    rows = best.select("block", F.explode(F.arrays_zip("s.items", "s.sizes", "s.bins")).alias("z"))
    rows = rows.select(F.col("z.items").alias("item"), F.col("z.sizes").alias("tokens"), "block", F.col("z.bins").alias("bin"))
    loads = rows.groupBy("block", "bin").agg(F.sum("tokens").alias("load"))
    return rows.join(loads, ["block", "bin"])


def pack(sizes: DataFrame, capacity: int, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS) -> DataFrame:
    """(doc_id, part, first_token, tokens, container) for ``sizes`` (doc_id, tokens).

    A document is divided only if it alone exceeds ``capacity``: into full containers of its own and one remaining part.
    Rows without tokens (null, zero) get no container; equal rows are items of their own; an empty table gives no rows.
    Every item is placed exactly once, and no container exceeds the capacity.
    """
    sized = sizes.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("tokens").cast("bigint").alias("n")).where(F.col("n") > 0)
    parts = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))).alias("part"))
    # an item has a number of its own, so that rows that share an id spread like any others; the checkpoint fixes it
    items = cut(parts.select("doc_id", "part", F.least(F.lit(capacity), F.col("n") - F.col("part") * F.lit(capacity)).cast("int").alias("tokens"), F.monotonically_increasing_id().alias("item")))
    placed = [items.where(F.col("tokens") == capacity).select("item", F.concat_ws("-", F.lit("full"), "item").alias("container"))]
    rest = items.where(F.col("tokens") < capacity).select("item", "tokens")
    count = rest.count()
    for level in range(LEVELS):
        if not count:
            break
        packed = cut(_level(rest, count, level, capacity, block_items, islands, epochs, generations))
        last = level == LEVELS - 1 or count <= block_items
        kept = packed if last else packed.where(F.col("load") >= WELL_FILLED * capacity)
        placed.append(kept.select("item", F.concat_ws("-", F.lit(f"level{level}"), "block", "bin").alias("container")))
        if last:
            break
        rest = packed.where(F.col("load") < WELL_FILLED * capacity).select("item", "tokens")
        count = rest.count()
    containers = placed[0]
    for more in placed[1:]:
        containers = containers.unionByName(more)
    return items.join(containers, "item").select("doc_id", "part", (F.col("part").cast("bigint") * capacity).alias("first_token"), "tokens", "container")


def pack_documents(docs: DataFrame, capacity: int, tokenizer: str | None = None) -> DataFrame:
    """``pack`` of a table (doc_id, text), measured in tokens; null and empty texts are left out."""
    from kinsieve.llm.tokens import token_sizes

    return pack(written(token_sizes(docs, tokenizer=tokenizer)), capacity)
