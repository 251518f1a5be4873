"""Problem 4: all pairs of records whose sets of word runs have at least a given Jaccard similarity.

Method: rare-first prefix filtering with length, positional and suffix filters, joined on prefix n-grams and verified once per pair.

1. A sketch of the frequency of all n-grams (counts by hash, of fixed size) gives one order for all records, rare first. Any fixed
   order makes prefix filtering exact; the sketch only decides how few candidates there are.
2. Records with equal sets form a class. Each class sends the hashes of its prefix, packed by bucket of the n-gram. There are as many
   buckets as the prefixes need at a fixed size of a bucket. Pairs of a bucket pass the length and positional filters.
3. Each candidate pair is verified once, on the texts of one record of each class: suffix filter, then the exact similarity.
4. Class pairs are expanded to rows over the membership.

No bucket grows with what is hot. Of a class with many copies one record alone sends its prefix. N-grams whose holders are a
share of all data are seen in the sketch and spread over a triangle of blocks, so that any two holders meet; those that the sketch
can't tell from chance are counted where they meet, and spread in the same way by a second shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsieve.plans.lineage import cut, lookup, spread, written

_WORD = re.compile(r"\w+")
#: Counters of the sketch (4 bytes each in a task, 1 byte when broadcast): a fixed size, whatever the data.
SKETCH_BITS, CHUNK = 22, 1 << 16
#: An n-gram with more holders than this (by the sketch; twice as many by their count) is spread over blocks of about this many.
HOT_GRAM = 8192
#: Prefix n-grams in a bucket, on average: about 8 MB as sent.
BUCKET_ENTRIES = 400_000
#: A class with more copies than this, and than this share of all rows, sends one prefix: fewer than COPIES_SHARE such classes exist.
COPIES, COPIES_SHARE = 1000, 100_000
#: Candidate pairs that a bucket's task holds before it hands them on, and classes that a task remembers to have sent.
HELD_PAIRS, HELD_CLASSES = 2_000_000, 500_000
SLACK = 1e-9
MATCH_STEP, MOST_MATCHES = 16, 12


def _u64(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


# Odd multipliers of the polynomial over word hashes, and of the final mixing.
_STEP, _MIX1, _MIX2 = _u64(0x9E3779B97F4A7C15), _u64(0xFF51AFD7ED558CCD), _u64(0xC4CEB9FE1A85EC53)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX1
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX2
    return h ^ (h >> np.uint64(33))


class Grams:
    """Hashes of the runs of ``n`` words of a text; word hashes are kept while there are not too many."""

    def __init__(self, n: int, held: int = 500_000):
        self.n, self.held, self.words = n, held, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """The distinct hashes in ascending order; none for a null text or one of fewer than n words."""
        words = _WORD.findall(text.lower()) if text else []
        if len(words) < self.n:
            return np.empty(0, np.uint64)
        known = self.words
        if len(known) > self.held:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self._hash(w)
        w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        h = w[: len(w) - self.n + 1].copy()
        for i in range(1, self.n):
            h = h * _STEP + w[i : len(w) - self.n + 1 + i]
        return np.unique(mixed(h))

    @staticmethod
    def _hash(word: str) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(word)


def signature(grams: np.ndarray) -> int:
    """A 64-bit name of a set (with its size: equal sets, equal names)."""
    total = int(np.bitwise_xor.reduce(mixed(grams + _STEP))) ^ (int(grams.sum(dtype=np.uint64)) * 0x9E3779B97F4A7C15)
    return int(np.int64(np.uint64(total & 0xFFFFFFFFFFFFFFFF)))


def matches_needed(n):
    """Common n-grams that the prefixes of a pair must have, by the size of the smaller set. Each one more lengthens the prefix by
    one, and with it pairs that meet in a single phrase are no candidates."""
    return np.clip(np.asarray(n) // MATCH_STEP, 1, MOST_MATCHES)


def _needed(size: Column) -> Column:
    """``matches_needed`` of a column."""
    return F.greatest(F.lit(1), F.least(F.lit(MOST_MATCHES), F.floor(size / MATCH_STEP)))


def prefix_length(n: int, t: float) -> int:
    """Of two sets with at least ceil(t * n) common members, the first n - ceil(t * n) + k share at least k."""
    return min(n, n - math.ceil(t * n - SLACK) + int(matches_needed(n)))


def _sketch(n: int, bits: int):
    """Batches of (id, text) -> one row of counts per chunk of the sketch, and one row of membership per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = Grams(n), np.zeros(1 << bits, np.uint32)
        for batch in batches:
            ids, names, sizes = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                g = grams(text)
                if len(g):
                    np.add.at(counts, g >> np.uint64(64 - bits), 1)
                    ids.append(i), names.append(signature(g)), sizes.append(len(g))
            yield _rows(chunk=[None] * len(ids), counts=[None] * len(ids), id=ids, name=names, size=sizes)
        for c in range(0, len(counts), CHUNK):
            part = counts[c : c + CHUNK]
            if part.any():
                yield _rows(chunk=[c // CHUNK], counts=[pa.compress(part.tobytes(), codec="zstd", asbytes=True)], id=[None], name=[None], size=[None])

    return run


_SKETCH_SCHEMA = "chunk int, counts binary, id bigint, name bigint, size int"
_KINDS = {"chunk": pa.int32(), "counts": pa.binary(), "id": pa.int64(), "name": pa.int64(), "size": pa.int32(), "bucket": pa.int32(), "blob": pa.binary(), "cell": pa.int64(), "matches": pa.int64(), "first": pa.bool_(), "a": pa.int64(), "b": pa.int64(), "a_size": pa.int32(), "b_size": pa.int32(), "similarity": pa.float64()}


def _rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, _KINDS[k]) for k, v in columns.items()], list(columns))


def _merged(frame):
    import pandas as pd

    total = np.zeros(CHUNK, np.uint64)
    for blob in frame["counts"]:
        total += np.frombuffer(pa.decompress(blob, decompressed_size=CHUNK * 4, codec="zstd", asbytes=True), np.uint32)
    # eight steps for each doubling: enough to order by, and one byte
    code = np.minimum(255, np.round(np.log2(total.astype(np.float64) + 1) * 8)).astype(np.uint8)
    return pd.DataFrame({"chunk": [int(frame["chunk"].iloc[0])], "code": [code.tobytes()]})


def _order(rows: DataFrame, bits: int) -> np.ndarray:
    """The sketch on the driver: 2^bits bytes, whatever the data."""
    merged = rows.where(F.col("chunk").isNotNull()).select("chunk", "counts").groupBy("chunk").applyInPandas(_merged, "chunk int, code binary")
    out = np.zeros(1 << bits, np.uint8)
    for row in merged.toLocalIterator():
        out[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.code, np.uint8)
    return out


def _cell(gram: int, lo: int, hi: int) -> int:
    """The name of the place where two blocks of an n-gram's holders meet."""
    return int(mixed(np.array([gram ^ (lo * 1_000_003 + hi + 1)], np.uint64))[0])


def _prefixes(n: int, t: float, bits: int, buckets: int, hot: int, noise: float, order, senders):
    """Batches of (id, text) -> packed prefixes: a row for each batch and bucket. ``senders`` has the record that sends for a class of many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, code, only, seen = Grams(n), order.value, senders.value, set()
        hot_code = min(255, math.ceil(math.log2(hot + noise + 1) * 8))
        for batch in batches:
            parts = []
            if len(seen) > HELD_CLASSES:
                seen.clear()
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                g = grams(text)
                name = signature(g) if len(g) else 0
                if not len(g) or (name, len(g)) in seen or only.get((name, len(g)), i) != i:
                    continue
                seen.add((name, len(g)))
                rank = code[(g >> np.uint64(64 - bits)).astype(np.int64)]
                first = np.argsort(rank, kind="stable")[: prefix_length(len(g), t)]
                parts.append((name, len(g), g[first], rank[first]))
            if not parts:
                continue
            lengths = [len(p[2]) for p in parts]
            name = np.repeat(np.array([p[0] for p in parts], np.int64), lengths)
            size = np.repeat(np.array([p[1] for p in parts], np.int32), lengths)
            gram, rank = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
            at = np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])
            side = np.zeros(len(gram), np.int32)
            hots = np.flatnonzero(rank > hot_code)
            if len(hots):  # holder block i meets block j in cell (i, j): a copy for every j
                extra = []
                for k in hots.tolist():
                    blocks = max(2, math.ceil((2 ** (int(rank[k]) / 8) - noise) / hot))
                    mine = int(name[k]) % blocks
                    for other in range(blocks):
                        lo, hi = min(mine, other), max(mine, other)
                        extra.append((int(name[k]), int(size[k]), _cell(int(gram[k]), lo, hi), int(at[k]), 0 if lo == hi else 1 + (mine == hi)))
                keep = np.ones(len(gram), bool)
                keep[hots] = False
                e = list(zip(*extra))
                name, size, at, side = (np.concatenate([x[keep], np.array(y, x.dtype)]) for x, y in ((name, e[0]), (size, e[1]), (at, e[3]), (side, e[4])))
                gram = np.concatenate([gram[keep], np.array(e[2], np.uint64)])
            bucket = (gram % np.uint64(buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[by])) + 1
            out = [(int(bucket[k[0]]), _pack(gram[k], name[k], size[k], at[k], side[k])) for k in np.split(by, cuts)]
            yield _rows(bucket=[o[0] for o in out], blob=[o[1] for o in out])

    return run


def _pack(gram, name, size, at, side) -> bytes:
    names, which = np.unique(name, return_inverse=True)
    sizes = np.zeros(len(names), np.int32)
    sizes[which] = size
    raw = b"".join([np.array([len(gram), len(names)], np.int64).tobytes(), gram.tobytes(), names.tobytes(), sizes.tobytes(), which.astype(np.int32).tobytes(), at.tobytes(), side.astype(np.uint8).tobytes()])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes):
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    k, m = np.frombuffer(raw, np.int64, 2)
    at = 16
    gram = np.frombuffer(raw, np.uint64, k, at)
    names = np.frombuffer(raw, np.int64, m, at := at + 8 * k)
    sizes = np.frombuffer(raw, np.int32, m, at := at + 8 * m)
    which = np.frombuffer(raw, np.int32, k, at := at + 4 * m)
    place = np.frombuffer(raw, np.int32, k, at := at + 4 * k)
    side = np.frombuffer(raw, np.uint8, k, at + 4 * k)
    return gram, names[which], sizes[which], place, side


def holders(gram, name, size, at, side) -> tuple[np.ndarray, ...]:
    """The entries in the order of n-gram and size, each class once an n-gram."""
    by = np.lexsort((name, size, gram))
    gram, name, size, at, side = gram[by], name[by], size[by], at[by], side[by]
    fresh = np.ones(len(gram), bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (name[1:] != name[:-1]) | (size[1:] != size[:-1])
    return gram[fresh], name[fresh], size[fresh], at[fresh], side[fresh]


def divided(gram, name, size, at, side, hot: int) -> tuple[tuple[np.ndarray, ...], Iterator[tuple[int, tuple[np.ndarray, ...]]]]:
    """(entries of the other n-grams, cells) of ``holders``: n-grams of more than twice ``hot`` holders leave for cells of two blocks each.

    Every two holders meet in one cell: those of block i and j in the cell (i, j), those of one block in (i, i).
    """
    begin = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.empty(0, np.int64)
    count = np.diff(np.append(begin, len(gram)))
    much = [(int(b), int(c)) for b, c in zip(begin[count > 2 * hot], count[count > 2 * hot]) if not side[b : b + c].any()]
    keep = np.ones(len(gram), bool)
    for b, c in much:
        keep[b : b + c] = False

    def cells():
        for b, c in much:
            part = [x[b : b + c] for x in (gram, name, size, at)]
            blocks = math.ceil(c / hot)
            mine = (name[b : b + c].astype(np.uint64) % np.uint64(blocks)).astype(np.int64)
            rows = [np.flatnonzero(mine == k) for k in range(blocks)]
            for lo in range(blocks):
                for hi in range(lo, blocks):
                    x = rows[lo] if lo == hi else np.concatenate([rows[lo], rows[hi]])
                    other = np.zeros(len(x), np.int32) if lo == hi else np.repeat(np.array([1, 2], np.int32), [len(rows[lo]), len(rows[hi])])
                    yield _cell(int(gram[b]), lo, hi), (*(p[x] for p in part), other)

    return tuple(x[keep] for x in (gram, name, size, at, side)), cells()


def pairs_of_bucket(gram, name, size, at, side, t: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(name, size, name, size, first) for each two of ``holders`` of an n-gram that pass the length and positional filters.

    ``first`` says that the match may be the pair's first one, which every similar pair has.
    """
    first = np.flatnonzero(np.append(gram[:-1] == gram[1:], False)) if len(gram) else np.empty(0, np.int64)
    step = 1
    while len(first):
        second = first + step
        ok = second < len(gram)
        first, second = first[ok], second[ok]
        alive = (gram[first] == gram[second]) & (size[first] >= np.ceil(t * size[second] - SLACK))  # sizes ascend: length filter
        first, second = first[alive], second[alive]
        need = np.ceil(t / (1 + t) * (size[first].astype(np.int64) + size[second]) - SLACK)
        rest = np.minimum(size[first] - at[first], size[second] - at[second])
        good = (rest + np.minimum(at[first], at[second]) >= need) & ((side[first] == 0) | (side[first] != side[second]))
        if good.any():
            yield name[first[good]], size[first[good]], name[second[good]], size[second[good]], (rest >= need)[good]
        step += 1


_MATCHES = "a bigint, a_size int, b bigint, b_size int, matches bigint, first boolean, cell bigint, blob binary"


def _matched(entries: tuple[np.ndarray, ...], t: float) -> Iterator[pa.RecordBatch]:
    """Pairs of classes with the number of their matches among ``holders``; a pair may come more than once if there are many."""
    keys, held, rows = ["a", "a_size", "b", "b_size"], [], 0

    def summed() -> pa.RecordBatch:
        found = pa.concat_tables(held).group_by(keys).aggregate([("first", "count"), ("first", "max")]).to_pydict()
        n = len(found["a"])
        return _rows(**{k: found[k] for k in keys}, matches=found["first_count"], first=found["first_max"], cell=[None] * n, blob=[None] * n)

    for x, sx, y, sy, first in pairs_of_bucket(*entries, t):
        swap = (x > y) | ((x == y) & (sx > sy))
        ends = (np.where(swap, y, x), np.where(swap, sy, sx), np.where(swap, x, y), np.where(swap, sx, sy))
        held.append(pa.table([*ends, first], names=[*keys, "first"]))
        rows += len(x)
        if rows > HELD_PAIRS:
            yield summed()
            held, rows = [], 0
    if held:
        yield summed()


def _joined(t: float, hot: int | None):
    """Packed entries of one bucket or cell -> pairs of classes, and packed cells of n-grams that turn out ``hot`` (none: never)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [v for batch in batches for v in batch.column(batch.schema.get_field_index("blob")).to_pylist()]
        if not blobs:
            return
        entries = holders(*(np.concatenate(c) for c in zip(*map(_unpack, blobs))))
        if hot is not None:
            entries, cells = divided(*entries, hot)
            for cell, part in cells:
                none = [None]
                yield _rows(a=none, a_size=none, b=none, b_size=none, matches=none, first=none, cell=[int(np.int64(np.uint64(cell)))], blob=[_pack(*part)])
        yield from _matched(entries, t)

    return run


def _cell_pairs(t: float):
    def run(table: pa.Table) -> pa.Table:
        done = list(_joined(t, None)(iter(table.to_batches())))
        columns = [f.split(" ")[0] for f in _MATCHES.split(", ")]
        return pa.Table.from_batches(done) if done else pa.table({c: pa.array([], _KINDS[c]) for c in columns})

    return run


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 2) -> int:
    """An upper bound of the common members of two ascending arrays: halves are compared by size around a pivot."""
    if not len(x) or not len(y):
        return 0
    if depth == 0:
        return min(len(x), len(y))
    middle = len(y) // 2
    at = int(np.searchsorted(x, y[middle]))
    return suffix_bound(x[:at], y[:middle], depth - 1) + suffix_bound(x[at:], y[middle:], depth - 1)


def similarity(x: np.ndarray, y: np.ndarray, t: float) -> float:
    """The Jaccard similarity of two ascending arrays without repeats, or 0 where the suffix filter shows it below ``t``."""
    need = math.ceil(t / (1 + t) * (len(x) + len(y)) - SLACK)
    if suffix_bound(x, y) < need:
        return 0.0
    common = len(x) + len(y) - len(np.union1d(x, y))
    return common / (len(x) + len(y) - common)


def _verified(n: int, t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held = Grams(n), {}

        def of(name, text):
            if name not in held:
                if len(held) > 2000:
                    held.clear()
                held[name] = grams(text)
            return held[name]

        for batch in batches:
            c = {k: batch.column(i).to_pylist() for i, k in enumerate(batch.schema.names)}
            scores = [similarity(of((a, sa), x), of((b, sb), y), t) for a, sa, b, sb, x, y in zip(c["a"], c["a_size"], c["b"], c["b_size"], c["a_text"], c["b_text"])]
            keep = [i for i, s in enumerate(scores) if s >= t]
            yield _rows(**{k: [c[k][i] for i in keep] for k in ("a", "a_size", "b", "b_size")}, similarity=[scores[i] for i in keep])

    return run


def similar_classes(records: DataFrame, row_id: str, text: Column, n: int = 5, t: float = 0.8, sketch_bits: int = SKETCH_BITS, hot: int = HOT_GRAM) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): classes of records with equal sets of n-word runs, and all pairs of classes with similarity >= t.

    pairs has (a, a_size, b, b_size, similarity), members (row_id, name, size); a class is named by (name, size). Records whose
    text is null or has fewer than n words have an empty set, belong to no class and are similar to none. The text is
    read whole. Equal rows are members of one class each; ``records`` may have any other columns.
    """
    spark = records.sparkSession
    base = spread(records.select(F.col(f"`{row_id}`").cast("bigint").alias("id"), text.alias("text")))
    counted = written(base.mapInArrow(_sketch(n, sketch_bits), _SKETCH_SCHEMA))
    codes = _order(counted, sketch_bits)
    # a counter also holds the n-grams that fall on it by chance: as many as the average, which says nothing of an n-gram
    noise = float(np.mean(np.exp2(codes / 8) - 1))
    order = spark.sparkContext.broadcast(codes)
    members = counted.where(F.col("chunk").isNull()).select(F.col("id").alias("row_id"), "name", "size")
    prefix = F.least(F.col("size"), F.col("size") - F.ceil(t * F.col("size") - SLACK) + _needed(F.col("size")))
    rows, entries = members.agg(F.count(F.lit(1)), F.coalesce(F.sum(prefix), F.lit(0))).head()
    many = members.groupBy("name", "size").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("id")).where(F.col("n") > max(COPIES, rows // COPIES_SHARE))
    senders = spark.sparkContext.broadcast({(r["name"], r["size"]): r["id"] for r in many.collect()})  # fewer than COPIES_SHARE
    buckets = max(spark.sparkContext.defaultParallelism, math.ceil(entries / BUCKET_ENTRIES))
    packed = base.mapInArrow(_prefixes(n, t, sketch_bits, buckets, hot, noise, order, senders), "bucket int, blob binary")
    joined = written(packed.repartitionById(buckets, "bucket").mapInArrow(_joined(t, hot), _MATCHES))
    pairs = joined.where(F.col("cell").isNull())
    apart = joined.where(F.col("cell").isNotNull()).select("cell", "blob").groupBy("cell").applyInArrow(_cell_pairs(t), _MATCHES)
    met = pairs.unionByName(apart).groupBy("a", "a_size", "b", "b_size").agg(F.sum("matches").alias("matches"), F.max("first").alias("first"))
    needed = _needed(F.least("a_size", "b_size"))
    candidates = written(met.where(F.col("first") & (F.col("matches") >= needed)).select("a", "a_size", "b", "b_size"))
    ends = candidates.select(F.col("a").alias("name"), F.col("a_size").alias("size")).unionByName(candidates.select(F.col("b").alias("name"), F.col("b_size").alias("size"))).distinct()
    chosen = members.groupBy("name", "size").agg(F.min("row_id").alias("id")).join(ends, ["name", "size"])
    texts = written(base.join(chosen, "id").select("name", "size", "text").dropDuplicates(["name", "size"]))
    side = lambda s: texts.select(F.col("name").alias(s), F.col("size").alias(f"{s}_size"), F.col("text").alias(f"{s}_text"))
    with_texts = candidates.join(side("a"), ["a", "a_size"]).join(side("b"), ["b", "b_size"])
    checked = with_texts.select("a", "a_size", "b", "b_size", "a_text", "b_text").mapInArrow(_verified(n, t), "a bigint, a_size int, b bigint, b_size int, similarity double")
    return cut(checked), members


def similar_pairs(records: DataFrame, row_id: str, text: Column, n: int = 5, t: float = 0.8, **options) -> DataFrame:
    """(row_id_a, row_id_b, similarity), row_id_a < row_id_b: every pair of rows with similarity >= t, copies included."""
    pairs, members = similar_classes(records, row_id, text, n, t, **options)
    one = lambda s: members.select(F.col("name").alias(s), F.col("size").alias(f"{s}_size"), F.col("row_id").alias(f"{s}_row"))
    across = pairs.join(one("a"), ["a", "a_size"]).join(one("b"), ["b", "b_size"]).select("a_row", "b_row", "similarity")
    many = members.groupBy("name", "size").count().where("count > 1").select("name", "size")
    copies = members.join(many, ["name", "size"])
    left, right = copies.withColumnRenamed("row_id", "a_row"), copies.withColumnRenamed("row_id", "b_row")
    within = left.join(right, ["name", "size"]).where("a_row < b_row").select("a_row", "b_row", F.lit(1.0).alias("similarity"))
    both = across.unionByName(within)
    return both.select(F.least("a_row", "b_row").alias("row_id_a"), F.greatest("a_row", "b_row").alias("row_id_b"), "similarity")


def near_duplicates(records: DataFrame, row_id: str, text: Column, n: int = 5, t: float = 0.8, **options) -> DataFrame:
    """(row_id, class_id, links): one row per record with a set of runs. class_id is the smallest row id of its class of equal
    sets joined with all classes similar to it, directly or through others; links counts the directly similar other rows."""
    from kinsieve.llm.groups import groups

    pairs, members = similar_classes(records, row_id, text, n, t, **options)
    sized = cut(members.groupBy("name", "size").agg(F.count(F.lit(1)).alias("rows"), F.min("row_id").alias("record_id")))
    a = sized.select(F.col("name").alias("a"), F.col("size").alias("a_size"), F.col("rows").alias("a_rows"), F.col("record_id").alias("a_id"))
    b = sized.select(F.col("name").alias("b"), F.col("size").alias("b_size"), F.col("rows").alias("b_rows"), F.col("record_id").alias("b_id"))
    edges = cut(pairs.join(a, ["a", "a_size"]).join(b, ["b", "b_size"]))
    links = edges.select(F.col("a_id").alias("record_id"), F.col("b_rows").alias("k")).unionByName(edges.select(F.col("b_id").alias("record_id"), F.col("a_rows").alias("k"))).groupBy("record_id").agg(F.sum("k").alias("k"))
    found = groups(sized, edges.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    classes = sized.join(found, "record_id").join(links, "record_id", "left")
    # a class of copies may hold a third of all rows: the classes that do are few and reach the rows by broadcast
    key = F.struct("name", "size").alias("class")
    mapping = cut(classes.select(key, F.col("rows").alias("weight"), F.col("group_id").alias("class_id"), (F.coalesce("k", F.lit(0)) + F.col("rows") - 1).alias("links")))
    total, hottest = mapping.agg(F.sum("weight"), F.max("weight")).head()
    return lookup(members.select("row_id", key), mapping, "class", max(20_000, (total or 0) // 200), hottest or 0).select("row_id", "class_id", "links")
