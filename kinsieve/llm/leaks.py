"""Problem 2: documents that contain passages of held-out evaluation items.

Method: latent semantic retrieval, then longest common subsequences and checks of the answer.

1. Both sides become words free of markup and odd spellings; only words of the items have a number, all others are one blank.
2. TF-IDF. Document frequencies of the items' words are counted over all documents.
3. A randomised SVD of the TF-IDF passages of the items and of all documents' passages that speak of them: each pass over the
   documents is distributed and returns sums of fixed size, vocabulary x rank; only small factors meet on the driver.
4. Candidates: passages of documents whose latent vector covers a passage of an item, by projected cosine.
   Passages whose norm can't reach the threshold are skipped (Cauchy-Schwarz), as are those that speak of no item of which the
   document has the own words that a leak keeps.
5. Checks: the longest common subsequence of item and document around the candidate must hold fifteen words in a row of the
   item, or all of it, with at most one word in six changed, and enough of it must be the item's own wording.

Items are searched for in parts of a bounded number of passages, each with a vocabulary and a latent space of its own; what is the wording
of an item alone and how frequent words are comes from all items and all documents.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsieve.llm.plaintext import plain
from kinsieve.plans.lineage import spread, written

_WORD = re.compile(r"\w+")
#: Words in a passage of an item and between two of them; of a document, which holds an item's passage whole with two words more.
ITEM_WORDS, ITEM_STEP, DOC_WORDS, DOC_STEP = 10, 5, 24, 12
RANK, OVERSAMPLE, THRESHOLD = 128, 16, 0.4
#: Documents, chosen by hash, on whose passages the latent space is fitted (frequencies and the search cover all of them).
FIT_DOCS = 10_000
#: Least weight of a word that is an item's own: copies of one leak may be any share of the documents, and make its words frequent.
LEAST_WEIGHT = 1.0
#: Passages of items in a part: its projections take half a KB each on the driver and in every task.
PART_PASSAGES = 50_000
#: Numbers of the largest array of cosines that a task makes at once.
CELLS = 8_000_000
#: A word is an item's own if it stands in at most so many items.
OWN_ITEMS = 2
#: Fewest words of a passage, share of changed ones, fewest own words that must be kept in it.
PASSAGE, CHANGED, OWN = 15, 1 / 6, 2


class Items:
    """The held-out texts as numbers of their words: of bounded size, as there is a bounded number of items."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        words = {i: w for i, w in ((i, _WORD.findall(plain(t))) for i, t in rows if t) if w}
        self.number = {w: n for n, w in enumerate(sorted({x for w in words.values() for x in w}))}
        self.ids = {i: np.array([self.number[x] for x in w], np.int32) for i, w in words.items()}
        # wording that stands in more than OWN_ITEMS items is form text or a phrase of crash reports; items of the same words are one text
        texts = {x.tobytes(): x for x in self.ids.values()}
        holders = sum((np.bincount(np.unique(x), minlength=len(self.number)) for x in texts.values()), np.zeros(len(self.number), np.int64))
        self.own = {i: holders[x] <= OWN_ITEMS for i, x in self.ids.items()}

    def parts(self, most: int = PART_PASSAGES) -> Iterator["Part"]:
        """All items, in parts of about ``most`` passages."""
        held: list[int] = []
        passages = 0
        for i in sorted(self.ids):
            passages += -(-len(self.ids[i]) // ITEM_STEP)
            held.append(i)
            if passages >= most:
                yield Part(self, held)
                held, passages = [], 0
        if held:
            yield Part(self, held)


class Part:
    """Some items with a numbering of their own words. ``local`` turns the numbers of all items' words into it, others into -1."""

    def __init__(self, items: Items, chosen: list[int]):
        known = np.unique(np.concatenate([items.ids[i] for i in chosen]))
        self.words = known
        self.local = np.full(len(items.number) + 1, -1, np.int32)  # the last place is that of -1
        self.local[known] = np.arange(len(known), dtype=np.int32)
        self.ids = {i: self.local[items.ids[i]] for i in chosen}
        self.own = {i: items.own[i] for i in chosen}
        self.own_set = {i: set(self.ids[i][self.own[i]].tolist()) for i in chosen}
        self.counts = {i: Counter(x.tolist()) for i, x in self.ids.items()}
        # the items (by place) whose own a word is, of which there are OWN_ITEMS at most beside items of the same words; none in the last row
        pairs = np.array([(w, n) for n, i in enumerate(self.own_set) for w in self.own_set[i]], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        place = np.arange(len(pairs)) - np.searchsorted(pairs[:, 0], pairs[:, 0])
        self.owned = np.full((len(known) + 1, int(place.max(initial=0)) + 1), -1, np.int32)
        self.owned[pairs[:, 0], place] = pairs[:, 1]
        self.least_own = np.array([min(OWN, len(x)) for x in self.own_set.values()], np.int64)
        # passages of shared wording alone make no case
        at = [(i, k) for i, w in self.ids.items() for k in range(0, max(1, len(w) - ITEM_WORDS + ITEM_STEP), ITEM_STEP) if self.own[i][k : k + ITEM_WORDS].any()]
        self.owners = np.array([i for i, _ in at], np.int64)
        rows = np.full((len(at), ITEM_WORDS), -1, np.int32)
        for row, (i, k) in zip(rows, at):
            w = self.ids[i][k : k + ITEM_WORDS]
            row[: len(w)] = w
        self.rows = distinct(rows)

    def speaking(self, ids: np.ndarray, weight: np.ndarray, floor: float, any_word: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(starts, passages x DOC_WORDS numbers, filled up with -1) of a document that may hold a part of a leak: with a word that is the own one of an item of which the document
        has as many own words as a leak keeps, and of at least the energy ``floor``. With ``any_word`` the energy alone decides."""
        known = ids >= 0
        words, place = np.unique(ids[known], return_inverse=True)
        owned = self.owned[words]
        enough = np.bincount(owned[owned >= 0], minlength=len(self.least_own)) >= np.maximum(self.least_own, 1)
        if not (any_word and len(words)) and not enough.any():
            return np.empty(0, np.int64), np.empty((0, DOC_WORDS), np.int32)
        speaks, energy = np.zeros(len(ids) + 1, np.int64), np.zeros(len(ids) + 1)
        speaks[1:][known] = (np.append(enough, False)[owned].any(axis=1) | any_word)[place]
        energy[1:][known] = (weight[words] ** 2)[place]
        speaks, energy = speaks.cumsum(), energy.cumsum()
        starts = passage_starts(len(ids))
        ends = np.minimum(starts + DOC_WORDS, len(ids))
        starts = starts[(speaks[ends] > speaks[starts]) & (energy[ends] - energy[starts] >= floor * (1 - 1e-6))]
        return starts, np.append(ids, np.full(DOC_WORDS, -1, np.int32))[starts[:, None] + np.arange(DOC_WORDS)[None, :]]


def distinct(rows: np.ndarray) -> np.ndarray:
    """Passages (passage x words, -1 for none) with each word once."""
    rows = np.sort(rows, axis=1)
    rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = -1
    return rows


def times(rows: np.ndarray, weight: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A x, where A has a row for each passage with the weights of its words; A is never made."""
    out = np.zeros((len(rows), x.shape[1]), np.float32)
    for c in range(rows.shape[1]):
        held = np.flatnonzero(rows[:, c] >= 0)
        w = rows[held, c]
        out[held] += x[w] * weight[w][:, None]
    return out


def transposed(rows: np.ndarray, weight: np.ndarray, y: np.ndarray, out: np.ndarray) -> None:
    """Adds A^T y to ``out``."""
    for c in range(rows.shape[1]):
        held = np.flatnonzero(rows[:, c] >= 0)
        held = held[np.argsort(rows[held, c], kind="stable")]
        if len(held):
            w = rows[held, c]
            first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            out[w[first]] += np.add.reduceat(y[held], first, axis=0) * weight[w[first]][:, None]


def _numbered(number):
    """Batches of (doc_id, text) -> the numbers of the words, -1 for words of no item; documents without any are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value.get
        for batch in batches:
            docs, out = [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _WORD.findall(plain(text))
                ids = np.fromiter((known(w, -1) for w in words), np.int32, len(words))
                if (ids >= 0).sum() >= 3:
                    docs.append(d), out.append(ids.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "ids"])

    return run


def passage_starts(words: int) -> np.ndarray:
    """Where the passages of a document begin; the last may end behind it."""
    return np.arange(0, max(1, words - DOC_WORDS + DOC_STEP), DOC_STEP)


def _sums(rows: DataFrame, make, size: int) -> np.ndarray:
    """The sum over all tasks of one float32 array of fixed ``size`` each; added in stages, so that the driver gets a few."""

    def run(batches):
        total = np.zeros(size, np.float64)
        for batch in batches:
            make(total, batch)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["k", "v"])

    def add(table):
        total = np.zeros(size, np.float64)
        for v in table.column("v").to_pylist():
            total += np.frombuffer(v, np.float32)
        return pa.table({"v": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    part = rows.mapInArrow(run, "k int, v binary").select(F.pmod(F.spark_partition_id(), F.lit(8)).alias("k"), "v")
    got = part.groupBy("k").applyInArrow(add, "v binary").collect()  # at most eight arrays
    return np.sum([np.frombuffer(r.v, np.float32) for r in got], axis=0, dtype=np.float64) if got else np.zeros(size)


def _document_frequencies(docs: DataFrame, size: int) -> tuple[np.ndarray, float]:
    """How many documents hold each word of the items, and how many documents there are."""

    def make(total, batch):
        for v in batch.column(1).to_pylist():
            ids = np.unique(np.frombuffer(v, np.int32))
            total[ids[ids >= 0]] += 1
            total[size] += 1

    got = _sums(docs, make, size + 1)
    return got[:size], got[size]


def weights(items: Items, held: np.ndarray, total: float) -> np.ndarray:
    """The weight of each word: its rarity in the documents and among the items, and ``LEAST_WEIGHT`` at least if it is an item's own.

    So no item drops out of the search, whatever share of the documents leaks it.
    """
    among, own = np.zeros(len(held)), np.zeros(len(held), bool)
    for i, ids in items.ids.items():
        among[np.unique(ids)] += 1
        own[ids[items.own[i]]] = True
    texts = total + len(items.ids) + 1
    return np.maximum(np.log(texts / (held + among + 0.5)), np.where(own, LEAST_WEIGHT, 0)).astype(np.float32)


def latent(docs: DataFrame, part: Part, weight: np.ndarray, rank: int = RANK, fit_docs: int = FIT_DOCS, total: float = 0, seed: int = 5) -> np.ndarray:
    """An orthonormal basis (words of the part x rank) of the main directions of the passages: a randomised SVD with one power iteration.

    The items' passages count as much as all documents' together, so that no item is lost among them. The documents' part is
    summed by the tasks over about ``fit_docs`` documents chosen by hash.
    """
    size, local, rows = len(weight), part.local, part.rows
    norm = np.sqrt(_energies(rows, weight))[:, None]  # a light item's directions aren't the last ones
    width = min(size, max(1, len(rows)), rank + OVERSAMPLE)
    probe = np.random.default_rng(seed).standard_normal((size, width)).astype(np.float32)
    floor = _floor(rows, weight)

    def own(q):
        out = np.zeros(q.shape)
        transposed(rows, weight, times(rows, weight, q) / norm**2, out)
        return out

    def multiplied(q):
        """The documents' passages' part of A^T (A q)."""

        def make(out, batch):
            held = [part.speaking(local[np.frombuffer(v, np.int32)], weight, floor, any_word=True)[1] for v in batch.column(1).to_pylist()]
            p = np.concatenate([np.empty((0, DOC_WORDS), np.int32), *held])
            for k in range(0, len(p), 4096):
                x = distinct(p[k : k + 4096])
                transposed(x, weight, times(x, weight, q), out.reshape(q.shape))

        return _sums(sample, make, q.size).reshape(q.shape)

    share = min(1.0, fit_docs / max(1.0, total))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * share))
    spread, mine = multiplied(probe), own(probe)
    scale = np.linalg.norm(mine) / max(np.linalg.norm(spread), 1e-9)
    basis = np.linalg.qr(mine + scale * spread)[0].astype(np.float32)
    # one power iteration, then the main directions within the basis, both with the passages of either side
    basis = np.linalg.qr(own(basis) + scale * multiplied(basis))[0].astype(np.float32)
    both = basis.T @ (own(basis) + scale * multiplied(basis))
    s, v = np.linalg.eigh((both + both.T) / 2)
    s, v = s[::-1], v[:, ::-1]
    keep = min(rank, int((s > 1e-12 * max(s[0], 1e-9)).sum())) if len(rows) else 0
    return (basis @ v[:, :keep]).astype(np.float32)


def _floor(rows: np.ndarray, weight: np.ndarray) -> float:
    """The least energy that a passage must have to cover the share THRESHOLD of any item's passage."""
    return float(THRESHOLD**2 * _energies(rows, weight).min()) if len(rows) else float("inf")


def _energies(p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.where(p >= 0, weight[p] ** 2, 0).sum(axis=1)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Positions (in a, in b) of a longest common subsequence, by the matches alone (words below 0 never match)."""
    places: dict[int, list[int]] = {}
    for j, w in enumerate(b.tolist()):
        if w >= 0:
            places.setdefault(w, []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i, w in enumerate(a.tolist()):
        for j in reversed(places.get(w, ())):
            at = bisect_left(ends, j)
            link = (i, j, links[at - 1] if at else None)
            if at == len(ends):
                ends.append(j), links.append(link)
            else:
                ends[at], links[at] = j, link
    out, link = [], links[-1] if links else None
    while link:
        out.append(link[:2])
        link = link[2]
    return out[::-1]


def diagonals(a: np.ndarray, b: np.ndarray, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions in a, in b) of the equal words (not below 0) at each distance of positions that has ``least`` of them or more."""
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    counts = np.where(a >= 0, hi - lo, 0)
    ai = np.repeat(np.arange(len(a)), counts)
    bi = order[np.repeat(lo - np.cumsum(counts) + counts, counts) + np.arange(len(ai))]
    distance, which, held = np.unique(bi - ai, return_inverse=True, return_counts=True)
    return [(ai[which == k], bi[which == k]) for k in np.flatnonzero(held >= least)] if len(distance) else []


def leaked(item: np.ndarray, own: np.ndarray, doc: np.ndarray, passage: int = PASSAGE, changed: float = CHANGED, least_own: int = OWN) -> int:
    """Words of the longest leaked passage of the item in the document's words, or 0.

    The passage must span ``passage`` words of the item (or all, if it is shorter), at most the share ``changed`` of its words
    may be changed, dropped or added, and of the item's own words in it ``least_own`` and at least half must be kept.
    """
    need = min(passage, len(item))
    pairs = common_subsequence(item, doc)
    if len(pairs) < need * (1 - changed) - 1e-9:
        return 0
    all_own = np.concatenate([[0], np.cumsum(own)])

    def longest(ai: np.ndarray, bi: np.ndarray) -> int:
        n, best = len(ai), 0
        kept_own = np.concatenate([[0], np.cumsum(own[ai])])
        if kept_own[-1] < min(least_own, all_own[-1]):
            return 0
        for s in range(n):
            if ai[-1] - ai[s] < best:
                break  # what begins later is no longer
            e = np.arange(s, n)
            span = ai[e] - ai[s] + 1
            length = np.maximum(span, bi[e] - bi[s] + 1)
            kept, every = kept_own[e + 1] - kept_own[s], all_own[ai[e] + 1] - all_own[ai[s]]
            ok = (length - (e - s + 1) <= changed * length + 1e-9) & (span >= need) & (kept >= np.minimum(least_own, all_own[-1])) & (2 * kept >= every)
            if ok.any():
                best = max(best, int(span[ok].max()))
        return best

    # the subsequence is one of several: where words of a passage stand elsewhere too it may leave it, but its diagonal holds it
    best = longest(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    for ai, bi in diagonals(item, doc, need * (1 - changed) - 1e-9):
        best = max(best, longest(ai, bi))
    return best


def _may_leak(items: Part, i: int, doc: np.ndarray) -> bool:
    """Bounds that any leaked passage keeps: enough own words, and enough words at all, occur in the document's part."""
    have = set(doc.tolist())
    if len(have & items.own_set[i]) < min(OWN, len(items.own_set[i])):
        return False
    least = min(PASSAGE, len(items.ids[i])) * (1 - CHANGED) - 1e-9
    return sum(k for w, k in items.counts[i].items() if w in have) >= least


def _found(part_b, weight_b, basis_b, unit_b, floor: float, lowest: float):
    """``unit_b`` has the items' projected passages over their squared norms; ``lowest`` is the norm that none can be covered below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, basis, unit = part_b.value, weight_b.value, basis_b.value, unit_b.value
        owners, at_once = items.owners.tolist(), max(1, CELLS // max(1, unit.shape[1]))
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), [items.local[np.frombuffer(v, np.int32)] for v in batch.column(1).to_pylist()]
            out: dict[tuple[int, int], int] = {}
            if owners and texts:
                which, starts, rows = [], [], []
                for d, ids in enumerate(texts):
                    s, p = items.speaking(ids, weight, floor)
                    which.append(np.full(len(s), d)), starts.append(s), rows.append(p)
                which, starts, rows = np.concatenate(which), np.concatenate(starts), np.concatenate(rows)
                hits: dict[tuple[int, int], list[int]] = {}
                for k in range(0, len(rows), 4096):
                    v = times(distinct(rows[k : k + 4096]), weight, basis)
                    near = np.flatnonzero(np.linalg.norm(v, axis=1) >= lowest)
                    for n in range(0, len(near), at_once):
                        some = near[n : n + at_once]
                        for x, y in zip(*np.nonzero(v[some] @ unit >= THRESHOLD)):
                            at = k + some[x]
                            hits.setdefault((int(which[at]), owners[y]), []).append(int(starts[at]))
                for (d, i), at in hits.items():
                    at, ids, margin = sorted(set(at)), texts[d], len(items.ids[i]) + 2 * DOC_WORDS
                    # candidates of one item that lie together are checked together
                    begin = 0
                    for k in range(len(at)):
                        if k + 1 == len(at) or at[k + 1] - at[k] > DOC_WORDS + DOC_STEP:
                            lo, hi = max(0, at[begin] - DOC_WORDS), at[k] + 2 * DOC_WORDS
                            if hi - lo < len(items.ids[i]):
                                hi = min(lo + margin, hi + DOC_WORDS)
                            score = leaked(items.ids[i], items.own[i], ids[lo:hi]) if _may_leak(items, i, ids[lo:hi]) else 0
                            if score:
                                out[(docs[d], i)] = max(score, out.get((docs[d], i), 0))
                            begin = k + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.int64()), pa.array([k[1] for k in out], pa.int64()), pa.array(list(out.values()), pa.int32())], ["doc_id", "item_id", "words"])

    return run


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rank: int = RANK, most_items: int = 20_000, part_passages: int = PART_PASSAGES) -> DataFrame:
    """(doc_id, item_id, words): every document with the items that it leaks, and the words of the longest passage.

    Null and empty texts leak nothing and can't be leaked; equal documents each get their rows once per id; ``items`` must be a
    held-out set of at most ``most_items`` rows (an error beyond), as its vocabulary is sent to all tasks. Documents are read whole.
    """
    spark = docs.sparkSession
    chosen = items.select(F.col(f"`{item_id}`").cast("bigint").alias("i"), F.col(f"`{item_text}`").alias("t")).where(F.col("i").isNotNull())
    rows = [(r.i, r.t) for r in chosen.limit(most_items + 1).collect()]
    if len(rows) > most_items:
        raise ValueError(f"more than {most_items} evaluation items: give them in parts")
    known = Items(sorted(rows, key=lambda r: (r[0], r[1] or "")))
    schema = "doc_id bigint, item_id bigint, words int"
    if not known.ids:
        return spark.createDataFrame([], schema)
    broadcast = spark.sparkContext.broadcast
    base = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).where(F.col("text") != "")
    coded = written(spread(base).mapInArrow(_numbered(broadcast(known.number)), "doc_id bigint, ids binary"))
    held, total = _document_frequencies(coded, len(known.number))
    every = weights(known, held, total)
    found = []
    for part in known.parts(part_passages):
        weight = every[part.words]
        basis = latent(coded, part, weight, rank, total=total)
        q = times(part.rows, weight, basis)
        norm = np.maximum(np.linalg.norm(q, axis=1), 1e-6)
        lowest = float(THRESHOLD * norm.min()) if len(norm) else 0.0
        unit = (q / (norm**2)[:, None]).T.copy()
        search = _found(broadcast(part), broadcast(weight), broadcast(basis), broadcast(unit), _floor(part.rows, weight), lowest)
        found.append(coded.mapInArrow(search, schema))
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))
