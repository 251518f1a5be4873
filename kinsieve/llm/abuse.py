"""Problem 8: a score of abusive, hateful or sexual content for every document, and a rate for every source.

Method: multiple-instance learning. A document is a bag of sentences; each sentence gets a probability from its words and word pairs,
and a noisy-or combines them: a document is abusive if at least one sentence is. Every weight is learned from document labels; there is
no word list. The trained sentence scores then locate the offending sentence.
Words are first undone of disguises: odd alphabets, invisible characters, digits for letters, stretched, spaced or masked letters.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsieve.llm.plaintext import _INVISIBLE, _MARKS, LOOKALIKES
from kinsieve.plans.lineage import spread

#: Labelled documents on which the model is trained, chosen by hash if there are more, and the longest of them: both bound the fit only.
FIT_DOCS, FIT_CHARS = 6_000, 200_000
#: Shares of labels that are wrong, assumed of the raters: harmless documents labelled, abusive ones not.
FALSE_ALARM, MISSED = 0.06, 0.12
#: A word or pair may speak for abuse if this share of its labelled documents is abusive, and so many deviations more than of all.
TELLING_SHARE, TELLING_Z = 0.6, 3.0
#: Logit of a sentence without any known word, the most that one word or pair adds to it (so that a single one never decides), and the
#: pull of all weights towards 0.
BIAS, MOST, PULL = -8.0, 5.0, 0.05
#: A word or pair has a weight if it stands in so many labelled documents.
LEAST_DOCS = 3

_SPACED = re.compile(r"(?<![\w.])\w(?:([ .\-_*·])\w)(?:\1\w)+(?!\w)")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+|\n+|</?p>|<br ?/?>")
_TOKEN = re.compile(r"[^\W_][\w*+$@!|]*")
_LEET = str.maketrans({"4": "a", "@": "a", "5": "s", "$": "s", "1": "i", "!": "i", "|": "i", "0": "o", "3": "e", "7": "t", "+": "t", "8": "b", "9": "g"})
_LEET_L = str.maketrans({"4": "a", "@": "a", "5": "s", "$": "s", "1": "l", "!": "l", "|": "l", "0": "o", "3": "e", "7": "t", "+": "t", "8": "b", "9": "g"})
_RUN = re.compile(r"(.)\1{2,}")
_LETTERS = re.compile(r"[^\W\d_]+")


def _squeezed(word: str, to: str = r"\1") -> str:
    """Letters repeated three times or more once (or as often as ``to`` says), so that stretched and plain spellings meet."""
    return _RUN.sub(to, word)


def clear_text(text: str) -> str:
    """Lower-case text of plain letters: without invisible characters, accents, lookalikes and blanks or dots between single letters."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", text)))
        if not text.isascii():
            text = _LETTERS.sub(lambda m: m[0].translate(LOOKALIKES), text)
    return text.lower()


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


def _joined(sentence: str, known=()) -> str:
    """Single letters with one and the same sign between them as one word; a one-letter word next to a ``known`` one stays apart."""

    def join(m: re.Match) -> str:
        word = m[0].replace(m[1], "")
        if m[1] != " " or word in known:
            return word
        if word[1:] in known:
            return f"{word[0]} {word[1:]}"
        return f"{word[:-1]} {word[-1]}" if word[:-1] in known else word

    return _SPACED.sub(join, sentence)


class Reader:
    """Numbers of the words of a sentence in a fixed vocabulary; 0 for other words, 1 for a masked one that fits no word.

    ``masks`` has the number that a masked word stands for, by its first and last letter and its length.
    """

    def __init__(self, vocabulary: dict[str, int], masks: dict[tuple[str, str, int], int]):
        self.known, self.masks, self.memo = vocabulary, masks, {}

    def number(self, token: str) -> int:
        n = self.known.get(token)
        if n is not None:
            return n
        n = self.memo.get(token)
        if n is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            n = self.memo[token] = self._unusual(token)
        return n

    def _unusual(self, token: str) -> int:
        if "*" in token.rstrip("*!") and token[0].isalpha():
            bare = token.rstrip("!")
            return self.masks.get((bare[0], bare[-1], len(bare)), 1)
        for form in (token.rstrip("!"), token.translate(_LEET), token.translate(_LEET_L), token.rstrip("!").translate(_LEET)):
            if form.isalpha():
                for n in (self.known.get(_squeezed(form)), self.known.get(_squeezed(form, r"\1\1"))):
                    if n is not None:
                        return n
        return 0

    def __call__(self, sentence: str) -> list[int]:
        return list(map(self.number, _TOKEN.findall(_joined(sentence, self.known))))


def words_of(sentence: str) -> list[str]:
    """The squeezed words of a sentence, disguises undone where that gives letters only: what vocabularies are made of."""
    out = []
    for token in _TOKEN.findall(_joined(sentence)):
        if token.isalpha():
            out.append(_squeezed(token))
        elif "*" not in token:
            form = token.translate(_LEET)
            if form.isalpha() and len(form) > 3 and sum(c.isdigit() for c in token) <= len(token) / 2:
                out.append(_squeezed(form))
    return out


class Model:
    """Weights of words and of pairs of neighbouring words."""

    def __init__(self, vocabulary: dict[str, int], masks: dict[tuple[str, str, int], int], pairs: np.ndarray, words_w: np.ndarray, pairs_w: np.ndarray):
        self.vocabulary, self.masks, self.pairs, self.words_w, self.pairs_w = vocabulary, masks, pairs, words_w, pairs_w

    def reader(self) -> Reader:
        return Reader(self.vocabulary, self.masks)

    def logits(self, numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A logit for each sentence; ``numbers`` of all words, ``starts`` of the sentences, none of them empty."""
        w = self.words_w[numbers]
        if len(numbers) > 1 and len(self.pairs):
            key = numbers[:-1].astype(np.int64) * len(self.words_w) + numbers[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = self.pairs[at] == key
            hit[starts[1:] - 1] = False
            w[1:] += np.where(hit, self.pairs_w[at], 0)
        return np.add.reduceat(w, starts) + BIAS


def _bags(reader: Reader, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(numbers, starts of sentences, document of each sentence, sentences) of all texts."""
    numbers, starts, owner, kept, at = [], [], [], [], 0
    for d, text in enumerate(texts):
        for s in sentences(clear_text(text)) if text else ():
            n = reader(s)
            if n:
                numbers.append(n), starts.append(at), owner.append(d), kept.append(s)
                at += len(n)
    flat = np.fromiter((x for n in numbers for x in n), np.int64, at)
    return flat, np.array(starts, np.int64), np.array(owner, np.int64), kept


def _telling(n: np.ndarray, k: np.ndarray, base: float) -> np.ndarray:
    """Which of the features, in ``n`` labelled documents of which ``k`` are abusive, may speak for abuse. Any may speak against it."""
    return (n > 0) & (k >= TELLING_SHARE * n) & (k - n * base >= TELLING_Z * np.sqrt(n * base * (1 - base)))


def _vocabulary(texts: list[str], abusive: np.ndarray) -> tuple[dict[str, int], dict[tuple[str, str, int], int]]:
    """Words of at least ``LEAST_DOCS`` documents with their numbers, and of the telling ones what a masked word may stand for."""
    held, bad = Counter(), Counter()
    for text, label in zip(texts, abusive.tolist()):
        words = {w for s in sentences(clear_text(text)) for w in words_of(s)}
        held.update(words)
        if label:
            bad.update(words)
    vocabulary = {w: i + 2 for i, w in enumerate(sorted(w for w, k in held.items() if k >= LEAST_DOCS))}
    n = np.array([held[w] for w in vocabulary], float)
    k = np.array([bad[w] for w in vocabulary], float)
    masks: dict[tuple[str, str, int], int] = {}
    for w, telling, _ in sorted(zip(vocabulary, _telling(n, k, float(abusive.mean())), k), key=lambda x: (x[2], x[0])):
        if telling and len(w) >= 3:
            masks[(w[0], w[-1], len(w))] = vocabulary[w]
    return vocabulary, masks


def _occurrences(numbers: np.ndarray, starts: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, feature, pairs): each feature once in each sentence that holds it; pairs come after the ``size`` words."""
    ends = np.append(starts[1:], len(numbers))
    sentence = np.repeat(np.arange(len(starts)), ends - starts)
    inside = (sentence[:-1] == sentence[1:]) & (numbers[:-1] > 0) & (numbers[1:] > 0)
    key, at = (numbers[:-1] * size + numbers[1:])[inside], sentence[1:][inside]
    pairs, which = np.unique(key, return_inverse=True)
    holders = np.bincount(np.unique(owner[at] * max(1, len(pairs)) + which) % max(1, len(pairs)), minlength=len(pairs))
    number = np.cumsum(holders >= LEAST_DOCS) - 1
    frequent = holders[which] >= LEAST_DOCS if len(which) else np.zeros(0, bool)
    pairs = pairs[holders >= LEAST_DOCS]
    feature = np.concatenate([numbers[numbers > 0], size + number[which[frequent]]])
    where = np.concatenate([sentence[numbers > 0], at[frequent]])
    width = size + len(pairs)
    once = np.unique(where * width + feature)
    return once // width, once % width, pairs


def train(texts: list[str], labels: list[float], rounds: int = 220) -> Model:
    """A model from document labels (0 to 1). Without labels of both kinds nothing is known, and no sentence is abusive."""
    y = np.clip(np.array(labels, float), 0.0, 1.0)
    abusive = y > 0.5
    none_known = Model({}, {}, np.empty(0, np.int64), np.zeros(2), np.empty(0))
    if not abusive.any() or abusive.all():
        return none_known
    vocabulary, masks = _vocabulary(texts, abusive)
    size = len(vocabulary) + 2
    numbers, starts, owner, _ = _bags(Reader(vocabulary, masks), texts)
    if not len(starts):
        return none_known
    where, feature, pairs = _occurrences(numbers, starts, owner, size)
    width, docs = size + len(pairs), len(texts)
    held = np.unique(owner[where] * width + feature)
    n, k = np.bincount(held % width, minlength=width), np.bincount(held % width, weights=abusive[held // width], minlength=width)
    telling = _telling(n, k, float(abusive.mean()))
    most = np.where(telling, MOST, 0.0)
    w = telling.astype(float)
    m1, m2 = np.zeros(width), np.zeros(width)
    told = 1 - FALSE_ALARM - MISSED
    for r in range(1, rounds + 1):
        z = np.clip(np.bincount(where, weights=w[feature], minlength=len(starts)) + BIAS, -30, 30)
        p = np.clip(1 / (1 + np.exp(-z)), 1e-9, 1 - 1e-9)
        none = np.exp(np.bincount(owner, weights=np.log1p(-p), minlength=docs))  # no sentence is abusive
        # raters err: the chance that a document is labelled isn't that it is abusive
        seen = FALSE_ALARM + told * np.clip(1 - none, 1e-6, 1 - 1e-9)
        slope = ((1 - y) / (1 - seen) - y / seen) * told * none
        grad = np.bincount(feature, weights=(slope[owner] * p)[where], minlength=width) + 4 * PULL * w
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        rate = 0.15 * (1 - r / rounds) + 0.01
        w = np.minimum(w - rate * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-6), most)
    return Model(vocabulary, masks, pairs, w[:size], w[size:])


def score(model: Model, reader: Reader, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str | None], np.ndarray]:
    """(score, offending sentences, worst sentence, its score) of each text; 0, 0, null, 0 for one without words."""
    numbers, starts, owner, kept = _bags(reader, texts)
    n = len(texts)
    if not len(starts):
        return np.zeros(n), np.zeros(n, np.int64), [None] * n, np.zeros(n)
    p = 1 / (1 + np.exp(-np.clip(model.logits(numbers, starts), -30, 30)))
    # what any sentence of unknown words gets is no evidence: else a long harmless text would add up to abuse
    rest = 1 / (1 + np.exp(-BIAS))
    p = np.maximum(p - rest, 0) / (1 - rest)
    total = 1 - np.exp(np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))
    offending = np.bincount(owner, weights=p >= 0.5, minlength=n).astype(np.int64)
    worst: list[str | None] = [None] * n
    top = np.zeros(n)
    for k in np.lexsort((-p, owner)).tolist():
        d = int(owner[k])
        if worst[d] is None:
            worst[d], top[d] = kept[k], p[k]
    return total, offending, worst, top


def labelled(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCS) -> list[tuple[str, float]]:
    """(text, mean label) of at most ``most`` labelled documents, chosen by hash; raters' nulls and even splits are left out, as are
    documents of more than ``FIT_CHARS`` characters, so that what the driver gets is bounded."""
    mean = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("y"))
    clear = mean.where(F.col("y") != 0.5).orderBy(F.xxhash64("doc_id")).limit(most)
    rows = docs.select("doc_id", "text").where((F.col("text") != "") & (F.length("text") <= FIT_CHARS)).join(F.broadcast(clear), "doc_id").select("doc_id", "text", "y").collect()
    return [(r.text, r.y) for r in sorted(rows, key=lambda r: (r.doc_id, r.text))]


def scores(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = (), most: int = FIT_DOCS) -> DataFrame:
    """(doc_id, keep..., score, offending, worst, worst_score): one row for each row of ``docs``.

    Null and empty texts and texts without words score 0. Equal texts score alike. With no usable labels of both kinds all
    score 0. Texts are read whole; ``docs`` may have any other columns.
    """
    pairs = labelled(docs, labels, most)
    model = train([t for t, _ in pairs], [y for _, y in pairs])
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled documents
    chosen = docs.select(F.col("text").alias("__text"), F.col("doc_id").cast("bigint").alias("doc_id"), *keep)
    schema = chosen.drop("__text").schema.add("score", "double").add("offending", "long").add("worst", "string").add("worst_score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = held.value.reader()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                total, offending, worst, top = score(held.value, reader, part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(total), pa.array(offending), pa.array(worst, pa.string()), pa.array(top)], [*batch.schema.names[1:], "score", "offending", "worst", "worst_score"])

    return spread(chosen).mapInArrow(run, schema)


def rates(scored: DataFrame, source: Column | str = "source", threshold: float = 0.5) -> DataFrame:
    """(source, documents, abusive, rate) of scored documents; a null source is a group of its own."""
    name = F.col(source) if isinstance(source, str) else source
    grouped = scored.groupBy(name.alias("source")).agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("score") >= threshold).cast("bigint")).alias("abusive"))
    return grouped.withColumn("rate", F.col("abusive") / F.col("documents"))
