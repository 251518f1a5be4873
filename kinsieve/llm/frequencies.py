"""Problem 5: occurrences and number of records of every distinct word.

Method: last-seen counters. Tokens arrive ordered by record; every term keeps its occurrences, its records and the record that
it was last seen in, so that no set per record or per term is needed. A task counts its own records this way (a record is never
divided between tasks), and the counters of all tasks are added after a shuffle by the hash of the term.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsieve.plans.lineage import spread

_WORD = re.compile(r"\w+")
#: Terms that a task holds before it hands its counters on; exact at any value, as hand-over is between records.
HELD_TERMS = 300_000


def count_terms(records: Iterator[str | None], held: int = HELD_TERMS) -> Iterator[dict[str, list[int]]]:
    """Counters {term: [occurrences, records, last record]} of the records, handed on whenever ``held`` terms are kept."""
    seen: dict[str, list[int]] = {}
    for at, text in enumerate(records):
        if text:
            for word in _WORD.findall(text.lower()):
                entry = seen.get(word)
                if entry is None:
                    seen[word] = [1, 1, at]
                else:
                    entry[0] += 1
                    if entry[2] != at:
                        entry[1] += 1
                        entry[2] = at
            if len(seen) >= held:
                yield seen
                seen = {}
    if seen:
        yield seen


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = (t for batch in batches for t in batch.column(0).to_pylist())
    for seen in count_terms(texts):
        terms = list(seen)
        for at in range(0, len(terms), 50_000):
            part = terms[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[t][0] for t in part], pa.int64()), pa.array([seen[t][1] for t in part], pa.int64())], ["term", "occurrences", "reports"])


def term_counts(records: DataFrame, text: str) -> DataFrame:
    """(term, occurrences, reports) of every distinct word of the column ``text``.

    Words are maximal runs of Unicode letters, digits and ``_`` of the lower-cased text. Null texts and texts without a word
    count nothing; equal rows count each; an empty table gives no rows. Texts are read whole, however long.
    """
    part = spread(records.select(F.col(f"`{text}`").cast("string").alias("t"))).mapInArrow(_counted, "term string, occurrences bigint, reports bigint")
    return part.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("reports").alias("reports"))


def marked_terms(records: DataFrame, text: str, rare_below: int = 3, common_above: float = 0.5) -> DataFrame:
    """``term_counts`` with ``mark``: `rare` in fewer than ``rare_below`` records, `common` in more than the share
    ``common_above`` of the non-null records, else null. A word that is both, in a tiny table, is `rare`."""
    total = records.where(F.col(f"`{text}`").isNotNull()).count()
    mark = F.when(F.col("reports") < rare_below, "rare").when(F.col("reports") > common_above * total, "common")
    return term_counts(records, text).withColumn("mark", mark)
