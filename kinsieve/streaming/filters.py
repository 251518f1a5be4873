"""The n-gram filter over a stream of training texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsieve.operators.overlap import gram_rows


def ngram_stream(train: DataFrame, train_id: str, train_text: str, bench: DataFrame, bench_id: str, bench_text: str, n: int) -> DataFrame:
    """(train_id, bench_id, gram): every shared n-gram, for a streaming ``train``: a stateless stream-static join.

    Each text is matched on its own row: its n-grams are looked up as one array, so that no state outlives a batch.
    The benchmark must be held-out items of a bounded number.
    """
    from kinsieve.functions.text import ngrams, words

    held = gram_rows(bench, bench_id, bench_text, n).groupBy("gram").agg(F.collect_set(bench_id).alias("__bench"))
    grams = train.select(train_id, F.explode(ngrams(words(F.col(train_text)), n)).alias("gram"))
    return grams.join(held, "gram").select(train_id, F.explode("__bench").alias(bench_id), "gram")
