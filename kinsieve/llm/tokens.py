"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsieve.plans.lineage import spread

#: Where the tokenizers' files lie; a rank file of a byte-level BPE is read.
TOKENIZER_FOLDER = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
TOKENIZER_FILE = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern with which this vocabulary's tokenizer divides a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are encoded piece by piece, cut before a blank, where the pattern never joins anything but blanks.
PIECE = 100_000


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """``text`` in pieces of about ``most`` characters, each but the first beginning with a single blank before a letter."""
    start = 0
    while len(text) - start > most:
        at = start + most
        while at < len(text) - 1 and not (text[at] == " " and text[at + 1].isalpha() and not text[at - 1].isspace()):
            at += 1
        if at >= len(text) - 1:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def size_of(text: str, path: str) -> int:
    enc = encoding(path)
    return sum(len(enc.encode_ordinary(p)) for p in pieces(text)) if len(text) > PIECE else len(enc.encode_ordinary(text))


def token_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), tokenizer: str | None = None) -> DataFrame:
    """(doc_id, keep..., chars, tokens) of the rows whose text is neither null nor empty.

    Text leaves Spark in Arrow batches and only numbers come back. Equal rows each give a row; an empty table gives none.
    """
    path = tokenizer or os.path.join(TOKENIZER_FOLDER, TOKENIZER_FILE)
    chosen = docs.select(F.col(f"`{text}`").alias("__text"), F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), *keep).where(F.col("__text") != "")
    schema = chosen.drop("__text").schema

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            arrays = batch.columns[1:] + [pa.array([len(t) for t in texts], pa.int64()), pa.array([size_of(t, path) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[1:], "chars", "tokens"])

    return spread(chosen).mapInArrow(sized, schema.add("chars", "long").add("tokens", "long"))
