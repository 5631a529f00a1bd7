"""Token counts by batch encoding inside Arrow functions.

Each Arrow batch is cut into encoding batches of about ``BATCH_BYTES`` text bytes, so one call never holds more encodings
than that, and a text beyond ``PIECE_BYTES`` is split first. A piece may end before a single space that stands between
two characters that are no white space: the tokenizer's own splitting always starts a new part there, so the counts of
the pieces add up to the count of the text. A stretch without such a place stays whole. Only lengths leave the function.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted one by one; an empty table
gives no rows; columns that aren't asked for are ignored, whatever their names.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from turnwise.llm.common import table
from turnwise.llm.registry import query

BATCH_BYTES = 1 << 20
PIECE_BYTES = 1 << 16
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def safe_pieces(text: str, most: int = PIECE_BYTES) -> list[str]:
    """The text in pieces of about ``most`` characters, cut before single inner spaces only."""
    pieces, start = [], 0
    while len(text) - start > most:
        cut = _SAFE.search(text, start + most)
        if cut is None:
            break
        pieces.append(text[start:cut.start()])
        start = cut.start()
    pieces.append(text[start:])
    return pieces


def batches_by_bytes(pieces: list[tuple[int, str]], most: int = BATCH_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Runs of (row, piece) of about ``most`` bytes each."""
    held: list[tuple[int, str]] = []
    size = 0
    for row, piece in pieces:
        own = len(piece.encode())
        if held and size + own > most:
            yield held
            held, size = [], 0
        held.append((row, piece))
        size += own
    if held:
        yield held


def _counter(path: str, limit: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [0] * len(texts)
            pieces = [(row, p) for row, t in enumerate(texts) for p in safe_pieces(t)]
            for run in batches_by_bytes(pieces):
                for (row, _), code in zip(run, tokenizer.encode_batch_fast(
                        [p for _, p in run], add_special_tokens=False)):
                    counts[row] += len(code)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()),
                 pa.array([c > limit for c in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return count


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for every row; ``vocabulary`` is a tokenizer file on every host."""
    slim = docs.select("doc_id", "text")
    kind = dict(slim.dtypes)["doc_id"]
    return slim.mapInArrow(_counter(vocabulary, limit),
                           f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
