"""Documents dealt into blocks of bounded text, so that a task can be told what it shares with other blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashable, shuffle_partitions

#: Bytes of text in a block, on average; what one task holds at a time.
BLOCK_BYTES = 1 << 24


def block_count(docs: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> tuple[int, int]:
    """(blocks, bytes of text) of a table; at least as many blocks as shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-total // block_bytes)), total


def dealt(docs: DataFrame, text: str, blocks: int, rest: list[str]) -> DataFrame:
    """The rows with block, body (the text as binary, null as empty) and the columns ``rest``, whose names must be others.

    A block is chosen by a hash of the text and the other columns, so that a group of copies is dealt over all blocks, and
    again in the same way if a task is repeated.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    seed = hashable(docs, [c for c in rest if c != text])
    return docs.select(F.pmod(F.xxhash64(F.col(text), *seed), F.lit(blocks)).cast("long").alias("block"), body.alias("body"), *rest)
