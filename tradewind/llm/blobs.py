"""Sorted 64-bit keys as compact binary cells, for shuffles of very many keys.

A task sorts the keys of its block, cuts them by their leading bits and sends one binary cell per (part, block): the
differences of neighbours, byte plane by byte plane, compressed. That moves two to six bytes a key instead of a 24-byte row.

A block cuts its keys into FAN parts at most, so that a cell stays worth packing. Where that leaves too much in a part, teams
of blocks merge their cells of it and cut them again, and so on: the number of cells follows the keys, not blocks times parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (the finalizer of splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def pack(keys: np.ndarray) -> bytes:
    """Of sorted keys."""
    if not len(keys):
        return b""
    gaps = np.empty(len(keys), U64)
    gaps[0] = keys[0]
    np.subtract(keys[1:], keys[:-1], out=gaps[1:])
    planes = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    body = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()
    return bytes([planes]) + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(cell: bytes) -> np.ndarray:
    if not cell:
        return np.empty(0, U64)
    planes = cell[0]
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(cell[1:]), np.uint8).reshape(planes, -1)
    gaps = np.zeros((body.shape[1], 8), np.uint8)
    gaps[:, :planes] = body.T
    return np.cumsum(gaps.view("<u8").ravel().astype(U64), dtype=U64)


def pack_raw(values: np.ndarray) -> bytes:
    """Of 64-bit values in any order."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_raw(cell: bytes) -> np.ndarray:
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(cell), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(body.T).view("<u8").ravel().astype(U64)


def parts(keys: np.ndarray, n_parts: int, bits: int = 64) -> Iterator[tuple[int, int, int]]:
    """(part, start, end) of sorted keys of so many bits, cut into n_parts (a power of two) by their leading bits."""
    if not len(keys):
        return
    shift = bits - (n_parts.bit_length() - 1)
    own = keys >> U64(shift) if shift < 64 else np.zeros(len(keys), U64)
    head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    yield from zip(own[head].tolist(), head.tolist(), [*head[1:].tolist(), len(keys)], strict=True)


def repeated(arrays: list[np.ndarray]) -> np.ndarray:
    """Sorted keys that are in two or more of the arrays; each array holds a key once."""
    s = np.sort(np.concatenate(arrays))
    twice = s[1:][s[1:] == s[:-1]]
    return twice[np.append(True, twice[1:] != twice[:-1])] if len(twice) else twice


def power_of_two(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))


#: Parts into which a block, or a team of them, cuts its keys, and blocks in a team.
FAN = 512
SENT_KEYS = "part long, sender long, keys binary, twice binary"


def _sent(keys: np.ndarray, twice: np.ndarray, sender: int, n_parts: int, bits: int) -> pa.Table:
    local = {p: (s, e) for p, s, e in parts(twice, n_parts, bits)}
    rows = [(p, sender, pack(keys[s:e]), pack(twice[slice(*local.get(p, (0, 0)))])) for p, s, e in parts(keys, n_parts, bits)]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(("part", "sender", "keys", "twice"), kinds, strict=True))})


def sent_keys(keys: np.ndarray, block: int, n_parts: int, bits: int, fan: int = FAN) -> pa.Table:
    """The cells (SENT_KEYS) of a block for its keys, in any order, repeats included."""
    keys = np.sort(keys)
    first = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    return _sent(keys[first], np.unique(keys[1:][~first[1:]]), block, min(n_parts, fan), bits)


def _merged(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """(keys of each cell, sorted keys that are in two cells or twice in one)."""
    arrays = [unpack(x.as_py()) for x in table["keys"]]
    return arrays, np.unique(np.concatenate([repeated(arrays), *(unpack(x.as_py()) for x in table["twice"])]))


def _answers(table: pa.Table, arrays: list[np.ndarray], hits: np.ndarray) -> pa.Table:
    """Those of the hits that each cell's sender holds."""
    out = []
    for sender, keys in zip(table["sender"].to_pylist(), arrays, strict=True):
        at = np.minimum(np.searchsorted(keys, hits), len(keys) - 1)
        if len(own := hits[keys[at] == hits]):
            out.append((sender, pack(own)))
    return pa.table({"block": pa.array([x[0] for x in out], pa.int64()), "hits": pa.array([x[1] for x in out], pa.binary())})


def repeated_keys(cells: DataFrame, n_parts: int, bits: int, fan: int = FAN) -> DataFrame:
    """(block, hits) from the cells of sent_keys: the keys of each block that occur more than once in all of them, as packed cells."""
    return _level(cells, min(n_parts, fan), n_parts, bits, fan)


def _level(cells: DataFrame, level: int, n_parts: int, bits: int, fan: int) -> DataFrame:
    """As repeated_keys, of cells cut into ``level`` parts so far."""
    answer = "block long, hits binary"
    if level >= n_parts:
        return cells.groupBy("part").applyInArrow(lambda t: _answers(t, *_merged(t)), answer)
    finer = min(n_parts, level * fan)
    low = F.lit((1 << 32) - 1)
    teamed = cells.withColumn("team", F.shiftright(F.col("sender").bitwiseAND(low), fan.bit_length() - 1))

    def merge(table: pa.Table) -> pa.Table:
        arrays, twice = _merged(table)
        # The team speaks for its blocks in this part. All senders of a finer part are of one part, so the lower half tells them apart.
        sender = table["part"][0].as_py() << 32 | table["team"][0].as_py()
        return _sent(np.unique(np.concatenate(arrays)), twice, sender, finer, bits)

    def split(own: pa.Table, told: pa.Table) -> pa.Table:
        if not own.num_rows or not told.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "hits": pa.array([], pa.binary())})
        hits = np.sort(np.concatenate([unpack(x.as_py()) for x in told["hits"]]))
        return _answers(own, [unpack(x.as_py()) for x in own["keys"]], hits)

    told = _level(teamed.groupBy("part", "team").applyInArrow(merge, SENT_KEYS), finer, n_parts, bits, fan)
    told = told.select(F.shiftright("block", 32).alias("part"), F.col("block").bitwiseAND(low).alias("team"), "hits")
    return teamed.groupBy("part", "team").cogroup(told.groupBy("part", "team")).applyInArrow(split, answer)
