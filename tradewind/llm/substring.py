"""Removal of passages that occur more than once: Rabin-Karp hashes of every window of words, counted over all documents.

Windows have two polynomial hashes of 64 bits. First only leading bits of one are sent, which finds the few windows that may
occur again; these alone are then told apart by all 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .blobs import FAN, SENT_KEYS, U64, mix, pack, pack_raw, parts, power_of_two, repeated_keys, sent_keys, unpack, unpack_raw
from .blocks import block_count, dealt
from .common import fenced, fields_of, unfenced

#: Bases of the two rolling polynomials modulo 2**64; words enter as their XXH64, the second time mixed once more.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def rolling(hashes: np.ndarray, at: np.ndarray, window: int, base: int) -> np.ndarray:
    """The polynomial of the window that starts at each place."""
    n = len(hashes)
    up = np.cumprod(np.concatenate([[U64(1)], np.full(n, U64(base))]), dtype=U64)
    down = np.cumprod(np.concatenate([[U64(1)], np.full(n - 1, U64(pow(base, -1, 1 << 64)))]), dtype=U64)
    sums = np.concatenate([[U64(0)], np.cumsum(hashes * down, dtype=U64)])
    return mix((sums[at + window] - sums[at]) * up[at])


def window_starts(n: int, ends: np.ndarray, window: int) -> np.ndarray:
    """Where windows start that lie inside a document; ``n`` words of all documents, ``ends`` where each ends."""
    if n < window:
        return np.empty(0, np.int64)
    inside = np.ones(n - window + 1, bool)
    starts = np.append(0, ends[:-1])
    short = np.zeros(n + 1, np.int64)  # windows that would run over a document's end
    np.add.at(short, np.maximum(starts, ends - window + 1), 1)
    np.add.at(short, ends, -1)
    inside &= np.cumsum(short)[: len(inside)] == 0
    return np.flatnonzero(inside)


def remove_repeats(docs: DataFrame, text: str = "text", window: int = 35, block_bytes: int = 1 << 23, bits: int | None = None, fan: int = FAN) -> DataFrame:
    """Every row without its text, with n_words, n_removed, removed (intervals of words, end exclusive) and kept_text.

    A word goes if a window of ``window`` consecutive words of its document covers it whose word sequence also starts anywhere
    else in the table, the same document included; windows are judged on the input. kept_text joins the others by one space.

    Every block of documents sends the leading ``bits`` of the first hash of its windows as sorted, packed cells (by default so
    many that one window in 4096 meets another by chance) and is told which of them occur again. Windows with such bits are sent
    once more with all 128 bits, and each cell is answered with a bitmap of those that do occur again. The block then marks them
    and merges them. Neither the number of bits nor ``fan`` changes the result.

    Null and empty texts have no words; texts shorter than a window lose nothing. All of repeated rows are judged (each is the
    other's repeat). An empty table gives an empty result. Columns named like a result are replaced, all others carried along,
    whatever their names. Two windows are taken for equal by 128 bits.
    """
    added = ("n_words", "n_removed", "removed", "kept_text")
    rows, inner, outer = fenced(docs, {text: "text"}, (text, *added))
    blocks, total = block_count(rows, "text", block_bytes)
    n_parts = power_of_two(blocks / 2)
    bits = bits or min(64, max(24, n_parts.bit_length() + 1, max(1, total // 6).bit_length() + 12))
    cut = U64(64 - bits)
    blocked = dealt(rows, "text", blocks, inner)

    def windows(table: pa.Table) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        split = [x.as_py().split() for x in table["body"]]
        ends = np.cumsum([len(x) for x in split], dtype=np.int64)
        n = int(ends[-1]) if len(ends) else 0
        hashes = np.fromiter((xxh64_intdigest(w) for x in split for w in x), U64, n)
        at = window_starts(n, ends, window)
        return split, ends, hashes, at, rolling(hashes, at, window, BASES[0]) if len(at) else np.empty(0, U64)

    def emit(table: pa.Table) -> pa.Table:
        return sent_keys(windows(table)[4] >> cut, table["block"][0].as_py(), n_parts, bits, fan)

    def suspects(own: pa.Table, told: pa.Table) -> tuple:
        """Windows whose leading bits occur again: (split, ends, starts, first hashes, second hashes, distinct pairs of these)."""
        split, ends, hashes, at, first = windows(own)
        hits = [unpack(x) for x in told["hits"].to_pylist() if x is not None]
        hits = np.sort(np.concatenate(hits)) if hits else np.empty(0, U64)
        if len(hits) and len(first):
            short = first >> cut
            known = hits[np.minimum(np.searchsorted(hits, short), len(hits) - 1)] == short
            at, first = at[known], first[known]
            second = rolling(mix(hashes), at, window, BASES[1])
        else:
            at, first, second = at[:0], first[:0], first[:0]
        order = np.lexsort((second, first))
        x, y = first[order], second[order]
        head = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))[: len(x)]
        return split, ends, at, order, head, x, y

    def confirm(own: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        if own.num_rows and told.num_rows:
            *_, head, x, y = suspects(own, told)
            twice = np.diff(np.append(head, len(x))) > 1
            x, y = x[head], y[head]
            out = [(p, own["block"][0].as_py(), pack(x[s:e]), pack_raw(y[s:e]), np.packbits(twice[s:e]).tobytes()) for p, s, e in parts(x, n_parts)]
        return pa.table({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate((("part", pa.int64()), ("block", pa.int64()), ("first", pa.binary()), ("second", pa.binary()), ("twice", pa.binary())))})

    def count(table: pa.Table) -> pa.Table:
        cells = [(unpack(x), unpack_raw(y)) for x, y in zip(table["first"].to_pylist(), table["second"].to_pylist(), strict=True)]
        x, y = (np.concatenate([c[i] for c in cells]) for i in (0, 1))
        again = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=len(c[0])) for t, c in zip(table["twice"].to_pylist(), cells, strict=True)]).astype(bool)
        order = np.lexsort((y, x))
        same = (x[order][1:] == x[order][:-1]) & (y[order][1:] == y[order][:-1])
        again[order[1:][same]] = again[order[:-1][same]] = True
        stop = np.cumsum([len(c[0]) for c in cells])
        out = [(b, p, np.packbits(again[e - len(c[0]) : e]).tobytes()) for b, p, c, e in zip(table["block"].to_pylist(), table["part"].to_pylist(), cells, stop.tolist(), strict=True)]
        return pa.table({"block": pa.array([r[0] for r in out], pa.int64()), "part": pa.array([r[1] for r in out], pa.int64()), "again": pa.array([r[2] for r in out], pa.binary())})

    result = ", ".join([*fields_of(rows, inner), "n_words long", "n_removed long", "removed array<struct<start:int,end:int>>", "kept_text string"])

    def cover(own: pa.Table, told: pa.Table) -> pa.Table:
        split, ends, at, order, head, x, _ = suspects(own, told)
        n = int(ends[-1]) if len(ends) else 0
        gone = np.zeros(n + 1, np.int64)
        if len(head):
            bits_of = {p: b for p, b in zip(told["part"].to_pylist(), told["again"].to_pylist(), strict=True) if b is not None}
            again = np.concatenate([np.unpackbits(np.frombuffer(bits_of[p], np.uint8), count=e - s) for p, s, e in parts(x[head], n_parts)]).astype(bool)
            start = at[order[np.repeat(again, np.diff(np.append(head, len(x))))]]
            gone[:n] += np.bincount(start, minlength=n)[:n]
            gone -= np.bincount(start + window, minlength=n + 1)[: n + 1]
        gone = np.cumsum(gone)[:n] > 0
        n_words, n_removed, removed, kept, s = [], [], [], [], 0
        for ws, e in zip(split, ends.tolist(), strict=True):
            g = gone[s:e]
            n_words.append(e - s)
            n_removed.append(int(g.sum()))
            if n_removed[-1]:
                turns = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]]))).tolist()
                runs = list(zip(turns[::2], turns[1::2], strict=True))
                removed.append([{"start": a, "end": b} for a, b in runs])
                ws = [w for a, b in zip([0, *turns[1::2]], [*turns[::2], e - s], strict=True) for w in ws[a:b]]
            else:
                removed.append([])
            kept.append(b" ".join(ws))
            s = e
        runs = pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        return pa.table({**{c: own[c] for c in inner}, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "removed": runs, "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    told = repeated_keys(blocked.groupBy("block").applyInArrow(emit, SENT_KEYS), n_parts, bits, fan)
    sent = blocked.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(confirm, "part long, block long, first binary, second binary, twice binary")
    answers = sent.groupBy("part").applyInArrow(count, "block long, part long, again binary")
    none = F.lit(None).cast("binary")
    both = told.select("block", F.lit(-1).cast("long").alias("part"), "hits", none.alias("again")).unionByName(answers.withColumn("hits", none))
    out = blocked.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(cover, result)
    return unfenced(out, inner, outer, added)
