"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .blobs import SENT_KEYS, U64, mix, pack, pack_raw, parts, power_of_two, repeated_keys, sent_keys, unpack, unpack_raw
from .common import fenced, fields_of, materialize, shuffle_partitions, unfenced
from .components import connected_components

BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Keys (fingerprint variants) that one task holds at a time.
TASK_KEYS = 1 << 22
#: Members of variant groups that are compared in one cell, and in the cells of one bin of parts on average.
CELL_ROWS, BIN_ROWS = 1 << 18, 1 << 16


def shingle_hashes(text: bytes | None, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of all word shingles, repeats included; of fewer words: of the whole sequence; of none: empty."""
    ws = (text or b"").lower().split()  # of bytes: A-Z only, and the white space of SPACE
    n = len(ws)
    if not n:
        return np.empty(0, "<u8")
    joined = b" ".join(ws)
    if n <= shingle:
        return np.array([xxh64_intdigest(joined, seed)], "<u8")
    lengths = np.fromiter(map(len, ws), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - shingle + 1].tolist()
    return np.array([xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], "<u8")


def majority(hashes: np.ndarray, words: int) -> bytes:
    """The fingerprint of so many 64-bit words: a bit is set if it is in over half the hashes. The first word takes the hashes as
    they are, the others a mix of each with the word's number."""
    counts = np.zeros((8 * words, 8), np.int64)
    columns = np.arange(8 * words) << 8
    for k in range(0, len(hashes), 4096):
        part = hashes[k : k + 4096].astype(U64)
        wide = np.stack([part, *(mix(part + U64((j * 0x9E3779B97F4A7C15) % (1 << 64))) for j in range(1, words))], 1)
        octets = wide.astype("<u8").view(np.uint8).reshape(len(part), -1)
        counts += np.bincount((octets + columns).ravel(), minlength=256 * 8 * words).reshape(-1, 256) @ BITS
    return np.packbits(2 * counts > len(hashes), axis=1, bitorder="little").tobytes()


def fingerprint(text: bytes | None, shingle: int, seed: int = 42) -> int:
    return int.from_bytes(majority(shingle_hashes(text, shingle, seed), 1), "little")


def fingerprints(docs: DataFrame, made: Callable[[bytes | None], object], kind: pa.DataType, name: str, carried: list[str]) -> DataFrame:
    """The carried columns of every row and, as column ``name``, what ``made`` gives for its column text (binary)."""
    schema = ", ".join([*fields_of(docs, carried), f"{name} {'binary' if kind == pa.binary() else 'long'}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([made(x.as_py()) for x in batch.column(0)], kind)], names=[*carried, name])

    return docs.select(F.col("text").cast("binary").alias("text"), *carried).mapInArrow(run, schema)


@lru_cache
def masks(radius: int) -> np.ndarray:
    """All 64-bit integers with at most so many bits set."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(64), r)], U64)


class Shared:
    """Fingerprints (column fp, unique; label, if they have one) in blocks, and the variants of each block that occur twice in all.

    ``variants`` gives the fp of each row of a table and its ``each`` variants, row by row, as spread 64-bit keys. Only the leading
    bits of the keys are shuffled for that.
    """

    def __init__(self, fps: DataFrame, variants: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], each: int):
        spark = fps.sparkSession
        total = max(1, fps.count() * each)
        blocks = max(shuffle_partitions(spark), -(-total // TASK_KEYS))
        n_parts = power_of_two(max(shuffle_partitions(spark) / 2, total / TASK_KEYS))
        # So many leading bits that about one variant in 2**12 meets another by chance, however many there are.
        bits = min(64, max(24, n_parts.bit_length() + 1, int(np.ceil(np.log2(total))) + 12))
        cut = U64(64 - bits)
        told_apart = "label" in fps.columns
        self.blocks, self.n_parts, self.told_apart = blocks, n_parts, told_apart
        self.blocked = fps.withColumn("block", F.pmod(F.xxhash64("fp"), F.lit(blocks)).cast("long")).repartition(blocks, "block")

        def emit(table: pa.Table) -> pa.Table:
            return sent_keys(variants(table)[1] >> cut, table["block"][0].as_py(), n_parts, bits)

        def members(own: pa.Table, told: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(fp, label, key) of the block's variants that occur twice, by key and fp; the label is the fp where there is none."""
            if not own.num_rows or not told.num_rows:
                return (np.empty(0, U64),) * 3
            hits = np.sort(np.concatenate([unpack(x.as_py()) for x in told["hits"]]))
            fp, keys = variants(own)
            short = keys >> cut
            sieve = np.zeros(1 << 22, bool)
            low = U64(len(sieve) - 1)
            sieve[hits & low] = True
            at = np.flatnonzero(sieve[short & low])
            near = np.minimum(np.searchsorted(hits, short[at]), len(hits) - 1)
            at = at[hits[near] == short[at]]
            label = own["label"].to_numpy().view(U64) if told_apart else fp
            fp, label, keys = fp[at // each], label[at // each], keys[at]
            order = np.lexsort((fp.view(np.int64), keys))
            return fp[order], label[order], keys[order]

        self.members = members
        self.told = repeated_keys(self.blocked.groupBy("block").applyInArrow(emit, SENT_KEYS), n_parts, bits)


def _heads(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)


def colliding(fps: DataFrame, variants: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], each: int, few: int, loose: bool = False) -> DataFrame:
    """Candidate links (a, b) between fingerprints (column fp, unique) that share a variant (of Shared).

    The variants that occur twice are sent whole, with their fp. All fingerprints of a variant are linked to the smallest, in
    groups of up to ``few`` all to all; with a column label, only fingerprints of different labels are.

    ``loose`` is for passes that only save work of a later one: a block of rows links those of its own that share a variant to
    the smallest and sends that one alone, so that a hot variant never brings more than one row a block to a task; labels are
    linked once in a task.
    """
    shared = Shared(fps, variants, each)
    members, n_parts, told_apart = shared.members, shared.n_parts, shared.told_apart

    def resend(own: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        fp, label, keys = members(own, told)
        if loose and len(keys):
            head = _heads(keys)
            hub = np.repeat(head, np.diff(np.append(head, len(keys))))
            links = _links_of(fp, fp[hub], label, label[hub])
            rows.append((-1, b"", pack_raw(links[:, 0]), pack_raw(links[:, 1])))
            fp, label, keys = fp[head], label[head], keys[head]
        rows += [(p, pack(keys[s:e]), pack_raw(fp[s:e]), pack_raw(label[s:e]) if told_apart else b"") for p, s, e in parts(keys, n_parts)]
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "keys": pa.array([r[1] for r in rows], pa.binary()), "fps": pa.array([r[2] for r in rows], pa.binary()), "labels": pa.array([r[3] for r in rows], pa.binary())})

    def pairs(table: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack(x.as_py()) for x in table["keys"]])
        fp = np.concatenate([unpack_raw(x.as_py()) for x in table["fps"]])
        label = np.concatenate([unpack_raw(x.as_py()) for x in table["labels"]]) if told_apart else fp
        order = np.lexsort((fp.view(np.int64), keys))
        keys, fp, label = keys[order], fp[order], label[order]
        head = _heads(keys)
        size = np.diff(np.append(head, len(keys)))
        hub = np.repeat(head, size)
        if loose:
            found = [_links_of(fp, fp[hub], label, label[hub])]
        else:
            small = np.repeat(size <= few, size)
            found = [np.stack([fp, fp[hub]], 1)[label != label[hub]]]
            for step in range(1, few - 1):
                at = np.flatnonzero((keys[step:] == keys[:-step]) & small[step:] & (label[step:] != label[:-step]))
                found.append(np.stack([fp[at + step], fp[at]], 1))
        found = np.unique(np.concatenate(found).view(np.int64), axis=0).reshape(-1, 2)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    sent = shared.blocked.groupBy("block").cogroup(shared.told.groupBy("block")).applyInArrow(resend, "part int, keys binary, fps binary, labels binary")
    if not loose:
        return sent.groupBy("part").applyInArrow(pairs, "a long, b long").distinct()
    sent = materialize(sent)
    local = sent.filter("part < 0").select("fps", "labels").mapInArrow(_unpacked, "a long, b long")
    return sent.filter("part >= 0").groupBy("part").applyInArrow(pairs, "a long, b long").unionByName(local).distinct()


CELL = "keys binary, fps binary, labels binary"
_CELL_KIND = pa.struct([("keys", pa.binary()), ("fps", pa.binary()), ("labels", pa.binary())])


def _cell(keys: np.ndarray, fp: np.ndarray, label: np.ndarray) -> dict:
    """Members by key, then fp."""
    order = np.lexsort((fp.view(np.int64), keys))
    return {"keys": pack_raw(keys[order]), "fps": pack_raw(fp[order]), "labels": pack_raw(label[order])}


def cells_apart(fps: DataFrame, variants: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], each: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Cells (bin, cell) of at most about ``cell_rows`` members (key, fp, label) such that every two fingerprints that share a variant
    and have different labels are in one of them.

    A block first tells, one row a variant, the smallest and the largest label that it has there: only where two labels meet
    are members sent at all, so that a variant of millions of one label costs a row a block. Variants of up to cell_rows
    members go to the task of their part. Those of more are dealt into pieces, a label of many members into some of its own:
    every two pieces that don't have the same single label make a cell.
    """
    shared = Shared(fps, variants, each)
    members, n_parts = shared.members, shared.n_parts

    def tally(own: pa.Table, told: pa.Table) -> pa.Table:
        _, label, keys = members(own, told)
        head = _heads(keys)
        told = [np.minimum.reduceat(label, head), np.maximum.reduceat(label, head), np.diff(np.append(head, len(keys)))] if len(head) else [keys] * 3
        rows = [(p, own["block"][0].as_py(), pack(keys[head[s:e]]), *(pack_raw(x[s:e]) for x in told)) for p, s, e in parts(keys[head], n_parts)]
        names = {"part": pa.int64(), "block": pa.int64(), "keys": pa.binary(), "least": pa.binary(), "most": pa.binary(), "n": pa.binary()}
        return pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(names.items())})

    def judge(table: pa.Table) -> pa.Table:
        own = [unpack(x.as_py()) for x in table["keys"]]
        keys, at = np.unique(np.concatenate(own), return_inverse=True)
        least, most, n = (np.concatenate([unpack_raw(x.as_py()) for x in table[c]]) for c in ("least", "most", "n"))
        low, high, total = np.full(len(keys), ~U64(0)), np.zeros(len(keys), U64), np.zeros(len(keys), U64)
        np.minimum.at(low, at, least)
        np.maximum.at(high, at, most)
        np.add.at(total, at, n)
        apart = low != high
        rows = []
        for block, mine in zip(table["block"].to_pylist(), own, strict=True):
            i = np.searchsorted(keys, mine)
            i = i[apart[i]]
            if len(i):
                rows.append((block, pack(keys[i]), pack_raw(total[i])))
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "keys": pa.array([r[1] for r in rows], pa.binary()), "n": pa.array([r[2] for r in rows], pa.binary()), "hits": pa.array([None] * len(rows), pa.binary())})

    def send(own: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        asked = told.filter(told["keys"].is_null()) if told.num_rows else told
        judged = told.filter(told["keys"].is_valid()) if told.num_rows else told
        if judged.num_rows:
            apart = np.concatenate([unpack(x.as_py()) for x in judged["keys"]])
            total = np.concatenate([unpack_raw(x.as_py()) for x in judged["n"]])
            order = np.argsort(apart)
            apart, total = apart[order], total[order]
            fp, label, keys = members(own, asked)
            at = np.minimum(np.searchsorted(apart, keys), len(apart) - 1)
            here = apart[at] == keys
            large = here & (total[at] > cell_rows)
            if large.any():
                rows.append((-1, int(large.sum()), _cell(keys[large], fp[large], label[large])))
            here &= ~large
            fp, label, keys = fp[here], label[here], keys[here]
            rows += [(p, e - s, _cell(keys[s:e], fp[s:e], label[s:e])) for p, s, e in parts(keys, n_parts)]
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int64()), "n": pa.array([r[1] for r in rows], pa.int64()), "cell": pa.array([r[2] for r in rows], _CELL_KIND)})

    def gathered(table: pa.Table) -> pa.Table:
        keys, fp, label = (np.concatenate([unpack_raw(x[c].as_py()) for x in table["cell"]]) for c in ("keys", "fps", "labels"))
        order = np.lexsort((fp.view(np.int64), keys))
        keys, fp, label = keys[order], fp[order], label[order]
        part, rows, ends = table["part"][0].as_py(), [], np.append(_heads(keys)[1:], len(keys))
        start = last = 0
        for end in ends.tolist():
            if end - start > cell_rows and last > start:
                rows.append((part << 24 | len(rows), _cell(keys[start:last], fp[start:last], label[start:last])))
                start = last
            last = end
        rows.append((part << 24 | len(rows), _cell(keys[start:], fp[start:], label[start:])))
        return pa.table({"bin": pa.array([r[0] for r in rows], pa.int64()), "cell": pa.array([r[1] for r in rows], _CELL_KIND)})

    asked = materialize(shared.told)
    tallied = shared.blocked.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(tally, "part long, block long, keys binary, least binary, most binary, n binary")
    judged = tallied.groupBy("part").applyInArrow(judge, "block long, keys binary, n binary, hits binary")
    none = F.lit(None).cast("binary")
    told = judged.unionByName(asked.select("block", none.alias("keys"), none.alias("n"), "hits"))
    sent = shared.blocked.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(send, f"part long, n long, cell struct<{CELL.replace(' binary', ': binary')}>")
    sent = materialize(sent)
    # As few bins as keep their size: a member of many variants is told once a bin.
    few = sent.filter("part >= 0").agg(F.sum("n")).first()[0] or 0
    bins = min(n_parts, power_of_two(few / BIN_ROWS))
    binned = sent.filter("part >= 0").withColumn("part", F.floor(F.col("part") / (n_parts // bins)))
    cells = binned.groupBy("part").applyInArrow(gathered, f"bin long, cell struct<{CELL.replace(' binary', ': binary')}>")
    large = sent.filter("part < 0")
    return cells if large.isEmpty() else cells.unionByName(_piece_cells(large, cell_rows))


def _piece_cells(large: DataFrame, cell_rows: int) -> DataFrame:
    """Cells of the variants of more than cell_rows members, from their packed members."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(unpack_raw(cell[c].as_py()).view(np.int64)) for c in ("keys", "fps", "labels")], names=["k", "fp", "label"])

    half = cell_rows // 2
    own = materialize(large.select("cell").mapInArrow(rows, "k long, fp long, label long"))
    sizes = own.groupBy("k", "label").agg(F.count("*").alias("n"))
    many = materialize(sizes.filter(F.col("n") > half))
    rest = sizes.filter(F.col("n") <= half).groupBy("k").agg(F.sum("n").alias("rest"))
    rest = materialize(rest)
    # Pieces: of a label of many members, or (own_label null) of all other labels of the variant.
    of_many = many.select("k", F.col("label").alias("own_label"), F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / half).cast("int"))).alias("nth"))
    of_rest = rest.select("k", F.lit(None).cast("long").alias("own_label"), F.explode(F.sequence(F.lit(0), F.floor((F.col("rest") - 1) / half).cast("int"))).alias("nth"))
    pieces = materialize(of_many.unionByName(of_rest).withColumn("piece", F.xxhash64("k", "own_label", "nth")))
    a, b = (pieces.select("k", F.col("own_label").alias(f"{x}_label"), F.col("piece").alias(x)) for x in "ab")
    pairs = a.join(b, "k").filter((F.col("a") < F.col("b")) & ~F.coalesce(F.col("a_label") == F.col("b_label"), F.lit(False)))
    cells = pairs.withColumn("bin", F.xxhash64("k", "a", "b")).select("k", "bin", F.explode(F.array("a", "b")).alias("piece"))
    mine = own.join(many.select("k", "label", "n"), ["k", "label"], "left").join(rest, "k", "left")
    wide = F.floor((F.coalesce("n", "rest") - 1) / half) + 1
    nth = F.pmod(F.when(F.col("n").isNotNull(), F.xxhash64("fp")).otherwise(F.xxhash64("label")), wide).cast("int")
    mine = mine.withColumn("piece", F.xxhash64("k", F.when(F.col("n").isNotNull(), F.col("label")), nth))

    def packed(table: pa.Table) -> pa.Table:
        cell = _cell(*(table[c].to_numpy().view(U64) for c in ("k", "fp", "label")))
        return pa.table({"bin": table["bin"][:1], "cell": pa.array([cell], _CELL_KIND)})

    met = mine.select("k", "fp", "label", "piece").join(cells, ["k", "piece"])
    return met.groupBy("bin").applyInArrow(packed, f"bin long, cell struct<{CELL.replace(' binary', ': binary')}>")


def _links_of(fp: np.ndarray, hub: np.ndarray, label: np.ndarray, hub_label: np.ndarray) -> np.ndarray:
    """Links (fp, hub) between different labels, one for each pair of labels."""
    apart = np.flatnonzero(label != hub_label)
    _, first = np.unique(np.stack([label[apart], hub_label[apart]], 1), axis=0, return_index=True)
    return np.stack([fp[apart[first]], hub[apart[first]]], 1)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(batch.column(0), batch.column(1), strict=True):
            cols = [pa.array(unpack_raw(x.as_py()).view(np.int64)) for x in (a, b)]
            yield pa.RecordBatch.from_arrays(cols, names=["a", "b"])


def group_links(cells: DataFrame, bits: DataFrame, limit: int) -> DataFrame:
    """Verified links (a, b) that connect all members of a group, at most ``limit`` bits apart, of the groups in ``cells`` (bin,
    cell, from cells_apart).

    Every pair of a group is compared over its whole fingerprint (fp, bits in ``bits``) unless its ends are connected already.
    That is done within a task, which gets each fingerprint of its groups once and returns only the links that connect: rows
    grow with the members, only comparisons of members that stay apart grow with the square of a group.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, cell in zip(batch.column("bin").to_pylist(), batch.column("cell"), strict=True):
                fp = np.unique(unpack_raw(cell["fps"].as_py()).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k), pa.int64()), pa.array(fp)], names=["bin", "fp"])

    def connect(own: pa.Table, told: pa.Table) -> pa.Table:
        links = []
        if own.num_rows:
            cell = own["cell"][0]
            keys, fp, label = (unpack_raw(cell[x].as_py()) for x in ("keys", "fps", "labels"))
            known = told["fp"].to_numpy().view(U64)
            order = np.argsort(known)
            wide = np.frombuffer(b"".join(told["bits"].to_pylist()), U64).reshape(len(known), -1)
            at = order[np.searchsorted(known[order], fp)]
            root = np.unique(label, return_inverse=True)[1]
            parent = np.arange(root.max() + 1)

            def top(x: int) -> int:
                while parent[x] != x:
                    x = parent[x]
                return x

            end = np.searchsorted(keys, keys, "right")
            step, left = 0, np.arange(len(keys))
            while True:
                step += 1
                left = left[left + step < end[left]]
                if not len(left):
                    break
                for s in range(0, len(left), 1 << 16):
                    i = left[s : s + (1 << 16)]
                    i = i[parent[root[i]] != parent[root[i + step]]]
                    i = i[np.bitwise_count(wide[at[i]] ^ wide[at[i + step]]).sum(1, dtype=np.int64) <= limit]
                    for x in i.tolist():
                        a, b = top(root[x]), top(root[x + step])
                        if a != b:
                            parent[max(a, b)] = min(a, b)
                            links.append((fp[x], fp[x + step]))
                    while len(i) and (parent[parent] != parent).any():
                        parent[:] = parent[parent]
        found = np.array(links, U64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    wanted = cells.mapInArrow(members, "bin long, fp long").join(bits.select("fp", "bits"), "fp")
    return cells.groupBy("bin").cogroup(wanted.groupBy("bin")).applyInArrow(connect, "a long, b long").distinct()


def near_links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect exactly those at most ``distance`` (even) bits apart.

    Every fingerprint emits all variants within distance / 2 bits. Two fingerprints within distance share a variant, and all
    that share one are within distance of each other, so a star on the smallest per variant connects them without pairs. Links
    are verified bit by bit.
    """
    if distance % 2:
        raise ValueError("distance must be even")
    ball = masks(distance // 2)

    def variants(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        own = table["fp"].to_numpy().view(U64)
        return own, mix((own[:, None] ^ ball[None, :]).ravel())

    links = colliding(fps.select("fp"), variants, len(ball), 2)
    return links.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


RESULTS = ("fingerprint", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4, distance: int = 4) -> DataFrame:
    """Every row without its text, with fingerprint (16 hex digits), fp (signed), root and component_id.

    component_id is the smallest key that can be reached over fingerprints at most ``distance`` bits apart, the row itself
    included. Texts without a word (null and empty ones too) have fingerprint zero and link as any other. Rows with a null key
    get the smallest key of their component, null if there is none. Repeated rows share a component; an empty table gives an
    empty result. Columns named like a result are replaced, all others carried along, whatever their names.
    """
    rows, inner, outer = fenced(docs, {text: "text", key: "id"}, (text, *RESULTS))
    signed = lambda x: int(np.array(fingerprint(x, shingle), U64).view(np.int64))
    seen = materialize(fingerprints(rows, signed, pa.int64(), "fp", [*inner, "id"]))
    distinct = materialize(seen.groupBy("fp").agg(F.min("id").alias("least")))
    return unfenced(_named(seen, distinct, near_links(distinct, distance)), inner, outer, RESULTS)


def _named(seen: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """The rows (with their fp) and fingerprint, root and component_id, from the links between distinct fingerprints (fp, least)."""
    roots = connected_components(links)
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(labelled.join(least, "root").select("fp", "root", "component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return seen.join(named, "fp").withColumn("fingerprint", hexed)


#: Fingerprints of similar_documents: WORDS 64-bit words, each two bands of 32 bits.
WORDS = 16


def similar_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """As near_duplicates, but for texts whose shingles have a Jaccard similarity of about ``similarity`` or more.

    At a similarity of 0.8, 15 % of the bits differ: far more than a ball over 64 bits can hold. So the fingerprint has 1024 bits,
    in 32 bands of 32 bits, and each band emits all its variants within one bit: two fingerprints collide if they differ by two
    bits or fewer in any band (98 % of pairs at 0.8, practically all at 0.85). Colliding pairs are verified over all bits: they
    link up to the expected distance at ``similarity`` plus one standard deviation.

    Bands that are equal are linked first, those of FIRST_BANDS and then all: that joins most of a large group of copies by few
    links and only saves work, as the variants hold all that these passes can miss. Last, the groups of fingerprints that share a
    variant and are still apart are compared whole (group_links). Repeats of a shingle count once. Cases as for near_duplicates;
    the fingerprint column is a hash of the 1024 bits of the first text so linked.
    """
    rows, inner, outer = fenced(docs, {text: "text", key: "id"}, (text, *RESULTS))
    wide = lambda x: majority(np.unique(shingle_hashes(x, shingle)), WORDS)
    seen = fingerprints(rows, wide, pa.binary(), "bits", [*inner, "id"]).withColumn("fp", F.xxhash64("bits"))
    seen = materialize(seen)
    distinct = materialize(seen.groupBy("fp").agg(F.min("id").alias("least"), F.min("bits").alias("bits")))
    seen = seen.drop("bits")
    differ = WORDS * 64 * np.arccos(2 * similarity / (1 + similarity)) / np.pi
    limit = int(differ + np.sqrt(differ * (1 - differ / (64 * WORDS))))
    labelled = distinct.withColumn("label", F.col("fp"))
    for bands in (FIRST_BANDS, 2 * WORDS):
        met = materialize(colliding(labelled.select("fp", "bits", "label"), *_band_variants(bands, 0), 2, loose=True))
        labelled = materialize(_relabelled(labelled, _verified(met, distinct, limit)))
    cells = materialize(cells_apart(labelled.select("fp", "bits", "label"), *_band_variants(2 * WORDS, 1)))
    late = _between_labels(materialize(group_links(cells, labelled, limit)), labelled)
    groups = labelled.groupBy("label").agg(F.min("least").alias("least")).withColumnRenamed("label", "fp")
    told = seen.join(labelled.select("fp", "label"), "fp").drop("fp").withColumnRenamed("label", "fp")
    return unfenced(_named(told, groups, late), inner, outer, RESULTS)


#: Bands of the first pass of similar_documents.
FIRST_BANDS = 4


def _band_variants(bands: int, radius: int) -> tuple[Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], int]:
    """For colliding: the variants within ``radius`` bits of the first so many bands, and their number."""
    names = np.arange(bands, dtype=U64) << U64(32)
    ball = np.array([x for x in masks(radius).tolist() if x < 1 << 32], np.uint32)

    def variants(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        own = table["fp"].to_numpy().view(U64)
        cells = np.frombuffer(b"".join(x.as_py() for x in table["bits"]), "<u4").reshape(-1, 2 * WORDS)[:, :bands]
        return own, mix((names[None, :, None] | (cells[:, :, None] ^ ball[None, None, :]).astype(U64)).ravel())

    return variants, bands * len(ball)


def _verified(links: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """Links (a, b) whose fingerprints (fp, bits in ``known``) differ by at most ``limit`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), U64).reshape(batch.num_rows, -1) for c in batch.columns[2:])
            near = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= limit
            yield batch.select(["a", "b"]).filter(pa.array(near))

    of = lambda c: known.select(F.col("fp").alias(c), F.col("bits").alias(f"bits_{c}"))
    both = links.join(of("a"), "a").join(of("b"), "b").select("a", "b", "bits_a", "bits_b")
    return materialize(both.mapInArrow(run, "a long, b long"))


def _between_labels(links: DataFrame, labelled: DataFrame) -> DataFrame:
    name = lambda c: labelled.select(F.col("fp").alias(c), F.col("label").alias(f"l{c}"))
    both = links.join(name("a"), "a").join(name("b"), "b")
    return both.select(F.col("la").alias("a"), F.col("lb").alias("b"))


def _relabelled(labelled: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, least, bits, label): the labels of linked fingerprints made one."""
    roots = connected_components(_between_labels(links, labelled)).withColumnRenamed("node", "label")
    told = labelled.join(roots, "label", "left")
    return told.select("fp", "least", "bits", F.coalesce("root", "label").alias("label"))
