"""Alignment of the tokens of two vocabularies by diagonal run skipping, and corpus-wide counts of the pairs that it links."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import U64, pack, pack_raw, parts, power_of_two, unpack, unpack_raw
from .bpe import coder
from .common import fenced, fields_of, hashable, materialize, shuffle_partitions, unfenced

#: Both vocabularies start a token at a single space between two other characters, so that texts are encoded piece by piece.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Parts of texts whose tokens a task keeps at hand, and their tokens; beyond either it starts anew.
KEPT_PARTS, KEPT_TOKENS = 1 << 19, 1 << 24
#: Bytes of packed links in a block, and blocks in a team.
BLOCK_BYTES, TEAM = 1 << 23, 512

Run = tuple[int, int, int, int, bool]


def alignment(ea: list[int], eb: list[int]) -> list[Run]:
    """Runs (i0, i1, j0, j1, one to one) of the tokens of two lists of end offsets with the same last one.

    While ends agree at the current shift j - i, doubling steps compare whole slices, and halving steps find where the stretch
    ends: it is one run, of as many groups as it has tokens. Where they don't, tokens are taken one at a time on the side that
    lags until both end together: that run is one group, after which the shift is another.
    """
    runs: list[Run] = []
    note = runs.append
    n = len(ea)
    ea, eb = [*ea, -1], [*eb, -2]  # never equal, and never reached by the side that lags
    i = j = 0
    while i < n:
        a, b = ea[i], eb[j]
        if a != b:
            p, q = i, j
            while a != b:
                if a < b:
                    p += 1
                    a = ea[p]
                else:
                    q += 1
                    b = eb[q]
            p += 1
            q += 1
            note((i, p, j, q, False))
            i, j = p, q
            continue
        k = 1
        if ea[i + 1] == eb[j + 1]:
            k = step = 2
            while ea[i + k : i + k + step] == eb[j + k : j + k + step]:
                k += step
                step *= 2
            while step > 1:
                step //= 2
                if ea[i + k : i + k + step] == eb[j + k : j + k + step]:
                    k += step
        note((i, i + k, j, j + k, True))
        i += k
        j += k
    return runs


class Aligner:
    """Two vocabularies: a byte-level one (A) and a SentencePiece model (B), which both read a text behind a space."""

    def __init__(self, ranks_path: str, pattern: str, pieces_path: str):
        self.a = coder(ranks_path, pattern, ())
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = self.a.sizes, np.array([len(x) for x in self.b_bytes])
        # A piece that goes on over a space would be cut by CUT.
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = [np.empty(0, np.int32), np.empty(0, np.int32)]
        self.start = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.same = np.empty(0, bool)

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.a.plain(b" " + text.encode()), np.int32), np.array(self.b.encode(text), np.int32)

    def told(self, b: np.ndarray) -> bytes:
        return b"".join([self.b_bytes[k] for k in b.tolist()])

    def fill(self, parts: list[str]) -> None:
        """Keeps the tokens of new parts. Many parts are encoded as one text and told apart by their bytes, or one by one if B reads
        other bytes in any of them."""
        made: tuple[list, list] = ([], [])
        ends: tuple[list, list] = ([], [])
        done = [0, 0]
        for s in range(0, len(parts), 512):
            some = parts[s : s + 512]
            both = self.encoded(" ".join(some))
            if self.told(both[1]) == "".join([" " + x for x in some]).encode():
                cuts = np.cumsum([1 + len(x.encode()) for x in some])
                at = [np.searchsorted(np.cumsum(size[ids]), cuts, "right") for ids, size in zip(both, (self.a_sizes, self.b_sizes), strict=True)]
                same = np.ones(len(some), bool)
            else:
                each = [self.encoded(x) for x in some]
                both = [np.concatenate([x[k] for x in each]) for k in range(2)]
                at = [np.cumsum([len(x[k]) for x in each]) for k in range(2)]
                same = np.array([self.told(x[1]) == b" " + y.encode() for x, y in zip(each, some, strict=True)])
            for k in range(2):
                made[k].append(both[k])
                ends[k].append(at[k] + len(self.flat[k]) + done[k])
                done[k] += len(both[k])
            self.same = np.append(self.same, same)
        for k in range(2):
            self.start[k] = np.concatenate([self.start[k], *ends[k]])
            self.flat[k] = np.concatenate([self.flat[k], *made[k]])
        self.number.update(zip(parts, range(len(self.number), len(self.number) + len(parts)), strict=True))

    def tokens(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of A, ids of B) of space+text; both empty if a side's bytes are others, as they are wherever U+2581 is."""
        if len(self.number) > KEPT_PARTS or len(self.flat[0]) > KEPT_TOKENS:
            self.forget()
        cut = [(CUT.split(x) if self.cuts else [x]) if x and "▁" not in x else [] for x in texts]
        if new := {y for x in cut for y in x}.difference(self.number):
            self.fill(list(new))
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64)
        ends = np.cumsum([len(x) for x in cut])
        sides = []
        for flat, start in zip(self.flat, self.start, strict=True):
            sizes = start[at + 1] - start[at]
            before = np.append(0, np.cumsum(sizes))
            sides.append((flat[np.repeat(start[at] - before[:-1], sizes) + np.arange(before[-1])], before))
        pos = 0
        for end in ends.tolist():
            known = self.same[at[pos:end]].all()
            yield tuple(ids[before[pos] : before[end]].astype(np.int64) if known else np.empty(0, np.int64) for ids, before in sides)
            pos = end


@lru_cache(2)
def aligner(ranks_path: str, pattern: str, pieces_path: str) -> Aligner:
    return Aligner(ranks_path, pattern, pieces_path)


def group_ends(runs: list[Run]) -> tuple[np.ndarray, np.ndarray]:
    """(ends in A, ends in B) of the groups, as numbers of tokens."""
    i, p, j, _, one = np.array(runs, np.int64).reshape(-1, 5).T
    times = np.where(one, p - i, 1)
    head = np.cumsum(times) - times
    nth = np.arange(times.sum()) - np.repeat(head, times) + 1
    last = nth == np.repeat(times, times)
    q = np.array([r[3] for r in runs], np.int64)
    return np.where(last, np.repeat(p, times), np.repeat(i, times) + nth), np.where(last, np.repeat(q, times), np.repeat(j, times) + nth)


#: Decimal ids, each followed by a comma, a bar or a semicolon, in six bytes.
_DECIMALS = np.array([[f"{k}{c}" for c in ",|;"] for k in range(1 << 16)], "S6").view(np.uint8).reshape(-1, 6)


def group_text(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray) -> bytes:
    """The groups in decimal ids, ``a1,a2|b1``, joined by semicolons."""
    na, nb = np.diff(ga, prepend=0), np.diff(gb, prepend=0)
    place = np.empty(len(a) + len(b), np.int64)
    at_a = np.arange(len(a)) + np.repeat(gb - nb, na)
    at_b = np.arange(len(b)) + np.repeat(ga, nb)
    place[at_a], place[at_b] = a * 3, b * 3
    place[at_a[ga - 1]] += 1
    place[at_b[gb - 1]] += 2
    rows = _DECIMALS[place]
    return rows[rows > 0].tobytes()[:-1]


def links_of(a: np.ndarray, b: np.ndarray, ea: np.ndarray, eb: np.ndarray) -> np.ndarray:
    """Keys of all pairs of overlapping tokens: between two neighbouring ends, whichever side they are of, lies one pair."""
    fa, fb = np.zeros(ea[-1] + 1, bool), np.zeros(ea[-1] + 1, bool)
    fa[ea], fb[eb] = True, True
    at = np.flatnonzero(fa | fb)
    fa, fb = fa[at], fb[at]
    return spread(a[np.cumsum(fa) - fa], b[np.cumsum(fb) - fb])


def spread(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs of ids below 2**16 as keys of 32 bits, all pairs of an A id together, A ids spread."""
    return ((a.astype(U64) * U64(40503) & U64(65535)) << U64(16)) | b.astype(U64)


def text_runs(column: pa.Array, most: int = 1 << 22) -> Iterator[list[str | None]]:
    """The texts of a column in runs of about so many characters."""
    run, size = [], 0
    for x in column:
        run.append(x.as_py())
        size += len(run[-1] or "")
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


LINKS = "links binary, times binary"
CELLS = "part long, sender long, keys binary, counts binary"
ANSWERS = "block long, part long, counts binary, best binary"
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def aligned(docs: DataFrame, carried: list[str], paths: dict, groups: bool) -> DataFrame:
    """The carried columns with n_a, n_b, n_groups, n_links, groups_sha256, the groups if asked for, and, packed, the distinct pairs
    of ids that are linked (links) with the times each is (times)."""
    added = ["n_a long", "n_b long", "n_groups long", "n_links long", "groups_sha256 string", *["groups string"] * groups, LINKS]
    names = [*carried, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *["groups"] * groups, "links", "times"]

    def one(a: np.ndarray, b: np.ndarray, own: Aligner) -> tuple:
        if not len(a):
            return 0, 0, 0, 0, "", *([""] * groups), b"", b""
        ea, eb = np.cumsum(own.a_sizes[a]), np.cumsum(own.b_sizes[b])
        ga, gb = group_ends(alignment(ea.tolist(), eb.tolist()))
        links = links_of(a, b, ea, eb)
        links.sort()
        head = np.flatnonzero(np.append(True, links[1:] != links[:-1]))
        told = group_text(a, b, ga, gb)
        times = np.diff(np.append(head, len(links)))
        return len(a), len(b), len(ga), len(links), hashlib.sha256(told).hexdigest(), *([told.decode()] if groups else []), pack(links[head]), pack_raw(times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(**paths)
        kinds = [pa.int64()] * 4 + [pa.string()] * (1 + groups) + [pa.binary()] * 2
        for batch in batches:
            told = list(zip(*[one(a, b, own) for part in text_runs(batch.column(0)) for a, b in own.tokens(part)], strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c, k) for c, k in zip(told, kinds, strict=True))], names=names)

    return docs.select("text", *carried).mapInArrow(run, ", ".join([*fields_of(docs, carried), *added]))


def _cells(keys: np.ndarray, counts: np.ndarray, sender: int, n_parts: int) -> pa.Table:
    rows = [(p, sender, pack(keys[s:e]), pack_raw(counts[s:e])) for p, s, e in parts(keys, n_parts, 32)]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(("part", "sender", "keys", "counts"), kinds, strict=True))})


def _summed(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(keys of each cell, all keys sorted, their sums)."""
    arrays = [unpack(x.as_py()) for x in table["keys"]]
    keys, at = np.unique(np.concatenate(arrays), return_inverse=True)
    counts = np.concatenate([unpack_raw(x.as_py()).astype(np.int64) for x in table["counts"]])
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, at, counts)
    return arrays, keys, sums


def _answers(table: pa.Table, arrays: list[np.ndarray], keys: np.ndarray, sums: np.ndarray, best: np.ndarray) -> pa.Table:
    at = [np.searchsorted(keys, own) for own in arrays]
    return pa.table({"block": table["sender"], "part": table["part"], "counts": pa.array([pack_raw(sums[i]) for i in at], pa.binary()), "best": pa.array([np.packbits(best[i]).tobytes() for i in at], pa.binary())})


def _totals(table: pa.Table) -> pa.Table:
    """To each sender, for its keys in order: the sum over all senders, and whether it is the largest of the key's A id."""
    arrays, keys, sums = _summed(table)
    own = keys >> U64(16)
    head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    top = np.repeat(np.maximum.reduceat(sums, head), np.diff(np.append(head, len(keys))))
    return _answers(table, arrays, keys, sums, sums == top)


def _merge(n_parts: int):
    def run(table: pa.Table) -> pa.Table:
        _, keys, sums = _summed(table)
        return _cells(keys, sums, table["team"][0].as_py(), n_parts)

    return run


def _split(own: pa.Table, told: pa.Table) -> pa.Table:
    arrays, keys, _ = _summed(own)
    best = np.unpackbits(np.frombuffer(told["best"][0].as_py(), np.uint8))[: len(keys)].astype(bool)
    return _answers(own, arrays, keys, unpack_raw(told["counts"][0].as_py()).astype(np.int64), best)


def counted(cells: DataFrame, blocks: int, n_parts: int) -> DataFrame:
    """Answers (block, part, counts, best) to the cells of all blocks. Teams of blocks add up their cells of a part first, so
    that a part has a cell a team."""
    if blocks <= TEAM:
        return cells.groupBy("part").applyInArrow(_totals, ANSWERS)
    teamed = cells.withColumn("team", F.expr(f"sender div {TEAM}"))
    told = teamed.groupBy("part", "team").applyInArrow(_merge(n_parts), CELLS).groupBy("part").applyInArrow(_totals, ANSWERS)
    told = told.withColumnRenamed("block", "team")
    return teamed.groupBy("part", "team").cogroup(told.groupBy("part", "team")).applyInArrow(_split, ANSWERS)


def align_documents(docs: DataFrame, ranks_path: str, pattern: str, pieces_path: str, text: str = "text", groups: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row without its text, with n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and the groups if asked for.

    Space+text is encoded by a byte-level vocabulary (A) and by a SentencePiece model (B). Where tokens of both end at the same
    byte, groups end; groups are ``a1,a2|b1``, joined by semicolons. A link is a pair of overlapping tokens, one of each side; the
    count of a pair of ids is the number of rows that hold it linked. n_best counts the links whose count is the highest of their
    A id (ties included), count_sum adds up the counts of all links.

    Texts are encoded and aligned where they lie; only the distinct pairs of each row go on, packed. Blocks of rows send their
    pairs with counts by ranges of A ids, where they are added up, and get back the counts of their own pairs.

    Null and empty texts, and texts whose bytes B tells otherwise (U+2581, for instance), have zeros and an empty groups_sha256.
    Repeated rows each count. An empty table gives an empty result. Columns named like a result are replaced, all others carried
    along, whatever their names. Both vocabularies must have less than 2**16 ids.
    """
    spark = docs.sparkSession
    results = (*RESULTS, *["groups"] * groups)
    rows, inner, outer = fenced(docs, {text: "text"}, (text, *results))
    paths = {"ranks_path": ranks_path, "pattern": pattern, "pieces_path": pieces_path}
    own = Aligner(**paths)
    if max(len(own.a_sizes), len(own.b_sizes)) > 1 << 16:
        raise ValueError("ids of both vocabularies must be below 2**16")
    told = materialize(aligned(rows, inner, paths, groups))
    total = told.agg(F.sum(F.octet_length("links").cast("long"))).first()[0] or 0
    blocks = max(shuffle_partitions(spark), -(-total // block_bytes))
    n_parts = min(1 << 16, power_of_two(max(shuffle_partitions(spark) / 2, blocks / 8)))
    seed = hashable(told, [*inner, "links", "groups_sha256"])
    blocked = told.withColumn("block", F.pmod(F.xxhash64(*seed), F.lit(blocks)).cast("long")).repartition(blocks, "block")
    made = [c for c in told.columns if c not in ("links", "times")]
    schema = ", ".join([*fields_of(told, made), "n_best long", "count_sum long"])

    def pairs_of(table: pa.Table) -> list[np.ndarray]:
        return [unpack(x.as_py()) for x in table["links"]]

    def emit(table: pa.Table) -> pa.Table:
        keys, counts = np.unique(np.concatenate(pairs_of(table)), return_counts=True)
        return _cells(keys, counts, table["block"][0].as_py(), n_parts)

    def finish(own: pa.Table, told: pa.Table) -> pa.Table:
        pairs = pairs_of(own)
        keys = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, U64)
        counts, best = np.empty(0, np.int64), np.empty(0, bool)
        if told.num_rows:
            told = told.sort_by("part")
            sums = [unpack_raw(x.as_py()).astype(np.int64) for x in told["counts"]]
            counts = np.concatenate(sums)
            best = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8))[: len(s)] for x, s in zip(told["best"], sums, strict=True)]).astype(bool)
        n_best, count_sum = [], []
        for mine, times in zip(pairs, own["times"], strict=True):
            at = np.searchsorted(keys, mine)
            times = unpack_raw(times.as_py()).astype(np.int64) if len(mine) else np.empty(0, np.int64)
            n_best.append(int(times[best[at]].sum()))
            count_sum.append(int((times * counts[at]).sum()))
        return pa.table([*(own[c] for c in made), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], names=[*made, "n_best", "count_sum"])

    answers = counted(blocked.groupBy("block").applyInArrow(emit, CELLS), blocks, n_parts)
    out = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)
    return unfenced(out, inner, outer, results)
