"""Near-duplicates by SuperMinHash signatures, banding and verification on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .align import text_runs
from .blobs import U64, mix, unpack_raw
from .common import fenced, fields_of, hashable, materialize, shuffle_partitions, unfenced
from .components import connected_components
from .simhash import _between_labels, _relabelled, cells_apart, colliding

#: Components of a signature (a prime), and bands of so many rows each.
SIZE, BANDS, ROWS = 421, 60, 7
#: Bytes of text that a task verifies at a time.
VERIFIED_BYTES = 1 << 24
_EMPTY = ~U64(0)


class Shingler:
    """Distinct shingles of texts as sorted 64-bit hashes; keeps the hashes of words."""

    def __init__(self, shingle: int):
        self.shingle = shingle
        self.words: dict[bytes, int] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        ws = (text or b"").lower().split()  # of bytes: A-Z only, and the white space of SPACE
        if len(ws) < self.shingle:
            return np.array([xxh64_intdigest(b" ".join(ws), 1)] if ws else [], U64)
        known = self.words
        if len(known) > 1 << 19:
            known.clear()
        for w in set(ws).difference(known):
            known[w] = xxh64_intdigest(w, 2)
        own = np.fromiter(map(known.__getitem__, ws), U64, len(ws))
        n = len(own) - self.shingle + 1
        out = own[:n].copy()
        for k in range(1, self.shingle):
            out = mix(out * U64(0x9E3779B97F4A7C15) + own[k : k + n])
        return np.unique(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures of sets of 64-bit elements, a byte a component; of an empty set: zeros.

    Each element draws a permutation of the components. In step j it offers j plus a random fraction to the j-th component of its
    permutation, and a component keeps the least offer: as the ranks of an element are all different, the components are less
    spread than independent ones. Step j can't lower what an earlier step set, so that a set is done as soon as each component is
    set (for a large set, in the first step or two). A permutation is k -> (a * k + b) mod SIZE, with SIZE prime and a and b from
    the element: any two components get any two ranks equally often, which is what the variance depends on.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    best = np.full(len(sets) * SIZE, _EMPTY)
    x = np.concatenate(sets) if len(sets) else np.empty(0, U64)
    base = np.repeat(np.arange(len(sets)) * SIZE, sizes)
    first = mix(x ^ U64(0xA5A5A5A5A5A5A5A5))
    b = (first & U64(0xFFFFFFFF)).astype(np.int64) % SIZE
    a = 1 + (first >> U64(32)).astype(np.int64) % (SIZE - 1)
    for j in range(SIZE):
        if not len(x):
            break
        at = base + b  # b runs through a * j + b
        free = best[at] > U64(j << 32) if j else slice(None)
        offer = (mix(x[free] + U64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> U64(32)) | U64(j << 32)
        np.minimum.at(best, at[free], offer)
        done = (best.reshape(-1, SIZE) != _EMPTY).all(1)
        left = ~done[base // SIZE]
        x, base, a, b = x[left], base[left], a[left], b[left]
        b = (b + a) % SIZE
    out = (mix(best) & U64(0xFF)).astype(np.uint8).reshape(-1, SIZE)
    out[sizes == 0] = 0
    return out


def _wide(cells) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.uint8).reshape(-1, SIZE)


def band_variants(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For colliding and cells_apart: the keys of the BANDS bands of the signatures in column bits."""
    own = table["fp"].to_numpy().view(U64)
    rows = _wide(table["bits"].to_pylist())[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(U64)
    keys = np.broadcast_to(mix(np.arange(BANDS, dtype=U64)), rows.shape[:2])
    for k in range(ROWS):
        keys = mix(keys * U64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return own, keys.ravel()


def least_equal(percent: int) -> int:
    """Components that two signatures share, at least, if their sets may have a Jaccard similarity of ``percent`` hundredths: five
    standard deviations (of independent components) below the expectation."""
    p = percent / 100
    return max(0, int(SIZE * p - 5 * np.sqrt(SIZE * p * (1 - p))))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of distinct elements share at least ``percent`` hundredths of their union."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _plausible(links: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """Links (a, b, size: bytes of both texts) whose signatures share ``least`` components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_wide(batch.column(c).to_pylist()) for c in ("bits_a", "bits_b"))
            yield batch.select(["a", "b", "size"]).filter(pa.array((x == y).sum(1) >= least))

    of = lambda c: known.select(F.col("fp").alias(c), F.col("bits").alias(f"bits_{c}"), F.col("size").alias(f"size_{c}"))
    both = links.join(of("a"), "a").join(of("b"), "b").select("a", "b", (F.col("size_a") + F.col("size_b")).alias("size"), "bits_a", "bits_b")
    return materialize(both.mapInArrow(run, "a long, b long, size long"))


#: Bits of the sieve that texts pass before they are joined: 1 MB, whatever the table.
SIEVE = 1 << 23


def texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, text) of the wanted (fp, row: hash of the row whose text stands for fp)."""
    bit = F.pmod("row", F.lit(SIEVE))
    found = wanted.select(F.bitmap_bucket_number(bit).alias("k"), F.bitmap_bit_position(bit).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("m")).collect()
    sieve = np.zeros(SIEVE + (1 << 15), bool)
    for r in found:
        if r["k"] == 0:  # holds number 0 alone
            sieve[0] = True
            continue
        s = (r["k"] - 1) << 15
        # Bucket k holds the numbers from 32768 * (k - 1) + 1 on.
        sieve[s + 1 : s + 1 + (1 << 15)] = np.unpackbits(np.frombuffer(r["m"], np.uint8), bitorder="little")[: len(sieve) - s - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sieve[batch.column("row").to_numpy() & (SIEVE - 1)]))

    near = rows.select("row", F.col("text").cast("binary").alias("text")).mapInArrow(run, "row long, text binary")
    return near.join(wanted, "row").dropDuplicates(["fp"]).select("fp", "text")


def _confirmed(links: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The links (a, b) whose whole sets are similar enough. Links are dealt by b; a task gets the text of each a once."""
    total = links.agg(F.sum("size")).first()[0] or 0
    blocks = max(shuffle_partitions(links.sparkSession), -(-total // VERIFIED_BYTES))
    dealt = links.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(blocks)).cast("long").alias("block"))
    own = dealt.groupBy(F.col("block").alias("own_block"), "b").agg(F.collect_list("a").alias("near")).join(texts.withColumnsRenamed({"fp": "b", "text": "own"}), "b")
    other = dealt.select("block", "a").distinct().join(texts.withColumnsRenamed({"fp": "a"}), "a")

    def check(own: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        if own.num_rows:
            made = Shingler(shingle)
            sets = {a: made(t.as_py()) for a, t in zip(told["a"].to_pylist(), told["text"], strict=True)}
            for b, near, text in zip(own["b"].to_pylist(), own["near"].to_pylist(), own["own"], strict=True):
                mine = made(text.as_py())
                out += [(a, b) for a in near if similar(mine, sets[a], percent)]
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return materialize(own.groupBy("own_block").cogroup(other.groupBy("block")).applyInArrow(check, "a long, b long"))


def _cross(keys: np.ndarray, label: np.ndarray, wide: np.ndarray, least: int) -> Iterator[np.ndarray]:
    """(i, j) of members with the same key, different labels and enough components in common, some at a time."""
    end = np.searchsorted(keys, keys, "right")
    left, step = np.arange(len(keys)), 0
    while True:
        step += 1
        left = left[left + step < end[left]]
        if not len(left):
            return
        for s in range(0, len(left), 1 << 14):
            i = left[s : s + (1 << 14)]
            i = i[label[i] != label[i + step]]
            i = i[(wide[i] == wide[i + step]).sum(1) >= least]
            if len(i):
                yield np.stack([i, i + step])


def _cell_links(cells: DataFrame, known: DataFrame, rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between fingerprints of different labels that share a cell and have similar sets, as far as they connect.

    First signatures go to the cells, which name the members that may be similar to one of another label; only their texts follow.
    """
    least = least_equal(percent)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, cell in zip(batch.column("bin").to_pylist(), batch.column("cell"), strict=True):
                fp = np.unique(unpack_raw(cell["fps"].as_py()).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k), pa.int64()), pa.array(fp)], names=["bin", "fp"])

    def opened(own: pa.Table, told: pa.Table, column: str) -> tuple:
        cell = own["cell"][0]
        keys, fp, label = (unpack_raw(cell[x].as_py()) for x in ("keys", "fps", "labels"))
        known = told["fp"].to_numpy().view(U64)
        order = np.argsort(known)
        at = np.minimum(np.searchsorted(known[order], fp), max(0, len(known) - 1))
        return keys, fp, label, order[at] if len(known) else at, known

    def name(own: pa.Table, told: pa.Table) -> pa.Table:
        found = np.empty(0, U64)
        if own.num_rows:
            keys, fp, label, at, _ = opened(own, told, "bits")
            wide = _wide(told["bits"].to_pylist())[at]
            found = np.unique(np.concatenate([found, *(fp[x.ravel()] for x in _cross(keys, label, wide, least))]))
        return pa.table({"bin": pa.array(np.full(len(found), own["bin"][0].as_py() if own.num_rows else 0), pa.int64()), "fp": found.view(np.int64)})

    def connect(own: pa.Table, told: pa.Table) -> pa.Table:
        links = []
        if own.num_rows and told.num_rows:
            keys, fp, label, at, known = opened(own, told, "text")
            here = known[at] == fp
            keys, fp, label, at = keys[here], fp[here], label[here], at[here]
            made, sets = Shingler(shingle), {}
            parent = {x: x for x in label.tolist()}

            def top(x: int) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            wide = _wide(told["bits"].to_pylist())[at]
            for pairs in _cross(keys, label, wide, least):
                for i, j in pairs.T.tolist():
                    a, b = top(int(label[i])), top(int(label[j]))
                    if a == b:
                        continue
                    for k in (i, j):
                        if at[k] not in sets:
                            sets[at[k]] = made(told["text"][int(at[k])].as_py())
                    if similar(sets[at[i]], sets[at[j]], percent):
                        parent[max(a, b)] = min(a, b)
                        links.append((fp[i], fp[j]))
        found = np.array(links, U64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    signed = cells.mapInArrow(listed, "bin long, fp long").join(known.select("fp", "bits"), "fp")
    named = materialize(cells.groupBy("bin").cogroup(signed.groupBy("bin")).applyInArrow(name, "bin long, fp long"))
    wanted = materialize(named.select("fp").distinct().join(known.select("fp", "row", "bits"), "fp"))
    texts = texts_of(rows, wanted.select("fp", "row")).join(wanted.select("fp", "bits"), "fp")
    return cells.groupBy("bin").cogroup(named.join(texts, "fp").groupBy("bin")).applyInArrow(connect, "a long, b long").distinct()


RESULTS = ("n_shingles", "component_id", "kept")


def minhash_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Every row without its text, with n_shingles (distinct word shingles), component_id (the smallest key that can be reached over
    links, the row itself included) and kept (the key is component_id).

    Two texts are linked if their sets of shingles have a Jaccard similarity of ``percent`` hundredths or more; links are confirmed
    on the full sets. A text of fewer words than a shingle has the sequence of its words as the only one.

    Signatures have SIZE components in BANDS bands of ROWS: of pairs at a similarity of 0.8, 8 in 10**7 share no band, of those
    at 0.85, 2 in 10**10; of unrelated texts, at 0.1, 6 in 10**6 share one. Equal sets are one from the start. The fingerprints of a band are first linked to the
    smallest, and what is confirmed is grouped: that joins most of a large group by few links. Then, where groups share a
    band and are still apart, all their members in it are compared (cells_apart), so that no link is lost to that shortcut.

    Texts without words, null and empty ones too, have no shingle and are linked with nothing. Rows with a null key get the smallest
    key of their component, null if there is none. Repeated rows share a component; an empty table gives an empty result.
    Columns named like a result are replaced, all others carried along, whatever their names.
    """
    rows, inner, outer = fenced(docs, {text: "text", key: "id"}, (text, *RESULTS))
    rows = rows.withColumn("row", F.xxhash64("text", *hashable(rows, inner), "id"))
    carried = [*inner, "id", "row"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Shingler(shingle)
        for batch in batches:
            sets, sizes = [], []
            signed, fps = [], []
            for run in text_runs(batch.column(0)):
                sets = [made(x) for x in run]
                sizes += [len(s) for s in sets]
                signed += [x.tobytes() for x in signatures(sets)]
                fps += [xxh64_intdigest(s.tobytes(), 3) for s in sets]
            fp = pa.array(np.array(fps, U64).view(np.int64), pa.int64(), mask=np.array(sizes) == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes, pa.int64()), fp, pa.array(signed, pa.binary())], names=[*carried, "n_shingles", "fp", "bits"])

    schema = ", ".join([*fields_of(rows, carried), "n_shingles long, fp long, bits binary"])
    sized = rows.select(F.col("text").cast("binary").alias("text"), *carried)
    seen = materialize(sized.mapInArrow(sign, schema))
    known = seen.filter(F.col("fp").isNotNull()).groupBy("fp").agg(F.min("id").alias("least"), F.min("row").alias("row"), F.min("bits").alias("bits"), F.max("n_shingles").alias("size"))
    known = materialize(known.withColumn("size", F.col("size") * 8))
    labelled = known.select("fp", "least", "bits", F.col("fp").alias("label"))
    met = materialize(colliding(labelled.select("fp", "bits", "label"), band_variants, BANDS, 2, loose=True))
    near = _plausible(met, known, least_equal(percent))
    ends = near.select(F.col("a").alias("fp")).union(near.select("b")).distinct()
    texts = materialize(texts_of(rows, ends.join(known.select("fp", "row"), "fp")))
    labelled = materialize(_relabelled(labelled, _confirmed(near, texts, shingle, percent)))
    cells = materialize(cells_apart(labelled.select("fp", "bits", "label"), band_variants, BANDS))
    late = _between_labels(materialize(_cell_links(cells, known, rows, shingle, percent)), labelled)
    roots = connected_components(late).withColumnRenamed("node", "label")
    rooted = labelled.join(roots, "label", "left").withColumn("root", F.coalesce("root", "label"))
    least = rooted.groupBy("root").agg(F.min("least").alias("least"))
    named = materialize(rooted.select("fp", "root").join(least, "root").select("fp", "least"))
    told = seen.drop("bits").join(named, "fp", "left").withColumn("component_id", F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("least")))
    return unfenced(told.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))), inner, outer, RESULTS)
