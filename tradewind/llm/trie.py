"""Prefix trie of rebuilt conversations, from fingerprints that are composed without making the rebuilt texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Two primes below 2**31, so that products of residues fit in a long; together they tell 2**62 values apart.
PRIMES = (2147483647, 2147483629)
#: Turns of a bucket of a long conversation, and conversations of a chunk of a list of ends.
BUCKET, CHUNK = 1024, 1 << 16
#: Children of a node that make it one of many.
MANY = 256


def _power(base: int, exponent: Column, prime: int) -> Column:
    """base ** exponent, 0 <= exponent < 2**31, by a table for each 11 bits."""
    out = None
    for k in range(3):
        step = pow(base, 1 << 11 * k, prime)
        entries = [1]
        for _ in range(2047 if k < 2 else 511):
            entries.append(entries[-1] * step % prime)
        factor = F.get(F.lit(entries), F.shiftright(exponent, 11 * k).bitwiseAND(2047).cast("int"))
        out = factor if out is None else F.pmod(out * factor, F.lit(prime))
    return out


def _bases(seed: int) -> tuple[int, ...]:
    return tuple(2 + int.from_bytes(hashlib.sha256(f"{seed}:{k}".encode()).digest()[:8], "big") % (p - 3) for k, p in enumerate(PRIMES))


def _running(rows: DataFrame, keys: list[str], order: str, bucket: Column, sums: dict[str, tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """The rows with, for each name, the sum of a column over the rows before in the order within the keys, each sum put through
    a function (a remainder, say). Sums are made inside a bucket (which follows the order), then over buckets, so that a long
    run of one key isn't one task."""
    own = rows.withColumn("bucket", bucket)
    inside = Window.partitionBy(*keys, "bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    of = own.groupBy(*keys, "bucket").agg(*[f(F.sum(c)).alias(f"all_{n}") for n, (c, f) in sums.items()])
    of = of.select(*keys, "bucket", *[F.coalesce(f(F.sum(f"all_{n}").over(ahead)), F.lit(0)).alias(f"ahead_{n}") for n, (_, f) in sums.items()])
    own = own.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, (c, _) in sums.items()}).join(of, [*keys, "bucket"])
    return own.withColumns({n: f(F.col(n) + F.col(f"ahead_{n}")) for n, (_, f) in sums.items()}).drop("bucket", *[f"ahead_{n}" for n in sums])


def _products(turns: DataFrame, bases: tuple[int, int]) -> DataFrame:
    """(conv, k, f0, f1, p0, p1, x0, x1, bytes): every turn with its number in its conversation, the hash product of the turns up to
    it and before it, 120 bits of a digest of its role and text, and the bytes of the text.

    The product of turns t1 .. tk is the sum of ti * base**i modulo a prime.
    """
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    made = turns.select("conv", "turn", "role", "text", F.xxhash64("role", "text").alias("h"), part(1).alias("x0"), part(16).alias("x1"), F.octet_length("text").cast("long").alias("bytes"))
    # Turns with one number are in order of role and text; which of two equal ones comes first makes no difference.
    bucket = F.coalesce(F.floor(F.col("turn") / BUCKET), F.lit(-(1 << 62)))
    inside = Window.partitionBy("conv", "bucket").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    made = made.withColumn("bucket", bucket).withColumns({"in": F.row_number().over(inside).cast("long"), "one": F.lit(1).cast("long")}).drop("role", "text", "turn")
    sizes = made.groupBy("conv", "bucket").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("conv").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("off"))
    made = made.join(sizes, ["conv", "bucket"]).withColumn("k", F.col("in") + F.col("off"))
    terms = {f"g{i}": F.pmod(F.pmod("h", F.lit(p)) * _power(bases[i], F.col("k"), p), F.lit(p)) for i, p in enumerate(PRIMES)}
    made = materialize(made.withColumns(terms).select("conv", "k", "g0", "g1", "x0", "x1", "bytes"))
    modulo = [lambda c, p=p: F.pmod(c, F.lit(p)) for p in PRIMES]
    made = _running(made, ["conv"], "k", F.floor(F.col("k") / BUCKET), {f"p{i}": (f"g{i}", modulo[i]) for i in range(2)})
    return made.select("conv", "k", *[modulo[i](F.col(f"p{i}") + F.col(f"g{i}")).alias(f"f{i}") for i in range(2)], "p0", "p1", "x0", "x1", "bytes")


def _prefixes(turns: DataFrame, bases: tuple[int, int], heads: int, group: int) -> DataFrame:
    """(conv, depth, f0, f1, p0, p1, x0, x1, bytes, last): every prefix of every rebuilt conversation with its product, that of
    the prefix before it, the digest of its last turn and whether the conversation ends there.

    The product of a base's head and an own suffix is head + suffix * base**(length of the head - turns left out), and that of
    the suffix is the difference of two products of its own conversation: stored products are combined, no turn is told again.
    """
    made = materialize(_products(turns, bases))
    stored = F.struct("k", "f0", "f1", "p0", "p1", "x0", "x1", "bytes")
    first = made.filter(F.col("k") <= heads).groupBy("conv").agg(F.sort_array(F.collect_list(stored)).alias("first"))
    sizes = made.groupBy("conv").agg(F.max("k").alias("n"))
    known = sizes.join(first, "conv")
    head = known.select(F.col("conv").alias("base"), F.col("first").alias("head"))
    known = known.withColumns({"base": F.col("conv") - F.col("conv") % group, "h": (F.crc32(F.col("conv").cast("string").cast("binary")) % (heads + 1)).cast("int")})
    known = known.join(head, "base", "left")
    known = known.withColumn("head", F.slice(F.coalesce("head", F.slice("first", 1, 0)), F.lit(1), F.col("h")))
    known = known.withColumn("m", F.size("head"))
    known = known.withColumn("length", F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    at = lambda array, k, i: F.coalesce(F.get(F.col(array), F.col(k) - 1)[f"f{i}"], F.lit(0))
    known = known.withColumns({f"{n}{i}": at(array, k, i) for n, array, k in (("top", "head", "m"), ("cut", "first", "h")) for i in range(2)})
    known = materialize(known.select("conv", "h", "m", "length", "head", "top0", "top1", "cut0", "cut1"))

    zero = F.lit(0).cast("long")
    rest = ("f0", "f1", "p0", "p1", "x0", "x1", "bytes")
    last = lambda d: (d == F.col("length")).alias("last")
    roots = known.select("conv", zero.alias("depth"), *[zero.alias(c) for c in rest], last(zero))
    heading = known.select("conv", "length", F.explode("head").alias("t"))
    heading = heading.select("conv", F.col("t.k").alias("depth"), *[f"t.{c}" for c in rest], last(F.col("t.k")))
    own = made.join(known.drop("head"), "conv").filter(F.col("k") > F.col("h"))
    depth = F.col("k") - F.col("h") + F.col("m")

    def composed(product: str, i: int) -> Column:
        p, inverse = PRIMES[i], pow(bases[i], -1, PRIMES[i])
        back = F.get(F.lit([pow(inverse, x, p) for x in range(heads + 1)]), F.col("h") - F.col("m"))
        return F.pmod(F.pmod(F.col(f"{product}{i}") - F.col(f"cut{i}"), F.lit(p)) * back + F.col(f"top{i}"), F.lit(p)).alias(f"{product}{i}")

    own = own.select("conv", depth.alias("depth"), *[composed(product, i) for product in "fp" for i in range(2)], "x0", "x1", "bytes", last(depth))
    return roots.unionByName(heading).unionByName(own)


def _end_digests(rows: DataFrame) -> DataFrame:
    """(depth, f0, f1, ends_sha256) of the prefixes at which conversations end.

    Conversations are listed in chunks by number, which bound what a group gathers; the chunks of a prefix are hashed one after
    the other as a sorted partition streams by.
    """
    key = ["depth", "f0", "f1"]
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = rows.filter("last").groupBy(*key, F.floor(F.col("conv") / CHUNK).alias("chunk")).agg(listed.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out = []
            for *at, ids in zip(*[batch.column(c).to_pylist() for c in (*key, "ids")], strict=True):
                if at == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = at, hashlib.sha256(ids.encode())
            yield _digests(out)
        if now is not None:
            yield _digests([(*now, digest.hexdigest())])

    streamed = chunks.repartition(*[F.col(c) for c in key]).sortWithinPartitions(*key, "chunk")
    return streamed.mapInArrow(run, "depth long, f0 long, f1 long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["depth", "f0", "f1", "ends_sha256"])


def conversation_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", heads: int = 8, group: int = 5, seed: int = 1) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    A conversation c is rebuilt as the first h turns of conversation c - c % group (all if fewer, none if absent) and its own
    turns after its first h, with h = crc32(decimal c) % (heads + 1). Every distinct sequence of the first d turns is a node, the
    root (d = 0) included; conv_id is its smallest member. saved_tokens adds up, over the node and all below, the bytes of the last
    text times the members but one.

    Members are grouped by depth and product. Equality is then verified by what each member refers to: all must have one
    product before and one digest of the stored last turn, which by induction makes the whole sequences equal. If a group
    fails, all is done again with other bases.

    Subtrees need no walk: a conversation that is the smallest member of a node is so of all its nodes below, so that each node
    is told by one conversation, and a subtree is all that its members tell, less what its own smallest member tells above it.

    Turns are in order of their number (null first), then role and text; null roles and texts are empty, repeated rows are turns
    of their own. Rows without a conversation are left out. An empty table gives an empty result. Other columns are not read.
    """
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    empty = F.lit("")
    turns = conversations.select(quoted(conv).cast("long").alias("conv"), quoted(turn).alias("turn"), F.coalesce(quoted(role), empty).alias("role"), F.coalesce(quoted(text), empty).alias("text"))
    turns = turns.filter(F.col("conv").isNotNull())
    key = ["depth", "f0", "f1"]
    checked = ("p0", "p1", "x0", "x1")
    for attempt in range(seed, seed + 8):
        rows = materialize(_prefixes(turns, _bases(attempt), heads, group))
        same = F.lit(True)
        for c in checked:
            same = same & (F.min(c) == F.max(c))
        nodes = rows.groupBy(*key).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in ("p0", "p1", "bytes")], same.alias("same"))
        nodes = materialize(nodes)
        if nodes.filter(~F.col("same")).isEmpty():
            break
    else:
        raise RuntimeError("products of different prefixes stay equal")
    above = [(F.col("depth") - 1).alias("depth"), F.col("p0").alias("f0"), F.col("p1").alias("f1")]
    children = nodes.filter("depth > 0").select(*above).groupBy(*key).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, key, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "saved": (F.col("n_convs") - 1) * F.col("bytes")})
    nodes = materialize(_running(nodes, ["conv_id"], "depth", F.floor(F.col("depth") / BUCKET), {"told": ("saved", lambda c: c)}))
    chains = nodes.groupBy("conv_id").agg(F.sum("saved").alias("all"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaf"), F.min("depth").alias("start"))
    chains = materialize(chains)
    member = rows.select("conv", *key).join(chains.select(F.col("conv_id").alias("conv"), "all", "leaf"), "conv")
    sums = member.groupBy(*key).agg(F.sum("all").alias("all"), F.sum("leaf").alias("n_leaves"))
    # A node's parent has the same smallest member, unless the chain of that member starts here.
    starts = nodes.join(chains.select("conv_id", F.col("start").alias("depth")), ["conv_id", "depth"]).filter("depth > 0")
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f0").alias("p0"), F.col("f1").alias("p1"), F.col("conv_id").alias("parent"), "n_children")
    # Parents of many children are few: joined by themselves, Spark can broadcast them or split the children by size.
    by, wide = ["depth", "p0", "p1"], materialize(up.filter(F.col("n_children") > MANY).drop("n_children"))
    narrow = up.filter((F.col("n_children") > 0) & (F.col("n_children") <= MANY)).drop("n_children")
    starts = materialize(starts.select(*key, "p0", "p1").join(wide, by, "left"))
    parents = starts.filter("parent is not null").select(*key, "parent")
    parents = parents.unionByName(starts.filter("parent is null").drop("parent").join(narrow, by).select(*key, "parent"))
    out = nodes.join(sums, key).join(parents, key, "left").join(_end_digests(rows), key, "left")
    return out.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("all") - F.col("told")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
