"""Mixing sources to target weights by Pfair scheduling of blocks."""

from __future__ import annotations

import heapq
import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fenced, hashable, materialize, shuffle_partitions, unfenced


def shares(weights: dict, period: int) -> dict:
    """Blocks of each source in a period: in proportion to the weights by largest remainders, one at least; they sum to period."""
    total = sum(weights.values())
    exact = {s: w * period / total for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (out[s] - exact[s], str(s)))
    for k in range(period - sum(out.values())):
        out[order[k % len(order)]] += 1
    while sum(out.values()) > period:
        out[max((s for s in out if out[s] > 1), key=lambda s: (out[s] - exact[s], str(s)))] -= 1
    return out


def schedule(blocks: dict, period: int) -> dict[tuple, tuple[int, int, int]]:
    """(source, j) -> (slot, release, deadline) of the j-th block of each source in one period.

    Block j of a source with a blocks in the period is released at floor(j * period / a) and due at ceil((j + 1) * period / a).
    Each slot takes the released block with the earliest deadline. As the shares add up to one, none is late, so that each
    source is always less than one block ahead of or behind its share.
    """
    waiting = [(0, s) for s in sorted(blocks, key=str)]
    waiting = [(0, i, s, 0) for i, (_, s) in enumerate(waiting)]
    ready: list[tuple] = []
    out = {}
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            r, i, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // blocks[s]), i, s, j, r))
        deadline, i, s, j, r = heapq.heappop(ready)
        out[s, j] = (slot, r, deadline)
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, ((j + 1) * period // blocks[s], i, s, j + 1))
    return out


def mix_sources(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    weights: dict | None = None,
    temper: float = 0.5,
    block_chars: int = 1 << 18,
    period: int = 1000,
    group_rows: int = 10_000,
    most_sources: int = 100_000,
) -> DataFrame:
    """Every row with block, slot, release, deadline (of its block) and place (its offset within the block, in characters).

    Each source is put in a random but fixed order (by hash) and cut into blocks of block_chars characters; a text belongs to
    the block that it starts in. Ordering by (slot, place) gives the mixed stream, in which every source is always less than one
    block off its target weight until a source runs out; its later slots stay empty, and the others keep their proportions.
    ``weights`` maps sources to target weights, 0 < w; sources without one weigh as the least of them. Without weights, they
    follow (characters of the source) ** temper. No row is dropped or doubled.

    The schedule repeats every max(period, 4 * sources) slots, so that one period of it is all that the driver makes. That grows
    with the number of sources, so a table with more than most_sources is refused; Spark broadcasts the schedule or not by its
    size.

    Null and empty texts count as one character; a null source is a source of its own. Repeated rows each have a place. An
    empty table gives an empty result. Columns named like a result are replaced, all others carried along, whatever their names.
    """
    spark = docs.sparkSession
    added = ("block", "slot", "release", "deadline", "place")
    rows, inner, outer = fenced(docs, {text: "text", source: "source"}, added)
    groups = max(shuffle_partitions(spark), -(-rows.count() // group_rows))
    size = F.greatest(F.lit(1), F.coalesce(F.length("text"), F.lit(0))).cast("long")
    kinds = dict(zip(outer, inner, strict=True))
    seed = hashable(rows, [i for c, i in kinds.items() if c != source])
    order = hashable(rows, [i for c, i in kinds.items() if c not in (source, text)])
    known = rows.withColumn("h", F.xxhash64(*seed) if seed else F.lit(0).cast("long"))
    known = known.withColumns({"size": size, "g": F.pmod("h", F.lit(groups)).cast("int")})
    # Prefix sums in two steps: over the groups of a source, then within each group, so that no source is in one task.
    sums = materialize(known.groupBy("source", "g").agg(F.sum("size").alias("sum")))
    each = sums.groupBy("source").agg(F.sum("sum").alias("n")).limit(most_sources + 1).collect()
    if len(each) > most_sources:
        raise ValueError(f"more than {most_sources} sources: group the small ones")
    totals = {r["source"]: r["n"] for r in each}
    if not totals:
        return unfenced(rows, inner, outer, [F.lit(0).cast("long").alias(c) for c in added])
    given = {s: (weights[s] if s in weights else min(weights.values())) for s in totals} if weights else {s: n**temper for s, n in totals.items()}
    period = max(period, 4 * len(totals))
    blocks = shares(given, period)
    plan = [(s, blocks[s], j, *x) for (s, j), x in schedule(blocks, period).items()]
    kind = dict(rows.dtypes)["source"]
    table = spark.createDataFrame(plan, f"p_source {kind}, p_n long, p_j long, p_slot long, p_release long, p_deadline long")
    counts = spark.createDataFrame(list(blocks.items()), f"c_source {kind}, n long")
    before = sums.withColumn("before", F.sum("sum").over(Window.partitionBy("source").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("source").alias("b_source"), F.col("g").alias("b_g"), F.coalesce("before", F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "g").orderBy("h", *order).rowsBetween(Window.unboundedPreceding, -1)
    placed = known.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).drop("text")
    placed = placed.join(before, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("g") == F.col("b_g")))
    placed = placed.withColumn("at", F.col("before") + F.col("ahead"))
    placed = placed.withColumns({"block": F.expr(f"at div {block_chars}"), "place": F.expr(f"at % {block_chars}")})
    placed = placed.join(counts, F.col("source").eqNullSafe(F.col("c_source")))
    placed = placed.withColumns({"j": F.expr("block % n"), "round": F.expr(f"(block div n) * {period}")})
    placed = placed.join(table, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("j") == F.col("p_j")))
    shifted = [(F.col(f"p_{c}") + F.col("round")).alias(c) for c in ("slot", "release", "deadline")]
    return unfenced(placed, inner, outer, ["block", *shifted, "place"])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows with their own columns, in the mixed order: partitions and the rows within them follow (slot, place)."""
    n = shuffle_partitions(docs.sparkSession)
    rows, inner, outer = fenced(docs, {}, ())
    at = {options.get(c, c): inner[outer.index(options.get(c, c))] for c in ("text", "source")}
    placed = mix_sources(rows, **{**options, "text": at[options.get("text", "text")], "source": at[options.get("source", "source")]})
    return unfenced(placed.repartitionByRange(n, "slot", "place").sortWithinPartitions("slot", "place"), inner, outer, [])


def in_stream_order(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """``rows`` (with slot and place) in the order of the mixed stream, as mixed() orders them.

    The bounds of the partitions are taken from slot and place of ``placed``, which has the same ones, so that ``rows``, costly
    to make, are not made a second time for a sample.
    """
    n = shuffle_partitions(rows.sparkSession)
    bounds = placed.select("slot").approxQuantile("slot", [k / n for k in range(1, n)], 0.25 / n) if n > 1 else []
    return rows.repartitionById(n, bounds_passed(F.col("slot"), sorted({int(b) for b in bounds}))).sortWithinPartitions("slot", "place")


def bounds_passed(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most ``value``: first among the first bound of each stretch of them, then within one
    stretch, so that neither the depth of the expression nor the work of a row grows with their number (but its root)."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    stretches = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    passed = lambda array: F.size(F.filter(array, lambda b: b <= value))
    # Both tables are literals of one string each, as array() of thousands of literals is slow to plan.
    table = F.from_json(F.lit(json.dumps(stretches)), "array<array<bigint>>")
    stretch = passed(F.transform(table, lambda s: F.get(s, F.lit(0))))
    return F.when(stretch == 0, 0).otherwise((stretch - 1) * step + passed(F.get(table, stretch - 1))).cast("int")
