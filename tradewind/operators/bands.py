"""Order statistics of prices in a sliding band of mileages, exact, with rows that grow with the listings only.

Listings are counted by (keys, mileage, city, price). A cell is the listings of equal keys in a stretch of mileages, WIDE times the
tolerance; its points are the counted prices there and those up to a tolerance beside it, so that a price is sent once or twice
(1.5 times on even mileages), whatever the number of listings that see it. A task takes many cells and answers all their questions
by rank (Ranks). A cell that many rows ask is answered in shares, each with all its points.

A cell with more points than a task should hold is cut into stretches as wide as the tolerance, and what is still too large into
slabs of prices. Its questions then go over slabs: totals of each slab for each place give, by prefix sums, the slab that holds a
rank, and only that slab is asked for the price.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Points and asking rows of a bin, the most points of a cell that isn't cut (and the most rows that ask one copy of it).
TASK_POINTS, CELL_POINTS = 1 << 18, 1 << 20

#: Width of a cell, in tolerances.
WIDE = 4


class Ranks:
    """Weighted values in a fixed order; answers for stretches [l, r) of it, all at once: a wavelet matrix over their codes.

    Values may lie in segments (ascending numbers), which no stretch leaves; a code is the rank of a value in its segment, so the
    levels follow the largest segment. Level by level, from the highest bit of the codes, values with a 0 go before those with a 1,
    each in their order; counts and weights of zeros up to each place tell where a stretch continues.
    """

    def __init__(self, values: np.ndarray, weights: np.ndarray, segments: np.ndarray | None = None):
        self.given, self.weights, self.total = values, weights, np.append(0, np.cumsum(weights))
        self.segments = np.zeros(len(values), np.int64) if segments is None else segments

    @cached_property
    def levels(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Made when values are first asked for, with what else is needed to read codes."""
        n, weights = len(self.given), self.weights
        begins = np.flatnonzero(np.append(True, self.segments[1:] != self.segments[:-1])) if n else np.zeros(0, np.int64)
        lengths = np.diff(np.append(begins, n))
        self.start, self.size = np.repeat(begins, lengths), np.repeat(lengths, lengths)
        self.distinct, code = np.unique(self.given, return_inverse=True)
        keys = self.segments * (len(self.distinct) + 1) + code
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], self.given[order]
        code = np.empty(n, np.int32)
        code[order] = np.arange(n) - self.start
        once = bool((weights == 1).all())  # then a weight is a count
        levels = []
        for b in reversed(range(max(1, int(lengths.max(initial=1) - 1).bit_length()))):
            zero = (code >> b) & 1 == 0
            count = np.append(0, np.cumsum(zero))
            levels.append((b, count, count if once else np.append(0, np.cumsum(np.where(zero, weights, 0)))))
            order = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])
            code, weights = code[order], weights[order]
        return levels

    def weight(self, l: np.ndarray, r: np.ndarray) -> np.ndarray:  # noqa: E741
        return self.total[r] - self.total[l]

    def _walk(self, l: np.ndarray, r: np.ndarray, turn: Callable[[int, np.ndarray], np.ndarray]) -> None:  # noqa: E741
        """Follows stretches down the levels; turn(b, zeros) tells which go on among the ones."""
        for b, count, weight in self.levels:
            l0, r0 = count.take(l), count.take(r)
            up = turn(b, r0 - l0 if weight is count else weight.take(r) - weight.take(l))
            l, r = np.where(up, count[-1] + l - l0, l0), np.where(up, count[-1] + r - r0, r0)  # noqa: E741

    def at(self, l: np.ndarray, r: np.ndarray, k: np.ndarray) -> np.ndarray:  # noqa: E741
        """The value at rank k (from 0, by weight) of each stretch; where there is none, any value."""
        if not len(self.given):
            return np.zeros(len(l), self.given.dtype)
        code, left = np.zeros(len(l), np.int64), [k]

        def turn(b: int, zeros: np.ndarray) -> np.ndarray:
            up = left[0] >= zeros
            left[0] = left[0] - zeros * up
            code[up] += 1 << b
            return up

        self._walk(l, r, turn)
        return self.values[np.minimum(self.start[np.minimum(l, len(self.start) - 1)] + code, len(self.values) - 1)]

    def below(self, l: np.ndarray, r: np.ndarray, x: np.ndarray, to: bool = False) -> np.ndarray:  # noqa: E741
        """The weight of the values below x (up to x, if ``to``) in each stretch."""
        out = np.zeros(len(l), np.int64)
        if not len(self.given):
            return out
        self.levels  # noqa: B018
        at = np.minimum(l, len(self.start) - 1)
        code = np.searchsorted(self.keys, self.segments[at] * (len(self.distinct) + 1) + np.searchsorted(self.distinct, x, "right" if to else "left"), "left") - self.start[at]

        def turn(b: int, zeros: np.ndarray) -> np.ndarray:
            up = (code >> b) & 1 == 1
            np.add(out, zeros, out=out, where=up)
            return up

        self._walk(l, r, turn)
        return np.where(code >= self.size[at], self.weight(l, r), out)


class Band:
    """The points of some cells, and where in them each asking row's band begins and ends: in its city, and in all cities."""

    def __init__(self, asking: pa.Table, points: pa.Table, tolerance: float, cities: bool):
        both = lambda c: np.concatenate([asking[c].to_numpy(), points[c].to_numpy()])
        self.n, self.tolerance, self.names = asking.num_rows, tolerance, ("wide", "local") if cities else ("wide",)
        self.cell = _numbered(both("cell"), both("cell2"))
        self.mine, self.theirs = asking["m"].to_numpy(), points["m"].to_numpy()
        self.steps = np.unique(self.theirs)
        self.step = np.searchsorted(self.steps, self.theirs)
        self.low, self.high = np.searchsorted(self.steps, self.mine - tolerance, "left"), np.searchsorted(self.steps, self.mine + tolerance, "right")
        self.price, self.cnt = points["price"].to_numpy(), points["cnt"].to_numpy()
        self.city = pa.chunked_array([*asking["city"].chunks, *points["city"].chunks], pa.string()).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1 if cities else None
        self.made = {}

    def kind(self, name: str) -> tuple[Ranks, np.ndarray, np.ndarray]:
        """The ranks of a scope, and the stretch of each asking row; made when first asked for."""
        if name not in self.made:
            segment = self.cell if name == "wide" else self.cell * (int(self.city.max(initial=0)) + 1) + self.city
            places = len(self.steps) + 1
            at = self.step + segment[self.n :] * places
            order = np.argsort(at, kind="stable")
            at, start = at[order], segment[: self.n] * places
            low, high = np.searchsorted(at, start + self.low, "left"), np.searchsorted(at, start + self.high, "left")
            if name == "local":  # an asking row without a city has none of its own
                high = np.where(self.city[: self.n] > 0, high, low)
            self.made[name] = (Ranks(self.price[order], self.cnt[order], segment[self.n :][order]), low, high)
        return self.made[name]


def _numbered(cell: np.ndarray, cell2: np.ndarray) -> np.ndarray:
    """Cells by number: by the first hash, unless two cells share it."""
    _, first, number = np.unique(cell, return_index=True, return_inverse=True)
    if (cell2[first][number] == cell2).all():
        return number
    return np.unique(np.stack([cell, cell2], 1), axis=0, return_inverse=True)[1].ravel()


def middle(ranks: Ranks, low: np.ndarray, high: np.ndarray, n: np.ndarray, q: float, shift: Callable[[np.ndarray], np.ndarray] = lambda k: k) -> np.ndarray:
    """Linearly interpolated q-quantiles of n values of each stretch; ``shift`` maps a rank among them to one of the stretch."""
    at = (n - 1) * q
    k = np.floor(at).astype(np.int64)
    part = at - k
    a = ranks.at(low, high, shift(k)).astype(float)
    b = ranks.at(low, high, np.where(part > 0, shift(k + 1), shift(k))).astype(float)
    return np.where(part == 0, a, a * (1 - part) + b * part)


def cell_columns(keys: Sequence[str], bucket: Column) -> list[Column]:
    """96 bits for the keys and a stretch of mileages, and the mileage as a number (one for all without a mileage)."""
    own = [*(F.col(k) for k in keys), *(F.col(k).isNull() for k in keys)]  # as hashes pass over nulls
    return [F.xxhash64(*own, bucket).alias("cell"), F.hash(bucket, *own).cast("long").alias("cell2"), F.coalesce(F.col("mileage"), F.lit(0)).cast("double").alias("m")]


CELL, ASKING, POINTS = ["cell", "cell2"], ["cell", "cell2", "m", "city"], ["cell", "cell2", "m", "city", "price", "cnt"]


def banded(rows: DataFrame, keys: Sequence[str], tolerance: int, *kept: str) -> DataFrame:
    """``kept`` of the rows, and the cell that they ask; rows without a mileage are a stretch of their own."""
    return rows.select(*kept, *cell_columns(keys, _stretch(F.col("mileage"), tolerance)))


def pointed(counted: DataFrame, keys: Sequence[str], tolerance: int) -> DataFrame:
    """The points of all cells: each counted price goes to every cell that has mileages within the tolerance."""
    ends = [_stretch(F.col("mileage") + d, tolerance) for d in (-tolerance, tolerance)]
    near = counted.select(*keys, "mileage", "city", "price", "cnt", F.explode(F.sequence(*ends)).alias("near"))
    return near.select(*cell_columns(keys, F.col("near")), F.col("city").cast("string").alias("city"), "price", "cnt")


def _stretch(mileage: Column, tolerance: int) -> Column:
    return F.coalesce(F.floor(mileage / (WIDE * tolerance)), F.lit(-(1 << 40))).cast("long")


def _narrowed(asking: DataFrame, points: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """The rows and points of wide cells in cells as wide as the tolerance; points go to their own and the two beside it."""
    bucket = F.floor(F.col("m") / tolerance)
    cut = lambda df, at: df.withColumns({"cell": F.xxhash64("cell", at), "cell2": F.hash(at, "cell2").cast("long")}).drop("near")
    asking = written(cut(asking, bucket))
    near = points.withColumn("near", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    return asking, written(cut(near, F.col("near")).join(asking.select(*CELL).distinct(), CELL, "left_semi"))


def answered(asking: DataFrame, points: DataFrame, listed: DataFrame, told: Callable[[pa.Table, Band], dict[str, np.ndarray]], added: str, tolerance: float, cities: bool, split: Callable[[DataFrame, DataFrame], DataFrame], cell_points: int = CELL_POINTS, narrow: bool = False) -> DataFrame:
    """The asking rows with what ``told`` gives for them (columns ``added``); rows that it leaves out (column ``keep``) are gone.

    ``listed`` (cell, cell2, listed) may tell a cell's asking rows in several parts. Cells are dealt to bins by hash, so many that a
    bin holds about TASK_POINTS points and rows; a cell that more than ``cell_points`` rows ask is dealt in shares of them. Cells of
    more than ``cell_points`` points are narrowed; of those, what still has more goes to ``split``, which must give the same rows.
    """
    spark = asking.sparkSession
    mine = [c for c in asking.columns if c not in ("cell", "cell2", "m")]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in asking.select(*mine).schema), added])
    names = [x.split()[0] for x in added.split(", ")]
    told_of = points.groupBy(*CELL).agg(F.count("*").alias("size"), F.lit(0).cast("long").alias("listed"))
    told_of = told_of.unionByName(listed.groupBy(*CELL).agg(F.lit(0).cast("long").alias("size"), F.sum("listed").alias("listed")))
    sizes = written(told_of.groupBy(*CELL).agg(F.sum("size").alias("size"), F.sum("listed").alias("listed")))
    shares = F.ceil(F.col("listed") / cell_points)
    total, largest, most = sizes.agg(F.sum(F.col("size") * F.greatest(shares, F.lit(1)) + F.col("listed")), F.max("size"), F.max("listed")).first()
    bins = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // TASK_POINTS))

    def run(own: pa.Table, there: pa.Table) -> pa.Table:
        out = told(own, Band(own, there, tolerance, cities))
        keep = out["keep"]
        kept = own.select(mine).filter(pa.array(keep))
        return pa.table([*kept.columns, *(pa.array(out[c][keep]) for c in names)], names=[*mine, *names])

    small = asking, points
    if (largest or 0) > cell_points:
        large = written(sizes.filter(F.col("size") > cell_points).select(*CELL))
        small = tuple(df.join(large, CELL, "left_anti") for df in small)
    if (most or 0) > cell_points:
        sharing = written(sizes.filter(F.col("listed") > cell_points).select(*CELL, shares.alias("shares")))
        own, there = (df.join(sharing, CELL, "left") for df in small)
        own = own.withColumn("share", F.pmod(F.xxhash64(*mine), F.coalesce("shares", F.lit(1))))
        there = there.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("shares", F.lit(1)) - 1)))
        small = tuple(df.withColumn("cell", F.when(F.col("share") > 0, F.xxhash64("cell", "share")).otherwise(F.col("cell"))).drop("share", "shares") for df in (own, there))
    own, there = (df.withColumn(name, F.pmod(F.col("cell"), F.lit(bins))) for df, name in zip(small, ("bin", "points_bin")))
    out = own.groupBy("bin").cogroup(there.groupBy("points_bin")).applyInArrow(run, fields)
    if (largest or 0) <= cell_points:
        return out
    own, there = (df.join(large, CELL, "left_semi") for df in (asking, points))
    if narrow:
        return out.unionByName(split(written(own), written(there)))
    own, there = _narrowed(own, there, tolerance)
    return out.unionByName(answered(own, there, own.select(*CELL, F.lit(1).alias("listed")), told, added, tolerance, cities, split, cell_points, True))


_KINDS = {"long": pa.int64(), "double": pa.float64()}
PLACE = ["cell", "cell2", "m", "city"]


class Slabs:
    """Questions to cells of more points than a task should hold: slabs of prices of a cell, and their totals at each place.

    Slab k of a cell holds the prices above k of its cuts, which are percentiles; a task holds one slab.
    """

    def __init__(self, asking: DataFrame, points: DataFrame, tolerance: float, cities: bool, slab_points: int):
        self.tolerance, self.cities = tolerance, cities
        sizes = points.groupBy("cell", "cell2").agg(F.count("*").alias("size"))
        n = max(2, -(-2 * sizes.agg(F.max("size")).first()[0] // slab_points))
        cuts = points.groupBy("cell", "cell2").agg(F.sort_array(F.array_distinct(F.percentile_approx("price", [k / n for k in range(1, n)], 100 * n))).alias("cuts"))
        self.cuts = written(cuts)
        self.points = written(self._placed(points.join(self.cuts, ["cell", "cell2"]), "price").drop("cuts"))
        places = asking.select(*PLACE).distinct().join(self.cuts, ["cell", "cell2"])
        every = places.select(*PLACE, F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("slab"))
        totals = self._ask(every, {k: "long" for k in self.scopes()}, lambda own, band: {k: band.kind(k)[0].weight(*band.kind(k)[1:]) for k in band.names})
        ahead = Window.partitionBy(*PLACE).orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
        self.totals = written(totals.withColumns({f"{k}_before": F.coalesce(F.sum(k).over(ahead), F.lit(0)) for k in self.scopes()}))

    def scopes(self) -> list[str]:
        return ["wide", "local"] if self.cities else ["wide"]

    def _placed(self, rows: DataFrame, value: str) -> DataFrame:
        return rows.withColumn("slab", F.size(F.filter("cuts", lambda c: c < F.col(value))))

    def _ask(self, rows: DataFrame, added: dict[str, str], told: Callable[[pa.Table, Band], dict[str, np.ndarray]]) -> DataFrame:
        """The rows (of a place and slab) and what ``told`` gives for them from the points of their slab; of an empty slab, zeros."""
        mine = rows.columns
        fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"{c} {k}" for c, k in added.items())])
        tolerance, cities = self.tolerance, self.cities

        def run(own: pa.Table, there: pa.Table) -> pa.Table:
            out = told(own, Band(own, there, tolerance, cities)) if own.num_rows and there.num_rows else {}
            new = [pa.array(out.get(c, np.zeros(own.num_rows)), _KINDS[k], safe=False) for c, k in added.items()]
            return pa.table([*(own[c] for c in mine), *new], names=[*mine, *added])

        there = self.points.withColumnsRenamed({c: f"of_{c}" for c in ("cell", "cell2", "slab")})
        both = rows.groupBy("cell", "cell2", "slab").cogroup(there.groupBy("of_cell", "of_cell2", "of_slab"))
        return both.applyInArrow(lambda own, points: run(own, points.rename_columns([c.removeprefix("of_") for c in points.column_names])), fields)

    def with_totals(self, rows: DataFrame) -> DataFrame:
        """The rows (of a place) and {scope}_total, the weight of all their band."""
        sums = self.totals.groupBy(*PLACE).agg(*[F.sum(k).alias(f"{k}_total") for k in self.scopes()])
        return at_place(rows, sums)

    def with_values(self, rows: DataFrame, ranks: dict[str, Column]) -> DataFrame:
        """The rows (id, a place, scope) and, for each name, the price at a rank of the band of their scope."""
        wanted = rows.select("id", *PLACE, "scope", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), k.cast("long").alias("k")) for n, k in ranks.items()])).alias("w")).select("id", *PLACE, "scope", "w.*")
        of = lambda c: F.when(F.col("scope") == "local", F.col(f"local{c}")).otherwise(F.col(f"wide{c}")) if self.cities else F.col(f"wide{c}")
        met = at_place(wanted, self.totals).withColumns({"before": of("_before"), "in_slab": of("")})
        met = met.filter((F.col("before") <= F.col("k")) & (F.col("k") < F.col("before") + F.col("in_slab")))
        met = met.select("id", *PLACE, "scope", "name", "slab", (F.col("k") - F.col("before")).alias("k"))

        def told(own: pa.Table, band: Band) -> dict[str, np.ndarray]:
            k = own["k"].to_numpy()
            return {"value": _by_scope(own, band, lambda ranks, low, high, i: ranks.at(low, high, k[i]).astype(float))}

        found = self._ask(met, {"value": "double"}, told)
        told_rows = found.groupBy("id").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in ranks])
        return written(rows.join(told_rows, "id", "left"))

    def with_below(self, rows: DataFrame, bounds: dict[str, tuple[Column, bool]]) -> DataFrame:
        """The rows (id, a place, scope) and, for each name, the weight of the prices below a bound (up to it, if so asked)."""
        wanted = rows.select("id", *PLACE, "scope", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), x.cast("double").alias("x"), F.lit(to).alias("to")) for n, (x, to) in bounds.items()])).alias("w")).select("id", *PLACE, "scope", "w.*")
        wanted = self._placed(wanted.join(self.cuts, ["cell", "cell2"]), "x").drop("cuts").filter("x is not null")

        def told(own: pa.Table, band: Band) -> dict[str, np.ndarray]:
            x, to = own["x"].to_numpy(), own["to"].to_numpy(zero_copy_only=False)
            both = [_by_scope(own, band, lambda ranks, low, high, i, to=t: ranks.below(low, high, x[i], to)) for t in (False, True)]
            return {"inside": np.where(to, both[1], both[0])}

        found = self._ask(wanted, {"inside": "long"}, told)
        ahead = self.totals.select(*PLACE, "slab", *[f"{k}_before" for k in self.scopes()])
        met = at_place(found, ahead, ["slab"])
        before = F.when(F.col("scope") == "local", F.col("local_before")).otherwise(F.col("wide_before")) if self.cities else F.col("wide_before")
        told_rows = met.groupBy("id").agg(*[F.max(F.when(F.col("name") == n, before + F.col("inside"))).alias(n) for n in bounds])
        return written(rows.join(told_rows, "id", "left"))


def at_place(rows: DataFrame, places: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """The rows joined with what is told of their place; cities may be null."""
    there = places.withColumnsRenamed({c: f"at_{c}" for c in (*PLACE, *more)})
    on = [F.col(c).eqNullSafe(F.col(f"at_{c}")) for c in (*PLACE, *more)]
    return rows.join(there, on).drop(*[f"at_{c}" for c in (*PLACE, *more)])


def _by_scope(own: pa.Table, band: Band, told: Callable) -> np.ndarray:
    """told(ranks, low, high, rows) for the rows of each scope, in one array."""
    local = np.array(own["scope"].to_pylist()) == "local"
    out = np.zeros(own.num_rows)
    for name, mine in (("wide", ~local), ("local", local)):
        if mine.any():
            ranks, low, high = band.kind(name)
            i = np.flatnonzero(mine)
            out[i] = told(ranks, low[i], high[i], i)
    return out
