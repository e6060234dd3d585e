"""Market prices: group mean, prior history, peer median, local median, and the deals below them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .bands import CELL_POINTS, PLACE, Band, Slabs, answered, at_place, banded, middle, pointed
from .history import anti, keep_first, retained, semi
from .validation import eligible


def percent_below(price: Column, market: Column) -> Column:
    return (market - price) / market * 100


def group_mean_deals(listings: DataFrame, keys: Sequence[str], low: float, high: float) -> DataFrame:
    """Each listing against the mean of its group (itself included): avg_price, group_size, diff_percent; those in the band.

    The mean is aggregated before the join, so a hot group is summed in its tasks and only one row of it is shuffled.
    """
    means = listings.groupBy(*keys).agg(F.avg("price").alias("_avg"), F.count("*").alias("group_size"))
    diff = percent_below(F.col("price"), F.col("_avg"))
    out = listings.join(means, list(keys)).withColumn("diff_percent", diff).filter(F.col("diff_percent").between(low, high))
    return out.withColumn("avg_price", F.bround("_avg").cast("bigint")).drop("_avg")


def cheapest_in_group(listings: DataFrame, keys: Sequence[str], low: float, high: float) -> DataFrame:
    """The cheapest listing of each group (ties by id), if the group's mean puts it in the band."""
    best = F.min(F.struct("price", "ad_id"))
    groups = listings.groupBy(*keys).agg(F.avg("price").alias("market_avg"), F.count("*").alias("group_size"), best.alias("b"))
    out = groups.select(*keys, "market_avg", "group_size", "b.price", "b.ad_id")
    return out.withColumn("diff_percent", percent_below(F.col("price"), F.col("market_avg"))).filter(F.col("diff_percent").between(low, high))


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def group_quartiles(listings: DataFrame, keys: Sequence[str], split_prices: int = 1 << 20) -> DataFrame:
    """Linearly interpolated quartiles of the positive prices of each group, and their number n.

    Equal prices are counted first, in the tasks that read them. A group of up to ``split_prices`` distinct prices is aggregated
    from these counts. One of more is cut into RANGES ranges of prices (at percentiles): prefix sums of their counts tell the
    range that holds a rank, and only inside that range prices are put in order.
    """
    counted = written(listings.filter("price > 0").groupBy(*keys, "price").agg(F.count("*").alias("_c")))
    large = written(counted.groupBy(F.struct(*keys).alias("_g")).agg(F.count("*").alias("_d")).filter(F.col("_d") > split_prices).select("_g"))
    p = lambda q: F.percentile("price", F.lit(q), F.col("_c"))
    told = lambda df: df.groupBy(*keys).agg(*[p(q).alias(n) for n, q in QUARTILES.items()], F.sum("_c").alias("n"))
    if large.isEmpty():
        return told(counted)
    own = counted.withColumn("_g", F.struct(*keys))
    few = told(own.join(large, "_g", "left_anti").drop("_g"))
    hot = own.join(large, "_g", "left_semi")
    cuts = written(hot.groupBy("_g").agg(F.percentile_approx("price", [k / RANGES for k in range(1, RANGES)], 100 * RANGES).alias("_cuts")))
    hot = written(hot.join(cuts, "_g").select("_g", "price", "_c", F.size(F.filter("_cuts", lambda c: c < F.col("price"))).alias("_range")))
    sums = hot.groupBy("_g", "_range").agg(F.sum("_c").alias("_s"))
    ahead = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"_ahead": F.coalesce(F.sum("_s").over(ahead), F.lit(0)), "n": F.sum("_s").over(Window.partitionBy("_g"))})
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), f((F.col("n") - 1) * F.lit(q)).cast("long").alias("k")) for name, q in QUARTILES.items() for f in (F.floor, F.ceil)])
    wanted = sums.withColumn("_w", F.explode(ranks)).filter((F.col("_ahead") <= F.col("_w.k")) & (F.col("_w.k") < F.col("_ahead") + F.col("_s")))
    wanted = wanted.groupBy("_g", "_range", "_ahead", "n").agg(F.collect_set("_w").alias("_w"))  # six at most
    inside = Window.partitionBy("_g", "_range").orderBy("price").rowsBetween(Window.unboundedPreceding, 0)
    near = hot.join(wanted, ["_g", "_range"]).withColumn("_upto", F.col("_ahead") + F.sum("_c").over(inside))
    found = near.withColumn("_w", F.explode("_w")).filter((F.col("_upto") - F.col("_c") <= F.col("_w.k")) & (F.col("_w.k") < F.col("_upto")))
    ends = {f"{name}_{e}": f(F.when(F.col("_w.name") == name, F.col("price"))) for name in QUARTILES for e, f in (("a", F.min), ("b", F.max))}
    found = found.groupBy("_g", "n").agg(*[c.alias(n) for n, c in ends.items()])
    part = lambda q: (F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q))
    quartiles = [_between_ranks(F.col(f"{name}_a"), F.col(f"{name}_b"), part(q)).alias(name) for name, q in QUARTILES.items()]
    return few.unionByName(found.select("_g.*", *quartiles, "n"))


def iqr_filter(listings: DataFrame, keys: Sequence[str], least: int = 5, survivors: int = 3) -> DataFrame:
    """Listings within 1.5 interquartile ranges of their group's quartiles. A group with fewer than ``least`` listings, without
    spread or with fewer than ``survivors`` left stays whole."""
    fences = group_quartiles(listings, keys).withColumn("iqr", F.col("q3") - F.col("q1"))
    marked = listings.filter("price > 0").join(fences, list(keys))
    inside = F.col("price").between(F.col("q1") - 1.5 * F.col("iqr"), F.col("q3") + 1.5 * F.col("iqr"))
    marked = marked.withColumn("inside", inside)
    left = marked.groupBy(*keys).agg(F.count_if("inside").alias("left"))
    whole = (F.col("n") < least) | (F.col("iqr") <= 0) | (F.col("left") < survivors)
    return marked.join(left, list(keys)).filter(F.col("inside") | whole).select(*listings.columns)


def group_readiness(listings: DataFrame, keys: Sequence[str], min_samples: int = 4) -> DataFrame:
    sizes = listings.groupBy(*keys).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("groups"), F.count_if(F.col("n") >= min_samples).alias("ready_groups"))


def peer_pairs(listings: DataFrame, keys: Sequence[str], tolerance: int) -> DataFrame:
    """(ad_id, price, city, peer_price, same_city) of every listing and each other listing of equal keys whose mileage is at most
    ``tolerance`` away; null keys meet null keys, and a listing without a mileage meets those without.

    The join is an equi join on the keys and a mileage bucket; the peers are put into their bucket and the two beside it, so
    that a large group is spread over its mileages.
    """
    pairs = _banded(listings, listings, keys, tolerance).filter("ad_id <> peer")
    return pairs.select("ad_id", "price", "city", "peer_price", F.coalesce(F.col("city") == F.col("peer_city"), F.lit(False)).alias("same_city"))


def peer_totals(listings: DataFrame, keys: Sequence[str], tolerance: int) -> DataFrame:
    """ad_id, peers, city_peers, peer_sum: the pairs of peer_pairs counted, and their prices summed, for each id that has any.

    No pair is made. Listings of equal keys, mileage and city (a spot) are counted, and sums from either end of the mileages tell a
    band: those up to its end and those from its beginning hold it twice and all the rest once. Listings of an id itself are
    taken off again.
    """
    own = listings.filter("ad_id is not null").select("ad_id", "price", "city", "mileage", *keys)
    spot = [*keys, "mileage", "city"]
    spots = own.groupBy(*spot).agg(F.count("*").alias("n"), F.count("price").alias("priced"), F.sum("price").alias("s"))

    def banded(value: str, *among: str) -> Column:
        every = Window.partitionBy(*keys, *among, F.col("mileage").isNull())
        up = every.orderBy("mileage").rangeBetween(Window.unboundedPreceding, tolerance)
        down = every.orderBy(F.desc("mileage")).rangeBetween(Window.unboundedPreceding, tolerance)
        total = lambda w: F.coalesce(F.sum(value).over(w), F.lit(0))
        return total(up) + total(down) - total(every)

    local = F.when(F.col("city").isNotNull(), banded("n", "city")).otherwise(0)
    told = spots.select(*[F.col(c).alias(f"at_{c}") for c in spot], banded("n").alias("n"), banded("priced").alias("priced"), banded("s").alias("s"), local.alias("local"))
    rows = own.join(told, [F.col(c).eqNullSafe(F.col(f"at_{c}")) for c in spot])
    one = F.struct("price", "city", "mileage", F.struct(*keys).alias("keys"), "n", "priced", "s", "local")
    near = lambda x, y: x["keys"].eqNullSafe(y["keys"]) & ((F.abs(x["mileage"] - y["mileage"]) <= tolerance) | (x["mileage"].isNull() & y["mileage"].isNull()))

    def others(x: Column, same: Column) -> Column:
        price = F.aggregate(same, F.lit(0).cast("long"), lambda t, y: t + F.coalesce(y["price"], F.lit(0)))
        return F.struct(
            (x["n"] - F.size(same)).alias("peers"),
            (x["local"] - F.size(F.filter(same, lambda y: x["city"] == y["city"]))).alias("city_peers"),
            (x["priced"] - F.size(F.filter(same, lambda y: y["price"].isNotNull()))).alias("priced"),
            (x["s"] - price).alias("s"),
        )

    def seen(xs: Column) -> Column:
        return F.transform(xs, lambda x: F.get(F.transform(F.array(F.filter(xs, lambda y: F.coalesce(near(x, y), F.lit(False)))), lambda same: others(x, same)), 0))

    each = rows.groupBy("ad_id").agg(F.collect_list(one).alias("xs")).select("ad_id", F.inline(seen(F.col("xs"))))
    out = each.groupBy("ad_id").agg(F.sum("peers").alias("peers"), F.sum("city_peers").alias("city_peers"), F.sum("priced").alias("priced"), F.sum("s").alias("s"))
    return out.filter("peers > 0").select("ad_id", "peers", "city_peers", F.when(F.col("priced") > 0, F.col("s")).alias("peer_sum"))


def _banded(rows: DataFrame, others: DataFrame, keys: Sequence[str], tolerance: int) -> DataFrame:
    bucket = F.coalesce(F.floor(F.col("mileage") / tolerance), F.lit(-2)).cast("long")
    left = rows.select("ad_id", "price", "city", "mileage", *keys, bucket.alias("bucket"))
    near = F.explode(F.when(F.col("mileage").isNull(), F.array(bucket)).otherwise(F.array(bucket - 1, bucket, bucket + 1)))
    right = others.select(F.col("ad_id").alias("peer"), F.col("price").alias("peer_price"), F.col("city").alias("peer_city"), F.col("mileage").alias("peer_mileage"), *[F.col(k).alias(f"peer_{k}") for k in keys], near.alias("peer_bucket"))
    on = [F.col(k).eqNullSafe(F.col(f"peer_{k}")) for k in keys] + [F.col("bucket") == F.col("peer_bucket")]
    on.append((F.abs(F.col("mileage") - F.col("peer_mileage")) <= tolerance) | (F.col("mileage").isNull() & F.col("peer_mileage").isNull()))
    return left.join(right, on)


def _between_ranks(low: Column, high: Column, part: Column) -> Column:
    """Linear interpolation between the values of two neighbouring ranks."""
    return F.when(part == 0, low.cast("double")).otherwise(low * (1 - part) + high * part)


def peer_median_opportunities(
    listings: DataFrame, keys: Sequence[str], tolerance: int = 25_000, min_comparables: int = 6, min_discount: int = 50_000_000, low: float = 8.0, high: float = 35.0, evaluated: DataFrame | None = None, cell_points: int = CELL_POINTS
) -> DataFrame:
    """Listings below the median of their peers: scope, comparables, median_price, discount, discount_percent, confidence.

    Peers are those of peer_pairs; the same city is the scope if it has min_comparables peers, before outliers are removed, else
    all cities. Prices outside 1.5 interquartile ranges are left out (as in iqr_filter); min_comparables must be left. The median
    is cut to an integer. ``evaluated`` (ad_id) restricts whose medians are wanted.

    Listings of equal keys, mileage, city and price (a spot) are counted first, and each counted price is sent to the cells of mileages
    that may see it (bands.py), where every listing finds its order statistics by rank, those at or above its own price moved up
    by one. Rows grow with the listings, however many peers each has; a cell of a hot group that one task can't hold is cut into
    slabs of prices, which each spot asks once.
    """
    own = listings if evaluated is None else listings.join(evaluated.select("ad_id"), "ad_id", "left_semi")
    spots = written(listings.filter("price is not null").groupBy(*keys, "mileage", "city", "price").agg(F.count("*").alias("cnt")))
    asking = banded(own.filter("price is not null"), keys, tolerance, "ad_id", "price", "city")
    points = pointed(spots.filter("price > 0"), keys, tolerance)
    listed = banded(spots, keys, tolerance, F.col("cnt").alias("listed"))

    def told(own: pa.Table, band: Band) -> dict[str, np.ndarray]:
        price = own["price"].to_numpy()
        mine = price > 0
        ranks, a, b = band.kind("local")
        n = ranks.weight(a, b) - mine
        local = (n >= min_comparables) & own["city"].is_valid().to_numpy()
        if not local.all():
            ranks, a, b = band.kind("wide")
            n = np.where(local, n, ranks.weight(a, b) - mine)
        out = {"keep": np.zeros(len(n), bool), "local": local, "comparables": n.copy(), "median": np.zeros(len(n))}
        for name, scope in (("local", local), ("wide", ~local)):
            i = np.flatnonzero(scope & (n >= min_comparables))
            if not len(i):
                continue
            ranks, low, high = band.kind(name)
            before = ranks.below(low[i], high[i], price[i])
            # At most the lowest quarter is left out below the quartiles, so no median comes after this rank.
            last = -(-(-(-(n[i] - 1) // 4) + n[i] - 1) // 2)
            i, before = i[before <= last], before[before <= last]
            a, b, m, p, taken = low[i], high[i], n[i], price[i], mine[i]
            moved = lambda k, where: k + (where & (k >= before))  # noqa: B023, E731
            q1, q3 = (middle(ranks, a, b, m, q, lambda k: moved(k, taken)) for q in (0.25, 0.75))  # noqa: B023
            floor, ceiling = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
            under, within = ranks.below(a, b, floor), ranks.below(a, b, ceiling, to=True)
            inside = taken & (p >= floor) & (p <= ceiling)
            left = within - under - inside
            whole = (m < 5) | (q3 <= q1) | (left < 3)
            left, under, gone = np.where(whole, m, left), np.where(whole, 0, under), np.where(whole, taken, inside)
            out["median"][i] = middle(ranks, a, b, left, 0.5, lambda k: moved(under + k, gone))  # noqa: B023
            out["comparables"][i] = left
            out["keep"][i] = (left >= min_comparables) & (p < np.floor(out["median"][i]))
        return out

    def split(asking: DataFrame, points: DataFrame) -> DataFrame:
        spots = written(asking.select(*PLACE, "price").distinct())
        slabs = Slabs(spots, points, tolerance, True, cell_points)
        mine = (F.col("price") > 0).cast("int")
        rows = slabs.with_totals(spots).withColumns({"mine": mine, "taken": mine == 1})
        same_city = F.col("city").isNotNull() & (F.col("local_total") - F.col("mine") >= min_comparables)
        rows = rows.withColumns({"local": same_city, "scope": F.when(same_city, "local").otherwise("wide"), "n": F.when(same_city, F.col("local_total")).otherwise(F.col("wide_total")) - F.col("mine")})
        rows = written(rows.filter(F.col("n") >= min_comparables).withColumn("id", F.monotonically_increasing_id()))
        rows = slabs.with_below(rows, {"r": (F.col("price"), False)})
        moved = lambda at, where: at + (where & (at >= F.col("r"))).cast("int")
        at = {q: (F.col("n") - 1) * F.lit(x) for q, x in (("q1", 0.25), ("q3", 0.75))}
        ranks = {f"{q}_{end}": moved(F.floor(k) + one, F.col("taken")) for q, k in at.items() for end, one in (("a", 0), ("b", 1))}
        rows = slabs.with_values(rows, ranks)
        rows = rows.withColumns({q: _between_ranks(F.col(f"{q}_a"), F.col(f"{q}_b"), k - F.floor(k)) for q, k in at.items()})
        reach = 1.5 * (F.col("q3") - F.col("q1"))
        rows = slabs.with_below(rows.withColumns({"floor": F.col("q1") - reach, "ceiling": F.col("q3") + reach}), {"under": (F.col("q1") - reach, False), "within": (F.col("q3") + reach, True)})
        inside = F.col("taken") & F.col("price").between(F.col("floor"), F.col("ceiling"))
        left = F.col("within") - F.col("under") - inside.cast("int")
        whole = (F.col("n") < 5) | (F.col("q3") <= F.col("q1")) | (left < 3)
        rows = rows.withColumns({"comparables": F.when(whole, F.col("n")).otherwise(left), "skipped": F.when(whole, 0).otherwise(F.col("under")), "gone": F.when(whole, F.col("taken")).otherwise(inside)})
        rows = rows.filter(F.col("comparables") >= min_comparables)
        k = (F.col("comparables") - 1) * F.lit(0.5)
        rows = slabs.with_values(rows, {f"m_{end}": moved(F.col("skipped") + F.floor(k) + one, F.col("gone")) for end, one in (("a", 0), ("b", 1))})
        median = _between_ranks(F.col("m_a"), F.col("m_b"), k - F.floor(k))
        rows = rows.select(*PLACE, "price", "local", "comparables", median.alias("median"))
        return at_place(asking, rows, ["price"]).select("ad_id", "price", "city", "local", "comparables", "median")

    out = answered(asking, points, listed, told, "local boolean, comparables long, median double", tolerance, True, split, cell_points)
    out = out.withColumns({"median_price": F.floor("median").cast("bigint"), "scope": F.when(F.col("local"), "city").otherwise("nationwide")})
    out = out.filter(F.col("price") < F.col("median_price"))
    out = out.withColumns({"discount": F.col("median_price") - F.col("price"), "discount_percent": percent_below(F.col("price"), F.col("median_price"))})
    out = out.filter((F.col("discount") >= min_discount) & F.col("discount_percent").between(low, high))
    out = out.withColumn("confidence", confidence_label(F.col("discount_percent"), F.col("comparables"), F.col("scope") == "city"))
    answer = ["scope", "comparables", "median_price", "discount", "discount_percent", "confidence"]
    return out.select("ad_id", "price", *answer)


def confidence_label(percent: Column, comparables: Column, same_city: Column) -> Column:
    score = F.when(comparables >= 12, 2).when(comparables >= 8, 1).otherwise(0) + same_city.cast("int") + percent.between(9, 22).cast("int")
    return F.when(score >= 3, "high").otherwise("medium")


def local_median(listings: DataFrame, keys: Sequence[str], tolerance: int = 10_000, least: int = 3, cell_points: int = CELL_POINTS) -> DataFrame:
    """local_n and local_price: the median within ``tolerance`` of a listing's mileage in its group, the listing included; null below
    ``least``.

    Listings of equal keys and mileage (a place) share it. Prices are counted first and sent to the cells of mileages that may see
    them, where each place finds its median by rank (bands.py). Listings without a mileage are left out, null
    prices aren't counted.
    """
    known = listings.filter("mileage is not null")
    none = F.lit(None).cast("string").alias("city")
    places = written(known.select(*keys, "mileage", none).distinct())
    counted = written(known.filter("price is not null").groupBy(*keys, "mileage", "price").agg(F.count("*").alias("cnt"))).withColumn("city", none)
    asking, points = banded(places, keys, tolerance, *places.columns), pointed(counted, keys, tolerance)
    listed = banded(places, keys, tolerance, F.lit(1).alias("listed"))

    def told(own: pa.Table, band: Band) -> dict[str, np.ndarray]:
        ranks, a, b = band.kind("wide")
        n = ranks.weight(a, b)
        return {"keep": n > 0, "local_n": n, "m": middle(ranks, a, b, n, 0.5)}

    def split(asking: DataFrame, points: DataFrame) -> DataFrame:
        slabs = Slabs(asking, points, tolerance, False, cell_points)
        rows = slabs.with_totals(asking).withColumnRenamed("wide_total", "local_n").filter("local_n > 0")
        rows = written(rows.withColumns({"id": F.monotonically_increasing_id(), "scope": F.lit("wide")}))
        k = (F.col("local_n") - 1) * F.lit(0.5)
        rows = slabs.with_values(rows, {"a": F.floor(k), "b": F.ceil(k)})
        return rows.select(*places.columns, "local_n", _between_ranks(F.col("a"), F.col("b"), k - F.floor(k)).alias("m"))

    medians = answered(asking, points, listed, told, "local_n long, m double", tolerance, False, split, cell_points)
    local = F.when(F.col("local_n") >= least, F.bround("m").cast("bigint")).alias("local_price")
    place = lambda: F.struct(*keys, "mileage")
    medians = medians.select(place().alias("place"), "local_n", local)
    return known.withColumn("place", place()).join(medians, "place", "left").withColumn("local_n", F.coalesce("local_n", F.lit(0).cast("long"))).drop("place")


#: Time ranges into which the listings of a large group are cut.
RANGES = 256


def prior_history(listings: DataFrame, keys: Sequence[str], most: int = 10, split_rows: int = 1 << 16, days: int | None = None) -> DataFrame:
    """prior_n, prior_avg: over the latest ``most`` listings of the group that came before (ties of first_seen by ad_id), and with
    ``days``, at most that many days before the listing.

    A group is one sorted partition of a window, unless it has more than ``split_rows`` listings: such a group is cut into RANGES
    ranges of first_seen (at percentiles), each a partition that starts with the ``most`` listings before it. These are found
    among the last ``most`` of each range, as none earlier in a range can be among them.
    """
    order = ["first_seen", "ad_id"]

    def added(w: Window) -> dict[str, Column]:
        if days is None:
            return {"prior_n": F.count("*").over(w), "prior_avg": F.avg("price").over(w)}
        # At most ``most`` rows: those too old are told apart in the row that sees them.
        near = F.filter(F.collect_list(F.struct("first_seen", "price")).over(w), lambda x: x["first_seen"] >= F.col("first_seen") - F.make_dt_interval(days=F.lit(days)))
        known = F.filter(near, lambda x: x["price"].isNotNull())
        total = F.aggregate(known, F.lit(0.0), lambda s, x: s + x["price"])
        return {"prior_n": F.size(near).cast("long"), "prior_avg": F.when(F.size(known) > 0, total / F.size(known))}

    frame = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(-most, -1)
    large = written(listings.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > split_rows).drop("_n"))
    if large.isEmpty():
        return listings.withColumns(added(frame(*keys)))
    named = large.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    at = F.unix_micros(F.col("first_seen").cast("timestamp"))
    cuts = listings.join(named, on, "left_semi").groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.percentile_approx(at, [k / RANGES for k in range(1, RANGES)], 100 * RANGES).alias("_cuts"))
    cut = listings.join(written(cuts), on, "left").drop(*[f"_{k}" for k in keys])
    range_of = F.coalesce(F.size(F.filter("_cuts", lambda c: c < at)), F.lit(0))
    cut = written(cut.withColumns({"_range": F.when(F.col("_cuts").isNull(), -1).otherwise(range_of), "_before": F.lit(False)}).drop("_cuts"))
    # The last listings of each range, and before its first one, the last of all ranges before.
    back = Window.partitionBy(*keys, "_range").orderBy(*[F.desc(c) for c in order])
    tails = cut.filter("_range >= 0").withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= most).drop("_back")
    row = F.struct(*listings.columns)
    firsts = Window.partitionBy(*keys, "_range").orderBy(*order)
    carried = tails.withColumns({"_carry": F.collect_list(row).over(frame(*keys)), "_first": F.row_number().over(firsts)}).filter("_first = 1")
    carried = carried.select("_range", F.explode("_carry").alias("_row")).select("_row.*", "_range", F.lit(True).alias("_before"))
    return cut.unionByName(carried).withColumns(added(frame(*keys, "_range"))).filter("not _before").drop("_range", "_before")


def prior_history_deals(listings: DataFrame, keys: Sequence[str], low: float = 4.0, least: int = 4, most: int = 10, days: int | None = None) -> DataFrame:
    known = prior_history(listings, keys, most, days=days).filter(F.col("prior_n") >= least)
    return known.withColumn("discount_percent", percent_below(F.col("price"), F.col("prior_avg"))).filter(F.col("discount_percent") >= low)


def best_deal(deals: DataFrame, percent: str = "diff_percent") -> DataFrame:
    """The one deal with the highest percentage, then the lowest price, then the largest id."""
    order = F.struct(F.col(percent), -F.col("price"), F.col("ad_id"))
    return deals.agg(F.max_by(F.struct("ad_id", "price", percent), order).alias("d")).filter("d is not null").select("d.*")


def top_deals(deals: DataFrame, k: int, percent: str = "diff_percent", per: Sequence[str] = ()) -> DataFrame:
    """The k best deals, or the k best of each group; by percentage, price, id."""
    order = [F.desc(percent), F.asc("price"), F.asc("ad_id")]
    if not per:
        return deals.orderBy(*order).limit(k)
    return deals.withColumn("_n", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


def analyzed_deals(listings: DataFrame, catalog: DataFrame, sent: DataFrame, as_of: str, current: DataFrame | None = None, days: int = 7, keys: Sequence[str] = ("brand", "model", "trim", "year"), least: int = 1, low: float = 2.0, high: float = 10.0) -> DataFrame:
    """Deals of the group-mean pipeline: listings seen in the last days, those eligible, the last row of each id; the cheapest of a
    group of at least ``least`` if it is in the band; those of the current run (ad_id) that weren't sent (ad_id)."""
    recent = eligible(retained(listings, as_of, days), catalog)
    unique = keep_first(recent, ["ad_id"], [F.desc("last_seen")])
    deals = cheapest_in_group(unique, keys, low, high).filter(F.col("group_size") >= least)
    if current is not None:
        deals = semi(deals, current, ["ad_id"])
    return anti(deals, sent, ["ad_id"])


def best_unsent(*args, **options) -> DataFrame:
    """The best of analyzed_deals, by best_deal."""
    return best_deal(analyzed_deals(*args, **options))
