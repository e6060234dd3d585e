"""What keeps the queries growing with their input: work done once a row, tasks that follow the rows, no pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.functions import parsers as P
from tradewind.functions import text as T
from tradewind.operators import market as M
from tradewind.plans import queries as Q
from tradewind.sources import payloads as PL

SF = "/root/testdata/sf0.001"
ADS = "ad_id string, price long, city string, mileage long, brand string, year int"


def totals(pairs):
    return pairs.groupBy("ad_id").agg(F.count("*").alias("peers"), F.count_if("same_city").alias("city_peers"), F.sum("peer_price").alias("peer_sum"))


def test_peer_totals_equal_the_pairs(spark):
    rng = random.Random(3)
    pick = lambda *xs: rng.choice(xs)
    rows = [(pick(f"a{k}", f"a{k}", f"a{k}", "same", None), pick(None, 5, 7, 11), pick(None, "x", "y"), pick(None, 0, 900, 1000, 2000, 2001, 5000, -1500), pick(None, "b", "c"), pick(1, 2, None)) for k in range(300)]
    ads = spark.createDataFrame(rows, ADS)
    got, want = (sorted(map(tuple, df.collect())) for df in (M.peer_totals(ads, ["brand", "year"], 1000), totals(M.peer_pairs(ads, ["brand", "year"], 1000))))
    assert got == want and len(got) > 100


def test_peer_totals_of_a_hot_group(spark):
    """100 000 listings that all see each other: ten thousand million pairs."""
    n = 100_000
    ads = spark.range(n).selectExpr("cast(id as string) ad_id", "1L price", "if(id % 4 = 0, 'x', 'y') city", "id % 7 mileage", "'b' brand", "1 year")
    got = M.peer_totals(ads, ["brand", "year"], 10).groupBy("city_peers").agg(F.count("*"), F.max("peers"), F.min("peer_sum")).collect()
    assert sorted(map(tuple, got)) == [(n // 4 - 1, n // 4, n - 1, n - 1), (n // 4 * 3 - 1, n // 4 * 3, n - 1, n - 1)]


def test_a_walk_parses_its_payloads_once(spark, capsys):
    payloads = spark.createDataFrame([(1, '{"a": [1, {"b": {"c": [null]}}]}')], "id long, p string")
    walk = PL.json_walk(payloads, "id", "p", depth=8)
    walk.explain()
    assert "parse_json" not in capsys.readouterr().out
    assert sorted(r.path for r in walk.collect()) == ["$", "$.a", "$.a[0]", "$.a[1]", "$.a[1].b", "$.a[1].b.c", "$.a[1].b.c[0]"]


@pytest.mark.parametrize("name", ["parse_price", "parse_year", "parse_mileage", "card_prices", "model_keys", "batch_listings", "group_identity", "listing_reason", "source_cards"])
def test_tasks_follow_the_rows(spark, monkeypatch, name):
    monkeypatch.setattr(Q, "TASK_ROWS", 100)
    assert Q.QUERIES[name](spark, SF).rdd.getNumPartitions() >= 10


def test_each_pattern_is_read_once(spark):
    t = F.col("t")
    assert str(P.year_batch(t)).count("[0-9]{2,4}") == 1
    assert str(T.normalize_match(t)).lower().count("translate(") == 1
    assert str(P.price_card(t)).lower().count("translate(") == 3  # the parts, and in each of the two readings a short match
    assert str(P.year_peer(t)).lower().count("translate(") == 1
    assert str(P.mileage_peer(t)).lower().count("translate(") == 1


def test_a_price_is_sent_to_two_cells_at_most_and_listings_are_not_joined_back(spark, monkeypatch, capsys):
    ads = spark.range(6000).selectExpr("cast(id as string) ad_id", "900 + id * 7919 % 9000 price", "if(id % 3 = 0, 'x', 'y') city", "1000 + id * 31 % 50 * 1000 mileage", "'b' brand")
    sent, real = [], M.answered
    monkeypatch.setattr(M, "answered", lambda asking, points, *a, **o: sent.append(points.count()) or real(asking, points, *a, **o))
    out = M.peer_median_opportunities(ads, ["brand"], 2000, min_discount=50)
    out.explain()
    assert sent[0] <= 1.6 * 6000 and "Join" not in capsys.readouterr().out
    assert out.count() > 100


def test_a_cell_that_many_listings_ask_is_answered_in_shares(spark, monkeypatch):
    """400 listings of three spots among 40 prices: no task gets all of them, the answers stay."""
    rows = [(f"a{k}", k % 40 + 60 if k < 40 else 70 + k % 3, None if k % 5 == 0 else "x", 10, "b") for k in range(440)]
    ads = spark.createDataFrame(rows, "ad_id string, price long, city string, mileage long, brand string")
    told = lambda **o: sorted(map(tuple, M.peer_median_opportunities(ads, ["brand"], 20, min_discount=1, low=0, high=100, **o).collect()))
    whole = told()
    assert told(cell_points=100) == whole and len(whole) > 100
    real = M.answered

    def rows_of_a_task(asking, points, listed, told, *a, **o):
        every = lambda own, band: {"keep": np.ones(own.num_rows, bool), "local": np.ones(own.num_rows, bool), "comparables": np.full(own.num_rows, own.num_rows), "median": np.full(own.num_rows, 1e6)}
        return real(asking, points, listed, every, *a, **o)

    monkeypatch.setattr(M, "answered", rows_of_a_task)
    assert max(r[3] for r in told(cell_points=100)) < 300


def test_null_keys_of_two_columns_are_told_apart(spark):
    rows = [(f"a{k}", 100 + k, "x", 5, None, "a") for k in range(8)] + [(f"b{k}", 900 + k, "x", 5, "a", None) for k in range(8)]
    ads = spark.createDataFrame(rows, "ad_id string, price long, city string, mileage long, brand string, model string")
    out = M.peer_median_opportunities(ads, ["brand", "model"], 10, min_discount=1, low=0, high=100).collect()
    assert {r.comparables for r in out} == {7} and {r.ad_id[0] for r in out} == {"a", "b"}


def test_ranks_in_segments_against_sorting():
    from tradewind.operators.bands import Ranks

    rng = np.random.default_rng(5)
    segments = np.repeat([2, 3, 7, 9], [1, 40, 128, 31])
    for weights in (rng.integers(1, 4, 200), np.ones(200, np.int64)):
        values = rng.integers(0, 30, 200)
        ranks = Ranks(values, weights, segments)
        begins = rng.integers(0, 200, 300)
        ends = np.array([rng.integers(b, np.searchsorted(segments, segments[b], "right") + 1) for b in begins])
        for a, b in zip(begins, ends, strict=True):
            own = np.sort(np.repeat(values[a:b], weights[a:b]))
            one = lambda f, *x, **o: f(np.array([a]), np.array([b]), *map(np.array, x), **o)[0]  # noqa: B023, E731
            for k in {0, len(own) // 2, len(own) - 1} if len(own) else ():
                assert one(ranks.at, [k]) == own[k]
            for x in (-1, 7.5, 20, 99):
                assert one(ranks.below, [x]) == (own < x).sum() and one(ranks.below, [x], to=True) == (own <= x).sum()
