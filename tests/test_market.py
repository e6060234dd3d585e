"""Golden cases, parsers on Persian texts, history rules, and streaming against batch."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tradewind import lexicons as L
from tradewind.functions import parsers as P
from tradewind.functions import text as T
from tradewind.operators import history as H
from tradewind.operators import market as M
from tradewind.operators import validation as V
from tradewind.sources import pages as PG
from tradewind.sources import payloads as PL


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first().v


GOLD = "پژو 206 تیپ 2 مدل 1383 کارکرد 169000 قیمت 595,500,000 تومان"


def test_listing_reasons(spark):
    rows = [
        ("a", "1", "https://Example.com/x/?q=1", GOLD, GOLD),
        ("a", "2", "https://example.com/x", "پژو 206 تیپ 2 مدل 1383 اقساطی", "قیمت 500 میلیون کارکرد 100000"),
        ("a", "3", "https://example.com/x", "پژو 206 مدل 1383", "کارکرد 169000 قیمت 595,500,000 تومان"),
        ("a", "", "https://example.com/x", "چیز", "مدل 1383 کارکرد 169000 قیمت 595,500,000 تومان"),
        ("a", "5", "https://example.com/x", "تیبا", "کارکرد 169000 قیمت 595,500,000 تومان"),
        ("a", "6", "https://example.com/x", "تیبا مدل 99", "قیمت 595,500,000 تومان"),
        ("formula", "7", "https://example.com/x", "تیبا مدل 99", "قیمت 595,500,000 تومان"),
        ("a", "8", "https://example.com/x", "تیبا مدل 99", ""),
    ]
    out = V.listing_reason(spark.createDataFrame(rows, "source string, source_ad_id string, url string, title string, raw_text string"), 2025).collect()
    first = out[0]
    assert (first.reason, first.brand, first.model, first.trim, first.model_year, first.condition, first.mileage, first.price) == ("accepted", "Peugeot", "206", "تیپ 2", 1383, "used", 169000, 595500000)
    assert first.clean_url == "https://example.com/x"
    assert [r.reason.split(":")[0] for r in out[1:]] == ["blocked_phrase", "missing_trim", "unknown_vehicle", "invalid_year", "unknown_condition", "accepted", "invalid_price"]
    assert len(out[3].source_ad_id) == 24


@pytest.mark.parametrize(
    ("text", "price"),
    [("قیمت ۱/۲۵۰ نقد", 1_250_000_000), ("۲ میلیارد", 2_000_000_000), ("850 میلیون", 850_000_000), ("595,500,000 تومان", 595_500_000), ("780م", 780_000_000), ("قیمت: 640", 640_000_000), ("بدون عدد", None)],
)
def test_price_batch(spark, text, price):
    assert one(spark, P.price_batch, text) == price


@pytest.mark.parametrize(("text", "price"), [("1.2 میلیارد تومان", 1_200_000_000), ("850 میلیون", 850_000_000), ("8,500,000,000,000 تومان", None), ("900,000,000,0 تومان", 9_000_000_000), ("توافقی 850 میلیون", None), ("500000000000 تومان", 50_000_000_000)])
def test_price_peer(spark, text, price):
    assert one(spark, P.price_peer, text) == price


def test_years_and_mileages(spark):
    year = lambda t: one(spark, P.parse_year, t)
    assert [year("مدل 83"), year("مدل 1402"), year("سال ۲۰۱۳"), year("مدل 05"), year("بی سال")] == [1383, 1402, 2013, 1405, None]
    assert [one(spark, P.normalize_year, x) for x in ("97", "402", "1402", "2013", "x")] == [1397, 1402, 1402, 2013, None]
    assert [one(spark, P.year_peer, x) for x in ("سال ساخت: 1398", "2015 یا 1394", "2015")] == [1398, 1394, 2015]
    assert one(spark, P.year_from_url, "https://x.example/car/detail-mvm-315-1393") == 1393
    assert [one(spark, P.parse_mileage, x) for x in ("کارکرد صفر", "کارکرد 169,000 کیلومتر", "120000 km", "نو")] == [0, 169000, 120000, None]
    assert [one(spark, P.mileage_batch, x) for x in ("کارکرد ۸۵/۰۰۰", "کارکرد: صفر", "کارکرد 120")] == [85000, 0, 120]
    assert one(spark, P.mileage_peer, "کارکرد: ۹۰٬۰۰۰ کیلومتر") == 90000
    assert one(spark, P.is_zero_km, "0 km") and not one(spark, P.is_zero_km, "10 km")


def test_texts(spark):
    assert [one(spark, T.normalize_match, x) for x in ("405تیوفایو", "مدل1402", "تیپ5")] == ["405 تیوفایو", "مدل 1402", "تیپ 5"]
    assert one(spark, T.normalize_match_any, "Ä5(x)") == "ä 5 x"
    assert one(spark, T.normalize_text, " كتاب‌هاي ۱۲ً ") == "کتاب های 12"
    assert one(spark, T.compact_text, "Dena+ 1402!") == "dena 1402"
    assert one(spark, lambda c: T.earliest_alias(c, L.BATCH_MODELS), "فروش پژو 206 SD سالم") == "پژو 206 SD"
    assert one(spark, lambda c: T.earliest_alias(c, L.BATCH_MODELS), "\n") == "unknown"
    assert one(spark, T.strip_signature, "متن @kanal") == "متن"
    assert one(spark, lambda c: P.model_key(c), "پژو206 تیپ دو سفید بدون رنگ مدل 1390") == "پژو 206 تیپ 2"
    assert one(spark, lambda c: T.longest_alias(c, {"x": "a", "x y": "b", "zz": "c"}), "zz xx y") == "c"
    assert one(spark, P.severity_class, "دور رنگ و گلگیر تعویض") == "replaced"
    assert one(spark, lambda c: P.exclusion_reason(c), "فروش با 36 قسط") == "instalment_count"
    assert one(spark, lambda c: P.exclusion_reason(c), "فروش اقساطی").startswith("finance:")
    assert one(spark, lambda c: P.price_card(F.split(c, "#")), "دنا#1,200 تومان#850,000,000 تومان#x") == 850_000_000


def test_batch_listing(spark):
    rows = spark.createDataFrame([("پراید 131 مدل 90 کارکرد 85/000 قیمت 300 میلیون",), ("پراید اقساط",), ("دنا پلاس",)], "text string")
    out = V.batch_listing(rows).collect()
    assert (out[0].car_name, out[0].model_year, out[0].price, out[0].mileage, out[0].reason) == ("پراید", "1390", 300_000_000, 85000, "accepted")
    assert [r.reason.split(":")[0] for r in out[1:]] == ["excluded", "no_price"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 10**11), min_size=1, max_size=30))
def test_prices_round_trip(spark, numbers):
    rows = spark.createDataFrame([(f"{n:,} تومان", n) for n in numbers], "t string, n bigint")
    for r in rows.select(P.parse_price(F.col("t")).alias("p"), "n").collect():
        assert r.p == (r.n if 1_000_000 <= r.n <= 500 * 10**9 else None) or len(f"{r.n:,}") < 6


def arrivals(spark, prices, start=0):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(f"a{start + k:02d}", "g", p, base + dt.timedelta(hours=start + k)) for k, p in enumerate(prices)], "ad_id string, key string, price bigint, first_seen timestamp")


def test_history_warm_up_and_deal(spark):
    prices = [900, 950, 920, 940, 850]
    out = M.prior_history_deals(arrivals(spark, [p * 10**6 for p in prices]), ["key"]).collect()
    assert [(r.ad_id, r.prior_n) for r in out] == [("a04", 4)] and out[0].discount_percent == pytest.approx(8.3558, abs=1e-3)
    latest = H.keep_first(arrivals(spark, range(1, 13)), ["key"], [F.desc("first_seen")], 10)
    assert latest.count() == 10


def test_upsert_merge_and_ledger(spark):
    stored = arrivals(spark, [1, 2])
    new = arrivals(spark, [5, 6], start=1)
    out = {r.ad_id: r.price for r in H.upsert(stored, new, "ad_id").collect()}
    assert out == {"a00": 1, "a01": 5, "a02": 6}
    a = spark.createDataFrame([("k", "long text", None, False, 1)], "k string, d string, c string, f boolean, first_seen int")
    b = spark.createDataFrame([("k", "short", "x", True, 9), ("n", None, None, None, 9)], "k string, d string, c string, f boolean, first_seen int")
    got = {r.k: tuple(r)[1:] for r in H.merge_sparse(a, b, "k", {}, longer=["d"], flags=["f"]).collect()}
    assert got == {"k": ("long text", "x", True, 1), "n": (None, None, False, 9)}


def test_peers_with_nulls_and_city(spark):
    rows = [(f"p{k}", "k", 100 + k, 1000 * k if k else None, "c") for k in range(4)] + [("q", "k", 50, None, None), ("z", None, 70, 1000, "c")]
    df = spark.createDataFrame(rows, "ad_id string, key string, price bigint, mileage bigint, city string")
    pairs = {(r.ad_id, r.peer_price, r.same_city) for r in M.peer_pairs(df, ["key"], 1000).collect()}
    assert pairs == {("p0", 50, False), ("q", 100, False), ("p1", 102, True), ("p2", 101, True), ("p2", 103, True), ("p3", 102, True)}


def test_opportunity_scopes(spark):
    rows = [(f"c{k}", "k", 100, 0, "x") for k in range(7)] + [("low", "k", 80, 0, "x"), ("far", "k", 85, 0, "y")]
    df = spark.createDataFrame(rows, "ad_id string, key string, price bigint, mileage bigint, city string")
    out = {r.ad_id: (r.scope, r.comparables, r.median_price, r.confidence) for r in M.peer_median_opportunities(df, ["key"], 10, min_discount=1).collect()}
    assert out == {"low": ("city", 7, 100, "medium"), "far": ("nationwide", 8, 100, "medium")}


def test_pages(spark):
    html = '<a data-post="c/1"></a><div class="m">one<br>two &amp;amp;</div><a data-post="c/2"></a><i data-post="c/1"></i><div class="m">x</div>'
    pages = spark.createDataFrame([(1, "https://www.cars.example/s", html + '<div><p>قیمت 850 تومان</p><a href="/v/ab-1/?x=1"><b>عنوان</b></a></div>'), (2, "https://x.example", None)], "page_id long, url string, html string")
    got = PG.message_blocks(pages, 'data-post="(c/[0-9]+)"', '<div class="m">(.*?)</div>').orderBy("pos").collect()
    assert [(r.id, r.text) for r in got] == [("c/1", "one\ntwo &amp;"), ("c/2", "x")]
    cards = PG.page_cards(pages, [{"name": "r", "hosts": ["cars.example"], "paths": ["^/v/"], "price": "قیمت"}, {"name": "no", "hosts": ["other.example"], "paths": ["^/v/"]}]).collect()
    assert [(c.rule, c.url, c.ad_id, c.title) for c in cards] == [("r", "https://www.cars.example/v/ab-1", "ab-1", "عنوان")]
    kinds = spark.createDataFrame([("<script>captcha</script>ok", 200), ("Access DENIED", 200), ("x", 429)], "h string, s int").select(PG.page_class(F.col("h"), "/v/", status=F.col("s")).alias("c")).collect()
    assert [k.c for k in kinds] == ["ok", "marker:access denied", "status"]


def test_json(spark):
    doc = '{"b": [1, {"price": "850 میلیون"}], "a": {"title": "قیمت", "city": " Tehran "}, "a2": null}'
    df = spark.createDataFrame([(1, doc), (2, "no json"), (3, None)], "id int, p string")
    walk = PL.json_walk(df, "id", "p")
    assert [r.path for r in walk.orderBy("pos").collect()][0] == "$" and walk.filter("id > 1").count() == 0
    assert PL.json_price(walk, "id").first().price == 850_000_000
    assert PL.json_first_value(walk, "id", ["city"]).first().value == "Tehran"
    assert PL.json_all_text(walk, "id").first().all_text.count("\n") == 2


def test_substring_lookup_of_short_and_empty_keys(spark):
    table = spark.createDataFrame([(1, "abc", 1), (2, "bcd", 2), (3, "xyz", 3), (4, "re", 4), (5, "q", 5), (6, None, 9)], "ord int, key string, price bigint")
    names = spark.createDataFrame([("zabcd",), ("bcdx",), ("none",), ("green re",), ("q",), ("",), (None,), ("re",), ("re",)], "name string")
    want = {"bcdx": 2, "none": None, "zabcd": 1, "green re": 4, "q": 5, "": None, None: None, "re": 4}
    out = V.substring_lookup(names, table).collect()
    assert len(out) == 9 and {r.name: r.price for r in out} == want
    every = table.unionByName(spark.createDataFrame([(7, "", 7)], table.schema))
    assert {r.name: r.price for r in V.substring_lookup(names, every).collect()} == {**want, "none": 7, "": 7}
    assert V.substring_lookup(names, table.limit(0)).filter("price is not null").count() == 0


def test_listing_build_falls_back(spark):
    rows = [
        (1, '{"token": "abcde1", "data": {"header": "تیبا مدل 1390"}}', None),
        (2, '{"data": {"title": "کارت"}}', '{"link": "https://x.example/v/a/zz-99_x", "images": [{"src": "http://h/1.webp?x"}], "p": {"label": "قیمت", "value": 850000000}}'),
        (3, '{"x": 1}', None),
    ]
    out = {r.id: r for r in V.build_listings(spark.createDataFrame(rows, "id int, card string, detail string"), "id", "card", "detail", "2024-01-01").collect()}
    assert sorted(out) == [1, 2]
    assert (out[1].token, out[1].title, out[1].model_key, out[1].year, out[1].excluded_reason) == ("abcde1", "تیبا مدل 1390", "تیبا", 1390, "no_price_found")
    assert (out[2].token, out[2].title, out[2].price_toman, out[2].image_url, out[2].excluded) == ("zz-99_x", "کارت", 850_000_000, "http://h/1.webp?x", False)


def test_group_identity_prefers_stated_values(spark):
    rows = [("پژو 206", "", "Peugeot", "206", "تیپ 2", "402"), ("x", "", "پژو", "۲۰۷", "اتومات", "97"), ("پژو 405", "تیپ 5", None, None, None, "1380"), ("شاهین GL 1401", "", None, None, None, None), ("سوناتا", "", "پژو", None, None, "1390")]
    df = spark.createDataFrame(rows, "title string, text string, b string, m string, t string, y string")
    out = [tuple(r)[6:10] for r in V.group_listings(df, "title", "text", ["b", "m", "t", "y"]).collect()]
    assert out == [("Peugeot", "206", "تیپ 2", 1402), ("Peugeot", "207", "اتوماتیک", 1397), (None, None, None, None), ("Saipa", "Shahin", "GL", 1401), (None, None, None, None)]


def test_peer_medians_against_brute_force(spark):
    """Nulls, repeated prices, listings without a price, small and large pools, outliers, both scopes."""
    import random

    rng = random.Random(7)
    rows = []
    for k in range(420):
        price = rng.choice([0, 50, 60, 61, 61, 62, 63, 64, 65, 70, 75, 80, 90, 400])
        rows.append((f"a{k:03d}", rng.choice(["k", "l", None]), price, rng.choice([None, 0, 10, 25, 40, 41, 90]), rng.choice(["x", "y", "z", None])))
    rows += [(f"b{k}", "few", 10 * (k + 5), 3, "x") for k in range(9)]
    df = spark.createDataFrame(rows, "ad_id string, key string, price bigint, mileage bigint, city string")

    def at(p, q):
        i = (len(p) - 1) * q
        k = int(i)
        return float(p[k]) if i == k else p[k] * (1 - (i - k)) + p[k + 1] * (i - k)

    want = {}
    for a, key, price, mileage, city in rows:
        near = [r for r in rows if r[0] != a and r[1] == key and r[2] > 0 and (r[3] is None and mileage is None or r[3] is not None and mileage is not None and abs(r[3] - mileage) <= 20)]
        local = [r for r in near if city is not None and r[4] == city]
        pool = sorted(r[2] for r in (local if len(local) >= 6 else near))
        if len(pool) < 6:
            continue
        q1, q3 = at(pool, 0.25), at(pool, 0.75)
        inside = [p for p in pool if q1 - 1.5 * (q3 - q1) <= p <= q3 + 1.5 * (q3 - q1)]
        kept = pool if q3 <= q1 or len(inside) < 3 else inside
        median = int(at(kept, 0.5)) if len(kept) >= 6 else 0
        if price < median and 0 <= (median - price) / median * 100 <= 100:
            want[a] = ("city" if len(local) >= 6 else "nationwide", len(kept), median)
    out = {r.ad_id: (r.scope, r.comparables, r.median_price) for r in M.peer_median_opportunities(df, ["key"], 20, min_discount=1, low=0, high=100).collect()}
    assert out == want and len(want) > 100
    some = M.peer_median_opportunities(df, ["key"], 20, min_discount=1, low=0, high=100, evaluated=df.filter("ad_id < 'a1'")).collect()
    assert {r.ad_id for r in some} == {a for a in want if a < "a1"}


def test_touch_and_retention(spark):
    stored = spark.createDataFrame([("a", 1, "2024-01-01"), ("b", 2, "2024-03-01")], "ad_id string, price int, d string").select("ad_id", "price", F.col("d").cast("timestamp").alias("last_seen"))
    seen = stored.select("ad_id", F.lit("2024-02-01").cast("timestamp").alias("last_seen"))
    out = {r.ad_id: (r.price, r.last_seen.month) for r in H.touch(stored, seen, "ad_id").collect()}
    assert out == {"a": (1, 2), "b": (2, 3)}
    kept = H.retained_tables({"ads": stored, "plan": stored.select(F.to_date("last_seen").alias("day"))}, {"ads": "last_seen", "plan": "day"}, "2024-03-05", 7)
    assert [r.ad_id for r in kept["ads"].collect()] == ["b"] and kept["plan"].count() == 1
    with pytest.raises(ValueError, match="days"):
        H.retained_tables({}, {}, "2024-03-05", 0)


def test_model_rules_file(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('[{"pattern": "DENA|دنا", "key": "Dena!"}, {"pattern": "("}, {"pattern": "(", "key": "bad"}, {"key": "x"}]', encoding="utf-8")
    rules = P.read_model_rules(spark, f"file://{path}")
    assert rules == [("DENA|دنا", "dena")]
    assert one(spark, lambda c: P.model_key(c, rules), "dena سفید") == "dena"


def test_card_sources(spark):
    html = "".join(f'<div><p>{text}</p><a href="{url}">t{k}</a></div>' for k, (url, text) in enumerate([
        ("https://bama.ir/car/detail-pdh9jy1c-mvm-315hatchback-basic-1393", ""), ("https://karnameh.com/used-cars/05c1a387-538f-4c22-b09d-d5f143dcf3bf", ""),
        ("https://www.sheypoor.com/v/example-466599945.html", "قیمت 850,000,000 تومان"), ("https://www.sheypoor.com/s/iran/car/peugeot", "قیمت 850,000,000 تومان"), ("https://divar.ir/v/x", ""), ("https://divar.ir/v/x/ab_1", ""),
    ]))
    pages = spark.createDataFrame([(1, "https://e.example/", html)], "page_id long, url string, html string")
    assert sorted(r.rule for r in PG.page_cards(pages, PG.CARD_SOURCES).collect()) == ["bama", "divar", "karnameh", "sheypoor"]
    assert [r.ad_id for r in PG.page_cards(pages, [PG.SEARCH_CARD]).filter("url like '%divar%'").collect()] == ["ab_1"]


def test_stream_equals_batch(spark, tmp_path):
    from tradewind.streaming.jobs import prior_history_stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    prices = [900, 950, 920, 940, 850, 990, 700, 880, 910, 870, 860, 500]
    source = arrivals(spark, prices)
    for k in range(3):
        source.filter(F.col("ad_id").between(f"a{4 * k:02d}", f"a{4 * k + 3:02d}")).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(source.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = prior_history_stream(stream, "key").writeStream.format("memory").queryName("stream_deals").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = sorted((r.ad_id, r.prior_n) for r in spark.sql("select * from stream_deals").collect())
    assert got == sorted((r.ad_id, r.prior_n) for r in M.prior_history_deals(source, ["key"]).collect())


def test_stream_expires_by_event_time(spark, tmp_path):
    """A backlog replayed at once: listings older than the days before an arrival don't count, whatever the clock says."""
    from tradewind.streaming.jobs import prior_history_stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    days = [0, 1, 2, 3, 4, 60, 61, 62, 63, 64, 100, 104, 250, 251, 252, 253, 254]
    rows = [(f"a{k:02d}", key, 900 - 30 * (k % 5), f"2024-01-01 {k % 24:02d}:00:00", d) for key in ("x", "y") for k, d in enumerate(days) if key == "x" or k % 4]
    source = spark.createDataFrame([(key + a, key, p, at, d) for a, key, p, at, d in rows], "ad_id string, key string, price bigint, at string, d int")
    source = source.select("ad_id", "key", "price", (F.col("at").cast("timestamp") + F.make_dt_interval("d")).alias("first_seen"), "d").cache()
    for k, (lo, hi) in enumerate(((0, 3), (3, 61), (61, 105), (105, 252), (252, 999))):
        source.filter(F.col("d").between(lo, hi - 1)).drop("d").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    schema = source.drop("d").schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = prior_history_stream(stream, "key", low=1, least=3, days=45).writeStream.format("memory").queryName("expiring").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = sorted((r.ad_id, r.prior_n) for r in spark.sql("select * from expiring").collect())
    want = sorted((r.ad_id, r.prior_n) for r in M.prior_history_deals(source, ["key"], low=1, least=3, days=45).collect())
    assert got == want and want
    assert want != sorted((r.ad_id, r.prior_n) for r in M.prior_history_deals(source, ["key"], low=1, least=3).collect())


def test_history_rewrites_touched_buckets_only(spark, tmp_path):
    from tradewind.operators.history import upsert
    from tradewind.streaming.jobs import History

    table = History(spark, str(tmp_path / "h"), buckets=8)
    row = lambda ids, price, day: spark.createDataFrame([(i, price, f"2024-01-0{day} 00:00:00") for i in ids], "ad_id string, price bigint, t string").select("ad_id", "price", F.col("t").cast("timestamp").alias("first_seen"), F.col("t").cast("timestamp").alias("last_seen"))
    merged = lambda old, new: upsert(old, new, "ad_id")
    first, fresh = table.merge(row([f"a{k}" for k in range(60)], 1, 1), "ad_id", (0, 0), merged)
    assert len(first) == 8 and fresh.count() == 60
    second, fresh = table.merge(row(["a1", "zz"], 2, 2), "ad_id", (0, 1), merged)
    assert sorted(r.ad_id for r in fresh.collect()) == ["zz"]
    assert 1 <= sum(first[b] != second[b] for b in first) <= 2  # two keys, two buckets at most
    again, _ = table.merge(row(["a1", "zz"], 2, 2), "ad_id", (0, 1), merged)  # a repeated batch
    assert again == second
    got = {r.ad_id: (r.price, r.first_seen.day) for r in table.read(again).collect()}
    assert len(got) == 61 and got["a1"] == (2, 1) and got["zz"] == (2, 2) and got["a2"] == (1, 1)
    table.prune(1)
    assert table.versions() == [(0, 1)] and table.read(table.files((0, 1))).count() == 61


def test_scan_job(spark, tmp_path):
    from tradewind.streaming.jobs import History, scan_job

    for k, prices in enumerate(([900, 950, 920, 940], [850])):
        arrivals(spark, prices, start=4 * k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = arrivals(spark, [1]).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    deals = lambda history, fresh: M.prior_history_deals(history, ["key"]).join(fresh.select("ad_id"), "ad_id", "left_semi")
    scan = lambda cp: scan_job(stream, str(tmp_path / "h"), str(tmp_path / "l"), str(tmp_path / "o"), "ad_id", deals, str(tmp_path / cp), [F.desc("first_seen")], counters=str(tmp_path / "c"))
    history = History(spark, str(tmp_path / "h"))
    newest = lambda: history.read(history.files(max(history.versions())))
    assert scan("cp").awaitTermination(120)
    assert [r.ad_id for r in spark.read.parquet(str(tmp_path / "o")).collect()] == ["a04"]
    assert newest().count() == 5
    # A new checkpoint goes on from the history: nothing is new, nothing is sent twice.
    arrivals(spark, [500], start=5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert scan("cp2").awaitTermination(120)
    assert sorted(r.ad_id for r in spark.read.parquet(str(tmp_path / "o")).collect()) == ["a04", "a05"]
    assert newest().count() == 6
    told = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "c")).select("run", "fetched", "distinct_keys", "new_keys", "deals").collect())
    assert sum(r[1] for r in told if r[0] == 0) == 5 and sum(r[3] for r in told) == 6 and sum(r[4] for r in told) == 2
    assert [sum(r[k] for r in told if r[0] == 1) for k in (1, 2, 3, 4)] == [6, 6, 1, 1]


def test_prior_history_of_a_large_group_in_ranges(spark):
    rows = [(f"a{k:05d}", "hot" if k % 3 else None, 100 + k * 7919 % 101, k // 7) for k in range(2000)]
    df = spark.createDataFrame(rows, "ad_id string, key string, price bigint, s int").select("ad_id", "key", "price", F.timestamp_seconds("s").alias("first_seen"))
    told = lambda **o: sorted(map(str, M.prior_history(df, ["key"], **o).select("ad_id", "prior_n", "prior_avg").collect()))
    assert told(split_rows=500) == told()
    ranges = M.prior_history(df, ["key"], split_rows=500)
    assert sorted(ranges.columns) == sorted(M.prior_history(df, ["key"]).columns)
    sizes = [n for n in ranges.withColumn("p", F.spark_partition_id()).groupBy("p").count().toPandas()["count"]]
    assert len(sizes) >= 3 and max(sizes) < 1200


def test_json_walk_to_the_last_level(spark):
    import json

    from tradewind.sources.payloads import json_walk

    deep = '{"token":"abcde9","title":"x"}'
    for k in range(20):
        deep = f'{{"a":[1,{deep}],"b{k}":{{}}}}'
    df = spark.createDataFrame([(1, deep), (2, '{"q":[]}'), (3, None), (4, "bad")], "k int, p string")

    def walk(v, pos, path):
        yield pos, path
        inside = [(f".{k}", x) for k, x in sorted(v.items())] if isinstance(v, dict) else [(f"[{k}]", x) for k, x in enumerate(v)] if isinstance(v, list) else []
        for k, (step, x) in enumerate(inside):
            yield from walk(x, [*pos, k], path + step)

    got = json_walk(df, "k", "p", depth=3).orderBy("k", "pos").collect()
    assert [(r.pos, r.path) for r in got if r.k == 1] == list(walk(json.loads(deep), [], "$"))
    assert [r.path for r in got if r.k > 1] == ["$", "$.q"]


@pytest.mark.parametrize("keys", [["brand", "trim"], ["trim"]])
def test_slabs_of_hot_stretches_give_the_same_medians(spark, keys):
    from tradewind.sources.tables import listings

    ads = listings(spark, "/root/testdata/sf0.001").filter("brand < 'Brand#3'")
    told = lambda f, **o: sorted(map(str, f(ads, keys, **o).collect()))
    peers = lambda *a, **o: M.peer_median_opportunities(*a, tolerance=2000, min_discount=50, **o)
    assert told(peers) == told(peers, cell_points=60)
    assert told(M.local_median) == told(M.local_median, cell_points=60)


def test_ranks_against_sorting():
    import numpy as np

    from tradewind.operators.bands import Ranks

    rng = np.random.default_rng(3)
    values, weights = rng.integers(0, 40, 300), rng.integers(1, 4, 300)
    ranks = Ranks(values, weights)
    low = rng.integers(0, 300, 200)
    high = np.minimum(300, low + rng.integers(0, 120, 200))
    for a, b in zip(low, high, strict=True):
        own = np.repeat(values[a:b], weights[a:b])
        own.sort()
        one = lambda f, *x: f(np.array([a]), np.array([b]), *map(np.array, x))[0]  # noqa: B023, E731
        assert one(ranks.weight) == len(own)
        for k in {0, len(own) // 2, len(own) - 1} if len(own) else ():
            assert one(ranks.at, [k]) == own[k]
        for x in (-1, 7.5, 20, 99):
            assert one(ranks.below, [x]) == (own < x).sum() and ranks.below(np.array([a]), np.array([b]), np.array([x]), to=True)[0] == (own <= x).sum()


def test_automaton_equals_the_column_expression(spark):
    """The same aliases with and without borders, overlapping, at the ends, and beside letters."""
    from tradewind.functions.automaton import Lexicon

    aliases = {"ab": "1", "ab c": "2", "c": "3", "پژو": "4", "پژو 206": "5", "x1": "6", "206": "7"}
    texts = ["ab c", "abc", "cab c", "xab c1", "پژو206", "پژو 206", "پژو 2061", "ax1", "x1", "x1 x1b", "", None, "206 ab", "_ab", "-c-"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for bounded in (True, False):
        lexicon = Lexicon(lambda p: p)
        import re

        numbers = lexicon.add(aliases, lambda p: "word" if bounded else "latin" if re.fullmatch("[a-z0-9 ]+", p) else "")
        df2 = df.withColumn("h", lexicon.hits(F.col("t")))
        got = df2.select("k", lexicon.best(F.col("h"), numbers).alias("a"), T.longest_alias(F.col("t"), aliases, bounded=bounded).alias("b")).collect()
        assert all(r.a == r.b for r in got), got



def test_new_listings_once(spark, tmp_path):
    from tradewind.streaming.jobs import new_listings

    arrivals(spark, [1, 2, 3]).coalesce(1).write.parquet(str(tmp_path / "in"))
    arrivals(spark, [9, 8], start=2).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(arrivals(spark, [1]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = new_listings(stream).writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r.ad_id for r in spark.sql("select * from fresh").collect()) == ["a00", "a01", "a02", "a03"]


def test_quartiles_of_a_hot_group(spark):
    """One group with spread prices, cut into ranges, beside small ones and one with a null key: as by percentile."""
    import random

    rng = random.Random(9)
    rows = [("hot", rng.randrange(1, 1_000_000)) for _ in range(4001)] + [("hot", 77)] * 50 + [("few", 10), ("few", 20), (None, 5), ("none", 0)]
    df = spark.createDataFrame(rows, "key string, price bigint")
    told = lambda **o: sorted(map(str, M.group_quartiles(df, ["key"], **o).select("key", "q1", "median", "q3", "n").collect()))
    p = lambda q: F.percentile("price", F.lit(q))
    plain = df.filter("price > 0").groupBy("key").agg(p(0.25).alias("q1"), p(0.5).alias("median"), p(0.75).alias("q3"), F.count("*").alias("n"))
    assert told() == told(split_prices=100) == sorted(map(str, plain.collect()))


def test_substring_lookup_against_brute_force(spark):
    import random

    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    table = [(k, word(rng.choice([1, 2, 3, 4, 6, 9])), 100 + k) for k in range(60)] + [(60, "zz", 7), (61, None, 8), (62, "", 9)]
    names = [*{word(n) for n in (1, 2, 3, 5, 8, 30, 60) for _ in range(12)}, "", None, "xxzzxx"]
    names.append(names[0])
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "id int, name string")
    got = {r.id: r.price for r in V.substring_lookup(df, spark.createDataFrame(table, "ord int, key string, price bigint")).collect()}
    for k, n in enumerate(names):
        assert got[k] == (None if n is None else next((p for _, key, p in table if key is not None and key in n), None)), n


def test_group_listings_read_a_text_once(spark, monkeypatch):
    texts = [("پژو 206 تیپ 5", "مدل 1390 کارکرد 17000 کیلومتر", None), ("سوناتا", "1402 سال", "Hyundai"), (None, "مدل 1390", None), ("x", None, ""), (None, None, None), ("دنا پلاس توربو", "مدل 1399", "brand?")]
    rows = spark.createDataFrame([(i, *texts[i % len(texts)]) for i in range(600)], "id int, title string, description string, brand string").repartition(5)
    read, own = [], V._group_told
    monkeypatch.setattr(V, "_group_told", lambda rows, *a: read.append(rows.count()) or own(rows, *a))
    stated = ("brand", None, None, None)
    out = V.group_listings(rows, "title", "description", stated)
    assert read == [len(texts)]
    want = sorted(map(str, own(rows, "title", "description", stated).collect()))
    assert out.columns == own(rows, "title", "description", stated).columns
    assert sorted(map(str, out.collect())) == want
    # Of many texts too, by a join that isn't broadcast; and where most rows have their own, each for itself.
    monkeypatch.setattr(V, "FEW_TEXTS", 2)
    assert sorted(map(str, V.group_listings(rows, "title", "description", stated).collect())) == want
    V.group_listings(rows.filter("id < 8"), "title", "description", stated)
    assert read == [len(texts), len(texts), 8]
