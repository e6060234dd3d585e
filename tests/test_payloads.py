"""Payloads read in one walk where they lie: no exchange, nothing written, the rules of the walks."""

import json

from pyspark.sql import functions as F

from tradewind.functions import text as T
from tradewind.operators import validation as V
from tradewind.sources import payloads as PL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cards_are_told_without_an_exchange(spark):
    deep = {"token": "deep-1", "title": "below"}
    for _ in range(30):
        deep = {"rows": [deep]}
    listed = {"web_widgets": {"post_list": [{"data": {"title": " a‌b ", "token": "one-1"}}, {"token": "one-1"}, {"url": "/v/x/two-22", "header": "H"}]}, "more": [{"token": "other"}]}
    rows = [(1, json.dumps(listed)), (2, json.dumps(deep)), (3, "{"), (4, None), (None, json.dumps({"x": [{"token": None, "url": "/v/three3", "name": 5}]}))]
    out = PL.json_cards(spark.createDataFrame(rows, "id int, json string"), "id", "json")
    assert "Exchange" not in plan(out) and "Join" not in plan(out)
    want = {(1, 0, "one-1", "a b"), (1, 1, "two-22", "H"), (2, 0, "deep-1", "below"), (None, 0, "three3", PL.NO_TITLE)}
    got = {tuple(r) for r in out.collect()}
    # The items around the deepest one hold its token too; the first of them counts.
    assert got == want


def test_plain_text_is_what_spark_makes(spark):
    texts = ["  پژو  ۲۰۶‌٣ ", "كيىةۀؤإأٱ", "مُدِل﻿x‏", "\x1c\x85\xa0 a　 b\n", "", "İK KELVIN K Σς"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", T.normalize_text(F.col("t")).alias("n"), T.compact_text(F.col("t")).alias("c")).collect():
        assert T.plain_text(r.t) == r.n
        assert T.plain_compact(r.n) == r.c


def test_listings_are_what_the_walks_tell(spark):
    card = {"data": {"title": "پژو ۲۰۶", "token": "tok_1", "thumbnail": "http://x/y.jpg?s"}, "name": "n"}
    details = [
        {"rows": [{"label": "قیمت پایه", "value": "123400000"}], "text": "مدل 1390 کارکرد 17000 کیلومتر", "city_name": None, "city": "x"},
        {"price": 45_000_000, "title": "آگهی خودرو", "name": [{"price_value": "۲٫۵ میلیارد تومان", "token": "tok_9"}], "district": "  d  e "},
        {"value": {"key": "price", "raw_value": 50_000_000.5, "number": True}, "data": {"header": "h"}, "token": "no"},
        [],
        "قیمت 300 میلیون تومان",
    ]
    rows = [(i, json.dumps(card if i % 2 == 0 else {"x": 1}), json.dumps(d)) for i, d in enumerate(details)]
    rows += [(7, json.dumps(card), None), (8, json.dumps(card), "{"), (9, "{", "{}"), (10, None, "{}")]
    payloads = spark.createDataFrame(rows, "id int, card string, detail string")
    built = V.build_listings(payloads, "id", "card", "detail", "2024-01-01")
    assert "Exchange" not in plan(built)
    out = {r.id: r for r in built.collect()}
    assert sorted(out) == [0, 1, 2, 4, 7, 8]
    walk = PL.json_walk(spark.createDataFrame([(i, r.source_json) for i, r in out.items()], "id int, json string"), "id", "json")
    same = {
        "price_toman": PL.json_price(walk, "id").withColumnRenamed("price", "v"),
        "description": PL.json_all_text(walk, "id").withColumnRenamed("all_text", "v"),
        "image_url": PL.json_image(walk, "id").withColumnRenamed("image_url", "v"),
        "city": PL.json_first_value(walk, "id", ["city_name", "city"], "v"),
        "district": PL.json_first_value(walk, "id", ["district"], "v"),
    }
    for column, told in same.items():
        want = {r.id: r.v for r in told.collect()}
        assert {i: r[column] for i, r in out.items() if r[column]} == want, column
    assert [out[i].token for i in (0, 1, 2)] == ["tok_1", "tok_9", "tok_1"]
    assert out[2].title == "h" and out[8].title == "پژو 206"
